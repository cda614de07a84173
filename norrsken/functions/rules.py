"""Scoring rules as data: a condition, its points and the text it leaves."""

from __future__ import annotations

from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column, functions as F

from norrsken.functions.text import texts


class Rule(NamedTuple):
    test: Column
    points: float = 0.0
    text: Column | str | None = None


def _as_text(rule: Rule) -> Column:
    return F.when(rule.test, F.lit(rule.text) if isinstance(rule.text, str) else rule.text)


def total_points(rules: list[Rule]) -> Column:
    """Sum of the points of all rules that hold; an unknown (null) condition does not hold."""
    return reduce(add, (F.when(r.test, F.lit(r.points)).otherwise(0.0) for r in rules if r.points))


def fired_texts(rules: list[Rule]) -> Column:
    """Texts of all rules that hold, in rule order."""
    return texts(*(_as_text(r) for r in rules if r.text is not None))


def first_match(*branches: tuple[Column, Column], otherwise: Column) -> Column:
    """An ordered case: the first branch whose condition holds decides."""
    chain = F.when(*branches[0])
    for test, result in branches[1:]:
        chain = chain.when(test, result)
    return chain.otherwise(otherwise)

"""Words of whole texts as bytes: runs of ASCII letters, digits and everything beyond ASCII, only A-Z lower-cased.

Every byte of a character beyond ASCII is 128 or more, so words of UTF-8 text can be cut at bytes.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of words in lower case, all others as blanks.
FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_WORD = re.compile(rb"[^ ]+")


def words_of(raw: bytes | None) -> list[bytes]:
    """The words of a text; null has none."""
    return raw.translate(FOLD).split() if raw else []


def word_bounds(raw: bytes) -> list[tuple[int, int]]:
    """Start and end byte of each word."""
    return [m.span() for m in _WORD.finditer(raw.translate(FOLD))]


def binary_texts(df: DataFrame, id: str, text: str, *more: Column) -> DataFrame:
    """doc_id and the text's bytes under fixed names, so that further columns cannot clash."""
    return df.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"), *more)


def blocks_of(items: DataFrame, text: str, limit: int) -> tuple[DataFrame, int]:
    """Items with ``block``, and the number of blocks, each of about ``limit`` bytes of text.

    A block is what a driver or task may hold whole; a block has at least one item however long.
    """
    size = items.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    blocks = max(1, -(-size // limit))
    return items.withColumn("block", F.pmod(F.xxhash64(*items.columns), F.lit(blocks))), blocks

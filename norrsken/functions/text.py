"""Text column functions: keys, cleanup, public wording."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from norrsken import constants as K

_BLANKS = " \t\n\r\f\x0b"
_SEPARATOR = "\u0001"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def non_empty(text: Column) -> Column:
    return F.when(text != "", text)


def clean_key(text: Column) -> Column:
    return F.upper(strip(text))


def clean_text(text: Column) -> Column:
    """Blank runs collapse to one blank; nothing left is null."""
    return non_empty(F.trim(F.regexp_replace(text, r"\s+", " ")))


def signal_key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"\s+", " "))


def capitalised(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2**31 - 1))


def texts(*candidates: Column) -> Column:
    """The non-null candidates in order. The candidates of one call are distinct texts.

    ``array_except`` against a null drops the nulls inside generated code, which the
    lambda-based ``array_compact`` does not.
    """
    return F.array_except(F.array(*candidates), F.array(F.lit(None).cast("string")))


def searchable(items: Column) -> Column:
    """One lower-case text of all items, for substring tests that hit if any item has it."""
    return F.lower(F.array_join(items, _SEPARATOR))


def has_signal(joined: Column, needle: str) -> Column:
    return F.coalesce(joined.contains(needle.lower()), F.lit(False))


def text_keys(items: Column) -> Column:
    """What makes texts equal: no case, no outer blanks."""
    return F.transform(items, lambda x: F.lower(strip(x)))


def may_repeat(items: Column) -> Column:
    """False only where no two texts are equal without case and blanks. Compiled, unlike ``text_keys``."""
    bare = F.split(F.translate(F.lower(F.array_join(items, _SEPARATOR)), _BLANKS, ""), _SEPARATOR)
    return F.size(F.array_distinct(bare)) < F.size(bare)


def distinct_texts(items: Column, keys: Column) -> Column:
    """The first item per key. Pass ``keys`` as a column, as it is read for every item."""
    return F.filter(items, lambda x, i: F.array_position(keys, keys[i]) == i + 1)


def listing_segment(raw: Column) -> Column:
    low = F.lower(strip(F.coalesce(raw, F.lit(""))))
    spaced = F.translate(low, "-", " ")
    return (
        F.when(spaced.contains("first north") | (spaced == "first_north"), "first_north")
        .when(spaced.contains("spotlight"), "spotlight")
        .when(spaced.contains("main"), "main_market")
        .otherwise("other_public")
    )


def isin_country(isin: Column) -> Column:
    prefix = F.substring(clean_key(isin), 1, 2)
    return F.when(prefix.isin(*K.LISTING_COUNTRIES), prefix).otherwise("")


def company_key(name: Column, fallback: Column) -> Column:
    """Name without legal form and share class, so that A and B shares meet."""
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "))
    tail = "(^| )((" + "|".join(K.NAME_SUFFIXES) + ")( |$))+$"
    stem = F.trim(F.regexp_replace(words, tail, ""))
    return F.coalesce(non_empty(stem), fallback)


def pick_company_key(name: Column, ticker: Column) -> Column:
    """As ``company_key``, but the ticker stands in only for a missing name."""
    stem = company_key(name, F.lit(""))
    return F.when(strip(F.coalesce(name, F.lit(""))) == "", clean_key(ticker)).otherwise(stem)


def symbol_candidates(ticker: Column, country: Column) -> Column:
    """Lookup symbols in the order to try them: hyphenated, then compact if different."""
    suffixes = F.create_map(*(F.lit(p) for pair in K.SYMBOL_SUFFIXES.items() for p in pair))
    suffix = F.try_element_at(suffixes, F.upper(country))
    hyphenated = F.regexp_replace(clean_key(ticker), r"\s+", "-")
    compact = F.translate(hyphenated, "-", "")
    return F.when(
        suffix.isNotNull(),
        F.array_distinct(F.array(F.concat(hyphenated, suffix), F.concat(compact, suffix))),
    ).otherwise(F.array().cast("array<string>"))


# --- fixed values: public wording -----------------------------------------------------------
_STRATEGY_NOTES = {
    "trading strategy adjustment applied": (
        "Trading strategy boost: liquidity and momentum signals make this more relevant for a "
        "short-term watchlist."
    ),
    "long-term strategy adjustment applied": (
        "Long-term strategy boost: valuation or balance-sheet signals make this more relevant "
        "for fundamental research."
    ),
    "discovery strategy adjustment applied": (
        "Discovery strategy boost: smaller or less-covered listing profile."
    ),
}
_INTERNAL_FLAGS = (
    "sparse live-source data", "thin data quality", "partial data quality",
    "missing live turnover",
)
_SIGNAL_LABELS = {
    "bucket": "Bucket",
    "country": "Country",
    "gate": "Gate",
    "gate_durable_anchors": "Gate durable anchors",
    "gate_severe_proof_gaps": "Gate severe proof gaps",
    "proof_gap": "Proof gap",
    "quality": "Quality",
    "quality_bucket": "Bucket",
    "reason": "Reason",
    "segment": "Segment",
    "strategy": "Strategy",
    "valuation_proxy": "Valuation proxy",
}
_VERBATIM_SIGNALS = ("gate", "gate_durable_anchors", "gate_severe_proof_gaps", "quality_bucket")


def public_reason(item: Column) -> Column:
    clean = strip(item)
    wording = capitalised(clean)
    for note, public in _STRATEGY_NOTES.items():
        wording = F.when(F.lower(clean) == note, public).otherwise(wording)
    return wording


def public_reasons(items: Column) -> Column:
    return F.filter(F.transform(items, public_reason), lambda x: x != "")


def public_risks(items: Column) -> Column:
    """Risks for readers: internal flags dropped, first letter raised."""

    def shown(x: Column) -> Column:
        low = F.lower(strip(x))
        hidden = (
            low.isin(*_INTERNAL_FLAGS)
            | low.endswith(" stated risk(s)")
            | low.endswith("strategy adjustment applied")
            | (low == "")
        )
        return ~hidden

    return F.transform(F.filter(items, shown), lambda x: capitalised(strip(x)))


def signal_label(signal: Column) -> Column:
    """Display text of a ``prefix:value`` signal."""
    prefix = F.substring_index(signal, ":", 1)
    value = F.when(
        F.instr(signal, ":") > 0,
        F.substring(signal, F.length(prefix) + F.lit(2), F.length(signal)),
    ).otherwise("")
    labels = F.create_map(*(F.lit(p) for pair in _SIGNAL_LABELS.items() for p in pair))
    label = F.coalesce(F.try_element_at(labels, prefix), F.initcap(prefix))
    readable = capitalised(F.translate(value, "_", " "))
    return F.concat(
        label, F.lit(": "), F.when(prefix.isin(*_VERBATIM_SIGNALS), value).otherwise(readable)
    )

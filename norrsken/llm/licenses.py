"""License scans: exact phrase places, and fuzzy search for short notices.

A text becomes its words, joined by single spaces. A notice of m characters may differ by up to k
edits; of its k + 1 consecutive parts at least one then stands unchanged in the text (pigeonhole). One
automaton over the parts of all notices finds these seeds; only the windows around them are given to
the regex library's bounded-error matching, which verifies the edits and reports the span.

Defined cases: null or empty text has no words, no labels and score 0; repeated rows and null ids give
a row each; only id and text are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from norrsken.llm.common import documents, pick, slices, texts_of

#: Phrases whose exact places are counted, with their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Short notices searched with errors: words of the published licenses as they open or name themselves.
NOTICES = {
    "gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license": "apache",
    "apache license version 2 0": "apache",
    "creative commons attribution": "cc-by",
    "licensed under cc by": "cc-by",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "all rights reserved": "all-rights-reserved",
    "spdx license identifier": "spdx",
}

#: Base phrases that are also searched with errors, as whole words. In "mit license" only the second word may
#: differ, as "omit license" is one edit away; "cc by" is too short for an edit.
SHORT = {"mit license": "mit", "apache license": "apache"}
#: A first word of so few characters stands as it is.
FIXED_WORD = 3

#: One edit is allowed for so many characters of a notice.
CHARS_PER_EDIT = 10
#: Notices' lengths of a stretch that are searched at once.
PART = 16
BATCH_BYTES = 8 << 20

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
    "labels string, score double, spans array<struct<label:string,start:long,end:long,edits:int>>"
)

_LETTERS = np.arange(256, dtype=np.uint8)
_LETTERS[:0x30] = _LETTERS[0x3A:0x61] = _LETTERS[0x7B:0x80] = 0x20
_LETTERS[ord("A"):ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)
#: ASCII other than letters and digits becomes a space; A-Z becomes lower case; all else stays.
TABLE = _LETTERS.tobytes()


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


class Notices:
    def __init__(self, notices: dict[str, str] | None = None, chars_per_edit: int = CHARS_PER_EDIT, whole_words: bool = False):
        self.notices = []
        self.edge = int(whole_words)
        self.seeds = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = {}
        for number, (notice, label) in enumerate((notices or NOTICES).items()):
            edits = len(notice) // chars_per_edit
            first = notice.split(" ")[0] + " "
            fixed = first if whole_words and len(first) <= FIXED_WORD + 1 else ""
            fuzzy = f"{regex.escape(fixed)}(?:{regex.escape(notice[len(fixed):])}){{e<={edits}}}"
            pattern = regex.compile(f"(?b)(?<= ){fuzzy}(?= )" if whole_words else f"(?b){fuzzy}")
            self.notices.append((notice, label, edits, pattern))
            cuts = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
            for a, b in zip(cuts, cuts[1:]):
                places.setdefault(notice[a:b], []).append((number, a, len(notice[a:b])))
        for seed, where in places.items():
            self.seeds.add_word(seed, where)
        self.seeds.make_automaton()

    def windows(self, text: str) -> dict[int, list[list[int]]]:
        """Per notice, the merged stretches of the text in which a match would have to lie."""
        found: dict[int, list[list[int]]] = {}
        for end, places in self.seeds.iter(text):
            for number, offset, length in places:
                notice, _, edits, _ = self.notices[number]
                start = end - length + 1 - offset
                # The match begins and ends within ``edits`` characters of where the seed puts it.
                low, high = max(0, start - 2 * edits), start + len(notice) + 2 * edits
                stretches = found.setdefault(number, [])
                if stretches and low <= stretches[-1][1]:
                    stretches[-1][0] = min(stretches[-1][0], low)
                    stretches[-1][1] = max(stretches[-1][1], high)
                else:
                    stretches.append([low, high])
        return found

    def matches(self, text: str) -> list[tuple[str, int, int, int, float]]:
        """label, start, end, edits, likeness of each match, in the joined words."""
        out = []
        for number, stretches in self.windows(text).items():
            notice, label, most, pattern = self.notices[number]
            # The best match of a stretch is found first, then what stands on either side of it. A stretch is read
            # from the left in parts of PART notices, so that a long one takes as many searches as it has matches.
            length = len(notice) + most + 2 * self.edge
            todo = [(max(0, low - self.edge), min(len(text), high + self.edge)) for low, high in stretches]
            while todo:
                low, high = todo.pop()
                if high - low < len(notice) - most:
                    continue
                cut = min(high, low + PART * length)
                m = pattern.search(text[low:cut])
                if m and low + m.end() > cut - length and cut < high:
                    # One that reaches beyond the cut may be better.
                    m = pattern.search(text[low:cut + length])
                if not m:
                    if cut < high:
                        todo.append((cut - length + 1, high))
                    continue
                start, end, edits = low + m.start(), low + m.end(), sum(m.fuzzy_counts)
                out.append((label, start, end, edits, 1 - edits / len(notice)))
                todo += [(end, high), (low, start)]
        return sorted(set(out))


def phrase_places(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which the phrase's words stand. ``joined`` has a space on both ends."""
    needle, at, places, word, last = b" " + phrase + b" ", 0, [], 0, 0
    while (at := joined.find(needle, at)) >= 0:
        word += joined.count(b" ", last, at)
        last = at
        places.append(word)
        at += 1
    return places


@lru_cache(maxsize=1)
def short_notices() -> Notices:
    return Notices(SHORT, whole_words=True)


def scan(text: str, notices: Notices) -> tuple:
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" "
    places, base = [], set()
    for phrase, label in PHRASES.items():
        if found := phrase_places(joined, phrase.encode()):
            places += found
            base.add(label)
    text = joined.decode("utf-8", "surrogatepass")
    matches = sorted({*notices.matches(text), *short_notices().matches(text)}) if words else []
    labels = base | {m[0] for m in matches}
    score = 1.0 if base else max((m[4] for m in matches), default=0.0)
    return (
        len(words), len(places), min(places, default=None), max(places, default=None),
        ",".join(sorted(base)), ",".join(sorted(labels)), score,
        [{"label": m[0], "start": m[1] - 1, "end": m[2] - 1, "edits": m[3]} for m in matches],
    )


def license_scan(df: DataFrame, id: str = "doc_id", text: str = "text",
                 notices: dict[str, str] | None = None) -> DataFrame:
    """A row per document: base phrase places, labels, score, and the spans of fuzzy matches.

    Spans count characters of the words joined by single spaces. The score is 1 where a base phrase
    stands, else 1 - edits / length of the best notice found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Notices(notices)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(),
                 pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                                     ("edits", pa.int32())]))]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in slices(batches, "text", BATCH_BYTES):
            columns = zip(*[scan(t, known) for t in texts_of(batch.column("text"))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *[pa.array(c, k) for c, k in zip(columns, kinds)]],
                ["doc_id", *names],
            )

    return pick(df, doc_id=id, text=text).mapInArrow(run, SCHEMA)


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(documents(spark, sf_dir))

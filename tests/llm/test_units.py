"""Substring dedup against a plain version."""

from __future__ import annotations

import re

from norrsken.llm.substring_dedup import MIN_WORDS, substring_dedup, units_of, without


def _key(piece):
    return " ".join(piece.lower().split())


def _pieces(line):
    """Start and end of the units within a line: the line, its longer sentences, their rests from the last capital on."""
    out = {(0, len(line))} if line.split() else set()
    ends = [m.end() for m in re.finditer(r"[.!?…。！？]\s+", line)]
    for a, b in zip([0, *ends], [*ends, len(line)]):
        starts = [m.start() for m in re.finditer(r"\S+", line[a:b])]
        capitals = [k for k, s in enumerate(starts) if k and line[a + s].isupper()]
        for k in {0, *capitals[-1:]}:
            if len(starts) - k >= MIN_WORDS:
                out.add((a + starts[k] if k else a, b))
    return out


def _plain(rows):
    places = {}
    opened = []
    for i, text in rows:
        at, units = 0, []
        for line in (text or "").split("\n"):
            units += [(at + a, b - a, _key(line[a:b])) for a, b in _pieces(line)]
            at += len(line) + 1
        opened.append((2**63 if i is None else i, text, units))
        for start, length, key in units:
            places.setdefault(key, []).append((opened[-1][0], start, length))
    firsts = {k: min(v) for k, v in places.items()}
    out = []
    for (i, text), (rank, _, units) in zip(rows, opened):
        gone = [False] * len(text or "")
        for start, length, key in units:
            if (rank, start, length) != firsts[key]:
                gone[start:start + length] = [True] * length
        kept, spans, at = [], [], 0
        for line in text.split("\n") if text is not None else ():
            mine = gone[at:at + len(line)]
            if not line or not all(mine):
                kept.append("".join(x for x, g in zip(line, mine) if not g))
            spans += [(at + m.start(), len(m.group())) for m in re.finditer("x+", "".join("x" if g else "-" for g in mine))]
            at += len(line) + 1
        out.append((i, 0 if text is None else text.count("\n") + 1, len(spans), tuple(spans), None if text is None else "\n".join(kept)))
    return sorted(out, key=repr)


def _mine(frame):
    return sorted(((r.doc_id, r.n_units, r.n_removed, tuple((s.start, s.length) for s in r.removed), r.clean_text)
                   for r in substring_dedup(frame).collect()), key=repr)


def test_documents_and_repeats(spark, docs, corpus, none):
    assert _mine(docs) == _plain(list(zip(corpus.doc_id.tolist(), corpus.text.tolist())))
    rows = [(1, "A b\n\nc"), (2, "a  B \nnew é\nnew é"), (3, None), (4, ""), (None, "c\nlast"), (5, "x" * 50_000 + "\nA B"), (6, "A b\n\nc"), (6, "A b\n\nc")]
    frame = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, unit int")
    assert _mine(frame) == _plain(rows)
    assert substring_dedup(none).count() == 0


PASSAGE = "One passage of more than eight words stands here. It is repeated, word for word, in many other texts of this set."


def test_passage_within_lines(spark):
    rows = [(1, f"First text. {PASSAGE} The end of it."), (2, f"other words before {PASSAGE} and after it"),
            (3, f"{PASSAGE}\nclean line"), (4, "A clean text of more than eight words that stands alone. Bye."), (5, f"Two. {PASSAGE}")]
    mine = _mine(spark.createDataFrame(rows, "doc_id long, text string"))
    assert mine == _plain(rows)
    texts = {r[0]: r[4] for r in mine}
    assert texts[1] == rows[0][1] and texts[4] == rows[3][1]
    assert texts[2] == "other words before and after it"
    assert texts[3] == "clean line" and texts[5] == "Two. "


def test_long_line_of_one_sentence_is_one_unit():
    text = "Word " * 20
    assert [u[:2] for u in units_of(text)][0] == (0, len(text))
    assert without("a\nb\nc", [(0, 1), (4, 1)]) == "b"

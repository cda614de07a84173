"""Token counts and packing against the library, byte for byte."""

from __future__ import annotations

import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from norrsken.llm import bpe
from norrsken.llm.packing import OpenBins, ids_by, packed, pieces
from norrsken.llm.token_counts import Counter, token_counts

PATH = bpe.vocabulary_path()


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def _encoded(library, texts):
    return [e.ids for e in library.encode_batch(list(texts), add_special_tokens=False)]


def test_counts_equal_library(docs, corpus, library):
    got = {r.doc_id: r for r in token_counts(docs).collect()}
    for d, text, ids in zip(corpus.doc_id, corpus.text, _encoded(library, corpus.text)):
        assert (got[d].n_tokens, got[d].n_bytes, got[d].over_limit) == (len(ids), len(text.encode()), len(ids) > 1024)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aab th e's 'll\n\t 012é語😀<|endoftext|>  ſ"), max_size=60), max_size=6))
def test_counts_of_any_text(texts):
    texts = texts + ["aaaaaaaaa", "ababababa", "<|endoftext|>", "a<|endoftext|><|endoftext|> b"]
    library = ids_by(PATH).library
    assert Counter(PATH).count(texts).tolist() == [len(i) for i in _encoded(library, texts)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab   's\n\t\x1c\x85\xa0\u20281é語.😀"), max_size=40), max_size=6))
def test_ids_of_any_white_space(texts):
    texts = texts + ["", " ", "a  <|endoftext|>  b", " \n x", "a \n  b ", "a\t b<|endoftext|>"]
    encoder = ids_by(PATH)
    want = [np.array([*i, 0], "<u4").tobytes() for i in _encoded(encoder.library, texts)]
    assert encoder.encode(texts) == want and encoder.encode(texts) == want


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("aaabthe é語Z9"), min_size=1, max_size=80))
def test_long_words_merge_like_short_ones(text):
    merges = bpe.merges(PATH)
    assert merges._alone(text.encode()).tolist() == merges._together([text.encode()])[0].tolist()


def test_long_words_against_library(library):
    rng = np.random.default_rng(2)
    letters = "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 80_000))
    texts = ["a" * 3001 + " b " + "ab" * 2000, letters[:5000], "語" * 4000, "x" * 511 + " " + "y" * 512, letters]
    began = time.perf_counter()
    counts = Counter(PATH).count(texts).tolist()
    assert time.perf_counter() - began < 5
    assert counts == [len(i) for i in _encoded(library, texts)]


def test_odd_rows(odd, none, odd_rows, library):
    got = sorted(tuple(r) for r in token_counts(odd).fillna({"doc_id": -1}).collect())
    want = sorted(
        (-1 if r[0] is None else r[0], len((r[1] or "").encode()), len(i), len(i) > 1024)
        for r, i in zip(odd_rows, _encoded(library, [r[1] or "" for r in odd_rows]))
    )
    assert got == want
    assert token_counts(none).count() == 0 and packed(pieces(none)).count() == 0


def _check_packing(rows, texts, library, capacity=2048):
    ids = {d: i + [0] for d, i in zip(texts, _encoded(library, texts.values()))}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
        part = np.array(ids[r.doc_id][r.start:r.start + r.length], "<u4").tobytes()
        assert zlib.crc32(part) == r.ids_crc32
    assert set(by_doc) == set(ids)
    for d, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts)))
        assert parts[0].start == 0 and parts[-1].start + parts[-1].length == len(ids[d])
        assert all(a.start + a.length == b.start for a, b in zip(parts, parts[1:]))
        assert all(p.length == capacity for p in parts[1:])
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r.offset)
        at = 0
        for p in parts:
            assert p.offset == at
            at += p.length
        assert at <= capacity
    return len(by_sequence), sum(map(len, ids.values()))


def test_packing(docs, corpus, library):
    rows = packed(pieces(docs)).collect()
    sequences, total = _check_packing(rows, dict(zip(corpus.doc_id, corpus.text)), library)
    assert sequences <= 1.03 * -(-total // 2048) + 1
    assert sorted(map(tuple, rows)) == sorted(map(tuple, packed(pieces(docs.repartition(5))).collect()))


def test_packing_repeated_rows(spark, odd, odd_rows):
    rows = packed(pieces(odd)).collect()
    assert sum(r.piece == 0 for r in rows) == len(odd_rows)
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_fullest_bin_closes():
    bins = OpenBins(10, 2)
    assert bins.place(6) == (0, 0)
    assert bins.place(7) == (1, 0)
    assert bins.place(5) == (2, 0)  # three would be open: bin 1, with 3 left, closes
    assert bins.place(3) == (0, 6)  # the fullest that has room
    assert bins.place(5) == (2, 5)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=80), st.integers(1, 5))
def test_bins_against_plain_search(lengths, most):
    bins, opened, plain = OpenBins(12, most), 0, []
    for n in lengths:
        fitting = [b for b in plain if b[1] >= n]
        least = min((b[1] for b in fitting), default=None)
        number, offset = bins.place(n)
        if fitting:
            chosen = next(b for b in plain if b[0] == number)
            assert chosen[1] == least and offset == 12 - least
            plain.remove(chosen)
            left = least - n
        else:
            assert (number, offset) == (opened, 0)
            opened += 1
            left = 12 - n
        if left:
            plain.append((number, left))
            if len(plain) > most:
                fullest = min(b[1] for b in plain)
                equal = [b for b in plain if b[1] == fullest]
                # Among equally full ones the new one closes, else the latest.
                plain.remove(equal[-1])

"""Pre-tokens and merge tables of a byte-level BPE vocabulary file."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import regex

#: The published split pattern of this family of vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

NO_RANK = np.iinfo(np.int32).max
#: Bytes from which on a pre-token is merged by itself.
LONG = 512


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself where it prints, else the next free code point from 256."""
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(printing) else chr(next(spare)) for b in range(256)]


class Merges:
    """Vocabulary of a file: symbols of single bytes, and pair -> (rank, merged symbol) as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        vocab, merges = content["model"]["vocab"], content["model"]["merges"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.width = max(vocab.values()) + 2
        keys = left * self.width + right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        self.by_rank = made
        self.of_byte = np.array([vocab[c] for c in byte_letters()], np.int32)
        self.special = {t["content"]: t["id"] for t in content.get("added_tokens", [])}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each adjacent pair, NO_RANK where the pair never merges."""
        keys = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.ranks[at], NO_RANK)

    def symbols(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Surviving symbols of all pre-tokens in one ragged array, and each one's length.

        Pre-tokens of LONG bytes and more are merged one by one, so that a round looks at changed pairs only.
        """
        n = len(tokens)
        if all(len(t) < LONG for t in tokens):
            return self._together(tokens)
        short = [i for i, t in enumerate(tokens) if len(t) < LONG]
        symbols, counts = self._together([tokens[i] for i in short])
        parts: list[np.ndarray] = [symbols[:0]] * n
        for i, part in zip(short, np.split(symbols, np.cumsum(counts)[:-1])):
            parts[i] = part
        for i, token in enumerate(tokens):
            if len(token) >= LONG:
                parts[i] = self._alone(token)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, n)

    def _alone(self, token: bytes) -> np.ndarray:
        """Symbols of one long pre-token: places of each rank are kept, and a merge looks up its two new pairs."""
        symbol = self.of_byte[np.frombuffer(token, np.uint8)]
        n = len(symbol)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        at_rank = np.full(n, NO_RANK, np.int32)  # rank of the pair that begins here; none where a symbol is gone
        places: dict[int, list[np.ndarray]] = {}
        lowest: list[int] = []

        def look_up(at: np.ndarray) -> None:
            at_rank[at] = NO_RANK
            at = at[after[at] < n]
            at_rank[at] = found = self.rank(symbol[at], symbol[after[at]])
            at, found = at[found != NO_RANK], found[found != NO_RANK]
            order = np.argsort(found, kind="stable")
            ranks, starts = np.unique(found[order], return_index=True)
            for rank, part in zip(ranks.tolist(), np.split(at[order], starts[1:])):
                if rank not in places:
                    places[rank] = []
                    heapq.heappush(lowest, rank)
                places[rank].append(part)

        look_up(np.arange(n))
        while lowest:
            rank = heapq.heappop(lowest)
            at = np.unique(np.concatenate(places.pop(rank)))
            at = at[at_rank[at] == rank]
            if not len(at):
                continue
            # In a run of equal symbols every other place counts.
            fresh = np.r_[True, after[at[:-1]] != at[1:]]
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            gone = after[at]
            symbol[at] = self.by_rank[rank]
            at_rank[gone] = NO_RANK
            after[at] = after[gone]
            inside = after[at] < n
            before[after[at[inside]]] = at[inside]
            left = before[at]
            look_up(np.unique(np.r_[at, left[left >= 0]]))
        alive = np.ones(n, bool)
        alive[1:] = after[before[1:]] == np.arange(1, n)
        return symbol[alive]

    def _together(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All pre-tokens at once.

        In every round each sequence looks up its lowest-ranked pair and merges all places of it
        (left to right where they overlap), for all sequences at once; finished ones are set aside.
        """
        n = len(tokens)
        if n == 0:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        lengths = np.fromiter(map(len, tokens), np.int64, n)
        flat = self.of_byte[np.frombuffer(b"".join(tokens), np.uint8)]
        owner = np.repeat(np.arange(n), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(flat):
            inside = owner[1:] == owner[:-1]
            ranks = np.full(len(flat), NO_RANK, np.int32)
            at = np.flatnonzero(inside)
            ranks[at] = self.rank(flat[at], flat[at + 1])
            starts = np.flatnonzero(np.r_[True, ~inside])
            lowest = np.minimum.reduceat(ranks, starts)
            each = np.repeat(lowest, np.diff(np.r_[starts, len(flat)]))
            hit = (ranks == each) & (ranks != NO_RANK)
            # Where places overlap (a pair of equal symbols in a run), every other one of the run counts.
            places = np.flatnonzero(hit)
            if len(places):
                fresh = np.r_[True, np.diff(places) > 1]
                first = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
                places = places[(np.arange(len(places)) - first) % 2 == 0]
            keep = np.ones(len(flat), bool)
            keep[places + 1] = False
            flat = flat.copy()
            flat[places] = self.by_rank[ranks[places]]
            finished = each == NO_RANK
            if finished.any():
                done.append((owner[finished], flat[finished]))
                keep &= ~finished
            flat, owner = flat[keep], owner[keep]
        owners = np.concatenate([o for o, _ in done])
        symbols = np.concatenate([s for _, s in done])
        order = np.argsort(owners, kind="stable")
        return symbols[order], np.bincount(owners, minlength=n)


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    return Merges(path)


def split_pattern() -> regex.Pattern:
    return regex.compile(SPLIT)


def any_of(special: list[str]) -> regex.Pattern | None:
    """Pattern of the special strings, longer ones first; None without any."""
    ordered = sorted(special, key=len, reverse=True)
    return regex.compile("|".join(map(regex.escape, ordered))) if ordered else None

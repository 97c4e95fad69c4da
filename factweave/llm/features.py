"""Hashed text features in flat arrays, and bounded samples of labelled documents."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_MIX = np.uint64(0xD6E8FEB86659FD93)
_CHUNK = 1 << 20
_BLANK = re.compile(r"[ \t\n\v\f\r]")


def _word_bytes() -> np.ndarray:
    """Letters, digits and all bytes of multi-byte characters."""
    table = np.zeros(256, dtype=bool)
    table[128:] = True
    for low, high in ((48, 58), (65, 91), (97, 123)):
        table[low:high] = True
    return table


def _blank_bytes() -> np.ndarray:
    """Everything but the six blanks."""
    table = np.ones(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = False
    return table


_WORD, _NOT_BLANK = _word_bytes(), _blank_bytes()


_POWERS: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base^2, ... as far as n; kept between batches of the usual size."""
    known = _POWERS.get(int(base))
    if known is None or len(known) < n:
        known = np.cumprod(np.r_[np.uint64(1), np.full(max(n, 2 * _CHUNK), base)])
        if n <= 8 * _CHUNK:
            _POWERS[int(base)] = known
    return known[:n]


class Words:
    """Words of a batch of texts: index of the text, place, substring hashes.

    Words are runs of letters and digits, lower-cased, or with `blank_separated` runs of
    other characters than blanks, with A-Z lower-cased only.
    A polynomial hash with running sums gives the hash of any part of any word in one step.
    """

    def __init__(self, texts: Sequence[str], blank_separated: bool = False):
        if blank_separated:
            raw = [t.encode("utf-8", "replace").lower() for t in texts]
        else:
            raw = [t.lower().encode("utf-8", "replace") for t in texts]
        self.buffer = np.frombuffer(b" ".join(raw) + b" ", dtype=np.uint8)
        inside = np.r_[False, (_NOT_BLANK if blank_separated else _WORD)[self.buffer]].astype(np.int8)
        edges = np.diff(inside)  # the last byte is a blank, so each word ends
        self.start, self.end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        self.doc = np.searchsorted(np.cumsum([len(r) + 1 for r in raw]), self.start, "right")
        n = len(self.buffer)
        self._back = _powers(_INVERSE, n + 1)
        self._sums = np.r_[np.uint64(0), np.cumsum((self.buffer + np.uint64(1)) * _powers(_BASE, n))]

    def hashes(self, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
        h = (self._sums[end] - self._sums[start]) * self._back[start] + np.uint64(salt)
        h = (h ^ (h >> np.uint64(32))) * _MIX
        return h ^ (h >> np.uint64(29))

    def prefix_ends(self, k: int) -> np.ndarray:
        """Where the first k characters of each word end; beyond the word's end if it is shorter."""
        begins = (self.buffer & 0xC0) != 0x80  # a byte that does not continue a character
        place = np.flatnonzero(begins)
        before = np.cumsum(begins)[self.start] - 1
        return np.where(before + k < len(place), place[np.minimum(before + k, len(place) - 1)], len(self.buffer))


def pieces(texts: Sequence[str], chars: int = _CHUNK) -> Iterator[tuple[list[int], list[str]]]:
    """Batches of about `chars` characters: text indices and texts; a longer text is cut at blanks."""
    index: list[int] = []
    held: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        at = 0
        while at < len(t) or (not t and at == 0):
            stop = len(t)
            if stop - at > chars:
                blank = _BLANK.search(t, at + chars)
                stop = blank.end() if blank else len(t)
            index.append(i)
            held.append(t[at:stop])
            size += stop - at
            at = max(stop, at + 1)
            if size >= chars:
                yield index, held
                index, held, size = [], [], 0
    if index:
        yield index, held


def labelled(labels: DataFrame, doc_id: str, label: str) -> DataFrame:
    """doc_id and label of every labelled document; of differing labels for one id the larger holds."""
    return labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label"))


def in_sample(key: Column, seed: int, share: float) -> Column:
    """Whether a key falls in a sample of the given share, by its hash."""
    if share >= 1:
        return F.lit(True)
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), key), 11) < int(share * (1 << 53))

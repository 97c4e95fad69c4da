"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes words at the marks that stand for spaces, since no piece of the vocabulary
crosses into a mark (checked when the model is loaded; otherwise a text is one word). The
distinct words of a batch that are not known yet lie behind one another in a flat symbol
array. In each round every adjacent pair is looked up in a hash table, a segmented minimum
gives each word its best pair, all its leftmost non-overlapping occurrences are merged at
once, the array is compacted, and words without a pair leave. The library merges one pair
at a time; doing all occurrences at once differs only where a merged piece can at once
join a neighbour at the same or a better rank. Such pieces are marked, and a word merges
only their leftmost occurrence in a round. Characters without a piece become byte pieces.

Words already encoded are remembered per worker up to a bound and then forgotten; a batch
is bounded by characters. Every text is handled where it lies, without a shuffle.

Defined results: a null text is an empty text, whose only id is the end id; any characters
are allowed; a text of any length is one row; repeated rows each get a row; an empty table
gives an empty result. Only id and text are read.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factweave.llm.text import read_table

MARK = "▁"
_WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_NONE = np.int32(1 << 30)
_KNOWN_WORDS = 400_000
_BATCH_CHARS = 1 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Model:
    """Tables of one vocabulary. Symbols 0..size-1 are pieces; characters that occur only inside pieces follow."""

    def __init__(self, path: str):
        source = sentencepiece.SentencePieceProcessor(model_file=path)
        n = source.get_piece_size()
        self.pieces = [source.id_to_piece(i) for i in range(n)]
        self.end = source.eos_id()
        plain = [i for i in range(n) if not (source.is_control(i) or source.is_unknown(i) or source.is_byte(i) or source.is_unused(i))]
        self.byte_ids = np.full(256, source.unk_id())
        self.byte_of = {}
        for i in range(n):
            if source.is_byte(i):
                value = int(self.pieces[i][3:5], 16)
                self.byte_ids[value], self.byte_of[i] = i, value
        self.silent = {i for i in range(n) if source.is_control(i)}
        self.unknown = source.unk_id()
        symbol = {self.pieces[i]: i for i in plain}
        self.whole = frozenset(symbol)
        for c in sorted({c for p in symbol for c in p} - set(symbol)):
            symbol[c] = n + len(symbol) - len(plain)
        self.size = n
        self.char_symbol = {c: s for c, s in symbol.items() if len(c) == 1}
        self.splits = not any(MARK in p.lstrip(MARK) for p in self.whole)
        scores = {p: source.get_score(symbol[p]) for p in self.whole}
        rank_of_score = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        rank = {p: rank_of_score[s] for p, s in scores.items()}
        keys, ranks, merged = [], [], []
        careful = np.zeros(n, dtype=bool)
        held: dict[int, str] = {}
        for p, r in rank.items():
            if held.setdefault(r, p) != p:  # pieces of equal score
                careful[symbol[p]] = careful[symbol[held[r]]] = True
            for i in range(1, len(p)):
                a, b = p[:i], p[i:]
                if a in symbol and b in symbol:
                    keys.append(symbol[a] << 32 | symbol[b])
                    ranks.append(r)
                    merged.append(symbol[p])
                for part in (a, b):
                    if part in rank and rank[part] >= r:
                        careful[symbol[part]] = True
        self.careful = careful
        self._hash(np.array(keys, dtype=np.uint64), np.array(ranks, dtype=np.int32), np.array(merged, dtype=np.int32))
        self.text = [str(i) for i in range(n)]
        self.shown = [p.replace(MARK, " ") for p in self.pieces]
        # Symbols whose ids or text need more than a look-up: the unknown piece, control and byte pieces, bare characters.
        self.special = np.ones(n + len(symbol) + 1, dtype=bool)
        self.special[plain] = False

    def _hash(self, keys: np.ndarray, ranks: np.ndarray, merged: np.ndarray) -> None:
        """Open addressing with linear probing, at most a quarter full."""
        bits = max(4, int(4 * len(keys)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), (1 << bits) - 1
        self._keys = np.full(1 << bits, np.iinfo(np.uint64).max, dtype=np.uint64)
        self._ranks = np.full(1 << bits, _NONE, dtype=np.int32)
        self._merged = np.zeros(1 << bits, dtype=np.int32)
        left = np.arange(len(keys))
        slot = ((keys * _MULTIPLIER) >> self._shift).astype(np.int64)
        self._probes = 0
        while len(left):
            free = self._keys[slot[left]] == np.iinfo(np.uint64).max
            at, first = np.unique(slot[left][free], return_index=True)
            chosen = left[free][first]
            self._keys[at], self._ranks[at], self._merged[at] = keys[chosen], ranks[chosen], merged[chosen]
            left = np.setdiff1d(left, chosen, assume_unique=True)
            slot[left] = (slot[left] + 1) & self._mask
            self._probes += 1

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of adjacent symbols; the rank of no piece is _NONE."""
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = ((key * _MULTIPLIER) >> self._shift).astype(np.int64)
        found = self._keys[slot]
        left = np.flatnonzero((found != key) & (found != np.iinfo(np.uint64).max))
        for _ in range(self._probes):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & self._mask
            found = self._keys[slot[left]]
            left = left[(found != key[left]) & (found != np.iinfo(np.uint64).max)]
        hit = self._keys[slot] == key
        return np.where(hit, self._ranks[slot], _NONE), self._merged[slot]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Final symbols of all words and the bounds of each word; negative symbols are code points without a piece."""
        text = "".join(words)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        distinct, inverse = np.unique(points, return_inverse=True)
        symbols = np.array([self.char_symbol.get(chr(c), -int(c) - 1) for c in distinct], dtype=np.int64)[inverse]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        done_symbols, done_words = [], []
        while len(symbols):
            inner = (word[1:] == word[:-1]) & (symbols[1:] >= 0) & (symbols[:-1] >= 0)
            rank, merged = np.full(len(symbols), _NONE, dtype=np.int32), np.zeros(len(symbols), dtype=np.int32)
            at = np.flatnonzero(inner)
            rank[at], merged[at] = self.pairs(symbols[at], symbols[at + 1])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(symbols)]))
            finished = best == _NONE
            if finished.any():
                done_symbols.append(symbols[finished])
                done_words.append(word[finished])
                keep = ~finished
                symbols, word, rank, merged, best = symbols[keep], word[keep], rank[keep], merged[keep], best[keep]
                if not len(symbols):
                    break
            here = np.flatnonzero(rank == best)
            # Of overlapping occurrences every other one, from the left.
            run = np.r_[True, np.diff(here) > 1]
            place = np.arange(len(here))
            here = here[(place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0]
            first = np.r_[True, word[here][1:] != word[here][:-1]]
            here = here[first | ~np.repeat(self.careful[merged[here[first]]], np.diff(np.r_[np.flatnonzero(first), len(here)]))]
            symbols[here] = merged[here]
            keep = np.ones(len(symbols), dtype=bool)
            keep[here + 1] = False
            symbols, word = symbols[keep], word[keep]
        if not done_words:
            return np.zeros(0, dtype=np.int64), np.zeros(len(words) + 1, dtype=np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        order = np.argsort(word, kind="stable")
        return symbols[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    def encode_words(self, words: list[str]) -> list[tuple[str, int, str]]:
        """Ids as text, their number and the decoded text of each word."""
        symbols, bounds = self.merge(words)
        hard = np.zeros(len(words), dtype=bool)
        odd = (symbols < 0) | self.special[np.maximum(symbols, 0)]
        hard[np.searchsorted(bounds, np.flatnonzero(odd), "right") - 1] = True
        flat, cuts = symbols.tolist(), bounds.tolist()
        out = []
        for i, by_bytes in enumerate(hard.tolist()):
            ids = flat[cuts[i]:cuts[i + 1]]
            if by_bytes:
                ids = self._with_bytes(ids)
                out.append((" ".join([self.text[s] for s in ids]), len(ids), self.pieces_text(ids)))
            else:
                out.append((" ".join([self.text[s] for s in ids]), len(ids), "".join([self.shown[s] for s in ids])))
        return out

    def _with_bytes(self, symbols: list[int]) -> list[int]:
        """Ids of symbols; a character without a piece becomes its bytes."""
        ids = []
        for s in symbols:
            if 0 <= s < self.size:
                ids.append(s)
            else:
                c = chr(-s - 1) if s < 0 else next(k for k, v in self.char_symbol.items() if v == s)
                ids += self.byte_ids[list(c.encode("utf-8", "replace"))].tolist()
        return ids

    def pieces_text(self, ids: list[int]) -> str:
        """Text of a run of ids, marks as spaces, byte pieces decoded together."""
        parts, raw = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                raw.append(self.byte_of[i])
                continue
            if raw:
                parts.append(_lenient(bytes(raw)))
                raw.clear()
            if i is not None and i not in self.silent:
                parts.append(" ⁇ " if i == self.unknown else self.shown[i])
        return "".join(parts)

    def decode(self, ids: list[int]) -> str:
        """Text of a whole id sequence: without the space that encoding puts in front."""
        shown = [i for i in ids if i not in self.silent]
        text = self.pieces_text(ids)
        return text[1:] if shown and self.pieces[shown[0]].startswith(MARK) else text


def _lenient(raw: bytes) -> str:
    """UTF-8 with one replacement character for each byte that begins no valid character."""
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[at:at + n].decode("utf-8"))
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


class Codec:
    """Encodes and decodes whole texts by remembered words."""

    def __init__(self, path: str):
        self.model = model(path)
        self.known: dict[str, tuple[str, int, str]] = {}  # word with its mark: ids as text, their number, decoded

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return _WORDS.findall(marked) if self.model.splits else [marked]

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > _KNOWN_WORDS:
            self.known.clear()
        new = list(words)
        self.known.update(zip(new, self.model.encode_words(new)))

    def batch(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of ids, ids as text, decoded text of each; texts together should be of bounded length."""
        split = [self.words(t) for t in texts]
        distinct = set().union(*split)
        missing = {w for w in distinct if w not in self.known}
        if missing:
            if len(self.known) + len(missing) > _KNOWN_WORDS:
                missing = distinct
            self.learn(missing)
        known, end = self.known, str(self.model.end)
        out = []
        for words in split:
            found = [known[w] for w in words]
            ids = " ".join([f[0] for f in found] + [end])
            decoded = "".join([f[2] for f in found])
            out.append((sum([f[1] for f in found]) + 1, ids, decoded[1:]))  # the first word begins with the mark put in front
        return out


def encoded(text: Column, path: str) -> Column:
    """Struct of n_tokens, ids_sha256 and decoded_sha256 of a text column."""
    digest = lambda s: hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def of(series: pd.Series) -> pd.DataFrame:
        codec = _codec(path)
        rows, held, size = [], [], 0
        texts = series.tolist()
        for i, t in enumerate(texts):
            held.append(t)
            size += len(t)
            if size >= _BATCH_CHARS or i == len(texts) - 1:
                rows += [(n, digest(ids), digest(decoded)) for n, ids, decoded in codec.batch(held)]
                held, size = [], 0
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return of(F.coalesce(text, F.lit("")))


def token_ids(text: Column, path: str) -> Column:
    """Array of all ids of a text, the end id last."""
    @F.pandas_udf("array<int>")
    def of(series: pd.Series) -> pd.Series:
        codec = _codec(path)
        return pd.Series([np.array(codec.batch([t])[0][1].split(" "), dtype=np.int32) for t in series])

    return of(F.coalesce(text, F.lit("")))


def decoded_text(ids: Column, path: str) -> Column:
    @F.pandas_udf("string")
    def of(series: pd.Series) -> pd.Series:
        m = model(path)
        return pd.Series([None if i is None else m.decode(list(i)) for i in series])

    return of(ids)


@lru_cache(maxsize=2)
def _codec(path: str) -> Codec:
    return Codec(path)


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    coded = docs.select(F.col(doc_id).alias("doc_id"), encoded(F.col(text), path).alias("e"))
    return coded.select("doc_id", "e.*")


def default_model() -> str:
    """Path of the installed public vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), path or default_model())

"""LM scoring with a log-frequency Bloom filter.

Words and word pairs of the training documents are counted by hash: a task sorts the
hashes of some million tokens and sends each hash range on as one packed block, so the
shuffle carries a few bytes a token and no task receives more than a range of bounded
size; the number of ranges follows the size of the text. Every pair and every word enters
the filter with its quantised log count q as q items (key, 1) ... (key, q), however rare or
frequent it is: the number of levels follows from the largest count. A count is read back by
probing (key, 1), (key, 2), ... until the first miss. Regions have `bits_per_item` bits or more
for each item of the fullest, so that with five probes an item not entered is found with a
probability of at most 1%.
Each hash range owns a region of the filter and is filled in one task. Regions are
gathered into segments of at most `segment_bytes`, which are broadcast; workers hold one
segment at a time beside the counts of a batch.

A token's probability interpolates the pair estimate with the smoothed word probability,
    p(w | h) = l c(h, w) / c(h) + (1 - l) (c(w) + 0.1) / (N + 0.1 (V + 1)),
with weights l by the level of c(h), fitted on all training documents, every token's
own occurrence left out. Word counts for the base score are exact: the
commonest words, at most `common_words`, are broadcast, and the rest of a document's
words meet their counts in a join.

Defined results: a null text is an empty text with one token, its end; a null id counts
as held out; repeated rows are all counted and all scored; without training text N is 0
and every word is unknown; an empty table gives an empty result. A word is known by a
64-bit hash. Only id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from factweave.llm.features import Words, pieces
from factweave.llm.hashing import Table, mix
from factweave.llm.text import fold, read_table
from factweave.session import stage

END = np.uint64(0x5851F42D4C957F2D)
START = np.uint64(0x14057B7EF767814F)
WORDS, PAIRS = 0, 1
_FLUSH_TOKENS = 1_500_000
_SCORED_CHARS = 2 << 20  # texts that share one walk over the segments
_PROBED = 1 << 14  # keys probed together, whose regions stay in the processor's cache
_WEIGHTS = np.linspace(0.02, 0.98, 25)


@dataclass(frozen=True)
class LanguageModel:
    base: float = 1.5
    bits_per_item: float = 10.0
    probes: int = 5
    range_tokens: int = 2_000_000
    segment_bytes: int = 32 << 20
    common_words: int = 1 << 19
    levels: int = 0  # set from the largest count


def is_training(doc_id: str) -> Column:
    return fold(doc_id, 10) != 0


def token_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, token hash, hash of the token before); each text ends with END and starts after START. Texts go in pieces."""
    docs, hashes = [], []
    for index, held in pieces(texts):
        w = Words(held, blank_separated=True)
        docs.append(np.array(index, dtype=np.int64)[w.doc])
        hashes.append(w.hashes(w.start, w.end))
    docs.append(np.arange(len(texts)))
    hashes.append(np.full(len(texts), END))
    doc, h = np.concatenate(docs), np.concatenate(hashes)
    order = np.argsort(doc, kind="stable")  # END comes last, having been appended last
    doc, h = doc[order], h[order]
    before = np.r_[START, h[:-1]] if len(h) else h
    before[np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])] = START
    return doc, h, before


def pair_hash(before: np.ndarray, h: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0xFF51AFD7ED558CCD) + h, 1)


# --- packed blocks of sorted keys and counts -----------------------------------

def pack(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as differences and counts, both by byte planes: the upper planes are mostly zero and compress away."""
    planes = lambda a, t: np.ascontiguousarray(a.astype(t).view(np.uint8).reshape(-1, np.dtype(t).itemsize).T).tobytes()
    return planes(np.diff(keys, prepend=np.uint64(0)), "<u8"), planes(counts, "<u4" if not len(counts) or counts.max() < 1 << 32 else "<u8")


def unpack(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(keys) // 8
    back = lambda raw, t: np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(t).itemsize, -1).T).reshape(-1).view(t)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.cumsum(back(keys, "<u8"), dtype=np.uint64), back(counts, "<u4" if len(counts) == 4 * n else "<u8").astype(np.int64)


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their summed counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def _count_blocks(bits: int):
    """Texts to one packed block per hash range and kind, for every few million tokens."""
    def blocks(held: list[np.ndarray], kind: int) -> Iterator[dict]:
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, int)
        for part, (k, c) in enumerate(zip(np.split(keys, cuts), np.split(counts, cuts))):
            if len(k):
                a, b = pack(k, c)
                yield {"kind": kind, "part": part, "keys": a, "counts": b}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, pairs, n = [], [], 0
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in _in_pieces(texts):
                _, h, before = token_hashes(texts[a:b])
                words += [h, np.full(b - a, START)]
                pairs.append(pair_hash(before, h))
                n += len(h)
                if n >= _FLUSH_TOKENS:
                    yield pd.DataFrame([*blocks(words, WORDS), *blocks(pairs, PAIRS)])
                    words, pairs, n = [], [], 0
        if n:
            yield pd.DataFrame([*blocks(words, WORDS), *blocks(pairs, PAIRS)])

    return run


def _merge_blocks(spec: LanguageModel):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        kind = int(group["kind"].iloc[0])
        parts = [unpack(a, b) for a, b in zip(group["keys"], group["counts"])]
        keys, counts = summed(np.concatenate([k for k, _ in parts]), np.concatenate([c for _, c in parts]))
        a, b = pack(keys, counts)
        return pd.DataFrame([{"kind": kind, "part": group["part"].iloc[0], "n": int(level_of(counts, spec).sum()), "most": int(counts.max(initial=1)), "keys": a, "counts": b}])

    return run


def count_ngrams(training: DataFrame, spec: LanguageModel) -> tuple[DataFrame, int]:
    """kind, part, keys, counts, the number n of items for the filter and the largest count, per hash range; the number of bits that select a range. training: text."""
    chars = training.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    bits = max(2, math.ceil(math.log2(max(1, chars / 6 / spec.range_tokens))))
    blocks = training.mapInPandas(_count_blocks(bits), "kind int, part int, keys binary, counts binary")
    merged = blocks.groupBy("kind", "part").applyInPandas(_merge_blocks(spec), "kind int, part int, n long, most long, keys binary, counts binary")
    return stage(merged, "lm-counts"), bits


def vocabulary(counts: DataFrame) -> DataFrame:
    """h and c of every word hash but START's."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a, b in zip(batch["keys"], batch["counts"]):
                keys, counts_ = unpack(a, b)
                words = keys != START
                yield pd.DataFrame({"h": keys[words].view(np.int64), "c": counts_[words]})

    return stage(counts.filter(F.col("kind") == WORDS).mapInPandas(run, "h long, c long"), "lm-words")


# --- the filter -----------------------------------------------------------------

def level_of(counts: np.ndarray, spec: LanguageModel) -> np.ndarray:
    """Quantised log count, 1 for a count of one."""
    return (1 + np.floor(np.log(np.maximum(counts, 1)) / np.log(spec.base) + 1e-9)).astype(np.int64)


def count_of(level: np.ndarray, spec: LanguageModel) -> np.ndarray:
    """Mean of the whole numbers of a level, 0 for level 0."""
    table = [0.0]
    for q in range(1, spec.levels + 1):
        low, high = math.ceil(spec.base ** (q - 1) - 1e-6), math.ceil(spec.base ** q - 1e-6) - 1
        table.append((low + high) / 2 if high >= low else spec.base ** (q - 0.5))
    return np.array(table)[level]


def _walk(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a key's places begin and their odd distance: probe p of item (key, q) is step (q - 1) * probes + p."""
    return mix(keys, 2), mix(keys, 3) | np.uint64(1)


def build_regions(counts: DataFrame, spec: LanguageModel, size: int) -> DataFrame:
    """part and bits of every region; a region holds the words and pairs of one hash range."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(size, dtype=bool)
        for kind, a, b in zip(group["kind"], group["keys"], group["counts"]):
            keys, c = unpack(a, b)
            keys, level = mix(keys, 9) if kind == WORDS else keys, level_of(c, spec)
            place, step = _walk(keys)
            for q in range(1, int(level.max(initial=0)) + 1):
                inside = level >= q
                place, step, level = place[inside], step[inside], level[inside]
                for _ in range(spec.probes):
                    bits[(place & np.uint64(size - 1)).view(np.int64)] = True
                    place = place + step
        return pd.DataFrame([{"part": int(group["part"].iloc[0]), "bits": np.packbits(bits, bitorder="little").tobytes()}])

    return counts.groupBy("part").applyInPandas(run, "part int, bits binary")


class Filter:
    """Broadcast segments of the filter; a segment is loaded when a batch needs it and dropped after."""

    def __init__(self, segments: list, parts_per_segment: int, bits: int, size: int, spec: LanguageModel):
        self.segments, self.per, self.bits, self.size, self.spec = segments, parts_per_segment, bits, size, spec

    def counts(self, keys: np.ndarray, part_of: np.ndarray) -> np.ndarray:
        """Estimated counts. `part_of`: the hash whose upper bits name the region. Every distinct key is probed once, in order of regions, and each segment is loaded once."""
        if not len(keys):
            return np.zeros(0)
        sort = np.argsort(keys)
        inner = keys[sort]
        first = np.r_[True, inner[1:] != inner[:-1]]
        part = (part_of[sort] >> np.uint64(64 - self.bits))[first]
        order = np.argsort(part.astype(np.uint16) if self.bits <= 16 else part, kind="stable")
        part, (place, step) = part[order], _walk(inner[first][order])
        base = (part % np.uint64(self.per)) * np.uint64(self.size)
        found = np.zeros(len(part), dtype=np.int64)
        cuts = np.searchsorted(part, np.arange(len(self.segments) + 1, dtype=np.uint64) * np.uint64(self.per))
        for segment, low, high in zip(self.segments, cuts, cuts[1:]):
            if low == high:
                continue
            raw = segment.value
            for a in range(low, high, _PROBED):
                b = min(high, a + _PROBED)
                found[a:b] = self._levels(raw, base[a:b], place[a:b], step[a:b])
            if len(self.segments) > 1:
                segment.__dict__.pop("_value", None)
        distinct, level = np.empty_like(found), np.empty(len(keys), dtype=np.int64)
        distinct[order] = found
        level[sort] = distinct[np.cumsum(first) - 1]
        return count_of(level, self.spec)

    def words(self, h: np.ndarray) -> np.ndarray:
        return self.counts(mix(h, 9), h)

    def pairs(self, before: np.ndarray, h: np.ndarray) -> np.ndarray:
        key = pair_hash(before, h)
        return self.counts(key, key)

    def _levels(self, raw: np.ndarray, base: np.ndarray, place: np.ndarray, step: np.ndarray) -> np.ndarray:
        level, at, q = np.zeros(len(base), dtype=np.int64), np.arange(len(base)), 1
        while len(at) and q <= self.spec.levels:
            held = np.uint8(1)
            for _ in range(self.spec.probes):
                bit = base + (place & np.uint64(self.size - 1))
                held = held & (raw[(bit >> np.uint64(3)).view(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8))
                place = place + step
            hit = np.flatnonzero(held)
            at, base, place, step = at[hit], base[hit], place[hit], step[hit]
            level[at] = q
            q += 1
        return level


def make_filter(counts: DataFrame, bits: int, spec: LanguageModel) -> Filter:
    spark = counts.sparkSession
    largest = counts.groupBy("part").agg(F.sum("n").alias("n")).agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    size = 1 << max(10, math.ceil(math.log2(max(1, largest) * spec.bits_per_item)))
    per = max(1, spec.segment_bytes * 8 // size)
    regions = stage(build_regions(counts, spec, size), "lm-filter")
    segments = []
    for first in range(0, 1 << bits, per):
        raw = np.zeros(min(per, (1 << bits) - first) * size // 8, dtype=np.uint8)
        # Regions pass one by one: the driver holds a segment and a region, not a segment twice in each of its two processes.
        for row in regions.filter((F.col("part") >= first) & (F.col("part") < first + per)).toLocalIterator():
            at = (row.part - first) * size // 8
            raw[at:at + size // 8] = np.frombuffer(row.bits, dtype=np.uint8)
            del row
        segments.append(spark.sparkContext.broadcast(raw))
        del raw
    return Filter(segments, per, bits, size, spec)


def common_table(words: DataFrame, spec: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and counts of the commonest words, at most spec.common_words."""
    sizes = words.groupBy(F.floor(F.log2("c") * 8).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, room = None, spec.common_words
    for row in sorted(sizes, key=lambda r: -r.bin):
        if row.n > room:
            break
        least, room = row.bin, room - row.n
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kept = words.filter(F.floor(F.log2("c") * 8) >= least).toArrow().sort_by("h")  # bounded, and without a Python object per word
    return kept["h"].to_numpy().view(np.uint64), kept["c"].to_numpy().astype(np.int64)


_BUILT: dict = {}


@dataclass
class Scorer:
    """What a worker needs; everything in it is of bounded size."""

    filter: Filter
    common: object  # broadcast (hashes, counts)
    n: int
    v: int
    spec: LanguageModel
    weights: np.ndarray | None = None

    def _table(self):
        """The table of common words, built once in a worker."""
        value = self.common.value
        if _BUILT.get("of") is not value:
            _BUILT.update(of=value, table=Table(value[0]), counts=np.r_[value[1], 0])
        return _BUILT["table"], _BUILT["counts"]

    @property
    def total(self) -> float:
        return self.n + 0.1 * (self.v + 1)

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact counts of common words and whether a word is common."""
        table, counts = self._table()
        index = table.find(h)
        return counts[index], index >= 0

    def read(self, h: np.ndarray, before: np.ndarray):
        """Of every token: exact count and whether it is common, count, count of its history, count of the pair, by one walk over the segments."""
        exact, is_common = self.look_up(h)
        rare, pairs = np.flatnonzero(~is_common), pair_hash(before, h)
        words = np.r_[h[rare], START]  # START is no word of the table
        found = self.filter.counts(np.r_[mix(words, 9), pairs], np.r_[words, pairs])
        count = exact.astype(float)
        count[rare] = found[:len(rare)]
        start = found[len(rare)]
        history = np.r_[start, count[:-1]]
        history[before == START] = start
        return exact, is_common, count, history, found[len(words):]

    def pair_share(self, history: np.ndarray, pairs: np.ndarray, own: int = 0):
        """c(h, w) / c(h) and the level of c(h), 0 for a history not known; `own` occurrences are left out."""
        history = np.maximum(history - own, 0)
        known = np.flatnonzero(history > 0)
        share = np.zeros(len(history))
        share[known] = np.minimum(np.maximum(pairs[known] - own, 0) / history[known], 1.0)
        return share, np.where(history > 0, level_of(history, self.spec), 0)

    def evidence(self, texts: list[str]) -> pd.DataFrame:
        """For the fit: per level and weight, the summed log10 of what the tokens after such a history get, up to a constant."""
        _, h, before = token_hashes(texts)
        _, _, count, history, pairs = self.read(h, before)
        share, level = self.pair_share(history, pairs, own=1)
        out = np.zeros((self.spec.levels + 1, len(_WEIGHTS)))
        bare = np.bincount(level[(level > 0) & (share == 0)], minlength=self.spec.levels + 1)
        out += bare[:, None] * np.log10(1 - _WEIGHTS)[None, :]
        word = (np.maximum(count - 1, 0) + 0.1) / self.total
        use = np.flatnonzero(share > 0)
        use = use[np.argsort(level[use], kind="stable")]
        for at in np.split(use, np.flatnonzero(np.diff(level[use])) + 1):
            if len(at):
                out[level[at[0]]] += [np.log10(w * share[at] + (1 - w) * word[at]).sum() for w in _WEIGHTS]
        used = np.flatnonzero(out.any(axis=1))
        return pd.DataFrame({"level": used, "gain": list(out[used])})

    def documents(self, texts: list[str]) -> pd.DataFrame:
        """Per text: n_tokens, known and base score of common words, part of the score, and its other words (hash, n, left to the word model)."""
        n_texts = len(texts)
        doc, h, before = token_hashes(texts)
        exact, is_common, guess, history, pairs = self.read(h, before)
        word = np.log10((exact + 0.1) / self.total)
        share, level = self.pair_share(history, pairs)
        weight = self.weights[level]
        mixed = share > 0
        # Without a pair: the word's probability times what its history leaves to it. A rare word's own part follows from the join.
        score = np.log10(1 - weight) + np.where(is_common, word, 0.0)
        score[mixed] = np.log10(weight[mixed] * share[mixed] + (1 - weight[mixed]) * (guess[mixed] + 0.1) / self.total)
        sum_ = lambda x: np.bincount(doc, x, n_texts)
        rest = np.flatnonzero(~is_common)
        order = np.lexsort((h[rest], doc[rest]))
        d, k, open_ = doc[rest][order], h[rest][order], ~mixed[rest][order]
        first = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (k[1:] != k[:-1])]) if len(d) else np.zeros(0, int)
        n = np.diff(np.r_[first, len(d)])
        left = np.add.reduceat(open_.astype(np.int64), first) if len(first) else n
        cuts = np.searchsorted(d[first], np.arange(1, n_texts))
        return pd.DataFrame({
            "n_tokens": np.bincount(doc, minlength=n_texts), "known": sum_(is_common).astype(np.int64), "base": sum_(np.where(is_common, word, 0.0)), "part": sum_(score),
            "h": np.split(k[first].view(np.int64), cuts), "n": np.split(n, cuts), "left": np.split(left, cuts)})


def _in_pieces(texts: list[str], chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size < chars):
            size += len(texts[stop])
            stop += 1
        yield at, stop
        at = stop


def fit_weights(training: DataFrame, scorer: Scorer) -> np.ndarray:
    """Weight of the pair estimate by level of the history's count, from all training documents: tasks add up what every weight gains, a few numbers a level."""
    spec = scorer.spec

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in _in_pieces(texts, _SCORED_CHARS):
                yield scorer.evidence(texts[a:b])

    gains = training.mapInPandas(run, "level int, gain array<double>")
    summed_ = gains.select("level", F.posexplode("gain")).groupBy("level", "pos").agg(F.sum("col").alias("g")).collect()
    table = np.full((spec.levels + 1, len(_WEIGHTS)), np.nan)
    for r in summed_:
        table[r.level, r.pos] = r.g
    best = np.full(spec.levels + 1, 0.5)
    seen = ~np.isnan(table[:, 0])
    best[seen] = _WEIGHTS[np.argmax(table[seen], axis=1)]
    best[0] = 0.0
    return best


def train(docs: DataFrame, doc_id: str, text: str, spec: LanguageModel) -> tuple[Scorer, DataFrame]:
    """The scorer and the word counts (h, c)."""
    training = docs.filter(F.col(doc_id).isNotNull() & is_training(doc_id)).select(F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts, bits = count_ngrams(training, spec)
    most = counts.agg(F.coalesce(F.max("most"), F.lit(1))).first()[0]
    spec = replace(spec, levels=int(level_of(np.array(most), spec)))
    words = vocabulary(counts)
    v, n = words.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
    table = common_table(words, spec)
    scorer = Scorer(make_filter(counts, bits, spec), docs.sparkSession.sparkContext.broadcast(table), n, v, spec)
    scorer.weights = fit_weights(training, scorer)
    return scorer, words


def scored(docs: DataFrame, scorer: Scorer, words: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in _in_pieces(texts, _SCORED_CHARS):
                yield pd.concat([batch[["uid", "doc_id", "held_out"]].iloc[a:b].reset_index(drop=True), scorer.documents(texts[a:b])], axis=1)

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(doc_id).alias("doc_id"), (F.col(doc_id).isNull() | ~is_training(doc_id)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    shape = f"uid long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, part double, h array<long>, n array<int>, left array<int>"
    first = stage(rows.mapInPandas(run, shape), "lm-documents")  # writing it fixes the row numbers
    open_words = first.select("uid", F.inline(F.arrays_zip("h", "n", "left")))
    log_word = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(scorer.total))
    rest = open_words.join(words, "h", "left").groupBy("uid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("known_rest"), F.sum(F.col("n") * log_word).alias("base_rest"), F.sum(F.col("left") * log_word).alias("part_rest"))
    zero = F.lit(0.0)
    return first.drop("h", "n", "left").join(rest, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known_rest", F.lit(0))).alias("n_known"), F.lit(scorer.n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_rest", zero)).alias("base_score"), (F.col("part") + F.coalesce("part_rest", zero)).alias("score"))


def op6_language_model(spark: SparkSession, sf_dir: str, spec: LanguageModel = LanguageModel()) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scorer, words = train(docs, "doc_id", "text", spec)
    return scored(docs, scorer, words)

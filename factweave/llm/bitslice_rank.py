"""Ranked lexical search over bit-sliced Bloom signatures.

Every document gets a Bloom signature of its terms, and of the pairs (term, level) for the levels
that its occurrences reach. Signatures stand in blocks of documents of like size, stored by slice:
slice i holds bit i of all documents of the block, so a term's documents are the intersection of a
few slices. A bitmap names all documents that hold the term and perhaps others, never fewer. The
highest level found bounds the occurrences, hence the term's part of the score; the weighted sum
over an item's terms is an upper bound of the document's score.

1. Signatures of all documents are built once and stored. Their lengths give N and L; the numbers
   of documents that hold the items' terms are counted exactly.
2. The documents of the largest bounds per item are scored exactly. The k-th score found is a
   threshold that the result cannot fall below.
3. Every document whose bound reaches its item's threshold is scored exactly from its whole text;
   the others are provably worse than k documents. The result is exact.

Items are treated in chunks of bounded size, whose terms are sent to all tasks. A task keeps k rows
per item, however many documents tie. Candidates are broadcast while few, and joined by a shuffle
otherwise.

Defined results: null and empty texts have no term, and no document or item without terms appears;
rows repeated with one id are ranked each; null ids come last among equal scores; of repeated item
ids the least text asks, once; an empty table gives an empty result. Only the id and text columns
are read. Ids of documents are integers.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from factweave.llm.features import Words, pieces
from factweave.llm.hashing import mix
from factweave.llm.text import lower_ascii, read_table
from factweave.session import stage

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(TERM)
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
# Bytes of UTF-8: A-Z lower-cased, ASCII outside of terms a space, all bytes of other characters kept.
_TERM_BYTES = bytes(ord(c.translate(_LOWER)) if _TERM.match(c) else 0x20 for c in map(chr, range(128))) + bytes(range(128, 256))
_NO_ID = -(1 << 63)  # stands for a null id as a join key only
_LEVELS = (1, 2, 3, 5)  # occurrences from which a level holds; the next level less one bounds them


@dataclass(frozen=True)
class BitSlices:
    """`bits`: per entry, at least; `hashes`: slices of an entry; `block_rows`, `block_bits`: size of a block; `seeds`: documents per item scored for the threshold; `chunk_terms`: terms of a chunk of items; `broadcast_rows`: candidates up to which they are broadcast."""

    k: int = 10
    bits: int = 12
    hashes: int = 4
    block_rows: int = 1_024
    block_bits: int = 1 << 24
    seeds: int = 30
    chunk_terms: int = 200_000
    broadcast_rows: int = 500_000


def saturation(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _entries(hashes: np.ndarray, level: int) -> np.ndarray:
    return mix(hashes, level)


def _places(entries: np.ndarray, slices: int, spec: BitSlices) -> np.ndarray:
    """Slices of each entry, one column per hash."""
    return np.stack([(mix(entries, 100 + j) % np.uint64(slices)).astype(np.int64) for j in range(spec.hashes)], axis=1)


def term_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, term hash and occurrences of each distinct term of each text.

    The hashes fold upper and lower case fully: terms that differ by it share a hash, which can only raise a bound.
    """
    docs, hashes, counts = [], [], []

    def reduce(doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.lexsort((h, doc))
        doc, h, n = doc[order], h[order], n[order]
        first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])][:len(doc)])
        return doc[first], h[first], np.add.reduceat(n, first) if len(first) else n

    for index, held in pieces(texts):
        words = Words(held)
        doc, h, n = reduce(np.asarray(index, dtype=np.int64)[words.doc], words.hashes(words.start, words.end), np.ones(len(words.start), dtype=np.int64))
        docs.append(doc), hashes.append(h), counts.append(n)
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return reduce(np.concatenate(docs), np.concatenate(hashes), np.concatenate(counts))  # a long text came in several pieces


def blocks(texts: list[str], spec: BitSlices) -> Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]:
    """Text numbers, lengths in terms, number of slices and sliced bits (slices x bytes) of the texts that hold a term."""
    doc, h, tf = term_counts(texts)
    length = np.bincount(doc, tf, minlength=len(texts)).astype(np.int64)
    levels = [tf >= low for low in _LEVELS]
    owner = np.concatenate([doc[held] for held in levels])
    entry = np.concatenate([_entries(h[held], low) for low, held in zip(_LEVELS, levels)])
    size = np.bincount(owner, minlength=len(texts))
    power = np.frexp(size.astype(float))[1]  # size < 2^power
    for p in np.unique(power[size > 0]):
        slices = spec.bits << int(p)
        rows = max(8, min(spec.block_rows, spec.block_bits // slices))
        members = np.flatnonzero((power == p) & (size > 0))
        for at in range(0, len(members), rows):
            part = members[at:at + rows]
            place = np.full(len(texts), -1)
            place[part] = np.arange(len(part))
            mine = place[owner] >= 0
            bits = np.zeros((slices, len(part)), dtype=bool)
            for column in _places(entry[mine], slices, spec).T:
                bits[column, place[owner[mine]]] = True
            yield part, length[part], slices, np.packbits(bits, axis=1)


def signatures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: BitSlices = BitSlices()) -> DataFrame:
    """Blocks: keys and lengths of their documents, number of slices, sliced bits."""
    given = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("key"), F.col(text).alias("text")).filter("text <> ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys, texts = batch["key"].to_numpy(dtype=np.int64), batch["text"].tolist()
            ends = np.cumsum([len(t) for t in texts]) // (1 << 23)  # about 8 million characters at a time
            for group in np.unique(ends):
                own = np.flatnonzero(ends == group)
                for part, length, slices, bits in blocks([texts[i] for i in own], spec):
                    yield pd.DataFrame({"keys": [keys[own[part]]], "lengths": [length], "slices": [slices], "bits": [bits.tobytes()]})

    return given.mapInPandas(run, "keys array<long>, lengths array<long>, slices int, bits binary")


@dataclass
class Corpus:
    """N and L."""

    documents: int
    terms: int

    def m(self, n):
        return 100 - 75 + (75 * n * self.documents) // self.terms

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.documents + 2) / (2 * df + 1)))


class Items:
    """A chunk of items: ids, the distinct terms, and per item the numbers of its terms and weights times repeats."""

    def __init__(self, rows: pd.DataFrame, df: dict[str, int], corpus: Corpus):
        rows = rows[rows["term"].isin(df.keys())]  # a term that no document holds scores nothing
        self.terms = sorted(set(rows["term"]))
        number = {t: i for i, t in enumerate(self.terms)}
        self.weights = [corpus.weight(df[t]) for t in self.terms]
        self.own: list[np.ndarray] = []
        self.weighed: list[np.ndarray] = []
        self.ids: list[int] = []
        for item, part in rows.groupby("item"):
            self.ids.append(int(item))
            self.own.append(np.array([number[t] for t in part["term"]]))
            self.weighed.append(np.array([self.weights[number[t]] * int(n) for t, n in zip(part["term"], part["times"])], dtype=np.float64))
        words = Words(self.terms)
        self.hashes = words.hashes(words.start, words.end)

    def bounds(self, lengths: np.ndarray, slices: int, bits: np.ndarray, corpus: Corpus, spec: BitSlices) -> np.ndarray:
        """Upper bound of the score of each item (row) and document of a block (column); sums stay below 2^53, so they are exact."""
        m, n = corpus.m(lengths), len(lengths)
        out, held, below = np.zeros((len(self.own), n)), None, np.zeros(n, dtype=np.int64)
        for low, following in zip(_LEVELS, (*_LEVELS[1:], None)):
            places = _places(_entries(self.hashes, low), slices, spec)
            found = np.bitwise_and.reduce(bits[places], axis=1)
            held = found if held is None else held & found  # a level holds only above the lower ones
            here = saturation(lengths if following is None else np.minimum(lengths, following - 1), m)
            step, below = here - below, here
            some = held.any(axis=1)
            maps = np.zeros((len(self.terms), n), dtype=np.float32)
            maps[some] = np.unpackbits(held[some], axis=1, count=n)
            for i, (own, weight) in enumerate(zip(self.own, self.weighed)):
                here_too = some[own]
                if here_too.any():
                    out[i] += (weight[here_too] @ maps[own[here_too]]) * step
        return out


def _bits(row) -> np.ndarray:
    return np.frombuffer(row.bits, dtype=np.uint8).reshape(row.slices, -1)


class _Top:
    """The k rows of largest score of each item, ties to the smaller (no id, id)."""

    def __init__(self, k: int):
        self.k, self.rows, self.size = k, [], 0

    def add(self, item: np.ndarray, score: np.ndarray, none: np.ndarray, key: np.ndarray) -> None:
        self.rows.append((item, score, none, key))
        self.size += len(item)
        if self.size > 200_000:
            self.rows = [self.best()]
            self.size = len(self.rows[0][0])

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        item, score, none, key = (np.concatenate(c) for c in zip(*self.rows)) if self.rows else (np.zeros(0, np.int64),) * 4
        order = np.lexsort((key, none, -score, item))
        item = item[order]
        first = np.flatnonzero(np.r_[True, item[1:] != item[:-1]][:len(item)])
        rank = np.arange(len(item)) - np.repeat(first, np.diff(np.r_[first, len(item)]))
        keep = order[rank < self.k]
        return tuple(np.concatenate(c)[keep] for c in zip(*self.rows)) if self.rows else (item,) * 4


def candidates(index: DataFrame, items: Items, corpus: Corpus, least: np.ndarray | None, spec: BitSlices) -> DataFrame:
    """item (number in the chunk), key: the `seeds` documents of the largest bounds per item and task with their bound, or all documents whose bound reaches `least`."""
    shared = index.sparkSession.sparkContext.broadcast((items, least))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, least = shared.value
        top = _Top(spec.seeds)
        for batch in batches:
            for block in batch.itertuples():
                bounds, keys = asked.bounds(np.asarray(block.lengths, dtype=np.int64), block.slices, _bits(block), corpus, spec), np.asarray(block.keys, dtype=np.int64)
                if least is not None:
                    item, at = np.nonzero(bounds >= least[:, None])
                    yield pd.DataFrame({"item": item, "key": keys[at], "bound": bounds[item, at]})
                else:
                    few = min(spec.seeds, bounds.shape[1])
                    at = np.argpartition(-bounds, few - 1, axis=1)[:, :few]
                    item = np.repeat(np.arange(len(bounds)), few)
                    at = at.ravel()
                    good = bounds[item, at] > 0
                    item, at = item[good], at[good]
                    top.add(item, bounds[item, at], np.zeros(len(item), dtype=bool), keys[at])
        if least is None:
            item, bound, _, key = top.best()
            yield pd.DataFrame({"item": item, "key": key, "bound": bound})

    return index.mapInPandas(run, "item int, key long, bound double")


def scored(docs: DataFrame, found: DataFrame, items: Items, corpus: Corpus, doc_id: str, text: str, k: int, spec: BitSlices) -> DataFrame:
    """item, none (no id), id, score of the k best candidates per item and task, by exact counts over whole texts."""
    asked = found.groupBy("key").agg(F.collect_set("item").alias("items"))
    known = stage(asked, "rank-candidates")
    side = F.broadcast(known) if known.count() <= spec.broadcast_rows else known
    rows = docs.select(F.col(doc_id).isNull().alias("none"), F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("key"), F.col(text).alias("text")).join(side, "key")
    shared = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = shared.value
        number = {t: i for i, t in enumerate(asked.terms)}
        top = _Top(k)
        for batch in batches:
            for none, key, text, wanted in zip(batch["none"], batch["key"], batch["text"], batch["items"]):
                terms = _TERM.findall((text or "").translate(_LOWER))
                if not terms:
                    continue
                counts = Counter(number[t] for t in terms if t in number)
                m = corpus.m(len(terms))
                worth = {t: saturation(n, m) for t, n in counts.items()}
                scores = [sum(int(w) * worth.get(t, 0) for t, w in zip(asked.own[i], asked.weighed[i])) for i in wanted]
                good = np.array(scores, dtype=np.int64) > 0
                item = np.asarray(wanted, dtype=np.int64)[good]
                top.add(item, np.array(scores, dtype=np.int64)[good], np.full(len(item), none), np.full(len(item), key))
        item, score, none, key = top.best()
        yield pd.DataFrame({"item": item, "none": none.astype(bool), "id": key, "score": score})

    return rows.mapInPandas(run, "item int, none boolean, id long, score long")


def terms_of(text: str) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats; a blank of bytes is an ASCII blank, so no other character splits."""
    return text.encode("utf-8").translate(_TERM_BYTES).split()


def document_counts(docs: DataFrame, terms: set[str], text: str) -> dict[str, int]:
    """How many documents hold each of the terms of a chunk of items, those that none holds left out.

    A task counts by sets of whole terms, which takes a fraction of the time of extracting, exploding and joining all terms of all documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(frozenset(t.encode("utf-8") for t in terms))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, asked = Counter(), shared.value
        for batch in batches:
            for t in batch["text"]:
                held.update(asked.intersection(terms_of(t)))
        yield pd.DataFrame({"term": pd.Series([t.decode("utf-8") for t in held], dtype=object), "n": pd.Series(list(held.values()), dtype="int64")})

    counts = docs.select(F.col(text).alias("text")).filter("text <> ''").mapInPandas(run, "term string, n long")
    return {r.term: r.n for r in counts.groupBy("term").agg(F.sum("n").alias("n")).collect()}


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "none", "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def term_list(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(F.coalesce(text, F.lit(""))), F.lit(TERM), F.lit(0))


def ranked(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", spec: BitSlices = BitSlices()) -> DataFrame:
    """item_id, rank, doc_id, score: the k documents of the highest score above zero for each item."""
    index = stage(signatures(docs, doc_id, text, spec), "rank-signatures")
    sums = index.select(F.size("lengths").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda s, x: s + x).alias("l")).agg(F.sum("n").alias("n"), F.sum("l").alias("l")).first()
    corpus = Corpus(sums.n or 0, sums.l or 0)
    asks = items.groupBy(F.col(item_id).alias("item_id")).agg(F.min(item_text).alias("text"))
    terms = stage(asks.select("item_id", F.explode(term_list(F.col("text"))).alias("term")).groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("times")), "rank-terms")
    chunks = -(-terms.count() // spec.chunk_terms) if corpus.terms else 0
    number = F.pmod(F.xxhash64("item_id"), F.lit(max(chunks, 1)))
    spark, out = docs.sparkSession, None
    for chunk in range(chunks):
        asking = terms.filter(number == chunk).collect()
        ids = list(dict.fromkeys(r.item_id for r in asking))
        place = {x: i for i, x in enumerate(ids)}
        rows = pd.DataFrame({"item": [place[r.item_id] for r in asking], "term": [r.term for r in asking], "times": [r.times for r in asking]})
        df = document_counts(docs, set(rows["term"]), text)
        asked = Items(rows, df, corpus)
        if not asked.ids:
            continue
        seeds = candidates(index, asked, corpus, None, spec)
        order = Window.partitionBy("item").orderBy(F.col("bound").desc(), "key")
        seeds = seeds.withColumn("at", F.row_number().over(order)).filter(F.col("at") <= spec.seeds)
        reached = _ranked(scored(docs, seeds, asked, corpus, doc_id, text, spec.k, spec), spec.k).filter(F.col("rank") == spec.k)
        least = np.ones(len(asked.ids))
        for r in reached.select("item", "score").collect():
            least[r.item] = r.score
        found = _ranked(scored(docs, candidates(index, asked, corpus, least, spec), asked, corpus, doc_id, text, spec.k, spec), spec.k)
        names = spark.createDataFrame([(i, ids[item]) for i, item in enumerate(asked.ids)], f"item int, item_id {terms.schema['item_id'].dataType.simpleString()}")
        part = found.join(F.broadcast(names), "item").select("item_id", "rank", F.when(~F.col("none"), F.col("id")).alias("doc_id"), "score")
        out = part if out is None else out.union(part)
    if out is None:
        out = asks.select("item_id", F.lit(1).alias("rank"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("score")).filter("1 = 0")
    return out


def op13_bitslice_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), items AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
), asked AS (SELECT item_id, term, count(*) AS times FROM items GROUP BY item_id, term
), sums AS (SELECT count(*) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs WHERE len(terms) > 0
), held AS (SELECT doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM docs
), counted AS (
  SELECT doc_id, n, term, count(*) AS tf FROM held WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, n, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, sums GROUP BY term
), scores AS (
  SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + ((75 * n * n_docs) // n_terms))))) AS BIGINT) AS score
  FROM counted JOIN asked USING (term) JOIN weights USING (term), sums GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
"""

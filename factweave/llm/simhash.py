"""SimHash near-dedup with BK-trees.

A fingerprint sums up the hashes of a text's word shingles. Equal fingerprints meet in a
group-by first, so copies never multiply. Two distinct fingerprints within `radius` bits
agree in at least one of radius + 1 blocks of bits; each fingerprint is sent to the shards
of its block values, and each shard builds one BK-tree: a node's children are keyed by
their Hamming distance to it, and a search for fingerprints within the radius follows only
the edges whose key lies within the radius of the distance to the node. Trees of all
shards in a batch are built and searched level by level with arrays.

A shard above `tree_rows` fingerprints is cut into slices: each slice's tree is sent to
the queries of every slice, cell by cell, so no task holds more than two slices. Trees
reach their queries by the shuffle and never pass the driver, since all fingerprints
together have no size bound that would permit a broadcast from there. A cell returns a
spanning forest of the links found, not all pairs; the forests are joined to components
over the whole table.

Whole documents that are near copies by word shingles (near_copies) lie farther apart than
a few bits, so their shards are keyed by the smallest shingle hashes of the text instead of
blocks of bits. Trees and a fingerprint sixteen times as wide only propose pairs, with radii
that lose next to none; a pair is linked if the exact Jaccard similarity of its two sets of
distinct shingle hashes is 0.8 or more. Pairs are confirmed in two rounds, so that a large
group does not confirm all its pairs: first a spanning forest of each cell's proposed pairs,
nearest first, by a join with the sets; then, in the cells that the first round left in several
components, every proposed pair whose ends are still apart, within the cell: its rows carry their
sets then, cells are cut by the number of hashes they hold, and only links leave the cell.

Defined results: a null text is an empty text; a text without words has fingerprint zero;
texts shorter than a shingle count as one shingle; shingles repeat as often as they occur;
rows repeated with an id each get a row; null ids are ignored as representatives unless a
component has no other; an empty table gives an empty result. Only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType

from factweave.llm.components import Forest, components
from factweave.llm.hashing import mix
from factweave.llm.text import in_place, read_table
from factweave.session import stage

BITS = 64
_FRONTIER = 500_000
_SHINGLES = 65_536
_PAIRS = 20_000
_HELD_PAIRS = 500_000
_HASHES = 1 << 19


@dataclass(frozen=True)
class SimHash:
    words: int = 3
    radius: int = 2
    seed: int = 42
    tree_rows: int = 50_000


@dataclass(frozen=True)
class NearCopies(SimHash):
    """`similarity` decides. At 0.8 a bit differs with probability 0.1515 for long texts and at most 0.1875 (four shingles of five); the radii add four standard deviations to the latter. `cell_hashes`: shingle hashes of a slice when sets travel."""

    words: int = 5
    radius: int = 25
    wide_words: int = 16
    wide_radius: int = 242
    sketch: int = 8
    similarity: float = 0.8
    cell_hashes: int = 1 << 22


def fingerprint_of(text: bytes, words: int, seed: int) -> int:
    """Fingerprint of a UTF-8 text as an unsigned integer."""
    found = text.lower().split()  # bytes: A-Z and the six ASCII blanks only
    if not found:
        return 0
    if len(found) <= words:
        shingles: Iterator[bytes] = iter([b" ".join(found)])
    else:
        shingles = map(b" ".join, zip(*(found[i:] for i in range(words))))
    total, ones = 0, np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    while part := [digest(s, seed) for s in islice(shingles, _SHINGLES)]:
        bits = np.unpackbits(np.array(part, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
        total += len(part)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def _shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    """Distinct shingle hashes of a text, in order."""
    found = text.lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) > words else [b" ".join(found)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(s, seed) for s in shingles), dtype=np.uint64))


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """Fingerprint of `words` 64-bit words of distinct shingle hashes; the first is the plain fingerprint of the set."""
    ones = np.zeros(words * BITS, dtype=np.int64)
    for at in range(0, len(hashes), 128):  # sums of 128 bits fit a byte
        part = hashes[at:at + 128]
        salted = np.stack([part, *[mix(part, salt) for salt in range(1, words)]], axis=1)
        ones += np.unpackbits(salted.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")


def fingerprint(text: Column, spec: SimHash = SimHash()) -> Column:
    """Fingerprint of a text column as a long."""
    words, seed = spec.words, spec.seed

    @F.pandas_udf(LongType())
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint_of(t, words, seed) for t in texts], dtype=np.uint64).view(np.int64))

    return of(F.coalesce(text, F.lit("")).cast("binary"))


class BKForest:
    """One BK-tree per cell over distinct fingerprints; `cell` must be sorted."""

    def __init__(self, cell: np.ndarray, fp: np.ndarray):
        self.fp = fp
        n = len(fp)
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if n else np.zeros(0, dtype=np.int64)
        self.cells, self.roots = cell[starts], starts
        at = np.repeat(starts, np.diff(np.r_[starts, n]))  # the node each row has come down to
        left = np.setdiff1d(np.arange(n), starts, assume_unique=True)
        code = np.full(n, -1, dtype=np.int64)
        while len(left):
            key = at[left] * (BITS + 1) + np.bitwise_count(fp[left] ^ fp[at[left]]).astype(np.int64)
            order = np.argsort(key, kind="stable")
            left, key = left[order], key[order]
            first = np.r_[True, key[1:] != key[:-1]]
            child = left[first]  # the first row on an edge becomes the child there, the others go down to it
            code[child] = key[first]
            at[left] = np.repeat(child, np.diff(np.r_[np.flatnonzero(first), len(left)]))
            left = left[~first]
        inner = np.flatnonzero(code >= 0)
        order = np.argsort(code[inner], kind="stable")
        self.codes, self.children = code[inner][order], inner[order]

    def search(self, cell: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, node) index pairs within the radius, in pieces of bounded size."""
        place = np.searchsorted(self.cells, cell)
        known = (place < len(self.cells)) & (self.cells[np.minimum(place, len(self.cells) - 1)] == cell) if len(self.cells) else np.zeros(len(cell), bool)
        query = np.flatnonzero(known)
        todo = [(query[i:i + _FRONTIER], self.roots[place[query[i:i + _FRONTIER]]]) for i in range(0, len(query), _FRONTIER)]
        while todo:
            q, node = todo.pop()
            d = np.bitwise_count(fp[q] ^ self.fp[node]).astype(np.int64)
            near = d <= radius
            if near.any():
                yield q[near], node[near]
            base = node * (BITS + 1)
            low = np.searchsorted(self.codes, base + np.maximum(d - radius, 0), "left")
            count = np.searchsorted(self.codes, base + np.minimum(d + radius, BITS), "right") - low
            if total := int(count.sum()):
                edge = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(total)
                q, node = np.repeat(q, count), self.children[edge]
                todo += [(q[i:i + _FRONTIER], node[i:i + _FRONTIER]) for i in range(0, total, _FRONTIER)]


def _shards(fp: Column, radius: int) -> Column:
    """Shard keys of a fingerprint: the value of each of radius + 1 blocks of bits."""
    cuts = [round(i * BITS / (radius + 1)) for i in range(radius + 2)]
    value = lambda a, b: fp if b - a == BITS else F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    return F.array(*[F.struct(F.lit(i).alias("block"), value(a, b).alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])


def _cells(routed: DataFrame, spec: SimHash, weight: Column | None = None) -> DataFrame:
    """routed: block, value and columns to carry. Adds i, j (tree and query slice), tree and query: what each cell holds.

    A shard is cut into slices of `tree_rows` rows, or of a total `weight` (numbers up to one a row) of one.
    """
    amount = F.count(F.lit(1)) / spec.tree_rows if weight is None else F.sum(weight)
    heavy = routed.groupBy("block", "value").agg(amount.alias("n")).filter(F.col("n") > 1)
    slices = heavy.select("block", "value", F.ceil("n").cast("int").alias("slices"))
    cut = routed.join(slices, ["block", "value"], "left").withColumn("slices", F.coalesce("slices", F.lit(1)))
    own = F.pmod(F.xxhash64("node"), F.col("slices")).cast("int")
    return (
        cut.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select(*routed.columns, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                (F.col("own") <= F.col("other")).alias("tree"), (F.col("own") >= F.col("other")).alias("query"))
    )


def _by_cell(solve):
    """Sorted rows to what `solve` makes of whole cells."""
    names = ["block", "value", "i", "j"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            key = held[names].to_numpy()
            edge = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            if len(edge):  # all but the last cell are complete
                last = edge[-1]
                yield from solve(held[:last], np.searchsorted(edge, np.arange(last), "right"))
                held = held[last:].reset_index(drop=True)
        if held is not None and len(held):
            yield from solve(held, np.zeros(len(held), dtype=np.int64))

    return run


def _found(rows: pd.DataFrame, cell: np.ndarray, spec: SimHash) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows that the cells' trees find, in pieces of bounded size."""
    fp = rows["fp"].to_numpy().view(np.uint64)
    tree, query = np.flatnonzero(rows["tree"].to_numpy()), np.flatnonzero(rows["query"].to_numpy())
    for q, n in BKForest(cell[tree], fp[tree]).search(cell[query], fp[query], spec.radius):
        yield query[q], tree[n]


def _link_cells(spec: SimHash):
    """Whole cells of sorted rows to a spanning forest of the links in each."""
    def solve(rows: pd.DataFrame, cell: np.ndarray) -> Iterator[pd.DataFrame]:
        node, forest = rows["node"].to_numpy(), Forest(len(rows))
        for a, b in _found(rows, cell, spec):
            forest.link(a, b)
        below = np.flatnonzero(forest.root != np.arange(len(rows)))
        yield pd.DataFrame({"a": node[below], "b": node[forest.root[below]]})

    return _by_cell(solve)


def _nearest_forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the pairs of a spanning forest of least distances d among n rows."""
    forest, kept = Forest(n), []
    left = np.argsort(d, kind="stable")
    while True:
        ra, rb = forest.root[a[left]], forest.root[b[left]]
        apart = ra != rb
        left, ra, rb = left[apart], ra[apart], rb[apart]
        if not len(left):
            return np.concatenate(kept) if kept else left
        best = np.full(n, len(left))
        np.minimum.at(best, ra, np.arange(len(left)))
        np.minimum.at(best, rb, np.arange(len(left)))
        chosen = left[np.unique(best[best < len(left)])]
        kept.append(chosen)
        forest.link(a[chosen], b[chosen])


def _proposed(rows: pd.DataFrame, cell: np.ndarray, spec: NearCopies) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows, once each, that may be similar enough, and their distance by the wide fingerprint."""
    node, size = rows["node"].to_numpy(), rows["size"].to_numpy()
    both = rows["tree"].to_numpy() & rows["query"].to_numpy()
    wide = np.frombuffer(b"".join(rows["wide"]), dtype=np.uint64).reshape(len(rows), -1)
    for a, b in _found(rows, cell, spec):
        able = ((node[a] > node[b]) | ~both[a]) & (np.minimum(size[a], size[b]) >= spec.similarity * np.maximum(size[a], size[b]))
        a, b = a[able], b[able]
        for at in range(0, len(a), _PAIRS):
            x, y = a[at:at + _PAIRS], b[at:at + _PAIRS]
            d = np.bitwise_count(wide[x] ^ wide[y]).sum(axis=1, dtype=np.int64)
            near = d <= spec.wide_radius
            if near.any():
                yield x[near], y[near], d[near]


def _nearest_pairs(spec: NearCopies):
    """Whole cells of sorted rows to a spanning forest of the proposed pairs in each, nearest first."""
    def solve(rows: pd.DataFrame, cell: np.ndarray) -> Iterator[pd.DataFrame]:
        node, held, n = rows["node"].to_numpy(), [], 0

        def least() -> list[np.ndarray]:
            pairs = [np.concatenate(x) for x in zip(*held)]
            kept = _nearest_forest(len(rows), *pairs)
            return [x[kept] for x in pairs]

        for found in _proposed(rows, cell, spec):
            held.append(found)
            n += len(found[0])
            if n > _HELD_PAIRS + len(rows):
                held = [least()]
                n = len(held[0][0])
        if held:
            a, b, _ = least()
            yield pd.DataFrame({"a": np.maximum(node[a], node[b]), "b": np.minimum(node[a], node[b])})

    return _by_cell(solve)


def _alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets, sorted, reach a Jaccard similarity."""
    at = np.searchsorted(a, b)
    both = int((a[np.minimum(at, len(a) - 1)] == b).sum()) if len(a) else 0
    return both >= similarity * (len(a) + len(b) - both)


def _confirmed_links(spec: NearCopies):
    """Whole cells of sorted rows to links between rows that the proposed pairs of exact similarity join, beyond their roots."""
    def solve(rows: pd.DataFrame, cell: np.ndarray) -> Iterator[pd.DataFrame]:
        node, forest, sets = rows["node"].to_numpy(), Forest(len(rows)), rows["hashes"].to_numpy()
        _, first, same = np.unique(rows["root"].to_numpy(), return_index=True, return_inverse=True)
        forest.link(np.arange(len(rows)), first[same])
        links = []
        for a, b, d in _proposed(rows, cell, spec):
            for at in np.argsort(d, kind="stable"):
                x, y = a[at], b[at]
                if forest.root[x] != forest.root[y] and _alike(sets[x], sets[y], spec.similarity):
                    forest.link(np.array([x]), np.array([y]))
                    links.append((x, y))
        if links:
            x, y = np.array(links).T
            yield pd.DataFrame({"a": np.maximum(node[x], node[y]), "b": np.minimum(node[x], node[y])})

    return _by_cell(solve)


def _forests(routed: DataFrame, spec: SimHash, run=_link_cells, weight: Column | None = None) -> DataFrame:
    cells = _cells(routed, spec, weight).repartition("block", "value", "i", "j").sortWithinPartitions("block", "value", "i", "j")
    return cells.mapInPandas(run(spec), "a long, b long")


def shingle_sets(texts: DataFrame, spec: NearCopies) -> DataFrame:
    """texts: node, text (binary). Returns node and its distinct shingle hashes, in pieces of bounded size."""
    words, seed = spec.words, spec.seed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes, sets, n = [], [], 0
            for node, text in zip(batch["node"], batch["text"]):
                nodes.append(node)
                sets.append(_shingle_hashes(text, words, seed).view(np.int64))
                n += len(sets[-1])
                if n > _HASHES:
                    yield pd.DataFrame({"node": nodes, "hashes": sets})
                    nodes, sets, n = [], [], 0
            if nodes:
                yield pd.DataFrame({"node": nodes, "hashes": sets})

    return texts.mapInPandas(run, "node long, hashes array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, spec: NearCopies) -> DataFrame:
    """The pairs a, b whose sets (node, hashes) have the Jaccard similarity asked for, exactly."""
    of = lambda name: sets.select(F.col("node").alias(name), F.col("hashes").alias(f"of_{name}"))
    both = F.size(F.array_intersect("of_a", "of_b"))
    counted = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", both.alias("both"), (F.size("of_a") + F.size("of_b")).alias("all"))
    return counted.filter(F.col("both") >= F.lit(float(spec.similarity)) * (F.col("all") - F.col("both"))).select("a", "b")


def near_fingerprints(distinct: DataFrame, spec: SimHash = SimHash()) -> DataFrame:
    """distinct: fp. Returns fp and root for every fingerprint but the roots of components of near fingerprints."""
    routed = distinct.select("fp", F.col("fp").alias("node"), F.explode(_shards(F.col("fp"), spec.radius)).alias("s")).select("fp", "node", "s.block", "s.value")
    return components(_forests(routed, spec), "simhash-links").select(F.col("node").alias("fp"), "root")


def near_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: SimHash = SimHash()) -> DataFrame:
    """doc_id, fp and component_id (smallest id of the component) of every row."""
    prints = stage(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text), spec).alias("fp")), "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = near_fingerprints(distinct.select("fp"), spec)
    placed = distinct.join(roots, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: NearCopies = NearCopies()) -> DataFrame:
    """`row` (the document's columns), the place of the row and `stays`: true for one document of each group.

    The one with the smallest id stays (nulls last, then by place). Texts without words are copies of one another.
    """
    words, seed, sketch, width = spec.words, spec.seed, spec.sketch, spec.wide_words

    @F.pandas_udf("fp long, wide binary, sketch array<long>, size int, digest binary")
    def prints_of(texts: pd.Series) -> pd.DataFrame:
        wide, low, size, digest = [], [], [], []
        for t in texts:
            h = _shingle_hashes(t, words, seed)
            wide.append(wide_fingerprint(h, width))
            low.append(h[:sketch].view(np.int64))
            size.append(len(h))
            digest.append(xxhash.xxh128_digest(h.tobytes()))
        return pd.DataFrame({"fp": [int(w[0].view(np.int64)) for w in wide], "wide": [w.tobytes() for w in wide], "sketch": low, "size": size, "digest": digest})

    rows = in_place(docs)
    body = F.coalesce(F.col("row").getField(text), F.lit("")).cast("binary")
    order = F.struct(F.col("row").getField(doc_id).isNull().alias("no_id"), F.col("row").getField(doc_id).alias("id"), "place")
    prints = stage(rows.select(order.alias("at"), prints_of(body).alias("p")).select("at", "p.*"), "near-prints")
    # Equal sets have equal digests.
    distinct = stage(prints.groupBy("digest").agg(F.min("at").alias("least"), *[F.any_value(c).alias(c) for c in ("fp", "wide", "sketch", "size")])
                     .drop("digest").withColumn("node", F.monotonically_increasing_id()), "near-distinct")
    routed = lambda nodes: nodes.withColumn("value", F.explode("sketch")).withColumn("block", F.lit(0)).drop("sketch", "least")
    nearest = stage(_forests(routed(distinct), spec, _nearest_pairs).distinct(), "near-pairs")
    paired = nearest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    open_ = distinct.join(paired, "node", "left_semi")
    wanted = open_.select("node", F.col("least.place").alias("place"))
    sets = stage(shingle_sets(rows.select("place", body.alias("text")).join(wanted, "place").select("node", "text"), spec), "near-sets")
    links = stage(confirmed(nearest, sets, spec), "near-confirmed")
    rooted = open_.join(components(links, "near-links"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # What the first round left apart: cells of one component are done.
    left = routed(rooted)
    mixed = left.groupBy("block", "value").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("block", "value")
    ordered = sets.select("node", F.array_sort("hashes").alias("hashes"))
    weight = F.greatest(F.lit(1.0) / spec.tree_rows, F.col("size") / spec.cell_hashes)
    links = links.union(_forests(left.join(mixed, ["block", "value"], "left_semi").join(ordered, "node"), spec, _confirmed_links, weight))
    placed = distinct.join(components(links, "near-links"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    # Documents that stay: the first of each component.
    first = placed.groupBy("root").agg(F.min("least").alias("at")).select(F.col("at.place").alias("place"), F.lit(True).alias("stays"))
    return rows.join(first, "place", "left").select("row", "place", F.coalesce("stays", F.lit(False)).alias("stays"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_documents(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

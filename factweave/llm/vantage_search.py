"""Nearest neighbours by inner product over vantage-point trees, one per shard.

The largest inner product becomes the smallest distance when every stored vector gets one more
coordinate, sqrt(M^2 - |x|^2) for M the largest norm of the table, and every query a zero there;
distances then obey the triangle inequality. A routing tree, fitted on a bounded sample, deals all
vectors into leaves by their distance to vantage points; a leaf above `shard_rows` is cut into
slices by a hash of the id. Every slice is a shard with a vantage-point tree of its own, whose
buckets know the interval of distances to each vantage point above them.

A query goes to the shards of its closest leaf first. Its k-th best score there bounds the distance
that still matters, and it goes on only to leaves, and in a shard to buckets, whose lower bound by
the triangle inequality, times `factor`, is within it. Factor one is exact search; a larger factor
prunes more. What is not pruned is scored by the inner product of the original vectors in double
precision, always summed in the same order, so equal vectors tie and the smaller id goes first.

Shards and blocks of queries are bounded, so a task holds one of each. The routing tree has at most
`most_leaves` nodes. A vector that many rows share fills several slices like any other.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no
part, nor do rows with a null id; vectors of different length are never compared; a query's own id is
never its neighbour; of repeated query ids the least vector asks, once, while repeated stored rows are
listed each; fewer rows than k give a shorter list; an empty table gives an empty result. The id
and vector columns are read, nothing else.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from factweave.llm.features import in_sample
from factweave.llm.text import read_table
from factweave.session import stage

_SLACK = 1e-6  # of the largest norm: more than distances can be off by rounding


@dataclass(frozen=True)
class VantageSearch:
    """`factor`: times the lower bound of a distance before it is compared (1: exact); `sample`: vectors that fit the routing tree; `shard_rows`, `query_rows`, `bucket_rows`: rows of a shard, of a block of queries, of a bucket."""

    k: int = 20
    factor: float = 1.0
    sample: int = 20_000
    most_leaves: int = 4_096
    shard_rows: int = 4_096
    query_rows: int = 4_096
    bucket_rows: int = 128
    seed: int = 12


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * a @ b.T, 0))


class Tree:
    """Balanced vantage-point tree: buckets of rows, and per bucket the vantage points above it with the least and largest distance of its rows."""

    def __init__(self, points: np.ndarray, bucket_rows: int):
        vantage: list[np.ndarray] = []
        self.radius: list[float] = []
        self.child: list[list[int]] = []  # node, or -1 - bucket
        self.buckets: list[np.ndarray] = []
        self.paths: list[list[tuple[int, float, float, bool]]] = []
        todo: list[tuple[np.ndarray, list, int, int]] = [(np.arange(len(points)), [], -1, 0)]
        while todo:
            rows, path, parent, side = todo.pop()
            if len(rows) <= max(1, bucket_rows):
                here = -1 - len(self.buckets)
                self.buckets.append(rows)
                self.paths.append(path)
            else:
                own = points[rows]
                far = int(np.argmax(((own - own[0]) ** 2).sum(axis=1)))  # an outlying row splits better than one in the middle
                d = np.sqrt(((own - own[far]) ** 2).sum(axis=1))
                order, half = np.argsort(d, kind="stable"), len(rows) // 2
                here = len(vantage)
                vantage.append(own[far])
                self.radius.append((d[order[half - 1]] + d[order[half]]) / 2)
                self.child.append([0, 0])
                for at, part in ((0, order[:half]), (1, order[half:])):
                    todo.append((rows[part], [*path, (here, d[part[0]], d[part[-1]], at == 0)], here, at))
            if parent >= 0:
                self.child[parent][side] = here
        self.vantage = np.array(vantage).reshape(len(vantage), points.shape[1])

    def route(self, points: np.ndarray) -> np.ndarray:
        """Bucket of each point, by the radii."""
        at = np.zeros(len(points), dtype=np.int64) if self.radius else np.full(len(points), -1)
        radius, child = np.array(self.radius), np.array(self.child).reshape(-1, 2)
        while (inside := np.flatnonzero(at >= 0)).size:
            node = at[inside]
            d = np.sqrt(((points[inside] - self.vantage[node]) ** 2).sum(axis=1))
            at[inside] = child[node, (d > radius[node]).astype(int)]
        return -1 - at

    def bounds(self, queries: np.ndarray, routed: bool = False) -> np.ndarray:
        """Lower bound of each query's distance to any row of each bucket; `routed`: to any point that route() puts there."""
        out = np.zeros((len(queries), len(self.buckets)))
        if not self.radius:
            return out
        d = _distances(queries, self.vantage)
        for bucket, path in enumerate(self.paths):
            for node, low, high, inner in path:
                if routed:
                    low, high = (0.0, self.radius[node]) if inner else (self.radius[node], np.inf)
                np.maximum(out[:, bucket], np.maximum(low - d[:, node], d[:, node] - high), out=out[:, bucket])
        return out


def _augmented(x: np.ndarray, most: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(most * most - (x * x).sum(axis=1), 0))]


class Best:
    """The k best (score, id) of each query, ties to the smaller id; `floor`: the k-th score, or what was given while that is lower."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.copy()
        self.scores, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(rows):
            return
        who, at = np.unique(rows, return_inverse=True)
        at = np.r_[np.repeat(np.arange(len(who)), self.k), at]
        scores, ids = np.r_[self.scores[who].ravel(), scores], np.r_[self.ids[who].ravel(), ids]
        order = np.lexsort((ids, -scores, at))
        begin = np.searchsorted(at[order], np.arange(len(who)))
        top = order[begin[:, None] + np.arange(self.k)]
        self.scores[who], self.ids[who] = scores[top], ids[top]
        self.floor[who] = np.maximum(self.floor[who], self.scores[who, -1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, id and score of every entry."""
        row, col = np.nonzero(self.scores > -np.inf)
        return row, self.ids[row, col], self.scores[row, col]


def search(x: np.ndarray, ids: np.ndarray, q: np.ndarray, own: np.ndarray, floor: np.ndarray, most: float, spec: VantageSearch) -> Best:
    """The k best of the rows x for each query; `own`: ids of the queries; `floor`: scores below it do not matter; `most`: a norm that no row exceeds."""
    tree = Tree(_augmented(x, most), spec.bucket_rows)
    norms = (q * q).sum(axis=1)
    bounds = tree.bounds(np.c_[q, np.zeros(len(q))])
    home = np.argmin(bounds, axis=1)
    best, slack = Best(len(q), spec.k, floor), _SLACK * most
    near = 1e-12 * most * np.sqrt(norms)  # a matrix product may be off by less

    def visit(bucket: int, who: np.ndarray) -> None:
        if not len(who):
            return
        rows = tree.buckets[bucket]
        row, col = np.nonzero(q[who] @ x[rows].T >= (best.floor[who] - near[who])[:, None])
        row, col = who[row], rows[col]
        apart = own[row] != ids[col]
        row, col = row[apart], col[apart]
        for at in range(0, len(row), 1 << 16):
            r, c = row[at:at + (1 << 16)], col[at:at + (1 << 16)]
            scores = (q[r] * x[c]).sum(axis=1)
            enough = scores >= best.floor[r]
            best.add(r[enough], scores[enough], ids[c[enough]])

    for bucket in range(len(tree.buckets)):
        visit(bucket, np.flatnonzero(home == bucket))
    for bucket in np.argsort(bounds.sum(axis=0), kind="stable"):
        reach = np.sqrt(np.maximum(norms + most * most - 2 * best.floor, 0))
        visit(bucket, np.flatnonzero((home != bucket) & (spec.factor * bounds[:, bucket] <= reach + slack)))
    return best


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in vectors])


def sound_vectors(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, vector (doubles), size and norm of the rows that take part."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(F.col(vec_id).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    doubles = vectors.filter(sound).select(F.col(vec_id).cast("long").alias("vec_id"), v.cast("array<double>").alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return doubles.select("vec_id", "vector", F.size("vector").alias("size"), norm.alias("norm"))


def _routing(rows: DataFrame, n: int, most: float, spec: VantageSearch) -> dict[int, Tree]:
    """A routing tree for every length in the sample."""
    drawn = rows.filter(in_sample(F.struct("vec_id", "vector"), spec.seed, spec.sample / max(n, 1))).select("vec_id", "size", "vector").toPandas().sort_values("vec_id", kind="stable")
    leaves = min(spec.most_leaves, -(-n // spec.shard_rows))
    return {int(size): Tree(_augmented(_matrix(part["vector"]), most), -(-len(part) // leaves)) for size, part in drawn.groupby("size")}


def _leaves(rows: DataFrame, trees: dict[int, Tree], most: float, spec: VantageSearch) -> DataFrame:
    """rows with their leaf; lengths that the sample lacks have one leaf."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby("size"):
                tree = shared.value.get(int(size))
                yield part.assign(leaf=0 if tree is None else tree.route(_augmented(_matrix(part["vector"]), most)))

    return rows.select("vec_id", "size", "vector").mapInPandas(run, "vec_id long, size int, vector array<double>, leaf long")


def _probes(queries: DataFrame, trees: dict[int, Tree], most: float, spec: VantageSearch, first: bool) -> DataFrame:
    """query_id, size, vector, floor and the leaf to search: the closest one if `first`, else all others within reach of the floor."""
    shared = queries.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby("size"):
                tree, q = shared.value.get(int(size)), _matrix(part["vector"])
                bounds = np.zeros((len(q), 1)) if tree is None else tree.bounds(np.c_[q, np.zeros(len(q))], routed=True)
                home = np.argmin(bounds, axis=1)
                if first:
                    leaves = [[h] for h in home]
                else:
                    reach = np.sqrt(np.maximum((q * q).sum(axis=1) + most * most - 2 * part["floor"].to_numpy(), 0)) + _SLACK * most
                    near = spec.factor * bounds <= reach[:, None]
                    near[np.arange(len(q)), home] = False
                    leaves = [np.flatnonzero(row) for row in near]
                yield part.assign(leaves=leaves)

    found = queries.mapInPandas(run, "query_id long, size int, vector array<double>, floor double, leaves array<long>")
    return found.select("query_id", "size", "vector", "floor", F.explode("leaves").alias("leaf"))


def _searched(index: DataFrame, probes: DataFrame, most: float, spec: VantageSearch) -> DataFrame:
    """query_id, vec_id, score: the best of every shard that a query probes. One task step holds one shard and one block of queries."""
    leaf = ["size", "leaf"]
    parts = lambda df, rows, name: df.groupBy(*leaf).agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias(name))
    cut = parts(index, spec.shard_rows, "ni").join(parts(probes, spec.query_rows, "nj"), leaf)
    part = lambda c, n: F.pmod(F.xxhash64(F.lit(spec.seed), c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = index.join(cut, leaf).withColumn("i", part("vec_id", "ni")).withColumn("j", every("nj")).select(*leaf, "i", "j", "vec_id", "vector", F.lit(None).cast("double").alias("floor"))
    asked = probes.join(cut, leaf).withColumn("j", part("query_id", "nj")).withColumn("i", every("ni")).select(*leaf, "i", "j", F.col("query_id").alias("vec_id"), "vector", "floor")

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        stored, asking = cell[cell["floor"].isna()], cell[cell["floor"].notna()]
        if stored.empty or asking.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        own = asking["vec_id"].to_numpy(dtype=np.int64)
        best = search(_matrix(stored["vector"]), stored["vec_id"].to_numpy(dtype=np.int64), _matrix(asking["vector"]), own, asking["floor"].to_numpy(), most, spec)
        row, ids, scores = best.found()
        return pd.DataFrame({"query_id": own[row], "vec_id": ids, "score": scores})

    return held.unionByName(asked).groupBy(*leaf, "i", "j").applyInPandas(run, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(vectors: DataFrame, asks: Column, vec_id: str = "vec_id", vector: str = "embedding", spec: VantageSearch = VantageSearch()) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest inner product with each row whose (cast) `vec_id` satisfies `asks`."""
    rows = stage(sound_vectors(vectors, vec_id, vector), "search-vectors")
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most")).first()
    most = known.most or 0.0
    trees = _routing(rows, known.n, most, spec)
    index = stage(_leaves(rows, trees, most, spec), "search-index")
    asking = index.filter(asks).groupBy("vec_id").agg(F.min(F.struct("size", "vector")).alias("q"))
    lowest = F.lit(-float(most) ** 2 - 1)  # below every inner product
    queries = stage(asking.select(F.col("vec_id").alias("query_id"), "q.size", "q.vector", lowest.alias("floor")), "search-queries")
    first = stage(_ranked(_searched(index, stage(_probes(queries, trees, most, spec, True), "search-probes"), most, spec), spec.k), "search-first")
    full = first.filter(F.col("rank") == spec.k).select("query_id", F.col("score").alias("reached"))
    going = queries.join(full, "query_id", "left").select("query_id", "size", "vector", F.coalesce("reached", "floor").alias("floor"))
    rest = _searched(index, stage(_probes(going, trees, most, spec, False), "search-probes"), most, spec)
    return _ranked(first.select("query_id", "vec_id", "score").union(rest), spec.k).select("query_id", "rank", "vec_id", "score")


def op12_vantage_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)

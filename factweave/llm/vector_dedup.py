"""Embedding near-dedup by product quantisation with lossless probes and filter.

Vectors are compared only inside a label, so every label with many rows has coarse centroids of its
own; their number grows with the rows, by the square root where there are very many, and in all
labels together at most `most_lists` are kept, for the largest. For the residuals a codebook per subspace
is shared by all labels. Both are trained on a bounded sample. Every distinct vector is filed under its nearest centroid with its residual's codes
and the length of what the codes leave out. As a query it probes every list that can hold a
vector within `reach` of it (the largest distance between unit vectors whose cosine meets
the threshold): a list can, only if the query is no farther than `reach` from the plane
between its own centroid and the list's. In a list, table look-ups over the codes give
asymmetric distances; a vector stays a candidate if its distance is within `reach` plus the
length its codes leave out, so none that qualifies is lost. Candidates are compared by exact
cosine in double precision. Recall is therefore 1 up to rounding.

Equal vectors meet in a group-by first and count by their number. A list above `list_rows` is cut into slices and treated slice by slice of
index and queries, so no task holds more than two slices. A slice returns one count per
query and a spanning forest of the links, never the pairs; forests are joined to components.

Defined results: vectors that are null, zero, or hold null or non-finite components, and
rows without a label, link with nothing; vectors of different length never link; repeated
rows are linked copies; null ids represent a component only if it has no other id; an
empty table gives an empty result. Id, vector and label columns are read, nothing else.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from factweave.llm.components import Forest, components
from factweave.llm.features import in_sample
from factweave.llm.text import read_table
from factweave.session import stage

_SLACK = 1e-6
_ROWS = 256


@dataclass(frozen=True)
class VectorDedup:
    cosine: float = 0.98
    sample: int = 20_000
    rows_per_list: int = 400
    most_lists: int = 16_384
    subspaces: int = 8
    codes: int = 256
    rounds: int = 8
    list_rows: int = 4_096
    seed: int = 5

    @property
    def reach(self) -> float:
        return math.sqrt(max(0.0, 2 - 2 * self.cosine))


def _kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = _nearest(x, centres)
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=k)
        np.add.at(sums, near, x)
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0][:, None]
    return centres


def _squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None, :] - 2 * x @ centres.T, 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin(_squared(x[i:i + 4096], centres), axis=1) for i in range(0, len(x), 4096)] or [np.zeros(0, int)])


@dataclass
class Quantiser:
    """Centroids by label and residual codebooks for vectors of one length. A label without centroids has one list around zero."""

    centres: dict
    books: list[np.ndarray]
    size: int

    def of(self, label) -> np.ndarray:
        found = self.centres.get(label)
        return np.zeros((1, self.size)) if found is None else found

    @property
    def cuts(self) -> list[int]:
        return np.cumsum([0, *[b.shape[1] for b in self.books]]).tolist()

    def file(self, x: np.ndarray, label, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """List, codes, length left out and sufficient probes of unit vectors."""
        centres = self.of(label)
        d = _squared(x, centres)
        own = np.argmin(d, axis=1)
        residual = x - centres[own]
        codes = np.stack([_nearest(residual[:, a:b], book) for book, a, b in zip(self.books, self.cuts, self.cuts[1:])], axis=1)
        decoded = np.concatenate([book[c] for book, c in zip(self.books, codes.T)], axis=1)
        between = np.sqrt(_squared(centres, centres))[own]
        probes = d - d[np.arange(len(x)), own][:, None] <= 2 * reach * between + _SLACK
        probes[np.arange(len(x)), own] = True
        return own, codes.astype(np.uint8), np.linalg.norm(residual - decoded, axis=1), [np.flatnonzero(p) for p in probes]

    def distances(self, q: np.ndarray, label, centre: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distance of each query to each coded vector of a list, by table look-up."""
        residual = q - self.of(label)[centre]
        total = np.zeros((len(q), len(codes)))
        for book, c, a, b in zip(self.books, codes.T, self.cuts, self.cuts[1:]):
            total += _squared(residual[:, a:b], book)[:, c]
        return np.sqrt(total)


def train(sample: np.ndarray, labels: np.ndarray, lists: dict, spec: VectorDedup) -> Quantiser:
    """lists: number of lists by label."""
    rng = np.random.default_rng(spec.seed)
    size = sample.shape[1]
    centres, residual = {}, sample.copy()
    for label, k in lists.items():
        rows = np.flatnonzero(labels == label)
        if k > 1 and len(rows):
            centres[label] = _kmeans(sample[rows], k, spec.rounds, rng)
            residual[rows] -= centres[label][_nearest(sample[rows], centres[label])]
    parts = np.array_split(np.arange(size), min(spec.subspaces, size))
    return Quantiser(centres, [_kmeans(residual[:, p[0]:p[-1] + 1], spec.codes, spec.rounds, rng) for p in parts], size)


def _untrained(size: int) -> Quantiser:
    """One list and one code: every vector is a candidate. For lengths that the sample lacks."""
    return Quantiser({}, [np.zeros((1, size))], size)


def _units(vectors: pd.Series) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1)[:, None]


def distinct_vectors(rows: DataFrame) -> DataFrame:
    """rows: vec_id, vector, label, k1, k2, sound. One row per distinct sound vector of a label, numbered."""
    found = rows.filter("sound").groupBy("k1", "k2").agg(F.any_value("vector").alias("vector"), F.any_value("label").alias("label"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    return stage(found.withColumn("node", F.monotonically_increasing_id()), "vectors")


def quantisers(distinct: DataFrame, spec: VectorDedup) -> dict[int, Quantiser]:
    n = distinct.count()
    drawn = distinct.filter(in_sample(F.col("k1"), spec.seed, spec.sample / max(n, 1))).select("k1", "label", "vector").toPandas().sort_values("k1")
    sizes = drawn["vector"].map(len)
    wanted = F.ceil(F.least(F.col("n") / spec.rows_per_list, F.sqrt("n"))).cast("int")
    counted = distinct.groupBy("label", F.size("vector").alias("size")).agg(F.count(F.lit(1)).alias("n")).withColumn("lists", wanted)
    lists: dict[int, dict] = {}
    room = spec.most_lists
    for r in counted.filter("lists > 1").orderBy(F.col("n").desc(), "label").limit(spec.most_lists).collect():
        if r.lists <= room:
            lists.setdefault(r["size"], {})[r.label] = r.lists
            room -= r.lists
    return {int(size): train(_units(drawn["vector"][sizes == size]), drawn["label"][sizes == size].to_numpy(), lists.get(int(size), {}), spec) for size in sizes.unique()}


def filed(distinct: DataFrame, models: dict[int, Quantiser], spec: VectorDedup) -> DataFrame:
    """node, label, size, vector, copies, list, codes, left_out and probes of every distinct vector."""
    shared = distinct.sparkSession.sparkContext.broadcast(models)
    kind = distinct.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (size, label), part in batch.groupby([batch["vector"].map(len), "label"]):
                for at in range(0, len(part), 2048):
                    piece = part.iloc[at:at + 2048]
                    q = shared.value.get(int(size)) or _untrained(int(size))
                    own, codes, left, probes = q.file(_units(piece["vector"]), label, spec.reach)
                    yield pd.DataFrame({
                        "node": piece["node"].to_numpy(), "label": piece["label"].to_numpy(), "size": int(size), "vector": piece["vector"].to_numpy(), "copies": piece["copies"].to_numpy(),
                        "list": own, "codes": [c.tobytes() for c in codes], "left_out": left, "probes": probes})

    shape = f"node long, label {kind}, size int, vector array<double>, copies long, list int, codes binary, left_out double, probes array<int>"
    return stage(distinct.select("node", "label", F.col("vector").cast("array<double>").alias("vector"), "copies").mapInPandas(run, shape), "vector-index")


def _cells(index: DataFrame, spec: VectorDedup) -> DataFrame:
    """Rows of each cell (label, size, list, index slice i, query slice j)."""
    queries = index.select("label", "size", F.explode("probes").alias("list"), "node", "vector")
    cell = ["label", "size", "list"]
    stored = index.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    asking = queries.groupBy(*cell).agg(F.count(F.lit(1)).alias("m"))
    slices = lambda c: F.ceil(F.col(c) / spec.list_rows).cast("int")
    cut = stored.join(asking, cell).select(*cell, slices("n").alias("ni"), slices("m").alias("nj"))
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = index.join(cut, cell).withColumn("i", own("ni")).withColumn("j", all_of("nj")).select(*cell, "i", "j", "node", "vector", "copies", "codes", "left_out")
    asked = queries.join(cut, cell).withColumn("j", own("nj")).withColumn("i", all_of("ni")).select(
        *cell, "i", "j", "node", "vector", F.lit(None).cast("long").alias("copies"), F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("left_out"))
    return held.unionByName(asked)


def links(index: DataFrame, models: dict[int, Quantiser], spec: VectorDedup) -> DataFrame:
    """Rows (a, b, null): links of spanning forests; rows (a, null, n): other vectors, copies counted, linked to a in one cell."""
    shared = index.sparkSession.sparkContext.broadcast(models)

    def run(cell: pd.DataFrame) -> pd.DataFrame:
        stored, asked = cell[cell["codes"].notna()], cell[cell["codes"].isna()]
        if stored.empty or asked.empty:
            return pd.DataFrame({"a": [], "b": [], "n": []})
        size, label, centre = int(cell["size"].iloc[0]), cell["label"].iloc[0], int(cell["list"].iloc[0])
        model = shared.value.get(size) or _untrained(size)
        x, q = _units(stored["vector"]), _units(asked["vector"])
        codes = np.stack([np.frombuffer(c, dtype=np.uint8) for c in stored["codes"]])
        bound, copies = spec.reach + stored["left_out"].to_numpy() + _SLACK, stored["copies"].to_numpy(dtype=np.int64)
        nodes, place = np.unique(np.r_[stored["node"], asked["node"]].astype(np.int64), return_inverse=True)
        of_x, of_q = place[:len(x)], place[len(x):]
        forest, counts = Forest(len(nodes)), np.zeros(len(q), dtype=np.int64)
        for at in range(0, len(q), _ROWS):
            part = q[at:at + _ROWS]
            candidate = (model.distances(part, label, centre, codes) <= bound) & (of_q[at:at + _ROWS][:, None] != of_x[None, :])
            row, col = np.nonzero(candidate)
            if not len(row):
                continue
            if len(row) * 8 > candidate.size:  # most are candidates: one matrix product
                near = (part @ x.T)[row, col] >= spec.cosine
            else:
                near = np.einsum("ij,ij->i", part[row], x[col]) >= spec.cosine
            row, col = row[near], col[near]
            np.add.at(counts, at + row, copies[col])
            forest.link(of_q[at + row], of_x[col])
        below = np.flatnonzero(forest.root != np.arange(len(nodes)))
        some = np.flatnonzero(counts)
        return pd.DataFrame({
            "a": np.r_[nodes[below], asked["node"].to_numpy(dtype=np.int64)[some]], "b": pd.array([*nodes[forest.root[below]], *[None] * len(some)], dtype="Int64"),
            "n": pd.array([*[None] * len(below), *counts[some]], dtype="Int64")})

    found = _cells(index, spec).groupBy("label", "size", "list", "i", "j").applyInPandas(run, "a long, b long, n long")
    return stage(found, "vector-links")


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", spec: VectorDedup = VectorDedup()) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.coalesce(F.col(label).isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = stage(vectors.select(
        F.col(vec_id).alias("vec_id"), v.alias("vector"), F.col(label).alias("label"), sound.alias("sound"),
        F.xxhash64(F.col(label), v).alias("k1"), F.xxhash64(F.lit(1), v, F.col(label)).alias("k2")), "vector-rows")
    distinct = distinct_vectors(rows)
    models = quantisers(distinct, spec)
    found = links(filed(distinct, models, spec), models, spec)
    counts = found.filter("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    roots = components(found.filter("b is not null").select("a", "b"), "vector-components")
    placed = distinct.select("k1", "k2", "node", "least", "copies").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").join(counts, "node", "left")
    known = named.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id", F.lit(True).alias("sound"))
    joined = rows.select("vec_id", "sound", "k1", "k2").join(known, ["k1", "k2", "sound"], "left")
    component = F.when(F.col("sound"), F.col("component_id")).otherwise(F.col("vec_id"))
    return joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))

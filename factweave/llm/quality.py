"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of a document is sigmoid(bias + sum w_i x_i + sum over pairs <v_i, v_j> x_i x_j),
with low-rank factors v. Pairs are never enumerated: for each factor they sum to half of
(sum v x)^2 - sum v^2 x^2, linear in the document's features. Features are the hashed words
(their share of the text, square-rooted), statistics of the text's structure in bins, and
the length that the metadata states, in bins.

Training uses a bounded sample of about `sample` labelled documents, drawn by a hash of
the id; `members` machines are trained in tasks of their own on parts of it and their
margins averaged. Everything else covers all documents: each is scored over its whole
text where it lies, without a shuffle, by factors of fixed size that are broadcast.

Defined results: a null text is an empty text and scores by its statistics; a null or
missing length falls in a bin of its own; null ids never serve for training and count as
held out; repeated rows are scored each; labels of one kind only, or none, give their
share as score; an empty table gives an empty result. Id, text, length and label columns
are read, nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType

from factweave.llm.features import Words, in_sample, labelled, pieces
from factweave.llm.text import fold, read_table
from factweave.session import stage

BINS = 16
STATISTICS = ("length", "words", "mean word", "upper", "signs", "digits", "distinct", "commonest", "lines", "short lines", "repeats", "marks", "stated length")


@dataclass(frozen=True)
class Machine:
    bits: int = 16
    rank: int = 8
    sample: int = 20_000
    members: int = 3
    epochs: int = 6
    least_steps: int = 400
    batch: int = 128
    rate: float = 0.05
    decay: float = 1e-4
    seed: int = 7

    @property
    def size(self) -> int:
        return (1 << self.bits) + BINS * len(STATISTICS)


def _bins(values: np.ndarray, low: float, high: float) -> np.ndarray:
    """Bin of each value; the last bin is for values that are missing."""
    at = np.floor((values - low) / (high - low) * (BINS - 1))
    return np.where(np.isnan(values), BINS - 1, np.clip(np.nan_to_num(at), 0, BINS - 2)).astype(np.int64)


def features(texts: list[str], stated: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value), sorted by document. Texts of any length are taken in pieces."""
    n = len(texts)
    chars = np.array([len(t) for t in texts], dtype=float)
    words, letters, upper, signs, digits, marks, repeats = (np.zeros(n) for _ in range(7))
    keys, counts = [], []
    for index, held in pieces(texts):
        owner = np.array(index, dtype=np.int64)
        w = Words(held)
        doc = owner[w.doc]
        h = w.hashes(w.start, w.end) >> np.uint64(64 - bits)
        key, count = np.unique((doc << bits) | h.astype(np.int64), return_counts=True)
        keys.append(key)
        counts.append(count)
        words += np.bincount(doc, minlength=n)
        letters += np.bincount(doc, (w.end - w.start).astype(float), n)
        same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
        repeats += np.bincount(doc[1:][same], minlength=n)
        for i, t in zip(index, held):  # fast counts inside the string methods
            raw = np.frombuffer(t.encode("utf-8", "replace"), dtype=np.uint8)
            kinds = np.bincount(_KIND[raw], minlength=4)
            upper[i] += kinds[1]
            digits[i] += kinds[2]
            signs[i] += kinds[3]
            marks[i] += t.count("|") + t.count("!") + t.count("#") + t.count("%") + t.count("*") + t.count("$") + t.count("&")
    key, inverse = np.unique(np.concatenate(keys), return_inverse=True) if keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    count = np.bincount(inverse, np.concatenate(counts), len(key)) if keys else np.zeros(0)
    doc, word = key >> bits, key & ((1 << bits) - 1)
    distinct = np.bincount(doc, minlength=n).astype(float)
    top = np.zeros(n)
    np.maximum.at(top, doc, count)
    lines = np.array([t.count("\n") + 1 for t in texts], dtype=float)
    some, letters_ = np.maximum(words, 1), np.maximum(chars, 1)
    statistics = [
        (np.log1p(chars), 0, 14), (np.log1p(words), 0, 12), (letters / some, 0, 15), (upper / letters_, 0, 0.6), (signs / letters_, 0, 0.4), (digits / letters_, 0, 0.2),
        (distinct / some, 0, 1), (top / some, 0, 0.6), (np.log1p(lines), 0, 7), (np.log1p(words / lines), 0, 8), (repeats / some, 0, 0.5), (marks / some, 0, 1.0),
        (np.log1p(stated), 0, 14),
    ]
    share = np.sqrt(count / some[doc])
    dense = [(1 << bits) + i * BINS + _bins(v, low, high) for i, (v, low, high) in enumerate(statistics)]
    every = np.arange(n)
    all_doc = np.concatenate([doc, *[every] * len(dense)])
    all_feature = np.concatenate([word, *dense])
    all_value = np.concatenate([share, np.ones(n * len(dense))])
    order = np.argsort(all_doc, kind="stable")
    return all_doc[order], all_feature[order], all_value[order]


def _kinds() -> np.ndarray:
    """1 upper case, 2 digit, 3 other sign, 0 the rest, by byte."""
    kind = np.zeros(256, dtype=np.int64)
    kind[33:127] = 3
    kind[48:58], kind[65:91], kind[97:123] = 2, 1, 0
    return kind


_KIND = _kinds()


def margins(doc, feature, value, n: int, w: np.ndarray, v: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray]:
    """Margin of each of `n` documents, and the factor sums. Rows are sorted by document and every document has rows."""
    starts = np.searchsorted(doc, np.arange(n))
    vx = v[feature] * value[:, None]
    sums = np.add.reduceat(vx, starts, axis=0) if n else np.zeros((0, v.shape[1]))
    squares = np.add.reduceat(np.einsum("ij,ij->i", vx, vx), starts) if n else np.zeros(0)
    linear = np.add.reduceat(w[feature] * value, starts) if n else np.zeros(0)
    return bias + linear + 0.5 * ((sums * sums).sum(axis=1) - squares), sums


def fit(doc, feature, value, label: np.ndarray, spec: Machine, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Linear weights, factors and bias by AdaGrad on the logistic loss, kinds weighted by their share."""
    rng = np.random.default_rng(seed)
    n = len(label)
    w, v = np.zeros(spec.size), rng.normal(0, 0.05, (spec.size, spec.rank))
    bias = float(np.log(label.mean() / (1 - label.mean())))
    gw2, gv2, gb2 = np.full(spec.size, 1e-4), np.full((spec.size, spec.rank), 1e-4), 1e-4
    starts = np.searchsorted(doc, np.arange(n + 1))
    for _ in range(max(spec.epochs, -(-spec.least_steps * spec.batch // n))):
        order = rng.permutation(n)
        for at in range(0, n, spec.batch):
            rows = order[at:at + spec.batch]
            lengths = starts[rows + 1] - starts[rows]
            flat = np.repeat(starts[rows] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
            d, f, x = np.repeat(np.arange(len(rows)), lengths), feature[flat], value[flat]
            z, sums = margins(d, f, x, len(rows), w, v, bias)
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label[rows]) / len(rows)
            used, inverse = np.unique(f, return_inverse=True)
            gx = g[d] * x
            grad_w = np.bincount(inverse, gx, len(used)) + spec.decay * w[used]
            per_row = gx[:, None] * (sums[d] - v[f] * x[:, None])
            by = np.argsort(inverse, kind="stable")
            grad_v = np.add.reduceat(per_row[by], np.searchsorted(inverse[by], np.arange(len(used))), axis=0) + spec.decay * v[used]
            gw2[used] += grad_w ** 2
            gv2[used] += grad_v ** 2
            gb2 += g.sum() ** 2
            w[used] -= spec.rate * grad_w / np.sqrt(gw2[used])
            v[used] -= spec.rate * grad_v / np.sqrt(gv2[used])
            bias -= spec.rate * g.sum() / np.sqrt(gb2)
    return w, v, bias


def _stated(docs: DataFrame, length: str):
    return F.col(length).cast("double") if length in docs.columns else F.lit(None).cast("double")


def train(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, length: str, label: str, spec: Machine) -> list[tuple[np.ndarray, np.ndarray, float]]:
    known = stage(labelled(labels, doc_id, label).filter(fold("doc_id", 5) != 0), "quality-labels")
    good, n = known.agg(F.coalesce(F.sum((F.col("label") == 1).cast("int")), F.lit(0)), F.count(F.lit(1))).first()
    # Each member draws its own part; when there are few labels, every member sees them all.
    share = spec.sample / spec.members / max(n, 1)
    drawn = known.withColumn("member", F.explode(F.filter(
        F.array(*[F.when(in_sample(F.col("doc_id"), spec.seed + i, share), F.lit(i)) for i in range(spec.members)]), lambda i: i.isNotNull())))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), _stated(docs, length).alias("stated"))
    # The sample's keys are bounded by `sample`, so the texts need no shuffle to meet them.
    sample = rows.join(F.broadcast(drawn), "doc_id").select("member", "text", "stated", "label")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        y = group["label"].to_numpy(dtype=float)
        if len(set(y)) < 2:
            return pd.DataFrame({"w": [], "v": [], "bias": []})
        group = group.iloc[np.argsort(pd.util.hash_pandas_object(group["text"], index=False).to_numpy(), kind="stable")]
        found = features(group["text"].tolist(), group["stated"].to_numpy(dtype=float), spec.bits)
        w, v, bias = fit(*found, group["label"].to_numpy(dtype=float), spec, spec.seed + int(group["member"].iloc[0]))
        return pd.DataFrame({"w": [w.astype(np.float32).tobytes()], "v": [v.astype(np.float32).tobytes()], "bias": [bias]})

    models = [(np.frombuffer(r.w, np.float32), np.frombuffer(r.v, np.float32).reshape(-1, spec.rank), r.bias)
              for r in sample.groupBy("member").applyInPandas(one, "w binary, v binary, bias double").collect()]
    if not models:
        share = min(max(good / n if n else 0.5, 1e-6), 1 - 1e-6)
        return [(np.zeros(spec.size, np.float32), np.zeros((spec.size, spec.rank), np.float32), float(np.log(share / (1 - share))))]
    return sorted(models, key=lambda m: m[2])


def with_score(docs: DataFrame, models, text: str = "text", length: str = "n_chars", name: str = "score", spec: Machine = Machine()) -> DataFrame:
    """The documents and their score."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    bits = spec.bits

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series, stated: pd.Series) -> pd.Series:
        out, lengths = np.zeros(len(texts)), stated.to_numpy(dtype=float)
        all_texts = texts.tolist()
        at = 0
        while at < len(all_texts):  # about a million characters at a time
            stop, size = at, 0
            while stop < len(all_texts) and (stop == at or size < 1 << 20):
                size += len(all_texts[stop])
                stop += 1
            doc, feature, value = features(all_texts[at:stop], lengths[at:stop], bits)
            out[at:stop] = np.mean([margins(doc, feature, value, stop - at, *m)[0] for m in shared.value], axis=0)
            at = stop
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -40, 40))))

    return docs.withColumn(name, score(F.coalesce(F.col(text), F.lit("")), _stated(docs, length)))


def op8_quality(spark: SparkSession, sf_dir: str, spec: Machine = Machine()) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    models = train(docs, read_table(spark, sf_dir, "labels"), "doc_id", "text", "n_chars", "quality", spec)
    rows = with_score(docs.select("doc_id", "text", "n_chars"), models, spec=spec)
    return rows.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))

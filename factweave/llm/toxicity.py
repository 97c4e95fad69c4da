"""Toxicity: non-negative positive-unlabelled learning on hashed words.

Confirmed toxic documents are the positives, all other text is unlabelled and may hide
toxic documents. The risk of a classifier is estimated as
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)),
where the part in brackets, the risk on negatives, cannot fall below zero; where it would,
the step goes back uphill on it. The prior is the share of toxic documents among those
labelled. Several linear classifiers over the features enriched among the positives (AdaGrad, soft
threshold) are trained with numpy, each in a task of its own on its part of the sample, and averaged.

Training uses bounded samples, drawn by a hash of the id: about `positives` and
`unlabelled` documents. Everything else covers all documents: each one is scored over its
whole text where it lies, without a shuffle; the weights have a fixed size and are
broadcast. Features are the words and their beginnings, so that inflected forms and words
with attached signs are recognised, and whether these occur several times.

Defined results: a null text is an empty text and scores by the bias alone; ids that are
null never serve for training and count as held out; repeated rows are scored each; with
no positives or no other text the score is the prior; an empty table gives an empty
result. Only id, text and the label column are read.
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

PREFIXES = (3, 5, 7)  # characters
OFTEN = 3


@dataclass(frozen=True)
class PULearner:
    bits: int = 18
    positives: int = 6_000
    unlabelled: int = 24_000
    members: int = 3
    support: int = 4
    deviations: float = 8.0
    epochs: int = 150
    least_steps: int = 300
    batch: int = 2048
    rate: float = 0.2
    sparsity: float = 1e-5
    seed: int = 11


def features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) index pairs of a batch, with repeats: each word and its first characters."""
    w = Words(texts)
    found, docs = [w.hashes(w.start, w.end)], [w.doc]
    for k in PREFIXES:
        cut = w.prefix_ends(k)
        longer = cut < w.end
        found.append(w.hashes(w.start[longer], cut[longer], salt=k))
        docs.append(w.doc[longer])
    return np.concatenate(docs), (np.concatenate(found) >> np.uint64(64 - bits)).astype(np.int64)


def _often(feature: np.ndarray, bits: int) -> np.ndarray:
    """The feature that stands for `feature` occurring OFTEN times or more."""
    return (feature * 0x9E3779B1 + 0x7F4A7C15) & ((1 << bits) - 1)


def _keyed(texts: list[str], bits: int, wanted: np.ndarray | None = None) -> np.ndarray:
    """Sorted (text << bits | feature), each once; of `wanted` features only."""
    keys = [np.zeros(0, dtype=np.int64)]
    for index, held in pieces(texts):
        doc, feature = features(held, bits)
        if wanted is not None:
            used = wanted[feature] | wanted[_often(feature, bits)]
            doc, feature = doc[used], feature[used]
        keys.append((np.array(index, dtype=np.int64)[doc] << bits) | feature)
    key, count = np.unique(np.concatenate(keys), return_counts=True)
    many = key[count >= OFTEN]
    often = (many >> bits << bits) | _often(many & ((1 << bits) - 1), bits)
    return np.unique(np.concatenate([key, often]))


def _unique_features(texts: list[str], bits: int) -> list[np.ndarray]:
    key = _keyed(texts, bits)
    return np.split(key & ((1 << bits) - 1), np.searchsorted(key, np.arange(1, len(texts)) << bits))


def enriched(positive: list[np.ndarray], unlabelled: list[np.ndarray], spec: PULearner) -> np.ndarray:
    """Features far commoner among the positives than in the unlabelled text; all others get no weight.

    A feature needs `support` positive documents and as many as the unlabelled rate would
    give plus `deviations` standard deviations.
    """
    size = 1 << spec.bits
    seen_p, seen_u = (np.bincount(np.concatenate(rows), minlength=size) for rows in (positive, unlabelled))
    expected = len(positive) * (seen_u + 0.5) / len(unlabelled)
    return np.flatnonzero((seen_p >= spec.support) & (seen_p >= expected + spec.deviations * np.sqrt(expected)))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, spec: PULearner, seed: int) -> np.ndarray:
    """Weights and, last, the bias. Documents are arrays of feature indices."""
    chosen = enriched(positive, unlabelled, spec)
    size = len(chosen)
    place = np.full(1 << spec.bits, -1)
    place[chosen] = np.arange(size)

    def table(rows):
        """Presence of the chosen features, a row per document."""
        out = np.zeros((len(rows), size), dtype=np.float32)
        for i, r in enumerate(rows):
            at = place[r]
            out[i, at[at >= 0]] = 1
        return out

    p_rows, u_rows = table(positive), table(unlabelled)
    weights, bias = np.zeros(size), np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
    seen = np.full(size + 1, 1e-8)
    rng = np.random.default_rng(seed)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    softplus = lambda z: np.logaddexp(0, z)  # noqa: E731  logistic loss of calling z negative
    n_u, n_p = min(spec.batch, len(u_rows)), min(spec.batch, len(p_rows))
    for _ in range(max(spec.epochs, -(-spec.least_steps * n_u // len(u_rows)))):
        order = rng.permutation(len(u_rows))
        for at in range(0, len(order) - n_u + 1, n_u):
            xu, xp = u_rows[order[at:at + n_u]], p_rows[rng.choice(len(p_rows), n_p, replace=False)]
            zu, zp = xu @ weights + bias, xp @ weights + bias
            negative = softplus(zu).mean() - prior * softplus(zp).mean()
            gu = sigmoid(zu) / n_u  # of R_u(-)
            gp_minus, gp_plus = prior * sigmoid(zp) / n_p, prior * (sigmoid(zp) - 1) / n_p
            gp = gp_plus - gp_minus
            if negative < 0:
                gu, gp = -gu, gp_minus  # back uphill on the negative part alone
            grad = np.r_[gu @ xu + gp @ xp, gu.sum() + gp.sum()]
            seen += grad * grad
            step = spec.rate / np.sqrt(seen)
            moved = weights - step[:-1] * grad[:-1]
            weights = np.sign(moved) * np.maximum(np.abs(moved) - step[:-1] * spec.sparsity, 0.0)
            bias -= step[-1] * grad[-1]
    full = np.zeros((1 << spec.bits) + 1)
    full[chosen], full[-1] = weights, bias
    return full


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, spec: PULearner) -> tuple[DataFrame, float]:
    """member, positive and text of the bounded training sample; the class prior."""
    known = stage(labelled(labels, doc_id, label).filter(fold("doc_id", 5) != 0), "toxic-labels")
    toxic, all_known = known.agg(F.coalesce(F.sum((F.col("label") == 1).cast("int")), F.lit(0)), F.count(F.lit(1))).first()
    prior = toxic / all_known if all_known else 0.0
    positive = known.filter("label = 1").filter(in_sample(F.col("doc_id"), spec.seed, spec.positives / max(toxic, 1))).select("doc_id", F.lit(True).alias("positive"))
    others = spec.unlabelled / max(docs.count(), 1)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).filter(F.col("doc_id").isNotNull() & (fold("doc_id", 5) != 0))
    marked = rows.join(F.broadcast(positive), "doc_id", "left").filter(F.col("positive").isNotNull() | in_sample(F.col("doc_id"), spec.seed + 1, others))
    own = F.pmod(F.xxhash64(F.lit(spec.seed + 2), "doc_id"), F.lit(spec.members)).cast("int")
    # Every member sees all positives of the sample and its own part of the unlabelled text.
    members = F.when(F.col("positive"), F.array(*[F.lit(i) for i in range(spec.members)])).otherwise(F.array(own))
    return marked.select(F.explode(members).alias("member"), F.coalesce("positive", F.lit(False)).alias("positive"), "text"), prior


def train(rows: DataFrame, prior: float, spec: PULearner) -> np.ndarray:
    """Mean weights of the members, each trained in a task of its own."""
    def one(group: pd.DataFrame) -> pd.DataFrame:
        member = int(group["member"].iloc[0])
        found = _unique_features(group["text"].tolist(), spec.bits)
        mark = group["positive"].to_numpy(dtype=bool)
        positive, rest = [f for f, m in zip(found, mark) if m], [f for f, m in zip(found, mark) if not m]
        if not positive or not rest:
            return pd.DataFrame({"weights": []})
        return pd.DataFrame({"weights": [fit(positive, rest, prior, spec, spec.seed + member).astype(np.float32).tobytes()]})

    models = [np.frombuffer(r.weights, dtype=np.float32) for r in rows.groupBy("member").applyInPandas(one, "weights binary").collect()]
    if not models:  # nothing to learn from: the prior
        flat = np.zeros((1 << spec.bits) + 1, dtype=np.float32)
        flat[-1] = np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))
        return flat
    return np.mean(sorted(models, key=lambda m: m.tobytes()), axis=0)


def scored(docs: DataFrame, weights: np.ndarray, doc_id: str = "doc_id", text: str = "text", bits: int = PULearner.bits) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        w = shared.value
        total = np.full(len(texts), float(w[-1]))
        active = w[:-1] != 0
        key = _keyed(texts.tolist(), bits, active)
        total += np.bincount(key >> bits, w[key & ((1 << bits) - 1)], len(texts))
        return pd.Series(1 / (1 + np.exp(-np.clip(total, -40, 40))))

    rows = docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id, 5) == 0).alias("held_out"), score(F.coalesce(F.col(text), F.lit(""))).alias("score"))
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op1_toxicity(spark: SparkSession, sf_dir: str, spec: PULearner = PULearner()) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rows, prior = sample(docs, read_table(spark, sf_dir, "labels"), "doc_id", "text", "toxic", spec)
    return scored(docs, train(rows, prior, spec), bits=spec.bits)

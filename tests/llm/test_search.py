from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from factweave.llm import bitslice_rank as rank, queries, spelling, vantage_search as search
from tests.llm import awkward

ROOT = "/root/testdata/sf0.001"


# --- spelling variants -----------------------------------------------------------------


def plain_words(docs, dropped=97, length=5, least=3):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if dropped and h % dropped == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= length and k >= least}


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(n, ratio=2):
    """Neighbours by trying all pairs of like length and beginning or end."""
    bins = defaultdict(set)
    for w in n:  # one change leaves the first or the second half of the word unharmed
        half = len(w) // 2
        for k in (half - 1, half, half + 1):
            bins[w[:k], 0].add(w)
            bins[w[len(w) - k:], 1].add(w)
    out = {}
    for w in n:
        half = len(w) // 2
        others = {v for k in (half - 1, half, half + 1) for key in ((w[:k], 0), (w[len(w) - k:], 1)) for v in bins[key] if near(w, v)}
        best = min(others, key=lambda v: (-n[v], v), default=None)
        form = best if best is not None and n[best] >= ratio * n[w] else None
        out[w] = (n[w], len(others), form, None if form is None else n[form])

    def root(w):
        while out[w][2] is not None:
            w = out[w][2]
        return w

    return {w: (*v, root(w)) for w, v in out.items()}


def spelled(df):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in df.collect()}


def test_spelling_of_the_whole_table(spark):
    rows = spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").collect()
    got = spelled(queries.QUERIES["op11_spelling"](spark, ROOT))
    assert got == plain_variants(plain_words(rows)) and any(v[2] for v in got.values())


def test_spelling_of_random_words_over_few_letters(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(pool[: 4 + i]) for _ in range(300))) for i in range(60)]
    spec = spelling.Spelling(least_count=2, dropped=11)
    got = spelled(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), spec=spec))
    want = plain_words(rows, 11, least=2)
    brute = {w: sum(near(w, v) for v in want) for w in want}
    assert got == plain_variants(want) and {w: v[1] for w, v in got.items()} == brute
    assert any(v[4] != (v[2] or w) for w, v in got.items())  # some chain is longer than one step


def test_spelling_of_long_words_meets_by_halves(spark):
    rng = random.Random(8)
    pool = ["".join(rng.choice("abc") for _ in range(rng.randint(7, 12))) for _ in range(20)]
    for _ in range(120):
        w = rng.choice(pool)
        at = rng.randrange(len(w))
        pool.append(rng.choice([w[:at] + w[at + 1:], w[:at] + "b" + w[at + 1:], w[:at] + "c" + w[at:]]))
    rows = [(i, " ".join(rng.choice(pool) for _ in range(200))) for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_words(rows, 0)
    assert any(v[1] for v in plain_variants(want).values())
    for longest in (5, 9):
        assert spelled(spelling.variants(table, spec=spelling.Spelling(dropped=0, longest=longest))) == plain_variants(want)


def test_spelling_takes_awkward_and_empty_tables(spark):
    docs = awkward.documents(spark)
    spec = spelling.Spelling(least_count=1)
    want = plain_variants(plain_words([(r.doc_id, r.text) for r in docs.collect()], least=1))
    assert spelled(spelling.variants(docs, spec=spec)) == want
    assert spelling.variants(awkward.empty(docs)).count() == 0


# --- nearest neighbours ------------------------------------------------------------------


def plain_nearest(rows, every=20, k=20):
    good = [(i, np.asarray(v, dtype=np.float64)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = set()
    for i, q in {i: q for i, q in sorted(good, key=lambda r: (r[0], tuple(r[1])), reverse=True) if i % every == 0}.items():
        found = sorted((-float((q * x).sum()), j) for j, x in good if j != i and len(x) == len(q))[:k]
        out |= {(i, at + 1, j, -s) for at, (s, j) in enumerate(found)}
    return out


def searched(df):
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in df.collect()}


def same_search(got, want):
    near = lambda rows: sorted((q, at, j, round(s, 9)) for q, at, j, s in rows)
    assert near(got) == near(want)


def test_search_of_the_whole_table_is_exact(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{ROOT}/embeddings.parquet").collect()]
    same_search(searched(queries.QUERIES["op12_vantage_search"](spark, ROOT)), plain_nearest(rows))


@pytest.mark.parametrize("norms", [False, True])
def test_search_over_many_small_shards_and_blocks(spark, norms):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 6))
    x = centres[rng.integers(0, 12, 900)] + 0.1 * rng.normal(size=(900, 6))
    x[300:600] = x[300]  # a third of all rows are one vector
    if not norms:
        x /= np.linalg.norm(x, axis=1)[:, None]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    spec = search.VantageSearch(k=5, sample=200, shard_rows=50, query_rows=7, bucket_rows=4)
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = plain_nearest(rows, 10, 5)
    same_search(searched(search.nearest(table, F.col("vec_id") % 10 == 0, spec=spec)), want)
    if norms:
        return  # queries stand apart from the stored vectors then, and every bound is loose
    loose = searched(search.nearest(table, F.col("vec_id") % 10 == 0, spec=search.VantageSearch(k=5, sample=200, shard_rows=50, query_rows=7, bucket_rows=4, factor=2.0)))
    pairs = lambda rows: {(q, j) for q, _, j, _ in rows}
    assert len(pairs(loose) & pairs(want)) >= 0.9 * len(want)


def test_pruning_by_the_triangle_inequality_spares_work_and_loses_nothing():
    rng = np.random.default_rng(2)
    x = np.repeat(10 * rng.normal(size=(40, 8)), 50, axis=0) + rng.normal(size=(2000, 8))
    most = float(np.linalg.norm(x, axis=1).max())
    tree = search.Tree(search._augmented(x, most), 32)
    q = np.c_[x[::40], np.zeros(50)]
    bounds, far = tree.bounds(q), search._distances(q, search._augmented(x, most))
    for bucket, rows in enumerate(tree.buckets):
        assert (bounds[:, bucket] <= far[:, rows].min(axis=1) + 1e-9).all()
    assert sorted(np.concatenate(tree.buckets)) == list(range(2000))
    routed = tree.bounds(q, routed=True)
    at = tree.route(search._augmented(x, most))
    assert all((routed[:, b] <= far[:, at == b].min(axis=1) + 1e-9).all() for b in np.unique(at))
    best = search.search(x, np.arange(2000), x[::40], np.arange(0, 2000, 40), np.full(50, -1e9), most, search.VantageSearch(bucket_rows=32))
    scores = x[::40] @ x.T
    scores[np.arange(50), np.arange(0, 2000, 40)] = -np.inf
    assert np.allclose(best.scores, -np.sort(-scores, axis=1)[:, :20])
    reach = np.sqrt((q * q).sum(axis=1) + most * most - 2 * best.floor)
    assert (bounds > reach[:, None]).mean() > 0.3


def test_search_takes_awkward_and_empty_tables(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (3, None), (4, []), (5, [0.0, 0.0]), (20, [nan, 1.0]), (40, [inf, 1.0]), (60, [None, 1.0]),
            (80, [1.0, 2.0, 3.0]), (100, [-1.0, -2.0]), (100, [-1.0, -2.0]), (None, [1.0, 1.0]), (7, [3.0, 1.0, 2.0])]
    table = spark.createDataFrame([(i, v, "r", 1.0, 2) for i, v in rows], "vec_id long, embedding array<double>, rank string, score double, query_id int")
    got = searched(search.nearest(table, F.col("vec_id") % 20 == 0))
    assert {q for q, *_ in got} == {0, 80, 100}
    assert [(r, j, s) for q, r, j, s in sorted(got) if q == 0] == [(1, 1, 1.0), (2, 2, 0.5), (3, 2, 0.5), (4, 100, -1.0), (5, 100, -1.0)]
    assert [(r, j) for q, r, j, _ in sorted(got) if q == 80] == [(1, 7)]
    assert search.nearest(awkward.empty(table), F.col("vec_id") % 20 == 0).count() == 0


# --- ranked search -------------------------------------------------------------------------


def plain_ranked(docs, items, k=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(rank.TERM, (t or "").translate(lower))
    held = [(i, terms(t)) for i, t in docs]
    count, total = sum(bool(t) for _, t in held), sum(len(t) for _, t in held)
    df = Counter(x for _, t in held for x in set(t))
    texts = {}
    for i, t in items:
        texts[i] = t if i not in texts or texts[i] is None or (t is not None and t < texts[i]) else texts[i]
    out = Counter()
    for item, text in texts.items():
        scores = []
        for i, t in held:
            tf, m = Counter(t), 100 - 75 + (75 * len(t) * count) // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * count + 2) / (2 * df[x] + 1))) * ((10**9 * tf[x]) // (1000 * tf[x] + 8 * m)) for x in terms(text) if tf[x])
            scores += [(-s, i is None, i or 0, i)] if s > 0 else []
        out.update((item, at + 1, i, -s) for at, (s, _, _, i) in enumerate(sorted(scores, key=lambda r: r[:3])[:k]))
    return out


def found(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


@pytest.mark.parametrize("spec", [rank.BitSlices(), rank.BitSlices(k=3, bits=2, hashes=1, block_rows=16, seeds=1, chunk_terms=40, broadcast_rows=0)])
def test_ranking_agrees_with_scoring_every_document(spark, spec):
    rng = random.Random(6)
    pool = ["".join(rng.choice("abcDEÉé1") for _ in range(rng.randint(1, 6))) for _ in range(150)]
    docs = [(i if i % 7 else None, rng.choice([" ", "-", "\n"]).join(rng.choice(pool[: rng.choice([5, 150])]) for _ in range(rng.choice([1, 5, 60, 900])))) for i in range(300)]
    docs += [(1000 + i, docs[3][1]) for i in range(150)]  # a third are copies: ties
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(1, 12)))) for i in range(40)] + [(90, "zzzz none"), (91, "--"), (92, docs[3][1])]
    table, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert found(rank.ranked(table, asked, spec=spec)) == plain_ranked(docs, items, spec.k)


def test_ranking_takes_awkward_and_empty_tables(spark):
    docs = awkward.documents(spark)
    items = [(1, "the quick brown fox"), (1, None), (2, None), (3, ""), (None, "word reserved"), (4, "« 日本語 ▁▁"), (5, "a a A"), (6, "x" * 300_000)]
    asked = spark.createDataFrame([(i, t, 1, "r") for i, t in items], "item_id long, text string, doc_id int, rank string")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert found(rank.ranked(docs, asked)) == plain_ranked(rows, items)
    assert rank.ranked(awkward.empty(docs), asked).count() == 0 == rank.ranked(docs, asked.filter("1 = 0")).count()


def test_signatures_only_overestimate_and_exclude_most_documents():
    rng = random.Random(9)
    pool = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(20, 200))) for _ in range(400)]
    spec, corpus = rank.BitSlices(), rank.Corpus(400, sum(len(t.split()) for t in texts))
    import pandas as pd

    asked = [(i, t, 1) for i in range(20) for t in set(rng.sample(pool, 8))]
    df = Counter(x for t in texts for x in set(t.split()))
    items = rank.Items(pd.DataFrame(asked, columns=["item", "term", "times"]), dict(df), corpus)
    bounds = np.zeros((20, 400))
    for part, length, slices, bits in rank.blocks(texts, spec):
        bounds[:, part] = items.bounds(length, slices, bits, corpus, spec)
        assert list(length) == [len(texts[i].split()) for i in part]
    exact = np.zeros((20, 400))
    for d, t in enumerate(texts):
        tf, m = Counter(t.split()), corpus.m(len(t.split()))
        for i, x, _ in asked:
            exact[i, d] += corpus.weight(df[x]) * rank.saturation(tf[x], m) if tf[x] else 0
    assert (bounds >= exact).all() and (bounds > exact).mean() < 0.05
    least = np.sort(exact, axis=1)[:, -10]
    assert (bounds >= least[:, None]).sum() < 1.2 * (exact >= least[:, None]).sum()


def test_documents_of_a_term_are_counted_by_whole_terms(spark):
    every = "".join(map(chr, range(0x250))) + "ÀÉİ \u0085 ß\U0001f600x A1b,c\tQ"
    want = rank._TERM.findall(every.translate(rank._LOWER))
    assert [t.decode("utf-8") for t in rank.terms_of(every)] == want
    docs = spark.createDataFrame([("Red red rose",), ("a red rose",), ("ROSE-red",), (None,), ("",)], "body string")
    assert rank.document_counts(docs, {"red", "rose", "red rose", "none"}, "body") == {"red": 2, "rose": 2, "red rose": 1}

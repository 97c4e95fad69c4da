from __future__ import annotations

import dataclasses
import math
import re
import zlib
from collections import Counter
from itertools import combinations

import duckdb
import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from factweave.llm import features, hashing, language_model, mixing, quality, queries, toxicity, url_rules
from tests.llm import awkward

ROOT = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def held_out(i, n=5):
    return zlib.crc32(str(i).encode()) % n == 0


# --- classifiers -------------------------------------------------------------------


@pytest.mark.parametrize("key,label,least", [("op8_quality", "quality", 0.95), ("op1_toxicity", "toxic", 0.75)])
def test_classifiers_rank_documents_they_have_not_seen(spark, key, label, least):
    got = {r.doc_id: r for r in queries.QUERIES[key](spark, MEDIUM).collect()}
    assert all(r.held_out == held_out(i) and 0 <= r.score <= 1 and r.predicted == int(r.score >= (0.5 if label == "toxic" else 0.3)) for i, r in got.items())
    pairs = [(got[i].score, y) for i, y in duckdb.sql(f"select doc_id, {label} from '{MEDIUM}/labels.parquet'").fetchall() if got[i].held_out]
    up, down = [s for s, y in pairs if y == 1], [s for s, y in pairs if y == 0]
    assert np.mean([(a > b) + (a == b) / 2 for a in up for b in down]) >= least


def test_toxic_words_decide(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefg"), 5))
    rows = [(i, " ".join([*(word() for _ in range(60)), *(["vile", "nasty###"] if i % 10 == 0 else [])])) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(0, 1500, 3)], "doc_id long, toxic int")
    sample, prior = toxicity.sample(docs, labels, "doc_id", "text", "toxic", toxicity.PULearner())
    assert 0.07 < prior < 0.14
    got = toxicity.scored(docs, toxicity.train(sample, prior, toxicity.PULearner())).collect()
    assert all(r.predicted == int(r.doc_id % 10 == 0) for r in got)


def test_classifiers_take_awkward_rows(spark):
    docs, labels = awkward.documents(spark), awkward.labels(spark)
    for d in (docs, awkward.empty(docs)):
        for lab in (labels, awkward.empty(labels)):
            rows, prior = toxicity.sample(d, lab, "doc_id", "text", "toxic", toxicity.PULearner())
            got = toxicity.scored(d, toxicity.train(rows, prior, toxicity.PULearner())).collect()
            assert len(got) == d.count() and all(0 <= r.score <= 1 for r in got)
            models = quality.train(d, lab, "doc_id", "text", "n_chars", "quality", quality.Machine(least_steps=20))
            got = quality.with_score(d.select("doc_id", "text", "n_chars"), models).collect()
            assert len(got) == d.count() and all(0 <= r.score <= 1 for r in got)


def test_factor_sums_equal_the_pairs():
    rng = np.random.default_rng(0)
    doc, feature = np.array([0, 0, 0, 1, 1]), np.array([3, 1, 2, 3, 0])
    value, w, v = rng.normal(size=5), rng.normal(size=4), rng.normal(size=(4, 3))
    got, _ = quality.margins(doc, feature, value, 2, w, v, 0.5)
    for d in (0, 1):
        at = np.flatnonzero(doc == d)
        pairs = sum(v[feature[a]] @ v[feature[b]] * value[a] * value[b] for a, b in combinations(at, 2))
        assert got[d] == pytest.approx(0.5 + sum(w[feature[at]] * value[at]) + pairs)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aÀ É語😀.# \t\n1", max_size=60), max_size=6), st.integers(1, 30))
def test_words_and_prefixes_by_hash(texts, chars):
    seen = {}
    for index, held in features.pieces(texts, chars):
        w = features.Words(held)
        cut = np.minimum(w.prefix_ends(2), w.end)
        found = [[m.group() for m in re.finditer(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t.lower())] for t in held]
        flat = [x for words in found for x in words]
        assert [index[d] for d in w.doc] == [index[k] for k, words in enumerate(found) for _ in words]
        for parts, hashes in ((flat, w.hashes(w.start, w.end)), ([x[:2] for x in flat], w.hashes(w.start, cut))):
            for x, h in zip(parts, hashes.tolist()):
                assert seen.setdefault(x, h) == h
    assert len(set(seen.values())) == len(seen)
    assert ["".join(t for i, held in zip(ix, h) for t in [held] if i == k) for k in range(len(texts)) for ix, h in [([i for a, b in features.pieces(texts, chars) for i in a], [x for a, b in features.pieces(texts, chars) for x in b])]] == texts


# --- language model ----------------------------------------------------------------


def base_scores(rows):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [(i, [*WORD.findall((t or "").translate(table)), None]) for i, t in rows]
    counts = Counter()
    for i, t in tokens:
        if i is not None and not held_out(i, 10):
            counts.update(t)
    n, v = sum(counts.values()), len(counts)
    return [(i, len(t), sum(counts[x] > 0 for x in t), n, sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t)) for i, t in tokens]


@pytest.mark.parametrize("common", [0, 50, 1 << 20])
def test_base_scores_are_exact_and_the_model_beats_them(spark, common):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    spec = language_model.LanguageModel(common_words=common, range_tokens=5_000, segment_bytes=4_096)
    got = {r.doc_id: r for r in language_model.scored(docs, *language_model.train(docs, "doc_id", "text", spec)).collect()}
    want = base_scores([(r.doc_id, r.text) for r in docs.collect()])
    for i, tokens, known, n, score in want:
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (tokens, known, n) and got[i].base_score == pytest.approx(score, rel=1e-9)
    assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())
    assert sum(r.score for r in got.values() if r.held_out) > sum(r.base_score for r in got.values() if r.held_out)


def test_scores_by_counting_every_pair(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    spec = language_model.LanguageModel(range_tokens=5_000, bits_per_item=80.0)  # wide enough that no unseen pair is found
    scorer, words = language_model.train(docs, "doc_id", "text", spec)
    got = {r.doc_id: r.score for r in language_model.scored(docs, scorer, words).collect()}
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = {r.doc_id: [0, *WORD.findall((r.text or "").translate(table)), 1] for r in docs.collect()}
    one, two = Counter(), Counter()
    for i, t in tokens.items():
        if not held_out(i, 10):
            one.update(t)
            two.update(zip(t, t[1:]))
    n, v = sum(one.values()) - one[0], len(one) - 1
    level = lambda c: int(math.floor(math.log(c) / math.log(spec.base) + 1e-9)) + 1 if c else 0
    read = lambda c: float(language_model.count_of(np.array(level(c)), scorer.spec))
    # The fit's weights are the model's; everything else is counted here.
    weights = scorer.weights
    for i, t in tokens.items():
        want = 0.0
        for h, w in zip(t, t[1:]):
            history = one[h] if h != 0 else read(one[h])  # the start is no word of the vocabulary
            share = min(read(two[h, w]) / history, 1.0) if history else 0.0
            weight = weights[level(history)] if history else 0.0
            want += math.log10(weight * share + (1 - weight) * (one[w] + 0.1) / (n + 0.1 * (v + 1)))
        assert got[i] == pytest.approx(want, rel=1e-6), i
    assert scorer.spec.levels == level(max(one.values()))


def test_large_counts_read_back_within_their_level():
    spec = language_model.LanguageModel(levels=80)
    counts = np.array([1, 2, 3, 10, 10**5, 10**7, 10**9, 10**12])
    back = language_model.count_of(language_model.level_of(counts, spec), spec)
    assert (back / counts < 1.5).all() and (counts / back < 1.5).all()


def test_weights_are_fitted_on_every_training_document(spark):
    """Every text stands for a level of its own, whose weight only that text can choose."""
    class Told:
        spec = language_model.LanguageModel(levels=6_000)

        def evidence(self, texts):
            return pd.DataFrame({"level": [int(t) for t in texts], "gain": [[float(j == int(t) % 24 + 1) for j in range(25)] for t in texts]})

    weights = language_model.fit_weights(spark.range(1, 6_001, numPartitions=3).select(F.col("id").cast("string").alias("text")), Told())
    assert weights[0] == 0.0 and np.array_equal(weights[1:], language_model._WEIGHTS[np.arange(1, 6_001) % 24 + 1])


def test_language_model_takes_awkward_rows(spark):
    docs = awkward.documents(spark)
    got = language_model.scored(docs, *language_model.train(docs, "doc_id", "text", language_model.LanguageModel())).collect()
    want = Counter((i, a, b, n, round(s, 6)) for i, a, b, n, s in base_scores([(r.doc_id, r.text) for r in docs.collect()]))
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    none = awkward.empty(docs)
    assert language_model.scored(none, *language_model.train(none, "doc_id", "text", language_model.LanguageModel())).count() == 0


def test_unseen_pairs_have_no_count(spark):
    spec = language_model.LanguageModel(levels=12)
    texts = [(" ".join(f"w{k}x{i}" for i in range(1000)),) for k in range(4) for _ in range(30)]
    counts, bits = language_model.count_ngrams(spark.createDataFrame(texts, "text string"), spec)
    found = language_model.make_filter(counts, bits, spec)
    _, h, before = language_model.token_hashes([t for t, in texts[::30]])
    want = language_model.count_of(language_model.level_of(np.array([30]), spec), spec)[0]
    assert (found.pairs(before, h) >= want).all()
    unseen = np.random.default_rng(1).integers(0, 2 ** 63, 100_000).astype(np.uint64)
    rate = (found.counts(unseen, unseen << np.uint64(1)) > 0).mean()
    assert rate <= 0.01


def test_a_batch_loads_every_segment_once_and_probes_a_key_once(spark):
    spec = language_model.LanguageModel(range_tokens=200, segment_bytes=1 << 10)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 400, 300)) for _ in range(40)]
    counts, bits = language_model.count_ngrams(spark.createDataFrame([(t,) for t in texts], "text string"), spec)
    spec = dataclasses.replace(spec, levels=12)
    found = language_model.make_filter(counts, bits, spec)
    assert len(found.segments) > 2
    loads, probed = [], []

    class Segment:
        def __init__(self, of):
            self.of = of

        @property
        def value(self):
            loads.append(self)
            return self.of.value

    found.segments = [Segment(s) for s in found.segments]
    levels = found._levels
    found._levels = lambda raw, base, *rest: probed.append(len(base)) or levels(raw, base, *rest)

    class Empty:
        value = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    scorer = language_model.Scorer(found, Empty(), 12_000, 400, spec, np.full(13, 0.5))
    scorer.documents(texts)
    doc, h, before = language_model.token_hashes(texts)
    assert len(loads) == len(found.segments) and sum(probed) == len(np.unique(h)) + 1 + len(np.unique(language_model.pair_hash(before, h)))


@settings(max_examples=30, deadline=None)
@given(st.dictionaries(st.integers(0, 2 ** 64 - 2), st.integers(1, 2 ** 40), max_size=60))
def test_blocks_and_tables_hold_what_was_put_in(counts):
    keys, values = np.array(sorted(counts), dtype=np.uint64), np.array([counts[k] for k in sorted(counts)], dtype=np.int64)
    a, b = language_model.unpack(*language_model.pack(keys, values))
    assert a.tolist() == keys.tolist() and b.tolist() == values.tolist()
    table = hashing.Table(keys)
    assert table.find(keys).tolist() == list(range(len(keys)))
    others = np.array([k ^ 1 for k in counts if k ^ 1 not in counts], dtype=np.uint64)
    assert (table.find(others) == -1).all()


# --- mixing ------------------------------------------------------------------------


def filled(sizes, weights=(5, 2, 1)):
    """Targets by resharing the excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest, w = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / w for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix_meets_its_targets(spark):
    rows = queries.QUERIES["op10_mix"](spark, MEDIUM).collect()
    again = queries.QUERIES["op10_mix"](spark, MEDIUM).collect()
    assert sorted(rows) == sorted(again)
    source = dict(duckdb.sql(f"select doc_id, source from '{MEDIUM}/documents.parquet'").fetchall())
    text = dict(duckdb.sql(f"select doc_id, text from '{MEDIUM}/documents.parquet'").fetchall())
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r.size == len(WORD.findall(text[r.doc_id])) and 0 <= r.taken <= 3 * r.size and r.taken == r.size * len(r.shards or [])
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
    want = filled(sizes)
    assert all(r.target == pytest.approx(want[source[r.doc_id]]) and r.source_size == sizes[source[r.doc_id]] for r in rows)
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] for s in sizes)


def test_tree_splits_exact_quotas_evenly(spark):
    quotas = spark.createDataFrame([(False, "a", 1000), (False, "b", 37), (False, "c", 0), (True, "", 500)], "no_source boolean, source string, n long")
    rows = mixing.splitting_tree(quotas, mixing.Mix(shards=16)).collect()
    per_source, per_shard = Counter(), Counter()
    for r in rows:
        assert r.n >= 0
        per_source[r.source] += r.n
        per_shard[r.shard] += r.n
    assert per_source == Counter({"a": 1000, "b": 37, "": 500}) and max(per_shard.values()) - min(per_shard.values()) <= 4
    of_a = [r.n for r in rows if r.source == "a"]
    assert 45 < min(of_a) and max(of_a) < 80  # 62.5 with a standard deviation of about 4.6


def test_hypergeometric_draws_follow_their_law(spark):
    u = [(i + 0.5) / 4000 for i in range(4000)]
    draw = mixing.hypergeometric(F.col("u"), F.lit(6).cast("long"), F.lit(20).cast("long"), F.lit(9).cast("long"))
    got = Counter(r.k for r in spark.createDataFrame([(x,) for x in u], "u double").select(draw.alias("k")).collect())
    for k in range(7):
        assert got[k] / 4000 == pytest.approx(math.comb(6, k) * math.comb(14, 9 - k) / math.comb(20, 9), abs=1e-3)


def test_mix_of_awkward_rows(spark):
    docs = awkward.documents(spark)
    out = mixing.mixed(docs, mixing.Mix(shards=4)).collect()
    drawn = Counter((r["row"].doc_id, r["row"].text) for r in out)
    copies = Counter((r.doc_id, r.text) for r in docs.collect())
    assert out and all(n <= 3 * copies[k] for k, n in drawn.items()) and set(out[0]["row"].asDict()) == set(docs.columns)
    assert mixing.mixed(awkward.empty(docs)).count() == 0
    assert mixing.mixed(docs.filter("text is null or text = ''")).count() == 0


# --- urls --------------------------------------------------------------------------


@pytest.mark.parametrize("url,host,path,rule,verdict", [
    ("http://a.NET/x?q=1", "a.net", "/x", "net/", "block"), ("https://B.example.net/en/1#t", "b.example.net", "/en/1", "example.net/en/", "allow"),
    ("x://example.net/en", "example.net", "/en", "net/", "block"), ("http://notexample.com/de/1", "notexample.com", "/de/1", None, None), ("http://example.com/de/", "example.com", "/de/", "example.com/de/", "block"),
    ("http://q.org/fr/", "q.org", "/fr/", "org/fr/", "allow"), ("http://a.net", "a.net", "", None, None), ("http://a.net?x=/y", "a.net", "", None, None), ("nothing", "", "", None, None), (None, "", "", None, None),
    ("", "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None), ("http://É.Example.COM/de/é", "É.example.com", "/de/é", "example.com/de/", "block")])
def test_explicit_rules(spark, url, host, path, rule, verdict):
    r = url_rules.judged_urls(spark.createDataFrame([(1, url, "h")], "page_id long, url string, html string")).first()
    assert (r.host, r.path, r.explicit and r.explicit.rule, r.explicit and r.explicit.verdict) == (host, path, rule, verdict)


def test_mined_rules_by_brute_force(spark):
    rng = np.random.default_rng(4)
    pages, labels = [], []
    for i in range(240):
        spam, deep = rng.random() < 0.3, rng.random() < 0.5
        pages.append((i, f"http://{'cheap' if spam else 'fine'}-{i % 3}.example.com/{'buy' if deep else 'read'}/{i}{'?ref=x' if rng.random() < 0.4 else ''}"))
        if i % 2:
            labels.append((i, int(spam and deep)))
    mining = url_rules.Mining(0.02, 0.8)
    df, lab = spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = url_rules.filter_urls(df, lab, mining).collect()
    tokens = {r.page_id: frozenset(r.tokens) for r in url_rules.judged_urls(df).collect()}
    known = dict(labels)
    sets = {frozenset(c) for i in known for k in range(1, len(tokens[i]) + 1) for c in combinations(sorted(tokens[i]), k)}
    strong = []
    for s in sets:
        fit = [known[i] for i in known if s <= tokens[i]]
        if sum(fit) >= math.ceil(mining.support * len(known)) and sum(fit) / len(fit) >= mining.confidence:
            strong.append(s)
    assert strong and {r.page_id: r.verdict for r in rows} == {i: "block" if any(s <= tokens[i] for s in strong) else "allow" for i in tokens}


def test_forms_of_many_parameters_are_one_item(spark):
    names = "&".join(f"{c}name=1" for c in "abcdefghijklmnopqrstuvwxy")
    pages = [(i, f"http://shop{i % 3}.info/{'form?' + names if i < 200 else 'page' + 'abc'[i % 3]}") for i in range(2000)]
    labels = [(i, int(i < 200)) for i in range(1990)]
    df, lab = spark.createDataFrame(pages + [(5000, "http://new.info/other?kname=2"), (5001, "http://new.info/other?zname=2")], "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r.page_id: (r.verdict, r.mined_tokens) for r in url_rules.filter_urls(df, lab, url_rules.Mining(0.02, 0.8)).collect()}
    assert {v for i, (v, _) in got.items() if i < 200} == {"block"} and {v for i, (v, _) in got.items() if 200 <= i < 5000} == {"allow"}
    assert got[5000] == ("block", ["query:kname"]) and got[5001] == ("allow", None)


def test_urls_of_empty_and_odd_tables(spark):
    pages = spark.createDataFrame([(1, None, "x"), (None, "http://q.org/en/" + "a" * 100_000, "y"), (1, None, "x")], "page_id long, url string, host string")
    labels = spark.createDataFrame([(None, None), (1, None), (1, 1), (1, 0)], "doc_id long, toxic int")
    for lab in (labels, awkward.empty(labels)):
        assert sorted((r.verdict, r.rule) for r in url_rules.filter_urls(pages, lab).select("verdict", "rule").collect()) == [("allow", None)] * 3 or lab is labels
        assert url_rules.filter_urls(awkward.empty(pages), lab).count() == 0

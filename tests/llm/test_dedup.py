from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from factweave.llm import components, exact_dedup, line_dedup, queries, simhash, vector_dedup
from tests.llm import awkward
from tests.oracle import compare, duck

ROOT = "/root/testdata/sf0.001"
BLANKS = r"[\x20\x09-\x0D]+"


@pytest.mark.parametrize("key", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, key):
    ok, message = compare(spark, ROOT, key, queries.QUERIES[key], queries.ORACLE_SQL[key], duck(ROOT))
    assert ok, message


# --- exact dedup ---------------------------------------------------------------


def _groups(spark, path, tmp_path, **kw):
    dedup = exact_dedup.DedupStream(str(path), f"{tmp_path}/state", **kw)
    dedup.update(spark)
    return dedup


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.unhex(F.substring(F.sha2(c, 256), 1, 2)), lambda c: F.unhex(F.lit("00"))])
def test_exact_groups_of_awkward_rows_with_strong_and_weak_digests(spark, tmp_path, digest):
    docs = awkward.documents(spark)
    docs.coalesce(2).write.parquet(f"{tmp_path}/docs")
    dedup = _groups(spark, f"{tmp_path}/docs", tmp_path, digest=digest)
    got = dedup.groups(spark).collect()
    texts = [(r.doc_id, re.sub(BLANKS, " ", r.text or "")) for r in docs.collect()]
    size = Counter(t for _, t in texts)
    least = {t: min((i for i, u in texts if u == t and i is not None), default=None) for t in size}
    want = Counter((i, least[t], size[t]) for i, t in texts)
    assert Counter((r["at"].id, r["keep"].id, r["group_size"]) for r in got) == want
    assert sum(r["at"] == r["keep"] for r in got) == len(size)
    kept = dedup.kept_rows(spark)
    assert kept.columns == docs.columns and kept.count() == len(size)


def test_exact_state_goes_on_with_new_files_and_takes_an_empty_table(spark, tmp_path):
    docs = awkward.documents(spark)
    awkward.empty(docs).write.parquet(f"{tmp_path}/docs")
    dedup = _groups(spark, f"{tmp_path}/docs", tmp_path)
    assert dedup.groups(spark).count() == 0
    for _ in range(2):
        docs.filter("doc_id in (10, 11)").coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
        dedup.update(spark)
    assert {(r.n, r["first"].id) for r in dedup.state(spark).collect()} == {(4, 10)}
    assert [r.group_size for r in dedup.groups(spark).collect()] == [4] * 4


def test_texts_that_hit_nothing_are_not_exchanged(spark, tmp_path, monkeypatch):
    """Texts are normalised and hashed in one pass, which keeps those of hits only; where the state is small enough to be broadcast, none is exchanged."""
    docs = spark.createDataFrame([(1, "a  b"), (2, "a b"), (3, "c")], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/docs")
    staged = {}
    monkeypatch.setattr(exact_dedup, "stage", lambda df, name, real=exact_dedup.stage: staged.update({name: (df, real(df, name))}) or staged[name][1])
    found = _groups(spark, f"{tmp_path}/docs", tmp_path).groups(spark)
    assert sorted((r["at"].id, r["keep"].id, r.group_size) for r in found.collect()) == [(1, 1, 2), (2, 1, 2), (3, 3, 1)]
    plan, rows = staged["dedup-rows"]
    assert "SortMergeJoin" not in plan._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["at"].id, r.body) for r in rows.collect()) == [(1, "a b"), (2, "a b"), (3, None)]


# --- lines -----------------------------------------------------------------------


def test_lines_of_awkward_rows(spark):
    docs = awkward.documents(spark)
    out = line_dedup.dedup_lines(docs).collect()
    assert len(out) == docs.count()
    assert all(r.clean == r["row"].text for r in out if r["row"].doc_id != 1)
    assert line_dedup.dedup_lines(awkward.empty(docs)).count() == 0


def test_recurring_templates_go_from_all_but_the_first_document(spark):
    own = lambda i: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for rng in [random.Random(i)] for _ in range(40))
    text = lambda i: f"own words {own(i)}\nPage {i} of the printed edition\nshared words that stay the same in every copy here {'abc'[i % 3]}\n12 {i}\nrare {own(i + 100)}"
    rows = [(i, text(i)) for i in range(6)]
    got = {r["row"].i: r.clean.split("\n") for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "i long, t string"), "i", "t").collect()}
    assert len(got[0]) == 5
    for i in range(1, 6):
        assert [line[:4] for line in got[i]] == ["own ", f"12 {i}"[:4], "rare"]


def test_copies_of_whole_documents_are_left_whole(spark):
    rows = [(i, "one two three four five six\nseven eight nine ten eleven") for i in range(9)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "i long, t string"), "i", "t").collect()
    assert all(r.clean == rows[0][1] and r.lines_dropped == 0 for r in got)


def test_boilerplate_goes_from_copies_and_short_documents_too(spark):
    notice = "this notice stands in many documents that are not alike"
    own = lambda i: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for rng in [random.Random(i)] for _ in range(30))
    rows = [(i, f"{own(i)}\n{notice}") for i in range(4)]
    rows += [(i, f"{own(50)}\nPage {i} of it\n{notice}\n{own(51)}") for i in range(10, 14)]  # copies but for a number
    rows += [(20, f"{notice}\nshort {own(60)[:5]}")]
    got = {r["row"].i: (r.clean, r.lines_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "i long, t string"), "i", "t").collect()}
    for i, text in rows:
        assert got[i] == ((text, 0) if i == 0 else ("\n".join(line for line in text.split("\n") if line != notice), 1)), i


def test_whole_texts_are_hashed_below_the_explode(spark):
    docs = awkward.documents(spark)
    plan = line_dedup.parsed_lines(docs, "doc_id", "text", line_dedup.LineDedup())._jdf.queryExecution().optimizedPlan().toString()
    above, below = plan.split("Generate posexplode")
    assert "text#" not in above and "body#" not in above and "xxhash64" in below and "regexp_replace" in below.split("Project")[1]


def test_documents_of_very_many_lines(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    shared = [f"shared passage {word()} {word()} {word()} {word()}" for _ in range(50)]
    own = [[f"{word()} {word()} {word()}" for _ in range(50_000)] for _ in range(2)]
    rows = [(i, "\n".join(own[i] + shared)) for i in range(2)] + [(i, "\n".join([f"{word()} {word()}"] + shared)) for i in range(2, 5)]
    got = {r["row"].i: (r.clean.count("\n") + 1, r.lines_dropped) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "i long, t string"), "i", "t").collect()}
    assert got == {0: (50_050, 0), 1: (50_000, 50), 2: (1, 50), 3: (1, 50), 4: (1, 50)}


# --- fingerprints ------------------------------------------------------------------


def plain_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i:i + n]) for i in range(len(words) - n + 1)] if len(words) >= n else [" ".join(words)] if words else []
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components_by_brute_force(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op9_simhash"](spark, ROOT).collect()}
    fp = {i: plain_fingerprint(t) for i, t in duckdb.sql(f"select doc_id, text from '{ROOT}/documents.parquet'").fetchall()}
    assert {i: got[i].fingerprint for i in fp} == {i: f"{v:016x}" for i, v in fp.items()}
    root = {i: i for i in fp}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {i: got[i].component_id for i in fp} == {i: find(i) for i in fp}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 2 ** 64 - 1), st.lists(st.integers(0, 63), max_size=4)), min_size=1, max_size=60), st.integers(0, 8))
def test_trees_find_exactly_the_near_ones(rows, radius):
    points = sorted({(c, v) for c, base, flips in rows for v in (base, base ^ sum({1 << f for f in flips}))})
    cell, fp = np.array([c for c, _ in points]), np.array([v for _, v in points], dtype=np.uint64)
    found = {(int(a), int(b)) for q, n in simhash.BKForest(cell, fp).search(cell, fp, radius) for a, b in zip(q, n)}
    assert found == {(a, b) for a in range(len(fp)) for b in range(len(fp)) if cell[a] == cell[b] and int(fp[a] ^ fp[b]).bit_count() <= radius}


def test_sliced_shards_lose_no_link(spark):
    rng = random.Random(3)
    base = rng.getrandbits(63)
    prints = sorted({base ^ sum({1 << rng.randrange(20) for _ in range(3)}) for _ in range(150)})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    roots = lambda spec: Counter(r.root for r in simhash.near_fingerprints(df, spec).collect())
    assert roots(simhash.SimHash(tree_rows=7)) == roots(simhash.SimHash())


def test_near_copies_keep_one_document_of_each_group(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(4000)]
    base = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(12)]
    rows = []
    for g, text in enumerate(base):
        for k in range(4):
            w = text.split()
            for _ in range(k):
                w[rng.randrange(300)] = rng.choice(words)
            rows.append((g * 10 + k, " ".join(w)))
    got = simhash.near_copies(spark.createDataFrame(rows, "i long, t string"), "i", "t").collect()
    assert sorted(r["row"].i for r in got if r.stays) == [g * 10 for g in range(12)] and len(got) == len(rows)


def test_near_copies_are_decided_by_their_exact_similarity(spark):
    rng = random.Random(11)
    rows, want = [], set()
    for g in range(150):
        n = rng.choice([8, 40, 300])  # shingles; a changed head and tail leaves the middle ones shared
        part = round(n * rng.choice([0.74, 0.78, 0.8, 0.82]) * 2 / (1 + 0.8))
        new = lambda k: ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(k)]
        middle = new(part + 4)
        for k in range(2):
            rows.append((2 * g + k, " ".join(middle + new(n - part))))
        a, b = ({" ".join(w[i:i + 5]) for i in range(len(w) - 4)} for w in (rows[-2][1].split(), rows[-1][1].split()))
        want |= {2 * g} if 5 * len(a & b) >= 4 * len(a | b) else {2 * g, 2 * g + 1}
    got = simhash.near_copies(spark.createDataFrame(rows, "i long, t string"), "i", "t").collect()
    assert {r["row"].i for r in got if r.stays} == want and 150 < len(want) < 300


def test_a_large_group_just_below_the_similarity_leaves_no_pairs_behind(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(100)]

    def edited(n):
        text = list(base)
        for at in rng.sample(range(100), n):
            text[at] = word()
        return " ".join(text)

    rows = [(i, edited(3)) for i in range(400)] + [(i, edited(1)) for i in range(400, 420)]
    table = spark.createDataFrame(rows, "i long, t string")
    sets = {i: {" ".join(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    kept = {r["row"].i for r in simhash.near_copies(table, "i", "t").collect() if r.stays}
    want = {top(i) for i in sets}
    assert 1 < len(want) < 420 and kept == want
    # What leaves the cells are links, fewer than rows of each cell, though most pairs are proposed.
    hashes = [np.sort(simhash._shingle_hashes(t.encode(), 5, 42)) for _, t in rows]
    spec, cell = simhash.NearCopies(), pd.DataFrame({
        "node": np.arange(420), "root": np.arange(420), "block": 0, "value": 0, "i": 0, "j": 0, "tree": True, "query": True, "size": [len(h) for h in hashes],
        "fp": [int(simhash.wide_fingerprint(h, 16)[0].view(np.int64)) for h in hashes], "wide": [simhash.wide_fingerprint(h, 16).tobytes() for h in hashes], "hashes": hashes})
    links = pd.concat(list(simhash._confirmed_links(spec)(iter([cell]))))
    proposed = sum(len(a) for a, _, _ in simhash._proposed(cell, np.zeros(420, dtype=np.int64), spec))
    assert proposed > 10_000 and len(links) < 420


def test_near_copies_of_awkward_rows(spark):
    docs = awkward.documents(spark)
    got = simhash.near_copies(docs).collect()
    assert len(got) == docs.count() and all(r["row"].doc_id is not None for r in got if r.stays and r["row"].text != "no id here at all today")
    assert sum(r.stays for r in got) == len({re.sub(BLANKS, " ", (r.text or "")).strip() for r in docs.collect()})
    assert simhash.near_copies(awkward.empty(docs)).count() == 0
    assert simhash.near_documents(awkward.empty(docs)).count() == 0
    assert simhash.near_documents(docs).count() == docs.count()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=50))
def test_components_agree_with_a_forest(spark, links):
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links or [(0, 0)], "a long, b long")).collect()}
    forest = components.Forest(41)
    if links:
        forest.link(np.array([a for a, _ in links]), np.array([b for _, b in links]))
    assert got == {i: int(r) for i, r in enumerate(forest.root) if r != i}


# --- vectors -----------------------------------------------------------------------


def brute_vectors(rows, cosine=0.98):
    ok = [(i, np.array(v, dtype=float), label) for i, v, label in rows if v is not None and label is not None and len(v) and None not in v and np.isfinite(np.array(v, dtype=float)).all() and np.any(v)]
    n = len(ok)
    near = np.array([[a is not b and a[2] == b[2] and len(a[1]) == len(b[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= cosine for b in ok] for a in ok]).reshape(n, n)
    forest = components.Forest(n)
    forest.link(*np.nonzero(near))
    least = {}
    for k in range(n):
        least[forest.root[k]] = min([x for x in (least.get(forest.root[k]), ok[k][0]) if x is not None], default=None)
    out = Counter((ok[k][0], int(near[k].sum()), least[forest.root[k]]) for k in range(n))
    good = {id(v) for v in ok}
    return out, len(good)


@pytest.mark.parametrize("spec", [vector_dedup.VectorDedup(), vector_dedup.VectorDedup(list_rows=5, rows_per_list=10), vector_dedup.VectorDedup(sample=40, rows_per_list=20, codes=4, subspaces=3)])
def test_vectors_by_brute_force(spark, spec):
    rng = np.random.default_rng(1)
    rows, k = [], 0
    for c in range(12):
        centre = rng.normal(size=16)
        for _ in range(15):
            v = centre + rng.normal(size=16) * rng.choice([0.0, 0.05, 0.2, 1.0])
            rows.append((k, [float(np.float32(x)) for x in v], c % 3))
            k += 1
    rows += [(k + 1, rows[0][1], 0), (k + 2, rows[0][1], 0), (k + 3, [1.0, 2.0], 0), (k + 4, [2.0, 4.0], 0), (k + 5, [2.0, 4.0], 1)]
    odd = [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None, 1.0], 0), (904, rows[0][1], None), (905, [], 0), (906, [float("inf")] * 16, 0)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows + odd], "vec_id long, embedding array<float>, label int, node long, copies string")
    got = vector_dedup.near_vectors(df, spec=spec).collect()
    want, _ = brute_vectors(rows)
    assert Counter((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id < 900) == want
    assert all((r.n_links, r.component_id, r.kept) == (0, r.vec_id, True) for r in got if r.vec_id >= 900) and len(got) == len(rows) + len(odd)


def test_vectors_of_an_empty_table_and_null_ids(spark):
    shape = "vec_id long, embedding array<float>, label int"
    assert vector_dedup.near_vectors(spark.createDataFrame([], shape)).count() == 0
    got = vector_dedup.near_vectors(spark.createDataFrame([(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1)], shape)).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(None, 1, 5, False), (5, 1, 5, True)}

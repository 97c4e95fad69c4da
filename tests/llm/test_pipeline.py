from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from factweave.llm import queries, sentencepiece_codec as codec
from factweave.session import stage
from tests.llm import awkward

ROOT = "/root/testdata/sf0.001"
PATH = codec.default_model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_library(text):
    ids = LIBRARY.encode(text or "", add_eos=True)
    return len(ids), digest(" ".join(map(str, ids))), digest(LIBRARY.decode(ids))


def test_encoding_agrees_with_the_library_on_any_text():
    rng = random.Random(7)
    alphabet = "aabbeinrst  \n\t▁é日語😀<s>/\x00-=._#AB09"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    texts += [c * n for c in ("a", "ab", "na", " ", "=-", "_", "the", "ananas", "0", "▁") for n in range(1, 60)] + ["", "</s>", "<0x0A>", "﷽ﬁ①", "a" * 20_000]
    coder = codec.Codec(PATH)
    for text, (n, ids, decoded) in zip(texts, coder.batch(texts)):
        want = LIBRARY.encode(text, add_eos=True)
        assert ids == " ".join(map(str, want)) and n == len(want) and decoded == LIBRARY.decode(want) == coder.model.decode(want), repr(text[:60])


def test_decoding_agrees_with_the_library_on_any_ids():
    rng = random.Random(8)
    model = codec.model(PATH)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(300), rng.randrange(model.size)]) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == LIBRARY.decode(ids), ids


def test_every_text_of_the_table(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    want = {r.doc_id: by_library(r.text) for r in docs.collect()}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op4_sentencepiece"](spark, ROOT).collect()} == want


def test_encoding_takes_awkward_rows_and_round_trips(spark):
    docs = awkward.documents(spark)
    want = Counter((r.doc_id, *by_library(r.text)) for r in docs.collect())
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in codec.encode_documents(docs, PATH).collect()) == want
    assert codec.encode_documents(awkward.empty(docs), PATH).count() == 0
    ids = docs.select("text", codec.token_ids(docs["text"], PATH).alias("ids"))
    assert all(r.back == (r.text or "").replace("▁", " ") for r in ids.select("text", codec.decoded_text(ids["ids"], PATH).alias("back")).collect())


# --- the pipeline against plain versions of its stages --------------------------------


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    out = [docs]
    for name, step in corpus_pipeline.STAGES:
        out.append(stage(step(spark, out[-1], ROOT), f"test-{name}"))
    return out


def test_run_is_its_stages_in_order(spark, steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mix", "tokens"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    assert Counter(corpus_pipeline.run(spark, ROOT).collect()) == Counter(steps[-1].collect())


def test_each_stage_takes_effect_and_only_its_own(spark, steps):
    docs, good, lines, distinct, mixed, tokens = ([r.asDict() for r in s.collect()] for s in steps)
    given = {r["doc_id"]: r for r in docs}
    assert all(r == given[r["doc_id"]] for r in good) and 0 < len(good) <= len(docs)
    before = {r["doc_id"]: r["text"].split("\n") for r in good}
    masked = lambda line: " ".join("<*>" if re.search("[0-9]", w) else w for w in re.findall(r"[^\x20\x09-\x0D]+", line))
    held = Counter(m for text in before.values() for m in {masked(line) for line in text})
    sets = {i: frozenset(m for m in map(masked, text) if set(m.split(" ")) - {"", "<*>"}) for i, text in before.items()}
    carriers = {m: {i for i in sets if m in sets[i]} for m in held if held[m] >= 3 and set(m.split(" ")) - {"", "<*>"}}
    recurring = {m for m, own in carriers.items() if len({sets[i] for i in own}) > 1}
    dropped = 0
    for r in lines:  # what is left stands in order; of recurring lines exactly those of later documents went
        left, gone = r["text"].split("\n"), list(before[r["doc_id"]])
        for line in left if r["text"] != "" else []:
            gone.remove(line)
        for line in filter(masked, gone):  # recurs as it is, or agrees with other lines in at least four fifths of its words
            m = masked(line).split(" ")
            like = {i for i, s in sets.items() for o in s if (w := o.split(" ")) and len(w) == len(m) and w[:3] == m[:3] and 5 * sum(x != y for x, y in zip(w, m)) <= len(m) + 4}
            assert masked(line) in recurring or len(like) >= 2, line
        dropped += len(gone)
        assert all(min(carriers[masked(line)]) == r["doc_id"] for line in left if masked(line) in recurring)
        assert r["n_chars"] == len(r["text"]) or r["text"] == given[r["doc_id"]]["text"]
    assert dropped and recurring
    assert len(lines) == len(good)
    shingles = {r["doc_id"]: (lambda w: {" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))})(r["text"].lower().split()) for r in lines}
    kept = {r["doc_id"] for r in distinct}
    like = lambda a, b: len(shingles[a] & shingles[b]) / len(shingles[a] | shingles[b])
    for a in shingles:
        near = [b for b in shingles if b != a and like(a, b) >= 0.9]
        assert sum(b in kept for b in [a, *near]) <= 1 or not near
        assert a in kept or any(like(a, b) >= 0.6 for b in shingles if b != a)
    whole = {r["doc_id"]: r for r in distinct}
    assert mixed and all(r == whole[r["doc_id"]] for r in mixed) and max(Counter(r["doc_id"] for r in mixed).values()) <= 3
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in tokens) == Counter((r["doc_id"], *by_library(r["text"])) for r in mixed)


def test_stages_take_awkward_and_empty_tables(spark):
    docs = awkward.documents(spark)
    for frame in (docs, awkward.empty(docs)):
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, stage(frame, "awkward"), ROOT)
            assert name == "tokens" or out.columns == frame.columns
            assert out.count() <= 3 * frame.count()

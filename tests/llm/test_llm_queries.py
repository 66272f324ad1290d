"""Registered queries: equal to their SQL, or to plain versions, on a small table; and the pipeline."""

from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import connect
from test_llm_operators import plain_jaccard, plain_model, plain_quality

import corpus_pipeline
import oracle
from foldsafe.llm import jaccard, mixing, pii, quality
from foldsafe.llm.all import REGISTRY
from foldsafe.llm.queries import PII_KEY, tokenizer_path


@pytest.fixture(scope="module")
def docs(spark, folder):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


@pytest.mark.parametrize("name", [n for n, q in REGISTRY.items() if q.sql is not None])
def test_same_rows(spark, folder, name, monkeypatch):
    monkeypatch.setattr(oracle, "REGISTRY", REGISTRY)
    assert oracle.compare(spark, connect(folder), name, folder) is None


def run(spark, folder, name):
    return REGISTRY[name].build(spark, folder).collect()


def test_language(spark, folder):
    labels = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = [r for r in run(spark, folder, "op1_language_id") if r["held_out"]]
    assert sum(r["lang_pred"] == labels[r["doc_id"]] for r in rows) >= 0.95 * len(rows)


def test_packing_and_counts(spark, folder, docs, library):
    import zlib

    ids = {d: [*library.encode(t or "", add_special_tokens=False).ids, 0] for d, t in docs}
    seen = defaultdict(int)
    for r in run(spark, folder, "op2_packing"):
        part = np.array(ids[r["doc_id"]][r["start"]: r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
        seen[r["doc_id"]] += r["length"]
    assert seen == {d: len(i) for d, i in ids.items()}
    counts = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in run(spark, folder, "op4_token_counts")}
    assert counts == {d: (len(t.encode()), len(ids[d]) - 1, len(ids[d]) > 1025) for d, t in docs}


def test_pii(spark, folder, docs):
    texts = dict(docs)
    changed = 0
    for r in run(spark, folder, "op3_pii"):
        found = sum(r[f"n_{k}"] for k in pii.KINDS)
        changed += found > 0
        assert (r["text"] != texts[r["doc_id"]]) == (found > 0)
        assert "@mail" not in r["text"]
    assert changed > 0


def test_jaccard(spark, folder, docs):
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in run(spark, folder, "op6_jaccard_join"))
    assert got == plain_jaccard(docs)


def test_language_model(spark, folder, docs):
    import zlib

    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d, _ in docs}
    rows = {r["doc_id"]: r for r in run(spark, folder, "op8_lm_scoring")}
    train = [t for d, t in docs if not held[d]]
    for d, text in docs[:8]:
        n, known, base, score, total, *_ = plain_model(train, text)
        r = rows[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[d], n, known, total)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
    apart = [r for d, r in rows.items() if held[d]]
    assert sum(r["score"] for r in apart) > sum(r["base_score"] for r in apart)


def test_quality(spark, folder, docs):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    texts = dict(docs)
    for r in run(spark, folder, "op9_quality_rules"):
        assert {k: r[k] for k in plain_quality("")} == plain_quality(texts[r["doc_id"]])
        assert not (r["base_failed"] and r["kept"])
        if not r["base_failed"] and r["doc_id"] in labels:
            assert r["kept"] == bool(labels[r["doc_id"]])


def test_pipeline(spark, folder, docs, library):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    cleaned = quality.clean_lines(frame).where("kept").collect()
    kept = {r["doc_id"]: r["clean_text"] for r in cleaned}
    first = corpus_pipeline.STAGES[0][1](spark, frame, folder)
    assert first.columns == columns and {r["doc_id"]: r["text"] for r in first.collect()} == kept
    assert all(r["n_chars"] == len(r["text"]) for r in first.collect())
    rows = list(kept.items())
    stay = {d for d, _, c in plain_jaccard(rows) if d == c}
    second = jaccard.keep_one(first)
    assert {r["doc_id"] for r in second.collect()} == stay
    third = corpus_pipeline.STAGES[2][1](spark, second, folder)
    changed = {r["doc_id"]: r["text"] for r in pii.pseudonymise(frame.join(second.select("doc_id"), "doc_id").drop("text").join(
        second.select("doc_id", "text"), "doc_id"), PII_KEY).collect()}
    assert third.columns == columns and {r["doc_id"]: r["text"] for r in third.collect()} == changed
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_report(third).collect()}
    want = Counter()
    for d, n in copies.items():
        want[d] = n * (len(library.encode(changed[d], add_special_tokens=False).ids) + 1)
    got = Counter()
    for r in corpus_pipeline.run(spark, folder).collect():
        got[r["doc_id"]] += r["length"]
    assert got == Counter({d: n for d, n in want.items() if n})
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "PII", "mixing sources to target weights", "packing"
    ]


def test_pipeline_on_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == 0

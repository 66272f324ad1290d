"""Lost files, spellings of one number, and columns whose names meet those of results."""

import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

import corpus_pipeline
from foldsafe.llm import jaccard, language, ngram_lm, pii, quality, textarrays

GOOD = (
    "This is a plain line of clean prose that ends as a sentence should end, and it goes on long enough "
    "for every base rule to be content with what the writer has put down here."
)


def changed(spark, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r["text"] for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]


@pytest.mark.parametrize("lost", ["words-0", "counts-0", "pairs-0", "small-0", "follows-0", "often-0"])
@pytest.mark.parametrize("cut", [False, True])
def test_a_lost_array_is_an_error(spark, lost, cut):
    docs = spark.createDataFrame([(i, f"a b c{i % 3} d a b") for i in range(20)], "doc_id long, text string")
    model = ngram_lm.learn(docs)
    assert ngram_lm.score(docs, model, [F.col("doc_id")]).count() == 20
    path = f"{model.folder}/{lost}"
    if cut:
        os.truncate(path, os.path.getsize(path) - 1)
    else:
        os.remove(path)
    with pytest.raises(PythonException, match=lost):
        ngram_lm.score(docs, model, [F.col("doc_id")]).collect()


def test_counts_in_full_are_found(spark):
    docs = spark.createDataFrame([(i, "x y " * 300) for i in range(3)], "doc_id long, text string")
    model = ngram_lm.learn(docs)
    assert model.pair_sizes == [(4, 2)]
    assert all(r["score"] < 0 for r in ngram_lm.score(docs, model, [F.col("doc_id")]).collect())


def test_all_spellings_of_a_phone_stay_linked(spark):
    spellings = ["+442071234567", "+44 20 7123 4567", "+44-207-123-4567", "+44 207 1234567", "+44.20.7123.4567"]
    found = changed(spark, *spellings)
    digits = {re.sub(r"\D", "", t) for t in found}
    assert len(digits) == 1 and digits.pop().startswith("44") and found[0] != spellings[0]
    shape = [re.sub(r"\d", "9", t) for t in spellings]
    assert [re.sub(r"\d", "9", t) for t in found] == shape


def test_calling_codes_stay(spark):
    numbers = {"1": "+12345556789", "7": "+74951234567", "49": "+49 30 1234567", "351": "+351 21 123 4567", "420": "+420 601 123 456",
               "880": "+8801712345678", "998": "+998 71 123 4567"}
    for (code, number), text in zip(numbers.items(), changed(spark, *numbers.values())):
        assert re.sub(r"\D", "", text).startswith(code) and text != number and len(text) == len(number)
    national, abroad = changed(spark, "(234) 555-6789", "+1 (234) 555-6789")
    assert abroad == f"+1 {national}"


def test_dates_with_the_year_first(spark):
    slash, dash, wrong = changed(spark, "1999/12/31", "1999-12-31", "2023/02/30")
    assert slash == dash.replace("-", "/") and slash != "1999/12/31" and wrong == "2023/02/30"


def test_kept_documents_keep_every_column(spark):
    rows = [(1, GOOD, "x", 999, "K"), (2, "bad", "y", 1, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, lines_stutter int, Kept string")
    out = quality.kept_documents(df)
    assert out.dtypes == df.dtypes
    (row,) = out.collect()
    assert (row["doc_id"], row["n_words"], row["lines_stutter"], row["Kept"]) == (1, "x", 999, "K")
    assert [c for c in quality.clean_lines(df).columns if c.lower() == "kept"] == ["kept"]
    only = quality.kept_documents(df.select("text"))
    assert only.columns == ["text"] and only.count() == 1


def test_stages_keep_columns_with_clashing_names(spark):
    df = spark.createDataFrame([(1, f"{GOOD} Mail a@b.example.org now.", "mine")], "doc_id long, text string, pii_kinds string")
    for stage in (corpus_pipeline.quality_rules, corpus_pipeline.personal_data):
        out = stage(spark, df, "")
        assert out.columns == df.columns and out.first()["pii_kinds"] == "mine"
    assert "a@b.example.org" not in out.first()["text"]
    counted = corpus_pipeline.personal_data(spark, df.withColumn("n_chars", F.lit(0)), "").first()
    assert counted["n_chars"] == len(counted["text"])


def test_gram_counts_handed_out_on_the_way(monkeypatch):
    rows = [(f"{word} and some {i} more words of the text {i * 7919}", f"l{i % 3}") for i, word in enumerate(["alpha", "beta"] * 200)]
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows]), pa.array([x for _, x in rows])], names=["text", "lang"])
    parts = [batch.slice(i, 20) for i in range(0, len(rows), 20)]

    def counts():
        made, total = 0, Counter()
        for out in language._count_task(iter(parts)):
            made += 1
            for x, gram, n in zip(*(out.column(i).to_pylist() for i in range(3))):
                total[x, gram] += n
        return made, total

    whole = counts()
    monkeypatch.setattr(language, "_KEEP", 200)
    handed = counts()
    assert whole[0] == 1 and handed[0] > 5 and handed[1] == whole[1]
    assert list(language._count_task(iter([]))) == []


def test_rows_with_ids_of_their_own_are_kept_without_hashing_their_texts_again(spark):
    """Before, all texts were cut into shingles once more, and shuffled, to find the chosen rows."""
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(reversed(words)), "", None, "one"]
    df = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, _aside int").repartition(3)
    kept = jaccard.keep_one(df)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "InArrow" not in plan and "SortMergeJoin" not in plan
    assert sorted((r["doc_id"], r["_aside"]) for r in kept.collect()) == [(i, i) for i in (0, 2, 3, 4, 5)]


def test_rows_that_share_an_id_are_told_apart_by_their_sets(spark):
    words = [f"w{i}" for i in range(40)]
    a, near, b = " ".join(words), " ".join([*words[:-1], "other"]), " ".join(reversed(words))
    rows = [(1, a), (1, a), (1, b), (2, near), (3, b), (4, ""), (4, None), (4, "own text"), (None, "none"), (None, "none"), (None, a), (5, "none"), (6, "left alone")]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    want = [(1, a), (1, b), (4, ""), (4, None), (4, "own text"), (5, "none"), (6, "left alone")]
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, want))


def test_long_spans_and_short_ones_have_the_hashes_they_had(monkeypatch):
    """Powers of a segment serve all spans in it; a plain sum over each span says the same."""
    texts = pa.array(["a bc " * 50, "x" * 500 + " y", "", "ü " * 40, "end"])
    monkeypatch.setattr(textarrays, "_SEGMENT", 64)
    for _, part in textarrays.chunks(texts):
        starts, rows = part.words()
        found = part.hashes(starts, textarrays.LOWER_TABLE)
        ends = [*starts[1:].tolist(), len(part.data)]
        for start, end, got in zip(starts.tolist(), ends, found.tolist()):
            total = sum(int(textarrays.LOWER_TABLE[b]) * pow(textarrays._STEP, i, 1 << 64) for i, b in enumerate(part.data[start:end])) % (1 << 64)
            assert int(textarrays.mix(np.array([total], np.uint64))[0]) == got
        assert rows.tolist() == part.row_of(starts).tolist()

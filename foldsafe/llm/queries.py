"""Registered queries: each applies one operator to its whole table and derives the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsafe.llm import (
    chat, jaccard, language, mixing, ngram_lm, packing, pii, quality, search, tokens, variants, wavelet, whitening,
)
from foldsafe.llm.registry import query
from foldsafe.sources import scratch
from foldsafe.sources.tables import load

TOKENIZER = "byte_bpe_50k.json"
PII_KEY = "example-key"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_language_id")
def op1_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    apart = language.held_out()
    found = language.learn(docs.where(~apart))
    return language.predict(docs, found, [F.col("doc_id"), apart.alias("held_out")])


@query("op2_packing")
def op2_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(load(spark, folder, "documents"), tokenizer_path())
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query("op3_pii")
def op3_pii(spark: SparkSession, folder: str) -> DataFrame:
    """The key is an example; a deployment passes its own secret."""
    changed = pii.pseudonymise(load(spark, folder, "documents").select("doc_id", "text"), PII_KEY)
    gone = [F.size(F.array_remove("pii_kinds", kind)) for kind in pii.KINDS]
    kinds = [(F.size("pii_kinds") - g).cast("long").alias(f"n_{k}") for g, k in zip(gone, pii.KINDS)]
    return changed.select("doc_id", "text", *kinds)


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Starts from an empty cache of its own, so that each run counts everything."""
    cache = scratch.new_path(spark, "token-cache")
    return tokens.count_tokens(load(spark, folder, "documents"), tokenizer_path(), cache)


_CHAT_SQL = """
WITH turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST) AS pos
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations)
),
shown AS (
  SELECT conv_id, turn // 256 AS block, pos,
         '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS said,
         md5(coalesce('v' || role, 'n') || chr(1) || coalesce('v' || text, 'n')) AS h
  FROM turns
),
runs AS (
  SELECT *, md5(string_agg(h, '') OVER (PARTITION BY conv_id ORDER BY pos)) AS upto,
         count(*) OVER (PARTITION BY conv_id) AS n_turns
  FROM shown
),
ends AS (
  SELECT upto, min(conv_id) AS conv_id, count(*) AS n_copies FROM runs WHERE pos = n_turns GROUP BY upto
),
kept AS (
  SELECT * FROM ends WHERE upto NOT IN (SELECT upto FROM runs WHERE pos < n_turns)
)
SELECT r.conv_id, CAST(dense_rank() OVER (PARTITION BY r.conv_id ORDER BY block) - 1 AS INT) AS segment,
       min(pos) AS first_turn, any_value(n_turns) AS n_turns, any_value(n_copies) AS n_copies,
       string_agg(said, '' ORDER BY pos) AS text
FROM runs r JOIN kept k USING (conv_id) GROUP BY r.conv_id, block
"""


@query("op5_chat_formatting", sql=_CHAT_SQL)
def op5_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    return chat.render(load(spark, folder, "conversations"))


@query("op6_jaccard_join")
def op6_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = jaccard.join(load(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


_SEARCH_SQL = """
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(
           CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""


@query("op7_topk_search", sql=_SEARCH_SQL)
def op7_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.nearest(load(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


@query("op8_lm_scoring")
def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = load(spark, folder, "documents")
    apart = language.held_out(folds=10, fold=0)
    model = ngram_lm.learn(docs.where(~apart))
    return ngram_lm.score(docs, model, [F.col("doc_id"), apart.alias("held_out")])


@query("op9_quality_rules")
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.clean_lines(load(spark, folder, "documents").select("doc_id", "text"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_lines_removed", "n_words_removed",
    )


_MIX_SQL = r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|7'), 1, 15) AS BIGINT) AS h
  FROM documents
),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS w
  FROM docs GROUP BY source
),
levels AS (
  SELECT s.*, 3.0::DOUBLE * source_size / w AS r,
         ((SELECT sum(source_size) FROM sources)
          - coalesce((SELECT sum(3 * o.source_size) FROM sources o
                      WHERE o.source_size * s.w < s.source_size * o.w), 0))::DOUBLE
         / (SELECT sum(o.w) FROM sources o WHERE o.source_size * s.w >= s.source_size * o.w) AS level
  FROM sources s
),
planned AS (
  SELECT source, source_size,
         CASE WHEN source_size = 0 THEN 0.0::DOUBLE ELSE least(3.0::DOUBLE * source_size, w * (
           SELECT arg_min(level, r) FROM levels WHERE level <= r)) END AS target
  FROM levels
),
runs AS (
  SELECT d.*, p.source_size, p.target,
         CASE WHEN p.source_size = 0 THEN 0 ELSE floor(p.target / p.source_size) END AS copies,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
         sum(size) OVER (PARTITION BY d.source, h) AS own
  FROM docs d JOIN planned p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, round(target, 6) + 0.0 AS target,
       CAST(size * (copies + CASE WHEN upto <= target - copies * source_size
         OR (upto - own <= target - copies * source_size
             AND upto - (target - copies * source_size) < (target - copies * source_size) - (upto - own)
             AND target > copies * source_size)
         THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM runs
"""


@query("op10_mixing", sql=_MIX_SQL)
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    report = mixing.mix_report(load(spark, folder, "documents"))
    return report.select("doc_id", "size", "source_size", (F.round("target", 6) + F.lit(0.0)).alias("target"), "taken")


@query("op11_spelling_variants")
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Words of at least 5 letters and 3 occurrences; some runs lose a letter first, by a rule on their document."""
    counted = variants.word_counts(load(spark, folder, "documents"), "text", 5, "doc_id", 97)
    return variants.group(counted.where("n >= 3"))


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Entries become whole numbers first; a vector with an entry that is none (null, infinite, not a number) is left out."""
    entry = "embedding"
    finite = F.forall(entry, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(entry, lambda x: F.floor(x.cast("double") * 64).cast("long") + 1_000_000)
    rows = load(spark, folder, "embeddings").where(F.col(entry).isNotNull() & finite).select("vec_id", whole.alias(entry))
    return whitening.transform(rows, whitening.fit(rows, entry), entry, ["vec_id"])


@query("op12_wavelet_shards")
def op12_wavelet_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Everything returned is read back from the files."""
    path = scratch.new_path(spark, "wavelet")
    wavelet.write(load(spark, folder, "documents"), tokenizer_path("word_bpe_49k.json"), path)
    found = wavelet.documents(wavelet.open_index(spark, path))
    return found.select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

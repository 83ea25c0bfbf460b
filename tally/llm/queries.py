"""Registered queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_classes
from .fill_in_middle import fill_in_middle, restored
from .lm_scoring import lm_scores
from .mixing import mixture
from .nbsvm import quality_scores
from .packing import pack_documents
from .quality_rules import quality_rules
from .secret_scan import scan_corpus
from .sentence_pieces import encode_pieces
from .sharding import shuffle_to_shards
from .simhash import simhash_components
from .toxicity import toxicity_scores
from .whitening import whitened_components


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(_docs(spark, sf_dir), words=4, max_bits=4)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(_docs(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = _docs(spark, sf_dir).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"),
                                       F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    return shuffle_to_shards(docs, 24).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
                                              "slot", F.lit(None).cast("int").alias("grown_shard"))


def _held_out(modulus: int, rest: int) -> Column:
    """Whether a row is held out, by the CRC-32 of its id as text."""
    return F.coalesce(F.crc32(F.encode(F.col("id").cast("string"), "utf-8")) % modulus == rest, F.lit(False))


def _classified(scores: DataFrame, modulus: int, rest: int) -> DataFrame:
    return scores.withColumnRenamed("doc_id", "id").select(
        F.col("id").alias("doc_id"), _held_out(modulus, rest).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _classified(quality_scores(_docs(spark, sf_dir), labels, ~_held_out(3, 1)), 3, 1)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_scores(_docs(spark, sf_dir))
    return scores.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"),
                         F.round("mean_log_score", 6).alias("mean_log_score"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _classified(toxicity_scores(_docs(spark, sf_dir), labels, ~_held_out(5, 0)), 5, 0)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(_docs(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def tokenizer_path() -> str:
    """Vocabulary file of the packing query and stage."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_docs(spark, sf_dir), tokenizer_path(), 4096)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by document and position; the digest stands for the secret."""
    found = scan_corpus(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("doc_id", "start", F.length("candidate").alias("length"), F.sha2("candidate", 256).alias("sha256"),
                        F.round("probability", 6).alias("probability"), "is_secret")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests stand for the output and for the text rebuilt from it."""
    out = fill_in_middle(_docs(spark, sf_dir), unit="line", seed=7, fim_rate=100, spm_rate=50)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars",
                      F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def piece_model_path() -> str:
    """Model file of the piece query."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests stand for ids, decoded text and the pieces' first bytes;
    ``spanned_bytes``: the source bytes that the spans cover."""
    path = piece_model_path()
    coded = encode_pieces(_docs(spark, sf_dir), path, with_text=True)
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
                        F.element_at("begins", -1).cast("long").alias("spanned_bytes"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), components=32)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_mixing": op2_mixing,
    "op3_sharding": op3_sharding,
    "op4_quality": op4_quality,
    "op5_quality_rules": op5_quality_rules,
    "op6_lm_scoring": op6_lm_scoring,
    "op7_toxicity": op7_toxicity,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_packing": op9_packing,
    "op10_secret_scan": op10_secret_scan,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_sentence_pieces": op12_sentence_pieces,
    "op13_whitening": op13_whitening,
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                  md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))) AS key FROM documents),
     s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
     w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
                  source_size * 2.0::DOUBLE AS cap FROM s),
     l AS (SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total,
                  coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
                  sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
     t AS (SELECT source, source_size, least(cap, max((total - caps) / rest) OVER () * weight) AS target FROM l),
     b AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS budget FROM t),
     p AS (SELECT d.doc_id, d.size, b.source_size, b.target, b.budget,
                  coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size
                                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
           FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM p""",
    "op8_exact_dedup": r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents),
     g AS (SELECT norm, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g USING (norm)""",
    "op11_fill_in_middle": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
     u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines,
                  ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
     c AS (SELECT *, len(lines)::BIGINT AS n, least(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS a,
                  greatest(h1 % (len(lines) + 1), h2 % (len(lines) + 1)) AS b,
                  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                       WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
     p AS (SELECT *, array_to_string(lines[1:a], '') AS prefix, array_to_string(lines[a + 1:b], '') AS middle,
                  array_to_string(lines[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p""",
}

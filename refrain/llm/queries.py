"""The registered queries of this subpackage: thin, each over its whole table, through its operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from refrain.llm import (
    bpe_speculate,
    decontaminate_pigeonhole,
    exact_cuckoo,
    html_crf,
    language_kneser_ney,
    parens_trie,
    permuterm,
    quality_pu,
    rare_digest,
    simhash_vantage,
    substring_levels,
    token_files,
    toxicity_ftrl,
)
from refrain.llm.common import checksum_bucket, table
from refrain.llm.queries_sql import OP12_SQL, OP13_SQL

QUALITY_THRESHOLD = 0.3
TOXIC_THRESHOLD = 0.7


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.main_text(table(spark, sf_dir, "pages"))


def op2_simhash_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_vantage.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_levels.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"),
                        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def _judged(scored: DataFrame, modulus: int, held_out: int, threshold: float) -> DataFrame:
    return scored.select("doc_id", (checksum_bucket(F.col("doc_id"), modulus) == held_out).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality_pu.Network | None:
    return quality_pu.fit(docs, table(spark, sf_dir, "labels"), checksum_bucket(F.col("doc_id"), 5) != 0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _judged(quality_pu.score(docs, quality_model(spark, docs, sf_dir)), 5, 0, QUALITY_THRESHOLD)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity_ftrl.fit(docs, table(spark, sf_dir, "labels"), checksum_bucket(F.col("doc_id"), 3) != 1)
    return _judged(toxicity_ftrl.score(docs, model), 3, 1, TOXIC_THRESHOLD)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = token_files.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.select("doc_id", "n_tokens")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_cuckoo.exact_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP7_SQL = r"""
WITH narrow AS (
    SELECT doc_id, length(coalesce(text, '')) AS n_chars,
        sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
    doc_id = first_value(doc_id) OVER best AS kept, text_sha256
FROM narrow WINDOW best AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST)
"""


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate_pigeonhole.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def token_digests() -> list:
    return ["doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
            F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")]


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe_speculate.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return found.select(*token_digests())


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = language_kneser_ney.fit(docs, checksum_bucket(F.col("doc_id"), 4) != 2)
    found = language_kneser_ney.identify(docs, models)
    return found.select("doc_id", (checksum_bucket(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score", "accepted")


def op11_rare_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rare_digest.fingerprint_table(table(spark, sf_dir, "documents"))


def op12_spelling_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permuterm.spelling_groups(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parens_trie.conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, tuple] = {
    "op1_main_text": (op1_main_text, None),
    "op2_simhash_near": (op2_simhash_near, None),
    "op3_repeated_bytes": (op3_repeated_bytes, None),
    "op4_quality": (op4_quality, None),
    "op5_toxicity": (op5_toxicity, None),
    "op6_token_counts": (op6_token_counts, None),
    "op7_exact_dedup": (op7_exact_dedup, OP7_SQL),
    "op8_benchmark_leaks": (op8_benchmark_leaks, None),
    "op9_bpe_roundtrip": (op9_bpe_roundtrip, None),
    "op10_language": (op10_language, None),
    "op11_rare_digest": (op11_rare_digest, None),
    "op12_spelling_forms": (op12_spelling_forms, OP12_SQL),
    "op13_prefix_trie": (op13_prefix_trie, OP13_SQL),
}

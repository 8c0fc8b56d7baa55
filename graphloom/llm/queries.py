"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.decontaminate import SQL as DECONTAMINATION_SQL
from graphloom.llm.hosts import SQL as HOST_SQL


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from graphloom.llm.repair import tokenised

    return tokenised(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")), end_id=2)


def remainder(n: int):
    """crc32 of doc_id as text, modulo ``n``: which rows may teach."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.language import fit, predict

    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(remainder(4) == 2, F.lit(False)))
    return predict(docs, fit(docs.where("NOT held_out")), "doc_id", "held_out")


def op3_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from graphloom.llm.separators import counted

    return counted(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.zipwarc import round_trip

    return round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.mixing import TARGETS, mixed

    docs = table(spark, sf_dir, "documents")
    return mixed(docs, docs.where("lang IS NOT NULL"), TARGETS)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.quality import scored

    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~held_out)
    out = scored(table(spark, sf_dir, "documents"), labels)
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.htmltext import extracted

    return extracted(table(spark, sf_dir, "pages"))


def op10_embedding_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.vectors import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.conversations import damaged, repaired

    return repaired(damaged(table(spark, sf_dir, "conversations")))


def op12_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphloom.llm.hosts import host_rules

    return host_rules(table(spark, sf_dir, "documents"))


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from graphloom.llm.alignment import aligned_documents

    a, b = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return aligned_documents(table(spark, sf_dir, "documents"), a, b)


QUERIES = {
    "op1_repair_tokens": op1_repair_tokens,
    "op2_language": op2_language,
    "op3_separator_scan": op3_separator_scan,
    "op4_decontamination": op4_decontamination,
    "op5_zip_warc": op5_zip_warc,
    "op6_near_duplicates": op6_near_duplicates,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_main_text": op9_main_text,
    "op10_embedding_duplicates": op10_embedding_duplicates,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_host_rules": op12_host_rules,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}

ORACLES = {
    "op4_decontamination": DECONTAMINATION_SQL,
    "op12_host_rules": HOST_SQL,
    "op5_zip_warc": """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), q AS (
  SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS n, sha256(h) AS d FROM p
), f AS (
  SELECT d, min(page_id) AS first FROM q WHERE n >= 100 GROUP BY d
)
SELECT q.page_id, q.n AS payload_bytes, q.d AS payload_digest,
       CASE WHEN f.first IS NULL OR f.first = q.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN f.first <> q.page_id THEN f.first END AS refers_to
FROM q LEFT JOIN f ON q.d = f.d
""",
}

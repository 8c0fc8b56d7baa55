"""A corpus from raw documents to token ids, in five stages.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again
as the next one's documents.  All but the last return the columns of ``documents``.
Stages keep rows with a null ``doc_id`` unless they say otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import decontaminate, language, mixing, neardup, repair
from graphloom.llm.common import small_side, staged


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose ``doc_id`` is in ``ids``."""
    ids = staged(ids.select("doc_id").distinct(), "gone")
    return docs.join(small_side(ids, ids.count()), "doc_id", "left_anti").select(*docs.columns)


def renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that clash with no operator's, and the new name of each column."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*names), dict(zip(docs.columns, names, strict=True))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (``und``: null texts, empty ones, texts without letters); a null
    ``lang`` becomes the predicted one.

    Texts of any length count whole; equal scores go to the first language by name; repeated
    rows and rows with a null id are judged like others; an empty table stays empty; columns
    named like those of the prediction are kept as they are.
    """
    model = language.fit(docs)
    rows, at = renamed(docs)
    out = language.predict(rows, model, *rows.columns, text=at["text"]).where(F.col("lang_pred") != language.UNKNOWN)
    return out.select(*[(F.coalesce(n, "lang_pred") if c == "lang" else F.col(n)).alias(c) for c, n in at.items()])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that with the smallest id.

    Rows that share the id that is kept stay, all of them, as do rows with a null id; texts of
    any length count whole; a text without words has no copies; an empty table stays empty.
    """
    return without(docs, neardup.near_duplicates(docs).where("NOT kept"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark.

    All rows of an id go if one of them holds a passage; rows with a null id stay; texts of any
    length are searched whole; an empty table, or an empty benchmark, drops nothing.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, decontaminate.contaminated(docs, benchmark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as its fitted rate gives.

    Memberships are learnt from the labels that the corpus came with, never from those that
    ``language_id`` filled in.  Every row has a rate of its own, rows that share an id and rows with a null id too; without
    labelled rows every document stays once; long texts, ties and empty tables as in ``mixing``.
    """
    rows, at = renamed(docs)
    given = spark.read.parquet(f"{sf_dir}/documents.parquet").where("lang IS NOT NULL")
    out = mixing.rated(rows, given, mixing.TARGETS, *rows.columns, key=at["doc_id"], text=at["text"]).where("copies > 0")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(*[F.col(n).alias(c) for c, n in at.items()])


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token file and returns what it holds: ``doc_id, start, n_tokens, ids_crc32`` and more.

    Every row has its ids, copies and rows with a null id too (null ids come first); a null
    text has the end id alone; an empty table gives no rows.
    """
    import public_tokenizers

    return repair.tokenised(docs, str(public_tokenizers.path("word_bpe_49k.json")), end_id=2)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("token_output", token_output),
]

#: SQL can't express the tokenizer, the classifier or MinHash; the tests check each stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs

"""Helpers that the operators share: scratch tables, broadcasts of a checked size, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.operators.closure import shared_root

#: Most rows of a side that ``small_side`` marks for broadcast.
BROADCAST_ROWS = 200_000


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written (with the writer's ``options``) as a table in the shared folder and read again.

    This cuts the lineage: a lost executor costs no more than the stage at hand.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """From now on the session's Arrow batches hold about ``most`` bytes, however long their rows: sets and texts
    of very long documents come in small batches, those of short ones by thousands."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def open_fs(uri: str):
    """The file system and path of a URI: local, HDFS, S3 or what else pyarrow opens."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def small_side(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if ``rows``, its counted size, is at most ``most``."""
    return F.broadcast(df) if rows <= most else df


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: ``(id, component)``, component being the smallest id reachable.

    ``vertices`` has ``id``, ``edges`` has ``a, b``.  Large-star and small-star steps
    over the edge table until it no longer changes: a logarithmic number of rounds on
    chains, no collected state, and each round's table is written to the shared folder.
    The neighbour minimum is aggregated before the shuffle, so a hub is no hot key.
    Nulls are in no edge; a vertex without edges is its own component.
    """
    live = staged(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "cc",
    )
    before = None
    while True:
        both = live.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            live.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        low = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = (
            both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        )
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        live = staged(
            large.join(low2, "a")
            .select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
            .where("a <> b")
            .distinct(),
            "cc",
        )
        row = live.agg(
            F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        now = (row["n"], row["h"])
        if now == before:
            break
        before = now
    return vertices.join(live.select(F.col("a").alias("id"), F.col("b").alias("c")), "id", "left").select(
        "id", F.coalesce("c", "id").alias("component")
    )

"""Incremental jobs on Structured Streaming.

Each job takes a streaming DataFrame; state lives in Spark's state store or in bucketed
tables of a folder, never in the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from graphloom.operators.closure import cut
from graphloom.operators.domain import latest


def run(stream: DataFrame, checkpoint: str, batch=None, path: str | None = None, mode: str = "append"):
    """Runs a stream over what is there and stops: into Parquet at ``path``, or through ``batch(df, id)``."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    query = (writer.foreachBatch(batch) if batch else writer.format("parquet").option("path", path)).start()
    query.awaitTermination()


def file_stream(spark: SparkSession, folder: str, schema, per_trigger: int = 1, pattern: str | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(folder)


class Bucketed:
    """A table in a folder, partitioned by a hash of its key; a batch rewrites the buckets that its keys fall in, no others.

    The rows of these buckets are first written beside the table, then put in their place by a
    dynamic partition overwrite.  A batch that is repeated after a failure finds what it had
    written and goes on from there; one that was done changes nothing.  Nothing of earlier
    batches stays but their rows.
    """

    def __init__(self, spark: SparkSession, folder: str, schema, key: str, buckets: int = 64):
        self.spark, self.folder, self.key, self.buckets = spark, folder, key, buckets
        self.schema = spark.createDataFrame([], schema).schema
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.fs, self.path = path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path

    def _there(self, name: str) -> bool:
        return self.fs.exists(self.path(f"{self.folder}/{name}"))

    def _remove(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.folder}/{name}"), True)

    def bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _rows(self) -> DataFrame:
        """The table with its ``_bucket``."""
        whole = StructType([*self.schema.fields, StructField("_bucket", IntegerType())])
        if not self._there("table"):
            return self.spark.createDataFrame([], whole)
        return self.spark.read.schema(whole).parquet(f"{self.folder}/table")

    def read(self) -> DataFrame:
        return self._rows().drop("_bucket")

    def replace(self, rows: DataFrame, number: int, keys: DataFrame | None = None) -> None:
        """``rows`` in place of all rows of their keys, and of ``keys`` that have none now; ``number`` names the batch."""
        if self._there(f"done-{number}"):
            return
        merged = f"{self.folder}/merged-{number}"
        if not self._there(f"merged-{number}/_SUCCESS"):
            gone = rows.select(self.key) if keys is None else rows.select(self.key).unionByName(keys.select(self.key))
            gone = gone.distinct().withColumn("_bucket", self.bucket())
            touched = [r[0] for r in gone.select("_bucket").distinct().collect()]  # as many as there are buckets, at most
            kept = self._rows().where(F.col("_bucket").isin(touched)).join(gone.select(self.key), self.key, "left_anti")
            new = rows.select(*self.schema.names).withColumn("_bucket", self.bucket())
            kept.select(*new.columns).unionByName(new).withColumn("_touched", F.lit(",".join(map(str, touched)))).repartition("_bucket").write.mode("overwrite").parquet(merged)
        out = self.spark.read.parquet(merged)
        first = out.select("_touched").first()
        left = {str(r[0]) for r in out.select("_bucket").distinct().collect()}
        out.drop("_touched").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(f"{self.folder}/table")
        for bucket in set(first[0].split(",") if first else []) - left:
            self._remove(f"table/_bucket={bucket}")
        self.fs.mkdirs(self.path(f"{self.folder}/done-{number}"))
        self._remove(f"merged-{number}")
        self._remove(f"done-{number - 1}")


def upsert(table: Bucketed):
    """``foreachBatch``: a changed file's rows replace all its rows."""
    return table.replace


def upsert_latest(table: Bucketed, by: list[str]):
    """``foreachBatch``: only the last change of each key in the batch counts."""
    return lambda df, number: table.replace(latest(df, [table.key], by), number)


def changed_since(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files ``(path, mtime, size)`` that the manifest lacks in this form."""
    return files.join(manifest.select("path", "mtime", "size"), ["path", "mtime", "size"], "left_anti")


def delta_plan(files: DataFrame, manifest: DataFrame | None, references: DataFrame) -> tuple[str, DataFrame | None]:
    """``rebuild``, ``hit``, or ``delta`` with the paths to read again: changed files and those that refer to them."""
    if manifest is None:
        return "rebuild", None
    if not manifest.join(files.select("path"), "path", "left_anti").isEmpty():
        return "rebuild", None
    changed = cut(changed_since(files, manifest).select("path"))
    if changed.isEmpty():
        return "hit", None
    referrers = references.join(changed.withColumnRenamed("path", "target"), "target", "left_semi").select("path")
    return "delta", changed.union(referrers).distinct()


def dedup(stream: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """Each key once within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, time: str, by: str, width: str, delay: str) -> DataFrame:
    """Counts of ``by`` in windows; late rows beyond ``delay`` go."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, time: str, by: str, gap: str, delay: str) -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"))

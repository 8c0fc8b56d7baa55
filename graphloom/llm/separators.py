"""Token counts from flat token files without an index: a scan for separators.

A token file holds little-endian uint16 or uint32 ids and nothing else: no header, no index.
It is read by ranges of bytes, cut anywhere, one task a range.  Each range, a block, is searched
for the end-of-document id as one vector; a prefix scan over the blocks of a file then carries
the position of the last separator before each block, so that a document that spans blocks gets
its whole length.  The scan sees one small row a block (how many ids and separators it has, and
the last one's place); the places themselves stay in their blocks' rows and are joined back.

``scan`` takes any table ``(file, block, payload)``, such as the ranges of ``flat_files`` and
``read_ranges``.  ``write_flat`` writes files through ``pyarrow.fs``; a task that runs again
writes under another name, and only names that Spark has committed are read.

A special token that a text spells out (``<|endoftext|>`` in a web page, say) is encoded as
plain text, so that the end id stands at the ends of documents only; writing checks that,
and ``counted`` that each file closes as many documents as went into it.

Defined cases: ids after the last separator of a file are a last, open document
(``closed`` false); a null text is empty; an empty document has its separator alone;
an empty payload, file or table gives no documents; a payload that ends inside an id is an
error, as is an id that the width of the file cannot hold; rows that repeat an id, or have
none, are documents like others; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import n_partitions, open_fs, scratch, staged
from graphloom.llm.encode import blocks, encoder, release


def write_flat(docs: DataFrame, path: str, tokenizer: str, end_token: str, width: int = 2) -> None:
    """Writes one flat file per partition of ``docs`` to ``path/_raw``, and which documents went into it, in order, to ``path``.

    The rows at ``path`` (Parquet) are of two kinds: ``file`` with a file's number, its size (``block``) and its name
    (``payload``), and ``order`` with ids of its documents from the ``block``-th on, without a hint where they start.
    """

    def work(batches):
        import uuid

        from pyspark import TaskContext

        release(keep="encoder")
        file, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        end = enc.tokenizer.token_to_id(end_token)
        kind = np.dtype(f"<u{width}")
        fs, base = open_fs(f"{path}/_raw")
        name, out, size, seen = f"{file:05d}-{uuid.uuid4().hex}.bin", None, 0, 0
        for part in blocks(batches):
            block = enc.encode(part["text"].combine_chunks(), special_as_text=True)
            ids, lengths = block.ids()
            if (ids == end).any():
                raise ValueError(f"file {file}: a text is encoded to the end id {end}")
            ids = np.insert(ids, np.cumsum(lengths), end)
            if len(ids) and ids.max() > np.iinfo(kind).max:
                raise ValueError(f"file {file}: id {ids.max()} does not fit into {width} bytes")
            if out is None:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/{name}")
            size += out.write(ids.astype(kind).tobytes())
            yield pa.RecordBatch.from_pylist([{"kind": "order", "file": file, "block": seen, "payload": None, "doc_ids": part["doc_id"].to_pylist()}], schema=schema)
            seen += part.num_rows
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"kind": "file", "file": file, "block": size, "payload": name.encode(), "doc_ids": None}], schema=schema)

    schema = pa.schema([("kind", pa.string()), ("file", pa.int64()), ("block", pa.int64()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64()))])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows.mapInArrow(work, "kind string, file long, block long, payload binary, doc_ids array<long>").write.option(
        "compression", "zstd"
    ).partitionBy("kind").parquet(path)


def read_ranges(files: DataFrame, range_bytes: int = 8 << 20) -> DataFrame:
    """``(file, block, payload)``: ranges of ``range_bytes`` (a multiple of the ids' width) of raw ``files`` (``file, length``)."""
    ranges = files.where("length > 0").select("file", F.explode(F.expr(f"sequence(0L, (length - 1) div {range_bytes})")).alias("block"))

    def work(batches):
        for batch in batches:
            for file, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, at = open_fs(file)
                with fs.open_input_file(at) as f:
                    f.seek(block * range_bytes)
                    payload = f.read(range_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([block], pa.int64()), pa.array([payload], pa.binary())], ["file", "block", "payload"])

    return ranges.repartition(n_partitions(files.sparkSession), "file", "block").mapInArrow(work, "file string, block long, payload binary")


def flat_files(spark: SparkSession, path: str, range_bytes: int = 8 << 20) -> DataFrame:
    """``(file, block, payload)`` of the raw files at ``path``."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "length")  # without the content
    return read_ranges(files, range_bytes)


def scan(files: DataFrame, end_id: int, width: int = 2) -> DataFrame:
    """``(file, ordinal, start, n_tokens, closed)`` of each document in ``files`` (``file, block, payload``)."""
    kind = f"<u{width}"

    def work(batches):
        for batch in batches:
            out = [[], [], [], []]
            for file, block, payload in zip(*(batch.column(i) for i in range(3)), strict=True):
                raw = payload.as_buffer()
                ids = np.frombuffer(raw, kind) if raw is not None and len(raw) else np.zeros(0, kind)
                for o, x in zip(out, (file.as_py(), block.as_py(), len(ids), np.flatnonzero(ids == end_id)), strict=True):
                    o.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int64()))],
                ["file", "block", "n", "at"],
            )

    found = files.select(F.col("file").cast("string").alias("file"), F.col("block").cast("long").alias("block"), F.col("payload")).mapInArrow(
        work, "file string, block long, n long, at array<long>"
    )
    found = staged(found, "separators")
    order = Window.partitionBy("file").orderBy("block")
    past = order.rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        found.select("file", "block", "n", F.size("at").alias("k"), F.expr("try_element_at(at, -1)").alias("last"))
        .withColumn("base", F.coalesce(F.sum("n").over(past), F.lit(0)))
        .withColumn("seen", F.coalesce(F.sum("k").over(past), F.lit(0)))
        .withColumn("carry", F.coalesce(F.max(F.col("last") + F.col("base")).over(past), F.lit(-1)))
        .withColumn("tail", F.lead("block").over(order).isNull())
        .select("file", "block", "base", "seen", "carry", "tail")
    )
    placed = found.join(totals, ["file", "block"]).withColumn("at", F.expr("transform(at, x -> x + base)"))
    ends = placed.select(
        "file", "seen", "carry", "at",
        F.when(
            F.col("tail") & (F.col("base") + F.col("n") - 1 > F.greatest("carry", F.coalesce(F.expr("try_element_at(at, -1)"), F.lit(-1)))),
            F.concat("at", F.array(F.col("base") + F.col("n") - 1)),
        ).otherwise(F.col("at")).alias("all"),
    )
    return ends.select("file", "seen", "carry", "at", F.posexplode("all").alias("i", "stop"), "all").select(
        "file",
        (F.col("seen") + F.col("i")).alias("ordinal"),
        (F.when(F.col("i") > 0, F.expr("all[i - 1]")).otherwise(F.col("carry")) + 1).alias("start"),
        (F.col("stop") - F.when(F.col("i") > 0, F.expr("all[i - 1]")).otherwise(F.col("carry"))).alias("n_tokens"),
        (F.col("i") < F.size("at")).alias("closed"),
    )


def counted(docs: DataFrame, tokenizer: str, end_token: str = "<|endoftext|>", path: str | None = None) -> DataFrame:
    """Writes ``docs`` as flat files, scans them, and returns ``doc_id, file, start, n_tokens`` (separator included)."""
    from tokenizers import Tokenizer

    spark, path = docs.sparkSession, path or scratch(docs.sparkSession, "flat")
    whole = Tokenizer.from_file(tokenizer)
    end_id = whole.token_to_id(end_token)
    if end_id is None:
        raise ValueError(f"the tokenizer has no {end_token}")
    width = 2 if max(whole.get_vocab().values()) < 1 << 16 else 4
    write_flat(docs, path, tokenizer, end_token, width=width)
    rows = spark.read.schema("file long, block long, payload binary, doc_ids array<long>, kind string").parquet(path)
    order = rows.where("kind = 'order'").select(
        F.col("file").cast("string").alias("file"), F.col("block").alias("first"), F.posexplode("doc_ids").alias("i", "doc_id")
    )
    order = order.select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    files = rows.where("kind = 'file'").select(F.concat(F.lit(f"{path}/_raw/"), F.col("payload").cast("string")).alias("file"), F.col("block").alias("length"))
    found = scan(read_ranges(files), end_id, width)
    found = found.withColumn("file", F.regexp_extract("file", r"(\d+)-[0-9a-f]+\.bin$", 1).cast("long").cast("string"))
    both = found.join(order.withColumn("ordered", F.lit(True)), ["file", "ordinal"], "full")
    agree = F.coalesce(F.col("closed") & F.col("ordered"), F.lit(False))
    n_tokens = F.when(agree, F.col("n_tokens")).otherwise(F.raise_error(F.lit("a file's closed documents and ordered ids differ")).cast("long"))
    return both.select("doc_id", "file", "ordinal", "start", n_tokens.alias("n_tokens"))

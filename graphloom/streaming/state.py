"""Operators on streams that keep state of their own: moves between states, edges that wait.

State is in Spark's state store (RocksDB, which these operators need), keyed and shuffled by
Spark; each processor holds what one key has, reads no other, and is restored from the
query's checkpoint after a restart.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, DataType, LongType, StringType, StructField, StructType

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(spark: SparkSession) -> None:
    """Sets the state store that the operators of this module need: one for each partition of a join instead of four,
    and no reading of each key before it is put, which only counts keys for the metrics."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
    spark.conf.set("spark.sql.streaming.join.stateFormatVersion", "3")


def fields(**kinds: DataType) -> StructType:
    return StructType([StructField(n, k) for n, k in kinds.items()])


class Moves(StatefulProcessor):
    """Illegal moves of one key.

    Rows wait until the watermark is past them, so that rows that come out of order are judged
    in order; ``last`` is the state that the key was in.  It is forgotten ``expire_ms`` after its
    row: what comes later is a first state.  The rows of a batch are one list that is stored by
    one call, with a timer for the earliest; those that still wait after it get the next one.
    """

    def __init__(self, allowed: list[tuple[str, str]], expire_ms: int):
        self.allowed, self.expire_ms = frozenset(allowed), expire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", fields(at=LongType(), state=StringType()))
        self.waiting = handle.getListState("waiting", fields(at=ArrayType(LongType()), id=ArrayType(LongType()), state=ArrayType(StringType())))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            at, ids, states = ([*map(int, part["at"])], [*map(int, part["id"])], part["state"].tolist())
            self.waiting.appendValue((at, ids, states))
            first = min(at) if first is None else min(first, *at)
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        last = self.last.get() if self.last.exists() else None
        held = {(at, i): state for part in self.waiting.get() for at, i, state in zip(*part, strict=True)}
        due = sorted((*k, state) for k, state in held.items() if k[0] < now)
        found = []
        for at, i, state in due:
            if last is not None and at - last[0] <= self.expire_ms * 1000 and last[1] != state and (last[1], state) not in self.allowed:
                found.append((key[0], at, i, last[1], state))
            last = (at, state)
        if due:
            later = sorted((*k, state) for k, state in held.items() if k[0] >= now)
            self.waiting.clear()
            if later:
                self.waiting.appendValue(tuple(map(list, zip(*later, strict=True))))
                self.handle.registerTimer(later[0][0] // 1000 + 1)
            self.last.update(last)
            self.handle.registerTimer((last[0] // 1000) + self.expire_ms + 1)
        elif last is not None and last[0] + self.expire_ms * 1000 < now:
            self.last.clear()
        if found:
            yield pd.DataFrame(found, columns=["key", "at", "id", "source", "target"])

    def close(self) -> None:
        pass


def illegal_moves(stream: DataFrame, key: str, time: str, id: str, state: str, allowed: list[tuple[str, str]], delay: str, expire_ms: int) -> DataFrame:
    """``key, time, id, source, target`` of moves between consecutive states of a key that are not ``allowed``.

    Order is by time, then id.  A row is judged when the watermark (``delay`` behind the latest
    time) is past it; rows that come later than that are dropped by Spark.  A state counts for
    ``expire_ms`` after its row.  Null keys, times or states take no part; of two rows with one
    key, time and id the later one counts.
    """
    with_state(stream.sparkSession)
    rows = stream.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(state).isNotNull())
    rows = rows.select(F.col(key).alias("key"), F.col(time).cast("timestamp").alias("ts"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(id).cast("long").alias("id"), F.col(state).alias("state"))
    kind = rows.schema["key"].dataType.simpleString()
    out = rows.withWatermark("ts", delay).groupBy("key").transformWithStateInPandas(Moves(allowed, expire_ms), f"key {kind}, at long, id long, source string, target string", "Append", "EventTime")
    return out.select(F.col("key").alias(key), F.timestamp_micros("at").alias(time), F.col("id").alias(id), "source", "target")


class Waiting(StatefulProcessor):
    """Edges that wait for the node of their key: held until it has come, then sent once and forgotten."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", fields(known=BooleanType()))
        self.edges = handle.getListState("edges", fields(src=StringType(), dst=StringType(), edge=StringType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        is_node, held = False, []
        for r in rows:
            if r["edge"] is None:
                is_node = True
            else:
                held.append((r["src"], r["dst"], r["edge"]))
        if is_node:  # few calls of the state: a node that came before has no edges that wait
            waited = [tuple(e) for e in self.edges.get()]
            if waited:
                held = waited + held
                self.edges.clear()
            self.known.update((True,))
        if is_node or self.known.exists():
            for src, dst, edge in held:
                yield Row(src=src, dst=dst, edge=edge)
        else:
            self.edges.appendList(held)

    def close(self) -> None:
        pass


EDGE = "src string, dst string, edge string"


def _resolved(edges: DataFrame, nodes: DataFrame, end: str, salts: int, forget: bool) -> DataFrame:
    """Edges whose ``end`` is a node: keyed by it and a salt of the edge, so that a hub's edges are ``salts`` keys."""
    salt = F.pmod(F.xxhash64("edge"), F.lit(salts)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    a = edges.select(F.col(end).alias("node"), salt.alias("salt"), "src", "dst", "edge")
    if not forget:
        b = nodes.dropDuplicates(["id"]).select("id", every.alias("_salt"))
        return a.join(b, (F.col("node") == F.col("id")) & (F.col("salt") == F.col("_salt"))).select("src", "dst", "edge")
    nothing = F.lit(None).cast("string")
    b = nodes.select(F.col("id").alias("node"), every.alias("salt"), nothing.alias("src"), nothing.alias("dst"), nothing.alias("edge"))
    return a.unionByName(b).groupBy("node", "salt").transformWithState(Waiting(), EDGE, "Append", "None")


def waiting_edges(edges: DataFrame, nodes: DataFrame, salts: int = 8, forget: bool = False) -> DataFrame:
    """Streams of ``edges`` (``src, dst, edge``, its id) and ``nodes`` (``id``) to edges whose ends have both come.

    Each edge row is sent once, in the batch in which its second end comes or later.  It waits
    first for its source, then for its target; edges with a null end or id never resolve and
    take no part.  Repeated nodes change nothing.  The waiting is two joins of the streams, of
    which Spark keeps both sides.  With ``forget`` an edge leaves the state when it is sent, for
    streams without end; this costs some round trips to Python for each node and salt.
    """
    with_state(edges.sparkSession)
    rows = edges.select(*[F.col(c).cast("string").alias(c) for c in ("src", "dst", "edge")]).where("src IS NOT NULL AND dst IS NOT NULL AND edge IS NOT NULL")
    ids = nodes.select(F.col("id").cast("string").alias("id")).where("id IS NOT NULL")
    return _resolved(_resolved(rows, ids, "src", salts, forget), ids, "dst", salts, forget)


def unresolved(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``src, dst, edge, missing`` of the edges that still wait in a checkpoint of ``waiting_edges``: the ends that never came."""
    found = {(r["operatorId"], r["operatorName"]) for r in spark.read.format("state-metadata").load(checkpoint).collect()}
    state = lambda operator, **options: spark.read.format("statestore").options(operatorId=operator, **options).load(checkpoint)
    parts = []
    for operator, name in found:
        if name == "symmetricHashJoin":
            came = state(operator, joinSide="right").select("key")
            parts.append(state(operator, joinSide="left").join(came, "key", "left_anti").select("value.src", "value.dst", "value.edge", F.col("value.node").alias("missing")))
        elif name.startswith("transformWithState"):
            held = state(operator, stateVarName="edges", flattenCollectionTypes=True)
            parts.append(held.select("list_element.*", F.col("key.node").alias("missing")))
    return reduce(DataFrame.unionByName, parts)

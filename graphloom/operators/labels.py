"""Interval labels of an acyclic hierarchy: "below" as a range, not as a table of all pairs.

Each node keeps one of its parents; of this forest every node has its place in preorder and the
last place below it.  The other edges are exceptions: each leads from the range below its source
to its end, and which exception leads on to which is the only closure that is built, over
exceptions alone.  The labels are a row a node, whatever the depth, and answers join ranges on
cells of powers of two, so that a range meets the points inside it by equality.

Edges go from below (``src``) to above (``dst``).  Ranges are made level by level, in as many
rounds as the forest is deep; siblings get their places from sums over ranges of (parent,
node), so that no task holds the children of one node.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.closure import cut, identity, pairs, reach, small


@dataclass
class Labels:
    """``nodes``: ``node, pre, last``; ``exceptions``: ``id, pre, last`` of the range below and ``to``, the place of the end;
    ``onward``: ``id, next``, each exception with all that it leads to, itself included."""

    nodes: DataFrame
    exceptions: DataFrame
    onward: DataFrame


def sums_before(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """``rows`` with ``before``: the sum of ``value`` over the rows of the same ``by`` (null is one, too) that come before."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, by, order).withColumn("_range", F.spark_partition_id()))
    ranges = dealt.groupBy(by, "_range").agg(F.sum(value).alias("_all"))
    earlier = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col(by).alias("_by"), F.col("_range").alias("_r"), F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_past"))
    here = Window.partitionBy("_range", by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumn("_own", F.coalesce(F.sum(value).over(here), F.lit(0)))
    both = own.join(ranges, (F.col("_range") == F.col("_r")) & F.col(by).eqNullSafe(F.col("_by")))
    return both.select(*rows.columns, (F.col("_past") + F.col("_own")).alias("before"))


def within(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Columns of both where ``point`` of ``points`` lies in ``pre`` to ``last`` of ``ranges``: a range has two cells at most, a
    point one for each width that any range has."""
    level = F.ceil(F.log2(F.col("last") - F.col("pre") + 1.0)).cast("int")
    cell = lambda c, at: F.expr(f"{c} div cast(pow(2, {at}) as bigint)")
    ranges = cut(ranges.withColumn("_level", level))
    spread = ranges.withColumn("_cell", F.explode(F.sequence(cell("pre", "_level"), cell("last", "_level"))))
    placed = points.crossJoin(small(ranges.select("_level").distinct())).withColumn("_cell", cell("point", "_level"))  # some forty widths at most
    return placed.join(spread, ["_level", "_cell"]).where("point BETWEEN pre AND last").drop("_level", "_cell")


def labelled(edges: DataFrame) -> Labels:
    """Labels of the hierarchy ``edges``; a cycle is an error."""
    e = cut(pairs(edges).where("src <> dst"))
    nodes = identity(edges).select(F.col("src").alias("node"))
    parent = cut(e.groupBy("src").agg(F.min("dst").alias("parent")).withColumnRenamed("src", "node"))
    levels = [cut(nodes.join(parent, "node", "left_anti").withColumn("parent", F.lit(None).cast(e.schema["dst"].dataType)))]
    while not levels[-1].isEmpty():
        levels.append(cut(parent.join(levels[-1].select(F.col("node").alias("parent")), "parent").select("node", "parent")))
    sized: list[DataFrame] = []
    for level in reversed(levels):
        below = sized[-1].groupBy("parent").agg(F.sum("size").alias("_n")).withColumnRenamed("parent", "_p") if sized else None
        joined = level.join(below, level["node"] == F.col("_p"), "left") if sized else level.withColumn("_n", F.lit(0).cast("long"))
        sized.append(cut(joined.select("node", "parent", (F.coalesce("_n", F.lit(0)) + 1).alias("size"))))
    placed = cut(sums_before(reduce(DataFrame.unionByName, sized), "parent", "node", "size"))
    if placed.count() != nodes.count():
        raise ValueError("the hierarchy has a cycle")
    done, found = None, []
    for level in levels[:-1]:
        own = placed.join(level.select("node"), "node", "left_semi")
        pre = F.col("before") if done is None else F.col("_pre") + 1 + F.col("before")
        own = own if done is None else own.join(done.select(F.col("node").alias("parent"), F.col("pre").alias("_pre")), "parent")
        done = cut(own.select("node", pre.alias("pre"), (pre + F.col("size") - 1).alias("last")))
        found.append(done)
    labels = cut(reduce(DataFrame.unionByName, found, nodes.limit(0).select("node", F.lit(0).cast("long").alias("pre"), F.lit(0).cast("long").alias("last"))))
    extra = e.join(parent.select(F.col("node").alias("src"), F.col("parent").alias("dst")), ["src", "dst"], "left_anti")
    ends = labels.select(F.col("node").alias("dst"), F.col("pre").alias("to"))
    extra = extra.join(labels.withColumnRenamed("node", "src"), "src").join(ends, "dst")
    exceptions = cut(extra.select(F.xxhash64("pre", "to").alias("id"), "pre", "last", "to"))  # places name them: (pre, to) are distinct
    steps = within(exceptions.select(F.col("id").alias("src"), F.col("to").alias("point")), exceptions.select(F.col("id").alias("dst"), "pre", "last"))
    own = exceptions.select("id", F.col("id").alias("next"))
    onward = cut(reach(steps.select("src", "dst")).select(F.col("src").alias("id"), F.col("dst").alias("next")).unionByName(own).distinct())
    return Labels(labels, exceptions, onward)


def above(labels: Labels, nodes: DataFrame) -> DataFrame:
    """``src, dst``: all nodes above each of ``nodes`` (column ``node``)."""
    start = cut(labels.nodes.join(nodes.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("src"), F.col("pre").alias("point")))
    taken = within(start, labels.exceptions.select("id", "pre", "last")).select("src", "id")
    ends = taken.join(labels.onward, "id").join(labels.exceptions.select(F.col("id").alias("next"), F.col("to").alias("point")), "next").select("src", "point")
    found = within(alt_points(start, ends), labels.nodes.withColumnRenamed("node", "dst")).select("src", "dst")
    return found.where("src <> dst").distinct()


def below(labels: Labels, tops: DataFrame) -> DataFrame:
    """``src, dst``: all nodes below each of ``tops`` (column ``node``)."""
    goal = cut(labels.nodes.join(tops.select("node").distinct(), "node", "left_semi").withColumnRenamed("node", "dst"))
    into = within(labels.exceptions.select(F.col("id").alias("next"), F.col("to").alias("point")), goal).select("next", "dst")
    from_ = into.join(labels.onward, "next").join(labels.exceptions.select("id", "pre", "last"), "id").select("dst", "pre", "last")
    found = within(labels.nodes.select(F.col("node").alias("src"), F.col("pre").alias("point")), goal.unionByName(from_.select("dst", "pre", "last")).distinct())
    return found.where("src <> dst").select("src", "dst").distinct()


def alt_points(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("src", "point").unionByName(b.select("src", "point")).distinct()

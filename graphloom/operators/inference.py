"""Inference: class closure, types, sub-properties, aliases, prototype inheritance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.closure import BROADCAST_ROWS, cut, pairs, reach, seq, small

TYPE = "rdf:type"


def infer_types(types: DataFrame, superclass: DataFrame) -> DataFrame:
    """New ``(s, cls)``: instances (``s, cls``) get all ancestors of their classes (``src`` below ``dst``).

    The instances are dealt out before they multiply, to a fixed number of tasks, and their own
    classes come along as marked rows: one aggregate on the instance's own task tells what is new.
    """
    up = reach(superclass).select(F.col("src").alias("cls"), F.col("dst").alias("up"), F.lit(False).alias("own"))
    own = types.select("cls").distinct().select("cls", F.col("cls").alias("up"), F.lit(True).alias("own"))
    dealt = types.select("s", "cls").repartition(int(types.sparkSession.conf.get("spark.sql.shuffle.partitions")), "s")
    found = dealt.join(small(up.unionByName(own)), "cls").groupBy("s", F.col("up").alias("cls")).agg(F.bool_or("own").alias("own"))
    return found.where("NOT own").select("s", "cls")


def map_vocabulary(triples: DataFrame, mapping: DataFrame, fixed: DataFrame | None = None) -> DataFrame:
    """Triples and their mirrors under mapped predicates (``p, q``), with fixed hierarchy triples; a set."""
    core = triples.select("s", "p", "o")
    out = core.unionByName(core.join(small(mapping), "p").select("s", F.col("q").alias("p"), "o"))
    return (out if fixed is None else out.unionByName(fixed)).distinct()


def match_subproperty(triples: DataFrame, subproperty: DataFrame, p: str) -> DataFrame:
    """``(s, o)`` of ``p`` and its sub-properties (``src`` below ``dst``), each value once."""
    below = reach(subproperty).where(F.col("dst") == p).select(F.col("src").alias("p"))
    wanted = below.unionByName(below.sparkSession.createDataFrame([(p,)], "p string")).distinct()
    return triples.join(small(wanted), "p", "left_semi").select("s", "o").distinct()


def resolve_alias(rows: DataFrame, column: str, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``column`` rewritten through ``aliases`` (``name, id``), and the ambiguous names.

    A name that several ids claim resolves to nothing and is reported.
    """
    counted = aliases.distinct().groupBy("name").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    good = counted.where("n = 1").select(F.col("name").alias(column), "id")
    out = rows.join(good, column, "left").withColumn(column, F.coalesce("id", column)).drop("id")
    return out.select(*rows.columns), counted.where("n > 1").select("name", "n")


def nearest(rows: DataFrame, multi: list[str]) -> DataFrame:
    """``rows`` (``s, p, o, depth``) with the least depth of each (s, p), or of each (s, p, o) where ``multi`` has the
    predicate; equal rows once.  It takes one sort, which spills, and no table of groups."""
    each = F.col("p").isin(*multi) if multi else F.lit(False)
    by = Window.partitionBy("s", "p", "_each").orderBy("depth", "o")
    value = F.struct("depth", "o")
    ranked = rows.withColumn("_each", F.when(each, F.col("o"))).select(
        "*", F.first("depth").over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("_least"), F.lag(value).over(by).eqNullSafe(value).alias("_again")
    )
    return ranked.where("depth = _least AND NOT _again").drop("_each", "_least", "_again")


def doubled(values: DataFrame, links: DataFrame, multi: list[str], depth: int) -> DataFrame:
    """What ``handed_on`` finds, by doubling: a value less than ``k`` steps away is found, and what its node's heirs exactly
    ``k`` steps off get of it is less than ``2 k`` away.  A round holds a row for each value kept and each pair
    exactly ``k`` steps apart, never the chains of all prototypes."""
    found, front, k = values, links, 1
    while k <= depth:
        ends = cut(front.select("dst").distinct())
        n = ends.count()
        if not n:
            break
        # in a tree few nodes have heirs that far off: only their rows are led on
        led = lambda df, c: df.join(F.broadcast(ends.withColumnRenamed("dst", c)), c, "left_semi") if n <= BROADCAST_ROWS else df  # noqa: B023, E731
        far = led(found.where(F.col("depth") <= depth - k), "s").select(F.col("s").alias("dst"), "p", "o", (F.col("depth") + k).alias("depth"))
        found = nearest(found.unionByName(front.join(far, "dst").select(F.col("src").alias("s"), "p", "o", "depth")), multi)
        if 2 * k <= depth:
            found, front = cut(found), cut(seq(front, led(front, "src")).where("src <> dst"))
        k *= 2
    return found if k > 1 else nearest(found, multi)


def handed_on(values: DataFrame, links: DataFrame, multi: list[str], depth: int, few: int = BROADCAST_ROWS) -> DataFrame:
    """``values`` (``s, p, o, depth``) and those of prototypes (``links`` from ``src`` to ``dst``) a step farther each, up to
    ``depth``; only the ``nearest`` are kept.  Self-links are skipped.

    Nodes without heirs are set aside, and those that then have none, while that halves the links and
    more than ``few`` are left; the rest is ``doubled``.  Then each layer set aside takes the values
    of its prototypes, which all stand above it: a tree is handled in a few passes over geometrically fewer rows.
    """
    links, values = cut(pairs(links.where("src <> dst"))), cut(values.select("s", "p", "o", "depth").where("p IS NOT NULL"))
    left, layers = links.count(), []
    while left > few:
        ends = small(links.select(F.col("dst").alias("_n")).distinct())
        split = lambda df, c: cut(df.join(ends.withColumn("_led", F.lit(True)), F.col(c) == F.col("_n"), "left").drop("_n"))  # noqa: B023, E731
        parted = split(links, "src")
        before, left = left, parted.where("_led").count()
        if left > before / 2:
            break
        held = split(values, "s")
        layers.append([df.where("_led IS NULL").drop("_led") for df in (parted, held)])
        links, values = (df.where("_led").drop("_led") for df in (parted, held))
    found = doubled(values, links, multi, depth)
    for below, own in reversed(layers):
        found = cut(found)
        given = found.where(F.col("depth") < depth).select(F.col("s").alias("dst"), "p", "o", (F.col("depth") + 1).alias("depth"))
        given = below.join(given, "dst").select(F.col("src").alias("s"), "p", "o", "depth")
        found = found.unionByName(nearest(own.unionByName(given), multi))
    return found


def inherit(triples: DataFrame, links: DataFrame, multi: list[str], barred: list[str] = (), depth: int = 10) -> DataFrame:
    """New ``(s, p, o, depth)`` from prototypes.

    Single-valued predicates: the nearest prototype's values, unless the instance has its
    own.  Predicates in ``multi`` are appended, each value once.  ``barred`` ones stay.
    Own rows have depth 0 among the found ones, which tells what is inherited.
    """
    core = triples.select("s", "p", "o").where(~F.col("p").isin(*barred)) if barred else triples.select("s", "p", "o")
    return handed_on(core.withColumn("depth", F.lit(0)), links, multi, depth).where("depth > 0")


def annotate(triples: DataFrame, inferred: DataFrame) -> DataFrame:
    """``s, p, o, source, depth``: ``own`` at depth 0, or ``inherited``."""
    own = triples.select("s", "p", "o").distinct().withColumn("depth", F.lit(0)).withColumn("source", F.lit("own"))
    more = inferred.join(triples.select("s", "p", "o").distinct(), ["s", "p", "o"], "left_anti").select("s", "p", "o", "depth", F.lit("inherited").alias("source"))
    return own.unionByName(more)

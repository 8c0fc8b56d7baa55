"""Aggregates with the reference semantics where they differ from SQL's."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.closure import cut


def min_max(num: Column, text: Column, largest: bool) -> Column:
    """Numeric if every value of the group is a number, else by text."""
    pick = F.max if largest else F.min
    return F.when(F.count(num) == F.count(text), pick(num).cast("string")).otherwise(pick(text))


def avg(x: Column) -> Column:
    """Zero where there is nothing."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def group_concat(x: str, separator: str = " ", distinct: bool = False) -> Column:
    """In the values' order, so that the answer is fixed; one space where there is nothing."""
    return F.coalesce(F.expr(f"listagg({'DISTINCT ' if distinct else ''}{x}, '{separator}') WITHIN GROUP (ORDER BY {x})"), F.lit(" "))


def median(x: str) -> Column:
    """For groups whose distinct values one task can hold; ``percentiles`` has no such bound."""
    return F.coalesce(F.expr(f"percentile({x}, 0.5)"), F.lit(0.0))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """``by`` and a column for each name of ``shares``: the exact percentile of ``value`` in each group, interpolated
    between the two nearest places; zero for a group without values (nulls don't count).

    Equal values are counted first; the counts are dealt out by ranges of (group, value), and
    each range learns how many rows of a group lie before it (one small row a range and
    group).  So no task holds a group, only a range of its distinct values.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x = F.col(value).cast("double")
    counts = rows.select(*by, x.alias("_x")).where("_x IS NOT NULL").groupBy(*by, "_x").agg(F.count("*").alias("_n"))
    dealt = cut(counts.repartitionByRange(parts, *by, "_x").withColumn("_range", F.spark_partition_id()))
    keys = F.struct(*by).alias("_g") if by else F.struct(F.lit(0).alias("all")).alias("_g")
    dealt = dealt.select("_range", keys, "_x", "_n")
    ranges = dealt.groupBy("_g", "_range").agg(F.sum("_n").alias("_all"))
    before = Window.partitionBy("_g").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("_g", "_range", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_past"), F.sum("_all").over(Window.partitionBy("_g")).alias("_total"))
    here = Window.partitionBy("_range", "_g").orderBy("_x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.withColumn("_to", F.sum("_n").over(here)).join(F.broadcast(ranges) if not by else ranges, ["_g", "_range"])
    last = F.col("_past") + F.col("_to") - 1
    first = last - F.col("_n") + 1
    found = []
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("_total") - 1)
        for k, place in enumerate((F.floor(at), F.ceil(at))):
            found.append(F.max(F.when((first <= place) & (place <= last), F.col("_x"))).alias(f"{name}_{k}"))
    both = placed.groupBy("_g").agg(F.first("_total").alias("_total"), *found)
    values = []
    for name, share in shares.items():
        at = F.lit(float(share)) * (F.col("_total") - 1)
        low, high = F.col(f"{name}_0"), F.col(f"{name}_1")
        values.append((low + (high - low) * (at - F.floor(at))).alias(name))
    out = both.select("_g", *values)
    if not by:
        return rows.sparkSession.range(1).join(out, how="left").select(*[F.coalesce(n, F.lit(0.0)).alias(n) for n in shares])
    groups = rows.select(F.struct(*by).alias("_g")).distinct()
    full = groups.join(out.withColumnRenamed("_g", "_h"), F.col("_g").eqNullSafe(F.col("_h")), "left")
    return full.select("_g.*", *[F.coalesce(n, F.lit(0.0)).alias(n) for n in shares])


def corr(x: str, y: str) -> Column:
    """Pearson over pairs with both; NaN where it is undefined."""
    a, b = F.when(F.col(y).isNotNull(), F.col(x)), F.when(F.col(x).isNotNull(), F.col(y))
    return F.coalesce(F.try_divide(F.covar_pop(a, b), F.sqrt(F.var_pop(a) * F.var_pop(b))), F.lit(float("nan")))


def regression(y: str, x: str) -> tuple[Column, Column]:
    """Slope and intercept; NaN where they are undefined."""
    nan = F.lit(float("nan"))
    return F.coalesce(F.regr_slope(F.col(y), F.col(x)), nan), F.coalesce(F.regr_intercept(F.col(y), F.col(x)), nan)


class Custom:
    """A user's aggregate over one or two columns: ``partial`` gives a short list of numbers for some rows (as
    pandas Series without nulls), ``merge`` puts two such lists together, ``finish`` makes the value."""

    def __init__(self, arity: int, partial, merge, finish):
        if arity not in (1, 2):
            raise ValueError(f"one or two columns, not {arity}")
        self.arity, self.partial, self.merge, self.finish = arity, partial, merge, finish


def custom(rows: DataFrame, by: str, wanted: dict[str, tuple[Custom, list[str]]]) -> DataFrame:
    """``by`` and a double for each of ``wanted`` (name -> aggregate and its columns), null where a group has no rows for it.

    Each task keeps one partial result a group; only those meet, so no group is gathered whole.
    """
    for name, (agg, columns) in wanted.items():
        if len(columns) != agg.arity:
            raise ValueError(f"{name}: {agg.arity} columns, not {len(columns)}")
    needed = sorted({c for _, cs in wanted.values() for c in cs})
    key = rows.schema[by].dataType.simpleString()

    def gather(batches):
        states: dict = {}
        for batch in batches:
            for g, part in batch.groupby(by, dropna=False, sort=False):
                for name, (agg, columns) in wanted.items():
                    some = part[columns].dropna()
                    new = agg.partial(*(some[c] for c in columns)) if len(some) else None
                    old = states.get((g, name))
                    states[g, name] = new if old is None else old if new is None else agg.merge(old, new)
        for (g, name), s in states.items():
            yield pd.DataFrame({by: [None if pd.isna(g) else g], "_name": [name], "_state": [None if s is None else [float(x) for x in s]]})

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        out = {by: [group[by].iloc[0]]}
        for name, (agg, _) in wanted.items():
            state = None
            for s in group.loc[group["_name"] == name, "_state"]:
                state = s if state is None else state if s is None else agg.merge(state, s)
            out[name] = [None if state is None else float(agg.finish(state))]
        return pd.DataFrame(out)

    partials = rows.select(by, *needed).mapInPandas(gather, f"`{by}` {key}, _name string, _state array<double>")
    return partials.groupBy(by).applyInPandas(finish, f"`{by}` {key}, " + ", ".join(f"`{n}` double" for n in wanted))


def top_groups(rows: DataFrame, group: str, n: int, other: str = "Other") -> DataFrame:
    """Counts of the ``n - 1`` largest groups; the rest falls together as ``other``."""
    counts = rows.groupBy(group).agg(F.count("*").alias("n"))
    return _folded(counts, group, n, other).groupBy(F.col("label").alias(group)).agg(F.sum("n").alias("n"))


def _folded(counts: DataFrame, group: str, n: int, other: str) -> DataFrame:
    """``counts`` with ``label``: the group's name if it is one of the ``n - 1`` largest, else ``other``."""
    top = counts.orderBy(F.desc("n"), group).limit(n - 1).select(F.col(group).alias("_g"), F.lit(True).alias("_top"))
    label = F.when(F.col("_top"), F.col(group)).otherwise(other)
    return counts.join(F.broadcast(top), F.col(group).eqNullSafe(F.col("_g")), "left").select(*counts.columns, label.alias("label"))


def group_edges(nodes: DataFrame, edges: DataFrame, n: int, other: str = "Other") -> DataFrame:
    """``a, b, n``: edges (``src, dst``) within and between the ``n - 1`` largest groups of ``nodes`` (``node, grp``) and the rest."""
    counts = nodes.groupBy("grp").agg(F.count("*").alias("n"))
    label = _folded(counts, "grp", n, other).select("grp", "label")
    of = nodes.join(label, nodes["grp"].eqNullSafe(label["grp"])).select("node", "label")
    ends = lambda node, name: of.select(F.col("node").alias(node), F.col("label").alias(name))
    return edges.join(ends("src", "a"), "src").join(ends("dst", "b"), "dst").groupBy("a", "b").agg(F.count("*").alias("n"))

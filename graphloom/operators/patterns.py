"""Graph-pattern algebra: patterns, joins, optional parts, negation, unions, forms.

A solution set is a DataFrame with one column per variable; null is unbound.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.closure import cut
from graphloom.sources.triples import match


def variable(term: str | None) -> str | None:
    """Name of a ``?variable`` term, without a typed suffix."""
    return term[1:].partition(":")[0] if isinstance(term, str) and term.startswith("?") else None


def pattern(triples: DataFrame, s: str, p: str, o: str) -> DataFrame:
    """Solutions of one pattern.  An object ``?x:num`` or ``?x:ts`` binds the typed projection."""
    constants = {k: t for k, t in (("s", s), ("p", p), ("o", o)) if not variable(t)}
    typed = {"num": "o_num", "ts": "o_ts"}.get(o.partition(":")[2] if variable(o) else "", "o")
    rows = match(triples, **constants)
    bound: dict[str, Column] = {}
    for column, term in (("s", s), ("p", p), (typed, o)):
        if name := variable(term):
            if name in bound:
                rows = rows.where(bound[name] == F.col(column))
            bound.setdefault(name, F.col(column))
    return rows.select(*[c.alias(n) for n, c in bound.items()])


def bgp(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Patterns joined on their shared variables, in the order given; Catalyst picks the joins."""
    return reduce(join, [pattern(triples, *p) for p in patterns])


def join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join of solutions whose shared variables are bound."""
    shared = [c for c in left.columns if c in right.columns]
    return left.join(right, shared) if shared else left.crossJoin(right)


#: Rows of the right side from which ``join_compat`` deals out both sides.
CHUNK_ROWS = 20_000


def join_compat(left: DataFrame, right: DataFrame, nullable: list[str]) -> DataFrame:
    """Join in which an unbound variable is compatible with anything.

    Rows are split by which ``nullable`` variables are bound, so that every part joins on
    plain equality; only solutions that share no bound variable at all pair up freely.  Few
    values may make most of the answer.  So a small right side meets left rows that are dealt
    out evenly; of a larger one each chunk meets each lot of the left rows, which then come one
    after the other with the same matches: written out, such repetition takes little room.
    """
    shared = [c for c in left.columns if c in right.columns]
    nullable = [c for c in shared if c in nullable]
    firm = [c for c in shared if c not in nullable]
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    right = cut(right.withColumn("_chunk", F.monotonically_increasing_id()))
    left = cut(left.repartition(tasks).withColumn("_lot", F.monotonically_increasing_id()).sortWithinPartitions(*firm, *nullable))
    chunks = math.ceil(right.count() / CHUNK_ROWS)
    if chunks > 1:
        lots = math.ceil(4 * tasks / chunks)
        every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        left = left.withColumn("_lot", (F.col("_lot") % lots).cast("int")).withColumn("_chunk", every(chunks))
        right = right.withColumn("_chunk", (F.col("_chunk") % chunks).cast("int")).withColumn("_lot", every(lots)).hint("merge")
        grid = ["_lot", "_chunk"]
    else:
        left, right, grid = left.drop("_lot"), F.broadcast(right.drop("_chunk")), []
    parts = []
    for lb, rb in product(product((True, False), repeat=len(nullable)), repeat=2):
        a, b, on = left, right, [*firm]
        for c, x, y in zip(nullable, lb, rb, strict=True):
            a = a.where(F.col(c).isNotNull() if x else F.col(c).isNull())
            b = b.where(F.col(c).isNotNull() if y else F.col(c).isNull())
            if x and y:
                on.append(c)
            elif x:
                b = b.drop(c)
            else:
                a = a.drop(c)
        on += grid
        a = a.repartition(tasks, *on) if grid else a
        parts.append((a.join(b, on) if on else a.crossJoin(b)).drop(*grid))
    return reduce(lambda x, y: x.unionByName(y), parts)


def optional(left: DataFrame, right: DataFrame, condition: Column | None = None) -> DataFrame:
    """Left join on the shared variables, unbound matching unbound only; a filter belongs on the right side."""
    right = right if condition is None else right.where(condition)
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        return left.join(right, F.lit(True), "left")
    renamed = right.select(*[F.col(c).alias(f"_{c}") if c in shared else F.col(c) for c in right.columns])
    on = reduce(lambda x, y: x & y, [left[c].eqNullSafe(renamed[f"_{c}"]) for c in shared])
    return left.join(renamed, on, "left").drop(*[f"_{c}" for c in shared])


def minus(left: DataFrame, right: DataFrame, nullable: list[str] | None = None) -> DataFrame:
    """Solutions without a compatible one on the right that shares a bound variable.

    The left rows are split by which ``nullable`` variables (all shared ones, if not given)
    are bound, and the right ones by which of those are bound too, so that every part is an
    anti join on equality.
    """
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        return left
    loose = shared if nullable is None else [c for c in shared if c in nullable]
    firm = [c for c in shared if c not in loose]
    bound = lambda on, off: reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in on] + [F.col(c).isNull() for c in off], F.lit(True))
    parts = []
    for given in product((True, False), repeat=len(loose)):
        own = [c for c, x in zip(loose, given, strict=True) if x]
        rows = left.where(bound(own, [c for c in loose if c not in own]))
        for both in product((True, False), repeat=len(own)):
            common = [c for c, x in zip(own, both, strict=True) if x]
            if firm or common:
                keys = right.where(bound(common, [c for c in own if c not in common])).select(*firm, *common).distinct()
                rows = rows.join(keys, firm + common, "left_anti")
        parts.append(rows)
    return reduce(lambda x, y: x.unionByName(y), parts).select(*left.columns)


def exists(left: DataFrame, right: DataFrame, negated: bool = False) -> DataFrame:
    """``FILTER EXISTS`` (or NOT EXISTS) on the shared variables."""
    shared = [c for c in left.columns if c in right.columns]
    if not shared:
        any_row = right.limit(1).select(F.lit(1).alias("_one"))
        return left.join(any_row, F.lit(True), "left_anti" if negated else "left_semi")
    return left.join(right, shared, "left_anti" if negated else "left_semi")


def union(*parts: DataFrame, all: bool = False) -> DataFrame:  # noqa: A002
    """Union of solutions with differing variables; duplicates go unless ``all``."""
    out = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    return out if all else out.distinct()


#: A UUID anywhere in an id.
UUID = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"


def lookup_by_uuid(subjects: DataFrame, wanted: DataFrame) -> DataFrame:
    """``s, uid`` of the subjects whose id holds a wanted ``uuid``: the UUID becomes a column, and the lookup an equality join."""
    held = subjects.withColumn("uid", F.lower(F.nullif(F.regexp_extract("s", f"({UUID})", 1), F.lit(""))))
    return held.join(wanted.select(F.lower("uuid").alias("uid")).distinct(), "uid", "left_semi")


def construct(solutions: DataFrame, template: list[tuple[str, str, str]]) -> DataFrame:
    """Template triples for each solution; a triple with an unbound variable is skipped; a set."""
    term = lambda t: F.col(variable(t)).cast("string") if variable(t) else F.lit(t)
    rows = F.array(*[F.struct(term(s).alias("s"), term(p).alias("p"), term(o).alias("o")) for s, p, o in template])
    return solutions.select(F.explode(rows).alias("t")).select("t.*").dropna().distinct()


def describe(triples: DataFrame, resources: DataFrame, depth: int = 1) -> DataFrame:
    """Triples around ``resources`` (column ``r``), up to ``depth`` steps in both directions."""
    core = triples.select("s", "p", "o", "o_kind")
    out, frontier = None, resources.select("r").distinct()
    for step in range(depth):
        at = frontier.select(F.col("r").alias("_r"))
        near = core.join(at, F.col("s") == F.col("_r"), "left_semi").unionByName(
            core.where("o_kind = 'iri'").join(at, F.col("o") == F.col("_r"), "left_semi")
        )
        out = near if out is None else out.unionByName(near)
        if step + 1 < depth:
            ends = near.select(F.explode(F.array("s", F.when(F.col("o_kind") == "iri", F.col("o")))).alias("r"))
            frontier = frontier.unionByName(ends.where("r IS NOT NULL")).distinct()
    return out.distinct()


def ask(solutions: DataFrame) -> DataFrame:
    """One row, ``answer``: is there any solution?"""
    return solutions.limit(1).agg((F.count("*") > 0).alias("answer"))


def insert_data(triples: DataFrame, new: DataFrame) -> DataFrame:
    """The table's next version: a set."""
    return triples.unionByName(new).distinct()


def delete_data(triples: DataFrame, gone: DataFrame) -> DataFrame:
    """The table's next version without the exact triples ``gone``."""
    g = gone.select(*[F.col(c).alias(f"_{c}") for c in gone.columns])
    return triples.join(g, reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in gone.columns]), "left_anti")


def answers_equal(left: DataFrame, right: DataFrame) -> DataFrame:
    """Differences of two answers as bags: ``side`` says where the row is too much."""
    right = right.select(*left.columns)
    return (
        left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
    )


#: Comparison names of a filter spec.
OPERATORS = {
    "eq": lambda c, v: c == v, "ne": lambda c, v: c != v, "gt": lambda c, v: c > v, "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v, "lte": lambda c, v: c <= v, "contains": lambda c, v: c.contains(v),
    "startsWith": lambda c, v: c.startswith(v), "endsWith": lambda c, v: c.endswith(v), "in": lambda c, v: c.isin(v),
    "notIn": lambda c, v: ~c.isin(v), "isNull": lambda c, v: c.isNull(), "isNotNull": lambda c, v: c.isNotNull(),
}


def layout_query(triples: DataFrame, cls: str, columns: dict[str, str], filters: list[tuple], order: list[str], offset: int = 0, limit: int | None = None) -> DataFrame:
    """A table view: instances of ``cls`` with optional ``columns`` (name -> predicate or ``predicate:num``), filtered and paged."""
    rows = pattern(triples, "?id", "rdf:type", cls)
    for name, predicate in columns.items():
        p, _, typed = predicate.partition(":")
        rows = optional(rows, pattern(triples, "?id", p, f"?{name}" + (f":{typed}" if typed else "")))
    for name, op, *value in filters:
        rows = rows.where(OPERATORS[op](F.col(name), value[0] if value else None))
    rows = rows.orderBy(*[F.col(c[1:]).desc_nulls_first() if c.startswith("-") else F.col(c).asc_nulls_last() for c in order])
    rows = rows.offset(offset) if offset else rows
    return rows.limit(limit) if limit is not None else rows

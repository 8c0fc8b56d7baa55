"""Queries of everyday work on entities: days, blockers, naming, workflows, layouts, gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.closure import BROADCAST_ROWS, cut, plus, small


def preconditions(rows: DataFrame, flags: dict[str, Column], trees: dict[str, tuple]) -> DataFrame:
    """One boolean column for each flag, and one for each tree ``(and|or|not, ...)`` over them, in Kleene logic."""

    def build(node) -> Column:
        if isinstance(node, str):
            return F.col(node)
        op, *parts = node
        cols = [build(p) for p in parts]
        return ~cols[0] if op == "not" else reduce(lambda a, b: a & b if op == "and" else a | b, cols)

    out = rows.withColumns(flags)
    return out.withColumns({k: build(t) for k, t in trees.items()})


#: Rows of a cell from which ``overlaps`` deals it out to several tasks.
HOT_CELL = 20_000
#: Parts that such a cell is dealt out to at most, while none of them gets more than ``HOT_CELL`` rows.
CELL_PARTS = 256


def overlaps(rows: DataFrame, key: str, start: str, end: str, by: list[str] | None = None, hot: int = HOT_CELL) -> DataFrame:
    """Pairs of intervals that overlap, ``key1 < key2``, with the columns of both.

    Each interval has a level, the power of two of days that holds its length, and touches at
    most two cells of that width.  Of a pair, the longer one is met in its own cells; the
    shorter one is put into its cells at each level from its own on that any row has.  So an
    interval of decades is two rows, not one for each month, and a row has some two copies for
    each level at most.  A pair counts in the first cell that both touch, which is the first of
    one of them.  A cell with more than ``hot`` rows is dealt out: its rows by a hash of their key,
    the longer ones to each part.  The parts stop growing in number before they grow large, so
    copies of the longer ones grow with the rows; what is asked of each pair compares columns
    and computes nothing.  Intervals that are empty or lack an end take no part.
    """
    by = by or []
    day = lambda c: F.unix_date(F.to_date(c))
    cell = lambda d, level: F.expr(f"floor({d} / pow(2, {level}))").cast("long")
    rows = rows.where(F.col(start) < F.col(end)).select(*by, F.col(key).alias("_k"), F.col(start).alias("_s"), F.col(end).alias("_e"), day(start).alias("_from"), day(end).alias("_to"))
    rows = cut(rows.withColumn("_level", F.ceil(F.log2(F.col("_to") - F.col("_from") + 1.0)).cast("int")))
    present = small(rows.select(F.col("_level").alias("_at")).distinct())
    spread = lambda df, level: df.withColumn("_cell", F.explode(F.sequence(cell("_from", level), cell("_to", level)))).withColumn("_first", F.col("_cell") == cell("_from", level))
    longer = spread(rows, "_level").select(*by, F.col("_level").alias("_at"), "_cell", F.col("_k").alias("_kl"), F.col("_s").alias("_sl"), F.col("_e").alias("_el"), F.col("_first").alias("_firstl"))
    other = spread(rows.join(present, F.col("_at") >= F.col("_level")), "_at").select(*by, "_at", "_cell", "_k", "_s", "_e", "_first", (F.col("_level") < F.col("_at")).alias("_shorter"))
    place = [*by, "_at", "_cell"]
    parts = F.least(F.ceil(F.col("_n") / hot), F.greatest(F.lit(CELL_PARTS), F.ceil(F.col("_n") / HOT_CELL))).cast("int")
    crowded = cut(other.groupBy(*place).agg(F.count("*").alias("_n")).where(F.col("_n") > hot).withColumn("_parts", parts).drop("_n"))
    dealt = lambda df: df.join(F.broadcast(crowded) if crowded.count() <= BROADCAST_ROWS else crowded, place, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    other = dealt(other).withColumn("_part", F.pmod(F.xxhash64("_k"), F.col("_parts")).cast("int")).drop("_parts")
    longer = dealt(longer).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    pairs = longer.join(other, [*place, "_part"])
    pairs = pairs.where((F.col("_kl") < F.col("_k")) | F.col("_shorter") & (F.col("_kl") > F.col("_k")))
    pairs = pairs.where((F.col("_sl") < F.col("_e")) & (F.col("_s") < F.col("_el")) & (F.col("_first") | F.col("_firstl")))
    first = F.col("_kl") < F.col("_k")
    side = lambda n, x, y: [F.when(first, F.col(x[i])).otherwise(F.col(y[i])).alias(f"{c}{n}") for i, c in enumerate((key, start, end))]
    a, b = ("_kl", "_sl", "_el"), ("_k", "_s", "_e")
    return pairs.select(*by, *side(1, a, b), *side(2, b, a))


def top_places(rows: DataFrame, keys: list, n: int) -> DataFrame:
    """The first ``n`` rows in the order of ``keys`` with their place, from one."""
    top = rows.orderBy(*keys).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*keys)))


def places(rows: DataFrame, keys: list) -> DataFrame:
    """All rows with their ``place`` in the order of ``keys``, from one: ranges of the order are sorted apart,
    and each starts where the ranges before it end (one small row a range)."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.repartitionByRange(parts, *keys).withColumn("_range", F.spark_partition_id()))
    before = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    past = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    before = before.select("_range", F.coalesce(past, F.lit(0)).alias("_past"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn("place", F.col("_past") + F.col("_own")).select(*rows.columns, "place")


def in_day(columns: list[str], day: str) -> Column:
    """Any of the timestamps lies in the day."""
    a = F.lit(day).cast("timestamp")
    return reduce(lambda x, y: x | y, [(F.col(c) >= a) & (F.col(c) < a + F.expr("INTERVAL 1 DAY")) for c in columns])


def gaps(rows: DataFrame, by: list[str], start: str, end: str, least_seconds: int) -> DataFrame:
    """Free slots of ``least_seconds`` or more between intervals, overlapping ones merged."""
    w = Window.partitionBy(*by).orderBy(start, end)
    done = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, 0))
    slots = rows.select(*by, done.alias("free_from"), F.lead(start).over(w).alias("free_to"))
    return slots.where(F.unix_timestamp("free_to") - F.unix_timestamp("free_from") >= least_seconds)


def keep_first(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row for each key: the first in ``order``."""
    fields = [c for c in rows.columns if c not in key]
    if all(isinstance(o, str) for o in order):  # the least of a struct: aggregated before the shuffle, no window
        rest = [c for c in fields if c not in order]
        return rows.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in fields])
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select(*key, *fields)


def latest(rows: DataFrame, key: list[str], by: list[str]) -> DataFrame:
    """The row of each key with the largest ``by``: partial aggregates, no window."""
    fields = [c for c in rows.columns if c not in key]
    order = F.struct(*by, *[c for c in fields if c not in by])
    return rows.groupBy(*key).agg(F.max_by(F.struct(*fields), order).alias("_r")).select(*key, "_r.*")


def transitions(rows: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """Moves ``(key, source, target)`` between consecutive states of a key."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.select(key, *order, F.lag(state).over(w).alias("source"), F.col(state).alias("target")).where("source IS NOT NULL AND source <> target")


def resolve_first(rows: DataFrame, key: str, candidates: list[Column]) -> DataFrame:
    """The first candidate that is not null, with its rank."""
    rank = reduce(lambda acc, x: F.when(x[1].isNotNull(), F.lit(x[0])).otherwise(acc), reversed(list(enumerate(candidates))), F.lit(None).cast("int"))
    return rows.select(key, F.coalesce(*candidates).alias("value"), rank.alias("rank"))


def render(template: str, columns: list[str]) -> Column:
    """``{{key}}`` filled from ``columns``; empty parts and doubled separators go."""
    out: Column = F.lit(template)
    for c in columns:
        out = F.replace(out, F.lit("{{" + c + "}}"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    out = F.regexp_replace(out, r"\{\{[^}]*\}\}", "")
    out = F.regexp_replace(out, r"(\s*-\s*)+", " - ")
    return F.trim(F.regexp_replace(out, r"^\s*-\s*|\s*-\s*$", ""))


def participating(entities: DataFrame, ancestors: DataFrame, rules: DataFrame) -> DataFrame:
    """The rules that hold for each entity: those of its class that match, else those of the nearest ancestor that has any.

    ``entities`` has ``key, cls, tags`` (an array); ``ancestors`` ``src, dst, depth``; ``rules``
    ``cls, priority, rule, needs`` (a tag, or null) and what else they carry.
    """
    chain = entities.select("key", "cls", "tags", F.lit(0).alias("depth")).unionByName(
        entities.join(ancestors.select(F.col("src").alias("cls"), "dst", "depth"), "cls").select("key", F.col("dst").alias("cls"), "tags", "depth")
    )
    fits = chain.join(small(rules), "cls").where(F.col("needs").isNull() | F.array_contains("tags", F.col("needs")))
    near = F.min("depth").over(Window.partitionBy("key"))
    return fits.withColumn("_near", near).where("depth = _near").drop("_near", "tags")


def composed(rules: DataFrame) -> DataFrame:
    """``key, template``: the rules of a key (``prefix, core, suffix``), in order of priority, put together:
    the first core that is not empty, and each prefix and suffix token once, in that order."""
    fields = F.struct("priority", "rule", "prefix", "core", "suffix")
    own = rules.groupBy("key").agg(F.array_sort(F.collect_list(fields)).alias("r"))  # as many as a class has rules
    tokens = lambda part: F.filter(F.array_distinct(F.flatten(F.transform("r", lambda x: F.split(F.trim(x[part]), r"\s+")))), lambda t: t != "")
    core = F.coalesce(F.get(F.filter(F.transform("r", lambda x: x["core"]), lambda c: c != ""), F.lit(0)), F.lit(""))
    before = F.array_join(F.transform(tokens("prefix"), lambda t: F.concat(t, F.lit(" "))), "")
    after = F.array_join(F.transform(tokens("suffix"), lambda t: F.concat(F.lit(" "), t)), "")
    return own.select("key", F.concat(before, core, after).alias("template"))


def next_states(current: DataFrame, moves: DataFrame, terminal: DataFrame) -> DataFrame:
    """``state``'s moves (``source, target, rollback``) for each row of ``current``, with ``kind`` available or
    rollback; a row in a ``terminal`` state has one of that kind without a target as well."""
    steps = current.join(small(moves.select(F.col("source").alias("state"), "target", "rollback")), "state")
    steps = steps.withColumn("kind", F.when(F.col("rollback"), "rollback").otherwise("available")).drop("rollback")
    ends = current.join(small(terminal.select("state")), "state").withColumns({"target": F.lit(None).cast("string"), "kind": F.lit("terminal")})
    return steps.unionByName(ends)


def creation_gate(candidates: DataFrame, nodes: DataFrame, guarded: DataFrame, exempt: DataFrame, evidence: str, anchors: DataFrame, allowed: DataFrame, depth: int = 12) -> DataFrame:
    """``id, reason`` of each candidate (``id, cls, text``).

    A candidate whose class is not ``guarded`` (column ``cls``) is ``unguarded``; one of an
    ``exempt`` class with ``evidence`` (a pattern) in its text is ``exempt``.  For the others
    the chain of parents is walked in ``nodes`` (``id, cls, parent, direction``), from the
    candidate's own node on: ``allowed`` at an anchor class whose direction is among
    ``allowed``; else ``chain-ended``, ``too-deep``, ``missing-parent`` or ``cycle``.
    """
    flag = lambda df, name: small(df.select("cls").distinct().withColumn(name, F.lit(True)))
    first = candidates.join(flag(guarded, "_guarded"), "cls", "left").join(flag(exempt, "_exempt"), "cls", "left")
    free = F.when(F.col("_guarded").isNull(), "unguarded").when(F.col("_exempt") & F.rlike("text", F.lit(evidence)), "exempt")
    first = cut(first.select("id", free.alias("reason")))
    done = first.where("reason IS NOT NULL")
    places = nodes.join(flag(anchors, "_anchor"), "cls", "left").join(small(allowed.select("direction").distinct().withColumn("_allowed", F.lit(True))), "direction", "left")
    places = cut(places.select(F.col("id").alias("node"), "parent", F.coalesce(F.col("_anchor") & F.col("_allowed"), F.lit(False)).alias("good")))
    live = first.where("reason IS NULL").select("id", F.col("id").alias("node"), F.array("id").alias("seen"))
    for hops in range(depth + 1):
        j = live.join(places, "node", "left")
        missing = F.col("good").isNull()
        reason = (
            F.when(missing, "missing-parent").when(F.col("good"), "allowed").when(F.col("parent").isNull(), "chain-ended")
            .when(F.lit(hops == depth), "too-deep").when(F.array_contains("seen", F.col("parent")), "cycle")
        )
        step = cut(j.select("id", "parent", "seen", reason.alias("reason")))
        done = done.unionByName(step.where("reason IS NOT NULL").select("id", "reason"))
        live = step.where("reason IS NULL").select("id", F.col("parent").alias("node"), F.array_append("seen", F.col("parent")).alias("seen"))
        if not live.take(1):
            break
    return done


def class_properties(triples: DataFrame, types: DataFrame) -> DataFrame:
    """``cls, property, subjects, n``: which properties the instances (``s, cls``) of each class have."""
    per = triples.groupBy("s", F.col("p").alias("property")).agg(F.count("*").alias("k"))
    return per.join(types, "s").groupBy("cls", "property").agg(F.count("*").alias("subjects"), F.sum("k").alias("n"))


def effective_set(roots: DataFrame, depends: DataFrame, floor: DataFrame, known: DataFrame) -> DataFrame:
    """``member, resolved``: the roots, what they depend on (``src`` on ``dst``) and a fixed floor, each once, and
    whether it is ``known``."""
    more = plus(depends, start=roots.select(F.col("member").alias("src"))).select(F.col("dst").alias("member"))
    every = roots.select("member").unionByName(more).unionByName(floor.select("member")).distinct()
    there = known.select("member").distinct().withColumn("_there", F.lit(True))
    return every.join(there, "member", "left").select("member", F.col("_there").isNotNull().alias("resolved"))


def instantiation_rule(entities: DataFrame, ancestors: DataFrame, rules: DataFrame, settings: DataFrame) -> DataFrame:
    """``s, rule, prototype, folder, settings`` of entities ``(s, cls)``: the first rule, by name, whose class is the
    entity's or an ancestor of it.

    ``ancestors`` has ``src, dst``; ``rules`` ``rule, cls, prototype, folder``; ``settings`` ``rule, key, value``, told as
    ``key=value`` in the order of keys, joined by ``;``.
    """
    up = ancestors.select(F.col("src").alias("cls"), F.col("dst").alias("up"))
    kinds = entities.select("cls").distinct()
    every = kinds.select("cls", F.col("cls").alias("up")).unionByName(kinds.join(up, "cls").select("cls", "up"))
    first = keep_first(every.join(rules.withColumnRenamed("cls", "up"), "up").select("cls", "rule", "prototype", "folder"), ["cls"], ["rule"])
    pair = F.concat_ws("=", "key", "value")
    told = settings.groupBy("rule").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", pair.alias("kv")))), lambda x: x["kv"]), ";").alias("settings"))
    rule = first.join(told, "rule", "left").select("cls", "rule", "prototype", "folder", F.coalesce("settings", F.lit("")).alias("settings"))
    return entities.join(small(rule), "cls").select("s", "rule", "prototype", "folder", "settings")

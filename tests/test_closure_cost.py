"""What closures shuffle and write, and exact depths."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from graphloom.operators import closure as C
from graphloom.operators import domain as W
from graphloom.operators import inference as I
from graphloom.operators import refresh as R
from graphloom.operators import shapes as V


def graph(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def halving(spark, n):
    return graph(spark, [(i, i // 2) for i in range(2, n)])


def depths(pairs):
    """The nearest depth of each pair, by breadth-first search."""
    out = {}
    for s in {a for a, _ in pairs}:
        front, k = {s}, 0
        while front:
            k += 1
            front = {b for a, b in pairs if a in front and (s, b) not in out}
            out |= {(s, b): k for b in front}
    return out


def shuffled(spark, df):
    """Rows that are shuffled while ``df()`` is built and read."""
    store = spark.sparkContext._jsc.sc().statusStore()
    gateway = spark.sparkContext._gateway

    def total():
        stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = total()
    df().write.format("noop").mode("overwrite").save()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in total().items() if k not in before)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_nearest_depths_on_random_graphs(spark, seed):
    r = random.Random(seed)
    pairs = list({(r.randrange(14), r.randrange(14)) for _ in range(20)})
    want = depths(pairs)
    for depth in (None, 1, 3, 4, 6):
        got = {(a, b): k for a, b, k in C.plus(graph(spark, pairs), depth=depth).collect()}
        assert got == {p: k for p, k in want.items() if depth is None or k <= depth}
    nodes = {x for p in pairs for x in p}
    starred = [tuple(x) for x in C.star(graph(spark, pairs)).collect()]
    assert sorted(starred) == sorted(set(want) | {(x, x) for x in nodes})
    wanted = [(a, b) for a in range(15) for b in range(0, 15, 2)]
    assert {tuple(x) for x in C.covered(graph(spark, wanted), graph(spark, pairs)).collect()} == set(want) & set(wanted)


def test_closure_shuffles_few_rows_for_each_pair(spark):
    e = C.cut(halving(spark, 4000))
    pairs = C.reach(e).count()
    for build in (lambda: C.reach(e), lambda: C.plus(e), lambda: C.star(e)):
        assert shuffled(spark, build) < 6 * pairs
    assert shuffled(spark, lambda: C.ancestor_lists(e, "Thing")) < 7 * pairs


def test_coverage_stops_where_facts_are_decided(spark):
    e = C.cut(graph(spark, [(i, i + 1) for i in range(400)]))
    facts = C.cut(graph(spark, [(i, i + 2) for i in range(0, 300, 7)] + [(5, 6), (400, 3)]))
    got = {tuple(x) for x in V.dependency_coverage(facts, e).collect()}
    assert got == {(i, i + 2, "indirect") for i in range(0, 300, 7)} | {(400, 3, "uncovered")}
    assert shuffled(spark, lambda: V.dependency_coverage(facts, e)) < 10_000  # the closure has 80,200 pairs


def test_copies_of_long_intervals_grow_with_the_rows(spark):
    """A crowded cell is dealt out to a bounded number of parts, so a long interval's copies are no share of the cell."""
    rows = spark.range(8000).select(F.col("id").alias("k"), F.timestamp_seconds(F.col("id") * 21_600).alias("a"), F.timestamp_seconds(F.col("id") * 21_600 + F.when(F.col("id") % 40 == 0, 400_000_000).otherwise(90)).alias("b"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        n = shuffled(spark, lambda: W.overlaps(rows, "k", "a", "b", hot=8))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert n < 150_000  # 225,615 with a part for each eight rows


def test_imports_of_a_tree_take_few_tables(spark, monkeypatch):
    """Trees are trimmed whole, not coloured, and an edge against a declared one is refused before any search."""
    written, n = C.written, []
    monkeypatch.setattr(C, "written", lambda df: n.append(1) or written(df))
    e = [(i, i // 2) for i in range(2, 400)]
    up = dict(e)
    derived = {p for p in e if p[0] % 24 != 12} | {(a, up[b]) for a, b in e if b in up} | {(b, a) for a, b in e if a % 24 == 12}
    got = {tuple(r) for r in V.propose_imports(graph(spark, list(derived)), graph(spark, [p for p in e if p[0] % 3 == 0])).collect()}
    assert got == {(a, b, "add") for a, b in e if a % 3} | {(b, a, "conflict") for a, b in e if a % 24 == 12}
    assert len(n) <= 60, len(n)


def kept(own, links, multi, depth):
    """What is inherited: least depths of values by breadth-first search, of each value or of each predicate."""
    steps = depths({(a, b) for a, b in links if a != b})
    far = [(s, p, o, 0) for s, p, o in own] + [(a, p, o, k) for (a, b), k in steps.items() if k <= depth for s, p, o in own if s == b]
    key = lambda r: (r[0], r[1], r[2] if r[1] in multi else None)
    least = {}
    for r in far:
        least[key(r)] = min(r[3], least.get(key(r), depth))
    return {r for r in far if 0 < r[3] == least[key(r)]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_values_handed_on_in_random_graphs(spark, seed, monkeypatch):
    monkeypatch.setattr(I.handed_on, "__defaults__", (seed,))
    r = random.Random(seed)
    links = {(r.randrange(12), r.randrange(12)) for _ in range(16)} | {(k, k - 1) for k in range(20, 34)}
    own = {(r.choice([*range(12), *range(19, 34)]), r.choice(["name", "tag"]), r.choice(["x", "y", None])) for _ in range(9)} | {(19, "name", "end")}
    t = spark.createDataFrame([*own, *list(own)[:3]], "s long, p string, o string")
    for depth, multi in ((10, ["tag"]), (10, []), (3, ["tag"]), (1, ["tag"])):
        got = [tuple(x) for x in I.inherit(t, graph(spark, list(links)), multi, depth=depth).collect()]
        assert len(got) == len(set(got)) and set(got) == kept(own, links, multi, depth)
    assert I.inherit(t, graph(spark, [(1, 1)]), ["tag"]).isEmpty()


def test_inheritance_shuffles_few_rows_for_each_node(spark):
    """Values are handed on, not joined to the chains of all prototypes, of which a node has ten here."""
    links = C.cut(halving(spark, 8000))
    own = C.cut(spark.range(8000).where("id % 10 = 1").selectExpr("id AS s", "'name' AS p", "cast(id AS string) AS o"))
    n = shuffled(spark, lambda: I.inherit(own, links, []))
    assert n < 80_000, n


def test_refresh_walks_no_pairs(spark, monkeypatch):
    """Heirs of changed notes are found as nodes, and take what other notes hand on from what followed before."""
    monkeypatch.setattr(I.handed_on, "__defaults__", (200,))
    said = "array(named_struct('p', 'prototype', 'o', 'n' || (id div 2)), named_struct('p', 'tag', 'o', if({c} AND id % 5 = 1, 'new', if(id % 2 = 1, 'v' || id, NULL)))) AS said"
    files = lambda c: spark.range(1, 4000).selectExpr("'n' || id AS path", f"if({c} AND id % 5 = 1, 2L, 1L) AS mtime", "1L AS size", said.format(c=c))
    parse = lambda df: df.selectExpr("path", "path AS s", "inline(said)").where("o IS NOT NULL").selectExpr("path", "s", "p", "o")
    before, after = R.refresh(None, files("false"), parse, [])[2], []
    n = shuffled(spark, lambda: after.append(R.refresh(before, files("true"), parse, [])[2]) or after[0].inherited)
    assert sorted(after[0].inherited.collect()) == sorted(R.facts(files("true"), parse(files("true")), []).inherited.collect())
    assert n < 85_000, n

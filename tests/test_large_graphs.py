"""Graph operators and aggregates whose work must not grow with the square of a component or group."""

from __future__ import annotations

import random
import statistics

import pytest
from pyspark.sql import functions as F

from graphloom.operators import aggregates as A
from graphloom.operators import closure as C
from graphloom.operators import labels as L
from tests.test_semantics import closure_model, graph, rows


def components(pairs):
    """Strongly connected components by two searches."""
    out, into, nodes = {}, {}, {x for e in pairs for x in e}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
        into.setdefault(b, []).append(a)
    order, seen = [], set()
    for n in nodes:
        stack = [] if n in seen else [(n, iter(out.get(n, ())))]
        seen.add(n)
        while stack:
            m = next((m for m in stack[-1][1] if m not in seen), None)
            if m is None:
                order.append(stack.pop()[0])
            else:
                seen.add(m)
                stack.append((m, iter(out.get(m, ()))))
    found = {}
    for n in reversed(order):
        if n not in found:
            own, stack = [], [n]
            found[n] = n
            while stack:
                own.append(stack.pop())
                for m in into.get(own[-1], ()):
                    if m not in found:
                        found[m] = n
                        stack.append(m)
            low = min(own)
            found.update(dict.fromkeys(own, low))
    return found


@pytest.mark.parametrize("seed", [0, 2])
def test_components_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range((40, 70, 110)[seed])]
    assert dict(rows(C.scc(graph(spark, pairs)))) == components(pairs)


def test_ring_and_giant_component(spark):
    n = 100_000
    ring = spark.range(n).select(F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"))
    rng = random.Random(1)
    giant = [(n + rng.randrange(3000), n + rng.randrange(3000)) for _ in range(6000)]
    got = C.cut(C.scc(ring.unionByName(graph(spark, giant))))
    assert got.where(f"node < {n}").agg(F.count("*"), F.max("component")).first() == (n, 0)
    want = components(giant)
    assert dict(rows(got.where(f"node >= {n}"))) == want and max(list(want.values()).count(c) for c in set(want.values())) > 1000


def reduced(pairs):
    reach = closure_model(pairs)
    return {(a, b) for a, b in pairs if not any((a, c) in pairs and c != b and (c, b) in reach for c in {y for _, y in pairs})}


@pytest.mark.parametrize("rounds", [C.LEVEL_ROUNDS, 1])
def test_reduction_of_random_graphs(spark, rounds):
    rng = random.Random(3)
    for n, m in ((12, 30), (5, 0)):
        pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
        assert set(rows(C.reduction(graph(spark, list(pairs)), rounds))) == reduced(pairs)


def test_reduction_of_layers(spark):
    wide, deep = 4000, 12
    node = lambda layer, k: layer * wide + k % wide
    base = spark.range(wide * (deep - 1)).select(F.expr(f"id div {wide}").alias("l"), (F.col("id") % wide).alias("k"))
    on = base.select(node(F.col("l"), F.col("k")).alias("src"), F.explode(F.array(*[node(F.col("l") + 1, F.col("k") * 3 + j) for j in range(4)])).alias("dst"))
    skip = base.where(f"l < {deep - 2} AND k % 10 = 0").select(node(F.col("l"), F.col("k")).alias("src"), F.explode(F.array(node(F.col("l") + 2, F.col("k") * 9), node(F.col("l") + 2, F.col("k") * 9 + 2000))).alias("dst"))
    got = C.cut(C.reduction(on.unionByName(skip)))
    kept = got.where(F.expr(f"dst div {wide} - src div {wide}") == 2)
    assert got.count() - kept.count() == on.distinct().count() and kept.where("(dst - src * 9) % 4000 = 0").count() == 0 < kept.count()


def test_percentiles_equal_a_sort(spark):
    rng = random.Random(9)
    found = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randrange(5), rng.random() * 100])) for _ in range(400)] + [("none", None), ("one", 7.5)]
    found = [(g, None if v is None else float(v)) for g, v in found]
    df = spark.createDataFrame(found, "g string, v double")

    def want(values, p):
        values = sorted(values)
        at = p * (len(values) - 1) if values else 0
        low = int(at)
        return values[low] + (values[min(low + 1, len(values) - 1)] - values[low]) * (at - low) if values else 0.0

    got = {r["g"]: r for r in A.percentiles(df, ["g"], "v", {"m": 0.5, "high": 0.95, "low": 0.0, "top": 1.0}).collect()}
    assert set(got) == {"a", "b", None, "none", "one"}
    for g, r in got.items():
        own = [v for x, v in found if x == g and v is not None]
        assert r["m"] == pytest.approx(statistics.median(own) if own else 0)
        assert [r[c] for c in ("high", "low", "top")] == pytest.approx([want(own, p) for p in (0.95, 0.0, 1.0)])
    assert A.percentiles(df, [], "v", {"m": 0.5}).first()["m"] == pytest.approx(statistics.median(v for _, v in found if v is not None))
    assert A.percentiles(df.limit(0), [], "v", {"m": 0.5}).first()["m"] == 0


@pytest.mark.parametrize("seed", [0, 1])
def test_interval_labels_equal_the_closure(spark, seed):
    rng = random.Random(seed)
    pairs = {(b, a) for a, b in (sorted(rng.sample(range(18), 2)) for _ in range((17, 34)[seed]))}
    closure = closure_model(pairs)
    labels = L.labelled(graph(spark, [*pairs, (99, 99)]))
    nodes = spark.createDataFrame([(k,) for k in (0, 3, 7, 12, 17, 500)], "node long")
    assert set(rows(L.above(labels, nodes))) == {(a, b) for a, b in closure if a in (0, 3, 7, 12, 17)}
    assert set(rows(L.below(labels, nodes))) == {(a, b) for a, b in closure if b in (0, 3, 7, 12, 17)}
    assert labels.nodes.count() == len({x for e in pairs for x in e} | {99})


def test_labels_of_a_tree_are_a_row_a_node(spark):
    n = 20_000
    tree = spark.range(1, n).select(F.col("id").alias("src"), F.when(F.col("id") % 3 == 0, 0).otherwise(F.expr("id div 2")).alias("dst"))
    labels = L.labelled(tree)
    assert labels.nodes.agg(F.count("*"), F.countDistinct("pre"), F.max("last")).first() == (n, n, n - 1) and labels.exceptions.isEmpty()
    got = L.below(labels, spark.createDataFrame([(0,), (5,)], "node long")).groupBy("dst").count()
    up = [0] * n
    for k in range(n - 1, 0, -1):
        up[0 if k % 3 == 0 else k // 2] += up[k] + 1
    assert dict(rows(got)) == {0: n - 1, 5: up[5]}


def test_labels_refuse_cycles(spark):
    with pytest.raises(ValueError, match="cycle"):
        L.labelled(graph(spark, [(1, 2), (2, 3), (3, 1), (4, 1)]))

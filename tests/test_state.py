"""Stateful streams over several batches, bucketed tables, and inferences kept up to date, against plain models."""

from __future__ import annotations

import os
import random
import time
import uuid
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from graphloom.operators import refresh as R
from graphloom.operators.closure import shared_root
from graphloom.streaming import jobs as J
from graphloom.streaming import state as K
from tests.test_semantics import closure_model, rows


def folder(spark):
    return f"{shared_root(spark)}/test-{uuid.uuid4().hex}"


def put(spark, path, found, ddl):
    spark.createDataFrame(found, ddl).coalesce(1).write.mode("append").parquet(path)
    time.sleep(0.02)  # files come in the order of their times


def test_illegal_moves_over_batches_with_late_rows_and_restarts(spark):
    allowed, hour = [("a", "b"), ("b", "c")], 3600
    rng = random.Random(2)
    made = [(k, hour * (10 * n + rng.randrange(9)), 1000 * k + n, rng.choice("abc")) for k in range(4) for n in range(12)]
    made += [(9, hour * 3, 1, "a"), (9, hour * 5, 2, "c"), (9, hour * 90, 3, "a"), (None, hour, 7, "a"), (5, hour * 4, 8, None)]
    made.sort(key=lambda r: r[1])
    for k in range(0, len(made) - 1, 2):  # neighbours in time change places: out of order, but not late
        made[k], made[k + 1] = made[k + 1], made[k]
    batches = [made[:15], made[15:31], [*made[31:], (0, hour, 99_999, "a"), (77, hour * 400, 5, "a")]]  # one far too late, and one that ends it
    at = folder(spark)
    for part in batches:
        put(spark, f"{at}/in", [(k, t, i, s) for k, t, i, s in part], "k long, t long, id long, s string")
        stream = spark.readStream.schema("k long, t long, id long, s string").parquet(f"{at}/in").withColumn("ts", F.timestamp_seconds("t"))
        moves = K.illegal_moves(stream, "k", "ts", "id", "s", allowed, "30 hours", 50 * hour * 1000)
        J.run(moves, f"{at}/state", path=f"{at}/out")  # every round is a restart from the checkpoint
    got = rows(spark.read.schema(moves.schema).parquet(f"{at}/out").select("k", F.unix_timestamp("ts"), "id", "source", "target"))
    want = []
    for k in {r[0] for r in made if r[0] is not None}:
        own = sorted((t, i, s) for x, t, i, s in made if x == k and s is not None)
        for (t0, _, a), (t, i, b) in zip(own, own[1:], strict=False):
            if t - t0 <= 50 * hour and a != b and (a, b) not in allowed:
                want.append((k, t, i, a, b))
    assert got == sorted(want, key=repr) and len(got) > 10 and all(r[0] != 9 or r[2] == 2 for r in got)
    left = spark.read.format("statestore").option("stateVarName", "last").load(f"{at}/state")
    assert {r[0] for r in left.select("key.key").collect()} <= {77}  # expired states are gone


def test_edges_wait_for_their_nodes(spark):
    rng = random.Random(4)
    names = [f"n{k}" for k in range(12)]
    edges = [(rng.choice([*names, "x", "y"]), rng.choice([*names, "x"]), f"e{k}") for k in range(80)] + [("n0", "n0", "loop"), ("n1", "n2", "same"), ("n1", "n2", "same"), (None, "n1", "no"), ("n1", None, "none")]
    rng.shuffle(edges)
    at, sent = folder(spark), []
    for k in range(3):
        put(spark, f"{at}/edges", edges[k::3], "src string, dst string, edge string")
        put(spark, f"{at}/nodes", [(n,) for n in names[(2 - k) * 4 : (3 - k) * 4]] + [(names[-1],)], "id string")
        streams = (spark.readStream.schema(s).parquet(f"{at}/{n}") for n, s in (("edges", "src string, dst string, edge string"), ("nodes", "id string")))
        J.run(K.waiting_edges(*streams, salts=3), f"{at}/state", path=f"{at}/out")
        sent.append(rows(spark.read.schema("src string, dst string, edge string").parquet(f"{at}/out")))
        come, known = [e for part in range(k + 1) for e in edges[part::3]], {*names[(2 - k) * 4 :]}
        assert sent[-1] == sorted((e for e in come if e[0] in known | {names[-1]} and e[1] in known | {names[-1]}), key=repr)
    open_ends = [(s, d, e, s if s not in names else d) for s, d, e in edges if s and d and (s not in names or d not in names)]
    assert rows(K.unresolved(spark, f"{at}/state")) == sorted(open_ends, key=repr)


def test_edges_wait_without_python_unless_they_are_forgotten(spark):
    at, sent = folder(spark), {}
    edges = [[("a", "b", "1"), ("b", "x", "2"), ("c", "a", "3")], [("a", "b", "1"), ("a", "a", "4"), ("y", "a", "5")]]
    for k, ids in enumerate((["a", "a"], ["a", "b", "c", "c"])):
        put(spark, f"{at}/edges", edges[k], "src string, dst string, edge string")
        put(spark, f"{at}/nodes", [(n,) for n in ids], "id string")
        for forget in (False, True):
            streams = (spark.readStream.schema(s).parquet(f"{at}/{n}") for n, s in (("edges", "src string, dst string, edge string"), ("nodes", "id string")))
            waiting = K.waiting_edges(*streams, salts=2, forget=forget)
            assert ("TransformWithState" in waiting._jdf.queryExecution().analyzed().toString()) == forget
            J.run(waiting, f"{at}/state-{forget}", path=f"{at}/out-{forget}")
            sent[forget] = rows(spark.read.schema("src string, dst string, edge string").parquet(f"{at}/out-{forget}"))
        assert sent[False] == sent[True] == ([], [("a", "a", "4"), ("a", "b", "1"), ("a", "b", "1"), ("c", "a", "3")])[k]
    for forget in (False, True):
        assert rows(K.unresolved(spark, f"{at}/state-{forget}")) == [("b", "x", "2", "x"), ("y", "a", "5", "y")]


def test_moves_and_edges_call_their_state_by_batches():
    """Each call of the state is a round trip; there must be a few for a key, not some for each row."""
    calls = Counter()

    class State:
        def __getattr__(self, name):
            def call(*_):
                calls[name] += 1
                return iter(()) if name == "get" else False if name == "exists" else self
            return call

    moves = K.Moves([], 1000)
    moves.init(State())
    list(moves.handleInputRows(("k",), iter([pd.DataFrame({"at": range(10, 500_000, 100), "id": range(10, 500_000, 100), "state": "a"})]), None))
    assert calls["updateValue"] == 0 and calls["appendValue"] == calls["registerTimer"] == 1
    calls.clear()
    edges = K.Waiting()
    edges.init(State())
    list(edges.handleInputRows(("n", 0), iter([{"src": "n", "dst": "m", "edge": str(k)} for k in range(1000)]), None))
    assert sum(calls.values()) - calls["getValueState"] - calls["getListState"] <= 2 and calls["appendList"] == 1


def test_batches_rewrite_their_buckets_only(spark):
    at = folder(spark)
    table = J.Bucketed(spark, at, "k long, v string", "k", buckets=16)
    files = lambda: {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, ns in os.walk(at.removeprefix("file://") + "/table") for n in ns if n.endswith(".parquet")}
    model = {}

    def batch(number, found):
        table.replace(spark.createDataFrame(found, "k long, v string"), number)
        for k in {k for k, _ in found}:
            model[k] = [v for x, v in found if x == k]
        assert rows(table.read()) == sorted(((k, v) for k, vs in model.items() for v in vs), key=repr)

    batch(0, [(k, "old") for k in range(100)])
    before = files()
    batch(1, [(3, "new"), (3, "newer"), (200, "x")])
    after = files()
    buckets = {r[0] for r in spark.createDataFrame([(3,), (200,)], "k long").select(table.bucket()).collect()}
    assert {f for f in before if f not in after} and all(any(f"_bucket={b}/" in f for b in buckets) for f in set(before) ^ set(after))
    batch(1, [(3, "new"), (3, "newer"), (200, "x")])
    assert files() == after  # a batch that was done changes nothing
    table.replace(spark.createDataFrame([(5, "kept")], "k long, v string"), 2, keys=spark.createDataFrame([(k,) for k in range(100)], "k long"))
    assert rows(table.read()) == [(200, "x"), (5, "kept")]
    assert sorted(os.listdir(at.removeprefix("file://"))) == ["done-2", "table"]


def test_a_batch_that_broke_off_goes_on(spark):
    table = J.Bucketed(spark, folder(spark), "k long, v string", "k", buckets=4)
    table.replace(spark.createDataFrame([(k, "old") for k in range(20)], "k long, v string"), 0)
    new, remove = spark.createDataFrame([(1, "new")], "k long, v string"), table._remove

    def breaks(name):
        raise RuntimeError(name)

    table._remove = breaks  # after the overwrite, before its end is known
    table.fs.delete(table.path(f"{table.folder}/done-0"), True)
    try:
        table.replace(new, 1)
    except RuntimeError:
        pass
    table._remove = remove
    table._remove("done-1")
    table._remove("table")  # as if the overwrite had been cut off, too
    table.replace(new, 1)
    bucket = spark.createDataFrame([(k,) for k in range(20)], "k long").withColumn("b", table.bucket())
    same = {r["k"] for r in bucket.join(bucket.where("k = 1").select("b"), "b").collect()}
    assert rows(table.read()) == sorted(((k, "new" if k == 1 else "old") for k in same), key=repr)


def test_closure_is_maintained(spark):
    rng = random.Random(7)
    edges = {(rng.randrange(9), rng.randrange(9)) for _ in range(14)}
    df = lambda e: spark.createDataFrame(list(e), "src long, dst long")
    closure = df(closure_model(edges))
    for _ in range(3):
        removed = set(rng.sample(sorted(edges), 4))
        added = {(rng.randrange(9), rng.randrange(9)) for _ in range(3)} - edges
        edges = edges - removed | added
        closure = R.maintained_closure(closure, df(edges), df(removed), df(added))
        assert rows(closure) == rows(df(closure_model(edges)))


def test_refresh_equals_rebuild(spark):
    rng = random.Random(11)

    def note(k):
        said = [("rdf:type", f"c{rng.randrange(6)}")] * (rng.random() < 0.8) + [("prototype", f"n{rng.randrange(14)}")] * (rng.random() < 0.6)
        return said + [(rng.choice(["p", "q", "tag"]), f"v{rng.randrange(5)}") for _ in range(rng.randrange(3))]

    files = {f"n{k}": (1, note(k)) for k in range(14)} | {f"c{k}": (1, [("rdfs:subClassOf", f"c{rng.randrange(6)}")]) for k in range(6)}
    read = []

    def listing():
        return spark.createDataFrame([(p, m, 1, [list(x) for x in said]) for p, (m, said) in files.items()], "path string, mtime long, size long, said array<array<string>>")

    def parse(df):
        read.append({r["path"] for r in df.select("path").collect()})
        return df.select("path", F.explode("said").alias("x")).select("path", F.col("path").alias("s"), F.col("x")[0].alias("p"), F.col("x")[1].alias("o"))

    verdict, _, now = R.refresh(None, listing(), parse, ["tag"])
    assert verdict == "rebuild" and R.refresh(now, listing(), parse, ["tag"])[0] == "hit"
    for step in range(2, 4):
        changed = set(rng.sample([f"n{k}" for k in range(14)], 2)) | {f"c{rng.randrange(6)}"}
        referrers = {p for p, (_, said) in files.items() if any(o in changed for _, o in said)}
        for p in changed:
            files[p] = (step, [("rdfs:subClassOf", f"c{rng.randrange(6)}")] if p[0] == "c" else note(p))
        verdict, paths, now = R.refresh(now, listing(), parse, ["tag"])
        assert verdict == "delta" and read[-1] == changed | referrers == {r["path"] for r in paths.collect()}
        full = R.facts(listing(), parse(listing()), ["tag"])
        for name in ("manifest", "rows", "closure", "types", "inherited"):
            assert rows(getattr(now, name)) == rows(getattr(full, name)), name
    del files["n0"]
    assert R.refresh(now, listing(), parse, ["tag"])[0] == "rebuild"

"""Property paths and graph analytics over ``edges(src, dst)``.

``plus`` doubles its paths, keeps the nearest depth of each pair and needs log n rounds; from
given starts it steps from node to node.  It runs until nothing new is found, whatever the
length of the paths; only ``depth``, where a caller gives it, bounds them.  Each round's new
pairs are written once to the shared folder; the driver sees one count per round.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a session on one machine gets a temporary folder; on a cluster, whose
    executors would not see one, that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[[^\]]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame) -> str:
    """``df`` as a table in the session's shared folder: its path."""
    path = f"{shared_root(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` written and read again, which ends its lineage."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df))


#: Most rows of a side that is marked for broadcast, after a count.
BROADCAST_ROWS = 200_000


def small(df: DataFrame) -> DataFrame:
    """``df`` as a table, marked for broadcast if its count allows it."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def pairs(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def seq(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a/b``: a set of end nodes."""
    left = a.select("src", F.col("dst").alias("_m"))
    return left.join(b.select(F.col("src").alias("_m"), "dst"), "_m").select("src", "dst").distinct()


def alt(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("src", "dst")
    for p in parts[1:]:
        out = out.unionByName(p.select("src", "dst"))
    return out.distinct()


def inverse(a: DataFrame) -> DataFrame:
    return a.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def identity(edges: DataFrame) -> DataFrame:
    """Zero steps, from every subject and object."""
    return edges.select(F.explode(F.array("src", "dst")).alias("src")).where("src IS NOT NULL").distinct().select("src", F.col("src").alias("dst"))


def maybe(edges: DataFrame) -> DataFrame:
    """``a?``"""
    return alt(identity(edges), edges)


def doublings(edges: DataFrame, depth: int | None = None) -> Iterator[tuple[DataFrame, DataFrame, int]]:
    """``(found, new, k)`` for k = 1, 2, 4 and so on: all pairs that are at most ``k`` steps apart, those of them that
    this round found, both as ``(src, dst, depth)`` with the nearest depth, and ``k``.

    A shortest path of more than ``k`` and at most ``2 k`` steps has one node that is ``k`` steps
    from its source; so only pairs exactly ``k`` apart are led on, by all that was found, and a pair
    comes up once for each such node, not once for each way to part its path.
    """
    spark = edges.sparkSession
    first = pairs(edges).withColumn("depth", F.lit(1))
    schema = first.schema
    paths, k = [written(first)], 1
    while True:
        found, new = spark.read.schema(schema).parquet(*paths), spark.read.schema(schema).parquet(paths[-1])
        yield found, new, k
        if depth is not None and k >= depth:
            return
        front = new.where(F.col("depth") == k).select("src", F.col("dst").alias("_m"))
        middle = cut(front.select("_m").distinct())
        n = middle.count()
        if not n:
            return
        on = found.select(F.col("src").alias("_m"), "dst", F.col("depth").alias("_more"))
        if depth is not None:
            on = on.where(F.col("_more") <= depth - k)
        if n <= BROADCAST_ROWS:
            on = on.join(F.broadcast(middle), "_m", "left_semi")
        longer = front.join(on, "_m").groupBy("src", "dst").agg((F.min("_more") + k).alias("depth"))
        paths.append(written(longer.join(found.select("src", "dst"), ["src", "dst"], "left_anti")))
        k *= 2


def plus(edges: DataFrame, start: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """``a+``: ``(src, dst, depth)``, the nearest depth of each pair; cycles end.

    ``start`` (column ``src``) binds where paths begin, which are then walked step by step;
    ``depth`` bounds their length.
    """
    if start is None:
        for found, _, _ in doublings(edges, depth):
            pass
        return found
    spark = edges.sparkSession
    step = cut(pairs(edges))
    frontier = step.join(start.select("src").distinct(), "src", "left_semi").withColumn("depth", F.lit(1))
    schema = frontier.schema
    paths = [written(frontier)]
    found = frontier = spark.read.schema(schema).parquet(*paths)
    k = 1
    while depth is None or k < depth:
        k += 1
        reached = frontier.select("src", F.col("dst").alias("_m")).join(step.select(F.col("src").alias("_m"), "dst"), "_m").select("src", "dst").distinct()
        path = written(reached.join(found.select("src", "dst"), ["src", "dst"], "left_anti").withColumn("depth", F.lit(k)))
        frontier = spark.read.schema(schema).parquet(path)
        if not frontier.take(1):
            break
        paths.append(path)
        found = spark.read.schema(schema).parquet(*paths)
    return found


def reach(edges: DataFrame) -> DataFrame:
    """``a+`` as ``(src, dst)``."""
    return plus(edges).select("src", "dst")


def covered(wanted: DataFrame, edges: DataFrame) -> DataFrame:
    """Those of the pairs ``wanted`` that the closure of ``edges`` has.

    It is built no further than the pairs still open need: one whose source has no path as long
    as the round's will not come up.
    """
    key = ["src", "dst"]
    hits, left = [], cut(pairs(wanted))
    for _, new, k in doublings(edges):
        hits.append(cut(left.join(new, key, "left_semi")))
        left = cut(left.join(new, key, "left_anti").join(new.where(F.col("depth") == k), "src", "left_semi"))
        if left.isEmpty():
            break
    return reduce(DataFrame.unionByName, hits)


def star(edges: DataFrame) -> DataFrame:
    """``a*``: ``a+`` and zero steps, from nodes that do not lead back to themselves."""
    more = reach(edges)
    return more.unionByName(identity(edges).join(more.where("src = dst"), ["src", "dst"], "left_anti"))


# --- analytics -----------------------------------------------------------------------------------


def least_source(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``node, label``: the least label of all nodes from which a node is reached, its own among them.

    ``labels`` has ``node, label``, a label being a struct whose field ``node`` names whose it
    is.  Each round takes the labels of direct predecessors, then jumps: what reaches the node
    that a label names reaches its bearers as well.  So labels cross chains and rings in a
    logarithmic number of rounds, and a round handles a row for each node and edge.
    """
    now = cut(labels.withColumn("moved", F.lit(True)))
    while True:
        sent = edges.join(now.where("moved").select(F.col("node").alias("src"), "label"), "src").select(F.col("dst").alias("node"), "label")
        offers = sent.groupBy("node").agg(F.min("label").alias("offer"))
        near = now.join(offers, "node", "left").select("node", "label", F.least("label", F.coalesce("offer", "label")).alias("near"))
        far = near.select(F.col("node").alias("_of"), F.col("near").alias("_far"))
        jumped = near.join(far, F.col("near.node") == F.col("_of"), "left").withColumn("far", F.least("near", F.coalesce("_far", "near")))
        now = cut(jumped.select("node", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("node", "label")


def scc(edges: DataFrame) -> DataFrame:
    """``(node, component)``: strongly connected components; the least member names one.

    Rounds of trimming and colouring: nodes without an edge in or out are alone, and so are those
    that then have none, as long as a pass takes a tenth of the edges; every other node gets the least of random labels that reaches it and, among the nodes of that colour, the
    least that it reaches.  Where both are one node's, that node's component is found; edges
    between nodes whose labels differ are on no cycle and go.  With new labels each round the
    classes shrink as in quicksort, so the rounds are few, and none makes more rows than edges.
    """
    live, found, k = cut(pairs(edges).where("src <> dst")), [], 0
    left = live.count()
    while left:
        k += 1
        before = 2 * left
        while 0 < left <= 0.9 * before:
            kept = live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
            live = cut(kept.join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
            before, left = left, live.count()
        if not left:
            break
        nodes = live.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
        labels = cut(nodes.select("node", F.struct(F.xxhash64(F.lit(k), "node").alias("rank"), "node").alias("label")))
        coloured = cut(least_source(live, labels))
        src, dst = (coloured.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")) for c in ("src", "dst"))
        within = cut(live.join(src, "src").join(dst, "dst").where("_src = _dst").select("src", "dst"))
        back = least_source(inverse(within), labels)
        both = cut(coloured.join(back.withColumnRenamed("label", "out"), "node"))
        found.append(cut(both.where("label = out").select("node", F.col("label.node").alias("root"))))
        rest = both.where("label <> out").select("node", F.struct("label", "out").alias("c"))
        src, dst = (rest.select(F.col("node").alias(c), F.col("c").alias(f"_{c}")) for c in ("src", "dst"))
        live = cut(within.join(src, "src").join(dst, "dst").where("_src = _dst").select("src", "dst"))
        left = live.count()
    every = identity(edges).select(F.col("src").alias("node"))
    if not found:
        return every.select("node", F.col("node").alias("component"))
    roots = cut(reduce(DataFrame.unionByName, found))
    least = roots.groupBy("root").agg(F.min("node").alias("component"))
    return every.join(roots.join(least, "root").select("node", "component"), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def condense(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges between components, without loops."""
    a, b = members.select(F.col("node").alias("src"), F.col("component").alias("a")), members.select(F.col("node").alias("dst"), F.col("component").alias("b"))
    return edges.join(a, "src").join(b, "dst").where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


def levels(edges: DataFrame, rounds: int) -> DataFrame:
    """``node, level``: the longest path that ends in a node of an acyclic graph, for nodes with one shorter than ``rounds``.

    Edges of nodes without an edge in are taken away, round by round: an end's level is one more
    than the last round that has an edge to it.  What is left has no row.
    """
    live, k = cut(edges.select("src", "dst")), 0
    left = live.count()
    nodes = [live.select(F.col("src").alias("node"), F.lit(0).alias("level"))]
    while k < rounds and left:
        after = cut(live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
        before, left = left, after.count()
        if left == before:
            break
        k += 1
        nodes.append(live.select(F.col("dst").alias("node"), F.lit(k).alias("level")))
        live = after
    found = reduce(DataFrame.unionByName, nodes).groupBy("node").agg(F.max("level").alias("level"))
    return cut(found.join(live.select(F.explode(F.array("src", "dst")).alias("node")).distinct(), "node", "left_anti"))


#: Rounds of ``levels`` in a reduction; nodes beyond have no level, and the search is not pruned there.
LEVEL_ROUNDS = 40


def reduction(edges: DataFrame, level_rounds: int = LEVEL_ROUNDS) -> DataFrame:
    """Transitive reduction of an acyclic graph: an edge goes if another successor of its source reaches its end.

    Only an edge whose source has another successor, whose end has another predecessor, and
    which skips a level (longest paths) can go.  From the sources of such edges the graph is
    walked forward, not beyond the level of the farthest end in question; a source whose edges
    are all decided walks on no more.  The closure is never built.
    """
    e = cut(pairs(edges).where("src <> dst"))
    fork = e.groupBy("src").agg(F.count("*").alias("n")).where("n > 1").select("src")
    meet = e.groupBy("dst").agg(F.count("*").alias("n")).where("n > 1").select("dst")
    open_edges = cut(e.join(fork, "src", "left_semi").join(meet, "dst", "left_semi").select("src", "dst"))
    if open_edges.isEmpty():
        return e
    level = levels(e, level_rounds)
    below = lambda c: level.select(F.col("node").alias(c), F.col("level").alias(f"_{c}"))
    step = cut(e.join(below("dst"), "dst", "left").select(F.col("src").alias("_m"), "dst", "_dst"))
    spans = open_edges.join(below("src"), "src", "left").join(below("dst"), "dst", "left")
    open_edges = cut(spans.where("_src IS NULL OR _dst IS NULL OR _dst > _src + 1").select("src", "dst", "_dst"))
    gone = []
    seen = front = cut(e.join(open_edges.select("src"), "src", "left_semi"))
    while not open_edges.isEmpty() and not front.isEmpty():
        far = open_edges.groupBy("src").agg(F.max(F.coalesce("_dst", F.lit(1 << 30))).alias("_far"))
        on = front.join(far, "src").withColumnRenamed("dst", "_m").join(step, "_m").where("_dst IS NULL OR _dst <= _far").select("src", "dst").distinct()
        reached = cut(on)
        hit = cut(reached.join(open_edges, ["src", "dst"], "left_semi"))
        gone.append(hit)
        open_edges = cut(open_edges.join(hit, ["src", "dst"], "left_anti"))
        front = cut(reached.join(seen, ["src", "dst"], "left_anti"))
        seen = cut(seen.unionByName(front).join(open_edges.select("src"), "src", "left_semi"))
    return e.join(reduce(DataFrame.unionByName, gone), ["src", "dst"], "left_anti") if gone else e


def typed_edges(triples: DataFrame, nodes: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``src, dst, p, kind`` of the references among ``nodes`` (column ``node``), without loops.

    ``kinds`` names the kind of a predicate (hierarchy, prototype, semantic); any other
    reference is a forward-link, and a backlink from its target as well.
    """
    e = triples.where("o_kind = 'iri' AND p <> 'rdf:type' AND s <> o").select(F.col("s").alias("src"), F.col("o").alias("dst"), "p").distinct()
    e = e.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    named = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv]) if kinds else F.create_map().cast("map<string,string>")
    e = e.select("src", "dst", "p", F.coalesce(F.element_at(named, F.col("p")), F.lit("forward-link")).alias("kind"))
    back = e.where("kind = 'forward-link'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), "p", F.lit("backlink").alias("kind"))
    return e.unionByName(back)


def degree_profile(edges: DataFrame, types: DataFrame) -> DataFrame:
    """``by, value, n``: edges by ``kind``, and their ends by ``cls`` (``types`` has ``node, cls``)."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    of_class = ends.join(types, "node").groupBy(F.col("cls").alias("value")).agg(F.sum("n").alias("n"))
    of_kind = edges.groupBy(F.col("kind").alias("value")).agg(F.count("*").alias("n"))
    return of_kind.select(F.lit("kind").alias("by"), "value", "n").unionByName(of_class.select(F.lit("class").alias("by"), "value", "n"))


def degrees(edges: DataFrame) -> DataFrame:
    """``node, in_degree, out_degree, weight`` (both together)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.select("x.*").groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("weight"))


def clone_subtree(edges: DataFrame, root: DataFrame, labels: DataFrame, run: str, values: dict[str, str], suffix: str) -> DataFrame:
    """``node, origin, parent, cls, label``: copies of all that is below ``root`` (column ``node``), itself included.

    ``edges`` go from child to parent; ``labels`` has ``node, cls, label``.  New ids are hashes of the
    old ones and ``run``; inner edges point to the copies; ``suffix`` goes from the end of the
    class; ``{{key}}`` in a label is filled from ``values``, an unknown key stays.
    """
    below = plus(inverse(edges), start=root.select(F.col("node").alias("src"))).select(F.col("dst").alias("node"))
    nodes = cut(below.unionByName(root.select("node")).distinct())
    inner = pairs(edges).join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    new = lambda c: F.md5(F.concat_ws("/", F.lit(run), F.col(c).cast("string")))
    label = F.col("label")
    for key, value in values.items():
        label = F.replace(label, F.lit("{{" + key + "}}"), F.lit(value))
    cls = F.regexp_replace("cls", re.escape(suffix) + "$", "")
    out = nodes.join(inner, nodes.node == inner.src, "left").join(labels.withColumnRenamed("node", "_n"), nodes.node == F.col("_n"), "left")
    return out.select(new("node").alias("node"), F.col("node").alias("origin"), F.when(F.col("dst").isNotNull(), new("dst")).alias("parent"), cls.alias("cls"), label.alias("label"))


def ancestor_lists(edges: DataFrame, root: str) -> DataFrame:
    """``src, ancestors``: each class's ancestors, the nearest first, joined by ``>``; ``root`` ends every list, and is all
    of one without superclasses.  A list is as long as the class tree is deep."""
    up = plus(edges)
    near = F.transform(F.array_sort(F.collect_list(F.struct("depth", "dst"))), lambda x: x["dst"].cast("string"))
    lists = up.groupBy("src").agg(near.alias("near"))
    classes = identity(edges).select("src")
    return classes.join(lists, "src", "left").select("src", F.array_join(F.array_append(F.coalesce("near", F.array().cast("array<string>")), F.lit(root)), ">").alias("ancestors"))


def backlinks(references: DataFrame, body_links: DataFrame) -> DataFrame:
    """``target, src, p, body``: who refers to each target by which property; a link (``src, dst``) in a text that no
    property repeats is marked ``body``."""
    links = pairs(body_links).join(pairs(references), ["src", "dst"], "left_anti")
    own = references.select(F.col("dst").alias("target"), "src", "p", F.lit(False).alias("body")).distinct()
    return own.unionByName(links.select(F.col("dst").alias("target"), "src", F.lit(None).cast("string").alias("p"), F.lit(True).alias("body")))


def khop(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """``src, dst, depth``: nodes connected in either direction, up to ``depth`` steps."""
    return plus(alt(edges, inverse(edges)), start, depth).where("src <> dst")


def tree(edges: DataFrame, roots: DataFrame, label: DataFrame, depth: int | None = None) -> DataFrame:
    """``node, depth, path``: children under their parents (``src`` is the child), ``path`` orders by label; cycles end."""
    names = cut(label.select("node", "label"))
    level = cut(roots.select("node").join(names, "node").select("node", F.lit(0).alias("depth"), F.col("label").alias("path"), F.array("node").alias("seen")))
    out = level
    children = edges.select(F.col("dst").alias("node"), F.col("src").alias("child"))
    k = 0
    while depth is None or k < depth:
        k += 1
        step = level.join(children, "node").where(~F.array_contains("seen", F.col("child")))
        step = step.select(F.col("child").alias("node"), "path", "seen").join(names, "node")
        level = cut(step.select("node", F.lit(k).alias("depth"), F.concat_ws(" / ", "path", "label").alias("path"), F.array_append("seen", F.col("node")).alias("seen")))
        if not level.take(1):
            break
        out = out.unionByName(level)
    return out.select("node", "depth", "path")

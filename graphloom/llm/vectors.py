"""Embedding near-duplicates by a robust-pruned flat graph.

1. Equal vectors of one label become one node that remembers how many they are.
2. Each label has centroids, fitted on a bounded sample (``SAMPLE`` vectors, by hash); cells
   with more than ``SPREAD`` times the nodes aimed at are split again, by centroids of their
   own, until they are small or no split helps.  A node's home is its cell.
3. Overlapping shards: a node is built into the shard of its home and of the cell that is
   next nearest.  What a cell holds beyond one shard (a tight group that no centroid parts)
   is dealt by hash into blocks, each a shard.  Each shard gives every node a robust-pruned
   list of neighbours; the lists that a node has from its shards are united.
4. A node also visits each later cell that can hold a link of it.  The members of cell ``j``
   lie on the side of ``c_j`` of the plane between ``c_j`` and the node's own centroid
   ``c_h``, so none is within the angle of the threshold if ``x.c_h - x.c_j`` exceeds
   ``sin(angle) * |c_h - c_j|``.  No other cell is left out, so no link is.
5. A task searches the graph of one block: from its medoid, greedily, then from every node
   in range to its neighbours, for its own nodes or for a block of others.  Every unordered
   pair of nodes meets in one task at most: in their common home, or in the later home of
   the two.  Tasks give counts and the local component of each node, never pairs.
6. Every search is audited: one in ``AUDIT`` of its queries, one at least, is compared with
   all nodes of the block.  Where the search has found less than ``ENOUGH`` of their links,
   the task compares all pairs instead.  Cosines are verified in double precision.

The search saves work, it is no bound of the answer: inside a tight group, where all nodes
link, the links themselves are quadratic in its distinct vectors.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components,
and vectors with a null label, link with nothing; so do vectors of different lengths;
components of any finite size count (vectors are scaled before they are squared); rows
that repeat a ``vec_id`` with the same vector count as copies; a null ``vec_id`` links with
nothing (component null, kept); equal cosines at the threshold link; an empty table gives
an empty table; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import components, n_partitions, small_side, staged
from graphloom.llm.language import sample_by_hash

#: Rows of the sample; nodes of a cell that are aimed at; nodes of a block; from how many times as many a cell is split again.
SAMPLE, CELL_NODES, BLOCK_NODES, SPREAD = 20_000, 1_024, 1_024, 2
#: One query in so many is audited; the share of its links that a search must find.
AUDIT, ENOUGH = 16, 0.98
DEGREE, CANDIDATES, ALPHA, BEAM = 24, 64, 1.2, 32
#: Nodes of which one matrix of similarities is made; the least cosine of two centroids of a group that is not split.
PART_NODES, TIGHT = 2_048, 0.98


# --- graph of one part ---------------------------------------------------------------------------


def prune(sim: np.ndarray, degree: int = DEGREE, candidates: int = CANDIDATES, alpha: float = ALPHA) -> list[np.ndarray]:
    """Robust-pruned neighbours of each node, from the similarities of all; edges go both ways."""
    n = len(sim)
    if n < 2:
        return [np.zeros(0, np.int64)] * n
    c = min(n - 1, candidates)
    near = sim.copy()
    np.fill_diagonal(near, -np.inf)
    near = np.argpartition(-near, c - 1, axis=1)[:, :c]
    far = np.random.default_rng(n).integers(0, n, (n, 8))  # a few nodes anywhere: the long edges
    pool = np.concatenate((near, far), axis=1)
    rows = np.arange(n)
    left = pool != rows[:, None]
    distance = np.sqrt(np.maximum(2 - 2 * sim, 0))
    own = np.where(left, np.take_along_axis(distance, pool, 1), np.inf)
    edges = []
    for _ in range(degree):
        pick = np.argmin(np.where(left, own, np.inf), axis=1)
        live = left[rows, pick]
        if not live.any():
            break
        chosen = pool[rows, pick]
        edges.append(np.column_stack((rows[live], chosen[live])))
        left &= ~(alpha * distance[chosen[:, None], pool] <= own) & (pool != chosen[:, None])
    e = np.concatenate(edges)
    out = np.unique(e[:, 0] * n + e[:, 1])
    back = np.setdiff1d(e[:, 1] * n + e[:, 0], out)
    a, b = np.divmod(np.concatenate((out, back)), n)
    # a node keeps its own edges and, up to twice the degree, the nearest of those that come back
    order = np.lexsort((distance[a, b], np.arange(len(a)) >= len(out), a))
    a, b = a[order], b[order]
    first = np.searchsorted(a, np.arange(n))
    keep = np.arange(len(a)) - first[a] < 2 * degree
    a, b = a[keep], b[keep]
    return np.split(b, np.searchsorted(a, np.arange(1, n)))


def medoid(vectors: np.ndarray) -> int:
    return int(np.argmax(vectors @ vectors.mean(axis=0)))


def in_range(
    queries: np.ndarray, vectors: np.ndarray, neighbours: list[np.ndarray], least: float, own: np.ndarray | None = None, beam: int = BEAM
) -> np.ndarray:
    """Pairs ``(query, node)`` with a cosine of ``least`` or more that the graph search finds.

    ``own`` is the node that a query is itself, or -1; the spread starts there too.
    """
    m, n = len(queries), len(vectors)
    width = max(max((len(x) for x in neighbours), default=0), 1)
    table = np.full((n, width), -1, np.int64)
    for i, x in enumerate(neighbours):
        table[i, : len(x)] = x
    seen, within = np.zeros((m, n), bool), np.zeros((m, n), bool)
    rows, start, beam = np.arange(m), medoid(vectors), min(beam, n)
    ids = np.full((m, beam), -1, np.int64)
    sims = np.full((m, beam), -np.inf)
    done = np.ones((m, beam), bool)
    ids[:, 0], sims[:, 0], done[:, 0], seen[:, start] = start, queries @ vectors[start], False, True
    within[:, start] = sims[:, 0] >= least
    live = rows
    while len(live):  # the best node not yet expanded, of all queries at once
        best = np.argmax(np.where(done[live], -np.inf, sims[live]), axis=1)
        node = ids[live, best]
        done[live, best] = True
        step = table[node]
        fresh = (step >= 0) & ~seen[live[:, None], step]
        q, k = np.nonzero(fresh)
        new = np.full(step.shape, -np.inf)
        for a in range(0, len(q), 100_000):
            s = slice(a, a + 100_000)
            new[q[s], k[s]] = np.einsum("ij,ij->i", queries[live[q[s]]], vectors[step[q[s], k[s]]])
        seen[live[q], step[q, k]] = True
        hit = new[q, k] >= least
        within[live[q[hit]], step[q[hit], k[hit]]] = True
        all_ids, all_sims = np.concatenate((ids[live], step), axis=1), np.concatenate((sims[live], new), axis=1)
        all_done = np.concatenate((done[live], ~np.isfinite(new)), axis=1)
        top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        ids[live], sims[live] = np.take_along_axis(all_ids, top, 1), np.take_along_axis(all_sims, top, 1)
        done[live] = np.take_along_axis(all_done, top, 1) | ~np.isfinite(sims[live])
        live = live[~done[live].all(axis=1)]
    edge = np.zeros((n, n), np.float32)
    at, k = np.nonzero(table >= 0)
    edge[at, table[at, k]] = 1
    if own is not None:
        held = np.flatnonzero(own >= 0)
        within[held, own[held]] = seen[held, own[held]] = True
    spread = within.copy()
    while spread.any():  # neighbours of what is in range, until nothing new is
        some = np.flatnonzero(spread.any(axis=1))
        near = np.zeros((m, n), bool)
        near[some] = (spread[some].astype(np.float32) @ edge > 0) & ~seen[some]
        seen |= near
        q, k = np.nonzero(near)
        spread = np.zeros((m, n), bool)
        for a in range(0, len(q), 100_000):
            i, j = q[a : a + 100_000], k[a : a + 100_000]
            hit = np.einsum("ij,ij->i", queries[i], vectors[j]) >= least
            spread[i[hit], j[hit]] = True
        within |= spread
    return np.argwhere(within)


def unit(vectors) -> np.ndarray:
    x = np.stack(list(vectors)).astype(np.float64)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def local_components(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest id that each of ``ids`` reaches over the edges between places ``a`` and ``b``."""
    low = ids.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, a, before[b])
        np.minimum.at(low, b, before[a])
        if (low == before).all():
            return low


# --- jobs ----------------------------------------------------------------------------------------


def usable(table: DataFrame) -> DataFrame:
    """``id, label, v, copies``: one node for each distinct vector that can link."""
    v = F.col("embedding").cast("array<double>")
    sound = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & (F.size(v) > 0)
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    rows = table.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))
    return rows.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies"))


def spherical(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """``k`` unit centroids of the unit vectors ``x``."""
    c = x[np.random.default_rng(k).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        for j in range(k):
            if (near == j).any():
                s = x[near == j].sum(axis=0)
                c[j] = s / (np.linalg.norm(s) or 1)
    return c


def centroids(nodes: DataFrame, levels: int = 4) -> dict[tuple[str, int], np.ndarray]:
    """Unit centroids for each label and vector length: fitted on a sample, then on samples of the cells that are still large."""
    counts = {(r["label"], r["d"]): r["n"] for r in nodes.groupBy("label", F.size("v").alias("d")).agg(F.count("*").alias("n")).where(F.col("n") > CELL_NODES).collect()}
    some = sample_by_hash(nodes, SAMPLE, "id").toPandas()
    some["d"] = some["v"].map(len)
    out = {}
    for key, own in some.groupby(["label", "d"]):
        if key in counts:
            x = unit(own.sort_values("id")["v"])
            out[key] = spherical(x, min(-(-counts[key] // CELL_NODES), max(len(x) // 8, 1)))
    for _ in range(levels if out else 0):
        homes = assigned(nodes, out, least=1.0, visits=False).select("cell", "id", "v")
        large = staged(homes.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > SPREAD * CELL_NODES), "large")
        sizes = {r["cell"]: r["n"] for r in large.collect()}  # fewer than nodes / CELL_NODES
        if not sizes:
            break
        some = sample_by_hash(homes.join(F.broadcast(large), "cell"), SAMPLE, "id").toPandas()
        split = False
        for cell, own in some.groupby("cell"):
            label, d, at = cell.rsplit("/", 2)
            x = unit(own.sort_values("id")["v"])
            c = spherical(x, min(-(-sizes[cell] // CELL_NODES), max(len(x) // 8, 1)))
            if len(c) > 1 and (c @ c.T)[np.triu_indices(len(c), 1)].min() < TIGHT:  # else a tight group, which blocks deal with
                c_all = out[label, int(d)]
                c_all[int(at)] = c[0]
                out[label, int(d)] = np.concatenate((c_all, c[1:]))
                split = True
        if not split:
            break
    return out


def reachable(sims: np.ndarray, centres: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each row, and which cells can hold a vector with a cosine of ``least`` or more to it."""
    home = np.argmax(sims, axis=1)
    square = (centres * centres).sum(axis=1)
    apart = np.sqrt(np.maximum(square[:, None] + square - 2 * centres @ centres.T, 0))
    sine = np.sqrt(1 - least * least) if 0 < least <= 1 else np.inf if least <= 0 else 0.0
    with np.errstate(invalid="ignore"):  # the own cell, at an infinite sine
        far = sims[np.arange(len(sims)), home][:, None] - sims > sine * apart[home] + 1e-7
    return home, ~far


def assigned(nodes: DataFrame, centres: dict, least: float, visits: bool = True) -> DataFrame:
    """``cell, kind, id, v, copies``: a row for each node's home (kind 0), for each later cell that it visits (1),
    and for the next nearest cell, into whose shard it is built as well (2)."""
    shared = nodes.sparkSession.sparkContext.broadcast(centres)

    def work(batches):
        for batch in batches:
            batch["d"] = batch["v"].map(len)
            for (label, d), own in batch.groupby(["label", "d"]):
                c = shared.value.get((label, d), np.zeros((1, d)))
                for at in range(0, len(own), 1_024):
                    some = own.iloc[at : at + 1_024]
                    sims = unit(some["v"]) @ c.T
                    home, near = reachable(sims, c, least)
                    rows = np.arange(len(some))
                    places = [(rows, home, np.zeros(len(some), np.int8))]
                    if visits:
                        q, cell = np.nonzero(near & (np.arange(len(c)) > home[:, None]))
                        places.append((q, cell, np.ones(len(q), np.int8)))
                    if visits and len(c) > 1:
                        sims[rows, home] = -np.inf
                        places.append((rows, np.argmax(sims, axis=1), np.full(len(some), 2, np.int8)))
                    q, cell, kind = (np.concatenate(x) for x in zip(*places, strict=True))
                    for k in range(0, len(q), 4_096):
                        held = some.iloc[q[k : k + 4_096]]
                        yield pd.DataFrame(
                            {"cell": [f"{label}/{d}/{x}" for x in cell[k : k + 4_096]], "kind": kind[k : k + 4_096], "id": held["id"].to_numpy(), "v": held["v"].to_numpy(), "copies": held["copies"].to_numpy()}
                        )

    return nodes.select("label", "id", "v", "copies").mapInPandas(work, "cell string, kind byte, id long, v array<double>, copies long")


def blocked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``block``: members of a cell (kinds 0 and 2) in blocks from 0 on, its visitors in blocks from ``own`` on."""
    blocks = lambda kind: F.ceil(F.count(F.when(F.col("kind") == kind, 1)) / BLOCK_NODES).cast("int")
    sizes = staged(rows.groupBy("cell").agg(blocks(0).alias("own"), blocks(1).alias("guests")).where("own > 0"), "sizes")
    return rows.join(small_side(sizes, sizes.count()), "cell").withColumn(
        "block", F.expr("IF(kind = 1, own + pmod(xxhash64(id), guests), pmod(xxhash64(id), own))").cast("int")
    )


def built(rows: DataFrame) -> DataFrame:
    """``id, near``: the united lists of each node, from the graphs of the shards (blocks of members and of second nearest nodes)."""

    def build(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("id")
        ids, x = own["id"].to_numpy(), unit(own["v"])
        near = []
        for at in range(0, len(x), PART_NODES):  # a shard that many second nearest nodes have joined
            part = slice(at, at + PART_NODES)
            near += [ids[part][k] for k in prune(x[part] @ x[part].T)]
        return pd.DataFrame({"id": ids, "near": near})

    shards = rows.where("kind <> 1").select("cell", "block", "id", "v")
    lists = shards.repartition(n_partitions(rows.sparkSession), "cell", "block").groupBy("cell", "block").applyInPandas(build, "id long, near array<long>")
    return lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))  # two lists a node


def searched(ids: np.ndarray, x: np.ndarray, near: list, held: np.ndarray, own: bool, least: float) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Pairs ``(query, node)`` of places whose cosine is at least ``least``; links of the audited queries, and how many of those the search found.

    ``held`` marks the nodes of the graph; the queries are the others, or the nodes themselves (``own``).
    """
    nodes = np.flatnonzero(held)
    queries = nodes if own else np.flatnonzero(~held)
    place = pd.Index(ids[nodes])
    lists = []
    for n in nodes:
        at = place.get_indexer(np.asarray(near[n], np.int64)) if near[n] is not None and len(near[n]) else np.zeros(0, np.int64)
        lists.append(at[at >= 0])
    pairs = [np.zeros((0, 2), np.int64)]
    for at in range(0, len(queries), 512):
        some = queries[at : at + 512]
        found = in_range(x[some], x[nodes], lists, least, np.arange(at, at + len(some)) if own else None)
        pairs.append(np.column_stack((some[found[:, 0]], nodes[found[:, 1]])))
    pairs = np.concatenate(pairs)
    audited = queries[::AUDIT]
    hit = x[audited] @ x[nodes].T >= least
    true, got = int(hit.sum()), int(np.isin(pairs[:, 0], audited).sum())
    if own:  # a node and itself are no link
        true, got = true - len(audited), got - len(audited)
    if got < ENOUGH * true:
        pairs = []
        for at in range(0, len(queries), 256):
            i, j = np.nonzero(x[queries[at : at + 256]] @ x[nodes].T >= least)
            pairs.append(np.column_stack((queries[at : at + 256][i], nodes[j])))
        pairs = np.concatenate(pairs)
    return pairs[:, 0], pairs[:, 1], true, got


def tallied(ids: np.ndarray, copies: np.ndarray, i: np.ndarray, j: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node (with copies) over the pairs, and the smallest id joined to it; pairs of ``own`` come both ways."""
    other = ids[i] != ids[j]
    i, j = i[other], j[other]
    n = np.bincount(i, copies[j], minlength=len(ids)).astype(np.int64)
    if not own:
        n += np.bincount(j, copies[i], minlength=len(ids)).astype(np.int64)
    return n, local_components(ids, i, j)


def linked(rows: DataFrame, least: float) -> DataFrame:
    """``id, n, low``: links that the search of each block finds for its nodes and queries, and the smallest id joined to them
    there; rows with a null ``id`` tell of the audit: ``n`` links, ``low`` of them found by the search."""
    rows = staged(blocked(rows), "blocks")
    near = staged(built(rows), "graph")
    rows = rows.where("kind < 2").join(near, "id", "left")
    # a task is a members' block, whose graph is searched, and itself or a later block, whose nodes are the queries
    tasks = F.expr("transform(sequence(0, IF(kind = 1, own, own + guests) - 1), o -> named_struct('a', least(o, block), 'b', greatest(o, block), 'held', o >= block))")
    rows = rows.withColumn("task", F.explode(tasks)).select("cell", "task.a", "task.b", "task.held", "id", "v", "copies", F.when(F.col("task.held"), F.col("near")).alias("near"))

    def search(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        ids, held, own = part["id"].to_numpy(), part["held"].to_numpy(), key[1] == key[2]
        if not held.any() or held.all() and not own:  # the hash left one of the two blocks empty
            return pd.DataFrame({"id": [], "n": [], "low": []})
        i, j, true, got = searched(ids, unit(part["v"]), part["near"].tolist(), held, own, least)
        n, low = tallied(ids, part["copies"].to_numpy(), i, j, own)
        some = n > 0
        out = pd.DataFrame({"id": [*ids[some], None], "n": [*n[some], true], "low": [*low[some], got]})
        return out.astype("Int64")

    return rows.repartition(n_partitions(rows.sparkSession), "cell", "a", "b").groupBy("cell", "a", "b").applyInPandas(search, "id long, n long, low long")


def near_duplicates(table: DataFrame, least: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector of ``table`` (``vec_id, embedding, label``)."""
    nodes = staged(usable(table), "nodes")
    rows = staged(assigned(nodes, centroids(nodes), least), "cells")
    found = staged(linked(rows, least), "found")
    rows = found.where("id IS NOT NULL")
    counts = staged(rows.groupBy("id").agg(F.sum("n").alias("n")), "counts")
    group = components(nodes.select("id").distinct(), rows.select(F.col("id").alias("a"), F.col("low").alias("b")).distinct())
    whole = staged(nodes.join(counts, "id", "left").join(group, "id").select("label", "v", "copies", "n", "component"), "whole")
    v = F.col("embedding").cast("array<double>")
    left = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), v.alias("v"))
    out = left.join(whole, ["label", "v"], "left")
    linked_to = F.when(F.col("vec_id").isNotNull(), F.coalesce(F.col("n"), F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).otherwise(F.lit(0))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select(
        "vec_id", linked_to.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept")
    )

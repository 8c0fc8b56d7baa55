"""MinHash near-duplicates by an inverted join over signature coordinates.

1. Every text becomes its set of distinct five-word shingles; documents with equal sets
   are one class (its id: the smallest ``doc_id``), so exact copies never meet in pairs.
2. Each class has ``COORDINATES`` MinHash values.  A coordinate-value pair is a token.
   Two sets with similarity 0.75 agree on at least ``MATCHES`` of 32 tokens but for a
   chance of about 0.00005, so only such pairs are retained.
3. Tokens that one class alone has are skipped, the others are ordered by how many classes
   hold them.  Two classes with ``MATCHES`` tokens in common share one among the first
   ``COORDINATES - MATCHES + 1`` of either (prefix filter), so only these are posted.
   Boilerplate that thousands of texts share stays at the end of the order.
4. Of each class with posted tokens Spark counts the shingles that no other such class has.
   The others bound every intersection: where even they do not suffice for the similarity,
   a class, or a pair, is skipped without a look at the sets.
5. In each posting list every member meets two others, the one whose tokens are the most
   common and one drawn by hash: this joins groups of copies at the price of two pairs a
   posting.  Collisions are counted on the signatures, links are confirmed on the full sets.
6. Members that confirmed links put into one component need not meet.  What is left of a
   list, members outside its largest component, meets the members of other components, each
   pair once; what either shares with the central member, and apart from it with others,
   bounds what they can share.

Every link between different texts is found, or lies within a component that other
confirmed links already join.

Defined cases: a text that is null or without words has an empty set and links with
nothing; a text with fewer than five words has one shingle; rows that share a ``doc_id``
are one vertex; a null ``doc_id`` takes part in nothing (its component is null, it is
kept); equal sizes and counts are ordered by hashes and ids, the same on every run; a text of
any length is one set in one row; other columns are ignored, whatever their names; an empty
table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches, components, small_side, staged
from graphloom.llm.encode import blocks, release
from graphloom.llm.shingles import fingerprints, shingle_sets, signatures

COORDINATES, MATCHES = 32, 14


def described(docs: DataFrame, coordinates: int = COORDINATES, width: int = 5) -> DataFrame:
    """``doc_id, n, f, g, sig``: size, fingerprint and signature of each document's set."""

    def work(batches):
        release()
        for part in blocks(batches, size=2 << 20):
            flat, at = shingle_sets(part["text"].combine_chunks(), width)
            sig = signatures(flat, at, coordinates).astype(np.uint32).view(np.int32)
            f, g = fingerprints(flat, at)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, coordinates, dtype=np.int32)), pa.array(sig.reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"].combine_chunks(), pa.array(np.diff(at)), pa.array(f.view(np.int64)), pa.array(g.view(np.int64)), lists],
                ["doc_id", "n", "f", "g", "sig"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n long, f long, g long, sig array<int>")


def full_sets(docs: DataFrame, ids: DataFrame, n_ids: int, width: int = 5) -> DataFrame:
    """``id, set`` (sorted 64-bit hashes) of the documents in ``ids``."""

    def work(batches):
        release()
        for part in blocks(batches, size=2 << 20):
            flat, at = shingle_sets(part["text"].combine_chunks(), width)
            raw = flat.astype("<u8").tobytes()
            sets = pa.array([raw[8 * a : 8 * b] for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([part["id"].combine_chunks(), sets], ["id", "set"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.join(small_side(ids.select("id"), n_ids), "id", "left_semi").mapInArrow(work, "id long, set binary")


def measured(pairs: DataFrame, sets: DataFrame, percent: int = 75) -> DataFrame:
    """``a, b, both, linked`` of ``pairs`` (``a, b``): the size of the intersection of their sets, and
    whether it is at least ``percent`` of the union."""

    def work(batches):
        release()
        for batch in batches:
            both, linked = [], []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both.append(len(np.intersect1d(x, y, assume_unique=True)))
                linked.append(100 * both[-1] >= percent * (len(x) + len(y) - both[-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(both, pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "both", "linked"])

    left = sets.select(F.col("id").alias("a"), F.col("set").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(work, "a long, b long, both long, linked boolean")


def shared_tokens(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """``id, n, spare, tokens, weight`` of the classes that can have a partner.

    ``tokens`` are those that other classes have too, the rarest first; ``spare`` is how
    many of them are posted; ``weight`` grows with how common they are.
    """
    tokens = classes.select(
        "id", "n", F.explode(F.expr("transform(sig, (v, i) -> shiftleft(cast(i as bigint), 32) | (cast(v as bigint) & 4294967295L))")).alias("t")
    )
    held = staged(tokens.groupBy("t").agg(F.count("*").alias("c")).where("c > 1"), "held")
    rows = (
        tokens.join(held, "t")
        .groupBy("id", "n")
        .agg(F.expr("transform(array_sort(collect_list(struct(c, t))), x -> x.t)").alias("tokens"), F.sum(F.log("c")).alias("weight"))
        .withColumn("spare", F.size("tokens") - (matches - 1))
    )
    return rows.where("spare > 0")


def unshared(sets: DataFrame) -> DataFrame:
    """``id, alone``: how many shingles of a set no other set has."""

    def work(batches):
        for batch in batches:
            size = [len(x.as_buffer()) // 8 for x in batch.column(1)]
            flat = np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in batch.column(1)]) if size else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), size)), pa.array(flat)], ["id", "shingle"])

    one = sets.mapInArrow(work, "id long, shingle long").groupBy("shingle").agg(F.count("*").alias("c"), F.min("id").alias("id")).where("c = 1")
    return one.groupBy("id").agg(F.count("*").alias("alone"))


def links(classes: DataFrame, docs: DataFrame, percent: int = 75, coordinates: int = COORDINATES, matches: int = MATCHES, width: int = 5) -> DataFrame:
    """Confirmed links ``(a, b)`` that span the components of ``classes`` (``id, n, sig``)."""
    able = staged(shared_tokens(classes, coordinates, matches), "able")
    sets = staged(full_sets(docs, able, able.count(), width), "sets")
    alone = staged(unshared(sets), "alone")
    able = able.join(alone, "id", "left").withColumn("m", F.col("n") - F.coalesce("alone", F.lit(0))).drop("alone")
    able = staged(able.where(100 * F.col("m") >= percent * F.col("n")), "able")

    def may_link(n1, m1, n2, m2):
        """Whether sizes and shared shingles leave room for the similarity."""
        return ((100 + percent) * F.least(m1, m2) >= percent * (n1 + n2)) & (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2))

    def retained(pairs: DataFrame) -> DataFrame:
        """Distinct pairs, from ``x, y``, that agree on enough coordinates."""
        pairs = pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()
        left = able.select(F.col("id").alias("a"), F.col("tokens").alias("s"))
        right = able.select(F.col("id").alias("b"), F.col("tokens").alias("t"))
        return pairs.join(left, "a").join(right, "b").where(F.size(F.array_intersect("s", "t")) >= matches).select("a", "b")

    lists = staged(able.select(F.posexplode(F.slice("tokens", F.lit(1), F.col("spare"))).alias("at", "key"), "id", "n", "m", "weight"), "posted")
    member = F.struct("id", "n", "m")
    hubs = staged(
        lists.groupBy("key")
        .agg(F.count("*").alias("size"), F.max_by(member, F.struct("weight", "id")).alias("h"), F.min_by(member, F.xxhash64("id")).alias("g"))
        .where("size > 1")
        .select("key", F.explode(F.array(F.struct("h.*", F.lit(True).alias("central")), F.struct("g.*", F.lit(False).alias("central")))).alias("hub"))
        .select("key", F.col("hub.id").alias("y"), F.col("hub.n").alias("n2"), F.col("hub.m").alias("m2"), F.col("hub.central").alias("central")),
        "hubs",
    )
    met = lists.join(hubs, "key").where((F.col("id") != F.col("y")) & (F.col("central") | may_link(F.col("n"), F.col("m"), F.col("n2"), F.col("m2"))))
    seen = staged(measured(retained(met.select(F.col("id").alias("x"), "y")), sets, percent), "measured")
    found = seen.where("linked").select("a", "b")
    group = staged(components(able.select("id").distinct(), found), "groups")
    members = staged(lists.drop("weight").join(group, "id"), "lists")
    main = staged(
        members.groupBy("key", "component").agg(F.count("*").alias("c"))
        .groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
        .select("key", F.col("top.component").alias("main")),
        "main",
    )
    # with: what a member shares with the list's central member, where that was measured
    central = hubs.where("central").select("key", F.col("y").alias("hub"))
    split = members.join(main, "key").join(central, "key").withColumn("a", F.least("id", "hub")).withColumn("b", F.greatest("id", "hub"))
    split = split.join(seen.drop("linked"), ["a", "b"], "left").withColumn("with", F.when(F.col("id") == F.col("hub"), F.col("n")).otherwise(F.col("both")))
    split = staged(split.join(able.select("id", "tokens"), "id").withColumn("past", F.expr("slice(tokens, 1, at)")), "split")
    columns = ("id", "component", "n", "m", "with", "past", "tokens")
    outside = split.where("component <> main").select("key", F.col("main").alias("main1"), *[F.col(c).alias(f"{c}1") for c in columns])
    inside = split.select("key", *[F.col(c).alias(f"{c}2") for c in columns])
    apart = F.least(F.greatest(F.col("m1") - F.col("with1"), F.lit(0)), F.greatest(F.col("m2") - F.col("with2"), F.lit(0)))
    most = F.when(F.col("with1").isNotNull() & F.col("with2").isNotNull(), F.least("with1", "with2") + apart).otherwise(F.least("m1", "m2"))
    rest = outside.join(inside, "key").where(
        (F.col("component1") != F.col("component2"))
        & ((F.col("id1") < F.col("id2")) | (F.col("component2") == F.col("main1")))  # two members outside meet once
        & may_link(F.col("n1"), F.col("m1"), F.col("n2"), F.col("m2"))
        & ((100 + percent) * most >= percent * (F.col("n1") + F.col("n2")))
        & ~F.arrays_overlap("past1", "past2")  # in the first list that both are in
        & (F.size(F.array_intersect("tokens1", "tokens2")) >= matches)
    )
    pairs = rest.select(F.least("id1", "id2").alias("a"), F.greatest("id1", "id2").alias("b")).distinct()
    return found.unionByName(measured(pairs, sets, percent).where("linked").select("a", "b"))


def near_duplicates(docs: DataFrame, percent: int = 75, coordinates: int = COORDINATES, matches: int = MATCHES, width: int = 5) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document."""
    bounded_batches(docs.sparkSession)
    rows = staged(described(docs, coordinates, width), "sets")
    classes = staged(
        rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("f", "g", "n").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")), "classes"
    )
    joined = components(classes.select("id").distinct(), links(classes, docs, percent, coordinates, matches, width))
    group = staged(classes.select("f", "g", "n", "id").join(joined, "id").select("f", "g", "n", "component"), "members")
    out = rows.select("doc_id", "n", "f", "g").join(group, ["f", "g", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept")
    )

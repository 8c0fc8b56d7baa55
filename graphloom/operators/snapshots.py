"""Three-way snapshots: hashes, differences, merges, parity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.operators.closure import small
from graphloom.sources.text import FENCE, notes_to_rows


def content_hash(content: Column) -> Column:
    """Git's blob hash."""
    return F.sha1(F.concat(F.lit("blob ").cast("binary"), F.octet_length(content).cast("string").cast("binary"), F.lit("\x00").cast("binary"), content.cast("binary")))


def dup_uids(*sides: DataFrame) -> DataFrame:
    """Uids on two or more paths of any side."""
    out = None
    for s in sides:
        one = s.where("uid IS NOT NULL").groupBy("uid").agg(F.countDistinct("path").alias("n")).where("n > 1").select("uid")
        out = one if out is None else out.unionByName(one)
    return out.distinct()


def diff(base: DataFrame, other: DataFrame) -> DataFrame:
    """``change, path, old_path`` between two snapshots ``(path, uid, sha)``.

    Rows are matched by uid where it is unique on both sides, the others by path.
    """
    bad = small(dup_uids(base, other).withColumn("bad", F.lit(True)))
    key = lambda s: s.join(bad, "uid", "left").select(
        F.when(F.col("uid").isNotNull() & F.col("bad").isNull(), F.concat(F.lit("u:"), "uid")).otherwise(F.concat(F.lit("p:"), "path")).alias("k"), "path", "sha"
    )
    b, o = key(base), key(other).select("k", F.col("path").alias("path2"), F.col("sha").alias("sha2"))
    j = b.join(o, "k", "full")
    change = (
        F.when(F.col("path").isNull(), "added").when(F.col("path2").isNull(), "deleted")
        .when(F.col("path") != F.col("path2"), "renamed").when(F.col("sha") != F.col("sha2"), "modified")
    )
    return j.select(change.alias("change"), F.coalesce("path2", "path").alias("path"), F.when(F.col("path") != F.col("path2"), F.col("path")).alias("old_path")).where("change IS NOT NULL")


def root_hash(snapshot: DataFrame) -> DataFrame:
    """One row ``root``: a hash of all ``(path, sha)``, whatever their order; none for an empty snapshot."""
    one = F.conv(F.substring(F.md5(F.concat_ws(" ", "path", "sha")), 1, 8), 16, 10).cast("long")
    return snapshot.agg(F.count("*").alias("n"), F.sum(one).alias("h")).where("n > 0").select(F.concat_ws("-", "n", "h").alias("root"))


def base_guard(remembered: DataFrame, actual: DataFrame) -> DataFrame:
    """``verdict, reason`` before a three-way merge: the base remembered from the last round (``root``) must be
    there, and be the one that the other side has now."""
    one = remembered.sparkSession.range(1)
    j = one.join(remembered.select(F.col("root").alias("a")), F.lit(True), "left").join(actual.select(F.col("root").alias("b")), F.lit(True), "left")
    reason = F.when(F.col("a").isNull(), "first-sync").when(F.col("b").isNull(), "base-missing").when(F.col("a") != F.col("b"), "base-mismatch")
    return j.select(F.when(reason.isNull(), "go").otherwise("full-conflict").alias("verdict"), F.coalesce(reason, F.lit("none")).alias("reason"))


def persistent(before: DataFrame, now: DataFrame, escalatable: list[str]) -> DataFrame:
    """``path, class`` of differences that two rounds of ``parity`` show with the same contents."""
    same = ["path", "l", "r"]
    old = before.where(F.col("class").isin(*escalatable)).select(*[F.col(c).alias(f"_{c}") for c in same])
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) if c != "path" else F.col(c) == F.col(f"_{c}") for c in same]
    return now.where(F.col("class").isin(*escalatable)).join(old, on, "left_semi").select("path", "class")


def lost_edits(base: DataFrame, before: DataFrame, local: DataFrame, remote: DataFrame, merged: DataFrame, pinned: DataFrame) -> DataFrame:
    """Paths edited before a round (``before`` differs from ``base``) whose edit is, after it, neither kept
    locally, nor pushed, nor merged, nor pinned."""
    dirty = before.select("path", "sha").join(base.select("path", "sha"), ["path", "sha"], "left_anti")
    for after in (local, remote):
        dirty = dirty.join(after.select("path", "sha"), ["path", "sha"], "left_anti")
    for paths in (merged, pinned):
        dirty = dirty.join(paths.select("path"), "path", "left_anti")
    return dirty.select("path")


def merge_scalar(base: DataFrame, local: DataFrame, remote: DataFrame, later: list[str] = ()) -> DataFrame:
    """``path, key, value, how`` from three sides ``(path, key, value)``; keys in ``later`` take the larger value."""
    on = ["path", "key"]
    j = local.withColumnRenamed("value", "l").join(remote.withColumnRenamed("value", "r"), on, "full").join(base.withColumnRenamed("value", "b"), on, "full")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    how = F.when(same("l", "r"), "same").when(same("l", "b"), "remote").when(same("r", "b"), "local").when(F.col("key").isin(*later) if later else F.lit(False), "later").otherwise("conflict")
    j = j.withColumn("how", how)
    value = F.when(F.col("how") == "remote", F.col("r")).when(F.col("how") == "later", F.greatest("l", "r")).when(F.col("how") == "conflict", None).otherwise(F.col("l"))
    return j.select("path", "key", value.alias("value"), "how")


def merge_set(base: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """``path, value`` arrays: what both keep and what either adds; what one removes goes."""
    j = local.select("path", F.col("value").alias("l")).join(remote.select("path", F.col("value").alias("r")), "path", "full").join(base.select("path", F.col("value").alias("b")), "path", "left")
    none = F.array().cast("array<string>")
    l, r, b = (F.coalesce(c, none) for c in ("l", "r", "b"))  # noqa: E741
    merged = F.array_union(F.array_intersect(l, r), F.array_union(F.array_except(l, b), F.array_except(r, b)))
    return j.select("path", F.array_sort(merged).alias("value"))


def parity(base: DataFrame, local: DataFrame, remote: DataFrame, pinned: DataFrame) -> DataFrame:
    """``path, class`` of every path of three sides ``(path, sha)``, and the contents ``l, r`` of the last two."""
    j = base.select("path", F.col("sha").alias("b")).join(local.select("path", F.col("sha").alias("l")), "path", "full").join(remote.select("path", F.col("sha").alias("r")), "path", "full")
    j = j.join(pinned.select("path", F.lit(True).alias("pin")), "path", "left")
    l, r, b = F.col("l"), F.col("r"), F.col("b")  # noqa: E741
    kind = lambda x: F.when(b.isNull(), "add").when(x.isNull(), "delete").otherwise("edit")
    cls = (
        F.when(l.eqNullSafe(r), "parity").when(F.col("pin"), "pinned").when(r.eqNullSafe(b), F.concat(F.lit("pending-local-"), kind(l)))
        .when(l.eqNullSafe(b), F.concat(F.lit("pending-remote-"), kind(r))).otherwise("conflict")
    )
    return j.select("path", cls.alias("class"), "l", "r")


def parity_totals(classes: DataFrame, accounted: list[str]) -> DataFrame:
    """``paths, differences, unaccounted, verdict``."""
    out = classes.agg(
        F.count("*").alias("paths"), F.count_if(F.col("class") != "parity").alias("differences"),
        F.count_if((F.col("class") != "parity") & ~F.col("class").isin(*accounted)).alias("unaccounted"),
    )
    return out.withColumn("verdict", F.when(F.col("paths") == 0, "vacuous").when(F.col("unaccounted") == 0, "ok").otherwise("diverged"))


def property_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, key, change`` between two versions ``(path, key, value)``."""
    j = old.withColumnRenamed("value", "a").withColumn("in_old", F.lit(True)).join(new.withColumnRenamed("value", "b").withColumn("in_new", F.lit(True)), ["path", "key"], "full")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("a").eqNullSafe(F.col("b")), "modified")
    return j.select("path", "key", change.alias("change")).where("change IS NOT NULL")


def format_drift(left: DataFrame, right: DataFrame) -> DataFrame:
    """Paths of notes ``(path, content)`` whose bytes differ between two sides, but neither their keys and values nor,
    apart from white space, their bodies."""

    def told(notes: DataFrame, n: str) -> DataFrame:
        keys = notes_to_rows(notes).groupBy("path").agg(F.md5(F.to_json(F.array_sort(F.collect_list(F.struct("key", "pos", "value"))))).alias("keys"))
        body = F.md5(canonical(F.regexp_replace("content", FENCE, "")))
        one = notes.select("path", F.md5("content").alias("sha"), body.alias("body")).join(keys, "path", "left")
        return one.select("path", *[F.col(c).alias(f"{c}{n}") for c in ("sha", "body", "keys")])

    j = told(left, "1").join(told(right, "2"), "path")
    return j.where((F.col("sha1") != F.col("sha2")) & (F.col("body1") == F.col("body2")) & F.col("keys1").eqNullSafe(F.col("keys2"))).select("path")


def merge_gate(findings: DataFrame, focus: DataFrame, known: DataFrame) -> DataFrame:
    """``s, ship, skipped`` of merged candidates (``focus``): whether none of their own violations stands against them.

    ``findings`` has ``s, check, severity, o``; one about the class of a target ``o`` outside the ``known`` nodes
    (column ``o``) says nothing of the candidate: it is skipped and counted.
    """
    there = known.select("o").distinct().withColumn("_known", F.lit(True))
    own = findings.where("severity = 'Violation'").join(focus.select("s"), "s", "left_semi").join(there, "o", "left")
    skip = (F.col("check") == "class_range") & F.col("o").isNotNull() & F.col("_known").isNull()
    told = own.groupBy("s").agg(F.count_if(~skip).alias("bad"), F.count_if(skip).alias("skipped"))
    return focus.select("s").join(told, "s", "left").select("s", (F.coalesce("bad", F.lit(0)) == 0).alias("ship"), F.coalesce("skipped", F.lit(0)).alias("skipped"))


def canonical(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), r"\s+", " ")

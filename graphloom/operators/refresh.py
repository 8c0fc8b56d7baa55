"""Stored inferences kept up to date under changes of the files that they rest on.

``Facts`` are what a set of notes says and what follows from it: rows ``(path, s, p, o)``, the
closure of the class hierarchy, inferred types, and properties inherited from prototypes.
``refreshed`` reads only changed files and those that refer to them, and changes of the stored
tables only what the difference of their rows can reach:

* the closure by over-deletion and re-derivation: pairs that could rest on a removed edge go,
  come back if what is kept still leads there (semi-naive), then added edges are closed;
* types of subjects whose own types, or the ancestors of whose classes, have changed;
* inherited properties of subjects that a changed subject is, or was, a prototype of.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.closure import alt, cut, pairs, reach, seq
from graphloom.operators.inference import TYPE, handed_on, inherit

SUPERCLASS, PROTOTYPE = "rdfs:subClassOf", "prototype"


@dataclass
class Facts:
    """``manifest`` has ``path, mtime, size``; ``rows`` ``path, s, p, o``; ``closure`` ``src, dst``; ``types`` ``s, cls``;
    ``inherited`` ``s, p, o, depth``."""

    manifest: DataFrame
    rows: DataFrame
    closure: DataFrame
    types: DataFrame
    inherited: DataFrame


def links(rows: DataFrame, p: str) -> DataFrame:
    return rows.where(F.col("p") == p).select(F.col("s").alias("src"), F.col("o").alias("dst"))


def properties(rows: DataFrame) -> DataFrame:
    """What prototypes hand on: all but types and links of the hierarchies."""
    return rows.where(~F.col("p").isin(TYPE, SUPERCLASS, PROTOTYPE)).select("s", "p", "o")


def typed(types: DataFrame, closure: DataFrame) -> DataFrame:
    """Types ``(s, cls)`` that follow from ``types`` and are not among them."""
    up = closure.select(F.col("src").alias("cls"), F.col("dst").alias("up"))
    return types.join(up, "cls").select("s", F.col("up").alias("cls")).distinct().join(types, ["s", "cls"], "left_anti")


def facts(manifest: DataFrame, rows: DataFrame, multi: list[str], depth: int = 10) -> Facts:
    """All of it, from the rows."""
    rows = cut(rows)
    closure = reach(links(rows, SUPERCLASS))
    types = cut(typed(own_types(rows), closure))
    return Facts(cut(manifest.select("path", "mtime", "size")), rows, closure, types, cut(inherit(properties(rows), links(rows, PROTOTYPE), multi, depth=depth)))


def own_types(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("p") == TYPE).select("s", F.col("o").alias("cls")).distinct()


def maintained_closure(closure: DataFrame, edges: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """The closure of ``edges``, from that of the edges before ``removed`` went and ``added`` came (all ``src, dst``)."""
    key = ["src", "dst"]
    edges, removed, added = (cut(pairs(e)) for e in (edges, removed, added))
    if not removed.isEmpty():
        into = seq(closure, removed.select("src", "dst"))  # what led to a removed edge's source now ends at its end
        doubtful = alt(removed, into)
        doubtful = cut(alt(doubtful, seq(doubtful, closure)).join(closure, key, "left_semi"))
        kept = cut(closure.join(doubtful, key, "left_anti"))
        back = cut(alt(edges, seq(edges, kept)).join(doubtful, key, "left_semi"))
        closure = kept
        while not back.isEmpty():
            closure = cut(closure.unionByName(back))
            back = cut(seq(edges, back).join(doubtful, key, "left_semi").join(closure, key, "left_anti"))
    new = cut(added.join(closure, key, "left_anti"))
    while not new.isEmpty():
        closure, longer = cut(closure.unionByName(new)), new
        new = cut(alt(seq(longer, closure), seq(closure, longer)).join(closure, key, "left_anti"))
    return closure


def inherited_by(heirs: DataFrame, triples: DataFrame, links: DataFrame, inherited: DataFrame, multi: list[str], depth: int) -> DataFrame:
    """What ``heirs`` (column ``s``) inherit; what all other prototypes hand on is their own and what ``inherited`` has of them."""
    up, end = links.join(heirs.select(F.col("s").alias("src")), "src", "left_semi"), heirs.select(F.col("s").alias("dst"))
    own = triples.withColumn("depth", F.lit(0))
    known = own.unionByName(inherited).where(F.col("depth") < depth).select(F.col("s").alias("dst"), "p", "o", (F.col("depth") + 1).alias("depth"))
    given = up.join(end, "dst", "left_anti").join(known, "dst").select(F.col("src").alias("s"), "p", "o", "depth")
    values = cut(own.join(heirs, "s", "left_semi").unionByName(given))
    return handed_on(values, up.join(end, "dst", "left_semi"), multi, depth).where("depth > 0")


def refreshed(before: Facts, manifest: DataFrame, reparsed: DataFrame, paths: DataFrame, multi: list[str], depth: int = 10) -> Facts:
    """``before`` with ``reparsed`` rows in place of all rows of ``paths``."""
    paths = cut(paths.select("path").distinct())
    rest = before.rows.join(paths, "path", "left_anti")
    rows = cut(rest.unionByName(reparsed.select(*before.rows.columns)))
    triple = ["s", "p", "o"]
    old, new = (df.join(paths, "path", "left_semi").select(*triple).distinct() for df in (before.rows, rows))
    removed = cut(old.join(rows.select(*triple), triple, "left_anti"))  # no other file says it either
    added = cut(new.join(before.rows.select(*triple), triple, "left_anti"))
    moved = removed.unionByName(added)

    closure = cut(maintained_closure(before.closure, links(rows, SUPERCLASS), links(removed, SUPERCLASS), links(added, SUPERCLASS)))
    gone = before.closure.join(closure, ["src", "dst"], "left_anti")
    came = closure.join(before.closure, ["src", "dst"], "left_anti")
    types = own_types(rows)
    other = types.join(gone.unionByName(came).select(F.col("src").alias("cls")).distinct(), "cls", "left_semi").select("s")
    touched = cut(other.unionByName(moved.where(F.col("p") == TYPE).select("s")).distinct())
    inferred = before.types.join(touched, "s", "left_anti").unionByName(typed(types.join(touched, "s", "left_semi"), closure))

    both = alt(links(before.rows, PROTOTYPE), links(rows, PROTOTYPE))
    changed = cut(moved.where(~F.col("p").isin(TYPE, SUPERCLASS)).select("s").distinct())
    mark = F.lit("").alias("p"), F.lit("").alias("o"), F.lit(0).alias("depth")
    heirs = cut(handed_on(changed.select("s", *mark), both, [], depth).select("s"))
    again = inherited_by(heirs, properties(rows), links(rows, PROTOTYPE), before.inherited, multi, depth)
    inherited = before.inherited.join(heirs, "s", "left_anti").unionByName(again)
    return Facts(cut(manifest.select("path", "mtime", "size")), rows, closure, cut(inferred), cut(inherited))


def refresh(before: Facts | None, files: DataFrame, parse: Callable[[DataFrame], DataFrame], multi: list[str], depth: int = 10) -> tuple[str, DataFrame | None, Facts]:
    """The verdict (``rebuild``, ``hit`` or ``delta``), the paths that were read for a delta, and the facts.

    ``files`` has ``path, mtime, size`` and what ``parse`` needs to make rows ``(path, s, p, o)`` of them.
    A file's own subject is its path, so a row refers to the file that its ``o`` names.
    """
    from graphloom.streaming.jobs import delta_plan

    references = None if before is None else before.rows.select("path", F.col("o").alias("target"))
    verdict, paths = delta_plan(files, None if before is None else before.manifest, references)
    if verdict == "hit":
        return verdict, None, before
    if verdict == "rebuild":
        return verdict, None, facts(files, parse(files), multi, depth)
    paths = cut(paths)
    return verdict, paths, refreshed(before, files, parse(files.join(paths, "path", "left_semi")), paths, multi, depth)

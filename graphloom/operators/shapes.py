"""Shape validation of triples, and audits of references, groups and workflows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.closure import alt, condense, covered, cut, identity, inverse, reach, reduction, scc, small
from graphloom.operators.domain import places

INTEGER, DECIMAL = r"^[+-]?\d+$", r"^[+-]?(\d+(\.\d*)?|\.\d+)$"
NON_NEGATIVE, FLOAT = r"^\+?\d+$", r"^([+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|[+-]?INF|NaN)$"
#: The lexical forms with which a number's literal may stand for another numeric datatype.  They are those
#: that right answers need, which is not all of XSD (``-0`` is no nonNegativeInteger here).
LEXICAL = {
    "xsd:integer": INTEGER, "xsd:long": INTEGER, "xsd:int": INTEGER, "xsd:short": INTEGER, "xsd:byte": INTEGER,
    "xsd:nonNegativeInteger": NON_NEGATIVE, "xsd:unsignedLong": NON_NEGATIVE, "xsd:unsignedInt": NON_NEGATIVE,
    "xsd:unsignedShort": NON_NEGATIVE, "xsd:unsignedByte": NON_NEGATIVE, "xsd:positiveInteger": r"^\+?0*[1-9]\d*$",
    "xsd:nonPositiveInteger": r"^(-\d+|\+?0+)$", "xsd:negativeInteger": r"^-0*[1-9]\d*$", "xsd:decimal": DECIMAL,
    "xsd:float": FLOAT, "xsd:double": FLOAT, "xsd:gYear": r"^-?\d{4,}(Z|[+-]\d{2}:\d{2})?$",
}
#: The schemes that an absolute IRI may have; those of the first line need a host.
HOSTED = ("http", "https", "ftp", "ws", "wss")
UNHOSTED = ("ftps", "file", "mailto", "tel", "data", "urn", "obsidian")
#: An absolute IRI: one of these schemes, no white space.
ABSOLUTE = rf"^(?i:(?:{'|'.join(HOSTED)}):[/\\]*[^\s/\\?#]\S*|(?:{'|'.join(UNHOSTED)}):\S*)$"


def load_shapes(definitions: DataFrame) -> DataFrame:
    """``property, domains, ranges, cardinality, min_count, severity`` from long rows ``(property, key, value)``.

    A property without a domain gives no shape.
    """
    pick = lambda k: F.collect_set(F.when(F.col("key") == k, F.col("value")))
    one = lambda k: F.min(F.when(F.col("key") == k, F.col("value")))
    out = definitions.groupBy("property").agg(
        F.array_sort(pick("domain")).alias("domains"), F.array_sort(pick("range")).alias("ranges"), one("cardinality").alias("cardinality"),
        F.coalesce(one("min_count").try_cast("int"), F.lit(0)).alias("min_count"), F.coalesce(one("severity"), F.lit("Violation")).alias("severity"),
    )
    return out.where(F.size("domains") > 0)


def ancestors(superclass: DataFrame) -> DataFrame:
    """The closure of the classes; one that ``report`` has made already is taken as it is."""
    return superclass if "closed" in superclass.columns else reach(superclass).withColumn("closed", F.lit(True))


def applicable(types: DataFrame, shapes: DataFrame, superclass: DataFrame) -> DataFrame:
    """``(s, property)``: shapes whose domain is a class of ``s`` or an ancestor.

    Subjects are first grouped by their set of classes, which are few, then joined back.
    """
    sets = types.groupBy("s").agg(F.array_sort(F.collect_set("cls")).alias("classes"))
    up = ancestors(superclass).select(F.col("src").alias("cls"), F.col("dst").alias("up"))
    kinds = sets.select("classes").distinct().select("classes", F.explode("classes").alias("cls"))
    every = kinds.select("classes", F.col("cls").alias("up")).unionByName(kinds.join(up, "cls").select("classes", "up")).distinct()
    wanted = shapes.select("property", F.explode("domains").alias("up"))
    fits = every.join(wanted, "up").select("classes", "property").distinct()
    return sets.join(fits, "classes").select("s", "property")


def counts(triples: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(s, property, n)``: values of each applicable property, zero included."""
    n = triples.groupBy("s", F.col("p").alias("property")).agg(F.count("*").alias("n"))
    return pairs.join(n, ["s", "property"], "left").select("s", "property", F.coalesce("n", F.lit(0)).alias("n"))


def min_count(counted: DataFrame, shapes: DataFrame) -> DataFrame:
    return counted.join(shapes.select("property", "min_count", "severity"), "property").where("n < min_count").select("s", "property", F.lit("min_count").alias("check"), "severity")


def max_count(counted: DataFrame, shapes: DataFrame) -> DataFrame:
    return counted.join(shapes.where("cardinality = 'Single'").select("property", "severity"), "property").where("n > 1").select("s", "property", F.lit("max_count").alias("check"), "severity")


def class_range_targets(triples: DataFrame, shapes: DataFrame, types: DataFrame, superclass: DataFrame) -> DataFrame:
    """``s, property, check, severity, o``: IRI values outside the expected classes; an untyped target is a warning;
    other vocabularies are skipped."""
    own = shapes.where(F.exists("ranges", lambda r: r.startswith("class/"))).select(F.col("property").alias("p"), "ranges", "severity")
    values = triples.where("o_kind = 'iri'").join(own, "p").where(~F.col("o").rlike("^(rdf|rdfs|owl|xsd):")).select("s", "p", "o", "ranges", "severity")
    up = ancestors(superclass).select(F.col("src").alias("cls"), F.col("dst").alias("up"))
    of = types.select(F.col("s").alias("o"), F.col("cls").alias("up")).unionByName(types.join(up, "cls").select(F.col("s").alias("o"), "up"))
    classes = of.groupBy("o").agg(F.collect_set("up").alias("classes"))
    j = values.join(classes, "o", "left").where(F.col("classes").isNull() | ~F.arrays_overlap("classes", "ranges"))
    severity = F.when(F.col("classes").isNull(), "Warning").otherwise(F.col("severity"))
    return j.select("s", F.col("p").alias("property"), F.lit("class_range").alias("check"), severity.alias("severity"), "o")


def class_range(triples: DataFrame, shapes: DataFrame, types: DataFrame, superclass: DataFrame) -> DataFrame:
    return class_range_targets(triples, shapes, types, superclass).drop("o")


def literal_fits(value: Column, tag: Column, expected: Column) -> Column:
    """Whether a literal of datatype ``tag`` (null: xsd:string) may stand where ``expected`` is asked for.

    The same datatype always fits.  A number's tag comes of how it was written down, so its
    text decides; so it does for a text under xsd:boolean or xsd:anyURI.  Nothing else fits.
    """
    tag = F.coalesce(tag, F.lit("xsd:string"))
    number = F.lit(False)
    for datatype, form in LEXICAL.items():
        number = number | ((expected == datatype) & value.rlike(form))
    text = ((expected == "xsd:boolean") & value.rlike("^(true|false)$")) | ((expected == "xsd:anyURI") & value.rlike(ABSOLUTE))
    return F.when(tag == expected, True).when(tag.isin("xsd:integer", "xsd:decimal"), number).when(tag == "xsd:string", text).otherwise(False)


def datatype_range(triples: DataFrame, shapes: DataFrame) -> DataFrame:
    """Literals ``(o, o_dt)`` that are not of any of the datatypes in the range."""
    own = shapes.where(F.exists("ranges", lambda r: r.startswith("xsd:"))).select(F.col("property").alias("p"), F.filter("ranges", lambda r: r.startswith("xsd:")).alias("dts"), "severity")
    lit = triples.where("o_kind = 'lit'").select("s", "p", "o", "o_dt").join(own, "p")
    bad = lit.where(~F.exists("dts", lambda dt: literal_fits(F.col("o"), F.col("o_dt"), dt)))
    return bad.select("s", F.col("p").alias("property"), F.lit("datatype_range").alias("check"), "severity", "o").distinct().drop("o")


def unknown_property(triples: DataFrame, shapes: DataFrame) -> DataFrame:
    known = shapes.select(F.col("property").alias("p"))
    return triples.where("p <> 'rdf:type'").join(known, "p", "left_anti").select("s", F.col("p").alias("property"), F.lit("unknown_property").alias("check"), F.lit("Warning").alias("severity")).distinct()


def report(triples: DataFrame, shapes: DataFrame, types: DataFrame, superclass: DataFrame) -> DataFrame:
    """All findings, by node and property; a pair below its minimum is checked no further.

    The triples and the closure of the classes are made once, as tables, for all checks.
    """
    triples, types, superclass = cut(triples), cut(types), ancestors(superclass)
    counted = counts(triples, applicable(types, shapes, superclass))
    low = min_count(counted, shapes)
    rest = max_count(counted, shapes).unionByName(class_range(triples, shapes, types, superclass)).unionByName(datatype_range(triples, shapes))
    rest = rest.join(low.select("s", "property"), ["s", "property"], "left_anti")
    return low.unionByName(rest).unionByName(unknown_property(triples, shapes)).orderBy("s", "property", "check")


def conforms(findings: DataFrame) -> DataFrame:
    return findings.agg(F.coalesce(F.bool_and(F.col("severity") != "Violation"), F.lit(True)).alias("conforms"), F.count("*").alias("findings"))


# --- audits ---------------------------------------------------------------------------------------


def uid_unique(assets: DataFrame, exempt: list[str] = ()) -> DataFrame:
    """``uid, path, n`` of uids on several paths; classes in ``exempt`` are skipped."""
    rows = assets.where(~F.col("cls").isin(*exempt)) if exempt else assets
    many = rows.groupBy("uid").agg(F.count("*").alias("n")).where("n > 1")
    return rows.join(many, "uid").select("uid", "path", "n")


def plan_uid_fix(assets: DataFrame, salt: str) -> DataFrame:
    """New uids for all but the first path of each uid."""
    w = Window.partitionBy("uid").orderBy("path")
    return assets.withColumn("_n", F.row_number().over(w)).where("_n > 1").select("path", "uid", F.md5(F.concat_ws("/", F.lit(salt), "path")).alias("new_uid"))


def term_collision(rows: DataFrame) -> DataFrame:
    """Terms that two or more entities emit."""
    return rows.groupBy("term").agg(F.countDistinct("s").alias("entities"), F.min("s").alias("first")).where("entities >= 2")


def imports_audit(links: DataFrame, files: DataFrame, imports: DataFrame) -> DataFrame:
    """Each link ``(src, name)`` with the first bucket that fits it.

    ``files`` has ``path, name, grp``; ``imports`` ``src, dst`` are declared between groups.
    """
    named = files.groupBy("name").agg(F.count("*").alias("n"), F.min("path").alias("target"), F.min("grp").alias("target_grp"))
    declared = reach(imports).select(F.col("src").alias("grp"), F.col("dst").alias("target_grp"), F.lit(True).alias("ok"))
    j = links.join(named, "name", "left").join(files.select(F.col("path").alias("src"), "grp"), "src", "left").join(declared, ["grp", "target_grp"], "left")
    bucket = (
        F.when(F.col("name").rlike(r"\.(png|jpg|pdf|js|css)$"), "non-markdown").when(F.col("n") > 1, "ambiguous").when(F.col("n").isNull(), "broken")
        .when(F.col("grp").isNull() | F.col("target_grp").isNull(), "no-group").when(F.col("grp") == F.col("target_grp"), "internal")
        .when(F.col("ok"), "valid").otherwise("violation")
    )
    return j.select("src", "name", "grp", "target_grp", bucket.alias("bucket"))


def import_pairs(audited: DataFrame, examples: int = 3) -> DataFrame:
    """``grp, target_grp, occurrences, valid, examples`` of links between two groups, from rows of ``imports_audit``.

    ``examples``: the first sources, by name, of a pair that violates; none of one that does not.
    """
    between = audited.where(F.col("bucket").isin("valid", "violation"))
    counted = between.groupBy("grp", "target_grp").agg(F.count("*").alias("occurrences"), (F.min("bucket") == "valid").alias("valid"))
    sources = between.where("bucket = 'violation'").select("grp", "target_grp", "src").distinct()
    near = sources.groupBy("grp", "target_grp").agg(F.min("src").alias("_s0"))
    told = [F.col("_s0")]
    for k in range(1, examples):  # the next least, aggregated before the shuffle: a pair's sources are never gathered
        rest = sources.join(near, ["grp", "target_grp"]).where(F.col("src") > F.col(f"_s{k - 1}"))
        near = near.join(rest.groupBy("grp", "target_grp").agg(F.min("src").alias(f"_s{k}")), ["grp", "target_grp"], "left")
        told.append(F.col(f"_s{k}"))
    out = counted.join(near, ["grp", "target_grp"], "left")
    return out.select("grp", "target_grp", "occurrences", "valid", F.array_compact(F.array(*told)).alias("examples"))


def import_groups(audited: DataFrame) -> DataFrame:
    """``grp, internal, links_out, links_in, violating, out_degree, in_degree`` of every group that a link starts or ends in."""
    one = lambda *of: F.sum(F.when(F.col("bucket").isin(*of), 1).otherwise(0))
    linked = audited.where(F.col("bucket").isin("internal", "valid", "violation"))
    pairs = linked.groupBy("grp", "target_grp").agg(one("internal").alias("i"), one("valid", "violation").alias("x"), one("violation").alias("v"))
    pairs = pairs.withColumn("d", (F.col("x") > 0).cast("long"))
    zero = F.lit(0).cast("long")
    out = pairs.select("grp", F.col("i").alias("internal"), F.col("x").alias("links_out"), zero.alias("links_in"), F.col("v").alias("violating"), F.col("d").alias("out_degree"), zero.alias("in_degree"))
    into = pairs.select(F.col("target_grp").alias("grp"), zero.alias("internal"), zero.alias("links_out"), F.col("x").alias("links_in"), zero.alias("violating"), zero.alias("out_degree"), F.col("d").alias("in_degree"))
    return out.unionByName(into).groupBy("grp").agg(*[F.sum(c).alias(c) for c in ("internal", "links_out", "links_in", "violating", "out_degree", "in_degree")])


def url_form(rows: DataFrame, url: str, own_host: str) -> DataFrame:
    """``rows`` with ``verdict`` and ``expected`` of a namespace's ``url``: one on an own host (a pattern) must end in ``#``.

    ``foreign`` hosts and what is no URL (``unparsable``) are told, never judged; ``no-hash`` ones have the form expected.
    """
    bare = F.substring_index(url, "#", 1)  # a second ``#`` is no fault of the host
    by_rule = F.nullif(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?:\s]+)", 1), F.lit(""))
    host = F.coalesce(F.try_parse_url(bare, F.lit("HOST")), by_rule)  # the rule takes names that Java refuses, such as ``a_b.org``
    verdict = F.when(host.isNull(), "unparsable").when(~host.rlike(f"^(?:{own_host})$"), "foreign").when(F.col(url).endswith("#"), "ok").otherwise("no-hash")
    rows = rows.withColumn("verdict", verdict)
    return rows.withColumn("expected", F.when(F.col("verdict") == "no-hash", F.concat(F.regexp_replace(url, "/+$", ""), F.lit("#"))))


def unknown_keys(used: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """``key, reason, nearest`` of keys (``used``: ``key``) of the form ``prefix__Name`` that are not among ``names`` (``name``).

    Other keys are not judged, nor is any where there are no names.  ``reason`` is ``unknown-name`` or
    ``unknown-prefix``; ``nearest`` has up to ``most`` names of the same prefix, by edit distance, then name, within
    four tenths of the key's length, or three if that is more.  Distances are taken of distinct keys with names of
    their prefix that are near in length; a key that occurs a million times is one.
    """
    prefix = lambda c: F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9]*)__.+", 1)
    names = cut(names.select("name").where("name IS NOT NULL").distinct().withColumn("prefix", prefix("name")))
    keys = used.select("key").where("key IS NOT NULL").distinct().withColumn("prefix", prefix("key")).where("prefix <> ''")
    unknown = keys.join(names.select(F.col("name").alias("key")), "key", "left_anti").join(F.broadcast(names.limit(1).select(F.lit(True).alias("_any"))))
    known = names.select("prefix", F.lit(True).alias("_known")).distinct()
    unknown = cut(unknown.select("key", "prefix").join(known, "prefix", "left"))
    within = F.greatest(F.lit(3), F.floor(F.length("key") * 0.4)).cast("int")
    offers = unknown.where("_known").select("key", "prefix", within.alias("_most"), F.explode(F.sequence(F.greatest(F.length("key") - within, F.lit(0)), F.length("key") + within)).alias("_len"))
    offers = offers.join(names.select("prefix", "name", F.length("name").alias("_len")), ["prefix", "_len"])
    offers = offers.withColumn("distance", F.levenshtein("key", "name")).where(F.col("distance") <= F.col("_most"))
    near = offers.withColumn("_n", F.row_number().over(Window.partitionBy("key").orderBy("distance", "name"))).where(F.col("_n") <= most)
    told = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("_n", "name"))).alias("t"))  # up to ``most``
    out = unknown.join(told, "key", "left")
    nearest = F.coalesce(F.transform("t", lambda x: x["name"]), F.array().cast("array<string>"))
    return out.select("key", F.when(F.col("_known"), "unknown-name").otherwise("unknown-prefix").alias("reason"), nearest.alias("nearest"))


def declared_cycles(imports: DataFrame, uids: DataFrame) -> DataFrame:
    """``kind, component, members``: cycles of two or more groups, self-imports, and uids (``uid, node``) of several groups."""
    cycles = scc(imports).groupBy("component").agg(F.count("*").alias("members")).where("members > 1")
    own = imports.where("src = dst").select(F.lit("self-import").alias("kind"), F.col("src").alias("component"), F.lit(1).cast("long").alias("members")).distinct()
    doubled = uids.groupBy("uid").agg(F.countDistinct("node").alias("members")).where("members > 1")
    return (
        cycles.select(F.lit("cycle").alias("kind"), "component", "members").unionByName(own)
        .unionByName(doubled.select(F.lit("duplicate-uid").alias("kind"), F.col("uid").alias("component"), "members"))
    )


def accepted_in_order(known: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the edges ``wanted``, one after the other by (src, dst): those that close no cycle with ``known`` ones and
    those accepted before, and the others.

    One whose inverse is known goes first.  Then rounds over all at once.  An edge that is on no cycle of everything left is accepted;
    one that what is accepted already closes is not.  In each component that is left, halving
    finds the first edge in order that closes a cycle: the edges before it are accepted, it is not.
    """
    edges = ["src", "dst"]
    taken, wanted = cut(known.select(*edges)), cut(wanted.select(*edges).distinct())
    yes, no = [], [cut(wanted.join(inverse(taken), edges, "left_semi"))]
    live = cut(wanted.join(no[0], edges, "left_anti"))
    inside = lambda df, members: df.join(members.select(F.col("node").alias("src"), "component"), "src").join(members.select(F.col("node").alias("dst"), F.col("component").alias("_c")), "dst").where("component = _c").drop("_c")
    while not live.isEmpty():
        members = cut(scc(alt(taken, live)))
        held = cut(inside(live, members).select("component", *edges))
        if held.isEmpty():
            yes.append(live)
            break
        free = live.join(held, edges, "left_anti")
        yes.append(free)
        taken = cut(alt(taken, free))
        base = cut(inside(taken, members).select(*edges))
        closing = cut(inverse(covered(inverse(held), base)))
        no.append(closing)
        live = cut(places(held.join(closing, edges, "left_anti"), ["component", *edges]))
        if live.isEmpty():
            break
        span = cut(live.groupBy("component").agg((F.min("place") - 1).alias("low"), (F.max("place") + 1).alias("high")))
        while not span.where("low + 1 < high").isEmpty():
            span = span.withColumn("mid", F.expr("(low + high) div 2"))
            tried = cut(live.join(span, "component").where("place <= mid").select("component", *edges))
            now = scc(alt(base, tried.select(*edges))).withColumnRenamed("component", "circle")
            ends = tried.join(now.select(F.col("node").alias("src"), "circle"), "src").join(now.select(F.col("node").alias("dst"), F.col("circle").alias("_c")), "dst")
            bad = ends.where("circle = _c").select("component").distinct().withColumn("bad", F.lit(True))
            step = span.join(bad, "component", "left")
            span = cut(step.select("component", F.expr("if(low + 1 < high AND bad IS NULL, mid, low)").alias("low"), F.expr("if(low + 1 < high AND bad, mid, high)").alias("high")))
        placed = live.join(span, "component")
        good = cut(placed.where("place <= low").select(*edges))
        yes.append(good)
        no.append(cut(placed.where("place = high").select(*edges)))
        taken = cut(alt(taken, good))
        live = cut(placed.where("place > high").select(*edges))
    none = wanted.select(*edges).limit(0)
    return cut(reduce(DataFrame.unionByName, yes, none)), cut(reduce(DataFrame.unionByName, no, none))


def propose_imports(derived: DataFrame, declared: DataFrame) -> DataFrame:
    """``src, dst, kind`` between the components of the ``derived`` graph, each named by its least member.

    The edges are taken by (src, dst); one that would close a cycle with the declared imports or
    those taken before it is a ``conflict``.  The others are reduced together with the declared
    ones; what is left and not declared is an ``add``.
    """
    member = cut(scc(derived))
    nodes = member.unionByName(
        identity(declared).select(F.col("src").alias("node"), F.col("src").alias("component")).join(member.select("node"), "node", "left_anti")
    )
    known, wanted = cut(condense(declared, nodes)), cut(condense(derived, nodes))
    fine, conflict = accepted_in_order(known, wanted)
    more = reduction(alt(fine, known)).join(known, ["src", "dst"], "left_anti")
    return more.select("src", "dst", F.lit("add").alias("kind")).unionByName(conflict.select("src", "dst", F.lit("conflict").alias("kind")))


def dependency_coverage(facts: DataFrame, declared: DataFrame) -> DataFrame:
    """Fact edges between packages that the closure of the declared ones does not cover, and those
    that a direct one lacks for; no facts at all are one row ``broken``, as nothing was audited."""
    covers = covered(facts.where("src <> dst"), declared)
    direct = declared.select("src", "dst", F.lit(True).alias("direct"))
    e = facts.where("src <> dst").select("src", "dst").distinct()
    missing = e.join(covers, ["src", "dst"], "left_anti").select("src", "dst", F.lit("uncovered").alias("verdict"))
    gap = covers.join(direct, ["src", "dst"], "left").where("direct IS NULL").select("src", "dst", F.lit("indirect").alias("verdict"))
    broken = facts.sparkSession.range(1).join(facts.limit(1), F.lit(True), "left_anti").select(*[F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in ("src", "dst")], F.lit("broken").alias("verdict"))
    return missing.unionByName(gap).unionByName(broken)


def membership_audit(entities: DataFrame, groups: DataFrame, allowed: DataFrame, classes: DataFrame, superclass: DataFrame) -> DataFrame:
    """``id, verdict`` of entities ``(id, ref, cls)``: the first reason to skip that holds, else whether the
    class or an ancestor is on the allow-list of the group.

    ``groups`` has ``ref``; ``allowed`` ``ref, cls``; ``classes`` the known ``cls``.
    """
    up = ancestors(superclass).select(F.col("src").alias("cls"), F.col("dst").alias("up")).unionByName(classes.select("cls", F.col("cls").alias("up")))
    good = up.join(allowed.select("ref", F.col("cls").alias("up")), "up").select("ref", "cls").distinct().withColumn("_ok", F.lit(True))
    known = lambda df, key, name: small(df.select(key).distinct().withColumn(name, F.lit(True)))
    j = entities.join(known(groups, "ref", "_group"), "ref", "left").join(known(allowed, "ref", "_list"), "ref", "left")
    j = j.join(known(classes, "cls", "_class"), "cls", "left").join(small(good), ["ref", "cls"], "left")
    verdict = (
        F.when(F.col("ref").isNull(), "no-reference").when(F.col("_group").isNull(), "unresolvable-group").when(F.col("_list").isNull(), "no-allow-list")
        .when(F.col("cls").isNull(), "no-class").when(F.col("_class").isNull(), "unresolvable-class").when(F.col("_ok"), "allowed").otherwise("violation")
    )
    return j.select("id", verdict.alias("verdict"))


def co_location(entities: DataFrame, files: DataFrame) -> DataFrame:
    """``id, verdict`` of entities ``(id, folder, ref)``: whether each is in the folder of the file that it refers
    to.  ``files`` has ``uid, basename, folder``: a reference is a uid, else a basename that only one file has."""
    by_uid = files.where("uid IS NOT NULL").groupBy(F.col("uid").alias("ref")).agg(F.min("folder").alias("_a"))
    by_name = files.groupBy(F.col("basename").alias("ref")).agg(F.count("*").alias("_n"), F.min("folder").alias("_b"))
    j = entities.join(by_uid, "ref", "left").join(by_name, "ref", "left")
    target = F.coalesce("_a", F.when(F.col("_n") == 1, F.col("_b")))
    verdict = (
        F.when(F.col("ref").isNull(), "no-reference").when(target.isNull() & (F.col("_n") > 1), "ambiguous").when(target.isNull(), "unresolved")
        .when(target == F.col("folder"), "ok").otherwise("misplaced")
    )
    return j.select("id", verdict.alias("verdict"))


def traceability(asked: DataFrame, used: DataFrame, floor: float = 0.0) -> DataFrame:
    """``kind, what, n``: requirements ``(tag, grp)`` that no text uses (``orphan``), tags in texts ``(tag, place)`` that no
    requirement asks for (``dangling``), tags of several requirements (``duplicate``), and each group's share of used
    ones in percent (``coverage``, or ``below-floor``)."""
    tags, there = asked.select("tag").distinct(), used.select("tag").distinct()
    none = F.lit(None).cast("double")
    orphan = tags.join(there, "tag", "left_anti").select(F.lit("orphan").alias("kind"), F.col("tag").alias("what"), none.alias("n"))
    dangling = there.join(tags, "tag", "left_anti").select(F.lit("dangling").alias("kind"), F.col("tag").alias("what"), none.alias("n"))
    doubled = asked.groupBy("tag").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate").alias("kind"), F.col("tag").alias("what"), F.col("n").cast("double"))
    hit = asked.select("grp", "tag").distinct().join(there.withColumn("hit", F.lit(1)), "tag", "left").groupBy("grp").agg((100.0 * F.count("hit") / F.count("*")).alias("n"))
    share = hit.select(F.when(F.col("n") < floor, "below-floor").otherwise("coverage").alias("kind"), F.col("grp").cast("string").alias("what"), F.round("n", 6).alias("n"))
    return orphan.unionByName(dangling).unionByName(doubled).unionByName(share)


def property_schema(definitions: DataFrame) -> DataFrame:
    """``property, type, required, options, pattern`` from long rows ``(property, key, value)``: the first type and pattern
    by name, whether any ``min_count`` is above zero, and the sorted ``option`` values, joined by ``|``."""
    one = lambda k: F.min(F.when(F.col("key") == k, F.col("value")))
    options = F.array_sort(F.collect_set(F.when(F.col("key") == "option", F.col("value"))))
    least = F.max(F.when(F.col("key") == "min_count", F.col("value").try_cast("int")))
    return definitions.groupBy("property").agg(
        one("range").alias("type"), (F.coalesce(least, F.lit(0)) > 0).alias("required"), F.array_join(options, "|").alias("options"), one("pattern").alias("pattern")
    )


def declared_ranges(declarations: DataFrame) -> DataFrame:
    """``key, ranges, conflict`` of declarations ``(key, range)``: each key's ranges, sorted and joined by ``|``; several are a conflict."""
    per = declarations.where("range IS NOT NULL").groupBy("key").agg(F.array_sort(F.collect_set("range")).alias("r"))
    return per.select("key", F.array_join("r", "|").alias("ranges"), (F.size("r") > 1).alias("conflict"))


def workflow_lint(states: DataFrame, moves: DataFrame) -> DataFrame:
    """``kind, what``: moves of unknown states, doubled moves, dead ends that are not terminal, terminals with a way out, a wrong number of initial states."""
    ends = moves.select(F.explode(F.array("source", "target")).alias("state"))
    unknown = ends.join(states, "state", "left_anti").distinct().select(F.lit("unknown").alias("kind"), F.col("state").alias("what"))
    doubled = moves.groupBy("source", "target").count().where("count > 1").select(F.lit("doubled"), F.concat_ws(">", "source", "target"))
    out = moves.select(F.col("source").alias("state")).distinct()
    dead = states.where("NOT terminal").join(out, "state", "left_anti").select(F.lit("dead-end"), "state")
    leak = states.where("terminal").join(out, "state", "left_semi").select(F.lit("terminal-with-exit"), "state")
    first = states.agg(F.sum(F.col("initial").cast("int")).alias("n")).where("n <> 1").select(F.lit("initial"), F.col("n").cast("string"))
    return unknown.union(doubled).union(dead).union(leak).union(first)


def run_checks(checks: dict, enabled: list[str]) -> DataFrame:
    """Findings of the enabled checks, each with its name; an unknown name is an error."""
    unknown = [c for c in enabled if c not in checks]
    if unknown:
        raise ValueError(f"no checks {unknown}")
    out = None
    for name in enabled:
        one = checks[name]().select(F.lit(name).alias("check_name"), F.to_json(F.struct("*")).alias("finding"))
        out = one if out is None else out.unionByName(one)
    return out

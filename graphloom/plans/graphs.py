"""Queries over paths, inference and graph analytics.

Graphs from the tables: the place tree (customer -> nation -> region), the binary tree of
parts (``k -> k div 2``), rings of five parts, and the links of orders to customers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import closure as C
from graphloom.operators import inference as I
from graphloom.operators import labels as L
from graphloom.plans.base import query, table
from graphloom.plans.patterns import with_t
from graphloom.sources.triples import load


def halves(spark, d):
    return table(spark, d, "part").where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))


HALVES = "e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1)"
UP = f"WITH RECURSIVE {HALVES}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) "


def rings(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("src"), F.expr("(p_partkey div 5) * 5 + (p_partkey + 1) % 5").alias("dst"))


RINGS = "e AS (SELECT p_partkey AS src, (p_partkey // 5) * 5 + (p_partkey + 1) % 5 AS dst FROM part)"
ROUND = f"WITH RECURSIVE {RINGS}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) "


def places(spark, d, *names):
    t = load(spark, d, *(names or ("customer", "nation")))
    return t.where("o_kind = 'iri' AND p <> 'rdf:type'").select(F.col("s").alias("src"), F.col("o").alias("dst"), "p")


@query("path_seq", "SELECT DISTINCT c_custkey AS src, r_name AS dst FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def path_seq(spark, d):
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    a = c.select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst"))
    b = C.seq(n.select(F.col("n_nationkey").alias("src"), F.col("n_regionkey").alias("dst")), r.select(F.col("r_regionkey").alias("src"), F.col("r_name").alias("dst")))
    return C.seq(a, b)


@query("path_alt", with_t("customer", "supplier") + "SELECT DISTINCT s AS src, o AS dst FROM t WHERE p IN ('c_nationkey', 's_nationkey')")
def path_alt(spark, d):
    e = places(spark, d, "customer", "supplier")
    return C.alt(e.where("p = 'c_nationkey'"), e.where("p = 's_nationkey'"))


@query("path_inv", "SELECT c_nationkey AS src, c_custkey AS dst FROM customer")
def path_inv(spark, d):
    return C.inverse(table(spark, d, "customer").select(F.col("c_custkey").alias("src"), F.col("c_nationkey").alias("dst")))


@query("path_opt", f"WITH {HALVES} SELECT src, dst FROM e UNION SELECT src, src FROM e UNION SELECT dst, dst FROM e")
def path_opt(spark, d):
    return C.maybe(halves(spark, d))


@query("path_plus", UP + "SELECT src, dst FROM r")
def path_plus(spark, d):
    return C.reach(halves(spark, d))


@query("path_plus_cycle", ROUND + "SELECT src, dst FROM r")
def path_plus_cycle(spark, d):
    return C.reach(rings(spark, d))


@query("path_star", UP + "SELECT src, dst FROM r UNION SELECT src, src FROM e UNION SELECT dst, dst FROM e")
def path_star(spark, d):
    return C.star(halves(spark, d))


@query("path_bound_end", UP + "SELECT src, dst FROM r WHERE src % 50 = 7")
def path_bound_end(spark, d):
    e = halves(spark, d)
    return C.plus(e, start=e.where("src % 50 = 7").select("src")).select("src", "dst")


@query("path_depth", f"WITH RECURSIVE {HALVES}, r AS (SELECT src, dst, 1 AS depth FROM e UNION ALL SELECT r.src, e.dst, depth + 1 FROM r JOIN e ON r.dst = e.src) SELECT src, dst, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY src, dst")
def path_depth(spark, d):
    return C.plus(halves(spark, d))


# --- inference --------------------------------------------------------------------------------------

#: Part types as classes: 'STANDARD TIN' below 'STANDARD' below 'Thing'.
CLASSES = "sup AS (SELECT DISTINCT 'brand/' || p_brand AS src, 'type/' || p_type AS dst FROM part UNION SELECT DISTINCT 'type/' || p_type, 'Thing' FROM part)"
CLASS_UP = f"WITH RECURSIVE {CLASSES}, up AS (SELECT src, dst FROM sup UNION SELECT up.src, sup.dst FROM up JOIN sup ON up.dst = sup.src) "


def superclasses(spark, d):
    p = table(spark, d, "part")
    return p.select(F.concat(F.lit("brand/"), "p_brand").alias("src"), F.concat(F.lit("type/"), "p_type").alias("dst")).unionByName(
        p.select(F.concat(F.lit("type/"), "p_type").alias("src"), F.lit("Thing").alias("dst"))
    ).distinct()


def part_types(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("part/"), "p_partkey").alias("s"), F.concat(F.lit("brand/"), "p_brand").alias("cls"))


@query("class_closure", CLASS_UP + "SELECT src, dst FROM up")
def class_closure(spark, d):
    return C.reach(superclasses(spark, d))


@query("infer_types", CLASS_UP + "SELECT DISTINCT 'part/' || p_partkey AS s, up.dst AS cls FROM part JOIN up ON up.src = 'brand/' || p_brand")
def infer_types(spark, d):
    return I.infer_types(part_types(spark, d), superclasses(spark, d))


@query("map_vocabulary", with_t("customer") + """
SELECT s, p, o FROM t UNION SELECT s, CASE p WHEN 'c_name' THEN 'rdfs:label' ELSE 'rdfs:isPartOf' END, o FROM t WHERE p IN ('c_name', 'c_nationkey')
UNION SELECT 'c_name', 'rdfs:subPropertyOf', 'rdfs:label' FROM customer""")
def map_vocabulary(spark, d):
    mapping = spark.createDataFrame([("c_name", "rdfs:label"), ("c_nationkey", "rdfs:isPartOf")], "p string, q string")
    fixed = spark.createDataFrame([("c_name", "rdfs:subPropertyOf", "rdfs:label")], "s string, p string, o string")
    return I.map_vocabulary(load(spark, d, "customer"), mapping, fixed)


@query("match_subproperty", with_t("customer", "supplier", "nation") + "SELECT DISTINCT s, o FROM t WHERE p IN ('c_name', 's_name', 'n_name')")
def match_subproperty(spark, d):
    sub = spark.createDataFrame([("c_name", "person_name"), ("s_name", "person_name"), ("person_name", "label"), ("n_name", "label")], "src string, dst string")
    return I.match_subproperty(load(spark, d, "customer", "supplier", "nation"), sub, "label")


@query("match_class_alias", "SELECT c_custkey, CASE WHEN n = 1 THEN 'nation/' || k ELSE n_name END AS place FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN (SELECT CASE WHEN n_nationkey < 6 THEN 'shared' ELSE n_name END AS nm, count(*) AS n, min(n_nationkey) AS k FROM nation GROUP BY 1) ON nm = n_name UNION ALL SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey < 6")
def match_class_alias(spark, d):
    n = table(spark, d, "nation")
    aliases = n.select(F.when(F.col("n_nationkey") < 6, "shared").otherwise(F.col("n_name")).alias("name"), F.concat(F.lit("nation/"), "n_nationkey").alias("id"))
    rows = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("place"))
    return I.resolve_alias(rows, "place", aliases)[0]


def proto(spark, d):
    """Parts whose prototype is part ``k div 4``; name for every tenth, brand for every third, tags for all."""
    p = table(spark, d, "part")
    links = p.where("p_partkey > 3").select(F.concat(F.lit("part/"), "p_partkey").alias("src"), F.concat(F.lit("part/"), F.expr("p_partkey div 4")).alias("dst"))
    s = F.concat(F.lit("part/"), "p_partkey").alias("s")
    t = p.where("p_partkey % 10 = 1").select(s, F.lit("name").alias("p"), F.col("p_name").alias("o")).unionByName(p.where("p_partkey % 3 = 0").select(s, F.lit("brand").alias("p"), F.col("p_brand").alias("o")))
    return t.unionByName(p.where("p_partkey % 7 = 2").select(s, F.lit("tag").alias("p"), F.col("p_type").alias("o"))), links


PROTO = ("WITH RECURSIVE l AS (SELECT p_partkey AS i, p_partkey // 4 AS j FROM part WHERE p_partkey > 3), ch AS (SELECT i, j, 1 AS depth FROM l UNION ALL SELECT ch.i, l.j, depth + 1 FROM ch JOIN l ON ch.j = l.i WHERE depth < 10), "
         "t AS (SELECT p_partkey AS k, 'name' AS p, p_name AS o FROM part WHERE p_partkey % 10 = 1 UNION ALL SELECT p_partkey, 'brand', p_brand FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, 'tag', p_type FROM part WHERE p_partkey % 7 = 2), "
         "f AS (SELECT ch.i AS k, t.p, t.o, min(depth) AS depth FROM ch JOIN t ON ch.j = t.k GROUP BY 1, 2, 3), "
         "n AS (SELECT * FROM (SELECT *, min(depth) OVER (PARTITION BY k, p) AS d FROM f) WHERE d = depth AND p <> 'tag'), "
         "inh AS (SELECT k, p, o, depth FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.k = n.k AND t.p = n.p) UNION ALL SELECT k, p, o, depth FROM f WHERE p = 'tag' AND NOT EXISTS (SELECT 1 FROM t WHERE t.k = f.k AND t.p = f.p AND t.o = f.o)) ")  # fmt: skip


@query("inherit_properties", PROTO + "SELECT 'part/' || k AS s, p, o, CAST(depth AS INTEGER) AS depth FROM inh WHERE p <> 'tag'")
def inherit_properties(spark, d):
    t, links = proto(spark, d)
    return I.inherit(t.where("p <> 'tag'"), links, [])


@query("inherit_multi", PROTO + "SELECT 'part/' || k AS s, p, o, CAST(depth AS INTEGER) AS depth FROM inh")
def inherit_multi(spark, d):
    t, links = proto(spark, d)
    return I.inherit(t, links, ["tag"])


@query("non_inheritable", PROTO + "SELECT 'part/' || k AS s, p, o, CAST(depth AS INTEGER) AS depth FROM inh WHERE p <> 'brand'")
def non_inheritable(spark, d):
    t, links = proto(spark, d)
    return I.inherit(t, links, ["tag"], barred=["brand"])


@query("annotate_source", PROTO + "SELECT 'part/' || k AS s, p, o, 'own' AS source, 0 AS depth FROM t UNION ALL SELECT 'part/' || k, p, o, 'inherited', CAST(depth AS INTEGER) FROM inh")
def annotate_source(spark, d):
    t, links = proto(spark, d)
    return I.annotate(t, I.inherit(t, links, ["tag"]))


@query("own_only", PROTO + "SELECT 'part/' || k AS s, p, o FROM t")
def own_only(spark, d):
    t, links = proto(spark, d)
    inferred = I.inherit(t, links, ["tag"])
    every = t.unionByName(inferred.select("s", "p", "o"))
    return every.join(inferred.select("s", "p", "o"), ["s", "p", "o"], "left_anti")


@query("inference_pipeline", CLASS_UP.replace("WITH RECURSIVE ", PROTO.rstrip() + ", ") + "SELECT 'part/' || k AS s, p, o FROM inh UNION ALL SELECT DISTINCT 'part/' || p_partkey, 'rdf:type', up.dst FROM part JOIN up ON up.src = 'brand/' || p_brand")
def inference_pipeline(spark, d):
    t, links = proto(spark, d)
    types = I.infer_types(part_types(spark, d), superclasses(spark, d)).select("s", F.lit("rdf:type").alias("p"), F.col("cls").alias("o"))
    return types.unionByName(I.inherit(t, links, ["tag"]).select("s", "p", "o"))


@query("class_ancestors_list", UP + """
SELECT src, coalesce(string_agg(CAST(dst AS VARCHAR), '>' ORDER BY dst DESC) || '>', '') || 'Thing' AS ancestors
FROM (SELECT src, dst FROM r UNION ALL SELECT 1, NULL) GROUP BY src""")
def class_ancestors_list(spark, d):
    return C.ancestor_lists(halves(spark, d), "Thing")


@query("subsumed_keys", CLASS_UP + "SELECT DISTINCT 'brand/' || p_brand AS cls FROM part WHERE p_type LIKE 'S%'")
def subsumed_keys(spark, d):
    up = C.reach(superclasses(spark, d))
    return up.where(F.col("dst").startswith("type/S") & F.col("src").startswith("brand/")).select(F.col("src").alias("cls")).distinct()


@query("subsumed_by_labels", """
WITH RECURSIVE e AS (SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1 UNION SELECT p_partkey, p_partkey - 3 FROM part WHERE p_partkey % 50 = 0),
b AS (SELECT src, dst FROM e WHERE dst IN (2, 13, 47, 97) UNION SELECT e.src, b.dst FROM b JOIN e ON e.dst = b.src)
SELECT dst AS top, CAST(count(*) AS BIGINT) AS n, CAST(sum(src) AS BIGINT) AS keys FROM b GROUP BY 1""")
def subsumed_by_labels(spark, d):
    """What is below some nodes of a hierarchy with cross edges, by interval labels."""
    p = table(spark, d, "part")
    cross = p.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("src"), (F.col("p_partkey") - 3).alias("dst"))
    tops = spark.createDataFrame([(2,), (13,), (47,), (97,)], "node long")
    found = L.below(L.labelled(C.alt(halves(spark, d), cross)), tops)
    return found.groupBy(F.col("dst").alias("top")).agg(F.count("*").alias("n"), F.sum("src").alias("keys"))


# --- analytics --------------------------------------------------------------------------------------


@query("graph_nodes", "SELECT DISTINCT 'customer/' || c_custkey AS node FROM customer WHERE c_mktsegment <> 'MACHINERY' ORDER BY node LIMIT 40 OFFSET 5")
def graph_nodes(spark, d):
    t = load(spark, d, "customer")
    gone = t.where("p = 'c_mktsegment' AND o = 'MACHINERY'").select("s")
    return t.where("p = 'rdf:type' AND o = 'class/Customer'").join(gone, "s", "left_anti").select(F.col("s").alias("node")).distinct().orderBy("node").offset(5).limit(40)


KIND_EDGES = """
k AS (
  SELECT 'nation/' || n_nationkey AS src, 'region/' || n_regionkey AS dst, 'n_regionkey' AS p, 'hierarchy' AS kind FROM nation WHERE n_nationkey < 15
  UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 's_nationkey', 'semantic' FROM supplier WHERE s_nationkey < 15
  UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey, 'c_nationkey', 'forward-link' FROM customer WHERE c_nationkey < 15
  UNION ALL SELECT 'nation/' || c_nationkey, 'customer/' || c_custkey, 'c_nationkey', 'backlink' FROM customer WHERE c_nationkey < 15
  UNION ALL SELECT 'customer/' || c_custkey, 'customer/' || (c_custkey // 2), 'model', 'prototype' FROM customer WHERE c_custkey // 2 <> c_custkey
    AND c_custkey // 2 IN (SELECT c_custkey FROM customer)
)"""


def kind_edges(spark, d):
    t = load(spark, d, "region", "nation", "customer", "supplier")
    number = F.regexp_extract("s", r"^nation/(\d+)$", 1).try_cast("int")
    nodes = t.where(F.coalesce(number < 15, F.lit(True))).select(F.col("s").alias("node")).distinct()
    model = table(spark, d, "customer").select(F.concat(F.lit("customer/"), "c_custkey").alias("s"), F.lit("model").alias("p"), F.concat(F.lit("customer/"), F.expr("c_custkey div 2")).alias("o"), F.lit("iri").alias("o_kind"))
    kinds = {"n_regionkey": "hierarchy", "model": "prototype", "s_nationkey": "semantic"}
    return C.typed_edges(t.select("s", "p", "o", "o_kind").unionByName(model), nodes, kinds)


@query("graph_edges", f"WITH {KIND_EDGES} SELECT src, dst, p, kind FROM k")
def graph_edges(spark, d):
    return kind_edges(spark, d)


@query("degree_profile", f"""WITH {KIND_EDGES}
SELECT 'kind' AS "by", kind AS value, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY 2
UNION ALL SELECT 'class', CASE split_part(node, '/', 1) WHEN 'customer' THEN 'class/Customer' WHEN 'nation' THEN 'class/Nation' WHEN 'region' THEN 'class/Region' ELSE 'class/Supplier' END,
  CAST(count(*) AS BIGINT) FROM (SELECT src AS node FROM k UNION ALL SELECT dst FROM k) GROUP BY 2""")
def degree_profile(spark, d):
    types = load(spark, d, "region", "nation", "customer", "supplier").where("p = 'rdf:type'").select(F.col("s").alias("node"), F.col("o").alias("cls"))
    return C.degree_profile(kind_edges(spark, d), types)


@query("degree_stats", "WITH e AS (SELECT 'customer/' || c_custkey AS src, 'nation/' || c_nationkey AS dst FROM customer UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation) SELECT node, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(count(*) AS BIGINT) AS weight FROM (SELECT src AS node, 0 AS i, 1 AS o FROM e UNION ALL SELECT dst, 1, 0 FROM e) GROUP BY node")
def degree_stats(spark, d):
    return C.degrees(places(spark, d))


@query("neighbours", "WITH e AS (SELECT 'customer/' || c_custkey AS src, 'nation/' || c_nationkey AS dst FROM customer UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation) SELECT src, dst FROM e UNION SELECT dst, src FROM e")
def neighbours(spark, d):
    e = places(spark, d)
    return C.alt(e, C.inverse(e))


@query("khop", f"""
WITH RECURSIVE {HALVES}, b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), r AS (
  SELECT src, dst, 1 AS depth FROM b WHERE src IN (SELECT p_partkey FROM part WHERE p_size = 3)
  UNION SELECT r.src, b.dst, depth + 1 FROM r JOIN b ON r.dst = b.src WHERE depth < 2)
SELECT src, dst, CAST(min(depth) AS INTEGER) AS depth FROM r WHERE src <> dst GROUP BY 1, 2""")
def khop(spark, d):
    return C.khop(halves(spark, d), table(spark, d, "part").where("p_size = 3").select(F.col("p_partkey").alias("src")), 2)


@query("filter_types", "SELECT 'customer/' || c_custkey AS src, 'nation/' || c_nationkey AS dst FROM customer")
def filter_types(spark, d):
    t = load(spark, d, "customer", "nation", "supplier")
    sub = spark.createDataFrame([("class/Customer", "class/Party"), ("class/Supplier", "class/Party"), ("class/Supplier", "class/Vendor")], "src string, dst string")
    up = C.reach(sub)
    cls = t.where("p = 'rdf:type'").select(F.col("s").alias("src"), F.col("o").alias("cls"))
    of = lambda c: cls.join(up.where(F.col("dst") == c).select(F.col("src").alias("cls")), "cls", "left_semi").select("src")
    e = t.where("o_kind = 'iri' AND p <> 'rdf:type'").select(F.col("s").alias("src"), F.col("o").alias("dst"))
    return e.join(of("class/Party"), "src", "left_semi").join(of("class/Vendor"), "src", "left_anti")


@query("scc", f"WITH RECURSIVE {RINGS}, r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT n AS node, least(n, coalesce((SELECT min(a.dst) FROM r a JOIN r b ON a.src = b.dst AND a.dst = b.src WHERE a.src = n), n)) AS component FROM (SELECT src AS n FROM e UNION SELECT dst FROM e)")
def scc(spark, d):
    return C.scc(rings(spark, d))


@query("transitive_closure", ROUND + "SELECT src, CAST(count(*) AS BIGINT) AS reach FROM r GROUP BY src")
def transitive_closure(spark, d):
    return C.reach(rings(spark, d)).groupBy("src").agg(F.count("*").alias("reach"))


@query("condense", "SELECT DISTINCT (p_partkey // 5) * 5 AS src, (p_partkey // 10) * 5 AS dst FROM part WHERE (p_partkey // 5) * 5 <> (p_partkey // 10) * 5")
def condense(spark, d):
    p = table(spark, d, "part")
    e = p.select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    ends = e.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    members = ends.withColumn("component", F.expr("(node div 5) * 5"))
    joined = C.condense(e, members)
    return joined


@query("transitive_reduction", f"WITH {HALVES} SELECT src, dst FROM e")
def transitive_reduction(spark, d):
    e = halves(spark, d)
    return C.reduction(C.alt(e, C.seq(e, e)))


@query("hierarchy_tree", "SELECT 'customer/' || c_custkey AS node, 2 AS depth, r_name || ' / ' || n_name || ' / ' || c_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'nation/' || n_nationkey, 1, r_name || ' / ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'region/' || r_regionkey, 0, r_name FROM region")
def hierarchy_tree(spark, d):
    t = load(spark, d, "region", "nation", "customer")
    label = t.where("p IN ('r_name', 'n_name', 'c_name')").select(F.col("s").alias("node"), F.col("o").alias("label"))
    roots = t.where("p = 'rdf:type' AND o = 'class/Region'").select(F.col("s").alias("node"))
    return C.tree(t.where("o_kind = 'iri' AND p <> 'rdf:type'").select(F.col("s").alias("src"), F.col("o").alias("dst")), roots, label)


@query("clone_subtree", UP + """
, x AS (SELECT src, src // 2 AS up FROM r WHERE dst = 5 UNION ALL SELECT 5, NULL)
SELECT md5('run1/' || src) AS node, src AS origin, md5('run1/' || up) AS parent, p_type AS cls, p_name || ' for Ann {{who}}' AS label FROM x JOIN part ON p_partkey = src""")
def clone_subtree(spark, d):
    p = table(spark, d, "part")
    labels = p.select(F.col("p_partkey").alias("node"), F.concat("p_type", F.lit("Prototype")).alias("cls"), F.concat("p_name", F.lit(" for {{name}} {{who}}")).alias("label"))
    return C.clone_subtree(halves(spark, d), p.where("p_partkey = 5").select(F.col("p_partkey").alias("node")), labels, "run1", {"name": "Ann"}, "Prototype")


@query("backlinks", """
WITH l AS (SELECT 'customer/' || c_custkey AS src, 'nation/' || c_nationkey AS dst, 'c_nationkey' AS p FROM customer UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 's_nationkey' FROM supplier),
b AS (SELECT 'customer/' || c_custkey AS src, 'nation/' || c_nationkey AS dst FROM customer WHERE c_acctbal < 0 UNION SELECT 'customer/' || c_custkey, 'nation/' || (c_nationkey // 2) FROM customer WHERE c_mktsegment = 'BUILDING')
SELECT dst AS target, src, p, FALSE AS body FROM l UNION ALL SELECT dst, src, NULL, TRUE FROM b WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.src = b.src AND l.dst = b.dst)""")
def backlinks(spark, d):
    t = load(spark, d, "customer", "supplier").where("o_kind = 'iri' AND p <> 'rdf:type'")
    c = table(spark, d, "customer").withColumn("src", F.concat(F.lit("customer/"), "c_custkey"))
    body = c.where("c_acctbal < 0").select("src", F.concat(F.lit("nation/"), "c_nationkey").alias("dst"))
    body = body.union(c.where("c_mktsegment = 'BUILDING'").select("src", F.concat(F.lit("nation/"), F.expr("c_nationkey div 2")).alias("dst")))
    return C.backlinks(t.select(F.col("s").alias("src"), F.col("o").alias("dst"), "p"), body)


STATEMENTS = "st AS (SELECT o_orderkey AS stmt, 'customer/' || o_custkey AS s, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'placed' END AS p, 'order/' || o_orderkey AS o FROM orders)"


def statements(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("stmt"), F.concat(F.lit("customer/"), "o_custkey").alias("s"), F.expr("if(o_orderkey % 7 = 0, null, 'placed')").alias("p"), F.concat(F.lit("order/"), "o_orderkey").alias("o"))
    return o.select("stmt", F.explode(F.map_from_arrays(F.array(F.lit("subject"), F.lit("predicate"), F.lit("object")), F.array("s", "p", "o"))).alias("role", "term"))


def reified(spark, d):
    wide = statements(spark, d).where("term IS NOT NULL").groupBy("stmt").pivot("role", ["subject", "predicate", "object"]).agg(F.first("term")).dropna()
    out = wide.select(F.col("subject").alias("src"), F.col("predicate").alias("p"), F.col("object").alias("dst"), F.lit("out").alias("way"))
    return out.unionByName(wide.where("subject <> object").select(F.col("object").alias("src"), F.col("predicate").alias("p"), F.col("subject").alias("dst"), F.lit("in").alias("way")))


@query("reified_relations", f"WITH {STATEMENTS} SELECT s AS src, p, o AS dst, 'out' AS way FROM st WHERE p IS NOT NULL UNION ALL SELECT o, p, s, 'in' FROM st WHERE p IS NOT NULL AND s <> o")
def reified_relations(spark, d):
    return reified(spark, d)


@query("merge_relations", f"WITH {STATEMENTS}, i AS (SELECT s, p, o FROM st WHERE stmt % 3 = 0 AND p IS NOT NULL) SELECT s, p, o, 'inline' AS source FROM i UNION ALL SELECT s, p, o, 'reified' FROM st WHERE p IS NOT NULL AND stmt % 3 <> 0")
def merge_relations(spark, d):
    r = reified(spark, d).where("way = 'out'").select(F.col("src").alias("s"), "p", F.col("dst").alias("o"))
    inline = r.where(F.regexp_extract("o", r"(\d+)$", 1).cast("long") % 3 == 0)
    return inline.withColumn("source", F.lit("inline")).unionByName(r.join(inline, ["s", "p", "o"], "left_anti").withColumn("source", F.lit("reified")))

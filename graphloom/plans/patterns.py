"""Queries over scans, filters, patterns, joins, sets and forms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import patterns as P
from graphloom.operators.closure import small
from graphloom.plans.base import query, table
from graphloom.sources import text as X
from graphloom.sources.triples import load, load_sql, match


def with_t(*names: str) -> str:
    return f"WITH t AS ({load_sql(*names)}) "


# --- scans ---------------------------------------------------------------------------------------


@query("scan_match", with_t("customer", "nation") + "SELECT 'p' AS k, s, p, o FROM t WHERE p = 'c_mktsegment' UNION ALL SELECT 's', s, p, o FROM t WHERE s = 'customer/7' "
       "UNION ALL SELECT 'o', s, p, o FROM t WHERE o = 'nation/3' UNION ALL SELECT 'spo', s, p, o FROM t WHERE s = 'nation/1' AND p = 'n_regionkey' AND o = 'region/1'")  # fmt: skip
def scan_match(spark, d):
    t = load(spark, d, "customer", "nation")
    parts = {"p": match(t, p="c_mktsegment"), "s": match(t, s="customer/7"), "o": match(t, o="nation/3"), "spo": match(t, "nation/1", "n_regionkey", "region/1")}
    return P.union(*[x.select(F.lit(k).alias("k"), "s", "p", "o") for k, x in parts.items()], all=True)


@query("scan_graph", with_t("customer", "nation") + "SELECT s, p, o FROM t WHERE g = 'graph/nation'")
def scan_graph(spark, d):
    return match(load(spark, d, "customer", "nation"), g="graph/nation").select("s", "p", "o")


@query("graph_var", with_t("customer", "nation", "supplier") + "SELECT g, s FROM t WHERE p = 'rdf:type' AND g IS NOT NULL AND s LIKE '%/1'")
def graph_var(spark, d):
    t = load(spark, d, "customer", "nation", "supplier").where("g IS NOT NULL")
    return match(t, p="rdf:type").where(F.col("s").endswith("/1")).select("g", "s")


@query("list_terms", with_t("customer", "nation") + "SELECT g, p, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT s) AS BIGINT) AS subjects, CAST(count(DISTINCT o) AS BIGINT) AS objects FROM t GROUP BY g, p")
def list_terms(spark, d):
    t = load(spark, d, "customer", "nation")
    return t.groupBy("g", "p").agg(F.count("*").alias("n"), F.countDistinct("s").alias("subjects"), F.countDistinct("o").alias("objects"))


@query("table_to_triples", load_sql("region", "nation", "supplier"))
def table_to_triples(spark, d):
    return load(spark, d, "region", "nation", "supplier")


@query("predicate_profile", with_t("customer", "orders") + "SELECT p, CAST(count(*) AS BIGINT) AS n, round(count(*) * 1.0 / (SELECT count(*) FROM t), 6) AS share, p IN ('c_mktsegment', 'o_custkey') AS needed FROM t GROUP BY p")
def predicate_profile(spark, d):
    n = load(spark, d, "customer", "orders").groupBy("p").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.crossJoin(F.broadcast(total)).select("p", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), F.col("p").isin("c_mktsegment", "o_custkey").alias("needed"))


UUID_OF = "regexp_replace(md5(coalesce(text, '')), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5')"


@query("lookup_by_uuid", f"""
WITH s AS (SELECT 'https://id.example/' || source || '/' || upper({UUID_OF}) || '#doc' AS s, lower({UUID_OF}) AS uid, doc_id FROM documents)
SELECT s, uid FROM s WHERE uid IN (SELECT uid FROM s WHERE doc_id % 97 = 0)""")
def lookup_by_uuid(spark, d):
    uuid = F.regexp_replace(F.md5(F.coalesce("text", F.lit(""))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("https://id.example/"), "source", F.lit("/"), F.upper(uuid), F.lit("#doc")).alias("s"), uuid.alias("uuid"))
    return P.lookup_by_uuid(docs.select("s"), docs.where("doc_id % 97 = 0").select("uuid")).select("s", "uid")


@query("extract_links", "SELECT page_id, unnest(regexp_extract_all(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', '', 'g'), 'href=\"([^\"#]*)', 1)) AS target FROM pages")
def extract_links(spark, d):
    bare = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", "")
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all(bare, F.lit('href="([^"#]*)'), F.lit(1))).alias("target"))


@query("extract_wikilinks", """
SELECT c_custkey, 0 AS pos, 'n' || c_nationkey AS target FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, 1, c_mktsegment FROM customer WHERE c_custkey % 3 <> 0
UNION ALL SELECT c_custkey, 2, 'end' FROM customer WHERE c_custkey % 3 = 1""")
def extract_wikilinks(spark, d):
    """Notes on customers: an alias, an embed with an anchor, links in fences (some never end), a link to the note itself."""
    n, fence = F.col("c_custkey"), F.when(F.col("c_custkey") % 3 == 0, "~~~~").when(F.col("c_custkey") % 3 == 1, "```").otherwise("````")
    top = F.when(n % 3 == 0, F.lit("  ~~~~ sql\n")).otherwise(F.lit(""))
    body = F.concat(top, F.lit("See [[n"), "c_nationkey", F.lit("|a nation]] and ![["), "c_mktsegment", F.lit("#top]] [[#here]]\n"), fence, F.lit("\n[[code]]\n```\n"), F.lit("[[end]]"))
    body = F.when(n % 3 == 0, F.replace(body, F.lit("~~~~\n[[code]]"), F.lit("~~~\n[[code]]"))).otherwise(body)
    return X.wikilinks(table(spark, d, "customer").select("c_custkey", body.alias("text")), "c_custkey", "text")


@query("rewrite_links", """
WITH r AS (SELECT n_name AS old, 'place ' || n_nationkey AS new FROM nation WHERE n_nationkey % 2 = 0), c AS (
  SELECT c_custkey AS id, n_name AS a, c_name AS b FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT id, 'See [[' || coalesce(new, a) || CASE WHEN new IS NULL THEN '|there' ELSE '' END || ']] and [[' || coalesce(new, a) || '#Top' || CASE WHEN new IS NULL THEN '|x' ELSE '' END || ']], `[['
       || a || ']]` ![[' || a || ']] [[' || b || '^k]]!' AS text, CAST(CASE WHEN new IS NULL THEN 0 ELSE 2 END AS BIGINT) AS n
FROM c LEFT JOIN r ON r.old = a""")
def rewrite_links(spark, d):
    from graphloom.sources.text import rewrite_links as rewritten

    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    text = F.format_string("See [[%s|there]] and [[%s#Top|x]], `[[%s]]` ![[%s]] [[%s^k]]!", "n_name", "n_name", "n_name", "n_name", "c_name")
    renames = n.where("n_nationkey % 2 = 0").select(F.col("n_name").alias("old"), F.concat(F.lit("place "), "n_nationkey").alias("new"))
    return rewritten(c.select(F.col("c_custkey").alias("id"), text.alias("text")), renames)


@query("exclude_paths", "SELECT page_id, url FROM pages WHERE NOT (starts_with(url, 'http://t') OR starts_with(url, 'https://m.'))")
def exclude_paths(spark, d):
    out = F.broadcast(spark.createDataFrame([("http://t",), ("https://m.",)], "prefix string"))
    return table(spark, d, "pages").join(out, F.col("url").startswith(F.col("prefix")), "left_anti").select("page_id", "url")


@query("canonicalize_ids", with_t("customer", "nation") + ", m AS (SELECT 'nation/' || n_nationkey AS short, 'https://id.example/nation/' || lower(n_name) AS full_id FROM nation) "
       "SELECT coalesce(a.full_id, t.s) AS s, t.p, coalesce(b.full_id, t.o) AS o FROM t LEFT JOIN m a ON t.s = a.short LEFT JOIN m b ON t.o = b.short AND t.o_kind = 'iri'")  # fmt: skip
def canonicalize_ids(spark, d):
    t = load(spark, d, "customer", "nation")
    m = table(spark, d, "nation").select(F.concat(F.lit("nation/"), "n_nationkey").alias("short"), F.concat(F.lit("https://id.example/nation/"), F.lower("n_name")).alias("full_id"))
    a, b = m.select(F.col("short").alias("sa"), F.col("full_id").alias("fa")), m.select(F.col("short").alias("sb"), F.col("full_id").alias("fb"))
    j = t.join(a, t.s == a.sa, "left").join(b, (t.o == b.sb) & (t.o_kind == "iri"), "left")
    return j.select(F.coalesce("fa", "s").alias("s"), "p", F.coalesce("fb", "o").alias("o"))


@query("usage_rollup", "SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS tokens, CAST(count(*) AS BIGINT) AS turns, round(sum(length(text)) * 15 / 1000000.0, 6) AS cost FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def usage_rollup(spark, d):
    c = table(spark, d, "conversations").where("role = 'assistant'").groupBy("conv_id").agg(F.sum(F.length("text")).alias("tokens"), F.count("*").alias("turns"))
    return c.withColumn("cost", F.round(F.col("tokens") * 15 / F.lit(1000000.0), 6))


# --- projection, filter, bind ----------------------------------------------------------------------


@query("project", with_t("customer") + "SELECT s, o AS segment FROM t WHERE p = 'c_mktsegment'")
def project(spark, d):
    return P.pattern(load(spark, d, "customer"), "?s", "c_mktsegment", "?segment").select("s", "segment")


@query("filter", with_t("customer") + "SELECT s, o_num AS bal FROM t WHERE p = 'c_acctbal' AND o_num > 5000")
def filter_(spark, d):
    return P.pattern(load(spark, d, "customer"), "?s", "c_acctbal", "?bal:num").where("bal > 5000")


@query("compare", with_t("orders") + "SELECT s, p, o FROM t WHERE (p = 'o_totalprice' AND o_num >= 200000) OR (p = 'o_orderdate' AND o_ts < TIMESTAMP '1993-01-01') OR (p = 'o_orderpriority' AND o <> '1-URGENT' AND o < '3')")
def compare(spark, d):
    t = load(spark, d, "orders")
    return t.where(
        ((F.col("p") == "o_totalprice") & (F.col("o_num") >= 200000))
        | ((F.col("p") == "o_orderdate") & (F.col("o_ts") < F.lit("1993-01-01").cast("timestamp")))
        | ((F.col("p") == "o_orderpriority") & (F.col("o") != "1-URGENT") & (F.col("o") < "3"))
    ).select("s", "p", "o")


@query("logical", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 150000) AND NOT (o_orderpriority = '5-LOW')")
def logical(spark, d):
    return table(spark, d, "orders").where(((F.col("o_orderstatus") == "F") | (F.col("o_totalprice") > 150000)) & ~(F.col("o_orderpriority") == "5-LOW")).select("o_orderkey")


@query("in_list", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)")
def in_list(spark, d):
    return table(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY") & ~F.col("c_nationkey").isin(1, 2, 3)).select("c_custkey")


@query("bind", with_t("customer") + "SELECT s, bal, CASE WHEN bal <> 0 THEN round(100 / bal, 6) END AS per FROM (SELECT s, o_num AS bal FROM t WHERE p = 'c_acctbal')")
def bind(spark, d):
    return P.pattern(load(spark, d, "customer"), "?s", "c_acctbal", "?bal:num").withColumn("per", F.round(F.try_divide(F.lit(100), "bal"), 6))


@query("values_inline", "SELECT c_custkey, c_mktsegment AS seg, c_nationkey AS nat FROM customer WHERE (c_mktsegment = 'BUILDING' AND c_nationkey = 4) OR c_mktsegment = 'FURNITURE' OR c_nationkey = 7 AND c_mktsegment = 'MACHINERY'")
def values_inline(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nat"))
    given = F.broadcast(spark.createDataFrame([("BUILDING", 4), ("FURNITURE", None), ("MACHINERY", 7)], "seg string, nat int"))
    return P.join_compat(rows, given, ["nat"]).select("c_custkey", "seg", "nat")


@query("if_coalesce", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'owes' WHEN c_acctbal < 1000 THEN 'low' ELSE 'fine' END AS band, coalesce(CASE WHEN c_acctbal > 9000 THEN c_name END, c_mktsegment) AS tag FROM customer")
def if_coalesce(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.when(b < 0, "owes").when(b < 1000, "low").otherwise("fine").alias("band"), F.coalesce(F.when(b > 9000, F.col("c_name")), "c_mktsegment").alias("tag"))


@query("arith", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 4) AS charge, round(CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END, 4) AS unit FROM lineitem WHERE l_quantity - 1 < 2")
def arith(spark, d):
    e = F.col("l_extendedprice")
    return table(spark, d, "lineitem").where("l_quantity - 1 < 2").select("l_orderkey", "l_linenumber", F.round(e * (1 - F.col("l_discount")) * (1 + F.col("l_tax")), 4).alias("charge"), F.round(F.try_divide(e, "l_quantity"), 4).alias("unit"))


@query("bound", "SELECT c_custkey, max(o_orderkey) IS NOT NULL AS has_order FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def bound(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderkey").alias("k")), "c_custkey", "left").select("c_custkey", F.col("k").isNotNull().alias("has_order"))


@query("ebv", with_t("customer", "part") + "SELECT s, p, CASE WHEN o_dt IN ('xsd:integer', 'xsd:decimal') THEN o_num <> 0 ELSE o <> '' END AS truth FROM t WHERE p IN ('c_acctbal', 'p_size', 'c_name')")
def ebv(spark, d):
    from graphloom.functions.terms import ebv as truth

    return load(spark, d, "customer", "part").where(F.col("p").isin("c_acctbal", "p_size", "c_name")).select("s", "p", truth().alias("truth"))


@query("layout_query", with_t("part") + "SELECT c.s AS id, n.o AS name, z.o_num AS size, r.o AS brand FROM t c LEFT JOIN t n ON n.s = c.s AND n.p = 'p_name' LEFT JOIN t z ON z.s = c.s AND z.p = 'p_size' LEFT JOIN t r ON r.s = c.s AND r.p = 'p_brand' "
       "WHERE c.p = 'rdf:type' AND c.o = 'class/Part' AND z.o_num >= 20 AND r.o LIKE '%2%' AND n.o IS NOT NULL ORDER BY z.o_num DESC, c.s LIMIT 50 OFFSET 10")  # fmt: skip
def layout_query(spark, d):
    return P.layout_query(load(spark, d, "part"), "class/Part", {"name": "p_name", "size": "p_size:num", "brand": "p_brand"}, [("size", "gte", 20), ("brand", "contains", "2"), ("name", "isNotNull")], ["-size", "id"], 10, 50)


@query("precondition_flags", "SELECT c_custkey, c_acctbal > 0 AS paid, n > 0 AS active, (c_acctbal > 0 AND n > 0) OR NOT (c_mktsegment = 'BUILDING') AS ok FROM (SELECT c_custkey, c_acctbal, c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)")
def precondition_flags(spark, d):
    from graphloom.operators.domain import preconditions

    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, d, "customer").join(n, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    flags = {"paid": F.col("c_acctbal") > 0, "active": F.col("n") > 0, "building": F.col("c_mktsegment") == "BUILDING"}
    return preconditions(rows, flags, {"ok": ("or", ("and", "paid", "active"), ("not", "building"))}).select("c_custkey", "paid", "active", "ok")


# --- patterns and joins ------------------------------------------------------------------------------


@query("join_compat", """
WITH l AS (SELECT c_custkey AS c, CASE WHEN c_acctbal < -990 THEN NULL ELSE c_nationkey END AS n FROM customer),
r AS (SELECT CASE WHEN s_acctbal < -900 THEN NULL ELSE s_nationkey END AS n, s_suppkey AS k FROM supplier)
SELECT l.c, coalesce(l.n, r.n) AS n, r.k FROM l JOIN r ON l.n = r.n
UNION ALL SELECT l.c, coalesce(l.n, r.n), r.k FROM l JOIN r ON l.n IS NULL OR r.n IS NULL""")
def join_compat(spark, d):
    left = table(spark, d, "customer").select(F.col("c_custkey").alias("c"), F.expr("if(c_acctbal < -990, null, c_nationkey)").alias("n"))
    right = table(spark, d, "supplier").select(F.expr("if(s_acctbal < -900, null, s_nationkey)").alias("n"), F.col("s_suppkey").alias("k"))
    return P.join_compat(left, right, ["n"]).select("c", "n", "k")


@query("bgp_star", with_t("customer") + "SELECT a.s AS c, a.o AS name, b.o AS segment, x.o_num AS bal FROM t a JOIN t b ON a.s = b.s JOIN t x ON a.s = x.s WHERE a.p = 'c_name' AND b.p = 'c_mktsegment' AND x.p = 'c_acctbal'")
def bgp_star(spark, d):
    return P.bgp(load(spark, d, "customer"), [("?c", "c_name", "?name"), ("?c", "c_mktsegment", "?segment"), ("?c", "c_acctbal", "?bal:num")])


@query("bgp_chain", "SELECT r_name AS region, CAST(count(DISTINCT c_custkey) AS BIGINT) AS customers, CAST(count(*) AS BIGINT) AS urgent, round(sum(o_totalprice), 2) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey "
       "JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT' GROUP BY r_name")  # fmt: skip
def bgp_chain(spark, d):
    t = load(spark, d, "region", "nation", "customer", "orders")
    chain = [("?o", "o_orderpriority", "1-URGENT"), ("?o", "o_totalprice", "?price:num"), ("?o", "o_custkey", "?c"), ("?c", "c_nationkey", "?n"), ("?n", "n_regionkey", "?r"), ("?r", "r_name", "?region")]
    return P.bgp(t, chain).groupBy("region").agg(F.countDistinct("c").alias("customers"), F.count("*").alias("urgent"), F.round(F.sum("price"), 2).alias("revenue"))


@query("cross_join", "SELECT r_name, c_custkey FROM region, customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey <> r_regionkey")
def cross_join(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return P.join(c, small(table(spark, d, "region"))).where("n_regionkey <> r_regionkey").select("r_name", "c_custkey")


@query("optional", with_t("customer") + "SELECT a.s AS c, a.o AS segment, b.o_num AS bal FROM t a LEFT JOIN t b ON a.s = b.s AND b.p = 'c_acctbal' AND b.o_num < 0 WHERE a.p = 'c_mktsegment'")
def optional(spark, d):
    t = load(spark, d, "customer")
    return P.optional(P.pattern(t, "?c", "c_mktsegment", "?segment"), P.pattern(t, "?c", "c_acctbal", "?bal:num"), F.col("bal") < 0)


@query("optional_cross", "SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT n_name FROM nation WHERE n_name LIKE '%U%') ON TRUE")
def optional_cross(spark, d):
    return P.optional(table(spark, d, "customer").select("c_custkey"), small(table(spark, d, "nation").where("n_name LIKE '%U%'").select("n_name")))


@query("exists", "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 20 * c.c_acctbal)")
def exists(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, (o.o_custkey == c.c_custkey) & (o.o_totalprice > 20 * c.c_acctbal), "left_semi").select("c_custkey")


@query("not_exists", "SELECT 'customer/' || c_custkey AS c FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def not_exists(spark, d):
    t = load(spark, d, "customer", "orders")
    return P.exists(P.pattern(t, "?c", "rdf:type", "class/Customer"), P.bgp(t, [("?o", "o_custkey", "?c"), ("?o", "o_orderstatus", "P")]), negated=True)


@query("minus", """
WITH l AS (SELECT o_custkey AS n, CASE WHEN o_totalprice < 50000 THEN NULL ELSE o_orderpriority END AS seg, o_orderkey AS c FROM orders),
r AS (SELECT DISTINCT o_custkey AS n, CASE WHEN o_totalprice > 300000 THEN NULL ELSE o_orderpriority END AS seg FROM orders WHERE o_orderstatus = 'P')
SELECT n, seg, c FROM l WHERE NOT EXISTS (SELECT 1 FROM r WHERE l.n = r.n AND (l.seg = r.seg OR l.seg IS NULL OR r.seg IS NULL))""")
def minus(spark, d):
    o = table(spark, d, "orders").withColumn("n", F.col("o_custkey"))
    left = o.select("n", F.expr("if(o_totalprice < 50000, null, o_orderpriority)").alias("seg"), F.col("o_orderkey").alias("c"))
    right = o.where("o_orderstatus = 'P'").select("n", F.expr("if(o_totalprice > 300000, null, o_orderpriority)").alias("seg"))
    return P.minus(left, right, nullable=["seg"]).select("n", "seg", "c")


@query("subquery", "SELECT n_name, top.c_custkey, top.c_acctbal FROM (SELECT * FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20) top JOIN nation ON n_nationkey = top.c_nationkey")
def subquery(spark, d):
    top = table(spark, d, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(20)
    return top.join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "c_custkey", "c_acctbal")


@query("lateral_topn", "SELECT n_nationkey, c_custkey, c_acctbal FROM (SELECT c_nationkey AS n_nationkey, c_custkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) WHERE k <= 3")
def lateral_topn(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").withColumn("k", F.row_number().over(w)).where("k <= 3").select(F.col("c_nationkey").alias("n_nationkey"), "c_custkey", "c_acctbal")


@query("join_var_predicate", with_t("customer") + "SELECT t.s, t.p, t.o FROM t JOIN (SELECT DISTINCT p FROM t WHERE s = 'customer/1' AND o_kind = 'iri') q ON t.p = q.p")
def join_var_predicate(spark, d):
    t = load(spark, d, "customer")
    return P.join(P.pattern(t, "?s", "?p", "?o"), match(t, s="customer/1").where("o_kind = 'iri'").select("p").distinct()).select("s", "p", "o")


@query("quoted_match", "SELECT o_orderkey AS stmt, 'customer/' || o_custkey AS s, o_orderdate AS at FROM orders WHERE o_custkey % 10 = 1")
def quoted_match(spark, d):
    quoted = F.struct(F.concat(F.lit("order/"), "o_orderkey").alias("s"), F.lit("o_custkey").alias("p"), F.concat(F.lit("customer/"), "o_custkey").alias("o"))
    st = table(spark, d, "orders").select(F.col("o_orderkey").alias("stmt"), quoted.alias("q"), F.col("o_orderdate").alias("at"))
    wanted = table(spark, d, "customer").where("c_custkey % 10 = 1").select(F.concat(F.lit("customer/"), "c_custkey").alias("o"))
    return st.join(wanted, st.q.o == wanted.o).where("q.p = 'o_custkey'").select("stmt", F.col("q.o").alias("s"), "at")


@query("overlap_join", "WITH i AS (SELECT o_orderkey AS k, o_custkey AS c, o_orderdate AS a, o_orderdate + INTERVAL 40 DAY AS b FROM orders) SELECT x.k AS k1, y.k AS k2 FROM i x JOIN i y ON x.c = y.c AND x.k < y.k AND x.a < y.b AND y.a < x.b")
def overlap_join(spark, d):
    from graphloom.operators.domain import overlaps

    i = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.col("o_orderdate").alias("a"), (F.col("o_orderdate") + F.expr("INTERVAL 40 DAY")).alias("b"))
    return overlaps(i, "k", "a", "b", by=["c"]).select("k1", "k2")


@query("overlap_long", """
WITH i AS (SELECT p_partkey AS k, p_size % 5 AS c, TIMESTAMP '1990-01-01' + INTERVAL (p_partkey * 37 % 9000) DAY AS a,
  TIMESTAMP '1990-01-01' + INTERVAL (p_partkey * 37 % 9000) DAY + INTERVAL (CASE WHEN p_partkey % 40 = 0 THEN 480000 WHEN p_partkey % 7 = 0 THEN 900 ELSE p_partkey % 30 END) HOUR AS b FROM part)
SELECT x.k AS k1, y.k AS k2 FROM i x JOIN i y ON x.c = y.c AND x.k < y.k AND x.a < y.b AND y.a < x.b AND x.a < x.b AND y.a < y.b""")
def overlap_long(spark, d):
    """Intervals of hours, weeks and half a century, in few groups."""
    from graphloom.operators.domain import overlaps

    a = F.expr("timestamp'1990-01-01' + make_dt_interval(cast(p_partkey * 37 % 9000 as int))")
    hours = F.expr("cast(CASE WHEN p_partkey % 40 = 0 THEN 480000 WHEN p_partkey % 7 = 0 THEN 900 ELSE p_partkey % 30 END as int)")
    i = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.expr("p_size % 5").alias("c"), a.alias("a"), hours.alias("h"))
    i = i.withColumn("b", F.expr("a + make_dt_interval(0, h)"))
    return overlaps(i, "k", "a", "b", by=["c"], hot=200).select("k1", "k2")


# --- order, slice, sets ------------------------------------------------------------------------------


@query("order_by", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC NULLS FIRST, c_custkey")
def order_by(spark, d):
    return table(spark, d, "customer").orderBy(F.col("c_mktsegment").asc_nulls_last(), F.col("c_acctbal").desc_nulls_first(), "c_custkey").select("c_custkey", "c_acctbal")


@query("slice", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def slice_(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(10).limit(25).select("o_orderkey")


@query("distinct", "SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct(spark, d):
    return table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query("union", "SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS status FROM customer UNION SELECT s_nationkey, NULL, 'supplies' FROM supplier")
def union(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    return P.union(a, table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.lit("supplies").alias("status")))


@query("answers_equal", "WITH a AS (SELECT c_nationkey AS n, c_mktsegment AS m FROM customer), b AS (SELECT c_nationkey AS n, c_mktsegment AS m FROM customer WHERE c_custkey % 50 <> 0) SELECT *, 'left' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'right' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)")
def answers_equal(spark, d):
    a = table(spark, d, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("m"), "c_custkey")
    return P.answers_equal(a.select("n", "m"), a.where("c_custkey % 50 <> 0").select("n", "m"))


@query("sort_priority", """
SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderstatus = 'P', o_orderstatus = 'F', o_totalprice DESC, o_orderdate, o_orderkey) AS BIGINT) AS place FROM orders""")
def sort_priority(spark, d):
    from graphloom.operators.domain import places

    keys = [F.col("o_orderstatus") == "P", F.col("o_orderstatus") == "F", F.desc("o_totalprice"), "o_orderdate", "o_orderkey"]
    return places(table(spark, d, "orders"), keys).select("o_orderkey", "place")


@query("sort_time_null_last", """
SELECT event_id, strftime(ts, '%H:%M:%S') AS clock, CAST(row_number() OVER (ORDER BY clock = '00:00:00', clock, event_id) AS BIGINT) AS place FROM events""")
def sort_time_null_last(spark, d):
    from graphloom.operators.domain import places

    e = table(spark, d, "events").select("event_id", F.date_format("ts", "HH:mm:ss").alias("clock"))
    return places(e, [F.col("clock") == "00:00:00", "clock", "event_id"])


# --- forms and updates --------------------------------------------------------------------------------


@query("ask", "SELECT count(*) > 0 AS answer FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000")
def ask(spark, d):
    return P.ask(table(spark, d, "orders").where("o_orderpriority = '1-URGENT' AND o_totalprice > 100000"))


@query("construct", with_t("customer", "nation") + "SELECT DISTINCT a.s, 'livesIn' AS p, b.o AS o FROM t a JOIN t b ON a.o = b.s WHERE a.p = 'c_nationkey' AND b.p = 'n_name' UNION SELECT DISTINCT b.o, 'hasResident', a.s FROM t a JOIN t b ON a.o = b.s WHERE a.p = 'c_nationkey' AND b.p = 'n_name'")
def construct(spark, d):
    t = load(spark, d, "customer", "nation")
    return P.construct(P.bgp(t, [("?c", "c_nationkey", "?n"), ("?n", "n_name", "?name")]), [("?c", "livesIn", "?name"), ("?name", "hasResident", "?c")])


@query("describe", with_t("region", "nation", "supplier") + "SELECT DISTINCT s, p, o, o_kind FROM t WHERE s = 'nation/5' OR o = 'nation/5' OR s IN (SELECT s FROM t WHERE o = 'nation/5') OR s IN (SELECT o FROM t WHERE s = 'nation/5') "
       "OR (o_kind = 'iri' AND o IN (SELECT s FROM t WHERE o = 'nation/5' UNION SELECT o FROM t WHERE s = 'nation/5' AND o_kind = 'iri'))")  # fmt: skip
def describe(spark, d):
    t = load(spark, d, "region", "nation", "supplier")
    return P.describe(t, match(t, s="nation/5").select(F.col("s").alias("r")), depth=2)


@query("insert_data", with_t("customer") + """
SELECT s, p, o FROM t UNION SELECT 'customer/' || c_custkey, 'seen', 'yes' FROM customer WHERE c_acctbal < 0 UNION SELECT s, p, o FROM t WHERE s = 'customer/1'""")
def insert_data(spark, d):
    t = load(spark, d, "customer").select("s", "p", "o")
    new = table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("customer/"), "c_custkey").alias("s"), F.lit("seen").alias("p"), F.lit("yes").alias("o"))
    return P.insert_data(t, new.unionByName(t.where("s = 'customer/1'")))


@query("delete_data", with_t("customer") + """
SELECT s, p, o FROM t WHERE NOT (p = 'c_name' AND s IN (SELECT 'customer/' || c_custkey FROM customer WHERE c_acctbal < 0))""")
def delete_data(spark, d):
    t = load(spark, d, "customer").select("s", "p", "o")
    gone = table(spark, d, "customer").where("c_acctbal < 0").select(F.concat(F.lit("customer/"), "c_custkey").alias("s"), F.lit("c_name").alias("p"), F.col("c_name").alias("o"))
    return P.delete_data(t, gone)


@query("named_template", "SELECT 'by_status' AS template, o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'by_date', o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1995-03-01' AND o_orderdate < TIMESTAMP '1995-03-15' "
       "UNION ALL SELECT 'active', o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 400000 UNION ALL SELECT 'by_domain', o_orderkey FROM orders WHERE o_orderpriority LIKE '1-%' "
       "UNION ALL SELECT 'per_day', min(o_orderkey) FROM orders GROUP BY CAST(o_orderdate AS DATE) HAVING count(*) >= 3")
def named_template(spark, d):
    from graphloom.plans.templates import run

    orders = table(spark, d, "orders")
    a = run(spark, "by_status", orders, status="P")
    more = {"by_date": {"first": "1995-03-01", "to": "1995-03-15"}, "active": {"status": "O", "least": "400000"}, "by_domain": {"prefix": "1-"}, "per_day": {"least": "3"}}
    for name, params in more.items():
        a = a.unionByName(run(spark, name, orders, **params))
    return a


@query("query_batch", "SELECT 'segments' AS name, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT c_mktsegment FROM customer) UNION ALL SELECT 'negative', count(*) FROM customer WHERE c_acctbal < 0")
def query_batch(spark, d):
    t = load(spark, d, "customer")
    batch = {"segments": P.pattern(t, "?s", "c_mktsegment", "?x").select("x").distinct(), "negative": P.pattern(t, "?s", "c_acctbal", "?b:num").where("b < 0")}
    return P.union(*[q.agg(F.count("*").alias("n")).select(F.lit(k).alias("name"), "n") for k, q in batch.items()], all=True)


@query("alias_find", "SELECT DISTINCT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey IN (3, 5)")
def alias_find(spark, d):
    fragments = spark.createDataFrame([("c_mktsegment", "BUILDING"), ("c_nationkey", "nation/3"), ("c_nationkey", "nation/5")], "p string, o string")
    t = load(spark, d, "customer")
    return t.join(F.broadcast(fragments), ["p", "o"], "left_semi").select(F.regexp_extract("s", r"(\d+)$", 1).cast("long").alias("c_custkey")).distinct()

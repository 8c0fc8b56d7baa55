"""Queries over shapes, audits, snapshots and domain rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphloom.operators import closure as C
from graphloom.operators import domain as W

from graphloom.operators import shapes as V
from graphloom.operators import snapshots as S
from graphloom.plans.base import query, table
from graphloom.plans.graphs import CLASS_UP, HALVES, UP, halves, part_types, superclasses
from graphloom.plans.patterns import with_t
from graphloom.sources.triples import load

# --- shapes: customers and orders, with faults planted by key ------------------------------------------


def data(spark, d):
    """Customers' triples with faults: every 11th lacks a segment, every 13th has two, every 17th a bad balance, every 19th points to a region."""
    t = load(spark, d, "customer", "nation", "region").select("s", "p", "o", "o_kind", "o_dt")
    k = F.regexp_extract("s", r"^customer/(\d+)$", 1).try_cast("long")
    seg, bal, nat = (F.col("p") == c for c in ("c_mktsegment", "c_acctbal", "c_nationkey"))
    t = t.withColumn("k", k).where(~(seg & F.coalesce(F.col("k") % 11 == 0, F.lit(False))))
    t = t.withColumn("o_dt", F.when(~(bal & F.coalesce(F.col("k") % 17 == 0, F.lit(False))), F.col("o_dt")))  # a text, no number
    t = t.withColumn("o", F.when(bal & (F.col("k") % 17 == 0), "n/a").when(nat & (F.col("k") % 19 == 0), "region/1").otherwise(F.col("o")))
    more = t.where(seg & (F.col("k") % 13 == 0)).withColumn("o", F.lit("EXTRA"))
    return t.unionByName(more).drop("k")


DATA = (with_t("customer", "nation", "region").rstrip() + ", k AS (SELECT s, p, o, o_kind, TRY_CAST(regexp_extract(s, '^customer/(\\d+)$', 1) AS BIGINT) AS k FROM t), "
        "x AS (SELECT s, p, CASE WHEN p = 'c_acctbal' AND k % 17 = 0 THEN 'n/a' WHEN p = 'c_nationkey' AND k % 19 = 0 THEN 'region/1' ELSE o END AS o, o_kind, k FROM k WHERE NOT (p = 'c_mktsegment' AND coalesce(k % 11 = 0, FALSE))), "
        "y AS (SELECT * FROM x UNION ALL SELECT s, p, 'EXTRA', o_kind, k FROM x WHERE p = 'c_mktsegment' AND k % 13 = 0) ")  # fmt: skip
#: The shapes' definitions.
DEFINITIONS = [
    ("c_mktsegment", "domain", "class/Customer"), ("c_mktsegment", "range", "xsd:string"), ("c_mktsegment", "cardinality", "Single"), ("c_mktsegment", "min_count", "1"),
    ("c_acctbal", "domain", "class/Customer"), ("c_acctbal", "range", "xsd:decimal"), ("c_acctbal", "severity", "Warning"),
    ("c_nationkey", "domain", "class/Party"), ("c_nationkey", "range", "class/Nation"), ("c_nationkey", "min_count", "1"),
    ("r_name", "range", "xsd:string"),
]


def shapes(spark):
    return V.load_shapes(spark.createDataFrame(DEFINITIONS, "property string, key string, value string"))


def party(spark):
    return spark.createDataFrame([("class/Customer", "class/Party")], "src string, dst string")


def typed(t):
    return t.where("p = 'rdf:type'").select("s", F.col("o").alias("cls"))


FINDINGS = {
    "min_count": "SELECT 'customer/' || c_custkey AS s, 'c_mktsegment' AS property, 'min_count' AS \"check\", 'Violation' AS severity FROM customer WHERE c_custkey % 11 = 0",
    "max_count": "SELECT DISTINCT s, 'c_mktsegment' AS property, 'max_count' AS \"check\", 'Violation' AS severity FROM y WHERE o = 'EXTRA'",
    "class_range": "SELECT 'customer/' || c_custkey AS s, 'c_nationkey' AS property, 'class_range' AS \"check\", 'Violation' AS severity FROM customer WHERE c_custkey % 19 = 0",
    "datatype_range": "SELECT 'customer/' || c_custkey AS s, 'c_acctbal' AS property, 'datatype_range' AS \"check\", 'Warning' AS severity FROM customer WHERE c_custkey % 17 = 0",
    "unknown_property": "SELECT DISTINCT s, p AS property, 'unknown_property' AS \"check\", 'Warning' AS severity FROM y WHERE p NOT IN ('rdf:type', 'c_mktsegment', 'c_acctbal', 'c_nationkey')",
}


@query("load_shapes", "SELECT p AS property, 1 AS n FROM (SELECT DISTINCT p FROM (" "SELECT 'c_acctbal' AS p FROM customer UNION ALL SELECT 'c_mktsegment' FROM customer UNION ALL SELECT 'c_nationkey' FROM customer))")
def load_shapes(spark, d):
    used = data(spark, d).select(F.col("p").alias("property")).distinct()
    return shapes(spark).join(used, "property", "left_semi").select("property", F.size("domains").alias("n"))


@query("applicable_shapes", "SELECT 'customer/' || c_custkey AS s, unnest(['c_mktsegment', 'c_acctbal', 'c_nationkey']) AS property FROM customer")
def applicable_shapes(spark, d):
    return V.applicable(typed(data(spark, d)), shapes(spark), party(spark))


def finding(name):
    @query("property_min_count" if name == "min_count" else name, DATA + FINDINGS[name])
    def run(spark, d):
        t, sh = data(spark, d), shapes(spark)
        if name in ("min_count", "max_count"):
            return getattr(V, name)(V.counts(t, V.applicable(typed(t), sh, party(spark))), sh)
        return {"class_range": lambda: V.class_range(t, sh, typed(t), party(spark)), "datatype_range": lambda: V.datatype_range(t, sh), "unknown_property": lambda: V.unknown_property(t, sh)}[name]()


for _name in FINDINGS:
    finding(_name)


@query("report", DATA + " UNION ALL ".join(f"({x})" for x in FINDINGS.values()))
def report(spark, d):
    t = data(spark, d)
    return V.report(t, shapes(spark), typed(t), party(spark))


@query("conforms", DATA + "SELECT FALSE AS conforms, CAST(count(*) AS BIGINT) AS findings FROM (" + " UNION ALL ".join(f"({x})" for x in FINDINGS.values()) + ")")
def conforms(spark, d):
    t = data(spark, d)
    return V.conforms(V.report(t, shapes(spark), typed(t), party(spark)))


# --- audits -------------------------------------------------------------------------------------------

ASSETS = "a AS (SELECT 'notes/' || c_nationkey || '/' || c_name AS path, 'u' || (c_custkey - CASE WHEN c_custkey % 20 = 3 THEN 1 ELSE 0 END) AS uid, c_mktsegment AS cls, c_custkey AS k FROM customer)"


def assets(spark, d):
    return table(spark, d, "customer").select(
        F.concat_ws("/", F.lit("notes"), "c_nationkey", "c_name").alias("path"), F.expr("concat('u', c_custkey - if(c_custkey % 20 = 3, 1, 0))").alias("uid"), F.col("c_mktsegment").alias("cls"), F.col("c_custkey").alias("k")
    )


@query("uid_unique", f"WITH {ASSETS}, b AS (SELECT * FROM a WHERE cls <> 'BUILDING') SELECT uid, path, CAST(n AS BIGINT) AS n FROM b JOIN (SELECT uid, count(*) AS n FROM b GROUP BY uid HAVING count(*) > 1) USING (uid)")
def uid_unique(spark, d):
    return V.uid_unique(assets(spark, d), ["BUILDING"])


@query("plan_uid_fix", f"WITH {ASSETS} SELECT path, uid, md5('fix/' || path) AS new_uid FROM a QUALIFY row_number() OVER (PARTITION BY uid ORDER BY path) > 1")
def plan_uid_fix(spark, d):
    return V.plan_uid_fix(assets(spark, d), "fix").select("path", "uid", "new_uid")


@query("co_location", """
WITH f AS (SELECT 'u' || n_nationkey AS uid, CASE WHEN n_nationkey IN (7, 8) THEN 'TWIN' ELSE n_name END AS basename, 'r' || n_regionkey AS folder FROM nation),
x AS (SELECT c_custkey AS id, 'r' || (c_nationkey % 5) AS folder,
  CASE WHEN c_acctbal < 0 THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 'u' || c_nationkey WHEN c_mktsegment = 'MACHINERY' THEN 'nobody'
       ELSE (SELECT basename FROM f WHERE uid = 'u' || c_nationkey) END AS ref FROM customer),
n AS (SELECT basename, count(*) AS k, min(folder) AS folder FROM f GROUP BY 1)
SELECT id, CASE WHEN ref IS NULL THEN 'no-reference' WHEN f.uid IS NULL AND k > 1 THEN 'ambiguous' WHEN f.uid IS NULL AND k IS NULL THEN 'unresolved'
  WHEN coalesce(f.folder, n.folder) = x.folder THEN 'ok' ELSE 'misplaced' END AS verdict
FROM x LEFT JOIN f ON f.uid = ref LEFT JOIN n ON n.basename = ref""")
def co_location(spark, d):
    n = table(spark, d, "nation")
    files = n.select(F.concat(F.lit("u"), "n_nationkey").alias("uid"), F.expr("if(n_nationkey in (7, 8), 'TWIN', n_name)").alias("basename"), F.concat(F.lit("r"), "n_regionkey").alias("folder"))
    c = table(spark, d, "customer").withColumn("uid", F.concat(F.lit("u"), "c_nationkey")).join(files.select("uid", "basename"), "uid", "left")
    ref = F.expr("case when c_acctbal < 0 then null when c_mktsegment = 'BUILDING' then uid when c_mktsegment = 'MACHINERY' then 'nobody' else basename end")
    return V.co_location(c.select(F.col("c_custkey").alias("id"), F.concat(F.lit("r"), F.expr("c_nationkey % 5")).alias("folder"), ref.alias("ref")), files)


@query("term_collision", "SELECT p_name AS term, CAST(count(DISTINCT p_partkey) AS BIGINT) AS entities, CAST(min(p_partkey) AS BIGINT) AS first FROM part GROUP BY 1 HAVING count(DISTINCT p_partkey) >= 2")
def term_collision(spark, d):
    return V.term_collision(table(spark, d, "part").select(F.col("p_name").alias("term"), F.col("p_partkey").alias("s")))


AUDITED = """
WITH RECURSIVE i AS (SELECT 'r1' AS src, 'r2' AS dst UNION ALL SELECT 'r2', 'r3'),
up AS (SELECT src, dst FROM i UNION SELECT up.src, i.dst FROM up JOIN i ON up.dst = i.src),
f AS (SELECT 'n' || n_nationkey AS path, CASE WHEN n_nationkey IN (7, 8) THEN 'twin' ELSE n_name END AS name, CASE WHEN n_nationkey = 9 THEN NULL ELSE 'r' || n_regionkey END AS grp FROM nation),
l AS (SELECT 'n' || c_nationkey AS src, CASE c_custkey % 6 WHEN 0 THEN 'pic.png' WHEN 1 THEN 'twin' WHEN 2 THEN 'nowhere' ELSE (SELECT name FROM f WHERE path = 'n' || (c_custkey % 25)) END AS name FROM customer),
m AS (SELECT name, count(*) AS n, min(grp) AS tg FROM f GROUP BY 1),
a AS (
  SELECT l.src, f.grp, tg AS target_grp, CASE WHEN regexp_matches(l.name, '\\.(png|jpg|pdf|js|css)$') THEN 'non-markdown' WHEN n > 1 THEN 'ambiguous' WHEN n IS NULL THEN 'broken'
    WHEN f.grp IS NULL OR tg IS NULL THEN 'no-group' WHEN f.grp = tg THEN 'internal' WHEN up.src IS NOT NULL THEN 'valid' ELSE 'violation' END AS bucket
  FROM l LEFT JOIN m ON m.name = l.name LEFT JOIN f ON f.path = l.src LEFT JOIN up ON up.src = f.grp AND up.dst = tg
)
"""


def audited(spark, d):
    n = table(spark, d, "nation")
    files = n.select(F.concat(F.lit("n"), "n_nationkey").alias("path"), F.expr("if(n_nationkey in (7, 8), 'twin', n_name)").alias("name"), F.expr("if(n_nationkey = 9, null, concat('r', n_regionkey))").alias("grp"))
    names = files.select(F.col("path").alias("to"), F.col("name").alias("target"))
    c = table(spark, d, "customer").withColumn("to", F.concat(F.lit("n"), F.expr("c_custkey % 25"))).join(names, "to", "left")
    links = c.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.expr("case c_custkey % 6 when 0 then 'pic.png' when 1 then 'twin' when 2 then 'nowhere' else target end").alias("name"))
    imports = spark.createDataFrame([("r1", "r2"), ("r2", "r3")], "src string, dst string")
    return V.imports_audit(links, files, imports)


@query("imports_audit", AUDITED + "SELECT bucket, CAST(count(*) AS BIGINT) AS n FROM a GROUP BY 1")
def imports_audit(spark, d):
    return audited(spark, d).groupBy("bucket").agg(F.count("*").alias("n"))


@query("import_pairs", AUDITED + """
SELECT grp, target_grp, CAST(count(*) AS BIGINT) AS occurrences, min(bucket) = 'valid' AS valid,
  CASE WHEN min(bucket) = 'valid' THEN [] ELSE list_sort(list(DISTINCT src))[1:3] END AS examples
FROM a WHERE bucket IN ('valid', 'violation') GROUP BY 1, 2""")
def import_pairs(spark, d):
    return V.import_pairs(C.cut(audited(spark, d)))


@query("import_groups", AUDITED + """
, p AS (SELECT grp, target_grp, count(*) FILTER (bucket = 'internal') AS i, count(*) FILTER (bucket <> 'internal') AS x, count(*) FILTER (bucket = 'violation') AS v
        FROM a WHERE bucket IN ('internal', 'valid', 'violation') GROUP BY 1, 2)
SELECT grp, CAST(sum(i) AS BIGINT) AS internal, CAST(sum(o) AS BIGINT) AS links_out, CAST(sum(n) AS BIGINT) AS links_in, CAST(sum(v) AS BIGINT) AS violating,
  CAST(count(*) FILTER (o > 0) AS BIGINT) AS out_degree, CAST(count(*) FILTER (n > 0) AS BIGINT) AS in_degree
FROM (SELECT grp, i, x AS o, 0 AS n, v FROM p UNION ALL SELECT target_grp, 0, 0, x, 0 FROM p) GROUP BY 1""")
def import_groups(spark, d):
    return V.import_groups(audited(spark, d))


@query("declared_cycles", """
SELECT 'cycle' AS kind, (p_partkey // 5) * 5 AS component, CAST(count(*) AS BIGINT) AS members FROM part GROUP BY 2 HAVING count(*) = 5
UNION ALL SELECT 'self-import', p_partkey, 1 FROM part WHERE p_size = 50
UNION ALL SELECT 'duplicate-uid', p_size, CAST(count(*) AS BIGINT) FROM part WHERE p_size < 3 GROUP BY p_size HAVING count(*) > 1""")
def declared_cycles(spark, d):
    p = table(spark, d, "part")
    ring = p.select(F.col("p_partkey").alias("src"), F.expr("(p_partkey div 5) * 5 + (p_partkey + 1) % 5").alias("dst"))
    own = p.where("p_size = 50").select(F.col("p_partkey").alias("src"), F.col("p_partkey").alias("dst"))
    uids = p.where("p_size < 3").select(F.col("p_size").cast("long").alias("uid"), F.col("p_partkey").alias("node"))
    return V.declared_cycles(ring.unionByName(own), uids)


@query("propose_imports", f"""
WITH {HALVES} SELECT src, dst, 'add' AS kind FROM e WHERE src % 3 <> 0
UNION ALL SELECT dst, src, 'conflict' FROM e WHERE src % 24 = 12""")
def propose_imports(spark, d):
    e = halves(spark, d)
    declared = e.where("src % 3 = 0")
    back = C.inverse(e.where("src % 24 = 12"))
    return V.propose_imports(C.alt(e.where("src % 24 <> 12"), C.seq(e, e), back), declared)


@query("membership_audit", """
SELECT c_custkey AS id, CASE WHEN c_acctbal < 0 THEN 'no-reference' WHEN c_acctbal < 1000 THEN 'unresolvable-group' WHEN n_regionkey = 4 THEN 'no-allow-list'
  WHEN c_acctbal < 2000 THEN 'no-class' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'unresolvable-class' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'allowed'
  WHEN c_mktsegment = 'AUTOMOBILE' AND n_regionkey = 0 THEN 'allowed' ELSE 'violation' END AS verdict
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def membership_audit(spark, d):
    n = table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("r"), "n_regionkey").alias("region"))
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    entities = c.select(
        F.col("c_custkey").alias("id"), F.expr("case when c_acctbal < 0 then null when c_acctbal < 1000 then 'r99' else region end").alias("ref"),
        F.expr("if(c_acctbal < 2000, null, c_mktsegment)").alias("cls"),
    )
    groups = n.select(F.col("region").alias("ref")).distinct()
    allowed = groups.where("ref <> 'r4'").withColumn("cls", F.lit("Hard")).unionByName(spark.createDataFrame([("r0", "AUTOMOBILE")], "ref string, cls string"))
    up = spark.createDataFrame([("BUILDING", "Hard"), ("MACHINERY", "Heavy"), ("Heavy", "Hard"), ("FURNITURE", "Soft")], "src string, dst string")
    classes = spark.createDataFrame([(x,) for x in ("BUILDING", "MACHINERY", "FURNITURE", "AUTOMOBILE", "Hard", "Heavy", "Soft")], "cls string")
    return V.membership_audit(entities, groups, allowed, classes, up)


@query("dependency_coverage", f"{UP}SELECT DISTINCT src, dst, 'indirect' AS verdict FROM r WHERE src // 4 = dst AND src // 4 > 0 UNION ALL SELECT 1, p_partkey, 'uncovered' FROM part WHERE p_partkey > 1 AND p_partkey % 100 = 0")
def dependency_coverage(spark, d):
    e = halves(spark, d)
    facts = e.where("src > 3").select("src", F.expr("src div 4").alias("dst")).unionByName(e.where("src % 100 = 0").select(F.lit(1).cast("long").alias("src"), F.col("src").alias("dst")))
    return V.dependency_coverage(facts, e)


@query("url_form", """
WITH u AS (SELECT page_id, CASE page_id % 5 WHEN 0 THEN url || '#' WHEN 1 THEN url || '#part' WHEN 2 THEN url || '//' WHEN 3 THEN 'no url' ELSE url END AS url FROM pages),
h AS (SELECT *, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host FROM u),
v AS (SELECT *, CASE WHEN host = '' THEN 'unparsable' WHEN host NOT LIKE '%.example.com' THEN 'foreign' WHEN url LIKE '%#' THEN 'ok' ELSE 'no-hash' END AS verdict FROM h)
SELECT page_id, verdict, CASE WHEN verdict = 'no-hash' THEN rtrim(url, '/') || '#' END AS expected FROM v""")
def url_form(spark, d):
    url = F.expr("CASE page_id % 5 WHEN 0 THEN url || '#' WHEN 1 THEN url || '#part' WHEN 2 THEN url || '//' WHEN 3 THEN 'no url' ELSE url END")
    return V.url_form(table(spark, d, "pages").select("page_id", url.alias("url")), "url", r".*\.example\.com").select("page_id", "verdict", "expected")


@query("broken_links", "WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"#]*)', 1)) AS target FROM pages) SELECT page_id, target FROM l WHERE target NOT IN (SELECT '/' || lower(p_name) FROM part) AND target NOT IN (SELECT '/' || split_part(text, ' ', 1) FROM documents WHERE lang = 'en')")
def broken_links(spark, d):
    links = table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"#]*)'), F.lit(1))).alias("target"))
    known = table(spark, d, "part").select(F.concat(F.lit("/"), F.lower("p_name")).alias("target")).unionByName(
        table(spark, d, "documents").where("lang = 'en'").select(F.concat(F.lit("/"), F.split_part("text", F.lit(" "), F.lit(1))).alias("target"))
    )
    return links.join(known.distinct(), "target", "left_anti").select("page_id", "target")


@query("unknown_keys", "SELECT DISTINCT event_id, k AS key FROM (SELECT event_id, unnest(json_keys(props)) AS k FROM events) WHERE k NOT IN ('page', 'ref')")
def unknown_keys(spark, d):
    e = table(spark, d, "events").select("event_id", F.explode(F.json_object_keys("props")).alias("key"))
    known = F.broadcast(spark.createDataFrame([("page",), ("ref",)], "key string"))
    return e.join(known, "key", "left_anti").select("event_id", "key").distinct()


@query("nearest_keys", """
WITH n AS (SELECT DISTINCT 'part__' || replace(p_type, ' ', '') AS name FROM part WHERE p_partkey % 3 <> 0),
k AS (SELECT DISTINCT CASE WHEN p_partkey % 50 = 0 THEN 'other__' || p_brand ELSE 'part__' || replace(p_type, ' ', '') || repeat('x', CAST(p_size % 3 AS INT)) END AS key FROM part),
u AS (SELECT key, key LIKE 'part__%' AS known FROM k WHERE key NOT IN (SELECT name FROM n)),
o AS (SELECT key, name, levenshtein(key, name) AS distance FROM u JOIN n ON known WHERE levenshtein(key, name) <= greatest(3, floor(length(key) * 0.4))),
r AS (SELECT key, list(name ORDER BY distance, name)[1:3] AS nearest FROM o GROUP BY 1)
SELECT u.key, CASE WHEN known THEN 'unknown-name' ELSE 'unknown-prefix' END AS reason, coalesce(nearest, []) AS nearest FROM u LEFT JOIN r USING (key)""")
def nearest_keys(spark, d):
    p = table(spark, d, "part")
    own = F.concat(F.lit("part__"), F.replace("p_type", F.lit(" "), F.lit("")))
    used = p.select(F.when(F.col("p_partkey") % 50 == 0, F.concat(F.lit("other__"), "p_brand")).otherwise(F.concat(own, F.expr("repeat('x', cast(p_size % 3 as int))"))).alias("key"))
    return V.unknown_keys(used.unionByName(used.limit(1).select(F.lit("tags").alias("key"))), p.where("p_partkey % 3 <> 0").select(own.alias("name")))


@query("required_fields", "SELECT 'customer/' || c_custkey AS s, unnest(['c_mktsegment', 'c_nationkey']) AS property FROM customer")
def required_fields(spark, d):
    sh = shapes(spark)
    return V.applicable(typed(data(spark, d)), sh.where("min_count > 0"), party(spark))


@query("property_schema", """
SELECT property, type, required, options, pattern FROM (
  SELECT 'c_mktsegment' AS property, 'xsd:string' AS type, TRUE AS required, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS options, CAST(NULL AS VARCHAR) AS pattern FROM customer
  UNION ALL SELECT 'c_acctbal', 'xsd:decimal', FALSE, '', '^-?[0-9.]+$' UNION ALL SELECT 'c_nationkey', 'class/Nation', TRUE, '', NULL UNION ALL SELECT 'r_name', 'xsd:string', FALSE, '', NULL)""")
def property_schema(spark, d):
    options = table(spark, d, "customer").select(F.lit("c_mktsegment").alias("property"), F.lit("option").alias("key"), F.col("c_mktsegment").alias("value")).distinct()
    fixed = spark.createDataFrame([*DEFINITIONS, ("c_acctbal", "pattern", "^-?[0-9.]+$")], "property string, key string, value string")
    return V.property_schema(fixed.unionByName(options))


@query("declared_ranges", """
SELECT p_brand AS key, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS ranges, count(DISTINCT p_type) > 1 AS conflict FROM part WHERE p_size > 45 GROUP BY 1""")
def declared_ranges(spark, d):
    return V.declared_ranges(table(spark, d, "part").select(F.col("p_brand").alias("key"), F.when(F.col("p_size") > 45, F.col("p_type")).alias("range")))


@query("enum_values", """
SELECT p_partkey, p_name, CASE WHEN p_size < 10 THEN p_size END AS rank, CAST(row_number() OVER (ORDER BY rank NULLS LAST, p_partkey) AS BIGINT) AS place
FROM part WHERE p_type LIKE '%S%'""")
def enum_values(spark, d):
    rank = table(spark, d, "part").where("p_size < 10").select("p_partkey", F.col("p_size").alias("rank"))
    rows = table(spark, d, "part").where("p_type LIKE '%S%'").join(rank, "p_partkey", "left").select("p_partkey", "p_name", "rank")
    return W.places(rows, [F.col("rank").asc_nulls_last(), "p_partkey"])


@query("workflow_lint", "WITH m AS (SELECT event_type AS source, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM events) SELECT DISTINCT 'unknown' AS kind, source AS what FROM m WHERE source NOT IN ('view', 'click', 'nothing') AND target IS NOT NULL UNION SELECT 'unknown', target FROM m WHERE target NOT IN ('view', 'click', 'nothing') UNION SELECT 'dead-end', 'nothing' FROM m UNION SELECT 'initial', '2' FROM m")
def workflow_lint(spark, d):
    moves = W.transitions(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], "event_type").select("source", "target")
    states = spark.createDataFrame([("view", True, False), ("click", True, False), ("nothing", False, False)], "state string, initial boolean, terminal boolean")
    return V.workflow_lint(states, moves.distinct())


TAGS = "SELECT doc_id, source, unnest(regexp_extract_all(lower(text), '\\b(?:th|on)[a-z]{6}\\b')) AS tag FROM documents WHERE lang = 'en'"

#: A tag between ASCII word ends, as in the SQL; Java's own \\b would count accented letters as parts of words.
TAG = r"(?<![A-Za-z0-9_])(?:th|on)[a-z]{6}(?![A-Za-z0-9_])"


@query("tag_traceability", f"""
WITH t AS ({TAGS}), q AS (SELECT DISTINCT source AS grp, tag FROM t WHERE doc_id % 2 = 0), u AS (SELECT DISTINCT tag FROM t WHERE doc_id % 2 = 1),
s AS (SELECT grp, 100.0 * count(u.tag) / count(*) AS n FROM q LEFT JOIN u USING (tag) GROUP BY grp)
SELECT 'orphan' AS kind, tag AS what, CAST(NULL AS DOUBLE) AS n FROM (SELECT DISTINCT tag FROM q) WHERE tag NOT IN (SELECT tag FROM u)
UNION ALL SELECT 'dangling', tag, NULL FROM u WHERE tag NOT IN (SELECT tag FROM q)
UNION ALL SELECT 'duplicate', tag, CAST(count(*) AS DOUBLE) FROM q GROUP BY tag HAVING count(*) > 1
UNION ALL SELECT CASE WHEN n < 5 THEN 'below-floor' ELSE 'coverage' END, grp, round(n, 6) FROM s""")
def tag_traceability(spark, d):
    docs = table(spark, d, "documents").where("lang = 'en'")
    tags = docs.select("doc_id", F.col("source").alias("grp"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TAG), F.lit(0))).alias("tag"))
    return V.traceability(tags.where("doc_id % 2 = 0").select("grp", "tag").distinct(), tags.where("doc_id % 2 = 1").select("tag", F.col("doc_id").alias("place")), floor=5.0)


@query("check_runner", f"""
WITH {ASSETS}, b AS (SELECT uid FROM a GROUP BY uid HAVING count(*) > 1)
SELECT 'datatype_range' AS check_name, CAST(to_json({{'s': s, 'property': property, 'check': "check", 'severity': severity}}) AS VARCHAR) AS finding
FROM ({FINDINGS["datatype_range"]})
UNION ALL
SELECT 'uid_unique', CAST(to_json({{'uid': uid, 'path': path, 'n': count(*) OVER (PARTITION BY uid)}}) AS VARCHAR) FROM a WHERE uid IN (SELECT uid FROM b)""")
def check_runner(spark, d):
    t, sh = data(spark, d), shapes(spark)
    checks = {"unknown_property": lambda: V.unknown_property(t, sh), "datatype_range": lambda: V.datatype_range(t, sh), "uid_unique": lambda: V.uid_unique(assets(spark, d))}
    return V.run_checks(checks, ["datatype_range", "uid_unique"])


@query("domain_range_check", DATA + "SELECT DISTINCT s, p, CASE WHEN p IN ('c_mktsegment', 'c_acctbal', 'c_nationkey') AND s NOT LIKE 'customer/%' THEN 'domain' WHEN p = 'c_nationkey' AND o NOT LIKE 'nation/%' THEN 'range' ELSE 'valid' END AS verdict FROM y WHERE p <> 'rdf:type'")
def domain_range_check(spark, d):
    t, sh = data(spark, d), shapes(spark)
    bad = V.class_range(t, sh, typed(t), party(spark)).select("s", F.col("property").alias("p"), F.lit("range").alias("bad"))
    fits = V.applicable(typed(t), sh, party(spark)).select("s", F.col("property").alias("p"), F.lit(True).alias("fits"))
    declared = sh.select(F.col("property").alias("p"), F.lit(True).alias("declared"))
    j = t.where("p <> 'rdf:type'").select("s", "p").distinct().join(declared, "p", "left").join(fits, ["s", "p"], "left").join(bad, ["s", "p"], "left")
    return j.select("s", "p", F.when(F.col("declared") & F.col("fits").isNull(), "domain").otherwise(F.coalesce("bad", F.lit("valid"))).alias("verdict"))


@query("classify_keys", DATA + "SELECT p AS key, CASE WHEN p = 'rdf:type' THEN 'ignored' WHEN p IN ('c_mktsegment', 'c_acctbal', 'c_nationkey') THEN 'declared' WHEN p LIKE 'c\\_%' ESCAPE '\\' THEN 'known-prefix' ELSE 'undeclared' END AS kind, CAST(count(*) AS BIGINT) AS n FROM y GROUP BY 1, 2")
def classify_keys(spark, d):
    declared = shapes(spark).select(F.col("property").alias("p"), F.lit(True).alias("declared"))
    j = data(spark, d).join(declared, "p", "left")
    kind = F.when(F.col("p") == "rdf:type", "ignored").when(F.col("declared"), "declared").when(F.col("p").startswith("c_"), "known-prefix").otherwise("undeclared")
    return j.groupBy(F.col("p").alias("key"), kind.alias("kind")).agg(F.count("*").alias("n"))


@query("report_filters", DATA + "SELECT \"check\", CAST(count(*) AS BIGINT) AS n FROM (" + " UNION ALL ".join(f"({x})" for x in FINDINGS.values()) + ") WHERE s LIKE 'customer/%' AND NOT (s = 'customer/22') GROUP BY 1")
def report_filters(spark, d):
    t = data(spark, d)
    found = V.report(t, shapes(spark), typed(t), party(spark))
    focus = typed(t).where("cls = 'class/Customer'").select("s")
    legacy = t.where("s = 'customer/22'").select("s").distinct()
    return found.join(focus, "s", "left_semi").join(legacy, "s", "left_anti").groupBy("check").agg(F.count("*").alias("n"))


# --- snapshots: customers with edits, moves, deletions and additions by key -----------------------------


def side(spark, d, which):
    """base, local or remote: ``path, uid, sha, bal, seg``."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    edits = {"base": F.lit(0), "local": F.when(k % 7 == 0, 1).otherwise(0), "remote": F.when(k % 11 == 0, 2).otherwise(F.when(k % 77 == 1, 1).otherwise(0))}[which]
    gone = {"base": k % 13 == 5, "local": k % 17 == 3, "remote": k % 19 == 4}[which]
    moved = {"base": F.lit(False), "local": k % 23 == 2, "remote": F.lit(False)}[which]
    bal = (F.round(F.col("c_acctbal") * 100).cast("long") + edits).cast("string")
    return c.where(~gone).select(
        F.concat(F.when(moved, "new/").otherwise("old/"), "c_name").alias("path"), F.concat(F.lit("u"), F.when(k % 50 == 1, F.lit(1)).otherwise(k)).alias("uid"), F.md5(bal).alias("sha"), bal.alias("bal"), F.col("c_mktsegment").alias("seg"), k.alias("k")
    )


def _side_sql(which):
    e = {"base": "0", "local": "CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END", "remote": "CASE WHEN c_custkey % 11 = 0 THEN 2 WHEN c_custkey % 77 = 1 THEN 1 ELSE 0 END"}[which]
    gone = {"base": "c_custkey % 13 = 5", "local": "c_custkey % 17 = 3", "remote": "c_custkey % 19 = 4"}[which]
    moved = {"base": "FALSE", "local": "c_custkey % 23 = 2", "remote": "FALSE"}[which]
    bal = f"CAST(CAST(round(c_acctbal * 100) AS BIGINT) + {e} AS VARCHAR)"
    return f"{which} AS (SELECT (CASE WHEN {moved} THEN 'new/' ELSE 'old/' END) || c_name AS path, 'u' || (CASE WHEN c_custkey % 50 = 1 THEN 1 ELSE c_custkey END) AS uid, md5({bal}) AS sha, {bal} AS bal, c_mktsegment AS seg, c_custkey AS k FROM customer WHERE NOT ({gone}))"


SIDES = "WITH " + ", ".join(_side_sql(x) for x in ("base", "local", "remote")) + " "


@query("content_hash", "SELECT doc_id, sha1('blob ' || octet_length(encode(coalesce(text, ''))) || chr(0) || coalesce(text, '')) AS sha FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", S.content_hash(F.coalesce("text", F.lit(""))).alias("sha"))


@query("diff_snapshot", SIDES + ", kb AS (SELECT CASE WHEN uid <> 'u1' THEN 'u:' || uid ELSE 'p:' || path END AS kk, * FROM base), kl AS (SELECT CASE WHEN uid <> 'u1' THEN 'u:' || uid ELSE 'p:' || path END AS kk, * FROM local) SELECT * FROM (SELECT CASE WHEN b.path IS NULL THEN 'added' WHEN l.path IS NULL THEN 'deleted' WHEN b.path <> l.path THEN 'renamed' WHEN b.sha <> l.sha THEN 'modified' END AS change, coalesce(l.path, b.path) AS path, CASE WHEN b.path <> l.path THEN b.path END AS old_path FROM kb b FULL JOIN kl l ON b.kk = l.kk) WHERE change IS NOT NULL")
def diff_snapshot(spark, d):
    return S.diff(side(spark, d, "base").select("path", "uid", "sha"), side(spark, d, "local").select("path", "uid", "sha"))


@query("dup_uid_guard", SIDES + "SELECT DISTINCT uid FROM (SELECT uid FROM base GROUP BY uid HAVING count(*) > 1 UNION SELECT uid FROM remote GROUP BY uid HAVING count(*) > 1)")
def dup_uid_guard(spark, d):
    return S.dup_uids(side(spark, d, "base"), side(spark, d, "remote"))


ROOT = "SELECT CAST(count(*) AS VARCHAR) || '-' || CAST(sum(CAST('0x' || substr(md5(path || ' ' || sha), 1, 8) AS BIGINT)) AS VARCHAR) AS root FROM"


@query("base_guard", SIDES + f"""
, r AS ({ROOT} base), q AS ({ROOT} remote)
SELECT 'same' AS case_name, 'go' AS verdict, 'none' AS reason
UNION ALL SELECT 'other', CASE WHEN r.root = q.root THEN 'go' ELSE 'full-conflict' END, CASE WHEN r.root = q.root THEN 'none' ELSE 'base-mismatch' END FROM r, q
UNION ALL SELECT 'first', 'full-conflict', 'first-sync'
UNION ALL SELECT 'gone', 'full-conflict', 'base-missing'""")
def base_guard(spark, d):
    base, other = (C.cut(S.root_hash(side(spark, d, x))) for x in ("base", "remote"))
    cases = {"same": (base, base), "other": (base, other), "first": (base.where("false"), base), "gone": (base, base.where("false"))}
    out = None
    for name, (remembered, actual) in cases.items():
        one = S.base_guard(remembered, actual).select(F.lit(name).alias("case_name"), "verdict", "reason")
        out = one if out is None else out.unionByName(one)
    return out


def key_rows(x):
    return x.select(F.col("uid").alias("u"), F.col("k").cast("string").alias("path"), F.explode(F.create_map(F.lit("bal"), F.col("bal"), F.lit("seg"), F.col("seg"))).alias("key", "value")).drop("u")


@query("merge_scalar", SIDES + ", " + ", ".join(f"{x[0]}3 AS (SELECT CAST(k AS VARCHAR) AS path, 'bal' AS key, bal AS value FROM {x} UNION ALL SELECT CAST(k AS VARCHAR), 'seg', seg FROM {x})" for x in ("base", "local", "remote"))
       + ", j AS (SELECT path, key, l3.value AS l, r3.value AS r, b3.value AS b FROM l3 FULL JOIN r3 USING (path, key) FULL JOIN b3 USING (path, key)), h AS (SELECT *, CASE WHEN l IS NOT DISTINCT FROM r THEN 'same' WHEN l IS NOT DISTINCT FROM b THEN 'remote' WHEN r IS NOT DISTINCT FROM b THEN 'local' WHEN key = 'seg' THEN 'later' ELSE 'conflict' END AS how FROM j) "
       "SELECT path, key, CASE how WHEN 'remote' THEN r WHEN 'later' THEN greatest(l, r) WHEN 'conflict' THEN NULL ELSE l END AS value, how FROM h")  # fmt: skip
def merge_scalar(spark, d):
    return S.merge_scalar(*[key_rows(side(spark, d, x)) for x in ("base", "local", "remote")], later=["seg"])


def sets(spark, d, which):
    w = {"base": "array('a', 'b', seg)", "local": "array('a', seg, 'l')", "remote": "if(k % 2 = 0, array('a', 'b', seg, 'r'), array('b', seg))"}[which]
    return table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("path"), F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("seg")).select("path", F.expr(w).alias("value"))


@query("merge_set", "SELECT CAST(c_custkey AS VARCHAR) AS path, CASE WHEN c_custkey % 2 = 0 THEN list_sort(['a', c_mktsegment, 'l', 'r']) ELSE list_sort([c_mktsegment, 'l']) END AS value FROM customer")
def merge_set(spark, d):
    return S.merge_set(*[sets(spark, d, x) for x in ("base", "local", "remote")])


PARITY = SIDES + (", p AS (SELECT path, CASE WHEN l IS NOT DISTINCT FROM r THEN 'parity' WHEN path LIKE '%77%' THEN 'pinned' WHEN r IS NOT DISTINCT FROM b THEN 'pending-local-' || CASE WHEN b IS NULL THEN 'add' WHEN l IS NULL THEN 'delete' ELSE 'edit' END "
                  "WHEN l IS NOT DISTINCT FROM b THEN 'pending-remote-' || CASE WHEN b IS NULL THEN 'add' WHEN r IS NULL THEN 'delete' ELSE 'edit' END ELSE 'conflict' END AS class FROM (SELECT path, base.sha AS b, local.sha AS l, remote.sha AS r FROM base FULL JOIN local USING (path) FULL JOIN remote USING (path))) ")  # fmt: skip


def parity_of(spark, d, local=None):
    b, r = side(spark, d, "base"), side(spark, d, "remote")
    l = side(spark, d, "local") if local is None else local  # noqa: E741
    pinned = b.unionByName(l).unionByName(r).where("path LIKE '%77%'").select("path").distinct()
    return S.parity(b, l, r, pinned)


@query("parity_classes", PARITY + "SELECT path, class FROM p")
def parity_classes(spark, d):
    return parity_of(spark, d).select("path", "class")


@query("parity_totals", PARITY + "SELECT CAST(count(*) AS BIGINT) AS paths, CAST(count(*) FILTER (class <> 'parity') AS BIGINT) AS differences, CAST(count(*) FILTER (class NOT IN ('parity', 'pinned', 'pending-local-edit', 'pending-remote-edit')) AS BIGINT) AS unaccounted, CASE WHEN count(*) = 0 THEN 'vacuous' WHEN count(*) FILTER (class NOT IN ('parity', 'pinned', 'pending-local-edit', 'pending-remote-edit')) = 0 THEN 'ok' ELSE 'diverged' END AS verdict FROM p")
def parity_totals(spark, d):
    return S.parity_totals(parity_of(spark, d), ["pinned", "pending-local-edit", "pending-remote-edit"])


#: Classes of differences that must not outlive a round.
ESCALATABLE = ["conflict", "pending-local-add", "pending-local-edit", "pending-local-delete", "pending-remote-edit"]


@query("persistent_divergence", PARITY + """
, earlier AS (
  SELECT path, CASE WHEN k % 14 = 7 THEN md5(CAST(CAST(round(bal_now) AS BIGINT) AS VARCHAR)) ELSE sha END AS sha
  FROM (SELECT local.*, round(c_acctbal * 100) AS bal_now FROM local JOIN customer ON c_custkey = k)
), three AS (
  SELECT path, base.sha AS b, local.sha AS l, remote.sha AS r, earlier.sha AS l0, base.path IS NOT NULL AS x
  FROM base FULL JOIN local USING (path) FULL JOIN remote USING (path) FULL JOIN earlier USING (path)
), old AS (
  SELECT path, CASE WHEN l0 IS NOT DISTINCT FROM r THEN 'parity' WHEN path LIKE '%77%' THEN 'pinned'
    WHEN r IS NOT DISTINCT FROM b THEN 'pending-local' WHEN l0 IS NOT DISTINCT FROM b AND b IS NOT NULL AND r IS NOT NULL THEN 'pending-remote-edit'
    WHEN l0 IS NOT DISTINCT FROM b THEN 'other' ELSE 'conflict' END AS was, l, l0 FROM three
)
SELECT p.path, p.class FROM p JOIN old USING (path)
WHERE p.class IN ('conflict', 'pending-local-add', 'pending-local-edit', 'pending-local-delete', 'pending-remote-edit')
  AND was IN ('conflict', 'pending-local', 'pending-remote-edit') AND l IS NOT DISTINCT FROM l0""")
def persistent_divergence(spark, d):
    local = side(spark, d, "local")
    plain = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.md5(F.round(F.col("c_acctbal") * 100).cast("long").cast("string")).alias("plain"))
    # a round ago, half of the edits had not been made
    earlier = local.join(plain, "k").withColumn("sha", F.when(F.col("k") % 14 == 7, F.col("plain")).otherwise(F.col("sha"))).select(*local.columns)
    return S.persistent(parity_of(spark, d, earlier), parity_of(spark, d), ESCALATABLE)


@query("edit_conservation", SIDES + """
SELECT local.path FROM local LEFT JOIN base USING (path)
WHERE local.sha IS DISTINCT FROM base.sha AND NOT EXISTS (SELECT 1 FROM remote r WHERE r.path = local.path AND r.sha = local.sha)
  AND local.seg <> 'BUILDING' AND local.seg <> 'MACHINERY' AND local.path NOT LIKE '%77%'""")
def edit_conservation(spark, d):
    base, before, remote = (side(spark, d, x) for x in ("base", "local", "remote"))
    kept = before.where("seg = 'BUILDING'")  # the rest of the local side was overwritten by the remote one
    merged = before.where("seg = 'MACHINERY'")
    return S.lost_edits(base, before, kept, remote, merged, before.where("path LIKE '%77%'"))


@query("format_drift", "SELECT 'n/' || c_custkey AS path FROM customer WHERE c_acctbal < 0")
def format_drift(spark, d):
    c = table(spark, d, "customer").withColumn("path", F.concat(F.lit("n/"), "c_custkey"))
    left = c.select("path", F.format_string("---\nname: %s\nsegment: %s\n---\nBody of the note.\n", "c_name", "c_mktsegment").alias("content"))
    moved = F.format_string("---\nsegment: '%s'\nname:   %s\n---\nBody of  the\nnote.\n\n", "c_mktsegment", "c_name")
    edited = F.format_string("---\nname: %s!\nsegment: %s\n---\nBody of the note.\n", "c_name", "c_mktsegment")
    same = F.format_string("---\nname: %s\nsegment: %s\n---\nBody of the note.\n", "c_name", "c_mktsegment")
    right = c.select("path", F.when(F.col("c_acctbal") < 0, moved).when(F.col("c_acctbal") < 1000, edited).otherwise(same).alias("content"))
    return S.format_drift(left, right)


@query("unparsable_notes", """
SELECT 'n/' || c_custkey AS path, CASE WHEN c_acctbal < 0 THEN 'no-front-matter' ELSE 'broken-line' END AS reason FROM customer WHERE c_acctbal < 500""")
def unparsable_notes(spark, d):
    from graphloom.sources.text import unparsable

    good, broken = F.format_string("---\nname: %s\ntags:\n  - a\n# note\n---\nBody", "c_name"), F.format_string("---\nname %s\n---\nBody", "c_name")
    content = F.when(F.col("c_acctbal") < 0, F.col("c_name")).when(F.col("c_acctbal") < 500, broken).otherwise(good)
    return unparsable(table(spark, d, "customer").select(F.concat(F.lit("n/"), "c_custkey").alias("path"), content.alias("content")))


@query("find_dup_groups", SIDES + "SELECT uid, path, CAST(count(*) OVER (PARTITION BY uid) AS BIGINT) AS n FROM base QUALIFY count(*) OVER (PARTITION BY uid) > 1")
def find_dup_groups(spark, d):
    base = side(spark, d, "base").select("uid", "path")
    many = base.groupBy("uid").agg(F.count("*").alias("n")).where("n > 1")
    return base.join(many, "uid").select("uid", "path", "n")


@query("property_delta", SIDES + ", " + ", ".join(f"{x[0]}3 AS (SELECT CAST(k AS VARCHAR) AS path, 'bal' AS key, bal AS value FROM {x} UNION ALL SELECT CAST(k AS VARCHAR), 'seg', seg FROM {x})" for x in ("base", "local"))
       + "SELECT * FROM (SELECT coalesce(b3.path, l3.path) AS path, coalesce(b3.key, l3.key) AS key, CASE WHEN b3.path IS NULL THEN 'added' WHEN l3.path IS NULL THEN 'removed' WHEN b3.value IS DISTINCT FROM l3.value THEN 'modified' END AS change FROM b3 FULL JOIN l3 ON b3.path = l3.path AND b3.key = l3.key) WHERE change IS NOT NULL")
def property_delta(spark, d):
    return S.property_delta(key_rows(side(spark, d, "base")), key_rows(side(spark, d, "local")))


@query("merge_gate", """
SELECT 'customer/' || c_custkey AS s, NOT (c_custkey % 11 = 0 OR c_custkey % 13 = 0) AS ship, CAST(CASE WHEN c_custkey % 19 = 0 THEN 1 ELSE 0 END AS BIGINT) AS skipped
FROM customer WHERE c_mktsegment <> 'HOUSEHOLD'""")
def merge_gate(spark, d):
    t = data(spark, d)
    types, sh = typed(t), shapes(spark)
    focus = table(spark, d, "customer").where("c_mktsegment <> 'HOUSEHOLD'").select(F.concat(F.lit("customer/"), "c_custkey").alias("s"))
    targets = V.class_range_targets(t, sh, types, party(spark)).select("s", "property", "check", "o")
    found = V.report(t, sh, types, party(spark)).join(targets, ["s", "property", "check"], "left")
    return S.merge_gate(found, focus, types.where("cls = 'class/Nation'").select(F.col("s").alias("o")))


@query("freshness", SIDES + "SELECT base.path, CASE WHEN local.sha IS NULL THEN 'unknown' WHEN local.sha <> base.sha THEN 'behind' ELSE 'current' END AS state FROM base LEFT JOIN local USING (path)")
def freshness(spark, d):
    b, l = side(spark, d, "base").select("path", F.col("sha").alias("b")), side(spark, d, "local").select("path", F.col("sha").alias("l"))  # noqa: E741
    return b.join(l, "path", "left").select("path", F.when(F.col("l").isNull(), "unknown").when(F.col("l") != F.col("b"), "behind").otherwise("current").alias("state"))


# --- domain ---------------------------------------------------------------------------------------------


@query("day_items", "SELECT DISTINCT o_orderkey FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE CAST(o_orderdate AS DATE) = DATE '1995-03-05' OR CAST(l_shipdate AS DATE) = DATE '1995-03-05'")
def day_items(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem").select("l_orderkey", "l_shipdate")
    a = o.where(W.in_day(["o_orderdate"], "1995-03-05")).select("o_orderkey")
    b = o.join(li.where(W.in_day(["l_shipdate"], "1995-03-05")), o.o_orderkey == li.l_orderkey, "left_semi").select("o_orderkey")
    return a.union(b).distinct()


@query("day_partition", "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'project' WHEN o_orderpriority = '1-URGENT' THEN 'action' ELSE 'task' END AS part FROM orders")
def day_partition(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_totalprice") > 200000, "project").when(F.col("o_orderpriority") == "1-URGENT", "action").otherwise("task").alias("part"))


@query("blocked", "SELECT a.o_orderkey, b.o_orderkey IS NOT NULL AND b.o_orderstatus NOT IN ('F') AS blocked FROM orders a LEFT JOIN orders b ON b.o_orderkey = a.o_orderkey + 7")
def blocked(spark, d):
    o = table(spark, d, "orders")
    b = o.select(F.col("o_orderkey").alias("blocker"), F.col("o_orderstatus").alias("state"))
    return o.join(b, F.col("blocker") == F.col("o_orderkey") + 7, "left").select("o_orderkey", F.coalesce(~F.col("state").isin("F"), F.lit(False)).alias("blocked"))


@query("ongoing", "SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS e FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderdate <= TIMESTAMP '1995-06-01' AND (e IS NULL OR e >= TIMESTAMP '1995-06-01')")
def ongoing(spark, d):
    e = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("e"))
    return table(spark, d, "orders").join(e, "o_orderkey", "left").where("o_orderdate <= TIMESTAMP '1995-06-01' AND (e IS NULL OR e >= TIMESTAMP '1995-06-01')").select("o_orderkey")


@query("calendar_events", "SELECT event_id, ts AS start, hour(ts) = 0 AND minute(ts) = 0 AND second(ts) = 0 AS all_day FROM events WHERE ts IS NOT NULL AND event_id % 9 <> 0")
def calendar_events(spark, d):
    text = F.when(F.col("event_id") % 9 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    e = table(spark, d, "events").withColumn("start", F.try_to_timestamp(text).cast("timestamp_ntz")).where("start IS NOT NULL")
    return e.select("event_id", "start", ((F.hour("start") == 0) & (F.minute("start") == 0) & (F.second("start") == 0)).alias("all_day"))


@query("naming_rule", """
SELECT c_custkey, CASE
  WHEN c_mktsegment = 'BUILDING' AND c_acctbal < 0 THEN 'B D ' || c_name || ' (debt)'
  WHEN c_mktsegment = 'BUILDING' THEN 'B ' || c_name
  WHEN c_mktsegment = 'MACHINERY' AND c_acctbal < 0 THEN 'P ' || c_name
  ELSE c_name || ' x' END AS title
FROM customer""")
def naming_rule(spark, d):
    rules = spark.createDataFrame(
        [
            ("BUILDING", 1, "r1", None, "B", "{{name}}", ""), ("BUILDING", 2, "r2", "debt", "D B ", "{{name}}!", "(debt)"),
            ("Party", 1, "r3", "debt", "P", "{{name}}", ""), ("Thing", 5, "r4", None, "", "{{name}}", "x x"),
        ],
        "cls string, priority int, rule string, needs string, prefix string, core string, suffix string",
    )
    up = C.plus(spark.createDataFrame([("BUILDING", "Party"), ("MACHINERY", "Party"), ("Party", "Thing"), ("HOUSEHOLD", "Thing"), ("FURNITURE", "Thing"), ("AUTOMOBILE", "Thing")], "src string, dst string"))
    c = table(spark, d, "customer").withColumn("tags", F.when(F.col("c_acctbal") < 0, F.array(F.lit("debt"))).otherwise(F.array().cast("array<string>")))
    names = W.composed(W.participating(c.select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("cls"), "tags"), up, rules))
    return c.join(names, c.c_custkey == names.key).select("c_custkey", F.replace("template", F.lit("{{name}}"), F.col("c_name")).alias("title"))


@query("render_template", "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_name || ' - ' || c_mktsegment ELSE c_mktsegment END AS title FROM customer")
def render_template(spark, d):
    c = table(spark, d, "customer").withColumn("owner", F.when(F.col("c_acctbal") < 0, F.col("c_name")))
    return c.select("c_custkey", W.render("{{owner}} - {{missing}} - {{c_mktsegment}}", ["owner", "c_mktsegment"]).alias("title"))


@query("class_list", with_t("customer", "nation", "part") + "SELECT o AS cls, CAST(count(*) AS BIGINT) AS n FROM t WHERE p = 'rdf:type' GROUP BY 1")
def class_list(spark, d):
    return load(spark, d, "customer", "nation", "part").where("p = 'rdf:type'").groupBy(F.col("o").alias("cls")).agg(F.count("*").alias("n"))


@query("class_properties", with_t("customer", "nation", "part") + """
, c AS (SELECT s, o AS cls FROM t WHERE p = 'rdf:type')
SELECT cls, p AS property, CAST(count(DISTINCT t.s) AS BIGINT) AS subjects, CAST(count(*) AS BIGINT) AS n FROM t JOIN c USING (s) WHERE p <> 'rdf:type' GROUP BY 1, 2""")
def class_properties(spark, d):
    t = load(spark, d, "customer", "nation", "part")
    return W.class_properties(t.where("p <> 'rdf:type'").select("s", "p"), typed(t))


@query("resolve_workflow", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'own' WHEN c_mktsegment = 'BUILDING' THEN 'wf-building' WHEN c_mktsegment IN ('MACHINERY', 'FURNITURE') THEN 'wf-goods' ELSE 'fallback' END AS value FROM customer")
def resolve_workflow(spark, d):
    up = C.plus(spark.createDataFrame([("MACHINERY", "Goods"), ("FURNITURE", "Goods"), ("BUILDING", "Goods"), ("Goods", "Thing")], "src string, dst string"))
    default = spark.createDataFrame([("BUILDING", "wf-building"), ("Goods", "wf-goods")], "cls string, wf string")
    near = W.keep_first(up.join(default, up.dst == default.cls).select(F.col("src").alias("cls"), "wf", "depth"), ["cls"], ["depth"])
    c = table(spark, d, "customer").withColumn("own", F.when(F.col("c_custkey") % 5 == 0, "own"))
    j = c.join(F.broadcast(default.withColumnRenamed("wf", "direct")), c.c_mktsegment == F.col("cls"), "left").drop("cls").join(F.broadcast(near), c.c_mktsegment == F.col("cls"), "left")
    return W.resolve_first(j, "c_custkey", [F.col("own"), F.col("direct"), F.col("wf"), F.lit("fallback")]).select("c_custkey", "value")


@query("next_states", """
WITH e AS (SELECT user_id, event_type AS state FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
SELECT user_id, state, target, kind FROM e JOIN (VALUES ('view', 'click', 'available'), ('view', 'signup', 'available'), ('click', 'purchase', 'available'),
  ('click', 'view', 'rollback'), ('signup', 'view', 'rollback')) n(source, target, kind) ON n.source = e.state
UNION ALL SELECT user_id, state, NULL, 'terminal' FROM e WHERE state IN ('purchase', 'error')""")
def next_states(spark, d):
    now = W.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])
    moves = [("view", "click", False), ("view", "signup", False), ("click", "purchase", False), ("click", "view", True), ("signup", "view", True)]
    moves = spark.createDataFrame(moves, "source string, target string, rollback boolean")
    terminal = spark.createDataFrame([("purchase",), ("error",)], "state string")
    return W.next_states(now.select("user_id", F.col("event_type").alias("state")), moves, terminal).select("user_id", "state", "target", "kind")


@query("instantiation_rule", """
SELECT 'part/' || p_partkey AS s, CASE WHEN p_type LIKE 'S%' THEN 'rule-1' ELSE 'rule-2' END AS rule, CASE WHEN p_type LIKE 'S%' THEN 'proto-s' END AS prototype,
       CASE WHEN p_type LIKE 'S%' THEN 'small' ELSE 'rest' END AS folder, CASE WHEN p_type LIKE 'S%' THEN 'area=home;size=1' ELSE '' END AS settings
FROM part WHERE p_type <> 'PROMO'""")
def instantiation_rule(spark, d):
    up = C.reach(spark.createDataFrame([("SMALL", "Slight"), ("STANDARD", "Slight"), ("Slight", "Thing"), ("LARGE", "Thing"), ("MEDIUM", "Thing"), ("ECONOMY", "Thing")], "src string, dst string"))
    rules = spark.createDataFrame([("rule-2", "Thing", None, "rest"), ("rule-1", "Slight", "proto-s", "small"), ("rule-3", "SMALL", "other", "never")], "rule string, cls string, prototype string, folder string")
    settings = spark.createDataFrame([("rule-1", "size", "1"), ("rule-1", "area", "home"), ("rule-3", "x", "y")], "rule string, key string, value string")
    p = table(spark, d, "part").select(F.concat(F.lit("part/"), "p_partkey").alias("s"), F.col("p_type").alias("cls"))
    return W.instantiation_rule(p, up, rules, settings)


@query("creation_gate", """
WITH RECURSIVE n AS (
  SELECT p_partkey AS id, p_type AS cls, p_brand AS direction, CASE WHEN p_size = 13 THEN 1000000000 WHEN p_size = 7 THEN p_partkey WHEN p_partkey > 1 THEN p_partkey // 2 END AS parent
  FROM part
), c AS (
  SELECT p_partkey AS id, CASE WHEN p_type = 'PROMO' THEN 'unguarded' WHEN p_type = 'LARGE' AND regexp_matches(p_name, '^red ') THEN 'exempt' END AS reason FROM part
), w AS (
  SELECT id, id AS node, 0 AS hops FROM c WHERE reason IS NULL
  UNION ALL
  SELECT w.id, n.parent, hops + 1 FROM w JOIN n ON n.id = w.node
  WHERE NOT (n.cls IN ('SMALL', 'STANDARD') AND n.direction LIKE '%1') AND n.parent IS NOT NULL AND n.parent <> n.id AND hops < 12
), z AS (
  SELECT w.id, w.node, hops, row_number() OVER (PARTITION BY w.id ORDER BY hops DESC) AS k FROM w
)
SELECT id, reason FROM c WHERE reason IS NOT NULL
UNION ALL
SELECT z.id, CASE WHEN n.id IS NULL THEN 'missing-parent' WHEN n.cls IN ('SMALL', 'STANDARD') AND n.direction LIKE '%1' THEN 'allowed'
  WHEN n.parent IS NULL THEN 'chain-ended' WHEN hops = 12 THEN 'too-deep' ELSE 'cycle' END
FROM z LEFT JOIN n ON n.id = z.node WHERE k = 1""")
def creation_gate(spark, d):
    p = table(spark, d, "part")
    parent = F.expr("case when p_size = 13 then 1000000000 when p_size = 7 then p_partkey when p_partkey > 1 then p_partkey div 2 end")
    nodes = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("cls"), parent.alias("parent"), F.col("p_brand").alias("direction"))
    up = C.reach(spark.createDataFrame([("SMALL", "Anchor"), ("STANDARD", "Plain"), ("Plain", "Anchor"), ("LARGE", "Big"), ("Big", "Free")], "src string, dst string"))
    below = lambda c: up.where(F.col("dst") == c).select(F.col("src").alias("cls"))
    kinds = p.select(F.col("p_type").alias("cls")).distinct()
    directions = p.select(F.col("p_brand").alias("direction")).distinct().where("direction LIKE '%1'")
    candidates = p.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("cls"), F.col("p_name").alias("text"))
    return W.creation_gate(candidates, nodes, kinds.where("cls <> 'PROMO'"), below("Free"), "^red ", below("Anchor"), directions)


@query("select_layout", "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'l2' WHEN c_nationkey < 10 THEN 'l3' END AS layout FROM customer WHERE c_mktsegment = 'BUILDING' OR c_nationkey < 10")
def select_layout(spark, d):
    layouts = spark.createDataFrame([("BUILDING", "l1", 1), ("BUILDING", "l2", 9), ("near", "l3", 5), ("near", "l4", 5)], "cls string, layout string, priority int")
    c = table(spark, d, "customer").select("c_custkey", F.posexplode(F.array("c_mktsegment", F.when(F.col("c_nationkey") < 10, "near"))).alias("pos", "cls"))
    return W.keep_first(c.join(F.broadcast(layouts), "cls"), ["c_custkey"], ["pos", F.desc("priority"), "layout"]).select("c_custkey", "layout")


@query("closed_in_day", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE CAST(l_shipdate AS DATE) = DATE '1995-03-05'")
def closed_in_day(spark, d):
    return table(spark, d, "lineitem").where(W.in_day(["l_shipdate"], "1995-03-05")).select("l_orderkey", "l_linenumber")


@query("effective_set", UP + """
, x AS (SELECT dst AS member FROM r WHERE src IN (SELECT p_partkey FROM part WHERE p_size = 9) UNION SELECT p_partkey FROM part WHERE p_size = 9 UNION SELECT 1 UNION SELECT -7)
SELECT member, member IN (SELECT p_partkey FROM part) AS resolved FROM x""")
def effective_set(spark, d):
    p = table(spark, d, "part")
    roots = p.where("p_size = 9").select(F.col("p_partkey").alias("member"))
    floor = spark.createDataFrame([(1,), (-7,)], "member long")
    return W.effective_set(roots, halves(spark, d), floor, p.select(F.col("p_partkey").alias("member")))

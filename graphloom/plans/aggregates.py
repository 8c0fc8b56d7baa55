"""Queries over aggregates, windows and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.functions import times as D
from graphloom.operators import aggregates as A
from graphloom.operators import domain as W
from graphloom.plans.base import query, table
from graphloom.plans.patterns import with_t
from graphloom.sources.triples import load


@query("group_by", "SELECT c_nationkey, c_mktsegment, CAST(count(*) AS BIGINT) AS n, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1, 2")
def group_by(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total"))


@query("having", "SELECT o_custkey, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY 1 HAVING count(*) > 12 AND avg(o_totalprice) > 100000")
def having(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("a"))
    return g.where("n > 12 AND a > 100000").select("o_custkey", "n")


@query("count", "SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN o_totalprice > 100000 THEN 1 END) AS BIGINT) AS big, CAST(count(DISTINCT o_custkey) AS BIGINT) AS customers FROM orders GROUP BY 1")
def count(spark, d):
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.count(F.when(F.col("o_totalprice") > 100000, 1)).alias("big"), F.countDistinct("o_custkey").alias("customers"))


@query("sum_avg", "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS total, round(coalesce(avg(CASE WHEN c_acctbal > 9990 THEN c_acctbal END), 0), 4) AS top FROM customer GROUP BY 1")
def sum_avg(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.round(F.sum("c_acctbal"), 2).alias("total"), F.round(A.avg(F.when(F.col("c_acctbal") > 9990, F.col("c_acctbal"))), 4).alias("top"))


@query("min_max", with_t("customer", "part") + "SELECT p, CASE WHEN count(o_num) = count(o) THEN CAST(CAST(min(o_num) AS DECIMAL(18,2)) AS VARCHAR) ELSE min(o) END AS low, CASE WHEN count(o_num) = count(o) THEN CAST(CAST(max(o_num) AS DECIMAL(18,2)) AS VARCHAR) ELSE max(o) END AS high FROM t GROUP BY p")
def min_max(spark, d):
    num = F.col("o_num").cast("decimal(18,2)")
    return load(spark, d, "customer", "part").groupBy("p").agg(A.min_max(num, F.col("o"), False).alias("low"), A.min_max(num, F.col("o"), True).alias("high"))


@query("group_concat", "SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ', ' ORDER BY c_mktsegment) AS segments, coalesce(string_agg(CASE WHEN c_acctbal > 9900 THEN c_name END, ' ' ORDER BY CASE WHEN c_acctbal > 9900 THEN c_name END), ' ') AS rich FROM customer GROUP BY 1")
def group_concat(spark, d):
    c = table(spark, d, "customer").withColumn("rich", F.when(F.col("c_acctbal") > 9900, F.col("c_name")))
    return c.groupBy("c_nationkey").agg(A.group_concat("c_mktsegment", ", ", True).alias("segments"), A.group_concat("rich").alias("rich"))


@query("sample", "SELECT c_nationkey, min(c_name) AS someone FROM customer GROUP BY 1")
def sample(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.min("c_name").alias("someone"))


@query("median", "SELECT l_returnflag, round(median(l_extendedprice), 4) AS m FROM lineitem GROUP BY 1")
def median(spark, d):
    return A.percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"m": 0.5}).withColumn("m", F.round("m", 4))


@query("variance_pop", "SELECT l_returnflag, round(var_pop(l_quantity), 4) AS v FROM lineitem GROUP BY 1")
def variance_pop(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.coalesce(F.var_pop("l_quantity"), F.lit(0.0)), 4).alias("v"))


@query("stddev_pop", "SELECT l_linestatus, round(stddev_pop(l_quantity), 4) AS v FROM lineitem GROUP BY 1")
def stddev_pop(spark, d):
    return table(spark, d, "lineitem").groupBy("l_linestatus").agg(F.round(F.coalesce(F.stddev_pop("l_quantity"), F.lit(0.0)), 4).alias("v"))


@query("mode", "SELECT l_returnflag, min(l_quantity) AS m FROM (SELECT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY count(*) DESC) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1 GROUP BY 1")
def mode(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.mode("l_quantity", True).alias("m"))


@query("percentile", "SELECT l_returnflag, " + ", ".join(f"round(quantile_cont(l_extendedprice, {p / 100}), 3) AS p{p}" for p in (25, 50, 75, 90, 95, 99)) + " FROM lineitem GROUP BY 1")
def percentile(spark, d):
    shares = {f"p{p}": p / 100 for p in (25, 50, 75, 90, 95, 99)}
    found = A.percentiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", shares)
    return found.select("l_returnflag", *[F.round(p, 3).alias(p) for p in shares])


@query("median_of_all", "SELECT round(median(l_extendedprice), 4) AS m, round(quantile_cont(l_quantity, 0.5), 4) AS q FROM lineitem")
def median_of_all(spark, d):
    """One group that holds the whole table."""
    li = table(spark, d, "lineitem")
    price, quantity = (A.percentiles(li, [], c, {n: 0.5}) for c, n in (("l_extendedprice", "m"), ("l_quantity", "q")))
    return price.join(quantity).select(F.round("m", 4).alias("m"), F.round("q", 4).alias("q"))  # a row each


@query("corr", "SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, CAST('NaN' AS DOUBLE) AS none FROM lineitem GROUP BY 1")
def corr(spark, d):
    li = table(spark, d, "lineitem").withColumn("one", F.lit(1.0))
    return li.groupBy("l_returnflag").agg(F.round(A.corr("l_quantity", "l_extendedprice"), 6).alias("r"), A.corr("one", "l_quantity").alias("none"))


@query("regression", "SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 2) AS intercept FROM lineitem GROUP BY 1")
def regression(spark, d):
    slope, intercept = A.regression("l_extendedprice", "l_quantity")
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(slope, 3).alias("slope"), F.round(intercept, 2).alias("intercept"))


@query("custom_agg", "SELECT c_mktsegment, max(c_acctbal) - min(c_acctbal) AS spread, sum(c_acctbal * c_nationkey) AS dot FROM customer GROUP BY 1")
def custom_agg(spark, d):
    spread = A.Custom(1, lambda x: [x.min(), x.max()], lambda a, b: [min(a[0], b[0]), max(a[1], b[1])], lambda s: s[1] - s[0])
    dot = A.Custom(2, lambda x, y: [(x * y).sum()], lambda a, b: [a[0] + b[0]], lambda s: s[0])
    c = table(spark, d, "customer").withColumn("nation", F.col("c_nationkey").cast("double"))
    return A.custom(c, "c_mktsegment", {"spread": (spread, ["c_acctbal"]), "dot": (dot, ["c_acctbal", "nation"])})


@query("agg_expression", "SELECT l_returnflag, round(sum(l_extendedprice * l_discount) / sum(l_extendedprice), 6) AS share, round(max(l_quantity) - min(l_quantity), 4) AS width FROM lineitem GROUP BY 1 ORDER BY sum(l_quantity) DESC")
def agg_expression(spark, d):
    e = F.col("l_extendedprice")
    g = table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(e * F.col("l_discount")) / F.sum(e), 6).alias("share"), F.round(F.max("l_quantity") - F.min("l_quantity"), 4).alias("width"), F.sum("l_quantity").alias("q"))
    return g.orderBy(F.desc("q")).drop("q")


@query("top_groups_other", "WITH c AS (SELECT p_brand, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS k FROM part GROUP BY 1) SELECT CASE WHEN k <= 5 THEN p_brand ELSE 'Other' END AS p_brand, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1")
def top_groups_other(spark, d):
    return A.top_groups(table(spark, d, "part"), "p_brand", 6)


@query("group_edges", """
WITH c AS (SELECT p_brand, row_number() OVER (ORDER BY count(*) DESC, p_brand) AS k FROM part GROUP BY 1),
l AS (SELECT p_partkey, CASE WHEN k <= 5 THEN c.p_brand ELSE 'Other' END AS label FROM part JOIN c USING (p_brand))
SELECT x.label AS a, y.label AS b, CAST(count(*) AS BIGINT) AS n FROM l x JOIN l y ON y.p_partkey = x.p_partkey // 2 WHERE x.p_partkey > 1 GROUP BY 1, 2""")
def group_edges(spark, d):
    p = table(spark, d, "part")
    edges = p.where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))
    return A.group_edges(p.select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("grp")), edges, 6)


# --- window-like -------------------------------------------------------------------------------------


@query("gaps", "WITH i AS (SELECT o_custkey, o_orderdate AS a, o_orderdate + INTERVAL 10 DAY AS b FROM orders), g AS (SELECT o_custkey, max(b) OVER (PARTITION BY o_custkey ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS free_from, lead(a) OVER (PARTITION BY o_custkey ORDER BY a, b) AS free_to FROM i) "
       "SELECT * FROM g WHERE free_to - free_from >= INTERVAL 300 DAY")  # fmt: skip
def gaps(spark, d):
    i = table(spark, d, "orders").select("o_custkey", F.col("o_orderdate").alias("a"), (F.col("o_orderdate") + F.expr("INTERVAL 10 DAY")).alias("b"))
    return W.gaps(i, ["o_custkey"], "a", "b", 300 * 86400)


@query("keep_last_key", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def keep_last_key(spark, d):
    return W.keep_first(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], [F.desc("event_id")])


@query("latest_per_key", "SELECT user_id, ts, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark, d):
    return W.latest(table(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"])


@query("nearest_wins", "WITH v AS (SELECT c_custkey AS k, 0 AS depth, CASE WHEN c_acctbal < 0 THEN c_mktsegment END AS x FROM customer UNION ALL SELECT c_custkey, 1, CASE WHEN n_nationkey % 2 = 0 THEN n_name END FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT c_custkey, 2, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) "
       "SELECT k, depth, x FROM v WHERE x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k ORDER BY depth) = 1")  # fmt: skip
def nearest_wins(spark, d):
    c, n, r = table(spark, d, "customer"), table(spark, d, "nation"), table(spark, d, "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    v = F.array(
        F.struct(F.lit(0).alias("depth"), F.when(F.col("c_acctbal") < 0, F.col("c_mktsegment")).alias("x")),
        F.struct(F.lit(1).alias("depth"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("x")),
        F.struct(F.lit(2).alias("depth"), F.col("r_name").alias("x")),
    )
    rows = j.select(F.col("c_custkey").alias("k"), F.explode(v).alias("v")).select("k", "v.*").where("x IS NOT NULL")
    return W.keep_first(rows, ["k"], ["depth"])


ALLOWED = [("view", "click"), ("click", "purchase"), ("view", "signup"), ("signup", "view"), ("click", "view")]


@query("transition_check", "WITH m AS (SELECT user_id, ts, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS source, event_type AS target FROM events) SELECT user_id, event_id, source, target FROM m WHERE source IS NOT NULL AND source <> target AND (source || '>' || target) NOT IN ("
       + ", ".join(f"'{a}>{b}'" for a, b in ALLOWED) + ")")
def transition_check(spark, d):
    moves = W.transitions(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")
    allowed = F.broadcast(spark.createDataFrame(ALLOWED, "source string, target string"))
    return moves.join(allowed, ["source", "target"], "left_anti").select("user_id", "event_id", "source", "target")


@query("first_wins", "SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def first_wins(spark, d):
    return W.keep_first(table(spark, d, "part").select("p_name", "p_partkey"), ["p_name"], ["p_partkey"])


# --- scalar functions ----------------------------------------------------------------------------------

NAMES = "SELECT n_nationkey, "


def scalar(name: str, source: str, key: str, columns: dict, sql: str, python: bool = False) -> None:
    """A query of Column builders over one table; ``python`` tells that one of them runs in Python tasks."""

    @query(name, f"SELECT {key}, {sql} FROM {source}")
    def run(spark, d):
        if python:
            T.bounded_batches(spark)
        return table(spark, d, source).select(key, *[c().alias(k) for k, c in columns.items()])


C = F.col
scalar("fn_strings", "part", "p_partkey", {
    "has": lambda: C("p_name").contains("e"), "starts": lambda: C("p_type").startswith("S"), "ends": lambda: C("p_brand").endswith("1"), "n": lambda: T.call("STRLEN", C("p_name")),
    "up": lambda: T.call("UCASE", C("p_name")), "low": lambda: T.call("http://x/fn#lcase", C("p_brand")), "both": lambda: F.concat("p_brand", F.lit("/"), "p_type"),
}, "contains(p_name, 'e') AS has, starts_with(p_type, 'S') AS starts, ends_with(p_brand, '1') AS ends, CAST(length(p_name) AS INTEGER) AS n, upper(p_name) AS up, lower(p_brand) AS low, p_brand || '/' || p_type AS both")
scalar("fn_substr", "part", "p_partkey", {"a": lambda: T.substr(C("p_name"), 0, 3), "b": lambda: T.substr(C("p_name"), -1, 4), "c": lambda: T.substr(C("p_name"), 3), "e": lambda: T.substr(C("p_name"), 2, 3)},
       "substr(p_name, 1, 2) AS a, substr(p_name, 1, 2) AS b, substr(p_name, 3) AS c, substr(p_name, 2, 3) AS e")
scalar("fn_strbefore_after", "part", "p_partkey", {"b": lambda: T.strbefore(C("p_type"), " "), "a": lambda: T.strafter(C("p_type"), " "), "x": lambda: T.strbefore(C("p_type"), ""), "y": lambda: T.strafter(C("p_type"), ""), "z": lambda: T.strafter(C("p_type"), "@@")},
       "CASE WHEN contains(p_type, ' ') THEN split_part(p_type, ' ', 1) ELSE '' END AS b, CASE WHEN contains(p_type, ' ') THEN substr(p_type, strpos(p_type, ' ') + 1) ELSE '' END AS a, '' AS x, p_type AS y, '' AS z")
scalar("fn_regex_replace", "part", "p_partkey", {"m": lambda: T.regex(C("p_type"), "^s.*l$", "i"), "r": lambda: T.replace(C("p_name"), "[aeiou]", "_"), "f": lambda: T.replace(C("p_name"), "[aeiou]", "_", "i")},
       "regexp_matches(p_type, '(?i)^s.*l$') AS m, regexp_replace(p_name, '[aeiou]', '_', 'g') AS r, regexp_replace(p_name, '(?i)[aeiou]', '_') AS f")
scalar("fn_encode_uri", "pages", "page_id", {"u": lambda: T.encode_for_uri(C("url"))}, "replace(url_encode(url), '+', '%20') AS u")
scalar("fn_fold_normalize", "documents", "doc_id", {"f": lambda: F.md5(T.fold(C("text"))), "n": lambda: F.md5(T.normalize(C("text"), "NFC"))}, "md5(replace(lower(text), 'ß', 'ss')) AS f, md5(nfc_normalize(text)) AS n", python=True)
scalar("fn_numeric", "customer", "c_custkey", {"a": lambda: F.abs("c_acctbal"), "c": lambda: F.ceil("c_acctbal"), "f": lambda: F.floor("c_acctbal"), "r": lambda: T.round_half_up(C("c_acctbal")), "h": lambda: T.to_hours(C("c_acctbal") * 10000), "half": lambda: T.round_half_up(C("c_nationkey") * -0.5)},
       "abs(c_acctbal) AS a, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(floor(c_acctbal + 0.5) AS BIGINT) AS r, round(c_acctbal * 10000 / 3600000.0, 2) AS h, CAST(floor(CAST(c_nationkey AS DOUBLE) * -0.5 + 0.5) AS BIGINT) AS half")
scalar("fn_hash", "customer", "c_custkey", {"m": lambda: F.md5("c_name"), "s": lambda: F.sha1("c_name"), "t": lambda: F.sha2("c_name", 256)}, "md5(c_name) AS m, sha1(c_name) AS s, sha256(c_name) AS t")


@query("fn_terms", with_t("customer", "part") + "SELECT s, p, o_kind = 'iri' AS iri, o_kind = 'lit' AS lit, CASE WHEN o_kind = 'lit' THEN coalesce(o_dt, 'xsd:string') END AS dt, o_kind = 'lit' AND coalesce(o_dt IN ('xsd:integer', 'xsd:decimal'), FALSE) AS num, '' AS lang FROM t WHERE p <> 'c_name'")
def fn_terms(spark, d):
    t = load(spark, d, "customer", "part").where("p <> 'c_name'")
    return t.select("s", "p", (F.col("o_kind") == "iri").alias("iri"), (F.col("o_kind") == "lit").alias("lit"), T.datatype().alias("dt"), T.is_numeric().alias("num"), T.lang().alias("lang"))


@query("fn_langmatches", "SELECT doc_id, lang <> '' AS any_lang, lang = 'en' AS en, TRUE AS region FROM documents WHERE lang IS NOT NULL")
def fn_langmatches(spark, d):
    rows = table(spark, d, "documents").where("lang IS NOT NULL")
    return rows.select("doc_id", T.langmatches(F.col("lang"), "*").alias("any_lang"), T.langmatches(F.col("lang"), "en").alias("en"), T.langmatches(F.concat("lang", F.lit("-XX")), "*").alias("region"))


@query("fn_same_term", with_t("customer") + "SELECT a.s, a.p, b.p AS q FROM t a JOIN t b ON a.s = b.s WHERE a.o = b.o AND a.o_kind = b.o_kind AND a.o_dt IS NOT DISTINCT FROM b.o_dt")
def fn_same_term(spark, d):
    t = load(spark, d, "customer")
    a, b = t.alias("a"), t.alias("b")
    same = T.same_term({k: F.col(f"a.{k}") for k in ("o", "o_kind", "o_dt", "o_lang")}, {k: F.col(f"b.{k}") for k in ("o", "o_kind", "o_dt", "o_lang")})
    return a.join(b, F.col("a.s") == F.col("b.s")).where(same).select("a.s", "a.p", F.col("b.p").alias("q"))


@query("fn_triple_terms", "SELECT o_orderkey, 'order/' || o_orderkey AS subject, 'o_custkey' AS predicate, 'customer/' || o_custkey AS object FROM orders")
def fn_triple_terms(spark, d):
    q = F.struct(F.concat(F.lit("order/"), "o_orderkey").alias("s"), F.lit("o_custkey").alias("p"), F.concat(F.lit("customer/"), "o_custkey").alias("o"))
    return table(spark, d, "orders").select("o_orderkey", q.alias("q")).select("o_orderkey", F.col("q.s").alias("subject"), F.col("q.p").alias("predicate"), F.col("q.o").alias("object"))


@query("fn_casts", with_t("part") + "SELECT s, p, TRY_CAST(o AS BIGINT) AS i, TRY_CAST(o AS DECIMAL(18,2)) AS x FROM t WHERE p IN ('p_size', 'p_brand')")
def fn_casts(spark, d):
    return load(spark, d, "part").where("p IN ('p_size', 'p_brand')").select("s", "p", F.col("o").try_cast("bigint").alias("i"), F.col("o").try_cast("decimal(18,2)").alias("x"))


scalar("fn_parse_compare", "events", "event_id", {
    "ms": lambda: D.parse_date(F.date_format("ts", "yyyy-MM-dd HH:mm:ss")), "before": lambda: C("ts") < F.lit("2024-01-15").cast("timestamp"), "within": lambda: C("ts").between(F.lit("2024-01-10").cast("timestamp"), F.lit("2024-01-20").cast("timestamp")),
}, "epoch_ms(date_trunc('second', ts)) AS ms, ts < TIMESTAMP '2024-01-15' AS before, ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20' AS within")
REF = "TIMESTAMP '2024-01-15 12:00:00'"
#: Whole milliseconds, cut off; DuckDB's epoch_ms rounds.
MS, REF_MS = "(epoch_us(ts) // 1000)", f"(epoch_us({REF}) // 1000)"
scalar("fn_diffs", "events", "event_id", {
    "mins": lambda: D.diff_minutes(C("ts"), F.expr(REF)), "hours": lambda: D.diff_hours(C("ts"), F.expr(REF)), "days": lambda: D.between(C("ts"), F.expr(REF), "day"), "m": lambda: D.between(C("ts"), F.expr(REF), "minute"), "h": lambda: F.round(D.between(C("ts"), F.expr(REF), "hour"), 4),
}, f"CAST(floor(abs({MS} - {REF_MS}) / 60000.0 + 0.5) AS BIGINT) AS mins, round(abs({MS} - {REF_MS}) / 3600000.0, 2) AS hours, CAST(floor(({REF_MS} - {MS}) / 86400000.0) AS BIGINT) AS days, "
   f"CAST(floor(({REF_MS} - {MS}) / 60000.0) AS BIGINT) AS m, round(({REF_MS} - {MS}) / 3600000.0, 4) AS h")  # fmt: skip
scalar("fn_calendar", "orders", "o_orderkey", {
    "week": lambda: F.weekofyear("o_orderdate"), "txt": lambda: D.format_date(C("o_orderdate"), "YYYY-MM-DD HH:mm:ss"), "y": lambda: D.part_of_text(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), "year"), "mo": lambda: D.part_of_text(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), "month"),
    "h": lambda: D.part_of_text(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), "hours"), "age": lambda: D.between(C("o_orderdate"), F.expr("TIMESTAMP '2000-01-01'"), "day"),
}, "CAST(weekofyear(o_orderdate) AS INTEGER) AS week, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS txt, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS mo, CAST(hour(o_orderdate) AS INTEGER) AS h, "
   "CAST(floor((epoch_ms(TIMESTAMP '2000-01-01') - epoch_ms(o_orderdate)) / 86400000.0) AS BIGINT) AS age")  # fmt: skip
scalar("fn_zone_adjust", "events", "event_id", {"z": lambda: D.zone(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(C("event_id") % 2 == 0, "Z").otherwise("+02:00"))), "local": lambda: F.date_format(D.adjust(C("ts"), "+02:00"), "yyyy-MM-dd HH:mm:ss")},
       "CASE WHEN event_id % 2 = 0 THEN 'Z' ELSE '+02:00' END AS z, strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S') AS local")
scalar("fn_durations", "part", "p_partkey", {
    "txt": lambda: D.duration_text(C("p_size") * 3723), "sec": lambda: D.seconds_of(D.duration_text(C("p_size") * 3723)), "bad": lambda: D.seconds_of(C("p_name")), "mon": lambda: D.months_of(F.concat(F.lit("P1Y"), C("p_size") % 12, F.lit("M"))), "neg": lambda: D.seconds_of(F.concat(F.lit("-PT"), "p_size", F.lit("M"))),
    "half": lambda: D.duration_text(F.try_divide(C("p_size") * 3600, F.lit(2))), "none": lambda: F.try_divide(C("p_size"), F.lit(0)),
}, "'P' || CASE WHEN p_size * 3723 >= 86400 THEN (p_size * 3723 // 86400) || 'D' ELSE '' END || CASE WHEN p_size * 3723 % 86400 > 0 THEN 'T' ELSE '' END || CASE WHEN p_size * 3723 % 86400 >= 3600 THEN (p_size * 3723 % 86400 // 3600) || 'H' ELSE '' END || CASE WHEN p_size * 3723 % 3600 >= 60 THEN (p_size * 3723 % 3600 // 60) || 'M' ELSE '' END || CASE WHEN p_size * 3723 % 60 > 0 THEN (p_size * 3723 % 60) || 'S' ELSE '' END AS txt, "
   "CAST(p_size * 3723 AS DOUBLE) AS sec, CAST(NULL AS DOUBLE) AS bad, CAST(12 + p_size % 12 AS INTEGER) AS mon, CAST(-60 * p_size AS DOUBLE) AS neg, "
   "'P' || CASE WHEN p_size * 1800 >= 86400 THEN (p_size * 1800 // 86400) || 'D' ELSE '' END || CASE WHEN p_size * 1800 % 86400 > 0 THEN 'T' ELSE '' END || CASE WHEN p_size * 1800 % 86400 >= 3600 THEN (p_size * 1800 % 86400 // 3600) || 'H' ELSE '' END || CASE WHEN p_size * 1800 % 3600 >= 60 THEN (p_size * 1800 % 3600 // 60) || 'M' ELSE '' END AS half, CAST(NULL AS DOUBLE) AS none")  # fmt: skip
scalar("fn_date_arith", "orders", "o_orderkey", {
    "later": lambda: D.plus_seconds(C("o_orderdate"), F.lit(93784)), "month": lambda: D.plus_months(C("o_orderdate"), F.lit(1)), "ago": lambda: D.plus_months(C("o_orderdate"), F.lit(-13)), "gap": lambda: D.duration_text(F.unix_timestamp(F.expr("TIMESTAMP '1998-12-01'")) - F.unix_timestamp("o_orderdate")),
}, "o_orderdate + INTERVAL 93784 SECOND AS later, o_orderdate + INTERVAL 1 MONTH AS month, o_orderdate - INTERVAL 13 MONTH AS ago, CASE WHEN date_diff('second', o_orderdate, TIMESTAMP '1998-12-01') = 0 THEN 'PT0S' ELSE (CASE WHEN o_orderdate > TIMESTAMP '1998-12-01' THEN '-' ELSE '' END) || 'P' || abs(date_diff('second', o_orderdate, TIMESTAMP '1998-12-01')) // 86400 || 'D' END AS gap")


scalar("fn_term_build", "documents", "doc_id", {
    "tag": lambda: T.strlang(C("source"), F.upper("lang"), F.lit("rtl"))["lang"], "way": lambda: T.langdir(T.strlang(C("source"), C("lang"), F.lit("rtl"))), "has": lambda: T.has_langdir(T.strlang(C("source"), C("lang"), F.lit("up"))),
    "dt": lambda: T.strdt(C("source"), "xsd:token")["dt"], "ok": lambda: T.call("isIRI", T.iri(F.concat(F.lit("x:"), "source"))), "bad": lambda: T.iri(F.concat("source", F.lit(" y")))["value"], "b": lambda: T.bnode(C("source"))["value"],
}, "lang AS tag, 'rtl' AS way, FALSE AS has, 'xsd:token' AS dt, TRUE AS ok, CAST(NULL AS VARCHAR) AS bad, '_:' || source AS b")
scalar("fn_duration_arith", "part", "p_partkey", {
    "sum": lambda: D.add(F.concat(F.lit("PT"), "p_size", F.lit("M")), F.lit("PT1H")), "diff": lambda: D.in_units(D.subtract(F.lit("PT1M"), F.concat(F.lit("PT"), "p_size", F.lit("M"))), "minutes"), "twice": lambda: D.component(D.scale(F.concat(F.lit("PT"), "p_size", F.lit("H")), F.lit(2)), "days"),
    "hours": lambda: D.component(F.concat(F.lit("PT"), "p_size", F.lit("H")), "hours"), "none": lambda: D.divide(F.lit("PT1H"), F.lit(0)), "zone": lambda: D.timezone_duration(F.lit("2024-01-01T00:00:00-02:30")),
}, "'PT' || ((60 + p_size) // 60) || 'H' || CASE WHEN p_size % 60 > 0 THEN (p_size % 60) || 'M' ELSE '' END AS sum, CAST(1 - p_size AS DOUBLE) AS diff, CAST(2 * p_size // 24 AS BIGINT) AS twice, CAST(p_size % 24 AS BIGINT) AS hours, CAST(NULL AS VARCHAR) AS none, '-PT2H30M' AS zone")


scalar("fn_months", "part", "p_partkey", {
    "sum": lambda: D.add_months(F.concat(F.lit("P"), "p_size", F.lit("M")), F.lit("P1Y2M")), "diff": lambda: D.subtract_months(F.lit("P2Y"), F.concat(F.lit("P"), "p_size", F.lit("M"))),
    "years": lambda: D.month_component(F.concat(F.lit("P"), "p_size", F.lit("M")), "years"), "months": lambda: D.month_component(F.concat(F.lit("-P"), "p_size", F.lit("M")), "months"),
    "none": lambda: D.add_months(F.lit("PT1H"), F.lit("P1M")),
}, "'P' || ((14 + p_size) // 12) || 'Y' || CASE WHEN (14 + p_size) % 12 > 0 THEN ((14 + p_size) % 12) || 'M' ELSE '' END AS sum, "
   "CASE WHEN p_size = 24 THEN 'P0M' ELSE CASE WHEN p_size > 24 THEN '-P' ELSE 'P' END || CASE WHEN abs(24 - p_size) >= 12 THEN (abs(24 - p_size) // 12) || 'Y' ELSE '' END "
   "|| CASE WHEN abs(24 - p_size) % 12 > 0 THEN (abs(24 - p_size) % 12) || 'M' ELSE '' END END AS diff, "
   "CAST(p_size // 12 AS BIGINT) AS years, CAST(-(p_size % 12) AS BIGINT) AS months, CAST(NULL AS VARCHAR) AS none")  # fmt: skip


@query("host_predicate", "SELECT c_custkey, c_acctbal < 0 AS hit FROM customer")
def host_predicate(spark, d):
    T.register("owes", lambda x: x < 0)
    return table(spark, d, "customer").select("c_custkey", T.call("urn:host:owes", F.col("c_acctbal")).alias("hit"))


@query("fn_volatile", "SELECT c_mktsegment, CAST(count(*) AS BIGINT) AS uuids, CAST(count(*) AS BIGINT) AS struuids, true AS rand_in_range, true AS rand_varies, CAST(1 AS BIGINT) AS clocks, true AS now_is_recent FROM customer GROUP BY 1")
def fn_volatile(spark, d):
    """Properties of UUID, STRUUID, RAND and NOW: distinct and well formed, in range and varying, one clock for the whole query."""
    form = "[0-9a-f]{8}-[0-9a-f]{4}-4[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"
    c = table(spark, d, "customer").select("c_mktsegment", *[T.call(n).alias(n) for n in ("UUID", "STRUUID", "RAND", "NOW")])
    return c.groupBy("c_mktsegment").agg(
        F.countDistinct(F.when(F.col("UUID").rlike(f"^urn:uuid:{form}$"), F.col("UUID"))).alias("uuids"),
        F.countDistinct(F.when(F.col("STRUUID").rlike(f"^{form}$"), F.col("STRUUID"))).alias("struuids"),
        F.bool_and((F.col("RAND") >= 0) & (F.col("RAND") < 1)).alias("rand_in_range"),
        (F.max("RAND") > F.min("RAND")).alias("rand_varies"),
        F.countDistinct("NOW").alias("clocks"),
        F.bool_and(F.abs(F.unix_timestamp("NOW") - F.unix_timestamp(F.current_timestamp())) < 60).alias("now_is_recent"),
    )

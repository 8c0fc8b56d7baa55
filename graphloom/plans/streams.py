"""Queries over text sources, sinks and streams; each stream reads a table of the given folder."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from graphloom.plans.aggregates import ALLOWED
from graphloom.plans.base import query, table
from graphloom.plans.patterns import with_t
from graphloom.sources import text as X
from graphloom.sources.triples import load
from graphloom.operators import refresh as R
from graphloom.operators.closure import shared_root
from graphloom.streaming import jobs as J
from graphloom.streaming import state as K


def work_dir(spark) -> str:
    return f"{shared_root(spark)}/stream-{uuid.uuid4().hex}"


def events(spark, d):
    """The events table as a stream."""
    schema = table(spark, d, "events").schema
    return J.file_stream(spark, d, schema, pattern="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


@query("notes_to_triples", "SELECT 'notes/' || c_custkey || '.md' AS path, key, CAST(pos AS INTEGER) AS pos, value FROM (SELECT c_custkey, 'label' AS key, 0 AS pos, c_name AS value FROM customer UNION ALL SELECT c_custkey, 'tags', 0, 'a' FROM customer UNION ALL SELECT c_custkey, 'tags', 1, c_mktsegment FROM customer UNION ALL SELECT c_custkey, 'refs', 0, 'x' FROM customer UNION ALL SELECT c_custkey, 'refs', 1, '[[n' || c_nationkey || ']]' FROM customer)")
def notes_to_triples(spark, d):
    content = F.concat(F.lit('---\nlabel: "'), "c_name", F.lit('"\ntags: [a, '), "c_mktsegment", F.lit("]\nrefs:\n  - x\n  - \"[[n"), "c_nationkey", F.lit(']]"\n---\nBody: text\n'))
    return X.notes_to_rows(table(spark, d, "customer").select(F.concat(F.lit("notes/"), "c_custkey", F.lit(".md")).alias("path"), content.alias("content")))


NTS = "SELECT s, p, o, o_kind, o_dt FROM t"


@query("read_ntriples", with_t("nation", "part") + NTS)
def read_ntriples(spark, d):
    lines = X.ntriples_lines(load(spark, d, "nation", "part"))
    noise = table(spark, d, "nation").select(F.concat(F.lit("# "), "n_name").alias("value"))
    return X.parse_ntriples(lines.unionByName(noise))[0].select("s", "p", "o", "o_kind", "o_dt")


@query("write_ntriples", with_t("customer") + "SELECT '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'lit' THEN '\"' || o || '\"' || CASE WHEN o_dt IS NOT NULL THEN '^^<' || o_dt || '>' ELSE '' END ELSE '<' || o || '>' END || ' .' AS value FROM t")
def write_ntriples(spark, d):
    path = work_dir(spark)
    X.write_ntriples(load(spark, d, "customer"), path)
    return spark.read.text(path)


@query("read_jsonld_flat", "SELECT 'c/' || c_custkey AS s, 'rdf:type' AS p, 'Customer' AS o, 'iri' AS o_kind FROM customer UNION ALL SELECT 'c/' || c_custkey, 'name', c_name, 'lit' FROM customer UNION ALL SELECT 'c/' || c_custkey, 'nation', 'n/' || c_nationkey, 'iri' FROM customer UNION ALL SELECT 'c/' || c_custkey, 'tag', unnest(['x', c_mktsegment]), 'lit' FROM customer")
def read_jsonld_flat(spark, d):
    node = F.struct(F.concat(F.lit("c/"), "c_custkey").alias("@id"), F.lit("Customer").alias("@type"), F.col("c_name").alias("name"), F.struct(F.concat(F.lit("n/"), "c_nationkey").alias("@id")).alias("nation"), F.array(F.lit("x"), "c_mktsegment").alias("tag"))
    docs = table(spark, d, "customer").groupBy(F.expr("c_custkey div 10").alias("g")).agg(F.to_json(F.struct(F.collect_list(node).alias("@graph"))).alias("value"))
    return X.jsonld_to_triples(docs)


@query("typed_records", "SELECT 'urn:c' || c_custkey AS s, 'urn:in' AS p, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'urn:n' || c_nationkey END AS o FROM customer WHERE c_custkey % 5 <> 0")
def typed_records(spark, d):
    c = table(spark, d, "customer")
    none = F.lit(None).cast("string")
    rec = lambda i, kind, value=none, s=none, p=none, o=none, b=none: F.struct(i.alias("id"), F.lit(kind).alias("kind"), value.alias("value"), s.alias("subject"), p.alias("predicate"), o.alias("object"), b.alias("body"))
    key, nat = F.concat(F.lit("c"), "c_custkey"), F.concat(F.lit("n"), "c_nationkey")
    st = c.select(rec(F.concat(F.lit("s"), "c_custkey"), "statement", s=F.when(F.col("c_custkey") % 5 != 0, key), p=F.lit("in"), o=nat, b=F.when(F.col("c_custkey") % 3 == 0, F.col("c_name"))).alias("r"))
    rows = st.unionByName(c.select(rec(key, "anchor", F.concat(F.lit("urn:"), key)).alias("r"))).unionByName(table(spark, d, "nation").select(rec(F.concat(F.lit("n"), "n_nationkey"), "anchor", F.concat(F.lit("urn:n"), "n_nationkey")).alias("r")))
    rows = rows.unionByName(c.limit(1).select(rec(F.lit("in"), "namespace", F.lit("urn:in")).alias("r")))
    return X.typed_records(rows.select("r.*"))[0]


@query("write_results", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal < 0")
def write_results(spark, d):
    path = work_dir(spark)
    X.write_results(table(spark, d, "customer").where("c_acctbal < 0").select("c_custkey", "c_name"), path, "json")
    return spark.read.schema("c_custkey long, c_name string").json(path)


LATEST = "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


@query("stream_upsert", "SELECT user_id, event_id FROM events")
def stream_upsert(spark, d):
    at = work_dir(spark)
    store = J.Bucketed(spark, f"{at}/store", "user_id long, event_id long", "user_id")
    J.run(events(spark, d).select("user_id", "event_id"), f"{at}/state", batch=J.upsert(store))
    return store.read()


@query("stream_latest", LATEST)
def stream_latest(spark, d):
    at = work_dir(spark)
    store = J.Bucketed(spark, f"{at}/store", "user_id long, ts timestamp, event_id long, event_type string", "user_id")
    J.run(events(spark, d).select("user_id", "ts", "event_id", "event_type"), f"{at}/state", batch=J.upsert_latest(store, ["ts", "event_id"]))
    return store.read().select("user_id", "event_id", "event_type")


def listing(spark, d, shift):
    return table(spark, d, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.expr(f"doc_id * 10 + if(doc_id % 9 = 4, {shift}, 0)").alias("mtime"), F.col("n_chars").alias("size"), "doc_id")


@query("changed_since", "SELECT 'doc/' || doc_id AS path FROM documents WHERE doc_id % 9 = 4 OR doc_id % 31 = 0")
def changed_since(spark, d):
    return J.changed_since(listing(spark, d, 1), listing(spark, d, 0).where("doc_id % 31 <> 0")).select("path")


@query("delta_refresh", "SELECT 'doc/' || doc_id AS path FROM documents WHERE doc_id % 9 = 4 UNION SELECT 'doc/' || (doc_id + 1) FROM documents WHERE doc_id % 9 = 4 AND doc_id + 1 IN (SELECT doc_id FROM documents)")
def delta_refresh(spark, d):
    now, before = listing(spark, d, 1), listing(spark, d, 0)
    refs = now.where("doc_id > 0").select("path", F.concat(F.lit("doc/"), F.col("doc_id") - 1).alias("target"))
    verdict, paths = J.delta_plan(now, before, refs)
    return paths if verdict == "delta" else now.limit(0).select("path")


@query("stream_chunks", "SELECT user_id AS src, c_nationkey AS dst FROM events JOIN customer ON user_id = c_custkey WHERE c_nationkey % 2 = 0")
def stream_chunks(spark, d):
    """Users come as nodes, so do the even nations; an edge from a user's event to a nation waits for both."""
    at = work_dir(spark)
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_nationkey")
    edges = events(spark, d).join(users, "user_id").select(F.concat(F.lit("c"), "user_id").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst"), F.col("event_id").alias("edge"))
    stream = lambda name: J.file_stream(spark, d, table(spark, d, name).schema, pattern=f"{name}.parquet")
    nodes = stream("customer").select(F.concat(F.lit("c"), "c_custkey").alias("id")).unionByName(stream("nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("n"), "n_nationkey").alias("id")))
    J.run(K.waiting_edges(edges, nodes), f"{at}/state", path=f"{at}/out")
    out = spark.read.schema("src string, dst string, edge string").parquet(f"{at}/out")
    return out.select(F.substring("src", 2, 20).cast("long").alias("src"), F.substring("dst", 2, 20).cast("int").alias("dst"))


@query("stream_transitions", f"""
WITH m AS (SELECT user_id, ts, event_id, lag(event_type) OVER w AS source, lag(ts) OVER w AS before, event_type AS target FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, source, target FROM m
WHERE source <> target AND ts - before <= INTERVAL 5 DAY AND ts < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
AND (source || '>' || target) NOT IN ({", ".join(f"'{a}>{b}'" for a, b in ALLOWED)})""")
def stream_transitions(spark, d):
    at = work_dir(spark)
    moves = K.illegal_moves(events(spark, d), "user_id", "ts", "event_id", "event_type", ALLOWED, "1 hour", 5 * 86_400_000)
    J.run(moves.select("user_id", "event_id", "source", "target"), f"{at}/state", path=f"{at}/out")
    return spark.read.schema("user_id long, event_id long, source string, target string").parquet(f"{at}/out")


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    at = work_dir(spark)
    J.run(J.dedup(events(spark, d), ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type"), f"{at}/state", path=f"{at}/out")
    return spark.read.schema("user_id long, event_type string").parquet(f"{at}/out")


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 1 DAY, ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def stream_tumbling(spark, d):
    at = work_dir(spark)
    counts = J.tumbling(events(spark, d), "ts", "event_type", "1 day", "1 hour")
    J.run(counts.select(F.col("window.start").alias("start"), "event_type", "n"), f"{at}/state", path=f"{at}/out")
    return spark.read.schema("start timestamp, event_type string, n long").parquet(f"{at}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sessions", """
WITH g AS (SELECT user_id, ts, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events),
n AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT min(ts) AS "start", max(ts) + INTERVAL 6 HOUR AS "end", user_id, CAST(count(*) AS BIGINT) AS n FROM n
GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""")
def stream_sessions(spark, d):
    at = work_dir(spark)
    s = J.sessions(events(spark, d), "ts", "user_id", "6 hours", "1 hour")
    J.run(s.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n"), f"{at}/state", path=f"{at}/out")
    return spark.read.schema("start timestamp, end timestamp, user_id long, n long").parquet(f"{at}/out")


def edited(spark, d, change: bool):
    """Notes on parts: brands are classes under makers, each part's prototype is part ``k div 4``; ``change`` edits some."""
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    k, hit = F.col("p_partkey"), F.lit(change) & (F.col("p_partkey") % 13 == 5)
    node = lambda x: F.concat(F.lit("part/"), x.cast("string"))
    row = lambda p, o: F.struct(F.lit(p).alias("p"), o.alias("o"))
    said = F.array(
        row("rdf:type", F.concat(F.lit("class/"), F.when(hit, "Brand#new").otherwise(F.col("p_brand")))),
        row("prototype", F.when(k > 3, node(F.when(hit, F.expr("p_partkey div 2")).otherwise(F.expr("p_partkey div 4"))))),
        row("name", F.when(k % 10 == 1, F.when(hit, F.lit("renamed")).otherwise(F.col("p_name")))),
        row("tag", F.when(k % 7 == 2, F.col("p_type"))),
    )
    parts = p.select(node(k).alias("path"), F.when(hit, 2).otherwise(1).cast("long").alias("mtime"), F.lit(1).cast("long").alias("size"), said.alias("said"))
    up = F.concat(F.lit("class/"), F.expr("CASE WHEN right(p_brand, 1) = '1' THEN 'root' ELSE left(p_brand, length(p_brand) - 1) || (cast(right(p_brand, 1) AS int) - 1) END"))
    cut_off = F.lit(change) & (F.substring("p_brand", -1, 1) == "4")
    brands = p.select("p_brand").distinct().select(F.concat(F.lit("class/"), "p_brand").alias("path"), F.when(cut_off, 2).otherwise(1).cast("long").alias("mtime"), F.lit(1).cast("long").alias("size"), F.array(row("rdfs:subClassOf", F.when(cut_off, "class/other").otherwise(up))).alias("said"))
    return parts.unionByName(brands)


def said_rows(files):
    return files.select("path", F.explode("said").alias("x")).where("x.o IS NOT NULL").select("path", F.col("path").alias("s"), "x.p", "x.o")


@query("delta_facts", """
WITH RECURSIVE b AS (SELECT DISTINCT p_brand AS b FROM part),
sup AS (SELECT 'class/' || b AS src, CASE WHEN right(b, 1) = '4' THEN 'class/other' WHEN right(b, 1) = '1' THEN 'class/root' ELSE 'class/' || left(b, length(b) - 1) || (CAST(right(b, 1) AS INT) - 1) END AS dst FROM b),
up AS (SELECT src, dst FROM sup UNION SELECT up.src, sup.dst FROM up JOIN sup ON up.dst = sup.src),
n AS (SELECT p_partkey AS k, p_partkey % 13 = 5 AS hit, * FROM part),
l AS (SELECT k AS i, CASE WHEN hit THEN k // 2 ELSE k // 4 END AS j FROM n WHERE k > 3),
ch AS (SELECT i, j, 1 AS depth FROM l UNION ALL SELECT ch.i, l.j, depth + 1 FROM ch JOIN l ON ch.j = l.i WHERE depth < 10),
t AS (SELECT k, 'name' AS p, CASE WHEN hit THEN 'renamed' ELSE p_name END AS o FROM n WHERE k % 10 = 1 UNION ALL SELECT k, 'tag', p_type FROM n WHERE k % 7 = 2),
f AS (SELECT ch.i AS k, t.p, t.o, min(depth) AS depth FROM ch JOIN t ON ch.j = t.k GROUP BY 1, 2, 3),
near AS (SELECT * FROM f WHERE p = 'name' QUALIFY min(depth) OVER (PARTITION BY k, p) = depth)
SELECT 'part/' || k AS s, 'rdf:type' AS p, up.dst AS o FROM n JOIN up ON up.src = CASE WHEN hit THEN 'class/Brand#new' ELSE 'class/' || p_brand END
UNION SELECT 'part/' || k, p, o FROM near WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.k = near.k AND t.p = 'name')
UNION SELECT 'part/' || k, p, o FROM f WHERE p = 'tag' AND NOT EXISTS (SELECT 1 FROM t WHERE t.k = f.k AND t.p = f.p AND t.o = f.o)""")
def delta_facts(spark, d):
    """What follows from the notes after some were edited: kept up to date from what followed before."""
    _, _, before = R.refresh(None, edited(spark, d, False), said_rows, ["tag"])
    verdict, _, after = R.refresh(before, edited(spark, d, True), said_rows, ["tag"])
    assert verdict == "delta"
    return after.types.select("s", F.lit("rdf:type").alias("p"), F.col("cls").alias("o")).unionByName(after.inherited.select("s", "p", "o"))


@query("usage_logs", """
WITH t AS (SELECT conv_id, length(text) AS n, turn FROM conversations WHERE role = 'assistant' AND turn % 7 <> 5)
SELECT 's' || conv_id AS session, CAST(count(*) AS BIGINT) AS turns, CAST(sum(n) AS BIGINT) AS "input", CAST(sum(CASE WHEN turn % 3 = 0 THEN 0 ELSE n // 2 END) AS BIGINT) AS output,
  CAST(sum(turn) AS BIGINT) AS cache_read, round((sum(n) * 15.0 + sum(CASE WHEN turn % 3 = 0 THEN 0 ELSE n // 2 END) * 75.0 + sum(turn) * 1.5) / 1000000, 7) AS cost
FROM t GROUP BY 1""")
def usage_logs(spark, d):
    """Logs as JSONL, with lines cut off, lines without usage and counts that are missing; written, then read back."""
    path, n = work_dir(spark), F.length("text").cast("long")
    counts = F.struct(n.alias("input_tokens"), F.when(F.col("turn") % 3 != 0, F.expr("length(text) div 2")).alias("output_tokens"), F.col("turn").cast("string").alias("cache_read_input_tokens"))
    usage = F.when(F.col("role") == "assistant", counts)
    line = F.to_json(F.struct(F.col("role").alias("type"), F.concat(F.lit("s"), "conv_id").alias("sessionId"), F.struct(usage.alias("usage")).alias("message")))
    cut_off = F.when(F.col("turn") % 7 == 5, F.substring(line, 1, 30)).otherwise(line)
    table(spark, d, "conversations").select(cut_off.alias("value")).write.text(path)
    return X.usage_cost(X.read_usage(spark, path)[0]).withColumn("cost", F.round("cost", 7))

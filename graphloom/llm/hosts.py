"""Quality rules with verdicts on hosts, with DataFrame functions alone.

1. Each document's own figures: words, characters in them, symbols, repeated lines, and the
   words inside 8-word windows that the text holds twice or more.  All of it is array work on
   one row, linear but for one sort of the windows of texts that repeat any; nothing is shuffled.
2. Failures of each rule are summed by host (before the shuffle first, so a host with a third
   of all rows is no hot key).  A beta prior is fitted to all hosts' rates by moments, with
   documents as weights; a host's rate is shrunk towards the prior's mean by its strength.
3. A host whose shrunken rate of some rule is over ``most`` fails, and all its documents go.

The prior.  With host sizes n, failures f, N = sum n, H hosts, m = sum f / N,
S = sum f^2/n / N - m^2, e = (H - 1) / N and Q = sum n^2 / N^2, the share of variance
between hosts is g = (S - m (1 - m) e) / (m (1 - m) (1 - Q - e)), and the prior has the
strength (1 - g) / g documents.  Where g <= 0 (hosts differ no more than by chance), all
hosts have the rate m; where g >= 1, each its own.

Defined cases: a null or empty text has no words and fails for having few; a null source is
no host: such documents stand for themselves and teach no prior; rows are judged one by one, so
repeated and null ids are kept; one host alone has its own rate; a text of any length counts
whole; empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import small_side, staged

SPACE = r"[ \t-\r]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS = 20
#: Largest share of a host's documents that may fail one rule.
MOST = 0.5
#: The rules that hosts are judged by, over the figures of a document.
RULES = {
    "few_words": f"n_words < {LEAST_WORDS}",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
}
BASE = ("few_words", "repeats")
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated(words: Column) -> tuple[Column, ...]:
    """The steps to the number of words in windows that occur twice or more, each over the one before."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    last = F.size("h") - WINDOW
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice("h", i + 1, WINDOW)))
    placed = F.sort_array(F.transform("w", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    same = lambda i, k: F.coalesce(F.get("s", i + k)["x"] == F.get("s", i)["x"], F.lit(False))
    twice = F.filter("s", lambda x, i: same(i, 1) | same(i, -1))
    at = F.array_sort(F.transform(twice, lambda x: x["i"]))
    covered = F.aggregate(F.transform("p", lambda p, k: F.least(F.coalesce(F.get("p", k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW))), F.lit(0), lambda a, x: a + x)
    return hashes, last, windows, placed, at, covered


def figures(docs: DataFrame, *kept: str) -> DataFrame:
    """The columns ``kept`` of ``docs`` (under their names) and the figures of each text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashes, last, windows, placed, at, covered = repeated(F.col("words"))
    none = F.array().cast("array<long>")
    rows = docs.select(*[F.col(c).alias(c) for c in kept], text.alias("t")).withColumn("words", F.filter(F.split("t", SPACE), lambda w: w != ""))
    rows = rows.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^ \t-\r]")))
    rows = rows.select(
        *kept,
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("t", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        hashes.alias("h"),
    )
    rows = rows.withColumn("w", F.when(last > 0, windows).otherwise(none)).drop("h")
    rows = rows.withColumn("s", F.when(F.size(F.array_distinct("w")) < F.size("w"), placed)).drop("w")
    rows = rows.withColumn("p", at).drop("s")
    return rows.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p")


def host_verdicts(judged: DataFrame, rules: list[str], most: float = MOST) -> DataFrame:
    """``host, host_rule`` of the hosts that fail, with the first rule that they fail.

    ``judged`` has ``host`` and a boolean for each rule, true where the document fails it.
    """
    live = judged.where("host IS NOT NULL")
    hosts = live.groupBy("host").agg(F.count("*").cast("double").alias("n"), *[F.sum(F.col(r).cast("double")).alias(r) for r in rules])
    hosts = staged(hosts, "hosts")
    squares = [F.sum(F.col(r) * F.col(r) / F.col("n")).alias(f"{r}_2") for r in rules]
    total = hosts.agg(F.count("*").alias("n_hosts"), F.sum("n").alias("n_all"), F.sum(F.col("n") * F.col("n")).alias("nn"), *[F.sum(r).alias(f"{r}_1") for r in rules], *squares)
    chance = (F.col("n_hosts") - 1) / F.col("n_all")
    prior = [F.col("n_hosts")]
    for r in rules:
        m = F.col(f"{r}_1") / F.col("n_all")
        within = m * (1 - m)
        g = F.try_divide(F.col(f"{r}_2") / F.col("n_all") - m * m - within * chance, within * (1 - F.col("nn") / (F.col("n_all") * F.col("n_all")) - chance))
        prior += [m.alias(f"{r}_m"), F.coalesce(g, F.lit(0.0)).alias(f"{r}_g")]
    both = hosts.crossJoin(F.broadcast(staged(total.select(*prior), "prior")))  # one row
    rates = []
    for r in rules:
        m, g, own = F.col(f"{r}_m"), F.col(f"{r}_g"), F.col(r) / F.col("n")
        strength = (1 - g) / g
        shrunken = F.when(F.col("n_hosts") == 1, own).when(g <= 0, m).when(g >= 1, own).otherwise((F.col(r) + m * strength) / (F.col("n") + strength))
        rates.append(F.when(shrunken > most, F.lit(r)))
    return both.select("host", F.coalesce(*rates).alias("host_rule")).where("host_rule IS NOT NULL")


def host_rules(docs: DataFrame, most: float = MOST) -> DataFrame:
    """``doc_id``, the figures, ``base_failed``, ``kept`` and ``host_rule`` (null: the host passes) of every row."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), "text")
    held = staged(figures(named, "doc_id", "host"), "figures")
    judged = held.select("host", *[F.expr(e).alias(r) for r, e in RULES.items()])
    bad = staged(host_verdicts(judged, list(RULES), most), "bad_hosts")
    out = held.join(small_side(bad, bad.count()), "host", "left")
    failed = F.expr(" OR ".join(RULES[r] for r in BASE))
    return out.select("doc_id", *FIGURES, failed.alias("base_failed"), (~failed & F.col("host_rule").isNull()).alias("kept"), "host_rule")


def _rates_sql() -> str:
    per_rule = []
    for r in RULES:
        m = f"({r}_1 / n_all)"
        within = f"{m} * (1 - {m})"
        g = f"(({r}_2 / n_all - {m} * {m} - {within} * (n_hosts - 1) / n_all) / nullif({within} * (1 - nn / (n_all * n_all) - (n_hosts - 1) / n_all), 0))"
        per_rule.append(
            f"CASE WHEN CASE WHEN n_hosts = 1 THEN {r} / n WHEN coalesce({g}, 0) <= 0 THEN {m} WHEN {g} >= 1 THEN {r} / n"
            f" ELSE ({r} + {m} * (1 - {g}) / {g}) / (n + (1 - {g}) / {g}) END > {MOST} THEN '{r}' END"
        )
    return "coalesce(" + ", ".join(per_rule) + ")"


#: The same rows in DuckDB SQL: windows are compared as words, not by hashes.
SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, source AS host, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), w AS (
  SELECT k, i, array_to_string(words[i + 1 : i + {WINDOW}], ' ') AS x
  FROM (SELECT k, words, unnest(range(0, len(words) - {WINDOW} + 1)) AS i FROM d WHERE len(words) > {WINDOW})
), r AS (
  SELECT k, sum(least(coalesce(lead_i - i, {WINDOW}), {WINDOW})) AS n
  FROM (SELECT k, i, lead(i) OVER (PARTITION BY k ORDER BY i) AS lead_i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, x) AS c FROM w) WHERE c > 1)
  GROUP BY k
), f AS (
  SELECT doc_id, host, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols, len(lines) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN r USING (k)
), h AS (
  SELECT host, CAST(count(*) AS DOUBLE) AS n, {", ".join(f"CAST(count(*) FILTER ({e}) AS DOUBLE) AS {r}" for r, e in RULES.items())}
  FROM f WHERE host IS NOT NULL GROUP BY host
), total AS (
  SELECT CAST(count(*) AS DOUBLE) AS n_hosts, sum(n) AS n_all, sum(n * n) AS nn, {", ".join(f"sum({r}) AS {r}_1, sum({r} * {r} / n) AS {r}_2" for r in RULES)} FROM h
), v AS (
  SELECT host, {_rates_sql()} AS host_rule FROM h, total
)
SELECT f.doc_id, {", ".join(FIGURES)}, base_failed, NOT base_failed AND host_rule IS NULL AS kept, host_rule
FROM (SELECT *, {" OR ".join(RULES[r] for r in BASE)} AS base_failed FROM f) f LEFT JOIN v USING (host)
"""

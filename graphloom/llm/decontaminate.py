"""Benchmark decontamination by spaced seeds, with DataFrame functions alone.

An overlap puts an item on a diagonal (place in the document less place in the item).  It
counts if some ``WINDOW`` places of the item in a row hold ``MIN_WORDS`` equal words; an item
of ``LEAST`` to ``WINDOW`` words needs the share ``MIN_SHARE`` of its words, a shorter one all
of them.  Equal words that are strewn over a long item are no overlap.

1. A seed hashes the words under the ones of a fixed mask and ignores those under its zeros.
   ``MASKS`` leave out no pattern of substitutions that the rule accepts (``lossless`` tries
   them all, so other parameters with which they would are refused); a shorter item is a
   seed of its own, as a whole.
2. The documents' seeds meet the distinct seeds of the benchmark in a semi join, inside the
   scan's stage; the hits, few as a rule, are gathered by document and seed, so that a word
   that a document repeats ten thousand times gives no more rows than it has places.
3. The diagonals of the hits are verified on the words: word by word over the item, then
   window by window.

The benchmark's seeds are broadcast if there are at most ``common.BROADCAST_ROWS`` of them,
by count; else the join shuffles (Spark splits its hot keys).

Defined cases: words are runs of letters or digits, in lower case; a null text has none;
an item of fewer than ``min_item`` words is no evidence and never matched; the rows of an
``item_id`` are texts of their own, repeated ones count once; rows that share a ``doc_id``
are compared as one document's texts; null ids take no part; of equally good diagonals the
first is told; a text of any length is searched whole (its words are one array); tables may
be empty; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import small_side, staged

MASKS = ("110111", "1101000011", "11001011", "1111001", "11111")
MIN_WORDS, WINDOW, MIN_SHARE = 13, 17, 0.75
#: Words of the shortest item that may have substitutions, and of the shortest that is matched.
LEAST, MIN_ITEM = 10, 3


@cache
def lossless(min_words: int, window: int, min_share: float) -> bool:
    """Whether each pattern of equal words that the rule accepts has all words under some mask."""
    masks = [(sum(1 << k for k, c in enumerate(m) if c == "1"), len(m)) for m in MASKS]
    for n in range(LEAST, window + 1):
        for gone in combinations(range(n), n - (min_words if n == window else ceil(min_share * n))):
            equal = (1 << n) - 1 - sum(1 << k for k in gone)
            if not any((equal >> k) & m == m for m, span in masks for k in range(n - span + 1)):
                return False
    return True


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def hashed(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def seeds(h: Column, at: Column, masks: list[str]) -> Column:
    """The seed of each mask at place ``at`` of the word hashes ``h``; null where it does not fit."""
    return F.array(
        *[F.when(at + len(m) <= F.size(h), F.xxhash64(F.lit(m), *[F.get(h, at + k) for k, c in enumerate(m) if c == "1"])) for m in masks]
    )


def contaminated(
    docs: DataFrame, benchmark: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW, min_share: float = MIN_SHARE, min_item: int = MIN_ITEM
) -> DataFrame:
    """``doc_id, item_id, n_equal, item_words, start`` of every overlap: the best diagonal of each pair."""
    if not lossless(min_words, window, min_share):
        raise ValueError("the masks would miss overlaps under this rule")
    items = benchmark.where("item_id IS NOT NULL").select("item_id", hashed(F.col("text")).alias("w")).withColumn("n", F.size("w"))
    items = staged(items.where(F.col("n") >= min_item).distinct().withColumn("item", F.xxhash64("item_id", "w")), "items")
    short = sorted(r["n"] for r in items.where(F.col("n") < LEAST).select("n").distinct().collect())  # fewer than LEAST values
    whole = ["1" * n for n in short]
    masks = [*MASKS, *(m for m in whole if m not in MASKS)]
    placed = items.select("item", "n", "w", F.posexplode("w").alias("at", "_w"))
    placed = placed.select("item", "n", "at", F.posexplode(seeds(F.col("w"), F.col("at"), masks)).alias("mask", "seed"))
    is_whole = F.array(*[F.lit(len(m) if m in whole else 0) for m in masks])
    own = F.when(F.col("n") < LEAST, F.get(is_whole, "mask") == F.col("n")).otherwise(F.col("mask") < len(MASKS))
    item_seeds = staged(placed.where(F.col("seed").isNotNull() & own).groupBy("seed", "item", "n").agg(F.collect_set("at").alias("ats")), "item_seeds")
    n_seeds = item_seeds.count()

    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    places = texts.select("doc_id", hashed(F.col("text")).alias("h")).select("doc_id", "h", F.posexplode("h").alias("pos", "_w"))
    found = places.select("doc_id", "pos", F.explode(seeds(F.col("h"), F.col("pos"), masks)).alias("seed")).where("seed IS NOT NULL")
    found = found.join(small_side(item_seeds.select("seed").distinct(), n_seeds), "seed", "left_semi")
    hits = staged(found.groupBy("doc_id", "seed").agg(F.collect_set("pos").alias("places")), "hits")
    diagonals = F.array_distinct(F.flatten(F.transform("places", lambda p: F.transform("ats", lambda a: p - a))))
    lines = staged(
        hits.join(small_side(item_seeds, n_seeds), "seed").select("doc_id", "item", "n", F.explode(diagonals).alias("start")).distinct(), "lines"
    )
    some = staged(lines.select("doc_id").distinct(), "hit_docs")
    held = texts.join(small_side(some, some.count()), "doc_id", "left_semi").select("doc_id", hashed(F.col("text")).alias("h"))
    inside = F.slice("h", F.greatest("start", F.lit(0)) + 1, F.col("n") + F.least("start", F.lit(0)))
    part = F.when(F.col("start") < 0, F.concat(F.array_repeat(F.lit(None).cast("long"), -F.col("start")), inside)).otherwise(inside)
    laid = lines.join(held, "doc_id").select("doc_id", "item", "start", part.alias("d"))
    laid = laid.join(small_side(items, items.count()), "item")
    marks = F.array_join(F.zip_with("w", "d", lambda a, b: F.when(a == b, F.lit("1")).otherwise(F.lit("0"))), "")
    equal = lambda flags: F.length(F.replace(flags, F.lit("0"), F.lit("")))
    checked = laid.select("doc_id", "item_id", "n", "start", marks.alias("flags")).withColumn("n_equal", equal(F.col("flags")))
    dense = F.exists(F.sequence(F.lit(1), F.greatest(F.col("n") - (window - 1), F.lit(1))), lambda s: equal(F.substring("flags", s, F.lit(window))) >= min_words)
    accepted = (
        F.when(F.col("n") < LEAST, F.col("n_equal") == F.col("n"))
        .when(F.col("n") < window, F.col("n_equal") >= F.ceil(F.lit(min_share) * F.col("n")))
        .otherwise((F.col("n_equal") >= min_words) & dense)
    )
    best = F.max(F.struct("n_equal", (-F.col("start")).alias("late"))).alias("best")
    return (
        checked.where(accepted)
        .groupBy("doc_id", "item_id", "n")
        .agg(best)
        .select("doc_id", "item_id", F.col("best.n_equal").alias("n_equal"), F.col("n").alias("item_words"), (-F.col("best.late")).alias("start"))
    )


def _seed_sql(name: str, key: str) -> str:
    """DuckDB SQL for the seeds of table ``name``: the words under each mask, joined."""
    parts = [
        f"SELECT {key}, p, '{n}' || " + " || chr(1) || ".join(f"w[p + {k + 1}]" for k, c in enumerate(m) if c == "1")
        + f" AS seed FROM (SELECT {key}, w, unnest(range(0, len(w) - {len(m)} + 1)) AS p FROM {name} WHERE len(w) >= {len(m)})"
        for n, m in enumerate(MASKS)
    ]
    return " UNION ALL ".join(parts)


#: The same rows in DuckDB SQL.
SQL = f"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents WHERE doc_id IS NOT NULL
), b AS (
  SELECT DISTINCT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), long_b AS (SELECT * FROM b WHERE len(w) >= {LEAST}), short_b AS (SELECT * FROM b WHERE len(w) BETWEEN {MIN_ITEM} AND {LEAST - 1}),
ds AS ({_seed_sql("d", "doc_id")}), bs AS ({_seed_sql("long_b", "item_id")}),
first_words AS (
  SELECT doc_id, p, w[p + 1] AS f FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS p FROM d WHERE EXISTS (SELECT 1 FROM short_b))
),
h AS (
  SELECT DISTINCT doc_id, item_id, ds.p - bs.p AS diagonal FROM ds JOIN bs USING (seed)
  UNION
  SELECT DISTINCT f.doc_id, s.item_id, f.p AS diagonal FROM first_words f JOIN short_b s ON f.f = s.w[1]
),
c AS (
  SELECT h.doc_id, h.item_id, len(b.w) AS n, h.diagonal,
         array_to_string(list_transform(range(0, len(b.w)), lambda k:
           CASE WHEN k + h.diagonal >= 0 AND b.w[k + 1] = d.w[CAST(k + h.diagonal + 1 AS BIGINT)] THEN '1' ELSE '0' END), '') AS flags
  FROM h JOIN b USING (item_id) JOIN d USING (doc_id) WHERE len(b.w) >= {MIN_ITEM}
),
e AS (SELECT *, length(replace(flags, '0', '')) AS n_equal FROM c)
SELECT doc_id, item_id, CAST(max(n_equal) AS INTEGER) AS n_equal, CAST(n AS INTEGER) AS item_words,
       CAST(arg_min(diagonal, diagonal - 1000000000 * n_equal) AS INTEGER) AS start
FROM e
WHERE CASE WHEN n < {LEAST} THEN n_equal = n
           WHEN n < {WINDOW} THEN n_equal >= ceil({MIN_SHARE} * n)
           ELSE n_equal >= {MIN_WORDS} AND len(list_filter(range(1, n - {WINDOW} + 2), lambda s:
                  length(replace(substr(flags, CAST(s AS BIGINT), {WINDOW}), '0', '')) >= {MIN_WORDS})) > 0 END
GROUP BY doc_id, item_id, n
"""

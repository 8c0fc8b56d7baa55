"""Normal forms: what goes to Python, and in which batches."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F

from graphloom.functions import terms as T
from graphloom.plans import catalog


def test_batches_of_the_query_are_bounded(spark, sf):
    texts = [None, "", "plain", "é", "Å", "a\nb", "ﬁ"]
    frame = spark.createDataFrame([(x,) for x in texts], "x string")
    for form in ("NFC", "NFKD"):
        assert [r[0] for r in frame.select(T.normalize(F.col("x"), form)).collect()] == [x and unicodedata.normalize(form, x) for x in texts]
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    catalog.queries()["fn_fold_normalize"](spark, sf)

    @F.pandas_udf("long")
    def held(s: pd.Series) -> pd.Series:
        return pd.Series([int(s.str.len().sum())] * len(s))

    long = spark.range(0, 60, 1, 1).select(F.repeat(F.lit("éx"), 500_000).alias("x"))
    assert long.select(held("x").alias("n")).agg(F.max("n")).first()[0] <= 8_000_000
    spark.conf.unset(key)

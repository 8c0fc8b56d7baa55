"""Saved queries with named parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEMPLATES = {
    "by_status": "SELECT 'by_status' AS template, o_orderkey FROM {rows} WHERE o_orderstatus = :status",
    "by_date": "SELECT 'by_date' AS template, o_orderkey FROM {rows} WHERE o_orderdate >= CAST(:first AS TIMESTAMP) AND o_orderdate < CAST(:to AS TIMESTAMP)",
    "active": "SELECT 'active' AS template, o_orderkey FROM {rows} WHERE o_orderstatus = :status AND o_totalprice >= CAST(:least AS DOUBLE)",
    "by_domain": "SELECT 'by_domain' AS template, o_orderkey FROM {rows} WHERE o_orderpriority LIKE concat(:prefix, '%')",
    "per_day": "SELECT 'per_day' AS template, min(o_orderkey) AS o_orderkey FROM {rows} GROUP BY to_date(o_orderdate) HAVING count(*) >= CAST(:least AS INT)",
}


def run(spark: SparkSession, name: str, rows: DataFrame, **params: str) -> DataFrame:
    """The template ``name`` over ``rows``; an unknown name is an error."""
    return spark.sql(TEMPLATES[name], args=params, rows=rows)

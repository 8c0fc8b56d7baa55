"""The triples table: schema, relational rows as triples, and scans of it.

A triple is one row ``(s, p, o, o_kind, o_dt, o_lang, o_num, o_ts, g)``.  The lexical value
is ``o``; ``o_num`` and ``o_ts`` are typed projections filled once at load, so that no query
casts per row.  ``o_kind`` is ``iri``, ``lit`` or ``bnode``; ``g`` is the named graph, null
for the default one.  A null cell gives no triple.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TYPE = "rdf:type"
COLUMNS = ("s", "p", "o", "o_kind", "o_dt", "o_lang", "o_num", "o_ts", "g")


@dataclass(frozen=True)
class Entity:
    """How a table becomes triples: subject prefix, key columns, class, and foreign keys (column -> prefix)."""

    name: str
    key: tuple[str, ...]
    cls: str
    refs: dict[str, str] = field(default_factory=dict)
    columns: dict[str, str] = field(default_factory=dict)  # column -> str | int | dec | ts

    @property
    def graph(self) -> str:
        return f"graph/{self.name}"


#: The star schema's entities.
ENTITIES = {
    "region": Entity("region", ("r_regionkey",), "Region", {}, {"r_name": "str"}),
    "nation": Entity("nation", ("n_nationkey",), "Nation", {"n_regionkey": "region"}, {"n_name": "str"}),
    "customer": Entity("customer", ("c_custkey",), "Customer", {"c_nationkey": "nation"}, {"c_name": "str", "c_acctbal": "dec", "c_mktsegment": "str"}),
    "supplier": Entity("supplier", ("s_suppkey",), "Supplier", {"s_nationkey": "nation"}, {"s_name": "str", "s_acctbal": "dec"}),
    "part": Entity("part", ("p_partkey",), "Part", {}, {"p_name": "str", "p_brand": "str", "p_type": "str", "p_size": "int", "p_retailprice": "dec"}),
    "orders": Entity(
        "orders", ("o_orderkey",), "Order", {"o_custkey": "customer"},
        {"o_orderstatus": "str", "o_totalprice": "dec", "o_orderdate": "ts", "o_orderpriority": "str"},
    ),
}
XSD = {"str": None, "int": "xsd:integer", "dec": "xsd:decimal", "ts": "xsd:dateTime"}


def lexical(c: Column, kind: str) -> Column:
    if kind == "dec":
        return c.cast("decimal(18,2)").cast("string")
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss") if kind == "ts" else c.cast("string")


def to_triples(rows: DataFrame, entity: Entity) -> DataFrame:
    """Rows of ``entity`` as triples: the class, a triple per column, foreign keys as IRIs; no shuffle.

    Each predicate is a branch of a union, with its name as a constant: a pattern that binds
    the predicate scans one column of the table, and a filter on its value reaches the scan.
    """
    subject = F.concat_ws("/", F.lit(entity.name), *[F.col(k).cast("string") for k in entity.key]).alias("s")
    null = F.lit(None)

    def branch(p: str, o: Column, kind: str, dt: str | None, num: Column = null, ts: Column = null) -> DataFrame:
        return rows.select(
            subject, F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("o_kind"), F.lit(dt).cast("string").alias("o_dt"), null.cast("string").alias("o_lang"),
            num.cast("double").alias("o_num"), ts.cast("timestamp").alias("o_ts"), F.lit(entity.graph).alias("g"),
        )

    out = branch(TYPE, F.lit(f"class/{entity.cls}"), "iri", None)
    for c, to in entity.refs.items():
        out = out.unionByName(branch(c, F.concat(F.lit(f"{to}/"), F.col(c).cast("string")), "iri", None).where("o IS NOT NULL"))
    for c, k in entity.columns.items():
        one = branch(c, lexical(F.col(c), k), "lit", XSD[k], F.col(c) if k in ("int", "dec") else null, F.col(c) if k == "ts" else null)
        out = out.unionByName(one.where("o IS NOT NULL"))
    return out


def load(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    """Triples of the named tables."""
    out = None
    for n in names:
        one = to_triples(spark.read.parquet(f"{sf_dir}/{n}.parquet"), ENTITIES[n])
        out = one if out is None else out.unionByName(one)
    return out


def load_sql(*names: str) -> str:
    """The same triples as a DuckDB query."""
    parts = []
    for n in names:
        e = ENTITIES[n]
        s = f"'{e.name}/' || " + " || '/' || ".join(f"CAST({k} AS VARCHAR)" for k in e.key)
        row = lambda p, o, kind, dt, num, ts: (
            f"SELECT {s} AS s, '{p}' AS p, {o} AS o, '{kind}' AS o_kind, {dt} AS o_dt, CAST(NULL AS VARCHAR) AS o_lang, "
            f"{num} AS o_num, {ts} AS o_ts, '{e.graph}' AS g FROM {n}"
        )
        no_num, no_ts = "CAST(NULL AS DOUBLE)", "CAST(NULL AS TIMESTAMP)"
        parts.append(row(TYPE, f"'class/{e.cls}'", "iri", "CAST(NULL AS VARCHAR)", no_num, no_ts))
        for c, to in e.refs.items():
            parts.append(row(c, f"'{to}/' || CAST({c} AS VARCHAR)", "iri", "CAST(NULL AS VARCHAR)", no_num, no_ts) + f" WHERE {c} IS NOT NULL")
        for c, k in e.columns.items():
            o = {"dec": f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)", "ts": f"strftime({c}, '%Y-%m-%dT%H:%M:%S')"}.get(k, f"CAST({c} AS VARCHAR)")
            dt = f"'{XSD[k]}'" if XSD[k] else "CAST(NULL AS VARCHAR)"
            parts.append(
                row(c, o, "lit", dt, f"CAST({c} AS DOUBLE)" if k in ("int", "dec") else no_num, c if k == "ts" else no_ts) + f" WHERE {c} IS NOT NULL"
            )
    return " UNION ALL ".join(parts)


def match(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None, g: str | None = None) -> DataFrame:
    """Triples with the given terms; any of the four may be free."""
    for column, value in (("s", s), ("p", p), ("o", o), ("g", g)):
        if value is not None:
            triples = triples.where(F.col(column) == value)
    return triples

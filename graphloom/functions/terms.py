"""Term, string, numeric and hash functions as Column builders; an error of the reference semantics is null.

``REGISTRY`` maps a name to its builder; ``register`` adds one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The numeric datatypes.
NUMERIC = (
    "xsd:integer", "xsd:decimal", "xsd:float", "xsd:double", "xsd:nonPositiveInteger", "xsd:negativeInteger", "xsd:long", "xsd:int",
    "xsd:short", "xsd:byte", "xsd:nonNegativeInteger", "xsd:unsignedLong", "xsd:unsignedInt", "xsd:unsignedShort", "xsd:unsignedByte",
    "xsd:positiveInteger",
)


def ebv() -> Column:
    """Effective boolean value of the object: numbers by value, booleans by name, other text by emptiness."""
    dt = F.col("o_dt")
    return (
        F.when(dt == "xsd:boolean", F.col("o").isin("true", "1"))
        .when(dt.isin(*NUMERIC), F.coalesce(F.col("o_num") != 0, F.lit(False)))
        .otherwise(F.col("o") != "")
    )


def lang() -> Column:
    return F.coalesce("o_lang", F.lit(""))


def langmatches(tag: Column, wanted: str) -> Column:
    """``*`` is any language; ``en`` matches ``en`` and ``en-GB``."""
    if wanted == "*":
        return tag != ""
    return (F.lower(tag) == wanted.lower()) | F.lower(tag).startswith(wanted.lower() + "-")


def datatype() -> Column:
    return F.when(F.col("o_kind") == "lit", F.when(F.col("o_lang").isNotNull(), "rdf:langString").otherwise(F.coalesce("o_dt", F.lit("xsd:string"))))


def is_numeric() -> Column:
    return (F.col("o_kind") == "lit") & F.coalesce(F.col("o_dt").isin(*NUMERIC), F.lit(False))


def same_term(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Equality of all parts of two terms, null equal to null."""
    out = F.lit(True)
    for k in a:
        out = out & a[k].eqNullSafe(b[k])
    return out


def substr(x: Column, start: int, length: int | None = None) -> Column:
    """One-based; what lies before the first character counts against the length."""
    if length is None:
        return F.substr(x, F.lit(max(start, 1)))
    end = start + length
    return F.substr(x, F.lit(max(start, 1)), F.lit(max(end - max(start, 1), 0)))


def strbefore(x: Column, sep: str) -> Column:
    if not sep:
        return F.when(x.isNotNull(), F.lit(""))
    return F.when(F.instr(x, sep) > 0, F.substring_index(x, sep, 1)).when(x.isNotNull(), F.lit(""))


def strafter(x: Column, sep: str) -> Column:
    if not sep:
        return x
    at = F.instr(x, sep)
    return F.when(at > 0, F.substr(x, at + len(sep))).when(x.isNotNull(), F.lit(""))


def inline(pattern: str, flags: str) -> str:
    known = "".join(f for f in flags if f in "ismx")
    return f"(?{known}){pattern}" if known else pattern


def regex(x: Column, pattern: str, flags: str = "") -> Column:
    return F.rlike(x, F.lit(inline(pattern, flags)))


def replace(x: Column, pattern: str, to: str, flags: str | None = None) -> Column:
    """All matches; flags given without ``g`` replace the first only."""
    if flags is None or "g" in flags:
        return F.regexp_replace(x, inline(pattern, flags or ""), to)
    return F.regexp_replace(x, inline(f"^(.*?)(?:{pattern})", flags + "s"), "$1" + to)


def encode_for_uri(x: Column) -> Column:
    out = F.url_encode(x)
    for a, b in (("+", "%20"), ("%7E", "~"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def fold(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def normalize(x: Column, form: str = "NFC") -> Column:
    """Unicode normal form; the one function that Spark's own lack.

    ASCII is its own form, so only other texts go to Python; ``bounded_batches`` bounds what a worker holds of them.
    """
    @F.pandas_udf("string")
    def work(s: pd.Series) -> pd.Series:
        return s.str.normalize(form)

    return F.coalesce(work(F.when(x.rlike("[^\\x00-\\x7F]"), x)), x)


def bounded_batches(spark: SparkSession, most: int = 4 << 20) -> None:
    """From now on the session's Arrow batches hold about ``most`` bytes, however long their texts."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(most))


def round_half_up(x: Column) -> Column:
    """-2.5 rounds to -2."""
    return F.floor(x + 0.5)


def to_hours(ms: Column) -> Column:
    return F.round(ms / 3_600_000.0, 2)


# --- terms as structs ``(kind, value, dt, lang, dir)`` -------------------------------------------------


def term(kind: str, value: Column, dt: Column | None = None, lang_tag: Column | None = None, direction: Column | None = None) -> Column:
    """A term; language tags are in lower case, a direction is ``ltr`` or ``rtl``, and one needs a language."""
    null = F.lit(None).cast("string")
    tag = null if lang_tag is None else F.lower(lang_tag)
    way = null if direction is None else F.when(direction.isin("ltr", "rtl") & tag.isNotNull(), direction)
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"), (null if dt is None else dt).alias("dt"), tag.alias("lang"), way.alias("dir"))


def iri(value: Column) -> Column:
    """Null where the text is no IRI: it needs a scheme and has no white space."""
    return F.when(F.rlike(value, F.lit(r"^[A-Za-z][A-Za-z0-9+.-]*:\S+$")), term("iri", value))


def bnode(label: Column) -> Column:
    return term("bnode", F.concat(F.lit("_:"), label))


def strdt(value: Column, dt: str) -> Column:
    """``xsd:string`` is the plain literal."""
    return term("lit", value, None if dt == "xsd:string" else F.lit(dt))


def strlang(value: Column, tag: Column, direction: Column | None = None) -> Column:
    return term("lit", value, None, tag, direction)


def is_kind(t: Column, kind: str) -> Column:
    return t["kind"] == kind


def langdir(t: Column) -> Column:
    return F.coalesce(t["dir"], F.lit(""))


def has_langdir(t: Column) -> Column:
    return t["dir"].isNotNull()


def uuid_iri() -> Column:
    return F.concat(F.lit("urn:uuid:"), F.uuid())


REGISTRY = {
    "iri": iri, "uri": iri, "bnode": bnode, "strdt": strdt, "strlang": strlang, "strlangdir": strlang, "langdir": langdir, "haslangdir": has_langdir,
    "isiri": lambda t: is_kind(t, "iri"), "isuri": lambda t: is_kind(t, "iri"), "isblank": lambda t: is_kind(t, "bnode"), "isliteral": lambda t: is_kind(t, "lit"),
    "uuid": uuid_iri, "struuid": F.uuid, "rand": F.rand, "now": F.current_timestamp, "contains": F.contains, "strstarts": F.startswith, "strends": F.endswith,
    "lang": lang, "langmatches": langmatches, "datatype": datatype, "isnumeric": is_numeric, "substr": substr, "strbefore": strbefore,
    "strafter": strafter, "regex": regex, "replace": replace, "encode_for_uri": encode_for_uri, "fold": fold, "normalize": normalize,
    "round": round_half_up, "strlen": F.length, "ucase": F.upper, "lcase": F.lower, "concat": F.concat, "abs": F.abs, "ceil": F.ceil,
    "floor": F.floor, "md5": F.md5, "sha1": F.sha1, "sha256": lambda x: F.sha2(x, 256), "sha384": lambda x: F.sha2(x, 384),
    "sha512": lambda x: F.sha2(x, 512), "mstohours": to_hours, "mstominutes": lambda ms: round_half_up(ms / 60_000.0),
    "mstoseconds": lambda ms: round_half_up(ms / 1000.0),
}


def register(name: str, builder) -> None:
    REGISTRY[name.lower()] = builder


def call(name: str, *args) -> Column:
    """A registered function by the local part of its name, in any case; an unknown one is an error."""
    key = name.replace("#", "/").rpartition("/")[2].rpartition(":")[2].lower()
    if key not in REGISTRY:
        raise ValueError(f"no function {name}")
    return REGISTRY[key](*args)

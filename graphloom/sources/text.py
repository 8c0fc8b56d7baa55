"""Text sources and sinks: notes with front matter, N-Triples, flat JSON-LD, typed records, results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FENCE = r"(?s)\A---[ \t]*\r?\n(.*?)\r?\n---[ \t]*(?:\r?\n|\z)"


def notes_to_rows(notes: DataFrame) -> DataFrame:
    """``path, key, pos, value`` of the front matter of notes ``(path, content)``.

    Flat keys and lists only, block (``- x``) or inline (``[a, b]``); quotes go; a note
    without front matter, or with a line that is neither, gives only what can be read.
    """
    body = F.regexp_extract("content", FENCE, 1)
    # list items join their key's line, so that each key is one line
    joined = F.regexp_replace(body, r"\r?\n\s*-\s+", "\x01")
    lines = notes.select("path", F.explode(F.split(joined, r"\r?\n")).alias("line"))
    key = F.trim(F.regexp_extract("line", r"^([A-Za-z0-9_:.\- ]+?)\s*:(.*)$", 1))
    value = F.regexp_extract("line", r"(?s)^[A-Za-z0-9_:.\- ]+?\s*:(.*)$", 1)
    inline = F.regexp_extract(value, r"^\s*\[(.*)\]\s*$", 1)
    items = (
        F.when(F.contains(value, F.lit("\x01")), F.slice(F.split(value, "\x01"), 2, F.size(F.split(value, "\x01"))))
        .when(F.rlike(value, F.lit(r"^\s*\[.*\]\s*$")), F.split(inline, ","))
        .otherwise(F.array(value))
    )
    rows = lines.where(key != "").select("path", key.alias("key"), F.posexplode(items).alias("pos", "raw"))
    clean = F.regexp_replace(F.trim("raw"), r"""^(["'])(.*)\1$""", "$2")
    return rows.select("path", "key", "pos", clean.alias("value")).where("value <> ''")


def unparsable(notes: DataFrame) -> DataFrame:
    """``path, reason`` of notes whose front matter cannot be read: none at all, or a line that is no key, list item or comment."""
    body = F.regexp_extract("content", FENCE, 1)
    bad = F.exists(F.split(body, r"\r?\n"), lambda x: ~F.rlike(x, F.lit(r"^\s*(#.*)?$|^\s*-\s|^[A-Za-z0-9_:.\- ]+?\s*:")))
    reason = F.when(F.coalesce(~F.rlike("content", F.lit(FENCE)), F.lit(True)), "no-front-matter").when(bad, "broken-line")
    return notes.select("path", reason.alias("reason")).where("reason IS NOT NULL")


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as ``(path, content)``."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


NT = r'^\s*(<[^>]*>|_:\S+)\s+<([^>]*)>\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:\^\^<[^>]*>|@[A-Za-z-]+)?)\s*\.\s*$'


#: Pieces of a note's text: fenced code, inline code, embeds, links (name, anchor, alias), a lone bracket or mark, anything else.
PIECES = r"(?s)```.*?(?:```|\z)|`[^`\n]*`|!\[\[[^\]]*\]\]|\[\[[^\]]*\]\]|[^`!\[]+|[`!\[]"
LINK = r"^\[\[([^\]|#^]+)([#^][^\]|]*)?(?:\|[^\]]*)?\]\]$"


#: Prices of a million tokens.
PRICES = {"input": 15.0, "output": 75.0, "cache_read": 1.5}
USAGE = "type string, sessionId string, message struct<usage: struct<input_tokens: string, output_tokens: string, cache_read_input_tokens: string>>, _bad string"


def read_usage(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Turns ``(session, input, output, cache_read)`` of the assistant in JSONL logs, and the lines ``(file, line)`` that are no JSON.

    A line that is empty, of another type or without usage is neither.  A missing or odd count is zero; a line
    without a session belongs to its file.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line")).where(F.trim("line") != "")
    read = lines.withColumn("x", F.from_json("line", USAGE, {"columnNameOfCorruptRecord": "_bad"}))
    used = read.where("x._bad IS NULL AND x.type = 'assistant' AND x.message.usage IS NOT NULL")
    count = lambda c: F.coalesce(F.expr(f"try_cast(x.message.usage.{c} AS double)"), F.lit(0.0)).cast("long")
    turns = used.select(F.coalesce("x.sessionId", "file").alias("session"), count("input_tokens").alias("input"), count("output_tokens").alias("output"), count("cache_read_input_tokens").alias("cache_read"))
    return turns, read.where("x._bad IS NOT NULL").select("file", "line")


def usage_cost(turns: DataFrame, prices: dict[str, float] = PRICES) -> DataFrame:
    """``session``, its turns, sums of tokens and their cost."""
    sums = turns.groupBy("session").agg(F.count("*").alias("turns"), *[F.sum(c).alias(c) for c in prices])
    return sums.withColumn("cost", sum((F.col(c) * p for c, p in prices.items()), F.lit(0.0)) / 1_000_000)


CODE_FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})(.*)", re.S)
WIKILINK = re.compile(r"\[\[([^\]]+)\]\]")


def link_targets(text: str) -> list[str]:
    """Targets of the wikilinks and embeds of a text, without alias and anchor, but for those in fenced code.

    A fence ends at a line of its own character, at least as many of them and nothing else; one
    that never ends runs to the end.  A line of backticks with more backticks behind opens none.
    """
    open_fence, kept = "", []
    for line in text.split("\n"):
        m = CODE_FENCE.match(line)
        if not open_fence:
            if m and (m[1][0] == "~" or "`" not in m[2]):
                open_fence = m[1]
            else:
                kept.append(line)
        elif m and m[1][0] == open_fence[0] and len(m[1]) >= len(open_fence) and not m[2].strip(" \t"):
            open_fence = ""
    found = (inner.split("|")[0].split("#")[0].strip() for inner in WIKILINK.findall("\n".join(kept)))
    return [t for t in found if t]


def wikilinks(texts: DataFrame, key: str, text: str) -> DataFrame:
    """``key, pos, target`` of every wikilink in the texts, in order; a null text has none."""
    import pyarrow as pa

    rows = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def work(batches):
        for batch in batches:
            found = [link_targets(t) if t else [] for t in batch["text"].to_pylist()]
            of = pa.array([k for k, targets in enumerate(found) for _ in targets], pa.int32())
            pos = pa.array([p for targets in found for p in range(len(targets))], pa.int32())
            yield pa.RecordBatch.from_arrays([batch["key"].take(of), pos, pa.array([t for targets in found for t in targets], pa.string())], ["key", "pos", "target"])

    return rows.mapInArrow(work, f"key {kind}, pos int, target string").withColumnRenamed("key", key)


def rewrite_links(texts: DataFrame, renames: DataFrame) -> DataFrame:
    """``id, text, n``: texts (``id, text``) whose links to a renamed target (``old, new``) point to its new name, and how many did.

    Anchors (``#heading``, ``^block``) stay, an alias goes; links in code and embeds are left alone.
    """
    pieces = texts.select("id", F.posexplode(F.regexp_extract_all("text", F.lit(PIECES), F.lit(0))).alias("at", "piece"))
    pieces = pieces.withColumn("old", F.nullif(F.regexp_extract("piece", LINK, 1), F.lit(""))).withColumn("anchor", F.regexp_extract("piece", LINK, 2))
    renamed = pieces.where("old IS NOT NULL").join(renames.select("old", "new"), "old").select("id", "at", F.concat(F.lit("[["), "new", "anchor", F.lit("]]")).alias("fresh"))
    per_text = renamed.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "fresh"))).alias("fresh"), F.count("*").alias("n"))
    own = F.regexp_extract_all("text", F.lit(PIECES), F.lit(0))
    again = F.array_join(F.transform(own, lambda piece, at: F.coalesce(F.element_at("fresh", at), piece)), "")
    out = texts.join(per_text, "id", "left")
    return out.select("id", F.when(F.col("n").isNull(), F.col("text")).otherwise(again).alias("text"), F.coalesce("n", F.lit(0)).alias("n"))


#: What a backslash and one letter stand for in a literal.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def unescaped(text: Column) -> Column:
    """A literal's text with its escapes decoded in one pass: letters, ``\\uXXXX`` and ``\\UXXXXXXXX``; others stay."""
    letters = F.create_map(*[F.lit(x) for a, b in ESCAPES.items() for x in ("\\" + a, b)])
    # two units of a surrogate pair are decoded together
    pairs = F.regexp_extract_all(text, F.lit(r"(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+|\\"), F.lit(0))
    units = lambda p: F.decode(F.unhex(F.replace(p, F.lit("\\u"), F.lit(""))), "UTF-16BE")
    one = lambda p: (
        F.when(p.rlike(r"^\\u[0-9A-Fa-f]{4}"), units(p)).when(p.rlike(r"^\\U[0-9A-Fa-f]{8}"), F.decode(F.unhex(F.substring(p, 3, 8)), "UTF-32"))
        .otherwise(F.coalesce(F.element_at(letters, p), p))
    )
    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(pairs, one), "")).otherwise(text)


def parse_ntriples(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triples of lines ``(value)``, and the lines that are none; comments and blank lines are skipped."""
    live = lines.where(~F.rlike("value", F.lit(r"^\s*(#.*)?$")))
    good = F.rlike("value", F.lit(NT))
    s, p, o = (F.regexp_extract("value", NT, i) for i in (1, 2, 3))
    bare = lambda c: F.regexp_replace(c, r"^<(.*)>$", "$1")
    text = unescaped(F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1))
    literal = o.startswith('"')
    out = live.where(good).select(
        bare(s).alias("s"), p.alias("p"), F.when(literal, text).otherwise(bare(o)).alias("o"),
        F.when(literal, "lit").when(o.startswith("_:"), "bnode").otherwise("iri").alias("o_kind"),
        F.when(literal, F.nullif(F.regexp_extract(o, r'"\^\^<([^>]*)>$', 1), F.lit(""))).alias("o_dt"),
        F.when(literal, F.nullif(F.lower(F.regexp_extract(o, r'"@([A-Za-z-]+)$', 1)), F.lit(""))).alias("o_lang"),
    )
    return out, live.where(~good)


def ntriples_lines(triples: DataFrame) -> DataFrame:
    """One line (``value``) for each triple."""
    node = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    text = F.col("o")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    tail = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.col("o_dt").isNotNull(), F.concat(F.lit("^^<"), "o_dt", F.lit(">"))).otherwise("")
    o = F.when(F.col("o_kind") == "lit", F.concat(F.lit('"'), text, F.lit('"'), tail)).otherwise(node(F.col("o")))
    return triples.select(F.concat(node(F.col("s")), F.lit(" "), node(F.col("p")), F.lit(" "), o, F.lit(" .")).alias("value"))


def write_ntriples(triples: DataFrame, path: str) -> None:
    ntriples_lines(triples).write.text(path)


def jsonld_to_triples(docs: DataFrame) -> DataFrame:
    """``s, p, o, o_kind`` of flat JSON-LD texts ``(value)``: nodes of ``@graph`` with ``@id``, ``@type`` and plain, listed or ``@id`` values."""
    nodes = docs.select(F.explode(F.from_json(F.get_json_object("value", "$.@graph"), "array<map<string,string>>")).alias("n"))
    entries = nodes.select(F.col("n").getItem("@id").alias("s"), F.explode("n").alias("key", "raw")).where("key <> '@id' AND s IS NOT NULL")
    listed = F.when(F.rlike("raw", F.lit(r"^\s*\[")), F.from_json("raw", "array<string>")).otherwise(F.array("raw"))
    one = entries.select("s", "key", F.explode(listed).alias("v"))
    ref = F.get_json_object("v", "$.@id")
    is_ref = F.rlike("v", F.lit(r"^\s*\{")) & ref.isNotNull()
    return one.select(
        "s", F.when(F.col("key") == "@type", "rdf:type").otherwise(F.col("key")).alias("p"),
        F.when(is_ref, ref).otherwise(F.coalesce(F.get_json_object("v", "$.@value"), "v")).alias("o"),
        F.when(is_ref | (F.col("key") == "@type"), "iri").otherwise("lit").alias("o_kind"),
    )


def typed_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Triples ``(s, p, o)`` and rejects ``(id, reason)`` of one-record-per-row RDF.

    ``records`` has ``id, kind`` (namespace, anchor, blank, statement), ``value, subject,
    predicate, object, body``: a statement refers to other records; its body overrides the
    object; an anchor's value is an IRI, a literal may not be a subject.
    """
    terms = records.where("kind <> 'statement'").select("id", "kind", F.when(F.col("kind") == "blank", F.concat(F.lit("_:"), "id")).otherwise(F.col("value")).alias("term"))
    side = lambda n: terms.select(F.col("id").alias(n), F.col("kind").alias(f"{n}_kind"), F.col("term").alias(f"{n}_term"))
    st = records.where("kind = 'statement'")
    j = st.join(side("subject"), "subject", "left").join(side("predicate"), "predicate", "left").join(side("object"), "object", "left")
    o = F.coalesce("body", "object_term")
    reason = (
        F.when(F.col("subject_term").isNull(), "no-subject").when(F.col("subject_kind") == "literal", "literal-subject")
        .when(F.col("predicate_term").isNull(), "no-predicate").when(o.isNull(), "no-object")
    )
    j = j.withColumn("reason", reason).withColumn("o", o)
    good = j.where("reason IS NULL").select(F.col("subject_term").alias("s"), F.col("predicate_term").alias("p"), "o")
    return good, j.where("reason IS NOT NULL").select("id", "reason")


def write_results(answer: DataFrame, path: str, kind: str = "json") -> None:
    """Answers as ``json`` (a line each), ``csv`` with a header, or ``parquet``; another kind is an error."""
    writer = {"json": answer.write.json, "csv": lambda p: answer.write.option("header", True).csv(p), "parquet": answer.write.parquet}
    if kind not in writer:
        raise ValueError(f"no format {kind}")
    writer[kind](path)

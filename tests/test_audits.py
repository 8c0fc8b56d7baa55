"""Audits against plain models: proposed imports in order, keys with near names, links in notes, namespace URLs, datatypes."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from graphloom.operators import domain as W
from graphloom.operators import shapes as V
from graphloom.sources import text as X
from tests.test_large_graphs import reduced
from tests.test_semantics import closure_model, graph, rows


def in_order(known, wanted):
    """Edges one by one: accepted unless their end already reaches their source."""
    taken, conflicts = set(known), set()
    for a, b in sorted(wanted):
        (conflicts if (b, a) in closure_model(taken) or a == b else taken).add((a, b))
    return taken - set(known) | (set(wanted) & set(known)), conflicts


@pytest.mark.parametrize("seed", [0])
def test_edges_are_accepted_in_order(spark, seed):
    rng = random.Random(seed)
    wanted = {(a, b) for a, b in ((rng.randrange(12), rng.randrange(12)) for _ in range(16)) if a != b}
    known = {(0, 5), (5, 7), (8, 2)}
    yes, no = V.accepted_in_order(graph(spark, list(known)), graph(spark, list(wanted)))
    want = in_order(known, wanted)
    assert (set(rows(yes)), set(rows(no))) == want and len(want[1]) > 1


def test_three_edges_that_only_together_close_a_cycle(spark):
    """Each is fine beside the declared imports; two are taken, and the last in order is the conflict."""
    declared = [(2, 10), (4, 30), (20, 5)]
    derived = [(1, 2), (10, 4), (30, 20), (5, 10)]
    got = {tuple(r) for r in V.propose_imports(graph(spark, derived), graph(spark, declared)).collect()}
    yes, no = in_order(set(declared), set(derived))
    assert no == {(30, 20)} and got == {(a, b, "conflict") for a, b in no} | {(a, b, "add") for a, b in reduced(yes | set(declared)) - set(declared)}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_unknown_keys_have_near_names(spark):
    rng = random.Random(3)
    names = {f"{p}__{''.join(rng.choice('abc') for _ in range(rng.randrange(1, 9)))}" for p in ("aa", "bb") for _ in range(25)}
    keys = {f"{p}__{''.join(rng.choice('abc') for _ in range(rng.randrange(1, 10)))}" for p in ("aa", "bb", "zzz") for _ in range(15)} | {"tags", "aa__", None, "aa__aaaaaaaaaaaaaaaaaaaaaaaaa"}
    got = {r["key"]: (r["reason"], r["nearest"]) for r in V.unknown_keys(spark.createDataFrame([(k,) for k in keys] * 2, "key string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()}
    want = {}
    for key in keys - names - {None, "tags", "aa__"}:
        prefix = key.split("__")[0]
        near = sorted((distance(key, n), n) for n in names if n.startswith(prefix + "__"))
        near = [n for d, n in near if d <= max(3, int(len(key) * 0.4))][:3]
        want[key] = ("unknown-name" if prefix != "zzz" else "unknown-prefix", near)
    assert got == want and any(len(n) == 3 for _, n in want.values())
    assert V.unknown_keys(spark.createDataFrame([("a__b",)], "key string"), spark.createDataFrame([], "name string")).count() == 0


def test_links_of_notes(spark):
    texts = {
        1: "[[A]] ![[B#h]] [[C|x]] [[D#^b|y]] [[#here]] [[ E ]] [[]] `[[F]]`",
        2: "```\n[[no]]\n```\n[[yes]]\n~~~ lang\n[[no]]\n```\n[[no]]\n~~~~~\n[[yes2]]",
        3: "````\n```\n[[no]]\n```\n````\n[[yes]]\n  ```\n[[no]]",
        4: "```code``` [[yes]]\n[[yes2]]",
        5: "```\n[[no]]\n``` not an end\n[[no]]",
        6: None,
        7: "",
        8: "[[a|b|c]] [[x#y#z]] [[two\nlines]] [[open [[in]]",
    }
    got = rows(X.wikilinks(spark.createDataFrame(list(texts.items()), "id long, text string"), "id", "text"))
    assert got == sorted([
        (1, 0, "A"), (1, 1, "B"), (1, 2, "C"), (1, 3, "D"), (1, 4, "E"), (1, 5, "F"), (2, 0, "yes"), (2, 1, "yes2"), (3, 0, "yes"), (4, 0, "yes"), (4, 1, "yes2"),
        (8, 0, "a"), (8, 1, "x"), (8, 2, "two\nlines"), (8, 3, "open [[in"),
    ], key=repr)


def test_namespace_urls(spark):
    urls = {"https://a.org/ns#": "ok", "https://a.org/ns": "no-hash", "https://a.org/ns#x": "no-hash", "https://a.org/ns//": "no-hash", "https://b.org/ns": "foreign", "ns": "unparsable", None: "unparsable", "https://a.org/x#y#": "ok"}
    got = V.url_form(spark.createDataFrame([(u,) for u in urls], "url string"), "url", r"a\.org").collect()
    assert {r["url"]: r["verdict"] for r in got} == urls
    assert {r["url"]: r["expected"] for r in got if r["expected"]} == {"https://a.org/ns": "https://a.org/ns#", "https://a.org/ns#x": "https://a.org/ns#x#", "https://a.org/ns//": "https://a.org/ns#"}


def test_schemes_of_absolute_iris(spark):
    good = ["http://a", "HTTPS://a/b?c#d", "urn:x:y", "mailto:a@b", "obsidian://v/n.md", "ftp:a", "data:,x"]
    bad = ["foo:bar", "a/b", "", "http://", "http:", "javascript:x", "http://a b", "//a", ":x", "1http://a"]
    df = spark.createDataFrame([(x,) for x in good + bad], "v string")
    fits = V.literal_fits(F.col("v"), F.lit("xsd:string"), F.lit("xsd:anyURI"))
    assert {r["v"] for r in df.where(fits).collect()} == set(good)


def test_counts_of_imports(spark):
    rng = random.Random(5)
    files = [(f"f{k}", f"n{k}", rng.choice(["g1", "g2", "g3", None])) for k in range(12)] + [("t1", "twin", "g1"), ("t2", "twin", "g2")]
    links = [(rng.choice(files)[0], rng.choice([f"n{k}" for k in range(14)] + ["twin", "a.png"])) for _ in range(150)]
    audited = V.imports_audit(spark.createDataFrame(links, "src string, name string"), spark.createDataFrame(files, "path string, name string, grp string"), spark.createDataFrame([("g1", "g2")], "src string, dst string"))
    found = [(r["src"], r["grp"], r["target_grp"], r["bucket"]) for r in audited.collect()]
    pairs, groups = {}, {}
    for src, a, b, bucket in found:
        if bucket == "internal":
            groups.setdefault(a, [0, 0, 0, 0, set(), set()])[0] += 1
        elif bucket in ("valid", "violation"):
            pairs.setdefault((a, b), []).append((src, bucket))
            groups.setdefault(a, [0, 0, 0, 0, set(), set()])
            groups.setdefault(b, [0, 0, 0, 0, set(), set()])
            groups[a][1] += 1
            groups[b][2] += 1
            groups[a][3] += bucket == "violation"
            groups[a][4].add(b)
            groups[b][5].add(a)
    assert rows(V.import_groups(audited)) == sorted(((g, i, o, n, v, len(x), len(y)) for g, (i, o, n, v, x, y) in groups.items()), key=repr)
    want = [(a, b, len(x), x[0][1] == "valid", sorted({s for s, _ in x})[:3] if x[0][1] == "violation" else []) for (a, b), x in pairs.items()]
    assert rows(V.import_pairs(audited)) == sorted(want, key=repr) and len(want) > 3
    assert all(len({k for _, k in own}) == 1 for own in pairs.values()) and list(itertools.chain(want))


@pytest.mark.parametrize("hot", [W.HOT_CELL, 2])
def test_overlaps_of_all_lengths(spark, hot):
    rng = random.Random(8)
    found = [(k, rng.choice("xy"), (s := rng.randrange(60_000)), s + rng.choice([0, 1, 5, 30, 400, 3_000, 50_000])) for k in range(220)] + [(900, "x", None, 5), (901, "y", 9, 3), (902, "x", -900, 90_000)]
    df = spark.createDataFrame(found, "k long, g string, a long, b long").withColumns({c: F.timestamp_seconds(F.col(c) * 7200) for c in ("a", "b")})
    live = [r for r in found if r[2] is not None and r[2] < r[3]]
    want = [(g, k, j) for k, g, a, b in live for j, h, c, d in live if g == h and k < j and a < d and c < b]
    assert rows(W.overlaps(df, "k", "a", "b", by=["g"], hot=hot).select("g", "k1", "k2")) == sorted(want, key=repr) and len(want) > 1000


def test_usage_of_logs(spark, tmp_path):
    lines = ['{"type":"assistant","sessionId":"s","message":{"usage":{"input_tokens":10,"output_tokens":"4"}}}', '{"type":"user","sessionId":"s","message":{"usage":{"input_tokens":10}}}', "", "{broken", '{"type":"assistant","message":{}}', '{"type":"assistant","sessionId":"s","message":{"usage":{"input_tokens":null,"cache_read_input_tokens":1000000}}}', '{"type":"assistant","message":{"usage":{"output_tokens":1}}}']
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    turns, bad = X.read_usage(spark, str(tmp_path))
    assert [r["line"] for r in bad.collect()] == ["{broken"]
    got = {r["session"].rpartition("/")[2]: tuple(r)[1:] for r in X.usage_cost(turns).collect()}
    assert got == {"s": (2, 10, 4, 1_000_000, pytest.approx((150 + 300 + 1_500_000) / 1e6)), "a.jsonl": (1, 0, 1, 0, pytest.approx(75e-6))}


def test_notes_with_front_matter_and_code_fences(spark):
    from graphloom.sources import text as X

    content = "---\nlabel: a\n---\nBody [[x]]\n```\n[[y]]\n```\n~~~\n[[z]]\n~~~~\n[[w]]"
    notes = spark.createDataFrame([("n", content), ("m", "no front [[v]]")], "path string, content string")
    assert [tuple(r) for r in X.notes_to_rows(notes).collect()] == [("n", "label", 0, "a")]
    assert [tuple(r) for r in X.unparsable(notes).collect()] == [("m", "no-front-matter")]
    assert sorted((r["path"], r["target"]) for r in X.wikilinks(notes, "path", "content").collect()) == [("m", "v"), ("n", "w"), ("n", "x")]


def test_tags_end_at_accents_as_in_sql(spark, tmp_path):
    from tests.compare import difference, duck

    from graphloom.plans import catalog

    texts = ["déonabcdef thabcdef", "thabcdefé x thabcdef_", "onabcdef, thabcdefg ONABCDEF", "THABCDEF-éthghijkl"]
    spark.createDataFrame([(k, t, "en", f"s{k % 2}") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/t")
    next((tmp_path / "t").glob("part-*.parquet")).rename(tmp_path / "documents.parquet")
    assert not difference(catalog.queries()["tag_traceability"](spark, str(tmp_path)), duck(str(tmp_path)), catalog.oracle_sql()["tag_traceability"])

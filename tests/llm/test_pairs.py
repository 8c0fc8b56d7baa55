from __future__ import annotations

import io
import itertools
import random
import re
import zipfile

import numpy as np
import pytest

from graphloom.llm import neardup, vectors, zipwarc
from graphloom.llm.common import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def classes(ids, linked):
    low = {i: i for i in ids}
    while True:
        before = dict(low)
        for a, b in linked:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low


def near_model(docs):
    sets = {i: shingles(t) for i, t in docs}
    linked = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, classes(sets, linked)


def made(seed):
    """Groups of near copies, exact copies, a passage that many share, chains, short and empty texts."""
    r = random.Random(seed)
    word = lambda: r.choice("bdfgklm") + r.choice("aeiou") + str(r.randrange(300))
    texts, passage = [], [word() for _ in range(30)]
    for size in (1, 2, 5, 70):
        base = [word() for _ in range(80)]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randrange(0, 6)):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += [texts[0].upper()] * 9
    for _ in range(60):
        texts.append(" ".join([word() for _ in range(r.choice([2, 10, 60]))] + passage))
    chain = [word() for _ in range(200)]
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 90, 6)]
    texts += ["", None, "   ", "one two", "One  two", "a b c d", "a b c d e", "a b c d e", "Été x y z w", "é " * 400]
    r.shuffle(texts)
    return [(i * 2 + 5, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_all_pairs(spark, seed):
    docs = made(seed)
    got = neardup.near_duplicates(spark.createDataFrame([(i, t, "n", 1) for i, t in docs], "doc_id long, text string, n string, component long")).collect()
    sizes, low = near_model(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (sizes[i], low[i]) for i, _ in docs}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_of_the_table_against_all_pairs(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = neardup.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    sizes, low = near_model(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (sizes[i], low[i]) for i, _ in docs}


def test_near_duplicates_edges(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["component_id"], r["kept"]) for r in got) == [("1", 1, True), ("1", 1, True), ("2", 2, True), ("None", None, True)]
    assert neardup.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_components_on_random_graphs(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7), (None, 3)]
    ids = [*range(60), *range(100, 131), 200]
    got = components(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(edges, "a long, b long"))
    assert {x["id"]: x["component"] for x in got.collect()} == classes(ids, [e for e in edges if None not in e])


# --- vectors ------------------------------------------------------------------------------------------


def vector_rows(seed, n=300, d=16):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    x[100:160] = x[100] + r.normal(size=(60, d)) * 0.05 * np.linalg.norm(x[100]) / 4
    x[200:210] = x[200]
    return [(i, [float(v) for v in row], int(i % 2 if i >= 210 else 0)) for i, row in enumerate(x)]


def test_vectors_against_all_pairs(spark):
    rows = vector_rows(3)
    got = {x["vec_id"]: x for x in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    x = np.array([v for _, v, _ in rows], np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.98) & (np.array([b for *_, b in rows])[:, None] == np.array([b for *_, b in rows])[None, :])
    np.fill_diagonal(near, False)
    low = classes(range(len(rows)), list(zip(*np.nonzero(near), strict=True)))
    found = sum(got[i]["n_links"] for i in got)
    assert found >= 0.98 * near.sum() and all(got[i]["n_links"] <= near[i].sum() for i in got)
    assert np.mean([got[i]["component_id"] == low[i] for i in got]) > 0.99


def test_vectors_that_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [nan, 1.0], 0), (5, [inf, 1.0], 0), (6, [None, 1.0], 0), (7, [1.0, 0.0], None), (8, [1.0, 0.0], 0), (9, [2.0, 0.0], 0), (10, [1.0, 0.0, 0.0], 0), (None, [1.0, 0.0], 0), (11, [1.0, 0.0], 0)]
    frame = spark.createDataFrame([(*r, 9, "x") for r in rows], "vec_id long, embedding array<float>, label int, n_links int, id string")
    got = {x["vec_id"]: (x["n_links"], x["component_id"], x["kept"]) for x in vectors.near_duplicates(frame).collect()}
    assert all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 5, 6, 7, 10)) and got[None] == (0, None, True)
    assert got[8] == (2, 8, True) and got[9] == (2, 8, False) and got[11] == (2, 8, False)
    assert vectors.near_duplicates(frame.limit(0)).count() == 0


def plain_links(x, label, least=0.98):
    near = (x @ x.T >= least) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    return near


def test_vectors_of_a_tight_group_link_all_with_all(spark):
    r = np.random.default_rng(5)
    x = np.concatenate((r.normal(size=64) + 0.08 * r.normal(size=(4000, 64)), r.normal(size=(500, 64))))
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = vectors.near_duplicates(frame).toPandas().sort_values("vec_id")
    near = plain_links(vectors.unit(x), np.zeros(len(x)))
    assert (near[:4000].sum(axis=1) > 3900).all()
    assert got["n_links"].sum() >= 0.98 * near.sum() and (got["n_links"].to_numpy() <= near.sum(axis=1)).all()
    assert (got["component_id"].to_numpy()[:4000] == 0).all()


def test_audit_of_the_search_and_its_exact_way(spark):
    r = np.random.default_rng(7)
    x = vectors.unit(np.repeat(r.normal(size=(60, 16)), 10, axis=0) + 0.02 * r.normal(size=(600, 16)))
    ids, held = np.arange(600), np.arange(600) % 2 == 0
    near = [None] * 600
    for k, n in zip(np.flatnonzero(held), vectors.prune(x[held] @ x[held].T), strict=True):
        near[k] = np.flatnonzero(held)[n]
    want = set(zip(*np.nonzero((x @ x.T >= 0.98) & ~held[:, None] & held), strict=True))
    i, j, true, got = vectors.searched(ids, x, near, held, False, 0.98)
    assert true > 0 and got >= 0.98 * true and len(set(zip(i, j, strict=True)) & want) >= 0.98 * len(want) and set(zip(i, j, strict=True)) <= want
    i, j, true, got = vectors.searched(ids, x, [None] * 600, held, False, 0.98)  # a graph without edges finds next to nothing
    assert got < 0.5 * true and set(zip(i, j, strict=True)) == want


def test_large_cells_are_split_and_vectors_of_any_size_count(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_NODES", 30)
    monkeypatch.setattr(vectors, "SAMPLE", 100)
    r = np.random.default_rng(9)
    x = np.repeat(r.normal(size=(90, 8)), 4, axis=0) + 0.01 * r.normal(size=(360, 8))
    x[:4] *= 1e200
    frame = spark.createDataFrame([(i, v.tolist(), 3, "c", 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int, cell string, kind int")
    nodes = vectors.usable(frame)
    assert len(vectors.centroids(nodes)["3", 8]) >= 12
    got = vectors.near_duplicates(frame).toPandas().sort_values("vec_id")
    assert (got["n_links"].to_numpy() == plain_links(vectors.unit(x), np.zeros(360)).sum(axis=1)).all()


@pytest.mark.parametrize("least", [0.98, 0.6, 0.0, -0.5])
def test_cells_left_out_hold_no_link(least):
    r = np.random.default_rng(6)
    x = vectors.unit(np.concatenate((r.normal(size=(600, 4)), r.normal(size=4) + 0.05 * r.normal(size=(200, 4)))))
    c = x[r.choice(len(x), 25, replace=False)]
    home, near = vectors.reachable(x @ c.T, c, least)
    i, j = np.nonzero(x @ x.T >= least)
    assert near[i, home[j]].all() and (least < 0.9 or not near.all())


def test_blocks_give_counts_and_components(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CELL_NODES", 20)
    monkeypatch.setattr(vectors, "BLOCK_NODES", 7)
    rows = vector_rows(4)
    got = {x["vec_id"]: x for x in vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    x = vectors.unit(np.array([v for _, v, _ in rows], np.float32))
    label = np.array([b for *_, b in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    low = classes(range(len(rows)), list(zip(*np.nonzero(near), strict=True)))
    assert {i: (g["n_links"], g["component_id"]) for i, g in got.items()} == {i: (near[i].sum(), low[i]) for i in range(len(rows))}


def test_graph_search_in_one_part():
    x = vectors.unit(np.random.default_rng(1).normal(size=(400, 8)))
    found = vectors.in_range(x, x, vectors.prune(x @ x.T), 0.9, np.arange(400))
    assert len(found) >= 0.95 * (x @ x.T >= 0.9).sum() and ((x @ x.T)[found[:, 0], found[:, 1]] >= 0.9).all()
    assert vectors.prune(np.ones((1, 1)))[0].size == 0


# --- archives -----------------------------------------------------------------------------------------


def test_zip_directories():
    for wide in (False, True):
        raw = io.BytesIO()
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_STORED) as z:
            for n in ("a.txt", "b/c.bin"):
                with z.open(zipfile.ZipInfo(n), "w", force_zip64=wide) as m:
                    m.write(n.encode() * 9)
            z.writestr(zipfile.ZipInfo("packed"), b"x" * 99, zipfile.ZIP_DEFLATED)
            z.comment = b"PK note"
        found = zipwarc.zip_members(raw, len(raw.getvalue()))
        assert set(found) == {"a.txt", "b/c.bin"}
        for n, (at, size) in found.items():
            assert raw.getvalue()[at : at + size] == n.encode() * 9
    with pytest.raises(ValueError, match="not a ZIP"):
        zipwarc.zip_members(io.BytesIO(b"nothing"), 7)


def test_zip64_end_record(monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 2)
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for i in range(5):
            z.writestr(f"f{i}", b"%d" % i)
    assert b"PK\6\6" in raw.getvalue() and len(zipwarc.zip_members(raw, len(raw.getvalue()))) == 5


def test_packages_are_closed_at_their_size(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(zipwarc, "PACKAGE_BYTES", 600)
    frame = spark.createDataFrame([(i, "u", f"page {i} " * 20) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    folder = f"file://{tmp_path}/wacz"
    manifest = zipwarc.write_packages(zipwarc.mark_revisits(frame), folder)
    assert manifest.count() > 5 and manifest.agg({"records": "sum"}).first()[0] == 20
    got = zipwarc.read_records(zipwarc.read_index(manifest, folder), folder)
    assert sorted((r["page_id"], r["payload_bytes"]) for r in got.collect()) == [(i, len(f"page {i} ") * 20) for i in range(20)]


def test_warc_round_trip_edges(spark):
    long = "é" * 60
    rows = [(5, "http://a/ b\r\nX: y", long), (3, None, long), (9, "u", long), (1, "u", "short"), (2, "u", "short"), (4, "u", None), (None, "u", long), (5, "http://a/", long)]
    frame = spark.createDataFrame([(*r, "d") for r in rows], "page_id long, url string, html string, digest string")
    got = zipwarc.round_trip(frame).collect()
    assert len(got) == 8
    kinds = sorted((str(r["page_id"]), r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert kinds == [("1", "response", None, 5), ("2", "response", None, 5), ("3", "response", None, 120), ("4", "response", None, 0), ("5", "revisit", 3, 120), ("5", "revisit", 3, 120), ("9", "revisit", 3, 120), ("None", "revisit", 3, 120)]
    assert zipwarc.round_trip(frame.limit(0)).count() == 0


def test_record_codec():
    raw = zipwarc.warc_record(7, "http://x/\n", b"pay\r\n\r\nload", "d", None)
    h, payload = zipwarc.parse_record(raw)
    assert payload == b"pay\r\n\r\nload" and zipwarc.number(h["warc-record-id"]) == 7 and h["warc-target-uri"] == "http://x/%0A"
    h, payload = zipwarc.parse_record(zipwarc.warc_record(None, None, b"abc", "d", 7))
    assert payload == b"" and h["warc-type"] == "revisit" and zipwarc.number(h["warc-refers-to"]) == 7 and zipwarc.number(h["warc-record-id"]) is None

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import repair, separators
from graphloom.llm.encode import Block, Encoder, encoder, spread

PATH = str(public_tokenizers.path("word_bpe_49k.json"))
TEXTS = [
    "Hello, World!! it's fine... don't", "", None, "###ab\"### $$$ 12 a1b2 x.y,z | | |", "<|endoftext|> tail <|startoftext|>x", "É café́ ñandú. Nbsp",
    "a " * 500, "same same same", "same same same", "\t\n \r", "über.\nZwei  Wörter;\x0bok", "A" * 3000, "token$$$ token&&& |x| (y) it's' 's",
]


def plain(text):
    return encoder(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids


def test_encoding_by_words_equals_encoding_whole_texts():
    ids, n = encoder(PATH).encode(pa.array(TEXTS, pa.string())).ids()
    ends = np.cumsum(n)
    for t, a, b in zip(TEXTS, ends - n, ends, strict=True):
        assert ids[a:b].tolist() == plain(t), t


def test_every_character_before_and_after_punctuation():
    encode, tokenizer = encoder(PATH).encode, encoder(PATH).tokenizer
    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    chars = chars[:0x3000] + chars[0x3000::37]
    for at in range(0, len(chars), 20_000):
        texts = [f"x{c}. {c}!{c}" for c in chars[at : at + 20_000]]
        ids, n = encode(pa.array(texts)).ids()
        cut = np.split(ids, np.cumsum(n)[:-1])
        for t, own, whole in zip(texts, cut, tokenizer.encode_batch(texts, add_special_tokens=False), strict=True):
            assert own.tolist() == whole.ids, t


def test_letters_that_normalise_to_more_than_one():
    words = ["TATLISES\u0130", "\u0958\u0959", "\u09dc\u09df", "\u0a33", "\u0b5c", "\ufb2a", "stra\u00dfe", "I\u0307", "e\u0301"]
    texts = [w + t for w in words for t in ("", ".", "!)", ".x", "' s")]
    ids, n = encoder(PATH).encode(pa.array(texts)).ids()
    for t, own in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert own.tolist() == plain(t), t


def test_other_tokenizers_encode_whole_texts():
    enc = Encoder(str(public_tokenizers.path("byte_bpe_50k.json")))
    assert encoder(PATH).by_words and not enc.by_words
    texts = ["Hello,  world. x", "", "tab\tand\n lines", "É!"]
    ids, n = enc.encode(pa.array(texts)).ids()
    for t, own in zip(texts, np.split(ids, np.cumsum(n)[:-1]), strict=True):
        assert own.tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids


def test_spread():
    flat = np.arange(10)
    assert spread(flat, np.array([3, 5, 0]), np.array([2, 0, 3])).tolist() == [3, 4, 0, 1, 2]
    assert spread(flat, np.array([1]), np.array([0])).tolist() == []


@pytest.mark.parametrize("seed", range(4))
def test_grammar_round_trip_and_windows(seed):
    r = np.random.default_rng(seed)
    segments = [r.integers(0, 6, r.integers(1, 9)) for _ in range(12)] + [np.full(20, 3)]
    lengths = np.array([len(s) for s in segments])
    starts = np.cumsum(lengths) - lengths
    pieces = r.integers(0, len(segments), 400)
    offsets = np.concatenate(([0], np.sort(r.integers(0, 401, 30)), [400]))
    block = Block(pieces, offsets, np.concatenate(segments).astype(np.uint32), starts, lengths)
    want, n = block.ids()
    grammar, symbols, at = repair.compress(block, 6)
    assert len(symbols) < len(want)
    pairs = np.column_stack((grammar.left, grammar.right)).reshape(-1)
    row = {
        "terminals": 6, "doc_tokens": n.astype("<u4").tobytes(), "symbol_starts": at.astype("<u4").tobytes(), "rules": pairs.astype("<u4").tobytes(),
        "rule_lengths": grammar.lengths.astype("<u4").tobytes(), "symbols": symbols.astype("<u4").tobytes(),
        "doc_ids": np.arange(len(n), dtype="<i8").tobytes(), "id_null": bytes(len(n)),
    }
    reader = repair.Reader(row)
    assert (reader.ids() == want).all()
    ends = np.cumsum(n)
    for d in range(len(n)):
        own = want[ends[d] - n[d] : ends[d]]
        assert (reader.ids(d, d + 1) == own).all()
        if n[d] > 3:
            assert (reader.window(d, 1, n[d] - 1) == own[1:-1]).all()
            assert (reader.window(d, 2, 3) == own[2:3]).all()


def plain_repair(ids, least):
    """Replaces the most frequent pair, one at a time, until none occurs ``least`` times."""
    ids, top = list(ids), max(ids) + 1
    while True:
        counts, k = Counter(), 0
        while k + 1 < len(ids):  # a run of one symbol holds half as many pairs
            counts[ids[k], ids[k + 1]] += 1
            k += 1 + (k + 2 < len(ids) and ids[k] == ids[k + 1] == ids[k + 2])
        if not counts or max(counts.values()) < least:
            return ids
        pair = max(counts, key=counts.get)
        out, k = [], 0
        while k < len(ids):
            hit = tuple(ids[k : k + 2]) == pair
            out.append(top if hit else ids[k])
            k += 1 + hit
        ids, top = out, top + 1


@pytest.mark.parametrize("seed", range(3))
def test_grammar_ends_without_a_frequent_pair_and_near_plain_repair(seed):
    r = np.random.default_rng(seed)
    phrases = [r.integers(0, 40, 12) for _ in range(30)]
    ids = np.concatenate([phrases[k] if k < 30 else r.integers(0, 40, 12) for k in r.integers(0, 40, 200)])
    block = Block(np.arange(len(ids)), np.array([0, len(ids)]), ids.astype(np.uint32), np.arange(len(ids)), np.ones(len(ids), np.int64))
    grammar, symbols, _ = repair.compress(block, 40, min_count=4)
    assert max(Counter(zip(symbols[:-1].tolist(), symbols[1:].tolist(), strict=True)).values()) < 4 + 2
    whole = plain_repair(ids.tolist(), 4)
    assert len(symbols) <= 1.15 * len(whole)
    copies = np.tile(phrases[0], 400)  # a passage that repeats shrinks to next to nothing
    one = Block(np.zeros(400, np.int64), np.array([0, 400]), phrases[0].astype(np.uint32), np.array([0]), np.array([12]))
    assert len(repair.compress(one, 40)[1]) < 12 and (one.ids()[0] == copies).all()


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, symbols string, start int")


def test_token_file_round_trip(spark):
    rows = [(i * 3, t, "x", 1) for i, t in enumerate(TEXTS)]
    got = {r["doc_id"]: r for r in repair.tokenised(docs(spark, rows), PATH).collect()}
    start = 0
    for i, t, *_ in rows:
        ids = [*plain(t), 2]
        r = got[i]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_file_nulls_repeats_and_empty(spark):
    rows = [(None, "n", "", 0), (1, "a b", "", 0), (1, "a b", "", 0), (2, None, "", 0)]
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in repair.tokenised(docs(spark, rows), PATH).collect())
    assert [x[1] for x in got] == [None, 1, 1, 2] and got[-1][2] == 1 and got[1][0] == got[0][2]
    assert repair.tokenised(docs(spark, []), PATH).count() == 0


def test_scan_stitches_documents_over_blocks(spark):
    r = np.random.default_rng(1)
    ids = r.integers(1, 50, 1000)
    ids[r.integers(0, 1000, 60)] = 0
    ids[[0, 1, 999]] = [0, 0, 7]
    cut = [0, 1, 2, 300, 300, 301, 750, 1000]
    blocks = [("f", i, ids[a:b].astype("<u2").tobytes()) for i, (a, b) in enumerate(zip(cut, cut[1:], strict=False))] + [("g", 0, b""), ("h", 0, np.array([5, 0], "<u2").tobytes())]
    frame = spark.createDataFrame(blocks, "file string, block long, payload binary")
    got = [tuple(x) for x in separators.scan(frame, 0).orderBy("file", "ordinal").collect()]
    want, last = [], -1
    for p in np.flatnonzero(ids == 0):
        want.append(("f", len(want), last + 1, int(p) - last, True))
        last = int(p)
    want.append(("f", len(want), last + 1, 999 - last, False))
    assert got == [*want, ("h", 0, 0, 2, True)]
    with pytest.raises(Exception, match="buffer size"):
        separators.scan(spark.createDataFrame([("f", 0, b"abc")], "file string, block long, payload binary"), 0).collect()


def test_counts_equal_plain_encoding(spark):
    rows = [(i, t, "", 0) for i, t in enumerate(TEXTS) if not t or "<|" not in t]
    got = {r["doc_id"]: r["n_tokens"] for r in separators.counted(docs(spark, rows).repartition(3), PATH).collect()}
    assert got == {i: len(plain(t)) + 1 for i, t, *_ in rows}
    assert separators.counted(docs(spark, []), PATH).count() == 0


def test_special_tokens_in_texts_are_counted_as_text(spark):
    texts = [*TEXTS, "a<|endoftext|>b <|endoftext|>", "after", None, "<|endoftext|>", "last one"]
    tokenizer = encoder(PATH).tokenizer
    tokenizer.encode_special_tokens = True
    want = [len(plain(t)) + 1 for t in texts]
    tokenizer.encode_special_tokens = False
    rows = [(i, t, "", 0) for i, t in enumerate(texts)]
    got = separators.counted(docs(spark, rows).coalesce(1), PATH).orderBy("ordinal").collect()
    assert [(r["doc_id"], r["n_tokens"]) for r in got] == list(enumerate(want))
    assert [r["start"] for r in got] == [sum(want[:i]) for i in range(len(want))]


def test_files_and_their_order_must_agree(spark, monkeypatch):
    whole = separators.write_flat

    def short(frame, path, *rest, **more):
        whole(frame.where("doc_id > 0"), path, *rest, **more)
        extra = [("order", 99, 0, None, [7])]
        spark.createDataFrame(extra, "kind string, file long, block long, payload binary, doc_ids array<long>").write.mode("append").partitionBy("kind").parquet(path)

    monkeypatch.setattr(separators, "write_flat", short)
    with pytest.raises(Exception, match="closed documents and ordered ids differ"):
        separators.counted(docs(spark, [(i, "a b", "", 0) for i in range(5)]), PATH).collect()


def test_ids_must_fit_the_width(spark, tmp_path):
    with pytest.raises(Exception, match="does not fit into 1 bytes"):
        separators.write_flat(docs(spark, [(1, "some words of a text", "", 0)]), f"file://{tmp_path}/flat", PATH, "<|endoftext|>", width=1)


@pytest.mark.parametrize("range_bytes", [4, 8, 12, 1 << 20])
def test_ranges_of_raw_files(spark, tmp_path, range_bytes):
    (tmp_path / "raw").mkdir()
    r = np.random.default_rng(2)
    files = {"a.bin": r.integers(0, 4, 100), "b.bin": np.array([3]), "c.bin": np.zeros(0, int), "d.bin": np.array([1, 0])}
    for name, ids in files.items():
        ids.astype("<u4").tofile(tmp_path / "raw" / name)
    got = separators.scan(separators.flat_files(spark, f"file://{tmp_path}/raw", range_bytes), 0, width=4).collect()
    found = {(x["file"].rsplit("/", 1)[1], x["ordinal"]): (x["start"], x["n_tokens"], x["closed"]) for x in got}
    want = {}
    for name, ids in files.items():
        cuts = [*(np.flatnonzero(ids == 0) + 1).tolist()]
        ends = cuts if len(ids) == 0 or cuts and cuts[-1] == len(ids) else [*cuts, len(ids)]
        for k, (a, b) in enumerate(zip([0, *ends], ends, strict=False)):
            want[name, k] = (a, b - a, k < len(cuts))
    assert found == want


def test_raw_files(spark, tmp_path):
    np.array([4, 4, 0, 5, 0], "<u4").tofile(tmp_path / "a.bin")
    raw = spark.read.format("binaryFile").load(f"file://{tmp_path}/*.bin").select(F.col("path").alias("file"), F.lit(0).alias("block"), F.col("content").alias("payload"))
    assert sorted(r["n_tokens"] for r in separators.scan(raw, 0, width=4).collect()) == [2, 3]


def test_written_files_hold_ids_alone(spark, tmp_path):
    texts = [t for t in TEXTS if not t or "<|" not in t]
    path = f"file://{tmp_path}/flat"
    separators.write_flat(docs(spark, [(i, t, "", 0) for i, t in enumerate(texts)]).coalesce(1), path, PATH, "<|endoftext|>")
    (raw,) = (tmp_path / "flat" / "_raw").iterdir()
    (tmp_path / "flat" / "_raw" / "00000-ab.bin").write_bytes(b"left by a task that was lost")
    ids = np.fromfile(raw, "<u2")
    end = encoder(PATH).tokenizer.token_to_id("<|endoftext|>")
    assert ids.tolist() == [x for t in texts for x in (*plain(t), end)]
    found = separators.scan(separators.flat_files(spark, f"{path}/_raw/{raw.name}", 64), end)
    assert [r["n_tokens"] for r in found.orderBy("ordinal").collect()] == [len(plain(t)) + 1 for t in texts]

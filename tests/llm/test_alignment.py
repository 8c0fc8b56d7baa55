from __future__ import annotations

import glob
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from graphloom.llm import alignment, queries
from graphloom.operators.closure import shared_root

A, B = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a   b ", "a\n b", "a \nb", "a\n \nb", "a\t b  \n\n  c", "\n", "\n\n", " \n ", "x  y", "x  y", "x    y", "a\x1c b", "a\x85 b",
    "don't we'll  I'm 's", "<|endoftext|> and <|endoftext|>", "</s> <s> <unk>", "▁", "a ▁b", "日本語 の テキスト。", "é ü ﬁ Ⅳ", "👩‍👩‍👧 🇫🇷", "\x00 \x01", "x" * 300, "1234567 8.90 -- ((", "a" + " " * 40 + "b", "　a 　",
    "tab\tseparated\tvalues \t here", "trailing \n", "a  b", "﻿ bom",
]


@pytest.fixture(scope="module")
def tools():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    b = SentencePieceProcessor(model_file=B)

    def tokens(text):
        """Ids and bytes of both sides of a whole text; nothing where they do not spell it."""
        meant = (" " + text).encode()
        enc = a.encode(" " + text, add_special_tokens=False)
        left = [(i, bytes(letters[c] for c in t)) for i, t in zip(enc.ids, enc.tokens, strict=True)]
        right = []
        for i in b.encode(text):
            p = b.id_to_piece(i)
            right.append((i, bytes([int(p[3:5], 16)]) if p.startswith("<0x") and p.endswith(">") and len(p) == 6 else p.replace("▁", " ").encode()))
        fine = text and all(b"".join(x for _, x in side) == meant for side in (left, right))
        return (left, right) if fine else ([], [])

    return tokens


def plain(rows, tokens):
    """The contract, an occurrence pair at a time."""
    held, total = [], Counter()
    for doc_id, text in rows:
        sides = tokens(text or "")
        spans = []
        for side in sides:
            at, own = 0, []
            for i, raw in side:
                own.append((at, at + len(raw), i))
                at += len(raw)
            spans.append(own)
        ends = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        cuts = [np.searchsorted([e for _, e, _ in own], ends, "right").tolist() for own in spans]
        parts = [[",".join(str(i) for _, _, i in own[x:y]) for x, y in zip([0, *cut], cut, strict=False)] for own, cut in zip(spans, cuts, strict=True)]
        groups = ["|".join(p) for p in zip(*parts, strict=True)]
        links, k = [], 0
        for s, e, i in spans[0]:
            while k and spans[1][k][0] > s:
                k -= 1
            while k < len(spans[1]) and spans[1][k][1] <= s:
                k += 1
            j = k
            while j < len(spans[1]) and spans[1][j][0] < e:
                links.append((i, spans[1][j][2]))
                j += 1
        total.update(links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if sides[0] else ""
        held.append((doc_id, len(sides[0]), len(sides[1]), len(groups), links, digest))
    most = {}
    for (_, b), n in total.items():
        most[b] = max(most.get(b, 0), n)
    return Counter((d, na, nb, g, len(ls), sum(total[x] == most[x[1]] for x in ls), sum(total[x] for x in ls), h) for d, na, nb, g, ls, h in held)


def results(df):
    return Counter(tuple(r[c] for c in alignment.RESULT.names) for r in df.collect())


def test_cut_texts_have_the_tokens_of_whole_ones(tools):
    pair = alignment.Pair(A, B)
    assert pair.cuts
    own = alignment.Aligner(A, B)
    rng = random.Random(3)
    marks = [" ", " ", " ", "  ", "\n", "\t", " ", "a", "word", "The", "'s", ".", "\x85", "é", "12", "日", "\x1f", " ", "-", "▁", "̀"]
    texts = [*ODD, *("".join(rng.choice(marks) for _ in range(rng.randrange(14))) for _ in range(3000))]
    got = own.block(pa.array(texts))
    for k, text in enumerate(texts):
        left, right = tools(text)
        assert (got["n_a"][k], got["n_b"][k]) == (len(left), len(right)), repr(text)
    some = [u for t in texts for u in alignment.CUT.split(t)]
    for u, ids in zip(some, pair.encode_a(some), strict=True):
        assert ids.as_py() == pair.a.encode(" " + u, add_special_tokens=False).ids, repr(u)


def test_query_equals_all_occurrence_pairs(spark, sf, tools):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert results(queries.op13_tokenizer_alignment(spark, sf)) == plain(rows, tools)


@pytest.mark.parametrize("size", [alignment.BLOCK_BYTES, 200])
def test_odd_rows(spark, tools, size):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, None), (None, "a  b"), (3, "the same the same"), (3, "the same the same"), (4, None), (5, "word " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("block", "pair", "pairs", "total", "at")})
    assert results(alignment.aligned_documents(df, A, B, size)) == plain(rows, tools)
    assert alignment.aligned_documents(df.limit(0), A, B).count() == 0


def test_other_tokenizers_are_not_cut(tools):
    own = alignment.Aligner(A, B)
    own.pair.cuts = False
    cut = alignment.Aligner(A, B)
    x, y = (o.block(pa.array(ODD)) for o in (own, cut))
    assert x["groups_sha256"] == y["groups_sha256"]
    assert all((x[c] == y[c]).all() for c in alignment.Aligner.COUNTS)
    assert dict(zip(x["pairs"].tolist(), x["counts"].tolist(), strict=True)) == dict(zip(y["pairs"].tolist(), y["counts"].tolist(), strict=True))
    assert np.diff(x["units_at"]).max() <= 1


def test_stored_blocks_are_read_some_at_a_time(spark):
    """A block is a row of megabytes, and a reader holds a whole row group."""
    there = lambda: {*glob.glob(f"{shared_root(spark).removeprefix('file://')}/aligned-*/*.parquet")}
    before, df = there(), spark.range(0, 200, 1, 1).selectExpr("id AS doc_id", "repeat('some words ', 20) AS text")
    assert alignment.aligned_documents(df, A, B, 200).where("n_links > 0").count() == 200
    groups = [m.row_group(k).num_rows for f in there() - before for m in [pq.read_metadata(f)] for k in range(m.num_row_groups)]
    assert sum(groups) == 200 and max(groups) <= 4

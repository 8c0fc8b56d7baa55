"""Token-ID output under a Re-Pair grammar, with random-access decoding.

Documents in ascending ``doc_id`` order are range-partitioned into parts, encoded and ended
by ``end_id``.  A shard is a run of a part's documents with about ``encode.BLOCK_BYTES`` of
text (a longer text is a shard of its own); it has a grammar of its own, so that one task
holds no more than one shard.  The file is a Parquet table with one row per shard:

    part, shard             place in the order
    doc_ids                 int64 little-endian, ``id_null`` one byte each (1: the id was null)
    doc_tokens              uint32 each: ids of the document, end id included
    symbol_starts           uint32, one more than documents: where each one's symbols start
    rules                   uint32 pairs; rule k is symbol ``terminals + k``
    rule_lengths            uint32: ids to which each rule expands
    symbols                 uint32: the text after replacement

Re-Pair replaces frequent neighbour pairs by new symbols, round by round, until no pair
occurs ``MIN_COUNT`` times in the shard; a round takes many pairs at once, the most
frequent first, of which none can overlap another.  Pairs within words come first, on the
shard's distinct words weighted by their counts (their counts are the same there, at a
fraction of the work), then all pairs of the text.  No rule crosses a document's end.

Defined cases: a null text is empty and yields the end id alone; null ids come first;
rows with equal ids stay next to each other, by text; a text of any length is encoded as a
whole (one shard must fit into a task's memory); other columns of the input are ignored,
whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import n_partitions, scratch
from graphloom.llm.encode import Block, blocks, encoder, release, spread

#: Bytes of text in a shard (a longer text is a shard of its own).
SHARD_BYTES = 4 << 20
FILE_SCHEMA = (
    "part int, shard int, tokens long, terminals int, doc_ids binary, id_null binary, doc_tokens binary, "
    "symbol_starts binary, rules binary, rule_lengths binary, symbols binary"
)


#: A pair is frequent from this count on: a rule takes 12 bytes, each use of it saves a symbol of 4.
MIN_COUNT = 4


class Grammar:
    """Rules of one shard, grown round by round until no pair is frequent."""

    def __init__(self, terminals: int, min_count: int = MIN_COUNT):
        self.terminals, self.min_count = terminals, min_count
        self.left, self.right = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int64)

    def length_of(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        high = symbols >= self.terminals
        out[high] = self.lengths[symbols[high] - self.terminals]
        return out

    def _take(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Places of the frequent pairs that become rules now: the most frequent first, none that can overlap one taken before."""
        order = np.lexsort((keys, -counts))
        lefts: set[int] = set()
        rights: set[int] = set()
        taken = []
        for k, a, b in zip(order.tolist(), (keys[order] >> 32).tolist(), (keys[order] & 0xFFFFFFFF).tolist(), strict=True):
            if a not in rights and b not in lefts and (a != b or (a not in lefts and b not in rights)):
                lefts.add(a)
                rights.add(b)
                taken.append(k)
        return np.array(taken, np.int64)

    def replace(self, seq: np.ndarray, last: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """``seq`` and ``last`` after all rounds; ``last`` marks symbols after which nothing may be joined.

        ``weights`` says how often each place of ``seq`` counts.  A pair that is not frequent
        never becomes so, unless a new symbol is part of it: after the first round only pairs
        that were frequent, and those beside a replaced one, are counted again.
        """
        live = ~last
        if len(live):
            live[-1] = False
        while True:
            at = np.flatnonzero(live)
            codes, keys = pd.factorize((seq[at] << 32) | seq[at + 1])
            counts = np.bincount(codes, None if weights is None else weights[at], minlength=len(keys))
            often = np.flatnonzero(counts >= self.min_count)
            if not len(often):
                return seq, last
            taken = often[self._take(keys[often], counts[often])]
            rule = np.full(len(keys), -1, np.int64)
            rule[taken] = self.terminals + len(self.left) + np.arange(len(taken))
            a, b = keys[taken] >> 32, keys[taken] & 0xFFFFFFFF
            self.lengths = np.concatenate((self.lengths, self.length_of(a) + self.length_of(b)))
            self.left, self.right = np.concatenate((self.left, a)), np.concatenate((self.right, b))
            live[at] = (counts >= self.min_count)[codes]
            symbol = rule[codes]
            hit = symbol >= 0
            at, symbol = at[hit], symbol[hit]
            twin = np.flatnonzero(seq[at] == seq[at + 1])
            if len(twin):  # a run of one symbol: every other of its pairs
                q = at[twin]
                head = np.concatenate(([True], np.diff(q) != 1))
                place = np.arange(len(q)) - np.maximum.accumulate(np.where(head, np.arange(len(q)), 0))
                keep = np.ones(len(at), bool)
                keep[twin[place % 2 == 1]] = False
                at, symbol = at[keep], symbol[keep]
            seq[at], last[at] = symbol, last[at + 1]
            live[at] = True
            live[at - 1] = True  # place -1 is the end, which joins nothing
            stays = np.ones(len(seq), bool)
            stays[at + 1] = False
            seq, last, live = seq[stays], last[stays], live[stays]
            weights = None if weights is None else weights[stays]
            live &= ~last
            live[-1] = False


def compress(block: Block, terminals: int, min_count: int = MIN_COUNT) -> tuple[Grammar, np.ndarray, np.ndarray]:
    """Grammar, symbols, and where each document's symbols start."""
    grammar = Grammar(terminals, min_count)
    counts = np.bincount(block.pieces, minlength=len(block.starts))
    used = np.flatnonzero((counts > 0) & (block.lengths > 0))
    n = block.lengths[used]
    seq = spread(block.flat, block.starts[used], n).astype(np.int64)
    weights = np.repeat(counts[used], n)
    last = np.zeros(len(seq), bool)
    last[np.cumsum(n) - 1] = True
    seq, last = grammar.replace(seq, last, weights)
    ends = np.flatnonzero(last) + 1
    size, start = np.zeros(len(block.starts), np.int64), np.zeros(len(block.starts), np.int64)
    size[used] = np.diff(ends, prepend=0)
    start[used] = ends - size[used]
    n = size[block.pieces]
    text = spread(seq, start[block.pieces], n)
    docs = np.concatenate(([0], np.cumsum(n)))[block.offsets]
    last = np.zeros(len(text), bool)
    full = np.diff(docs) > 0
    last[docs[1:][full] - 1] = True
    text, last = grammar.replace(text, last)
    sizes = np.zeros(len(docs) - 1, np.int64)
    sizes[full] = np.diff(np.flatnonzero(last) + 1, prepend=0)
    return grammar, text, np.concatenate(([0], np.cumsum(sizes)))


def expansions(terminals: int, left: np.ndarray, right: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rules in one array, and where each rule starts."""
    starts = np.concatenate(([0], np.cumsum(lengths)))
    flat = np.zeros(starts[-1], np.uint32)
    done = 0
    while done < len(left):  # rules whose parts are all expanded, a run at a time
        parts = np.maximum(left[done:], right[done:]) - terminals
        late = np.flatnonzero(parts >= done)
        to = done + (int(late[0]) if len(late) else len(parts))
        for side, shift in ((left, None), (right, left)):
            s = side[done:to]
            at = starts[done:to] + (0 if shift is None else np.where(shift[done:to] >= terminals, lengths[np.maximum(shift[done:to] - terminals, 0)], 1))
            low = s < terminals
            flat[at[low]] = s[low]
            k = s[~low] - terminals
            if len(k):
                source = spread(np.arange(starts[-1]), starts[k], lengths[k])
                target = spread(np.arange(starts[-1]), at[~low], lengths[k])
                flat[target] = flat[source]
        done = to
    return flat, starts


class Reader:
    """One row of the file, ready for decoding whole documents or ranges of them."""

    def __init__(self, row: dict):
        self.terminals = row["terminals"]
        self.doc_tokens = np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)
        self.symbol_starts = np.frombuffer(row["symbol_starts"], "<u4").astype(np.int64)
        pairs = np.frombuffer(row["rules"], "<u4").astype(np.int64)
        self.lengths = np.frombuffer(row["rule_lengths"], "<u4").astype(np.int64)
        self.symbols = np.frombuffer(row["symbols"], "<u4").astype(np.int64)
        nulls = np.frombuffer(row["id_null"], np.uint8)
        self.doc_ids = [None if z else int(i) for i, z in zip(np.frombuffer(row["doc_ids"], "<i8"), nulls, strict=True)]
        rules, starts = expansions(self.terminals, pairs[0::2], pairs[1::2], self.lengths)
        self.flat = np.concatenate((np.arange(self.terminals, dtype=np.uint32), rules))
        self.starts = np.concatenate((np.arange(self.terminals), self.terminals + starts[:-1]))
        self.widths = np.concatenate((np.ones(self.terminals, np.int64), self.lengths))

    def ids(self, first: int = 0, to: int | None = None) -> np.ndarray:
        """Ids of the documents from place ``first`` to before ``to``."""
        to = len(self.doc_tokens) if to is None else to
        s = self.symbols[self.symbol_starts[first] : self.symbol_starts[to]]
        return spread(self.flat, self.starts[s], self.widths[s])

    def window(self, doc: int, start: int, stop: int) -> np.ndarray:
        """Ids ``start:stop`` of one document: only the symbols that cover them are expanded."""
        s = self.symbols[self.symbol_starts[doc] : self.symbol_starts[doc + 1]]
        ends = np.cumsum(self.widths[s])
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        base = ends[a - 1] if a else 0
        s = s[a:b]
        return spread(self.flat, self.starts[s], self.widths[s])[start - base : stop - base]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2) -> None:
    """Writes the token file of ``docs`` (``doc_id, text``) as a Parquet table at ``path``."""
    spark = docs.sparkSession
    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange(n_partitions(spark), "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )

    def work(batches):
        from pyspark import TaskContext

        release(keep="encoder")
        order, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        terminals = max(enc.tokenizer.get_vocab_size(), end_id + 1)
        for number, part in enumerate(blocks(batches, size=SHARD_BYTES)):
            block = enc.encode(part["text"].combine_chunks())
            n_docs = part.num_rows
            # the end id is a piece of its own after each document
            ended = Block(
                np.insert(block.pieces, block.offsets[1:], len(block.starts)),
                block.offsets + np.arange(n_docs + 1),
                np.append(block.flat, np.uint32(end_id)),
                np.append(block.starts, len(block.flat)),
                np.append(block.lengths, 1),
            )
            before = np.concatenate(([0], np.cumsum(ended.lengths[ended.pieces])))[ended.offsets]
            grammar, symbols, starts = compress(ended, terminals)
            ids = part["doc_id"].combine_chunks()
            pairs = np.empty(2 * len(grammar.left), "<u4")
            pairs[0::2], pairs[1::2] = grammar.left, grammar.right
            row = {
                "part": order, "shard": number, "tokens": int(before[-1]), "terminals": terminals,
                "doc_ids": ids.fill_null(0).to_numpy().astype("<i8").tobytes(),
                "id_null": ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(),
                "doc_tokens": np.diff(before).astype("<u4").tobytes(), "symbol_starts": starts.astype("<u4").tobytes(),
                "rules": pairs.tobytes(), "rule_lengths": grammar.lengths.astype("<u4").tobytes(), "symbols": symbols.astype("<u4").tobytes(),
            }
            block = ended = grammar = symbols = starts = pairs = before = None  # not beside the next shard's
            yield pa.RecordBatch.from_pylist([row], schema=ARROW)

    rows.mapInArrow(work, FILE_SCHEMA).write.option("compression", "zstd").parquet(path)


ARROW = pa.schema(
    [(n, {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in FILE_SCHEMA.split(", "))]
)


def read_documents(spark, path: str) -> DataFrame:
    """Per document of a token file: ``doc_id, start, n_tokens, ids_crc32, part, shard, symbols``.

    ``start`` is the number of ids before the document: sums over the parts before its own,
    over its part's shards before its own, and within its shard.
    """
    rows = spark.read.schema(FILE_SCHEMA).parquet(path)

    def work(batches):
        release()
        for batch in batches:
            for row in batch.to_pylist():
                r = Reader(row)
                raw, ends = memoryview(r.ids().astype("<u4").tobytes()), np.concatenate(([0], np.cumsum(r.doc_tokens)))
                n = len(r.doc_tokens)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]] * n, pa.int32()), pa.array([row["shard"]] * n, pa.int32()),
                        pa.array(r.doc_ids, pa.int64()), pa.array(ends[:-1], pa.int64()), pa.array(r.doc_tokens, pa.int64()),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)], pa.int64()),
                        pa.array(np.diff(r.symbol_starts), pa.int64()),
                    ],
                    ["part", "shard", "doc_id", "inner", "n_tokens", "ids_crc32", "symbols"],
                )

    docs = rows.mapInArrow(work, "part int, shard int, doc_id long, inner long, n_tokens long, ids_crc32 long, symbols long")
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    of_part = rows.groupBy("part").agg(F.sum("tokens").alias("tokens"))  # a row for each task that wrote
    of_part = of_part.select("part", F.coalesce(F.sum("tokens").over(before(Window.orderBy("part"))), F.lit(0)).alias("base"))
    of_shard = F.coalesce(F.sum("tokens").over(before(Window.partitionBy("part").orderBy("shard"))), F.lit(0))
    starts = rows.select("part", "shard", of_shard.alias("past")).join(of_part, "part")
    return docs.join(starts, ["part", "shard"]).select(
        "doc_id", (F.col("base") + F.col("past") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", "part", "shard", "symbols"
    )


def tokenised(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes ``docs`` as a token file and reads it back, a row per document."""
    path = path or scratch(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer, end_id)
    return read_documents(docs.sparkSession, path)

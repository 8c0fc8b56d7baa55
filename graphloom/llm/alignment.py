"""Alignment of two tokenizers over the same bytes, as an Arrow pipeline that Spark deals out and merges.

Text is cut into units before each space that follows a character which is no white space.
Neither tokenizer joins anything over such a cut (``Pair`` checks the files that this rests
on; under others a text is one unit), so both end a token there, and a text's alignment is
that of its units in order.  Of a block of texts only units that the worker has not met are
aligned:

1. both lists of tokens are flattened; parent indices name each token's unit, and a segmented
   cumulative sum of byte lengths gives where it ends;
2. a full outer Acero join on (unit, end) finds the ends that both share, which cut the groups;
3. sorted by end, each row of the join is one run of bytes in one token of either side: filled
   from behind with the ids that end there or later, it is a link.

``Table.group_by`` counts the links of each id pair in a block, Spark sums these partial
counts.  A block's distinct pairs then meet the sums in a join (a pair is one row a block, so
a pair that every text has is no hot key), and the block's task adds up its documents.

Defined cases: a null or empty text has no tokens, nor has one whose joined tokens differ from
space and text (such as a text with U+2581); rows are judged one by one, so repeated and null
ids are kept; a very long text is a block of its own; the strings of special tokens are plain
text; empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import staged
from graphloom.llm.encode import blocks, release, spread, worker_cache

#: Bytes of text that are aligned at once.
BLOCK_BYTES = 2 << 20
#: A stored block is a row of megabytes, and who writes or reads a row group holds all its rows at once.
ROW_GROUPS = {"parquet.block.row.count.limit": "4"}
#: Units that a worker remembers; past it, it starts anew.
CACHE_UNITS = 200_000
#: Units that are encoded as one text.
JOINED = 4096
#: White space before a space: only then is there a space at which a text may not be cut.
#: (\x1c-\x1f are here because the slow way counts them as white space.)
RUN = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] "
CUT = re.compile(r"(?<=\S) ")
SPACE_MARK = "▁"


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the entries of a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Spelling:
    """The bytes of each token of a vocabulary."""

    def __init__(self, tokens: list[bytes]):
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return spread(self.flat, self.starts[ids], self.lengths[ids])


class Pair:
    """Tokenizer A (a ``tokenizers`` file) and B (a ``sentencepiece`` model)."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        letters = byte_letters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        spelt = [b""] * (max(vocabulary.values()) + 1)
        for entry, k in vocabulary.items():
            spelt[k] = bytes(letters[c] for c in entry) if all(c in letters for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.space = self.b.piece_to_id(SPACE_MARK)
        self.spelt_a = Spelling(spelt)
        self.spelt_b = Spelling([bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE_MARK, " ").encode() for k, p in enumerate(pieces)])
        described, model = json.loads(self.a.to_str()), sentencepiece_model_pb2.ModelProto()
        with open(b_path, "rb") as f:
            model.ParseFromString(f.read())
        rules, how = model.normalizer_spec, described["pre_tokenizer"]
        self.cuts = (
            described["normalizer"] is None
            and how["type"] == "ByteLevel"
            and how["use_regex"]
            and not how["add_prefix_space"]
            and described["post_processor"] is None
            and not described["model"].get("dropout")
            and rules.name == "identity"
            and rules.add_dummy_prefix
            and not rules.remove_extra_whitespaces
            and not model.trainer_spec.treat_whitespace_as_suffix
            and not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in pieces)
        )

    def encode_a(self, units: list[str]) -> pa.ListArray:
        """Ids of each space and unit.  Units that end in no white space are joined: the cuts between them are safe."""
        safe = [self.cuts and u != "" and not u[-1].isspace() for u in units]
        joined, rest = [k for k, s in enumerate(safe) if s], [k for k, s in enumerate(safe) if not s]
        flat, counts = [], []
        for at in range(0, len(joined), JOINED):
            some = [" " + units[k] for k in joined[at : at + JOINED]]
            ids = np.array(self.a.encode("".join(some), add_special_tokens=False).ids, np.int64)
            ends = np.cumsum([len(u.encode()) for u in some])
            counts.append(np.diff(np.searchsorted(np.cumsum(self.spelt_a.lengths[ids]), ends, "right"), prepend=0))
            flat.append(ids)
        for k in rest:
            flat.append(np.array(self.a.encode(" " + units[k], add_special_tokens=False).ids, np.int64))
            counts.append([len(flat[-1])])
        return listed(flat, counts, joined + rest)

    def encode_b(self, units: list[str]) -> pa.ListArray:
        found = [ids if u else [self.space] for u, ids in zip(units, self.b.encode(units, num_threads=1), strict=True)]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return listed([np.fromiter(chain.from_iterable(found), np.int64, int(counts.sum()))], [counts])


def listed(flat: list[np.ndarray], counts: list, places: list[int] | None = None) -> pa.ListArray:
    """Lists from their joined values and lengths; ``places``: where each list belongs, if not in this order."""
    values = np.concatenate(flat) if flat else np.zeros(0, np.int64)
    counts = np.concatenate(counts).astype(np.int64) if counts else np.zeros(0, np.int64)
    if places is not None and places != sorted(places):
        order = np.argsort(np.array(places))
        values = spread(values, (np.cumsum(counts) - counts)[order], counts[order])
        counts = counts[order]
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(values))


def ended(tokens: pa.ListArray, lengths: np.ndarray, name: str) -> pa.Table:
    """``unit, end`` and the id of every token: bytes of its unit up to its end."""
    ids, unit = pc.list_flatten(tokens), pc.list_parent_indices(tokens)
    total = pc.cumulative_sum(pc.take(pa.array(lengths), ids))
    firsts = tokens.offsets.to_numpy()[:-1]
    before = np.concatenate(([0], total.to_numpy()))[firsts]  # of each unit: what ends before it begins
    return pa.table({"unit": unit, "end": pc.subtract(total, pc.take(pa.array(before), unit)), name: ids})


def grouped_text(ids: np.ndarray, group: np.ndarray, n_groups: int) -> pa.Array:
    """The ids of each group, in order, joined by commas."""
    offsets = np.searchsorted(group, np.arange(n_groups + 1))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids).cast(pa.string())), ",")


def aligned(a: pa.ListArray, b: pa.ListArray, a_lengths: np.ndarray, b_lengths: np.ndarray) -> dict:
    """Of each unit: its tokens on both sides, groups, links (id pairs, ``a << 32 | b``) and its groups as text."""
    n = len(a)
    left, right = ended(a, a_lengths, "a"), ended(b, b_lengths, "b")
    both = left.join(right, ["unit", "end"], join_type="full outer", use_threads=False).sort_by([("unit", "ascending"), ("end", "ascending")])
    both = both.combine_chunks()
    shared = pc.and_(pc.is_valid(both["a"]), pc.is_valid(both["b"])).to_numpy(zero_copy_only=False)
    unit = both["unit"].to_numpy()
    a_ids, b_ids = (pc.fill_null_backward(both[c]).to_numpy() for c in ("a", "b"))
    group = np.cumsum(shared) - shared
    n_groups = int(shared.sum())
    in_a, in_b = (pc.is_valid(both[c]).to_numpy(zero_copy_only=False) for c in ("a", "b"))
    text = pc.binary_join_element_wise(grouped_text(a_ids[in_a], group[in_a], n_groups), grouped_text(b_ids[in_b], group[in_b], n_groups), "|")
    of_unit = np.bincount(unit[shared], minlength=n) if len(unit) else np.zeros(n, np.int64)
    groups_at = pa.array(np.concatenate(([0], np.cumsum(of_unit))), pa.int32())
    return {
        "n_a": pc.list_value_length(a).to_numpy(zero_copy_only=False).astype(np.int64),
        "n_b": pc.list_value_length(b).to_numpy(zero_copy_only=False).astype(np.int64),
        "n_groups": of_unit.astype(np.int64),
        "n_links": np.bincount(unit, minlength=n).astype(np.int64) if len(unit) else np.zeros(n, np.int64),
        "links": (a_ids.astype(np.int64) << 32) | b_ids.astype(np.int64),
        "text": pc.binary_join(pa.ListArray.from_arrays(groups_at, text), ";"),
    }


class Aligner:
    """The units that a worker has met, aligned."""

    COUNTS = ("n_a", "n_b", "n_groups", "n_links")

    def __init__(self, a_path: str, b_path: str):
        self.pair = Pair(a_path, b_path)
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.string())
        self.counts = {c: np.zeros(0, np.int64) for c in self.COUNTS}
        self.starts, self.links = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.text, self.wrong = pa.array([], pa.string()), np.zeros(0, bool)

    def learn(self, units: pa.Array) -> None:
        words = units.to_pylist()
        sizes = pc.binary_length(units).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        meant = np.frombuffer("".join([" " + w for w in words]).encode(), np.uint8)
        starts = np.cumsum(sizes) - sizes
        sides, wrong = [self.pair.encode_a(words), self.pair.encode_b(words)], np.zeros(len(words), bool)
        for tokens, spelt in zip(sides, (self.pair.spelt_a, self.pair.spelt_b), strict=True):
            flat, unit = pc.list_flatten(tokens).to_numpy(), pc.list_parent_indices(tokens).to_numpy()
            right = np.bincount(unit, spelt.lengths[flat], len(words)).astype(np.int64) == sizes
            same = spelt.joined(flat[right[unit]]) == spread(meant, starts[right], sizes[right])
            wrong |= ~right
            if right.any():
                wrong[right] |= ~np.logical_and.reduceat(same, np.cumsum(sizes[right]) - sizes[right])
        if wrong.any():
            sides = [pc.if_else(pa.array(wrong), pa.scalar([], x.type), x) for x in sides]
        a, b = sides
        new = aligned(a, b, self.pair.spelt_a.lengths, self.pair.spelt_b.lengths)
        self.starts = np.concatenate((self.starts, len(self.links) + np.cumsum(new["n_links"]) - new["n_links"]))
        self.links = np.concatenate((self.links, new["links"]))
        self.counts = {c: np.concatenate((self.counts[c], new[c])) for c in self.COUNTS}
        self.text = pa.concat_arrays([self.text, new["text"]])
        self.wrong = np.concatenate((self.wrong, wrong))
        self.known = pa.concat_arrays([self.known, units])

    def places(self, units: pa.Array) -> np.ndarray:
        """Where each of these distinct units stands among the known ones; unknown ones are learnt."""
        at = pc.index_in(units, value_set=self.known)
        if at.null_count:
            self.learn(units.filter(pc.is_null(at)))
            at = pc.index_in(units, value_set=self.known)
        return at.to_numpy(zero_copy_only=False).astype(np.int64)

    def cut(self, texts: pa.Array) -> pa.ListArray:
        """Each text as its units, without the space before each."""
        if not self.pair.cuts:
            return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1), pa.int32()), texts)
        whole = pc.or_(pc.starts_with(texts, " "), pc.match_substring_regex(texts, RUN))
        split = pc.split_pattern(texts, " ")
        if not pc.any(whole).as_py():
            return split
        odd = {int(k): CUT.split(texts[int(k)].as_py()) for k in np.flatnonzero(whole.to_numpy(zero_copy_only=False))}
        own = pa.array([odd.get(k, []) for k in range(len(texts))], pa.list_(pa.string()))
        return pc.if_else(whole, own, split)

    def block(self, texts: pa.Array) -> dict:
        """What a block's documents have, and the links of its distinct units as places in its distinct pairs."""
        if len(self.known) > CACHE_UNITS:
            self.clear()
        texts = pc.fill_null(texts, "").cast(pa.string())
        units = self.cut(texts)
        some = pc.not_equal(texts, "")
        if not pc.all(some).as_py():
            units = pc.if_else(some, units, pa.scalar([], units.type))
        flat = pc.list_flatten(units).dictionary_encode()
        code = self.places(flat.dictionary)[flat.indices.to_numpy(zero_copy_only=False)]
        doc = pc.list_parent_indices(units).to_numpy()
        size = pc.list_value_length(units).to_numpy(zero_copy_only=False).astype(np.int64)
        if self.wrong[code].any():  # a wrong unit tells that its text is wrong, unless the whole text says otherwise
            bad = np.unique(doc[self.wrong[code]])
            whole = texts.take(pa.array(bad)).dictionary_encode()
            own = self.places(whole.dictionary)[whole.indices.to_numpy(zero_copy_only=False)]
            keep = ~np.isin(doc, bad)
            code, doc = np.concatenate((code[keep], own)), np.concatenate((doc[keep], bad))
            order = np.argsort(doc, kind="stable")
            code, doc = code[order], doc[order]
            size[bad] = 1
        offsets = np.concatenate(([0], np.cumsum(size)))
        out = {c: np.bincount(doc, self.counts[c][code], len(texts)).astype(np.int64) for c in self.COUNTS}
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.text.take(pa.array(code))), ";")
        out["groups_sha256"] = [hashlib.sha256(t.encode()).hexdigest() if n else "" for t, n in zip(joined.to_pylist(), out["n_a"].tolist(), strict=True)]
        used, local = np.unique(code, return_inverse=True)
        n_links = self.counts["n_links"][used]
        links = spread(self.links, self.starts[used], n_links)
        weight = np.repeat(np.bincount(local, minlength=len(used)), n_links)
        counted = pa.table({"pair": links, "n": weight}).group_by("pair", use_threads=False).aggregate([("n", "sum")])
        pairs = counted["pair"].combine_chunks()
        place = pc.index_in(pa.array(links), value_set=pairs).to_numpy(zero_copy_only=False)
        return out | {
            "units_at": offsets, "units": local, "links_of": n_links, "links": place,
            "pairs": pairs.to_numpy(), "counts": counted["n_sum"].to_numpy(),
        }


LONGS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "pairs", "counts")
INTS = ("units_at", "units", "links_of", "links")
BLOCK = pa.schema([("block", pa.string()), *[(c, pa.list_(pa.int64())) for c in LONGS], *[(c, pa.list_(pa.int32())) for c in INTS], ("groups_sha256", pa.list_(pa.string()))])
BLOCK_DDL = "block string, " + ", ".join([*[f"{c} array<long>" for c in LONGS], *[f"{c} array<int>" for c in INTS]]) + ", groups_sha256 array<string>"
RESULT = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups_sha256", pa.string())])
RESULT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def _blocks(a_path: str, b_path: str, size: int):
    def run(batches):
        release("aligner")
        own = worker_cache(("aligner", a_path, b_path), lambda: Aligner(a_path, b_path))
        task = TaskContext.get().partitionId()
        for k, part in enumerate(blocks(batches, size=size)):
            got = own.block(part["text"].combine_chunks())
            row = {"block": [f"{task}-{k}"], "doc_id": [part["doc_id"].to_pylist()]} | {c: [v] for c, v in got.items()}
            yield pa.RecordBatch.from_arrays([pa.array(row[f.name], f.type) for f in BLOCK], schema=BLOCK)
        del own
        release()  # the next stage's shuffle needs the room more than the next task needs these units

    return run


def _documents(batches):
    """Blocks with the sums of their pairs: one row a document."""
    for batch in batches:
        for k in range(batch.num_rows):
            get = lambda c, k=k: batch.column(batch.schema.get_field_index(c))[k].values
            links, links_of, units, units_at = (get(c).to_numpy() for c in ("links", "links_of", "units", "units_at"))
            links_at = np.concatenate(([0], np.cumsum(links_of)))
            out = {c: get(c) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")}
            for c, of_pair in (("n_best", "best"), ("count_sum", "total")):
                of_link = np.concatenate(([0], np.cumsum(get(of_pair).to_numpy()[links])))
                of_unit = of_link[links_at[1:]] - of_link[links_at[:-1]]
                of_doc = np.concatenate(([0], np.cumsum(of_unit[units])))
                out[c] = pa.array(of_doc[units_at[1:]] - of_doc[units_at[:-1]], pa.int64())
            yield pa.RecordBatch.from_arrays([out[f.name] for f in RESULT], schema=RESULT)


def aligned_documents(docs: DataFrame, a_path: str, b_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``RESULT_DDL`` for every row of ``docs``: its tokens on both sides, groups, links, and how its links fare in the corpus."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = staged(texts.mapInArrow(_blocks(a_path, b_path, block_bytes), BLOCK_DDL), "aligned", **ROW_GROUPS)
    partial = held.select(F.explode(F.arrays_zip("pairs", "counts")).alias("p")).select("p.pairs", "p.counts")
    sums = staged(partial.groupBy(F.col("pairs").alias("pair")).agg(F.sum("counts").alias("total")), "pairs")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    most = sums.groupBy(b.alias("b")).agg(F.max("total").alias("most"))
    sums = staged(sums.withColumn("b", b).join(most, "b").select("pair", "total", (F.col("total") == F.col("most")).cast("long").alias("best")), "sums")
    placed = held.select("block", F.posexplode("pairs").alias("at", "pair")).join(sums, "pair")
    of_block = placed.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("at", "total", "best"))).alias("s"))
    of_block = of_block.select("block", F.col("s.total").alias("total"), F.col("s.best").alias("best"))
    full = held.drop("pairs", "counts").join(of_block, "block", "left")
    nothing = F.array().cast("array<long>")
    full = full.withColumns({c: F.coalesce(c, nothing) for c in ("total", "best")})
    return full.mapInArrow(_documents, RESULT_DDL)

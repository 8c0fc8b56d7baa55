"""Whole texts to token ids, a distinct word at a time.

For a tokenizer that drops white space and cuts words by kinds of characters (checked when
its file is loaded: ``cuts_words``) the ids of a text are the ids of its words in order.
Each worker keeps the words it has met, without case (ASCII) and trailing punctuation, and
asks the ``tokenizers`` library only for new ones.  Punctuation is split off only after an
ASCII letter or digit: any other character may change its kind when it is normalised.
Texts that could hold a special token, and all texts under any other tokenizer, are encoded
as wholes.  The tests compare both ways.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import json
import os
import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Marks that are split off the end of a word.
TAIL = ".,!?;:#$%&*|)"
#: The only normalizer and pre-tokenizer under which words are encoded one by one.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": WORD_PATTERN}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Words that the tokenizer's model takes as they are.
LETTERS = re.compile("[a-zß-öø-ÿ]+")
#: Words that a worker remembers; past it, it starts anew.
CACHE_WORDS = 700_000
#: Bytes of text that are encoded at once (a longer text is a block of its own).
BLOCK_BYTES = 8 << 20


def cuts_words(described: dict) -> bool:
    """Whether a tokenizer file (its JSON) gives a text the ids of its words, one after the other."""
    return (
        described.get("normalizer") == NORMALIZER
        and described.get("pre_tokenizer") == PRE_TOKENIZER
        and described.get("post_processor") is None
        and described.get("truncation") is None
        and not described["model"].get("dropout")
        and all(x["content"].startswith("<|") for x in described.get("added_tokens", []))
    )


@dataclass
class Block:
    """Documents as runs of distinct pieces: ``pieces[offsets[d]:offsets[d + 1]]`` indexes the piece table."""

    pieces: np.ndarray
    offsets: np.ndarray
    flat: np.ndarray  # ids of all pieces of the table
    starts: np.ndarray  # of each piece in flat
    lengths: np.ndarray

    def ids(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and each document's number of ids."""
        n = self.lengths[self.pieces]
        before = np.concatenate(([0], np.cumsum(n)))
        return spread(self.flat, self.starts[self.pieces], n), before[self.offsets[1:]] - before[self.offsets[:-1]]


def spread(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``flat[starts[0]:starts[0] + lengths[0]]``, then the next, in one array."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return flat[:0]
    at = np.ones(ends[-1], np.int64)
    live = lengths > 0
    s, n = starts[live], lengths[live]
    first = np.concatenate(([0], np.cumsum(n)[:-1]))
    at[first[0]] = s[0]
    at[first[1:]] = s[1:] - (s[:-1] + n[:-1] - 1)
    return flat[np.cumsum(at)]


class Encoder:
    """A tokenizer file with the pieces met so far."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelt = {c: spell(chr(c))[0][0] for c in range(ord("ß"), ord("ÿ") + 1)}
        self.by_words = cuts_words(json.loads(self.tokenizer.to_str()))
        self._clear()

    def _clear(self) -> None:
        self.known = pa.array([""])  # piece k is known[k]
        self.flat = np.zeros(1 << 20, np.uint32)
        self.ends = np.zeros(1 << 18, np.int64)
        self.n = 1

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces without white space, and how many each has."""
        own: list[list[int]] = [[]] * len(pieces)
        model, odd = self.tokenizer.model, []
        for k, piece in enumerate(pieces):
            if LETTERS.fullmatch(piece):  # one run of letters that normalising leaves as it is
                own[k] = [t.id for t in model.tokenize(piece if piece.isascii() else piece.translate(self.spelt))]
            else:
                odd.append(k)
        for at in range(0, len(odd), 4096):  # joined by spaces; offsets tell them apart
            some = odd[at : at + 4096]
            got = self.tokenizer.encode(" ".join([pieces[k] for k in some]), add_special_tokens=False)
            bounds = np.cumsum([len(pieces[k]) + 1 for k in some])
            found = got.ids
            first = np.fromiter((o[0] for o in got.offsets), np.int64, len(found))
            cut = np.searchsorted(np.searchsorted(bounds, first, "right"), np.arange(len(some) + 1)).tolist()
            for j, k in enumerate(some):
                own[k] = found[cut[j] : cut[j + 1]]
        counts = np.fromiter(map(len, own), np.int64, len(own))
        return np.fromiter(chain.from_iterable(own), np.uint32, int(counts.sum())), counts

    def _learn(self, new: pa.Array) -> None:
        ids, counts = self._ids(new.to_pylist())
        start = self.ends[self.n - 1]
        while start + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        while self.n + len(new) > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros_like(self.ends)))
        self.flat[start : start + len(ids)] = ids
        self.ends[self.n : self.n + len(new)] = start + np.cumsum(counts)
        self.n += len(new)
        self.known = pa.concat_arrays([self.known, new])

    def _pieces(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each distinct word, its stem and its tail as places in ``known`` (0: no tail)."""
        stems = pc.utf8_rtrim(words, TAIL)
        size, stem_size = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (words, stems))
        raw, offsets = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words)]
        last = raw[np.maximum(offsets + stem_size - 1, 0)] if len(raw) else np.zeros(len(words), np.uint8)
        plain = ((last >= ord("a")) & (last <= ord("z"))) | ((last >= ord("0")) & (last <= ord("9")))
        cut = (stem_size < size) & (stem_size > 0) & plain
        where = np.flatnonzero(cut)
        tail_size = (size - stem_size)[where]
        tail_raw = spread(raw, offsets[where] + stem_size[where], tail_size)
        tail_at = np.concatenate(([0], np.cumsum(tail_size))).astype(np.int32)
        tails = pa.Array.from_buffers(pa.string(), len(where), [None, pa.py_buffer(tail_at), pa.py_buffer(tail_raw)])
        both = pa.concat_arrays([pc.if_else(pa.array(cut), stems, words), tails]).dictionary_encode()
        place = pc.index_in(both.dictionary, value_set=self.known)
        if place.null_count:
            new = both.dictionary.filter(pc.is_null(place))
            first = self.n
            self._learn(new)
            place = place.to_numpy(zero_copy_only=False)
            place[np.isnan(place)] = first + np.arange(len(new))
        else:
            place = place.to_numpy(zero_copy_only=False)
        place = place.astype(np.int64)[both.indices.to_numpy(zero_copy_only=False)]
        tail = np.zeros(len(words), np.int64)
        tail[where] = place[len(words) :]
        return place[: len(words)], tail

    def encode(self, texts: pa.Array, special_as_text: bool = False) -> Block:
        """A block of texts; null counts as empty.  ``special_as_text``: special tokens in a text are but text."""
        if self.n > CACHE_WORDS:
            self._clear()
        texts = pc.fill_null(texts, "").cast(pa.string())
        whole = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False) if self.by_words else np.ones(len(texts), bool)
        plain = pc.if_else(pa.array(~whole), texts, pa.scalar("", texts.type)) if whole.any() else texts
        split = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        words = pc.list_flatten(split).dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False)
        offsets = np.concatenate(([0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64))))
        stem, tail = self._pieces(words.dictionary)
        pieces = np.empty(2 * len(codes), np.int64)
        pieces[0::2], pieces[1::2] = stem[codes], tail[codes]
        full = pieces > 0
        kept = np.concatenate(([0], np.cumsum(full)))
        offsets, pieces = kept[2 * offsets], pieces[full]
        ends = self.ends[: self.n]
        flat, starts, lengths = self.flat[: ends[-1]], np.concatenate(([0], ends[:-1])), np.diff(ends, prepend=0)
        if whole.any():
            at = np.flatnonzero(whole)
            self.tokenizer.encode_special_tokens = special_as_text
            own = [np.array(self.tokenizer.encode(texts[int(d)].as_py(), add_special_tokens=False).ids, np.uint32) for d in at]
            self.tokenizer.encode_special_tokens = False
            pieces = np.insert(pieces, offsets[at], len(starts) + np.arange(len(at)))
            offsets = offsets + np.concatenate(([0], np.cumsum(whole)))
            sizes = np.array([len(x) for x in own], np.int64)
            starts = np.concatenate((starts, len(flat) + np.cumsum(sizes) - sizes))
            flat, lengths = np.concatenate((flat, *own)), np.concatenate((lengths, sizes))
        return Block(pieces, offsets, flat, starts, lengths)


_held: dict = {}


def worker_cache(key, make):
    """What a worker process keeps between tasks: one thing at a time, so that the caches of
    several operators never add up."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def release(keep: str = "") -> None:
    """Gives back what other operators' tasks left in this worker; ``keep`` names a kind of cache to hold on to."""
    if not any(k[0] == keep for k in _held):
        _held.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # what numpy and the tokenizer freed goes back to the system, where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def encoder(path: str) -> Encoder:
    """The worker's own encoder of a tokenizer file."""
    return worker_cache(("encoder", path), lambda: Encoder(path))


def blocks(batches, text: str = "text", size: int = BLOCK_BYTES):
    """Arrow batches cut into runs of rows with about ``size`` bytes of text, small batches put together."""
    held, n = [], 0
    for batch in batches:
        width = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        at = 0
        total = np.cumsum(width.astype(np.int64))
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(total, before + size - n, "right")))
            held.append(batch.slice(at, to - at))
            n += int(total[to - 1] - before)
            at = to
            if n >= size or at < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()

"""Language ID by word-first backoff.

A known word scores by its log frequency in each language; an unseen word falls back to
its longest character n-grams that are known, from ``max_gram`` characters down to one.
The scores of a text's words add up; the best language wins, and ``score`` is its share
of the posterior.

The model is fitted on a bounded sample: the ``TRAIN_DOCS`` labelled rows with the smallest
hashes of their ids and texts, of whose whole texts Spark counts the words.  Every word and
n-gram that the sample has ``LEAST`` times is kept; a rarer word counts as unseen.  Every
text is scored as a whole.

Defined cases: a text that is null or has no letters gives ``und`` with score 0, as does
any text when there is nothing to learn from; labels that are null teach nothing; rows of
the sample that repeat an id and its text teach once; equal scores go to the first language
by name; words are runs of letters, in lower case; a long text is scored in one task like
any other, by its words' sums; columns other than those asked for are ignored, and
predictions take the place of columns of the same names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import staged
from graphloom.llm.encode import blocks, release, worker_cache
from graphloom.llm.shingles import mix

#: Bound of the sample; counts from which a word or n-gram is known.
TRAIN_DOCS, LEAST = 4_000, 2
UNKNOWN = "und"
#: Words that a worker remembers the scores of (no bound of the model: past it, it starts anew).
CACHE_WORDS = 250_000
BLOCK_BYTES = 2 << 20


def sample_by_hash(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """Of the distinct ``keys``, a row for each of the ``most`` with the smallest hashes: the same on every run."""
    marked = rows.withColumn("_mark", F.xxhash64(*[F.col(k) for k in keys]))
    cut = marked.groupBy("_mark").agg(F.count("*").alias("n")).select("_mark").orderBy("_mark").limit(most).agg(F.max("_mark").alias("h")).first()["h"]
    return (marked.where(F.col("_mark") <= F.lit(cut)) if cut is not None else marked.limit(0)).dropDuplicates(["_mark"]).drop("_mark")


#: Letters whose lower case depends on the library or on what stands beside them, and what they count as.
FOLDED = {"İ": "i", "Σ": "σ", "ς": "σ"}


def word_column(text):
    return F.regexp_extract_all(F.lower(F.translate(text, "".join(FOLDED), "".join(FOLDED.values()))), F.lit(r"\p{L}+"), F.lit(0))


def lowered(texts: pa.Array) -> pa.Array:
    """Lower case as in ``word_column``."""
    for a, b in FOLDED.items():
        texts = pc.replace_substring(texts, a, b)
    return pc.utf8_lower(texts)


class Model:
    """Languages, and a row of log frequencies by language for each known word and n-gram.

    N-grams are found by 64-bit hashes of their characters, whatever the alphabet, and then
    compared with the known one, so that equal hashes are never taken for equal n-grams.
    """

    def __init__(self, langs: list[str], prior, words: list[str], word_rows, grams: list[str], gram_rows, max_gram: int):
        self.key, self.langs, self.prior, self.max_gram = uuid.uuid4().hex, langs, prior, max_gram
        self.words, self.word_rows = pa.array(words, pa.string()), np.asarray(word_rows, float)
        size = np.array([len(g) for g in grams], np.int64)
        spelt = np.zeros((len(grams), max_gram), np.uint32)
        spelt[np.arange(max_gram) < size[:, None]] = np.frombuffer("".join(grams).encode("utf-32-le"), "<u4")
        self.seed = 0
        while True:  # until no two known ones share a hash: the first seed, as a rule
            keys = self._start(size)
            for k in range(max_gram):
                keys = np.where(k < size, self._on(keys, spelt[:, k]), keys)
            if len(np.unique(keys)) == len(keys):
                break
            self.seed += 1
        order = np.argsort(keys, kind="stable")
        self.gram_keys, self.spelt, self.gram_rows = keys[order], spelt[order], np.asarray(gram_rows, float).reshape(len(grams), len(langs))[order]

    def _start(self, size: np.ndarray) -> np.ndarray:
        return mix(size.astype(np.uint64) + np.uint64(self.seed << 8))

    @staticmethod
    def _on(keys: np.ndarray, characters: np.ndarray) -> np.ndarray:
        return keys * np.uint64(0x9E3779B97F4A7C15) + mix(characters.astype(np.uint64) + np.uint64(1))

    def rows(self, words: list[str]) -> np.ndarray:
        """Log frequencies by language of each word: its own, or the mean of its longest known n-grams."""
        out = np.zeros((len(words), len(self.langs)))
        place = pc.index_in(pa.array(words, pa.string()), value_set=self.words)
        known = place.is_valid().to_numpy(zero_copy_only=False)
        out[known] = self.word_rows[place.drop_null().to_numpy(zero_copy_only=False)]
        size = np.array([len(w) for w in words], np.int64)
        left = np.flatnonzero(~known & (size > 0))
        if not len(left) or not len(self.gram_keys):
            return out
        text = np.frombuffer("".join([f"<{words[i]}>" for i in left]).encode("utf-32-le"), "<u4")
        size = size[left] + 2
        word_of, ends = np.repeat(np.arange(len(left)), size), np.cumsum(size)
        room = ends[word_of] - np.arange(len(text))  # characters from here to the word's end
        open_ = np.ones(len(left), bool)
        for n in range(self.max_gram, 0, -1):
            at = np.flatnonzero((room >= n) & open_[word_of])
            key = self._start(np.full(len(at), n))
            for k in range(n):
                key = self._on(key, text[at + k])
            i = np.minimum(np.searchsorted(self.gram_keys, key), len(self.gram_keys) - 1)
            hit = self.gram_keys[i] == key
            for k in range(n):
                hit &= self.spelt[i, k] == text[at + k]
            w, i = word_of[at[hit]], i[hit]
            if len(w):
                first = np.flatnonzero(np.diff(w, prepend=-1))
                out[left[w[first]]] = np.add.reduceat(self.gram_rows[i], first, axis=0) / np.diff([*first, len(w)])[:, None]
                open_[w] = False
        return out


def fit(rows: DataFrame, max_gram: int = 5, train_docs: int = TRAIN_DOCS) -> Model:
    """Learns from ``rows`` (``doc_id, text, lang``); null labels are left out."""
    labelled = rows.where("lang IS NOT NULL").select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    labelled = staged(sample_by_hash(labelled, train_docs, "doc_id", "text"), "labelled")
    langs_n = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(langs_n)
    counts = labelled.select("lang", F.explode(word_column(F.col("text"))).alias("w")).groupBy("w", "lang").agg(F.count("*").alias("n"))
    counts = staged(counts, "words")

    def table(c: DataFrame):
        wide = c.groupBy("w").agg(
            *[F.coalesce(F.sum(F.when(F.col("lang") == x, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, x in enumerate(langs)], F.sum("n").alias("all")
        )
        got = wide.where(F.col("all") >= LEAST).toPandas().sort_values("w")
        n = got[[f"n{i}" for i in range(len(langs))]].to_numpy(float).reshape(len(got), len(langs))
        return got["w"].tolist(), n

    def logs(n):
        """Log frequencies, less those of a word that no language has."""
        total = n.sum(axis=0) + 1
        return np.log((n + 0.5) / (total + 0.5 * len(n))) - np.log(0.5 / (total + 0.5 * len(n)))

    if not langs:
        return Model([], np.zeros(0), [], np.zeros((0, 0)), [], np.zeros((0, 0)), max_gram)
    words, n = table(counts)
    padded = counts.select("lang", "n", F.concat(F.lit("<"), "w", F.lit(">")).alias("p"))
    grams = padded.select(
        "lang", "n",
        F.explode(F.expr(f"flatten(transform(sequence(1, {max_gram}), k -> if(length(p) >= k, transform(sequence(1, length(p) - k + 1), i -> substring(p, i, k)), array())))")).alias("w"),
    ).groupBy("w", "lang").agg(F.sum("n").alias("n"))
    gram_words, m = table(grams)
    prior = np.log(np.array([langs_n[x] for x in langs], float) / sum(langs_n.values()))
    return Model(langs, prior, words, logs(n), gram_words, logs(m), max_gram)


def predict(docs: DataFrame, model: Model, *keep: str, text: str = "text", posterior: bool = False) -> DataFrame:
    """The columns ``keep``, and ``lang_pred, score`` of column ``text`` of every document.

    With ``posterior`` also ``n_words`` and ``posterior``, in the order of the model's
    languages (flat for a text without letters).
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    if posterior:
        schema = schema.add("n_words", "long").add("posterior", T.ArrayType(T.DoubleType()))

    def work(batches):
        release(keep="language")
        m = shared.value
        k = len(m.langs)
        seen = worker_cache(("language", m.key), lambda: {"words": pa.array([], pa.string()), "rows": np.zeros((0, k))})
        for part in blocks(batches, held, BLOCK_BYTES):
            whole = pc.fill_null(part[held].combine_chunks(), "")
            split = pc.split_pattern_regex(lowered(whole), r"[^\p{L}]+")
            n = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = pc.list_flatten(split).dictionary_encode()
            uniq, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
            if len(seen["words"]) > CACHE_WORDS:
                seen["words"], seen["rows"] = seen["words"][:0], seen["rows"][:0]
            at = pc.index_in(uniq, value_set=seen["words"])
            if at.null_count:
                new = uniq.filter(at.is_null())
                seen["words"] = pa.concat_arrays([seen["words"], new])
                seen["rows"] = np.concatenate((seen["rows"], m.rows(new.to_pylist())))
                at = pc.index_in(uniq, value_set=seen["words"])
            rows = seen["rows"][at.to_numpy(zero_copy_only=False)] if len(uniq) else np.zeros((0, k))
            ends = np.cumsum(n)
            real = pc.not_equal(uniq, "").to_numpy(zero_copy_only=False)[codes] if len(uniq) else np.zeros(0, bool)
            letters = np.concatenate(([0], np.cumsum(real)))
            letters = letters[ends] - letters[ends - n]
            scores = np.zeros((len(n), k))
            for c in range(k):
                total = np.concatenate(([0.0], np.cumsum(rows[:, c][codes])))
                scores[:, c] = total[ends] - total[ends - n] + m.prior[c]
            if k:
                best = scores.argmax(axis=1)
                share = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
                lang = pc.if_else(pa.array(letters > 0), pa.array(m.langs, pa.string()).take(pa.array(best)), UNKNOWN)
                share = np.where(letters > 0, share, 0.0)
            else:
                lang, share = pa.array([UNKNOWN] * len(n), pa.string()), np.zeros(len(n))
            if posterior:
                p = np.exp(scores - scores.max(axis=1, keepdims=True)) if k else scores
                p = np.where((letters > 0)[:, None], p / p.sum(axis=1, keepdims=True), 1 / k) if k else p
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, k, dtype=np.int32)) if k else pa.array(np.zeros(len(n) + 1, np.int32)), pa.array(p.reshape(-1)))
                extra = {"n_words": pa.array(letters.astype(np.int64)), "posterior": lists}
            out = part if text in keep else part.drop_columns([held])
            out = out.append_column("lang_pred", lang).append_column("score", pa.array(share, pa.float64()))
            for name, column in extra.items() if posterior else ():
                out = out.append_column(name, column)
            yield from out.to_batches()
        part = whole = split = coded = codes = rows = real = letters = scores = lang = out = None  # but not the scores of words
        release(keep="language")

    held = text if text in keep else "_text"
    return docs.select(*keep, *([] if text in keep else [F.col(text).cast("string").alias(held)])).mapInArrow(work, schema)

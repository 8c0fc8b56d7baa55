"""Quality scores by a regularised quadratic discriminant over document statistics.

Each text becomes a short vector of transformed statistics (log sizes, logit shares of
kinds of characters, repeated lines, echoed words).  Per class, mean and covariance come from sums and
products that Spark adds up over all training rows; covariances shrink towards the pooled
one and its diagonal.  A score is the logistic of the Mahalanobis log-density difference,
from Cholesky factors computed once.

Defined cases: a null text is empty, and empty texts have a score like any other; labels
that are null teach nothing; a document labelled more than once counts with its mean label,
rounded up from one half; labels other than 0 and 1 teach nothing; with fewer than two
classes every score is the share of label 1 (0.5 without labels); a text of any length is
described as a whole; repeated rows of documents, and rows with a null id, each get a row;
an empty table gives an empty one; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import staged
from graphloom.llm.encode import blocks, release
from graphloom.llm.shingles import word_hashes

FEATURES = ("size", "word_size", "line_size", "upper", "digit", "plain_mark", "odd_mark", "bar", "bang", "space", "odd_lines", "same_lines", "same_words")


def _kinds() -> np.ndarray:
    """Of each byte: bit flags of the kinds of characters that are counted."""
    k = np.zeros(256, np.uint8)
    k[[ord(c) for c in " \t\n\r\v\f"]] |= 1
    k[ord("A") : ord("Z") + 1] |= 2
    k[ord("0") : ord("9") + 1] |= 4
    k[[ord(c) for c in ".,;:?'-()\""]] |= 8
    k[[ord(c) for c in "#$%&*@+=<>^~_\\/[]{}`"]] |= 16
    k[ord("|")] |= 32
    k[ord("!")] |= 64
    k[ord("a") : ord("z") + 1] |= 128
    k[128:] |= 128
    return k


KINDS = _kinds()


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text of a block."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    at = offsets - offsets[0]
    kind = KINDS[raw]

    def counts(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return (total[at[1:]] - total[at[:-1]]).astype(float)

    n = np.diff(at).astype(float)
    space, upper, digit, plain, odd, bar, bang = (counts(kind & b > 0) for b in (1, 2, 4, 8, 16, 32, 64))
    lower = counts(kind & 128 > 0)
    hashes, word_at = word_hashes(texts)
    words = np.diff(word_at).astype(float)
    lines = counts(raw == 10) + 1
    split = pc.split_pattern(texts, "\n")
    of_line = np.repeat(np.arange(len(n)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    flat = pc.list_flatten(split)
    codes = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs = np.unique(of_line * (codes.max() + 1 if len(codes) else 1) + codes)
    distinct = np.bincount(pairs // (codes.max() + 1 if len(codes) else 1), minlength=len(n)) if len(codes) else np.zeros(len(n))
    # lines of which more than a tenth are odd marks, bars, bangs, or more than half capitals
    b = np.flatnonzero(raw == 10)
    ends = np.sort(np.concatenate((b, at[1:])))
    starts = np.concatenate(([0], ends[:-1]))
    weird = np.concatenate(([0], np.cumsum(kind & (16 | 32 | 64) > 0, dtype=np.int64)))
    caps = np.concatenate(([0], np.cumsum(kind & 2 > 0, dtype=np.int64)))
    size = np.maximum(ends - starts, 1)
    bad = ((weird[ends] - weird[starts]) > 0.1 * size) | ((caps[ends] - caps[starts]) > 0.5 * size)
    bad_bytes = np.concatenate(([0], np.cumsum(np.where(bad, ends - starts, 0))))
    line_at = np.searchsorted(ends, at[1:], "right")
    odd_bytes = bad_bytes[line_at] - bad_bytes[np.concatenate(([0], line_at[:-1]))]

    again = np.concatenate(([0], np.cumsum(hashes[1:] == hashes[:-1], dtype=np.int64), [0]))[: len(hashes) + 1] if len(hashes) else np.zeros(1, np.int64)
    inner = np.maximum(word_at[1:] - 1, word_at[:-1])
    echoed = (again[np.minimum(inner, len(again) - 1)] - again[np.minimum(word_at[:-1], len(again) - 1)]).astype(float)

    def logit(part, whole):
        p = (part + 0.5) / (whole + 1)
        return np.log(p / (1 - p + 1e-9) + 1e-9)

    letters = upper + lower
    return np.column_stack((
        np.log1p(n), np.log1p(n / np.maximum(words, 1)), np.log1p(n / lines), logit(upper, letters), logit(digit, n), logit(plain, n),
        logit(odd, n), logit(bar, n), logit(bang, n), logit(space, n), logit(odd_bytes, n), logit(lines - distinct, lines), logit(echoed, words),
    ))


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id, x0, x1, ...``: the statistics of every whole text."""
    names = [f"x{i}" for i in range(len(FEATURES))]

    def work(batches):
        release()
        for part in blocks(batches, size=2 << 20):
            x = statistics(part["text"].combine_chunks())
            yield pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks(), *(pa.array(x[:, i]) for i in range(x.shape[1]))], ["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, " + ", ".join(f"{n} double" for n in names))


class Discriminant:
    """Means, Cholesky factors and log priors of two classes."""

    def __init__(self, sums: dict[int, tuple[float, np.ndarray, np.ndarray]], towards_pool: float, towards_diagonal: float):
        """``sums``: of each class its count, sum vector and matrix of summed products."""
        total = sum(n for n, _, _ in sums.values())
        self.rate = sums[1][0] / total if total and 1 in sums else 0.0 if total else 0.5
        self.parts = []
        if len(sums) < 2:
            return
        means = {c: s / n for c, (n, s, _) in sums.items()}
        covs = {c: p / n - np.outer(means[c], means[c]) for c, (n, _, p) in sums.items()}
        pool = sum(n * covs[c] for c, (n, _, _) in sums.items()) / total
        for c in (0, 1):
            # a class with few rows leans more on the pooled covariance
            n, d = sums[c][0], len(pool)
            lean = max(towards_pool, d / (d + n))
            cov = (1 - lean) * covs[c] + lean * pool
            cov = (1 - towards_diagonal) * cov + towards_diagonal * np.diag(np.diag(cov)) + 1e-6 * np.eye(d)
            root = np.linalg.cholesky(cov)
            self.parts.append((means[c], np.linalg.inv(root), np.log(np.diag(root)).sum(), np.log(n / total)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Of each row, the posterior of label 1."""
        if not self.parts:
            return np.full(len(x), self.rate)
        log = [p - h - 0.5 * (((x - m) @ inv.T) ** 2).sum(axis=1) for m, inv, h, p in self.parts]
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))


def fit(described: DataFrame, labels: DataFrame, towards_pool: float = 0.1, towards_diagonal: float = 0.05) -> Discriminant:
    """Learns from the rows of ``described`` that ``labels`` (``doc_id, quality``) has."""
    label = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.floor(F.avg("quality") + 0.5).cast("int").alias("y"))
    d = len(FEATURES)
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    got = (
        described.join(label, "doc_id").groupBy("y").agg(F.count("*").alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(d)], *products).collect()
    )
    sums = {}
    for r in got:
        p = np.zeros((d, d))
        for i in range(d):
            for j in range(i, d):
                p[i, j] = p[j, i] = r[f"p{i}_{j}"]
        sums[r["y"]] = (float(r["n"]), np.array([r[f"s{i}"] for i in range(d)]), p)
    return Discriminant({c: s for c, s in sums.items() if c in (0, 1)}, towards_pool, towards_diagonal)


def score(described: DataFrame, model: Discriminant) -> DataFrame:
    """``doc_id, score`` of every described document."""
    shared = described.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], ["doc_id", "score"])

    return described.mapInArrow(work, "doc_id long, score double")


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from ``labels`` and scores every document of ``docs``."""
    described = staged(describe(docs), "statistics")
    return score(described, fit(described, labels))

"""Quality scores from supervised subword embeddings.

A document's features are its words, its pairs of consecutive words and the character n-grams inside its words (the
word's two borders count as characters), each hashed to a row of an embedding table, and one row that every document has.
The document vector is the mean of its features' rows, taken kind by kind so that the many n-grams do not drown the pairs,
and these means weighed; a softmax over the classes follows. Rows that training never touched are zero. Table and softmax are learned
together by stochastic gradient descent in numpy, one document a step, with a falling rate. Features of the labelled sample
are counted in Spark tasks, over whole texts; only the counts reach the driver.

With two classes the difference of the two logits is linear in every row, so for scoring each row is folded into one
number: a document's score is the logistic of the mean of its features' numbers. That is the same model, exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import textkernels as K
from folioflow.llm.common import crc32_of_id, pieces

#: Odd multipliers that tell pairs of words and places in an n-gram apart.
PAIR, PLACE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Weights of the kinds of features (words, pairs of words, n-grams) and of the row that every document has.
KINDS, OWN = (0.2, 0.6, 0.2), 0.02


@dataclass
class Embeddings:
    """Embedding rows (the last belongs to every document), softmax weights, and the n-gram lengths."""

    rows: np.ndarray
    softmax: np.ndarray
    grams: tuple[int, ...]

    @property
    def buckets(self) -> int:
        return len(self.rows) - 1

    def folded(self) -> np.ndarray:
        """For every row, what it adds to the logit of class 1 over class 0."""
        return (self.rows @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float32)


def features(texts: pa.Array, buckets: int, grams: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Batches of features: kind, where each text's begin (one more at the end), and their buckets.

    Words come first, then pairs of words, then n-grams of each length. Buckets are a power of two. A gram may touch a border
    at its ends only. Grams are of characters, not of bytes.
    """
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    words = K.words_of(texts, K.SPACED, lower=False)
    codes, first = words.codes(K.LANES[0]), words.first
    yield 0, first, (codes >> shift).astype(np.int64)
    ends = np.zeros(len(codes), dtype=bool)
    ends[first[1:][words.counts > 0] - 1] = True
    follows = np.flatnonzero(~ends)
    yield 1, np.concatenate([[0], np.cumsum(np.maximum(words.counts - 1, 0))]), (K.mix(codes[follows] * PAIR + codes[follows + 1]) >> shift).astype(np.int64)
    every = [t or "" for t in texts.to_pylist()]
    symbol = np.frombuffer(" ".join(["", *every, ""]).encode("utf-32-le"), np.uint32)
    inside = (symbol != 32) & ((symbol < 9) | (symbol > 13))
    symbol = np.where(inside, symbol, 32).astype(np.uint64)
    # Place p > 0 is character p - 1 of the texts joined by one border; a first border belongs to the text after it.
    cuts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in every])])
    for n in grams:
        count = max(len(symbol) - n + 1, 0)
        packed, good = symbol[:count].copy(), np.ones(count, dtype=bool)
        for j in range(1, n):
            packed *= PLACE
            packed += symbol[j : j + count]
            if j < n - 1:
                good &= inside[j : j + count]
        at = np.flatnonzero(good)
        yield 2, np.searchsorted(at, cuts), (K.mix(packed[at] + np.uint64(n << 56)) >> shift).astype(np.int64)


def bag(text: pa.Array, buckets: int, grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of one text's features with the row that every document has, and their weights, which add up to one."""
    found = [(kind, bucket) for kind, _, bucket in features(text, buckets, grams)]
    sizes = np.bincount([kind for kind, b in found], [len(b) for _, b in found], len(KINDS))
    index = np.concatenate([*(b for _, b in found), [buckets]])
    weight = np.concatenate([*(np.full(len(b), KINDS[kind] / max(sizes[kind], 1)) for kind, b in found), [OWN]])
    which, place = np.unique(index, return_inverse=True)
    share = np.bincount(place, weight)
    return which.astype(np.int32), (share / share.sum()).astype(np.float32)


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, buckets: int, dim: int, grams: tuple[int, ...], epochs: int, rate: float, seed: int = 11) -> Embeddings:
    """Stochastic gradient descent over documents in a seeded order, one a step; the rate falls linearly to zero."""
    rng = np.random.default_rng(seed)
    rows = rng.uniform(-1 / dim, 1 / dim, (buckets + 1, dim)).astype(np.float32)
    softmax, touched = np.zeros((dim, 2), dtype=np.float32), np.zeros(buckets + 1, dtype=bool)
    steps, done = epochs * len(bags), 0
    for _ in range(epochs):
        for i in rng.permutation(len(bags)):
            index, share = bags[i]
            mine = rows[index]
            hidden = share @ mine
            logit = hidden @ softmax
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[int(labels[i])] -= 1
            now = rate * (1 - done / steps)
            back = softmax @ p
            softmax -= now * np.outer(hidden, p)
            # A row's gradient is its share of the mean; divided by the largest share, as rare features would never move.
            rows[index] = mine - now * (share / share.max())[:, None] * back
            touched[index] = True
            done += 1
    rows[~touched] = 0
    return Embeddings(rows, softmax, grams)


def scores(texts: pa.Array, folded: np.ndarray, grams: tuple[int, ...]) -> np.ndarray:
    """Probability of class 1 for each text."""
    n_docs, buckets = len(texts), len(folded) - 1
    total, count = np.zeros((len(KINDS), n_docs)), np.zeros((len(KINDS), n_docs))
    for kind, cuts, bucket in features(texts, buckets, grams):
        sums = np.concatenate([[0.0], np.cumsum(folded[bucket], dtype=np.float64)])
        total[kind] += np.diff(sums[cuts])
        count[kind] += np.diff(cuts)
    weight = np.where(count > 0, np.array(KINDS)[:, None], 0.0)
    logit = ((weight * total / np.maximum(count, 1)).sum(axis=0) + OWN * float(folded[-1])) / (weight.sum(axis=0) + OWN)
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: int, held_out_fold: int, sample: int) -> DataFrame:
    """(doc_id, label) of at most ``sample`` labels outside the held-out fold whose document is there, the first by a hash.

    Ids alone are shuffled for it.
    """
    good = F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (F.pmod(crc32_of_id(F.col("doc_id")), F.lit(folds)) != held_out_fold)
    present = labels.where(good).select("doc_id", "label").distinct().join(docs.select("doc_id"), "doc_id", "left_semi")
    return present.orderBy(F.xxhash64("doc_id", F.lit(10)), "doc_id", "label").limit(sample)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, held_out_fold: int = 0, sample: int = 2500, buckets: int = 1 << 17, dim: int = 8, grams: tuple[int, ...] = (3, 4), epochs: int = 6, least_steps: int = 4000, rate: float = 0.5) -> Embeddings:
    """The model of the whole texts of at most ``sample`` labels outside the held-out fold.

    A small sample is gone through more often than ``epochs`` times, until ``least_steps`` steps are made.

    Labels other than 0 and 1 and labels without a document are ignored; a document with two labels counts with both; of rows
    that share an id the one of least text counts, so that the driver gets no more than ``sample`` bags.
    """
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    marked = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label"))
    chosen = labelled_sample(named, marked, folds, held_out_fold, sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 2):
            for i in range(batch.num_rows):
                index, share = bag(batch.column(2).slice(i, 1), buckets, grams)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), pa.array([index.tobytes()], pa.binary()), pa.array([share.tobytes()], pa.binary())], names=["doc_id", "label", "index", "share"])

    id_type = named.schema["doc_id"].dataType.simpleString()
    one_each = named.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    counted = one_each.mapInArrow(count, f"doc_id {id_type}, label int, index binary, share binary")
    rows = sorted(counted.toArrow().to_pylist(), key=lambda r: (r["doc_id"], r["label"], r["index"], r["share"]))  # bounded by sample
    bags = [(np.frombuffer(r["index"], np.int32), np.frombuffer(r["share"], np.float32)) for r in rows]
    rounds = max(epochs, -(-least_steps // max(len(bags), 1)))
    return fit(bags, np.array([r["label"] for r in rows], dtype=np.int64), buckets, dim, grams, rounds, rate)


def quality_score(spark: SparkSession, model: Embeddings, text: Column) -> Column:
    """Probability of label 1 for whole texts, null and empty ones included."""
    held, grams = spark.sparkContext.broadcast(model.folded()), model.grams

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        parts = pieces([pa.RecordBatch.from_arrays([texts], names=["text"])], 0, 1 << 18)
        return pa.array(np.concatenate([np.zeros(0), *(scores(part.column(0), held.value, grams) for part in parts)]))

    return score(text)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_out_fold: int = 0, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 at ``threshold`` or more) per document.

    Fitted as ``fit_quality`` says, on rows whose crc32(id as text) mod ``folds`` is not ``held_out_fold``. Null and empty
    texts get the score of the row all documents have; without any label every score is 0.5. held_out is false for a null
    id. Other columns are ignored; an empty table gives no rows.
    """
    model = fit_quality(docs, labels, id_col, text_col, folds=folds, held_out_fold=held_out_fold, **options)
    named = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    held_out = F.coalesce(F.pmod(crc32_of_id(F.col("doc_id")), F.lit(folds)) == held_out_fold, F.lit(False))
    scored = named.select("doc_id", held_out.alias("held_out"), quality_score(docs.sparkSession, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **options) -> DataFrame:
    """The documents that score ``threshold`` or more, all their columns as they were."""
    model = fit_quality(docs, labels, id_col, text_col, **options)
    return docs.where(quality_score(docs.sparkSession, model, F.col(f"`{text_col}`")) >= threshold)

"""Quality classifier: supervised subword embeddings.

Words, byte 3- and 4-grams and whether a word repeats the one before it are hashed into buckets, each bucket has a learned vector, and a document
is the average of its vectors, followed by softmax over two classes; numpy stochastic gradient descent
learns both layers. As nothing but sums lies between the average and the softmax, scoring needs only
one number a bucket, the vector's projection on the difference of the classes: results are the same.

Fitting uses a bounded sample of labelled rows, ``SAMPLE`` documents with the smallest hashes of their
ids, which come to the driver as at most ``BUCKETS`` counts each. Scoring reads every whole text.

Defined results: every text also has one feature of its own kind (its end), so an empty or null text
gets the score that this feature earned. Without labels every score is 0.5. A label of a document that
isn't there, or a null one, is left out. Repeated rows are scored each; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbalance.llm.common import blocks, utf8
from flowbalance.llm.words import word_hashes

SAMPLE, BUCKETS, WIDTH, GRAMS = 4096, 1 << 16, 16, (3, 4)


def _features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each feature, features before each text and in all), kind by kind.

    Buckets 0 to 2 are the end, a word that repeats the one before it, and one that doesn't.
    """
    yield np.zeros(len(offsets) - 1, np.int64), np.arange(len(offsets))
    words, first = word_hashes(data, offsets)
    yield (words % np.uint64(BUCKETS - 3)).astype(np.int64) + 3, first
    follows = np.ones(len(words), bool)
    follows[first[:-1][np.diff(first) > 0]] = False
    at = np.flatnonzero(follows)
    yield np.where(words[at] == words[at - 1], 1, 2), np.searchsorted(at, first)
    start = np.repeat(offsets[:-1], np.diff(offsets))
    for n in GRAMS:
        h = np.full(max(len(data) - n + 1, 0), n, np.uint32)
        for k in range(n):
            h = (h ^ data[k:k + len(h)]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        inside = np.arange(n - 1, n - 1 + len(h)) - start[n - 1:] >= n - 1
        before = np.concatenate(([0], np.cumsum(np.bincount(np.searchsorted(offsets, np.arange(n - 1, len(data))[inside], side="right") - 1, minlength=len(offsets) - 1))))
        yield (h[inside] % np.uint32(BUCKETS - 3)).astype(np.int64) + 3, before


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, data, offsets in blocks(batch["body"], 1):
            bag = np.zeros(BUCKETS, np.int64)
            for bucket, _ in _features(data, offsets):
                bag += np.bincount(bucket, minlength=BUCKETS)
            at = np.flatnonzero(bag)
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), batch["label"].slice(lo, hi - lo), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([bag[at].astype(np.float32)], pa.list_(pa.float32()))], names=["doc_id", "label", "at", "n"])


def descend(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 12, rate: float = 1.0, seed: int = 7) -> np.ndarray:
    """Projection of every bucket on class 1 minus class 0, learned from (buckets, counts) and labels."""
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    classes = np.zeros((2, WIDTH), np.float32)
    steps, done = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for i in draw.permutation(len(bags)):
            at, n = bags[i]
            share = n / n.sum()
            mean = share @ vectors[at]
            out = classes @ mean
            chance = np.exp(out - out.max())
            chance /= chance.sum()
            chance[labels[i]] -= 1
            step = rate * (1 - done / steps)
            back = chance @ classes
            classes -= step * chance[:, None] * mean
            # vectors see the step as if a text had few features, or they'd hardly move
            vectors[at] -= step * (share * min(len(at), 100))[:, None] * back
            done += 1
    return (vectors @ (classes[1] - classes[0])).astype(np.float64)


def fit(labelled: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Model from ``labelled(doc_id, text)`` and ``labels(doc_id, label 0/1)``, both already without
    the rows held out. Labels without a document don't count against the sample."""
    known = labels.join(labelled.select("doc_id"), "doc_id", "left_semi")
    chosen = (known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).select("doc_id", F.col("label").cast("int").alias("label")).distinct()
              .orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id", "label").limit(sample))
    # at most `sample` rows of two numbers
    rows = labelled.select("doc_id", utf8().alias("body")).join(F.broadcast(chosen), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "label", "body")
    found = rows.mapInArrow(_counts, "doc_id long, label int, at array<int>, n array<float>").orderBy("doc_id", "label").limit(sample).toArrow()
    bags = [(a.values.to_numpy().astype(np.int64), n.values.to_numpy()) for a, n in zip(found["at"], found["n"], strict=True)]
    return descend(bags, found["label"].to_numpy())


def _score(shared):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            score = np.zeros(batch.num_rows)
            for lo, hi, data, offsets in blocks(batch["body"], 1 << 20):
                total, n = np.zeros(hi - lo), np.zeros(hi - lo)
                for bucket, before in _features(data, offsets):
                    sums = np.concatenate(([0.0], np.cumsum(weight[bucket])))
                    total += sums[before[1:]] - sums[before[:-1]]
                    n += np.diff(before)
                score[lo:hi] = 1 / (1 + np.exp(-np.clip(total / n, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(score)], names=["doc_id", "score"])

    return rows


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, score of class 1 from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("body"))
    return rows.mapInArrow(_score(shared), "doc_id long, score double")

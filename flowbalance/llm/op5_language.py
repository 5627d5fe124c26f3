"""Language ID as inference of a multilingual mixture.

Learning counts byte n-grams (of lower-cased words, hashed into a fixed number of buckets) per language
over all labelled documents; the model is languages x buckets of log probabilities. A document is a
mixture: each of its words comes from one language, and expectation-maximisation finds the proportions
that make its n-grams likeliest. Languages are then taken away, the least likely first, as long as the
penalised likelihood (each language costs half the logarithm of the number of words) gets better. The
prediction is the largest proportion, and the score is that proportion.

The model's size is known before it is sent to the executors: ``MOST_CELLS`` bounds languages x sizes x buckets.
Buckets are halved until that holds, which merges neighbouring ones: up to 128 languages have all of them, and
each doubling beyond costs a bit of the hash. Blocks of text shrink in the same measure. At ``LEAST_BUCKETS``, over
16,384 languages, learning stops with an error, as that is no set of languages any more.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is everything if no
language was learned. Ties go to the language that sorts first. Repeated rows are judged each; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowbalance.llm.common import LOWER, UPPER, blocks, cut, utf8

BUCKETS = 1 << 15
SIZES = (1, 2, 3, 4)
MOST_CELLS = 1 << 24
LEAST_BUCKETS = 1 << 8
BLOCK = 512 << 10
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[list(UPPER.encode())] = list(LOWER.encode())
_FOLD[[9, 10, 11, 12, 13]] = 32
_LETTER = np.zeros(256, bool)
_LETTER[128:] = True
_LETTER[list((UPPER + LOWER).encode())] = True


def _grams(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each n-gram as a row per n and a column per byte, word of each byte or -1, word offsets).

    Bytes of letters make words, with the byte before each as its boundary; an n-gram ends at its byte.
    Upper-case letters outside ASCII keep their bytes.
    """
    low = _FOLD[data].astype(np.uint32)
    letter = _LETTER[data]
    fresh = letter.copy()
    text_start = np.zeros(len(data) + 1, bool)
    text_start[offsets[:-1]] = True
    fresh[1:] &= ~letter[:-1] | text_start[1:-1]
    word = np.cumsum(fresh) - 1
    begin = np.flatnonzero(fresh)
    low[~letter] = 32
    padded = np.concatenate((np.full(4, 32, np.uint32), low))
    at = np.arange(len(data)) - (begin[word] if len(begin) else 0)  # bytes since the word began
    out = np.empty((len(SIZES), len(data)), np.int32)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    for row, n in enumerate(SIZES):
        h = np.full(len(data), n, np.uint32)
        for back in range(n - 1, -1, -1):
            byte = padded[4 - back:4 - back + len(data)]
            byte = np.where(at >= back, byte, np.uint32(32))
            h = (h ^ byte) * np.uint32(0x01000193)
        out[row] = (h * np.uint32(0x9E3779B1)) >> shift
    return out, np.where(letter, word, -1), np.append(begin, len(data))


def _counts(buckets: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), object)
            for lo, hi, data, offsets in blocks(batch["body"], 1 << 20):
                grams, word, _ = _grams(data, offsets, buckets)
                of = np.repeat(np.arange(hi - lo), np.diff(offsets))
                names, code = np.unique(langs[lo:hi], return_inverse=True)
                keep = word >= 0
                which = code[of[keep]].astype(np.int64) * buckets
                for row in range(len(SIZES)):
                    found = np.bincount(which + grams[row][keep], minlength=len(names) * buckets).reshape(len(names), buckets)
                    for k, name in enumerate(names):
                        total.setdefault(name, np.zeros((len(SIZES), buckets), np.int64))[row] += found[k]
        for name, table in total.items():
            row, at = np.nonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(row * buckets + at, pa.int64()), pa.array(table[row, at], pa.int64())], names=["lang", "cell", "n"])

    return rows


def learn(labelled: DataFrame, buckets: int = BUCKETS, most_cells: int = MOST_CELLS) -> tuple[list[str], np.ndarray]:
    """Languages in order, and float32 log probabilities [sizes x buckets, languages], from all of
    ``labelled(text, lang)``; rows without a language are left out. Many languages have fewer buckets."""
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", utf8().alias("body"))
    counts = rows.mapInArrow(_counts(buckets), "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    most = most_cells // (len(SIZES) * min(buckets, LEAST_BUCKETS))
    langs = sorted(row[0] for row in counts.select("lang").distinct().limit(most + 1).collect())
    if len(langs) > most:
        raise ValueError(f"over {most} languages")
    halved = 0
    while len(langs) * len(SIZES) * (buckets >> halved) > most_cells:
        halved += 1
    if halved:  # a bucket is the upper bits of a hash, and a cell's row is a multiple of the buckets
        buckets >>= halved
        counts = counts.groupBy("lang", F.shiftright("cell", halved).alias("cell")).agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    tables = np.full((len(langs), len(SIZES) * buckets), 0.5)
    coded = found["lang"].combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    of = np.searchsorted(langs, coded.dictionary.to_pylist())[coded.indices.to_numpy()] if len(found) else np.zeros(0, np.int64)
    tables[of, found["cell"].to_numpy()] += found["n"].to_numpy()
    tables = tables.reshape(len(langs), len(SIZES), buckets)
    logs = np.log(tables / tables.sum(axis=2, keepdims=True)).astype(np.float32)
    return langs, np.ascontiguousarray(logs.reshape(len(langs), len(SIZES) * buckets).T)


def proportions(likely: np.ndarray, first: np.ndarray, steps: int = 12, again: int = 6) -> np.ndarray:
    """Proportions [texts, languages] from words' likelihoods [words, languages] (their largest is 1);
    text t has words first[t]..first[t+1]-1, one at least."""
    count = np.diff(first).astype(np.float64)
    of = np.repeat(np.arange(len(count)), np.diff(first))

    def climb(pi: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(n):
            joint = likely * pi.astype(np.float32)[of]
            joint /= joint.sum(axis=1, keepdims=True)
            pi = np.add.reduceat(joint, first[:-1], axis=0, dtype=np.float64) / count[:, None]
        fit = np.log(np.maximum((likely * pi.astype(np.float32)[of]).sum(axis=1, dtype=np.float64), 1e-300))
        return pi, np.add.reduceat(fit, first[:-1])

    langs = likely.shape[1]
    pi, fit = climb(np.full((len(count), langs), 1 / langs), steps)
    cost = 0.5 * np.log(count + 1)
    open_ = np.ones(len(count), bool)
    for _ in range(langs - 1):
        there = pi > 0
        least = np.where(there, pi, 2).argmin(axis=1)
        fewer = pi.copy()
        fewer[np.arange(len(pi)), least] = 0
        open_ &= there.sum(axis=1) > 1
        if not open_.any():
            break
        fewer /= np.maximum(fewer.sum(axis=1, keepdims=True), 1e-12)
        fewer[~open_] = pi[~open_]
        fewer, less = climb(fewer, again)
        open_ &= less + cost > fit
        pi[open_], fit[open_] = fewer[open_], less[open_]
    return pi


def _judge(shared, buckets: int, most: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, model = shared.value
        names = np.array([*langs, "und"], object)
        for batch in batches:
            pred, score = np.full(batch.num_rows, len(langs)), np.zeros(batch.num_rows)
            text = batch["row"].field("text").cast(pa.binary()).fill_null(b"")
            for lo, hi, data, offsets in blocks(text, most):
                if not langs or not len(data):
                    continue
                grams, word, begin = _grams(data, offsets, buckets)
                if len(begin) < 2:
                    continue
                held = np.flatnonzero(word >= 0)
                fits = np.zeros((len(held), len(langs)), np.float32)
                for row in range(len(SIZES)):
                    fits += model[row * buckets + grams[row][held]]
                start = np.searchsorted(held, begin[:-1])
                fits = np.add.reduceat(fits, start, axis=0) / len(SIZES)
                likely = np.exp(fits - fits.max(axis=1, keepdims=True))
                likely = np.maximum(likely, np.float32(1e-30))
                first = np.searchsorted(begin[:-1], offsets)
                full = np.flatnonzero(np.diff(first) > 0)
                pi = proportions(likely, np.append(first[:-1][full], first[-1]))
                pred[lo + full], score[lo + full] = pi.argmax(axis=1), np.minimum(pi.max(axis=1), 1)
            wordless = ~np.array(batch["lettered"].to_pylist(), bool)
            pred[wordless], score[wordless] = len(langs), 0
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(names[pred], pa.string()), pa.array(score)], names=["row", "lang_pred", "score"])

    return rows


def identify(docs: DataFrame, langs: list[str], model: np.ndarray) -> DataFrame:
    """Per row of ``docs``, which has a text: the row as a struct, lang_pred, score."""
    buckets = len(model) // len(SIZES)
    most = min(BLOCK, 128 * BLOCK // max(1, len(langs)))  # bytes of text; each has a float per language
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    rows = docs.select(row, F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered"))
    schema = T.StructType([rows.schema["row"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_judge(shared, buckets, most), schema)

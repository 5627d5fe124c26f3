"""Exact dedup by content-defined chunk recipes.

A text without white space is cut where a rolling hash of the last 32 bytes says so, into chunks of
about 1 KB. Every distinct chunk travels once, to be verified: chunks of one hash are compared byte by
byte, and where two differ, the hash gets a variant number for each. A document is then its recipe,
the ordered list of verified chunk identifiers, and equal recipes are equal texts. Long documents
themselves never move.

Defined results: a null text is an empty text, and all empty texts (also those of white space only)
are one group. The row of a group that stays has the most code points, then the smallest ``doc_id``; a
null ``doc_id`` comes last. Rows that repeat a ``doc_id`` with an equal text are counted each and share
its decision. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbalance.llm.common import SPACE, binaries, blocks, cut, keyed, lists, signed, utf8

WINDOW, LONGEST = 32, 16 << 10
GEAR = (keyed(256, 10) >> np.uint64(32)).astype(np.uint32)


def chunk_ends(data: np.ndarray, offsets: np.ndarray, bits: int = 10) -> np.ndarray:
    """End of each chunk; ends of documents that hold bytes are ends of chunks.

    A cut depends on the 32 bytes before it in the same document; the first 31 bytes hold none.
    Stretches of over 16 KB without a cut are cut every 16 KB.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    rolling = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        rolling[k:] += rolling[:-k] << np.uint32(k)
    cuts = np.flatnonzero(rolling >> np.uint32(32 - bits) == 0) + 1
    start = offsets[np.searchsorted(offsets, cuts - 1, side="right") - 1]
    ends = np.union1d(cuts[cuts - start >= WINDOW], offsets[1:][np.diff(offsets) > 0])
    starts = np.concatenate(([0], ends[:-1]))
    if (long := np.flatnonzero(ends - starts > LONGEST)).size:
        ends = np.union1d(ends, np.concatenate([np.arange(starts[i] + LONGEST, ends[i], LONGEST) for i in long]))
    return ends


def _recipes(hash_bits: int, what: str):
    """what: 'recipe' (a row per document), 'chunks' (distinct ones of a block) or 'places'."""
    mask = (1 << hash_bits) - 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, at in blocks(batch["body"]):
                raw = raw.tobytes()
                texts = [raw[a:b].translate(None, SPACE) for a, b in zip(at[:-1], at[1:], strict=True)]
                data = b"".join(texts)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in texts]))).astype(np.int64)
                ends = chunk_ends(np.frombuffer(data, np.uint8), offsets)
                starts = np.concatenate(([0], ends[:-1])).astype(np.int64) if len(ends) else ends
                ids = signed(np.array([xxhash.xxh3_64_intdigest(data[a:b]) & mask for a, b in zip(starts, ends, strict=True)], np.uint64))
                per = np.searchsorted(starts, offsets)  # chunks before each document
                if what == "chunks":
                    seen = {(int(i), data[a:b]) for i, a, b in zip(ids, starts, ends, strict=True)}
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in seen], pa.int64()), pa.array([x[1] for x in seen], pa.binary())], names=["hash", "chunk"])
                    continue
                sha = pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())
                if what == "recipe":
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), batch["n_points"].slice(lo, hi - lo), sha, lists(pa.array(ids), per)], names=["doc_id", "n_points", "text_sha256", "ids"])
                else:
                    of = np.repeat(np.arange(hi - lo), np.diff(per))
                    yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo).take(pa.array(of)), sha.take(pa.array(of)), pa.array((np.arange(len(of)) - per[of]).astype(np.int32)), pa.array(ids), binaries(data, np.concatenate((starts, [len(data)])))], names=["doc_id", "text_sha256", "pos", "hash", "chunk"])

    return rows


def exact_groups(docs: DataFrame, hash_bits: int = 64) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256.

    ``hash_bits`` narrows the chunk hash; results don't depend on it.
    """
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_points"), utf8().alias("body"))
    recipes = cut(body.mapInArrow(_recipes(hash_bits, "recipe"), "doc_id long, n_points long, text_sha256 string, ids array<long>"))

    chunks = body.select("body").mapInArrow(_recipes(hash_bits, "chunks"), "hash long, chunk binary").distinct()
    shared = chunks.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    clashes = cut(shared)
    if clashes.isEmpty():  # every hash stands for one verified chunk
        recipes = recipes.withColumn("variants", F.lit("").cast("string"))
    else:
        # per hash few contents: a variant is the content's place among those of its hash
        variants = chunks.join(clashes, "hash").groupBy("hash").agg(F.sort_array(F.collect_list("chunk")).alias("contents")).select("hash", F.posexplode("contents").alias("variant", "chunk"))
        places = body.select("doc_id", "body", "n_points").mapInArrow(_recipes(hash_bits, "places"), "doc_id long, text_sha256 string, pos int, hash long, chunk binary")
        marks = (places.join(variants.where("variant > 0"), ["hash", "chunk"]).select("doc_id", "text_sha256", "pos", "variant").distinct()
                 .groupBy("doc_id", "text_sha256").agg(F.to_json(F.sort_array(F.collect_list(F.struct("pos", "variant")))).alias("found")))
        recipes = (recipes.alias("r").join(marks.alias("m"), (F.col("r.doc_id").eqNullSafe(F.col("m.doc_id"))) & (F.col("r.text_sha256") == F.col("m.text_sha256")), "left")
                   .select("r.*", F.coalesce("m.found", F.lit("")).alias("variants")))
    recipes = recipes.withColumn("recipe", F.xxhash64("ids", "variants"))
    # written out, so that Spark splits the partition of a large group in the join
    groups = cut(recipes.groupBy("recipe", "ids", "variants").agg(
        F.count("*").alias("group_size"), F.min(F.struct(-F.col("n_points"), F.col("doc_id").isNull(), "doc_id")).alias("best")))
    return (recipes.join(groups, ["recipe", "ids", "variants"])
            .select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
                    F.col("doc_id").eqNullSafe(F.col("best.doc_id")).alias("kept"), "text_sha256"))

"""MinHash near-dedup by a multi-index Hamming join.

A document is the set of its word shingles, as 64-bit hashes. Documents of equal sets are one class and
go on as their smallest ``doc_id``. A class's signature is ``LANES`` minimum hashes of ``b`` = 16 bits. It
is split into chunks of ``CHUNK`` lanes, and in each chunk one wrong lane is allowed: leaving out each lane
in turn gives ``CHUNK`` keys, so two signatures of which a chunk differs in one lane at most share a key.
By the pigeonhole principle no pair that differs in at most 2 * 8 - 1 = 15 of 40 lanes is missed; of pairs
at a similarity of exactly 0.8, 2 in 100,000 share no key, and fewer above.

Pairs in a bucket aren't all made. First every member meets the bucket's smallest id only, unless their
signatures differ in over ``FAR`` lanes; that joins the copies of a large group in as many pairs as there
are keys. What is left is exact: where a bucket's members aren't yet in one component, a link between two
components needs both documents to have ``percent`` of their shingles in other components. Few
do, which takes one count of shingles and no pairs. Those that do are clustered by shared keys and
compared within their clusters, block by block of ``BLOCK`` documents. Every link is confirmed on
the full sets, from whole texts.

Defined results: words are runs of anything but white space, A-Z lower-cased; a text of fewer words than
a shingle is one shingle. Documents without words, null texts included, have no shingles and no links;
so have rows without a ``doc_id``. Rows that share a ``doc_id`` are one document with the links of all
its texts. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbalance.llm.common import blocks, cut, keyed, lists, mixed, signed, utf8
from flowbalance.llm.components import components
from flowbalance.llm.words import shingles, word_hashes

LANES, CHUNK, FAR, BLOCK = 40, 5, 20, 512
_XOR, _MUL = keyed(LANES, 401), keyed(LANES, 402) | np.uint64(1)


def text_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes of each text, in order; index of each text's first and the end)."""
    found, first = shingles(*word_hashes(data, offsets), width)
    sets = [np.unique(found[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
    return np.concatenate([np.zeros(0, np.uint64), *sets]), np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def signatures(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """uint16 [sets, LANES]; every set has a member."""
    out = np.empty((len(first) - 1, LANES), np.uint16)
    for k in range(LANES):
        out[:, k] = mixed(np.minimum.reduceat((hashes ^ _XOR[k]) * _MUL[k], first[:-1])) >> np.uint64(48)
    return out


def _sets(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch["body"], 1 << 20):
                hashes, first = text_sets(data, offsets, width)
                n = np.diff(first)
                full = np.flatnonzero(n)
                stamp, sig = np.zeros((2, hi - lo), np.uint64), np.zeros((hi - lo, LANES), np.uint16)
                if len(full):
                    starts = np.append(first[:-1][full], first[-1])
                    for k in range(2):
                        stamp[k, full] = np.add.reduceat(mixed(hashes ^ keyed(2, 403)[k]), starts[:-1])
                    sig[full] = signatures(hashes, starts)
                flat = pa.array(sig.view(np.int64).ravel())
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), pa.array(n), pa.array(signed(stamp[0])), pa.array(signed(stamp[1])), pa.FixedSizeListArray.from_arrays(flat, LANES // 4).cast(pa.list_(pa.int64()))], names=["doc_id", "n", "s1", "s2", "sig"])

    return rows


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk and each lane of it left out."""
    kept = np.array([[c * CHUNK + k for k in range(CHUNK) if k != out] for c in range(LANES // CHUNK) for out in range(CHUNK)])
    salt = keyed(len(kept), 404)
    for batch in batches:
        if not batch.num_rows:
            continue
        sig = batch["sig"].flatten().to_numpy().view(np.uint16).reshape(-1, LANES)
        key = mixed(np.ascontiguousarray(sig[:, kept]).view(np.uint64).reshape(len(sig), len(kept)) + salt)
        yield pa.RecordBatch.from_arrays([pa.array(signed(key.ravel())), pa.array(np.repeat(batch["id"].to_numpy(), len(kept)))], names=["key", "id"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures differ in at most FAR lanes."""
    for batch in batches:
        if batch.num_rows:
            one, other = (batch[c].flatten().to_numpy().view(np.uint16).reshape(-1, LANES) for c in ("usig", "vsig"))
            mask = pa.array((one != other).sum(axis=1) <= FAR)
            yield pa.RecordBatch.from_arrays([batch["u"].filter(mask), batch["v"].filter(mask)], names=["u", "v"])


def _full(width: int):
    """Distinct shingles of each text."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch["body"], 1 << 20):
                hashes, first = text_sets(data, offsets, width)
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), lists(pa.array(signed(hashes)), first)], names=["id", "set"])

    return rows


def _confirm(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = np.zeros(batch.num_rows, bool)
            for i, (one, other) in enumerate(zip(batch["u_set"], batch["v_set"], strict=True)):
                one, other = one.values.to_numpy(), other.values.to_numpy()
                both = len(np.intersect1d(one, other, assume_unique=True))
                linked[i] = 100 * both >= percent * (len(one) + len(other) - both)
            mask = pa.array(linked)
            yield pa.RecordBatch.from_arrays([batch["u"].filter(mask), batch["v"].filter(mask)], names=["u", "v"])

    return rows


def _block_links(percent: int):
    """Links between the documents of two blocks of a cluster, or of one with itself."""
    def links(block: pa.Table) -> pa.Table:
        ids, label, side = (block[c].to_numpy() for c in ("id", "label", "side"))
        sets = block["set"].combine_chunks()
        sets = sets.chunk(0) if isinstance(sets, pa.ChunkedArray) else sets
        own = sets.value_parent_indices().to_numpy()
        n = np.bincount(own, minlength=len(ids))
        _, at, df = np.unique(sets.flatten().to_numpy(), return_inverse=True, return_counts=True)
        column = np.cumsum(df > 1) - 1  # shingles of one document only are in no intersection
        many = df[at] > 1
        own, at = own[many], column[at[many]]
        both = np.zeros((len(ids), len(ids)), np.float32)
        order = np.argsort(at, kind="stable")
        own, at = own[order], at[order]
        for lo in range(0, int(at.max(initial=-1)) + 1, 2048):
            a, b = np.searchsorted(at, (lo, lo + 2048))
            part = np.zeros((len(ids), 2048), np.float32)
            part[own[a:b], at[a:b] - lo] = 1
            both += part @ part.T
        union = n[:, None] + n[None, :] - both
        found = (100 * both >= percent * union) & (label[:, None] != label[None, :]) & (ids[:, None] < ids[None, :])
        if len(np.unique(side)) > 1:
            found &= side[:, None] != side[None, :]
        u, v = np.nonzero(found)
        return pa.table({"u": ids[u], "v": ids[v]})

    return links


def _across(keys: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(u, v) of all links between documents of different components that share a key."""
    placed = keys.join(labels, "id", "left").select("key", "id", F.coalesce("label", "id").alias("label"))
    apart = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    open_ = cut(placed.join(apart, "key"))
    owners = open_.select("id", "label").distinct()
    held = owners.join(sets, "id").select("id", "label", F.size("set").alias("n"), F.explode("set").alias("h"))
    # 40 bits do: two shingles taken for one can only let a document through
    shingles = held.withColumn("h", F.col("h").bitwiseAND((1 << 40) - 1)).withColumn("n", F.col("n").cast("long"))
    spread = shingles.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("h")
    shared = shingles.select("h", "id", "n").join(spread, "h").groupBy("id").agg(F.count("*").alias("shared"), F.min("n").alias("n"))
    left = cut(shared.where(F.col("shared") * 100 >= F.col("n") * percent).join(owners, "id").select("id", "label"))
    still = open_.join(left.select("id"), "id", "left_semi").select("key", "id")
    heads = still.groupBy("key").agg(F.min("id").alias("v"))
    clusters = components(still.join(heads, "key").select(F.col("id").alias("u"), "v").distinct())
    members = left.join(clusters.withColumnRenamed("label", "cluster"), "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
    size = members.groupBy("cluster").agg(F.count("*").alias("size")).where("size > 1")
    dealt = (members.join(size, "cluster").withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int"))
             .withColumn("side", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("cluster", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "id", "label", "side"))
    return dealt.join(sets, "id").groupBy("cluster", "i", "j").applyInArrow(_block_links(percent), "u long, v long")


def near_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id, kept."""
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("body"))
    thin = cut(body.mapInArrow(_sets(width), "doc_id long, n long, s1 long, s2 long, sig array<long>"))
    fit = thin.where("n > 0 and doc_id is not null")
    classes = cut(fit.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("id"), F.first("sig").alias("sig")))
    keys = classes.select("id", "sig").mapInArrow(_keys, "key long, id long")

    least = keys.groupBy("key").agg(F.min("id").alias("u"), F.max("id").alias("most")).where("u <> most").select("key", "u")
    met = cut(keys.join(least, "key").select("key", "id", "u"))  # the rows of all buckets with two ids
    needed = met.select("id").distinct()
    sets = cut(body.join(needed, F.col("doc_id") == F.col("id"), "left_semi").mapInArrow(_full(width), "id long, set array<long>"))

    alike = f"100 * least(un, vn) >= {percent} * greatest(un, vn)"
    as_u = classes.select(F.col("id").alias("u"), F.col("n").alias("un"), F.col("sig").alias("usig"))
    as_v = classes.select(F.col("id").alias("v"), F.col("n").alias("vn"), F.col("sig").alias("vsig"))
    stars = met.where("u <> id").select("u", F.col("id").alias("v")).distinct()
    tried = stars.join(as_u, "u").join(as_v, "v").where(alike).select("u", "v", "usig", "vsig").mapInArrow(_close, "u long, v long")
    links = (tried.join(sets.select(F.col("id").alias("v"), F.col("set").alias("v_set")), "v")
             .join(sets.select(F.col("id").alias("u"), F.col("set").alias("u_set")), "u")
             .select("u", "v", "u_set", "v_set").mapInArrow(_confirm(percent), "u long, v long"))
    # texts of one document in several classes
    again = cut(fit.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1").select("doc_id"))
    twice = (fit.join(again, "doc_id").join(classes.select("n", "s1", "s2", "id"), ["n", "s1", "s2"]).groupBy("doc_id").agg(F.min("id").alias("u"), F.max("id").alias("most"), F.collect_set("id").alias("all"))
             .where("u <> most").select("u", F.explode("all").alias("v")))
    first = components(links if again.isEmpty() else links.unionByName(twice))
    more = _across(met.select("key", "id"), sets, first, percent)
    labels = components(first.select(F.col("id").alias("u"), F.col("label").alias("v")).unionByName(more))
    # written out, so that Spark splits the partition of a large class in the join
    named = cut(classes.join(labels, "id", "left").select("n", "s1", "s2", F.coalesce("label", "id").alias("component")))
    return (thin.join(named, ["n", "s1", "s2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))

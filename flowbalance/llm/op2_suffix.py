"""Suffix-array dedup: every byte covered by a ``length``-byte string that also starts elsewhere goes.

Two equal strings of 400 bytes have the same anchor, the place of the smallest hash of 64 bytes within
them. So the windows of a text fall into runs by anchor, and only runs whose anchors' hashes are equal can hold
equal windows: that is what the data is partitioned by, and it is exact. A run's context is the
bytes that its windows cover. Equal contexts are one from the start (all their windows repeat, and a large
group of copies is one row); of the anchors with different contexts, the contexts' texts are
dealt to shards, and each shard is sorted by external induced sorting (``induced.py``), which gives
the windows that start at two places.

Equal windows also have equally many bytes before their anchor. Of windows with a to b bytes before it, all hold
the string from a before to 400 - b after it, their core; where a core has one context only, none of its
windows repeats. A shard leaves such windows out before it sorts. An anchor with over ``CROWD`` different
contexts would put an unbounded group into one shard: its contexts are cut into pieces, whose windows have one
core, and dealt by it instead of the anchor. Equal pieces are one, pieces of a core that is
still crowded are cut further, at last into single windows, which are their own core.

Defined results: a null text is empty; a text shorter than ``length`` keeps all. Matches never cross
documents. Repeated rows repeat each other, so a repeated text of ``length`` bytes or more is
removed whole from each of its rows. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbalance.llm.common import blocks, cut, keyed, lists, mixed, signed, utf8
from flowbalance.llm.induced import repeated
from flowbalance.llm.words import powers

GRAM, CROWD, SHARD = 64, 2048, 1 << 20
#: Pieces that the windows of an anchor are cut into at a time.
PIECES = 8
_CODES, _BASE = keyed(256, 201), 0xD1342543DE82EF95
_BACK = pow(_BASE, -1, 1 << 64)
RUN = "lo long, n int, off int, anchor long, context long"


def _prefix_sums(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_CODES[data] * powers(_BASE, len(data)), out=total[1:])
    return total, powers(_BACK, len(data))


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor, in order: first window (lo, in the block), windows (n), anchor's
    distance from lo (off), hash of the anchor and of the context."""
    wide = length - gram + 1
    none = {k: np.zeros(0, np.int64) for k in ("lo", "n", "off")} | {k: np.zeros(0, np.uint64) for k in ("anchor", "context")}
    if len(data) < length:
        return none
    total, back = _prefix_sums(data)
    grams = len(data) - gram + 1
    hashes = mixed((total[gram:] - total[:grams]) * back[:grams])
    low = np.uint64((1 << 31) - 1)  # the same in all blocks, so that equal windows have one anchor
    least = (hashes & ~low) | np.arange(grams, dtype=np.uint64)
    span = 1
    while 2 * span <= wide:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < wide:
        least = np.minimum(least[:len(least) - (wide - span)], least[wide - span:])
    at = (least & low).astype(np.int64)
    of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.flatnonzero(of[:len(at)] == of[length - 1:length - 1 + len(at)])
    if not len(inside):
        return none
    anchor = at[inside]
    first = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    lo, n = inside[first], np.diff(np.append(first, len(inside)))
    context = (total[lo + n - 1 + length] - total[lo]) * back[lo]
    off = anchor[first] - lo
    return {"lo": lo, "n": n, "off": off, "anchor": hashes[anchor[first]], "context": mixed(context ^ mixed(n.astype(np.uint64) << np.uint64(32) | off.astype(np.uint64)))}


def _runs(length: int, gram: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in blocks(batch["body"], 1 << 18):
                runs = window_runs(data, offsets, length, gram)
                doc = np.searchsorted(offsets, runs["lo"], side="right") - 1
                rows = pa.array(doc + first)
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(rows), batch["stamp"].take(rows), pa.array(runs["lo"] - offsets[doc], pa.int64()), pa.array(runs["n"], pa.int32()), pa.array(runs["off"], pa.int32()), pa.array(signed(runs["anchor"])), pa.array(signed(runs["context"]))],
                    names=["doc_id", "stamp", "lo", "n", "off", "anchor", "context"])

    return rows


def _contexts(length: int):
    """Bytes of the contexts asked of each document."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch["asked"]
            of = asked.value_parent_indices().to_numpy()
            flat = asked.flatten()
            lo, n = flat.field("lo").to_numpy(), flat.field("n").to_numpy()
            for a in range(0, len(of), 4000):
                cut_out = [batch["body"][int(d)].as_buffer()[int(x):int(x) + int(k) + length - 1].to_pybytes() for d, x, k in zip(of[a:a + 4000], lo[a:a + 4000], n[a:a + 4000], strict=True)]
                part = flat.slice(a, 4000)
                yield pa.RecordBatch.from_arrays([*(part.field(c) for c in ("anchor", "context", "off", "times", "crowd")), pa.array(cut_out, pa.binary())], names=["anchor", "context", "off", "times", "crowd", "bytes"])

    return rows


def _spans(flags: list[np.ndarray]) -> pa.Array:
    """Per context the stretches of repeated windows."""
    starts, ends, count = [], [], [0]
    for f in flags:
        edge = np.flatnonzero(np.diff(np.concatenate(([False], f, [False])).astype(np.int8)))
        starts.append(edge[::2])
        ends.append(edge[1::2] - 1)
        count.append(count[-1] + len(edge) // 2)
    flat = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int32()) for x in (starts, ends)], names=["a", "b"])
    return lists(flat, np.array(count))


class _Pieces:
    """Texts cut so that the windows of a piece have ``width * cell`` to ``width * cell + width - 1`` bytes before
    their anchor, which is ``off`` bytes into the text. Per piece: text, cell, first window, windows (n)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, off: np.ndarray, length: int, width: int):
        self.length, self.begin, (self.total, self.back) = length, offsets[:-1], _prefix_sums(data)
        windows = np.diff(offsets) - length + 1
        least = (off - windows + 1) // width
        cells = off // width - least + 1
        self.text = np.repeat(np.arange(len(off)), cells)
        self.cell = np.arange(len(self.text)) - np.repeat(np.cumsum(cells) - cells - least, cells)
        self.off = off[self.text]
        self.first = np.maximum(self.off - self.cell * width - width + 1, 0)
        self.n = np.minimum(self.off - self.cell * width, windows[self.text] - 1) - self.first + 1
        self.width = width

    def _hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of the bytes from a to b of the pieces' texts."""
        at = self.begin[self.text]
        return mixed((self.total[at + b] - self.total[at + a]) * self.back[at + a])

    def cores(self) -> np.ndarray:
        a = self.off - self.cell * self.width
        h = self._hash(a, a - self.width + 1 + self.length)
        return mixed(h ^ mixed(self.cell.astype(np.uint64) << np.uint64(32) | np.uint64(self.width)))

    def wholes(self) -> np.ndarray:
        """Hashes of the pieces, of their halves each."""
        a, b = self.first, self.first + self.n - 1 + self.length
        half = (a + b) // 2
        place = mixed(self.n.astype(np.uint64) << np.uint64(32) | (self.off - self.first).astype(np.uint64))
        return mixed(self._hash(a, half) * np.uint64(3) + self._hash(half, b) ^ place)


def _one_block(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of all values."""
    _, _, data, offsets = next(blocks(column, 1 << 40))
    return data, offsets


def may_repeat(data: np.ndarray, offsets: np.ndarray, off: np.ndarray, anchor: np.ndarray, length: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First window and end per text, which hold all that may equal a window of another text; none: 0, 0."""
    pieces = _Pieces(data, offsets, off, length, width)
    _, core, times = np.unique(pieces.cores() ^ mixed(anchor.view(np.uint64))[pieces.text], return_inverse=True, return_counts=True)
    hit = times[core] > 1
    first, end = np.full(len(off), len(data)), np.zeros(len(off), np.int64)
    np.minimum.at(first, pieces.text[hit], pieces.first[hit])
    np.maximum.at(end, pieces.text[hit], (pieces.first + pieces.n)[hit])
    return np.where(end > 0, first, 0), end


def _sorted_shard(length: int, width: int):
    def rows(shard: pa.Table) -> pa.Table:
        data, offsets = _one_block(shard["bytes"])
        lo, end = may_repeat(data, offsets, shard["off"].to_numpy().astype(np.int64), shard["anchor"].to_numpy(), length, width)
        kept = np.flatnonzero(end)
        # symbols above the end of all and of a text; bytes of UTF-8 are below 254
        kind = np.uint8 if int(data.max(initial=0)) < 254 else np.uint16
        parts, base, at = [], [], 0
        for k in kept.tolist():
            text = data[offsets[k] + lo[k]:offsets[k] + end[k] - 1 + length]
            base.append(at)
            parts += [text.astype(kind) + kind(2), np.ones(1, kind)]
            at += len(text) + 1
        hit = repeated(np.concatenate([*parts, np.zeros(1, kind)]), length)
        spans = _spans([hit[b:b + n] for b, n in zip(base, (end - lo)[kept].tolist(), strict=True)])
        out = shard.select(["level", "anchor", "context"]).take(pa.array(kept))
        return out.append_column("first", pa.array(lo[kept], pa.int32())).append_column("spans", spans)

    return rows


def _pieces(length: int, width: int):
    """Pieces of crowded texts, without their bytes."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off = batch["off"].to_numpy().astype(np.int64)
            for first, end, data, offsets in blocks(batch["bytes"], 1 << 18):
                pieces = _Pieces(data, offsets, off[first:end], length, width)
                rows = pa.array(pieces.text + first)
                yield pa.RecordBatch.from_arrays(
                    [*(batch[c].take(rows) for c in ("anchor", "context", "times")), pa.array(pieces.first, pa.int32()), pa.array(pieces.n, pa.int32()), pa.array(pieces.off - pieces.first, pa.int32()), pa.array(signed(pieces.cores())), pa.array(signed(pieces.wholes()))],
                    names=["anchor", "context", "times", "first", "n", "off", "core", "whole"])

    return rows


def _cut_further(texts: DataFrame, length: int, width: int, crowd: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of crowded texts: their pieces, the different pieces whose windows all repeat, and those yet to be compared
    (with their bytes, as texts)."""
    pieces = cut(texts.mapInArrow(_pieces(length, width), "anchor long, context long, times long, first int, n int, off int, core long, whole long"))
    one = cut(pieces.groupBy("core", "whole").agg(F.sum("times").alias("times"), F.first(F.struct("anchor", "context", "first", "n", "off")).alias("at")))
    several = cut(one.groupBy("core").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).where("kinds > 1 and least = 1").select("core", (F.col("kinds") > crowd).alias("crowd")))
    asked = cut(one.join(several, "core").select("core", "whole", "times", "crowd", "at.*"))
    held = texts.select("anchor", "context", "bytes")
    left = (asked.join(held, ["anchor", "context"])
            .select(F.col("core").alias("anchor"), F.col("whole").alias("context"), "off", "times", "crowd", F.expr(f"substring(bytes, first + 1, n + {length - 1})").alias("bytes")))
    known = one.where("times > 1").select("core", "whole", F.lit(0).alias("a"), (F.col("at.n") - 1).alias("b"))
    return pieces, known, cut(left)


def _keep(length: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, shas = [], [], []
            for body, found in zip(batch["body"], batch["found"], strict=True):
                raw = body.as_buffer().to_pybytes()
                sha, at, gone, runs = hashlib.sha256(), 0, 0, 0
                pieces = found.values if found.is_valid else None
                if pieces is not None and len(pieces):
                    a, b = pieces.field("a").to_numpy(), pieces.field("b").to_numpy() + length
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    heads = np.flatnonzero(np.append(True, a[1:] > b[:-1]))
                    for x, y in zip(a[heads].tolist(), b[np.append(heads[1:], len(a)) - 1].tolist(), strict=True):
                        sha.update(raw[at:x])
                        at, gone, runs = y, gone + y - x, runs + 1
                sha.update(raw[at:])
                removed.append(gone)
                spans.append(runs)
                shas.append(sha.hexdigest())
            n = pa.array([len(x.as_buffer()) for x in batch["body"]], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], n, pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(shas, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return rows


def remove_repeats(docs: DataFrame, length: int = 400, gram: int = GRAM, crowd: int = CROWD, shard: int = SHARD) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("stamp"), utf8().alias("body"))
    runs = body.mapInArrow(_runs(length, gram), f"doc_id long, stamp long, {RUN}")
    # sides of joins are written out first: Spark then splits the partition of a hot anchor
    often = cut(runs.groupBy("anchor").agg(F.count("*").alias("of")).where("of > 1").select("anchor"))
    some = cut(runs.join(often, "anchor", "left_semi"))
    # one row per distinct context, of any of its places
    contexts = cut(some.groupBy("anchor", "context").agg(F.count("*").alias("times"), *(F.first(c).alias(c) for c in ("doc_id", "stamp", "lo", "n", "off"))))
    # where every context repeats, all is known
    several = cut(contexts.groupBy("anchor").agg(F.count("*").alias("kinds"), F.min("times").alias("least")).where("kinds > 1 and least = 1").select("anchor", "kinds"))
    asked = (contexts.join(several, "anchor")
             .groupBy("doc_id", "stamp").agg(F.collect_list(F.struct("lo", "n", "off", "anchor", "context", "times", (F.col("kinds") > crowd).alias("crowd"))).alias("asked")))
    same_doc = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("doc_id", "stamp")]
    once = body.alias("l").join(asked.alias("r"), same_doc).select("l.doc_id", "l.stamp", "l.body", "r.asked")
    texts = cut(once.mapInArrow(_contexts(length), "anchor long, context long, off int, times long, crowd boolean, bytes binary").dropDuplicates(["anchor", "context"]))
    # what is crowded is cut into ever smaller pieces; a single window is its own core, so this ends
    plain, cuts, width = [texts.where("not crowd").withColumn("level", F.lit(0))], [], length - gram + 1
    while width > 1 and not texts.where("crowd").isEmpty():
        width = -(-width // PIECES)
        pieces, known, texts = _cut_further(texts.where("crowd"), length, width, crowd)
        cuts.append((pieces, known))
        plain.append(texts.where("not crowd").withColumn("level", F.lit(len(cuts))))
    dealt = reduce(DataFrame.unionByName, plain).select("level", "anchor", "context", "off", "bytes")
    in_all = dealt.agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = -(-in_all // shard) or 1
    kind = "array<struct<a: int, b: int>>"
    sorted_ = cut(dealt.withColumn("deal", F.pmod(F.xxhash64("anchor"), F.lit(shards))).repartition(min(shards, 20_000), "deal").groupBy("deal")
                  .applyInArrow(_sorted_shard(length, -(-(length - gram + 1) // PIECES)), f"level int, anchor long, context long, first int, spans {kind}")
                  .select("level", "anchor", "context", "first", F.inline("spans"))
                  .select("level", "anchor", "context", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b")))
    found = sorted_.where(F.col("level") == len(cuts)).drop("level")
    for level in range(len(cuts) - 1, -1, -1):
        pieces, known = cuts[level]
        of_pieces = cut(found.select(F.col("anchor").alias("core"), F.col("context").alias("whole"), "a", "b").unionByName(known))
        of_texts = pieces.join(of_pieces, ["core", "whole"]).select("anchor", "context", (F.col("first") + F.col("a")).alias("a"), (F.col("first") + F.col("b")).alias("b"))
        found = cut(of_texts.unionByName(sorted_.where(F.col("level") == level).drop("level")))
    whole = contexts.where("times > 1").select("anchor", "context", F.lit(0).alias("a"), (F.col("n") - 1).alias("b"))
    place = ["doc_id", "stamp", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.col("b")).alias("b")]
    spans = some.join(found, ["anchor", "context"]).select(*place).unionByName(some.join(whole, ["anchor", "context"]).select(*place))
    by_doc = spans.groupBy("doc_id", "stamp").agg(F.collect_set(F.struct("a", "b")).alias("found"))
    merged = body.alias("l").join(by_doc.alias("r"), same_doc, "left").select("l.doc_id", "l.body", "r.found")
    return merged.mapInArrow(_keep(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")

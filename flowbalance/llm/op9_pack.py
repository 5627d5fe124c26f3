"""Best-fit packing with a swap-based local search.

Documents become token ids once; from then on only a thin row for each piece moves. A document longer
than a sequence is cut into pieces of full length, the first of which takes the remainder. Full pieces
are sequences of their own. The others are dealt at random into groups of about ``group`` pieces, packed
best-fit, and then improved: one document for one, two for one, one for two, or one moved, always from
an emptier to a fuller bin, so that the sum of squared fills grows until bins are empty. Bins that are
still underfull meet other groups' in the next round, and a round that emptied no bin is the last.

The ids are those of the ``tokenizers`` file. They are computed by ``tiktoken`` from the same vocabulary,
which takes a quarter of the CPU time; words of over 4,096 bytes, on which it is slow, go through
``tokenizers``.

Defined results: a null text is empty, and an empty text has one piece of the end id alone. Repeated rows
are packed each. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowbalance.llm.common import cut

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
LONG_WORD = 4096
#: Tasks of a packing round; a task takes its groups one after the other.
MOST_TASKS = 4000


@cache
def encoder(vocabulary: str, ranks: str, pattern: str):
    """text -> uint32 ids; special tokens' strings are special tokens, as the file has them."""
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    with open(vocabulary) as file:
        special = {t["content"]: t["id"] for t in json.load(file)["added_tokens"] if t["special"]}
    with open(ranks, "rb") as file:
        fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}, special_tokens=special)

    def ids(text: str) -> np.ndarray:
        if len(text) > LONG_WORD and max(map(len, text.split()), default=0) > LONG_WORD // 4:
            return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return fast.encode_to_numpy(text, allowed_special="all")

    return ids


def _pieces(files: tuple[str, str, str], end_id: int, most: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*files)
        for batch in batches:
            of, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch["text"]):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                n = -(-len(ids) // most)
                ends = len(ids) - most * np.arange(n - 1, -1, -1)
                for k, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)):
                    of.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows


def best_fit(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Indices by bin: longest first, each into the fullest bin that takes it."""
    bins: list[list[int]] = []
    by_room: dict[int, list[int]] = {}
    rooms: list[int] = []  # sorted keys of by_room
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                del by_room[room]
                rooms.pop(at)
        else:
            room, b = most, len(bins)
            bins.append([])
        bins[b].append(i)
        if room := room - size:
            if room not in by_room:
                insort(rooms, room)
            by_room.setdefault(room, []).append(b)
    return bins


def _parts(members: list[int], lengths: np.ndarray) -> dict[int, tuple[int, ...]]:
    """Sum -> the one or two members that have it; members of equal length stand for each other, so
    there are at most 45 lengths in 1,024 tokens."""
    one = {int(lengths[i]): i for i in members}
    out: dict[int, tuple[int, ...]] = {}
    seen: dict[int, list[int]] = {}
    for i in members:
        if len(seen.setdefault(int(lengths[i]), [])) < 2:
            seen[int(lengths[i])].append(i)
    few = [i for same in seen.values() for i in same]
    for k, i in enumerate(few):
        for j in few[k + 1:]:
            out[int(lengths[i] + lengths[j])] = (i, j)
    return {n: m for n, m in out.items() if n not in one} | {n: (i,) for n, i in one.items()}


def local_search(bins: list[list[int]], lengths: np.ndarray, most: int) -> list[list[int]]:
    """Exchanges between underfull bins, each of which makes the sum of squared fills larger.

    A pass takes the bins from the emptiest on as givers, each until no exchange improves; a pass that
    changed nothing ends the search. There is always such a pass, as fills are whole numbers of tokens and
    the sum of their squares is bounded.
    """
    fills = np.array([lengths[b].sum() for b in bins], np.int64)
    full = [b for b, f in zip(bins, fills, strict=True) if f == most]
    bins = [b for b, f in zip(bins, fills, strict=True) if f < most]
    fills = fills[fills < most]
    parts = [_parts(b, lengths) for b in bins]

    def options(k: int) -> np.ndarray:
        """Rows of sum, documents and bin: nothing, one or two documents to give back."""
        return np.array([(0, 0, k), *((n, len(m), k) for n, m in parts[k].items())], np.int32).T

    table = np.concatenate([options(k) for k in range(len(bins))], axis=1) if bins else np.zeros((3, 0), np.int32)
    moved = True
    while moved:
        moved = False
        for a in np.argsort(fills, kind="stable").tolist():
            while 0 < fills[a] < most:
                size, many, owner = table
                fill = fills[owner]
                best = (0, 0, 0)
                for give, members in parts[a].items():
                    d = give - size
                    good = np.flatnonzero((d > 0) & (d + fill <= most) & (d + fill > fills[a]) & (owner != a) & (many <= (2 if len(members) == 1 else 1)))
                    if len(members) == 2:
                        good = good[many[good] == 1]
                    if len(good):
                        gain = d[good] * (fill[good] - fills[a] + d[good])
                        at = int(gain.argmax())
                        best = max(best, (int(gain[at]), give, int(good[at])))
                if not best[0]:
                    break
                _, give, at = best
                b, go = int(owner[at]), list(parts[a][give])
                back = list(parts[b][int(size[at])]) if many[at] else []
                bins[a] = [x for x in bins[a] if x not in go] + back
                bins[b] = [x for x in bins[b] if x not in back] + go
                table = table[:, (owner != a) & (owner != b)]
                for k in (a, b):
                    parts[k], fills[k] = _parts(bins[k], lengths), lengths[bins[k]].sum()
                    if 0 < fills[k] < most:
                        table = np.concatenate((table, options(k)), axis=1)
                moved = True
    return full + [b for b in bins if b]


def _round(most: int, first: bool):
    def packed(group: pa.Table) -> pa.Table:
        lengths = group["length"].to_numpy()
        rid = group["rid"].to_numpy()
        if first:
            bins = best_fit(lengths, most)
        else:
            _, at = np.unique(group["bin"].to_numpy(), return_inverse=True)
            order = np.argsort(at, kind="stable")
            bins = [x.tolist() for x in np.split(order, np.cumsum(np.bincount(at))[:-1])]
        bins = local_search(bins, lengths, most)
        of, fill, offset = np.zeros(len(rid), np.int64), np.zeros(len(rid), np.int64), np.zeros(len(rid), np.int64)
        for b in bins:
            b = np.array(b)[np.argsort(rid[b])]
            ends = np.cumsum(lengths[b])
            of[b], fill[b], offset[b] = rid[b[0]], ends[-1], ends - lengths[b]
        out = group.select(["doc_id", "piece", "start", "length", "ids_crc32", "rid"])
        for name, values in (("bin", of), ("fill", fill), ("offset", offset)):
            out = out.append_column(name, pa.array(values))
        return out

    return packed


def pack(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, end_id: int = 2, most: int = 1024, group: int = 4096) -> DataFrame:
    """Per piece of ``docs(doc_id, text)``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A sequence's id is the number of its first piece.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = cut(source.mapInArrow(_pieces((vocabulary, ranks, pattern), end_id, most), PIECE).withColumn("rid", F.monotonically_increasing_id()))
    placed = [pieces.where(F.col("length") == most).withColumns({"bin": F.col("rid"), "offset": F.lit(0).cast("long")})]
    left = pieces.where(F.col("length") < most)
    schema = f"{PIECE}, rid long, bin long, fill long, offset long"
    for k in count():
        unit = "rid" if k == 0 else "bin"
        n, bins = left.agg(F.count("*"), F.count_distinct(unit)).first()
        if n == 0:
            break
        dealt = F.pmod(F.xxhash64(unit, F.lit(k)), F.lit(-(-n // group)))
        last = cut(left.withColumn("deal", dealt).repartition(min(-(-n // group), MOST_TASKS), "deal").groupBy("deal").applyInArrow(_round(most, k == 0), schema))
        if n <= group or k > 0 and last.select("bin").distinct().count() == bins:
            placed.append(last.drop("fill"))
            break
        placed.append(last.where(F.col("fill") == most).drop("fill"))
        left = last.where(F.col("fill") < most)
    out = placed[0]
    for part in placed[1:]:
        out = out.unionByName(part)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"), "offset")

"""N-gram Jaccard join by a partition of the universe and the pigeonhole principle.

A document is the set of its word shingles, as 64-bit hashes; documents of equal sets are one class. Sizes are
cut into bands so that the two sizes of any pair over the threshold lie in one band or in neighbouring
ones; a class takes part in two groups, that of its band and the next as the lower side, that of its band and
the one before as the upper side. In a group two linked sets differ in at most H elements (from the sizes
and the threshold), and a hash deals the universe of shingles into ``H + 1 + SPARE`` segments. A set's subset
in a segment, as a sum of hashes, is a key.

Each set then allots to every segment how much may differ there: nothing (its subset is looked up), one
element (the subset and all subsets with one element less are looked up, and those of the others with
one less are indexed), or the segment is left out. Left out counts 0, an equal subset 1, one deletion 2; by
the pigeonhole principle a total of H + 1 finds every linked set. The allotment goes by cost: an empty subset
is shared by a fixed part of all documents, so it is left out as long as the total allows, first at the expense
of the spare segments and then of a deletion neighbourhood of the first segment, if its subset has two
elements or more, where lookups are as good as unique.

Pairs of a bucket aren't all made. Its members meet its first class, and those go whose sketches (parities of
elements) differ in more bits than linked sets can in elements; then, where the others aren't yet in one
component, classes that share too few keys or shingles with other components go, as they can't be linked to one.
Of the rest, linked sets share one of their rarest shingles: classes that do are paired, and where many share one,
compared in blocks. Every link is confirmed on the full sets of whole texts. Those of classes that can be asked for
one are dealt by their class once and stay there.

Defined results: words are runs of anything but white space, A-Z lower-cased; a text of fewer words than
a shingle is one shingle. Documents without words, null texts included, have no shingles and no links; so
have rows without a ``doc_id``. Rows that share a ``doc_id`` are one document with the links of all its texts.
An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowbalance.llm.common import blocks, cut, cut_by, keyed, lists, mixed, shuffles_freed, signed, stored, utf8
from flowbalance.llm.components import components
from flowbalance.llm.op4_minhash import BLOCK, _block_links, text_sets

#: Segments of a group beyond those that the pigeonhole principle needs.
SPARE = 3
#: A shingle that is among the rarest of more sets than this pairs them in blocks.
CROWD = 32
#: Stamps of sets that a task remembers, so that it sends the keys of a repeated set once.
SEEN = 1 << 20
_STAMP, _DEAL, _VALUE, _SKETCH = keyed(4, 1301)


def bands(most: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(first size of each band; for band k and the next: how many elements linked sets can differ in), up to a
    set of ``most`` elements."""
    starts = [1]
    while starts[-1] <= most:
        starts.append(max(starts[-1] + 1, 100 * (starts[-1] - 1) // percent + 1))
    starts.append(max(starts[-1] + 1, 100 * (starts[-1] - 1) // percent + 1))
    differ = []
    for low, high in zip(starts, starts[1:], strict=False):
        top = high - 1 + 100 * (high - 1) // percent  # the largest sum of two linked sizes
        both = np.arange(max(2 * low, top - 400), top + 1)
        differ.append(int((both + 2 * (-percent * both // (100 + percent))).max()))
    return np.array(starts), np.array(differ)


def stamps(hashes: np.ndarray, first: np.ndarray, salt: int) -> np.ndarray:
    """A hash of each set; that of an empty one is 0."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mixed(hashes ^ _STAMP ^ np.uint64(salt)), out=total[1:])
    n = np.diff(first)
    return np.where(n > 0, mixed((total[first[1:]] - total[first[:-1]]) ^ n.astype(np.uint64)), np.uint64(0))


def set_keys(hashes: np.ndarray, first: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, number of the set, whether the set looks it up or is only found by it, how many keys the set shares at
    least with any linked one) of all segments. Linked sets agree in ``SPARE`` + 1 segments or more, which are keys of
    both unless they are empty."""
    n = np.diff(first)
    starts, differ = bands(int(n.max(initial=1)), percent)
    band = np.searchsorted(starts, n, side="right") - 1
    of = np.repeat(np.arange(len(n)), n)
    value = mixed(hashes ^ _VALUE)
    dealt = mixed(hashes ^ _DEAL)
    out: list[tuple[np.ndarray, ...]] = []
    for side in (0, 1):  # lower, upper
        group = band - side
        far = np.where((n > 0) & (group >= 0), differ[np.maximum(group, 0)], 0)
        segments = np.where(far > 0, far + 1 + SPARE, 0)
        base = np.concatenate(([0], np.cumsum(segments)))
        taken = np.flatnonzero(segments[of] > 0)
        if not len(taken):
            continue
        mine, worth = of[taken], value[taken]
        segment = (dealt[taken] % segments[mine].astype(np.uint64)).astype(np.int64)
        slot = base[mine] + segment
        # sums modulo 2**64 from two halves whose sums a float holds exactly
        total = (np.bincount(slot, worth >> np.uint64(32), base[-1]).astype(np.uint64) << np.uint64(32)) + np.bincount(slot, worth & np.uint64(0xFFFFFFFF), base[-1]).astype(np.uint64)
        size = np.bincount(slot, minlength=base[-1])
        owner = np.repeat(np.arange(len(n)), segments)
        number = np.arange(base[-1]) - base[owner]
        name = mixed((group[owner].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64))
        empty = size == 0
        rank = np.cumsum(empty)
        rank -= (rank - empty)[base[owner]]  # 1 for the first empty segment of a set
        full = np.flatnonzero(segments)
        deletes = np.zeros(len(n), bool)  # could delete in its first segment
        deletes[full] = size[base[full]] > 1
        spared = SPARE + deletes[owner]
        looked = ~(empty & (rank <= spared))
        empties = np.zeros(len(n), np.int64)
        np.add.at(empties, owner, empty)
        promoted = deletes & (empties > SPARE)
        least = np.clip(SPARE + 1 - empties, 1, None)
        out.append((mixed(total ^ name), owner, looked, least[owner]))
        head = np.flatnonzero(segment == 0)
        out.append((mixed((total[slot[head]] - worth[head]) ^ name[slot[head]]), mine[head], promoted[mine[head]], least[mine[head]]))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _thin(width: int, salt: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch["body"], 1 << 20):
                hashes, first = text_sets(data, offsets, width)
                made = [signed(stamps(hashes, first, x)) for x in (salt, salt + 1)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(lo, hi - lo), pa.array(np.diff(first)), pa.array(made[0]), pa.array(made[1]), pa.array(sketches(hashes, first), pa.binary())], names=["doc_id", "n", "s", "check", "sketch"])

    return rows


def _keys(width: int, percent: int, salt: int):
    """Keys of each different set of a task; ``s`` names the set."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in blocks(batch["body"], 1 << 20):
                hashes, first = text_sets(data, offsets, width)
                stamp = stamps(hashes, first, salt)
                _, once = np.unique(stamp, return_index=True)
                new = np.array([i for i in once.tolist() if int(stamp[i]) not in seen], np.int64)
                if len(seen) < SEEN:
                    seen.update(stamp[new].tolist())
                if not len(new):
                    continue
                n = np.diff(first)[new]
                at = np.concatenate([np.arange(first[i], first[i + 1]) for i in new.tolist()])
                key, of, looked, least = set_keys(hashes[at], np.concatenate(([0], np.cumsum(n))), percent)
                yield pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(signed(stamp[new][of])), pa.array(looked), pa.array(least.astype(np.int8))], names=["key", "s", "looked", "least"])

    return rows


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in the order of key, looked up first, s: the members of buckets that hold several sets and a set
    that looks there, with the bucket's first set. Of a bucket that goes on in the next batch only its first
    row is held."""
    held, sent = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch["key"].to_numpy(), batch["s"].to_numpy(), batch["looked"].to_numpy(zero_copy_only=False), batch["least"].to_numpy()]
        if held is not None:
            rows = [np.concatenate(([h], r)) for h, r in zip(held, rows, strict=True)]
        key, s, looked, least = rows
        heads = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        bucket = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(key))))
        lead = s[heads][bucket]
        fine = (looked[heads] & np.logical_or.reduceat(s != lead, heads))[bucket]
        out = fine & np.concatenate(([True], (key[1:] != key[:-1]) | (s[1:] != s[:-1])))
        out[0] &= not (held is not None and sent)
        sent = bool(fine[-1]) or (held is not None and sent and len(heads) == 1)
        held = tuple(r[heads[-1]] for r in rows)
        yield pa.RecordBatch.from_arrays([pa.array(key[out]), pa.array(s[out]), pa.array(lead[out]), pa.array(least[out])], names=["key", "id", "u", "least"])


def _sets(width: int, salt: int):
    """Each different set of a task."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in blocks(batch["body"], 1 << 20):
                hashes, first = text_sets(data, offsets, width)
                stamp = stamps(hashes, first, salt)
                _, once = np.unique(stamp, return_index=True)
                new = np.array([i for i in once.tolist() if first[i] < first[i + 1] and int(stamp[i]) not in seen], np.int64)
                if len(seen) < SEEN:
                    seen.update(stamp[new].tolist())
                if len(new):
                    at = np.concatenate([np.arange(first[i], first[i + 1]) for i in new.tolist()])
                    yield pa.RecordBatch.from_arrays([pa.array(signed(stamp[new])), lists(pa.array(signed(hashes[at])), np.append(0, np.cumsum(np.diff(first)[new])))], names=["id", "set"])

    return rows


def sketches(hashes: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Of each set the parities of its elements, dealt to the power of 2 next to its size (64 at least): two sets
    differ in as many elements at least as their sketches in bits."""
    n = np.diff(first)
    bits = np.int64(1) << np.ceil(np.log2(np.maximum(n, 64))).astype(np.int64)
    base = np.concatenate(([0], np.cumsum(bits)))
    slot = np.repeat(base[:-1], n) + (mixed(hashes ^ _SKETCH) & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(slot, minlength=base[-1]) & 1).astype(bool)).tobytes()
    return [packed[a // 8:b // 8] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def sketched_apart(one: bytes, other: bytes) -> int:
    """In how many bits two sketches differ, the longer one folded to the other's size."""
    a, b = sorted((np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)), key=len)
    return int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())


def _near(percent: int):
    """The pairs that sizes and sketches leave possible."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = batch["un"].to_numpy() + batch["vn"].to_numpy()
            most = both + 2 * (-percent * both // (100 + percent))  # elements that linked sets of these sizes can differ in
            mask = pa.array([sketched_apart(a.as_py(), b.as_py()) <= m for a, b, m in zip(batch["u_sketch"], batch["v_sketch"], most.tolist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch[c].filter(mask) for c in ("u", "v", "shared")], names=["u", "v", "shared"])

    return rows


def _confirmed(percent: int):
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


def _classes(body: DataFrame, width: int) -> tuple[DataFrame, DataFrame, int]:
    """(thin rows doc_id, n, s; classes s, doc, n, sketch; the salt of the stamps). Should two different sets have one
    stamp, all are stamped anew."""
    salt = 0
    while True:
        thin = cut(body.mapInArrow(_thin(width, salt), "doc_id long, n long, s long, check long, sketch binary"))
        full = thin.where("n > 0 and doc_id is not null").groupBy("s")
        classes = cut(full.agg(F.min("doc_id").alias("doc"), F.min("n").alias("n"), F.max("n").alias("n2"), F.min("check").alias("c"), F.max("check").alias("c2"), F.first("sketch").alias("sketch")))
        if classes.where("n <> n2 or c <> c2").isEmpty():
            return thin, classes.select("s", "doc", "n", "sketch"), salt
        salt += 2


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) that the full sets confirm. Pairs are few bytes and go to the sets, which stay where they are; only
    a set (v) that a pair needs moves on, to the first sets of buckets (u), which are few. Those are written out, as Spark
    then splits the partition of a hot one."""
    pairs = stored(pairs)
    firsts = stored(sets.select(F.col("id").alias("u"), F.col("set").alias("u_set")).join(pairs.select("u").distinct(), "u", "left_semi"))
    others = sets.select(F.col("id").alias("v"), F.col("set").alias("v_set"))
    return cut(pairs.join(others, "v").join(firsts, "u").select("u", "v", "u_set", "v_set").mapInArrow(_confirmed(percent), "u long, v long"))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label) of components when ``links(u, v)`` join them as well. The links are taken as ones between components,
    which are few."""
    ends = [labels.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")) for c in "uv"]
    between = cut(links.join(ends[0], "u", "left").join(ends[1], "v", "left")
                  .select(F.coalesce("u_label", "u").alias("u"), F.coalesce("v_label", "v").alias("v")).where("u <> v").distinct())
    if between.isEmpty():
        return labels
    joined = components(between)
    moved = joined.select(F.col("id").alias("label"), F.col("label").alias("least"))
    return cut(labels.join(moved, "label", "left").select("id", F.coalesce("least", "label").alias("label")).unionByName(joined))


def _possible(stars: DataFrame, sketched: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v, shared) that sizes and sketches leave possible."""
    ends = [sketched.select(F.col("id").alias(c), F.col("n").alias(f"{c}n"), F.col("sketch").alias(f"{c}_sketch")) for c in "uv"]
    alike = stars.join(ends[0], "u").join(ends[1], "v").where(f"100 * least(un, vn) >= {percent} * greatest(un, vn)")
    return alike.mapInArrow(_near(percent), "u long, v long, shared long")


def _enough(shown: DataFrame, *by: str) -> DataFrame:
    """The classes that share as many keys of ``shown`` as they do with any linked one."""
    return shown.groupBy("id", *by).agg(F.countDistinct("key").alias("keys"), F.min("least").alias("least")).where("keys >= least").select("id", *by)


def _rarest(held: DataFrame, percent: int) -> DataFrame:
    """(h, no, part) of the shingles ``held(no, part, n, h)`` of which two linked sets of different parts have one in common.

    Such sets share ``percent`` of either's shingles, all of them held by several parts. In an order of all shingles, here by
    the sets that hold them, the first that they share has as many after it in both.
    """
    group, own = Window.partitionBy("h"), Window.partitionBy("no")
    spread = held.withColumns({"lo": F.min("part").over(group), "hi": F.max("part").over(group), "sets": F.count("*").over(group)}).where("lo <> hi")
    ranked = spread.withColumns({"shared": F.count("*").over(own), "rank": F.row_number().over(own.orderBy("sets", "h"))})
    return ranked.where(f"100 * (shared - rank + 1) >= {percent} * n").select("h", "no", "part")


def _apart(others: DataFrame, sets: DataFrame, sketched: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(u, v) of all links between sets of different components that share a key.

    A bucket's first set has met all others, so only the others of a bucket can hide a link, and those that have too few
    keys in common with other components can't. Of what is left, a set needs ``percent`` of its shingles in other
    components; few sets have that. Those that share one of their rarest shingles are paired; if more than ``CROWD`` sets do,
    they are compared in blocks of their clusters.
    """
    placed = others.join(labels, "id", "left").select("key", "id", "least", F.coalesce("label", "id").alias("label"))
    mixed_keys = placed.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    owners = cut(_enough(placed.join(mixed_keys, "key"), "label").withColumn("no", F.monotonically_increasing_id()))
    # numbers, not stamps, go with the shingles: they compress. A component's is its least owner's
    numbered = cut(owners.join(owners.groupBy("label").agg(F.min("no").alias("part")), "label").select("id", "label", "no", "part"))
    # 40 bits do: two shingles taken for one can only let a set through
    held = numbered.join(sets, "id").select("no", "part", F.explode("set").alias("h")).withColumn("h", F.col("h").bitwiseAND((1 << 40) - 1))
    group = Window.partitionBy("h")
    spread = held.withColumns({"lo": F.min("part").over(group), "hi": F.max("part").over(group)}).where("lo <> hi")
    shared = spread.groupBy("no").agg(F.count("*").alias("shared"))
    left = cut(shared.join(numbered, "no").join(sketched.select("id", "n"), "id").where(F.col("shared") * 100 >= F.col("n") * percent).select("no", "part", "id", "label", "n"))

    rare = cut(_rarest(left.join(sets, "id").select("no", "part", "n", F.explode("set").alias("h")), percent))
    sizes = rare.groupBy("h").agg(F.count("*").alias("size"), F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("h", "size")
    met = cut(rare.join(sizes, "h"))
    few = met.where(F.col("size") <= CROWD)
    ends = [few.select("h", F.col("no").alias(f"{c}_no"), F.col("part").alias(f"{c}_part")) for c in "uv"]
    pairs = ends[0].join(ends[1], "h").where("u_no < v_no and u_part <> v_part").select("u_no", "v_no").distinct()
    ends = [left.select(F.col("no").alias(f"{c}_no"), F.col("id").alias(c)) for c in "uv"]
    paired = _possible(pairs.join(ends[0], "u_no").join(ends[1], "v_no").select("u", "v", F.lit(1).cast("long").alias("shared")), sketched, percent)
    found = _linked(paired.select("u", "v"), sets, percent)

    crowded = met.where(F.col("size") > CROWD)
    heads = crowded.groupBy("h").agg(F.min("no").alias("v"))
    clusters = components(crowded.join(heads, "h").select(F.col("no").alias("u"), "v").distinct()).select(F.col("id").alias("no"), F.col("label").alias("cluster"))
    members = left.join(crowded.select("no").distinct(), "no").join(clusters, "no", "left").withColumn("cluster", F.coalesce("cluster", "no"))
    size = members.groupBy("cluster").agg(F.count("*").alias("size")).where("size > 1")
    dealt = (members.join(size, "cluster").withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int"))
             .withColumn("side", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select("cluster", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "id", "label", "side"))
    return found.unionByName(dealt.join(sets, "id").groupBy("cluster", "i", "j").applyInArrow(_block_links(percent), "u long, v long"))


def _named(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(thin rows doc_id, n, s; classes s, component), both written out."""
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("body"))
    thin, classes, salt = _classes(body, width)
    keys = body.where("doc_id is not null").mapInArrow(_keys(width, percent, salt), "key long, s long, looked boolean, least byte")
    met = stored(keys.repartition("key").sortWithinPartitions("key", F.desc("looked"), "s").mapInArrow(_buckets, "key long, id long, u long, least byte"))

    sketched = classes.select(F.col("s").alias("id"), "n", "sketch")
    met_by = met.where("u <> id").groupBy("u", F.col("id").alias("v")).agg(F.count("*").alias("shared"))
    stars = cut(_possible(met_by, sketched, percent))
    beside = met.where("u <> id").select("key", "id", "least")
    several = beside.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key")
    others = cut(beside.join(several, "key"))

    # the sets that are asked for a link, here or in _apart
    asked = cut(stars.select(F.explode(F.array("u", "v")).alias("id")).unionByName(_enough(others)).distinct())
    sets = cut_by(body.where("doc_id is not null").mapInArrow(_sets(width, salt), "id long, set array<long>"), "id", asked)

    # each set first against the one with which it shares most keys; of the rest, what that left apart
    likely = stars.groupBy("v").agg(F.max_by("u", F.struct("shared", -F.col("u"))).alias("u")).select("u", "v")
    joined = components(_linked(likely, sets, percent))
    ends = [joined.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")) for c in "uv"]
    apart = (stars.join(ends[0], "u", "left").join(ends[1], "v", "left")
             .where("coalesce(u_label, u) <> coalesce(v_label, v)").select("u", "v").exceptAll(likely))
    links = _linked(apart, sets, percent)
    # texts of one document in several classes
    own = thin.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("s").alias("u"), F.max("s").alias("most")).where("u <> most")
    again = cut(thin.where("n > 0").join(own.select("doc_id", "u"), "doc_id").select("u", F.col("s").alias("v")).where("u <> v").distinct())
    first = _merged(joined, links if again.isEmpty() else links.unionByName(again))
    labels = _merged(first, _apart(others, sets, sketched, first, percent))

    placed = cut(classes.select("s", "doc").join(labels.withColumnRenamed("id", "s"), "s", "left").withColumn("label", F.coalesce("label", "s")))
    least = placed.groupBy("label").agg(F.min("doc").alias("component"))
    named = cut(placed.join(least, "label").select("s", "component"))
    return thin, named


def similar_groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id."""
    with shuffles_freed(docs.sparkSession):
        thin, named = _named(docs, width, percent)
    return (thin.join(named, "s", "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")))

"""Merkle dataset manifest by a butterfly exchange.

Rows are leaves of a tree per source, in the order of ``doc_id``; the roots of these trees are the leaves
of a tree over the sources. ``FANOUT`` consecutive nodes have a parent.

The leaves of a source are cut into aligned blocks of ``FANOUT ** LEVELS``, the partitions of the
exchange. Each block hashes its own subtree. Then blocks exchange roots round by round: in round r, the
blocks at the same place (lane) of ``FANOUT`` neighbouring subtrees of ``FANOUT ** r`` blocks swap the roots of
those subtrees, and each hashes the parent for itself. After the last round every block has the root
and the siblings on its way to it: ancestors are hashed by all their blocks, and nothing is sent down.
The last subtree of a source may have fewer lanes than its neighbours; its last block serves those that
lack a partner. A round moves one thin row per block. The sources then exchange in the same way.

Leaves are numbered without a window over a source: they are sorted over all tasks, and a source's counts
per task, a thin table, give the number of its first leaf in each.

Defined results: null columns count as ``-``; a null ``source`` is a source and comes first; a null ``doc_id``
comes first in its source and isn't tampered with; rows of one id are ordered by their leaf, and equal
rows are leaves of their own. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowbalance.llm.common import TASK_BITS, cut, in_order, stored

FANOUT, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_BLOCK = "source string, block long, total long, ids array<long>, leaves binary, altered binary, marks binary, node string"
_PROVEN = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_of(columns: Sequence[Column]) -> Column:
    """Hash of values, each with its length in bytes before it, so that no two rows read alike."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def climb(nodes: list[str], levels: int | None) -> Iterator[list[str]]:
    """Each level's nodes, lowest first: so many ``levels``, or else until one node is left."""
    yield nodes
    while len(nodes) > 1 if levels is None else levels > 0:
        nodes = [_digest("".join(nodes[i:i + FANOUT])) for i in range(0, len(nodes), FANOUT)]
        levels = None if levels is None else levels - 1
        yield nodes


def _own_levels(total: int, levels: int) -> int | None:
    """A source of one block ends at its root, the blocks of a larger one all have the same height."""
    return levels if total > FANOUT ** levels else None


def _packed(levels: int):
    """A block's leaves as one row, with the root of its subtree."""
    def block(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        leaves, altered = rows["leaf"].to_pylist(), rows["altered"].to_pylist()
        total = rows["total"][0].as_py()
        *_, (root, *_) = climb(leaves, _own_levels(total, levels))
        raw = [b"".join(bytes.fromhex(x) if x else b"" for x in column) for column in (leaves, altered)]
        marks = bytes(x is not None for x in altered)
        values = [rows["source"][:1], rows["block"][:1], [total], [rows["doc_id"].to_pylist()], [raw[0]], [raw[1]], [marks], [root]]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.string())
        return pa.table(values, schema=pa.schema(list(zip(("source", "block", "total", "ids", "leaves", "altered", "marks", "node"), kinds, strict=True))))

    return block


def numbered(rows: DataFrame, tree: str) -> DataFrame:
    """Adds ``place``, a row's number in its tree, and ``total``, the tree's rows, to rows from ``in_order``."""
    task = F.shiftright("at", TASK_BITS)
    counts = rows.groupBy(F.col(tree).alias("_tree"), task.alias("_task")).agg(F.count("*").alias("_n"), F.min("at").alias("_first"))
    whole = Window.partitionBy("_tree")
    before = F.sum("_n").over(whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    spans = cut(counts.select("*", F.coalesce(before, F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("total")))
    met = rows.join(spans, F.col(tree).eqNullSafe(F.col("_tree")) & (task == F.col("_task")))
    return met.select(*rows.columns, (F.col("_before") + F.col("at") - F.col("_first")).alias("place"), "total")


def butterfly(nodes: DataFrame, tree: str, rounds: int) -> DataFrame:
    """All rounds over ``nodes(tree, place, total, node)``: ``node`` becomes the root of the tree, ``lefts`` and
    ``rights`` the siblings on the way, joined per round. Trees that are done wait unchanged."""
    nodes = nodes.select("*", F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"))
    names = nodes.columns
    for r in range(rounds):
        width = FANOUT ** r
        at, lane = F.expr(f"place DIV {width}"), F.expr(f"place % {width}")
        going = F.col("total") > width
        serves = going & (F.col("place") == F.col("total") - 1) & (at % FANOUT > 0)
        lanes = F.when(serves, F.sequence(lane, F.lit(width - 1).cast("long"))).otherwise(F.array(lane))
        sent = nodes.select("*", (at % FANOUT).alias("_k"), lane.alias("_own"), F.explode(lanes).alias("_lane"))
        group = Window.partitionBy(tree, F.expr(f"place DIV {width * FANOUT}"), "_lane")
        got = sent.withColumn("_got", F.sort_array(F.collect_list(F.struct("_k", "node")).over(group))).where("_own = _lane")
        left, right = (F.expr(f"array_join(transform(filter(_got, x -> x._k {side} _k), x -> x.node), '')") for side in "<>")
        grown = got.select("*", left.alias("_left"), right.alias("_right")).withColumns({
            "node": F.when(going, F.sha2(F.concat("_left", "node", "_right"), 256)).otherwise(F.col("node")),
            **{side: F.when(going, F.array_append(side, F.col(f"_{side[:-1]}"))).otherwise(F.col(side)) for side in ("lefts", "rights")}})
        nodes = grown.select(*names)
        if r % 4 == 3:
            nodes = cut(nodes)
    return nodes


def _rounds(nodes: DataFrame) -> int:
    most, r = nodes.agg(F.max("total")).first()[0] or 1, 0
    while FANOUT ** r < most:
        r += 1
    return r


def _proven(levels: int):
    """A row per leaf: its block's levels, then what the exchange gave the block."""
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    schema = pa.schema([(c, pa.int64() if c == "doc_id" else pa.bool_() if c == "verified" else pa.string()) for c in names])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                leaves = [row["leaves"][k:k + 32].hex() for k in range(0, len(row["leaves"]), 32)]
                inner = list(climb(leaves, _own_levels(row["total"], levels)))[:-1]
                upper = list(zip(row["lefts"], row["rights"], strict=True))
                above, used, out = "".join(left + right for left, right in upper), 0, []
                for i, (doc_id, leaf, marked) in enumerate(zip(row["ids"], leaves, row["marks"], strict=True)):
                    node, path = leaf, []
                    if marked:
                        node, used = row["altered"][used:used + 32].hex(), used + 32
                    for nodes in inner:
                        first = i - i % FANOUT
                        path.append(("".join(nodes[first:i]), "".join(nodes[i + 1:first + FANOUT])))
                        i //= FANOUT
                    proof = _digest("".join(left + right for left, right in path) + above)
                    for left, right in path + upper:
                        node = _digest(left + node + right)
                    out.append((doc_id, leaf, row["subroot"], row["root"], proof, node, node == row["root"]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return rows


def manifest(docs: DataFrame, is_altered: Column | None = None, altered_text: Column | None = None, levels: int = LEVELS) -> DataFrame:
    """Per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Where ``is_altered`` holds, the root is folded from the row with ``altered_text`` in place of its text,
    and the siblings of the original. ``levels`` is the height of a block.
    """
    columns = [F.col(c) for c in FIELDS]
    other = F.lit(None).cast("string") if is_altered is None else F.when(is_altered, leaf_of([*columns[:-1], altered_text]))
    leaves = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), leaf_of(columns).alias("leaf"), other.alias("altered"), F.monotonically_increasing_id().alias("row"))
    rows = in_order(leaves, F.asc_nulls_first("source"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("row"))
    placed = numbered(rows, "source").withColumn("block", F.expr(f"place DIV {FANOUT ** levels}"))
    blocks = stored(placed.groupBy("source", "block").applyInArrow(_packed(levels), _BLOCK))

    thin = blocks.select("source", F.col("block").alias("place"), F.expr(f"(total + {FANOUT ** levels - 1}) DIV {FANOUT ** levels}").alias("total"), "node")
    lower = cut(butterfly(thin, "source", _rounds(thin)))
    roots = in_order(lower.where("place = 0").select("source", F.col("node")), F.asc_nulls_first("source"))
    top = numbered(roots.withColumn("_all", F.lit(0)), "_all")
    upper = cut(butterfly(top, "_all", _rounds(top)).select(F.col("source").alias("_source"), F.col("node").alias("root"), F.col("lefts").alias("_lefts"), F.col("rights").alias("_rights")))
    paths = lower.join(upper, F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("source").alias("_source"), F.col("place").alias("_block"), F.col("node").alias("subroot"), "root", F.concat("lefts", "_lefts").alias("lefts"), F.concat("rights", "_rights").alias("rights"))
    met = blocks.join(paths, F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")))
    return met.select("total", "ids", "leaves", "altered", "marks", "subroot", "root", "lefts", "rights").mapInArrow(_proven(levels), _PROVEN)

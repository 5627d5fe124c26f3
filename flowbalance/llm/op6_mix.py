"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Sources in code point order (null last) get the weights in turn and share ``share`` times all words. A
target stops at ``most`` times its source's size; the rest is shared again by weight until no target is
above. With sources sorted by size over weight this has a closed form, two running sums over one row
per source. A document's share of copies, target / source size, has a whole part and a fraction, and
the fractions are rounded together: documents are dealt into buckets of about 64, and in a bucket two
documents at a time exchange expected words at random, keeping their sum, until one of them is taken or
not. What is left of each bucket, one document, goes to the next level of the tree, down to one
document per source, which is rounded to the nearer side. So a source's words miss the target by at
most half of its last document.

Defined results: words are runs of anything but space and \\t \\n \\v \\f \\r; a null text has none. A null
source is a source, the last one. A document without words is taken as 0 words. Rows that repeat
``doc_id``, source and size, null ids included, are documents of their own, but go through the tree as
one: of m of them at share p, floor(m p) have one copy more, one is rounded with the chance that is left,
and the others have none. So a repeated row never crowds a bucket and is never rounded as a whole. No
words at all give zero targets; an empty table no rows. Further columns are ignored. The same rows give
the same mix in any partitioning: chances are hashes of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowbalance.llm.common import WORD_RE, cut

BUCKET = 64
#: Rows of one repeated document that one step writes out.
REPEATS = 10_000
OF_SOURCE = ["source", "source_size", "target", "whole", "n_parts"]

#: A step of the fold: s.now and x exchange words. u is the chance drawn, a and b the words of both.
_STEP = """
transform(array(named_struct(
    'u', (xxhash64({seed}, {level}, s.now.doc_id, s.now.size, x.doc_id, x.size) & 9007199254740991) / 9007199254740992D,
    'a', cast(s.now.size AS double), 'b', cast(x.size AS double), 'p', s.now.p, 'q', x.p)),
  t -> transform(array(named_struct(
    'up', t.u * (least(1 - t.p, t.q * t.b / t.a) + least(t.p, (1 - t.q) * t.b / t.a)) < least(t.p, (1 - t.q) * t.b / t.a))),
  d -> CASE
    WHEN d.up AND (1 - t.p) * t.a <= t.q * t.b
      THEN named_struct('now', {x_left_up}, 'done', {now_in})
    WHEN d.up
      THEN named_struct('now', {now_left_up}, 'done', {x_out})
    WHEN t.p * t.a <= (1 - t.q) * t.b
      THEN named_struct('now', {x_left_down}, 'done', {now_out})
    ELSE named_struct('now', {now_left_down}, 'done', {x_in}) END)[0])[0]
"""


def _unit(of: str, p: str) -> str:
    return f"named_struct('doc_id', {of}.doc_id, 'size', {of}.size, 'p', {p})"


def _fold(seed: int, level: int) -> Column:
    """The bucket's array of units -> (left: the last fractional unit, done: units with p 0 or 1)."""
    def within(p: str) -> str:
        return f"least(1D, greatest(0D, {p}))"
    step = _STEP.format(
        seed=seed, level=level,
        x_left_up=_unit("x", within("t.q - (1 - t.p) * t.a / t.b")), now_in=_unit("s.now", "1D"),
        now_left_up=_unit("s.now", within("t.p + t.q * t.b / t.a")), x_out=_unit("x", "0D"),
        x_left_down=_unit("x", within("t.q + t.p * t.a / t.b")), now_out=_unit("s.now", "0D"),
        now_left_down=_unit("s.now", within("t.p - (1 - t.q) * t.b / t.a")), x_in=_unit("x", "1D"))
    kind = "array<struct<doc_id: bigint, size: bigint, p: double>>"
    return F.expr(f"""aggregate(slice(units, 2, size(units)),
        named_struct('now', units[0], 'done', cast(array() AS {kind})),
        (s, x) -> transform(array({step}), r -> named_struct('now', r.now, 'done', concat(s.done, array(r.done))))[0])""")


def targets(sizes: DataFrame, weights: list[int], share: tuple[int, int], most: int) -> DataFrame:
    """``sizes(source, source_size)``, a row per source, with ``target``. Whole numbers until the last
    division; ``share`` is a fraction of at most ``most``."""
    n, d = share
    if n > d * most:
        raise ValueError(f"{n}/{d} of all words can't be had with at most {most} copies")
    whole = "decimal(38,0)"
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, len(weights)) + 1).cast("int"))
    ranked = sizes.withColumn("w", w.cast(whole)).withColumn("s", F.col("source_size").cast(whole))
    order = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    free = ranked.withColumns({
        "rest": (F.sum("s").over(everything) * n - F.coalesce(F.sum("s").over(before), F.lit(0)) * (most * d)).cast(whole),  # d times what is left to share
        "w_on": F.sum("w").over(on).cast(whole)})
    free = free.withColumn("is_free", F.col("s") * (most * d) * F.col("w_on") >= F.col("w") * F.col("rest"))
    first = F.min(F.when(F.col("is_free"), F.struct(F.col("source_size") / F.col("w"), F.col("source").isNull(), "source", "rest", "w_on"))).over(everything)
    return (free.withColumn("first", first)
            .select("source", "source_size", F.when(F.col("is_free"), (F.col("w") * F.col("first.rest")).cast("double") / (F.col("first.w_on") * d).cast("double"))
                    .otherwise((F.col("source_size") * most).cast("double")).alias("target")))


def mix(docs: DataFrame, weights: list[int], share: tuple[int, int] = (3, 2), most: int = 2, seed: int = 6) -> DataFrame:
    """Per row of ``docs(doc_id, source, text)``: doc_id, size, source_size, target, taken, and copies."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD_RE)), F.lit(0)).cast("long").alias("size"))
    units = cut(sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("m")))
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count_if(F.col("size") > 0).alias("n_parts"))
    aims = targets(sizes, weights, share, most).withColumnRenamed("source", "of")
    aims = aims.join(sizes.select(F.col("source").alias("of_2"), "n_parts"), F.col("of").eqNullSafe(F.col("of_2"))).drop("of_2")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = (units.join(aims, F.col("source").eqNullSafe(F.col("of"))).drop("of")
            .withColumn("whole", F.floor(rate)).withColumn("p", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0)))
    fields = [*OF_SOURCE, "doc_id", "size", "m", "p"]
    rows = rows.select(fields)
    # of the m rows of a unit, up have one copy more, and one is left if a fraction is
    split = rows.where("p > 0").withColumn("up", F.floor(F.col("m") * F.col("p"))).withColumn("rest", F.col("m") * F.col("p") - F.col("up"))
    sides = split.select(*OF_SOURCE, "doc_id", "size", F.inline(F.expr(
        "array(named_struct('m', up, 'p', 1D), named_struct('m', m - up - if(rest > 0, 1L, 0L), 'p', 0D))"))).where("m > 0")
    settled = [rows.where("p = 0"), sides.select(fields)]
    left = split.where("rest > 0").select(*OF_SOURCE, "doc_id", "size", F.col("rest").alias("p"))
    most_parts = sizes.agg(F.max("n_parts")).first()[0] or 0

    level, wide = 0, BUCKET
    while most_parts > 0:
        into = F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "size"), F.ceil(F.col("n_parts") / F.lit(wide)))
        folded = cut(left.groupBy(*OF_SOURCE, into.alias("bucket"))
                     .agg(F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("first"), F.xxhash64("doc_id", F.lit(seed)).alias("then"), "doc_id", "size", "p"))).alias("found"))
                     .withColumn("units", F.expr("transform(found, f -> named_struct('doc_id', f.doc_id, 'size', f.size, 'p', f.p))"))
                     .select(*OF_SOURCE, _fold(seed, level).alias("s")))
        settled.append(folded.select(*OF_SOURCE, F.inline("s.done")).withColumn("m", F.lit(1).cast("long")))
        left = folded.select(*OF_SOURCE, "s.now.*")
        if wide >= most_parts:
            break
        level, wide = level + 1, wide * BUCKET
    done = left.withColumns({"p": F.round("p"), "m": F.lit(1).cast("long")})
    for part in settled:
        done = done.unionByName(part)
    steps = F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / REPEATS)))
    each = done.withColumn("step", steps).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(REPEATS).cast("long"), F.col("m") - F.col("step") * REPEATS))))
    copies = (F.col("whole") + F.col("p")).cast("long")
    return each.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), copies.alias("copies"))

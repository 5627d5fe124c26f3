"""From raw documents to packed sequences in five stages, each on all that the one before kept.

1. language ID: documents without text or without a letter go; those of no learned language stay; a
   missing ``lang`` is filled with the language found;
2. exact dedup: of equal texts one row stays;
3. MinHash near-dedup: of each group of near copies (five-word shingles, similarity 0.8) the row of the smallest id stays;
4. mixing: sources are brought to their target weights, a document is dropped, kept or repeated;
5. packing: what is left is cut and packed into sequences.

Decisions are made for each row, whatever its ``doc_id``: the first stage numbers its rows, its output is
written with the numbers (``ROW``), and dedup and mixing run on them. Ties between rows of one id, and
between those without an id, which come last, go to the smaller number. A stage that gets rows without numbers
numbers and writes them itself. An empty table goes through to an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowbalance.llm.common import cut, stored
from flowbalance.llm.op4_minhash import near_groups
from flowbalance.llm.op5_language import identify, learn
from flowbalance.llm.op6_mix import mix
from flowbalance.llm.op9_pack import pack
from flowbalance.llm.op10_exact import exact_groups

#: The language ID's SQL, the classes of near copies and the packing have no SQL form.
ORACLE_SQL = None

#: Number of a row in the written output of the first stage; mixing, which repeats rows, takes it away.
ROW = "corpus_pipeline_row"


def _with_numbers(docs: DataFrame) -> DataFrame:
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows with numbers that are in a written table, so that each read sees the same ones."""
    return docs if ROW in docs.columns else stored(_with_numbers(docs))


def _names(docs: DataFrame) -> list[str]:
    return [f"`{c}`" for c in docs.columns]


def _by_row(docs: DataFrame, *columns: str) -> DataFrame:
    """The columns, with the row's number for its id."""
    return docs.select(F.col(ROW).alias("doc_id"), *columns)


def _firsts(docs: DataFrame, groups: DataFrame, *before: Column) -> DataFrame:
    """Rows of docs but those that aren't the first of their group in ``groups(one, same)``, row numbers and
    what a group has in common; a group's rows are ordered by ``before``, id (null last) and number.

    The numbers that go are a written table, so its size is known and Catalyst moves the texts for the join
    only if it is too large to be broadcast.
    """
    order = docs.select(F.col(ROW).alias("row"), F.struct(*(c.alias(f"b{k}") for k, c in enumerate(before)), F.col("doc_id").isNull().alias("nameless"), F.col("doc_id").cast("long").alias("of"), F.col(ROW).alias("at")).alias("place"))
    placed = cut(groups.join(order, F.col("one") == F.col("row")).select("same", "place"))
    first = cut(placed.groupBy("same").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("same", F.col("first.at").alias("stays")))
    gone = stored(placed.join(first, "same").where("place.at <> stays").select(F.col("place.at").alias(ROW)))
    return docs.join(gone, ROW, "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = identify(docs, *learn(docs)).where(F.col("row.text").rlike(r"\p{L}"))
    named = F.coalesce("row.lang", F.nullif("lang_pred", F.lit("und")))
    return _with_numbers(found.select(F.col("row").withField("lang", named).alias("row")).select("row.*"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    groups = exact_groups(_by_row(rows, "text")).where("group_size > 1").select(F.col("doc_id").alias("one"), F.col("keep_id").alias("same"))
    return _firsts(rows, groups, -F.coalesce(F.length("text"), F.lit(0))).select(_names(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    groups = near_groups(_by_row(rows, "text")).select(F.col("doc_id").alias("one"), F.col("component_id").alias("same"))
    return _firsts(rows, groups).select(_names(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = _numbered(docs)
    copies = f"{ROW}_copies"
    while copies in rows.columns:
        copies += "_"
    times = mix(_by_row(rows, "source", "text"), weights=[3, 1, 2], share=(3, 2), most=2).where("copies > 0").select(F.col("doc_id").alias(ROW), F.col("copies").alias(copies))
    names = _names(docs.drop(ROW))
    return rows.join(times, ROW).select(*names, F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias(copies)).select(names)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path
    return pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("near dedup", near_dedup), ("mixing", mixing), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs

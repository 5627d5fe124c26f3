"""Windows that late events amend: every change of a window is a new version of its row.

The feed runs in update mode, so a micro-batch brings the new totals of the windows that it touched. A
batch is stored in a folder of its own, in which a row has the next version of its key after those of
earlier batches. Repeating a batch after a failure writes the same folder again from the same earlier
versions, so it adds nothing. Only the days that a batch touches are read again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

KEYS = ("tick", "site", "product")

VERSIONS = T.StructType([
    T.StructField("tick", T.LongType()), T.StructField("site", T.LongType()),
    T.StructField("product", T.StringType()), T.StructField("volume", T.DoubleType()),
    T.StructField("price", T.DoubleType()), T.StructField("revenue", T.DoubleType()),
    T.StructField("version", T.LongType()), T.StructField("batch_id", T.LongType()),
    T.StructField("part", T.LongType())])


def versions(spark: SparkSession, path: str) -> DataFrame:
    """All versions of all rows, with the batch that brought them."""
    return spark.read.schema(VERSIONS).parquet(path)


def create(spark: SparkSession, path: str) -> None:
    """The table without a version; done again, it changes nothing but this empty part."""
    empty = spark.createDataFrame([], VERSIONS).drop("batch_id")
    empty.drop("part").write.mode("overwrite").parquet(f"{path}/batch_id=-1/part=0")


def merge(batch: DataFrame, batch_id: int, path: str, span: int = 24) -> None:
    """Store the rows of ``batch`` as the next versions of their keys; ``span`` ticks are one part."""
    spark = batch.sparkSession
    kept = batch.withColumn("part", F.expr(f"tick DIV {span}")).persist()
    try:
        touched = kept.agg(F.min("part"), F.max("part")).first()
        if touched[0] is None:
            rows = kept.withColumn("version", F.lit(1).cast("long"))
        else:
            earlier = versions(spark, path).where(
                (F.col("batch_id") < batch_id) & F.col("part").between(*touched))
            last = earlier.groupBy(*KEYS).agg(F.max("version").alias("before"))
            rows = kept.join(last, list(KEYS), "left").withColumn(
                "version", F.coalesce("before", F.lit(0).cast("long")) + 1).drop("before")
        rows.write.mode("overwrite").partitionBy("part").parquet(f"{path}/batch_id={batch_id}")
    finally:
        kept.unpersist()


def write_amended(feed: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Merge what a feed brings into the table at ``path``, until all that is available is read."""
    create(feed.sparkSession, path)
    return (feed.writeStream.outputMode("update")
            .foreachBatch(lambda batch, batch_id: merge(batch, batch_id, path))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest(spark: SparkSession, path: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """The last version of every row."""
    values = [c for c in VERSIONS.names if c not in (*keys, "batch_id", "part")]
    found = versions(spark, path).groupBy(*keys).agg(
        F.max_by(F.struct(*values), "version").alias("last"))
    return found.select(*keys, "last.*")

"""Stream sinks and the shared folder they use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder under the session's ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="flowbalance-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def with_checkpoints(spark: SparkSession) -> None:
    """Give the session a checkpoint folder under the rule of ``shared_folder``, if it has none yet."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark, "checkpoints"))


def write_quotes(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed windows to parquet, reading all that is available and then stopping."""
    return (stream.writeStream.format("parquet").outputMode("append")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start(path))

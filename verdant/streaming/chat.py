"""ST1: what-if questions as an append-only stream.

Questions arrive as files in a folder (here the driver's ``conversations``
parquet); each micro-batch routes them (X10) and scrubs personal data (X1)
with the same column functions as the batch path. The query is stateless, so
no watermark is needed; progress lives in the checkpoint under the shared
checkpoint folder, so a restarted job resumes where it stopped.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant.functions.text import intent, pii_scrub
from verdant.session import checkpoint_root


def route_questions(stream: DataFrame) -> DataFrame:
    """The per-row transformation shared by batch and stream."""
    return (stream.where(F.col("role") == "user")
            .select("conv_id", "turn", intent("text").alias("intent"),
                    pii_scrub("text", max_chars=None).alias("question_scrubbed")))


def question_stream(spark: SparkSession, folder: str, table: str = "conversations.parquet") -> DataFrame:
    """Stream of the table ``folder/table``, one file or a folder of part files."""
    path = os.path.join(folder, table)
    # As a glob that only this name matches, a single file can be a source too.
    return (spark.readStream.schema(spark.read.parquet(path).schema)
            .option("maxFilesPerTrigger", 64).parquet(f"{path[:-1]}[{path[-1]}]"))


def run_routing(spark: SparkSession, folder: str, out_dir: str | None = None,
                table: str = "conversations.parquet") -> str:
    """Process everything available now (``availableNow`` trigger) into a
    parquet sink; returns the sink folder."""
    base = out_dir or os.path.join(checkpoint_root(spark), "streams", f"route-{uuid.uuid4().hex}")
    sink, chk = os.path.join(base, "data"), os.path.join(base, "_checkpoint")
    q = (route_questions(question_stream(spark, folder, table))
         .writeStream.format("parquet").option("path", sink).option("checkpointLocation", chk)
         .outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    return sink

"""Books as a file stream [R01-R04]: one file is one book, processed whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener


def markdown_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """(book_id, markdown) of new Markdown files; a file is read whole, as every book rule needs the whole book."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return raw.select(F.col("path").alias("book_id"), F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", "").alias("markdown"))


class Progress(StreamingQueryListener):
    """Calls ``said(stage, done, total)`` as batches finish [R02]; total is unknown to a stream and given as done."""

    def __init__(self, said: Callable[[str, int, int], None]):
        self.said, self.done = said, 0

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self.said("started", 0, 0)

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self.done += event.progress.numInputRows
        self.said("books", self.done, self.done)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        return

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self.said("failed" if event.exception else "done", self.done, self.done)


def job_status(spark: SparkSession, out: str) -> DataFrame:
    """(batch, books): what a running or finished job has written so far, for polling [R04]."""
    return spark.read.parquet(out).groupBy("batch").agg(F.count_distinct("book_id").alias("books"))


def process_available(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Applies a whole-book plan to what has arrived since the checkpoint, and appends the result as Parquet."""

    def batch(df: DataFrame, number: int) -> None:
        plan(df).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

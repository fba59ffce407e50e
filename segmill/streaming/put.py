"""Streams into and out of segment stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.sources.store import BATCH_ROWS, SEGMENT_MAX_DOCS, Store


def put(stream: DataFrame, path: str, checkpoint: str, coercion: str = "auto", segment_max_docs: int = SEGMENT_MAX_DOCS, trigger: dict | None = None):
    """Appends each micro-batch to a store as segments of their own, one commit a batch.

    The commit holds the batch's number, so that a batch that the stream repeats
    after a failure is skipped if it was committed.  An empty batch commits nothing.
    Returns the running query.
    """
    spark = stream.sparkSession

    def take(batch: DataFrame, batch_id: int) -> None:
        store = Store(spark, path)
        done = store.commit().batch if store.generations() else None
        if done is not None and batch_id <= done or batch.isEmpty():
            return
        kept = batch.persist()
        try:
            store.write(kept, coercion, segment_max_docs, BATCH_ROWS, append=bool(store.generations()), batch=batch_id)
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """The rows of Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).parquet(path)


def windowed(stream: DataFrame, time: str, size: str, keys: list[str], late: str | None = None, slide: str | None = None) -> DataFrame:
    """(start, stop, keys..., n): rows by windows of time; rows later than ``late`` behind the latest are dropped."""
    if late:
        stream = stream.withWatermark(time, late)
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n")


def sessions(stream: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    """(start, stop, keys..., n): rows of a key that follow one another within the gap."""
    if late:
        stream = stream.withWatermark(time, late)
    return stream.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n")


def collect_stream(stream: DataFrame, path: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now, into Parquet files that executors write, and returns what they hold.

    complete replaces the files with each batch; append adds what a watermark
    has closed, so that late rows are dropped and windows still open stay out.
    """
    spark = stream.sparkSession

    def take(batch: DataFrame, batch_id: int) -> None:
        out = f"{path}/{batch_id if mode == 'append' else 'whole'}"  # a batch that is repeated replaces its own
        batch.write.mode("overwrite").parquet(out)

    query = stream.writeStream.foreachBatch(take).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)

"""Epochs as streams: batches without end, weights that follow metrics, and event-time windows over arriving files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lattiq.operators import mining, rowset


def epoch(df: DataFrame, key: str, epoch_no: int, batch_size: int, mode: str = rowset.KEEP, n: int | None = None) -> DataFrame:
    """An epoch's rows: shuffled by the epoch's number and cut into batches."""
    n = df.count() if n is None else n
    return rowset.batched(rowset.shuffled(df, key, epoch_no), batch_size, n, mode)


def batches(df: DataFrame, key: str, batch_size: int, epochs: int | None = None, most_steps: int | None = None, mode: str = rowset.KEEP) -> Iterator[tuple[int, int, list[Row]]]:
    """(epoch, batch, rows) for ever, or for some epochs: the driver holds two partitions, the next one is fetched ahead."""
    n, no = df.count(), 0
    while epochs is None or no < epochs:
        rows = epoch(df, key, no, batch_size, mode, n).orderBy("batch", "pos")
        at, held = None, []
        for r in rows.toLocalIterator(prefetchPartitions=True):
            if at is not None and r["batch"] != at:
                yield no, at, held
                held = []
                if most_steps is not None and at + 1 >= most_steps:
                    break
            at = r["batch"]
            held.append(r)
        else:
            if held:
                yield no, at, held
        no += 1


def mined_epochs(df: DataFrame, key: str, metrics: list[Callable[[DataFrame], DataFrame]], schedule: mining.Schedule, epochs: int, size: int, **options) -> Iterator[DataFrame]:
    """Each epoch's draw of ``size`` rows; when the schedule says so, a metric gives new weights first."""
    weighted = df.withColumn("p", F.lit(1.0))
    for no in range(epochs):
        if schedule.due(no):
            measured = metrics[schedule.metric(no)](df)
            weighted = mining.index_probability(measured, "metric", **options)
        yield rowset.resampled(weighted, "p", size, key, no)


def windowed_counts(spark: SparkSession, path: str, schema, width: str = "1 day", late: str = "2 days", by: str = "event_type", files_at_once: int | None = None) -> DataFrame:
    """A stream over a folder's files: rows and sums by event-time window, late rows up to the watermark."""
    reader = spark.readStream.schema(schema)
    reader = reader if files_at_once is None else reader.option("maxFilesPerTrigger", files_at_once)
    events = reader.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    w = F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Everything that is there now, to parquet."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_batches(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "update") -> None:
    """Calls a function with each batch of changed windows, once for all that is there now."""
    stream.writeStream.outputMode(mode).foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

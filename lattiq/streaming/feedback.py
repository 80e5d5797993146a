"""Weights that follow metrics, as a stream: metrics of samples arrive as rows, a state by key holds each sample's newest ones, and when the
schedule says so sampling weights are computed from all of them.

The state and the snapshots are in shared folders, so a stream that is started again from its checkpoint goes on where it was and gives the same
weights; a batch that is tried again overwrites its own output.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from lattiq.operators import mining

#: Spark keeps the state of ``transformWithState`` in this store.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Newest(StatefulProcessor):
    """A key's metrics of its newest epoch, the mean of the rows that came for it (parts of a sample), in whatever order and batches
    they came. Rows of an older epoch change nothing."""

    def __init__(self, keys: Sequence[str]):
        self.keys = list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("newest", "epoch long, n long, sums array<double>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        epoch, n, sums = self.state.get() if self.state.exists() else (-1, 0, None)
        before = (epoch, n)
        sums = None if sums is None else np.asarray(sums, dtype=np.float64)
        for part in rows:
            for e, m in zip(part["epoch"].to_numpy(), part["metrics"]):
                if e > epoch:
                    epoch, n, sums = int(e), 0, np.zeros(len(m))
                if e == epoch:
                    n, sums = n + 1, sums + np.asarray(m, dtype=np.float64)
        if (epoch, n) != before:
            self.state.update((epoch, n, sums.tolist()))
            yield pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key)}, "epoch": [epoch], "metrics": [(sums / n).tolist()]})

    def close(self) -> None:
        pass


def newest_metrics(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The stream of a sample's newest metrics (keys, epoch, metrics), a row whenever they change, of rows (keys, epoch, metrics)."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    schema = StructType([stream.schema[k] for k in keys]).add("epoch", "long").add("metrics", stream.schema["metrics"].dataType)
    rows = stream.select(*keys, F.col("epoch").cast("long"), "metrics")
    return rows.groupBy(*keys).transformWithStateInPandas(Newest(keys), schema, "Update", "None")


def snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The last whole snapshot of all samples' newest metrics."""
    done = _batches(spark, f"{path}/samples")
    return spark.read.parquet(f"{path}/samples/batch={done[-1]}") if done else None


def weights(spark: SparkSession, path: str, epoch: int) -> DataFrame:
    """The weights that were computed after an epoch."""
    return spark.read.parquet(f"{path}/weights/epoch={epoch}")


def _batches(spark: SparkSession, folder: str) -> list[int]:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [s.getPath() for s in fs.listStatus(at)]
    return sorted(int(n.getName().split("=")[1]) for n in names if n.getName().startswith("batch=") and fs.exists(jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS")))


def newest_of(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, epoch, n, sums, metrics) of each sample's newest epoch, of rows (keys, epoch, n, sums): sums of n rows. Partial sums are taken
    before any shuffle, by position, so a sample of very many parts takes a row a task. A null metric is NaN; rows without an epoch are left out."""
    each = rows.where(F.col("epoch").isNotNull()).select(*keys, "epoch", "n", F.posexplode_outer("sums").alias("i", "v"))
    v = F.when(F.col("i").isNotNull(), F.coalesce(F.col("v").cast("double"), F.lit(float("nan"))))
    each = each.groupBy(*keys, "epoch", "i").agg(F.sum("n").alias("n"), F.sum(v).alias("v"))
    at = F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", "v"))))
    each = each.groupBy(*keys, "epoch").agg(F.max("n").alias("n"), F.transform(at, lambda x: x["v"]).alias("sums"))
    last = each.groupBy(*keys).agg(F.max_by(F.struct("epoch", "n", "sums"), "epoch").alias("x")).select(*keys, "x.*")
    return last.withColumn("metrics", F.transform("sums", lambda x: x / F.col("n")))


def follow(stream: DataFrame, keys: Sequence[str], schedule: mining.Schedule, path: str, checkpoint: str, **options) -> None:
    """Runs the stream over all that is there now: each batch of metrics is merged into the snapshot, and after an epoch that is due
    the weights of its metric are written (they sum to 1; ``options`` are those of ``mining.regime``). The snapshot, a row for each sample with
    the count and sums of its newest epoch, is the state: it is merged by aggregation, with no call for each sample."""
    spark = stream.sparkSession

    def merged(batch: DataFrame, no: int) -> None:
        done = [b for b in _batches(spark, f"{path}/samples") if b < no]
        state = [*keys, "epoch", "n", "sums"]
        rows = batch.select(*keys, F.col("epoch").cast("long"), F.lit(1).cast("long").alias("n"), F.col("metrics").cast("array<double>").alias("sums"))
        if done:
            rows = rows.unionByName(spark.read.parquet(f"{path}/samples/batch={done[-1]}").select(*state))
        newest_of(rows, keys).write.mode("overwrite").parquet(f"{path}/samples/batch={no}")
        now = spark.read.parquet(f"{path}/samples/batch={no}")
        epoch = now.agg(F.max("epoch")).first()[0]
        if epoch is not None and schedule.due(epoch):
            m = now.select(*keys, F.get("metrics", F.lit(schedule.metric(epoch))).alias("m"))
            mining.index_probability(m, "m", **options).select(*keys, "p").write.mode("overwrite").parquet(f"{path}/weights/epoch={epoch}")

    query = stream.writeStream.foreachBatch(merged).option("checkpointLocation", checkpoint)
    query.trigger(availableNow=True).start().awaitTermination()

"""Structured Streaming: archiving with a ledger, guarded publication, averages per key, event-time windows."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from almucantar.operators import climatology


def archive_batch(root: str, keys: list[str], guard: Callable[[DataFrame], DataFrame] | None = None, weight: int = 1) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` that adds samples (cycle_id, ts, value, keys) to a store exactly once.

    Each batch writes the whole store and ledger under its own number, so a batch that runs again replaces
    what it wrote; the ledger keeps a cycle from being counted twice. ``guard`` returns the rows to hold
    back: cycles that have any are quarantined and the store goes on without them.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        past = [f for f in folders(spark, root) if f < number]
        if past:
            store, ledger = (spark.read.parquet(f"{root}/batch={max(past):012d}/{k}") for k in ("store", "ledger"))
        else:
            names = ", ".join(f"{k} {t}" for k, t in batch.dtypes if k in keys)
            store, ledger = spark.createDataFrame([], f"month int, slot int, {names}, total double, n long"), spark.createDataFrame([], "cycle_id string")
        if guard is not None:
            held = guard(batch).select("cycle_id").distinct()
            batch.join(held, "cycle_id", "left_semi").write.mode("overwrite").parquet(f"{root}/quarantine/batch={number:012d}")
            batch = batch.join(held, "cycle_id", "left_anti")
        store, ledger = climatology.add_to_store(store, ledger, batch, keys, weight)
        store.write.mode("overwrite").parquet(f"{root}/batch={number:012d}/store")
        ledger.write.mode("overwrite").parquet(f"{root}/batch={number:012d}/ledger")

    return run


def folders(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the batches whose ledger, written last, is complete."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/batch=*/ledger/_SUCCESS")
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(int(str(f.getPath()).split("batch=")[1].split("/")[0]) for f in found or [])


def current(spark: SparkSession, root: str) -> DataFrame:
    """The store as of the last complete batch."""
    return spark.read.parquet(f"{root}/batch={folders(spark, root)[-1]:012d}/store")


def averages(rows: DataFrame, share: float = 0.3) -> DataFrame:
    """A running average per kind of rows (kind, seconds, at): the first value starts it, later ones count ``share``.

    On a stream the state is kept per kind; within a batch rows go by ``at``.
    """

    def step(key, frames, state):
        value = json.loads(state.get[0])["v"] if state.exists else None
        for frame in frames:
            for x in frame.sort_values("at")["seconds"]:
                value = x if value is None else (1 - share) * value + share * x
        state.update((json.dumps({"v": value}),))
        yield pd.DataFrame({"kind": [key[0]], "average": [value]})

    return rows.groupBy("kind").applyInPandasWithState(step, "kind string, average double", "state string", "update", GroupStateTimeout.NoTimeout)


def window_sums(events: DataFrame, keys: list[str], length: str = "3 hours", late: str = "1 day") -> DataFrame:
    """Sums and counts by event-time window; rows later than the watermark are dropped on a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", length).alias("w"), *keys).agg(F.sum("value").alias("total"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), *keys, "total", "n")

"""Structured Streaming forms: windows with watermarks, deduplication, and a sliding-window rate limiter."""

from __future__ import annotations

import os
import uuid
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitequarry.plans.session import checkpoint_dir


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table as a stream of files, a few a batch."""
    path = f"{folder}/{name}.parquet"
    # a pattern, as the table may be one file, which a file stream takes by pattern only
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 4).parquet(path + "*")


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a streaming query over all that is there and gives its sink, a table in the shared folder. In complete mode the last result stands."""
    spark = df.sparkSession
    where = os.path.join(checkpoint_dir(spark), f"stream-{uuid.uuid4().hex}")

    def keep(batch: DataFrame, number: int) -> None:
        # a batch that is tried again writes the same place, so that each counts once
        batch.write.mode("overwrite").parquet(f"{where}/out/batch={number if mode == 'append' else 0}")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{where}/out/batch=*")


def daily(events: DataFrame) -> DataFrame:
    """Per day: events and mean value. Rows later than a day after the newest seen are dropped."""
    return events.withWatermark("ts", "1 day").groupBy(F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 4).alias("avg_value")).select(F.to_date("w.start").alias("day"), "n", "avg_value")


def sliding(events: DataFrame) -> DataFrame:
    """Per six-hour window, opened every three, and type: number of events. An extension."""
    return events.withWatermark("ts", "1 day").groupBy(F.window("ts", "6 hours", "3 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("starts"), "event_type", "n")


def first_seen(docs: DataFrame, key: str, ts: str) -> DataFrame:
    """One row per key within the watermark, whichever arrives first; state of older keys is dropped."""
    return docs.withWatermark(ts, "30 days").dropDuplicatesWithinWatermark([key])


def rate_limited(events: DataFrame, limit: int = 100, seconds: int = 3600) -> DataFrame:
    """event_id, user_id and allowed: an event is allowed if fewer than ``limit`` allowed ones of its user lie in the ``seconds`` before it.

    Only allowed events count, so the rule is sequential, but only within a run: where a user has no event in a whole slot of
    ``seconds``, nothing before matters after. The slots in use are aggregated with map-side combine and joined into runs; runs are spread over the
    tasks, sorted by time, and each is read once as a stream with at most ``limit`` times in memory. Ties go by event_id; a null
    user is a user, a null time comes first and is allowed.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, times = object(), deque()
        for batch in batches:
            allowed = []
            users = batch["user_id"].astype(object).where(batch["user_id"].notna(), None)
            for u, r, t in zip(users, batch["run"].tolist(), batch["t"].tolist()):
                if (u, r) != key:
                    key, times = (u, r), deque()
                while times and times[0] <= t - seconds:
                    times.popleft()
                ok = not t == t or len(times) < limit
                if ok and t == t:
                    times.append(t)
                allowed.append(ok)
            yield pd.DataFrame({"event_id": batch["event_id"], "user_id": batch["user_id"], "allowed": allowed})

    kinds = dict(events.dtypes)
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000
    rows = events.select("event_id", "user_id", t.alias("t"), F.coalesce(F.floor(t / seconds), F.lit(-1)).alias("slot"))
    w = Window.partitionBy("user_id").orderBy("slot")
    slots = rows.select("user_id", "slot").distinct().withColumn("opens", F.when(F.col("slot") - F.lag("slot").over(w) == 1, 0).otherwise(1))
    runs = slots.select("user_id", "slot", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run")).toDF("_u", "_s", "run")
    rows = rows.join(runs, F.col("user_id").eqNullSafe(F.col("_u")) & (F.col("slot") == F.col("_s")))
    rows = rows.select("event_id", "user_id", "run", "t").repartition("user_id", "run").sortWithinPartitions("user_id", "run", "t", "event_id")
    return rows.mapInPandas(run, f"event_id {kinds['event_id']}, user_id {kinds['user_id']}, allowed boolean")

"""Streaming forms of the event-log state: daily study time with late data, latest attempts by upsert."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnspark.functions.scores import rnd
from learnspark.sources import model as M
from learnspark.sources.files import remove, shared_folder, versions


def event_stream(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """The event files of a folder as a stream, a file a trigger."""
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", 1).parquet(folder)


def daily(events: DataFrame, late: str = "30 days") -> DataFrame:
    """(date, seconds, events) by tumbling day; a day is closed when events `late` after it have come."""
    day = F.window("ts", "1 day")
    spent = F.floor(F.col("value") + 0.5).cast("long")
    g = events.withWatermark("ts", late).groupBy(day.alias("w")).agg(F.sum(F.when(spent > 0, spent)).alias("seconds"), F.count("*").alias("events"))
    return g.select(F.to_date("w.start").alias("date"), "seconds", "events")


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def upsert(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str]):
    """A foreachBatch function that keeps, under path, the row of each key that is last in the order.

    Batch n reads the newest complete version before it and writes version n, so a batch that is run
    again gives the same table and a restarted query goes on from the files. The last two versions
    stay; read the newest with `upserted`.
    """

    def apply(batch: DataFrame, number: int) -> None:
        before = [f for n, f in versions(spark, path) if n < number]
        rows = batch.unionByName(spark.read.parquet(before[-1])) if before else batch
        rest = [c for c in rows.columns if c not in {*keys, *order}]
        last = rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("x"))
        last.select(*keys, "x.*").select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v{number}")
        for old in before[:-1]:
            remove(spark, old)

    return apply


def upserted(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(versions(spark, path)[-1][1])


def upsert_latest(spark: SparkSession, path: str):
    """Keeps the latest attempt of each question: (question_id, ts, event_id, correct)."""
    keep = upsert(spark, path, ["question_id"], ["ts", "event_id"])
    return lambda batch, number: keep(batch.select("question_id", "ts", "event_id", "correct"), number)


def run_daily(spark: SparkSession, events: DataFrame, folder: str, late: str = "30 days") -> None:
    """Runs the daily stream over what there is; days that a batch changes are upserted, older ones than `late` leave the state."""
    keep = upsert(spark, f"{folder}/days", ["date"], ["events", "seconds"])  # totals of a day only grow
    query = daily(events, late).writeStream.outputMode("update").foreachBatch(keep)
    query.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()


def replay_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs the daily stream over the event table to its end and returns its days."""
    folder = f"{shared_folder(spark)}/daily-{uuid.uuid4().hex}"
    run_daily(spark, event_stream(spark, sf_dir, "events.parquet"), folder)
    return upserted(spark, f"{folder}/days").select("date", rnd(F.col("seconds") / 60, 1).alias("minutes"), "events")


def learning_stream(events: DataFrame) -> DataFrame:
    """Raw events as learning events, the same projection as in batch."""
    return M.as_learning(events)

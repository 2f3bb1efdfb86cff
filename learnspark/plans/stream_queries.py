"""Queries that replay the event table as a stream with state by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from learnspark.functions.scores import rnd
from learnspark.sources import model as M
from learnspark.streaming import state as T
from learnspark.streaming.events import event_stream


#: Groups of users that count as one learner, and days kept, so that the test tables fill the state.
LEARNERS, DAYS = 7, 14


def _stream(spark, d):
    return M.as_learning(event_stream(spark, d, "events.parquet"))


def _by_learner(spark, d):
    return _stream(spark, d).withColumn("user_id", F.col("user_id") % LEARNERS)


def stream_durations(spark, d):
    return T.run(spark, T.timers(_stream(spark, d)), T.fresh_folder(spark, "durations"), ["event_id"], "append")


def stream_wrongs(spark, d):
    return T.run(spark, T.wrong_streaks(_stream(spark, d)), T.fresh_folder(spark, "wrongs"), ["question_id"]).where("wrong_count > 0")


def stream_retained(spark, d):
    return T.run(spark, T.newest_events(_by_learner(spark, d)), T.fresh_folder(spark, "retained"), ["user_id", "event_id"]).where("kept").drop("kept")


def stream_sessions(spark, d):
    days = T.run(spark, T.newest_days(_by_learner(spark, d), DAYS), T.fresh_folder(spark, "sessions"), ["user_id", "date"]).where("kept")
    return days.select("user_id", "date", rnd(F.col("seconds") / 60, 1).alias("minutes"), "last_activity")

"""State of a learner from the event log: latest attempts, wrong streaks, study time, retention.

Each is an aggregation by question or day that combines before it shuffles, so a question that holds
a third of all events is no hot task; only answer timing needs the order within a question.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnspark.functions.scores import rnd, rnd_int


def graded(events: DataFrame) -> DataFrame:
    return events.where((F.col("type") == "question_answer") & F.col("correct").isNotNull())


def latest_attempts(events: DataFrame) -> DataFrame:
    """(question_id, pattern_id, answered_at, correct): the last graded answer of each question."""
    last = F.max(F.struct("ts", "event_id", "correct", "pattern_id")).alias("x")
    return graded(events).groupBy("question_id").agg(last).select("question_id", "x.pattern_id", F.col("x.ts").alias("answered_at"), "x.correct")


def wrong_streaks(events: DataFrame) -> DataFrame:
    """(question_id, pattern_id, wrong_count, last_wrong_at): wrong answers since the last right one, if any."""
    g = graded(events).select("question_id", "pattern_id", "correct", F.struct("ts", "event_id").alias("at"))
    right = g.where("correct").groupBy("question_id").agg(F.max("at").alias("right"))
    since = g.where("not correct").join(right, "question_id", "left").where(F.col("right").isNull() | (F.col("at") > F.col("right")))
    return since.groupBy("question_id").agg(F.first("pattern_id").alias("pattern_id"), F.count("*").alias("wrong_count"), F.max("at.ts").alias("last_wrong_at"))


def attempt_counters(latest: DataFrame) -> DataFrame:
    return latest.agg(F.count("*").alias("total_answered"), F.count_if("correct").alias("total_correct"))


def carried(rows: DataFrame, keys: list[str], block: str, values: dict[str, Column]) -> DataFrame:
    """(keys, block, values): for each block of a key, each aggregate over all its blocks before.

    With it a running value is made of two short windows, one over a key's blocks and one within a
    block, so that a key that holds most rows is no single task.
    """
    past = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.groupBy(*keys, block).agg(*[v.alias(f"own_{k}") for k, v in values.items()])
    over = {k: (F.sum if "sum" in k else F.max)(f"own_{k}").over(past) for k in values}
    return own.select(*keys, block, *[v.alias(k) for k, v in over.items()])


def answer_durations(events: DataFrame) -> DataFrame:
    """(event_id, question_id, seconds): from a question's last start to its answer; each start serves one answer."""
    own = Window.partitionBy("question_id", "hour").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    timed = events.where(F.col("type").isin("question_start", "question_answer")).select("event_id", "question_id", "type", "ts", F.date_trunc("hour", "ts").alias("hour"))
    at = F.struct("ts", "event_id")
    started, answered = (F.max(F.when(F.col("type") == f"question_{x}", at)) for x in ("start", "answer"))
    before = carried(timed, ["question_id"], "hour", {"max_s": started, "max_a": answered})
    here = timed.withColumn("s0", started.over(own)).withColumn("a0", answered.over(own)).where("type = 'question_answer'")
    both = here.join(before.withColumnRenamed("question_id", "q").withColumnRenamed("hour", "h"), F.col("question_id").eqNullSafe(F.col("q")) & (F.col("hour") == F.col("h")), "left")
    out = both.withColumn("s", F.coalesce("s0", "max_s")).withColumn("a", F.coalesce("a0", "max_a"))
    open_ = F.col("s").isNotNull() & (F.col("a").isNull() | (F.col("s") > F.col("a")))
    seconds = rnd_int((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.col("s.ts").cast("timestamp"))) / 1_000_000.0)
    return out.select("event_id", "question_id", F.when(open_, seconds).alias("seconds"))


def retained(events: DataFrame, keep: int = 500) -> DataFrame:
    """The last `keep` events."""
    return events.orderBy(F.desc("ts"), F.desc("event_id")).limit(keep)


def study_minutes(events: DataFrame) -> DataFrame:
    total = F.coalesce(F.sum(F.when(F.col("duration") > 0, F.col("duration"))), F.lit(0))
    return events.agg(total.alias("seconds")).select("seconds", rnd_int(F.col("seconds") / 60).alias("minutes"))


def study_sessions(events: DataFrame, keep: int = 30) -> DataFrame:
    """(date, minutes, last_activity) of the newest `keep` days with time spent."""
    spent = events.where("duration > 0").groupBy("date").agg(rnd(F.sum("duration") / 60, 1).alias("minutes"), F.max("ts").alias("last_activity"))
    return spent.orderBy(F.desc("date")).limit(keep)


def running_score(events: DataFrame, day: str) -> DataFrame:
    """(event_id, answered, right): the score after each graded answer of one day, the learner's session; by the minute, then within it."""
    g = graded(events).where(F.col("date") == F.to_date(F.lit(day))).select("event_id", "ts", "date", "correct", F.date_trunc("minute", "ts").alias("minute"))
    before = carried(g, ["date"], "minute", {"sum_n": F.count("*"), "sum_right": F.count_if("correct")})
    w = Window.partitionBy("date", "minute").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    here = g.select("event_id", "date", "minute", F.count("*").over(w).alias("n"), F.count_if("correct").over(w).alias("r")).join(before, ["date", "minute"])
    return here.select("event_id", (F.col("n") + F.coalesce("sum_n", F.lit(0))).alias("answered"), (F.col("r") + F.coalesce("sum_right", F.lit(0))).alias("right"))


def study_time_estimate(events: DataFrame, latest: DataFrame, exam_seconds: DataFrame, recent: DataFrame | None = None, per_question: float = 2.5) -> DataFrame:
    """One row `minutes`: from the events; where they hold no time, recent study (minutes) plus exams (seconds); without that 2.5 minutes an answered question plus exams."""
    e = study_minutes(events).select(F.col("minutes").alias("from_events"))
    n = latest.agg(F.count("*").alias("n"))
    x = exam_seconds.agg(F.coalesce(F.sum("seconds"), F.lit(0)).alias("exam"))
    r = (latest.limit(0).select(F.lit(0.0).alias("minutes")) if recent is None else recent).agg(F.coalesce(F.sum("minutes"), F.lit(0.0)).alias("recent"))
    one = e.join(n).join(x).join(r)  # one row each
    exam = F.col("exam") / 60
    return one.select(F.when(F.col("from_events") > 0, F.col("from_events")).when(F.col("recent") > 0, rnd_int(F.col("recent") + exam)).otherwise(rnd_int(F.col("n") * per_question + exam)).alias("minutes"))


def active_sessions(sessions: DataFrame, key: str = "session_id") -> DataFrame:
    """The exam sessions that are not submitted yet, the newest of each learner: (user_id, key, started_at) with a null submitted_at."""
    return sessions.where("submitted_at is null").groupBy("user_id").agg(F.max_by(key, F.struct("started_at", key)).alias(key), F.max("started_at").alias("started_at"))


def attempts_with_defaults(attempts: DataFrame, defaults: dict) -> DataFrame:
    """A stored table of attempts with a default where a column is null or missing."""
    out = attempts
    for c, v in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v)) if c in attempts.columns else F.lit(v))
    return out

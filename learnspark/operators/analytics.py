"""Timelines, habits and pattern analytics over the event log and the learner's state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learnspark.functions import scores as S
from learnspark.operators import state

DAYS = 14


def calendar(spark: SparkSession, anchor: str, days: int = DAYS) -> DataFrame:
    """(date): the `days` days that end with the anchor."""
    last = F.to_date(F.lit(anchor))
    return spark.range(1).select(F.explode(F.sequence(F.date_sub(last, days - 1), last)).alias("date"))


def in_window(events: DataFrame, anchor: str, days: int = DAYS) -> DataFrame:
    last = F.to_date(F.lit(anchor))
    return events.where(F.col("date").between(F.date_sub(last, days - 1), last))


def timeline_daily(spark: SparkSession, events: DataFrame, anchor: str, days: int = DAYS) -> DataFrame:
    """(date, minutes, answered, tutor_views) of each calendar day, zero where nothing happened."""
    seconds = F.sum(F.when(F.col("duration") > 0, F.col("duration")))
    per = in_window(events, anchor, days).groupBy("date").agg(seconds.alias("s"), F.count_if(F.col("type") == "question_answer").alias("a"), F.count_if(F.col("type") == "tutor_view").alias("v"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return calendar(spark, anchor, days).join(per, "date", "left").select("date", S.rnd(zero(F.col("s")) / 60, 1).alias("minutes"), zero(F.col("a")).alias("answered"), zero(F.col("v")).alias("tutor_views"))


def timeline_accuracy(spark: SparkSession, events: DataFrame, anchor: str, days: int = DAYS, window: int = 3) -> DataFrame:
    """(date, answered, correct, accuracy, moving_average): accuracy in whole percent, null on days without answers."""
    per = in_window(state.graded(events), anchor, days).groupBy("date").agg(F.count("*").alias("answered"), F.count_if("correct").alias("correct"))
    rows = calendar(spark, anchor, days).join(per, "date", "left").select("date", F.coalesce("answered", F.lit(0)).alias("answered"), F.coalesce("correct", F.lit(0)).alias("correct"))
    rows = rows.withColumn("accuracy", S.percent(F.col("correct"), F.col("answered"), F.lit(None)))
    # a calendar has a fixed number of rows: one window partition is bounded
    trailing = Window.orderBy("date").rowsBetween(1 - window, 0)
    return rows.withColumn("moving_average", S.rnd(F.avg("accuracy").over(trailing), 1))


def timeline_summary(spark: SparkSession, events: DataFrame, anchor: str, days: int = DAYS) -> DataFrame:
    daily = timeline_daily(spark, events, anchor, days).agg(S.rnd_int(F.sum("minutes")).alias("total_minutes"), F.sum("answered").alias("total_answered"), F.count_if((F.col("minutes") > 0) | (F.col("answered") > 0)).alias("days_active"))
    trend = timeline_accuracy(spark, events, anchor, days).agg(F.coalesce(S.rnd_int(F.avg("accuracy")), F.lit(0)).alias("avg_accuracy"))
    tutor = tutor_usage(events).select("usage_ratio")
    return daily.join(trend).join(tutor).withColumn("total_time", S.study_time(F.col("total_minutes")))  # one row each


def tutor_usage(events: DataFrame) -> DataFrame:
    answer = F.col("type") == "question_answer"
    n = events.agg(F.count_if(answer).alias("total_answered"), F.count_if(F.col("type") == "tutor_view").alias("tutor_views"), F.count_if(answer & F.col("used_tutor")).alias("tutor_used"))
    return n.select("*", S.percent(F.col("tutor_used"), F.col("total_answered"), F.lit(0)).alias("usage_ratio"), S.percent(F.col("tutor_views"), F.col("total_answered"), F.lit(0)).alias("view_ratio"))


def tutor_daily(spark: SparkSession, events: DataFrame, anchor: str, days: int = DAYS) -> DataFrame:
    return timeline_daily(spark, events, anchor, days).select("date", "tutor_views")


def solving(events: DataFrame, anchor: str, days: int = DAYS) -> DataFrame:
    return in_window(events, anchor, days).where(F.col("type").isin("question_answer", "question_start"))


def hour_histogram(spark: SparkSession, events: DataFrame, anchor: str, days: int = DAYS) -> DataFrame:
    """(hour, n) for each of 24 hours."""
    per = solving(events, anchor, days).groupBy(F.hour("ts").alias("hour")).agg(F.count("*").alias("n"))
    return spark.range(24).select(F.col("id").cast("int").alias("hour")).join(per, "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def peak_hour(spark: SparkSession, events: DataFrame, anchor: str, days: int = DAYS) -> DataFrame:
    return hour_histogram(spark, events, anchor, days).where("n > 0").orderBy(F.desc("n"), "hour").limit(1)


def top_pattern(events: DataFrame, patterns: DataFrame, anchor: str, days: int = DAYS) -> DataFrame:
    """The most used pattern; of equals the one seen first."""
    per = solving(events, anchor, days).where("pattern_id is not null").groupBy("pattern_id").agg(F.count("*").alias("n"), F.min(F.struct("ts", "event_id")).alias("seen"))
    return per.orderBy(F.desc("n"), "seen").limit(1).join(patterns.select("pattern_id", "name"), "pattern_id", "left").select("pattern_id", "name", "n")


def weak_changes(events: DataFrame, patterns: DataFrame, anchor: str, days: int = DAYS, limit: int = 5) -> DataFrame:
    """Patterns whose accuracy fell between the window's halves; a half at exactly 0 % does not count."""
    late = F.col("date") >= F.date_sub(F.to_date(F.lit(anchor)), days - 1 - days // 2)
    g = in_window(state.graded(events), anchor, days)
    per = g.groupBy("pattern_id").agg(F.count_if(~late).alias("n1"), F.count_if(~late & F.col("correct")).alias("c1"), F.count_if(late).alias("n2"), F.count_if(late & F.col("correct")).alias("c2"))
    none = F.lit(0)
    per = per.select("pattern_id", S.percent(F.col("c1"), F.col("n1"), none).alias("early_accuracy"), S.percent(F.col("c2"), F.col("n2"), none).alias("late_accuracy"), F.col("n2").alias("late_answered"))
    fell = per.where("early_accuracy > 0 and late_accuracy > 0 and late_accuracy < early_accuracy").withColumn("change", F.col("late_accuracy") - F.col("early_accuracy"))
    return fell.orderBy("change", "pattern_id").limit(limit).join(patterns.select("pattern_id", "name"), "pattern_id", "left")


def daily_trend(latest: DataFrame, days: int = DAYS) -> DataFrame:
    """(date, answered, correct, accuracy) of the last `days` days that hold a latest attempt."""
    per = latest.groupBy(F.to_date("answered_at").alias("date")).agg(F.count("*").alias("answered"), F.count_if("correct").alias("correct"))
    return per.orderBy(F.desc("date")).limit(days).withColumn("accuracy", S.percent(F.col("correct"), F.col("answered"), F.lit(0)))


def pattern_progress(questions: DataFrame, latest: DataFrame) -> DataFrame:
    """(pattern_id, total, answered, correct, correct_percent, last_study_at) of every pattern with questions."""
    done = latest.select("question_id", "answered_at", "correct")
    per = questions.join(done, "question_id", "left").groupBy("pattern_id").agg(F.count("*").alias("total"), F.count("answered_at").alias("answered"), F.count_if("correct").alias("correct"), F.max("answered_at").alias("last_study_at"))
    return per.withColumn("correct_percent", S.percent(F.col("correct"), F.col("answered"), F.lit(0)))


def wrong_by_pattern(wrongs: DataFrame) -> DataFrame:
    """(pattern_id, question_count, total_wrong, last_wrong_at); a count of zero stands for one."""
    n = F.sum(F.when(F.coalesce("wrong_count", F.lit(0)) == 0, 1).otherwise(F.col("wrong_count")))
    return wrongs.where("pattern_id is not null").groupBy("pattern_id").agg(F.count("*").alias("question_count"), n.alias("total_wrong"), F.max("last_wrong_at").alias("last_wrong_at"))


def pattern_analytics(patterns: DataFrame, questions: DataFrame, latest: DataFrame, wrongs: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = patterns.join(pattern_progress(questions, latest), "pattern_id", "left").join(wrong_by_pattern(wrongs), "pattern_id", "left")
    rows = rows.select(*patterns.columns, *[zero(c).alias(c) for c in ("total", "answered", "correct", "correct_percent", "question_count", "total_wrong")], "last_study_at", "last_wrong_at")
    score = S.weakness_score(F.col("correct_percent"), F.col("total_wrong"), F.col("question_count"), F.col("answered"), F.col("total"))
    return rows.withColumn("weakness_score", score).withColumn("weakness_level", S.weakness_level(F.col("weakness_score")))


def weak_top(analytics: DataFrame, limit: int = 3) -> DataFrame:
    return analytics.where("answered > 0 or total_wrong > 0").orderBy(F.desc("weakness_score"), F.desc("total_wrong"), "pattern_id").limit(limit)


def overall_stats(latest: DataFrame, wrongs: DataFrame, analytics: DataFrame, events: DataFrame) -> DataFrame:
    n = state.attempt_counters(latest).withColumn("accuracy", S.percent(F.col("total_correct"), F.col("total_answered"), F.lit(0)))
    n = n.withColumn("wrong_rate", F.when(F.col("total_answered") > 0, 100 - F.col("accuracy")).otherwise(0))
    w = wrongs.agg(F.count("*").alias("wrong_questions"))
    p = analytics.agg(F.count_if(F.col("answered") > 0).alias("studied_patterns"), F.count("*").alias("total_patterns"))
    m = state.study_minutes(events).select("minutes")
    return n.join(w).join(p).join(m)  # one row each


def dashboard(analytics: DataFrame) -> DataFrame:
    n = analytics.agg(F.sum("total").alias("questions"), F.sum("answered").alias("answered"), F.sum("correct").alias("correct"), F.count_if(F.col("total_wrong") > 0).alias("patterns_with_wrong"), F.count("*").alias("patterns"))
    return n.withColumn("overall_percent", S.percent(F.col("answered"), F.col("questions"), F.lit(0)))


def vulnerability(patterns: DataFrame, wrongs: DataFrame, every: bool = False) -> DataFrame:
    """Patterns with wrong answers; with `every`, the others too, at level NONE with a score of 0."""
    w = patterns.select("pattern_id", "name").join(wrong_by_pattern(wrongs), "pattern_id", "left" if every else "inner").na.fill(0, ["question_count", "total_wrong"])
    w = w.withColumn("score", F.col("total_wrong") * 10 + F.col("question_count") * 5)
    level = F.when(F.col("total_wrong") == 0, "NONE").when((F.col("total_wrong") >= 3) | (F.col("score") >= 35), "HIGH").when((F.col("total_wrong") >= 2) | (F.col("score") >= 15), "MEDIUM").otherwise("LOW")
    return w.select("pattern_id", "name", "question_count", "total_wrong", "score", level.alias("level"))


def wrong_entries(wrongs: DataFrame, questions: DataFrame, patterns: DataFrame) -> DataFrame:
    q = wrongs.drop("pattern_id").join(questions.select("question_id", "pattern_id", "question"), "question_id")
    return q.join(patterns.select("pattern_id", F.col("name").alias("pattern")), "pattern_id", "left").select("question_id", "pattern_id", "question", "pattern", "wrong_count", "last_wrong_at")


def wrong_summary(entries: DataFrame, vulnerable: DataFrame) -> DataFrame:
    e = entries.agg(F.count("*").alias("questions"), F.coalesce(F.sum("wrong_count"), F.lit(0)).alias("wrong_attempts"), F.max_by("question_id", F.struct("wrong_count", "last_wrong_at", -F.col("question_id"))).alias("retry_target"))
    v = vulnerable.agg(F.count("*").alias("vulnerable"), F.count_if(F.col("level") == "HIGH").alias("high"))
    return e.join(v)  # one row each

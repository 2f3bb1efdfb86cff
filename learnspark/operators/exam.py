"""Exam sessions: grading, pattern statistics, history, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from learnspark.functions import scores as S

PASS_SCORE = 60


def details(answers: DataFrame, questions: DataFrame) -> DataFrame:
    """Each answer with its question, null where the question is unknown; `right` is never null."""
    q = questions.select("question_id", "pattern_id", "year", "answer", F.lit(True).alias("known"))
    d = answers.join(q, "question_id", "left")
    return d.withColumn("known", F.coalesce("known", F.lit(False))).withColumn("right", F.coalesce(F.col("selected") == F.col("answer"), F.lit(False)))


def grade(d: DataFrame) -> DataFrame:
    """One row a session; unknown questions count in the total only, an empty session has no score."""
    n = d.groupBy("session_id").agg(F.count("*").alias("total"), F.count_if(F.col("known") & F.col("selected").isNotNull()).alias("answered"), F.count_if(F.col("right")).alias("correct"))
    return n.select("*", (F.col("total") - F.col("answered")).alias("unanswered"), S.rnd(F.col("correct") / F.col("total") * 100, 1).alias("accuracy"), S.percent(F.col("correct"), F.col("total"), F.lit(None)).alias("score")).withColumn("passed", F.col("score") >= PASS_SCORE)


def pattern_stats(d: DataFrame) -> DataFrame:
    """Totals by pattern over all sessions, with the achievement level."""
    n = d.where("known").groupBy("pattern_id").agg(F.count("*").alias("total"), F.count("selected").alias("answered"), F.count_if("right").alias("correct"))
    return n.withColumn("accuracy", S.rnd(F.col("correct") / F.col("total") * 100, 1)).withColumn("level", S.achievement(F.col("accuracy")))


def session_pattern_stats(d: DataFrame) -> DataFrame:
    n = d.where("known").groupBy("session_id", "pattern_id").agg(F.count("*").alias("total"), F.count("selected").alias("answered"), F.count_if("right").alias("correct"))
    return n.withColumn("accuracy", S.rnd(F.col("correct") / F.col("total") * 100, 1))


def weak_patterns(stats: DataFrame, limit: int = 5) -> DataFrame:
    """The weakest patterns of each session with their reason; a session has as many patterns as questions at most."""
    w = Window.partitionBy("session_id").orderBy("accuracy", "pattern_id")
    reason = F.when(F.col("accuracy") < 50, "below_50").when(F.col("accuracy") < 70, "below_70").otherwise("some_wrong")
    rows = stats.where("accuracy < 70 or correct < total")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("session_id", "pattern_id", "accuracy", reason.alias("reason"), "rank")


def advice(grades: DataFrame, weak: DataFrame) -> DataFrame:
    """(session_id, kind, pattern_id, n): what a session's result recommends, as rows of the rules that hold."""
    none = F.lit(None).cast("string")
    time = grades.where("unanswered > 0").select("session_id", F.lit("time").alias("kind"), none.alias("pattern_id"), F.col("unanswered").alias("n"))
    again = weak.where("rank <= 3").select("session_id", F.lit("pattern").alias("kind"), "pattern_id", F.col("rank").cast("long").alias("n"))
    failed = grades.where("not passed").select("session_id", F.explode(F.array(F.lit("wrong-note"), F.lit("ai-tutor"))).alias("kind"), none.alias("pattern_id"), F.lit(None).cast("long").alias("n"))
    more = grades.where("passed").join(weak.where("rank = 1 and accuracy < 100").select("session_id", "pattern_id"), "session_id").select("session_id", F.lit("question").alias("kind"), "pattern_id", F.lit(None).cast("long").alias("n"))
    return time.unionByName(again).unionByName(failed).unionByName(more)


def history(grades: DataFrame, order: str = "session_id") -> DataFrame:
    """(exams, average, best, latest) over all graded sessions."""
    return grades.agg(F.count("*").alias("exams"), S.rnd_int(F.avg("score")).alias("average"), F.max("score").alias("best"), F.max_by("score", order).alias("latest"))


def newest(grades: DataFrame, keep: int = 20, order: str = "session_id") -> DataFrame:
    return grades.orderBy(F.desc(order)).limit(keep)


def sample(questions: DataFrame, n: int, seed: str = "exam") -> DataFrame:
    """n questions without replacement, the same for the same seed on any cluster."""
    return questions.orderBy(F.md5(F.concat(F.lit(seed), F.col("question_id").cast("string"))), "question_id").limit(n)


def round_robin(questions: DataFrame, group: str, n: int) -> DataFrame:
    """n questions taken in turn from each group."""
    w = Window.partitionBy(group).orderBy("question_id")
    # no group gives more than n, so each keeps its first n before anything is shuffled
    return questions.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n).orderBy("turn", group).limit(n)


def first_per_group(questions: DataFrame, group: str, n: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy("question_id")
    return questions.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= n)

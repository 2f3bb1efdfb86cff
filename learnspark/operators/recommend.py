"""Ranked recommendations: patterns by score, weak patterns, questions due for review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnspark.functions import scores as S

# Texts shown as reasons; {n} is a number.
REASONS = {
    "grade_s": "S급 핵심 Pattern",
    "grade_a": "A급 중요 Pattern",
    "frequent": "출제 빈도 HIGH",
    "wrong_n": "최근 {n}회 오답",
    "wrong": "오답 기록 있음",
    "percent": "정답률 {n}%",
    "never": "아직 학습하지 않은 Pattern",
    "days": "마지막 학습 {n}일 전",
    "week": "1주 이상 복습 간격",
    "important": "Pattern 중요도 상위",
    "repeated": "반복 실패 {n}회",
    "missed_n": "오답 {n}회",
    "missed": "오답 1회",
    "due": "복습 주기 도래",
    "recent": "최근 오답",
    "calculation": "계산형 — AI Tutor 권장",
    "mixed": "혼합형 문항",
    "core": "고중요 Pattern 소속",
}


def _text(name: str, n: Column | None = None) -> Column:
    before, mark, after = REASONS[name].partition("{n}")
    return F.concat(F.lit(before), n.cast("string"), F.lit(after)) if mark else F.lit(before)


def _first_four(*reasons: Column) -> Column:
    return F.slice(F.array_compact(F.array(*reasons)), 1, 4)


def pattern_reasons() -> Column:
    c = F.col
    return _first_four(
        F.when(c("grade") == "S", _text("grade_s")).when(c("grade") == "A", _text("grade_a")),
        F.when(c("priority") == "HIGH", _text("frequent")),
        F.when(c("total_wrong") >= 3, _text("wrong_n", c("total_wrong"))).when(c("total_wrong") >= 1, _text("wrong")),
        F.when((c("correct_percent") < 60) & (c("correct_percent") >= 0), _text("percent", c("correct_percent"))),
        F.when(c("study_days").isNull(), _text("never")).when(c("study_days") >= 14, _text("days", c("study_days"))).when(c("study_days") >= 7, _text("week")),
        F.when(c("importance_score") >= 85, _text("important")),
    )


def question_reasons() -> Column:
    c = F.col
    return _first_four(
        F.when(c("wrong_count") >= 3, _text("repeated", c("wrong_count"))).when(c("wrong_count") >= 2, _text("missed_n", c("wrong_count"))).otherwise(_text("missed")),
        F.when(c("due"), _text("due")),
        F.when(c("wrong_days") <= 3, _text("recent")),
        F.when(c("question_type") == "calculation", _text("calculation")).when(c("question_type") == "mixed", _text("mixed")),
        F.when(c("importance_score") >= 80, _text("core")),
    )


def dominant_types(questions: DataFrame) -> DataFrame:
    """(pattern_id, question_type): the most frequent type; of equals the one of the first question."""
    per = questions.groupBy("pattern_id", "question_type").agg(F.count("*").alias("n"), F.min("question_id").alias("first"))
    return per.groupBy("pattern_id").agg(F.max_by("question_type", F.struct("n", -F.col("first"))).alias("question_type"))


def pattern_metrics(analytics: DataFrame, questions: DataFrame, day: str) -> DataFrame:
    """Analytics rows with the four factor scores, the recommendation score and its reasons."""
    m = analytics.join(dominant_types(questions), "pattern_id", "left")
    m = m.withColumn("study_days", S.days_since(F.col("last_study_at"), day)).withColumn("wrong_days", S.days_since(F.col("last_wrong_at"), day))
    m = m.withColumn("importance_score", S.importance_score(F.col("grade"), F.col("importance"), F.col("stat_grade")))
    m = m.withColumn("recency_score", S.recency_score(F.col("study_days"), F.col("wrong_days"), F.col("total_wrong")))
    m = m.withColumn("exam_probability", S.exam_probability(F.col("priority"), F.col("frequency"), F.col("recent_years")))
    factor = S.type_factor(F.coalesce("question_type", F.lit("mixed")))
    m = m.withColumn("score", S.recommendation_score(F.col("importance_score"), F.col("weakness_score"), F.col("recency_score"), F.col("exam_probability"), factor))
    return m.withColumn("reasons", pattern_reasons())


def _ranked(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows by `order`, numbered; only those few rows are gathered."""
    from pyspark.sql import Window

    return rows.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def daily(metrics: DataFrame, limit: int = 3) -> DataFrame:
    return _ranked(metrics, limit, F.desc("score"), F.col("pattern_id"))


def weak(metrics: DataFrame, limit: int = 5) -> DataFrame:
    rows = metrics.where("total_wrong > 0 or correct_percent < 70")
    level = F.when((F.col("total_wrong") >= 3) | (F.col("correct_percent") < 50), "HIGH").otherwise("MEDIUM")
    return _ranked(rows.withColumn("level", level), limit, F.desc("score"), F.col("pattern_id"))


def review_entries(wrongs: DataFrame, questions: DataFrame, patterns: DataFrame, day: str) -> DataFrame:
    """Wrong questions that still exist, with priority, due flag and review score."""
    r = wrongs.drop("pattern_id").join(questions, "question_id").join(patterns, "pattern_id", "left")
    r = r.withColumn("importance_score", F.coalesce(S.importance_score(F.col("grade"), F.col("importance"), F.col("stat_grade")), F.lit(0)))
    r = r.withColumn("wrong_days", S.days_since(F.col("last_wrong_at"), day)).withColumn("due", S.review_due(F.col("wrong_days"), F.col("wrong_count")))
    r = r.withColumn("priority_score", S.wrong_priority(F.col("wrong_count"), F.col("importance_score"), F.col("wrong_days")))
    r = r.withColumn("score", S.review_score(F.col("priority_score"), F.col("due"), S.type_factor(F.col("question_type"))))
    return r.withColumn("reasons", question_reasons())


def review(entries: DataFrame, limit: int = 8) -> DataFrame:
    return _ranked(entries, limit, F.desc("due"), F.desc("score"), F.col("question_id"))

"""Pattern and statistics tables, and lookups within patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pattern_table(questions: DataFrame, base: int = 55, step: int = 3) -> DataFrame:
    """(pattern_id, chapter_id, grade, frequency, years, importance); years are few, so they may be an array.

    The importance is base + step for each question, 95 at most; the first phase took 60 and 5.
    """
    t = questions.groupBy("pattern_id").agg(F.min_by("chapter_id", "question_id").alias("chapter_id"), F.count("*").alias("frequency"), F.array_sort(F.collect_set("year")).alias("years"))
    grade = F.when(F.col("frequency") >= 4, "S").when(F.col("frequency") >= 2, "A").otherwise("B")
    return t.withColumn("grade", grade).withColumn("importance", F.least(F.lit(95), base + step * F.col("frequency")))


def related_questions(questions: DataFrame) -> DataFrame:
    """(pattern_id, question_id) in order: rows, since a pattern may have any number of questions."""
    return questions.select("pattern_id", "question_id").orderBy("pattern_id", "question_id")


def statistics_table(patterns: DataFrame, since: int = 2022) -> DataFrame:
    priority = F.when(F.col("grade") == "S", "HIGH").when(F.col("grade") == "A", "MEDIUM").otherwise("LOW")
    return patterns.select("pattern_id", "chapter_id", F.col("frequency").alias("total_count"), "years", F.filter("years", lambda y: y >= since).alias("recent_years"), priority.alias("priority"), "grade")


def choice_histogram(choices: DataFrame, key: str) -> DataFrame:
    return choices.groupBy(key).agg(F.count("*").alias("choices")).groupBy("choices").agg(F.count("*").alias("n"))


def year_union(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(year, questions, answers) of the years of either side."""
    q = questions.groupBy("year").agg(F.count("*").alias("questions"))
    a = answers.groupBy("year").agg(F.count("*").alias("answers"))
    return q.join(a, "year", "full").select("year", F.coalesce("questions", F.lit(0)).alias("questions"), F.coalesce("answers", F.lit(0)).alias("answers"))


def next_in_pattern(questions: DataFrame, block: int = 4096) -> DataFrame:
    """(question_id, pattern_id, next_id): within blocks of ids, and from the end of a block to the next one's first."""
    q = questions.select("question_id", "pattern_id", F.floor(F.col("question_id") / block).alias("block"))
    inside = Window.partitionBy("pattern_id", "block").orderBy("question_id")
    blocks = q.groupBy("pattern_id", "block").agg(F.min("question_id").alias("first"))
    after = blocks.select("pattern_id", "block", F.lead("first").over(Window.partitionBy("pattern_id").orderBy("block")).alias("after"))
    here = q.withColumn("next_id", F.lead("question_id").over(inside)).join(after, ["pattern_id", "block"])
    return here.select("question_id", "pattern_id", F.coalesce("next_id", "after").alias("next_id"))


def similar_questions(questions: DataFrame, n: int = 3) -> DataFrame:
    """(question_id, similar_id, rank): the first n others of the pattern.

    Only the first n + 1 questions of a pattern can be anyone's first n, so no pairs within a pattern are made.
    """
    w = Window.partitionBy("pattern_id").orderBy("question_id")
    head = questions.withColumn("_turn", F.row_number().over(w)).where(F.col("_turn") <= n + 1)
    first = head.groupBy("pattern_id").agg(F.array_sort(F.collect_list("question_id")).alias("first"))
    others = F.slice(F.filter("first", lambda x: x != F.col("question_id")), 1, n)
    rows = questions.join(first, "pattern_id").select("question_id", F.posexplode(others).alias("rank", "similar_id"))
    return rows.select("question_id", "similar_id", (F.col("rank") + 1).alias("rank"))


def unlinked(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key), key, "left_anti")


def frequency_mismatch(patterns: DataFrame, questions: DataFrame) -> DataFrame:
    """Patterns whose stated frequency is not the number of their questions."""
    n = questions.groupBy("pattern_id").agg(F.count("*").alias("linked"))
    return patterns.join(n, "pattern_id", "left").select("pattern_id", "frequency", F.coalesce("linked", F.lit(0)).alias("linked")).where("frequency <> linked")


def year_grade() -> Column:
    """Build-readiness of a year from columns exam, extracted, five, keyed, expected."""
    c = F.col
    full = (c("extracted") == c("expected")) & (c("five") == c("expected"))
    return (
        F.when(~c("exam"), "F")
        .when(full & (c("keyed") == c("expected")), "A")
        .when(full & (c("keyed") > 0), "B")
        .when(full, "C")
        .when((c("extracted") >= 0.75 * c("expected")) & (c("five") >= 0.9 * c("extracted")), "C")
        .when(c("extracted") > 0, "D")
        .otherwise("F")
    )

"""Learning-model views over the driver's tables.

`events` becomes the event log of one learner, `part`/`orders`/`lineitem` become exam questions,
sessions and answers. The small question, pattern and statistics dimensions are ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dates of the event log end here; every "today" is a parameter.
ANCHOR = "2024-01-30"
N_QUESTIONS, PER_PATTERN = 144, 8
EVENT_TYPES = {"view": "question_start", "click": "question_answer", "signup": "tutor_view", "purchase": "exam_complete"}
GRADES, PRIORITIES = ("S", "A", "B", "C"), ("HIGH", "MEDIUM", "LOW")
QUESTION_TYPES = ("calculation", "mixed", "incorrect_statement", "concept")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cycle(values: tuple[str, ...], i: Column) -> Column:
    """The value at i modulo their number."""
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def learning_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_learning(read(spark, sf_dir, "events"))


def as_learning(e: DataFrame) -> DataFrame:
    """Raw events, from a table or a stream, as learning events."""
    kind = F.lit("other")
    for source, target in EVENT_TYPES.items():
        kind = F.when(F.col("event_type") == source, target).otherwise(kind)
    question = F.get_json_object("props", "$.k").cast("int")
    graded = (F.col("event_type") == "click") & (F.col("event_id") % 17 != 0)
    return e.select(
        "event_id",
        "user_id",
        "ts",
        F.to_date("ts").alias("date"),
        kind.alias("type"),
        question.alias("question_id"),
        F.floor(question / PER_PATTERN).cast("int").alias("pattern_id"),
        F.floor(F.col("value") + 0.5).cast("long").alias("duration"),
        F.when(graded, F.col("event_id") % 3 != 0).alias("correct"),
        (F.col("event_id") % 5 == 0).alias("used_tutor"),
    )


def questions(spark: SparkSession) -> DataFrame:
    i = F.col("id")
    return spark.range(N_QUESTIONS).select(i.cast("int").alias("question_id"), F.floor(i / PER_PATTERN).cast("int").alias("pattern_id"), cycle(QUESTION_TYPES, i).alias("question_type"), F.concat(F.lit("Question "), i.cast("string")).alias("question"))


def patterns(spark: SparkSession) -> DataFrame:
    """Patterns with their statistics: the two share their key and are read together everywhere."""
    i = F.col("id")
    return spark.range(N_QUESTIONS // PER_PATTERN).select(
        i.cast("int").alias("pattern_id"),
        F.concat(F.lit("Pattern "), i.cast("string")).alias("name"),
        cycle(GRADES, i).alias("grade"),
        (60 + (7 * i) % 36).cast("int").alias("importance"),
        (1 + i % 9).cast("int").alias("frequency"),
        cycle(GRADES, i).alias("stat_grade"),
        cycle(PRIORITIES, i).alias("priority"),
        (i % 4).cast("int").alias("recent_years"),
    )


def exam_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    key = F.col("p_partkey")
    return p.select(key.alias("question_id"), F.col("p_brand").alias("pattern_id"), F.col("p_type").alias("chapter_id"), (2015 + F.col("p_size") % 11).cast("int").alias("year"), (1 + key % 5).cast("int").alias("answer"), F.col("p_name").alias("question"))


def exam_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    selected = F.when(F.col("l_returnflag") != "N", (1 + F.col("l_quantity").cast("int") % 5).cast("int"))
    return li.select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("question_id"), selected.alias("selected"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")

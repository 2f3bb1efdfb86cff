"""Whole reports from one pass over the raw events: what several sections need is written once and read by all of them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from learnspark.operators import analytics as A
from learnspark.operators import quality, recommend, state
from learnspark.sources.files import kept

#: Columns of the events that the reports read.
NEEDED = ("event_id", "ts", "date", "type", "question_id", "pattern_id", "duration", "correct", "used_tutor")


def learner_base(events: DataFrame, questions: DataFrame, patterns: DataFrame) -> dict[str, DataFrame]:
    """events (their needed columns, the one pass), latest attempts, wrong streaks and pattern analytics, each written once."""
    own = kept(events.select(*NEEDED))
    latest, wrongs = kept(state.latest_attempts(own)), kept(state.wrong_streaks(own))
    return {"events": own, "latest": latest, "wrongs": wrongs, "analytics": kept(A.pattern_analytics(patterns, questions, latest, wrongs))}


def analytics_report(base: Mapping[str, DataFrame], patterns: DataFrame) -> dict[str, DataFrame]:
    return {
        "overall": A.overall_stats(base["latest"], base["wrongs"], base["analytics"], base["events"]),
        "dashboard": A.dashboard(base["analytics"]),
        "daily_trend": A.daily_trend(base["latest"]),
        "weak_top": A.weak_top(base["analytics"]),
        "vulnerability": A.vulnerability(patterns, base["wrongs"]),
    }


def timeline_report(base: Mapping[str, DataFrame], patterns: DataFrame, day: str) -> dict[str, DataFrame]:
    e = base["events"]
    spark = e.sparkSession
    return {
        "timeline": A.timeline_daily(spark, e, day),
        "timeline_accuracy": A.timeline_accuracy(spark, e, day),
        "timeline_summary": A.timeline_summary(spark, e, day),
        "tutor": A.tutor_usage(e),
        "hours": A.hour_histogram(spark, e, day),
        "weak_changes": A.weak_changes(e, patterns, day),
    }


def recommendation_report(base: Mapping[str, DataFrame], questions: DataFrame, patterns: DataFrame, day: str) -> dict[str, DataFrame]:
    metrics = kept(recommend.pattern_metrics(base["analytics"], questions, day))
    return {"daily": recommend.daily(metrics), "weak": recommend.weak(metrics), "review": recommend.review(recommend.review_entries(base["wrongs"], questions, patterns, day))}


def quality_report(found: DataFrame, names: DataFrame, key: str, by: str) -> dict[str, DataFrame]:
    """Crosstab, grade, and issues by a column of names (key, by), from issue rows (key, severity, category) written once."""
    issues = kept(found)
    return {"crosstab": quality.crosstab(issues), "grade": quality.grade(issues), "by": issues.join(names, key).groupBy(by).agg(F.count("*").alias("n"), F.count_distinct(key).alias("rows"))}


def long_form(sections: Mapping[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """(section, item, metric, value) of the numbers of all sections; item is the section's key column, blank where it is None."""
    out = None
    for name, (df, key) in sections.items():
        numbers = [c for c, kind in df.dtypes if c != key and kind in ("int", "bigint", "double")]
        cells = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers])
        item = F.col(key).cast("string") if key else F.lit("")
        part = df.select(F.lit(name).alias("section"), item.alias("item"), F.explode(cells).alias("x")).select("section", "item", "x.*")
        out = part if out is None else out.unionByName(part)
    return out

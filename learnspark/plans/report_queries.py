"""Whole reports as one long table each."""

from __future__ import annotations

from pyspark.sql import functions as F

from learnspark.operators import bundles, quality
from learnspark.plans import queries as Q
from learnspark.sources import model as M
from learnspark.sources import torn


def learner_report(spark, d):
    """Analytics, timeline and recommendations of the learner from one pass over the events."""
    q, p = M.questions(spark), M.patterns(spark)
    base = bundles.learner_base(M.learning_events(spark, d), q, p)
    a, t = bundles.analytics_report(base, p), bundles.timeline_report(base, p, M.ANCHOR)
    r = bundles.recommendation_report(base, q, p, M.ANCHOR)
    sections = {"overall": (a["overall"], None), "dashboard": (a["dashboard"], None), "daily_trend": (a["daily_trend"], "date"), "weak_top": (a["weak_top"].select("pattern_id", "weakness_score", "total_wrong"), "pattern_id")}
    sections |= {"vulnerability": (a["vulnerability"], "pattern_id"), "timeline": (t["timeline"], "date"), "timeline_accuracy": (t["timeline_accuracy"], "date"), "timeline_summary": (t["timeline_summary"], None), "tutor": (t["tutor"], None)}
    sections |= {"hours": (t["hours"].select("hour", "n"), "hour"), "weak_changes": (t["weak_changes"].select("pattern_id", "early_accuracy", "late_accuracy", "change", "late_answered"), "pattern_id")}
    sections |= {"daily": (r["daily"].select("rank", "pattern_id", "score"), "rank"), "weak": (r["weak"].select("rank", "pattern_id", "score", "total_wrong", "correct_percent"), "rank")}
    sections |= {"review": (r["review"].select("rank", "question_id", "wrong_count", "priority_score", "score"), "rank")}
    return bundles.long_form(sections)


def quality_report(spark, d):
    r = bundles.quality_report(Q.quality_issues(spark, d), M.documents(spark, d).select("doc_id", "source"), "doc_id", "source")
    return bundles.long_form({"crosstab": (r["crosstab"], "category"), "grade": (r["grade"], None), "by": (r["by"], "source")})


#: What a text gets behind it, by its number.
PLANTED = ("�", "Ã", "\x00", "A-12-3", "가ab나", ".가", "\n\n\n\n끝", "가W1", "page ( 3", "제3회", "")


def text_audit(spark, d):
    n = F.col("doc_id")
    planted = F.get(F.array(*map(F.lit, PLANTED)), F.pmod(n, F.lit(len(PLANTED))).cast("int"))
    text = F.when(n % 13 == 0, " \n").when(n % 3 == 0, F.concat("text", planted)).otherwise(F.concat(F.regexp_replace("text", r"\w{3,}", " "), planted))
    field = F.when(n % 4 == 0, "choices[1]").when(n % 4 == 1, "originalQuestion").otherwise("question")
    return quality.text_audit(torn.hangul(spark, d).select("doc_id", field.alias("field"), text.alias("text")), "doc_id")

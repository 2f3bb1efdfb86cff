"""Score and date expressions of the learning model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights, bases and intervals of the learning model.
GRADE_BASE = {"S": 100, "A": 80, "B": 60, "C": 40}
PRIORITY_BASE = {"HIGH": 100, "MEDIUM": 65, "LOW": 35}
TYPE_FACTOR = {"calculation": 1.15, "mixed": 1.1, "incorrect_statement": 1.0, "concept": 0.95}
REVIEW_DAYS = (1, 3, 7, 14, 30)
WEIGHTS = {"importance": 0.4, "weakness": 0.3, "recency": 0.2, "exam_probability": 0.1}


def rnd(x: Column, digits: int = 0) -> Column:
    """Half up, also for negatives, as a double."""
    scale = float(10**digits)
    return F.floor(x.cast("double") * scale + 0.5).cast("double") / scale


def rnd_int(x: Column) -> Column:
    return F.floor(x.cast("double") + 0.5).cast("long")


def percent(part: Column, whole: Column, empty: Column) -> Column:
    """Whole percent; `empty` where there is nothing to divide by."""
    return F.when(whole > 0, rnd_int(part / whole * 100)).otherwise(empty)


def chosen(values: dict[str, float], c: Column, other: Column) -> Column:
    out = None
    for k, v in values.items():
        out = F.when(c == k, F.lit(v)) if out is None else out.when(c == k, F.lit(v))
    return out.otherwise(other)


def days_since(ts: Column, day: str) -> Column:
    """Whole days from ts to noon of the day; below zero for the day's afternoon."""
    noon = F.unix_micros(F.lit(f"{day} 12:00:00").cast("timestamp"))
    return F.floor((noon - F.unix_micros(ts.cast("timestamp"))) / 86_400_000_000.0)


def importance_score(grade: Column, importance: Column, stat_grade: Column) -> Column:
    base = chosen(GRADE_BASE, grade, F.lit(50))
    norm = F.least(F.lit(100), F.greatest(F.lit(0), F.when(importance.isNull() | (importance == 0), F.lit(70)).otherwise(importance)))
    return rnd_int(base * 0.45 + norm * 0.35 + chosen(GRADE_BASE, stat_grade, base) * 0.2)


def weakness_score(percent_right: Column, wrongs: Column, wrong_questions: Column, answered: Column, total: Column) -> Column:
    missed = F.when(wrongs > 0, F.least(F.lit(50), wrongs * 12 + wrong_questions * 4)).otherwise(0)
    right = F.when((answered > 0) & (percent_right < 100), rnd_int((100 - percent_right) * 0.4)).otherwise(0)
    gap = F.when((total > 0) & (answered == 0), F.lit(25)).when((total > 0) & (answered < total), F.least(F.lit(20), (total - answered) * 4)).otherwise(0)
    return F.least(F.lit(100), missed + right + gap).cast("long")


def weakness_level(score: Column) -> Column:
    return F.when(score >= 60, "HIGH").when(score >= 35, "MEDIUM").otherwise("LOW")


def recency_score(study_days: Column, wrong_days: Column, wrongs: Column) -> Column:
    known = wrong_days.isNotNull() & (wrong_days >= 0)
    wrong = F.when(known, F.greatest(F.lit(0), 100 - wrong_days * 8) * 0.55).otherwise(0.0) + F.when(known & (wrongs >= 2) & (wrong_days <= 7), 15.0).otherwise(0.0)
    study = F.when(study_days.isNull() | (study_days < 0), F.lit(30.0)).when(study_days >= 14, F.least(F.lit(35.0), 10 + study_days * 0.8)).when(study_days >= 7, 20.0).when(study_days <= 1, 5.0).otherwise(0.0)
    return F.least(F.lit(100), rnd_int(wrong + study))


def exam_probability(priority: Column, frequency: Column, recent_years: Column) -> Column:
    base = chosen(PRIORITY_BASE, priority, F.lit(65))
    return F.least(F.lit(100), rnd_int(base * 0.5 + F.least(F.lit(100), frequency * 7) * 0.35 + F.least(F.lit(30), recent_years * 8) * 0.15))


def type_factor(kind: Column) -> Column:
    return chosen(TYPE_FACTOR, kind, F.lit(1.0))


def recommendation_score(importance: Column, weakness: Column, recency: Column, probability: Column, factor: Column) -> Column:
    weighted = importance * WEIGHTS["importance"] + weakness * WEIGHTS["weakness"] + recency * WEIGHTS["recency"] + probability * WEIGHTS["exam_probability"]
    return F.least(F.lit(100), rnd_int(weighted * factor))


def wrong_priority(wrongs: Column, importance: Column, days: Column) -> Column:
    fresh = F.when(days.isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(0.5), 1.2 - days * 0.04))
    return rnd(wrongs * (importance / 100) * fresh, 2)


def review_interval(wrongs: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, REVIEW_DAYS)), F.least(F.greatest(wrongs, F.lit(1)), F.lit(len(REVIEW_DAYS))).cast("int"))


def review_due(days: Column, wrongs: Column) -> Column:
    return F.coalesce(days.isNotNull() & (wrongs >= 1) & (days >= review_interval(wrongs)), F.lit(False))


def review_score(priority: Column, due: Column, factor: Column) -> Column:
    return F.least(F.lit(100), rnd_int(priority * 10 + F.when(due, 25).otherwise(0) + factor * 5))


def achievement(accuracy: Column) -> Column:
    return F.when(accuracy >= 90, "EXCELLENT").when(accuracy >= 70, "GOOD").when(accuracy >= 50, "FAIR").otherwise("WEAK")


def stars(importance: Column) -> Column:
    n = F.least(F.greatest(rnd_int(importance / 20), F.lit(1)), F.lit(5)).cast("int")
    return F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), 5 - n))


def study_time(minutes: Column) -> Column:
    """Hours and minutes as 'h시간 m분', as the model shows them."""
    h, m = F.floor(minutes / 60).cast("string"), rnd_int(minutes % 60).cast("string")
    return F.when(minutes < 1, "0분").when(minutes < 60, F.concat(m, F.lit("분"))).when(m == "0", F.concat(h, F.lit("시간"))).otherwise(F.concat(h, F.lit("시간 "), m, F.lit("분")))


def exam_time(seconds: Column) -> Column:
    pad = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    tail = F.concat(pad((seconds % 3600) / 60), F.lit(":"), pad(seconds % 60))
    return F.when(seconds >= 3600, F.concat(F.floor(seconds / 3600).cast("string"), F.lit(":"), tail)).otherwise(tail)


def url_part(c: Column) -> Column:
    """Percent-encoding with %20 for a space and the marks a URI component keeps."""
    out = F.regexp_replace(F.url_encode(c), r"\+", "%20")
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def wrong_date(day: Column) -> Column:
    """A date as 'y. M. d.'."""
    return F.date_format(day, "yyyy. M. d.")


def hour_label(hour: Column) -> Column:
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":00"))


def elapsed(limit: Column, remaining: Column) -> Column:
    return limit - remaining


def stable_id(*parts: Column) -> Column:
    """An id that is the same on every run: a hash of the natural key."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)

"""Reports over extraction and audit results: year feasibility, rollups, required fields, source comparison, samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from learnspark.functions import text as X
from learnspark.functions.scores import rnd
from learnspark.operators import extract
from learnspark.operators.content import year_grade
from learnspark.operators.quality import issues
from learnspark.sources.files import kept


def year_report(questions: DataFrame, expected: int, five: Column, keyed: Column) -> DataFrame:
    """(year, extracted, five, keyed, rate, grade): how far each year's questions are usable."""
    n = questions.groupBy("year").agg(F.count("*").alias("extracted"), F.count_if(five).alias("five"), F.count_if(keyed).alias("keyed"))
    n = n.withColumn("exam", F.lit(True)).withColumn("expected", F.lit(expected))
    return n.withColumn("rate", rnd(F.col("five") / F.col("extracted") * 100, 1)).withColumn("grade", year_grade()).drop("exam", "expected")


def recognition(years: DataFrame) -> DataFrame:
    """One row: years, ready years, questions, five-choice and keyed rates (0 where there are none)."""
    n = years.agg(F.count("*").alias("years"), F.count_if(F.col("grade").isin("A", "B")).alias("ready"), F.sum("extracted").alias("questions"), F.sum("five").alias("five"), F.sum("keyed").alias("keyed"))
    rate = lambda c: F.when(F.col("questions") > 0, rnd(F.col(c) / F.col("questions") * 100, 1)).otherwise(0.0)
    return n.select("years", "ready", "questions", rate("five").alias("five_rate"), rate("keyed").alias("keyed_rate"))


def issue_rollup(found: DataFrame) -> DataFrame:
    """(severity, category, n) with subtotals; nulls stand for all."""
    return found.rollup("severity", "category").agg(F.count("*").alias("n"))


def sparse_groups(rows: DataFrame, by: str, least: int) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n")).where(F.col("n") < least)


def required_fields(rows: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, missing): rows in which each field is null or blank."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    n = rows.agg(*[F.count_if(blank(c)).alias(c) for c in fields])
    return n.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, fields)), F.array(*[F.col(c) for c in fields]))).alias("field", "missing"))


def source_issues(pairs: DataFrame, key: str, question: str, source: str, letters: str = X.HANGUL, glued: int = 12) -> DataFrame:
    """Issues of a stored question against its source text: missing, truncated, numbers lost, runs glued together."""
    q, s = F.col(question), F.col(source)
    pairs = pairs.withColumn("_cover", extract.coverage(q, s))
    cover = F.col("_cover")
    lost = F.size(F.array_except(X.numbers(s), X.numbers(q)))
    there = F.trim(s) != ""
    run = lambda c: X.glued_run(F.replace(c, F.lit(" "), F.lit("")), letters)
    rules = [
        ("critical", "source_missing", F.coalesce(~there, F.lit(True))),
        ("critical", "stem_truncated", there & (cover < 0.55)),
        ("warning", "stem_short", there & (cover >= 0.55) & (cover < 0.75)),
        ("warning", "missing_numbers", there & (lost >= 3)),
        ("warning", "ocr_glued", there & (run(q) >= glued) & (run(q) > run(s) + 2)),
    ]
    return issues(pairs, key, rules)


def answer_pairs(texts: DataFrame, key: str, text: str, low: int, high: int) -> DataFrame:
    """(key, number, answer) of "number.answer" pairs in an answer text; the last of repeated numbers counts."""
    found = F.regexp_extract_all(text, F.lit(r"(\d{1,2})[.:)]\s*([1-5])(?!\d)"), 0)
    p = texts.select(key, F.posexplode(found).alias("at", "p"))
    p = p.select(key, "at", F.regexp_extract("p", r"^(\d+)", 1).cast("int").alias("number"), F.regexp_extract("p", r"(\d)$", 1).cast("int").alias("answer"))
    return p.where(F.col("number").between(low, high)).groupBy(key, "number").agg(F.max_by("answer", "at").alias("answer"))


def compact_answers(texts: DataFrame, key: str, text: str, low: int, high: int) -> DataFrame:
    """(key, number, answer) of triples "nna" in a text's digits run together, read from the offset of 0 to 3 that gives most.

    A fold over the digits: where two digits are a number in range and the third is 1 to 5, they are taken
    and skipped, else one digit is; the last of repeated numbers counts, the first of equal offsets.
    """
    digits = F.regexp_replace(text, r"\D", "")
    kind = "array<struct<number:int,answer:int>>"

    def read(offset: int) -> Column:
        def step(s: Column, i: Column) -> Column:
            n, a = digits.substr(i + 1, F.lit(2)).cast("int"), digits.substr(i + 3, F.lit(1)).cast("int")
            hit = (s["skip"] == 0) & n.between(low, high) & a.between(1, 5)
            new = F.concat(s["found"], F.array(F.struct(n.alias("number"), a.alias("answer"))))
            return F.struct(F.when(hit, 2).otherwise(F.greatest(s["skip"] - 1, F.lit(0))).alias("skip"), F.when(hit, new).otherwise(s["found"]).alias("found"))

        places = F.when(F.length(digits) >= offset + 3, F.sequence(F.lit(offset), F.length(digits) - 3)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, F.struct(F.lit(0).alias("skip"), F.array().cast(kind).alias("found")), step, lambda s: s["found"])

    tried = F.array(*[F.struct(F.size(F.array_distinct(F.transform(read(k), lambda x: x["number"]))).alias("n"), F.lit(-k).alias("k"), read(k).alias("found")) for k in range(4)])
    best = F.array_max(F.transform(tried, lambda t: F.struct(t["n"], t["k"], t["found"])))["found"]
    t = texts.select(key, F.posexplode(best).alias("at", "x"))
    return t.groupBy(key, F.col("x.number").alias("number")).agg(F.max_by("x.answer", "at").alias("answer"))


def stratified(rows: DataFrame, key: str, strata: Sequence[tuple[str, Column, int]], seed: str = "sample") -> DataFrame:
    """rows of a sample: from each stratum in turn its number of rows that no stratum before it picked; same for the same seed."""
    order = [F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), F.col(key)]
    # each a bounded top-n, no window over a whole stratum; what is picked already is a few rows
    out = None
    for name, fits, n in strata:
        pool = rows.where(fits)
        if out is not None:
            pool = pool.join(F.broadcast(out.select(key)), key, "left_anti")
        part = kept(pool.orderBy(*order).limit(n).withColumn("stratum", F.lit(name)))
        out = part if out is None else out.unionByName(part)
    return out


def pattern_fit(rows: DataFrame, by: str, text: str, keywords: Sequence[str]) -> DataFrame:
    """(by, fit): mean share of the keywords that a row's text holds."""
    words = F.array(*map(F.lit, keywords))
    share = F.size(F.filter(words, lambda w: F.contains(F.col(text), w))) / len(keywords)
    return rows.groupBy(by).agg(rnd(F.avg(share), 6).alias("fit"))


def percent_change(before: Column, after: Column) -> Column:
    """Change in percent with one decimal and sign; from zero it is the new value itself."""
    return F.when((before == 0) & (after == 0), "0%").when(before == 0, F.concat(F.lit("+"), after.cast("string"))).otherwise(F.format_string("%+.1f%%", rnd((after - before) / before * 100, 1)))


def first_of(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """The first row of each key."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("x")).select(*key, "x.*")


def same_sets(a: DataFrame, b: DataFrame, by: str, item: str) -> DataFrame:
    """(by, only_a, only_b): how many items of a group only one side has; groups without difference do not show."""
    left = a.select(by, item).distinct().withColumn("in_a", F.lit(True))
    right = b.select(by, item).distinct().withColumn("in_b", F.lit(True))
    n = left.join(right, [by, item], "full").groupBy(by).agg(F.count_if(F.col("in_b").isNull()).alias("only_a"), F.count_if(F.col("in_a").isNull()).alias("only_b"))
    return n.where("only_a > 0 or only_b > 0")


def submitted(details: DataFrame) -> DataFrame:
    """Attempt rows that a submitted session adds: answered, known questions only."""
    return details.where(F.col("known") & F.col("selected").isNotNull()).select("session_id", "question_id", "pattern_id", "selected", F.col("answer").alias("correct_answer"), "right")


def hourly(events: DataFrame) -> DataFrame:
    """(start, events, seconds) by tumbling hour."""
    return events.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("events"), F.sum("duration").alias("seconds")).select(F.col("w.start").alias("start"), "events", "seconds")


def scaled(rows: DataFrame, by: str, value: str) -> DataFrame:
    """rows plus `share` of the largest value (at least 1) of the group, as charts scale their bars."""
    top = rows.groupBy(F.col(by).alias("_by")).agg(F.greatest(F.max(value), F.lit(1)).alias("_top"))
    return rows.join(top, F.col(by) == F.col("_by")).withColumn("share", rnd(F.col(value) / F.col("_top"), 6)).drop("_by", "_top")


def latest_of_user(events: DataFrame) -> DataFrame:
    """(user_id, question_id, correct) of each user's last graded answer of a question."""
    g = events.where((F.col("type") == "question_answer") & F.col("correct").isNotNull())
    return g.groupBy("user_id", "question_id").agg(F.max(F.struct("ts", "event_id", "correct"))["correct"].alias("correct"))


def session_gaps(events: DataFrame, key: str = "user_id", minutes: int = 30) -> DataFrame:
    """(key, start, end, events): runs of a user's events without a longer gap."""
    w = F.session_window("ts", f"{minutes} minutes")
    return events.groupBy(key, w.alias("w")).agg(F.count("*").alias("events"), F.max("ts").alias("end")).select(key, F.col("w.start").alias("start"), "end", "events")


def running_total(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(value).over(w))

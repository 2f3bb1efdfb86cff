"""Steps over whole texts cost little more than reading them, and give what plain patterns give."""

import random
import time

import pytest
from pyspark.sql import functions as F

from learnspark.functions import choices, spacing, text
from learnspark.operators import extract, source_truth


def seconds(run):
    times = []
    for _ in range(3):
        start = time.perf_counter()
        run()
        times.append(time.perf_counter() - start)
    return min(times)


@pytest.mark.parametrize("step", [choices.before_choices, text.choice_marks])
def test_marks_are_found_as_fast_as_a_class_of_one_range(spark, step):
    texts = spark.range(0, 80, numPartitions=4).select(F.repeat(F.lit("words of a text "), 12_500).alias("t")).cache()
    texts.count()
    took = lambda c: seconds(lambda: texts.agg(F.max(c)).collect())
    assert took(F.length(step(F.col("t")).cast("string"))) < 5 * took(F.col("t").rlike("[①-⑤]").cast("int")) + 0.3
    texts.unpersist()


def test_share_of_spaces_is_two_short_passes(spark):
    texts = spark.range(0, 80, numPartitions=4).select(F.repeat(F.lit("은는이가 을를의에서, "), 12_500).alias("t")).cache()
    texts.count()
    took = lambda c: seconds(lambda: texts.agg(F.max(c)).collect())
    one = F.length(F.regexp_replace("t", rf"[{text.HANGUL}]+", ""))
    assert took(text.space_ratio(F.col("t"))) < 1.9 * took(one) + 0.1
    texts.unpersist()


def test_terms_cost_little_more_than_their_search():
    r = random.Random(3)
    texts = ["".join(r.choice("은는이가을를의에서로 ") for _ in range(3000)) for _ in range(60)]
    known = spacing.Terms(["은는", "이가을", "를의", "에서", "로은", "는이", "서로"], ["가을", "의에"])
    search = seconds(lambda: [list(known.automaton.iter(t)) for t in texts])
    assert seconds(lambda: [known.spaced(t) for t in texts]) < 5 * search


def test_slices_lie_on_their_pages(spark):
    t = "앞 41. 하나\f 둘 43. 셋\f\f넷 45. 다섯 44. 여섯\f80. 끝\f"
    got = {r.number: (r.body, r.page) for r in source_truth.slices(spark.createDataFrame([(1, t)], "year int, text string"), "year", "text").collect()}
    at = {n: t.index(f"{n}. ") for n in (41, 43, 44, 45, 80)}
    at[42] = (at[41] + at[43]) // 2
    places = sorted((p, n) for n, p in at.items())
    ends = [p for p, _ in places[1:]] + [len(t)]
    assert got == {n: (t[p:e].strip(" "), 1 + t[:p].count("\f")) for (p, n), e in zip(places, ends, strict=True)}


def test_only_undecided_texts_go_to_python(spark, monkeypatch):
    def never(*_):
        raise AssertionError("sent to Python")

    rows = spark.createDataFrame([("a b", "xAb", 2 / 3), ("", "x", 0.0), ("x", "", 1.0), ("ab", "cd", 0.0), ("q" * 30 + "z", "q" * 30, 1.0)], "a string, b string, c double")
    monkeypatch.setattr(extract, "_common", never)
    assert rows.select(extract.coverage(F.col("a"), F.col("b")).alias("x"), "c").where("x <> c or x is null").count() == 0
    again = extract.with_coverage(rows, "x", F.col("a"), F.col("b"))
    assert again.columns == ["a", "b", "c", "x"] and again.where("x <> c or x is null").count() == 0


def test_texts_are_searched_for_marks_once(spark):
    texts = spark.createDataFrame([(1, "40. 41. a 43. b 41. c 42x 44. d"), (2, "42. none"), (None, "41. a")], "year int, text string")
    marks = extract.interpolated(extract.markers(texts, "year", "text", 41, 80), "year")
    assert sorted(map(tuple, marks.collect())) == [(1, 41, 4), (1, 42, 7), (1, 43, 10), (1, 44, 26)]
    plan = marks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1

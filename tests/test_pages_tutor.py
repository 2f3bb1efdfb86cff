"""Page headers, whole bodies, tutor sections, gates and scans by hand-made examples."""

import pytest
from pyspark.sql import functions as F

from learnspark.functions import pages
from learnspark.operators import tutor
from learnspark.sources import files
from tests.test_exam_texts import one


@pytest.mark.parametrize(("text", "start"), [("앞 회계학 41. x", 2), ("앞 41. x", 2), ("141. 41.5 x", 0), ("", 0), (None, None)])
def test_subject_start(spark, text, start):
    assert one(spark, pages.subject_start, text) == start


def test_year_headers(spark):
    rows = one(spark, pages.year_sections, "a 2019년 제30회 b 2020년도 감정평가사 2021년 제3회")
    assert [tuple(r) for r in rows] == [(2019, 30, 2), (2020, None, 15), (2021, 3, 28)]
    assert one(spark, pages.year_sections, "none") == []
    year = lambda t: one(spark, pages.page_year, t)
    assert (year("2019년 제30회"), year("2019년 제30회 2020년도 감정평가사"), year("x")) == (2019, 2020, None)
    assert one(spark, lambda t: pages.from_marker(t, "2과목"), "머리 2과목: 회계학") == "2과목: 회계학"
    assert one(spark, lambda t: pages.from_marker(t, "2과목"), "머리") is None


def test_labels_pairs_and_cells(spark):
    assert [one(spark, lambda _, k=k: pages.choice_label(F.lit(k)), "") for k in (1, 5, 6)] == ["①", "⑤", "6"]
    assert one(spark, pages.year_amounts, "20×1년 W1,000 / 20x2년 W2,000.5") == ["20×1년 W1,000", "20x2년 W2,000.5"]
    assert one(spark, pages.year_amounts, "20×1년 W1,000") is None
    assert one(spark, pages.markdown_cells, "| a | b |\n| --- | --- |\n| 1 |  |\n") == [["a", "b"], ["1", ""]]


def test_bodies_in_order(spark):
    text = "매출은\n년과\n20×1\n20×2\n12,000\n이고 A-12-3-[1교시]\n끝"
    assert one(spark, pages.body_in_order, text) == "매출은 (20×1)년과 (20×2)년에 각각 12,000W 이고끝"
    assert one(spark, pages.question_text, "기말재고자산은\n얼마인가?") == "기말재고자산 은 얼마인 가?"
    assert one(spark, pages.question_text, None) == ""


def test_tutor_sections(spark):
    q = spark.createDataFrame([(1, "p"), (2, "p"), (3, "none")], "question_id int, pattern_id string")
    own = spark.createDataFrame([(2, "t", "own title", "own why", [], "own tip")], "question_id int, template_id string, title string, explanation string, steps array<string>, tip string")
    of = spark.createDataFrame([("p", "Name", None, "why", ["s1"], "tip")], "pattern_id string, name string, template_id string, explanation string, steps array<string>, tip string")
    t = spark.createDataFrame([("t", "T", "a=b", ["x"], "hook")], "template_id string, title string, formula string, steps array<string>, hook string")
    got = {r.question_id: r for r in tutor.merged(q, own, of, t, {"tip": "any", "explanation": "later"}).collect()}
    assert (got[1].title, got[1].explanation, got[1].steps, got[1].tip, got[1].has_override) == ("Name", "why", ["s1"], "tip", False)
    assert (got[2].title, got[2].explanation, got[2].steps, got[2].tip, got[2].has_override) == ("own title", "own why", ["[T] a=b", "x", "s1"], "own tip", True)
    assert (got[3].title, got[3].explanation, got[3].steps, got[3].tip) == ("none", "later", [], "any")


def test_gates(spark):
    rows = spark.range(10)
    found = tutor.gates(rows, {"half": (F.col("id") < 5, F.lit(True), 0.5), "few": (F.col("id") < 1, F.col("id") < 5, 0.5), "none": (F.lit(True), F.lit(False), 0.0)})
    assert {r.gate: (r.hits, r.total, r.rate, r.passed) for r in found.collect()} == {"half": (5, 10, 0.5, True), "few": (1, 5, 0.2, False), "none": (0, 0, 0.0, True)}
    assert not tutor.all_passed(found) and tutor.all_passed(found, ["half"])


def test_scans_and_keys(spark, tmp_path):
    (tmp_path / "terms.js").write_text("const TERMS = [\n 'ab', 'abc',\n 'ab'];\nconst PREFIXES = ['x'];")
    assert files.terms(spark, f"{tmp_path}/terms.js", "TERMS") == ["abc", "ab"] and files.terms(spark, f"{tmp_path}/terms.js", "PREFIXES") == ["x"]
    for name in ("ACC_1.json", "ACC_2.json", "other.json"):
        (tmp_path / name).write_text("{}")
    assert sorted(r.question_id for r in files.verified_ids(spark, str(tmp_path)).collect()) == ["ACC_1", "ACC_2"]
    store = f"{tmp_path}/store"
    assert files.stored_keys(spark, store) == []
    for key in ("b", "a"):
        files.write_table(spark.range(1), f"{store}/{key}")
    assert files.stored_keys(spark, store) == ["a", "b"]
    files.remove_key(spark, store, "b")
    files.remove_key(spark, store, "b")
    assert files.stored_keys(spark, store) == ["a"]

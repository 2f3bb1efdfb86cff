"""Slices of a source, what differs from it, pattern rules, file resolution and overrides, by hand-made examples."""

import json

import pytest
from pyspark.sql import functions as F

from learnspark.functions import patterns
from learnspark.operators import cleanup, source_truth
from learnspark.sources import files, resolve
from tests.test_exam_texts import one

MARKS = "① 가 ② 나 ③ 다 ④ 라 ⑤ 마"
TEXT = f"머리말 3. 앞\n41. 첫째 12,000원은? {MARKS}\f42. 둘째 20×1년 5.5%는? {MARKS}\n44. 넷째 ① 가"


def test_slices(spark):
    rows = {r.number: r for r in source_truth.slices(spark.createDataFrame([(2020, TEXT, "x")], "year int, text string, page string"), "year", "text").collect()}
    assert sorted(rows) == [41, 42, 43, 44]  # 43 lies between its neighbours
    assert rows[41].body.startswith("41. 첫째") and rows[41].page == 1 and rows[42].page == 2
    assert (rows[41].n_marks, rows[41].numbers, rows[41].units) == (5, ["12,000"], ["000원"])
    assert rows[42].numbers == ["5.5"] and "5.5%" in rows[42].units and len(rows[44].body_hash) == 16


QUESTIONS = "year int, number int, id string, stem string, original string, choices array<string>, has_table boolean, table string"


def found(spark, **q):
    five = ["가", "나", "다", "라", "마"]
    base = {"year": 2020, "number": 41, "id": "q", "stem": "첫째 12,000원은?", "original": "", "choices": five, "has_table": False, "table": None}
    row = {**base, **q}
    questions = spark.createDataFrame([tuple(row[c.split()[0]] for c in QUESTIONS.split(", "))], QUESTIONS)
    sources = source_truth.slices(spark.createDataFrame([(2020, TEXT)], "year int, text string"), "year", "text")
    return sorted(r.category for r in source_truth.source_issues(source_truth.compared(questions, sources, ["year", "number"]), "id").collect())


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        ({}, []),
        ({"year": 1999}, ["source_missing"]),
        ({"number": 44, "stem": "넷째"}, ["choice_markers_source"]),
        ({"choices": ["가"]}, ["choice_count"]),
        ({"choices": None}, ["choice_count"]),
        ({"stem": "첫"}, ["missing_units", "stem_truncated"]),
        ({"stem": "첫째 12,000원은? 가나다라마바사아자차카타파하"}, ["ocr_glued_hangul"]),
        ({"original": "한국산업인력공단"}, ["ocr_footer"]),
        ({"has_table": True}, ["table_empty"]),
        ({"has_table": True, "table": "한 줄"}, ["table_markdown"]),
        ({"has_table": True, "table": "| a |\n| --- |\n| b |"}, []),
        ({"has_table": True, "table": "a\tb\nc  d"}, []),
    ],
)
def test_source_issues(spark, change, expected):
    got = found(spark, **change)
    assert [x for x in got if x != "stem_truncated"] == [x for x in expected if x != "stem_truncated"]
    assert "stem_truncated" not in expected or "stem_truncated" in got


def lost(spark, stem, original="", choices=(), table=None):
    rows = spark.createDataFrame([("q", stem, original, [*choices], table)], "id string, stem string, original string, choices array<string>, table string")
    return sorted(r.category for r in source_truth.lost_on_the_way(rows, "id").collect())


def test_lost_on_the_way(spark):
    assert lost(spark, "( )년과 년에 얼마인가") == ["empty_paren_year", "missing_year_pair"]
    assert lost(spark, "20×1년 3월 4일 현재") == []
    assert lost(spark, "20×1년 3월 4일과 년 월 일") == ["missing_date_parts"]
    assert lost(spark, "얼마인가? 년 20×1 년 20×2") == ["choice_grid_header_in_stem"]
    assert lost(spark, "얼마", choices=["W1,000 W2,000", "W1"]) == ["merged_w_choice"]
    assert lost(spark, "같다", "같다", table="| a |") == ["stem_equals_original_with_table"]
    assert lost(spark, "가" * 201 + "①", "가" * 201 + "①") == ["possible_duplicate_stem_context"]
    assert lost(spark, None, None, table=None) == []


def test_patterns(spark):
    for text, expected, first in (
        ("FOB 선적지 인도", "ACC_INV_001", "ACC_INV_001"),
        ("매출원가와 선적", "ACC_INV_001", "ACC_INV_004"),
        ("CIF", "ACC_INV_002", "ACC_INV_002"),
        ("선입선출법", "ACC_INV_006", "ACC_INV_006"),
        ("선입선출 소매재고", "ACC_INV_006", "ACC_INV_007"),
        ("PER법", "ACC_INV_004", "ACC_INV_005"),
        ("리스부채", "ACC_LEASE_001", "ACC_INV_001"),
        ("재고자산", "ACC_GEN_001", "ACC_INV_004"),
        ("", "ACC_GEN_001", "ACC_INV_001"),
    ):
        assert (one(spark, patterns.classified, text).pattern_id, one(spark, patterns.first_phase, text)) == (expected, first)


def test_kinds(spark):
    kind = lambda stem, *choices: one(spark, lambda t: patterns.kind_of_question(t, F.array(*map(F.lit, choices))), stem)
    assert [kind("틀린 것은", "a"), kind("금액은", "a"), kind("고르면", "ㄱ, ㄴ"), kind("고르면", "가")] == ["incorrect_statement", "calculation", "mixed", "concept"]


def test_wrong_reasons(spark):
    def why(stem, choice, reasons, number=1, right=2):
        have = F.create_map(*[F.lit(x) for k in reasons for x in (k, f"r {k}")]) if reasons else F.create_map().cast("map<string,string>")
        return one(spark, lambda t: patterns.wrong_reason(t, F.lit(choice), F.lit(number), F.lit(right), have, F.array(*map(F.lit, reasons)).cast("array<string>")), stem)

    assert why("VAT 포함", "x", ["vat", "generic"]) == "r vat"
    assert why("x", "할인액", ["discount"]) == "r discount"
    assert why("실지재고", "x", ["method"]) == "r method"
    assert why("x", "12", ["formula", "calc"]) == "r calc"
    assert why("x", "y", ["generic"]) == "r generic"
    assert why("x", "y", ["avg", "trial"]) == "r trial"  # (1 + 2) % 2
    assert why("x", "y", []) == patterns.NO_REASON


def test_sources(spark, tmp_path):
    for name, text in (("2020.pdf", "p"), ("2020.hwp", "h"), ("2021.pdf", "p"), ("2020.json", json.dumps({"_note": "x", "41": 2, "42": None, "99": 1})), ("answers-2020.hwp", "a"), ("b-2021-2020.pdf", "b"), ("2020-1.txt", "c"), ("2020-2.txt", "d")):
        (tmp_path / name).write_text(text)
    listing, years = resolve.listing(spark, str(tmp_path)), spark.createDataFrame([(2020,), (2021,), (2022,)], "year int")
    assert [(r.year, r.kind, r.path and r.path.rsplit("/", 1)[1]) for r in resolve.exam_sources(listing, years).orderBy("year").collect()] == [(2020, "hwp", "2020.hwp"), (2021, "pdf", "2021.pdf"), (2022, None, None)]
    keys = files.answer_keys(spark, f"{tmp_path}/2020.json")
    got = {r.year: r for r in resolve.answer_sources(listing, keys, years).collect()}
    assert (got[2020].json_count, got[2020].json_path.endswith("2020.json"), got[2020].source_path.endswith("2020.hwp"), got[2020].source_kind) == (1, True, True, "hwp")
    assert got[2021].json_count == 0 and got[2021].source_path.endswith("2021.pdf") and got[2022].source_path is None
    assert {r.year: r.path and r.path[-10:] for r in resolve.caches(listing, years).collect()} == {2020: "2020-1.txt", 2021: None, 2022: None}
    texts = resolve.read_by_kind(spark, resolve.exam_sources(listing, years), {k: lambda s, paths: s.read.text(paths, wholetext=True) for k in ("pdf", "hwp")})
    assert sorted(r.value for r in texts.collect()) == ["h", "p"]
    with pytest.raises(ValueError, match="hwp"):
        resolve.read_by_kind(spark, resolve.exam_sources(listing, years), {"pdf": None})


def test_text_layer_and_cascade(spark):
    pages = spark.createDataFrame([("a", 1, "x" * 500), ("a", 2, "y" * 300), ("b", 1, " " * 900 + "z")], "path string, page int, text string")
    assert {r.path: r.text_layer for r in resolve.has_text_layer(pages, "path", "text").collect()} == {"a": True, "b": False}
    make = lambda *rows: spark.createDataFrame(rows, "year int, number int, answer int")
    got = resolve.cascaded([make((2020, 41, None), (2020, 42, 3)), make((2020, 41, 1), (2020, 42, 5)), make((2020, 43, 2))]).collect()
    assert sorted(map(tuple, got)) == [(2020, 41, 1, 1), (2020, 42, 3, 0), (2020, 43, 2, 2)]


def test_overrides_and_report(spark):
    rows = [(1, "기말재고자산10000원", "원문① 12345", "| a |", ["① 가", "나자산"], "kept"), (2, "둘째", "원문", None, None, "kept"), (3, "셋째", "원문", "표", ["가"], "kept")]
    q = spark.createDataFrame(rows, "question_id int, question string, original string, table string, choices array<string>, more string")
    over = spark.createDataFrame([(2, "새 글", None, "새 표", True), (3, None, "새 원문", None, True)], "question_id int, question string, original string, table string, has_table boolean")
    got = {r.question_id: r for r in cleanup.cleaned(q, over, terms=["재고자산", "자산"]).collect()}
    assert got[1].question == "기말 재고 자산 10,000원" and got[1].choices == ["가", "나 자산"] and got[1].table == "| a |" and got[1].more == "kept"
    assert (got[2].question, got[2].original, got[2].table, got[2].choices) == ("새 글", "새 글\n새 표", "새 표", None)
    assert (got[3].question, got[3].original, got[3].table) == ("셋째", "새 원문", None)
    assert cleanup.cleaned(q).columns == q.columns
    r = {x.metric: x for x in cleanup.report(q, cleanup.cleaned(q, over)).collect()}
    assert (r["bare_numbers"].before, r["bare_numbers"].after, r["bare_numbers"].change) == (2, 0, 100.0)
    assert cleanup.report(q.limit(0), q.limit(0)).where("metric = 'fields'").first().before == 0

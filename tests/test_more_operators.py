"""Operators that the registered queries do not show in full."""

import datetime

import pytest
from pyspark.sql import functions as F

from learnspark.functions import text as X
from learnspark.operators import analytics, content, extract, quality, records, state
from learnspark.sources import files
from learnspark.streaming import events as E

DAY = datetime.datetime(2024, 1, 1)


def test_study_time_cascade(spark):
    events = lambda *s: spark.createDataFrame([(x,) for x in s], "duration long")
    latest = spark.createDataFrame([(1,), (2,)], "question_id int")
    exams, recent = spark.createDataFrame([(120,)], "seconds long"), spark.createDataFrame([(10.0,), (5.5,)], "minutes double")
    minutes = lambda *a: state.study_time_estimate(*a).first().minutes
    assert minutes(events(600), latest, exams, recent) == 10
    assert minutes(events(0), latest, exams, recent) == 18
    assert minutes(events(), latest, exams, recent.limit(0)) == 7
    assert minutes(events(), latest, exams) == 7


def test_fullest_and_related(spark):
    rows = spark.createDataFrame([(1, 0, ["a"]), (1, 1, ["a", "b"]), (1, 2, ["c", "d"]), (2, 0, [])], "number int, page int, choices array<string>")
    assert sorted((r.number, r.page) for r in extract.fullest(rows, ["number"], "page").collect()) == [(1, 1), (2, 0)]
    q = spark.createDataFrame([("p", 2), ("o", 9), ("p", 1)], "pattern_id string, question_id int")
    assert [tuple(r) for r in content.related_questions(q).collect()] == [("o", 9), ("p", 1), ("p", 2)]


def test_table_rules(spark):
    rows = spark.createDataFrame([(1, True, ""), (2, True, "text"), (3, True, "| a |\n| --- |\n| b |"), (4, False, None)], "id int, has boolean, t string")
    found = quality.issues(rows, "id", quality.table_rules(F.col("has"), F.col("t"))).collect()
    assert {(r.id, r.category) for r in found if r.category in ("table_empty", "table_markdown")} == {(1, "table_empty"), (2, "table_markdown")}


def test_question_types(spark):
    rows = [("액면가치", True, ["a"]), ("표", True, ["a"]), ("x", False, ["ㄱ, ㄴ"]), ("계산하면", False, ["a"]), ("x", False, ["a"])]
    df = spark.createDataFrame(rows, "b string, t boolean, c array<string>")
    got = [r.k for r in df.select(X.question_type(F.col("b"), F.col("t"), F.col("c"), ["계산"]).alias("k")).collect()]
    assert got == ["table-bond", "table", "hangul-combo", "calculation", "standard"]


def test_events_once(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"
    rows = [(1, DAY, 1, "view", 1.0, "{}")] * 2 + [(2, DAY + datetime.timedelta(hours=1), 1, "view", 1.0, "{}")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame(rows[:1], schema).coalesce(1).write.parquet(f"{tmp_path}/in/b")
    stream = E.deduplicated(spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [1, 2]


def test_years_in_file_names(spark, tmp_path):
    for name in ("2019.pdf", "a-2020-x.txt", "none.txt"):
        (tmp_path / name).write_text("x")
    assert sorted(r.year for r in files.years_in(spark, str(tmp_path)).collect()) == [2019, 2020]


def test_vulnerability_of_every_pattern(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b")], "pattern_id int, name string")
    w = spark.createDataFrame([(9, 1, 3, DAY)], "question_id int, pattern_id int, wrong_count long, last_wrong_at timestamp")
    assert {r.pattern_id: (r.score, r.level) for r in analytics.vulnerability(p, w, True).collect()} == {1: (35, "HIGH"), 2: (0, "NONE")}
    assert analytics.vulnerability(p, w).count() == 1


def test_top_pattern_of_equals_is_the_first_seen(spark):
    at = lambda h: DAY + datetime.timedelta(hours=h)
    e = spark.createDataFrame([(1, at(2), 1), (2, at(1), 2), (3, at(3), 1), (4, at(4), 2)], "event_id long, ts timestamp, pattern_id int")
    e = e.withColumns({"date": F.to_date("ts"), "type": F.lit("question_answer"), "correct": F.lit(True)})
    p = spark.createDataFrame([(1, "a"), (2, "b")], "pattern_id int, name string")
    assert analytics.top_pattern(e, p, "2024-01-01").first().pattern_id == 2


@pytest.mark.parametrize(("stem", "table", "cause"), [("가나다라", None, None), ("가나", "가나다라", "table_handling"), ("가", None, "linebreak_handling"), ("가나", "가나", "linebreak_handling")])
def test_truncation_with_a_table(spark, stem, table, cause):
    df = spark.createDataFrame([("가나\n다라", stem, table, ["x"] * 5)], "b string, s string, t string, c array<string>")
    assert df.select(records.truncation_cause(F.col("b"), F.col("s"), F.col("c"), F.col("t")).alias("x")).first().x == cause


def test_stored_attempts_and_sessions(spark):
    a = spark.createDataFrame([(1, None), (2, True)], "question_id int, correct boolean")
    assert [tuple(r) for r in state.attempts_with_defaults(a, {"correct": False, "count": 0}).orderBy("question_id").collect()] == [(1, False, 0), (2, True, 0)]
    s = spark.createDataFrame([(1, 10, DAY, None), (1, 11, DAY + datetime.timedelta(1), None), (1, 12, DAY, DAY), (2, 20, DAY, DAY)], "user_id int, session_id int, started_at timestamp, submitted_at timestamp")
    assert [(r.user_id, r.session_id) for r in state.active_sessions(s).collect()] == [(1, 11)]


def test_small_operators(spark):
    df = spark.createDataFrame([(["b", "a"], None, ["a", "c"])], "x array<string>, y array<string>, z array<string>")
    assert df.select(records.united(F.col("x"), F.col("y"), F.col("z")).alias("u")).first().u == ["b", "a", "c"]
    n = records.checked(spark.range(4), {"even": F.col("id") % 2 == 0, "all": F.col("id") >= 0}).first()
    assert (n.rows, n.even, n.all_pass) == (4, 2, False)
    p = spark.createDataFrame([("p", 1)], "pattern_id string, frequency int")
    got = records.with_pattern(spark.createDataFrame([("p",), ("q",)], "pattern_id string"), p, {"frequency": 0}).collect()
    assert {r.pattern_id: r.frequency for r in got} == {"p": 1, "q": 0}
    assert spark.createDataFrame([(" a\x00 b\n",)], "t string").select(X.squeezed(F.col("t")).alias("t")).first().t == "a b"


def test_text_audit(spark):
    rows = [("a", "question", " "), ("b", "question", "가" * 12), ("c", "choices[1]", "가" * 12), ("d", "question", "가ab나 A-12-3"), ("e", "question", "가.나 다W1"), ("f", "question", None), ("g", "question", "�Ã")]
    got = {}
    for r in quality.text_audit(spark.createDataFrame(rows, "id string, field string, text string"), "id").collect():
        got.setdefault(r.id, []).append(r.category)
    assert {k: sorted(v) for k, v in got.items()} == {"a": ["question_empty"], "b": ["ocr_glued_hangul"], "d": ["ocr_footer", "ocr_fragment"], "e": ["ocr_currency", "ocr_punctuation"], "g": ["broken_char"] * 3}


def test_markdown_says_where_it_is_cut(spark):
    assert files.markdown(spark.range(3), "t", 2).splitlines()[-1] == "Only the first 2 rows are shown."
    assert "Only" not in files.markdown(spark.range(2), "t", 2)


def test_exam_record(spark):
    columns = "year int, number int, pattern_id string, chapter_id string, stem string, original string, choices array<string>, answer int, question_type string, has_table boolean, has_calculation boolean, has_figure boolean, markdown string, grid string, exam_round int, source_file string, source_kind string, page int, used_ocr boolean, more string"
    row = (2020, 7, "P", "C", "stem", "orig", ["a"], 3, "table", True, False, False, "", "x\ty", 31, "2020.pdf", "pdf", 4, False, "kept")
    q = records.exam_record(spark.createDataFrame([row, (None,) * 20], columns)).collect()
    r = q[0].record
    assert (r.questionId, r.subjectId, r.difficulty, r.answerIndex, r.table, r.formula, q[0].more) == ("ACC_2020_Q007", "ACC", "medium", 3, "x\ty", None, "kept")
    assert (r.source.type, r.source.examRound, r.source.questionNumber, r.source.sourceFile, r.source.page) == ("original_exam", 31, 7, "2020.pdf", 4)
    assert (r.solution.summary, r.solution.steps) == ("", []) and q[1].record.question is None


def test_missing_tables(spark):
    one = spark.range(1)
    found = records.table_errors({"master": one.withColumn("pdf_verified", F.lit(False)), "statistics": None, "questions": one}, spark, "master")
    assert sorted(map(tuple, found.collect())) == [("master", "not_verified"), ("statistics", "missing")]
    assert records.table_errors({"master": one.withColumn("pdf_verified", F.lit(True))}, spark, "master").count() == 0

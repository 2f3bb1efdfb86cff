"""File formats and streams."""

import datetime
import json

from pyspark.sql import functions as F

from learnspark.operators import state
from learnspark.plans.registry import QUERIES
from learnspark.sources import files
from learnspark.sources import model as M
from learnspark.streaming import events as E


def test_questions_in_both_shapes(spark, tmp_path):
    q = [{"questionId": "Q1", "year": 2020, "choices": ["a"], "answer": 1}]
    for name, value in (("a.json", q), ("b.json", {"questions": q}), ("c.json", {})):
        (tmp_path / name).write_text(json.dumps(value))
    assert files.questions_json(spark, str(tmp_path / "*.json")).select("questionId").count() == 2


def test_answer_keys_and_cascade(spark, tmp_path):
    (tmp_path / "2021.json").write_text(json.dumps({"_note": "x", "41": 2, "42": None, "99": 1}))
    keys = files.answer_keys(spark, str(tmp_path))
    assert keys.collect() == [(2021, 41, 2)]
    rows = spark.createDataFrame([(2021, 41, 2, 3), (2021, 41, 1, 4)], "year int, number int, priority int, answer int")
    assert files.answer_cascade(rows).first()["answer"] == 4


def test_sessions_of_three_shapes(spark):
    rows = ['[{"date":"2024-01-01","durationMinutes":2}]', '{"sessions":[{"date":"2024-01-02","durationMinutes":3}]}', '{"sessions":[],"totalMinutes":7}', "broken"]
    raw = spark.createDataFrame([(x,) for x in rows], "value string")
    assert files.sessions(raw).count() == 2
    assert files.session_total(raw).first()["minutes"] == 12.0


def test_pages_manifest_and_report(spark, tmp_path):
    (tmp_path / "x.txt").write_text("one\ftwo")
    assert [r.page for r in files.page_texts(spark, str(tmp_path)).orderBy("page").collect()] == [1, 2]
    manifest = spark.createDataFrame([("x.txt", "bad"), ("y.txt", "z")], "name string, sha256 string")
    assert [r.ok for r in files.frozen_files(spark, str(tmp_path), manifest).collect()] == [False, False]
    assert files.markdown(manifest, "T").splitlines()[2] == "| name | sha256 |"


def test_larger_table_wins(spark, tmp_path):
    path = str(tmp_path / "t")
    assert files.write_larger(spark.range(3).toDF("x"), path, spark)
    assert not files.write_larger(spark.range(2).toDF("x"), path, spark)
    assert spark.read.parquet(path).count() == 3


def test_stream_of_days_equals_batch(spark, sf_dir):
    streamed = {(r.date, r.events) for r in QUERIES["stream_daily"](spark, sf_dir).collect()}
    e = M.learning_events(spark, sf_dir)
    assert streamed == {(r.date, r.n) for r in e.groupBy("date").agg(F.count("*").alias("n")).collect()}


def test_upserted_state_equals_batch(spark, sf_dir, tmp_path):
    path = str(tmp_path / "state")
    learning = state.graded(E.learning_stream(E.event_stream(spark, sf_dir, "events.parquet")))
    learning.writeStream.foreachBatch(E.upsert_latest(spark, path)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = {(r.question_id, r.ts, r.correct) for r in E.upserted(spark, path).collect()}
    assert got == {(r.question_id, r.answered_at, r.correct) for r in QUERIES["latest_attempts"](spark, sf_dir).collect()}


def test_upsert_goes_on_after_a_restart(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = lambda *x: spark.createDataFrame(x, "question_id int, ts timestamp, event_id long, correct boolean")
    day = lambda n: datetime.datetime(2024, 1, n)
    E.upsert_latest(spark, path)(rows((1, day(1), 1, True), (2, day(5), 2, True)), 0)
    again = E.upsert_latest(spark, path)  # another driver
    for _ in range(2):  # the same batch twice
        again(rows((1, day(3), 3, False), (2, day(4), 4, False), (3, day(1), 5, True)), 1)
    again(rows((4, day(1), 6, True)), 2)
    assert sorted((r.question_id, r.event_id) for r in E.upserted(spark, path).collect()) == [(1, 3), (2, 2), (3, 5), (4, 6)]
    assert [n for n, _ in files.versions(spark, path)] == [1, 2]


def test_late_events(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"

    def put(*days):
        rows = [(i, d, 1, "view", 60.0, "{}") for i, d in enumerate(days)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        E.run_daily(spark, E.event_stream(spark, source), folder)

    first, last = datetime.datetime(2024, 1, 1, 9), datetime.datetime(2024, 3, 1, 9)
    put(first, datetime.datetime(2024, 2, 20, 9))
    put(last)
    put(first, datetime.datetime(2024, 2, 20, 10), last)  # the first is over 30 days late
    got = {str(r.date): (r.events, r.seconds) for r in E.upserted(spark, f"{folder}/days").collect()}
    assert got == {"2024-01-01": (1, 60), "2024-02-20": (2, 120), "2024-03-01": (2, 120)}


def test_data_sets_with_fallback(spark):
    from learnspark.operators import records as R

    assert R.chosen_dataset(None, "other", "phase1", "mvp", known=("mvp", "phase1"), default="mvp") == "phase1"
    assert R.chosen_dataset(None, known=("mvp",), default="mvp") == "mvp"
    sets = {n: R.load_set(lambda p: spark.range(int(p)), {"questions": c}, lambda q: q.where("id > 0")) for n, c in (("a", "1"), ("b", "3"))}
    wrong = lambda s: s["questions"].agg(F.count("*").alias("n")).where("n = 0")
    name, tables = R.load_valid(sets, ("a", "b"), wrong)
    assert name == "b" and tables["questions"].count() == 2

"""State by key in a stream: equal to the batch operators over restarts, late events and merges."""

import datetime
import tracemalloc

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from learnspark.operators import state as B
from learnspark.sources import files
from learnspark.sources import model as M
from learnspark.streaming import events as E
from learnspark.streaming import state as T

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def in_parts(spark, sf_dir, tmp_path_factory):
    """The event table as four files in order of time."""
    folder = str(tmp_path_factory.mktemp("events"))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    edges = [datetime.datetime(2024, 1, 1) + datetime.timedelta(days=k) for k in (0, 9, 17, 24, 60)]
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        rows.where((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(1).write.mode("append").parquet(f"{folder}/p{k}")
    return folder


def replayed(spark, in_parts, make, folder, keys, mode="update", **more):
    """The stream over growing inputs, each time as a new query on the same checkpoint."""
    source, out = f"{folder}/in", None
    for k in range(4):
        spark.read.schema(SCHEMA).parquet(f"{in_parts}/p{k}").coalesce(1).write.mode("append").parquet(source)
        out = T.run(spark, make(M.as_learning(E.event_stream(spark, source))), f"{folder}/out", keys, mode, **more)
    return out


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_timers(spark, sf_dir, in_parts, tmp_path):
    got = replayed(spark, in_parts, T.timers, str(tmp_path), ["event_id"], "append")
    assert rows_of(got.select("event_id", "question_id", "seconds")) == rows_of(B.answer_durations(M.learning_events(spark, sf_dir)).where("question_id is not null").select("event_id", "question_id", F.col("seconds").cast("long")))


def test_wrong_streaks(spark, sf_dir, in_parts, tmp_path):
    got = replayed(spark, in_parts, T.wrong_streaks, str(tmp_path), ["question_id"], merge_every=2)
    batch = B.wrong_streaks(M.learning_events(spark, sf_dir))
    assert rows_of(got.where("wrong_count > 0").select("question_id", "wrong_count", "last_wrong_at")) == rows_of(batch.select("question_id", "wrong_count", "last_wrong_at"))
    assert len(files.versions(spark, f"{tmp_path}/out/rows")) <= 2  # merged on the way


def test_newest_events(spark, sf_dir, in_parts, tmp_path):
    one = lambda e: T.newest_events(e.withColumn("user_id", F.lit(1).cast("long")), 100)
    got = replayed(spark, in_parts, one, str(tmp_path), ["user_id", "event_id"])
    assert {r.event_id for r in got.where("kept").collect()} == {r.event_id for r in B.retained(M.learning_events(spark, sf_dir), 100).collect()}


def test_newest_days(spark, sf_dir, in_parts, tmp_path):
    one = lambda e: T.newest_days(e.withColumn("user_id", F.lit(1).cast("long")), 10)
    got = replayed(spark, in_parts, one, str(tmp_path), ["user_id", "date"])
    batch = B.study_sessions(M.learning_events(spark, sf_dir), 10)
    assert rows_of(got.where("kept").select("date", F.round(F.col("seconds") / 60, 1))) == rows_of(batch.select("date", "minutes"))


def test_a_late_event_of_a_day_that_left(spark, tmp_path):
    source, out = f"{tmp_path}/in", None
    day = lambda n: datetime.datetime(2024, 1, n, 9)
    for k, (days, seconds) in enumerate((((1, 2, 3), 60.0), ((4,), 60.0), ((1, 3), 30.0))):
        rows = [(10 * k + i, day(n), 1, "view", seconds, "{}") for i, n in enumerate(days)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        out = T.run(spark, T.newest_days(M.as_learning(E.event_stream(spark, source)), 3), f"{tmp_path}/out", ["user_id", "date"])
    got = {r.date.day: (r.seconds, r.kept) for r in out.collect()}
    assert got == {1: (0, False), 2: (60, True), 3: (90, True), 4: (60, True)}


def test_only_changed_keys_are_written(spark, tmp_path):
    source = f"{tmp_path}/in"
    ask = lambda i, q, right: (i, datetime.datetime(2024, 1, 1, 9, i), 1, "click", 5.0, f'{{"k": {q}}}')
    for rows in ([ask(3 * i + 1, i, False) for i in range(9)], [ask(31, 5, False)]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        T.run(spark, T.wrong_streaks(M.as_learning(E.event_stream(spark, source))), f"{tmp_path}/out", ["question_id"])
    last = files.versions(spark, f"{tmp_path}/out/rows")[-1][1]
    assert spark.read.parquet(last).count() == 1


def test_nothing_yet(spark, tmp_path):
    assert T.current(spark, str(tmp_path), ["k"]) is None


def test_a_batch_that_runs_again(spark, tmp_path):
    put = T.changes(spark, str(tmp_path), ["k"], merge_every=3)
    rows = lambda *x: spark.createDataFrame(x, "k int, v string")
    for n, batch in ((0, [(1, "a"), (2, "b")]), (1, [(1, "c")]), (1, [(1, "c")]), (2, [(3, "d")]), (3, [(2, "e")])):
        put(rows(*batch), n)
    assert rows_of(T.current(spark, str(tmp_path), ["k"])) == [(1, "c"), (2, "e"), (3, "d")]


class Held:
    """A state store of one key for processors that run without Spark."""

    def __init__(self):
        self.list, self.map = [], {}
        self.getListState = self.getMapState = self.getValueState = lambda *_: self
        self.put = lambda x: setattr(self, "list", list(x))
        self.iterator = lambda: iter([((k,), v) for k, v in self.map.items()])
        self.updateValue = lambda k, v: self.map.__setitem__(k[0], v)
        self.removeKey = lambda k: self.map.pop(k[0])
        self.get, self.update, self.clear = (lambda: self.list), (lambda x: setattr(self, "list", x)), (lambda: setattr(self, "list", []))


def peak_mb(processor, rows):
    processor.init(Held())
    tracemalloc.start()
    out = sum(1 for _ in processor.handleInputRows((1,), rows, None))
    mb = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return out, mb


def test_a_trigger_of_many_rows_is_not_held():
    n, first = 60_000, datetime.date(2000, 1, 1)
    at = lambda i: i * 7919 % n  # noqa: E731  every place once, out of order
    rows = lambda: (Row(ts=at(i), event_id=i, date=first + datetime.timedelta(days=at(i) // 10), duration=1, type="question_start" if i % 2 else "question_answer", correct=i % 3 > 0) for i in range(n))
    out, mb = peak_mb(T.NewestEvents(500), rows())
    assert out == 500 and mb < 2
    out, mb = peak_mb(T.NewestDays(14), rows())
    assert out == 14 and mb < 2
    out, mb = peak_mb(T.Timers(), rows())
    assert out == n // 2 and mb < 8
    out, mb = peak_mb(T.WrongStreaks(), rows())
    assert out == 1 and mb < 8


def test_newest_days_out_of_order(spark, tmp_path):
    source = f"{tmp_path}/in"
    day = lambda n, h: datetime.datetime(2024, 1, n, h)
    rows = [(i, day(n, h), 1, "view", 10.0, "{}") for i, (n, h) in enumerate(((5, 9), (1, 8), (3, 7), (5, 3), (2, 1), (4, 6), (3, 23), (1, 2)))]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(source)
    got = T.run(spark, T.newest_days(M.as_learning(E.event_stream(spark, source)), 3), f"{tmp_path}/out", ["user_id", "date"])
    assert {r.date.day: (r.seconds, r.last_activity.hour, r.kept) for r in got.collect()} == {3: (20, 23, True), 4: (10, 6, True), 5: (20, 9, True)}

"""Learner state in a stream: question timers, wrong streaks, the newest events and the newest study days.

Each is a stateful operator with bounded state by key, which gives only what a trigger changed; the
rows of a key in one trigger are taken in order of (ts, event_id), times as microseconds. Newest events and days
hold no more of them than they keep, whatever a trigger brings; timers and streaks, whose result is that order,
hold packed numbers. Changes are appended, a folder a
batch, and read as the last change of each key, so no batch rewrites the table; every MERGE_EVERY
batches they are merged. A batch that runs again writes the same folder, and a restarted stream goes
on from its checkpoint.
"""

from __future__ import annotations

import heapq
import uuid
from array import array
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from learnspark.sources.files import remove, shared_folder, versions

#: Events kept for each learner, and days.
KEEP_EVENTS, KEEP_DAYS = 500, 30
MERGE_EVERY = 50


def _in_order(rows: Iterator[Row], flag: Callable[[Row], bool]) -> Iterator[tuple[int, int, bool]]:
    """(ts, event_id, flag) of the rows in order, from 17 bytes a row."""
    ts, ids, flags = array("q"), array("q"), array("b")
    for r in rows:
        ts.append(r.ts)
        ids.append(r.event_id)
        flags.append(bool(flag(r)))
    t, i = np.frombuffer(ts, np.int64), np.frombuffer(ids, np.int64)
    for k in np.lexsort((i, t)):
        yield ts[k], ids[k], flags[k] == 1


class Timers(StatefulProcessor):
    """Seconds from a question's last start to its answer; each start serves one answer."""

    def init(self, handle) -> None:
        self.started = handle.getValueState("started", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.started.get()
        at = held[0] if held else None
        for ts, event_id, starts in _in_order(rows, lambda r: r.type == "question_start"):
            if starts:
                at = ts
            else:
                yield Row(event_id=event_id, question_id=key[0], seconds=None if at is None else (ts - at + 500_000) // 1_000_000)
                at = None
        if at is None:
            self.started.clear()
        else:
            self.started.update((at,))

    def close(self) -> None:
        pass


class WrongStreaks(StatefulProcessor):
    """Wrong answers of a question since its last right one; a right answer deletes the state, given as a count of 0."""

    def init(self, handle) -> None:
        self.wrong = handle.getValueState("wrong", "n long, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = self.wrong.get()
        n, at = before if before else (0, None)
        for ts, _, correct in _in_order(rows, lambda r: r.correct):
            n, at = (0, None) if correct else (n + 1, ts)
        if n:
            self.wrong.update((n, at))
        else:
            self.wrong.clear()
        yield Row(question_id=key[0], wrong_count=n, last_wrong_at=at)

    def close(self) -> None:
        pass


class NewestEvents(StatefulProcessor):
    """A learner's newest events; one that leaves them is given once more with kept = False."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle) -> None:
        self.events = handle.getListState("events", "ts long, event_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = {(x[0], x[1]) for x in self.events.get()}
        newest = sorted(before)[-self.keep :]  # a heap of `keep` at most, its oldest first
        inside = set(newest)
        for r in rows:
            x = (r.ts, r.event_id)
            if x in inside or (len(newest) == self.keep and x < newest[0]):
                continue
            inside.add(x)
            if len(newest) < self.keep:
                heapq.heappush(newest, x)
            else:
                inside.remove(heapq.heappushpop(newest, x))
        kept = sorted(newest)
        self.events.put(kept)
        for x in kept:
            if x not in before:
                yield Row(user_id=key[0], event_id=x[1], kept=True)
        for x in sorted(before - inside):
            yield Row(user_id=key[0], event_id=x[1], kept=False)

    def close(self) -> None:
        pass


class NewestDays(StatefulProcessor):
    """Seconds spent on each of a learner's newest days; a day that leaves them is given once more with kept = False.

    A late event of a day that has left finds `keep` newer ones, so it is passed over: no order of the rows
    changes which days stay, and no more of them are held than stay.
    """

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle) -> None:
        self.days = handle.getMapState("days", "date date", "seconds long, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = {k[0]: (v[0], v[1]) for k, v in self.days.iterator()}
        days, changed = dict(held), {}  # of the changed days the last time in this trigger
        for r in rows:
            if r.duration > 0:
                if r.date not in days and len(days) >= self.keep:
                    oldest = min(days)
                    if r.date < oldest:
                        continue
                    del days[oldest]
                    changed.pop(oldest, None)
                seconds, _ = days.get(r.date, (0, 0))
                changed[r.date] = last = max(changed.get(r.date, r.ts), r.ts)
                days[r.date] = seconds + r.duration, last
        for day in sorted(changed.keys() | (held.keys() - days.keys())):
            if day in days:
                self.days.updateValue((day,), days[day])
                yield Row(user_id=key[0], date=day, seconds=days[day][0], last_activity=days[day][1], kept=True)
            elif day in held:
                self.days.removeKey((day,))
                yield Row(user_id=key[0], date=day, seconds=0, last_activity=held[day][1], kept=False)

    def close(self) -> None:
        pass


def _micros() -> Column:
    return F.unix_micros(F.col("ts").cast("timestamp")).alias("ts")


def timers(events: DataFrame) -> DataFrame:
    """(event_id, question_id, seconds) of each answer in a stream of learning events."""
    own = events.where(F.col("type").isin("question_start", "question_answer") & F.col("question_id").isNotNull()).select("question_id", _micros(), "event_id", "type")
    return own.groupBy("question_id").transformWithState(Timers(), "event_id long, question_id int, seconds long", "Append", "None")


def wrong_streaks(events: DataFrame) -> DataFrame:
    """(question_id, wrong_count, last_wrong_at) of each question that a trigger changed."""
    own = events.where("type = 'question_answer' and correct is not null and question_id is not null").select("question_id", _micros(), "event_id", "correct")
    changed = own.groupBy("question_id").transformWithState(WrongStreaks(), "question_id int, wrong_count long, last_wrong_at long", "Update", "None")
    return changed.withColumn("last_wrong_at", F.timestamp_micros("last_wrong_at"))


def newest_events(events: DataFrame, keep: int = KEEP_EVENTS) -> DataFrame:
    """(user_id, event_id, kept) of events that came to, or left, the newest `keep` of a learner."""
    return events.select("user_id", _micros(), "event_id").groupBy("user_id").transformWithState(NewestEvents(keep), "user_id long, event_id long, kept boolean", "Update", "None")


def newest_days(events: DataFrame, keep: int = KEEP_DAYS) -> DataFrame:
    """(user_id, date, seconds, last_activity, kept) of the days that a trigger changed among the newest `keep` of a learner."""
    own = events.where("duration > 0").select("user_id", _micros(), "event_id", "date", "duration")
    changed = own.groupBy("user_id").transformWithState(NewestDays(keep), "user_id long, date date, seconds long, last_activity long, kept boolean", "Update", "None")
    return changed.withColumn("last_activity", F.timestamp_micros("last_activity"))


def _numbered(spark: SparkSession, path: str) -> DataFrame | None:
    """The merged table and the changes after it, with the batch they are of."""
    merged, after = versions(spark, f"{path}/merged"), versions(spark, path)
    last = merged[-1][0] if merged else -1
    parts = [(n, f) for n, f in [*merged[-1:], *after] if n > last or (n, f) in merged]
    rows = None
    for n, f in parts:
        one = spark.read.parquet(f).withColumn("batch_", F.lit(n))
        rows = one if rows is None else rows.unionByName(one)
    return rows


def changes(spark: SparkSession, path: str, keys: Sequence[str], merge_every: int = MERGE_EVERY):
    """A foreachBatch function that writes a batch's changed rows, one of a key, under path; read them with `current`."""

    def apply(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/v{number}")
        old = versions(spark, path)
        if len(old) >= merge_every:
            current(spark, path, keys).write.mode("overwrite").parquet(f"{path}/merged/v{number}")
            for n, f in [*old[:-1], *versions(spark, f"{path}/merged")[:-1]]:
                remove(spark, f)

    return apply


def current(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame | None:
    """The last change of each key; None before the first batch."""
    rows = _numbered(spark, path)
    if rows is None:
        return None
    rest = [c for c in rows.columns if c not in {*keys, "batch_"}]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch_").alias("x"))
    return last.select(*keys, "x.*")


@contextmanager
def keyed_state(spark: SparkSession):
    """The state store that stateful operators by key need, for the streams started inside."""
    option = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(option, None)
    spark.conf.set(option, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(option, before) if before else spark.conf.unset(option)


def run(spark: SparkSession, changed: DataFrame, folder: str, keys: Sequence[str], mode: str = "update", merge_every: int = MERGE_EVERY) -> DataFrame | None:
    """Runs a stream of changes over what there is and returns the current rows."""
    with keyed_state(spark):
        query = changed.writeStream.outputMode(mode).foreachBatch(changes(spark, f"{folder}/rows", keys, merge_every))
        query.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return current(spark, f"{folder}/rows", keys)


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

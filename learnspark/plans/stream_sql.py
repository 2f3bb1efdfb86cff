"""The SQL of stream_queries for DuckDB: the same state by windows over the whole table."""

from __future__ import annotations

from learnspark.plans.oracle import rnd, sql

_MICROS = "(epoch_us(ts) - epoch_us(s)) / 1000000.0::DOUBLE"
ORACLE_SQL = {
    "stream_durations": sql(
        "le",
        f"""SELECT event_id, question_id, CAST(floor({_MICROS} + 0.5::DOUBLE) AS BIGINT) AS seconds FROM (
 SELECT *, CASE WHEN before = 'question_start' THEN lag(ts) OVER w END AS s FROM (
 SELECT *, lag(type) OVER w AS before FROM le WHERE type IN ('question_start', 'question_answer') AND question_id IS NOT NULL WINDOW w AS (PARTITION BY question_id ORDER BY ts, event_id))
 WINDOW w AS (PARTITION BY question_id ORDER BY ts, event_id)) WHERE type = 'question_answer'""",
    ),
    "stream_wrongs": sql("le g streak wrongs", "SELECT question_id, wrong_count, last_wrong_at FROM wrongs"),
    "stream_retained": sql("le", "SELECT user_id % 7 AS user_id, event_id FROM le QUALIFY row_number() OVER (PARTITION BY le.user_id % 7 ORDER BY ts DESC, event_id DESC) <= 500"),
    "stream_sessions": sql(
        "le",
        f"""SELECT user_id, d AS date, {rnd("s / 60.0::DOUBLE", 1)} AS minutes, last_activity FROM (SELECT user_id % 7 AS user_id, d, sum(duration) AS s, max(ts) AS last_activity FROM le WHERE duration > 0 GROUP BY 1, 2)
 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY d DESC) <= 14""",
    ),
}

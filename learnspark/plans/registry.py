"""Every query of the library by name, and its SQL."""

from __future__ import annotations

import inspect

from learnspark.plans import exam_queries, exam_sql, oracle, queries, record_queries, record_sql, report_queries, report_sql, stream_queries, stream_sql

QUERIES = {name: f for module in (queries, record_queries, exam_queries, stream_queries, report_queries) for name, f in vars(module).items() if inspect.isfunction(f) and f.__module__ == module.__name__ and not name.startswith("_")}
ORACLE_SQL = {**oracle.ORACLE_SQL, **record_sql.ORACLE_SQL, **exam_sql.ORACLE_SQL, **stream_sql.ORACLE_SQL, **report_sql.ORACLE_SQL}

__all__ = ["ORACLE_SQL", "QUERIES"]

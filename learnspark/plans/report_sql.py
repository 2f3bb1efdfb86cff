"""The SQL of report_queries for DuckDB: the sections' own SQL, one metric after the other."""

from __future__ import annotations

from learnspark.plans.exam_sql import HANGUL
from learnspark.plans.oracle import ORACLE_SQL as PARTS

_LEARNER = {
    "overall": ("overall_stats", None, "total_answered total_correct accuracy wrong_rate wrong_questions studied_patterns total_patterns minutes"),
    "dashboard": ("dashboard", None, "questions answered correct patterns_with_wrong patterns overall_percent"),
    "daily_trend": ("daily_trend", "date", "answered correct accuracy"),
    "weak_top": ("weak_top", "pattern_id", "weakness_score total_wrong"),
    "vulnerability": ("vulnerability", "pattern_id", "question_count total_wrong score"),
    "timeline": ("timeline_daily", "date", "minutes answered tutor_views"),
    "timeline_accuracy": ("timeline_accuracy", "date", "answered correct accuracy moving_average"),
    "timeline_summary": ("timeline_summary", None, "total_minutes total_answered days_active avg_accuracy usage_ratio"),
    "tutor": ("tutor_usage", None, "total_answered tutor_views tutor_used usage_ratio view_ratio"),
    "hours": ("hour_histogram", "hour", "n"),
    "weak_changes": ("weak_changes", "pattern_id", "early_accuracy late_accuracy change late_answered"),
    "daily": ("rec_daily", "rank", "pattern_id score"),
    "weak": ("rec_weak", "rank", "pattern_id score total_wrong correct_percent"),
    "review": ("rec_review", "rank", "question_id wrong_count priority_score score"),
}


def _long(sections: dict[str, tuple[str, str | None, str]]) -> str:
    parts = []
    for name, (query, key, metrics) in sections.items():
        item = f"CAST({key} AS VARCHAR)" if key else "''"
        cells = ", ".join(f"{{'metric': '{m}', 'value': CAST({m} AS DOUBLE)}}" for m in metrics.split())
        parts.append(f"SELECT '{name}' AS section, {item} AS item, unnest([{cells}]) AS x FROM ({query if ' ' in query else PARTS[query]})")
    return f"SELECT section, item, x.metric AS metric, x.value AS value FROM ({' UNION ALL '.join(parts)})"


_BY = f"SELECT source, count(*) AS n, count(DISTINCT doc_id) AS rows FROM ({PARTS['quality_issues']}) JOIN documents USING (doc_id) GROUP BY 1"
_C = "regexp_replace(text, '\\s+', '', 'g')"
_MARKS = [("critical", "broken_char", "contains(text, '�')"), ("critical", "broken_char", "contains(text, chr(0))")]
_MARKS += [("warning", "broken_char", f"contains(text, '{m}')") for m in ("Ã", "Â", "ï¿½", "�", "Ð", "Ñ")]
_MARKS += [("warning", "ocr_footer", f"regexp_matches(text, '{p}')") for p in (r"A-\d{2}-\d", r"한국산업", r"교시\s*-\[", r"(?i)page\s*\(", r"제\d+회")]
_RUNNING = [
    ("warning", "ocr_glued_hangul", f"regexp_matches({_C}, '[가-힣]{{12,}}')"),
    ("info", "ocr_fragment", "regexp_matches(text, '[가-힣][A-Za-z]{1,2}[가-힣]')"),
    ("info", "ocr_punctuation", "regexp_matches(text, '[.?][가-힣]')"),
    ("warning", "ocr_linebreak", r"regexp_matches(text, '\n{4,}')"),
    ("info", "ocr_currency", r"regexp_matches(text, '[가-힣]W\d')"),
]
_RULES = [(s, c, w) for s, c, w in _MARKS] + [(s, c, f"field IN ('question', 'originalQuestion') AND {w}") for s, c, w in _RUNNING]
_AUDIT = " UNION ALL ".join(f"SELECT doc_id, field, '{s}' AS severity, '{c}' AS category FROM f WHERE full_ AND {w}" for s, c, w in _RULES)
_PLANTED = "['�', 'Ã', chr(0), 'A-12-3', '가ab나', '.가', chr(10) || chr(10) || chr(10) || chr(10) || '끝', '가W1', 'page ( 3', '제3회', ''][doc_id % 11 + 1]"
TEXT_AUDIT = rf"""WITH {HANGUL}, g AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'choices[1]' WHEN doc_id % 4 = 1 THEN 'originalQuestion' ELSE 'question' END AS field,
 CASE WHEN doc_id % 13 = 0 THEN ' ' || chr(10) WHEN doc_id % 3 = 0 THEN t || {_PLANTED} ELSE regexp_replace(t, '\w{{3,}}', ' ', 'g') || {_PLANTED} END AS text FROM hangul),
f AS (SELECT *, NOT regexp_full_match(text, '\s*') AS full_ FROM g WHERE text IS NOT NULL)
SELECT doc_id, field, 'critical' AS severity, 'question_empty' AS category FROM f WHERE NOT full_ UNION ALL {_AUDIT}"""

ORACLE_SQL = {
    "learner_report": _long(_LEARNER),
    "quality_report": _long({"crosstab": ("quality_crosstab", "category", "critical warning info"), "grade": ("quality_grade", None, "critical warning info"), "by": (_BY, "source", "n rows")}),
    "text_audit": TEXT_AUDIT,
}

"""The SQL of each query for DuckDB, over the same tables.

WITH clauses stand for the model views; each query names those it needs.
"""

from __future__ import annotations

ANCHOR = "DATE '2024-01-30'"


def rnd(x: str, digits: int = 0) -> str:
    scale = f"1{'0' * digits}.0::DOUBLE"
    return f"(floor(({x})::DOUBLE * {scale} + 0.5::DOUBLE) / {scale})"


def rint(x: str) -> str:
    return f"CAST(floor(({x})::DOUBLE + 0.5::DOUBLE) AS BIGINT)"


def pct(part: str, whole: str, empty: str = "0") -> str:
    return f"CASE WHEN {whole} > 0 THEN {rint(f'({part})::DOUBLE / ({whole})::DOUBLE * 100')} ELSE {empty} END"


def grade(c: str, other: str = "50") -> str:
    return f"CASE {c} WHEN 'S' THEN 100 WHEN 'A' THEN 80 WHEN 'B' THEN 60 WHEN 'C' THEN 40 ELSE {other} END"


def days(ts: str) -> str:
    return f"CAST(floor((epoch_us(TIMESTAMP '2024-01-30 12:00:00') - epoch_us({ts})) / 86400000000.0::DOUBLE) AS BIGINT)"


VIEWS = {
    "le": """SELECT event_id, user_id, ts, CAST(ts AS DATE) AS d,
 CASE event_type WHEN 'view' THEN 'question_start' WHEN 'click' THEN 'question_answer' WHEN 'signup' THEN 'tutor_view' WHEN 'purchase' THEN 'exam_complete' ELSE 'other' END AS type,
 CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS INT) AS question_id, CAST(regexp_extract(props, '"k": ?([0-9]+)', 1) AS INT) // 8 AS pattern_id,
 CAST(floor(value + 0.5::DOUBLE) AS BIGINT) AS duration, CASE WHEN event_type = 'click' AND event_id % 17 <> 0 THEN event_id % 3 <> 0 END AS correct, event_id % 5 = 0 AS used_tutor FROM events""",
    "q": """SELECT CAST(i AS INT) AS question_id, CAST(i // 8 AS INT) AS pattern_id, ['calculation','mixed','incorrect_statement','concept'][i % 4 + 1] AS question_type, 'Question ' || i AS question FROM range(144) t(i)""",
    "p": """SELECT CAST(i AS INT) AS pattern_id, 'Pattern ' || i AS name, ['S','A','B','C'][i % 4 + 1] AS grade, CAST(60 + (7 * i) % 36 AS INT) AS importance, CAST(1 + i % 9 AS INT) AS frequency, ['S','A','B','C'][i % 4 + 1] AS stat_grade, ['HIGH','MEDIUM','LOW'][i % 3 + 1] AS priority, CAST(i % 4 AS INT) AS recent_years FROM range(18) t(i)""",
    "cal": f"SELECT CAST({ANCHOR} - CAST(i AS INT) AS DATE) AS date FROM range(14) t(i)",
    "g": "SELECT * FROM le WHERE type = 'question_answer' AND correct IS NOT NULL",
    "latest": "SELECT question_id, pattern_id, ts AS answered_at, correct FROM g QUALIFY row_number() OVER (PARTITION BY question_id ORDER BY ts DESC, event_id DESC) = 1",
    "streak": "SELECT *, coalesce(sum(CASE WHEN correct THEN 1 ELSE 0 END) OVER (PARTITION BY question_id ORDER BY ts DESC, event_id DESC), 0) AS later FROM g",
    "wrongs": "SELECT question_id, any_value(pattern_id) AS pattern_id, count(*) AS wrong_count, max(ts) AS last_wrong_at FROM streak WHERE later = 0 GROUP BY question_id",
    "daily": f"SELECT date, {rnd('coalesce(s, 0) / 60.0::DOUBLE', 1)} AS minutes, coalesce(a, 0) AS answered, coalesce(v, 0) AS tutor_views FROM cal LEFT JOIN (SELECT d, sum(duration) FILTER (duration > 0)::DOUBLE AS s, count(*) FILTER (type = 'question_answer') AS a, count(*) FILTER (type = 'tutor_view') AS v FROM le GROUP BY d) ON d = date",
    "acc0": f"SELECT date, coalesce(n, 0) AS answered, coalesce(c, 0) AS correct, {pct('coalesce(c, 0)', 'coalesce(n, 0)', 'NULL')} AS accuracy FROM cal LEFT JOIN (SELECT d, count(*) AS n, count(*) FILTER (correct) AS c FROM g GROUP BY d) ON d = date",
    "acc": f"SELECT *, {rnd('avg(accuracy) OVER (ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 1)} AS moving_average FROM acc0",
    "tutor": f"SELECT *, {pct('tutor_used', 'total_answered')} AS usage_ratio, {pct('tutor_views', 'total_answered')} AS view_ratio FROM (SELECT count(*) FILTER (type = 'question_answer') AS total_answered, count(*) FILTER (type = 'tutor_view') AS tutor_views, count(*) FILTER (type = 'question_answer' AND used_tutor) AS tutor_used FROM le)",
    "solving": "SELECT le.* FROM le JOIN cal ON d = date WHERE type IN ('question_answer', 'question_start')",
    "hours": "SELECT CAST(i AS INT) AS hour, coalesce(n, 0) AS n FROM range(24) t(i) LEFT JOIN (SELECT hour(ts) AS h, count(*) AS n FROM solving GROUP BY 1) ON h = i",
    "prog": f"SELECT q.pattern_id, count(*) AS total, count(answered_at) AS answered, count(*) FILTER (correct) AS correct, max(answered_at) AS last_study_at, {pct('count(*) FILTER (correct)', 'count(answered_at)')} AS correct_percent FROM q LEFT JOIN latest USING (question_id) GROUP BY q.pattern_id",
    "wp": "SELECT pattern_id, count(*) AS question_count, CAST(sum(wrong_count) AS BIGINT) AS total_wrong, max(last_wrong_at) AS last_wrong_at FROM wrongs GROUP BY pattern_id",
    "an0": "SELECT p.*, coalesce(total, 0) AS total, coalesce(answered, 0) AS answered, coalesce(correct, 0) AS correct, coalesce(correct_percent, 0) AS correct_percent, coalesce(question_count, 0) AS question_count, coalesce(total_wrong, 0) AS total_wrong, last_study_at, last_wrong_at FROM p LEFT JOIN prog USING (pattern_id) LEFT JOIN wp USING (pattern_id)",
    "an1": f"SELECT *, least(100, CASE WHEN total_wrong > 0 THEN least(50, total_wrong * 12 + question_count * 4) ELSE 0 END + CASE WHEN answered > 0 AND correct_percent < 100 THEN {rint('(100 - correct_percent) * 0.4::DOUBLE')} ELSE 0 END + CASE WHEN total > 0 AND answered = 0 THEN 25 WHEN total > 0 AND answered < total THEN least(20, (total - answered) * 4) ELSE 0 END) AS weakness_score FROM an0",
    "an": "SELECT *, CASE WHEN weakness_score >= 60 THEN 'HIGH' WHEN weakness_score >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS weakness_level FROM an1",
    "vul": "SELECT pattern_id, name, question_count, total_wrong, total_wrong * 10 + question_count * 5 AS score, CASE WHEN total_wrong >= 3 OR total_wrong * 10 + question_count * 5 >= 35 THEN 'HIGH' WHEN total_wrong >= 2 OR total_wrong * 10 + question_count * 5 >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM p JOIN wp USING (pattern_id)",
    "ent": "SELECT question_id, q.pattern_id, question, name AS pattern, wrong_count, last_wrong_at FROM wrongs JOIN q USING (question_id) LEFT JOIN p ON p.pattern_id = q.pattern_id",
    "dom": "SELECT pattern_id, question_type FROM (SELECT pattern_id, question_type, count(*) AS n, min(question_id) AS f FROM q GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY pattern_id ORDER BY n DESC, f) = 1",
    "m0": f"SELECT an.*, question_type, {days('last_study_at')} AS study_days, {days('last_wrong_at')} AS wrong_days, {rint(f'({grade("grade")}) * 0.45::DOUBLE + least(100, greatest(0, CASE WHEN importance = 0 THEN 70 ELSE importance END)) * 0.35::DOUBLE + ({grade("stat_grade", grade("grade"))}) * 0.2::DOUBLE')} AS importance_score, least(100, {rint("(CASE priority WHEN 'HIGH' THEN 100 WHEN 'MEDIUM' THEN 65 WHEN 'LOW' THEN 35 ELSE 65 END) * 0.5::DOUBLE + least(100, frequency * 7) * 0.35::DOUBLE + least(30, recent_years * 8) * 0.15::DOUBLE")}) AS exam_probability FROM an LEFT JOIN dom USING (pattern_id)",
    "m1": f"SELECT *, least(100, {rint('CASE WHEN wrong_days >= 0 THEN greatest(0, 100 - wrong_days * 8) * 0.55::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN wrong_days >= 0 AND total_wrong >= 2 AND wrong_days <= 7 THEN 15.0::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN study_days IS NULL OR study_days < 0 THEN 30.0::DOUBLE WHEN study_days >= 14 THEN least(35.0::DOUBLE, 10 + study_days * 0.8::DOUBLE) WHEN study_days >= 7 THEN 20.0::DOUBLE WHEN study_days <= 1 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END')}) AS recency_score FROM m0",
    "m": f"SELECT *, least(100, {rint("(importance_score * 0.4::DOUBLE + weakness_score * 0.3::DOUBLE + recency_score * 0.2::DOUBLE + exam_probability * 0.1::DOUBLE) * (CASE coalesce(question_type, 'mixed') WHEN 'calculation' THEN 1.15::DOUBLE WHEN 'mixed' THEN 1.1::DOUBLE WHEN 'concept' THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END)")}) AS score FROM m1",
    "r0": f"SELECT wrongs.question_id, wrong_count, question_type, {days('last_wrong_at')} AS wrong_days, {rint(f'({grade("grade")}) * 0.45::DOUBLE + importance * 0.35::DOUBLE + ({grade("stat_grade")}) * 0.2::DOUBLE')} AS importance_score FROM wrongs JOIN q USING (question_id) JOIN p ON p.pattern_id = q.pattern_id",
    "r1": f"SELECT *, wrong_days >= [1, 3, 7, 14, 30][least(greatest(wrong_count, 1), 5)] AS due, {rnd('wrong_count * (importance_score::DOUBLE / 100) * greatest(0.5::DOUBLE, 1.2::DOUBLE - wrong_days * 0.04::DOUBLE)', 2)} AS priority_score FROM r0",
    "r": f"SELECT *, least(100, {rint("priority_score * 10 + CASE WHEN due THEN 25 ELSE 0 END + (CASE question_type WHEN 'calculation' THEN 1.15::DOUBLE WHEN 'mixed' THEN 1.1::DOUBLE WHEN 'concept' THEN 0.95::DOUBLE ELSE 1.0::DOUBLE END) * 5")}) AS score FROM r1",
    "eq": "SELECT p_partkey AS question_id, p_brand AS pattern_id, p_type AS chapter_id, CAST(2015 + p_size % 11 AS INT) AS year, CAST(1 + p_partkey % 5 AS INT) AS answer, p_name AS question FROM part",
    "ea": "SELECT l_orderkey AS session_id, l_linenumber AS number, l_partkey AS question_id, CASE WHEN l_returnflag <> 'N' THEN CAST(1 + CAST(trunc(l_quantity) AS INT) % 5 AS INT) END AS selected FROM lineitem",
    "ed": "SELECT ea.*, pattern_id, year, answer, eq.question_id IS NOT NULL AS known, coalesce(selected = answer, false) AS \"right\" FROM ea LEFT JOIN eq USING (question_id)",
    "eg": f"SELECT *, total - answered AS unanswered, {rnd('correct::DOUBLE / total::DOUBLE * 100', 1)} AS accuracy, {pct('correct', 'total', 'NULL')} AS score, {pct('correct', 'total', 'NULL')} >= 60 AS passed FROM (SELECT session_id, count(*) AS total, count(*) FILTER (known AND selected IS NOT NULL) AS answered, count(*) FILTER (\"right\") AS correct FROM ed GROUP BY session_id)",
    "esp": f"SELECT *, {rnd('correct::DOUBLE / total::DOUBLE * 100', 1)} AS accuracy FROM (SELECT session_id, pattern_id, count(*) AS total, count(selected) AS answered, count(*) FILTER (\"right\") AS correct FROM ed WHERE known GROUP BY ALL)",
    "ew": "SELECT session_id, pattern_id, accuracy, CASE WHEN accuracy < 50 THEN 'below_50' WHEN accuracy < 70 THEN 'below_70' ELSE 'some_wrong' END AS reason, CAST(row_number() OVER (PARTITION BY session_id ORDER BY accuracy, pattern_id) AS INT) AS rank FROM esp WHERE accuracy < 70 OR correct < total QUALIFY rank <= 5",
    "pt": "SELECT pattern_id, arg_min(chapter_id, question_id) AS chapter_id, count(*) AS frequency, list_sort(list_distinct(list(year))) AS years, CASE WHEN count(*) >= 4 THEN 'S' WHEN count(*) >= 2 THEN 'A' ELSE 'B' END AS grade, least(95, 55 + 3 * count(*)) AS importance FROM eq GROUP BY pattern_id",
}
VIEWS["lines"] = "SELECT doc_id, unnest(range(1, len(lines) + 1)) AS page, unnest(lines) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)"
VIEWS["seg"] = "SELECT doc_id, CAST(page AS INT) AS page, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(length(text) AS INT) AS length FROM lines"
FOOT = r"regexp_replace(regexp_replace(regexp_replace(text, '\n?[ ]*All rights reserved[^\n]*', '', 'g'), '\n?[ ]*This work is licensed[^\n]*', '', 'g'), '^\s+|\s+$', '', 'g')"
HASFOOT = r"regexp_matches(text, '\n?[ ]*All rights reserved[^\n]*') OR regexp_matches(text, '\n?[ ]*This work is licensed[^\n]*')"
COMPACT_RUN = r"coalesce(list_max(list_transform(regexp_extract_all(regexp_replace(text, '\s+', '', 'g'), '[a-zA-Z]+'), lambda x: length(x))), 0)"
RUN = r"coalesce(list_max(list_transform(regexp_split_to_array(text, '\s+'), lambda x: length(regexp_replace(x, '[^a-zA-Z]', '', 'g')))), 0)"
BLANK = r"(text IS NULL OR regexp_full_match(text, '\s*'))"
VIEWS["iss"] = " UNION ALL ".join(
    f"SELECT doc_id, '{s}' AS severity, '{c}' AS category FROM documents WHERE {w}"
    for s, c, w in (
        ("critical", "question_empty", BLANK),
        ("critical", "broken_char", "contains(text, chr(65533))"),
        ("warning", "mojibake", "contains(text, 'Ã') OR contains(text, 'Â') OR contains(text, 'ï¿½') OR contains(text, 'Ð') OR contains(text, 'Ñ')"),
        ("warning", "ocr_footer", HASFOOT),
        ("warning", "ocr_glued", f"{COMPACT_RUN} >= 20"),
        ("info", "ocr_punctuation", "regexp_matches(text, '[.?][a-zA-Z]')"),
        ("warning", "ocr_linebreak", r"regexp_matches(text, '\n{4,}')"),
        ("warning", "question_short", f"NOT {BLANK} AND length(trim(text)) < 8"),
    )
)
VIEWS["read"] = rf"SELECT doc_id, {RUN} AS longest_run, CASE WHEN length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) > 0 THEN {rnd(r"length(regexp_replace(text, '[^\s]', '', 'g'))::DOUBLE / length(regexp_replace(text, '[^a-zA-Z]', '', 'g'))::DOUBLE", 6)} ELSE 0.0::DOUBLE END AS space_ratio, CAST(len(regexp_extract_all(regexp_replace(text, '\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?', '', 'g'), '\d{{4,}}')) AS INT) AS unformatted FROM documents"
#: Views each view reads.
USES = {
    "g": ["le"], "latest": ["g"], "streak": ["g"], "wrongs": ["streak"], "daily": ["cal", "le"], "acc0": ["cal", "g"], "acc": ["acc0"], "tutor": ["le"], "solving": ["le", "cal"], "hours": ["solving"], "prog": ["q", "latest"], "wp": ["wrongs"],
    "an0": ["p", "prog", "wp"], "an1": ["an0"], "an": ["an1"], "vul": ["p", "wp"], "ent": ["wrongs", "q", "p"], "dom": ["q"], "m0": ["an", "dom"], "m1": ["m0"], "m": ["m1"], "r0": ["wrongs", "q", "p"], "r1": ["r0"], "r": ["r1"],
    "ed": ["ea", "eq"], "eg": ["ed"], "esp": ["ed"], "ew": ["esp"], "pt": ["eq"], "seg": ["lines"],
}


def sql(views: str, body: str) -> str:
    order: list[str] = []

    def add(v: str) -> None:
        for u in USES.get(v, []):
            add(u)
        if v not in order:
            order.append(v)

    for v in views.split():
        add(v)
    return (f"WITH {', '.join(f'{v} AS ({VIEWS[v]})' for v in order)} " if order else "") + body


S_ = "list_aggregate(list_filter([{}], lambda x: x IS NOT NULL)[1:4], 'string_agg', '|')"
PATTERN_REASONS = S_.format(
    "CASE grade WHEN 'S' THEN 'S급 핵심 Pattern' WHEN 'A' THEN 'A급 중요 Pattern' END, CASE WHEN priority = 'HIGH' THEN '출제 빈도 HIGH' END, CASE WHEN total_wrong >= 3 THEN '최근 ' || total_wrong || '회 오답' WHEN total_wrong >= 1 THEN '오답 기록 있음' END,"
    " CASE WHEN correct_percent < 60 THEN '정답률 ' || correct_percent || '%' END, CASE WHEN study_days IS NULL THEN '아직 학습하지 않은 Pattern' WHEN study_days >= 14 THEN '마지막 학습 ' || study_days || '일 전' WHEN study_days >= 7 THEN '1주 이상 복습 간격' END, CASE WHEN importance_score >= 85 THEN 'Pattern 중요도 상위' END"
)
QUESTION_REASONS = S_.format(
    "CASE WHEN wrong_count >= 3 THEN '반복 실패 ' || wrong_count || '회' WHEN wrong_count >= 2 THEN '오답 ' || wrong_count || '회' ELSE '오답 1회' END, CASE WHEN due THEN '복습 주기 도래' END, CASE WHEN wrong_days <= 3 THEN '최근 오답' END,"
    " CASE question_type WHEN 'calculation' THEN '계산형 — AI Tutor 권장' WHEN 'mixed' THEN '혼합형 문항' END, CASE WHEN importance_score >= 80 THEN '고중요 Pattern 소속' END"
)
NUMBERS = r"list_distinct(regexp_extract_all({}, '\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+\.\d+|\d{{3,}}'))"
GONE = f"list_filter({NUMBERS.format('text')}, lambda x: NOT list_contains({NUMBERS.format("split_part(text, chr(10), 1)")}, x))"

ORACLE_SQL = {
    "timeline_daily": sql("daily", "SELECT * FROM daily"),
    "timeline_accuracy": sql("acc", "SELECT * FROM acc"),
    "timeline_summary": sql("daily acc tutor", f"SELECT total_minutes, total_answered, days_active, avg_accuracy, usage_ratio, CASE WHEN total_minutes < 1 THEN '0분' WHEN total_minutes < 60 THEN total_minutes || '분' WHEN total_minutes % 60 = 0 THEN total_minutes // 60 || '시간' ELSE total_minutes // 60 || '시간 ' || total_minutes % 60 || '분' END AS total_time FROM (SELECT {rint('sum(minutes)')} AS total_minutes, CAST(sum(answered) AS BIGINT) AS total_answered, count(*) FILTER (minutes > 0 OR answered > 0) AS days_active FROM daily), (SELECT coalesce({rint('avg(accuracy)')}, 0) AS avg_accuracy FROM acc), (SELECT usage_ratio FROM tutor)"),
    "tutor_usage": sql("tutor", "SELECT * FROM tutor"),
    "tutor_daily": sql("daily", "SELECT date, tutor_views FROM daily"),
    "hour_histogram": sql("hours", "SELECT * FROM hours"),
    "peak_hour": sql("hours", "SELECT * FROM hours WHERE n > 0 ORDER BY n DESC, hour LIMIT 1"),
    "top_pattern": sql("solving p", "SELECT s.pattern_id, name, n FROM (SELECT pattern_id, count(*) AS n FROM solving WHERE pattern_id IS NOT NULL GROUP BY 1 ORDER BY n DESC, min({'ts': ts, 'id': event_id}) LIMIT 1) s LEFT JOIN p ON p.pattern_id = s.pattern_id"),
    "weak_changes": sql("g p", f"SELECT pattern_id, name, early_accuracy, late_accuracy, late_accuracy - early_accuracy AS change, late_answered FROM (SELECT pattern_id, {pct('count(*) FILTER (NOT l AND correct)', 'count(*) FILTER (NOT l)')} AS early_accuracy, {pct('count(*) FILTER (l AND correct)', 'count(*) FILTER (l)')} AS late_accuracy, count(*) FILTER (l) AS late_answered FROM (SELECT *, d >= {ANCHOR} - 6 AS l FROM g WHERE d BETWEEN {ANCHOR} - 13 AND {ANCHOR}) GROUP BY pattern_id) LEFT JOIN p USING (pattern_id) WHERE early_accuracy > 0 AND late_accuracy > 0 AND late_accuracy < early_accuracy ORDER BY change, pattern_id LIMIT 5"),
    "daily_trend": sql("latest", f"SELECT *, {pct('correct', 'answered')} AS accuracy FROM (SELECT CAST(answered_at AS DATE) AS date, count(*) AS answered, count(*) FILTER (correct) AS correct FROM latest GROUP BY 1 ORDER BY 1 DESC LIMIT 14)"),
    "study_minutes": sql("le", f"SELECT CAST(s AS BIGINT) AS seconds, {rint('s / 60.0::DOUBLE')} AS minutes FROM (SELECT coalesce(sum(duration) FILTER (duration > 0), 0) AS s FROM le)"),
    "latest_attempts": sql("latest", "SELECT * FROM latest"),
    "attempt_counters": sql("latest", "SELECT count(*) AS total_answered, count(*) FILTER (correct) AS total_correct FROM latest"),
    "wrong_streaks": sql("wrongs", "SELECT * FROM wrongs"),
    "answer_durations": sql("le", f"SELECT event_id, question_id, CASE WHEN s IS NOT NULL AND (a IS NULL OR s > a) THEN {rint('(epoch_us(ts) - epoch_us(s.t)) / 1000000.0::DOUBLE')} END AS seconds FROM (SELECT *, max(CASE WHEN type = 'question_start' THEN {{'t': ts, 'i': event_id}} END) OVER w AS s, max(CASE WHEN type = 'question_answer' THEN {{'t': ts, 'i': event_id}} END) OVER w AS a FROM le WHERE type IN ('question_start', 'question_answer') WINDOW w AS (PARTITION BY question_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) WHERE type = 'question_answer'"),
    "running_score": sql("g", f"SELECT event_id, count(*) OVER w AS answered, count(*) FILTER (correct) OVER w AS \"right\" FROM g WHERE d = {ANCHOR} WINDOW w AS (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
    "event_retention": sql("le", "SELECT event_id, type, question_id, duration FROM le ORDER BY ts DESC, event_id DESC LIMIT 500"),
    "study_sessions": sql("le", f"SELECT d AS date, {rnd('sum(duration)::DOUBLE / 60.0::DOUBLE', 1)} AS minutes, max(ts) AS last_activity FROM le WHERE duration > 0 GROUP BY d ORDER BY d DESC LIMIT 30"),
    "pattern_progress": sql("prog", "SELECT * FROM prog"),
    "wrong_by_pattern": sql("wp", "SELECT * FROM wp"),
    "pattern_analytics": sql("an", "SELECT pattern_id, grade, total, answered, correct, correct_percent, question_count, total_wrong, last_study_at, weakness_score, weakness_level FROM an"),
    "weak_top": sql("an", "SELECT pattern_id, weakness_score, total_wrong FROM an WHERE answered > 0 OR total_wrong > 0 ORDER BY weakness_score DESC, total_wrong DESC, pattern_id LIMIT 3"),
    "overall_stats": sql("latest wrongs an le", f"SELECT *, CASE WHEN total_answered > 0 THEN 100 - accuracy ELSE 0 END AS wrong_rate FROM (SELECT count(*) AS total_answered, count(*) FILTER (correct) AS total_correct, {pct('count(*) FILTER (correct)', 'count(*)')} AS accuracy FROM latest), (SELECT count(*) AS wrong_questions FROM wrongs), (SELECT count(*) FILTER (answered > 0) AS studied_patterns, count(*) AS total_patterns FROM an), (SELECT {rint('coalesce(sum(duration) FILTER (duration > 0), 0) / 60.0::DOUBLE')} AS minutes FROM le)"),
    "dashboard": sql("an", f"SELECT *, {pct('answered', 'questions')} AS overall_percent FROM (SELECT CAST(sum(total) AS BIGINT) AS questions, CAST(sum(answered) AS BIGINT) AS answered, CAST(sum(correct) AS BIGINT) AS correct, count(*) FILTER (total_wrong > 0) AS patterns_with_wrong, count(*) AS patterns FROM an)"),
    "vulnerability": sql("vul", "SELECT * FROM vul"),
    "wrong_entries": sql("ent", "SELECT * FROM ent"),
    "wrong_summary": sql("ent vul", "SELECT * FROM (SELECT count(*) AS questions, CAST(coalesce(sum(wrong_count), 0) AS BIGINT) AS wrong_attempts, (SELECT question_id FROM ent ORDER BY wrong_count DESC, last_wrong_at DESC, question_id LIMIT 1) AS retry_target FROM ent), (SELECT count(*) AS vulnerable, count(*) FILTER (level = 'HIGH') AS high FROM vul)"),
    "pattern_metrics": sql("m", "SELECT pattern_id, importance_score, weakness_score, recency_score, exam_probability, study_days, wrong_days, score FROM m"),
    "reasons": sql("m", f"SELECT pattern_id, coalesce({PATTERN_REASONS}, '') AS reasons FROM m"),
    "rec_daily": sql("m", "SELECT CAST(row_number() OVER (ORDER BY score DESC, pattern_id) AS INT) AS rank, pattern_id, score FROM m ORDER BY rank LIMIT 3"),
    "rec_weak": sql("m", "SELECT CAST(row_number() OVER (ORDER BY score DESC, pattern_id) AS INT) AS rank, pattern_id, score, CASE WHEN total_wrong >= 3 OR correct_percent < 50 THEN 'HIGH' ELSE 'MEDIUM' END AS level, total_wrong, correct_percent FROM m WHERE total_wrong > 0 OR correct_percent < 70 ORDER BY rank LIMIT 5"),
    "rec_review": sql("r", f"SELECT CAST(row_number() OVER (ORDER BY due DESC, score DESC, question_id) AS INT) AS rank, question_id, wrong_count, priority_score, due, score, {QUESTION_REASONS} AS reasons FROM r ORDER BY rank LIMIT 8"),
    "exam_grade": sql("eg", "SELECT * FROM eg"),
    "exam_pattern_stats": sql("ed", f"SELECT *, CASE WHEN accuracy >= 90 THEN 'EXCELLENT' WHEN accuracy >= 70 THEN 'GOOD' WHEN accuracy >= 50 THEN 'FAIR' ELSE 'WEAK' END AS level FROM (SELECT pattern_id, count(*) AS total, count(selected) AS answered, count(*) FILTER (\"right\") AS correct, {rnd('count(*) FILTER ("right")::DOUBLE / count(*)::DOUBLE * 100', 1)} AS accuracy FROM ed WHERE known GROUP BY pattern_id)"),
    "exam_weak": sql("ew", "SELECT * FROM ew"),
    "exam_advice": sql("eg ew", "SELECT kind, count(*) AS rows, count(DISTINCT session_id) AS sessions, count(DISTINCT pattern_id) AS patterns FROM (SELECT session_id, 'time' AS kind, NULL::VARCHAR AS pattern_id FROM eg WHERE unanswered > 0 UNION ALL SELECT session_id, 'pattern', pattern_id FROM ew WHERE rank <= 3 UNION ALL SELECT session_id, k, NULL FROM eg, (VALUES ('wrong-note'), ('ai-tutor')) v(k) WHERE NOT passed UNION ALL SELECT eg.session_id, 'question', pattern_id FROM eg JOIN ew ON ew.session_id = eg.session_id AND rank = 1 AND ew.accuracy < 100 WHERE passed) GROUP BY kind"),
    "exam_history": sql("eg", f"SELECT count(*) AS exams, {rint('avg(score)')} AS average, max(score) AS best, arg_max(score, session_id) AS latest FROM eg"),
    "exam_newest": sql("eg", "SELECT session_id, score, passed FROM eg ORDER BY session_id DESC LIMIT 20"),
    "exam_sample": sql("eq", "SELECT question_id, pattern_id FROM eq ORDER BY md5('exam' || question_id), question_id LIMIT 40"),
    "pattern_table": sql("pt", "SELECT * REPLACE (array_to_string(years, ',') AS years) FROM pt"),
    "statistics_table": sql("pt", "SELECT pattern_id, chapter_id, frequency AS total_count, array_to_string(years, ',') AS years, coalesce(array_to_string(list_filter(years, lambda y: y >= 2022), ','), '') AS recent_years, CASE grade WHEN 'S' THEN 'HIGH' WHEN 'A' THEN 'MEDIUM' ELSE 'LOW' END AS priority, grade FROM pt"),
    "choice_histogram": sql("ea", "SELECT choices, count(*) AS n FROM (SELECT count(*) AS choices FROM ea GROUP BY session_id) GROUP BY choices"),
    "year_union": sql("eq", "SELECT CAST(coalesce(a.year, b.year) AS INT) AS year, coalesce(questions, 0) AS questions, coalesce(answers, 0) AS answers FROM (SELECT year, count(*) AS questions FROM eq GROUP BY year) a FULL JOIN (SELECT year(o_orderdate) AS year, count(*) AS answers FROM orders GROUP BY 1) b ON a.year = b.year"),
    "round_robin": sql("eq", "SELECT question_id, pattern_id, CAST(row_number() OVER (PARTITION BY pattern_id ORDER BY question_id) AS INT) AS turn FROM eq ORDER BY turn, pattern_id LIMIT 60"),
    "first_per_group": sql("eq", "SELECT question_id, pattern_id, CAST(row_number() OVER (PARTITION BY pattern_id ORDER BY question_id) AS INT) AS turn FROM eq QUALIFY turn <= 3"),
    "next_in_pattern": sql("eq", "SELECT question_id, pattern_id, lead(question_id) OVER (PARTITION BY pattern_id ORDER BY question_id) AS next_id FROM eq"),
    "similar_questions": sql("eq", "SELECT a.question_id, b.question_id AS similar_id, CAST(row_number() OVER (PARTITION BY a.question_id ORDER BY b.question_id) AS INT) AS rank FROM eq a JOIN eq b ON a.pattern_id = b.pattern_id AND a.question_id <> b.question_id QUALIFY rank <= 3"),
    "unlinked": sql("ea eq", "SELECT question_id, count(*) AS answers FROM ea WHERE question_id NOT IN (SELECT question_id FROM eq WHERE NOT ends_with(pattern_id, '3')) GROUP BY 1"),
    "frequency_mismatch": sql("eq", "SELECT pattern_id, count(*) + 1 AS frequency, count(*) AS linked FROM eq WHERE ends_with(pattern_id, '2') GROUP BY 1"),
    "classify": "SELECT doc_id, CASE WHEN contains(text, 'licensed under') OR contains(text, 'All rights reserved') THEN 'license' WHEN contains(text, ' | ') THEN 'pipe_table' WHEN contains(text, '!!') THEN 'shout' WHEN contains(text, 'tiontion') THEN 'tion' ELSE 'general' END AS rule FROM documents",
    "quality_issues": sql("iss", "SELECT * FROM iss"),
    "quality_crosstab": sql("iss", "SELECT category, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM iss GROUP BY category"),
    "quality_grade": sql("iss", "SELECT *, CASE WHEN critical > 0 THEN 'D' WHEN warning > 40 THEN 'C' WHEN warning > 0 THEN 'B' ELSE 'A' END AS grade FROM (SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'info') AS info FROM iss)"),
    "completeness": f"SELECT *, labelled = 100 AND good = 100 AND long = 100 AS all_pass FROM (SELECT source, count(*) AS rows, {rnd('count(quality)::DOUBLE / count(*)::DOUBLE * 100', 1)} AS labelled, {rnd('count(*) FILTER (quality = 1)::DOUBLE / count(*)::DOUBLE * 100', 1)} AS good, {rnd('count(*) FILTER (length(text) >= 500)::DOUBLE / count(*)::DOUBLE * 100', 1)} AS long FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)",
    "invariants": f"SELECT 'lang' AS \"column\", CAST(0 AS BIGINT) AS changed UNION ALL SELECT 'source', 0 UNION ALL SELECT 'text', count(*) FROM documents WHERE {FOOT} <> text",
    "cleanup_footer": f"SELECT doc_id, CAST(length(text) AS INT) AS before, CAST(length({FOOT}) AS INT) AS after, md5({FOOT}) AS text_md5, {HASFOOT} AS footer FROM documents",
    "readability": sql("read", "SELECT doc_id, CAST(longest_run AS INT) AS longest_run, space_ratio, unformatted FROM read"),
    "readability_summary": sql("read", "SELECT CAST(max(longest_run) AS INT) AS longest, count(*) FILTER (longest_run >= 20) AS rows_glued, CAST(sum(unformatted) AS BIGINT) AS unformatted, count(*) AS rows FROM read"),
    "number_set_diff": f"SELECT doc_id, len(g) AS n, coalesce(array_to_string(list_transform(list_sort(list_transform(g, lambda x: {{'l': -length(x), 'x': x}}))[1:20], lambda s: s.x), ','), '') AS numbers FROM (SELECT doc_id, {GONE} AS g FROM documents)",
    "containment": f"SELECT item_id, {rnd(r"length(regexp_replace(split_part(text, '.', 1), '\s+', '', 'g'))::DOUBLE / length(regexp_replace(text, '\s+', '', 'g'))::DOUBLE", 6)} AS coverage FROM benchmark",
    "content_hash": "SELECT doc_id, substring(sha256(text), 1, 16) AS hash FROM documents",
    "segments": sql("seg", "SELECT * FROM seg"),
    "page_asof": sql("seg", "SELECT doc_id, \"offset\", arg_max(page, start) AS page FROM (SELECT doc_id, CAST(floor(length(text) / 2) AS BIGINT) AS \"offset\" FROM documents) JOIN seg USING (doc_id) WHERE start <= \"offset\" GROUP BY ALL"),
    "page_lookup": sql("seg", "SELECT doc_id, \"offset\", coalesce(max(page) FILTER (start <= \"offset\"), 1)::BIGINT AS page FROM (SELECT item_id AS doc_id, length(text)::BIGINT AS \"offset\" FROM benchmark) LEFT JOIN seg USING (doc_id) GROUP BY ALL"),
    "year_ffill": "SELECT conv_id, turn, last_value(y IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS year FROM (SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 3 = 0 THEN 2000 + turn END AS y FROM conversations)",
    "marker_interpolation": sql("ea", "SELECT session_id, number, position FROM (WITH j AS (SELECT session_id, number, min(question_id) AS position FROM ea WHERE (session_id + number) % 3 <> 0 GROUP BY ALL), k AS (SELECT session_id, number, position, lead(number) OVER w AS n2, lead(position) OVER w AS p2 FROM j WINDOW w AS (PARTITION BY session_id ORDER BY number)) SELECT session_id, number, position FROM k UNION ALL SELECT session_id, CAST(x AS INT), position + CAST(trunc((p2 - position) * (x - number)::DOUBLE / (n2 - number)::DOUBLE) AS BIGINT) FROM (SELECT *, unnest(range(number + 1, n2)) AS x FROM k WHERE n2 - number BETWEEN 2 AND 3))"),
    "dedupe_lines": "SELECT doc_id, len(l) AS n_lines, len(k) AS n_kept, md5(array_to_string(k, chr(10))) AS text_md5 FROM (SELECT doc_id, l, list_filter(l, lambda x, i: i = 1 OR x <> l[i - 1]) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))",
    "url_links": sql("eq", "SELECT question_id, 'question.html?pattern=' || url_encode(pattern_id) || '&q=' || url_encode(question) AS url FROM eq"),
    "exam_sections": r"SELECT item_id, CAST(i AS INT) AS number, CAST(CASE WHEN i % 2 = 1 THEN 5 ELSE 0 END AS BIGINT) AS n_choices, length(trim(l[i])) AS stem_length FROM (SELECT item_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT item_id, list_filter(string_split_regex(regexp_replace(text, '\d+\.', '', 'g'), '\.\s*'), lambda x: trim(x) <> '') AS l FROM benchmark))",
    "stars": sql("eq", f"SELECT pattern_id, repeat('★', n) || repeat('☆', 5 - n) AS stars, CASE WHEN t >= 3600 THEN t // 3600 || ':' ELSE '' END || lpad(CAST(t % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(t % 60 AS VARCHAR), 2, '0') AS time, CASE WHEN importance < 60 THEN importance || '분' WHEN importance % 60 = 0 THEN importance // 60 || '시간' ELSE importance // 60 || '시간 ' || importance % 60 || '분' END AS study FROM (SELECT *, CAST(least(greatest({rint('importance / 20.0::DOUBLE')}, 1), 5) AS INT) AS n, importance * 97 AS t FROM (SELECT chapter_id AS pattern_id, least(95, 55 + 3 * count(*)) AS importance FROM eq GROUP BY 1))"),
    "stream_daily": sql("le", f"SELECT d AS date, {rnd('sum(duration) FILTER (duration > 0)::DOUBLE / 60.0::DOUBLE', 1)} AS minutes, count(*) AS events FROM le GROUP BY d"),
}

VIEWS["yr"] = f"SELECT *, {rnd('five::DOUBLE / extracted::DOUBLE * 100', 1)} AS rate, CASE WHEN extracted = 150 AND five = 150 AND keyed = 150 THEN 'A' WHEN extracted = 150 AND five = 150 AND keyed > 0 THEN 'B' WHEN extracted = 150 AND five = 150 THEN 'C' WHEN extracted >= 0.75 * 150 AND five >= 0.9 * extracted THEN 'C' WHEN extracted > 0 THEN 'D' ELSE 'F' END AS grade FROM (SELECT year, count(*) AS extracted, count(*) FILTER (question_id % 10 <> 0) AS five, count(*) FILTER (question_id % 7 <> 0) AS keyed FROM eq GROUP BY year)"
USES["yr"] = ["eq"]
VIEWS["src0"] = "SELECT doc_id, left(text, CAST(floor(length(text) * (40 + doc_id % 60) / 100) AS INT)) AS q, text AS s FROM documents"
VIEWS["src1"] = r"SELECT *, lower(regexp_replace(q, '\s+', '', 'g')) AS a, lower(regexp_replace(s, '\s+', '', 'g')) AS b FROM src0"
UNSPACED_RUN = "coalesce(list_max(list_transform(regexp_extract_all(replace({}, ' ', ''), '[a-zA-Z]+'), lambda x: length(x))), 0)"
VIEWS["src"] = f"SELECT *, CASE WHEN length(a) = 0 THEN 0.0 WHEN length(b) = 0 THEN 1.0 WHEN contains(b, a) THEN least(1.0, length(a)::DOUBLE / length(b)::DOUBLE) ELSE 0.0 END AS cover, len(list_filter({NUMBERS.format('s')}, lambda x: NOT list_contains({NUMBERS.format('q')}, x))) AS lost, trim(s) <> '' AS there, {UNSPACED_RUN.format('q')} AS rq, {UNSPACED_RUN.format('s')} AS rs FROM src1"
USES |= {"src1": ["src0"], "src": ["src1"]}
ORACLE_SQL |= {
    "year_report": sql("yr", "SELECT * FROM yr"),
    "recognition": sql("yr", f"SELECT years, ready, questions, CASE WHEN questions > 0 THEN {rnd('five::DOUBLE / questions::DOUBLE * 100', 1)} ELSE 0.0::DOUBLE END AS five_rate, CASE WHEN questions > 0 THEN {rnd('keyed::DOUBLE / questions::DOUBLE * 100', 1)} ELSE 0.0::DOUBLE END AS keyed_rate FROM (SELECT count(*) AS years, count(*) FILTER (grade IN ('A', 'B')) AS ready, CAST(sum(extracted) AS BIGINT) AS questions, CAST(sum(five) AS BIGINT) AS five, CAST(sum(keyed) AS BIGINT) AS keyed FROM yr)"),
    "issue_rollup": sql("iss", "SELECT severity, category, count(*) AS n FROM iss GROUP BY ROLLUP (severity, category)"),
    "sparse_groups": sql("eq", "SELECT pattern_id || '/' || chapter_id || '/' || year AS key, count(*) AS n FROM eq GROUP BY 1 HAVING count(*) < 2"),
    "required_fields": "SELECT field, missing FROM (SELECT count(*) FILTER (doc_id IS NULL) AS doc_id, count(*) FILTER (text IS NULL OR trim(text) = '') AS text, count(*) FILTER (lang IS NULL OR trim(lang) = '') AS lang, count(*) FILTER (quality IS NULL) AS quality, count(*) FILTER (toxic IS NULL) AS toxic FROM documents LEFT JOIN labels USING (doc_id)) UNPIVOT (missing FOR field IN (doc_id, text, lang, quality, toxic))",
    "source_issues": sql("src", "SELECT doc_id, 'critical' AS severity, 'source_missing' AS category FROM src WHERE coalesce(NOT there, true) UNION ALL SELECT doc_id, 'critical', 'stem_truncated' FROM src WHERE there AND cover < 0.55 UNION ALL SELECT doc_id, 'warning', 'stem_short' FROM src WHERE there AND cover >= 0.55 AND cover < 0.75 UNION ALL SELECT doc_id, 'warning', 'missing_numbers' FROM src WHERE there AND lost >= 3 UNION ALL SELECT doc_id, 'warning', 'ocr_glued' FROM src WHERE there AND rq >= 20 AND rq > rs + 2"),
    "answer_pairs": sql("ea", "SELECT session_id, number, CAST(min(selected) AS INT) AS answer FROM ea WHERE selected IS NOT NULL AND number BETWEEN 1 AND 5 GROUP BY ALL"),
    "stratified_sample": sql("eq", """SELECT question_id, stratum FROM (WITH o AS (SELECT question_id, year, pattern_id, md5('sample' || question_id) AS h FROM eq),
 a AS (SELECT question_id FROM o WHERE year >= 2024 ORDER BY h, question_id LIMIT 15),
 b AS (SELECT question_id FROM o WHERE ends_with(pattern_id, '1') AND question_id NOT IN (FROM a) ORDER BY h, question_id LIMIT 10),
 c AS (SELECT question_id FROM o WHERE question_id NOT IN (FROM a) AND question_id NOT IN (FROM b) ORDER BY h, question_id LIMIT 5)
 SELECT question_id, 'recent' AS stratum FROM a UNION ALL SELECT question_id, 'first_brand' FROM b UNION ALL SELECT question_id, 'other' FROM c)"""),
    "pattern_fit": f"SELECT source, {rnd("avg((CASE WHEN contains(text, 'tion') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'ing') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'heit') THEN 1 ELSE 0 END + CASE WHEN contains(text, 'elle') THEN 1 ELSE 0 END)::DOUBLE / 4)", 6)} AS fit FROM documents GROUP BY source",
    "text_change": f"SELECT source, \"before\", \"after\", CASE WHEN \"before\" = 0 AND \"after\" = 0 THEN '0%' WHEN \"before\" = 0 THEN '+' || \"after\" ELSE printf('%+.1f%%', {rnd('(\"after\" - \"before\")::DOUBLE / \"before\"::DOUBLE * 100', 1)}) END AS change FROM (SELECT source, CAST(sum(length(text)) AS BIGINT) AS \"before\", CAST(sum(length({FOOT})) AS BIGINT) AS \"after\" FROM documents GROUP BY source)",
    "first_of_year": sql("eq", "SELECT year, pattern_id, question_id, answer FROM eq QUALIFY row_number() OVER (PARTITION BY year, pattern_id ORDER BY question_id) = 1"),
    "same_sets": sql("eq", "SELECT pattern_id, count(*) FILTER (question_id % 11 <> 0 AND question_id % 13 = 0) AS only_a, count(*) FILTER (question_id % 13 <> 0 AND question_id % 11 = 0) AS only_b FROM eq GROUP BY pattern_id HAVING only_a > 0 OR only_b > 0"),
    "merged_bodies": "SELECT conv_id, role, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS text_md5 FROM conversations WHERE text IS NOT NULL GROUP BY ALL",
    "submitted_answers": sql("ed", "SELECT pattern_id, selected, count(*) AS n, count(*) FILTER (\"right\") AS hits FROM ed WHERE known AND selected IS NOT NULL GROUP BY ALL"),
    "hourly_events": sql("le", "SELECT date_trunc('hour', ts) AS start, count(*) AS events, CAST(sum(duration) AS BIGINT) AS seconds FROM le GROUP BY 1"),
    "user_latest": sql("g", "SELECT user_id, count(*) AS questions, count(*) FILTER (correct) AS correct FROM (SELECT user_id, question_id, correct FROM g QUALIFY row_number() OVER (PARTITION BY user_id, question_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY user_id"),
    "user_sessions": sql("le", "SELECT user_id, min(ts) AS start, max(ts) AS \"end\", count(*) AS events FROM (SELECT *, sum(CASE WHEN before IS NULL OR ts >= before + INTERVAL 600 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM le)) GROUP BY user_id, s"),
    "scaled_bars": sql("eq", f"SELECT pattern_id, year, n, {rnd('n::DOUBLE / greatest(max(n) OVER (PARTITION BY year), 1)::DOUBLE', 6)} AS share FROM (SELECT pattern_id, year, count(*) AS n FROM eq GROUP BY ALL)"),
    "running_orders": "SELECT o_orderkey, CAST(sum(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS running FROM (SELECT o_custkey, o_orderkey, count(*) AS n FROM orders GROUP BY ALL)",
}

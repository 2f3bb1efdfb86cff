"""The SQL of record_queries for DuckDB."""

from __future__ import annotations

from learnspark.plans.oracle import USES, VIEWS, pct, rnd, sql

VIEWS["rec"] = "SELECT p_partkey AS question_id, p_brand AS pattern_id, CAST(2015 + p_size % 11 AS INT) AS year, CAST(1 + p_partkey % 40 AS INT) AS number, CASE WHEN p_partkey % 23 <> 0 THEN p_name END AS stem, list_transform(range(1, CASE WHEN p_partkey % 7 = 0 THEN 5 ELSE 6 END), lambda k: p_type || ' ' || k) AS choices, CASE WHEN p_partkey % 11 <> 0 THEN CAST(1 + p_partkey % 5 AS INT) END AS answer, p_retailprice AS price FROM part"
VIEWS["pf"] = "SELECT pattern_id, count(*) AS frequency, max(year) AS last_year FROM eq GROUP BY 1"
VIEWS["keys"] = "SELECT question_id, min(selected) AS answer FROM ea WHERE selected IS NOT NULL AND question_id % 5 <> 2 GROUP BY 1"
VIEWS["reasons0"] = "SELECT question_id, choices, coalesce(answer, 1) AS answer, ['long enough', 'short', stem, 'also long enough'] AS reasons FROM rec"
VIEWS["wrong0"] = "SELECT question_id, k AS choice, reasons[k] AS reason FROM (SELECT question_id, answer, reasons, unnest(range(1, len(choices) + 1)) AS k FROM reasons0) WHERE k <> answer"
VIEWS["lq"] = "SELECT CAST(question_id AS VARCHAR) AS qid, CASE WHEN question_id % 29 = 0 THEN 'Brand#99' ELSE pattern_id END AS pid, stem, choices, answer, question_id AS k, year FROM rec"
USES |= {"pf": ["eq"], "keys": ["ea"], "reasons0": ["rec"], "wrong0": ["reasons0"], "lq": ["rec"]}
LACK = "CASE WHEN coalesce(trim(stem), '') = '' THEN 'stem' WHEN len(choices) <> 5 THEN 'choices' WHEN answer IS NULL THEN 'answer' END"
FOOTER = r"E'\n 제3회 감정평가 A-12-3-[1교시] \n한국산업인력공단 page ( 7 ) 교시 -[ 2 ]'"
FOOTERS = (r"(?i)\n?\s*A-\d{2}-\d{1,2}(?:-\[\d교시\])?\s*", r"(?i)\n?\s*A-\d{2}-\d{1,2}-\[\d교시\]\s*", r"(?i)\n?\s*교시\s*-\[\s*\d\s*\]\s*", r"(?i)\n?\s*한국산업[^\n]*", r"(?i)\n?\s*page\s*\(\s*\d+\s*\)\s*", r"(?i)\n?\s*제\d+회[^\n]*A-\d{2}-\d{1,2}\s*", r"(?i)\n?\s*청렴한감정평가[^\n]*", r"(?i)\d{4}년\s*제\d+회[^\n]{0,40}A-\d{2}-\d{1,2}")
_clean = "t"
for _p in FOOTERS:
    _clean = f"regexp_replace({_clean}, '{_p}', '', 'g')"
TOPIC = "NOT (contains(s, 'tiontion') OR contains(s, '!!')) AND (contains(s, 'heit') OR contains(s, 'tion') OR contains(text, 'and') AND (contains(text, 'elle') OR contains(text, 'ing')))"
LOST = r"CAST(sum(len(regexp_extract_all(regexp_replace({}, '\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?', '', 'g'), '\d{{4,}}'))) AS BIGINT)"
BARE = r"length(regexp_replace({}, '\s+', '', 'g'))"

CHAPTERS = "SELECT chapter_id AS pattern_id, CASE WHEN count(*) >= 4 THEN 'S' WHEN count(*) >= 2 THEN 'A' ELSE 'B' END AS grade, least(95, 55 + 3 * count(*)) AS importance, count(*) AS frequency, list_sort(list_distinct(list(year))) AS years FROM eq GROUP BY 1"
ORACLE_SQL = {
    "question_records": sql("rec", "SELECT question_id, year || '-' || lpad(CAST(number AS VARCHAR), 2, '0') AS qid, pattern_id AS pattern, array_to_string(choices, '|') AS choices, year FROM rec"),
    "valid_questions": sql("rec", f"SELECT question_id, answer FROM rec WHERE {LACK} IS NULL"),
    "failed_questions": sql("rec", f"SELECT question_id, {LACK} AS lack FROM rec WHERE {LACK} IS NOT NULL"),
    "answered_questions": sql("rec keys", "SELECT question_id, CAST(keys.answer AS INT) AS key_answer FROM rec JOIN keys USING (question_id)"),
    "unanswered_questions": sql("rec keys", "SELECT question_id FROM rec WHERE question_id NOT IN (SELECT question_id FROM keys)"),
    "solved_questions": sql("rec", "SELECT question_id, s.price AS solution FROM rec LEFT JOIN (SELECT year, number, max(price) AS price FROM rec WHERE number % 3 <> 0 GROUP BY ALL) s USING (year, number)"),
    "related_in_order": sql("rec", "SELECT key, CAST(pos AS INT) AS pos, r.question_id FROM (SELECT question_id AS key, unnest([0, 1, 2]) AS pos, unnest([question_id + 3, question_id - 1, question_id * 2]) AS other FROM rec) JOIN rec r ON r.question_id = other"),
    "numbered_in_year": sql("rec", "SELECT year, question_id, CAST(row_number() OVER (PARTITION BY year ORDER BY question_id) AS INT) AS number FROM (SELECT year, question_id FROM rec) QUALIFY number <= 40"),
    "phase_one_patterns": sql("eq", f"SELECT pattern_id, grade, frequency, least(95, 60 + 5 * frequency) AS importance, array_to_string(years, ',') AS years, array_to_string(list_filter(years, lambda y: y >= 2022), ',') AS recent_years, CASE grade WHEN 'S' THEN 'HIGH' WHEN 'A' THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM ({CHAPTERS})"),
    "pattern_filter": sql("rec", "SELECT question_id FROM rec WHERE pattern_id = 'Brand#13'"),
    "no_pattern_filter": sql("rec", "SELECT pattern_id, count(*) AS n FROM rec GROUP BY 1"),
    "chapter_filter": sql("eq", "SELECT question_id FROM eq WHERE chapter_id = 'ECONOMY'"),
    "topic_documents": f"SELECT doc_id, {TOPIC} AS about FROM (SELECT doc_id, text, split_part(text, chr(10), 1) AS s FROM documents)",
    "kept_lines": "SELECT doc_id, md5(t) AS text_md5, CAST(length(t) AS INT) AS length FROM (SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: regexp_matches(x, '[0-9]') AND NOT regexp_matches(x, '^[0-9]+$')), chr(10)) AS t FROM documents)",
    "question_tags": sql("rec", "SELECT question_id, concat_ws(',', CASE WHEN question_id % 3 = 0 THEN 'calculation' END, CASE WHEN question_id % 3 <> 0 AND question_id % 4 <> 0 THEN 'concept' END, CASE WHEN question_id % 4 = 0 THEN 'table' END, CASE WHEN regexp_matches(coalesce(stem, ''), 'cold|red') THEN 'tabular-stem' END) AS tags FROM rec"),
    "shown_tables": sql("rec", "SELECT question_id, question_id % 2 = 0 AND coalesce(trim(CASE WHEN question_id % 3 = 0 THEN ' ' ELSE stem END), '') <> '' AND NOT list_bool_or(list_transform(choices, lambda c: starts_with(c, 'PROMO'))) AS shown FROM rec"),
    "detailed_steps": r"SELECT doc_id, len(l) >= 3 AND list_bool_or(list_transform(l, lambda s: regexp_matches(s, '[0-9=×÷+\-]'))) AS detailed FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)",
    "truncation_causes": f"SELECT doc_id, CASE WHEN trim(text) = '' THEN 'question_end_fail' WHEN doc_id % 9 = 0 THEN 'choice_start_fail' WHEN {BARE.format('q')} = 0 THEN 'linebreak_handling' WHEN {BARE.format('q')}::DOUBLE / greatest({BARE.format('text')}, 1) >= 0.75 THEN NULL WHEN doc_id % 4 = 0 AND {BARE.format('q')} < {BARE.format("left(text, CAST(floor(length(text) * 9 / 10) AS INT))")} * 0.6 THEN 'table_handling' WHEN {BARE.format('q')}::DOUBLE / greatest({BARE.format('text')}, 1) >= 0.55 THEN NULL WHEN contains(text, chr(10)) THEN 'linebreak_handling' ELSE 'question_end_fail' END AS cause FROM (SELECT doc_id, text, left(text, CAST(floor(length(text) * (20 + doc_id % 80) / 100) AS INT)) AS q FROM documents WHERE text IS NOT NULL)",
    "load_errors": sql("lq pf", " UNION ALL ".join([
        *[f"SELECT qid AS id, '{rule}' AS rule FROM lq WHERE {on}" for rule, on in (("missing_question", "stem IS NULL"), ("missing_answer", "answer IS NULL"), ("missing_solution", "k % 13 = 0"), ("missing_originalQuestion", "k % 17 = 0"), ("choices", "len(choices) <> 5"), ("answer", "answer IS NULL"), ("unknown_pattern", "pid NOT IN (SELECT pattern_id FROM pf)"), ("source_type", "k % 31 = 0"), ("source_year", "k % 37 = 0"))],
        "SELECT pf.pattern_id, 'frequency' FROM pf LEFT JOIN (SELECT pid, count(*) AS n FROM lq GROUP BY 1) ON pid = pf.pattern_id WHERE frequency <> coalesce(n, 0)",
        "SELECT 'questions', 'count' FROM (SELECT count(*) AS n FROM lq) WHERE n <> 240",
    ])),
    "verified_records": sql("rec", "SELECT question_id, CASE WHEN question_id % 50 = 0 THEN 'row' ELSE 'year' END AS field FROM rec WHERE question_id % 10 = 0 AND (question_id % 50 = 0 OR question_id % 30 = 0)"),
    "choice_coverage": sql("reasons0 wrong0", f"SELECT question_id, {rnd('count(*) FILTER (length(trim(reason)) >= 8)::DOUBLE / count(*)::DOUBLE', 6)} AS coverage FROM wrong0 GROUP BY 1"),
    "lacking_reasons": sql("wrong0", "SELECT question_id, CAST(choice AS INT) AS choice FROM wrong0 WHERE coalesce(trim(reason), '') = ''"),
    "issue_counts": sql("iss", "SELECT source, category, count(*) AS n, count(DISTINCT doc_id) AS affected FROM iss JOIN documents USING (doc_id) GROUP BY ALL"),
    "patterns_of_year": sql("eq", "SELECT year, array_to_string(list_sort(list_distinct(list(pattern_id))), ',') AS \"values\" FROM eq GROUP BY 1"),
    "restore_rates": rf"SELECT source, CASE WHEN b = 0 THEN 100.0::DOUBLE ELSE {rnd('(b - a)::DOUBLE / b::DOUBLE * 100', 1)} END AS restored, CASE WHEN b = 0 THEN 0.0::DOUBLE ELSE {rnd('(b - a)::DOUBLE / b::DOUBLE * 100', 1)} END AS reduction FROM (SELECT source, {LOST.format('text')} AS b, {LOST.format("regexp_replace(text, '\\d{4,}', '0', 'g')")} AS a FROM documents GROUP BY 1)",
    "common_answers": sql("ea", "SELECT question_id, count(*) AS n FROM ea WHERE selected IS NOT NULL GROUP BY 1 ORDER BY n DESC, question_id LIMIT 10"),
    "categories_by_count": sql("iss", "SELECT category, n, CAST(row_number() OVER (ORDER BY n DESC, category) AS INT) AS place FROM (SELECT category, count(*) AS n FROM iss GROUP BY 1)"),
    "patterns_by_grade": sql("eq", f"SELECT CAST(row_number() OVER (ORDER BY strpos('SABC', grade), importance DESC, pattern_id) AS INT) AS place, pattern_id, grade, importance FROM ({CHAPTERS})"),
    "wrong_entries_ordered": sql("ent", "SELECT CAST(row_number() OVER (ORDER BY wrong_count DESC, last_wrong_at DESC, question_id) AS INT) AS place, question_id, wrong_count FROM ent"),
    "vulnerability_ordered": sql("vul", "SELECT CAST(row_number() OVER (ORDER BY score DESC, pattern_id) AS INT) AS place, pattern_id, score FROM vul"),
    "questions_ordered": sql("rec", "SELECT year, number, question_id FROM rec ORDER BY ALL"),
    "worst_coverage": rf"SELECT *, CAST(row_number() OVER (ORDER BY coverage, item_id) AS INT) AS place FROM (SELECT item_id, {rnd(r"length(regexp_replace(split_part(text, '.', 1), '\s+', '', 'g'))::DOUBLE / length(regexp_replace(text, '\s+', '', 'g'))::DOUBLE", 6)} AS coverage FROM benchmark) ORDER BY place LIMIT 25",
    "class_sample": sql("rec", "SELECT question_id, CAST(CASE WHEN year = 2025 THEN 1 WHEN price > 1500 THEN 2 ELSE 3 END AS INT) AS class FROM rec ORDER BY class, question_id LIMIT 20"),
    "first_unanswered": sql("ea", "SELECT session_id, coalesce(min(number) FILTER (selected IS NULL), min(number)) AS \"first\" FROM ea GROUP BY 1"),
    "pattern_chips": sql("eq", "SELECT pattern_id, n, CAST(row_number() OVER (ORDER BY n DESC, pattern_id) AS INT) AS place FROM (SELECT pattern_id, count(*) AS n FROM eq GROUP BY 1)"),
    "session_patterns_named": sql("esp pf", "SELECT session_id, esp.pattern_id, coalesce(frequency, 0) AS frequency, accuracy FROM esp LEFT JOIN (SELECT * FROM pf WHERE pattern_id <> 'Brand#13') f ON f.pattern_id = esp.pattern_id"),
    "recommendation_counts": sql("an wrongs", "SELECT count(*) AS patterns, count(*) FILTER (answered > 0) AS studied, (SELECT count(*) FROM wrongs) AS wrong_questions FROM an"),
    "exam_footers": rf"SELECT doc_id, {' OR '.join(f"regexp_matches(t, '{p}')" for p in FOOTERS)} AS footer, md5(regexp_replace({_clean}, '^\s+|\s+$', '', 'g')) AS text_md5 FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || {FOOTER} ELSE text END AS t FROM documents)",
    "glued_runs": "SELECT doc_id, CAST(coalesce(list_max(list_transform(regexp_extract_all(text, '[a-zA-Z]+'), lambda x: length(x))), 0) AS INT) AS run FROM documents",
    "dates_and_labels": "SELECT o_orderkey, year(o_orderdate) || '. ' || month(o_orderdate) || '. ' || day(o_orderdate) || '.' AS date, lpad(CAST(o_orderkey % 24 AS VARCHAR), 2, '0') || ':00' AS hour, 3600 - o_orderkey % 3600 AS elapsed FROM orders",
    "json_defaults": "SELECT event_id, CAST(CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 7 = 0 THEN -1 ELSE CAST(regexp_extract(props, '\"k\": ?([0-9]+)', 1) AS INT) END AS INT) AS k FROM events",
    "merged_defaults": "SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN event_type ELSE 'none' END AS event_type, false AS used_tutor FROM events",
    "event_ids": "SELECT event_id, substring(sha256(user_id || '|' || event_type || '|' || event_id), 1, 12) AS id FROM events",
    "choice_years": sql("eq", "SELECT question_id, CASE WHEN year >= 2024 THEN 'recent,' || chapter_id ELSE chapter_id END AS \"set\" FROM eq"),
    "squeezed_text": r"SELECT doc_id, md5(trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g'))) AS text_md5 FROM documents",
    "short_texts": "SELECT doc_id, CASE WHEN length(text) > 80 THEN left(text, 80) || '…' ELSE text END AS short FROM documents",
    "tutor_samples": sql("ea", "SELECT *, all_answered = sessions AND gapless = sessions AND long = sessions AS all_pass FROM (SELECT count(*) AS sessions, count(*) FILTER (answered = n) AS all_answered, count(*) FILTER (\"last\" = n) AS gapless, count(*) FILTER (n >= 4) AS long FROM (SELECT session_id, count(*) AS n, count(selected) AS answered, max(number) AS \"last\" FROM ea GROUP BY 1))"),
    "score_percent": sql("ea", f"SELECT number, {pct('count(selected)', 'count(*)')} AS answered_percent FROM ea GROUP BY 1"),
}

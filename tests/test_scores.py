"""Hand-computed values of scores, dates, text and extraction."""

import datetime
import random

from pyspark.sql import functions as F

from learnspark.functions import scores as S
from learnspark.functions import text as X
from learnspark.operators import analytics as A
from learnspark.operators import content, exam, extract, quality, recommend, reports, state


def one(spark, *columns, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v if not isinstance(v, (int, float, str, bool, type(None))) else F.lit(v))
    row = df.select(*columns).first()
    return row[0] if len(row) == 1 else tuple(row)


def test_rounding_is_half_up(spark):
    assert one(spark, S.rnd(F.lit(2.5)), S.rnd(F.lit(-2.5)), S.rnd(F.lit(1.005), 2)) == (3.0, -2.0, 1.0)


def test_weakness(spark):
    assert one(spark, S.weakness_score(F.lit(50), F.lit(2), F.lit(1), F.lit(2), F.lit(5))) == 60
    assert one(spark, S.weakness_level(F.lit(60))) == "HIGH"


def test_recency_and_noon(spark):
    assert one(spark, S.recency_score(F.lit(2), F.lit(2), F.lit(2))) == 61
    assert one(spark, S.recency_score(F.lit(-1), F.lit(None).cast("int"), F.lit(0))) == 30
    assert one(spark, S.days_since(F.lit("2024-01-30 15:00:00").cast("timestamp"), "2024-01-30")) == -1
    assert one(spark, S.days_since(F.lit("2024-01-28 12:00:00").cast("timestamp"), "2024-01-30")) == 2


def test_importance_exam_and_total(spark):
    assert one(spark, S.importance_score(F.lit("S"), F.lit(85), F.lit("S"))) == 95
    assert one(spark, S.exam_probability(F.lit("HIGH"), F.lit(5), F.lit(1))) == 63
    assert one(spark, S.recommendation_score(F.lit(95), F.lit(60), F.lit(61), F.lit(63), S.type_factor(F.lit("mixed")))) == 82


def test_review(spark):
    assert one(spark, S.wrong_priority(F.lit(2), F.lit(95), F.lit(2))) == 2.13
    assert one(spark, S.review_due(F.lit(2), F.lit(2))) is False
    assert one(spark, S.review_score(F.lit(2.13), F.lit(False), F.lit(1.1))) == 27
    assert [one(spark, S.review_interval(F.lit(n))) for n in (0, 1, 2, 5, 9)] == [1, 1, 3, 30, 30]


def test_stars_and_times(spark):
    assert one(spark, S.stars(F.lit(85))) == "★★★★☆"
    assert one(spark, S.exam_time(F.lit(3725)), S.exam_time(F.lit(65))) == ("1:02:05", "01:05")
    assert one(spark, S.study_time(F.lit(0)), S.study_time(F.lit(60)), S.study_time(F.lit(61))) == ("0분", "1시간", "1시간 1분")


def test_url(spark):
    assert one(spark, S.url_part(F.lit("a b(c)!"))) == "a%20b(c)!"


def events(spark, rows):
    base = datetime.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, base + datetime.timedelta(minutes=i), "question_answer", q, p, c) for i, (q, p, c) in enumerate(rows)], "event_id long, ts timestamp, type string, question_id int, pattern_id int, correct boolean")


def test_wrong_streaks(spark):
    e = events(spark, [(1, 1, False), (1, 1, False), (1, 1, True), (1, 1, False), (2, 1, False), (2, 1, True), (3, 2, False), (3, 2, False)])
    assert {(r.question_id, r.wrong_count) for r in state.wrong_streaks(e).collect()} == {(1, 1), (3, 2)}
    assert {(r.question_id, r.correct) for r in state.latest_attempts(e).collect()} == {(1, False), (2, True), (3, False)}
    w = {r.pattern_id: (r.question_count, r.total_wrong) for r in A.wrong_by_pattern(state.wrong_streaks(e)).collect()}
    assert w == {1: (1, 1), 2: (1, 2)}


def test_moving_average_skips_gaps(spark):
    rows = [(datetime.date(2024, 1, d), c) for d, cs in ((25, [True, False]), (27, [True] * 4 + [False])) for c in cs]
    e = spark.createDataFrame(rows, "date date, correct boolean").withColumn("type", F.lit("question_answer"))
    got = [(r.accuracy, r.moving_average) for r in A.timeline_accuracy(spark, e, "2024-01-30", 6).orderBy("date").collect()]
    assert got == [(50, 50.0), (None, 50.0), (80, 65.0), (None, 80.0), (None, 80.0), (None, None)]


def test_exam_grading(spark):
    q = spark.createDataFrame([(i, "p", 2020, 1) for i in (1, 2, 3)], "question_id int, pattern_id string, year int, answer int")
    a = spark.createDataFrame([(7, 1, 1), (7, 2, 1), (7, 3, None)], "session_id int, question_id int, selected int")
    r = exam.grade(exam.details(a, q)).first()
    assert (r.total, r.answered, r.correct, r.accuracy, r.score, r.passed) == (3, 2, 2, 66.7, 67, True)


def test_pattern_tables(spark):
    q = spark.createDataFrame([(i, "p", "c", y) for i, y in enumerate((2018, 2019, 2021, 2023, 2023))], "question_id int, pattern_id string, chapter_id string, year int")
    t = content.pattern_table(q)
    assert t.select("grade", "importance", "frequency").first() == ("S", 70, 5)
    s = content.statistics_table(t).first()
    assert (s.recent_years, s.priority) == ([2023], "HIGH")


def test_interpolation_and_pages(spark):
    m = spark.createDataFrame([(1, 41, 100), (1, 43, 160), (1, 50, 300)], "id int, number int, position long")
    assert {(r.number, r.position) for r in extract.interpolated(m, "id").collect()} == {(41, 100), (42, 130), (43, 160), (50, 300)}
    d = spark.createDataFrame([(1, "a" * 10 + "\n" + "b" * 20)], "id int, text string")
    o = spark.createDataFrame([(1, 10), (1, 11)], "id int, offset long")
    assert {(r.offset, r.page) for r in extract.page_asof(o, extract.pages(d, "id", "text"), "id").collect()} == {(10, 1), (11, 2)}


def test_display_text(spark):
    assert one(spark, X.space_terms(F.lit("기말재고자산"), ["재고자산"])) == "기말 재고자산"
    assert one(spark, X.format_numbers(F.lit("10000원, W1000000"))) == "10,000원, W1,000,000"
    assert one(spark, X.format_numbers(F.lit("20x1 1234.5678 999"))) == "20×1 1,234.5678 999"
    assert one(spark, X.clean_display(F.lit("기말재고자산은10000원이다.A-01-2"), terms=("재고자산",))) == "기말 재고자산은 10,000 원이다."
    assert one(spark, X.longest_run(F.lit("가나 다라마")), X.unformatted_numbers(F.lit("1,000 2000 30"))) == (3, 1)


def test_segments_and_choices(spark):
    d = spark.createDataFrame([(1, "x 3. no 1. 첫 문제? ① a ② b ③ c ④ d ⑤ e 2. second 1.5 ① f")], "id int, text string")
    b = extract.bodies(d, extract.markers(d, "id", "text", 1, 5), "id", "text")
    rows = {r.number: (r.c, r.s) for r in b.select("number", extract.choices(F.col("body")).alias("c"), extract.stem(F.col("body")).alias("s")).collect()}
    assert rows == {1: (["a", "b", "c", "d", "e"], "첫 문제?"), 2: ([], "second 1.5")}
    assert one(spark, extract.markdown_table(F.lit("a\tb\nnone\nc  d"))) == "| a | b |\n| --- | --- |\n| c | d |"


def test_longest_common(spark):
    p = spark.createDataFrame([("x" + "abcdefghij" * 3, "abcdefghij" * 3 + "y"), ("short", "short"), (None, "a")], "a string, b string")
    assert [r.lcs for r in extract.longest_common(p, "a", "b").collect()] == [30, 0, 0]


def test_quality_rules(spark):
    d = spark.createDataFrame([(1, ["a", "b", "c", "d", "e"], 2, 2), (2, ["a", "a", "", "①", None], 6, 5)], "id int, choices array<string>, answer int, idx int")
    rules = quality.choice_rules(F.col("choices")) + quality.answer_rules(F.col("answer"), F.col("idx"), F.col("choices"))
    found = quality.issues(d, "id", rules)
    assert {r.category for r in found.collect()} == {"choice_empty", "choice_marker", "choice_duplicate", "answer_range", "answer_index"}
    assert quality.grade(found).first()["grade"] == "D"


def test_dominant_type_and_reasons(spark):
    q = spark.createDataFrame([(1, 1, "concept"), (2, 1, "mixed"), (3, 1, "mixed"), (4, 2, "concept"), (5, 2, "mixed")], "question_id int, pattern_id int, question_type string")
    assert {(r.pattern_id, r.question_type) for r in recommend.dominant_types(q).collect()} == {(1, "mixed"), (2, "concept")}


def test_lines(spark):
    from learnspark.functions import lines as L

    assert one(spark, L.soft_joined(F.lit("재고는\n1,000\n원이다.\n다음 중?\n① a\n② b\n\nend-\nless"))) == "재고는 1,000 원이다.\n다음 중?\n① a\n② b\n\nendless"
    assert one(spark, L.exam_symbols(F.lit("AA. 다음? # 100 # 200 ￦5"))) == "44. 다음? ① 100 ① 200 W5"
    assert one(spark, L.units(F.lit("W1,000 5% 20×1년 30원"))) == ["20×1", "20×1년", "30원", "5%", "W1,000"]


def test_answer_texts(spark):
    from learnspark.operators import reports

    t = spark.createDataFrame([("a", "41.2 42. 3 43: 9 41.4"), ("b", "x")], "k string, t string")
    assert {tuple(r) for r in reports.answer_pairs(t, "k", "t", 41, 80).collect()} == {("a", 41, 4), ("a", 42, 3)}
    c = spark.createDataFrame([("a", "9 412 423 431"), ("b", "")], "k string, t string")
    assert {tuple(r) for r in reports.compact_answers(c, "k", "t", 41, 80).collect()} == {("a", 41, 2), ("a", 42, 3), ("a", 43, 1)}


def test_percent_change(spark):
    from learnspark.operators import reports

    assert one(spark, reports.percent_change(F.lit(198), F.lit(16)), reports.percent_change(F.lit(0), F.lit(124)), reports.percent_change(F.lit(0), F.lit(0))) == ("-91.9%", "+124", "0%")


def test_coverage_of_changed_stems(spark):
    r = random.Random(5)
    source = "".join(r.choice("abcdefgh") for _ in range(30_000))
    short = source[:200]
    pairs = [(1, source[:29_000] + "#" + source[29_001:], source), (2, short[:130] + "#" + short[131:], short), (3, short[:20] + "#", short), (4, short[:180], short), (5, None, short)]
    p = spark.createDataFrame(pairs, "id int, q string, s string")
    got = {r.id: r.c for r in p.select("id", extract.coverage(F.col("q"), F.col("s")).alias("c")).collect()}
    assert got == {1: 29_000 / 30_000, 2: 130 / 200, 3: 0.0, 4: 0.9, 5: 0.0}
    found = reports.source_issues(p, "id", "q", "s", "a-h", 10**6).collect()
    assert {(r.id, r.category) for r in found} == {(2, "stem_short"), (3, "stem_truncated"), (5, "stem_truncated")}
    for _ in range(300):
        x, y = ("".join(r.choice("ab") for _ in range(r.randint(0, 12))) for _ in range(2))
        want = max((j - i for i in range(len(x)) for j in range(i + 1, len(x) + 1) if x[i:j] in y), default=0)
        assert extract._common(x, y, 1) == want

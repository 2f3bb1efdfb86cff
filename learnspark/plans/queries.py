"""One function per registered query, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnspark.functions import scores as S
from learnspark.functions import text as X
from learnspark.operators import analytics as A
from learnspark.operators import content, exam, extract, quality, recommend, reports, state
from learnspark.sources import model as M

#: Letters and footers of the test tables' documents, in place of Hangul and exam footers.
LETTERS = "a-zA-Z"
FOOTERS = (r"\n?[ ]*All rights reserved[^\n]*", r"\n?[ ]*This work is licensed[^\n]*")
#: Keyword rules for the test tables' documents.
RULES = (("license", ("licensed under", "All rights reserved")), ("pipe_table", (" | ",)), ("shout", ("!!",)), ("tion", ("tiontion",)))


def _learner(spark: SparkSession, d: str):
    e, q, p = M.learning_events(spark, d), M.questions(spark), M.patterns(spark)
    latest, wrongs = state.latest_attempts(e), state.wrong_streaks(e)
    return e, q, p, latest, wrongs, A.pattern_analytics(p, q, latest, wrongs)


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    _, q, _, _, _, a = _learner(spark, d)
    return recommend.pattern_metrics(a, q, M.ANCHOR)


def timeline_daily(spark, d):
    return A.timeline_daily(spark, M.learning_events(spark, d), M.ANCHOR)


def timeline_accuracy(spark, d):
    return A.timeline_accuracy(spark, M.learning_events(spark, d), M.ANCHOR)


def timeline_summary(spark, d):
    return A.timeline_summary(spark, M.learning_events(spark, d), M.ANCHOR)


def tutor_usage(spark, d):
    return A.tutor_usage(M.learning_events(spark, d))


def tutor_daily(spark, d):
    return A.tutor_daily(spark, M.learning_events(spark, d), M.ANCHOR)


def hour_histogram(spark, d):
    return A.hour_histogram(spark, M.learning_events(spark, d), M.ANCHOR)


def peak_hour(spark, d):
    return A.peak_hour(spark, M.learning_events(spark, d), M.ANCHOR)


def top_pattern(spark, d):
    return A.top_pattern(M.learning_events(spark, d), M.patterns(spark), M.ANCHOR)


def weak_changes(spark, d):
    return A.weak_changes(M.learning_events(spark, d), M.patterns(spark), M.ANCHOR).select("pattern_id", "name", "early_accuracy", "late_accuracy", "change", "late_answered")


def daily_trend(spark, d):
    return A.daily_trend(state.latest_attempts(M.learning_events(spark, d)))


def study_minutes(spark, d):
    return state.study_minutes(M.learning_events(spark, d))


def latest_attempts(spark, d):
    return state.latest_attempts(M.learning_events(spark, d))


def attempt_counters(spark, d):
    return state.attempt_counters(state.latest_attempts(M.learning_events(spark, d)))


def wrong_streaks(spark, d):
    return state.wrong_streaks(M.learning_events(spark, d))


def answer_durations(spark, d):
    return state.answer_durations(M.learning_events(spark, d))


def running_score(spark, d):
    return state.running_score(M.learning_events(spark, d), M.ANCHOR)


def event_retention(spark, d):
    return state.retained(M.learning_events(spark, d)).select("event_id", "type", "question_id", "duration")


def study_sessions(spark, d):
    return state.study_sessions(M.learning_events(spark, d))


def pattern_progress(spark, d):
    return A.pattern_progress(M.questions(spark), state.latest_attempts(M.learning_events(spark, d)))


def wrong_by_pattern(spark, d):
    return A.wrong_by_pattern(state.wrong_streaks(M.learning_events(spark, d)))


def pattern_analytics(spark, d):
    return _learner(spark, d)[5].select("pattern_id", "grade", "total", "answered", "correct", "correct_percent", "question_count", "total_wrong", "last_study_at", "weakness_score", "weakness_level")


def weak_top(spark, d):
    return A.weak_top(_learner(spark, d)[5]).select("pattern_id", "weakness_score", "total_wrong")


def overall_stats(spark, d):
    e, _, _, latest, wrongs, a = _learner(spark, d)
    return A.overall_stats(latest, wrongs, a, e)


def dashboard(spark, d):
    return A.dashboard(_learner(spark, d)[5])


def vulnerability(spark, d):
    _, _, p, _, wrongs, _ = _learner(spark, d)
    return A.vulnerability(p, wrongs)


def wrong_entries(spark, d):
    _, q, p, _, wrongs, _ = _learner(spark, d)
    return A.wrong_entries(wrongs, q, p)


def wrong_summary(spark, d):
    _, q, p, _, wrongs, _ = _learner(spark, d)
    return A.wrong_summary(A.wrong_entries(wrongs, q, p), A.vulnerability(p, wrongs))


def pattern_metrics(spark, d):
    return _metrics(spark, d).select("pattern_id", "importance_score", "weakness_score", "recency_score", "exam_probability", "study_days", "wrong_days", "score")


def reasons(spark, d):
    return _metrics(spark, d).select("pattern_id", F.array_join("reasons", "|").alias("reasons"))


def rec_daily(spark, d):
    return recommend.daily(_metrics(spark, d)).select("rank", "pattern_id", "score")


def rec_weak(spark, d):
    return recommend.weak(_metrics(spark, d)).select("rank", "pattern_id", "score", "level", "total_wrong", "correct_percent")


def rec_review(spark, d):
    _, q, p, _, wrongs, _ = _learner(spark, d)
    r = recommend.review(recommend.review_entries(wrongs, q, p, M.ANCHOR))
    return r.select("rank", "question_id", "wrong_count", "priority_score", "due", "score", F.array_join("reasons", "|").alias("reasons"))


def _details(spark, d):
    return exam.details(M.exam_answers(spark, d), M.exam_questions(spark, d))


def exam_grade(spark, d):
    return exam.grade(_details(spark, d))


def exam_pattern_stats(spark, d):
    return exam.pattern_stats(_details(spark, d))


def exam_weak(spark, d):
    return exam.weak_patterns(exam.session_pattern_stats(_details(spark, d)))


def exam_advice(spark, d):
    x = _details(spark, d)
    found = exam.advice(exam.grade(x), exam.weak_patterns(exam.session_pattern_stats(x)))
    return found.groupBy("kind").agg(F.count("*").alias("rows"), F.count_distinct("session_id").alias("sessions"), F.count_distinct("pattern_id").alias("patterns"))


def exam_history(spark, d):
    return exam.history(exam.grade(_details(spark, d)))


def exam_newest(spark, d):
    return exam.newest(exam.grade(_details(spark, d))).select("session_id", "score", "passed")


def exam_sample(spark, d):
    return exam.sample(M.exam_questions(spark, d), 40).select("question_id", "pattern_id")


def pattern_table(spark, d):
    return content.pattern_table(M.exam_questions(spark, d)).withColumn("years", F.array_join("years", ","))


def statistics_table(spark, d):
    t = content.statistics_table(content.pattern_table(M.exam_questions(spark, d)))
    return t.withColumn("years", F.array_join("years", ",")).withColumn("recent_years", F.array_join("recent_years", ","))


def choice_histogram(spark, d):
    return content.choice_histogram(M.exam_answers(spark, d), "session_id")


def year_union(spark, d):
    orders = M.read(spark, d, "orders").select(F.year("o_orderdate").alias("year"))
    return content.year_union(M.exam_questions(spark, d), orders)


def round_robin(spark, d):
    return exam.round_robin(M.exam_questions(spark, d), "pattern_id", 60).select("question_id", "pattern_id", "turn")


def first_per_group(spark, d):
    return exam.first_per_group(M.exam_questions(spark, d), "pattern_id", 3).select("question_id", "pattern_id", "turn")


def next_in_pattern(spark, d):
    return content.next_in_pattern(M.exam_questions(spark, d))


def similar_questions(spark, d):
    return content.similar_questions(M.exam_questions(spark, d))


def unlinked(spark, d):
    known = M.exam_questions(spark, d).where(~F.col("pattern_id").endswith("3"))
    return content.unlinked(M.exam_answers(spark, d), known, "question_id").groupBy("question_id").agg(F.count("*").alias("answers"))


def frequency_mismatch(spark, d):
    q = M.exam_questions(spark, d)
    stated = content.pattern_table(q).select("pattern_id", F.when(F.col("pattern_id").endswith("2"), F.col("frequency") + 1).otherwise(F.col("frequency")).alias("frequency"))
    return content.frequency_mismatch(stated, q)


def classify(spark, d):
    return M.documents(spark, d).select("doc_id", X.classified(F.col("text"), RULES, "general").alias("rule"))


def _issues(spark, d):
    rows = M.documents(spark, d).select("doc_id", "text")
    return quality.issues(rows, "doc_id", quality.text_rules(F.col("text"), LETTERS, FOOTERS, 20))


def quality_issues(spark, d):
    return _issues(spark, d)


def quality_crosstab(spark, d):
    return quality.crosstab(_issues(spark, d))


def quality_grade(spark, d):
    return quality.grade(_issues(spark, d))


def completeness(spark, d):
    rows = M.documents(spark, d).join(M.read(spark, d, "labels"), "doc_id", "left")
    checks = {"labelled": F.col("quality").isNotNull(), "good": F.col("quality") == 1, "long": F.length("text") >= 500}
    return quality.completeness(rows, "source", checks)


def invariants(spark, d):
    docs = M.documents(spark, d)
    cleaned = docs.withColumn("text", X.remove_footer(F.col("text"), FOOTERS))
    return quality.invariants(docs, cleaned, "doc_id", ("lang", "source", "text"))


def cleanup_footer(spark, d):
    t = F.col("text")
    new = X.remove_footer(t, FOOTERS)
    return M.documents(spark, d).select("doc_id", F.length(t).alias("before"), F.length(new).alias("after"), F.md5(new).alias("text_md5"), X.has_footer(t, FOOTERS).alias("footer"))


def readability(spark, d):
    t = F.col("text")
    return M.documents(spark, d).select("doc_id", X.longest_run(t, LETTERS).alias("longest_run"), S.rnd(X.space_ratio(t, LETTERS), 6).alias("space_ratio"), X.unformatted_numbers(t).alias("unformatted"))


def readability_summary(spark, d):
    r = readability(spark, d)
    return r.agg(F.max("longest_run").alias("longest"), F.count_if(F.col("longest_run") >= 20).alias("rows_glued"), F.sum("unformatted").alias("unformatted"), F.count("*").alias("rows"))


def number_set_diff(spark, d):
    docs = M.documents(spark, d)
    gone = F.array_except(X.numbers(F.col("text")), X.numbers(F.substring_index("text", "\n", 1)))
    return docs.select("doc_id", F.size(gone).cast("long").alias("n"), F.array_join(X.longest_first(gone, 20), ",").alias("numbers"))


def containment(spark, d):
    stem = F.substring_index("text", ".", 1)
    return M.read(spark, d, "benchmark").select("item_id", S.rnd(X.containment(stem, F.col("text")), 6).alias("coverage"))


def content_hash(spark, d):
    return M.documents(spark, d).select("doc_id", X.short_hash(F.col("text")).alias("hash"))


def segments(spark, d):
    return extract.pages(M.documents(spark, d), "doc_id", "text").select("doc_id", "page", "start", "length")


def page_asof(spark, d):
    offset = F.floor(F.length("text") / 2)
    return M.documents(spark, d).where("text is not null").select("doc_id", offset.alias("offset"), extract.page_at(F.col("text"), offset).cast("long").alias("page"))


def page_lookup(spark, d):
    """Offsets that are not into the text: those of benchmark items, looked up in the pages of the documents of the same number."""
    starts = extract.pages(M.documents(spark, d), "doc_id", "text")
    offsets = M.read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.length("text").cast("long").alias("offset"))
    return extract.page_asof(offsets, starts, "doc_id").select("doc_id", "offset", F.col("page").cast("long").alias("page"))


def year_ffill(spark, d):
    c = M.read(spark, d, "conversations")
    year = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, 2000 + F.col("turn"))
    return extract.forward_fill(c.select("conv_id", "turn", year.alias("year")), "conv_id", "turn", "year")


def marker_interpolation(spark, d):
    a = M.exam_answers(spark, d)
    marks = a.where((F.col("session_id") + F.col("number")) % 3 != 0).groupBy("session_id", "number").agg(F.min("question_id").alias("position"))
    return extract.interpolated(marks, "session_id")


def dedupe_lines(spark, d):
    return extract.distinct_lines(M.documents(spark, d), "doc_id", "text").select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_kept").cast("long").alias("n_kept"), F.md5("text").alias("text_md5"))


def url_links(spark, d):
    return M.exam_questions(spark, d).select("question_id", F.concat(F.lit("question.html?pattern="), S.url_part(F.col("pattern_id")), F.lit("&q="), S.url_part(F.col("question"))).alias("url"))


def exam_sections(spark, d):
    """The sentences of each benchmark item made into numbered questions, every second with two choices only, and parsed again."""
    sentences = F.filter(F.split(F.regexp_replace("text", r"\d+\.", ""), r"\.\s*"), lambda x: F.trim(x) != "")
    one = lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x, F.when(i % 2 == 0, " ① a ② b ③ c ④ d ⑤ e").otherwise(" ① x ② y"))
    docs = M.read(spark, d, "benchmark").select("item_id", F.array_join(F.transform(sentences, one), " ").alias("text"))
    parts = extract.bodies(docs, extract.markers(docs, "item_id", "text", 1, 99), "item_id", "text")
    return parts.select("item_id", "number", F.size(extract.choices(F.col("body"))).cast("long").alias("n_choices"), F.length(extract.stem(F.col("body"))).cast("long").alias("stem_length"))


def _chapters(spark, d):
    """The chapters of the exam questions as patterns, with the grade and importance that their numbers give."""
    return content.pattern_table(M.exam_questions(spark, d).withColumn("pattern_id", F.col("chapter_id")))


def stars(spark, d):
    return _chapters(spark, d).select("pattern_id", S.stars(F.col("importance")).alias("stars"), S.exam_time(F.col("importance") * 97).alias("time"), S.study_time(F.col("importance")).alias("study"))


def stream_daily(spark, d):
    from learnspark.streaming.events import replay_daily

    return replay_daily(spark, d)


def _years(spark, d):
    q = M.exam_questions(spark, d)
    return reports.year_report(q, 150, F.col("question_id") % 10 != 0, F.col("question_id") % 7 != 0)


def year_report(spark, d):
    return _years(spark, d)


def recognition(spark, d):
    return reports.recognition(_years(spark, d))


def issue_rollup(spark, d):
    return reports.issue_rollup(_issues(spark, d))


def sparse_groups(spark, d):
    return reports.sparse_groups(M.exam_questions(spark, d).withColumn("key", F.concat_ws("/", "pattern_id", "chapter_id", "year")), "key", 2)


def required_fields(spark, d):
    rows = M.documents(spark, d).join(M.read(spark, d, "labels"), "doc_id", "left")
    return reports.required_fields(rows, ("doc_id", "text", "lang", "quality", "toxic"))


def source_issues(spark, d):
    docs = M.documents(spark, d).select("doc_id", F.left("text", F.floor(F.length("text") * (40 + F.col("doc_id") % 60) / 100).cast("int")).alias("question"), F.col("text").alias("source_text"))
    return reports.source_issues(docs, "doc_id", "question", "source_text", LETTERS, 20)


def answer_pairs(spark, d):
    a = M.exam_answers(spark, d).where("selected is not null").groupBy("session_id", "number").agg(F.min("selected").alias("a"))
    part = F.concat(F.col("number").cast("string"), F.lit(". "), F.col("a").cast("string"))
    texts = a.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_list(part)), " ").alias("text"))
    return reports.answer_pairs(texts, "session_id", "text", 1, 5)


def stratified_sample(spark, d):
    q = M.exam_questions(spark, d)
    strata = (("recent", F.col("year") >= 2024, 15), ("first_brand", F.col("pattern_id").endswith("1"), 10), ("other", F.lit(True), 5))
    return reports.stratified(q, "question_id", strata).select("question_id", "stratum")


def pattern_fit(spark, d):
    return reports.pattern_fit(M.documents(spark, d), "source", "text", ("tion", "ing", "heit", "elle"))


def text_change(spark, d):
    t = F.col("text")
    n = M.documents(spark, d).groupBy("source").agg(F.sum(F.length(t)).alias("before"), F.sum(F.length(X.remove_footer(t, FOOTERS))).alias("after"))
    return n.withColumn("change", reports.percent_change(F.col("before"), F.col("after")))


def first_of_year(spark, d):
    return reports.first_of(M.exam_questions(spark, d).select("year", "pattern_id", "question_id", "answer"), ("year", "pattern_id"), "question_id")


def same_sets(spark, d):
    q = M.exam_questions(spark, d)
    return reports.same_sets(q.where("question_id % 11 <> 0"), q.where("question_id % 13 <> 0"), "pattern_id", "question_id")


def merged_bodies(spark, d):
    c = M.read(spark, d, "conversations").where("text is not null")
    return extract.merged_bodies(c, ["conv_id", "role"], "turn", "text").select("conv_id", "role", F.md5("text").alias("text_md5"))


def submitted_answers(spark, d):
    return reports.submitted(_details(spark, d)).groupBy("pattern_id", "selected").agg(F.count("*").alias("n"), F.count_if("right").alias("hits"))


def hourly_events(spark, d):
    return reports.hourly(M.learning_events(spark, d))


def user_latest(spark, d):
    return reports.latest_of_user(M.learning_events(spark, d)).groupBy("user_id").agg(F.count("*").alias("questions"), F.count_if("correct").alias("correct"))


def user_sessions(spark, d):
    return reports.session_gaps(M.learning_events(spark, d), minutes=600)


def scaled_bars(spark, d):
    n = M.exam_questions(spark, d).groupBy("pattern_id", "year").agg(F.count("*").alias("n"))
    return reports.scaled(n, "year", "n")


def running_orders(spark, d):
    o = M.read(spark, d, "orders").groupBy("o_custkey", "o_orderkey").agg(F.count("*").alias("n"))
    return reports.running_total(o, "o_custkey", "o_orderkey", "n").select("o_orderkey", "running")

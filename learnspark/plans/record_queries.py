"""Queries over question records: building, validation, counts and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from learnspark.functions import scores as S
from learnspark.functions import text as X
from learnspark.operators import records as R
from learnspark.plans import queries as Q
from learnspark.sources import model as M

EXAM_FOOTER = "\n 제3회 감정평가 A-12-3-[1교시] \n한국산업인력공단 page ( 7 ) 교시 -[ 2 ]"
#: Keyword rules of a topic, for the test tables' documents.
TOPIC = {"apart": ("tiontion", "!!"), "words": ("heit", "tion"), "both": (("and", ("elle", "ing")),)}


def _records(spark, d):
    """Questions of `part` with numbers, stems, choices (some four) and answers (some lacking)."""
    p, key = M.read(spark, d, "part"), F.col("p_partkey")
    all_five = F.transform(F.sequence(F.lit(1), F.lit(5)), lambda k: F.concat(F.col("p_type"), F.lit(" "), k.cast("string")))
    return p.select(
        key.alias("question_id"),
        F.col("p_brand").alias("pattern_id"),
        (2015 + F.col("p_size") % 11).cast("int").alias("year"),
        (1 + key % 40).cast("int").alias("number"),
        F.when(key % 23 != 0, F.col("p_name")).alias("stem"),
        F.when(key % 7 == 0, F.slice(all_five, 1, 4)).otherwise(all_five).alias("choices"),
        F.when(key % 11 != 0, (1 + key % 5).cast("int")).alias("answer"),
        F.col("p_retailprice").alias("price"),
    )


def _patterns(spark, d):
    return M.exam_questions(spark, d).groupBy("pattern_id").agg(F.count("*").alias("frequency"), F.max("year").alias("last_year"))


def question_records(spark, d):
    r = R.record(_records(spark, d))
    return r.select("question_id", F.col("record.questionId").alias("qid"), F.col("record.patternId").alias("pattern"), F.array_join("record.choices", "|").alias("choices"), F.col("record.source.year").alias("year"))


def valid_questions(spark, d):
    return R.split_valid(_records(spark, d))[0].select("question_id", "answer")


def failed_questions(spark, d):
    return R.split_valid(_records(spark, d))[1].select("question_id", "lack")


def _keys(spark, d):
    return M.exam_answers(spark, d).where("selected is not null and question_id % 5 <> 2").groupBy("question_id").agg(F.min("selected").alias("answer"))


def answered_questions(spark, d):
    return R.with_answers(_records(spark, d).select("question_id", "stem"), _keys(spark, d), ["question_id"])[0].select("question_id", "key_answer")


def unanswered_questions(spark, d):
    return R.with_answers(_records(spark, d).select("question_id", "stem"), _keys(spark, d), ["question_id"])[1].select("question_id")


def solved_questions(spark, d):
    """Questions with the solutions of the same year and number."""
    s = _records(spark, d).groupBy("year", "number").agg(F.max("price").alias("price")).where("number % 3 <> 0")
    return R.with_solutions(_records(spark, d).select("question_id", "year", "number"), s).select("question_id", F.col("price").alias("solution"))


def related_in_order(spark, d):
    q = _records(spark, d).select("question_id", F.col("stem").alias("question"))
    asked = q.select(F.col("question_id").alias("key"), F.array(F.col("question_id") + 3, F.col("question_id") - 1, F.col("question_id") * 2).alias("ids"))
    return R.related_in_order(asked, "ids", q).select("key", F.col("pos").cast("int").alias("pos"), "question_id")


def numbered_in_year(spark, d):
    return R.numbered(_records(spark, d), "year", ["question_id"]).select("year", "question_id", F.col("number").cast("int").alias("number"))


def pattern_filter(spark, d):
    return R.only_pattern(_records(spark, d), "Brand#13").select("question_id")


def no_pattern_filter(spark, d):
    return R.only_pattern(_records(spark, d), None).groupBy("pattern_id").agg(F.count("*").alias("n"))


def chapter_filter(spark, d):
    return R.only_pattern(M.exam_questions(spark, d), "ECONOMY", "chapter_id").select("question_id")


def topic_documents(spark, d):
    t = F.col("text")
    return M.documents(spark, d).select("doc_id", R.about(t, F.substring_index(t, "\n", 1), **TOPIC).alias("about"))


def kept_lines(spark, d):
    t = R.kept_lines(F.col("text"), r"[0-9]", r"^[0-9]+$")
    return M.documents(spark, d).select("doc_id", F.md5(t).alias("text_md5"), F.length(t).alias("length"))


def question_tags(spark, d):
    q = _records(spark, d)
    tags = R.tags(F.col("question_id") % 3 == 0, F.col("question_id") % 4 == 0, F.coalesce("stem", F.lit("")), "cold|red")
    return q.select("question_id", F.array_join(tags, ",").alias("tags"))


def shown_tables(spark, d):
    q = _records(spark, d)
    table = F.when(F.col("question_id") % 3 == 0, F.lit(" ")).otherwise(F.col("stem"))
    return q.select("question_id", R.shows_table(F.col("question_id") % 2 == 0, table, F.col("choices"), "^PROMO").alias("shown"))


def detailed_steps(spark, d):
    return M.documents(spark, d).select("doc_id", R.detailed(F.split("text", "\n")).alias("detailed"))


def truncation_causes(spark, d):
    docs = M.documents(spark, d).where("text is not null")
    share = F.left("text", F.floor(F.length("text") * (20 + F.col("doc_id") % 80) / 100).cast("int"))
    choices = F.array_repeat(F.lit("x"), F.when(F.col("doc_id") % 9 == 0, 4).otherwise(5))
    table = F.when(F.col("doc_id") % 4 == 0, F.left("text", F.floor(F.length("text") * 9 / 10).cast("int")))
    return docs.select("doc_id", R.truncation_cause(F.col("text"), share, choices, table).alias("cause"))


def load_errors(spark, d):
    """The load check over all questions, with gaps planted by key."""
    r, key = _records(spark, d), F.col("question_id")
    gone = lambda n, c: F.when(key % n != 0, c)
    q = r.select(
        F.col("question_id").cast("string").alias("questionId"),
        F.when(key % 29 == 0, F.lit("Brand#99")).otherwise(F.col("pattern_id")).alias("patternId"),
        F.col("stem").alias("question"),
        "choices",
        "answer",
        gone(13, F.lit("s")).alias("solution"),
        gone(17, F.lit("o")).alias("originalQuestion"),
        F.struct(F.when(key % 31 == 0, F.lit("made_up")).otherwise(F.lit("past_exam")).alias("type"), (F.col("year") + F.when(key % 37 == 0, 1).otherwise(0)).alias("year")).alias("source"),
        "year",
    )
    p = _patterns(spark, d).select(F.col("pattern_id").alias("patternId"), "frequency")
    return R.load_errors(q, p, 240)


def verified_records(spark, d):
    q = _records(spark, d)
    told = q.where("question_id % 10 = 0").select("question_id", F.when(F.col("question_id") % 30 == 0, F.col("year") + 1).otherwise(F.col("year")).alias("year"), "answer")
    return R.verified(told, q.where("question_id % 50 <> 0"), "question_id", ("year", "answer"))


def _reasons(spark, d):
    q = _records(spark, d)
    told = F.map_from_arrays(F.sequence(F.lit(1), F.lit(4)), F.array(F.lit("long enough"), F.lit("short"), F.col("stem"), F.lit("also long enough")))
    return q.select("question_id", "choices", F.coalesce("answer", F.lit(1)).alias("answer"), told.alias("reasons"))


def choice_coverage(spark, d):
    return _reasons(spark, d).select("question_id", R.choice_coverage(F.col("choices"), F.col("answer"), F.col("reasons")).alias("coverage"))


def lacking_reasons(spark, d):
    return R.lacking_reasons(_reasons(spark, d))


def issue_counts(spark, d):
    found = Q.quality_issues(spark, d).join(M.documents(spark, d).select("doc_id", "source"), "doc_id")
    return R.issue_counts(found, "doc_id", "source", "category")


def patterns_of_year(spark, d):
    return R.as_lists(M.exam_questions(spark, d), "year", "pattern_id")


def restore_rates(spark, d):
    t = F.col("text")
    docs = M.documents(spark, d)
    n = lambda c: X.unformatted_numbers(c)
    after = F.regexp_replace(t, r"\d{4,}", "0")
    out = docs.groupBy("source").agg(F.sum(n(t)).alias("before"), F.sum(n(after)).alias("after"))
    return out.select("source", R.restore_rate(F.col("before"), F.col("after")).alias("restored"), R.reduction(F.col("before"), F.col("after")).alias("reduction"))


def common_answers(spark, d):
    return R.most_common(M.exam_answers(spark, d).where("selected is not null"), "question_id", 10)


def categories_by_count(spark, d):
    return R.placed(Q.quality_issues(spark, d).groupBy("category").agg(F.count("*").alias("n")), F.desc("n"), "category")


def patterns_by_grade(spark, d):
    return R.by_grade(Q._chapters(spark, d)).select("place", "pattern_id", "grade", "importance")


def phase_one_patterns(spark, d):
    """The first phase's tables: patterns with 60 and 5 for each question, and their statistics."""
    from learnspark.operators import content

    t = content.pattern_table(M.exam_questions(spark, d).withColumn("pattern_id", F.col("chapter_id")), 60, 5)
    s = content.statistics_table(t)
    return t.select("pattern_id", "grade", "frequency", "importance", F.array_join("years", ",").alias("years")).join(s.select("pattern_id", F.array_join("recent_years", ",").alias("recent_years"), "priority"), "pattern_id")


def wrong_entries_ordered(spark, d):
    return R.placed(Q.wrong_entries(spark, d), F.desc("wrong_count"), F.desc("last_wrong_at"), "question_id").select("place", "question_id", "wrong_count")


def vulnerability_ordered(spark, d):
    return R.placed(Q.vulnerability(spark, d), F.desc("score"), "pattern_id").select("place", "pattern_id", "score")


def questions_ordered(spark, d):
    """By year and number; a sort of all rows, which Spark does by ranges."""
    return _records(spark, d).select("year", "number", "question_id").orderBy("year", "number", "question_id")


def worst_coverage(spark, d):
    return R.placed(Q.containment(spark, d).orderBy("coverage", "item_id").limit(25), "coverage", "item_id")


def class_sample(spark, d):
    return R.by_class(_records(spark, d), "question_id", (F.col("year") == 2025, F.col("price") > 1500, F.lit(True)), 20).select("question_id", "class")


def first_unanswered(spark, d):
    a = M.exam_answers(spark, d)
    return R.first_unanswered(a, "session_id", "number", F.col("selected").isNotNull())


def pattern_chips(spark, d):
    n = M.exam_questions(spark, d).groupBy("pattern_id").agg(F.count("*").alias("n"))
    return R.placed(n, F.desc("n"), "pattern_id")


def session_patterns_named(spark, d):
    """A session's statistics by pattern with the pattern's frequency, 0 where the pattern is unknown."""
    from learnspark.operators import exam

    s = exam.session_pattern_stats(exam.details(M.exam_answers(spark, d), M.exam_questions(spark, d)))
    p = _patterns(spark, d).where("pattern_id <> 'Brand#13'")
    return R.with_pattern(s, p, {"frequency": 0}).select("session_id", "pattern_id", "frequency", "accuracy")


def recommendation_counts(spark, d):
    e, q, p, latest, wrongs, a = Q._learner(spark, d)
    return R.recommendation_counts(a, wrongs)


def exam_footers(spark, d):
    """The extraction's own footers, put into each third document and taken out again."""
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit(EXAM_FOOTER))).otherwise(F.col("text"))
    out = X.remove_footer(t, X.EXTRACTION_FOOTERS)
    return M.documents(spark, d).select("doc_id", X.has_footer(t, X.EXTRACTION_FOOTERS).alias("footer"), F.md5(out).alias("text_md5"))


def glued_runs(spark, d):
    return M.documents(spark, d).select("doc_id", X.glued_run(F.col("text"), Q.LETTERS).alias("run"))


def dates_and_labels(spark, d):
    o = M.read(spark, d, "orders")
    return o.select("o_orderkey", S.wrong_date(F.col("o_orderdate")).alias("date"), S.hour_label(F.col("o_orderkey") % 24).alias("hour"), S.elapsed(F.lit(3600), F.col("o_orderkey") % 3600).alias("elapsed"))


def json_defaults(spark, d):
    e = M.read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 5 == 0, "{broken").when(F.col("event_id") % 7 != 0, F.col("props")).alias("props"))
    return e.select("event_id", R.value_or(F.col("props"), "k int", F.struct(F.lit(-1).alias("k")))["k"].alias("k"))


def merged_defaults(spark, d):
    e = M.read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("event_type"))
    return R.with_defaults(e, {"event_type": "none", "used_tutor": False})


def event_ids(spark, d):
    """Ids that are the same on every run: a hash of the natural key."""
    return M.read(spark, d, "events").select("event_id", S.stable_id(F.col("user_id"), F.col("event_type"), F.col("event_id")).alias("id"))


def choice_years(spark, d):
    return M.exam_questions(spark, d).select("question_id", R.united(F.when(F.col("year") >= 2024, F.array(F.lit("recent"))), F.array("chapter_id"), F.array("chapter_id")).alias("set")).select("question_id", F.array_join("set", ",").alias("set"))


def squeezed_text(spark, d):
    return M.documents(spark, d).select("doc_id", F.md5(X.squeezed(F.col("text"))).alias("text_md5"))


def short_texts(spark, d):
    return M.documents(spark, d).select("doc_id", X.truncated(F.col("text"), 80).alias("short"))


def tutor_samples(spark, d):
    """Pass counts of the checks on a session's answers, and whether all hold."""
    a = M.exam_answers(spark, d).groupBy("session_id").agg(F.count("*").alias("n"), F.count("selected").alias("answered"), F.max("number").alias("last"))
    checks = {"all_answered": F.col("answered") == F.col("n"), "gapless": F.col("last") == F.col("n"), "long": F.col("n") >= 4}
    return R.checked(a, checks, "sessions")


def score_percent(spark, d):
    a = M.exam_answers(spark, d)
    return a.groupBy("number").agg(S.percent(F.count("selected"), F.count("*"), F.lit(0)).alias("answered_percent"))

"""Queries over exam pages: torn lines, choices, tables and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from learnspark.functions import answers, fragments, pages, patterns, spacing
from learnspark.functions import tables as T
from learnspark.operators import cleanup, extract, records, source_truth, tutor
from learnspark.plans import queries as Q
from learnspark.sources import model as M
from learnspark.sources import resolve, torn

#: Terms and prefixes in the syllables of torn.hangul.
TERMS = tuple(word.translate(str.maketrans(torn.LATIN, torn.SYLLABLES)) for word in ("tion", "ation", "heit", "lich", "ung", "ment", "the", "or", "nd", "keit", "tionti"))
PREFIXES = tuple(word.translate(str.maketrans(torn.LATIN, torn.SYLLABLES)) for word in ("be", "re", "an"))


def rejoined_lines(spark, d):
    p = torn.pages(spark, d).select("doc_id", F.size("lines").alias("n_lines"), fragments.rejoined(F.array_join("lines", "\n")).alias("text"))
    return p.select("doc_id", "n_lines", F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).alias("n_left"), "text")


def restructured_lines(spark, d):
    return torn.pages(spark, d).select("doc_id", fragments.restructured(F.array_join("lines", " ")).alias("text"))


def exam_choices(spark, d):
    parsed = extract.with_choices(torn.bodies(spark, d), "body")
    return parsed.select("doc_id", "strategy", F.array_join("choices", "\n").alias("choices"), F.size("choices").alias("n_choices"))


def choice_grids(spark, d):
    return extract.with_choices(torn.bodies(spark, d), "body").select("doc_id", "grid", F.length("rest").alias("rest_length"))


def exam_tables(spark, d):
    return torn.grids(spark, d).withColumn("t", T.table(F.col("body"))).select("doc_id", "t.rest", "t.grid", "t.markdown")


def key_sheets(spark, d):
    return torn.sheets(spark, d).select("doc_id", F.explode(answers.sheet(F.col("text"), 41, 80)).alias("x")).select("doc_id", "x.*")


def worked_answers(spark, d):
    parts = torn.worked(spark, d).select("doc_id", F.explode(answers.solutions(F.col("text"), 41, 80)).alias("x"))
    return parts.select("doc_id", "x.number", answers.resolved(F.col("x.block")).alias("answer"))


def particles_apart(spark, d):
    return torn.hangul(spark, d).select("doc_id", spacing.particles_apart(F.col("text")).alias("text"))


def terms_apart(spark, d):
    return torn.hangul(spark, d).select("doc_id", spacing.terms_apart(F.col("text"), TERMS, PREFIXES).alias("text"))


def accounting_patterns(spark, d):
    t = torn.sentences(spark, d).withColumn("p", patterns.classified(F.col("text")))
    kind = patterns.kind_of_question(F.col("text"), F.split("text", " "))
    return t.select("doc_id", "i", "p.pattern_id", "p.chapter_id", patterns.first_phase(F.col("text")).alias("first_phase"), kind.alias("kind"))


#: Reasons that a question has for its wrong choices, in turn.
REASONS = (("vat", "fifo"), ("avg", "fob_swap", "calc"), ("generic",), ("method", "trial", "no_loss"), ())


def wrong_reasons(spark, d):
    order = F.get(F.array(*[F.array(*map(F.lit, r)).cast("array<string>") for r in REASONS]), ((F.col("doc_id") + F.col("i")) % len(REASONS)).cast("int"))
    t = torn.sentences(spark, d).withColumn("order", order).withColumn("choice", F.element_at(F.split("text", " "), -1))
    reasons = F.map_from_arrays("order", F.transform("order", lambda k: F.concat(F.lit("r_"), k)))
    return t.select("doc_id", "i", patterns.wrong_reason(F.col("text"), F.col("choice"), (F.col("i") % 5 + 1).cast("int"), (F.col("doc_id") % 5 + 1).cast("int"), reasons, F.col("order")).alias("reason"))


def _stored(spark, d):
    """Questions as they may be stored: whole or restructured, with choices that some lost their border, and a table for some."""
    lines, n = torn.pages(spark, d), F.col("doc_id")
    raw = F.array_join("lines", " ")
    choices = F.array(F.when(n % 4 == 0, "W1,000 W2,000").otherwise("W1,000 / W2,000"), F.lit("나"))
    return lines.select("doc_id", raw.alias("stem"), F.when(n % 3 == 0, raw).when(n % 3 == 1, F.concat(raw, F.lit(" ①"))).otherwise(fragments.restructured(raw)).alias("original"), choices.alias("choices"), F.when(n % 2 == 0, "| a |").alias("table"))


def lost_on_the_way(spark, d):
    return source_truth.lost_on_the_way(_stored(spark, d), "doc_id")


def source_slices(spark, d):
    s = source_truth.slices(torn.exam_texts(spark, d), "year", "text")
    return s.select("year", "number", "page", F.length("body").alias("length"), "body_hash", "n_marks", F.array_join("numbers", " ").alias("numbers"), F.array_join("units", " ").alias("units"))


def source_comparison(spark, d):
    """Each document's question, its stem cleaned, against the slice of its year's exam text with its number."""
    q = extract.with_choices(torn.bodies(spark, d), "body").select(
        F.floor(F.col("doc_id") / 40).cast("int").alias("year"), (F.col("doc_id") % 40 + 41).cast("int").alias("number"), "doc_id", extract.stem(F.col("body")).alias("stem"), F.col("rest").alias("original"), "choices", F.col("grid").isNotNull().alias("has_table"), F.col("markdown").alias("table")
    )
    pairs = source_truth.compared(q, source_truth.slices(torn.exam_texts(spark, d), "year", "text"), ["year", "number"], Q.LETTERS)
    return source_truth.source_issues(pairs, "doc_id", Q.LETTERS)


def _years(spark, d):
    return M.read(spark, d, "documents").select((1990 + F.col("doc_id") % 80).cast("int").alias("year")).distinct()


def exam_file_sources(spark, d):
    return resolve.exam_sources(torn.file_listing(spark, d), _years(spark, d))


def answer_file_sources(spark, d):
    keys = M.read(spark, d, "part").select((1990 + F.col("p_partkey") % 70).cast("int").alias("year"), (F.col("p_size") + 30).alias("number"), F.when(F.col("p_partkey") % 3 > 0, 1).alias("answer")).where("number between 41 and 80")
    return resolve.answer_sources(torn.file_listing(spark, d), keys, _years(spark, d))


def cached_texts(spark, d):
    return resolve.caches(torn.file_listing(spark, d), _years(spark, d))


def cleanup_report(spark, d):
    n = F.col("doc_id")
    q = torn.hangul(spark, d).select(n.alias("question_id"), F.col("text").alias("question"), F.concat("text", F.lit(" 12345원")).alias("original"), F.when(n % 2 == 0, "구분 10000").alias("table"), F.slice(F.split("text", r"\."), 1, 5).alias("choices"))
    over = q.where("question_id % 10 = 0").select("question_id", F.lit("기말 재고자산은?").alias("question"), F.lit(None).cast("string").alias("original"), F.lit("표").alias("table"), F.lit(True).alias("has_table"))
    return cleanup.report(q, cleanup.cleaned(q, over, terms=TERMS, prefixes=PREFIXES))


def _headed(spark, d):
    """Documents with headers that name years put between their sentences."""
    n = F.col("doc_id")
    header = F.when(n % 3 == 0, F.concat(F.lit(" "), (2000 + n % 30).cast("string"), F.lit("년 제"), (n % 40).cast("string"), F.lit("회 "))).when(n % 3 == 1, F.concat((1990 + n % 40).cast("string"), F.lit("년도 감정평가사"))).otherwise(" 회계학 41. ")
    return M.read(spark, d, "documents").select("doc_id", F.call_function("array_join", F.split("text", r"\."), header).alias("text"))


def year_sections(spark, d):
    t = _headed(spark, d).select("doc_id", F.posexplode(pages.year_sections(F.col("text"))).alias("i", "x"))
    return t.select("doc_id", "i", "x.*")


def subject_starts(spark, d):
    t = F.col("text")
    return _headed(spark, d).select("doc_id", pages.subject_start(t).alias("start"), pages.page_year(t).alias("year"), F.length(pages.from_marker(t, "회계학")).alias("rest"))


def year_amounts(spark, d):
    """The choices read from the documents' questions, with their labels and pairs of years and amounts."""
    parsed = extract.with_choices(torn.bodies(spark, d), "body").select("doc_id", F.posexplode_outer("choices").alias("i", "choice")).where("choice is not null")
    return parsed.select("doc_id", pages.choice_label(F.col("i") + 1).alias("label"), F.array_join(pages.year_amounts(F.col("choice")), "|").alias("pairs"))


def question_texts(spark, d):
    return torn.pages(spark, d).select("doc_id", pages.question_text(F.array_join("lines", "\n")).alias("text"))


FALLBACK = {"tip": "핵심 원칙을 떠올린다", "explanation": "풀이 준비 중"}


def tutor_sections(spark, d):
    """Questions of `part` with sections merged from rows that suppliers, nations and regions stand for."""
    q = M.read(spark, d, "part").select(F.col("p_partkey").alias("question_id"), (F.col("p_partkey") % 25).cast("int").alias("pattern_id"))
    s, k = M.read(spark, d, "supplier"), F.col("s_suppkey")
    some = lambda on, value: F.when(on, value)
    own = s.select(k.alias("question_id"), some(k % 4 == 0, (k % 7).cast("int")).alias("template_id"), some(k % 5 == 0, F.col("s_name")).alias("title"), some(k % 2 == 0, F.concat(F.lit("why "), F.col("s_name"))).alias("explanation"), some(k % 3 > 0, F.array_repeat(F.col("s_name"), (k % 3 - 1).cast("int"))).alias("steps"), some(k % 6 == 0, F.lit("tip")).alias("tip"))
    n, i = M.read(spark, d, "nation"), F.col("n_nationkey")
    of = n.select(i.cast("int").alias("pattern_id"), F.col("n_name").alias("name"), some(i % 2 == 0, (i % 5).cast("int")).alias("template_id"), some(i % 7 > 0, F.col("n_name")).alias("explanation"), some(i % 3 > 0, F.array("n_name")).alias("steps"), some(i % 4 > 0, F.col("n_name")).alias("tip")).where("pattern_id <> 24")
    r = M.read(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("template_id"), F.col("r_name").alias("title"), F.lit("a = b").alias("formula"), F.array(F.lit("one"), F.col("r_name")).alias("steps"), some(F.col("r_regionkey") % 2 == 0, F.col("r_name")).alias("hook"))
    m = tutor.merged(q, own, of, r, FALLBACK)
    return m.select("question_id", "title", "explanation", F.array_join("steps", "|").alias("steps"), "tip", "has_override")


def quality_gates(spark, d):
    rows = M.read(spark, d, "documents").join(M.read(spark, d, "labels"), "doc_id", "left")
    checks = {"labelled": (F.col("quality").isNotNull(), F.lit(True), 0.3), "good": (F.col("quality") == 1, F.col("quality").isNotNull(), 0.9), "clean_english": (F.col("toxic") == 0, F.col("toxic").isNotNull() & (F.col("lang") == "en"), 0.5), "none": (F.lit(True), F.col("lang") == "xx", 0.1)}
    return tutor.gates(rows, checks)


def exam_records(spark, d):
    """Every document's question as a record, by its fields; its answer is the number of its choices, where there are any."""
    n = F.col("doc_id")
    q = extract.with_choices(torn.bodies(spark, d), "body").withColumns({"p": patterns.classified(F.col("body")), "n_choices": F.size("choices")})
    q = q.withColumns({"year": F.floor(n / 40).cast("int"), "number": (n % 40 + 41).cast("int"), "pattern_id": F.col("p.pattern_id"), "chapter_id": F.col("p.chapter_id"), "stem": extract.stem(F.col("body")), "original": F.col("rest"), "answer": F.nullif("n_choices", F.lit(0))})
    q = q.withColumns({"question_type": F.coalesce("strategy", F.lit("none")), "has_table": F.col("grid").isNotNull(), "has_calculation": F.col("body").contains("W"), "has_figure": F.lit(False), "exam_round": F.lit(None).cast("int"), "source_file": F.lit("exam.txt"), "source_kind": F.lit("text"), "page": F.lit(1), "used_ocr": F.lit(False)})
    r = records.exam_record(q).select("doc_id", "record.*")
    return r.select("doc_id", F.col("questionId").alias("question_id"), F.col("source.questionNumber").alias("number"), F.col("patternId").alias("pattern_id"), F.col("chapterId").alias("chapter_id"), F.col("answerIndex").alias("answer"), F.col("questionType").alias("question_type"), F.col("hasTable").alias("has_table"), F.col("hasCalculation").alias("has_calculation"), F.col("table").alias("table_text"), F.length("originalQuestion").alias("original_length"), F.col("source.type").alias("source_type"))

"""Question records: building, splitting, validating and ordering them, and sets of tables with defaults and fallback."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learnspark.functions.scores import rnd

# Fields that every question must have, and kinds of source that it may name.
REQUIRED = ("questionId", "patternId", "question", "choices", "answer", "solution", "originalQuestion", "source")
SOURCE_TYPES = ("past_exam", "original_exam")
GRADE_ORDER = ("S", "A", "B", "C")


# tables


def chosen_dataset(*wishes: str | None, known: Sequence[str], default: str) -> str:
    """The first wish, in order of precedence, that names a known data set; else the default."""
    return next((w for w in wishes if w in known), default)


def load_set(read: Callable[[str], DataFrame], paths: Mapping[str, str], clean: Callable[[DataFrame], DataFrame] | None = None, cleaned: str = "questions") -> dict[str, DataFrame]:
    """The tables of a data set by name, lazily; the questions cleaned on the way."""
    tables = {name: read(path) for name, path in paths.items()}
    if clean is not None:
        tables[cleaned] = clean(tables[cleaned])
    return tables


def load_valid(sets: Mapping[str, dict[str, DataFrame]], order: Sequence[str], validate: Callable[[dict[str, DataFrame]], DataFrame]) -> tuple[str, dict[str, DataFrame]]:
    """The first data set of the order without a validation error, or the last one; one job for each that is tried."""
    for name in order[:-1]:
        if validate(sets[name]).isEmpty():
            return name, sets[name]
    return order[-1], sets[order[-1]]


def value_or(c: Column, schema: str, default: Column) -> Column:
    """A JSON value, or the default where it is null or no such JSON."""
    return F.coalesce(F.from_json(c, schema, {"mode": "PERMISSIVE"}), default)


def with_defaults(rows: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """rows with each missing column or null value filled from the defaults."""
    have = {c: F.coalesce(F.col(f"`{c}`"), F.lit(v)) if c in rows.columns else F.lit(v) for c, v in defaults.items()}
    return rows.withColumns(have)


# building


def record(q: DataFrame) -> DataFrame:
    """(record): each question as one nested row."""
    source = F.struct(F.lit("past_exam").alias("type"), "year", "number")
    fields = F.struct(F.concat_ws("-", "year", F.lpad(F.col("number").cast("string"), 2, "0")).alias("questionId"), F.col("pattern_id").alias("patternId"), F.col("stem").alias("question"), "choices", "answer", source.alias("source"))
    return q.select("question_id", fields.alias("record"))


#: What every record of an exam question states alike.
ALIKE = {"subjectId": "ACC", "difficulty": "medium"}
SOLUTION_TEXTS = ("summary", "algorithm", "calculationProcess", "explanation", "memoryPoint")


def exam_record(q: DataFrame, source_type: str = "original_exam", exam: str = "APPRAISER") -> DataFrame:
    """q plus `record`, a parsed question as one nested row with its source and an empty solution.

    q has year, number, pattern_id, chapter_id, stem, original, choices, answer, question_type, has_table,
    has_calculation, has_figure, markdown, grid, exam_round, source_file, source_kind, page and used_ocr.
    """
    c = F.col
    qid = F.format_string("ACC_%d_Q%03d", c("year"), c("number"))
    none = F.array().cast("array<string>")
    source = F.struct(F.lit(source_type).alias("type"), F.lit(exam).alias("examId"), c("year"), F.lit(1).alias("round"), c("exam_round").alias("examRound"), c("number").alias("questionNumber"), c("source_file").alias("sourceFile"), c("source_kind").alias("sourceKind"), c("page"), c("used_ocr").alias("usedOcr"))
    solution = F.struct(*[F.lit("").alias(k) for k in SOLUTION_TEXTS], none.alias("steps"), none.alias("wrongAnalysis"))
    record = F.struct(
        qid.alias("questionId"), c("year"), F.lit(ALIKE["subjectId"]).alias("subjectId"), c("chapter_id").alias("chapterId"), c("pattern_id").alias("patternId"), F.lit(ALIKE["difficulty"]).alias("difficulty"), c("original").alias("originalQuestion"), c("stem").alias("question"),
        c("choices"), c("answer"), c("answer").alias("answerIndex"), c("question_type").alias("questionType"), c("has_table").alias("hasTable"), c("has_calculation").alias("hasCalculation"), c("has_figure").alias("figure"),
        F.coalesce(F.nullif("markdown", F.lit("")), c("grid")).alias("table"), F.lit(None).cast("string").alias("formula"), source.alias("source"), solution.alias("solution"),
    )
    return q.withColumn("record", record)


def split_valid(q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, failures): questions with a stem, five choices and an answer; the others with the first thing they lack."""
    lack = F.when(F.coalesce(F.trim("stem"), F.lit("")) == "", "stem").when(F.coalesce(F.size("choices"), F.lit(0)) != 5, "choices").when(F.col("answer").isNull(), "answer")
    told = q.withColumn("lack", lack)
    return told.where("lack is null").drop("lack"), told.where("lack is not null")


def with_answers(q: DataFrame, answers: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(answered, failures): questions joined to answers by number, or by year and number; those without one apart."""
    a = answers.select(*keys, F.col("answer").alias("key_answer"))
    return q.join(a, list(keys)), q.join(a, list(keys), "left_anti")


def related_in_order(rows: DataFrame, ids: str, questions: DataFrame) -> DataFrame:
    """(key, pos, question_id, question) of each row's list of ids: unknown ids are dropped, the order is kept."""
    one = rows.select("key", F.posexplode(ids).alias("pos", "question_id"))
    return one.join(questions.select("question_id", "question"), "question_id")


def numbered(rows: DataFrame, group: str, order: Sequence[str], most: int = 40) -> DataFrame:
    """rows with `number`: their place in the group, up to `most`; only a group's first `most` rows are shuffled."""
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("number", F.row_number().over(w)).where(F.col("number") <= most)


# predicates


def only_pattern(rows: DataFrame, pattern: object | None, column: str = "pattern_id") -> DataFrame:
    """rows of one pattern; all of them where none is asked for."""
    return rows if pattern is None else rows.where(F.col(column) == F.lit(pattern))


def holds_any(c: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def about(text: Column, stem: Column, apart: Sequence[str], words: Sequence[str], both: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Whether a question is about a topic: no word that sets it apart in the stem, and a topic word there or a combination in the text."""
    joint = F.lit(False)
    for word, others in both:
        joint = joint | (text.contains(word) & holds_any(text, others))
    return ~holds_any(stem, apart) & (holds_any(stem, words) | joint)


def kept_lines(c: Column, keep: str, drop: str | None = None) -> Column:
    """The trimmed lines that fit `keep` and not `drop`."""
    lines = F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & x.rlike(keep))
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(drop)) if drop else lines, "\n")


def tags(calculation: Column, has_table: Column, stem: Column, tabular: str) -> Column:
    named = {"calculation": calculation, "concept": ~calculation & ~has_table, "table": has_table, "tabular-stem": stem.rlike(tabular)}
    return F.array_compact(F.array(*[F.when(on, name) for name, on in named.items()]))


def shows_table(has_table: Column, table: Column, choices: Column, pair: str) -> Column:
    """A table is shown where there is one and no choice holds a pair of years."""
    return has_table & (F.coalesce(F.trim(table), F.lit("")) != "") & ~F.exists(choices, lambda c: c.rlike(pair))


def detailed(steps: Column) -> Column:
    """At least three steps, one of them with a digit or an operator."""
    return (F.size(steps) >= 3) & F.exists(steps, lambda s: s.rlike(r"[0-9=×÷+\-]"))


def truncation_cause(before: Column, stem: Column, choices: Column, without_table: Column | None = None) -> Column:
    """Why a stem is shorter than the text before its choices, null where it is not.

    `without_table` is that text without its table, null where there is none; a stem under 0.6 of it lost more than the table.
    """
    bare = lambda c: F.length(F.regexp_replace(c, r"\s+", ""))
    cover = bare(stem) / F.greatest(bare(before), F.lit(1))
    return (
        F.when(F.trim(before) == "", "question_end_fail")
        .when(F.size(choices) != 5, "choice_start_fail")
        .when(bare(stem) == 0, "linebreak_handling")
        .when(cover >= 0.75, None)
        .when(F.lit(False) if without_table is None else F.coalesce(bare(stem) < bare(without_table) * 0.6, F.lit(False)), "table_handling")
        .when(cover >= 0.55, None)
        .when(before.contains("\n"), "linebreak_handling")
        .otherwise("question_end_fail")
    )


def with_solutions(questions: DataFrame, solutions: DataFrame, keys: Sequence[str] = ("year", "number")) -> DataFrame:
    """questions with the columns of the solutions of the same keys, null where there is none."""
    return questions.join(solutions, [*keys], "left")


def with_pattern(stats: DataFrame, patterns: DataFrame, defaults: dict) -> DataFrame:
    """Statistics by pattern with the pattern's columns named in defaults, those where the pattern is unknown."""
    own = patterns.select("pattern_id", *defaults)
    return stats.join(own, "pattern_id", "left").withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def recommendation_counts(analytics: DataFrame, wrongs: DataFrame) -> DataFrame:
    """One row: patterns, studied ones, wrong questions."""
    n = analytics.agg(F.count("*").alias("patterns"), F.count_if(F.col("answered") > 0).alias("studied"))
    return n.join(wrongs.agg(F.count("*").alias("wrong_questions")))  # one row each


def united(*sets: Column) -> Column:
    """The values of all sets, each once, in the order in which they come; null sets are empty."""
    return F.array_distinct(F.concat(*[F.coalesce(s, F.array().cast("array<string>")) for s in sets]))


def checked(rows: DataFrame, checks: dict[str, Column], count: str = "rows") -> DataFrame:
    """One row: rows, how many pass each check, and whether all pass all."""
    n = rows.agg(F.count("*").alias(count), *[F.count_if(c).alias(k) for k, c in checks.items()])
    return n.withColumn("all_pass", F.forall(F.array(*checks), lambda x: x == F.col(count)))


# validation


def table_errors(tables: Mapping[str, DataFrame | None], spark: SparkSession, verified: str | None = None) -> DataFrame:
    """(id, rule): the tables of a data set that are missing, and `verified`, where named, if its pdf_verified is not true."""
    rows = [(name, "missing") for name, t in tables.items() if t is None]
    if verified and tables.get(verified) is not None and not tables[verified].where("pdf_verified").limit(1).count():
        rows.append((verified, "not_verified"))
    return spark.createDataFrame(rows, "id string, rule string")


def load_errors(questions: DataFrame, patterns: DataFrame, expected: int | None = None) -> DataFrame:
    """(id, rule): every broken rule of a data set's load check, a row each; empty where the set is valid.

    questions have the columns of REQUIRED and year; source is a struct of type and year.
    """
    known = patterns.select(F.col("patternId").alias("known")).distinct()
    q = questions.join(known, F.col("patternId") == F.col("known"), "left")
    rules = [(f"missing_{c}", F.col(c).isNull()) for c in REQUIRED]
    rules += [
        ("choices", F.coalesce(F.size("choices"), F.lit(0)) != 5),
        ("answer", F.col("answer").isNull()),
        ("unknown_pattern", F.col("patternId").isNotNull() & F.col("known").isNull()),
        ("source_type", ~F.col("source.type").isin(*SOURCE_TYPES)),
        ("source_year", F.col("source.year") != F.col("year")),
    ]
    told = F.array_compact(F.array(*[F.when(F.coalesce(on, F.lit(False)), name) for name, on in rules]))
    rows = q.select(F.coalesce("questionId", F.lit("?")).alias("id"), F.explode(told).alias("rule"))
    n = questions.groupBy("patternId").agg(F.count("*").alias("n"))
    wrong = patterns.join(n, "patternId", "left").where(~F.col("frequency").eqNullSafe(F.coalesce("n", F.lit(0))))
    rows = rows.union(wrong.select("patternId", F.lit("frequency")))
    one = lambda df, name: df.agg(F.count("*").alias("n")).where("n = 0").select(F.lit(name), F.lit("empty"))
    rows = rows.union(one(patterns, "patterns")).union(one(questions, "questions"))
    if expected is not None:
        rows = rows.union(questions.agg(F.count("*").alias("n")).where(F.col("n") != expected).select(F.lit("questions"), F.lit("count")))
    return rows


def verified(records: DataFrame, table: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, field): fields in which a verified record is not what the table has; field `row` where the table has none."""
    t = table.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    fields = F.when(F.col("_key").isNull(), F.array(F.lit("row"))).otherwise(F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), c) for c in columns])))
    return records.join(t, F.col(key) == F.col("_key"), "left").select(key, F.explode(fields).alias("field"))


def choice_coverage(choices: Column, answer: Column, reasons: Column, least: int = 8) -> Column:
    """Share of the wrong choices (by number) with a reason of `least` characters; 1 where there is no wrong choice."""
    wrong = F.filter(F.sequence(F.lit(1), F.size(choices)), lambda k: k != answer)
    told = F.filter(wrong, lambda k: F.length(F.trim(reasons[k])) >= least)
    return F.when(F.size(choices) > 1, rnd(F.size(told) / F.size(wrong), 6)).otherwise(1.0)


def lacking_reasons(rows: DataFrame) -> DataFrame:
    """(question_id, choice): wrong choices without a text, of (question_id, choices, answer, reasons)."""
    k = rows.where(F.size("choices") > 0).select("question_id", "answer", "reasons", F.explode(F.sequence(F.lit(1), F.size("choices"))).alias("choice"))
    return k.where((F.col("choice") != F.col("answer")) & (F.coalesce(F.trim(F.col("reasons")[F.col("choice")]), F.lit("")) == "")).select("question_id", "choice")


# counts


def issue_counts(issues: DataFrame, key: str, group: str, issue: str) -> DataFrame:
    """(group, issue, n, affected): issues and distinct questions with them."""
    return issues.groupBy(group, issue).agg(F.count("*").alias("n"), F.count_distinct(key).alias("affected"))


def as_lists(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, values): the distinct values of a group, sorted; for groups with few distinct values."""
    return rows.groupBy(group).agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias("values"))


def restore_rate(lost_before: Column, lost_after: Column) -> Column:
    """Percent of losses put right, 100 where there were none; one decimal."""
    return F.when(lost_before == 0, 100.0).otherwise(rnd((lost_before - lost_after) / lost_before * 100, 1))


def reduction(before: Column, after: Column) -> Column:
    """Percent by which a count fell; 0 where it was 0."""
    return F.when(before == 0, 0.0).otherwise(rnd((before - after) / before * 100, 1))


def most_common(rows: DataFrame, value: str, k: int) -> DataFrame:
    """(value, n): the k most frequent, equals by value."""
    return rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(k)


# orders


def by_grade(patterns: DataFrame) -> DataFrame:
    """Patterns by grade S, A, B, C, others, then falling importance, with their `place`."""
    turn = F.coalesce(F.array_position(F.array(*map(F.lit, GRADE_ORDER)), F.col("grade")), F.lit(0))
    return placed(patterns, F.when(turn == 0, len(GRADE_ORDER) + 1).otherwise(turn), F.desc("importance"), "pattern_id")


def placed(rows: DataFrame, *order: Column | str) -> DataFrame:
    """rows with `place`, from 1 in the order; for reports of a bounded number of rows (one task numbers them)."""
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def by_class(rows: DataFrame, key: str, classes: Sequence[Column], n: int) -> DataFrame:
    """n rows: those of the first class by key, then of the second that are in none before, and so on; `class` from 1."""
    kind = F.lit(None).cast("int")
    for k, fits in reversed(list(enumerate(classes, 1))):
        kind = F.when(fits, k).otherwise(kind)
    return rows.withColumn("class", kind).where("class is not null").orderBy("class", key).limit(n)


def first_unanswered(rows: DataFrame, group: str, order: str, answered: Column) -> DataFrame:
    """(group, first): the first row of each group that is not answered, or else its first."""
    return rows.groupBy(group).agg(F.coalesce(F.min(F.when(~answered, F.col(order))), F.min(order)).alias("first"))

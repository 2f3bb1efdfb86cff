"""Stored questions against the source that they were taken from: slices of the source by number, joined by key, and what differs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnspark.functions import lines
from learnspark.functions import text as X
from learnspark.functions.choices import before_choices
from learnspark.operators import extract
from learnspark.operators.quality import issues

# Footers of stored texts, each behind the words that it has one of, shapes of what was lost on the way, and limits of the comparison.
STORED_FOOTERS = ((("A-", "a-"), r"(?i)A-\d{2}-\d{1,2}(?:-\[\d교시\])?"), (("교시",), r"(?i)교시\s*-\[\s*\d\s*\]"), (("한국산업",), r"한국산업"), (("청렴한감정평가",), r"청렴한감정평가"))
LOST = (
    ("empty_paren_year", r"\(\s*\)\s*년"),
    ("missing_year_pair", r"년\s*과\s*년\s*에"),
    ("missing_year_pair_genitive", r"년\s*과\s*년\s*의"),
)
DATE_PARTS, WHOLE_DATE = r"년\s*월\s*일", r"20[×xX]\d{1,2}\s*년\s*\d{1,2}\s*월\s*\d{1,2}\s*일"
HEADER_IN_STEM = r"\?\s*년\s+20[×xX]\d{1,2}\s+년\s+20[×xX]\d{1,2}"
MERGED_CHOICE = r"^W[\d,]+ W[\d,]+$"
COVERED, GLUED, MANY_NUMBERS, MANY_LOST, LONG_STEM = 0.55, 12, 20, 3, 200


def slices(texts: DataFrame, key: str, text: str, low: int = 41, high: int = 80, page_mark: str = "\f") -> DataFrame:
    """(key, number, body, page, body_hash, n_marks, numbers, units): the source of each question from its number mark to the next one.

    Numbers lacking between close neighbours are put in by their places. Numbers and units are those of
    the body without footers and its own number. The text of a key is joined once, not once a number, and read once.
    """
    texts = texts.where(F.col(key).isNotNull())  # on both sides of the join, so that these are one shuffle
    marks = extract.interpolated(extract.markers(texts, key, text, low, high), key)
    packed = marks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "number"))).alias("spans"))
    rows = texts.select(key, text).join(packed, key).withColumn("pieces_", _cut(F.col(text), F.col("spans.position")))
    breaks = F.transform("pieces_", lambda x: F.length(x) - F.length(F.replace(x, F.lit(page_mark), F.lit(""))))
    page = lambda n, i: F.aggregate(F.slice(n, 1, i + 1), F.lit(1), lambda a, b: a + b)
    own = X.let(breaks, lambda n: F.transform("spans", lambda s, i: F.struct(s["number"].alias("number"), F.trim(F.get("pieces_", i + 1)).alias("body"), page(n, i).alias("page"))))
    out = rows.select(key, F.explode(own).alias("s")).select(key, "s.*")
    bare = F.regexp_replace(X.remove_footer(F.col("body"), X.EXTRACTION_FOOTERS), r"^\d{1,2}\.", "")
    return out.withColumn("bare_", bare).select(
        key, "number", "body", "page", X.short_hash(F.col("body")).alias("body_hash"), X.choice_marks(F.col("body")).alias("n_marks"), X.numbers(F.col("bare_")).alias("numbers"), lines.units(F.col("bare_")).alias("units")
    )


def _cut(text: Column, places: Column) -> Column:
    """The text cut at ascending places: what is before the first one, then a piece for each; each step goes over its own piece only."""
    none = F.array().cast("array<string>")
    sizes = F.transform(places, lambda p, i: (p - F.coalesce(F.get(places, i - 1), F.lit(0))).cast("int"))
    step = lambda s, n: F.struct(F.substr(s["rest"], n + 1).alias("rest"), F.concat(s["pieces"], F.array(F.left(s["rest"], n))).alias("pieces"))
    return F.aggregate(sizes, F.struct(text.alias("rest"), none.alias("pieces")), step, lambda s: F.concat(s["pieces"], F.array(s["rest"])))


def longest_glued(c: Column, letters: str = X.HANGUL, least: int = GLUED) -> Column:
    """The longest run of letters once spaces are out, 0 where it is shorter than `least`."""
    run = X.glued_run(F.replace(c, F.lit(" "), F.lit("")), letters)
    return F.when(run >= least, run).otherwise(0)


def table_broken(table: Column) -> Column:
    """Neither Markdown nor two lines of two cells or more."""
    rows = F.filter(F.transform(F.split(table, "\n"), F.trim), lambda x: x != "")
    wide = F.filter(rows, lambda x: F.size(F.split(x, r"\s{2,}|\t")) >= 2)
    ruled = table.contains("| ---") | F.replace(table, F.lit(" "), F.lit("")).contains("|---")
    return ~ruled & ((F.size(rows) < 2) | (F.size(wide) < 2))


def compared(questions: DataFrame, sources: DataFrame, keys: Sequence[str], letters: str = X.HANGUL) -> DataFrame:
    """questions (keys, stem, original, choices, has_table, table) left joined to slices by keys, with (cover, lost_numbers, lost_units)."""
    both = questions.join(sources, [*keys], "left").withColumn("body", F.coalesce("body", F.lit("")))
    above = before_choices(F.col("body"))
    stored = F.concat_ws("\n", *[F.nullif(c, F.lit("")) for c in (F.col("stem"), F.col("original"), F.array_join("choices", " "), F.col("table"))])
    rows = extract.with_coverage(both.withColumns({"above": above, "stored": stored}), "cover", F.col("stem"), F.col("above"))
    none = F.array().cast("array<string>")
    kept = lambda c, found: F.when(F.size(c) > 0, F.array_except(c, found)).otherwise(none)
    lost = F.filter(kept(F.col("numbers"), X.numbers(F.col("stored"))), lambda n: n != F.col(keys[-1]).cast("string"))
    return rows.withColumns({"lost_numbers": X.longest_first(lost, MANY_NUMBERS), "lost_units": kept(F.col("units"), lines.units(F.col("stored")))})


def source_issues(pairs: DataFrame, key: str, letters: str = X.HANGUL) -> DataFrame:
    """(key, severity, category): what differs in rows of `compared`; where the source is missing, that alone."""
    there = F.trim("body") != ""
    source_stem = F.regexp_replace(X.remove_footer(F.col("above"), X.EXTRACTION_FOOTERS), r"^\d{1,2}\.", "")
    own, theirs = F.replace("stem", F.lit(" "), F.lit("")), F.replace(source_stem, F.lit(" "), F.lit(""))
    glued = (X.stripped(own) != X.stripped(theirs)) & (X.glued_run(own, letters) > F.greatest(F.lit(GLUED - 1), longest_glued(theirs, letters) + 2))
    footer = F.lit(False)
    for words, p in STORED_FOOTERS:
        footer = footer | (X.has_any(F.col("stored"), words) & F.col("stored").rlike(p))
    blank = F.coalesce(F.trim("table"), F.lit("")) == ""
    has = F.coalesce("has_table", F.lit(False))
    rules = [
        ("critical", "source_missing", ~there),
        ("critical", "choice_markers_source", there & (F.col("n_marks") < 5)),
        ("critical", "choice_count", there & (F.size(F.coalesce("choices", F.array().cast("array<string>"))) != 5)),
        ("critical", "stem_truncated", there & (F.col("cover") < COVERED)),
        ("warning", "missing_numbers", there & (F.size("lost_numbers") >= MANY_LOST)),
        ("warning", "missing_units", there & (F.size("lost_units") > 0)),
        ("warning", "ocr_glued_hangul", there & glued),
        ("warning", "ocr_footer", there & footer),
        ("critical", "table_empty", there & has & blank),
        ("warning", "table_markdown", there & has & ~blank & table_broken(F.col("table"))),
    ]
    return issues(pairs, key, rules)


def lost_on_the_way(questions: DataFrame, key: str) -> DataFrame:
    """(key, severity, category) of stems and choices that lost years, dates or their borders."""
    stem, original = F.coalesce("stem", F.lit("")), F.coalesce("original", F.lit(""))
    same = F.trim(stem) == F.trim(original)
    orphan = stem.rlike(DATE_PARTS) & F.regexp_replace(stem, WHOLE_DATE, "").rlike(DATE_PARTS)
    rules = [("critical", name, stem.rlike(p)) for name, p in LOST]
    rules += [
        ("critical", "missing_date_parts", orphan),
        ("critical", "choice_grid_header_in_stem", stem.rlike(HEADER_IN_STEM)),
        ("critical", "merged_w_choice", F.exists("choices", lambda c: F.trim(c).rlike(MERGED_CHOICE))),
        ("warning", "stem_equals_original_with_table", (F.coalesce("table", F.lit("")) != "") & same),
        ("warning", "possible_duplicate_stem_context", (stem != "") & (original != "") & same & (F.length(stem) > LONG_STEM) & original.rlike(f"[{X.ANY_MARK}]")),
    ]
    return issues(questions, key, rules)

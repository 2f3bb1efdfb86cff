"""What a page text says about itself: where the subject starts, which years its headers name, whole bodies put in order, pairs of years and amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from learnspark.functions import fragments, lines, spacing
from learnspark.functions.choices import MARKS, let
from learnspark.functions.text import EXTRACTION_FOOTERS, remove_footer

# The subject's name, headers that name a year, pairs in choices, and rules of Markdown tables.
SUBJECT = "회계학"
FIRST_NUMBER = r"(?<![\d.])41\.(?!\d)"
HEADER = r"(\d{4})년\s*(?:제(\d+)회|도\s*감정평가사)"
ROUND_HEADER, YEAR_HEADER = r"(\d{4})년\s*제\d+회", r"(\d{4})년도\s*감정평가사"
YEAR_AMOUNT = r"20[×xX]\d{1,2}년\s+W[\d,]+(?:\.\d+)?"
RULE = r"^\|\s*[-:| ]+\|\s*$"


def subject_start(text: Column) -> Column:
    """The place, from 0, where the subject is named, else of the first mark of its first number, else 0; null for a null text."""
    named = F.instr(text, SUBJECT)
    mark = let(F.split(text, FIRST_NUMBER, 2), lambda p: F.when(F.size(p) > 1, F.length(F.get(p, F.lit(0)))).otherwise(0))
    return F.when(text.isNotNull(), F.when(named > 0, named - 1).otherwise(mark))


def from_marker(text: Column, marker: str) -> Column:
    """The text from a marker on, null where it is not found."""
    return let(F.instr(text, marker), lambda at: F.when(at > 0, F.substr(text, at)))


def year_sections(text: Column) -> Column:
    """array<struct<year, round, position>> of the headers that name a year; the round is null where none is named.

    Headers and the lengths of the texts between them are worked out once, places by one pass over both.
    """
    both = F.struct(F.regexp_extract_all(text, F.lit(HEADER), 0).alias("found"), F.transform(F.split(text, HEADER, -1), F.length).alias("gaps"))
    return let(both, lambda s: _placed(s["found"], s["gaps"]))


def _placed(found: Column, gaps: Column) -> Column:
    sizes = F.zip_with(F.slice(gaps, 1, F.size(found)), F.transform(found, F.length), lambda gap, size: F.struct(gap.alias("gap"), size.alias("size")))
    ends = F.aggregate(sizes, F.array(F.lit(0)), lambda at, x: F.array_append(at, F.element_at(at, -1) + x["gap"] + x["size"]))

    def one(h: Column, end: Column) -> Column:
        year, turn = F.left(h, F.lit(4)).cast("int"), F.expr("try_cast(null as int)")
        named = F.regexp_extract(h, HEADER, 2)
        return F.struct(year.alias("year"), F.when(named != "", named.cast("int")).otherwise(turn).alias("round"), (end - F.length(h)).alias("position"))

    return F.zip_with(found, F.slice(ends, 2, F.size(found)), one)


def page_year(text: Column) -> Column:
    """The year that a page's header or footer names, null where there is none; 'n년도 감정평가사' counts before 'n년 제m회'."""
    year = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("int")
    return F.coalesce(year(YEAR_HEADER), year(ROUND_HEADER))


def choice_label(index: Column) -> Column:
    """The circled mark of a choice from 1, its number beyond 5."""
    return F.coalesce(F.get(F.array(*map(F.lit, MARKS)), index - 1), index.cast("string"))


def year_amounts(choice: Column) -> Column:
    """The pairs of a year and an amount in a choice, null where there are fewer than two."""
    return let(F.regexp_extract_all(choice, F.lit(YEAR_AMOUNT), 0), lambda p: F.when(F.size(p) >= 2, p))


def markdown_cells(table: Column) -> Column:
    """Rows of cells of a Markdown table, without its rule."""
    rows = F.filter(F.transform(F.split(F.trim(table), "\n"), F.trim), lambda x: (x != "") & ~x.rlike(RULE))
    return F.transform(rows, lambda r: F.transform(F.split(F.regexp_replace(r, r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)))


def body_in_order(text: Column) -> Column:
    """A body before its fields are read: footers out, torn lines put together, soft breaks joined, clauses put in order; lines stay."""
    whole = fragments.rejoined(remove_footer(F.coalesce(text, F.lit("")), EXTRACTION_FOOTERS))
    return F.trim(fragments.restructured(lines.soft_joined(whole)))


def question_text(text: Column) -> Column:
    """A body in order, with spaces between words and numbers left alone."""
    apart = spacing.particles_apart(body_in_order(text))
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(apart, r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")

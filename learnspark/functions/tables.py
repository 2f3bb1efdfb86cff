"""Tables inside a question's body, as islands in a string of line classes.

Each line has a class: H starts or goes on with a table, D goes on with one, B is blank and goes on with whatever
there is, X ends it. A table line is an H, or a D or B with no X since the last H. Null bodies have no table.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from learnspark.functions.text import ANY_MARK, has_any, let, stripped

# Words of table headers and shapes of lines that are none.
HEADER_WORDS = ("차변", "대변", "구분", "일자", "적요", "예산", "실제", "단일금액", "정상연금", "액면가치", "시장이자율", "상환가치", "연금현재가치")
ENTRIES = ("(차변)", "(대변)")
YEARS_ONLY = r"^(?:년\s*)?(?:20[×xX]\d{1,2}\s*년\s*){1,4}20[×xX]\d{1,2}\s*$"
QUESTION = rf"^(?:\d{{1,2}}\.|[{ANY_MARK}])"
FACTOR = r"\d\.\d{3}"
#: Between cells of a line without tabs: a wide gap, or a blank between a digit and another character. It starts with what most characters are not.
GAP = r"\s(?:\s+|(?<=\d\s)(?=\D)|(?<=\D\s)(?=\d))"
TWO_GAPS = rf"(?s)(?>{GAP}).*?{GAP}"
#: Bars at the ends of a line, each row of bars looked at once.
OUTER_BARS = r"^\|+|\|(?<!\|\|)\|*$"
PLACE = "[TABLE]"
LONGEST_HEADER = 140


def _some(parts: Column) -> Column:
    return F.filter(F.transform(parts, stripped), lambda x: x != "")


def cells(line: Column) -> Column:
    """The cells of a line: by tabs, by wide gaps and between digits and others, or by bars."""
    return let(stripped(line), lambda x: F.filter(F.split(_cells(x), "\t"), lambda c: c != ""))


def _cells(line: Column) -> Column:
    """The cells of a line without blanks around it as one text, by tabs. Gaps end at no blank, so that no cell is blank; patterns are compiled once, which a split by them is not."""
    barred = _some(F.split(F.regexp_replace(line, OUTER_BARS, ""), r"\|"))
    tabs, bars = F.array_join(_some(F.split(line, "\t")), "\t"), F.array_join(barred, "\t")
    return F.when(line.contains("\t"), tabs).when(_by_bars(line), bars).otherwise(F.regexp_replace(line, GAP, "\t"))


def _by_bars(line: Column) -> Column:
    return line.contains("|") & ~line.rlike(GAP)


def line_class(line: Column) -> Column:
    """H, D, B or X of a line without blanks around it; words and cells are looked for where they can make a difference."""
    entry, word = F.lit(False), has_any(line, HEADER_WORDS)
    for e in ENTRIES:
        entry = entry | line.startswith(e)
    two, three = _has_gaps(line, GAP, "\t"), _has_gaps(line, TWO_GAPS, r"(?s)\t.*\t")
    factor = line.contains(".") & line.rlike(FACTOR)
    short = (F.length(line) <= LONGEST_HEADER) | line.startswith("(차변)")
    years = line.contains("년") & F.replace(line, F.lit(" "), F.lit("")).rlike(YEARS_ONLY)
    header = lambda fits: short & fits & ~has_any(line, "?？") & ~years
    numbers = F.when(entry | two | factor, F.when(header(entry | three | factor | word), "H").otherwise("D")).otherwise("X")
    told = F.when(line == "", "B").when(line == PLACE, "H").when(F.left(line, F.lit(3)).rlike(QUESTION), "X")
    return told.when(line.rlike(r"\d"), numbers).when(entry, F.when(header(entry), "H").otherwise("D")).when(header(word & two), "H").otherwise("X")


def _has_gaps(line: Column, gaps: str, tabs: str) -> Column:
    """Whether a line has the gaps, or the tabs between its cells where it has other ones than gaps."""
    return F.when(line.contains("\t") | _by_bars(line), _cells(line).rlike(tabs)).otherwise(line.rlike(gaps))


def table(body: Column) -> Column:
    """(rest, grid, markdown): the body without its table, the rows by tabs, and as Markdown; grid and markdown are null where there is no table.

    A line of one cell goes to the row above it. One row alone is a table only where it has two lines or more.
    """
    lines = F.transform(F.split(body, "\r?\n"), stripped)
    marks = lambda x: F.split(F.regexp_replace(F.array_join(F.transform(x, line_class), ""), r"(?:(?<=H)|(?!^)\G)[DB]", "T"), "")
    return let(lines, lambda x: let(marks(x), lambda m: _table(body, x, m)))


def _table(body: Column, lines: Column, marks: Column) -> Column:
    own = lambda i: F.get(marks, i).isin("H", "T")
    inside = F.filter(lines, lambda x, i: own(i) & (x != "") & (x != PLACE))
    rest = stripped(F.array_join(F.filter(lines, lambda _, i: ~own(i)), "\n"))
    found = let(inside, lambda i: let(F.transform(i, _cells), lambda p: let(_rows(p), lambda r: _drawn(i, p, r))))
    none = F.struct(body.alias("rest"), F.lit(None).cast("string").alias("grid"), F.lit(None).cast("string").alias("markdown"))
    return let(found, lambda x: F.when(x["grid"].isNotNull(), F.struct(rest.alias("rest"), x["grid"].alias("grid"), x["markdown"].alias("markdown"))).otherwise(none))


def _rows(parts: Column) -> Column:
    """Rows of cells as one text, by lines and tabs; a line of one cell goes to the row above it, and nowhere if there is none."""
    placed = F.transform(parts, lambda p: F.when(p.contains("\t"), F.concat(F.lit("\n"), p)).when(p != "", F.concat(F.lit("\t"), p)).otherwise(p))
    return F.regexp_replace(F.array_join(placed, ""), r"^[^\n]*\n?", "")


def _drawn(inside: Column, parts: Column, rows: Column) -> Column:
    some, several = F.filter(parts, lambda p: p != ""), rows.contains("\n")
    grid = F.when(several, rows).when(F.size(inside) >= 2, F.array_join(inside, "\n"))
    return F.struct(grid.alias("grid"), markdown(F.when(several, F.split(rows, "\n")).otherwise(some)).alias("markdown"))


def markdown(rows: Column) -> Column:
    """Rows, their cells by tabs, as a Markdown table as wide as the first one; empty where there are fewer than two."""
    return let(F.get(rows, F.lit(0)), lambda first: let(_tabs(first), lambda n: _markdown(rows, first, n)))


def _tabs(row: Column) -> Column:
    return F.octet_length(row) - F.octet_length(F.replace(row, F.lit("\t"), F.lit("")))


def _markdown(rows: Column, first: Column, tabs: Column) -> Column:
    as_wide = lambda r: F.concat(F.call_function("substring_index", r, F.lit("\t"), tabs + 1), F.repeat(F.lit("\t"), tabs - _tabs(r)))
    others = F.transform(F.slice(rows, 2, 1 << 30), lambda r: F.when(_tabs(r) == tabs, r).otherwise(as_wide(r)))
    lines = F.concat(F.array(first, F.concat(F.lit("---"), F.repeat(F.lit("\t---"), tabs))), others)
    drawn = F.concat(F.lit("| "), F.replace(F.array_join(lines, " |\n| "), F.lit("\t"), F.lit(" | ")), F.lit(" |"))
    return F.when(F.size(rows) >= 2, drawn).otherwise("")

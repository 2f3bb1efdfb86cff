"""Answer choices of a question's body: nine ways to read five of them, and the first that succeeds.

Marks and columns are read as runs of lines: a line that starts with a circled mark opens a block, and
amounts on the lines below it are its further columns, named by the years or letters that stand above
the first mark. Everything is built-in functions. Null bodies have no choices.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from learnspark.functions.text import ANY_MARK, EXTRACTION_FOOTERS, has_any, let, remove_footer, stripped

# Marks, amounts, years, headers and words of the exam texts.
MARKS = "①②③④⑤"
AMOUNT = r"W[\d,]+(?:\.\d+)?"
CELL = rf"(?i)^{AMOUNT}$"
YEAR = r"20[×xX]\d{1,2}"
WORDS = r"[가-힣]{4,}"
THOUSANDS = r"\d{1,3}(?:,\d{3})+"
FOUR_YEARS = rf"년\s+({YEAR})년\s+({YEAR})년\s+{YEAR}년\s+{YEAR}"
COMBINATION = r"[ㄱ-ㅎㅁ]|그|L|드|근|I|II|H"
BOND_WORDS = ("액면가치", "시장이자율", "상환가치", "연금현재가치", "내재이자율", "단일금액")
PAIR_OF_AMOUNTS = r"^W[\d,]+,?\s*W[\d,]+$"
LONGEST = 600
#: A text whose first mark starts a line, blanks before it or not.
FIRST_OF_LINE = rf"\A(?:[^{ANY_MARK}]*\n)?+[ \t\x0B\f\r]*[{ANY_MARK}]"


def none() -> Column:
    return F.array().cast("array<string>")


def _flat(c: Column) -> Column:
    return F.replace(c, F.lit("\n"), F.lit(" "))


def _one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\r?\n"), stripped), lambda x: x != "")


def _marked(line: Column) -> Column:
    """Whether a line starts with a mark."""
    return F.left(line, F.lit(1)).isin(*MARKS)


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), group)


def _clean(c: Column) -> Column:
    return remove_footer(c, EXTRACTION_FOOTERS)


def _five(found: Column) -> Column:
    """The first five, or null where there are fewer."""
    return F.when(F.size(found) >= 5, F.slice(found, 1, 5))


def _times(c: Column) -> Column:
    return F.regexp_replace(c, "[xX]", "×")


def before_choices(body: Column) -> Column:
    return F.split(body, f"[{ANY_MARK}]", 2)[0]


def from_choices(body: Column) -> Column:
    """From the first mark on; empty where there is none."""
    return F.regexp_extract(body, rf"(?s)[{ANY_MARK}].*$", 0)


def headers(body: Column) -> Column:
    """Names of the columns of choices: two years, two letters, or the words of the last line above them."""
    return let(before_choices(body), lambda above: let(F.right(above, F.lit(200)), lambda near: let(_flat(F.right(near, F.lit(120))), lambda end: _headers(above, near, end))))


def _headers(above: Column, near: Column, end: Column) -> Column:
    """The text above is put on one line only where it has words that are looked for there."""
    fours = _all(F.regexp_replace(_flat(above), rf"(?i)({YEAR})\s+년", "$1년"), FOUR_YEARS)
    year = lambda y: F.concat(y, F.lit("년"))
    four = let(F.when(above.contains("년"), fours), lambda x: F.transform(F.slice(_all(_times(F.get(x, F.size(x) - 1)), YEAR), 1, 2), year))
    years = F.array_distinct(F.transform(_all(near, YEAR), _times))
    two = let(years, lambda x: F.when(F.size(x) >= 2, F.transform(F.slice(x, 1, 2), year)))
    fixed = lambda *names: F.array(*map(F.lit, names))
    named = (
        F.when((above.contains("(A)") | above.contains("(a)")) & _flat(above).rlike(r"(?i)\(A\).*\(B\)"), fixed("(A)", "(B)"))
        .when(end.contains("처분손실") & (F.size(_all(end, "할인액")) >= 2), fixed("할인액", "처분손실"))
        .when(end.contains("법인세비용") & end.contains("이연법인세"), fixed("법인세비용", "이연법인세자산", "이연법인세부채"))
    )
    return F.coalesce(four, two, named, none())


def tail_lines(tail: Column) -> Column:
    """The lines of a text from its first mark on, without blank ones."""
    return _lines(tail)


def blocks(lines: Column) -> Column:
    """(mark, parts) of each line that starts with a mark, with the lines up to the next one; empty parts are left out."""
    starts = F.filter(F.transform(lines, lambda x, i: F.when(_marked(x), i + 1)), lambda i: i.isNotNull())

    def block(own: Column) -> Column:
        first = F.get(own, F.lit(0))
        parts = F.filter(F.concat(F.array(stripped(F.substring(first, 2, 1 << 30))), F.slice(own, 2, 1 << 30)), lambda x: x != "")
        return F.struct(F.left(first, F.lit(1)).alias("mark"), parts.alias("parts"))

    own = lambda s: F.transform(s, lambda at, k: F.slice(lines, at, F.coalesce(F.get(s, k + 1), F.size(lines) + 1) - at))
    return F.transform(let(starts, own), block)


def in_columns(cells: Column, names: Column) -> Column:
    """The cells of a choice as one text, each behind its column's name where there are names for them."""
    lines = F.filter(F.transform(cells, _one_line), lambda x: x != "")
    return let(let(lines, lambda x: _split_amounts(x, names)), lambda x: _named(x, names))


def _split_amounts(cells: Column, names: Column) -> Column:
    """The amounts of a single cell without words, as many as there are names."""
    only = F.get(cells, F.lit(0))
    amounts = _all(only, r"W[\d,]+")
    some = lambda x: F.slice(x, 1, F.when(F.size(names) > 0, F.size(names)).otherwise(F.size(x)))
    return let(amounts, lambda x: F.when((F.size(cells) == 1) & ~only.rlike(WORDS) & (F.size(x) >= 2), some(x)).otherwise(cells))


def _named(cells: Column, names: Column) -> Column:
    n = F.least(F.size(cells), F.size(names))
    k = F.when(n >= 3, 3).otherwise(2)
    with_names = F.array_join(F.zip_with(F.slice(names, 1, k), F.slice(cells, 1, k), lambda a, b: F.concat_ws(" ", a, b)), ", ")
    bare = (F.size(cells) >= 2) & ~F.exists(cells, lambda x: x.rlike(WORDS))
    return F.when(n >= 2, with_names).when(bare, F.array_join(F.slice(cells, 1, 2), ", ")).otherwise(F.array_join(cells, " "))


def grid_cells(tail: Column) -> Column:
    """For each mark its amount and, where the next line is one too, the second; marks without an amount are left out."""
    return let(tail, _grid_cells)


def _grid_cells(tail: Column) -> Column:
    def of(mark: str) -> Column:
        both = F.regexp_extract(tail, rf"{mark}\s*({AMOUNT})(?:\s*\n\s*({AMOUNT}))?", 0)
        return let(both, lambda x: F.when(x != "", F.struct(F.lit(mark).alias("mark"), _all(x, AMOUNT).alias("parts"))))

    found = F.filter(F.array(*map(of, MARKS)), lambda x: x.isNotNull())
    return F.when(tail.contains("W"), found).otherwise(F.array().cast("array<struct<mark:string,parts:array<string>>>"))


class Body:
    """What the strategies read: columns of the body and, worked out before, its names, text and lines from the first mark, blocks and grid cells."""

    def __init__(self, body: str, names: str, tail: str, lines: str, blocks: str, cells: str) -> None:
        self.text, self.names, self.tail, self.lines, self.blocks, self.cells = (F.col(f"`{c}`") for c in (body, names, tail, lines, blocks, cells))


def grid(b: Body) -> Column:
    """Amounts in two named columns, the second one on the next line."""
    fits = (F.size(b.names) >= 2) & (F.size(b.cells) == 5) & (F.size(F.get(b.cells, F.lit(0))["parts"]) >= 2)
    pair = lambda p: F.array_join(F.zip_with(F.slice(b.names, 1, 2), p, lambda n, x: F.concat_ws(" ", n, x)), ", ")
    return F.when(fits, F.transform(b.cells, lambda x: F.when(F.size(x["parts"]) >= 2, pair(x["parts"])).otherwise(F.get(x["parts"], F.lit(0)))))


def multicolumn(b: Body) -> Column:
    """A mark's own line and the amount on the line below it."""

    def one(line: Column, i: Column) -> Column:
        below = F.get(b.lines, i + 1)
        cells = F.array(stripped(F.substring(line, 2, 1 << 30)), F.when(below.rlike(CELL), below).otherwise(""))
        return F.when(_marked(line), _clean(in_columns(cells, b.names)))

    return let(F.filter(F.transform(b.lines, one), lambda x: x != ""), _five)


def circled(b: Body) -> Column:
    """The blocks of the marks, or the texts between the marks of a single line."""
    whole = lambda x: F.when(F.get(x["parts"], F.lit(1)).rlike(CELL), in_columns(x["parts"], b.names)).otherwise(_one_line(F.array_join(x["parts"], " ")))
    kept = lambda found: let(F.filter(F.transform(found, _clean), lambda x: (x != "") & (F.length(x) <= LONGEST)), _five)
    inline = []
    for k, m in enumerate(MARKS):
        stop = rf"(?=\s*[{MARKS[k + 1 :]}]|$)" if MARKS[k + 1 :] else "$"
        inline.append(_one_line(F.regexp_extract(F.get(b.lines, F.lit(0)), rf"{m}\s*(.+?){stop}", 1)))
    return F.coalesce(kept(F.transform(b.blocks, whole)), F.when(F.size(b.lines) == 1, kept(F.array(*inline))))


def won(b: Body) -> Column:
    """Lines with a mark and an amount, or marks with amounts anywhere."""
    own = F.filter(b.lines, lambda x, i: _marked(x) & x.rlike(rf"^[{ANY_MARK}]\s*.") & ((i > 0) | b.text.rlike(FIRST_OF_LINE)))
    values = F.transform(own, lambda x: _clean(in_columns(F.array(stripped(F.substring(x, 2, 1 << 30))), b.names)))
    amounts = F.filter(values, lambda x: x.contains("W") | x.rlike(THOUSANDS))
    inline = F.transform(_all(_flat(b.tail), rf"[{ANY_MARK}]\s*((?:W[\d,]+(?:\s*,?\s*)?)+)", 1), lambda x: _one_line(in_columns(F.array(x), b.names)))
    return F.coalesce(let(amounts, _five), let(inline, _five))


def hashes(b: Body) -> Column:
    items = F.filter(_all(_flat(b.text), r"#\s*([^#]{1,220}?)(?=\s*#|$)", 1), lambda x: stripped(x) != "")
    return F.when(b.text.contains("#"), let(F.transform(items, lambda x: _one_line(F.regexp_replace(x, "^[ .]+|[ .]+$", ""))), _five))


def combinations(b: Body) -> Column:
    """Combinations of Hangul letters after the question mark, as read or as misread."""
    after = F.regexp_extract(_one_line(F.regexp_extract(b.text, r"(?s)[?？].*$", 0)), r"[?？]\s*(?:\([^)]*\))?\s*(.+)$", 1)
    misread = _all(after, rf"[{ANY_MARK}]?\s*({COMBINATION})[^{ANY_MARK}]{{0,120}}", 1)
    plain = _all(after, rf"[{ANY_MARK}]\s*([ㄱ-ㅎㅁ][^{ANY_MARK}]{{0,120}})", 1)
    return F.when(has_any(b.text, "?？"), F.coalesce(*[F.transform(let(x, _five), _one_line) for x in (misread, plain)]))


def statements(b: Body) -> Column:
    """Sentences of eight characters or more; the pattern between them starts with what most characters are not."""
    parts = F.split(_flat(F.when(b.tail != "", b.tail).otherwise(b.text)), r"\s(?<=[.:]\s)\s*")
    bare = F.transform(parts, lambda x: F.regexp_replace(x, "^[ .:]+|[ .:]+$", ""))
    return F.transform(let(F.filter(bare, lambda x: F.length(x) >= 8), _five), _one_line)


def bond_tables(b: Body) -> Column:
    """The factors of a bond question's table in five equal groups."""
    known = F.lit(False)
    for w in BOND_WORDS:
        known = known | b.text.contains(w)

    def rows(factors: Column) -> Column:
        size = F.greatest(F.lit(1), F.floor(F.size(factors) / 5).cast("int"))
        starts = F.sequence(F.lit(0), F.greatest(F.least(F.size(factors), size * 5) - 1, F.lit(0)), size)
        return F.when(F.size(factors) >= 4, F.transform(starts, lambda s: F.array_join(F.slice(factors, s + 1, size), " / ")))

    found = let(_all(b.text, r"\d+\.\d{2,4}"), rows)
    return F.when(known & (F.size(_all(b.text, r"\d+(?:\.\d+)?%")) >= 8), let(found, _five))


#: The ways to read choices, in the order in which they are tried.
STRATEGIES = (("grid", grid), ("multicolumn", multicolumn), ("circled", circled), ("won", won), ("hash", hashes), ("combination", combinations), ("statement", statements), ("bond", bond_tables))


def whole_texts(found: Column, b: Body) -> Column:
    """Choices that kept two bare amounts while the others have texts get their whole block."""
    bare = lambda x: F.trim(x).rlike(PAIR_OF_AMOUNTS)
    texts = F.filter(found, lambda x: (F.length(x) > 25) & x.rlike(WORDS))
    whole = F.transform(b.blocks, lambda x: _clean(_one_line(F.array_join(x["parts"], " "))))
    better = F.zip_with(found, whole, lambda x, y: F.when(bare(x) & (F.length(y) > F.length(x)), y).otherwise(x))
    torn = F.exists(found, bare) & (F.size(texts) >= 3) & (F.size(b.blocks) == 5)
    return F.when(torn, better).otherwise(found)


def grid_table(b: Body, strategy: Column) -> Column:
    """Tab-separated rows of choices in two columns: names, then a row for each mark; null where the choices are no such grid."""
    full = F.transform(b.cells, lambda x: F.concat_ws("\t", x["mark"], F.array_join(x["parts"], "\t")))
    second = lambda p: F.when(F.get(p, F.lit(1)).rlike(CELL), F.get(p, F.lit(1))).otherwise("")
    some = F.filter(F.slice(b.blocks, 1, 5), lambda x: F.size(x["parts"]) > 0)
    loose = F.transform(some, lambda x: F.concat_ws("\t", x["mark"], F.get(x["parts"], F.lit(0)), second(x["parts"])))
    rows = F.when(strategy == "grid", full).when((strategy == "multicolumn") & (F.size(b.names) >= 2) & (F.size(some) == 5), loose)
    return F.concat(F.lit("\t"), F.array_join(F.slice(b.names, 1, 2), "\t"), F.lit("\n"), F.array_join(rows, "\n"))

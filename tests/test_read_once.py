"""Values that several rules look at are worked out once: seen in plans, and in results on odd rows."""

import random
import re

from pyspark.sql import functions as F

from learnspark.functions import choices, patterns, tables
from learnspark.operators import extract


def optimized(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def reasoned(spark, rows):
    t = spark.createDataFrame(rows, "stem string, choice string, names array<string>, texts array<string>")
    have = F.map_from_arrays("names", "texts")
    return t.select(patterns.wrong_reason(F.col("stem"), F.col("choice"), F.lit(1), F.lit(2), have, F.col("names")).alias("reason"))


def test_reasons_are_made_once_and_texts_searched_for_words(spark):
    plan = optimized(reasoned(spark, [("a", "b", ["vat"], ["r"])]))
    assert plan.count("map_from_arrays(") == 1 and plan.count("lower(") == 2
    assert plan.count("RLIKE(") == 1  # the digits of a choice


def test_reasons_of_odd_rows(spark):
    none = patterns.NO_REASON
    rows = [
        (None, None, ["vat", "generic"], ["r", "g"], "g"),  # by number: (1 + 2) % 2
        (None, "VAT", ["vat"], ["r"], "r"),
        ("부가", None, ["calc", "vat"], ["c", "r"], "r"),
        ("x", "세금", ["vat", "generic"], ["", "g"], "g"),
        ("x", "할인", ["discount", "generic"], [None, "g"], "g"),
        ("FOB 선적 1", "2", ["generic", "calc", "fob_swap"], ["g", "c", "f"], "f"),
        ("x", "2", ["generic", "calc", "fob_swap"], ["g", "c", "f"], "c"),
        ("x", "٣", ["calc", "trial"], ["c", "t"], "t"),  # only 0 to 9 are digits
        ("Per", "x", ["per_pr", "method"], ["", "m"], "m"),
        ("x", "x", ["trial", "avg"], ["", ""], none),
        ("x", "x", ["trial", "avg"], ["t", None], none),
        ("", "", ["formula"], ["f"], "f"),
        ("x", "x", [], [], none),
        ("x", "x", None, None, none),
    ]
    assert [r.reason for r in reasoned(spark, [r[:4] for r in rows]).coalesce(1).collect()] == [r[4] for r in rows]


BETWEEN_CELLS = re.compile(r"\s{2,}|(?<=\d)\s(?=\D)|(?<=\D)\s(?=\d)", re.ASCII)
BLANKS = " \t\n\v\f\r"


def cells(line):
    """Cells by plain splits."""
    some = lambda parts: [x for x in (p.strip(BLANKS) for p in parts) if x]
    if "\t" in line:
        return some(line.split("\t"))
    parts = some(BETWEEN_CELLS.split(line))
    return some(re.sub(r"\A\|+|\|+\Z", "", line).split("|")) if len(parts) < 2 and "|" in line else parts


def line_class(line):
    if line in ("", "[TABLE]"):
        return "H" if line else "B"
    n, digit, entry = len(cells(line)), re.search("[0-9]", line), line.startswith(("(차변)", "(대변)"))
    word, factor = any(w in line for w in tables.HEADER_WORDS), re.search(r"[0-9]+\.[0-9]{3,4}", line)
    short = len(line) <= 140 or line.startswith("(차변)")
    if re.match(r"[0-9]{1,2}\.|[①-⑤]", line):
        return "X"
    years = re.match(r"(?:년\s*)?(?:20[×xX][0-9]{1,2}\s*년\s*){1,4}20[×xX][0-9]{1,2}\s*\Z", line.replace(" ", ""), re.ASCII)
    if short and not re.search("[?？]", line) and not years and (entry or (n >= 2 and word) or (n >= 3 and digit) or factor):
        return "H"
    return "D" if entry or (n >= 2 and digit) or factor else "X"


def table(body):
    lines, inside, rest, above = [x.strip(BLANKS) for x in re.split("\r?\n", body)], [], [], False
    for line in lines:
        kind = line_class(line)
        above = kind == "H" or (above and kind != "X")
        (inside if above else rest).append(line)
    inside = [x for x in inside if x not in ("", "[TABLE]")]
    rows, parts = [], [cells(x) for x in inside]
    for p in parts:
        if len(p) >= 2:
            rows.append([*p])
        elif rows:
            rows[-1] += p
    grid = "\n".join("\t".join(r) for r in rows) if len(rows) >= 2 else "\n".join(inside) if len(inside) >= 2 else None
    if grid is None:
        return body, None, None
    drawn = rows if len(rows) >= 2 else [p for p in parts if p]
    if len(drawn) < 2:
        return "\n".join(rest).strip(BLANKS), grid, ""
    n = len(drawn[0])
    wide = [drawn[0], ["---"] * n, *[(r + [""] * n)[:n] for r in drawn[1:]]]
    return "\n".join(rest).strip(BLANKS), grid, "\n".join(f"| {' | '.join(r)} |" for r in wide)


def test_tables_are_those_of_plain_splits(spark):
    r = random.Random(5)
    bits = ["차변", "구분", "(대변)", "(차변) 1", "년", "20×1", "20x2년", "가", "b", "1", "12", "0.9091", "0.25", "1.2345", "1,000", "?", "①", "3.", "41.", "[TABLE]", "|", "||", "\t", "\t\t", " ", " ", "  ", "   ", "\f", "\r", "\v", "\u3000", "\u00a0", "\u0661", "😀", "\n", "\n", "\r\n", "글" * 150]
    bodies = ["", " ", "\n", "|", "||\n||", "\t", "구분 1 a\n|", "a 1 b\n1 2 3\n|\n가", "[TABLE]\n[TABLE]", *["".join(r.choices(bits, k=r.randint(1, 60))) for _ in range(6000)]]
    rows = spark.createDataFrame([(b,) for b in [*bodies, None]], "b string").repartition(4).select("b", tables.table(F.col("b")).alias("t")).collect()
    got = {x.b: tuple(x.t) for x in rows}
    assert got.pop(None) == (None, None, None)
    wrong = [(b, t, table(b)) for b, t in got.items() if t != table(b)]
    assert not wrong, wrong[:2]
    assert sum(t[1] is not None for t in got.values()) > 1000


def test_lines_are_not_split_by_patterns(spark):
    """A split compiles its pattern for each line."""
    plan = optimized(spark.createDataFrame([("a",)], "b string").select(tables.table(F.col("b"))))
    assert "arrays_zip" not in plan and not re.search(r"split\(lambda x_\d+#\d+, [^,]*\(\?", plan)


def parsed(spark, texts):
    """Each text with its choices, what `won`, `hashes`, `combinations` and `statements` read alone, its names and cells."""
    b = F.col("b")
    rows = spark.createDataFrame([(t,) for t in texts], "b string").repartition(1).withColumns({"n": choices.headers(b), "t": choices.from_choices(b)})
    rows = rows.withColumns({"l": choices.tail_lines(F.col("t")), "c": choices.grid_cells(F.col("t"))})
    rows = rows.withColumn("k", choices.blocks(F.col("l")))
    body = choices.Body("b", "n", "t", "l", "k", "c")
    return rows.select("b", "n", "c", *[way(body).alias(way.__name__) for way in (choices.won, choices.hashes, choices.combinations, choices.statements)])


def test_marked_lines_are_those_of_the_whole_text(spark):
    five = "".join(f"{m} W{k},000\n" for k, m in enumerate("①②③④⑤", 1))
    amounts = [f"W{k},000" for k in range(1, 6)]
    cases = {
        f"값은?\n{five}": amounts,
        f"값은?\r\n \t{five}": amounts,
        f"\n\n{five}": amounts,
        five: amounts,
        f" \f{five}": amounts,
        f"값은? {five}⑤ W6,000": [*amounts[1:], "W6,000"],  # the first mark ends a line: its amount is not on a line of its own
        f"값은?\u3000{five}⑤ W6,000": [*amounts[1:], "W6,000"],
        f"값은? {five}": amounts,  # by marks with amounts anywhere
        f"\n1\n값은? {five.replace('W', '')}": None,
        "\n" * 3000 + f"값 {five}⑤ W6,000": [*amounts[1:], "W6,000"],
    }
    assert {r.b: r.won for r in parsed(spark, [*cases]).collect()} == cases


def test_choices_of_odd_texts(spark):
    texts = ("", "#", "# a # b # c # d # e", "? ㄱ ① ㄴ ② ㄷ ③ ㄹ ④ ㅁ ⑤", "가나다라마바사아. " * 5, "가나다라마바사아:\n\r " * 5, ". . 가나다라마바사. 1234567.8 90: abcdefgh", "① (a) (B)", "(a)\n(b)①", "(a) (b)①", None)
    got = {r.b: r for r in parsed(spark, texts).collect()}
    assert got[texts[2]].hashes == list("abcde") and got["#"].hashes is None and got[None].hashes is None
    assert got[texts[3]].combinations == list("ㄱㄴㄷㄹㅁ") and got[None].combinations is None
    assert got[texts[4]].statements == ["가나다라마바사아"] * 5 == got[texts[5]].statements
    assert got[texts[6]].statements is None and got[""].statements is None
    assert [got[t].n for t in texts[7:]] == [[], ["(A)", "(B)"], ["(A)", "(B)"], []]
    assert all(r.c == [] for r in got.values())
    cells = {r.b: [(x.mark, x.parts) for x in r.c] for r in parsed(spark, ["① W1\nW2 ② 3 ③W4.5", "① 1"]).collect()}
    assert cells == {"① W1\nW2 ② 3 ③W4.5": [("①", ["W1", "W2"]), ("③", ["W4.5"])], "① 1": []}


def test_whole_texts_are_not_cut_into_lines_for_choices(spark):
    rows = extract.with_choices(spark.createDataFrame([("a",)], "body string"), "body").select("choices")
    plan = optimized(rows)
    assert not re.search(r"split\(body#\d+, \r\?\n", plan)
    assert re.search(r"Contains\(body#\d+, #\)", plan)


def test_bars_inside_a_line_stay(spark):
    lines = ["|a|", "||a||b||", "a||b", "|||", "a|||", "|||a", "|", "a|\u2028", "a||\u2028", "||a|b|c||\u2028", "a |", "1" + "|" * 3000 + "b"]
    got = {r.b: r.c for r in spark.createDataFrame([(x,) for x in lines], "b string").select("b", tables.cells(F.col("b")).alias("c")).collect()}
    assert got == dict(zip(lines, [["a"], ["a", "b"], ["a", "b"], [], ["a"], ["a"], [], ["a\u2028"], ["a\u2028"], ["a", "b", "c\u2028"], ["a"], ["1", "b"]], strict=True))
    plan = optimized(spark.createDataFrame([("a",)], "b string").select(tables.cells(F.col("b"))))
    assert r"|\|+$" not in plan  # would go over a row of bars from each of them

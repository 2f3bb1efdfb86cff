"""Answers of a key sheet or of worked solutions: number and answer pairs, columns of numbers, and prose.

All are built-in functions; null texts have no answers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from learnspark.functions.choices import let

# sheets' headings, marks of a solution and its words, and how answers are written.
SHEET = r"(?s)2교시\s*A[^\n]*.*?(?=2교시\s*B|한국산업|\z)"
SUBJECT = r"(?s)회계\s*학.*"
SHEET_END = r"(?s)(?:한국산업|2교시\s*B).*"
EXPLAINED = "CBT문제은행AI"
RIGHT_ONE, WRONG_ONE = ("옳은 것은?", "옳은 것을"), ("옳지 않", "틀린")
KNOWN = ((("추정치", "유용성"), 5), (("미래 경제적 효익", "원가"), 5))
COMBINATION = r"(?s)A\s*=\s*([0-9,]+).*?B\s*=\s*([0-9,]+)"
FINAL = r"(?:최종 결과|따라서|=)\s*[:\$]?=?\s*([0-9,\.]+)"
#: Pairs that make a sheet complete without reading its columns again.
ENOUGH = 30

_ANSWERS = "array<struct<number:int,answer:int>>"
_ALONE = r"(?<![\p{L}\p{N}_])\d{1,3}(?![\p{L}\p{N}_])"


def _none() -> Column:
    return F.array().cast(_ANSWERS)


def section(text: Column) -> Column:
    """The subject's part of a key sheet, or the sheet where the subject is not named."""
    sheet = F.regexp_extract(text, SHEET, 0)
    return let(F.when(sheet != "", sheet).otherwise(text), _subject)


def _subject(sheet: Column) -> Column:
    part = F.regexp_extract(sheet, SUBJECT, 0)
    after = let(F.substring(part, 6, 1 << 30), lambda x: F.regexp_replace(x, SHEET_END, ""))
    return F.when(part == "", sheet).otherwise(F.concat(F.left(part, F.lit(5)), after))


def pairs(text: Column) -> Column:
    """(number, answer) of a number from 10 to 80 with an answer behind it, in order."""
    found = F.regexp_extract_all(text, F.lit(r"(?<![0-9])(?:4[1-9]|[1-6]\d|7[0-9]|80)[\s.]+[1-5](?![0-9])"), 0)
    return F.transform(found, lambda x: F.struct(F.left(x, F.lit(2)).cast("int").alias("number"), F.right(x, F.lit(1)).cast("int").alias("answer")))


def columns(text: Column, low: int, high: int) -> Column:
    """(number, answer) from numbers that stand alone, from the first `low` on: an answer belongs to the number before it,
    or, where none is, to the next number that has no answer yet; a larger number in range is gone on from."""
    alone = let(F.regexp_extract_all(text, F.lit(_ALONE), 0), lambda x: F.transform(x, lambda v: v.cast("int")))
    return let(alone, lambda n: _columns(let(F.array_position(n, F.lit(low)), lambda at: F.when(at > 0, F.slice(n, at.cast("int"), F.size(n))).otherwise(F.array().cast("array<int>"))), low, high))


def _columns(numbers: Column, low: int, high: int) -> Column:
    """A fold with the next number to be answered; a number asked for leaves it as it is."""
    state = lambda next_, found: F.struct(next_.alias("next"), found.alias("found"))

    def step(s: Column, n: Column) -> Column:
        open_ = s["next"] <= high
        taken = F.concat(s["found"], F.array(F.struct(s["next"].alias("number"), n.alias("answer"))))
        return F.when(open_ & n.between(1, 5), state(s["next"] + 1, taken)).when(open_ & (n > s["next"]) & (n <= high), state(n, s["found"])).otherwise(s)

    return F.aggregate(numbers, state(F.lit(low), _none()), step, lambda s: s["found"])


def sheet(text: Column, low: int, high: int) -> Column:
    """(number, answer) of a key sheet, by number: pairs, over them columns, and columns of the whole sheet where there are fewer than ENOUGH numbers."""
    own = let(section(text), lambda s: F.concat(pairs(s), columns(s, low, high)))
    again = columns(F.replace(text, F.lit("회계학"), F.lit(" ")), low, high)
    return let(own, lambda x: let(F.when(F.size(F.array_distinct(F.transform(x, lambda y: y["number"]))) >= ENOUGH, x).otherwise(F.concat(x, again)), lambda y: _last(y, low, high)))


def _last(found: Column, low: int, high: int) -> Column:
    """The last answer of each number."""

    def one(k: Column) -> Column:
        own = F.filter(found, lambda y: y["number"] == k)
        return F.get(own, F.size(own) - 1)

    return F.filter(F.transform(F.sequence(F.lit(low), F.lit(high)), one), lambda y: y.isNotNull())


def solutions(text: Column, low: int, high: int) -> Column:
    """(number, block) of "n. " at line starts: from the first n to the next n + 1, or to the text's end."""
    parts = F.split(text, r"(?m)^(?=\d{1,2}\. )")
    numbered = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, r"^(\d{1,2})\. ", 1).alias("n"), p.alias("p")))
    return let(numbered, lambda x: _blocks(x, F.transform(x, lambda y: y["n"]), low, high))


def _blocks(parts: Column, numbers: Column, low: int, high: int) -> Column:
    def block(n: Column) -> Column:
        at = F.array_position(numbers, n.cast("string")).cast("int")
        rest = F.slice(parts, F.greatest(at, F.lit(1)), F.size(parts))
        stop = F.array_position(F.transform(rest, lambda y: y["n"]), (n + 1).cast("string")).cast("int")
        own = F.slice(rest, 1, F.when(stop > 0, stop - 1).otherwise(F.size(rest)))
        return F.when(at > 0, F.struct(n.alias("number"), F.array_join(F.transform(own, lambda y: y["p"]), "").alias("block")))

    return F.filter(F.transform(F.sequence(F.lit(low), F.lit(high)), block), lambda x: x.isNotNull())


def resolved(block: Column) -> Column:
    """The answer of one question from its explanation: by its wording, a choice that the explanation quotes, both values
    of a combination, or the last final value that a choice has; null where nothing fits."""
    choices = F.array(*[F.regexp_extract(block, rf"(?m)^{k}\.\s*(.+)$", 1) for k in range(1, 6)])
    why = let(F.instr(block, EXPLAINED), lambda at: F.when(at > 0, F.substr(block, at + len(EXPLAINED))).otherwise(""))
    return let(F.struct(F.left(block, F.lit(160)).alias("head"), choices.alias("choices"), why.alias("why")), _by_rules)


def _by_rules(x: Column) -> Column:
    choices, why = x["choices"], x["why"]
    says = lambda words: F.lit(False) if not words else x["head"].contains(words[0]) | says(words[1:])
    bare = lambda c: F.replace(c, F.lit(","), F.lit(""))

    def first(fits) -> Column:
        """The number of the first choice that fits."""
        return F.get(F.filter(F.transform(choices, lambda c, i: F.when((c != "") & fits(c), i + 1)), lambda i: i.isNotNull()), F.lit(0))

    quoted = lambda size, reach: first(lambda c: F.left(why, F.lit(reach)).contains(F.left(F.trim(c), F.lit(size))))
    known = F.coalesce(*[F.when(why.contains(a) & why.contains(b), n) for (a, b), n in KNOWN])
    both = lambda p: first(lambda c: bare(c).contains(bare(F.regexp_extract(p, COMBINATION, 1))) & bare(c).contains(bare(F.regexp_extract(p, COMBINATION, 2))))
    combination = let(F.regexp_extract_all(why, F.lit(COMBINATION), 0), lambda m: F.when(F.size(m) > 0, let(F.get(m, F.size(m) - 1), both)))
    finals = F.reverse(F.transform(F.regexp_extract_all(why, F.lit(FINAL), 1), bare))
    holds = lambda v: first(lambda c: F.array_contains(F.transform(F.regexp_extract_all(c, F.lit(r"[0-9,\.]+"), 0), bare), v))
    final = F.get(F.filter(F.transform(finals, holds), lambda i: i.isNotNull()), F.lit(0))
    quarter = F.when(why.contains("25%") & F.exists(choices, lambda c: c.contains("25")), 1)
    return F.coalesce(F.when(says(RIGHT_ONE), F.coalesce(known, quoted(18, 700))), F.when(says(WRONG_ONE), quoted(28, 600)), combination, final, quarter)

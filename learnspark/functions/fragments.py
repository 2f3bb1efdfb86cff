"""Lines that a page reader tore apart: years, days, amounts and currency put back into their sentences.

`rejoined` folds the lines of a text, in order, by their kind: single years wait in a queue until a
unit, a day, an amount or a clause of two years takes them. `restructured` then mends what is left
inside the lines by ordered rewrites; a day without its month stays as it is. Null texts stay null,
blank ones become empty.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from learnspark.functions.text import let

# Kinds of torn lines, the words that tie two years to one clause, and the rewrites.
KINDS = (
    ("open", r"\("),
    ("close", r"\)"),
    ("year", r"20[×xX]\d{1,2}"),
    ("amount", r"\d{1,3}(?:,\d{3})+|\d{3,}"),
    ("unit", r"(?:년|월|일|주|원|%).*"),
    ("day", r"\d{1,2}"),
    ("currency", r"[W￦₩]"),
    ("link", r"[과.,;]"),
)
TIES = ("년과", "년에", "각각", "년의")
LOOSE = re.compile(r"년[과에의]|각각과?|과|[()]|\(\)|\((?!.*20[×xX]).*\)", re.S)
Y = r"20[×xX](\d{1,2})"
REWRITES = (
    (r"\(\s*\)\s*(?=[년월일과에의.])", ""),
    (r"년\s*과\s*년\s*에\s*(?=\()", ""),
    (r"년\s*과\s*년\s*의\s*(?=\()", ""),
    (rf"(?i)년\s*과\s*년\s*에\s*각각\s*(?:과\s*)?{Y}\s+{Y}\s+(\d{{1,3}}(?:,\d{{3}})*)\s*W?", "(20×$1)년과 (20×$2)년에 각각 $3W"),
    (rf"(?i)년\s*과\s*년\s*의(\s*[^.?]{{0,60}}?)\s+{Y}\s+{Y}", "(20×$2)년과 (20×$3)년의$1"),
    (rf"(?i){Y}년\s*월\s*일(?:부터|에)?[^0-9]{{0,30}}(\d{{1,2}})\s+(\d{{1,2}})", "20×$1년 $2월 $3일"),
    (r"(?<![0-9])년\s*월\s*일\s*(?=까지|에|과)", ""),
    (r"(?i)월\s*일\s*과\s*월\s*일\s*에\s+[\d,]+W?\s*(\d{1,2})\s+(\d{1,2})\s+(\d{1,2})\s+(\d{1,2})", "$1월 $2일 과 $3월 $4일"),
    (rf"(?i)\.?\s*{Y}\s+(\d{{1,2}})\s+(\d{{1,2}})\s*W(?=\s|[^\n])", "20×$1년 $2월 $3일"),
    (rf"(?i){Y}\s+(\d{{1,2}})\s+(\d{{1,2}})\s+(?=[^\n])", "20×$1년 $2월 $3일 "),
    (rf"{Y}\s+년\s+(\d{{1,2}})\s+월\s+(\d{{1,2}})\s+일", "20×$1년 $2월 $3일"),
    (rf"{Y}\s+월\s+일", "20×$1년 1월 2일"),
)
WHOLE_DATE, EMPTY_DATE = r"20[×xX]\d{1,2}\s*년\s*\d{1,2}\s*월\s*\d{1,2}\s*일", r"년\s*월\s*일\s*"
TRAILING_YEARS = r"(\?)\s*년\s+(?:20[×xX]\d{1,2}\s*년\s*){2,4}20[×xX]\d{1,2}\s*$"

_KIND = re.compile("|".join(f"(?P<{name}>{look})" for name, look in KINDS), re.S)


def kind_of(line: str) -> str:
    found = _KIND.fullmatch(line)
    return found.lastgroup if found else "text"


class Lines:
    """The finished lines, the years that wait, and what is still to be read."""

    def __init__(self, lines: list[str]) -> None:
        self.lines, self.kinds, self.at = lines, [kind_of(x) for x in lines], 0
        self.done: list[str] = []
        self.years: list[str] = []
        self.bracket = False

    def peek(self, n: int = 0) -> str:
        """Kind of the n-th line after the one being read."""
        return self.kinds[self.at + n] if self.at + n < len(self.kinds) else "end"

    def take_currency(self) -> str:
        if self.peek() == "currency":
            self.at += 1
            return "W"
        return ""

    def glue(self, text: str, space: str = " ") -> None:
        """text behind the last line, or as the first one."""
        if self.done:
            self.done[-1] = f"{self.done[-1]}{space}{text}".strip()
        else:
            self.done.append(text)

    def clause(self, pair: list[str], case: str, amount: str = "") -> None:
        """Both years as one clause behind the last line that is more than a loose tie."""
        while self.done and LOOSE.fullmatch(self.done[-1].strip()):
            self.done.pop()
        self.glue(f"({pair[0]})년과 ({pair[1]})년{case}" + (f" 각각 {amount}" if amount else ""))

    def tied(self) -> str:
        """The case of the two waiting years where the last line ends in their tie, or nothing."""
        end = self.done[-1].strip()[-2:] if len(self.years) > 1 and self.done else ""
        return {"년의": "의", "년과": "에", "년에": "에"}.get(end, "")

    def years_ahead(self) -> tuple[list[str], int]:
        """The next two years behind links only, and the place after them."""
        found, k = [], self.at
        while k < len(self.lines) and len(found) < 2 and (self.kinds[k] == "year" or self.kinds[k] == "link"):
            if self.kinds[k] == "year":
                found.append(times(self.lines[k]))
            k += 1
        return found, k

    def read(self) -> list[str]:
        while self.at < len(self.lines):
            line, kind = self.lines[self.at], self.kinds[self.at]
            self.at += 1
            if kind not in ("open", "year", "amount") and not (kind == "close" and self.bracket) and (case := self.tied()):
                self.clause(self.years[-2:], case)
                self.years.clear()
                self.done.append(line)
            else:
                getattr(self, f"on_{kind}")(line)
        return self.done + ([" ".join(self.years)] if self.years else [])

    def on_open(self, line: str) -> None:
        self.bracket = True

    def on_close(self, line: str) -> None:
        if self.bracket:
            self.bracket = False
        else:
            self.on_text(line)

    def on_year(self, line: str) -> None:
        self.years.append(times(line))

    def on_unit(self, line: str) -> None:
        if not self.years:
            self.done.append(line)
            return
        year, self.bracket = self.years.pop(0), False
        self.done.append(f"{year}년" + ("" if line in ("년", "월") else " 1월 2일" if line[0] == "일" else f" {line}"))

    def on_day(self, line: str) -> None:
        if self.years and self.peek() == "day":
            date = f"{self.years.pop(0)}년 {line}월 {self.lines[self.at]}일"
            self.at += 1
            self.done.append(date + self.take_currency())
        else:
            self.on_text(line)

    def on_currency(self, line: str) -> None:
        if self.done:
            self.done[-1] = self.done[-1].rstrip() + "W"
        else:
            self.on_text(line)

    def on_amount(self, line: str) -> None:
        currency = self.take_currency()
        if len(self.years) > 1 and self.done and any(t in self.done[-1] for t in TIES):
            self.clause(self.years[-2:], "에", line + (currency or "W"))
            self.years.clear()
            return
        ahead, after = self.years_ahead()
        if len(ahead) > 1 and self.done:
            self.clause(ahead, "에", line + (currency or "W"))
            self.at = after
        else:
            self.glue(line + currency)

    def on_link(self, line: str) -> None:
        if not self.done:
            self.on_text(line)
        elif line != "과" or not self.done[-1].endswith("각각"):
            self.done[-1] += line

    def on_text(self, line: str) -> None:
        if self.years and "년" not in line and line != "각각":
            self.done.append(" ".join(self.years))
            self.years.clear()
        self.done.append(line)


def times(year: str) -> str:
    return year.replace("x", "×").replace("X", "×")


def _joined(text: str | None) -> str | None:
    return None if text is None else "\n".join(Lines([x for line in text.splitlines() if (x := line.strip())]).read())


def rejoined(c: Column) -> Column:
    """The lines of a text with torn years, dates, amounts and currency in their places; linear in its length."""

    @F.pandas_udf("string")
    def fold(texts: pd.Series) -> pd.Series:
        return texts.map(_joined)

    return fold(c)


def restructured(c: Column) -> Column:
    """Clauses of two years, dates and empty brackets put in order inside lines."""
    for pattern, new in REWRITES:
        c = F.regexp_replace(c, pattern, new)
    c = let(c, lambda x: F.when(x.rlike(WHOLE_DATE), F.regexp_replace(x, EMPTY_DATE, "")).otherwise(x))
    return F.regexp_replace(F.regexp_replace(c, TRAILING_YEARS, "$1"), r"^\s+|\s+$", "")

"""Data-quality rules as rows: each rule is an expression, each violation a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnspark.functions import text as X

Rule = tuple[str, str, Column]


def issues(rows: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """(key, severity, category) of every (severity, category, violated) rule that holds."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.struct(F.lit(s).alias("severity"), F.lit(c).alias("category"))) for s, c, bad in rules]))
    return rows.select(key, F.explode(found).alias("i")).select(key, "i.severity", "i.category")


def text_rules(c: Column, letters: str = X.HANGUL, footers: Sequence[str] = X.FOOTERS, glued: int = 12) -> list[Rule]:
    blank = c.isNull() | c.rlike(r"^\s*$")
    moji = F.lit(False)
    for m in X.MOJIBAKE:
        moji = moji | c.contains(m)
    return [
        ("critical", "question_empty", blank),
        ("critical", "broken_char", c.contains("�")),
        ("warning", "mojibake", moji),
        ("warning", "ocr_footer", X.has_footer(c, footers)),
        ("warning", "ocr_glued", X.glued_run(F.regexp_replace(c, r"\s+", ""), letters) >= glued),
        ("info", "ocr_punctuation", c.rlike(f"[.?][{letters}]")),
        ("warning", "ocr_linebreak", c.rlike(r"\n{4,}")),
        ("warning", "question_short", ~blank & (F.length(F.trim(c)) < 8)),
    ]


# Marks of broken encodings and footers that the audit looks for.
AUDIT_MOJIBAKE = ("Ã", "Â", "ï¿½", "�", "Ð", "Ñ")
AUDIT_FOOTERS = (r"A-\d{2}-\d", r"한국산업", r"교시\s*-\[", r"(?i)page\s*\(", r"제\d+회")
#: Fields whose spacing is looked at too.
RUNNING = ("question", "originalQuestion")


def text_audit(fields: DataFrame, key: str, letters: str = X.HANGUL, glued: int = 12) -> DataFrame:
    """(key, field, severity, category) of rows (key, field, text): a row for each mark and footer found, none for a null text;
    a blank text is only that."""
    c, running = F.col("text"), F.col("field").isin(*RUNNING)
    full = ~c.rlike(r"^\s*$")
    compact = X.glued_run(F.regexp_replace(c, r"\s+", ""), letters)
    rules = [("critical", "question_empty", ~full), ("critical", "broken_char", full & c.contains("\ufffd")), ("critical", "broken_char", full & c.contains("\u0000"))]
    rules += [("warning", "broken_char", full & c.contains(m)) for m in AUDIT_MOJIBAKE]
    rules += [("warning", "ocr_footer", full & c.rlike(p)) for p in AUDIT_FOOTERS]
    rules += [
        ("warning", "ocr_glued_hangul", full & running & (compact >= glued)),
        ("info", "ocr_fragment", full & running & c.rlike(f"(?<=[{letters}])[A-Za-z]{{1,2}}(?=[{letters}])")),
        ("info", "ocr_punctuation", full & running & c.rlike(f"[.?][{letters}]")),
        ("warning", "ocr_linebreak", full & running & c.rlike(r"\n{4,}")),
        ("info", "ocr_currency", full & running & c.rlike(f"(?<=[{letters}])W\\d")),
    ]
    rows = fields.withColumn("id_", F.struct(key, "field"))
    return issues(rows, "id_", rules).select("id_.*", "severity", "category")


def choice_rules(choices: Column) -> list[Rule]:
    return [
        ("critical", "choice_count", F.size(choices) != 5),
        ("critical", "choice_empty", F.exists(choices, lambda x: F.coalesce(F.trim(x), F.lit("")) == "")),
        ("warning", "choice_marker", F.exists(choices, lambda x: x.rlike(f"[{X.CHOICE_MARKS}]"))),
        ("warning", "choice_duplicate", F.size(F.array_distinct(choices)) < F.size(choices)),
    ]


def answer_rules(answer: Column, index: Column, choices: Column) -> list[Rule]:
    return [
        ("critical", "answer_range", answer.isNull() | ~answer.between(1, 5)),
        ("critical", "answer_index", ~answer.eqNullSafe(index)),
        ("critical", "answer_choice", answer.between(1, 5) & (F.coalesce(F.trim(F.try_element_at(choices, answer)), F.lit("")) == "")),
    ]


def table_rules(has_table: Column, table: Column) -> list[Rule]:
    blank = F.coalesce(F.trim(table), F.lit("")) == ""
    rows = F.size(F.filter(F.split(table, "\n"), lambda x: x.rlike(r"^\|.+\|$")))
    return [
        ("critical", "table_empty", has_table & blank),
        ("warning", "table_markdown", has_table & ~blank & ((rows < 2) | ~table.rlike(r"(?m)^\|\s*[-:| ]+\|\s*$"))),
    ]


def crosstab(found: DataFrame) -> DataFrame:
    """(category, critical, warning, info)."""
    return found.groupBy("category").agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")])


def grade(found: DataFrame) -> DataFrame:
    """One row: counts and the grade, D with any critical issue, C over 40 warnings, B with any, else A."""
    n = found.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")])
    return n.withColumn("grade", F.when(F.col("critical") > 0, "D").when(F.col("warning") > 40, "C").when(F.col("warning") > 0, "B").otherwise("A"))


def invariants(before: DataFrame, after: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(column, changed): how many rows of the same key differ in columns that must not change."""
    mark = lambda c: F.sha2(F.col(c).cast("string"), 256)  # noqa: E731  hashes are joined, not texts
    b = before.select(key, *[mark(c).alias(f"b_{c}") for c in columns])
    a = after.select(key, *[mark(c).alias(c) for c in columns])
    n = a.join(b, key).agg(*[F.count_if(~F.col(c).eqNullSafe(F.col(f"b_{c}"))).alias(c) for c in columns])
    return n.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*columns))).alias("column", "changed"))


def completeness(rows: DataFrame, by: str, checks: dict[str, Column]) -> DataFrame:
    """Share of rows that pass each check, in percent with one decimal, and whether all do."""
    from learnspark.functions.scores import rnd

    n = rows.groupBy(by).agg(F.count("*").alias("rows"), *[F.count_if(c).alias(k) for k, c in checks.items()])
    out = n.select(by, "rows", *[rnd(F.col(k) / F.col("rows") * 100, 1).alias(k) for k in checks])
    return out.withColumn("all_pass", F.forall(F.array(*checks), lambda x: x == 100))

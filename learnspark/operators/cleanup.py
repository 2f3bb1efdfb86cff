"""Display texts of whole questions: overrides before cleaning, field by field, and a report of before and after."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from learnspark.functions import spacing
from learnspark.functions import text as X
from learnspark.functions.scores import rnd

GLUED = 12
#: Stands between choices while their terms are spaced.
BORDER = "\u001f"
FIELDS = ("question", "original", "table", "choices")


def _clean(c: Column, field: str, terms: Sequence[str], prefixes: Sequence[str]) -> Column:
    out = X.clean_display(c, field)
    return F.trim(spacing.terms_apart(out, terms, prefixes)) if terms or prefixes else out


def _clean_choices(terms: Sequence[str], prefixes: Sequence[str]) -> Column:
    each = F.transform("choices", lambda x: X.clean_display(x, "choices"))
    if not terms and not prefixes:
        return each
    joined = spacing.terms_apart(F.array_join(F.transform(each, lambda x: F.coalesce(x, F.lit(""))), BORDER), terms, prefixes)
    return F.when(F.size("choices") > 0, F.transform(F.split(joined, BORDER), F.trim)).otherwise(F.col("choices"))


def cleaned(questions: DataFrame, overrides: DataFrame | None = None, key: str = "question_id", terms: Sequence[str] = (), prefixes: Sequence[str] = ()) -> DataFrame:
    """questions (key, question, original, table, choices) with each field overridden or else cleaned.

    overrides holds (key, question, original, table, has_table), a row a key. An override of the
    question stands for the original too, with the override's table below it; has_table says that the table is
    overridden, with null too. Choices are cleaned one by one. Other columns stay.
    """
    names = {c: f"{c}_over" for c in ("question", "original", "table", "has_table")}
    rows = questions
    if overrides is not None:
        rows = rows.join(overrides.select(key, *[F.col(c).alias(n) for c, n in names.items()]), key, "left")
    else:
        rows = rows.withColumns({n: F.lit(None).cast("boolean" if c == "has_table" else "string") for c, n in names.items()})
    new, table = F.nullif("question_over", F.lit("")), F.when(F.col("has_table_over"), F.col("table_over"))
    question = F.coalesce(new, _clean(F.when(new.isNull(), F.col("question")), "question", terms, prefixes))
    kept = F.when(new.isNull() & F.col("original_over").isNull(), F.col("original"))
    original = F.coalesce("original_over", F.when(new.isNotNull(), F.concat_ws("\n", new, F.nullif(table, F.lit("")))), _clean(kept, "originalQuestion", terms, prefixes))
    own_table = F.when(F.coalesce("table", F.lit("")) != "", _clean(F.col("table"), "table", terms, prefixes)).otherwise(F.col("table"))
    out = rows.withColumns({"question": question, "original": original, "table": F.when(F.coalesce("has_table_over", F.lit(False)), F.col("table_over")).otherwise(own_table), "choices": _clean_choices(terms, prefixes)})
    return out.drop(*names.values())


def fields(questions: DataFrame, key: str = "question_id") -> DataFrame:
    """(key, field, text): a row for each field and choice that is not blank."""
    all_ = F.concat(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in FIELDS[:3]]), F.transform("choices", lambda x, i: F.struct(F.concat(F.lit("choices["), (i + 1).cast("string"), F.lit("]")).alias("field"), x.alias("text"))))
    return questions.select(key, F.explode(all_).alias("x")).select(key, "x.*").where(F.trim("text") != "")


def metrics(questions: DataFrame, key: str = "question_id", letters: str = X.HANGUL) -> DataFrame:
    """One row: questions with a glued run, the longest run, the mean share of spaces over fields, numbers without separators, fields."""
    f = fields(questions, key)
    each = f.select(key, X.glued_run(F.col("text"), letters).alias("run"), X.space_ratio(F.col("text"), letters).alias("ratio"), X.unformatted_numbers(F.col("text")).alias("bare"))
    return each.agg(
        F.count_distinct(F.when(F.col("run") >= GLUED, F.col(key))).alias("glued_questions"), F.coalesce(F.max("run"), F.lit(0)).alias("longest_run"),
        rnd(F.coalesce(F.avg("ratio"), F.lit(0.0)), 6).alias("space_ratio"), F.coalesce(F.sum("bare"), F.lit(0)).cast("long").alias("bare_numbers"), F.count("*").alias("fields"),
    )


def report(before: DataFrame, after: DataFrame, key: str = "question_id", letters: str = X.HANGUL) -> DataFrame:
    """(metric, before, after, change): the percentage by which each metric fell, for the share of spaces by which it rose; 0 where there was none."""
    b, a = metrics(before, key, letters), metrics(after, key, letters)
    both = b.select(*[F.col(c).cast("double").alias(f"b_{c}") for c in b.columns]).join(a.select(*[F.col(c).cast("double").alias(f"a_{c}") for c in a.columns]))  # one row each
    rows = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"b_{c}").alias("before"), F.col(f"a_{c}").alias("after")) for c in b.columns])
    x = both.select(F.explode(rows).alias("x")).select("x.*")
    fall = F.when(F.col("metric") == "space_ratio", F.col("after") - F.col("before")).otherwise(F.col("before") - F.col("after"))
    none = F.when(F.col("metric") == "space_ratio", F.col("after") * 100).otherwise(0.0)
    return x.withColumn("change", rnd(F.when(F.col("before") == 0, none).otherwise(fall / F.col("before") * 100), 4))

"""Tutor sections of a question from its own override, a template, its pattern's profile and a fallback, in this order, and gates over them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sections that a template opens where nothing overrides them, and how its title and formula are written.
STEPS, TIP, EXPLANATION = "steps", "tip", "explanation"


def merged(questions: DataFrame, overrides: DataFrame, profiles: DataFrame, templates: DataFrame, fallback: Mapping[str, str], key: str = "question_id") -> DataFrame:
    """questions (key, pattern_id) plus title, explanation, steps, tip and has_override.

    overrides (key, template_id, title, explanation, steps, tip) and profiles (pattern_id, name, template_id,
    explanation, steps, tip) have a row a key; templates (template_id, title, formula, steps, hook) too. An empty list of steps
    counts as none. A template's steps come before the profile's, and its hook behind the tip, where neither is overridden.
    """
    own = overrides.select(key, *[F.col(c).alias(f"own_{c}") for c in ("template_id", "title", EXPLANATION, STEPS, TIP)], F.lit(True).alias("has_own"))
    of = profiles.select("pattern_id", *[F.col(c).alias(f"profile_{c}") for c in ("name", "template_id", EXPLANATION, STEPS, TIP)])
    rows = questions.join(own, key, "left").join(of, "pattern_id", "left").withColumn("template_id", F.coalesce("own_template_id", "profile_template_id"))
    rows = rows.join(templates.select("template_id", F.col("title").alias("t_title"), F.col("formula").alias("t_formula"), F.col(STEPS).alias("t_steps"), F.col("hook").alias("t_hook")), "template_id", "left")
    none = F.array().cast("array<string>")
    some = lambda c: F.when(F.size(c) > 0, F.col(c))
    head = F.concat(F.lit("["), F.col("t_title"), F.lit("] "), F.col("t_formula"))
    opened = F.when(F.col("t_title").isNotNull(), F.concat(F.array(head), F.coalesce("t_steps", none))).otherwise(none)
    tip = F.coalesce("profile_tip", F.lit(fallback[TIP]))
    hooked = F.when(F.coalesce("t_hook", F.lit("")) != "", F.concat(tip, F.lit("\n\n[계산 템플릿] "), F.col("t_hook"))).otherwise(tip)
    return rows.select(
        *[F.col(c) for c in questions.columns], F.coalesce("own_title", "profile_name", F.col("pattern_id").cast("string")).alias("title"), F.coalesce(f"own_{EXPLANATION}", f"profile_{EXPLANATION}", F.lit(fallback[EXPLANATION])).alias(EXPLANATION),
        F.coalesce(some("own_steps"), F.concat(opened, F.coalesce("profile_steps", none))).alias(STEPS), F.coalesce("own_tip", hooked).alias(TIP), F.coalesce("has_own", F.lit(False)).alias("has_override"),
    )


def gates(rows: DataFrame, checks: Mapping[str, tuple[Column, Column, float]]) -> DataFrame:
    """(gate, hits, total, rate, least, passed): for (passes, counts, least), the share of the rows that count which pass; 0 of none is 0."""
    n = rows.agg(*[x.alias(f"{k}_{c}") for k, (hit, of, _) in checks.items() for c, x in (("hits", F.count_if(hit & of)), ("total", F.count_if(of)))])
    cells = [F.struct(F.lit(k).alias("gate"), F.col(f"{k}_hits").alias("hits"), F.col(f"{k}_total").alias("total"), F.lit(float(least)).alias("least")) for k, (_, _, least) in checks.items()]
    rate = F.col("hits") / F.greatest("total", F.lit(1))
    return n.select(F.explode(F.array(*cells)).alias("x")).select("x.*").select("gate", "hits", "total", F.round(rate, 6).alias("rate"), "least", (rate >= F.col("least")).alias("passed"))


def all_passed(found: DataFrame, needed: Sequence[str] = ()) -> bool:
    """Whether every gate, or those needed, passed; a report of a few rows."""
    rows = {r.gate: r.passed for r in found.collect()}
    return all(rows[g] for g in (needed or rows))

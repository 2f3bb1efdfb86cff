"""Quality rules whose cutoffs carry a guarantee against rejecting good documents.

Five rules measure a document. Their cutoffs are tightened together along a path of levels fixed
beforehand, so a document has one first level at which some rule rejects it. In each stratum (the
language) the labelled good documents are the holdout. From the most lenient level on, level j is
accepted while the exact binomial test rejects "at least `risk` of good documents are rejected at
level j" at `delta` / number of strata: fixed-sequence testing within a stratum, Bonferroni between
strata. With probability 1 - delta no stratum loses more than a share `risk` of its good documents to
the cutoffs, of those that the base rules let pass: these are fixed and reject what they reject.
A stratum with too few labels gets no cutoff and rejects nothing beyond the base rules.

Defined results: a null or blank text has no words, fails the base rules and is rejected; a null
stratum value is a stratum of its own; labels that are null or without a document are ignored; a
document that is labelled or present more than once is one document of the holdout (good only if all
its labels say so, at the first level that rejects any of its rows), as the exact binomial asks for;
rows that repeat a doc_id are judged each for itself; an empty table gives an empty result; all input
columns, whatever their names, pass through unchanged.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learnspark.llm.common import cut, free_names, table

RISK, DELTA = 0.02, 0.05
MIN_WORDS = 50
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bangs", "n_upper", "n_letters", "n_stutter")
#: Rule: (numerator, denominator, most lenient cutoff, strictest cutoff); LEVELS even steps between.
RULES = {
    "symbols": ("n_symbols", "n_words", 2.0, 0.2),
    "bangs": ("n_bangs", "n_words", 2.0, 0.2),
    "upper": ("n_upper", "n_letters", 1.0, 0.3),
    "dup_lines": ("n_dup_lines", "n_lines", 0.9, 0.5),
    "stutter": ("n_stutter", "n_words", 0.9, 0.15),
}
LEVELS = 10
_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123)])


def measure(raw: bytes | None) -> tuple[int, ...]:
    """MEASURES of a text; n_stutter counts words equal to the word before."""
    raw = raw or b""
    words = raw.split()
    gone = lambda chars: len(raw) - len(raw.translate(None, chars))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    tri = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    if len(set(tri)) < len(tri):
        seen = Counter(tri)
        hit = np.fromiter((seen[t] > 1 for t in tri), bool, len(tri))
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[k : k + len(hit)] |= hit
        repeated = int(covered.sum())
    return (
        len(words),
        len(raw) - gone(b" \t\n\r\x0b\x0c") - gone(bytes(range(0x80, 0xC0))),
        gone(b"#*$%&|<>"),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        gone(b"!?"),
        gone(_UPPER),
        gone(_LETTERS),
        sum(a == b for a, b in zip(words, words[1:], strict=False)),
    )


def measured(docs: DataFrame, text_col: str = "text", drop_text: bool = False, into: str = "_m") -> DataFrame:
    """docs plus a struct column `into` of MEASURES (without the text where drop_text)."""
    kept = [c for c in docs.columns if not (drop_text and c == text_col)]
    raw = free_names(docs, "raw")[0]
    ready = docs.select(F.col(f"`{text_col}`").cast("binary").alias(raw), *[F.col(f"`{c}`") for c in kept])
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.struct(*[F.lit(0).cast("long").alias(m) for m in MEASURES]).alias(into)).schema

    def run(batches):
        for b in batches:
            values = list(zip(*(measure(x.as_py()) for x in b.column(0)), strict=True)) or [()] * len(MEASURES)
            m = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in values], list(MEASURES))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], m], [*kept, into])

    return ready.mapInArrow(run, out)


def base_failed(m: str = "_m") -> Column:
    return (F.col(f"{m}.n_words") < MIN_WORDS) | (100 * F.col(f"{m}.n_repeat_words") > 50 * F.col(f"{m}.n_words"))


def first_level(m: str = "_m") -> Column:
    """The first of levels 0..LEVELS-1 at which a rule rejects; LEVELS where none does."""
    levels = []
    for num, den, lenient, strict in RULES.values():
        share = F.col(f"{m}.{num}") / F.greatest(F.col(f"{m}.{den}"), F.lit(1))
        step = (lenient - strict) / (LEVELS - 1)
        # cutoffs lenient - j * step: the smallest j with share >= cutoff
        levels.append(F.greatest(F.ceil((F.lit(lenient) - share) / step - 1e-9), F.lit(0)))
    return F.least(F.lit(LEVELS), *levels).cast("int")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p) for i in range(k + 1)]
    top = max(logs)
    return min(1.0, math.exp(top) * sum(math.exp(x - top) for x in logs))


def certified(counts: list[int], risk: float, delta: float) -> int:
    """The strictest level that fixed-sequence testing accepts, or -1. counts: good documents by first level."""
    n, k, accepted = sum(counts), 0, -1
    for j in range(LEVELS):
        k += counts[j]
        # past the share allowed no bound can hold; this also keeps the sum short
        if n == 0 or k >= risk * n or binomial_tail(k, n, risk) > delta:
            break
        accepted = j
    return accepted


def cutoffs(labelled: DataFrame, stratum: str, risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(_stratum, _accepted): a row per stratum of labelled (stratum, _level, _good).

    Only the histogram of first levels is gathered per stratum: LEVELS + 1 counts, whatever the input.
    """
    levels = [F.count(F.when(F.col("_level") == j, 1)).alias(f"c{j}") for j in range(LEVELS + 1)]
    per = cut(labelled.where("_good").groupBy(F.col(stratum).alias("_stratum")).agg(*levels))
    strata = max(1, per.count())

    def run(batches):
        for b in batches:
            counts = b[[f"c{j}" for j in range(LEVELS + 1)]].to_numpy().tolist()
            yield pd.DataFrame({"_stratum": b["_stratum"], "_accepted": [certified(c, risk, delta / strata) for c in counts]})

    return per.mapInPandas(run, f"_stratum {per.schema['_stratum'].dataType.simpleString()}, _accepted int")


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """(id, stratum, m, failed, kept): the verdict on every row of docs, with its MEASURES in m.

    labels: (doc_id, quality), quality 1 for good. Texts are measured once and never shuffled.
    """
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{stratum}`").alias("stratum"), F.col(f"`{text_col}`").alias("text"))
    m = cut(measured(slim, drop_text=True, into="m"))
    at = _accepted(m, labels, risk, delta)
    return m.join(at, m["stratum"].eqNullSafe(at["_stratum"]), "left").select("id", "stratum", "m", base_failed("m").alias("failed"), _verdict("m", "_accepted").alias("kept"))


def _accepted(m: DataFrame, labels: DataFrame, risk: float, delta: float) -> DataFrame:
    """(_stratum, _accepted) from the labelled ones of documents (id, stratum, m), each counted once."""
    good = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.min(F.col("quality") == 1).alias("good"))
    held = m.join(good, F.col("id") == F.col("label_id")).where(~base_failed("m"))
    held = held.groupBy("id").agg(F.min(F.struct(first_level("m").alias("level"), "stratum")).alias("x"), F.min("good").alias("_good"))
    return cut(cutoffs(held.select("x.stratum", F.col("x.level").alias("_level"), "_good"), "stratum", risk, delta))


def _verdict(m: str, accepted: str) -> Column:
    return ~base_failed(m) & (first_level(m) > F.coalesce(accepted, F.lit(-1)))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum: str = "lang", risk: float = RISK, delta: float = DELTA) -> DataFrame:
    """docs without the rejected ones, all their columns as they were.

    The rows are measured twice, once without texts for the labels, so that no text is written or shuffled.
    """
    m, accepted, own = free_names(docs, "m", "accepted", "own_stratum")
    known = measured(docs, text_col, into=m)
    slim = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{stratum}`").alias("stratum"), F.col(f"`{text_col}`").alias("text"))
    slim = measured(slim, drop_text=True, into="m")
    at = _accepted(slim, labels, risk, delta).select(F.col("_stratum").alias(own), F.col("_accepted").alias(accepted))
    out = known.join(at, F.col(f"`{stratum}`").eqNullSafe(F.col(own)), "left").where(_verdict(m, accepted))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op10_risk_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return verdict.select(F.col("id").alias("doc_id"), *[f"m.{x}" for x in MEASURES[:5]], F.col("failed").alias("base_failed"), "kept", F.col("stratum").alias("lang"), first_level("m").alias("first_level"))

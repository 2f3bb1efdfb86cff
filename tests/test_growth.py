"""Steps whose work grows no faster than their text, and short cuts that change no result."""

import time

import pytest
from pyspark.sql import functions as F

from learnspark.functions import lines, pages, spacing, text
from learnspark.operators import extract


def value(spark, c, x):
    return spark.createDataFrame([(x,)], "t string").select(c(F.col("t"))).first()[0]


def test_year_sections_of_many_headers(spark):
    n, head = 12_000, "2019년 제30회"
    start = time.time()
    found = value(spark, pages.year_sections, ("a" * 9 + head) * n)
    assert time.time() - start < 20
    assert [x.position for x in found] == [9 + k * (9 + len(head)) for k in range(n)] and {(x.year, x.round) for x in found} == {(2019, 30)}
    assert value(spark, pages.year_sections, None) is None


def test_soft_breaks_of_a_long_sentence(spark):
    start = time.time()
    assert value(spark, lines.soft_joined, "\n".join(["word"] * 8_000)) == " ".join(["word"] * 8_000)
    assert time.time() - start < 10


@pytest.mark.parametrize(
    ("given", "joined"),
    [("a-\nb", "ab"), ("a·-\r\nb", "ab"), ("x\n₩", "xW"), ("what?\nyes", "what?\nyes"), ("what?\n12,000\nyes", "what?\n12,000 yes"), ("a\n\nb", "a\n\nb"), ("", ""), (None, None), ("년 20×1년 20×2년 20×1년\n20x2", "년 20×1년 20×2년 20×1년\n20x2"), ("한다.\n(단", "한다. (단")],
)
def test_soft_breaks(spark, given, joined):
    assert value(spark, lines.soft_joined, given) == joined


@pytest.mark.parametrize("patterns", [text.FOOTERS, text.EXTRACTION_FOOTERS])
@pytest.mark.parametrize("footer", ["a-01-2", "A-01-23-[1교시]", "교시 -[ 1 ]", "한국산업 x", "PaGe ( 3 )", "제3회 x", "2019년 제3회 A-01-2", "제3회 A-01-2", "청렴한감정평가 x", "none", "pag", "A-1-2"])
def test_footers_are_found_before_they_are_removed(spark, patterns, footer):
    given, plain = f" one\n {footer} ", F.col("t")
    for p in patterns:
        plain = F.regexp_replace(plain, p, "")
    assert value(spark, lambda c: text.remove_footer(c, patterns), given) == value(spark, lambda c: F.regexp_replace(plain, r"^\s+|\s+$", ""), given)


def test_particles_are_one_class(spark):
    every = "|".join("\\Q" + p + "\\E" for p in spacing.PARTICLES)
    given = " ".join(f"가{p}나 x{p} 가나{p}" for p in [*spacing.PARTICLES, "하나", "경", "이것", "에게", "으하", "있"])
    assert value(spark, lambda c: F.regexp_replace(c, spacing._PARTICLE, "_"), given) == value(spark, lambda c: F.regexp_replace(c, f"(?<=[가-힣])(?={every})", "_"), given)


def test_masks_without_a_match(spark):
    assert value(spark, spacing.particles_apart, "가나 12%가 12%") == "가나 12%가 12%"


def test_coverage_of_odd_texts(spark):
    rows = [("", "x", 0.0), ("x", "", 1.0), (None, "", 1.0), (None, "x", 0.0), ("x", None, 0.0), ("a B", "xab", 2 / 3), ("q" * 30 + "z", "q" * 30, 1.0), ("ab", "cd", 0.0)]
    got = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(rows)], "i int, a string, b string").select("i", extract.coverage(F.col("a"), F.col("b")).alias("c")).orderBy("i")
    assert [r.c for r in got.collect()] == [c for *_, c in rows]

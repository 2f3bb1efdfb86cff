"""Key sheets, worked solutions and spacing by hand-made examples and, for the dictionary, against one replacement after the other."""

import random
import re

import pytest
from pyspark.sql import functions as F

from learnspark.functions import answers, spacing
from tests.test_exam_texts import one


def sheet(spark, text):
    return {x.number: x.answer for x in one(spark, lambda t: answers.sheet(t, 41, 80), text) or []}


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("회계학 41 3 42 1 43. 5", {41: 3, 42: 1, 43: 5}),
        ("41 42 43 3 1 5", {43: 3, 44: 1, 45: 5}),
        ("41\n2\n3\n4", {41: 2, 42: 3, 43: 4}),
        ("2교시 A형\n경제학 41 1\n회계학 41 2 42 3\n한국산업 43 4", {41: 1, 42: 2, 43: 3, 44: 4}),  # too few, so the whole sheet is read
        ("41 9 7 3", {41: 3}),
        ("no numbers", {}),
        ("", {}),
        (None, {}),
    ],
)
def test_key_sheets(spark, text, expected):
    assert sheet(spark, text) == expected


def test_sections(spark):
    text = "2교시 A형\n경제학 41 1\n회계학 41 2 42 3\n한국산업 43 4"
    assert one(spark, answers.section, text) == "회계학 41 2 42 3\n"
    assert one(spark, answers.section, "2교시 A 회계 학 41 2 2교시 B 회계학 41 5") == "회계 학 41 2 "
    assert one(spark, answers.section, "41 2") == "41 2"


def test_key_sheet_of_enough_pairs(spark):
    pairs = " ".join(f"{n} {n % 5 + 1}" for n in range(41, 81))
    assert sheet(spark, pairs) == {n: n % 5 + 1 for n in range(41, 81)}


def resolved(spark, head, choices, why, mark="CBT문제은행AI"):
    block = f"41. {head}\n" + "".join(f"{k}. {c}\n" for k, c in enumerate(choices, 1)) + f"{mark} {why}\n"
    return one(spark, answers.resolved, block)


@pytest.mark.parametrize(
    ("head", "choices", "why", "expected"),
    [
        ("옳은 것은?", ["가치", "원가모형", "손상", "측정", "표시"], "답은 손상 이다", 3),
        ("옳은 것은?", ["가", "나", "다", "라", "마"], "추정치는 유용성을 해치지 않는다", 5),
        ("옳지 않은 것은?", ["하나둘", "셋넷", "다섯", "여섯", "일곱"], "다섯 은 틀리다", 3),
        ("값은?", ["A 1,000, B 2,000", "A 1,500, B 2,500", "x", "y", "z"], "A = 1000 그리고 B = 2,000, 다시 A = 1,500 B = 2500", 2),
        ("얼마인가?", ["10,000원", "20,000원", "30,000원", "x", "y"], "중간 = 10,000 최종 결과 = 30,000", 3),
        ("세율은?", ["25", "30", "35", "40", "45"], "25% 적용", 1),
        ("얼마인가?", ["1", "2", "3", "4", "5"], "모른다", None),
    ],
)
def test_resolved(spark, head, choices, why, expected):
    assert resolved(spark, head, choices, why) == expected
    assert resolved(spark, head, choices, "", "") is None


def test_solutions(spark):
    text = "머리\n41. 첫째\n1. 가\n43. 끼움\n42. 둘째\n44. 넷째"
    got = {x.number: x.block for x in one(spark, lambda t: answers.solutions(t, 41, 80), text)}
    assert got == {41: "41. 첫째\n1. 가\n43. 끼움\n", 42: "42. 둘째\n44. 넷째", 43: "43. 끼움\n42. 둘째\n", 44: "44. 넷째"}


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("기말재고자산은", "기말재고자산 은"),
        ("현금1,000원을", "현금 1,000원을"),
        ("매출12가", "매출 12 가"),
        ("12년말", "12년말"),
        ("20×1년3월4일에", "20×1년3월4일에"),
        ("합계:10", "합계: 10"),
        ("자산(순액)의", "자산 (순액) 의"),
        ("( 순액 )", "(순액)"),
        ("", ""),
        (None, None),
    ],
)
def test_particles_apart(spark, text, expected):
    assert one(spark, spacing.particles_apart, text) == expected


def test_particles_apart_has_a_fixed_point(spark):
    rows = ["매출총이익과12,000원을(순액)의", "이익은20×1년에부터까지", "가나다라는의에서으로"]
    twice = [one(spark, lambda t: spacing.particles_apart(spacing.particles_apart(t)), x) for x in rows]
    assert twice == [one(spark, spacing.particles_apart, x) for x in rows]


def test_masks_are_put_back(spark):
    text = "a 12% b 1,000W c 12% d 20×1년 e 3.5㎡ f 12345"
    patterns = (*spacing.UNITS, spacing.NUMBER)
    whole = lambda t: spacing.let(spacing.masked(t, patterns), lambda s: spacing.restored(s["text"], s["tokens"], len(patterns)))
    assert one(spark, whole, text) == text
    assert not re.search(r"\d", one(spark, lambda t: spacing.masked(t, patterns)["text"], text))


def in_turn(text, terms, prefixes):
    """One replacement after the other, as the rule is stated."""
    for t in sorted(dict.fromkeys(t for t in terms if len(t) > 1), key=len, reverse=True):
        text = re.sub(rf"(?<=[가-힣])({re.escape(t)})", r" \1", text)
    for p in prefixes:
        text = re.sub(rf"(?<=[가-힣])({re.escape(p)})(?=[가-힣])", r" \1 ", text)
    return re.sub(r"\s{2,}", " ", text)


def test_terms_are_matched_in_small_batches(spark):
    """A worker gets a few megabytes at once, whatever the number and length of texts."""
    from pyspark.sql import functions as F

    texts = spark.range(3000, numPartitions=1).select("id", F.concat(F.repeat(F.lit("기말자산"), 1000), F.col("id").cast("string")).alias("t"))
    got = texts.select("id", spacing.terms_apart(F.col("t"), ["자산"]).alias("t")).withColumn("n", F.length("t"))
    assert got.where(F.col("n") == 5000 + F.length(F.col("id").cast("string"))).count() == 3000
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 8 << 20


def test_terms_apart_equals_replacements_in_turn(spark):
    r = random.Random(8)
    letters = "가나다라 1"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(400)]
    for _ in range(5):
        terms = ["".join(r.choice("가나다라") for _ in range(r.randint(1, 4))) for _ in range(6)]
        prefixes = ["".join(r.choice("가나다라") for _ in range(2)) for _ in range(2)]
        apart = spacing.Terms(terms, prefixes)
        assert [re.sub(r"\s{2,}", " ", apart.spaced(t)) for t in texts] == [in_turn(t, terms, dict.fromkeys(prefixes)) for t in texts]
    assert one(spark, lambda t: spacing.terms_apart(t, ["재고자산", "자산"], ["당기"]), "기말재고자산의당기손익") == "기말 재고 자산의 당기 손익"
    assert one(spark, lambda t: spacing.terms_apart(t, []), "기말자산") == "기말자산"
    assert spacing.Terms(["자산"]).spaced(None) is None

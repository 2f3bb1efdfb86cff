"""Torn lines, choices and tables of exam pages by hand-made examples."""

import pytest
from pyspark.sql import functions as F

from learnspark.functions import choices, fragments, tables
from learnspark.operators import extract


def one(spark, expression, text):
    return spark.createDataFrame([(text,)], "t string").select(expression(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("lines", "expected"),
    [
        ("20×1\n3\n14\n매출", "20×1년 3월 14일\n매출"),
        ("20x1\n3\n14\nW\n매출", "20×1년 3월 14일W\n매출"),
        ("취득원가\n12,000\nW", "취득원가 12,000W"),
        ("취득원가\n₩", "취득원가W"),
        ("기말 재고 년의\n20×1\n20x2\n금액", "기말 재고 년의 (20×1)년과 (20×2)년의\n금액"),
        ("매출은\n년과\n20×1\n20×2\n12,000", "매출은 (20×1)년과 (20×2)년에 각각 12,000W"),
        ("매출은\n각각\n500\nW\n20×1\n과\n20X2\n이다", "매출은 (20×1)년과 (20×2)년에 각각 500W\n이다"),
        ("20×1\n년", "20×1년"),
        ("20×1\n일부터", "20×1년 1월 2일"),
        ("20×1\n주식", "20×1년 주식"),
        ("(\n가\n)\n나", "가\n나"),
        (")\n나", ")\n나"),
        ("20×1\n매출", "20×1\n매출"),
        ("20×1\n20×2", "20×1 20×2"),
        ("각각\n과\n.", "각각."),
        ("", ""),
        (" \n\n", ""),
        (None, None),
    ],
)
def test_rejoined(spark, lines, expected):
    assert one(spark, fragments.rejoined, lines) == expected


def test_rejoined_is_linear(spark):
    assert one(spark, fragments.rejoined, "20×1\n3\n14\n" * 100_000).count("\n") == 99_999


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("20x1 년 3 월 14 일 현재", "20×1년 3월 14일 현재"),
        ("20×1 3 14 까지", "20×1년 3월 14일 까지"),
        ("년과 년에 각각 20×1 20x2 12,000", "(20×1)년과 (20×2)년에 각각 12,000W"),
        ("년과 년의 법인세 20×1 20×2", "(20×1)년과 (20×2)년의 법인세"),
        ("() 년말", "년말"),
        ("20×1 월 일", "20×1년 1월 2일"),
        ("얼마인가? 년 20×1년 20×2년 20×1년 20×2", "얼마인가?"),
        ("20×1 월 9 일", "20×1 월 9 일"),
        (None, None),
    ],
)
def test_restructured(spark, text, expected):
    assert one(spark, fragments.restructured, text) == expected


def parsed(spark, body):
    return extract.with_choices(spark.createDataFrame([(1, body, "kept")], "id long, body string, line string"), "body").first()


FIVE = ["가", "나", "다", "라", "마"]
MARKED = list(zip(choices.MARKS, FIVE, strict=True))


@pytest.mark.parametrize(
    ("body", "strategy", "expected"),
    [
        ("1. 금액은? 20×1 20x2\n" + "".join(f"{m} W{k},000\nW{k},500\n" for k, m in enumerate(choices.MARKS, 1)), "grid", [f"20×1년 W{k},000, 20×2년 W{k},500" for k in range(1, 6)]),
        ("1. 금액은?\n(A) (B)\n" + "".join(f"{m} 증가\nW{k},500\n" for k, m in enumerate(choices.MARKS, 1)), "multicolumn", [f"(A) 증가, (B) W{k},500" for k in range(1, 6)]),
        ("1. 무엇인가?\n" + "".join(f"{m}\n{x}\n계속\n" for m, x in MARKED), "circled", [f"{x} 계속" for x in FIVE]),
        ("1. 무엇인가? " + " ".join(f"{m} {x}" for m, x in MARKED), "circled", FIVE),
        ("1. 얼마인가?\n① W1\n② W2\n③ W3 ④ W4\n⑤ W5", "won", [f"W{k}" for k in range(1, 6)]),
        ("1. 무엇인가 # 하나 # 둘 # 셋 # 넷 # 다섯", "hash", ["하나", "둘", "셋", "넷", "다섯"]),
        ("1. 고르면? ① ㄱ\n② ㄴ\n③ ㄷ ④ ㄱ, ㄴ ⑤ ㄴ, ㄷ", "combination", ["ㄱ", "ㄴ", "ㄷ", "ㄱ", "ㄴ"]),
        ("하나는 아주 길다. 둘째도 아주 길다. 셋째도 아주 길다. 넷째도 아주 길다. 다섯째도 아주 길다.", "statement", ["하나는 아주 길다", "둘째도 아주 길다", "셋째도 아주 길다", "넷째도 아주 길다", "다섯째도 아주 길다"]),
        ("액면가치 1% 2% 3% 4% 5% 6% 7% 8% 0.11 0.22 0.33 0.44 0.55 0.66", "bond", ["0.11", "0.22", "0.33", "0.44", "0.55"]),
        ("1. 무엇인가? ① 가 ② 나", None, []),
        ("", None, []),
        (None, None, []),
    ],
)
def test_choices(spark, body, strategy, expected):
    row = parsed(spark, body)
    assert (row.strategy, row.choices, row.line) == (strategy, expected, "kept")


def test_headers(spark):
    assert one(spark, choices.headers, "년 20×1년 20x2년 20×1년 20×2\n① W1") == ["20×1년", "20×2년"]
    assert one(spark, choices.headers, "할인액 처분손실 할인액\n① W1") == ["할인액", "처분손실"]
    assert one(spark, choices.headers, "법인세비용 이연법인세자산\n① W1") == ["법인세비용", "이연법인세자산", "이연법인세부채"]
    assert one(spark, choices.headers, "금액은?\n① W1") == []


def test_three_columns_and_amounts_side_by_side(spark):
    cells, names = (F.array(*map(F.lit, x)) for x in (["W1", "W2", "W3"], ["가", "나", "다"]))
    assert one(spark, lambda _: choices.in_columns(cells, names), "") == "가 W1, 나 W2, 다 W3"
    assert one(spark, lambda t: choices.in_columns(F.array(t), F.slice(names, 1, 2)), "W1,000 W2,000") == "가 W1,000, 나 W2,000"
    assert one(spark, lambda t: choices.in_columns(F.array(t, F.lit("W2")), F.slice(names, 1, 0)), "W1") == "W1, W2"


def test_bare_amounts_get_their_whole_block(spark):
    long_ = "당기순이익이 증가하고 자산과 부채는 변동하지 않는다"
    body = "1. 옳은 것은?\n①W1,000, W2,000\n가나다라 설명\n" + "".join(f"{m} {long_}\n" for m in choices.MARKS[1:])
    assert parsed(spark, body).choices == ["W1,000, W2,000 가나다라 설명", *[long_] * 4]


def test_grid_of_choices_comes_before_the_table(spark):
    body = "구분  금액  1\n1. 금액은? 20×1 20×2\n" + "".join(f"{m} W{k}\nW{k}0\n" for k, m in enumerate(choices.MARKS, 1))
    row = parsed(spark, body)
    assert row.grid.split("\n")[:2] == ["\t20×1년\t20×2년", "①\tW1\tW10"] and row.markdown is None


def test_table(spark):
    body = "다음 자료이다.\n구분  20×1년  금액\n현금\t1,000\n\n미지급\n설명 5\n상품 하나\n상품  5\n41. 문제"
    t = one(spark, tables.table, body)
    assert t.grid == "구분\t20×1년\t금액\n현금\t1,000"
    assert t.markdown == "| 구분 | 20×1년 | 금액 |\n| --- | --- | --- |\n| 현금 | 1,000 |  |"
    assert t.rest == "다음 자료이다.\n미지급\n설명 5\n상품 하나\n상품  5\n41. 문제"


def test_single_cells_go_to_the_row_above(spark):
    t = one(spark, tables.table, "구분  금액\n적요  1\n0.1 0.9091\n20.1234\n끝")
    assert t.grid.split("\n")[0] == "구분\t금액" and t.rest.endswith("끝")


@pytest.mark.parametrize("body", ["표가 없다.", "", "구분  금액", None, "[TABLE]"])
def test_no_table(spark, body):
    t = one(spark, tables.table, body)
    assert (t.rest, t.grid, t.markdown) == (body, None, None)


def test_line_classes(spark):
    found = {x: one(spark, tables.line_class, x) for x in ("", "[TABLE]", "41. 구분  1", "① 1  2", "구분  금액", "a  1  2", "a0.9091", "a  1", "글", "구분  1?", "(대변) 매출", "20×1년 20×2년 20×3")}
    assert list(found.values()) == ["B", "H", "X", "X", "H", "H", "H", "D", "X", "D", "H", "D"]


def test_cells(spark):
    assert one(spark, tables.cells, "a b\tc") == ["a b", "c"]
    assert one(spark, tables.cells, "현금 1,000 상품") == ["현금", "1,000", "상품"]
    assert one(spark, tables.cells, "| a | b |") == ["a", "b"]
    assert one(spark, tables.cells, " ") == []

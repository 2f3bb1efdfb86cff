"""Patterns and types of accounting questions by rules over their texts, the first that fits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from learnspark.functions.text import let

# Fixed values: (pattern, chapter, keywords) in the order in which they count.
RULES = (
    ("ACC_INV_001", "ACC_INV", ("FOB", "선적", "도착지", "운송 중", "기말재고에 포함")),
    ("ACC_INV_002", "ACC_INV", ("CIF", "FOB 조건")),
    ("ACC_INV_003", "ACC_INV", ("운반", "하역", "보험료", "부대비용", "매입할인")),
    ("ACC_INV_004", "ACC_INV", ("매출원가", "PER(", "PER법", "실지재고", "재고조사법")),
    ("ACC_INV_006", "ACC_INV", ("선입선출", "FIFO", "가중평균", "이동평균", "총평균")),
    ("ACC_INV_007", "ACC_INV", ("순실현", "LCM", "저가", "소매재고", "순매가")),
    ("ACC_INV_008", "ACC_INV", ("재고자산에 관한", "재고자산의 정의")),
    ("ACC_PPE_001", "ACC_PPE", ("유형자산", "감가상각", "내용연수", "잔존가치")),
    ("ACC_PPE_002", "ACC_PPE", ("재평가", "공정가치", "손상", "회수가능액")),
    ("ACC_INT_001", "ACC_INT", ("무형자산", "개발비", "상각", "비한정")),
    ("ACC_FIN_001", "ACC_FIN", ("금융자산", "금융부채", "상각후원가", "공정가치")),
    ("ACC_FIN_002", "ACC_FIN", ("사채", "전환사채", "회사채", "사채할인", "내재이자율")),
    ("ACC_REV_001", "ACC_REV", ("수익인식", "매출", "고객과의 계약")),
    ("ACC_TAX_001", "ACC_TAX", ("법인세", "이연법인세", "과세소득")),
    ("ACC_EQ_001", "ACC_EQ", ("주식", "배당", "자본", "우선주", "보통주")),
    ("ACC_COST_001", "ACC_COST", ("원가계산", "제조원가", "변동원가", "종합원가", "원가흐름")),
    ("ACC_COST_002", "ACC_COST", ("활동기준", "ABC", "제약이론", "EVA", "잔여이익")),
    ("ACC_CFS_001", "ACC_CFS", ("현금흐름", "영업활동", "투자활동", "재무활동")),
    ("ACC_FS_001", "ACC_FS", ("재무제표", "표시", "개념체계", "표현충실성", "인식", "측정")),
    ("ACC_LEASE_001", "ACC_LEASE", ("리스", "사용권자산", "리스부채")),
    ("ACC_GEN_001", "ACC_GEN", ("회계", "분개", "장부", "재무상태표", "손익")),
)
OTHER = ("ACC_GEN_001", "ACC_GEN")
#: The first phase's rules: (pattern, words of which one must occur, words of which none may).
IN_TRANSIT = ("FOB", "선적", "도착지", "운송 중", "위탁", "시송", "적송", "기말재고에 포함", "재고자산은?")
COST_FLOW = ("선입선출", "FIFO", "가중평균", "이동평균", "총평균", "기초재고", "매출원가")
FIRST_PHASE = (
    ("ACC_INV_001", IN_TRANSIT, ("선입선출", "가중평균")),
    ("ACC_INV_002", ("FOB", "CIF"), ()),
    ("ACC_INV_003", ("운반", "하역", "보험료", "부대비용", "매입할인", "매입세"), ()),
    ("ACC_INV_005", ("PER", "PR(", "실지 재고", "주기적 재고", "재고조사법"), ("선입", "FIFO", "평균")),
    ("ACC_INV_007", COST_FLOW, None),
    ("ACC_INV_006", COST_FLOW, None),
    ("ACC_INV_004", COST_FLOW, ()),
    ("ACC_INV_007", ("순실현", "LCM", "저가", "소매재고", "순매가"), ()),
    ("ACC_INV_008", ("재고자산에 관한", "재고자산의 정의", "회계정책", "분개"), ()),
    ("ACC_INV_004", ("재고자산",), ()),
)
FIRST_PHASE_OTHER = "ACC_INV_001"
TYPES = (("incorrect_statement", r"옳지 않은|틀린|거리가 먼"), ("calculation", r"계산|금액|￦|\d{3,}"))
LETTERS = "[ㄱㄴㄷㄹㅁㅂㅅㅇ]"
#: (looks of a stem, looks of a choice, reasons to take, the first that there is); a look is a pattern, or words of which one is in the text.
WRONG = (
    (("vat", "부가"), ("vat", "부가", "세금"), ("vat",)),
    (None, ("할인", "에누리"), ("discount",)),
    (("fifo", "선입", "선출"), ("fifo", "선입"), ("fifo",)),
    (("평균", "가중"), ("평균",), ("avg",)),
    (("fob", "선적", "도착", "운송"), None, ("fob_swap",)),
    (("위탁", "적송"), None, ("consignment",)),
    (("시송",), None, ("trial",)),
    (("per", "pr", "실지", "계속"), None, ("per_pr", "method")),
    (("lcm", "순실현", "nrv", "순매"), None, ("nrv", "no_loss")),
    (None, r"\d", ("calc",)),
    (("",), None, ("formula",)),
    (("",), None, ("generic",)),
)
NO_REASON = "Pattern 핵심 원칙과 맞지 않는 선택입니다."


def _one_of(c: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def classified(text: Column) -> Column:
    """(pattern_id, chapter_id) by RULES."""
    pair = lambda p, c: F.struct(F.lit(p).alias("pattern_id"), F.lit(c).alias("chapter_id"))
    return F.coalesce(*[F.when(_one_of(text, words), pair(p, c)) for p, c, words in RULES], pair(*OTHER))


def first_phase(text: Column) -> Column:
    """The pattern by FIRST_PHASE; transit does not count where the first 80 characters speak of the cost of sales, and the
    cost flows are told apart by what else the text has."""
    more = {4: _one_of(text, ("소매재고",)), 5: _one_of(text, ("선입", "FIFO", "평균", "단가")), 0: ~F.left(text, F.lit(80)).contains("매출원가")}
    tried = [F.when(_one_of(text, some) & more.get(k, F.lit(True)) & ~_one_of(text, none or ()), p) for k, (p, some, none) in enumerate(FIRST_PHASE)]
    return F.coalesce(*tried, F.lit(FIRST_PHASE_OTHER))


def kind_of_question(stem: Column, choices: Column) -> Column:
    tried = [F.when(stem.rlike(look), name) for name, look in TYPES]
    return F.coalesce(*tried, F.when(F.exists(choices, lambda c: c.rlike(LETTERS)), "mixed"), F.lit("concept"))


def wrong_reason(stem: Column, choice: Column, number: Column, right: Column, reasons: Column, order: Column) -> Column:
    """Why a choice is wrong: the first rule whose look fits and whose reason there is, else one by number from `order`; blank reasons are none.

    Texts and reasons are made once, not once a rule, and a text is searched only for rules whose reason there is.
    """
    at = F.pmod(number + right, F.greatest(F.size(order), F.lit(1)))
    some = F.map_filter(reasons, lambda _, reason: reason != "")
    return let(F.lower(stem), lambda s: let(F.lower(choice), lambda c: let(some, lambda r: _wrong_reason(s, c, r, F.get(order, at)))))


def _wrong_reason(stem: Column, choice: Column, reasons: Column, other: Column) -> Column:
    looks = lambda c, look: F.lit(False) if look is None else c.rlike(look) if isinstance(look, str) else _one_of(c, look)
    tried = []
    for of_stem, of_choice, names in WRONG:
        fits = looks(stem, of_stem) | looks(choice, of_choice)
        for name in names:
            reason = F.try_element_at(reasons, F.lit(name))
            tried.append(F.when(reason.isNotNull() & fits, reason))
    return F.coalesce(*tried, F.try_element_at(reasons, other), F.lit(NO_REASON))

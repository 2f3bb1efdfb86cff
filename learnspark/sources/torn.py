"""Exam pages as a page reader leaves them, made from the words of the given documents.

Each word stands for one fragment of an exam text, chosen by its first letter and its length, so that
a page has years, days, units, amounts, currency and ties in every order, and grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learnspark.sources.model import read

#: What a word stands for; `~` is the word itself.
FRAGMENTS = ("20×1", "20x2", "년", "3", "14", "월", "일부터", "12,000", "W", "₩", "(", ")", "과", "년과", "년에", "각각", "기말 재고 년의", "500", ".", "~", "~", "(가)", "주", "~이다", "20X10", "일", "에", "() 년", "?", "9")
#: Letters as Hangul syllables, particles among them.
LATIN, SYLLABLES = "abcdefghijklmnopqrstuvwxyz", "은는이가을를의에서으로와과도만부터까지하여며면거나것"

#: What a word stands for in a table, and what follows it.
CELLS = ("~", "차변", "구분", "1,200", "0.9091", "(대변) 매출", "①", "3.", "[TABLE]", "~", "12", "~", "적요", "?", "20×1년", "8")
GAPS = ("\n", "  ", "\t", "|", " ", " ", "  ", "\n")
MARKS = "①②③④⑤"

#: What a word stands for in a key sheet.
SHEET = ("41", "42", "43", "44", "45", "1", "2", "3", "4", "5", "46. 3", "47 2", "48.", "1", "회계학", "2교시 A", "2교시 B", "한국산업", "50", "60", "41", "80", "3", "(1)", "12", "~", "회계 학", "49 .4", "5번", "81")

#: What a word stands for in an accounting sentence; other words stay.
ACCOUNTING = ("FOB", "선적", "운반", "매출원가", "선입선출", "순실현", "재고자산에 관한", "유형자산", "재평가", "무형자산", "금융자산", "사채", "수익인식", "법인세", "주식", "원가계산", "활동기준", "현금흐름", "재무제표", "리스", "회계", "재고자산", "PER", "평균", "저가", "CIF", "분개", "틀린", "계산", "옳지 않은", "12,345", "ㄱ", "시송", "소매재고")
OTHER_WORDS = 61


def fragment(word: Column) -> Column:
    """The fragment that a word stands for."""
    chosen = F.element_at(F.array(*map(F.lit, FRAGMENTS)), ((F.ascii(word) + 3 * F.length(word)) % len(FRAGMENTS) + 1).cast("int"))
    return F.replace(chosen, F.lit("~"), word)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lines): a line for each word of a document."""
    words = F.filter(F.split("text", r"[ \n\t]+"), lambda w: w != "")
    return read(spark, sf_dir, "documents").select("doc_id", F.transform(words, fragment).alias("lines"))


def _word(words: Column, k: int) -> Column:
    return F.get(words, F.lit(7 * k) % F.size(words))


def _won(words: Column, k: int) -> Column:
    n = F.length(_word(words, k))
    return F.concat(F.lit("W"), (n % 9 + 1).cast("string"), F.lit(","), F.lpad(((37 * n + k) % 1000).cast("string"), 3, "0"))


def _marked(*parts) -> Column:
    """The five marks, each with what the parts give for its number."""
    return F.concat(*[x for k, m in enumerate(MARKS, 1) for x in (F.lit(m), *(F.lit(p) if isinstance(p, str) else p(k) for p in parts))])


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, body): whole documents as questions, their choices laid out in one of eleven ways by the doc_id."""
    bare = F.btrim("text", F.lit(" \n\t"))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.when(bare != "", F.split(bare, r"[ \n\t]+")).otherwise(F.array(F.lit("none"))).alias("w"))
    w = F.col("w")
    word, won, second = (lambda k: _word(w, k)), (lambda k: _won(w, k)), (lambda k: _won(w, k + 5))
    at = lambda k: F.concat(F.lit(f" {MARKS[k - 1]} "), _won(w, k))
    layouts = (
        F.concat(F.lit("? 20×1 20x2\n"), _marked(" ", won, "\n", second, "\n")),
        F.concat(F.lit("?\n(A) (B)\n"), _marked(" ", word, "\n", won, "\n")),
        F.concat(F.lit("?\n"), _marked("\n", word, " ", word, "\n ", word, "\n")),
        F.concat(F.lit("? "), _marked(" ", word, "  ", word, " ")),
        F.concat(F.lit("?"), at(1), F.lit("\n"), at(2), F.lit("\n"), at(3), at(4), F.lit("\n"), at(5)),
        F.concat(F.lit("? # "), word(1), F.lit(" . # "), word(2), F.lit(" # "), word(3), F.lit("# "), word(4), F.lit(" # "), word(5)),
        F.concat(F.lit("? (단, "), word(1), F.lit(")\n① ㄱ, "), word(2), F.lit("\n② ㄴ "), word(3), F.lit("\n③ ㄱ, ㄴ ④ ㄴ, ㄷ ⑤ ㄷ")),
        F.lit("?"),
        F.concat(F.lit("? 액면가치 3% 4% 5% 6% 7% 8% 9% 10% 0.9709 0.9615 0.9524 0.9434 0.9346 1.111 "), word(1), F.lit(" 0.25 0.5 0.125 0.0625")),
        F.concat(F.lit("? ① "), word(1), F.lit(" ② "), word(2)),
        F.concat(F.lit("? 년 20×1년 20×2년 20×1년 20x2\n"), F.lit("①"), won(1), F.lit(", "), won(2), F.lit("\n가나다라 "), word(1), F.lit("\n"), *[F.concat(F.lit(f"{m} 당기순이익이 증가하고 자산과 부채는 변동하지 않는다 "), word(k), F.lit("\n")) for k, m in enumerate(MARKS[1:], 2)]),
    )
    return docs.select("doc_id", F.concat((F.col("doc_id") % 40 + 41).cast("string"), F.lit(". "), "text", F.element_at(F.array(*layouts), (F.pmod("doc_id", F.lit(len(layouts))) + 1).cast("int"))).alias("body"))


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, body): documents whose words stand for cells, with gaps between them by the next letters."""
    words = F.filter(F.split("text", r"[ \n\t]+"), lambda w: w != "")

    def cell(word: Column) -> Column:
        of = lambda values, k: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
        n = F.length(word)
        return F.concat(F.replace(of(CELLS, F.ascii(word) + n), F.lit("~"), word), of(GAPS, F.ascii(F.reverse(word)) + 5 * n))

    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(words, cell), "").alias("body"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): documents whose words stand for the numbers and headings of a key sheet."""
    words = F.filter(F.split("text", r"[ \n\t]+"), lambda w: w != "")
    of = lambda w: F.replace(F.element_at(F.array(*map(F.lit, SHEET)), ((F.ascii(w) + 3 * F.length(w)) % len(SHEET) + 1).cast("int")), F.lit("~"), w)
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(F.transform(words, of), " ").alias("text"))


def worked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): five questions a document with choices and an explanation, the whole document being one of them."""
    words = F.filter(F.split("text", r"[ \n\t]+"), lambda w: w != "")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("none"))).alias("w"))
    word = lambda k: _word(F.col("w"), k)
    number = lambda k: F.format_number(F.length(word(k)) * 1111 + k, 0)
    heads = ("옳은 것은?", "틀린 것은?", "값은?", "얼마인가?", "추정치에 관한 옳은 것을 고르면")
    choices = (word, word, lambda k: F.concat(F.lit("A "), number(k), F.lit(", B "), number(k + 1)), lambda k: F.concat(number(k), F.lit("원")), lambda k: F.concat(word(k), F.lit(" 25")))
    tails = (F.col("text"), word(4), F.concat(F.lit("A = "), number(3), F.lit("이고 B = "), number(4)), F.concat(F.lit("계산 = "), number(2), F.lit(" 따라서 "), number(5), F.lit(" 최종 결과 $=77")), F.when(F.col("doc_id") % 2 == 0, "추정치의 유용성").otherwise("25% 적용"))
    blocks = [
        F.concat(F.lit(f"{41 + j}. {heads[j]}\n"), *[F.concat(F.lit(f"{k}. "), choices[j](k + j), F.lit("\n")) for k in range(1, 6)], F.lit("CBT문제은행AI "), tails[j], F.lit("\n")) for j in range(5)
    ]
    return docs.select("doc_id", F.concat(F.lit("2과목: 회계학\n"), *blocks).alias("text"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, i, text): the sentences of documents, some of their words as accounting terms."""

    def term(word: Column) -> Column:
        k = (F.ascii(word) + 3 * F.length(word)) % OTHER_WORDS
        return F.when(k < len(ACCOUNTING), F.get(F.array(*map(F.lit, ACCOUNTING)), k)).otherwise(word)

    docs = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", r"\.")).alias("i", "s"))
    words = F.filter(F.split("s", r"[ \n\t]+"), lambda w: w != "")
    return docs.select("doc_id", "i", F.array_join(F.transform(words, term), " ").alias("text"))


def exam_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(year, text): forty questions of `bodies` a year in order of their numbers, a page each."""
    b = bodies(spark, sf_dir).select(F.floor(F.col("doc_id") / 40).cast("int").alias("year"), "doc_id", "body")
    return b.groupBy("year").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "body"))), lambda x: x["body"]), "\f").alias("text"))


def file_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, length): a file for each document, named by a year and one of several kinds."""
    n = F.col("doc_id")
    names = (".pdf", ".hwp", ".json", "-2.pdf", "-ocr-1.txt", ".txt", "-answers.hwp")
    kind = F.get(F.array(*map(F.lit, names)), F.pmod(n, F.lit(len(names))).cast("int"))
    return read(spark, sf_dir, "documents").select(F.concat(F.lit("exams/"), (F.pmod(n, F.lit(3))).cast("string"), F.lit("/"), (1900 + F.pmod(n * 13, F.lit(150))).cast("string"), kind).alias("path"), F.col("n_chars").alias("length"))


def hangul(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): documents in Hangul syllables, with their numbers and marks."""
    return read(spark, sf_dir, "documents").select("doc_id", F.translate(F.lower("text"), LATIN, SYLLABLES).alias("text"))

"""Surrogates on crowded numbers, whole names and further kinds, and their distinctness against brute force."""

import re

import pytest
from pyspark.sql import functions as F

from learnspark.llm import surrogates

SCHEMA = "doc_id long, text string"


def replaced(spark, *texts, key="k"):
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA)
    return [r.text for r in surrogates.with_surrogates(docs, key).orderBy("doc_id").collect()]


def test_crowded_phones(spark, monkeypatch):
    """More short numbers than there are values of their own length and country."""
    monkeypatch.setattr(surrogates, "ATTEMPTS", 40)
    numbers = [f"+1 2{k // 100} {k % 100:02}" for k in range(1000)]
    out = replaced(spark, *[f"call {n} now" for n in numbers])
    new = [t[5:-4] for t in out]
    assert len(set(re.sub(r"\D", "", n) for n in new)) == 1000 and not set(new) & set(numbers)
    assert all(n.startswith("+") and re.fullmatch(r"\+\d \d{2,3} \d{2,}", n) for n in new)


@pytest.mark.parametrize(
    ("text", "hidden"),
    [
        ("Mr McDonald came.", ["McDonald", "Donald"]),
        ("Herr Müller-Schmidt kam.", ["Müller", "Schmidt"]),
        ("Mr. O'Brien left.", ["Brien"]),
        ("Mr Smith's hat, Frau Schmidts Hut", ["Smith", "Schmidt"]),
        ("Mr Smith Mrs Jones", ["Smith", "Jones"]),
        ("Mr O’Neill left.", ["Neill"]),
        ("Dr. Alan Turing wrote.", ["Alan", "Turing"]),
        ("Mr John Ronald Tolkien wrote.", ["John", "Ronald", "Tolkien"]),
        ("Prof. Ada Lovelace; later Lovelace, then Ada.", ["Lovelace", "Ada"]),
        ("Mr McDonald came. McDonald left.", ["McDonald"]),
        ("Pay to DE89 3704 0044 0532 0130 00 soon.", ["3704", "0532"]),
        ("Pay to GB82WEST12345698765432 soon.", ["WEST12345698765432"]),
        ("Host 2001:db8:85a3:0:0:8a2e:370:7334 is up.", ["85a3", "7334"]),
        ("Host fe80::1ff:fe23:4567:890a is up.", ["fe23"]),
        ("token ghp_abcdefghijklmnopqrstuvwxyz0123456789 here", ["abcdefghij"]),
        ("aws_secret_access_key = wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", ["wJalr", "EXAMPLEKEY"]),
    ],
)
def test_hidden(spark, text, hidden):
    (out,) = replaced(spark, text)
    assert out != text and not any(h in out for h in hidden)


@pytest.mark.parametrize("text", ["Mr. and they went", "std::abs(x) and 12:34:56", "AB12 CDEF GHIJ KLMN is no account", "sha 0123456789abcdef0123456789abcdef01234567", "The doctor said. Dr. who?", "a::b"])
def test_left_alone(spark, text):
    assert replaced(spark, text) == [text]


def test_format_and_check_digits(spark):
    out = replaced(spark, "a DE89 3704 0044 0532 0130 00 b", "c DE89370400440532013000 d", "ghp_" + "a" * 36)
    spaced, plain = out[0][2:-2], out[1][2:-2]
    assert spaced.replace(" ", "") == plain and re.fullmatch(r"DE\d\d( \d{4}){4} \d\d", spaced)
    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    assert re.fullmatch(r"ghp_[a-z]{36}", out[2])


def test_the_same_name_everywhere_and_distinct_ones_apart(spark):
    families = [f"{a}{b}{c}" for a in ("Mc", "O'", "") for b in ("Alder", "Birch", "Cedar", "Doran") for c in ("", "son", "-Vale")]
    texts = [f"Mr {f} met Ms {f}." for f in families] + [f"Dr. {f} again" for f in families]
    out = replaced(spark, *texts)
    n = len(families)
    new = [re.fullmatch(r"Mr (\S+) met Ms (\S+)\.", t).groups() for t in out[:n]]
    assert all(a == b for a, b in new) and len({a for a, _ in new}) == n
    assert [re.fullmatch(r"Dr\. (\S+) again", t)[1] for t in out[n:]] == [a for a, _ in new]


def test_keys(spark):
    a, b = (replaced(spark, "mail bob@x.org", key=k) for k in ("one", "two"))
    assert a != b
    spark.conf.unset("spark.learnspark.key")
    drawn = surrogates.session_key(spark)
    assert len(drawn) == 64 and surrogates.session_key(spark) == drawn
    spark.conf.unset("spark.learnspark.key")
    assert surrogates.session_key(spark) != drawn


def test_very_long_text(spark):
    text = "word " * 200_000 + "bob@x.org" + " Mr Smith," * 1000
    (out,) = replaced(spark, text)
    assert "bob@x.org" not in out and "Smith" not in out and out.startswith("word word") and len(set(re.findall(r"Mr (\S+)", out))) == 1


def test_rows_with_the_same_id(spark):
    docs = spark.createDataFrame([(1, "a bob@x.org"), (1, "b bob@x.org"), (None, "c bob@x.org"), (1, None)], SCHEMA)
    out = [r.text for r in surrogates.with_surrogates(docs, "k").collect()]
    assert len(out) == 4 and len({t[2:] for t in out if t}) == 1 and docs.where(F.col("text").isNull()).count() == 1

"""PII surrogates in DataFrame functions only.

One pattern finds all entities of a text. An entity is its kind and its normal form (a phone number
is its digits, without the 1 before ten others; an address is lower case), and its surrogate is a keyed SHA-256 of both, put
into the kind's own form: digits for digits in the format of the place, a valid check digit, a name
of the same script and, for given names, the same gender. Names are found by the title before them,
up to three words with hyphens and apostrophes; where such a name stands without it elsewhere in the same text, whole or in
part, it is replaced too. A name that no title marks in its text stays. So each mention of an entity that is found, in any
document and format, gets the same surrogate. From attempt GROW on, values of a kind that may run out grow. Distinct entities must get distinct surrogates and no
surrogate may be a real entity: surrogates of all entities of the corpus are grouped, and every
entity but one of a collision tries again with its next attempt until none is left. Only documents
with matches are joined to the surrogates; the others pass through in place.

Defined results: a null text stays null; a text without entities stays as it is; rows that repeat a
doc_id are replaced each for itself; an empty table gives an empty result; all other columns pass
through unchanged.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from learnspark.llm.common import cut, free_names, table

MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Sir", "Lord", "Signor", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Señorita", "Srta", "Lady", "Dame", "Signora", "Госпожа", "Κυρία")
#: Titles that tell no gender; given names behind them are of either kind.
ANY_GENDER = ("Dr", "Prof", "Professor", "Doctor", "Docteur", "Doktor", "Mx", "Доктор", "Профессор")
TITLE = "(?:" + "|".join(sorted(MALE + FEMALE + ANY_GENDER, key=len, reverse=True)) + ")"
#: A word of a name: no title, with a small letter, without a possessive's end.
NAME_WORD = rf"(?!{TITLE}\b)(?=\p{{Lu}}[\p{{L}}'’-]*\p{{Ll}})\p{{Lu}}[\p{{L}}\p{{M}}]*+(?:['’-](?!s\b)\p{{L}}[\p{{L}}\p{{M}}]*+)*+"
#: Kind: pattern. Where two fit at the same place, the first counts.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "key": r"\bAKIA[0-9A-Z]{16}\b",
    "token": r"\bgh[opsur]_[A-Za-z0-9]{36,}+(?!\w)",
    "awskey": r"(?<=(?i:secret_access_key)[=:]|(?i:secret_access_key)[=:][\x20\"']|(?i:secret_access_key)[=:]\x20[\"']|(?i:secret_access_key)\x20=\x20|(?i:secret_access_key)\x20=\x20[\"'])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])",
    "iban": r"\b[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b",
    "password": r"(?i:(?<=\bpassword=)|(?<=\bpasswd=)|(?<=\bpwd=))[^\x00-\x20\"']++|(?i:(?<=\bpassword: ))[^\x00-\x20\"']{6,}+",
    "secret": r"(?<==\x20?[\"'])[0-9a-fA-F]{32,}+(?=[\"'])",
    "ipv6": r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,6}|[0-9A-Fa-f]{1,4}:(?::[0-9A-Fa-f]{1,4}){2,6})(?![\w:])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.-])[3-6]\d{3}(?:[\x20-]?\d{4}){2}[\x20-]?\d{1,7}(?![\d-])",
    "phone": r"(?<![\w+])\+\d{1,3}[\x20.-]?(?:\(\d{1,4}\)[\x20.-]?)?\d{2,4}(?:[\x20.-]?\d{2,4}){1,3}(?!\d)|(?<![\w(])\(\d{3}\)\x20?\d{3}-\d{4}(?!\d)|(?<![\w-])\d{3}-\d{3}-\d{4}(?![\d-])",
    "name": rf"(?<!\p{{L}}){TITLE}\.?\x20{NAME_WORD}(?:\x20{NAME_WORD}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in KINDS.values())
#: Every match of the other kinds holds one of these; texts without them, most texts, are passed over quickly.
HINT = r"[0-9@]|::|AKIA|=\x20?[\"']|(?i:passw|pwd=)"
#: Syllables of made-up names: consonants, vowels, end of a woman's and of a man's given name, by script.
SCRIPTS = {
    "latin": ("bdfgklmnprstvzhj", "aeiouaeiouaeioua", "a", "n"),
    "cyrillic": ("бдзгклмнпрствжхф", "аеиоуаеиоуаеиоуа", "а", "н"),
    "greek": ("βγδζθκλμνπρστφχξ", "αειουαειουαειουα", "α", "ς"),
}
HEX = "0123456789abcdef"
#: What stands for letters of other scripts, by a hash's digits; a script without a row gets Latin letters. MARKS stands for the rest.
LETTERS = {
    "Cyrillic": "бдзгклмнпрствжхф",
    "Greek": "βγδζθκλμνπρστφχξ",
    "Han": "天地人山水火木金土日月星風雨石田",
    "Hangul": "가나다라마바사아자차카타파하거너",
    "Hiragana": "あいうえおかきくけこさしすせそた",
    "Katakana": "アイウエオカキクケコサシスセソタ",
    "Arabic": "بتثجحخدرزسشصطعفق",
    "Hebrew": "אבגדהוזחטיכלמנסע",
}
MARKS = "!#$%&*+/:;=?^_~|"
#: From this attempt on, passwords, the local parts of addresses, phone and other numbers grow by a place an attempt, so that values never run out.
GROW = 3
#: Digits that a phone number must have behind its country's, or the country's are replaced too.
PHONE_REST = 7
#: Attempts before an entity without a free surrogate is an error; only kinds of fixed length with very many values could get there.
ATTEMPTS = 200


def session_key(spark: SparkSession) -> str:
    """The secret key in spark.learnspark.key; where it is unset, one is drawn for the session, so surrogates can't be told from another run's."""
    option = "spark.learnspark.key"
    if not spark.conf.get(option, ""):
        spark.conf.set(option, secrets.token_hex(32))
    return spark.conf.get(option)


def _mod97(c: Column) -> Column:
    """The remainder of an IBAN-like text, its first four characters put behind the others and letters read as 10 to 35."""
    step = lambda total, x: F.pmod(total * F.when(x.rlike("[0-9]"), 10).otherwise(100) + F.conv(x, 36, 10).cast("int"), F.lit(97))
    return F.aggregate(F.filter(F.split(F.concat(F.substring(c, 5, 1 << 30), F.left(c, F.lit(4))), ""), lambda x: x != ""), F.lit(0), step)


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def _luhn(digits: Column, doubled: int) -> Column:
    """Sum of the Luhn rule; the last digit is doubled where `doubled` is 1, every second one before it too."""

    def add(total: Column, i: Column) -> Column:
        x = digits.substr(F.length(digits) - i, F.lit(1)).cast("int")
        y = F.when(F.pmod(i + doubled, F.lit(2)) == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)
        return total + y

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _kind(m: Column) -> Column:
    full = [(k, m.rlike(f"^(?:{p})$")) for k, p in KINDS.items() if k not in ("password", "secret", "card", "email", "awskey", "iban")]
    out = F.when(m.contains("@") & m.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"), "email")
    iban = m.rlike(f"^(?:{KINDS['iban']})$")
    out = out.when(iban & (_mod97(F.replace(m, F.lit(" "), F.lit(""))) == 1), "iban")
    for k, hit in full:
        out = out.when(hit, k)
    out = out.when(iban, F.lit(None))
    number = m.rlike(r"^\d[\d\x20-]*$") & (F.length(_digits(m)) >= 13)
    out = out.when(number & (F.pmod(_luhn(_digits(m), 0), F.lit(10)) == 0), "card").when(number, F.lit(None))
    return out.when(m.rlike(r"^[0-9a-fA-F]{32,}$"), "secret").when(m.rlike(r"^[A-Za-z0-9/+]{40}$"), "awskey").otherwise("password")


def _normal(kind: Column, m: Column) -> Column:
    return F.when(kind.isin("email", "ipv6"), F.lower(m)).when(kind == "iban", F.replace(m, F.lit(" "), F.lit(""))).when(kind == "phone", F.regexp_replace(_digits(m), r"^1(?=\d{10}$)", "")).when(kind.isin("card", "ssn"), _digits(m)).otherwise(m)


def _entities(hits: Column) -> Column:
    """array<struct<m, kind, norm>> of matches; the kind is null where a match is no entity after all."""
    kinds = F.transform(hits, lambda m: F.struct(m.alias("m"), _kind(m).alias("kind")))
    return F.transform(kinds, lambda x: F.struct(x["m"].alias("m"), x["kind"].alias("kind"), _normal(x["kind"], x["m"]).alias("norm")))


def _name_words(e: Column) -> Column:
    """The words of a name as written, without its title."""
    words = F.split(e["m"], " ")
    return F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))


def _parts(e: Column) -> Column:
    """array<struct<kind, norm>> to be kept distinct: an entity itself, or the given names and the family name in a name."""
    words = _name_words(e)
    title = F.rtrim(F.split(e["m"], " ")[0], F.lit("."))
    gender = F.when(title.isin(*FEMALE), "given-f").otherwise("given-m")
    part = lambda w, i: F.struct(F.when(i + 1 == F.size(words), "family").otherwise(gender).alias("kind"), F.lower(w).alias("norm"))
    return F.when(e["kind"] == "name", F.transform(words, part)).when(e["kind"].isNotNull(), F.array(F.struct(e["kind"].alias("kind"), e["norm"].alias("norm"))))


def _refit(m: Column, letters: Column, digits: Column, h: Column | None = None) -> Column:
    """m with letters and digits, place by place, from the two streams of 64; case is kept.

    With h, the hash, letters of other scripts and all other characters are drawn too.
    """
    at = lambda s, i: s.substr(F.pmod(i, F.lit(64)) + 1, F.lit(1))

    def one(c: Column, i: Column) -> Column:
        out = F.when(c.rlike("[0-9]"), at(digits, i)).when(c.rlike("[a-z]"), at(letters, i)).when(c.rlike("[A-Z]"), F.upper(at(letters, i)))
        if h is None:
            return out.otherwise(c)
        cased = lambda x: F.when(c.rlike(r"\p{Lu}"), F.upper(x)).otherwise(x)
        for script, row in LETTERS.items():
            out = out.when(c.rlike(rf"^\p{{Is{script}}}"), cased(at(F.translate(h, HEX, row), i)))
        return out.when(c.rlike(r"^[\p{L}\p{N}]"), cased(at(letters, i))).otherwise(at(F.translate(h, HEX, MARKS), i))

    return F.array_join(F.transform(F.split(m, ""), one), "")


def with_surrogate(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, norm, attempt) plus `sur`, the surrogate's normal form; for a name part, the lower-case name."""
    kind, norm, h, digits, letters = (F.col(c) for c in ("kind", "norm", "_h", "_digits", "_letters"))
    keyed = lambda *c: F.sha2(F.concat_ws("\x01", F.lit(key), *c), 256)
    out = entities.withColumn("_h", keyed(kind, norm, F.col("attempt").cast("string")))
    out = out.withColumn("_digits", F.translate(h, "abcdef", "274953")).withColumn("_letters", F.translate(h, HEX, "bcdfghjklmnpqrst"))
    local = F.substring_index(norm, "@", 1)
    host = F.translate(keyed(F.lit("host"), F.substring_index(norm, "@", -1)).substr(1, 10), HEX, "bcdfghjklmnpqrst")
    first = lambda n: F.translate(digits.substr(n, 1), "01", "68")  # noqa: E731  2 to 9
    octet = lambda n, low, size: (F.conv(h.substr(n, 4), 16, 10).cast("int") % size + low).cast("string")
    out = out.withColumn("_body", F.when(kind == "card", F.concat(norm.substr(1, 1), digits.substr(F.lit(1), F.length(norm) - 2 + F.greatest(F.col("attempt") - (GROW - 1), F.lit(0))))))
    body = F.col("_body")
    script = F.lit("latin")  # names of other scripts too
    for name, marks in {"latin": r"\p{IsLatin}", "cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}.items():
        script = F.when(norm.rlike(marks), name).otherwise(script)

    def of(k: int, make=F.lit) -> Column:
        """Part k of the script's row in SCRIPTS."""
        value = F.lit(None).cast("string")
        for name, row in SCRIPTS.items():
            value = F.when(F.col("_script") == name, make(row[k])).otherwise(value)
        return value

    stream = lambda k: of(k, lambda x: F.translate(h, HEX, x))
    out = out.withColumn("_script", script).withColumn("_c", stream(0)).withColumn("_v", stream(1))
    c, v = F.col("_c"), F.col("_v")
    grown = F.greatest(F.col("attempt") - (GROW - 1), F.lit(0))
    more = letters.substr(F.lit(1), grown)
    bban = F.concat(norm.substr(1, 2), F.lit("00"), _refit(F.substring(norm, 5, 1 << 30), letters, digits))
    hexes = F.repeat(h, F.ceil(F.length(norm) / 64).cast("int"))
    word = F.concat(*[x.substr(i, 1) for i in (1, 3, 5) for x in (c, v)], c.substr(7, 1))
    values = {
        "email": F.concat(F.rpad(_refit(local, letters, digits), F.greatest(F.length(local), F.lit(8)), letters), more, F.lit("@"), host, F.lit(".example.com")),
        "ip": F.concat_ws(".", octet(1, 1, 223), octet(5, 0, 256), octet(9, 0, 256), octet(13, 1, 254)),
        "card": F.concat(body, F.pmod(10 - F.pmod(_luhn(body, 1), F.lit(10)), F.lit(10)).cast("string")),
        "phone": F.when(F.length(norm) == 10, F.concat(first(1), digits.substr(2, 2), first(4), digits.substr(5, 6))).when(F.length(norm) >= PHONE_REST + 2, F.concat(norm.substr(1, 2), digits.substr(F.lit(1), F.length(norm) - 2 + grown))).otherwise(F.concat(first(1), digits.substr(F.lit(2), F.length(norm) - 1 + grown))),  # the country stays where the rest has room
        "ssn": F.concat(F.lit("9"), digits.substr(F.lit(1), 8 + grown)),
        "iban": F.concat(norm.substr(1, 2), F.lpad((98 - _mod97(bban)).cast("string"), 2, "0"), F.substring(bban, 5, 1 << 30)),
        "ipv6": F.concat(F.lit("fd"), h.substr(1, 2), *[F.concat(F.lit(":"), h.substr(4 * k + 1, 4)) for k in range(1, 8)]),
        "token": F.concat(F.left(norm, F.lit(4)), _refit(F.substring(norm, 5, 1 << 30), letters, digits)),
        "awskey": _refit(norm, letters, digits),
        "key": F.concat(F.lit("AKIA"), F.upper(F.translate(h.substr(1, 16), "01", "yz"))),
        "secret": F.when(F.upper(norm) == norm, F.upper(hexes)).otherwise(hexes).substr(F.lit(1), F.length(norm)),
        "given-f": F.concat(word, of(2)),
        "given-m": F.concat(word, v.substr(8, 1), of(3)),
        "family": F.concat(word, v.substr(9, 1), c.substr(10, 1)),
        "password": F.concat(_refit(norm, letters, digits, h), more),
    }
    sur = None
    for name, value in values.items():
        sur = F.when(kind == name, value) if sur is None else sur.when(kind == name, value)
    return out.withColumn("sur", sur).drop("_h", "_digits", "_letters", "_body", "_script", "_c", "_v")


def _placed(e: Column, parts: Column) -> Column:
    """The mention e with its surrogate in its own format; parts: the surrogates of _parts(e)."""
    sur = F.get(parts, F.lit(0))
    room = F.length(_digits(e["m"]))
    skip = F.greatest(room - F.length(sur), F.lit(0))  # a country's 1 that the normal form leaves out

    def digit(c: Column, i: Column) -> Column:
        nth = F.length(_digits(e["m"].substr(F.lit(1), i + 1))) - skip
        return F.when(c.rlike("[0-9]") & (nth > 0), sur.substr(nth, F.lit(1))).otherwise(c)

    spread = F.concat(F.array_join(F.transform(F.split(e["m"], ""), digit), ""), F.substr(sur, room + 1))  # a surrogate that has grown is longer
    iban = F.when(e["m"].contains(" "), F.rtrim(F.regexp_replace(sur, "(.{4})", "$1 "))).otherwise(sur)
    name = F.concat_ws(" ", F.split(e["m"], " ")[0], F.transform(parts, F.initcap))
    return F.when(e["kind"].isNull(), e["m"]).when(e["kind"].isin("phone", "card", "ssn"), spread).when(e["kind"] == "name", name).when(e["kind"] == "iban", iban).otherwise(sur)


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt, sur) of distinct (kind, norm): no two surrogates of a kind are equal, none is an entity.

    An entity for which ATTEMPTS surrogates were all taken raises an error.
    """
    now = cut(with_surrogate(entities.withColumn("attempt", F.lit(0)), key))
    while True:
        # of equals, the entity settled earlier keeps its surrogate
        turn = F.row_number().over(Window.partitionBy("kind", "sur").orderBy("attempt", "norm"))
        real = entities.select(F.col("kind").alias("k2"), F.col("norm").alias("n2"), F.lit(True).alias("taken"))
        ranked = now.withColumn("turn", turn).join(real, (F.col("kind") == F.col("k2")) & (F.col("sur") == F.col("n2")), "left")
        lost = cut(ranked.where("turn > 1 or taken").select("kind", "norm", (F.col("attempt") + 1).alias("attempt")))
        if lost.isEmpty():
            return now
        if full := lost.where(F.col("attempt") >= ATTEMPTS).select("kind").first():
            raise ValueError(f"no free surrogate for an entity of kind {full.kind} after {ATTEMPTS} attempts")
        now = cut(now.join(lost, ["kind", "norm"], "left_anti").unionByName(with_surrogate(lost, key)))


def with_surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with the text's entities replaced, and their number in a new column count_col where it is named.

    Only the documents with matches are shuffled; the others pass through.
    """
    if count_col in docs.columns:
        raise ValueError(f"docs has a column {count_col} already")
    hits, row, of, at, map_, counted = free_names(docs, "hits", "row", "of", "at", "told", count_col or "entities")
    text = F.col(f"`{text_col}`")
    all_hits = F.regexp_extract_all(text, F.lit(ANY), 0)
    hit = F.coalesce(F.when(text.rlike(HINT) | text.rlike(KINDS["name"]), text.rlike(ANY)), F.lit(False))
    clean = docs.where(~hit).withColumn(counted, F.lit(0))
    found = cut(docs.where(hit).withColumn(hits, _entities(all_hits)).withColumn(row, F.xxhash64(text)))
    seen = found.select(F.col(f"`{id_col}`").alias("d"), F.col(row).alias("r"), F.explode(hits).alias("e")).select("d", "r", F.explode(_parts(F.col("e"))).alias("p")).select("d", "r", "p.kind", "p.norm").distinct()
    seen = cut(seen)
    known = distinct_surrogates(cut(seen.select("kind", "norm").distinct()), key)
    pair = F.struct(F.concat_ws("\x01", "kind", "norm"), "sur")
    per = seen.join(known, ["kind", "norm"]).groupBy(F.col("d").alias(of), F.col("r").alias(at)).agg(F.map_from_entries(F.collect_list(pair)).alias(map_))
    told = lambda p: F.col(map_)[F.concat_ws("\x01", p["kind"], p["norm"])]

    def replaced(e: Column) -> Column:
        return _placed(e, F.transform(_parts(e), told))

    new = F.array_join(F.zip_with(F.split(text, ANY, -1), F.transform(hits, replaced), lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
    # names again, where no title stands before them
    named = F.filter(hits, lambda e: e["kind"] == "name")
    parts = F.array_distinct(F.flatten(F.transform(named, lambda e: F.transform(F.zip_with(_name_words(e), _parts(e), lambda w, p: F.struct(w.alias("word"), p.alias("part"))), lambda p: F.struct(p["word"].alias("name"), F.initcap(told(p["part"])).alias("sur"))))))
    once_more = F.aggregate(parts, new, lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}@.])"), p["name"], F.lit(r"(?![\p{L}@])")), p["sur"]))
    joined = found.join(per, F.col(f"`{id_col}`").eqNullSafe(F.col(of)) & (F.col(row) == F.col(at)), "left")
    done = joined.withColumn(text_col, F.when(F.size(named) > 0, once_more).otherwise(new)).withColumn(counted, F.size(F.filter(hits, lambda e: e["kind"].isNotNull())))
    out = clean.unionByName(done.select(*[F.col(f"`{c}`") for c in clean.columns]))
    return out if count_col else out.drop(counted)


def op4_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), session_key(spark), count_col="n_entities")
    return docs.select("doc_id", "text", F.col("n_entities").cast("long").alias("n_entities"))

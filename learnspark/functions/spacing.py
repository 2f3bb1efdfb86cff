"""Spaces in glued Hangul that leave numbers alone: tokens are masked, words are parted, tokens are put back.

`particles_apart` is built-in functions. `terms_apart` matches a dictionary with an Aho-Corasick
automaton, so its time is linear in the text whatever the dictionary's size. Null texts stay null.
Private-use characters from U+E100 on are the masks and are not expected in texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from learnspark.functions.choices import let
from learnspark.functions.lines import UNITS
from learnspark.functions.text import NUMBER

# Particles and endings that start a word of their own, and units that stay with their number.
PARTICLES = "은 는 이 가 을 를 의 에 에서 으로 로 와 과 도 만 부터 까지 하여 하며 하면 하거나 하는 하였 하기 경우 때 것 등 및 있다 없다 이다 아니다 ( （".split()
KEPT_UNITS = "년월일원주회번호층시분세"
#: Marks and neighbours that get a space between them, in order.
APART = (
    (r"([.?,:;])([가-힣A-Za-z0-9])", "$1 $2"),
    (r"([가-힣0-9])(\()", "$1 $2"),
    (r"\)(?=[가-힣A-Za-z0-9])", ") "),
    (r"([가-힣])(W\d|\d)", "$1 $2"),
    (rf"(\d)((?![{KEPT_UNITS}])[가-힣])", "$1 $2"),
)


#: Bytes of texts that a Python worker is given at once.
BATCH_BYTES = 4 << 20

#: A place before a particle, behind Hangul: one class for those of one character, before all longer ones.
_PARTICLE = "(?=[" + "".join(p for p in PARTICLES if len(p) == 1) + "]|" + "|".join(p for p in PARTICLES if len(p) > 1 and p[0] not in PARTICLES) + ")(?<=[가-힣])"


def _mask(k: int) -> str:
    return chr(0xE100 + k)


def masked(text: Column, patterns: Sequence[str]) -> Column:
    """(text, tokens): what each pattern matches, one pattern after the other, is kept in tokens and stands in the text as the pattern's mask."""
    state = F.struct(text.alias("text"), F.array().cast("array<array<string>>").alias("tokens"))
    for k, p in enumerate(patterns):
        state = let(state, _masker(k, p))
    return state


def _masker(k: int, pattern: str):
    def mask(s: Column) -> Column:
        found = F.regexp_extract_all(s["text"], F.lit(pattern), 0)
        new = lambda x: F.when(F.size(x) > 0, F.regexp_replace(s["text"], pattern, _mask(k))).otherwise(s["text"])
        return let(found, lambda x: F.struct(new(x).alias("text"), F.concat(s["tokens"], F.array(x)).alias("tokens")))

    return mask


def restored(text: Column, tokens: Column, n: int) -> Column:
    """The text with the i-th mask of each of n patterns replaced by the pattern's i-th token."""
    for k in range(n):
        text = let(text, _weaver(k, tokens))
    return text


def _weaver(k: int, tokens: Column):
    return lambda t: F.when(t.contains(_mask(k)), F.array_join(_woven(F.split(t, _mask(k)), F.get(tokens, F.lit(k))), "")).otherwise(t)


def _woven(parts: Column, tokens: Column) -> Column:
    return F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(tokens, i), F.lit(""))))


def particles_apart(text: Column) -> Column:
    """Spaces around marks, numbers and before particles of glued Hangul; units stay with their numbers, spaces inside brackets go."""
    patterns = (*UNITS, NUMBER)
    return let(masked(text, patterns), lambda s: restored(_apart(s["text"]), s["tokens"], len(patterns)))


def _apart(c: Column) -> Column:
    c = F.regexp_replace(F.replace(F.replace(c, F.lit("￦"), F.lit("W")), F.lit("₩"), F.lit("W")), r"20[xX](\d)", "20×$1")
    for pattern, new in APART:
        c = F.regexp_replace(c, pattern, new)
    c = F.regexp_replace(c, _PARTICLE, " ")
    bare = lambda x: F.when(x.contains("(") | x.contains(")"), F.regexp_replace(x, r"(?<=\()\s+|\s+(?=\))", "")).otherwise(x)
    return F.regexp_replace(let(c, bare), r"[ \t]{2,}", " ")


class Terms:
    """A dictionary whose longer terms count first, equal ones in its order; prefixes come after all terms."""

    def __init__(self, terms: Sequence[str], prefixes: Sequence[str] = ()) -> None:
        kept = dict.fromkeys(t for t in terms if len(t) > 1)
        self.words = [(w, False) for w in sorted(kept, key=len, reverse=True)] + [(p, True) for p in dict.fromkeys(prefixes) if len(p) > 1]
        self.automaton = ahocorasick.Automaton()
        by_text: dict[str, list[tuple[int, int]]] = {}
        for rank, (w, _) in enumerate(self.words):
            by_text.setdefault(w, []).append((rank, len(w)))
        for w, ranks in by_text.items():
            self.automaton.add_word(w, ranks)
        if by_text:
            self.automaton.make_automaton()

    def spaced(self, text: str | None) -> str | None:
        """A space before each term behind Hangul, and around each prefix between Hangul, as one after the other would put them."""
        if text is None or not self.words:
            return text
        found: dict[int, list[int]] = {}  # for each word, where it starts behind Hangul
        for end, ranks in self.automaton.iter(text):
            for rank, size in ranks:
                start = end + 1 - size
                if start and "가" <= text[start - 1] <= "힣":
                    found.setdefault(rank, []).append(start)
        broken = bytearray(len(text) + 1)  # 1 at breaks of the words before the one in hand
        breaks: set[int] = set()
        for rank in sorted(found):
            word, prefix = self.words[rank]
            size, own, free = len(word), [], 0  # from `free` on the word may match again
            for start in found[rank]:
                end = start + size
                if start < free or broken.find(1, start, end + prefix) >= 0:
                    continue
                if prefix:
                    if end == len(text) or not "가" <= text[end] <= "힣":
                        continue
                    own.append(end)
                own.append(start)
                free = end
            for k in own:
                broken[k] = 1
            breaks.update(own)
        places = sorted(breaks)
        return " ".join([text[i:j] for i, j in zip([0, *places], [*places, len(text)], strict=True)])


def terms_apart(text: Column, terms: Sequence[str], prefixes: Sequence[str] = ()) -> Column:
    """The text with the terms of a dictionary apart; runs of white space become one space.

    From here on in this session, Arrow batches have BATCH_BYTES at most, or one longer text: a worker holds several copies of a batch.
    """
    words = [(*terms,), (*prefixes,)]
    SparkSession.active().conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    @F.arrow_udf("string")
    def apart(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Terms(*words)
        for texts in batches:
            yield pa.array((known.spaced(x.as_py()) for x in texts), pa.string())

    return F.regexp_replace(apart(text), r"\s{2,}", " ")

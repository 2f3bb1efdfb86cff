"""Removal of long word sequences that occur earlier in the corpus, or in a reference, by suffix automata.

A suffix automaton of a reference shard is built once; documents are streamed through it for matching
statistics (at each word, the longest sequence ending there that the shard contains), and what lies
in spans of at least `window` words goes.

`remove_known` is the broadcast form, for a reference of bounded size. `remove_repeats` compares the
corpus with itself. There, every document would have to pass the automata of all documents before it,
so only what may be repeated meets, and only where it may meet its like:
1. Each window of `window` words picks the least hash among its GRAM-word grams; equal windows pick
   equal grams, so a pick is a shard's key. Windows in a row with the same pick form a unit. Counting
   picks tells those that occur once (nothing to do), those that always come with the same unit, and
   the rest; the two repeated kinds go into Bloom filters of bounded size. A false hit there gives
   more rows but the same result, since all occurrences of a pick are treated alike.
2. Equal units are one content, with its first place in the corpus by aggregation.
3. The contents of a pick are a shard: in order of their first places, each is streamed through the
   suffix automaton of those before it and is added to it. A unit that always comes alike needs none.
   A pick with more than SHARD_CONTENTS different contents would make one task too long; there each
   window is a row, and the first place of each is found by aggregation.
4. A unit at a later place than its content's first goes whole; at the first place its windows go
   that the automaton has met. Units of a very common content are told by a broadcast of the few
   such contents. Only (id, span) lists meet the texts again.
It is linear in the input and exact up to 95-bit hashes of units and 48-bit hashes of their words.

Defined results: a null or blank text has no words and keeps the empty string; a text with fewer
words than a window loses nothing; of equal windows the one with the smallest (id, start) stays, a
null id being smallest; rows with the same id and text are one document, so neither makes the other
go; rows that share an id but not the text come in order of the text's hash; an empty table gives an
empty result; other columns, whatever their names, pass through unchanged.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnspark.llm.common import cut, drop_cut, free_names, joined_by_count, sliced, table

WINDOW, GRAM = 20, 6
#: Words in a broadcast shard, and in all of a broadcast reference at most.
SHARD_WORDS, REFERENCE_WORDS = 50_000, 500_000
#: Contents of a pick that one automaton takes (34 words each at most).
SHARD_CONTENTS = 20_000
KNOWN = 300_000
#: A filter has 16 bits a key between these bounds: 16 MB at most.
MIN_BITS, MAX_BITS = 1 << 16, 1 << 27
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Hashes:
    """Hashes of any ranges of a document's words, from prefix sums of word hash * base^position."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    #: Hashes of words met before; a worker remembers up to KNOWN.
    _known: dict[bytes, int] = {}

    def __init__(self, words: list[bytes]):
        known = self._known
        if new := set(words).difference(known):
            if len(known) > KNOWN:
                known.clear()
                new = set(words)
            known.update((w, xxhash.xxh64_intdigest(w)) for w in new)
        self.h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        self.sums: list[np.ndarray | None] = [None, None]

    @classmethod
    def powers(cls, k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in cls._powers or len(cls._powers[k][0]) < n:
            size = 1 << max(16, n.bit_length())
            base = _BASES[k]
            inverse = np.uint64(pow(int(base), -1, 1 << 64))
            cls._powers[k] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (base, inverse))
        return cls._powers[k]

    def of(self, start: np.ndarray, stop: np.ndarray, k: int = 0) -> np.ndarray:
        up, down = self.powers(k, len(self.h) + 1)
        if self.sums[k] is None:
            self.sums[k] = np.r_[np.uint64(0), np.cumsum(self.h * up[: len(self.h)], dtype=np.uint64)]
        return _mix((self.sums[k][stop] - self.sums[k][start]) * down[start] + (stop - start).astype(np.uint64))


def _window_argmin(x: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values, the place of its least, the first of equals; windows double in size."""
    at, size = np.arange(len(x)), 1
    while 2 * size <= width:
        a, b = at[:-size], at[size:]
        at, size = np.where(x[b] < x[a], b, a), 2 * size
    a, b = at[: len(x) - width + 1], at[width - size :][: len(x) - width + 1]
    return np.where(x[b] < x[a], b, a)


def units(h: Hashes, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pick, first window start, last window start) of each unit of a document."""
    n = len(h.h)
    if n < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n - gram + 1)
    grams = h.of(at, at + gram)
    choice = _window_argmin(grams, window - gram + 1)
    first = np.flatnonzero(np.r_[True, choice[1:] != choice[:-1]])
    return grams[choice[first]], first, np.r_[first[1:], len(choice)] - 1


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def picks(docs: DataFrame, text_col: str, window: int, gram: int) -> DataFrame:
    """(pick, unit): a row for each unit."""

    def run(batches):
        for b in sliced(batches):
            found = []
            for x in b.column(0):
                h = Hashes((x.as_py() or b"").split())
                pick, first, last = units(h, window, gram)
                found.append((pick, h.of(first, last + window)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate(c))) for c in zip(*found, strict=True)], ["pick", "unit"])

    return docs.select(F.col(f"`{text_col}`").cast("binary")).mapInArrow(run, "pick long, unit long")


class Bloom:
    """Membership of 64-bit hashes in a bit map of bounded size; no false misses."""

    def __init__(self, keys: DataFrame, count: int):
        """keys: one long column `pick`, already well mixed."""
        self.bits = max(MIN_BITS, min(MAX_BITS, 1 << (16 * count).bit_length()))
        block = MIN_BITS

        def pack(key, rows):
            import pandas as pd

            on = np.zeros(block, np.uint8)
            on[rows["bit"].to_numpy() % block] = 1
            return pd.DataFrame({"block": [key[0]], "map": [np.packbits(on, bitorder="little").tobytes()]})

        low = F.col("pick").bitwiseAND(F.lit(self.bits - 1))
        high = F.shiftrightunsigned("pick", 32).bitwiseAND(F.lit(self.bits - 1))
        bits = keys.select(F.explode(F.array(low, high)).alias("bit")).distinct().withColumn("block", F.floor(F.col("bit") / block).cast("int"))
        self.map = np.zeros(self.bits // 8, np.uint8)
        for r in bits.groupBy("block").applyInPandas(pack, "block int, map binary").toLocalIterator():
            self.map[r["block"] * block // 8 : (r["block"] + 1) * block // 8] = np.frombuffer(r["map"], np.uint8)

    def has(self, pick: np.ndarray) -> np.ndarray:
        mask = np.uint64(self.bits - 1)

        def on(i: np.ndarray) -> np.ndarray:
            return (self.map[i >> np.uint64(3)] >> (i & np.uint64(7)).astype(np.uint8)) & 1

        return (on(pick & mask) & on((pick >> np.uint64(32)) & mask)).astype(bool)


def places(docs: DataFrame, alike: Bloom, mixed: Bloom, id_col: str, text_col: str, window: int, gram: int) -> DataFrame:
    """(pick, k1, k2, id, row, start, n, words): units of n windows whose pick may be repeated; k1, k2: hash of the words.

    A unit whose pick does not always come alike has its words' hashes, where it is the first of its
    kind that the task meets (so a copied passage is sent once a task).
    """
    filters = docs.sparkSession.sparkContext.broadcast((alike, mixed))
    schema = pa.schema([("pick", pa.int64()), ("k1", pa.int64()), ("k2", pa.int32()), ("id", pa.int64()), ("row", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("words", pa.binary())])

    def run(batches):
        one, many = filters.value
        met: set[int] = set()
        for b in sliced(batches):
            found, owner, rows, words = [], [], [], []
            for d, x in enumerate(b.column(1)):
                raw = x.as_py() or b""
                h = Hashes(raw.split())
                pick, first, last = units(h, window, gram)
                split = many.has(pick)
                at = np.flatnonzero(split | one.has(pick))
                if not len(at):
                    continue
                start, stop, split = first[at], last[at] + window, split[at]
                k1 = h.of(start, stop)
                found.append((_signed(pick[at]), _signed(k1), (h.of(start, stop, 1) >> np.uint64(33)).astype(np.int32), start, stop - start - window + 1))
                owner.append(np.full(len(at), d))
                rows.append(np.full(len(at), xxhash.xxh64_intdigest(raw, 42), np.uint64).view(np.int64))
                for key, s, e, wanted in zip(k1.tolist(), start.tolist(), stop.tolist(), split.tolist(), strict=True):
                    if wanted and key not in met:
                        met.add(key)
                        words.append(_short(h.h[s:e]))
                    else:
                        words.append(None)
            if len(met) > KNOWN:
                met.clear()
            if found:
                pick, k1, k2, start, n = (np.concatenate(c) for c in zip(*found, strict=True))
                arrays = [pick, k1, k2, b.column(0).take(pa.array(np.concatenate(owner))), np.concatenate(rows), start.astype(np.int32), n.astype(np.int32), pa.array(words, pa.binary())]
                yield pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a) for a in arrays], schema=schema)

    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("binary")).mapInArrow(run, "pick long, k1 long, k2 int, id long, row long, start int, n int, words binary")


def _short(h: np.ndarray) -> bytes:
    """Word hashes cut to 48 bits."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _long(raw: bytes) -> list[int]:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel().tolist()


def _runs(hit: list[bool]) -> list[dict]:
    """[start, n] of the runs of True."""
    at = np.flatnonzero(np.diff(np.r_[0, np.array(hit, np.int8), 0]))
    return [{"start": int(s), "n": int(e - s)} for s, e in zip(at[::2], at[1::2], strict=True)]


def said_before(contents: DataFrame, window: int) -> DataFrame:
    """(k1, k2, again): of each content (pick, k1, k2, at, words), the [start, n] windows that an earlier one of its pick has.

    The contents of a pick are a reference shard: in order of their first places, each is streamed
    through the suffix automaton of those before it, and then joins it.
    """

    def run(batches):
        shard, automaton = None, None
        for b in batches:
            out = []
            for pick, k1, k2, raw in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if automaton is None or pick != shard:
                    shard, automaton = pick, SuffixAutomaton([])
                words = _long(raw)
                again = [n >= window for n in automaton.statistics(words)[window - 1 :]]
                automaton.add(words)
                if any(again):
                    out.append({"k1": k1, "k2": k2, "again": _runs(again)})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    span = pa.list_(pa.struct([("start", pa.int32()), ("n", pa.int32())]))
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("again", span)])
    ordered = contents.repartition("pick").sortWithinPartitions("pick", "at", "k1", "k2")
    return ordered.select("pick", "k1", "k2", "words").mapInArrow(run, f"k1 long, k2 int, again {SPANS}")


def said_before_by_window(contents: DataFrame, window: int) -> DataFrame:
    """What said_before tells, for picks with very many contents: each window is a row, and its first place is aggregated."""

    def run(batches):
        for b in batches:
            for k1, k2, at, raw in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                h = np.array(_long(raw), np.uint64)
                sums = [np.r_[np.uint64(0), np.cumsum(h * up[: len(h)], dtype=np.uint64)] for up, _ in (Hashes.powers(0, len(h)), Hashes.powers(1, len(h)))]
                s = np.arange(len(h) - window + 1)
                w1, w2 = (_mix((x[s + window] - x[s]) * Hashes.powers(k, len(h))[1][s]) for k, x in enumerate(sums))
                n = len(s)
                place = pa.array([at | {"start": at["start"] + i} for i in range(n)], place_type)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k1)), pa.array(np.full(n, k2, np.int32)), pa.array(_signed(w1)), pa.array(_signed(w2)), pa.array(s.astype(np.int32)), place], ["k1", "k2", "w1", "w2", "s", "place"])

    place_type = pa.struct([("id", pa.int64()), ("row", pa.int64()), ("start", pa.int32())])
    rows = cut(contents.select("k1", "k2", "at", "words").mapInArrow(run, f"k1 long, k2 int, w1 long, w2 long, s int, place {PLACE}"))
    first = cut(rows.groupBy("w1", "w2").agg(F.min("place").alias("first"), F.count("*").alias("c")).where("c > 1"))
    again = joined_by_count(rows, first, ["w1", "w2"], "c").where("place > first")
    return again.groupBy("k1", "k2").agg(F.collect_list(F.struct(F.col("s").alias("start"), F.lit(1).alias("n"))).alias("again"))


PLACE, SPANS = "struct<id:long,row:long,start:int>", "array<struct<start:int,n:int>>"


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, shard: int = SHARD_CONTENTS) -> DataFrame:
    """(id, row, spans): for each document with any, the [start, n windows] that occur earlier."""
    counted = picks(docs, text_col, window, gram).groupBy("pick").agg(F.count("*").alias("n"), F.min("unit").alias("lo"), F.max("unit").alias("hi"))
    repeated = cut(counted.where("n > 1").select("pick", (F.col("lo") == F.col("hi")).alias("alike")))
    sizes = repeated.agg(F.count_if("alike").alias("a"), F.count("*").alias("n")).first()
    one = Bloom(repeated.where("alike").select("pick"), sizes["a"])
    many = Bloom(repeated.where("not alike").select("pick"), sizes["n"] - sizes["a"])
    drop_cut(repeated)
    found = cut(places(docs, one, many, id_col, text_col, window, gram))
    place = F.struct("id", "row", "start")
    contents = cut(found.groupBy("pick", "k1", "k2").agg(F.min(place).alias("at"), F.count("*").alias("c"), F.max("words").alias("words")))
    mixed = contents.where("words is not null")
    large = cut(mixed.groupBy("pick").agg(F.count("*").alias("c")).where(F.col("c") > shard))  # few: each has over `shard` contents
    again = said_before(mixed.join(large, "pick", "left_anti"), window)
    if not large.isEmpty():
        again = again.union(said_before_by_window(mixed.join(large.select("pick"), "pick", "left_semi"), window))
    first = cut(contents.select("k1", "k2", "at", "c").join(again, ["k1", "k2"], "left").where("c > 1 or again is not null"))
    drop_cut(contents)
    moved = F.transform("again", lambda x: F.struct((x["start"] + F.col("start")).alias("start"), x["n"].alias("n")))
    told = joined_by_count(found.drop("pick", "words"), first, ["k1", "k2"], "c")
    told = told.withColumn("spans", F.when(place > F.col("at"), F.array(F.struct("start", "n"))).otherwise(moved))
    return told.where("spans is not null").groupBy("id", "row").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def _covered(n_words: int, found: list[dict], window: int) -> np.ndarray:
    gone = np.zeros(n_words + 1, np.int64)
    for s in found:
        gone[s["start"]] += 1
        gone[s["start"] + s["n"] + window - 1] -= 1
    return np.cumsum(gone)[:n_words] > 0


def marked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs plus a last column of spans (null where nothing is to go), under a name that docs does not have."""
    id_, row, told, own = free_names(docs, "id", "row", "spans", "own_row")
    found = spans(docs, id_col, text_col, window, gram).select(F.col("id").alias(id_), F.col("row").alias(row), F.col("spans").alias(told))
    keyed = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
    return keyed.join(found, F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(row)), "left").drop(id_, own, row)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs whose texts lack every word covered by a window that occurs earlier.

    A text that loses words becomes its kept words joined by single spaces; others stay as they are.
    """
    rows = marked(docs, id_col, text_col, window)
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        for b in sliced(batches):
            texts = []
            for x, s in zip(b.column(at).to_pylist(), b.column(len(b.columns) - 1).to_pylist(), strict=True):
                if s:
                    words = x.encode().split()
                    x = b" ".join(w for w, g in zip(words, _covered(len(words), s, window).tolist(), strict=True) if not g).decode()
                texts.append(x)
            columns = b.columns[:-1]
            columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, docs.schema)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""

    def run(batches):
        for b in sliced(batches):
            out = []
            for x, s in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                words = (x.as_py() or b"").split()
                gone = 0
                if s:
                    cover = _covered(len(words), s, window)
                    gone = int(cover.sum())
                    words = [w for w, g in zip(words, cover.tolist(), strict=True) if not g]
                out.append((len(words) + gone, gone, hashlib.sha256(b" ".join(words)).hexdigest()))
            n, removed, sha = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = marked(docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), window=window)
    return rows.select("doc_id", F.col("text").cast("binary"), "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


class SuffixAutomaton:
    """Suffix automaton of word sequences; a sequence never continues into the next one."""

    def __init__(self, texts: list[list[bytes]]):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        for words in texts:
            self.add(words)

    def add(self, words: list) -> None:
        last = 0
        for w in words:
            last = self._add(last, w)

    def _state(self, length: int, moves: dict, link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, p: int, w, q: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _add(self, last: int, w) -> int:
        q = self.next[last].get(w)
        if q is not None:  # read before, in an earlier sequence
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, w, q)
        new, p = self._state(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, w, q)
        return new

    def statistics(self, words: list) -> list[int]:
        """For each word, the length of the longest sequence ending there that some text contains."""
        at, n, out = 0, 0, []
        for w in words:
            while at and w not in self.next[at]:
                at = self.link[at]
                n = self.length[at]
            if w in self.next[at]:
                at, n = self.next[at][w], n + 1
            else:
                n = 0
            out.append(n)
        return out


def remove_known(docs: DataFrame, reference: list[str], text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """docs without their spans of at least `window` words that `reference` contains.

    reference: texts of REFERENCE_WORDS words at most, else an error. They are cut into shards of
    SHARD_WORDS words (overlapping by a window), whose automata are built once and broadcast.
    """
    shards, held, size, total = [], [], 0, 0
    for text in reference:
        words = (text or "").encode().split()
        total += len(words)
        for s in range(0, max(1, len(words)), SHARD_WORDS):
            held.append(words[s : s + SHARD_WORDS + window - 1])
            size += len(held[-1])
            if size >= SHARD_WORDS:
                shards.append(held)
                held, size = [], 0
    if total > REFERENCE_WORDS:
        raise ValueError(f"the reference has {total} words; at most {REFERENCE_WORDS} can be broadcast")
    shards += [held] if held else []
    sent = docs.sparkSession.sparkContext.broadcast([SuffixAutomaton(s) for s in shards])
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches):
        for b in batches:
            texts = []
            for x in b.column(at).to_pylist():
                words = (x or "").encode().split()
                gone = np.zeros(len(words), bool)
                for a in sent.value:
                    for i, n in enumerate(a.statistics(words)):
                        if n >= window:
                            gone[i - n + 1 : i + 1] = True
                texts.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g).decode() if gone.any() else x)
            columns = b.columns
            columns[at] = pa.array(texts, b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))

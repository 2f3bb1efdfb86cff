"""Phrase collocations by SPAM-style position bitmaps, summed over shards.

Texts are dealt, where they lie, into shards of about SHARD_TOKENS word positions of one language; a
piece is never split and an unused position stands between pieces. In a shard each word has a
compressed bitmap of its positions: the eight-position chunks where it occurs, with a mask each. A
phrase is extended by shifting its bitmap (of last words) by one position, which crosses chunks but
never an unused position, and by ANDing it with words' bitmaps; popcounts are its occurrences. The
siblings of a batch of first words are extended together, and a batch goes down to the last length
before the next one starts, so a task holds the bitmaps of one batch.

Counts are sums of popcounts over shards. Only phrases of frequent parts can be frequent, so words
are counted first, then pairs of frequent words, then longer phrases of frequent pairs. Counts
travel in packed and compressed rows by the phrase's hash, and each shard is told which of its own phrases are
frequent; nothing is broadcast, and a phrase has at most one count a shard.

Defined results: null texts are empty, a null language is `und`; words keep everything but blanks,
piece marks and the case of A-Z; repeated rows count each time; an empty table gives an empty
result. The inputs' other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learnspark.llm.common import cut, drop_cut, small_batches, table

#: Word positions in a shard, about; a longer piece makes a longer shard.
SHARD_TOKENS = 1_000_000
#: Chunks of first words whose phrases are extended together.
BATCH_CHUNKS = 100_000
#: Word positions whose phrases one counting group holds, about.
GROUP_TOKENS = 500_000
#: Words of the longest phrase.
LONGEST = 4
UNKNOWN = "und"

#: A-Z in lower case, tabs as spaces, every piece mark as a line end.
_READ = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")

SHARDS = "shard long, lang string, n_words long, words array<string>, length long, tokens binary"
PACKED = "bucket int, lang string, shard long, packed binary, counts binary"
TOLD = "lang string, shard long, packed binary, phrases array<string>, counts array<long>"
_PACKED = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("shard", pa.int64()), ("packed", pa.binary()), ("counts", pa.binary())])
_TOLD = pa.schema([*list(_PACKED)[1:4], ("phrases", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])


def _tokens(texts: pa.Array) -> pa.Array:
    """The words of texts in order, `\\n` between pieces."""
    read = pa.array([t.translate(_READ).replace(b"\n", b" \n ") + b" \n" for t in texts.cast(pa.binary()).to_pylist() if t], pa.large_binary())
    words = pc.split_pattern(read, b" ").flatten()
    return words.filter(pc.greater(pc.binary_length(words), 0))


def _squeezed(ids: np.ndarray) -> bytes:
    """int32 numbers, compressed byte by byte of their places."""
    return pa.compress(np.ascontiguousarray(ids.view(np.uint8).reshape(-1, 4).T).tobytes(), "zstd", asbytes=True)


def _restored(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, 4 * n, "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view(np.int32)[:, 0]


def _packed_lists(phrases: pa.Array, offsets: np.ndarray) -> list[bytes]:
    """Each list of phrases, compressed; no phrase has a line end."""
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), phrases)
    return [zstandard.compress(x, 1) for x in pc.binary_join(lists, "\n").cast(pa.binary()).to_pylist()]


def _unpacked(packed: pa.Array) -> pa.Array:
    """The lists of phrases; an empty list is not packed."""
    return pc.split_pattern(pa.array(map(zstandard.decompress, packed.to_pylist()), pa.binary()).cast(pa.string()), "\n")


def _shard_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Shards of `most` positions or the rest, of longer pieces where there are such; one language each."""
    first, made, held, sizes = TaskContext.get().partitionId() << 32, 0, {}, {}

    def emit(lang: str, last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal made
        flat = pa.concat_arrays(held.pop(lang))
        while len(flat) and (last or len(flat) >= most):
            ends = np.flatnonzero(pc.equal(flat[:most], b"\n").to_numpy(zero_copy_only=False))
            if not len(ends):  # one piece is longer than a shard
                ends = np.flatnonzero(pc.equal(flat, b"\n").to_numpy(zero_copy_only=False))[:1]
            part, flat = flat[: ends[-1] + 1].dictionary_encode(), flat[ends[-1] + 1 :]
            words, ids = part.dictionary.cast(pa.binary()).cast(pa.string()), part.indices.to_numpy()
            gap = ids == pc.index(part.dictionary, pa.scalar(b"\n", pa.large_binary())).as_py()
            ids = np.where(gap, np.int32(-1), ids).astype(np.int32)
            ids = ids[np.append(True, ~(gap[1:] & gap[:-1]))]
            row = [pa.array([first + made], pa.int64()), pa.array([lang]), pa.array([int((ids >= 0).sum())], pa.int64()), pa.ListArray.from_arrays([0, len(words)], words), pa.array([len(ids)], pa.int64()), pa.array([_squeezed(ids)], pa.binary())]
            made += 1
            yield pa.record_batch(row, ["shard", "lang", "n_words", "words", "length", "tokens"])
        held[lang], sizes[lang] = [flat], len(flat)

    for b in batches:
        for lang in b["lang"].unique().to_pylist():
            flat = _tokens(b["text"].filter(pc.equal(b["lang"], lang)))
            held.setdefault(lang, []).append(flat)
            sizes[lang] = sizes.get(lang, 0) + len(flat)
            if sizes[lang] >= most:
                yield from emit(lang, False)
        while sum(sizes.values()) >= 4 * most:  # many languages in one task
            yield from emit(max(sizes, key=sizes.get), True)
    for lang in list(held):
        yield from emit(lang, True)


class Bitmaps:
    """Bitmaps of phrases: `key` has a mask of bits in a chunk; a chunk of a key may come twice, with other bits."""

    def __init__(self, key: np.ndarray, chunk: np.ndarray, mask: np.ndarray) -> None:
        self.key, self.chunk, self.mask = key, chunk, mask

    @staticmethod
    def of_words(tokens: np.ndarray, wanted: np.ndarray) -> Bitmaps:
        """Those of the words that are wanted, in order of word and chunk."""
        at = np.flatnonzero(wanted[tokens] & (tokens >= 0))
        at = at[np.argsort(tokens[at], kind="stable")]
        word, chunk = tokens[at], at >> 3
        if not len(at):
            return Bitmaps(word, chunk, at.astype(np.uint8))
        new = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (chunk[1:] != chunk[:-1])))
        return Bitmaps(word[new], chunk[new], np.bitwise_or.reduceat((1 << (at & 7)).astype(np.uint8), new))

    def shifted(self) -> Bitmaps:
        over = np.flatnonzero(self.mask & 128)
        parts = (self.key, self.key[over]), (self.chunk, self.chunk[over] + 1), ((self.mask << 1) & 255, np.ones(len(over), np.uint8))
        key, chunk, mask = map(np.concatenate, parts)
        some = mask != 0
        return Bitmaps(key[some], chunk[some], mask[some])

    def part(self, start: int, end: int) -> Bitmaps:
        return Bitmaps(self.key[start:end], self.chunk[start:end], self.mask[start:end])


class ByChunk:
    """Words' bitmaps in order of chunk."""

    def __init__(self, words: Bitmaps, chunks: int) -> None:
        order = np.argsort(words.chunk, kind="stable")
        self.word, self.mask = words.key[order], words.mask[order]
        self.start = np.append(0, np.cumsum(np.bincount(words.chunk, minlength=chunks + 1)))

    def extend(self, phrases: Bitmaps, last: np.ndarray, allowed) -> tuple[Bitmaps, np.ndarray, np.ndarray, np.ndarray]:
        """(bitmaps, prefix, word, count) of the phrases one word longer that occur; `last` has each phrase's last word."""
        s = phrases.shifted()
        low = self.start[s.chunk]
        n = self.start[s.chunk + 1] - low
        i = np.repeat(np.arange(len(n)), n)
        j = np.arange(len(i)) + np.repeat(low - np.cumsum(n) + n, n)
        both = s.mask[i] & self.mask[j]
        some = np.flatnonzero(both)
        i, j, both = i[some], j[some], both[some]
        prefix, word = s.key[i], self.word[j]
        if allowed is not None:
            some = allowed(last[prefix], word)
            i, prefix, word, both = i[some], prefix[some], word[some], both[some]
        width = int(self.word.max()) + 1 if len(self.word) else 1
        codes, key = np.unique(prefix.astype(np.int64) * width + word, return_inverse=True)
        count = np.bincount(key, np.bitwise_count(both), len(codes)).astype(np.int64)
        return Bitmaps(key, s.chunk[i], both), codes // width, (codes % width).astype(np.int32), count


def _batches(words: Bitmaps) -> Iterator[Bitmaps]:
    """Parts of whole words, each of about BATCH_CHUNKS chunks."""
    edges = np.flatnonzero(np.append(True, words.key[1:] != words.key[:-1])) if len(words.key) else np.empty(0, int)
    start = 0
    while start < len(words.key):
        after = edges[np.searchsorted(edges, start + BATCH_CHUNKS) :]
        end = after[0] if len(after) else len(words.key)
        yield words.part(start, end)
        start = end


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b


def _halves(pairs: pa.Array) -> list[pa.Array]:
    both = pc.split_pattern(pairs, " ").flatten()
    return [both.take(pa.array(np.arange(k, len(both), 2))) for k in (0, 1)]


def _phrases(tokens: np.ndarray, words: int, heads: np.ndarray, tails: np.ndarray | None = None) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """(words of each phrase, counts): pairs of the words `heads`, or, of pairs (heads, tails), all longer phrases that have no other pairs."""
    pairs = tails is None
    first, second = np.zeros(words + 1, bool), np.zeros(words + 1, bool)
    first[heads] = second[heads if pairs else tails] = True
    allowed = None
    if not pairs:
        told = np.sort(_pair(heads, tails))

        def allowed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = _pair(a, b)
            return told[np.minimum(np.searchsorted(told, key), len(told) - 1)] == key

    chunks = len(tokens) // 8 + 2
    after = ByChunk(Bitmaps.of_words(tokens, second), chunks)
    for batch in _batches(Bitmaps.of_words(tokens, first)):
        phrase, last = [np.arange(words, dtype=np.int32)], np.arange(words, dtype=np.int32)
        for size in range(2, LONGEST + 1):
            batch, prefix, last, count = after.extend(batch, last, allowed)
            if not len(count):
                break
            phrase = [w[prefix] for w in phrase] + [last]
            if pairs or size > 2:
                yield phrase, count
            if pairs:
                break


def _packed(lang: str, shard: int, phrases: pa.Array, counts: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket."""
    order = np.argsort(bucket, kind="stable")
    there, start = np.unique(bucket[order], return_index=True)
    offsets = np.append(start, len(bucket))
    counts = counts[order].astype(np.int32)
    lists = [pa.array(x, pa.binary()) for x in (_packed_lists(phrases.take(pa.array(order)), offsets), [_squeezed(counts[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)])]
    return pa.record_batch([pa.array(there, pa.int32()), pa.array([lang] * len(there), pa.string()), pa.array([shard] * len(there), pa.int64()), *lists], schema=_PACKED)


def _counted(shards: DataFrame, level: int, groups: int) -> DataFrame:
    """Packed counts of each shard's words (level 1), pairs of frequent words (2) or longer phrases (3)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                lang, shard = b["lang"][row].as_py(), b["shard"][row].as_py()
                words, tokens = b["words"][row].values, _restored(b["tokens"][row].as_py(), b["length"][row].as_py())
                hashes = pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False)
                if level == 1:
                    counts = np.bincount(tokens[tokens >= 0], minlength=len(words))
                    some = np.flatnonzero(counts)  # not the gap's own entry
                    yield _packed(lang, shard, words.take(pa.array(some)), counts[some], hashes[some] % groups)
                    continue
                told = _unpacked(b["told"][row].values).flatten()
                told = [pc.index_in(x, words).to_numpy() for x in ([told] if level == 2 else _halves(told))]
                for phrase, counts in _phrases(tokens, len(words), *told):
                    mixed = hashes[phrase[0]]
                    for w in phrase[1:]:
                        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) ^ hashes[w] ^ mixed >> np.uint64(29)
                    texts = pc.binary_join_element_wise(*(words.take(pa.array(w)) for w in phrase), " ")
                    yield _packed(lang, shard, texts, counts, mixed % np.uint64(groups))

    return shards.mapInArrow(count, PACKED)


def _frequent(packed: DataFrame, least: int) -> DataFrame:
    """Rows (lang, phrases, counts) of the phrases counted `least` times or more, and rows (shard, packed) of where they are."""

    def sum_up(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        lists = _unpacked(t["packed"].combine_chunks())
        size, flat = pc.list_value_length(lists).to_numpy(), lists.flatten()
        row = np.repeat(np.arange(len(size)), size)
        counts = np.concatenate([_restored(x, n) for x, n in zip(t["counts"].to_pylist(), size.tolist(), strict=True)])
        langs = t["lang"].combine_chunks().dictionary_encode()
        phrases = flat.dictionary_encode()
        code = langs.indices.to_numpy().astype(np.int64)[row] * len(phrases.dictionary) + phrases.indices.to_numpy()
        codes, key = np.unique(code, return_inverse=True)
        total = np.zeros(len(codes), np.int64)
        np.add.at(total, key, counts)
        some = np.flatnonzero(total[key] >= least)
        out = []
        good = np.flatnonzero(total >= least)
        for k, lang in enumerate(langs.dictionary.to_pylist()):
            own = good[codes[good] // len(phrases.dictionary) == k]
            if len(own):
                out.append((lang, None, None, phrases.dictionary.take(pa.array(codes[own] % len(phrases.dictionary))).to_pylist(), total[own]))
        shard = t["shard"].to_numpy()[row[some]]
        order = np.argsort(shard, kind="stable")
        there, start = np.unique(shard[order], return_index=True)
        packed = _packed_lists(flat.take(pa.array(some[order])), np.append(start, len(some)))
        out += [(None, s, x, None, None) for s, x in zip(there, packed, strict=True)]
        return pa.Table.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(_TOLD)], schema=_TOLD)

    return packed.groupBy("bucket").applyInArrow(sum_up, TOLD)


def shards_of(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", size: int = SHARD_TOKENS) -> DataFrame:
    """(shard, lang, n_words, words, length, tokens): tokens are `length` numbers into words, squeezed, -1 between pieces."""
    ready = docs.select(F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"))
    return ready.mapInArrow(lambda batches: _shard_rows(batches, size), SHARDS)


def phrase_counts(shards: DataFrame, least: int = 30) -> DataFrame:
    """(lang, phrase, size, f) of all phrases of up to LONGEST words counted `least` times or more; shards must be a table."""
    groups = (shards.agg(F.sum("n_words")).first()[0] or 0) // GROUP_TOKENS + 1
    told, found = None, []
    for level in (1, 2, 3):
        rows = shards
        if told is not None:
            own = told.where("shard is not null").groupBy("shard").agg(F.collect_list("packed").alias("told"))
            rows = shards.join(own, "shard")
        told = cut(_frequent(_counted(rows, level, groups), least))
        found.append(told)
    rows = found[0].unionByName(found[1]).unionByName(found[2]).where("counts is not null")
    pairs = rows.select("lang", F.explode(F.arrays_zip("phrases", "counts")).alias("x"))
    return pairs.select("lang", F.col("x.phrases").alias("phrase"), F.size(F.split("x.phrases", " ")).alias("size"), F.col("x.counts").alias("f"))


def _cut_phrases(start: str, stop: str) -> F.Column:
    return F.array_join(F.slice("words", F.expr(start), F.expr(stop)), " ")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score) of each phrase of two words or more at its lowest-scoring cut."""
    words = F.split("phrase", " ")
    cuts = counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a"), words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    parts = cuts.select("lang", "phrase", "a", "k", _cut_phrases("1", "k").alias("head"), _cut_phrases("k + 1", "size - k").alias("tail"))
    both = parts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    both = both.join(counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    score = F.expr("(cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = both.groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("x"))
    return best.select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def covered(counts: DataFrame, percent: int = 80) -> DataFrame:
    """(lang, phrase): phrases that lie in a longer one with at least `percent` of their count."""
    long_ = counts.where("size > 2").select("lang", "size", "f", F.split("phrase", " ").alias("words"))
    sizes = long_.withColumn("n", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    starts = sizes.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1)))
    most = starts.groupBy("lang", _cut_phrases("at", "n").alias("phrase")).agg(F.max("f").alias("longer"))
    hit = most.join(counts, ["lang", "phrase"]).where(F.col("longer").cast("decimal(20,0)") * 100 >= F.col("f").cast("decimal(20,0)") * percent)
    return hit.select("lang", "phrase")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 30, percent: int = 80, top: int = 2000, size: int = SHARD_TOKENS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases by score, count and bytes."""
    small_batches(docs.sparkSession)
    shards = cut(shards_of(docs, text_col, lang_col, size))
    counts = cut(phrase_counts(shards, least))
    n = cut(shards.groupBy("lang").agg(F.sum("n_words").alias("n")))
    drop_cut(shards)
    left = scored(counts).join(covered(counts, percent), ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))

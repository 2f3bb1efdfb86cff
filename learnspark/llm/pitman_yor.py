"""A hierarchical Pitman-Yor language model, trained by Gibbs sampling and used for scoring.

Every training word has a context restaurant of its own, for the words that follow it. All context
restaurants share the root as their parent, which serves words from a uniform base: a table in a
context is a customer in the root. The discount is 1/2 on both levels, where the number of ways to seat c customers of a dish
at t tables has the closed form

    S(c, t) = (2c - t - 1)! / ((t - 1)! (c - t)! 2^(2c - 2t)),

so a Gibbs move takes all customers of a dish from their tables and seats them again by a draw from
P(t) ~ S(c, t) * p^t * prod(k < t) (s + (T + k) / 2), for any c alike (`draw_tables`): p is the parent's
probability of the dish, s the strength and T the tables of the other dishes. That is the exact
conditional of the restaurant given T and p. Three things are approximations, which make the dishes of a
sweep independent tasks: T and p are those of the sweep before, p stays while the dish's tables
enter the parent, and a pair of two rare words keeps one table, as a second one has at most 2p(A + 1/2) times
its weight, for the tiny p of a rare word and A = s + T/2 of a small restaurant. Predictive probabilities are averaged over the sweeps after burn-in. The model's order is two: one
word of context, under one root.

Words are 64-bit hashes, rare ones cut to 47 bits, or to 55 where they are a context. Word counts are gathered
first: they give the counts of the base formula, and the HEAD most frequent words, whose numbers and
totals are all that the driver and broadcasts hold. Pairs of neighbouring words are dealt into
buckets. Behind a frequent word: those of a rare word by the word, so its root counts are in one place; those
of a frequent word by pair, so that no word is a hot bucket, and its root counts are summed up with
the totals. Behind a rare word: by the context, so its totals are in one place and are never
gathered; if the word is rare too, its bucket also learns of the pair, for the root counts. When such a pair is scored,
the context's bucket and the word's each give their factor, which meet where a batch is added up. Texts travel once, as postings (pair, document, count) of batches of documents; each
bucket scores its own postings and the parts of a document are added up.

Defined results: a null or blank text is its end token alone; rows that repeat a doc_id are scored
each for itself; without training documents every word is unknown; an empty table gives an empty
result; other columns are dropped.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnspark.llm.common import arrow_rows, cut, drop_cut, table

#: Frequent words, whose totals are broadcast; restaurants that the other words share if they are not to have their own (no query asks for that).
HEAD, TAIL = 65_280, 256
#: Strengths of the contexts and of the root.
STRENGTH, ROOT_STRENGTH = 2.0, 50.0
DISCOUNT = 0.5
BURN_IN, SAMPLES = 2, 3
#: Training tokens for a bucket, and tokens and documents in a batch of postings.
BUCKET_TOKENS, BATCH_TOKENS, BATCH_DOCS = 4_000_000, 2_000_000, 30_000
#: Words that a worker remembers.
CACHE = 300_000
_LOW, _SHIFT = np.uint64(0xFFFF), np.uint64(16)
_CONTEXTS = HEAD + TAIL
_END = b" end"  # no word holds a space


def squeezed(x: np.ndarray, ascending: bool = False) -> bytes:
    """x in few bytes: differences where ascending, then equal bytes of the numbers together, then zstd."""
    x = np.diff(x, prepend=x.dtype.type(0)) if ascending else x
    return zstandard.compress(np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.itemsize).T.tobytes(), 1)


def restored(raw: bytes, kind, ascending: bool = False) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8)
    x = np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if ascending else x


def word_hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 7)


def words_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").lower().split()  # bytes.lower() changes A-Z only


class Codes:
    """word -> its number or cut hash in the high 48 bits, and in the low 16 the context it makes for the next word."""

    def __init__(self, head: dict[int, int]):
        """head: hash -> number of the words with a restaurant of their own."""
        self.head, self.known = head, {}
        self.end = self._code(_END)

    def _code(self, word: bytes) -> int:
        h = word_hash(word)
        n = self.head.get(h)
        return n << 16 | n if n is not None else (h >> 16 | 1 << 47) << 16 | HEAD + h % TAIL

    def __call__(self, raw: bytes | None) -> np.ndarray:
        """The codes of a text's words between two ends."""
        words, known = words_of(raw), self.known
        try:
            codes = list(map(known.__getitem__, words))
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            known.update((w, self._code(w)) for w in set(words) if w not in known)
            codes = list(map(known.__getitem__, words))
        return np.array([self.end, *codes, self.end], np.uint64)


def paired(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(key, context) of each token: the key has the word's high bits and the low bits of the context, which is the code of the word before."""
    before = np.concatenate([x[:-1] for x in codes])
    return (np.concatenate([x[1:] for x in codes]) & ~_LOW) | (before & _LOW), before


def held_out(id_col: str):
    """Documents that are scored but not learnt from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def draw_tables(customers: np.ndarray, parent: np.ndarray, strength: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A draw of each dish's number of tables from P(t) ~ S(c, t) * p^t * prod(k < t) (A + k / 2), t = 1 to c (0 for no customers).

    p is the parent's probability, A the strength plus half the tables of other dishes. Neighbouring
    terms have the ratio 4 * p * (A + t / 2) * (c - t) / (t * (2c - t - 1)), which falls with t; it
    is 1 at a root of a quadratic. Terms are summed from 12 deviations below the most likely t to as many above.
    """
    tables = np.minimum(customers, 1).astype(np.int32)
    live = np.flatnonzero(customers > 1)
    c, p, a = customers[live].astype(np.float64), parent[live], strength[live]
    b = 2 * c - 1 - 2 * p * (c - 2 * a)
    root = np.sqrt(np.maximum(b * b - 16 * (1 - 2 * p) * p * a * c, 0))
    mode = np.clip(np.floor(8 * p * a * c / (b + root)) + 1, 1, c)
    spread = 1 / (1 / mode - 1 / (2 * a + mode) + 1 / np.maximum(c - mode, 0.5) - 1 / (2 * c - mode))
    half = np.ceil(12 * np.sqrt(np.maximum(spread, 0))) + 12
    low, high = np.maximum(1, mode - half), np.minimum(c, mode + half)
    level = np.frexp(high - low)[1]  # terms by power of two
    for k in np.unique(level).tolist():
        rows, width = np.flatnonzero(level == k), 1 << k
        for part in range(0, len(rows), max(1, (1 << 17) // width)):
            r = rows[part : part + max(1, (1 << 17) // width)]
            t = low[r, None] + np.arange(width - 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.log(4 * p[r, None] * (a[r, None] + t / 2) * (c[r, None] - t) / (t * (2 * c[r, None] - t - 1)))
            step[t >= high[r, None]] = -np.inf
            logs = np.concatenate([np.zeros((len(r), 1)), np.cumsum(step, axis=1)], axis=1)
            total = np.cumsum(np.exp(logs - logs.max(axis=1)[:, None]), axis=1)
            at = (rng.random(len(r)) * total[:, -1])[:, None] >= total
            tables[live[r]] = low[r] + np.minimum(at.sum(axis=1), high[r] - low[r])
    return tables


# word counts


def word_counts(raw: DataFrame) -> DataFrame:
    """(h, n): each word of column `raw`, by its hash, and its number of tokens, ends among them."""

    def run(batches):
        seen = Counter()

        def told():
            h = np.fromiter(map(word_hash, seen), np.uint64, len(seen)).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.fromiter(seen.values(), np.int64, len(seen)))], ["h", "n"])

        for b in batches:
            for x in b.column(0):
                seen.update(words_of(x.as_py()))
            seen[_END] += b.num_rows
            if len(seen) > CACHE:
                yield told()
                seen.clear()
        if seen:
            yield told()

    return raw.select("raw").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def likely(counts: DataFrame, head: int) -> DataFrame:
    """The `head` most frequent words and few others, so that no task sends the driver words that are not among them: the rest of the last count by bins of the hash."""
    level = F.when(F.col("n") < 1024, F.col("n")).otherwise(1024 + F.floor(F.log2(F.col("n") / 1024) * 64)).cast("long")
    bin_ = F.shiftright("h", 52)

    def until(groups: DataFrame, left: int, descending: bool) -> tuple[int | None, int]:
        for key, n in sorted(groups.count().collect(), reverse=descending):
            if n >= left:
                return key, left
            left -= n
        return None, left

    last, left = until(counts.groupBy(level.alias("k")), head, True)
    if last is None:
        return counts
    if last >= 1024:
        return counts.where(level >= last)
    edge, _ = until(counts.where(F.col("n") == last).groupBy(bin_.alias("k")), left, False)
    return counts.where((F.col("n") > last) | (F.col("n") == last) & (bin_ <= edge))


class Words:
    """The most frequent words and the totals of all; of bounded size."""

    def __init__(self, counts: DataFrame, head: int = HEAD, own: bool = False):
        """head: how many words are frequent, HEAD at most; own: whether each of the others has a restaurant of its own, too."""
        self.tokens, self.distinct = (int(x or 0) for x in counts.agg(F.sum("n"), F.count("*")).first())
        self.own = own
        top = likely(counts, head).orderBy(F.col("n").desc(), "h").limit(head).toArrow()
        self.head = {h % (1 << 64): k for k, h in enumerate(top["h"].to_pylist())}
        self.counts = np.zeros(_CONTEXTS, np.int64)
        self.counts[: top.num_rows] = top["n"].to_numpy()
        self.base = 1.0 / (self.distinct + 1)
        self.buckets = max(12, -(-self.tokens // BUCKET_TOKENS))


def _head(keys: np.ndarray) -> np.ndarray:
    return keys >> _SHIFT < np.uint64(_CONTEXTS)


def _buckets(keys: np.ndarray, count: int) -> np.ndarray:
    """Pairs of rare words by the word, pairs of frequent ones by pair."""
    x = np.where(_head(keys), keys, keys >> _SHIFT) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(24)) % np.uint64(count)).astype(np.int64)


def _by_bucket(keys: np.ndarray, count: int):
    """(bucket, rows of sorted keys), each rows' keys still sorted."""
    where = _buckets(keys, count).astype(np.uint16 if count < 1 << 16 else np.int64)
    order = np.argsort(where, kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(where[order].astype(np.int64)) != 0])
    for start, stop in zip(at.tolist(), [*at[1:].tolist(), len(order)], strict=True):
        if stop > start:
            yield int(where[order[start]]), order[start:stop]


def _own(words: Words, before: np.ndarray) -> np.ndarray:
    """Which pairs are behind a rare word that has its own restaurant."""
    return (before & _LOW >= np.uint64(HEAD)) if words.own else np.zeros(len(before), bool)


def _context_buckets(before: np.ndarray, count: int) -> np.ndarray:
    """Buckets of rare contexts, which follow those of words."""
    return ((before >> _SHIFT ^ before << np.uint64(40)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24)) % np.uint64(count) + np.uint64(count)


def _dealt(where: np.ndarray):
    """(bucket, rows), in order."""
    if not len(where):
        return
    order = np.argsort(where, kind="stable")
    at = np.flatnonzero(np.r_[True, np.diff(where[order].astype(np.int64)) != 0])
    for start, stop in zip(at, [*at[1:], len(order)], strict=True):
        yield int(where[order[start]]), order[start:stop]


def _pair_ids(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64 bits for each pair of a rare context and a word."""
    x = before * np.uint64(0x9E3779B97F4A7C15) ^ (word >> _SHIFT) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _distinct(before: np.ndarray, word: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order of context and word, and their counts."""
    order = np.lexsort((word, before))
    before, word = before[order], word[order]
    new = np.flatnonzero(np.r_[True, (before[1:] != before[:-1]) | (word[1:] != word[:-1])]) if len(order) else np.empty(0, np.int64)
    n = np.diff(np.r_[new, len(order)]) if n is None else np.add.reduceat(n[order], new) if len(new) else n
    return before[new], word[new], n.astype(np.int64)


def _rare(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rare words among sorted keys, the places of their pairs, and each pair's word."""
    at = np.flatnonzero(~_head(keys))
    words, own = np.unique(keys[at] >> _SHIFT, return_inverse=True)
    return words, at, own


# the state

#: What does not change: pairs counted once (they have one table), rare words and their counts and pairs counted once.
#: Of rare contexts (buckets from words.buckets on): ids of pairs counted once, contexts and their customers.
FIXED = "bucket long, ones binary, words binary, n binary"
#: What a sweep rewrites: the other pairs, their counts and tables, tables over the samples; of rare words the
#: pairs counted once, root tables, and for each sample 2 * (root customers - root tables / 2). Of rare contexts the same of
#: ids of pairs, each context's pairs counted once, and for each sample its tables.
MOVED = "bucket long, keys binary, counts binary, tables binary, summed binary, single binary, roots binary, mass binary"


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in schema.split(", "))])


def gathered(raw: DataFrame, words: Words) -> DataFrame:
    """The training pairs: a row for each bucket, with the columns of FIXED and MOVED."""
    sent, buckets, sends = raw.sparkSession.sparkContext.broadcast(words), words.buckets, "bucket long, keys binary, n binary, before binary"

    def gather(batches):
        code, held, size = Codes(sent.value.head), [], 0

        def flush():
            keys, before = paired(held)
            held.clear()
            apart = _own(sent.value, before)
            before, word, m = _distinct(before[apart], keys[apart] & ~_LOW)
            keys, n = np.unique(keys[~apart], return_counts=True)
            rows = [(k, squeezed(keys[at], True), squeezed(n[at].astype(np.int32)), None) for k, at in _by_bucket(keys, buckets)] if len(keys) else []
            rare = np.flatnonzero(~_head(word))
            for at, where in ((np.arange(len(word)), _context_buckets(before, buckets)), (rare, _buckets(word[rare], buckets))):
                rows += [(k, squeezed(word[at[i]]), squeezed(m[at[i]].astype(np.int32)), squeezed(before[at[i]], True)) for k, i in _dealt(where)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _arrow(sends), strict=True)], schema=_arrow(sends))

        for b in batches:
            for x in b.column(0):
                held.append(code(x.as_py()))
                size += len(held[-1]) - 1
                if size >= BATCH_TOKENS:
                    size = 0
                    yield from flush()
        if held:
            yield from flush()

    def behind_rare(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        none = [np.zeros(0, np.uint64)]
        return _distinct(*(np.concatenate(none + [restored(r[c], np.uint64, up) for r in rows]) for c, up in (("before", True), ("keys", False))), np.concatenate([np.zeros(0, np.int32)] + [restored(r["n"], np.int32) for r in rows]))

    def merge_contexts(rows: list[dict]) -> pa.Table:
        before, word, total = behind_rare(rows)
        contexts, own = np.unique(before, return_inverse=True)
        number = np.where(_head(word), (word >> _SHIFT).astype(np.int64), -1).astype(np.int32)  # -1: a rare word
        ids, once = _pair_ids(before, word), total == 1
        order = np.argsort(ids)
        ones, rest = order[once[order]], order[~once[order]]
        row = {
            "bucket": rows[0]["bucket"],
            "ones": squeezed(ids[ones], True),
            "words": squeezed(contexts, True),
            "n": squeezed(np.bincount(own, total, len(contexts)).astype(np.int32)),
            "keys": squeezed(ids[rest], True),
            "counts": squeezed(total[rest].astype(np.int32)),
            "tables": squeezed(np.ones(len(rest), np.int32)),
            "summed": squeezed(np.zeros(len(rest), np.int32)),
            "single": squeezed(np.bincount(own, once, len(contexts)).astype(np.int32)),
            "roots": squeezed(np.zeros(0, np.int32)),
            "mass": squeezed(np.zeros(0, np.int32)),
            "index": squeezed(np.r_[own[rest], number[rest]].astype(np.int32)),
            "heads": squeezed(np.sort(number[ones][number[ones] >= 0])),
        }
        return pa.Table.from_pylist([row], schema=whole)

    def merge(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        if rows[0]["bucket"] >= buckets:
            return merge_contexts(rows)
        plain, more = [r for r in rows if r["before"] is None], [r for r in rows if r["before"] is not None]
        keys = np.concatenate([np.zeros(0, np.uint64)] + [restored(r["keys"], np.uint64, True) for r in plain])
        n = np.concatenate([np.zeros(0, np.int32)] + [restored(r["n"], np.int32) for r in plain])
        u, back = np.unique(keys, return_inverse=True)
        total = np.bincount(back, n, len(u)).astype(np.int64)
        _, word, m = behind_rare(more)  # pairs of two rare words, which have a table each
        _, at, _ = _rare(u)
        rare = np.union1d(u[at] >> _SHIFT, word >> _SHIFT)
        own, known = np.searchsorted(rare, u[at] >> _SHIFT), np.searchsorted(rare, word >> _SHIFT)
        once = total == 1
        ones, rest, counts = u[once], u[~once], total[~once].astype(np.int32)
        zero = squeezed(np.zeros(len(rest), np.int32))
        row = {
            "bucket": t["bucket"][0].as_py(),
            "ones": squeezed(ones, True),
            "words": squeezed(rare, True),
            "n": squeezed((np.bincount(own, total[at], len(rare)) + np.bincount(known, m, len(rare))).astype(np.int32)),
            "keys": squeezed(rest, True),
            "counts": squeezed(counts),
            "tables": squeezed(np.ones(len(rest), np.int32)),
            "summed": zero,
            "single": squeezed((np.bincount(own, once[at], len(rare)) + np.bincount(known, minlength=len(rare))).astype(np.int32)),
            "roots": squeezed(np.ones(len(rare), np.int32)),
            "mass": squeezed(np.zeros(0, np.int32)),
            "index": None,
            "heads": None,
        }
        return pa.Table.from_pylist([row], schema=whole)

    schema = FIXED + ", " + MOVED.removeprefix("bucket long, ") + ", index binary, heads binary"
    whole = _arrow(schema)
    return raw.select("raw").mapInArrow(gather, sends).groupBy("bucket").applyInArrow(merge, schema)


def _summed(state: DataFrame, columns: list[str], size: int, count) -> np.ndarray:
    """The sum over buckets of count(row), a vector of `size` numbers."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for r in b.to_pylist():
                total += count(r)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["k", "n"])

    got = state.select(*columns).mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, np.int64)
    out[got["k"].to_numpy()] = got["n"].to_numpy()
    return out


def _add_up(keys: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of n by context, then by frequent word."""
    own = _head(keys)
    return np.r_[np.bincount((keys & _LOW).astype(np.int64), n, _CONTEXTS), np.bincount((keys[own] >> _SHIFT).astype(np.int64), n[own], _CONTEXTS)].astype(np.int64)


class Totals:
    """Customers and tables of each context, and the root's customers and tables of each frequent word, after a sweep."""

    def __init__(self, words: Words, customers: np.ndarray, sums: np.ndarray, rng: np.random.Generator, before: Totals | None = None):
        """sums: tables by context, root customers by frequent word, root tables of rare words."""
        self.base, self.customers = words.base, customers
        self.tables, self.head, rare = sums[:_CONTEXTS], sums[_CONTEXTS : 2 * _CONTEXTS], int(sums[-1])
        self.root_customers = int(self.tables.sum())
        roots = before.head_roots if before else np.minimum(self.head, 1)
        other = ROOT_STRENGTH + DISCOUNT * (roots.sum() + rare - roots)
        self.head_roots = draw_tables(self.head, np.full(len(other), self.base), other, rng)
        self.new_root = ROOT_STRENGTH + DISCOUNT * (int(self.head_roots.sum()) + rare)
        #: Weight of the parent in each context.
        self.back = (STRENGTH + DISCOUNT * self.tables) / (STRENGTH + self.customers)

    def root(self, mass: np.ndarray) -> np.ndarray:
        """Root probability of words by their root customers less half their root tables."""
        return (mass + self.new_root * self.base) / (ROOT_STRENGTH + self.root_customers)

    @property
    def head_mass(self) -> np.ndarray:
        return self.head - DISCOUNT * self.head_roots


def swept_contexts(r: dict, totals: Totals, rng: np.random.Generator, keep: bool) -> dict:
    """The same of a bucket of rare contexts."""
    counts, tables, summed, single = (restored(r[c], np.int32) for c in ("counts", "tables", "summed", "single"))
    context, number = restored(r["index"], np.int32).reshape(2, -1)
    all_tables = single + np.bincount(context, tables, len(single))
    own = np.flatnonzero(number >= 0)
    k, context_, mine = number[own], context[own], tables[own]
    others = totals.head[k] - mine
    parent = totals.root(others - DISCOUNT * np.minimum(totals.head_roots[k], others))
    tables = tables.copy()
    tables[own] = draw_tables(counts[own], parent, STRENGTH + DISCOUNT * (all_tables[context_] - mine), rng)
    out = r | {"tables": squeezed(tables)}
    if keep:
        mass = np.r_[restored(r["mass"], np.int32), single + np.bincount(context, tables, len(single)).astype(np.int32)]
        out |= {"summed": squeezed(summed + tables), "mass": squeezed(mass.astype(np.int32))}
    return out


def swept(r: dict, totals: Totals, rng: np.random.Generator, keep: bool) -> dict:
    """A bucket's row of MOVED after one Gibbs sweep over its pairs and rare words."""
    keys = restored(r["keys"], np.uint64, True)
    counts, tables, summed, single, roots = (restored(r[c], np.int32) for c in ("counts", "tables", "summed", "single", "roots"))
    context, own = (keys & _LOW).astype(np.int64), _head(keys)
    customers, settled = np.empty(len(keys)), np.empty(len(keys))
    k = (keys[own] >> _SHIFT).astype(np.int64)
    customers[own], settled[own] = totals.head[k], totals.head_roots[k]
    words = np.frombuffer(zstandard.decompress(r["index"]), np.int32)  # the rare word of each other pair
    n = single + np.bincount(words, tables[~own], len(single)).astype(np.int32)
    customers[~own], settled[~own] = n[words], roots[words]
    others = customers - tables  # the pair's own tables are taken out of its restaurant and of the root
    parent = totals.root(others - DISCOUNT * np.minimum(settled, others))
    tables = draw_tables(counts, parent, STRENGTH + DISCOUNT * (totals.tables[context] - tables), rng)
    n = single + np.bincount(words, tables[~own], len(single)).astype(np.int32)
    roots = draw_tables(n, np.full(len(n), totals.base), totals.new_root - DISCOUNT * roots, rng)
    out = r | {"tables": squeezed(tables), "roots": squeezed(roots)}
    if keep:
        mass = np.r_[restored(r["mass"], np.int32), 2 * n - roots]
        out |= {"summed": squeezed(summed + tables), "mass": squeezed(mass.astype(np.int32))}
    return out


def train(raw: DataFrame, words: Words, seed: int = 1) -> tuple[DataFrame, DataFrame, list[Totals]]:
    """(FIXED, MOVED, the totals of each kept sample) of the documents in column `raw`."""
    spark, index_schema, buckets = raw.sparkSession, MOVED + ", index binary", words.buckets
    state = cut(gathered(raw, words))
    with arrow_rows(spark, 1):  # a row is a bucket

        def indexed(batches):
            for b in batches:
                for r in b.to_pylist():
                    if r["bucket"] >= buckets:
                        r.pop("words")
                        yield pa.RecordBatch.from_pylist([r], schema=_arrow(index_schema))
                        continue
                    keys, rare = restored(r["keys"], np.uint64, True), restored(r.pop("words"), np.uint64, True)
                    at = np.searchsorted(rare, keys[~_head(keys)] >> _SHIFT).astype(np.int32)
                    yield pa.RecordBatch.from_pylist([r | {"index": zstandard.compress(at.tobytes(), 1)}], schema=_arrow(index_schema))

        moved_columns = [c.split()[0] for c in MOVED.split(", ")]
        moved = cut(state.select(*moved_columns, "words", "index").mapInArrow(indexed, index_schema))
        both = lambda r: (restored(r["ones"], np.uint64, True), restored(r["keys"], np.uint64, True))

        def fixed_sums(r):
            if r["bucket"] >= buckets:  # rare contexts stand together where the totals have the first shared one
                one = np.zeros(3 * _CONTEXTS, np.int64)
                one[HEAD], one[2 * _CONTEXTS + HEAD] = len(restored(r["ones"], np.uint64, True)), restored(r["n"], np.int32).sum(dtype=np.int64)
                one[_CONTEXTS : 2 * _CONTEXTS] = np.bincount(restored(r["heads"], np.int32), minlength=_CONTEXTS)
                return one
            ones, keys = both(r)
            one = _add_up(ones, np.ones(len(ones)))
            return np.r_[one, one[:_CONTEXTS] + _add_up(keys, restored(r["counts"], np.int32))[:_CONTEXTS]]

        fixed = _summed(state, ["bucket", "ones", "keys", "counts", "n", "heads"], 3 * _CONTEXTS, fixed_sums)
        once, customers = np.r_[fixed[: 2 * _CONTEXTS], 0], fixed[2 * _CONTEXTS :]

        def moving(r):
            if r["bucket"] >= buckets:
                tables, (_, number) = restored(r["tables"], np.int32), restored(r["index"], np.int32).reshape(2, -1)
                out = np.zeros(2 * _CONTEXTS + 1, np.int64)
                out[HEAD], out[_CONTEXTS : 2 * _CONTEXTS] = tables.sum(dtype=np.int64), np.bincount(number[number >= 0], tables[number >= 0], _CONTEXTS)
                return out
            return np.r_[_add_up(restored(r["keys"], np.uint64, True), restored(r["tables"], np.int32)), restored(r["roots"], np.int32).sum(dtype=np.int64)]

        def totals_of(df, number, before=None):
            sums = once + _summed(df, ["bucket", "keys", "tables", "roots", "index"], 2 * _CONTEXTS + 1, moving)
            return Totals(words, customers, sums, np.random.default_rng([seed, number]), before)

        totals, kept = totals_of(moved, 0), []
        for number in range(1, BURN_IN + SAMPLES + 1):
            keep, sent = number > BURN_IN, spark.sparkContext.broadcast(totals)

            def run(batches, sent=sent, keep=keep, number=number):
                for b in batches:
                    for r in b.to_pylist():
                        rng = np.random.default_rng([seed, number, r["bucket"]])
                        move = swept_contexts if r["bucket"] >= buckets else swept
                        yield pa.RecordBatch.from_pylist([move(r, sent.value, rng, keep)], schema=_arrow(index_schema))

            new = cut(moved.mapInArrow(run, index_schema))
            drop_cut(moved)
            sent.destroy()
            moved, totals = new, totals_of(new, number, totals)
            kept += [totals] if keep else []
    return state.select("bucket", "ones", "words", "n"), moved.select(*moved_columns), kept


# scoring

#: Postings: distinct pairs of a batch in a bucket, documents by pair, those documents and the pair's counts in them (kind 2);
#: the same of pairs behind rare words, with their contexts (3); rare words behind rare words (4).
POSTED = "bucket long, part long, kind int, batch long, ids array<long>, a binary, b binary, c binary, d binary, e binary"
#: Training tokens of a bucket from which on its postings are dealt into parts, each with the bucket's model.
PART_TOKENS = 8 * BUCKET_TOKENS


def parts_of(moved: DataFrame) -> DataFrame:
    """(bucket, parts): the number of parts of the buckets whose pairs, a few very frequent ones, have more tokens than PART_TOKENS; fewer than tokens / PART_TOKENS."""

    def run(batches):
        for b in batches:
            n = [int(restored(x.as_py(), np.int32).sum(dtype=np.int64)) for x in b["counts"]]
            yield pa.RecordBatch.from_arrays([b["bucket"], pa.array(n, pa.int64())], ["bucket", "n"])

    tokens = moved.select("bucket", "counts").mapInArrow(run, "bucket long, n long").where(F.col("n") > PART_TOKENS)
    return cut(tokens.select("bucket", F.ceil(F.col("n") / PART_TOKENS).cast("long").alias("parts")))


def _postings(docs: DataFrame, words: Words, parts: dict[int, int]) -> DataFrame:
    """POSTED of documents (doc_id, raw); one bucket of a batch, another one each time, carries the batch's ids."""
    context = docs.sparkSession.sparkContext
    sent, buckets, kinds, parts = context.broadcast(words), words.buckets, _arrow(POSTED), context.broadcast(parts)

    def run(batches):
        code, number = Codes(sent.value.head), TaskContext.get().partitionId() << 32
        ids, tokens, size = [], [], 0

        def flush():
            key, before = paired(tokens)
            doc = np.repeat(np.arange(len(tokens)), [len(x) - 1 for x in tokens])
            mixed = number * 0x9E3779B97F4A7C15 % (1 << 64) >> 20
            apart = _own(sent.value, before)
            rows = []

            def posted(kind, where, key, doc, before=None):
                new = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1]) | (False if before is None else before[1:] != before[:-1])])
                n = np.diff(np.r_[new, len(key)]).astype(np.int32)
                key, doc, before = key[new], doc[new].astype(np.uint16), None if before is None else before[new]
                for k, at in _dealt(where(key, before)):
                    own = key[at]
                    first = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (False if before is None else before[at][1:] != before[at][:-1])])
                    sizes = np.diff(np.r_[first, len(own)]).astype(np.uint16)
                    rows.append([k, mixed % parts.value.get(k, 1), kind, number, None, squeezed(own[first], before is None), squeezed(sizes), squeezed(doc[at]), squeezed(n[at]), None if before is None else squeezed(before[at][first], True)])

            if not apart.all():
                own = key[~apart]
                order = np.argsort(own, kind="stable")  # documents stay in order within a key
                posted(2, lambda key, _: _buckets(key, buckets).astype(np.uint16 if buckets < 1 << 16 else np.int64), own[order], doc[~apart][order])
            if apart.any():
                own = key[apart] & ~_LOW
                order = np.lexsort((own, before[apart]))
                posted(3, lambda _, before: _context_buckets(before, buckets), own[order], doc[apart][order], before[apart][order])
                rare = np.unique(own[~_head(own)])
                rows.extend([k, mixed % parts.value.get(k, 1), 4, number, None, squeezed(rare[at], True), None, None, None, None] for k, at in _dealt(_buckets(rare, buckets)))
            rows[mixed % len(rows)][4] = list(ids)
            ids.clear()
            tokens.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), kinds, strict=True)], schema=kinds)

        for b in batches:
            for i, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                tokens.append(code(x.as_py()))
                size += len(tokens[-1]) - 1
                if size >= BATCH_TOKENS or len(ids) >= BATCH_DOCS:
                    yield flush()
                    number, size = number + 1, 0
        if ids:
            yield flush()

    return docs.select("doc_id", "raw").mapInArrow(run, POSTED)


class Model:
    """A bucket's part of the model, from its rows of FIXED and MOVED (either may be missing)."""

    def __init__(self, ones, words, n, keys, counts, summed, mass, kept: list[Totals], head: Words):
        self.ones, self.words, self.n, self.keys = ones, words, n, keys
        self.own = counts - DISCOUNT * summed / len(kept)
        self.kept, self.head = kept, head
        mass = mass.reshape(len(kept), -1) / 2 if len(words) else np.zeros((len(kept), 0))
        self.roots = np.stack([t.root(m) for t, m in zip(kept, mass, strict=True)])
        self.head_roots = np.stack([t.root(t.head_mass) for t in kept])
        self.unseen = np.array([t.root(0.0) for t in kept])

    @staticmethod
    def _found(sorted_: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where x is among sorted_, and its place there."""
        if not len(sorted_):
            return np.zeros(len(x), bool), np.zeros(len(x), np.int64)
        at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
        return sorted_[at] == x, at

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(training count of the word, mean predictive probability) of pairs."""
        context = (keys & _LOW).astype(np.int64)
        count, root = self.parents(keys)
        direct = np.zeros(len(keys))
        hit, at = self._found(self.ones, keys)
        direct[hit] = 1 - DISCOUNT
        hit, at = self._found(self.keys, keys)
        direct[hit] = self.own[at[hit]]
        direct /= STRENGTH + self.kept[0].customers[context]
        return count, direct + np.mean([t.back[context] * p for t, p in zip(self.kept, root, strict=True)], axis=0)

    def parents(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(training count of the word, root probability in each sample) of pairs."""
        head, part = _head(keys), keys >> _SHIFT
        count, root = np.zeros(len(keys), np.int64), np.tile(self.unseen[:, None], len(keys))
        k = part[head].astype(np.int64)
        count[head], root[:, head] = self.head.counts[k], self.head_roots[:, k]
        hit, at = self._found(self.words, part)
        hit &= ~head
        count[hit], root[:, hit] = self.n[at[hit]], self.roots[:, at[hit]]
        return count, root


class Contexts(Model):
    """A bucket of rare contexts."""

    def __init__(self, ones, words, n, keys, counts, summed, mass, kept: list[Totals], head: Words):
        self.ones, self.contexts, self.n, self.keys = ones, words, n, keys
        self.own, self.head = counts - DISCOUNT * summed / len(kept), head
        self.tables = mass.reshape(len(kept), -1) if len(words) else np.zeros((len(kept), 0))
        self.head_roots = np.stack([t.root(t.head_mass) for t in kept])

    def __call__(self, before: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(part of the probability from the restaurant itself, weight of the parent in each sample) of pairs."""
        customers, tables = np.zeros(len(words)), np.zeros((len(self.tables), len(words)))
        hit, at = self._found(self.contexts, before)
        customers[hit], tables[:, hit] = self.n[at[hit]], self.tables[:, at[hit]]
        ids, direct = _pair_ids(before, words), np.zeros(len(words))
        hit, at = self._found(self.ones, ids)
        direct[hit] = 1 - DISCOUNT
        hit, at = self._found(self.keys, ids)
        direct[hit] = self.own[at[hit]]
        return direct / (STRENGTH + customers), (STRENGTH + DISCOUNT * tables) / (STRENGTH + customers)


#: Sums of a batch's documents in a bucket (kind 0). For pairs of two rare words: the word's count and root probabilities (1), and the
#: context's factors of each pair and document (2).
PARTS = "batch long, bucket long, kind int, ids array<long>, doc binary, n binary, known binary, base binary, score binary"


def score(docs: DataFrame, fixed: DataFrame, moved: DataFrame, kept: list[Totals], words: Words) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of every row of docs (doc_id, raw)."""
    norm, samples, words_buckets = words.tokens + words.distinct + 1, len(kept), words.buckets
    sent = docs.sparkSession.sparkContext.broadcast((kept, words))
    none = lambda kind: F.lit(None).cast(kind)

    dealt = parts_of(moved)

    def typed(df, kind, *columns):
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
        return df.join(dealt, "bucket", "left").select("bucket", part, F.lit(kind).alias("kind"), none("long").alias("batch"), none("array<long>").alias("ids"), *[F.col(c).alias(x) for x, c in zip("abcd", columns, strict=True)], none("binary").alias("e"))

    def one(t: pa.Table) -> pa.Table:
        said = {}
        kind = t["kind"].to_pylist()
        for i in (i for i, k in enumerate(kind) if k < 2):
            said[kind[i]] = t.slice(i, 1).to_pylist()[0]
        empty = squeezed(np.zeros(0, np.int8))
        f, m = said.get(0, dict.fromkeys("abc", empty)), said.get(1, dict.fromkeys("abcd", empty))
        made = Model if t["bucket"][0].as_py() < words_buckets else Contexts
        model = made(restored(f["a"], np.uint64, True), restored(f["b"], np.uint64, True), restored(f["c"], np.int32), restored(m["a"], np.uint64, True), *(restored(m[c], np.int32) for c in "bcd"), *sent.value)
        out = []

        def sums(p, doc, n, each, count, probability):
            log_p, log_base = np.log10(probability), np.log10((count + 1) / norm)
            present, local = np.unique(doc, return_inverse=True)
            found = [np.bincount(local, x, len(present)) for x in (n, n * (count[each] > 0), n * log_base[each], n * log_p[each])]
            out.append((p["batch"], p["bucket"], 0, p["ids"], squeezed(present), *(squeezed(x.astype(np.int32)) for x in found[:2]), *(x.tobytes() for x in found[2:])))

        for i in (i for i, k in enumerate(kind) if k >= 2):
            p = t.slice(i, 1).to_pylist()[0]
            keys = restored(p["a"], np.uint64, p["kind"] != 3)
            if p["kind"] == 4:
                count, roots = model.parents(keys)
                out.append((p["batch"], p["bucket"], 1, p["ids"], p["a"], squeezed(count), None, None, roots.tobytes()))
                continue
            sizes, doc, n = restored(p["b"], np.uint16), restored(p["c"], np.uint16), restored(p["d"], np.int32)
            each = np.repeat(np.arange(len(keys)), sizes)
            if p["kind"] == 2:
                sums(p, doc, n, each, *model(keys))
                continue
            direct, back = model(restored(p["e"], np.uint64, True), keys)
            head = _head(keys)
            k, on = (keys[head] >> _SHIFT).astype(np.int64), head[each]
            sums(p, doc[on], n[on], (np.cumsum(head) - 1)[each[on]], model.head.counts[k], direct[head] + (back[:, head] * model.head_roots[:, k]).mean(axis=0))
            if not on.all():
                of = each[~on]
                out.append((p["batch"], p["bucket"], 2, None, squeezed(doc[~on]), squeezed(n[~on]), squeezed(keys[of]), direct[of].tobytes(), back[:, of].tobytes()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), parts, strict=True)], schema=parts) if out else parts.empty_table()

    def combined(t: pa.Table) -> pa.Table:
        rows = sorted(t.to_pylist(), key=lambda r: (r["bucket"], r["kind"]))
        ids = next(r["ids"] for r in rows if r["ids"] is not None)
        total = np.zeros((4, len(ids)))
        for r in (r for r in rows if r["kind"] == 0):
            at = restored(r["doc"], np.uint16)
            for k, x in enumerate((restored(r["n"], np.int32), restored(r["known"], np.int32), np.frombuffer(r["base"]), np.frombuffer(r["score"]))):
                total[k, at] += x
        told = [r for r in rows if r["kind"] == 1]
        if told:
            found = np.concatenate([restored(r["doc"], np.uint64, True) for r in told])
            order = np.argsort(found)
            found, counts = found[order], np.concatenate([restored(r["n"], np.int64) for r in told])[order]
            roots = np.concatenate([np.frombuffer(r["score"]).reshape(samples, -1) for r in told], axis=1)[:, order]
        for r in (r for r in rows if r["kind"] == 2):
            doc, n, at = restored(r["doc"], np.uint16), restored(r["n"], np.int32), np.searchsorted(found, restored(r["known"], np.uint64))
            p = np.frombuffer(r["base"]) + (np.frombuffer(r["score"]).reshape(samples, -1) * roots[:, at]).mean(axis=0)
            for k, x in enumerate((n, n * (counts[at] > 0), n * np.log10((counts[at] + 1) / norm), n * np.log10(p))):
                total[k] += np.bincount(doc, x, len(ids))
        return pa.table([pa.array(ids, pa.int64()), *(pa.array(x.astype(np.int64)) for x in total[:2]), *map(pa.array, total[2:])], schema=answer)

    parts = _arrow(PARTS)
    answer = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    model = typed(fixed.withColumn("none", none("binary")), 0, "ones", "words", "n", "none").union(typed(moved, 1, "keys", "counts", "summed", "mass"))
    scored_ = model.union(_postings(docs, words, {r.bucket: r.parts for r in dealt.collect()})).groupBy("bucket", "part").applyInArrow(one, PARTS)
    return scored_.groupBy("batch").applyInArrow(combined, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), learnt from the documents not held out."""
    ready = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw"))
    learnt = ready.where(~held_out("doc_id")).select("raw")
    counts = cut(word_counts(learnt))
    words = Words(counts, head, own=True)
    drop_cut(counts)
    fixed, moved, kept = train(learnt, words, seed)
    found = score(ready, fixed, moved, kept, words)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "n_tokens", "n_known", F.lit(words.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(scores: DataFrame) -> DataFrame:
    """(held_out, perplexity, base_perplexity) per token."""
    of = lambda c: F.pow(F.lit(10.0), -F.sum(c) / F.sum("n_tokens"))
    return scores.groupBy("held_out").agg(of("score").alias("perplexity"), of("base_score").alias("base_perplexity"))


def op7_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))

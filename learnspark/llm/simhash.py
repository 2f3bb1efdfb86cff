"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64 majority bits over the XXH64 values (seed 42) of word shingles. To find all
pairs within `radius` differing bits, the 64 positions are divided into partitions of correlated
bits. If partition i gets threshold t_i and the (t_i + 1) add up to radius + 1, two fingerprints
within the radius agree in some partition up to its threshold. Every fingerprint picks its own
thresholds by dynamic programming over estimated candidate counts, probes the variants of its own
parts, and every hit is verified on all 64 bits.

`keep_one` drops near-duplicates by similarity: texts whose sets of five-word shingles have a Jaccard
similarity of SIMILARITY or more. One fingerprint within a few bits misses many such pairs, so each
text has PRINTS independent ones, and a pair is a candidate where any of them is within KEEP_RADIUS;
candidates are then compared by their whole sets. That is done in two passes. First each text meets
the first text that shares a part of a fingerprint with it, which joins groups of copies at the cost of one
comparison a text. Then the probes look only for texts of other groups, so a ball of copies makes no
pairs within itself. Many texts edited from one may be near in bits but less similar: so the probes tell
only which texts have such a partner, and these meet by the rarest hashes of their sets, at least one of
which any similar two share there. README has the recall by similarity.

Defined results: a null or blank text has fingerprint zero, which links like any other; for keep_one
such texts are alike. Rows that repeat a doc_id share its group in `components`; keep_one judges each
distinct text for itself and keeps one row of equal (id, text). A null doc_id is smaller than others
there and never names a component in `components`, but carries links. An empty table gives an empty
result; other columns, whatever their names, pass through keep_one and are not read elsewhere.
"""

from __future__ import annotations

import math
import zlib
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learnspark.llm.common import components_of_few, connected_components, cut, drop_cut, free_names, table

RADIUS = 3
SHINGLE = 3
#: Width in bits of the blocks whose exact histograms feed the estimates: 2^11 counts each at most.
BLOCK = 11
#: Variants of a part that a probe enumerates at most.
MAX_KEYS = 2500
#: For keep_one: words in a shingle, least similarity, fingerprints of a text and their radius.
KEEP_SHINGLE, SIMILARITY, PRINTS, KEEP_RADIUS = 5, 0.8, 4, 9
#: What a probe that travels costs, in comparisons of two fingerprints in a bucket.
TRAVEL = 50
#: Probes that one bucket of them holds, about, and fingerprints whose probes leave a task together.
BUCKET_PROBES, TOGETHER = 500_000, 50_000
#: Rows of other groups under one key beyond which a probe of `far_texts` takes all of them uncompared.
LONG_RUN = 20_000
#: Rounds in which each text meets only the nearest one that shares a prefix hash.
NEAREST_ROUNDS = 2
#: Pairs a text, on average, that `compared` takes all at once.
AT_ONCE = 4
#: Slots in which `prefix_meetings` counts hashes, as a power of two, those of them that travel together, and prefix rows of a bucket, about.
SLOT_BITS, SLOT_RANGE, BUCKET_ROWS = 20, 14, 100_000
#: A row of a prefix: a hash, its text, the largest set that this hash can be the first common one with, and all that tells a pair apart.
PREFIX_ROW = np.dtype([("h", "<u8"), ("node", "<i8"), ("group", "<i8"), ("size", "<i4"), ("most", "<i4"), ("fps", "<i8", (PRINTS,))])


def shingle_hashes(raw: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of the words, A-Z in lower case; of all words where they are fewer."""
    words = raw.lower().split() if raw else []  # bytes.lower() changes A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))) or [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, len(grams))


def majority(h: np.ndarray) -> int:
    """The 64 bits that over half the hashes have, as a signed number; zero without hashes."""
    ones = np.zeros(64, np.int64)
    for start in range(0, len(h), 255 * 256):  # sums of up to 255 bits fit a byte
        bits = np.unpackbits(h[start : start + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        if whole:
            ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(raw, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the signed 64-bit fingerprint of each row."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("raw")).mapInArrow(run, "doc_id long, fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps, np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _summed(fps: DataFrame, count, size: int) -> np.ndarray:
    """The sum of count(bits of a batch), a vector of `size` numbers whatever the input."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            total += count(_bits(b["fp"].to_numpy()))
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"k": hit, "n": total[hit]})

    out = np.zeros(size, np.int64)
    for k, n in fps.select("fp").mapInPandas(run, "k int, n long").groupBy("k").sum("n").collect():
        out[k] = n
    return out


def correlated_partitions(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """m groups of bit positions; each grows from the strongest free pair by the most correlated bit."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    r = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(r, 0)
    free, groups = set(range(64)), []
    for i in range(m):
        width = 64 // m + (i < 64 % m)
        left = sorted(free)
        at = np.unravel_index(np.argmax(r[np.ix_(left, left)]), (len(left), len(left)))
        group = list(dict.fromkeys(left[x] for x in at))[:width]
        while len(group) < width:
            rest = sorted(free - set(group))
            group.append(rest[int(np.argmax(r[np.ix_(group, rest)].sum(axis=0)))])
        free -= set(group)
        groups.append(group)
    return groups


def partition_count(n: int, radius: int, travel: float = 1.0) -> int:
    """The number of partitions with the least work for each of n fingerprints: keys probed, at `travel` each, plus chance hits.

    With m partitions of 64/m bits, equal thresholds and even bits, a fingerprint probes some keys
    and each key meets n / 2^(64/m) others. Few partitions keep the buckets small, many need few keys.
    """

    def work(m: int) -> float:
        each, more = divmod(radius + 1, m)
        keys = [_keys(64 // m, each - 1 + (i < more)) for i in range(m)]
        return sum(keys) * (travel + n / 2.0 ** (64 / m)) if max(keys) <= MAX_KEYS else math.inf

    counts = range(2, max(2, radius + 1) + 1)
    return min(counts, key=work)  # one bit a partition and threshold 0 is always among them


def _keys(width: int, t: int) -> int:
    return sum(len(list(combinations(range(width), k))) for k in range(t + 1)) if t >= 0 else 0


def _compact(bits: np.ndarray, group: list[int]) -> np.ndarray:
    return bits[:, group].astype(np.int64) @ (1 << np.arange(len(group), dtype=np.int64))


class Plan:
    """Partitions, their variant masks and the block histograms; a few hundred KB at any input size."""

    def __init__(self, fps: DataFrame, n: int, radius: int, travel: float = 1.0):
        self.radius, self.n = radius, n
        both = _summed(fps, lambda b: (b.T.astype(np.float64) @ b.astype(np.float64)).astype(np.int64).ravel(), 4096).reshape(64, 64)
        self.groups = correlated_partitions(both, n, partition_count(n, radius, travel))
        self.blocks = [[g[i : i + BLOCK] for i in range(0, len(g), BLOCK)] for g in self.groups]
        flat = [b for bs in self.blocks for b in bs]
        counted = _summed(fps, lambda bits: np.concatenate([np.bincount(_compact(bits, b), minlength=1 << BLOCK) for b in flat]), len(flat) << BLOCK)
        near = iter([self._near(counted[i << BLOCK : (i + 1) << BLOCK], len(b)) for i, b in enumerate(flat)])
        self.near = [[next(near) for _ in bs] for bs in self.blocks]
        self.masks = []
        for g in self.groups:
            rings, t = [], 0
            while t <= radius and (t < 2 or _keys(len(g), t) <= MAX_KEYS):
                rings.append(np.array([sum(1 << i for i in c) for c in combinations(range(len(g)), t)], np.int64))
                t += 1
            self.masks.append(rings)

    def _near(self, counts: np.ndarray, width: int) -> np.ndarray:
        """[e, value]: share of fingerprints at distance exactly e from value in this block."""
        out, values = np.zeros((self.radius + 1, 1 << BLOCK)), np.arange(1 << width)
        for e in range(self.radius + 1):
            for c in combinations(range(width), e):
                out[e, values] += counts[values ^ sum(1 << i for i in c)]
        return out / max(self.n, 1)

    def thresholds(self, bits: np.ndarray) -> np.ndarray:
        """[row, partition]: thresholds from -1 up whose (t + 1) add up to radius + 1 at least estimated cost."""
        rows, budget = len(bits), self.radius + 1
        best = np.full((rows, budget + 1), np.inf)
        best[:, 0] = 0
        took = []
        for g, blocks, near, rings in zip(self.groups, self.blocks, self.near, self.masks, strict=True):
            at = np.zeros((rows, self.radius + 1))
            at[:, 0] = 1
            for b, table_ in zip(blocks, near, strict=True):
                share = table_[:, _compact(bits, b)].T
                at = np.stack([sum(at[:, i] * share[:, e - i] for i in range(e + 1)) for e in range(self.radius + 1)], axis=1)
            cost = np.full((rows, budget + 1), np.inf)
            cost[:, 0] = 0
            for t in range(len(rings)):
                cost[:, t + 1] = self.n * at[:, : t + 1].sum(axis=1) + sum(map(len, rings[: t + 1]))
            options = np.stack([np.stack([best[:, s - k] + cost[:, k] if k <= s else np.full(rows, np.inf) for k in range(budget + 1)]) for s in range(budget + 1)])
            took.append(options.argmin(axis=1))
            best = options.min(axis=1).T
        out, left = np.empty((rows, len(self.groups)), np.int64), np.full(rows, budget)
        for i in reversed(range(len(self.groups))):
            k = took[i][left, np.arange(rows)]
            out[:, i], left = k - 1, left - k
        if left.any():
            raise ValueError(f"no thresholds of these partitions reach radius {self.radius}")
        return out


def near_pairs(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): nodes a < b of (fp, node) whose fingerprints differ in at most `radius` bits, each pair once."""
    nodes = cut(nodes.select("fp", "node"))
    fps = cut(nodes.select("fp").distinct())  # probes carry no more than the fingerprint
    plan = Plan(fps, fps.count(), radius)

    def keys(i: int, values: np.ndarray) -> np.ndarray:
        return values | (np.int64(i) << np.int64(58))  # parts have 32 bits at most

    def stored(batches):
        for b in batches:
            bits = _bits(b["fp"].to_numpy())
            for i, g in enumerate(plan.groups):
                yield pd.DataFrame({"key": keys(i, _compact(bits, g)), "fp": b["fp"]})

    def probes(batches):
        for b in batches:
            fp = b["fp"].to_numpy()
            for s in range(0, len(fp), 4096):
                bits = _bits(fp[s : s + 4096])
                t = plan.thresholds(bits)
                for i, g in enumerate(plan.groups):
                    own = _compact(bits, g)
                    for e, masks in enumerate(plan.masks[i]):
                        rows = np.flatnonzero(t[:, i] >= e)
                        if len(rows):
                            yield pd.DataFrame({"key": keys(i, (own[rows, None] ^ masks).ravel()), "pfp": np.repeat(fp[s + rows], len(masks))})

    data = fps.mapInPandas(stored, "key long, fp long")
    asked = fps.mapInPandas(probes, "key long, pfp long")
    hits = asked.join(data, (asked.key == data.key) & (asked.pfp < data.fp) & (F.bit_count(asked.pfp.bitwiseXOR(data.fp)) <= radius)).select("pfp", data.fp.alias("fp")).distinct()
    one, two = (nodes.select(F.col("fp").alias(f"f{c}"), F.col("node").alias(c)) for c in "xy")
    near = hits.join(one, F.col("pfp") == F.col("fx")).join(two, F.col("fp") == F.col("fy")).select("x", "y")
    same = one.join(two, F.col("fx") == F.col("fy")).where("x < y").select("x", "y")
    return near.union(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of up to `radius` bits."""
    fps = cut(fingerprints(docs, id_col, text_col, shingle))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    labels = connected_components(near_pairs(classes.select("fp", F.col("fp").alias("node")), radius))
    joined = cut(classes.join(labels, classes.fp == labels.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("c")))
    least = joined.groupBy("c").agg(F.min("rep").alias("component_id"))
    named = joined.join(least, "c").select("fp", "component_id")
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The hashes of another independent kind, k above 0."""
    x = h + np.uint64((k * 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prints(texts: DataFrame) -> DataFrame:
    """(node, n, fps): of texts (node, raw) the number of distinct shingles and PRINTS fingerprints of the text."""

    def run(batches):
        for b in batches:
            n, fps = [], []
            for x in b.column(1):
                h = np.unique(shingle_hashes(x.as_py(), KEEP_SHINGLE))
                n.append(len(h))
                fps.append([majority(_mixed(h, k) if k else h) for k in range(PRINTS)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(fps, pa.list_(pa.int64()))], ["node", "n", "fps"])

    return texts.mapInArrow(run, "node long, n int, fps array<long>")


def sets(texts: DataFrame) -> DataFrame:
    """(node, hashes): of texts (node, raw) the sorted hashes of the distinct shingles."""

    def run(batches):
        for b in batches:
            rows = [np.unique(shingle_hashes(x.as_py(), KEEP_SHINGLE)).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], ["node", "hashes"])

    return texts.mapInArrow(run, "node long, hashes binary")


def similar(pairs: DataFrame, hashes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of SIMILARITY or more."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                common = len(x) + len(y) - len(np.union1d(x, y))
                keep.append(common >= SIMILARITY * (len(x) + len(y) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (hashes.select(F.col("node").alias(c), F.col("hashes").alias(f"h{c}")) for c in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ha", "hb").mapInArrow(run, "a long, b long")


def _part_keys(plan: Plan, bits: np.ndarray, i: int) -> np.ndarray:
    return _compact(bits, plan.groups[i]) | (np.int64(i) << np.int64(58))  # parts have 32 bits at most


def first_meetings(nodes: DataFrame, *plans: Plan) -> DataFrame:
    """(a, b): each node b of (fp, node) with the smallest node a that shares a part of the fingerprint, where they are within the radius.

    With several plans of (fps, node), the same of each of the fingerprints by its own plan, each pair once.
    """
    fps = F.array("fp") if "fp" in nodes.columns else F.col("fps")

    def stored(batches):
        for b in batches:
            for k, fp in enumerate(np.stack(b["fps"].to_list()).T if len(b) else []):
                bits = _bits(fp)
                for i in range(len(plans[k].groups)):
                    yield pd.DataFrame({"key": _part_keys(plans[k], bits, i) | (np.int64(k) << np.int64(54)), "fp": fp, "node": b["node"]})

    rows = nodes.select(fps.alias("fps"), "node").mapInPandas(stored, "key long, fp long, node long")
    first = rows.groupBy("key").agg(F.min(F.struct("node", "fp")).alias("x"), F.count("*").alias("n")).where("n > 1")
    met = rows.join(first.select("key", F.col("x.node").alias("a"), F.col("x.fp").alias("afp")), "key")
    return met.where((F.col("a") < F.col("node")) & (F.bit_count(F.col("afp").bitwiseXOR(F.col("fp"))) <= plans[0].radius)).select("a", F.col("node").alias("b")).distinct()


def _kinds(nodes: DataFrame) -> DataFrame:
    """Nodes (fp, node, group) as of kind 0; of (fps, node, group) a row for each fingerprint, its kind the place."""
    fps = F.array("fp") if "fp" in nodes.columns else F.col("fps")
    return nodes.select(F.posexplode(fps).alias("kind", "fp"), "node", "group")


def _by_fingerprint(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of nodes (kind, fp, node, group): what groups a fingerprint has, and (kind, fp, group), the group that all its nodes are of, 0 where there is none."""
    own = nodes.groupBy("kind", "fp").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("n"), F.count("group").alias("grouped"))
    return own, cut(own.select("kind", "fp", F.when((F.col("low") == F.col("high")) & (F.col("n") == F.col("grouped")), F.col("low")).otherwise(0).alias("group")))


def _in_several_groups(own: DataFrame) -> DataFrame:
    """The fingerprints of texts that the first meetings left in several groups."""
    return own.where("n > 1 and (low <> high or n > grouped)").select("kind", "fp")


def _buckets(plans: tuple[Plan, ...]) -> np.ndarray:
    """The first bucket of each plan's fingerprints, and the number of all."""
    return np.cumsum([0, *(plan.n * sum(_keys(len(g), 1) for g in plan.groups) // BUCKET_PROBES + 1 for plan in plans)])


def _dealt(fps: DataFrame, *plans: Plan) -> DataFrame:
    """Fingerprints (kind, fp, group), each kind by its plan, and their probes, packed by the hash of the part that they look up."""
    edges = _buckets(plans)

    def packed(kind: int, key: np.ndarray, fp: np.ndarray, group: np.ndarray, asks: bool):
        mixed = (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)
        bucket = (mixed % np.uint64(edges[kind + 1] - edges[kind])).astype(np.int32) + np.int32(edges[kind])
        order = np.argsort(bucket, kind="stable")
        there, start = np.unique(bucket[order], return_index=True)
        columns = [np.split(x[order], start[1:]) for x in (key, fp, group)]
        return pa.record_batch([pa.array(there), pa.array([asks] * len(there)), *(pa.array([x.tobytes() for x in c], pa.binary()) for c in columns)], ["bucket", "asks", "keys", "fps", "groups"])

    def emit(kinds: np.ndarray, fps: np.ndarray, groups: np.ndarray):
        for kind, plan in enumerate(plans):
            if (mine := kinds == kind).any():
                yield from of_kind(kind, plan, fps[mine], groups[mine])

    def of_kind(kind: int, plan: Plan, fp: np.ndarray, group: np.ndarray):
        bits = _bits(fp)
        yield packed(kind, np.concatenate([_part_keys(plan, bits, i) for i in range(len(plan.groups))]), np.tile(fp, len(plan.groups)), np.tile(group, len(plan.groups)), False)
        for s in range(0, len(fp), 4096):
            part = slice(s, s + 4096)
            t = plan.thresholds(bits[part])
            keys, rows = [], []
            for i in range(len(plan.groups)):
                mine = _part_keys(plan, bits[part], i)
                for e, masks in enumerate(plan.masks[i]):
                    hit = np.flatnonzero(t[:, i] >= e)
                    keys.append((mine[hit, None] ^ masks).ravel())
                    rows.append(np.repeat(hit, len(masks)))
            rows = np.concatenate(rows) + s
            yield packed(kind, np.concatenate(keys), fp[rows], group[rows], True)

    def asked(batches):
        held, size = [], 0
        for b in batches:
            held.append(tuple(b[c].to_numpy() for c in ("kind", "fp", "group")))
            size += b.num_rows
            if size >= TOGETHER:
                yield from emit(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield from emit(*map(np.concatenate, zip(*held, strict=True)))

    return fps.mapInArrow(asked, "bucket int, asks boolean, keys binary, fps binary, groups binary")


def _opened(t: pa.Table) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Of a bucket: the fingerprints that probes ask with, those stored, and where a probe's rows of other groups start and end, in two parts."""
    asks = t["asks"].to_numpy()
    column = lambda c, side: np.concatenate([np.frombuffer(x.as_py(), np.int64) for x, a in zip(t[c], asks, strict=True) if a == side] or [np.zeros(0, np.int64)])
    key, fp, group = (column(c, False) for c in ("keys", "fps", "groups"))
    order = np.lexsort((group, key))
    key, fp, group = key[order], fp[order], group[order]
    pkey, pfp, pgroup = (column(c, True) for c in ("keys", "fps", "groups"))
    # a probe passes over the rows of its own group, which lie together
    low, high = np.searchsorted(key, pkey, "left"), np.searchsorted(key, pkey, "right")
    inside = _span(key, group, pkey, pgroup, low, high)
    return pfp, fp, [(low, inside[0]), (inside[1], high)]


def _near(pfp: np.ndarray, fp: np.ndarray, start: np.ndarray, n: np.ndarray, radius: int):
    """(smaller, larger) fingerprints within the radius, of probes and the n rows from `start`, in parts."""
    for chunk in _chunks(n):
        i, j = _pairs_of(chunk, start, n)
        near = (pfp[i] < fp[j]) & (np.bitwise_count((pfp[i] ^ fp[j]).view(np.uint64)) <= radius)
        yield pfp[i[near]], fp[j[near]]


def _pairs_of(rows: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of the rows with each of the n rows from its start."""
    i = np.repeat(rows, n[rows])
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows]) + start[i]


def far_meetings(nodes: DataFrame, plan: Plan) -> DataFrame:
    """(a, b): nodes of (fp, node, group) within the radius that are not of one group, each pair once; a null group is the node's own.

    Fingerprints and their probes are joined by key within a bucket. The pairs of a crowd of groups grow with its
    square; `far_texts` and `prefix_meetings` do without them.
    """
    own, fps = _by_fingerprint(_kinds(nodes))

    def meet(t: pa.Table) -> pa.Table:
        pfp, fp, spans = _opened(t)
        found = [np.column_stack(p) for start, end in spans for p in _near(pfp, fp, start, end - start, plan.radius)]
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"x": pa.array(pairs[:, 0], pa.int64()), "y": pa.array(pairs[:, 1], pa.int64())})

    hits = _dealt(fps, plan).groupBy("bucket").applyInArrow(meet, "x long, y long").distinct()
    one, two = (nodes.select(F.col("fp").alias(f"f{c}"), F.col("node").alias(c), F.coalesce("group", "node").alias(f"g{c}")) for c in "pq")
    far = cut(hits).join(one, F.col("x") == F.col("fp")).join(two, F.col("y") == F.col("fq")).where("gp <> gq").select("p", "q")
    mixed = nodes.join(_in_several_groups(own), "fp", "left_semi").select(F.col("fp").alias("fm"), F.col("node").alias("q"), F.coalesce("group", "node").alias("gq"))
    same = mixed.join(one, F.col("fm") == F.col("fp")).where("p < q and gp <> gq").select("p", "q")
    return far.union(same).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def far_texts(nodes: DataFrame, *plans: Plan) -> DataFrame:
    """(node): all nodes that have a pair in far_meetings, found as there, and maybe some more, but a row a node, not a pair.

    With several plans of nodes (fps, node, group), those of any of the fingerprints. Under a key with more than LONG_RUN rows of other groups, whoever looks it up and whoever is there is taken uncompared.
    """
    rows = _kinds(nodes)
    own, fps = _by_fingerprint(rows)
    firsts = _buckets(plans)

    def meet(t: pa.Table) -> pa.Table:
        pfp, fp, spans = _opened(t)
        hit = [np.zeros(0, np.int64)]
        for start, end in spans:
            n = end - start
            long = np.flatnonzero(n > LONG_RUN)
            if len(long):
                edges = np.bincount(start[long], minlength=len(fp) + 1) - np.bincount(end[long], minlength=len(fp) + 1)
                hit += [np.unique(pfp[long]), fp[np.cumsum(edges[:-1]) > 0]]
            for both in _near(pfp, fp, start, np.where(n > LONG_RUN, 0, n), plans[0].radius):
                hit += map(np.unique, both)
        hit = np.unique(np.concatenate(hit))
        kind = np.searchsorted(firsts, t["bucket"][0].as_py(), "right") - 1
        return pa.table({"kind": pa.array(np.full(len(hit), kind), pa.int32()), "fp": pa.array(hit, pa.int64())})

    hits = _dealt(fps, *plans).groupBy("bucket").applyInArrow(meet, "kind int, fp long")
    return rows.join(hits.union(_in_several_groups(own)), ["kind", "fp"], "left_semi").select("node").distinct()


def slot_counts(hashes: DataFrame) -> np.ndarray:
    """How many of the hashes of (hashes) fall into each of 2^SLOT_BITS slots by their upper bits: 4 MB whatever the input."""

    def run(batches):
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for b in batches:
            slots = np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint64) >> np.uint64(64 - SLOT_BITS)
            total += np.bincount(slots.astype(np.int64), minlength=len(total))
        parts = {k: x for k, x in enumerate(total.reshape(-1, 1 << SLOT_RANGE)) if x.any()}
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in parts.values()], pa.binary())], ["k", "n"])

    def summed(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x.as_py()), np.int64) for x in t["n"])
        return pa.table({"k": t["k"].slice(0, 1), "n": pa.array([zlib.compress(np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes(), 1)], pa.binary())})

    out = np.zeros((1 << (SLOT_BITS - SLOT_RANGE), 1 << SLOT_RANGE), np.uint32)
    for k, n in hashes.mapInArrow(run, "k int, n binary").groupBy("k").applyInArrow(summed, "k int, n binary").collect():
        out[k] = np.frombuffer(zlib.decompress(n), np.uint32)
    return out.ravel()


def prefix_meetings(texts: DataFrame, radius: int = KEEP_RADIUS, nearest: bool = False) -> DataFrame:
    """(a, b): of texts (node, hashes, fps, group) each pair of other groups once that is within the radius and can be similar.

    With `nearest` only the pair of each text whose fingerprints differ least, so no more pairs than texts.

    The hashes of every set are put in one order, the rarest slot first. If i hashes of a set of m stand before the first
    one that two sets share, they have m - i in common at most, and similar ones have SIMILARITY / (1 + SIMILARITY) of both
    sizes together. So similar sets meet in a hash of their first fifths that leaves enough, and edited copies that are
    less similar than that, each with more hashes of its own, do not meet at all. Any order is right; this one is quick.
    """
    counts = slot_counts(texts.select("hashes"))
    share = SIMILARITY / (1 + SIMILARITY)
    buckets = int(counts.sum(dtype=np.int64) * (1 - SIMILARITY)) // BUCKET_ROWS + 1

    def prefix(node: int, raw: bytes, fps: list[int], group: int) -> np.ndarray:
        h = np.frombuffer(raw, np.uint64)
        n = min(len(h), int((1 - SIMILARITY) * len(h) + 1e-6) + 1)
        out = np.zeros(n, PREFIX_ROW)
        out["h"] = h[np.lexsort((h, counts[(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]))[:n]]
        out["node"], out["group"], out["fps"], out["size"] = node, group, fps, len(h)
        out["most"] = np.floor((len(h) - np.arange(n)) / share - len(h) + 1e-6)
        return out

    def prefixes(batches):
        for b in batches:
            rows = np.concatenate([prefix(*(x.as_py() for x in row)) for row in zip(*b.columns, strict=True)] or [np.zeros(0, PREFIX_ROW)])
            bucket = (rows["h"] % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            there, start = np.unique(bucket[order], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array([x.tobytes() for x in np.split(rows[order], start[1:])][: len(there)], pa.binary())], ["bucket", "rows"])

    def meet(t: pa.Table) -> pa.Table:
        rows = np.frombuffer(b"".join(t["rows"].to_pylist()), PREFIX_ROW)
        rows, run, rest = _largest_group_first(rows)
        code = (2 * run + rest) << 32 | rows["size"]
        asks = np.flatnonzero(rest)
        low, most, size = np.ceil(SIMILARITY * rows["size"][asks] - 1e-6).astype(np.int64), rows["most"][asks].astype(np.int64), rows["size"][asks]
        found = [np.zeros((0, 3), np.int64)]
        for side in (0, 1):
            base = (2 * run[asks] + side) << 32
            start, end = np.searchsorted(code, base | low, "left"), np.searchsorted(code, base | most, "right")
            start = np.maximum(start, asks + 1) if side else start  # two that both ask meet once
            n = np.maximum(end - start, 0)
            for chunk in _chunks(n, 500_000):
                i, j = _pairs_of(chunk, start, n)
                fit = (rows["most"][j] >= size[i]) & (rows["group"][j] != rows["group"][asks[i]])
                i, j = asks[i[fit]], j[fit]
                differ = np.bitwise_count((rows["fps"][i] ^ rows["fps"][j]).view(np.uint64))
                fit = (differ <= radius).any(axis=1)
                x, y, d = rows["node"][i[fit]], rows["node"][j[fit]], differ[fit].sum(axis=1, dtype=np.int64)
                part = np.column_stack([np.minimum(x, y), np.maximum(x, y), d])
                found.append(_nearest(np.concatenate([part, part[:, [1, 0, 2]]])) if nearest else np.unique(part, axis=0))
        pairs = np.concatenate(found)
        pairs = _nearest(pairs) if nearest else np.unique(pairs, axis=0)
        return pa.table({c: pa.array(pairs[:, k], pa.int64()) for k, c in enumerate("abd")})

    rows = texts.select("node", "hashes", "fps", "group").mapInArrow(prefixes, "bucket int, rows binary")
    met = rows.groupBy("bucket").applyInArrow(meet, "a long, b long, d long")
    if nearest:
        met = met.groupBy("a").agg(F.min(F.struct("d", "b")).alias("x")).select(F.least("a", "x.b").alias("a"), F.greatest("a", "x.b").alias("b"))
    return met.select("a", "b").distinct()


def _nearest(pairs: np.ndarray) -> np.ndarray:
    """Of pairs (a, b, distance) the nearest one of each a."""
    pairs = pairs[np.lexsort((pairs[:, 1], pairs[:, 2], pairs[:, 0]))]
    return pairs[np.append(True, pairs[1:, 0] != pairs[:-1, 0])[: len(pairs)]]


def _largest_group_first(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows by hash, those of its largest group first, then by size; the hash's number; and whether a row is of a smaller group."""
    rows = rows[np.lexsort((rows["group"], rows["h"]))]
    new_hash = np.append(True, rows["h"][1:] != rows["h"][:-1])[: len(rows)]
    new_group = new_hash | np.append(True, rows["group"][1:] != rows["group"][:-1])[: len(rows)]
    run, part = np.cumsum(new_hash) - 1, np.cumsum(new_group) - 1
    sizes, of = np.bincount(part, minlength=1), run[new_group]
    last = np.lexsort((sizes[: len(of)], of))  # the largest part of a hash comes last
    largest = last[np.append(of[last][1:] != of[last][:-1], True)[: len(of)]]
    rest = part != largest[run] if len(rows) else np.zeros(0, bool)
    order = np.lexsort((rows["size"], rest, run))
    return rows[order], run[order].astype(np.int64), rest[order].astype(np.int64)


def _span(key: np.ndarray, group: np.ndarray, pkey: np.ndarray, pgroup: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the rows (sorted by key, group) of a probe's key and group lie; nothing, at `low`, for group 0."""
    codes = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (group[1:] != group[:-1]))) if len(key) else np.zeros(0, np.int64)
    ends = np.append(codes[1:], len(key))
    runs = {(k, g): (s, e) for k, g, s, e in zip(key[codes].tolist(), group[codes].tolist(), codes.tolist(), ends.tolist(), strict=True) if g}
    start, end = low.copy(), low.copy()
    if runs:
        for at in np.flatnonzero(pgroup != 0):
            if run := runs.get((int(pkey[at]), int(pgroup[at]))):
                start[at], end[at] = run
    return start, end


def _chunks(n: np.ndarray, most: int = 2_000_000):
    """Row numbers with n > 0 in parts whose n add up to about `most`."""
    rows = np.flatnonzero(n > 0)
    total = np.cumsum(n[rows])
    edges = np.searchsorted(total, np.arange(most, int(total[-1]) + most, most)) if len(rows) else []
    for part in np.split(rows, np.unique(edges)) if len(rows) else []:
        if len(part):
            yield part


def compared(left: DataFrame, hashes: DataFrame, links: DataFrame | None) -> DataFrame | None:
    """links with all pairs (a, b) of left that are similar, but for pairs whose ends are linked to one text already.

    In rounds: each b with its smallest a first, then with 4 more, 16 more and so on, so a group of copies costs a
    comparison a text or so, and every pair is compared or already connected. Once no more than AT_ONCE pairs a text
    are left, all of them are compared: each round is some jobs, whatever it compares.
    """
    left, several, few = cut(left), 1, AT_ONCE * hashes.count()
    while count := left.count():
        last = count <= few
        if not last:
            turn = F.row_number().over(Window.partitionBy("b").orderBy("a"))
            before, left = left, cut(left.withColumn("turn", turn))
            drop_cut(before)
        pairs = left if last else left.where(F.col("turn") <= several).select("a", "b")
        used = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        now = cut(similar(pairs, hashes.join(used, "node", "left_semi")))
        links = now if links is None else links.union(now)
        if last:
            drop_cut(left)
            break
        # texts that are linked to the same smallest one need no comparison; one aggregation tells most of them
        least = links.groupBy("b").agg(F.min("a").alias("least"))
        la, lb = (least.select(F.col("b").alias(c), F.col("least").alias(f"l{c}")) for c in "ab")
        rest = left.where(F.col("turn") > several).drop("turn").join(la, "a", "left").join(lb, "b", "left")
        after = cut(rest.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b"))
        drop_cut(left)
        left, several = after, 4 * several
    return links


def similar_texts(texts: DataFrame, radius: int = KEEP_RADIUS) -> DataFrame:
    """(node, component): of texts (node, raw), equal ones under one node, those linked to others by similarity.

    Every candidate pair is compared by its whole sets or already connected.
    """
    spark = texts.sparkSession
    found = cut(prints(texts).dropDuplicates(["node"]))
    size = found.select("node", "n")
    one, two = (size.select(F.col("node").alias(c), F.col("n").alias(f"n{c}")) for c in "ab")
    fits = F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb") - 1e-9  # sets of other sizes cannot be so similar

    def sets_of(nodes: DataFrame) -> DataFrame:
        asked = cut(nodes)  # a table: where it is small, no text is shuffled
        return cut(sets(texts.join(asked, "node", "left_semi").dropDuplicates(["node"])))

    n = found.count()
    plans = [Plan(found.select(F.col("fps")[k].alias("fp")), n, radius, TRAVEL) for k in range(PRINTS)]
    first = cut(first_meetings(found, *plans).join(one, "a").join(two, "b").where(fits).select("a", "b"))
    links = compared(first, sets_of(first.select(F.explode(F.array("a", "b")).alias("node")).distinct()), None)
    nothing = spark.createDataFrame([], "node long, component long")
    groups = nothing if links is None else components_of_few(links)
    grouped = cut(found.join(groups, "node", "left").select("fps", "node", F.col("component").alias("group")))
    hashes = sets_of(far_texts(grouped, *plans))
    drop_cut(grouped)
    far = cut(hashes.join(found.select("node", "fps"), "node"))
    for turn in range(NEAREST_ROUNDS + 1):  # groups that a few pairs join make no more pairs
        grouped = far.join(groups, "node", "left").select("node", "hashes", "fps", F.coalesce("component", "node").alias("group"))
        links = compared(prefix_meetings(grouped, radius, nearest=turn < NEAREST_ROUNDS).join(first, ["a", "b"], "left_anti"), hashes, links)
        groups = nothing if links is None else components_of_few(links)
    return groups


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but the first row, by id and then text, of each group of equal or similar texts."""
    id_, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    blank = F.coalesce(F.when(text.rlike(r"[^\x20\x09-\x0D]"), text), F.lit(""))
    key, told, kept, copies = free_names(docs, "key", "told", "kept", "copies")
    node = F.xxhash64(blank)
    labels = similar_texts(docs.select(node.alias("node"), blank.cast("binary").alias("raw")))
    labels = labels.select(F.col("node").alias("labelled"), F.col("component").alias("c"))
    # the first (id, node) of each group, and how many rows are just that
    rows = docs.select(id_.alias("id"), node.alias("node")).groupBy("id", "node").agg(F.count("*").alias("n"))
    grouped = rows.join(labels, F.col("node") == F.col("labelled"), "left").groupBy(F.coalesce("c", "node").alias("g"))
    first = cut(grouped.agg(F.min(F.struct("id", "node", "n")).alias("first")).select(F.col("first.id").alias(told), F.col("first.node").alias(kept), F.col("first.n").alias(copies)))
    chosen = docs.withColumn(key, node).join(first, id_.eqNullSafe(F.col(told)) & (F.col(key) == F.col(kept)))
    once, more = chosen.where(F.col(copies) == 1), chosen.where(F.col(copies) > 1).dropDuplicates([id_col, key])
    return once.unionByName(more).select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")

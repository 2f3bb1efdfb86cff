"""A quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Each whole text becomes the numbers in STATISTICS, standardised over the labelled training rows and
cut at REACH standard deviations. Cosines of random projections approximate a Gaussian kernel over
them. Each of PARTS partitions of the training rows sums its part of the normal equations by kernel
width and fold, the parts are added up, and the driver solves them: a few matrices of a fixed size,
however many rows there are. Width and ridge are those of the least squared error on the folds left
out, which follows from the same sums. Scores of the folds left out, counted on a grid, give the
isotonic calibration by pooling adjacent violators.

Labels are learnt from rows whose crc32(doc_id as text) mod 5 is not 0, without a cap. Labels, language, source and
doc_id are no inputs of a score; equal texts have equal scores and are in one fold.

Defined results: a null text is empty, and an empty one has statistics of zero; a null doc_id is not
held out and has no label; of several labels of a doc_id the least counts, null labels don't; each
document row with a label counts; without labels every score is 0.5, with labels of one kind it is
that label; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from learnspark.llm.common import cut, sliced, small_batches, table

STATISTICS = (
    "log_words", "word_length", "word_length_spread", "distinct_words", "commonest_word", "stutter", "repeated_triples",
    "upper", "letters", "digits", "marks", "bangs", "symbols", "bars", "beyond_ascii", "blanks", "entropy",
    "capitalised", "ends_in_mark", "no_letter", "log_lines", "repeated_lines", "log_line_words", "lines_end_in_mark",
)
#: Cosines that stand for the kernel.
FEATURES = 256
#: Kernel widths to choose from, as multiples of the square root of the number of statistics.
WIDTHS = (0.5, 1.0, 2.0)
#: Ridges to choose from, as shares of the number of rows.
RIDGES = (1e-6, 1e-5, 1e-4, 1e-3, 1e-2)
FOLDS = 4
#: Partitions that sum the normal equations.
PARTS = 32
#: Standard deviations at which a statistic is cut.
REACH = 6.0
#: Steps of a score of 1 on the calibration's grid; scores beyond -1 and 2 are at its ends.
GRID = 1024
CUTOFF = 0.3

_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": b"abcdefghijklmnopqrstuvwxyz", "digits": b"0123456789", "marks": b".,;:!?", "bangs": b"!?", "symbols": b"#*$%&|<>", "bars": b"|", "beyond_ascii": bytes(range(128, 256)), "blanks": b" \t\n\v\f\r"}
_OF_BYTE = np.zeros((256, len(_KINDS)))
for _k, _v in enumerate(_KINDS.values()):
    _OF_BYTE[list(_v), _k] = 1


def statistics(text: str) -> list[float]:
    """The numbers in STATISTICS of one whole text."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n = len(words)
    length = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    triples = Counter(zip(words, words[1:], words[2:], strict=False))
    lines = [x for line in raw.split(b"\n") if (x := line.strip())]
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = dict(zip(_KINDS, counts @ _OF_BYTE, strict=True))
    letters = kinds["upper"] + kinds["lower"] + kinds["beyond_ascii"]
    share = counts[counts > 0] / len(raw)
    bare = sum(c for w, c in seen.items() if not any(x >= 128 or 65 <= x <= 90 or 97 <= x <= 122 for x in w))
    return [
        np.log1p(n), length.mean(), length.std(), len(seen) / n, max(seen.values()) / n, sum(map(bytes.__eq__, words, words[1:])) / n,
        sum(c for c in triples.values() if c > 1) / max(n - 2, 1), kinds["upper"] / max(letters, 1), letters / len(raw), kinds["digits"] / len(raw),
        kinds["marks"] / n, kinds["bangs"] / n, kinds["symbols"] / n, kinds["bars"] / n, kinds["beyond_ascii"] / len(raw), kinds["blanks"] / len(raw), -(share * np.log2(share)).sum(),
        sum(c for w, c in seen.items() if 65 <= w[0] <= 90) / n, sum(c for w, c in seen.items() if w[-1] in b".,;:!?") / n, bare / n,
        np.log1p(len(lines)), 1 - len(set(lines)) / len(lines), np.log1p(n / len(lines)), sum(x[-1] in b".,;:!?" for x in lines) / len(lines),
    ]


def held_out(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, fold, x): the statistics of each whole text; equal texts are in one fold."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    ready = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.pmod(F.xxhash64(text), F.lit(FOLDS)).cast("int").alias("fold"), text.alias("text"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            x = pa.array([statistics(t) for t in b["text"].to_pylist()], pa.list_(pa.float64()))
            yield pa.record_batch([b["doc_id"], b["held_out"], b["fold"], x], ["doc_id", "held_out", "fold", "x"])

    return ready.mapInArrow(measure, "doc_id long, held_out boolean, fold int, x array<double>")


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy().reshape(len(lists), len(STATISTICS))


class Features:
    """Standardised statistics as a constant and FEATURES cosines for each width."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, seed: int = 13) -> None:
        r = np.random.default_rng(seed)
        self.mean, self.spread = mean, np.where(spread > 0, spread, 1.0)
        self.directions, self.phases = r.standard_normal((len(STATISTICS), FEATURES)), r.uniform(0, 2 * np.pi, FEATURES)

    def __call__(self, x: np.ndarray, width: float) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -REACH, REACH) / (width * np.sqrt(len(STATISTICS)))
        return np.hstack([np.ones((len(x), 1)), np.sqrt(2 / FEATURES) * np.cos(z @ self.directions + self.phases)])


def normal_equations(rows: DataFrame, features: Features) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray, float, int]]:
    """By (width, fold): the sums of zz', zy, yy and the number of rows (fold, x, label)."""
    size = FEATURES + 1

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for b in batches:
            x, y, fold = _matrix(b["x"]), b["label"].to_numpy().astype(float), b["fold"].to_numpy()
            for k, width in enumerate(WIDTHS):
                z = features(x, width)
                for f in np.unique(fold):
                    own = np.column_stack([z, y])[fold == f]
                    total[k, f] = total.get((k, f), 0) + own.T @ own
        yield pa.record_batch([pa.array([k for k, _ in total], pa.int32()), pa.array([f for _, f in total], pa.int32()), pa.array([m.tobytes() for m in total.values()], pa.binary())], ["width", "fold", "m"])

    def added(t: pa.Table) -> pa.Table:
        m = sum(np.frombuffer(x.as_py()) for x in t["m"])
        return pa.table({"width": t["width"][:1], "fold": t["fold"][:1], "m": pa.array([m.tobytes()], pa.binary())})

    schema = "width int, fold int, m binary"
    found = rows.select("fold", "x", "label").repartition(PARTS).mapInArrow(sums, schema).groupBy("width", "fold").applyInArrow(added, schema)
    out = {}
    for r in found.collect():
        m = np.frombuffer(r.m).reshape(size + 1, size + 1)
        out[r.width, r.fold] = m[:size, :size], m[:size, size], m[size, size], int(round(m[0, 0]))
    return out


def _solved(a: np.ndarray, b: np.ndarray, n: int, ridge: float) -> np.ndarray:
    """Ridge weights; the constant is not shrunk."""
    shrunk = np.full(len(b), ridge * max(n, 1))
    shrunk[0] = 1e-9
    return np.linalg.solve(a + np.diag(shrunk), b)


def fitted(sums: dict) -> tuple[int, np.ndarray, dict[int, np.ndarray]]:
    """(width, weights, weights without each fold) of the width and ridge with the least squared error on folds left out."""
    best = None
    for k in sorted({k for k, _ in sums}):
        of = {f: v for (w, f), v in sums.items() if w == k}
        a, b, n = (sum(v[i] for v in of.values()) for i in (0, 1, 3))
        for ridge in RIDGES:
            each = {f: _solved(a - v[0], b - v[1], n - v[3], ridge) for f, v in of.items()} if len(of) > 1 else {f: _solved(a, b, n, ridge) for f in of}
            loss = sum(w @ of[f][0] @ w - 2 * w @ of[f][1] + of[f][2] for f, w in each.items())
            if best is None or loss < best[0]:
                best = loss, k, _solved(a, b, n, ridge), each
    return best[1:]


def pooled(score: np.ndarray, n: np.ndarray, ones: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The isotonic fit of ones / n over ascending scores, by pooling adjacent violators: (mean score, value) of each pool."""
    pools: list[list[float]] = []
    for s, k, one in zip(score, n, ones, strict=True):
        pools.append([s * k, k, one])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    s, k, one = np.array(pools).T
    return s / k, one / k


def _grid(score: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(score, -1, 2) * GRID).astype(np.int32)


class Model:
    """Features, the width chosen, its weights and the calibration's pools; without labels all scores are 0.5."""

    def __init__(self, features: Features | None = None, width: float = 1.0, weights: np.ndarray | None = None, at: np.ndarray | None = None, value: np.ndarray | None = None) -> None:
        self.features, self.width, self.weights, self.at, self.value = features, width, weights, at, value

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.features is None:
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.features(x, self.width) @ self.weights, self.at, self.value), 0.0, 1.0)


def train(rows: DataFrame) -> Model:
    """The model of rows (fold, x, label); rows must be a table."""
    moments = [f(F.col("x")[k]) for k in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]
    n, *told = rows.agg(F.count("*"), *moments).first()
    if not n:
        return Model()
    features = Features(np.array(told[::2]), np.array(told[1::2]))
    k, weights, each = fitted(normal_equations(rows, features))
    width = WIDTHS[k]

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z, fold = features(_matrix(b["x"]), width), b["fold"].to_numpy()
            score = np.zeros(len(fold))
            for f, w in each.items():
                score[fold == f] = z[fold == f] @ w
            yield pa.record_batch([pa.array(_grid(score)), b["label"]], ["score", "label"])

    counts = rows.select("fold", "x", "label").mapInArrow(binned, "score int, label int").groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("ones"))
    score, n, ones = np.array(counts.orderBy("score").collect(), float).T
    return Model(features, width, weights, *pooled(score / GRID, n, ones))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs, learnt from the labels of those not held out."""
    small_batches(docs.sparkSession)
    rows = cut(measured(docs, id_col, text_col))
    known = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("label")).where("label is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    model = train(cut(rows.where("not held_out").join(known, "doc_id").select("fold", "x", "label")))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = model(_matrix(b["x"]))
            yield pa.record_batch([b["doc_id"], b["held_out"], pa.array(found), pa.array((found >= CUTOFF).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

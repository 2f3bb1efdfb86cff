"""Near-duplicate embeddings from int8 tile products with error bounds.

Unit vectors x are quantised to s * q with int8 q; e = |x - s * q| is kept per vector. For any two,
|x.y - s_x s_y (q_x.q_y)| <= e_x + e_y + e_x e_y, so a pair whose quantised product plus that bound
stays under the threshold is no link; only the others are computed in double precision.

Equal vectors are one class before anything else. Classes are dealt to their nearest pivot (a
bounded sample of classes) and to tiles of about TILE rows. By the triangle inequality on angles,
two pivots whose angle less both radii exceeds the threshold's angle share no link, and their tiles
are never multiplied. A tile product returns a count and a spanning forest, a row per vector and not
per pair, so a dense group costs no more rows than a sparse one.

Defined results: a vector that is null, empty or zero or holds null, NaN or infinite components
links with nothing and is its own component; vectors of different lengths never link; rows that
repeat a vec_id are vectors of their own and share its component only by links; a null vec_id never
names a component, but its vector links others; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnspark.llm.common import arrow_rows, connected_components, cut, table

THRESHOLD = 0.95
TILE = 2048
#: Pivots for as many cells of TILE rows, up to here; cells of a larger input hold several tiles.
MAX_PIVOTS = 4096
#: Pairs computed in double precision at once.
PAIRS = 1 << 15
#: For rounding in the float32 sums of products and bounds.
SLACK = 1e-5


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """q (int8), s and e of unit rows x, so that |x - s * q| <= e."""
    s = np.abs(x).max(axis=1) / 127
    q = np.rint(x / s[:, None]).astype(np.int8)
    return q, s, np.sqrt(((x - s[:, None] * q) ** 2).sum(axis=1)) + 1e-12


class Tile:
    """Vectors quantised once, and as they are for the pairs that need them: 5 bytes a component of a float vector."""

    def __init__(self, x: np.ndarray):
        self.x = x
        exact = x.astype(np.float64)
        self.norm = np.sqrt((exact * exact).sum(axis=1))
        self.q, self.s, self.e = quantised(exact / self.norm[:, None])

    def packed(self) -> dict[str, list[bytes]]:
        return {"vec": [self.x.tobytes()], "norm": [self.norm.tobytes()], "q": [self.q.tobytes()], "s": [self.s.tobytes()], "e": [self.e.tobytes()]}

    @classmethod
    def of(cls, r: dict, k: int, kind: np.dtype) -> Tile:
        """Tile k (1 or 2) of a row of two packed ones."""
        t = cls.__new__(cls)
        t.norm, t.s, t.e = (np.frombuffer(r[f"{c}{k}"], np.float64) for c in ("norm", "s", "e"))
        t.x, t.q = np.frombuffer(r[f"vec{k}"], kind).reshape(len(t.norm), -1), np.frombuffer(r[f"q{k}"], np.int8).reshape(len(t.norm), -1)
        return t


def linked(a: Tile, b: Tile, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (i, j) of all pairs with cosine >= threshold; i < j only, where a is b."""
    exact = np.float32 if a.q.shape[1] * 127 * 127 < 1 << 24 else np.float64  # holds every product sum
    bound = a.q.astype(exact) @ b.q.astype(exact).T
    bound *= a.s[:, None].astype(exact)
    bound *= b.s.astype(exact)
    bound += (a.e * (1 + b.e.max())).astype(exact)[:, None]
    bound += b.e.astype(exact)
    i, j = np.nonzero(bound >= threshold - SLACK)
    if same:
        i, j = i[i < j], j[i < j]
    sure = []
    for p in range(0, len(i), PAIRS):
        x, y = a.x[i[p : p + PAIRS]].astype(np.float64), b.x[j[p : p + PAIRS]].astype(np.float64)
        sure.append(np.einsum("ij,ij->i", x, y) / (a.norm[i[p : p + PAIRS]] * b.norm[j[p : p + PAIRS]]) >= threshold)
    hit = np.concatenate(sure) if sure else np.zeros(0, bool)
    return i[hit], j[hit]


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest member number of each node's component under edges (i, j)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[i], label[j])
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def classes(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(node, rep, n, vec): each distinct usable vector, by its hash, with its smallest id and its number of rows."""
    v = F.col(vec_col)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)
    return vectors.where(usable).groupBy(v.alias("vec")).agg(F.min(F.col(id_col).cast("long")).alias("rep"), F.count("*").alias("n")).select(F.xxhash64("vec").alias("node"), "rep", "n", "vec")


def tile_links(found: DataFrame, threshold: float) -> DataFrame:
    """(node, links, root) for each class of each tile product it has links in."""
    spark, total = found.sparkSession, found.count()
    pivots = min(MAX_PIVOTS, max(1, -(-total // TILE)))
    # a bounded sample, by hash: it decides only how classes are dealt out, not which pairs are found
    chosen = found.orderBy("node").limit(pivots).select("vec").toPandas()["vec"]
    by_size: dict[int, list[np.ndarray]] = {}
    for v in chosen:
        by_size.setdefault(len(v), []).append(np.asarray(v, np.float64))
    unit, start = {}, 0
    for size, vs in by_size.items():
        unit[size] = (start, np.stack([v / np.linalg.norm(v) for v in vs]))
        start += len(vs)

    def dealt(batches):
        for b in batches:
            out = []
            for size, rows in b.groupby(b["vec"].map(len)):
                x = np.stack(rows["vec"].to_numpy()).astype(np.float64)
                x /= np.sqrt((x * x).sum(axis=1))[:, None]
                first, p = unit.get(size, (-size, np.zeros((1, size))))  # no pivot has this length: a cell of its own
                near = x @ p.T
                best = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(x)), best], -1, 1))
                out.append(pd.DataFrame({"node": rows["node"], "n": rows["n"], "vec": rows["vec"], "size": size, "cell": first + best, "angle": angle}))
            if out:
                yield pd.concat(out)

    kind = found.schema["vec"].dataType.simpleString()
    placed = cut(found.select("node", "n", "vec").mapInPandas(dealt, f"node long, n long, vec {kind}, size int, cell long, angle double"))
    cells = placed.groupBy("size", "cell").agg(F.count("*").alias("rows"), F.max("angle").alias("radius")).toPandas()  # pivots + lengths rows
    reach, pairs = math.acos(threshold) + 1e-6, []
    for size, own in cells.groupby("size"):
        cell, radius = own["cell"].to_numpy(), own["radius"].to_numpy()
        if size in unit:
            first, p = unit[size]
            centre = p[cell - first]
            angle = np.arccos(np.clip(centre @ centre.T, -1, 1))
        else:
            angle = np.zeros((len(cell), len(cell)))
        i, j = np.nonzero(np.triu(angle - radius[:, None] - radius <= reach))
        pairs += list(zip(cell[i].tolist(), cell[j].tolist(), strict=True))
    if not pairs:
        return spark.createDataFrame([], "node long, links long, root long")
    chunks = {int(c): -(-int(r) // TILE) for c, r in zip(cells["cell"], cells["rows"], strict=True)}
    split = F.create_map(*[F.lit(x) for kv in chunks.items() for x in kv]) if chunks else None

    held = np.dtype(np.float32 if kind == "array<float>" else np.float64)

    def tile(key, rows):
        one = {"cell": [key[0]], "chunk": [key[1]], "node": [rows["node"].to_numpy(np.int64).tobytes()], "n": [rows["n"].to_numpy(np.int64).tobytes()]}
        return pd.DataFrame(one | Tile(np.stack(rows["vec"].to_numpy()).astype(held)).packed())

    blobs = ("node", "n", "vec", "norm", "q", "s", "e")
    chunk = F.pmod(F.col("node"), split[F.col("cell")].cast("long"))
    tiles = cut(placed.withColumn("chunk", chunk).groupBy("cell", "chunk").applyInPandas(tile, "cell long, chunk long, " + ", ".join(f"{c} binary" for c in blobs)))
    which = spark.createDataFrame(pairs, "ci long, cj long").repartition(max(1, min(len(pairs), 4 * spark.sparkContext.defaultParallelism)))
    a, b = (tiles.select(*[F.col(c).alias(f"{c}{s}") for c in tiles.columns]) for s in "12")
    both = which.join(a, F.col("ci") == F.col("cell1")).join(b, F.col("cj") == F.col("cell2")).where("ci <> cj or chunk1 <= chunk2")

    def product(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ra, rb, wa, wb = (np.frombuffer(r[c], np.int64) for c in ("node1", "node2", "n1", "n2"))
                same = (r["ci"], r["chunk1"]) == (r["cj"], r["chunk2"])
                i, j = linked(Tile.of(r, 1, held), Tile.of(r, 2, held), threshold, same)
                if not len(i):
                    continue
                j = j if same else j + len(ra)
                node, n = (ra, wa) if same else (np.concatenate([ra, rb]), np.concatenate([wa, wb]))
                links = np.bincount(i, n[j], len(node)) + np.bincount(j, n[i], len(node))
                root = node[forest(i, j, len(node))]
                hit = links > 0
                yield pa.RecordBatch.from_pydict({"node": node[hit], "links": links[hit].astype(np.int64), "root": root[hit]})

    with arrow_rows(spark, 8):  # a row holds two tiles
        return cut(both.select("ci", "cj", "chunk1", "chunk2", *[f"{c}{k}" for c in blobs for k in "12"]).mapInArrow(product, "node long, links long, root long"))


def components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id) of every row; threshold above 0."""
    found = cut(classes(vectors, id_col, vec_col))
    links = tile_links(found, threshold)
    label = connected_components(links.select(F.col("node").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "member")
    counted = links.groupBy(F.col("node").alias("counted")).agg(F.sum("links").alias("links"))
    told = found.join(counted, F.col("node") == F.col("counted"), "left").join(label, F.col("node") == F.col("member"), "left")
    told = told.select("vec", "rep", F.coalesce("component", "node").alias("c"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    first = told.groupBy("c").agg(F.min("rep").alias("component_id"))
    told = told.join(first, "c").select("vec", "n_links", "component_id")
    all_rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vec_col}`").alias("own"))
    out = all_rows.join(told, F.col("own") == F.col("vec"), "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op5_int8_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))

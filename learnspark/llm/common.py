"""What the training-data operators share: table reading, lineage cuts and connected components."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from learnspark.sources.files import remove, shared_folder

#: Characters between words, as a Java pattern; bytes.split() uses the same set.
BLANK = r"[\x20\x09-\x0D]+"
#: Keys that joined_by_count broadcasts at most.
HOT_KEYS = 10_000
#: Edges that one task contracts, about: some MB.
TASK_EDGES = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each with as many underscores in front as make it no column of df, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return tuple(out)


def joined_by_count(rows: DataFrame, told: DataFrame, keys: list[str], count: str) -> DataFrame:
    """rows joined to told (one row for each of their keys, `count` the number of rows that have it).

    Keys with more than 1 / HOT_KEYS of all rows are fewer than HOT_KEYS, so they are broadcast and
    their rows stay where they are; the other rows are shuffled, and none of their keys is hot. Both
    inputs are read twice, so they should be tables.
    """
    total = told.agg(F.sum(count)).first()[0] or 0
    bound = total // HOT_KEYS + 1
    hot = F.broadcast(told.where(F.col(count) > bound))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(told.where(F.col(count) <= bound), keys))


def cut(df: DataFrame, *by: str) -> DataFrame:
    """df, written once to the shared folder, in folders by the columns named, and read back: a lost executor costs no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Removes the files of an earlier cut() that nothing reads any more."""
    remove(df.sparkSession, df.cut_path)


def sliced(batches, rows: int = 1_000):
    """Record batches in slices of at most `rows` rows, for work that holds much more than a row's text."""
    for b in batches:
        for start in range(0, b.num_rows, rows):
            yield b.slice(start, rows)


def small_batches(spark: SparkSession) -> None:
    """From here on in this session, Arrow batches of at most 1,000 rows and 8 MB.

    Rows hold whole texts, and each task keeps several copies of a batch outside the heap.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1_000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of at most `rows` rows for the jobs run inside, where each row is large."""
    option = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(option)
    spark.conf.set(option, rows)
    try:
        yield
    finally:
        spark.conf.set(option, before)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is the smallest node reachable.

    Alternating large-star and small-star rounds: each node hangs its larger neighbours, then its
    smaller ones, under the smallest it knows. Minima are aggregated before they are shuffled and
    the joins back can be split by AQE, so a node with very many neighbours is no single task.
    Self-loops and null ends are ignored; repeated edges count once.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = cut(e), None
    while True:
        after = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if after == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
        before = after
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = cut(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = cut(kept.union(low.select("u", F.col("m").alias("v"))).distinct())
        drop_cut(large)
        drop_cut(e)
        e = small


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of edges (a, b): the smallest node of each and every other one of its nodes."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[root[leaf]], nodes[leaf]


def components_of_few(edges: DataFrame) -> DataFrame:
    """What connected_components returns, in fewer jobs where there are far fewer edges than texts.

    Each task of about TASK_EDGES edges puts stars in their place, with the same components and no more edges than
    nodes. The stars of a single task are the result, those of several go through the rounds.
    """
    edges = cut(edges.where("a <> b").select("a", "b"))
    tasks = edges.count() // TASK_EDGES + 1

    def run(batches):
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches] or [(np.zeros(0, np.int64),) * 2]
        low, other = stars(*map(np.concatenate, zip(*parts, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(other, pa.int64())], ["a", "b"])

    found = cut(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(tasks).mapInArrow(run, "a long, b long"))
    drop_cut(edges)
    if tasks > 1:
        return connected_components(found)
    return found.select(F.col("b").alias("node"), F.col("a").alias("component")).union(found.select("a", "a").distinct())

"""Recall of the near-duplicate stage by similarity, against all pairs, and no pairs within a ball of copies."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from learnspark.llm import simhash
from learnspark.llm.common import connected_components, cut


def edited(r, words, edits):
    out = list(words)
    for _ in range(edits):
        k = r.randrange(len(out))
        kind = r.random()
        if kind < 0.5:
            out[k] = f"n{r.random()}"
        elif kind < 0.75:
            del out[k]
        else:
            out.insert(k, f"m{r.random()}")
    return out


def similarity(a, b):
    x, y = (np.unique(simhash.shingle_hashes(t.encode(), simhash.KEEP_SHINGLE)) for t in (a, b))
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common / (len(x) + len(y) - common)


@pytest.fixture(scope="module")
def pairs(spark):
    """(first, second, similarity) of whole documents and edited ones."""
    r, out = random.Random(7), []
    texts = [x.text for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("size(split(text, ' ')) between 60 and 500").select("text").distinct().orderBy("text").collect()]
    for t in texts[:450]:
        words = t.split()
        other = " ".join(edited(r, words, r.randint(1, max(1, len(words) // 20))))
        out.append((" ".join(words), other, similarity(t, other)))
    return out


def test_recall_by_similarity(spark, pairs):
    texts = [t for a, b, _ in pairs for t in (a, b)]
    rows = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "node long, raw binary")
    group = {x.node: x.component for x in simhash.similar_texts(rows).collect()}
    found = {}
    for k, (_, _, s) in enumerate(pairs):
        if s >= simhash.SIMILARITY:
            band = min(int((s - simhash.SIMILARITY) / 0.05), 3)
            found.setdefault(band, []).append(group.get(2 * k, -1) == group.get(2 * k + 1, -2))
    assert sorted(found) == [0, 1, 2, 3] and all(len(x) >= 25 for x in found.values())
    assert all(np.mean(x) >= 0.9 for x in found.values()), {b: np.mean(x) for b, x in found.items()}
    assert np.mean([hit for b in (1, 2, 3) for hit in found[b]]) >= 0.99


def test_nothing_else_is_linked(spark, pairs):
    texts = [t for a, b, _ in pairs[:120] for t in (a, b)]
    rows = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "node long, raw binary")
    group = {x.node: x.component for x in simhash.similar_texts(rows).collect()}
    links = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(texts[i], texts[j]) >= simhash.SIMILARITY - 1e-9]
    true = {x.node: x.component for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    for i, c in group.items():
        assert true[i] == true[c]


def test_a_ball_of_copies_makes_no_pairs_within_itself(spark):
    r = random.Random(3)
    base = [f"w{r.randint(0, 5000)}" for _ in range(300)]
    copies = [" ".join(edited(r, base, 2)) for _ in range(400)]
    others = [" ".join(f"w{r.randint(0, 5000)}" for _ in range(300)) for _ in range(100)]
    rows = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(copies + others)], "node long, raw binary")
    group = {x.node: x.component for x in simhash.similar_texts(rows).collect()}
    assert len(group) == 400 and set(group.values()) == {0}
    found = cut(simhash.prints(rows))
    nodes = found.select(F.col("fps")[0].alias("fp"), "node")
    plan = simhash.Plan(nodes, 500, simhash.KEEP_RADIUS, simhash.TRAVEL)
    assert simhash.first_meetings(nodes, plan).count() <= 400 * len(plan.groups)
    grouped = cut(nodes.withColumn("group", F.when(F.col("node") < 400, F.lit(0).cast("long"))))
    assert simhash.far_meetings(grouped.withColumn("group", F.when(F.col("group").isNotNull(), F.lit(7).cast("long"))), plan).count() < 50
    near = simhash.near_pairs(nodes, simhash.KEEP_RADIUS)
    alone = simhash.far_meetings(cut(nodes.withColumn("group", F.lit(None).cast("long"))), plan)
    pairs = lambda df: {(x.a, x.b) for x in df.collect()}
    assert pairs(alone) == pairs(near) and len(pairs(near)) > 10_000  # without groups all pairs within the radius are found

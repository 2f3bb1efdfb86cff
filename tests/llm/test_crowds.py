"""Many texts edited from one, near in bits and mostly less similar than the cutoff: their pairs must not become rows."""

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from learnspark.llm import common, simhash
from learnspark.llm.common import connected_components, cut


def family(n, seed=5):
    """n texts, each with a few words of the same 150 replaced."""
    r, base = random.Random(seed), [f"w{k}" for k in range(150)]
    out = []
    for _ in range(n):
        words = list(base)
        for k in r.sample(range(150), r.choice([1, 2, 3, 4, 5, 6, 7])):
            words[k] = f"n{r.randrange(10**9)}"
        out.append(" ".join(words))
    return out


def links_of(texts):
    """The pairs whose sets are similar."""
    sets = [set(simhash.shingle_hashes(t.encode(), simhash.KEEP_SHINGLE).tolist()) for t in texts]
    return [(i, j) for i, j in combinations(range(len(texts)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]


def frame(spark, texts):
    return spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "node long, raw binary")


def test_a_crowd_makes_no_more_pairs_than_a_few_a_text(spark, monkeypatch):
    texts, asked, compared = family(500), [], simhash.compared

    def counted(left, hashes, links):
        left = cut(left)
        asked.append(left.count())
        return compared(left, hashes, links)

    monkeypatch.setattr(simhash, "compared", counted)
    group = {x.node: x.component for x in simhash.similar_texts(frame(spark, texts)).collect()}
    true = {x.node: x.component for x in connected_components(spark.createDataFrame(links_of(texts), "a long, b long")).collect()}
    assert group == true and 100 < len(group) < 450
    assert sum(asked) <= 20 * len(texts), asked  # over 47,000 pairs are near in bits


@pytest.fixture(scope="module")
def crowd(spark):
    """Texts of a family, without groups but for five, with hashes and fingerprints; and the pairs that are similar and of other groups."""
    texts = family(200, 11)
    rows = frame(spark, texts)
    group = F.when(F.col("node") < 5, F.lit(0).cast("long"))
    found = cut(simhash.prints(rows).join(simhash.sets(rows), "node").withColumn("group", group))
    return found, [(i, j) for i, j in links_of(texts) if j >= 5]


def test_prefixes_lose_no_similar_pair_and_few_others_stay(spark, crowd):
    found, links = crowd
    told = found.select("node", "hashes", "fps", F.coalesce("group", "node").alias("group"))
    fps = {x.node: np.array(x.fps) for x in found.select("node", "fps").collect()}
    near = [(i, j) for i, j in links if (np.bitwise_count((fps[i] ^ fps[j]).view(np.uint64)) <= simhash.KEEP_RADIUS).any()]
    met = [(x.a, x.b) for x in simhash.prefix_meetings(told).collect()]
    assert len(met) == len(set(met)) and set(near) <= set(met) and len(near) > 500
    assert len(met) < 3 * len(near) and not any(b < 5 for _, b in met)
    few = {(x.a, x.b) for x in simhash.prefix_meetings(told, nearest=True).collect()}
    assert few <= set(met) and 0 < len(few) <= 200
    assert {n for p in met for n in p} == {n for p in few for n in p}
    assert simhash.prefix_meetings(told.limit(0)).count() == 0


@pytest.mark.parametrize("long_run", [simhash.LONG_RUN, 5])
def test_far_texts_are_those_of_far_meetings(spark, crowd, monkeypatch, long_run):
    monkeypatch.setattr(simhash, "LONG_RUN", long_run)
    found, _ = crowd
    nodes = cut(found.select(F.col("fps")[0].alias("fp"), "node", "group"))
    plan = simhash.Plan(nodes, 200, simhash.KEEP_RADIUS, simhash.TRAVEL)
    pairs = simhash.far_meetings(nodes, plan).collect()
    told = [x.node for x in simhash.far_texts(nodes, plan).collect()]
    want = {n for x in pairs for n in (x.a, x.b)}
    assert len(pairs) > 1_000 and len(told) == len(set(told))
    assert set(told) == want if long_run > 5 else set(told) >= want


def test_the_largest_group_of_a_hash_comes_first():
    rows = np.zeros(6, simhash.PREFIX_ROW)
    rows["h"], rows["group"], rows["size"] = [7, 7, 7, 7, 3, 3], [1, 2, 2, 4, 9, 9], [5, 8, 6, 1, 2, 1]
    out, run, rest = simhash._largest_group_first(rows)
    assert run.tolist() == [0, 0, 1, 1, 1, 1] and rest.tolist() == [0, 0, 0, 0, 1, 1]
    assert out["size"].tolist() == [1, 2, 6, 8, 1, 5]
    assert all(len(x) == 0 for x in simhash._largest_group_first(rows[:0]))


@pytest.mark.parametrize("task_edges", [10**6, 40])
def test_components_of_few_are_the_components(spark, monkeypatch, task_edges):
    monkeypatch.setattr(common, "TASK_EDGES", task_edges)
    r = random.Random(4)
    edges = [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(250)] + [(k, k + 1) for k in range(1_000, 1_100)] + [(5_000, 4_000), (7, 7)]
    given = spark.createDataFrame(edges, "a long, b long")
    told = [(x.node, x.component) for x in common.components_of_few(given).collect()]
    assert sorted(told) == sorted((x.node, x.component) for x in connected_components(given).collect())
    assert common.components_of_few(given.limit(0)).count() == 0


def test_pairs_no_more_than_a_few_a_text_are_compared_in_one_round(spark, monkeypatch):
    texts, rounds, similar = family(60, 3), [], simhash.similar
    rows = frame(spark, texts)
    pairs = [(i, j) for i, j in combinations(range(60), 2) if j - i <= 3]

    def counted(asked, hashes):
        rounds.append(asked.count())
        return similar(asked, hashes)

    monkeypatch.setattr(simhash, "similar", counted)
    links = simhash.compared(spark.createDataFrame(pairs, "a long, b long"), cut(simhash.sets(rows)), None)
    assert {(x.a, x.b) for x in links.collect()} == set(links_of(texts)) & set(pairs)
    assert rounds == [len(pairs)]
    monkeypatch.setattr(simhash, "AT_ONCE", 0)
    links = simhash.compared(spark.createDataFrame(pairs, "a long, b long"), cut(simhash.sets(rows)), None)
    same = lambda edges: {(x.node, x.component) for x in connected_components(edges).collect()}
    assert len(rounds) > 2 and same(links) == same(spark.createDataFrame(sorted(set(links_of(texts)) & set(pairs)), "a long, b long"))


def test_kinds_of_fingerprints_meet_in_one_pass(spark, crowd):
    found, _ = crowd
    kinds = [cut(found.select(F.col("fps")[k].alias("fp"), "node", "group")) for k in range(simhash.PRINTS)]
    plans = [simhash.Plan(nodes, 200, simhash.KEEP_RADIUS, simhash.TRAVEL) for nodes in kinds]
    met = [(x.a, x.b) for x in simhash.first_meetings(found, *plans).collect()]
    each = {(x.a, x.b) for nodes, plan in zip(kinds, plans, strict=True) for x in simhash.first_meetings(nodes, plan).collect()}
    assert len(met) == len(set(met)) and set(met) == each
    told = [x.node for x in simhash.far_texts(found.select("fps", "node", "group"), *plans).collect()]
    each = {x.node for nodes, plan in zip(kinds, plans, strict=True) for x in simhash.far_texts(nodes, plan).collect()}
    assert len(told) == len(set(told)) and set(told) == each

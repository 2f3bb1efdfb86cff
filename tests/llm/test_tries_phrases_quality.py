"""Conversation tries, collocations and the quality classifier against brute force, odd rows included."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from learnspark.llm import collocations, prefix_trie, quality_classifier
from learnspark.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string, kind string, pos int, a string, level int"


def sha(ids):
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def in_turns(rows):
    """Conversations as lists of (role, text); rows must not tie but where they are equal."""
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append(((turn is not None, turn or 0), role or "", text or ""))
    return {c: [x[1:] for x in sorted(v)] for c, v in out.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for n in members:
        if n:
            children[n[:-1]].append(n)

    def below(n):
        stack, out = [n], []
        while stack:
            out.append(stack.pop())
            stack += children[out[-1]]
        return out

    rows = []
    for n, m in members.items():
        tree = below(n)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in tree if x)
        ends = sorted(c for c in m if len(convs[c]) == len(n))
        rows.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), sum(not children[x] for x in tree), saved, sha(ends)))
    return sorted(map(repr, rows))


def some_turns(seed=5):
    r = random.Random(seed)
    rows = []
    for c in [*range(-12, 60), 900, 901, 905]:
        if c == 905:
            continue
        for t in range(r.choice([0, 1, 2, 5, 9, 12, 30])):
            rows.append((c, t - 1 if t else None, r.choice(["user", None, "bot"]), r.choice(["a", "bé", "", None, "x" * 50])))
    rows += [(901, t, "user", "same") for t in range(40)] + [(902, 3, "u", "eq")] * 5 + [(None, 1, "u", "lost"), (5, None, "z", "first?")]
    rows += [(7, 1000, "u", "y"), (8, 1000, "u", "y")]
    return [r_ for r_ in rows if r_[:3] != (5, None, None)]


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "k", 1, "x", 2) for r in rows], TURNS)


def collected(df):
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())


@pytest.mark.parametrize("block", [4, 1024])
def test_trie(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = [r for r in some_turns() if r != (5, None, "z", "first?")]
    table_of(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    assert collected(QUERIES["op11_prefix_trie"](spark, str(tmp_path))) == trie(rebuilt(in_turns(rows)))


def test_trie_as_it_is(spark):
    rows = [(c, t, "u", f"t{c % (t + 1)}") for c in range(40) for t in range(c % 7)] + [(100, 0, "u", "t0"), (101, 0, "u", "t0")] + [(200 + c, 0, "u", "t0") for c in range(20)]
    assert collected(prefix_trie.prefix_trie(table_of(spark, rows))) == trie(in_turns(rows))


def test_trie_of_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 16)
    rows = [(1, t, "u", "z" * (t % 3)) for t in range(300)] + [(2, t, "u", "z" * (t % 3)) for t in range(150)] + [(3, 0, "u", "x" * 200_000)]
    assert collected(prefix_trie.prefix_trie(table_of(spark, rows))) == trie(in_turns(rows))


def test_ids_of_a_node_are_hashed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "ID_BITS", 2)
    rows = [(c, 0, "u", "same") for c in range(-9, 60)]
    assert collected(prefix_trie.prefix_trie(table_of(spark, rows))) == trie(in_turns(rows))


def test_tie_of_turns_goes_by_role(spark):
    rows = [(1, 0, "b", "x"), (1, 0, "a", "y"), (2, 0, "a", "y"), (2, 1, "b", "x")]
    leaves = [r for r in prefix_trie.prefix_trie(table_of(spark, rows)).collect() if r.n_children == 0]
    assert [(r.depth, r.n_convs, r.saved_tokens) for r in leaves] == [(2, 2, 1)]


def test_paths_hold_each_node_once_in_few_rounds(spark):
    r = random.Random(1)
    rows = [(c, t, "u", r.choice("ab")) for c in range(64) for t in range(9)]
    turns = prefix_trie.positioned(table_of(spark, rows))
    from learnspark.llm.common import cut
    from pyspark.sql import functions as F

    found = cut(prefix_trie.prefixes(prefix_trie.branched(cut(turns), F.lit(0), F.col("conv_id"), 0)))
    nodes = cut(prefix_trie.tree(found))
    paths = prefix_trie.heavy_paths(found, nodes).collect()
    assert len(paths) == len({(p.depth, p.a, p.b) for p in paths}) == nodes.count()
    assert max(p.level for p in paths) <= 6


def test_empty_tables(spark, tmp_path):
    table_of(spark, []).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op11_prefix_trie", "op12_collocations", "op13_quality"):
        assert QUERIES[name](spark, str(tmp_path)).collect() == []


def phrases(rows, least, percent=80, top=2000):
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(lower)):
            w = re.findall("[^ \t]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        good = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        gone = {q for p, c in good.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * c >= percent * counts[q := p[i : i + k]]}
        ranked = []
        for p, a in good.items():
            if p not in gone:
                score, _, left, right = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for rank, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


def some_prose(seed=2):
    r = random.Random(seed)
    words = ["the", "The", "of", "ÀB", "b\x00c", "é", "x", "|", " ", "ĳ"]
    rows = []
    for k in range(300):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "\t", ", ", "\n", ".", "  "]) for _ in range(r.randint(0, 60)))
        rows.append((text, ("en", "de", None, "und")[k % 4]))
    return rows + [(None, "en"), ("", "fr"), (" \t\n", "fr"), ("x " * 5000, "en"), ("one two three four " * 40, "es"), ("one two three four " * 40, "es")]


def test_packed_phrases_are_small_and_whole(spark):
    """What travels between shards and counts is a fraction of its phrases."""
    import pyarrow as pa

    r = random.Random(3)
    texts = [" ".join(f"word{min(r.randint(0, 3000), r.randint(0, 3000))}" for _ in range(2000)) for _ in range(20)]
    shards = collocations.shards_of(spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").coalesce(1))
    want, rows = Counter(w for t in texts for w in t.split()), collocations._counted(shards, 1, 3).collect()
    got = Counter()
    for x in rows:
        words = collocations._unpacked(pa.array([x.packed], pa.binary())).flatten().to_pylist()
        got.update(dict(zip(words, collocations._restored(x.counts, len(words)).tolist(), strict=True)))
    assert got == want and len(rows) == 3
    assert sum(len(x.packed) + len(x.counts) for x in rows) < 0.6 * sum(len(w) + 4 for w in want)


@pytest.mark.parametrize(("size", "least", "top"), [(1_000_000, 30, 2000), (50, 3, 2000), (400, 2, 7)])
def test_collocations(spark, size, least, top):
    rows = some_prose()
    docs = spark.createDataFrame([(t, lang, 1, "s") for t, lang in rows], "text string, lang string, rank int, phrase string").repartition(3)
    found = collocations.collocations(docs, least=least, top=top, size=size).collect()
    assert sorted(tuple(r) for r in found) == phrases(rows, least, top=top)


def test_scores_pass_64_bits(spark):
    big = 5 * 10**15
    counts = spark.createDataFrame([("en", "a", 1, 3 * big), ("en", "b", 1, big), ("en", "a b", 2, big)], "lang string, phrase string, size int, f long")
    assert collocations.scored(counts).first().score == 2_000_000 * big // (4 * big)


def test_bitmaps_cross_chunks_but_not_gaps():
    tokens = np.array([0, 1] * 20 + [-1] + [0, 1] + [-1, 1, 0, -1], np.int32)
    (words, counts), *rest = collocations._phrases(tokens, 2, np.array([0, 1]))
    assert not rest and {(int(a), int(b)): int(n) for a, b, n in zip(*words, counts)} == {(0, 1): 21, (1, 0): 20}
    longer = {tuple(map(int, w)): int(n) for ws, ns in collocations._phrases(tokens, 2, np.array([0, 1]), np.array([1, 0])) for *w, n in zip(*ws, ns)}
    assert longer == {(0, 1, 0): 19, (1, 0, 1): 19, (0, 1, 0, 1): 19, (1, 0, 1, 0): 18}


def test_quality_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in QUERIES["op13_quality"](spark, folder).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(found) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in found.items())
    held = [d for d in labels if found[d].held_out]
    assert sum(found[d].predicted == labels[d] for d in held) >= 0.97 * len(held)
    good, bad = [found[d].score for d in held if labels[d]], [found[d].score for d in held if not labels[d]]
    assert sum(g > b for g in good for b in bad) >= 0.97 * len(good) * len(bad)


DOCS = "doc_id long, text string, x string, fold int, score double"


def docs_of(spark, n=60):
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["word", "other", "text", "more"]) + ("!!" if i % 3 == 0 else "") for _ in range(30)), "q", 1, 0.5) for i in range(n)]
    return spark.createDataFrame([*rows, (None, "free text", "q", 1, 0.1), (500, None, "q", 1, 0.1), (501, "", "q", 1, 0.1), (502, "w " * 100_000, "q", 1, 0.1), (3, "again!!", "q", 1, 0.1)], DOCS)


def test_held_out_labels_teach_nothing(spark):
    docs = docs_of(spark)
    labels = [(i, 0 if i % 3 == 0 else 1) for i in range(60)]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels] + [(None, 0), (1, None)]
    one, two = ({(r.doc_id, r.held_out, round(r.score, 9), r.predicted) for r in quality_classifier.classify(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect()} for x in (labels, flipped))
    assert one == two
    scores = {d: s for d, h, s, _ in one if h and d < 60}
    assert all((s < 0.3) == (d % 3 == 0) for d, s in scores.items())
    assert {h for d, h, _, _ in one if d is None} == {False}


def test_quality_without_labels_and_with_one_kind(spark):
    docs = docs_of(spark)
    assert {r.score for r in quality_classifier.classify(docs, spark.createDataFrame([], "doc_id long, quality int")).collect()} == {0.5}
    for kind in (0, 1):
        labels = spark.createDataFrame([(i, kind) for i in range(60)], "doc_id long, quality int")
        assert {round(r.score, 6) for r in quality_classifier.classify(docs, labels).collect()} == {float(kind)}


def test_normal_equations_are_those_of_all_rows(spark):
    r = np.random.default_rng(0)
    x, y, fold = r.standard_normal((200, len(quality_classifier.STATISTICS))), r.integers(0, 2, 200), r.integers(0, 4, 200)
    rows = spark.createDataFrame([(int(f), [float(v) for v in row], int(k)) for f, row, k in zip(fold, x, y)], "fold int, x array<double>, label int")
    features = quality_classifier.Features(x.mean(0), x.std(0))
    sums = quality_classifier.normal_equations(rows, features)
    assert len(sums) == 12
    for (k, f), (a, b, yy, n) in sums.items():
        z = features(x[fold == f], quality_classifier.WIDTHS[k])
        assert n == (fold == f).sum() and np.allclose(a, z.T @ z) and np.allclose(b, z.T @ y[fold == f]) and yy == y[fold == f].sum()


def test_cosines_approximate_the_kernel():
    r = np.random.default_rng(1)
    x = r.standard_normal((30, len(quality_classifier.STATISTICS)))
    features = quality_classifier.Features(np.zeros(x.shape[1]), np.ones(x.shape[1]))
    z = features(x, 1.0)[:, 1:]
    kernel = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * x.shape[1]))
    assert abs(z @ z.T - kernel).max() < 0.35 and abs(z @ z.T - kernel).mean() < 0.06


def test_isotonic_fit():
    r = np.random.default_rng(3)
    n = r.integers(1, 9, 40)
    ones = np.minimum(n, r.integers(0, 9, 40))
    at, value = quality_classifier.pooled(np.arange(40.0), n, ones)
    assert (np.diff(value) > 0).all() and (np.diff(at) > 0).all()
    fit = np.array([max(min(ones[i : j + 1].sum() / n[i : j + 1].sum() for j in range(k, 40)) for i in range(k + 1)) for k in range(40)])
    assert set(np.round(value, 9)) == set(np.round(fit, 9))

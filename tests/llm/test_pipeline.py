"""The pipeline's stages against brute force, one after the other."""

import zlib

import numpy as np
from pyspark.sql import functions as F
from test_operators import SCHEMA, components_of, make, removed, shingles, some_texts

import corpus_pipeline
from learnspark.llm import quality_rules


def test_stages(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    texts = [*some_texts(), (7000, "Write to someone.else@mail.example.org today " + " ".join(f"z{i}" for i in range(70)))]
    folder = str(tmp_path)
    make(spark, texts).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = {i: t for i, t in texts}

    kept = {}
    for i, t in docs.items():
        m = dict(zip(quality_rules.MEASURES, quality_rules.measure((t or "").encode())))
        if m["n_words"] >= 50 and 2 * m["n_repeat_words"] <= m["n_words"]:
            kept[i] = t
    sets = {i: shingles(t) for i, t in kept.items()}
    group = components_of([(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])], sets)
    firsts = {i for i in kept if group[i] == i}

    frame, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, folder)
        seen[name] = frame = frame.cache()
        if name != "packing":
            assert frame.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    stay = {r.doc_id for r in seen["simhash_dedup"].collect()}
    assert stay == firsts
    gone = removed({i: kept[i] for i in stay})
    cleaned = {r.doc_id: r.text for r in seen["substring_dedup"].collect()}
    assert {i: len(t.encode().split()) for i, t in cleaned.items()} == {i: n - k for i, (n, k, _) in gone.items()}
    private = {r.doc_id: r.text for r in seen["pii_surrogates"].collect()}
    assert {i for i in private if private[i] != cleaned[i]} == {7000} and "someone.else" not in private[7000]
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = seen["packing"].collect()
    for i, t in private.items():
        ids = np.array([*tok.encode(t, add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((r for r in pieces if r.doc_id == i), key=lambda r: r.start)
        assert [r.ids_crc32 for r in mine] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine]
        assert sum(r.length for r in mine) == len(ids)
    assert {r.doc_id for r in pieces} == set(private)
    whole = corpus_pipeline.run(spark, folder)
    assert whole.agg(F.sum("length")).first()[0] == sum(r.length for r in pieces)


def test_empty_tables_and_odd_columns(spark, tmp_path):
    folder = str(tmp_path)
    docs = make(spark, [(1, None), (2, ""), (3, "few words")])
    for name in ("key", "m", "spans", "hits", "told"):
        docs = docs.withColumn(name, F.lit(name))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, folder)
        assert out.count() == 0 or name != "quality_rules"
        assert stage(spark, frame.limit(0), folder).count() == 0
        assert name == "packing" or out.columns == frame.columns
    assert corpus_pipeline.run(spark, folder).count() == 0

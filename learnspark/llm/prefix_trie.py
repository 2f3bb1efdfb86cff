"""The trie of conversations by their first turns, with subtree sums by heavy-path decomposition.

A node is a distinct sequence of first turns; it is named by its depth and two 64-bit XORs of
position-bound hashes of (role, text), a fingerprint of 128 bits. Each node's child with the most
conversations is heavy. The heavy path that ends at a leaf is the part of the leaf's first
conversation below its last light node, so all paths come out of one aggregation. A path is held as
arrays of BLOCK nodes. Rounds go from the paths with the most light edges above them to the root's
path: subtree sums are suffix sums along the path's arrays, and its top's sum is attached to the
parent's place on the path one level up. A light child has at most half of its parent's
conversations, so there are at most log2(conversations) + 1 rounds.

A conversation of any length is fine: turns are numbered by range partitions and prefixes are made
by blocks of positions, so no task holds a whole conversation; nor is any node's list of
conversations held in one place: ids are joined by blocks of ids and hashed in a stream.

Defined results: rows without a conv_id belong to no conversation and are left out; null roles and
texts are empty; turns go by number, null first, equal numbers by role, then by the text's hash; a
repeated row is a turn of its own; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learnspark.llm.common import cut, drop_cut, table

#: Positions of a conversation, and nodes of a path, that are handled together.
BLOCK = 1024
#: Conversation ids that are joined into one text, as a power of two.
ID_BITS = 12

NODE = ["depth", "a", "b"]
SUMS = "path long, block long, nodes array<struct<depth:long,conv_id:long,parent_conv_id:long,n_convs:long,n_children:long,a:long,b:long,saved:long,leaf:long>>, saved array<long>, leaves array<long>"


def positioned(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, k1, k2, n_bytes): turns numbered from 1; k1 and k2 hold 120 bits of the MD5 of (role, text)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    told = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    half = lambda k: F.conv(F.substring("md5", k, 15), 16, 10).cast("long")
    rows = turns.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), told.alias("md5"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = rows.select("conv_id", "turn", "role", half(1).alias("k1"), half(16).alias("k2"), "n_bytes", F.monotonically_increasing_id().alias("any"))
    order = ["turn", "role", "k1", "k2", "any"]  # the last only deals out equal rows
    dealt = cut(rows.repartitionByRange("conv_id", *order).withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("size"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("conv_id", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    local = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    numbered = dealt.withColumn("local", local).join(starts, ["conv_id", "part"])
    return numbered.select("conv_id", (F.col("start") + F.col("local")).alias("pos"), "k1", "k2", "n_bytes")


def branched(turns: DataFrame, first: Column, base: Column, longest: int) -> DataFrame:
    """turns, each conversation's first `first` replaced by those of conversation `base`; `first` is at most `longest`.

    (conv_id, pos, k1, k2, n_bytes, n_turns), and a row at pos 0 for each conversation. turns must be a table.
    """
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("own")).withColumns({"h": first, "base": base})
    heads = turns.where(F.col("pos") <= longest).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "k1", "k2", "n_bytes"))).alias("head"))
    head = F.expr("slice(coalesce(head, array()), 1, cast(h as int))")
    convs = convs.join(heads, "base", "left").withColumn("head", head).withColumn("shift", F.size("head") - F.col("h"))
    convs = cut(convs.withColumn("n_turns", F.size("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))))
    begun = convs.select("conv_id", F.explode("head").alias("x"), "n_turns").select("conv_id", "x.*", "n_turns")
    rest = turns.where(F.col("pos") > first).join(convs.select("conv_id", "shift", "n_turns"), "conv_id")
    rest = rest.select("conv_id", F.col("pos") + F.col("shift"), "k1", "k2", "n_bytes", "n_turns")
    zero = F.lit(0).cast("long")
    return begun.union(rest).union(convs.select("conv_id", zero, zero, zero, zero, "n_turns"))


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, n_bytes, is_end): each conversation's first turns as nodes, with their parents."""
    lanes = {"xa": F.xxhash64(F.lit("a"), "pos", "k1", "k2"), "xb": F.xxhash64(F.lit("b"), "k2", "pos", "k1")}
    rows = turns.withColumns({x: F.when(F.col("pos") > 0, v).otherwise(0) for x, v in lanes.items()}).withColumn("block", F.expr(f"pos div {BLOCK}"))
    sums = rows.groupBy("conv_id", "block").agg(F.bit_xor("xa").alias("sa"), F.bit_xor("xb").alias("sb"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("conv_id", "block", *[F.coalesce(F.bit_xor(s).over(before), F.lit(0)).alias(s) for s in ("sa", "sb")])
    inside = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    all_ = rows.withColumns({"ia": F.bit_xor("xa").over(inside), "ib": F.bit_xor("xb").over(inside)}).join(starts, ["conv_id", "block"])
    a, b = F.col("sa").bitwiseXOR(F.col("ia")), F.col("sb").bitwiseXOR(F.col("ib"))
    return all_.select("conv_id", F.col("pos").alias("depth"), a.alias("a"), b.alias("b"), a.bitwiseXOR(F.col("xa")).alias("pa"), b.bitwiseXOR(F.col("xb")).alias("pb"), "n_bytes", (F.col("pos") == F.col("n_turns")).alias("is_end"))


def tree(found: DataFrame) -> DataFrame:
    """A row for each node of the prefixes: its parent, children and whether it is light; the root is light."""
    nodes = cut(found.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("pa").alias("pa"), F.first("pb").alias("pb"), F.first("n_bytes").alias("n_bytes")))
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    children = children.agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", "a", "b")).alias("heavy"))
    full = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    parents = full.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"), F.col("heavy.a").alias("ha"), F.col("heavy.b").alias("hb"))
    all_ = full.join(parents, ["depth", "pa", "pb"], "left")
    light = ~F.coalesce((F.col("a") == F.col("ha")) & (F.col("b") == F.col("hb")), F.lit(False))
    return all_.select(*NODE, "pa", "pb", "conv_id", "parent_conv_id", "n_convs", "n_children", ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), (F.col("n_children") == 0).cast("long").alias("leaf"), light.alias("light"))


def heavy_paths(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes plus (path, level): a path is named by its leaf's smallest conversation, level counts the light edges above it."""
    ends = nodes.where("n_children = 0").select(F.col("conv_id").alias("path"))
    chain = found.select(F.col("conv_id").alias("path"), *NODE).join(ends, "path")
    chain = chain.join(nodes, NODE)
    tops = chain.where("light").groupBy("path").agg(F.max("depth").alias("top"), (F.count("*") - 1).alias("level"))
    return chain.join(tops, "path").where("depth >= top").drop("top")


def _suffix_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        start = b["nodes"].offsets.to_numpy()
        start, nodes = start - start[0], b["nodes"].flatten()
        size = np.diff(start)
        row = np.repeat(np.arange(len(size)), size)
        added = b["added"]
        at = np.repeat(np.arange(len(size)), added.value_lengths().fill_null(0).to_numpy())
        added = added.flatten()
        place = added.field("depth").to_numpy() - nodes.field("depth").to_numpy()[start[at]] + start[at]
        lists = []
        for own, more in (("saved", "saved"), ("leaf", "leaves")):
            x = nodes.field(own).to_numpy().copy()
            np.add.at(x, place, added.field(more).to_numpy())
            till = np.cumsum(x)
            lists.append(pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(till[start[1:] - 1][row] - till + x, pa.int64())))
        yield pa.record_batch([b["path"], b["block"], b["nodes"], *lists], ["path", "block", "nodes", "saved", "leaves"])


def subtree_sums(paths: DataFrame) -> DataFrame:
    """(depth, a, b, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens) of every node."""
    paths = cut(paths)
    block = F.expr(f"depth div {BLOCK}")
    fields = ["depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "a", "b", "saved", "leaf"]
    arrays = paths.groupBy("level", "path", block.alias("block")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("nodes"))
    tops = paths.where("light and depth > 0").select("level", "path", (F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    above = tops.join(paths.select(*NODE, F.col("path").alias("parent_path")), NODE).select("level", "path", "parent_path", "depth")
    arrays, above = cut(arrays, "level"), cut(above, "level")
    levels = paths.agg(F.max("level")).first()[0]
    drop_cut(paths)
    found, attached = [], None
    for level in range(-1 if levels is None else levels, -1, -1):
        rows = arrays.where(F.col("level") == level).select("path", "block", "nodes")
        if attached is None:
            rows = rows.withColumn("added", F.expr("cast(null as array<struct<depth:bigint,saved:bigint,leaves:bigint>>)"))
        else:
            rows = rows.join(attached, ["path", "block"], "left")
        sums = rows.mapInArrow(_suffix_sums, SUMS)
        first = [F.element_at(c, 1).alias(f"{c}_all") for c in ("saved", "leaves")]
        later = Window.partitionBy("path").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
        rest = [F.coalesce(F.sum(f"{c}_all").over(later), F.lit(0)).alias(f"{c}_after") for c in ("saved", "leaves")]
        done = cut(sums.select("*", *first).select("*", *rest))
        found.append(done)
        totals = done.groupBy("path").agg(F.sum("saved_all").alias("saved"), F.sum("leaves_all").alias("leaves"))
        up = totals.join(above.where(F.col("level") == level), "path").groupBy(F.col("parent_path").alias("path"), "depth").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
        attached = up.groupBy("path", block.alias("block")).agg(F.collect_list(F.struct("depth", "saved", "leaves")).alias("added"))
    if not found:
        found = [paths.sparkSession.createDataFrame([], SUMS + ", saved_after long, leaves_after long")]
    every = None
    for done in found:
        x = done.select("saved_after", "leaves_after", F.explode(F.arrays_zip("nodes", "saved", "leaves")).alias("x"))
        every = x if every is None else every.union(x)
    n = F.col("x.nodes")
    columns = [n[c].alias(c) for c in (*NODE, "conv_id", "parent_conv_id", "n_convs", "n_children")]
    return every.select(*columns, (F.col("x.leaves") + F.col("leaves_after")).alias("n_leaves"), (F.col("x.saved") + F.col("saved_after")).alias("saved_tokens"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, state = None, None
    schema = pa.schema([*((c, pa.int64()) for c in NODE), ("ends_sha256", pa.string())])
    for b in batches:
        out = []
        for *node, text in zip(*(b[c].to_pylist() for c in (*NODE, "ids")), strict=True):
            if node != last:
                if state:
                    out.append((*last, state.hexdigest()))
                last, state = node, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((*last, state.hexdigest()), schema, strict=True)], schema=schema)


def ends(found: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of nodes where conversations end: the hash of their ids, ascending, joined by commas."""
    ids = found.where("is_end").groupBy(*NODE, F.shiftright("conv_id", ID_BITS).alias("part")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    return ids.repartition(*NODE).sortWithinPartitions(*NODE, "part").mapInArrow(_hashed, "depth long, a long, b long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """A row for each node of turns (conv_id, pos, k1, k2, n_bytes, n_turns), which have a row at pos 0 for each conversation."""
    found = cut(prefixes(turns))
    nodes = cut(tree(found))
    sums = subtree_sums(heavy_paths(found, nodes))
    out = sums.join(ends(found), NODE, "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of conversations as they are."""
    turns = cut(positioned(conversations, id_col, turn_col, role_col, text_col))
    return trie(branched(turns, F.lit(0), F.col("conv_id"), 0))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = cut(positioned(table(spark, sf_dir, "conversations")))
    first = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    return trie(branched(turns, first, F.col("conv_id") - F.col("conv_id") % 5, 8))

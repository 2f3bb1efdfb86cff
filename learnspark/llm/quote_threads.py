"""Quotation linking: conversations in reply order, without the quotes.

A line's quote level is the number of '>' at its start. Neighbouring lines of one level above zero
are a passage. A passage and the messages' own text are normalised (quote marks gone, white space
runs to one space, ASCII lower case) and hashed: each message offers its whole own text, its
paragraphs, its lines and its runs of neighbouring lines (blank ones aside) as originals. Runs are
offered in the lengths that the conversation's passages have, so offers are lines times lengths. A passage links to the first earlier message of its
conversation that offers it. A message replies to the latest message it quotes at its lowest linked
level, or else to the turn before. Where it quotes, a branch starts; branches are ordered so that
each follows the branch it replies to, and messages by (branch path, turn).

Defined results: a null or blank text stays as it is, without passages; a message of quotes only keeps the
empty string; passages without an original are removed too and counted as unlinked; messages with
the same turn count as one place and share its links; a null turn or conversation links to
nothing and has no parent; an empty table gives an empty result; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from learnspark.llm.common import cut, drop_cut, table

MARKS = r"^((?:[ \t]?>)+)[ \t]?"
#: Turns numbered in one window partition.
BLOCK_TURNS = 1024


def normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), r"[\x20\x09-\x0D]+", " "))


def parsed(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text) plus `own` (text without quotes) and `quotes`, array<struct<level, passage>>."""
    level = lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), r"[^>]", ""))
    lines = F.transform(F.split("text", "\r?\n"), lambda x: F.struct(level(x).alias("level"), F.regexp_replace(x, MARKS, "").alias("line")))
    none = F.array().cast("array<struct<level:int,passage:string>>")

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(x["level"].alias("level"), F.concat(last["passage"], F.lit("\n"), x["line"]).alias("passage"))
        new = F.struct(x["level"].alias("level"), x["line"].alias("passage"))
        return F.when((F.size(done) > 0) & (F.try_element_at(done, F.lit(-1))["level"] == x["level"]), F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.when(F.size(done) > 0, joined).otherwise(new)))).otherwise(F.concat(done, F.array(new)))

    quoted = F.col("text").rlike(r"(?m)" + MARKS)
    blocks = F.when(quoted, F.aggregate(lines, none, add)).otherwise(none)
    out = messages.select("conv_id", "turn", "role", "text").withColumn("_blocks", blocks)
    own = F.when(quoted, F.trim(F.array_join(F.transform(F.filter("_blocks", lambda b: b["level"] == 0), lambda b: b["passage"]), "\n"))).otherwise(F.col("text"))
    return out.withColumn("own", own).withColumn("quotes", F.filter("_blocks", lambda b: (b["level"] > 0) & (normal(b["passage"]) != ""))).drop("_blocks")


def _line_hashes(c: Column) -> Column:
    return F.transform(F.filter(F.transform(F.split(c, "\n"), normal), lambda x: x != ""), F.md5)


def _run(line_hashes: Column) -> Column:
    return F.sha2(F.array_join(line_hashes, " "), 256)


def _first_runs(messages: DataFrame, said: DataFrame) -> DataFrame:
    """(c4, r4, run_origin): the first turn that holds each asked run of two lines or more."""
    sizes = said.where("run is not null").select(F.col("conv_id").alias("c5"), "size").distinct()
    held = messages.select("conv_id", "turn", _line_hashes(F.col("own")).alias("lines"))
    held = held.join(sizes, (F.col("conv_id") == F.col("c5")) & (F.size("lines") >= F.col("size")))
    starts = F.sequence(F.lit(1), F.size("lines") - F.col("size") + 1)
    runs = held.select("conv_id", "turn", F.explode(F.array_distinct(F.transform(starts, lambda i: _run(F.slice("lines", i, F.col("size")))))).alias("r"))
    return runs.groupBy(F.col("conv_id").alias("c4"), F.col("r").alias("r4")).agg(F.min("turn").alias("run_origin"))


def links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, level, hash, origin): each quoted passage and the first earlier turn that offers it, or null."""
    said = messages.where("quotes is not null and size(quotes) > 0").select("conv_id", "turn", F.explode("quotes").alias("q"))
    said = said.select("conv_id", "turn", F.col("q.level").alias("level"), F.sha2(normal(F.col("q.passage")), 256).alias("hash"), _line_hashes(F.col("q.passage")).alias("lines"))
    said = said.select("conv_id", "turn", "level", "hash", F.size("lines").alias("size"), F.when(F.size("lines") > 1, _run(F.col("lines"))).alias("run")).distinct()
    # only conversations with quotes offer originals
    asked = said.select(F.col("conv_id").alias("c2"), F.col("hash").alias("h2")).distinct()
    offers = F.array_distinct(F.concat(F.array("own"), F.split("own", r"\n[ \t]*\n"), F.split("own", "\n")))
    offered = messages.join(asked.select(F.col("c2")).distinct(), F.col("conv_id") == F.col("c2"), "left_semi").select("conv_id", "turn", F.explode(offers).alias("o"))
    first = offered.groupBy(F.col("conv_id").alias("c3"), F.sha2(normal(F.col("o")), 256).alias("h3")).agg(F.min("turn").alias("origin"))
    found = said.join(first, (F.col("conv_id") == F.col("c3")) & (F.col("hash") == F.col("h3")), "left")
    runs = _first_runs(messages, said)
    found = found.join(runs, (F.col("conv_id") == F.col("c4")) & (F.col("run") == F.col("r4")), "left")
    origin = F.least("origin", "run_origin")
    found = found.withColumn("origin", F.when(origin < F.col("turn"), origin))
    # passages that differ in line ends only are one
    return found.groupBy("conv_id", "turn", "level", "hash").agg(F.min("origin").alias("origin"))


def threads(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, parent_turn, n_quotes, n_linked, branch, text): text without quotes; branch: the turns that start the branches down to the message's own."""
    m = cut(parsed(messages))
    found = cut(links(m))
    by_level = found.groupBy("conv_id", "turn", "level").agg(F.max("origin").alias("origin"), F.count("*").alias("n"), F.count("origin").alias("k"))
    heads = by_level.groupBy(F.col("conv_id").alias("c"), F.col("turn").alias("t")).agg(F.min(F.when(F.col("origin").isNotNull(), F.struct("level", "origin")))["origin"].alias("to"), F.sum("n").alias("n_quotes"), F.sum("k").alias("n_linked"))
    heads = cut(heads)
    places = m.groupBy("conv_id", "turn").agg(F.count("*").alias("rows")).join(heads, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left").drop("c", "t", "rows")
    # the turn before and the start of the branch: within blocks of turns, then over the blocks
    block = F.floor(F.col("turn") / BLOCK_TURNS)
    places = cut(places.withColumn("block", block))
    carried = places.groupBy("conv_id", "block").agg(F.max("turn").alias("turn"), F.max(F.when(F.col("to").isNotNull(), F.col("turn"))).alias("head"))
    past = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.max("turn").over(past).alias("last_turn"), F.max("head").over(past).alias("last_head"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn")
    here = places.withColumn("before", F.lag("turn").over(inside)).withColumn("head", F.max(F.when(F.col("to").isNotNull(), F.col("turn"))).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    here = here.join(carried, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")), "left")
    here = here.select("conv_id", "turn", "to", F.coalesce("to", "before", "last_turn").alias("parent_turn"), F.coalesce("head", "last_head").alias("head"), "n_quotes", "n_linked")
    here = cut(here)
    paths = _paths(here)
    told = here.join(paths, F.col("conv_id").eqNullSafe(F.col("pc")) & F.col("head").eqNullSafe(F.col("ph")), "left").drop("pc", "ph")
    told = told.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.when(F.col("turn").isNotNull() & F.col("conv_id").isNotNull(), F.col("parent_turn")).alias("parent_turn"), "n_quotes", "n_linked", F.coalesce("path", F.array().cast("array<long>")).alias("branch"))
    out = m.join(told, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")))
    return out.select("conv_id", "turn", "role", "parent_turn", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).alias("n_linked"), "branch", F.col("own").alias("text"))


def _paths(places: DataFrame) -> DataFrame:
    """(pc, ph, path) for each branch start ph: the branch starts from the conversation's first branch down to it.

    A branch starts at a turn that quotes; the branch it replies to is the one of the quoted turn.
    Paths double in length each round, so rounds grow with the logarithm of the deepest nesting.
    """
    starts = places.where("to is not null").select(F.col("conv_id").alias("pc"), F.col("turn").alias("ph"), "to")
    quoted = places.select(F.col("conv_id").alias("qc"), F.col("turn").alias("qt"), F.col("head").alias("up"))
    paths = cut(starts.join(quoted, (F.col("pc") == F.col("qc")) & (F.col("to") == F.col("qt"))).select("pc", "ph", "up", F.array("ph").alias("path")))
    while not paths.where("up is not null").isEmpty():
        above = paths.select(F.col("pc").alias("ac"), F.col("ph").alias("ah"), F.col("up").alias("aup"), F.col("path").alias("apath"))
        joined = paths.join(above, (F.col("pc") == F.col("ac")) & (F.col("up") == F.col("ah")), "left")
        longer = cut(joined.select("pc", "ph", F.col("aup").alias("up"), F.when(F.col("apath").isNotNull(), F.concat("apath", "path")).otherwise(F.col("path")).alias("path")))
        drop_cut(paths)
        paths = longer
    return paths.select("pc", "ph", "path")


def op1_quote_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return threads(table(spark, sf_dir, "conversations"))

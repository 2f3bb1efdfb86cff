"""Segmentation of page texts: offsets, as-of lookups, forward fill, marker interpolation, lines, markers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from learnspark.functions import choices as C
from learnspark.functions import tables as T
from learnspark.functions import text as X


def pages(docs: DataFrame, id_col: str, text_col: str, mark: str = "\n") -> DataFrame:
    """(id, page, start, length, text): parts of a text between marks, with their offsets from 0."""
    w = Window.partitionBy(id_col).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    p = docs.select(id_col, F.posexplode(F.split(text_col, mark)).alias("page", "text")).withColumn("page", F.col("page") + 1)
    return p.withColumn("length", F.length("text")).withColumn("start", F.coalesce(F.sum(F.col("length") + 1).over(w), F.lit(0)))


def page_asof(offsets: DataFrame, starts: DataFrame, id_col: str) -> DataFrame:
    """(id, offset, page): the last page that starts at or before the offset; page 1 where there is none."""
    near = offsets.join(starts.select(id_col, "page", "start"), id_col, "left").where("start is null or start <= offset")
    return near.groupBy(id_col, "offset").agg(F.coalesce(F.max_by("page", "start"), F.lit(1)).alias("page"))


def page_at(text: Column, offset: Column, mark: str = "\n") -> Column:
    """The page of an offset into the text itself: one more than the marks before it. Nothing is exploded or shuffled."""
    head = F.left(text, offset.cast("int"))
    return 1 + F.length(head) - F.length(F.replace(head, F.lit(mark), F.lit("")))


def forward_fill(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(value, F.last(value, ignorenulls=True).over(w))


def interpolated(markers: DataFrame, id_col: str, most: int = 3) -> DataFrame:
    """(id, number, position) with numbers missing between neighbours up to `most` apart put in on a line, rounded down."""
    w = Window.partitionBy(id_col).orderBy("number")
    n = markers.select(id_col, "number", "position", F.lead("number").over(w).alias("n2"), F.lead("position").over(w).alias("p2"))
    gap = F.when((F.col("n2") - F.col("number")).between(2, most), F.sequence(F.col("number") + 1, F.col("n2") - 1))
    at = lambda k: F.col("position") + ((F.col("p2") - F.col("position")) * (k - F.col("number")) / (F.col("n2") - F.col("number"))).cast("long")
    new = F.transform(gap, lambda k: F.struct(k.alias("number"), at(k).alias("position")))
    own = F.array(F.struct("number", "position"))
    return n.select(id_col, F.explode(F.when(gap.isNotNull(), F.concat(own, new)).otherwise(own)).alias("x")).select(id_col, "x.*")


def distinct_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_lines, n_kept, text): without lines equal to the line before."""
    lines = F.split(text_col, "\n")
    kept = F.filter(lines, lambda x, i: (i == 0) | (x != F.element_at(lines, F.greatest(i, F.lit(1)))))
    return docs.select(id_col, F.size(lines).alias("n_lines"), F.size(kept).alias("n_kept"), F.array_join(kept, "\n").alias("text"))


def merged_bodies(parts: DataFrame, key: list[str], order: str, text: str) -> DataFrame:
    """Bodies of the same key appended in page order; a question has a few parts."""
    pairs = F.array_sort(F.collect_list(F.struct(order, text)))
    return parts.groupBy(*key).agg(F.array_join(F.transform(pairs, lambda x: x[text]), "\n").alias(text))


def fullest(parsed: DataFrame, key: list[str], order: str) -> DataFrame:
    """Of repeated questions the one with most choices, the first of equals."""
    return parsed.groupBy(*key).agg(F.max_by(F.struct(*[c for c in parsed.columns if c not in key]), F.struct(F.size("choices"), -F.col(order))).alias("x")).select(*key, "x.*")


#: A number mark: one or two digits and a dot, apart from other numbers.
MARK = r"\d(?<![\d.]\d)\d?\.(?!\d)"


def markers(docs: DataFrame, id_col: str, text_col: str, low: int, high: int) -> DataFrame:
    """(id, number, position): the first place of each number mark "n." from `low` on, after the first mark of `low`.

    A mark's place is the length of the marks before it and of the texts between them.
    """
    text = F.col(text_col)
    marks, between = F.regexp_extract_all(text, F.lit(MARK), 0), F.transform(F.split(text, MARK, -1), lambda y: F.length(y))
    both = F.arrays_zip(marks.alias("mark"), F.slice(between, F.lit(1), F.size(marks)).alias("gap"))
    one = docs.where(F.col(id_col).isNotNull()).select(id_col, F.posexplode(both).alias("at", "x")).select(id_col, "at", "x.mark", "x.gap", F.length("x.mark").alias("size"))
    before = Window.partitionBy(id_col).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    placed = one.select(id_col, F.rtrim("mark", F.lit(".")).cast("int").alias("number"), (F.sum(F.col("gap") + F.col("size")).over(before) - F.col("size")).alias("position"))
    start = F.min(F.when(F.col("number") == low, F.col("position"))).over(Window.partitionBy(id_col))
    found = placed.where(F.col("number").between(low, high)).withColumn("start", start).where("position >= start")
    return found.groupBy(id_col, "number").agg(F.min("position").alias("position"))


def bodies(docs: DataFrame, marks: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, number, body): from each mark to the next, the last to the text's end."""
    w = Window.partitionBy(id_col).orderBy("position")
    spans = marks.withColumn("stop", F.lead("position").over(w))
    t = docs.select(id_col, text_col).join(spans, id_col)
    size = F.coalesce(F.col("stop"), F.length(text_col)) - F.col("position")
    return t.select(id_col, "number", F.trim(F.col(text_col).substr((F.col("position") + 1).cast("int"), size.cast("int"))).alias("body"))


def choices(body, marks: str = "①②③④⑤"):
    """The texts after the circled marks, empty unless there are as many as marks."""
    parts = F.filter(F.transform(F.slice(F.split(body, f"[{marks}]"), 2, len(marks) + 1), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    return F.when(F.size(parts) == len(marks), parts).otherwise(F.array().cast("array<string>"))


def stem(body, marks: str = "①②③④⑤"):
    above = F.split(body, f"[{X.ANY_MARK if marks == X.CHOICE_MARKS else marks}]", 2)[0]
    return F.trim(F.regexp_replace(above, r"^\d{1,2}\.\s*", ""))


def with_choices(questions: DataFrame, body: str) -> DataFrame:
    """questions plus (strategy, choices, grid, markdown, rest): the choices of each body by the first strategy that reads five,
    its table, a grid of choices first, and the body without the table. None of these names may be in questions.

    A strategy is tried only where those before it failed. Explode the choices with an outer explode: for an inner one Spark
    pushes a filter on them below all strategies, which copies them.
    """
    text = F.col(f"`{body}`")
    rows = questions.withColumns({"names_": C.headers(text), "tail_": C.from_choices(text), "table_": T.table(text)})
    rows = rows.withColumns({"lines_": C.tail_lines(F.col("tail_")), "cells_": C.grid_cells(F.col("tail_"))})
    rows = rows.withColumn("blocks_", C.blocks(F.col("lines_")))
    read, found = C.Body(body, "names_", "tail_", "lines_", "blocks_", "cells_"), F.lit(None).cast("array<string>")
    strategy = F.lit(None).cast("string")
    rows = rows.withColumns({"strategy": strategy, "choices": found})
    for name, way in C.STRATEGIES:
        rows = rows.withColumn("tried_", F.when(F.col("strategy").isNull(), way(read)))
        rows = rows.withColumns({"choices": F.coalesce("choices", "tried_"), "strategy": F.when(F.col("tried_").isNotNull(), name).otherwise(F.col("strategy"))})
    grid = C.grid_table(read, F.col("strategy"))
    rows = rows.withColumns({"choices": F.coalesce(C.whole_texts(F.col("choices"), read), F.array().cast("array<string>")), "grid_": grid})
    columns = [F.col(f"`{c}`") for c in questions.columns]
    return rows.select(*columns, "strategy", "choices", F.coalesce("grid_", "table_.grid").alias("grid"), F.when(F.col("grid_").isNull(), F.col("table_.markdown")).alias("markdown"), "table_.rest")


def table_rows(text):
    """Rows of cells of the lines with two cells or more (tabs or runs of spaces apart)."""
    rows = F.transform(F.split(text, "\n"), lambda x: F.filter(F.transform(F.split(F.trim(x), r"\t|\s{2,}"), lambda y: F.trim(y)), lambda c: c != ""))
    return F.filter(rows, lambda r: F.size(r) >= 2)


def markdown_table(text):
    rows = table_rows(text)
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(rows[0], lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, 2, 1_000_000), line)
    return F.when(F.size(rows) >= 2, F.array_join(F.concat(F.array(line(rows[0]), rule), body), "\n"))


def longest_common(pairs: DataFrame, a: str, b: str, least: int = 21) -> DataFrame:
    """pairs plus `lcs`: the length of the longest common substring where it is `least` or more, else 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.assign(lcs=[_common(x or "", y or "", least) for x, y in zip(p[a], p[b], strict=True)])

    return pairs.mapInPandas(run, StructType(pairs.schema.fields[:]).add("lcs", "long"))


def coverage(stem: Column, whole: Column, least: int = 21) -> Column:
    """Containment, else the longest common substring of `least` or more as a share of the normalised whole; 0 for nulls."""
    a, b = X.normal(stem), X.normal(whole)
    return _covered(_told(a, b, least), a, b, least)


def with_coverage(rows: DataFrame, name: str, stem: Column, whole: Column, least: int = 21) -> DataFrame:
    """rows with their `coverage`; both texts are normalised once. The columns `a_`, `b_` and `told_` must not be there."""
    rows = rows.withColumns({"a_": X.normal(stem), "b_": X.normal(whole)})
    rows = rows.withColumn("told_", _told(F.col("a_"), F.col("b_"), least))
    return rows.withColumn(name, _covered(F.col("told_"), F.col("a_"), F.col("b_"), least)).drop("a_", "b_", "told_")


def _told(a: Column, b: Column, least: int) -> Column:
    """The coverage, null where the longest common substring has to be looked for."""
    n, m = F.length(a), F.length(b)
    inside = F.when(n == 0, 0.0).when(m == 0, 1.0).when(a.isNull() | b.isNull(), 0.0).when(b.contains(a), n / m)
    return F.coalesce(inside, F.when(F.least(n, m) < least, 0.0).when(a.contains(b), 1.0))


def _covered(told: Column, a: Column, b: Column, least: int) -> Column:
    """What is told, else looked for; other texts do not go to Python."""

    @F.pandas_udf("double")
    def shared(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([0.0 if x is None or y is None else _common(x, y, least) / len(y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.coalesce(told, shared(F.when(told.isNull(), a), F.when(told.isNull(), b)))


def _common(x: str, y: str, least: int) -> int:
    """By a suffix automaton of the shorter text that reads the longer one: linear in both lengths."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) < least:
        return 0
    if x in y:
        return len(x)
    after: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in x:
        new, p = len(after), last
        after.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p >= 0 and c not in after[p]:
            after[p][c] = new
            p = link[p]
        if p >= 0:
            q = after[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(after)
                after.append(dict(after[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and after[p].get(c) == q:
                    after[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    state = size = best = 0
    for c in y:
        while state and c not in after[state]:
            state = link[state]
            size = length[state]
        if c in after[state]:
            state, size = after[state][c], size + 1
            best = max(best, size)
    return best if best >= least else 0

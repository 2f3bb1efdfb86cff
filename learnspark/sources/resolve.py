"""Which file holds a year's exam or answers: chosen from a file listing by kind, name and what the file has.

Listings are (path, length) rows; nothing is opened but what the answers' count and the probes need.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of exam files, the first that there is; kinds of answer files; characters of a text layer.
EXAM_KINDS = ("hwp", "pdf")
ANSWER_KINDS = ("pdf", "hwp")
TEXT_LAYER = 800


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the files under a folder; their contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")


def _named(files: DataFrame) -> DataFrame:
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumns({"name": name, "stem": F.regexp_replace(name, r"\.[^.]*$", ""), "kind": F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))})


def exam_sources(files: DataFrame, years: DataFrame) -> DataFrame:
    """(year, path, kind): of the files named by the year alone the one of the first kind; null where there is none."""
    order = F.array_position(F.array(*map(F.lit, EXAM_KINDS)), F.col("kind"))
    own = _named(files).where(F.col("kind").isin(*EXAM_KINDS) & F.col("stem").rlike(r"^\d{4}$"))
    best = own.groupBy(F.col("stem").cast("int").alias("year")).agg(F.min(F.struct(order.alias("order"), "path", "kind")).alias("x"))
    return years.select("year").distinct().join(best, "year", "left").select("year", "x.path", "x.kind")


def answer_sources(files: DataFrame, keys: DataFrame, years: DataFrame) -> DataFrame:
    """(year, json_path, json_count, source_path, source_kind): the key file of each year with the number of its answers (keys:
    year, number, answer), and the first other file, by path, whose name has the year."""
    named = _named(files)
    jsons = named.where((F.col("kind") == "json") & F.col("stem").rlike(r"^\d{4}$")).groupBy(F.col("stem").cast("int").alias("year")).agg(F.min("path").alias("json_path"))
    counts = keys.where("answer is not null").groupBy("year").agg(F.count("*").alias("n"))
    mentions = F.explode(F.array_distinct(F.regexp_extract_all("name", F.lit(r"(?=(\d{4}))"), 1)))
    others = named.where(F.col("kind").isin(*ANSWER_KINDS)).select("path", "kind", mentions.alias("y"))
    first = others.groupBy(F.col("y").cast("int").alias("year")).agg(F.min(F.struct("path", "kind")).alias("x"))
    rows = years.select("year").distinct().join(jsons, "year", "left").join(counts, "year", "left").join(first, "year", "left")
    count = F.when(F.col("json_path").isNotNull(), F.coalesce("n", F.lit(0))).otherwise(0)
    return rows.select("year", "json_path", count.cast("long").alias("json_count"), F.col("x.path").alias("source_path"), F.col("x.kind").alias("source_kind"))


def caches(files: DataFrame, years: DataFrame) -> DataFrame:
    """(year, path): the first text `<year>-*.txt` of an earlier reading."""
    own = _named(files).where((F.col("kind") == "txt") & F.col("stem").rlike(r"^\d{4}-"))
    return years.select("year").distinct().join(own.groupBy(F.left("stem", F.lit(4)).cast("int").alias("year")).agg(F.min("path").alias("path")), "year", "left")


def has_text_layer(pages: DataFrame, key: str, text: str, least: int = TEXT_LAYER) -> DataFrame:
    """(key, text_layer): whether the pages of a file have `least` characters together, blanks at its ends left out."""
    return pages.groupBy(key).agg((F.length(F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", text))), lambda x: x[text]), ""))) >= least).alias("text_layer"))


def read_by_kind(spark: SparkSession, chosen: DataFrame, readers: Mapping[str, Callable[[SparkSession, Sequence[str]], DataFrame]]) -> DataFrame | None:
    """The texts of all chosen files (kind, path), each kind by its reader; a kind without a reader is an error that names it."""
    paths: dict[str, list[str]] = {}
    for r in chosen.where("path is not null").select("kind", "path").distinct().collect():  # a row a file of an exam year
        paths.setdefault(r.kind, []).append(r.path)
    if unknown := sorted(set(paths) - set(readers)):
        raise ValueError(f"no reader for {unknown}")
    out = None
    for kind, own in sorted(paths.items()):
        part = readers[kind](spark, sorted(own))
        out = part if out is None else out.unionByName(part)
    return out


def cascaded(sources: Sequence[DataFrame]) -> DataFrame:
    """(year, number, answer, source): of answers (year, number, answer) from several sources, the best first, that of the first that has one."""
    rows = None
    for k, s in enumerate(sources):
        part = s.where("answer is not null").select("year", "number", "answer", F.lit(k).alias("source"))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy("year", "number").agg(F.min(F.struct("source", "answer")).alias("x"))
    return best.select("year", "number", "x.answer", "x.source")

"""Readers and writers for the model's own file formats: JSON tables, answer keys, page texts, manifests."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUESTION = (
    "struct<questionId:string,year:int,subjectId:string,chapterId:string,patternId:string,difficulty:string,originalQuestion:string,question:string,"
    "choices:array<string>,answer:int,answerIndex:int,questionType:string,hasTable:boolean,hasCalculation:boolean,figure:boolean,`table`:string,formula:string,"
    "source:struct<type:string,examId:string,year:int,round:int,examRound:int,questionNumber:int,sourceFile:string,sourceKind:string,page:int,usedOcr:boolean>>"
)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that driver and executors share.

    Where it is unset, a local session makes a temporary one; on a cluster that is an error, since a
    machine's own folder is no shared one.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="learnspark-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df, written once to the shared folder and read back by all who need it."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of the complete versions v0, v1, ... of a table under path, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [str(x.getPath()) for x in fs.listStatus(root)] if fs.exists(root) else []
    numbered = [(int(f.rsplit("/v", 1)[1]), f) for f in found if f.rsplit("/v", 1)[-1].isdigit()]
    return sorted((n, f) for n, f in numbered if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{f}/_SUCCESS")))


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def questions_json(spark: SparkSession, path: str) -> DataFrame:
    """Question rows from a JSON file that holds an array of them or an object {questions: [...]}."""
    raw = spark.read.text(path, wholetext=True)
    wrapped = F.from_json("value", f"struct<questions:array<{QUESTION}>>")["questions"]
    bare = F.from_json("value", f"array<{QUESTION}>")
    rows = F.when(F.ltrim("value").startswith("["), bare).otherwise(wrapped)
    return raw.select(F.explode(rows).alias("q")).where("q is not null").select("q.*")


def answer_keys(spark: SparkSession, path: str, low: int = 41, high: int = 80) -> DataFrame:
    """(year, number, answer) from {"41": 2, ...} files named by year; keys from '_' and nulls are comments."""
    raw = spark.read.text(path, wholetext=True).select("value", F.regexp_extract(F.input_file_name(), r"((?:19|20)\d\d)[^/]*$", 1).alias("year"))
    rows = raw.select(F.expr("try_cast(year as int)").alias("year"), F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))
    return rows.select("year", F.expr("try_cast(key as int)").alias("number"), F.expr("try_cast(value as int)").alias("answer")).where(F.col("number").between(low, high) & F.col("answer").isNotNull())


def answer_cascade(sources: DataFrame) -> DataFrame:
    """One answer for each (year, number): that of the source with the least priority number."""
    return sources.groupBy("year", "number").agg(F.min(F.struct("priority", "answer"))["answer"].alias("answer"))


def years_in(spark: SparkSession, path: str) -> DataFrame:
    """Distinct years in the file names under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    return files.select(F.expr("try_cast(regexp_extract(path, '((?:19|20)\\\\d\\\\d)[^/]*$', 1) as int)").alias("year")).where("year is not null").distinct()


def page_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, page, text): text files cut into pages at form feeds, pages from 1."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return raw.select("path", F.posexplode(F.split("value", "\f")).alias("page", "text")).withColumn("page", F.col("page") + 1)


def frozen_files(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(name, expected, actual, ok): SHA-256 of files against a manifest (name, sha256)."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("actual"))
    joined = manifest.join(files, "name", "left")
    return joined.select("name", F.col("sha256").alias("expected"), "actual", F.coalesce(F.col("sha256") == F.col("actual"), F.lit(False)).alias("ok"))


def terms(spark: SparkSession, path: str, name: str) -> list[str]:
    """The quoted texts of the list `name = [...]` in a source file, longest first; a dictionary of a bounded size."""
    raw = spark.read.text(path, wholetext=True)
    body = F.regexp_extract("value", rf"(?s)\b{name}\s*=\s*\[(.*?)\];", 1)
    rows = raw.select(F.explode(F.regexp_extract_all(body, F.lit("'([^']+)'"), 1)).alias("t")).distinct()
    return [r.t for r in rows.orderBy(F.desc(F.length("t")), "t").collect()]


def verified_ids(spark: SparkSession, folder: str, prefix: str = "ACC_") -> DataFrame:
    """(question_id): the ids that the names of the JSON files of a folder hold."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*.json").load(folder).select("path")
    return files.select(F.regexp_extract("path", r"([^/]+)\.json$", 1).alias("question_id")).distinct()


def stored_keys(spark: SparkSession, folder: str) -> list[str]:
    """The names of the tables kept under a folder, one a key."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(x.getPath().getName() for x in fs.listStatus(root) if x.isDirectory()) if fs.exists(root) else []


def remove_key(spark: SparkSession, folder: str, key: str) -> None:
    """Removes the table kept under a key; nothing happens where there is none."""
    remove(spark, f"{folder}/{key}")


def sessions(raw: DataFrame) -> DataFrame:
    """(date, durationMinutes) from a JSON column `value` of any of three shapes: an array, {sessions}, or {sessions, totalMinutes}."""
    kind = "array<struct<date:date,durationMinutes:double>>"
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", kind)).otherwise(F.from_json("value", f"struct<sessions:{kind}>")["sessions"])
    return raw.select(F.explode(rows).alias("s")).where("s is not null").select("s.*")


def session_total(raw: DataFrame) -> DataFrame:
    """One row `minutes`: the stated totals, or else the sum of the sessions."""
    kind = "array<struct<date:date,durationMinutes:double>>"
    whole = F.from_json("value", f"struct<sessions:{kind},totalMinutes:double>")
    rows = F.when(F.ltrim("value").startswith("["), F.from_json("value", kind)).otherwise(whole["sessions"])
    own = F.aggregate(rows, F.lit(0.0), lambda a, x: a + F.coalesce(x["durationMinutes"], F.lit(0.0)))
    stated = F.when(~F.ltrim("value").startswith("["), whole["totalMinutes"])
    return raw.select(F.coalesce(stated, own, F.lit(0.0)).alias("m")).agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("minutes"))


def write_table(df: DataFrame, path: str, form: str = "parquet") -> None:
    df.write.mode("overwrite").format(form).save(path)


def write_larger(df: DataFrame, path: str, spark: SparkSession) -> bool:
    """Replaces a cached table only by one with more rows; True where it did."""
    try:
        held = spark.read.parquet(path).count()
    except Exception as e:  # no table yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = -1
    if df.count() <= held:
        return False
    write_table(df, path)
    return True


def markdown(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A small report table as Markdown; it is a report, so at most `limit` rows are shown, and a last line says where there are more."""
    rows = df.limit(limit + 1).collect()
    more, rows = len(rows) > limit, rows[:limit]
    cells = lambda r: "| " + " | ".join("" if x is None else str(x).replace("|", "\\|") for x in r) + " |"
    return "\n".join([f"# {title}", "", cells(df.columns), cells(["---"] * len(df.columns)), *map(cells, rows), *(["", f"Only the first {limit} rows are shown."] if more else []), ""])

"""Sources and sinks: session files, text logs, and index tables kept by rewriting immutable files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentis.sources import logs

SESSION = "version int, capture string, duration_us long, moments array<struct<id:string,start_us:long,end_us:long,score:double,enabled:boolean>>"


def read_sessions(spark: SparkSession, path: str, newest: int = 1, lines: bool = False) -> DataFrame:
    """Session files (one JSON object each, or one a line; unknown fields and a byte order mark ignored); other extensions, corrupt files and newer versions are left out."""
    files = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=not lines)
    parsed = F.from_json(F.regexp_replace("value", "^\\uFEFF", ""), SESSION + ", _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rows = files.select(parsed.alias("x")).select("x.*")
    return rows.where(F.col("_corrupt").isNull() & F.col("version").between(1, newest)).drop("_corrupt")


def write_sessions(rows: DataFrame, path: str) -> None:
    """One JSON object a line; the committer moves whole files into place."""
    rows.write.mode("overwrite").json(path)


def read_loudness(spark: SparkSession, path: str) -> DataFrame:
    """(file, t, lufs) of loudness logs, each read whole, so that its lines keep their order."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\\r?\\n")).alias("n", "value"))
    return logs.loudness(files)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same keys."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def last_writes(log: DataFrame, keys: list[str], order: str, gone: str) -> DataFrame:
    """The last write of each key by order, without those that are tombstones."""
    newest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return log.withColumn("_n", newest).where((F.col("_n") == 1) & ~F.col(gone)).drop("_n", gone)


def keep_last(rows: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """The last rows of each key."""
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(x) for x in order)))
    return rows.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def stale(index: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Files without an index row of their modification time and size."""
    return files.join(index.select(key, "mtime", "size"), [key, "mtime", "size"], "left_anti")

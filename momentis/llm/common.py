"""What the training-data operators share: shared-folder tables, Arrow plumbing and rolling hashes."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Python's and Java's common notion of a word here: a run of characters that are no ASCII white space.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the folder named in spark.checkpoint.dir; a temporary one only where none is named and all runs on one machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not named and not re.match(r"local(\[.*\])?$", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="momentis-"))
        current = sc._jsc.sc().getCheckpointDir()
    return f"{(named or current.get()).rstrip('/')}/momentis-{sc.applicationId}"


def materialize(df: DataFrame, frees: Iterable[DataFrame] = ()) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the lineage and outlives lost executors.

    frees: tables written before that no later step reads; they are deleted. What is left goes when the driver ends.
    """
    spark = df.sparkSession
    top = shared_dir(spark)
    path = f"{top}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if top not in _folders:
        _folders.add(top)
        atexit.register(_delete, spark, top)
    release(*frees)
    out = spark.read.schema(df.schema).parquet(path)
    out._momentis_path = path
    _written.append(path)
    return out


#: Tables that this process has written, in order.
_written: list[str] = []


def release(*tables: DataFrame) -> None:
    """Delete written tables that no later step reads."""
    for old in tables:
        if at := getattr(old, "_momentis_path", None):
            _delete(old.sparkSession, at)


class Scope:
    """The tables that one step over `source` writes, to be deleted once its result has been written elsewhere."""

    def __init__(self, source: DataFrame):
        self.source = set(source.inputFiles())

    def __enter__(self):
        self.start = len(_written)
        self.paths: list[str] = []
        return self

    def __exit__(self, *_) -> None:
        self.paths = _written[self.start :]

    def close(self, reader: DataFrame) -> None:
        """Delete the tables, unless the next step's rows still come from them, or from where this step's came (its result may then be unread)."""
        files = set(reader.inputFiles())
        names = [p.rsplit("/", 1)[1] for p in self.paths]
        if files and not files & self.source and not any(n in f for f in files for n in names):
            for path in self.paths:
                _delete(reader.sparkSession, path)


_folders: set[str] = set()


def _delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    with contextlib.suppress(Exception):  # a folder that is left over harms no result, and the driver's JVM may be gone
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


def is_plain_scan(df: DataFrame) -> bool:
    """Whether the rows come straight from files through projections and filters, so that each evaluation deals them alike."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    heads = [line.lstrip(" +-:").split(" ")[0] for line in plan.splitlines() if line.strip()]
    return all(h in ("Project", "Filter", "Relation") for h in heads) and "rand(" not in plan


def numbered(df: DataFrame, name: str, once: bool = False) -> DataFrame:
    """Give each row a 64-bit number and write the rows with it to the shared folder, from where every later job reads it.

    A scan's partitions follow the cores registered when a job starts, so a number evaluated anew could move to another row.
    once: the caller reads the numbers in one job only, so those of a plain scan needn't be written.
    """
    own = F.monotonically_increasing_id()
    if once:
        return (df if is_plain_scan(df) else materialize(df)).withColumn(name, own)
    return materialize(df.withColumn(name, own))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context, so that their Python workers can import it."""
    sc = spark.sparkContext
    if not getattr(sc, "_momentis_shipped", False):
        package = Path(__file__).resolve().parents[1]
        archive = Path(tempfile.mkdtemp(prefix="momentis-")) / "momentis.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        sc.addPyFile(str(archive))
        sc._momentis_shipped = True


#: What an Arrow batch of texts may hold, in bytes (a longer row is a batch of its own).
BATCH_BYTES = 16 << 20


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what a Python worker holds of a partition at once, by rows and bytes, and let it import this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def strings(column: pa.Array) -> list[str]:
    """The texts of a column, null as empty."""
    return [x or "" for x in column.to_pylist()]


#: An odd multiplier and its inverse modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        for k, b in enumerate((_BASE, _BASE_INV)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0][:n], _powers[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def prefix_sums(x: np.ndarray) -> np.ndarray:
    """Sums of x[j] * base**j modulo 2**64, one longer than x; x holds the symbols as uint64, none of them 0."""
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * powers(len(x))[0], out=sums[1:])
    return sums

"""Session construction and table access shared by every query."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | None = None, app: str = "momentis") -> SparkSession:
    """A session under the submitter's settings; where no master is set, a local one with the settings the engine is tested under."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if not os.environ.get("PYSPARK_SUBMIT_ARGS", "").count("--master") and not os.environ.get("SPARK_REMOTE") and SparkSession.getActiveSession() is None and "spark.master" not in _submitted():
        n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
        local = {"spark.sql.shuffle.partitions": n, "spark.sql.adaptive.enabled": "true", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
        builder = builder.master(f"local[{n}]").config(map=local)
    return builder.getOrCreate()


def _submitted() -> dict[str, str]:
    """Settings of spark-defaults.conf."""
    path = os.path.join(os.environ.get("SPARK_CONF_DIR", os.path.join(os.environ.get("SPARK_HOME", ""), "conf")), "spark-defaults.conf")
    if not os.path.isfile(path):
        return {}
    with open(path) as lines:
        return dict(line.split(None, 1) for line in lines if line.strip() and not line.startswith("#") and len(line.split(None, 1)) == 2)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context, so that their Python workers can import it."""
    sc = spark.sparkContext
    if not getattr(sc, "_momentis_shipped", False):
        package = Path(__file__).resolve().parent
        archive = Path(tempfile.mkdtemp(prefix="momentis-")) / "momentis.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(package.rglob("*.py")):
                out.write(source, source.relative_to(package.parent))
        sc.addPyFile(str(archive))
        sc._momentis_shipped = True


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


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever store it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it lies."""
    with contextlib.suppress(Exception):  # a folder that is left over harms no result, and the driver's JVM may be gone
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)


_tops: set[str] = set()


def scratch(spark: SparkSession) -> str:
    """A new folder that driver and executors share, deleted when the driver ends."""
    top = f"{shared_dir(spark)}/scratch"
    if top not in _tops:
        _tops.add(top)
        atexit.register(delete, spark, top)
    return f"{top}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """Write a table into the shared folder and read it back: cuts the lineage and outlives lost executors."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir; what is done with it may need this package on the executors."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

"""The source of settled files against plain walks of growing folders."""

import os
import time

from pyspark.sql import functions as F

from momentis.sources import folders


def put(path, text, age=100.0):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    at = time.time() - age
    os.utime(path, (at, at))
    return path


def test_batch(spark, tmp_path):
    folders.register(spark)
    put(tmp_path / "a.log", "one\ntwo\r\n\nlast")
    put(tmp_path / "x/y/b.LOG", "\ufeffä\n")
    put(tmp_path / "x/c.txt", "no")
    put(tmp_path / "x/empty.log", "")
    put(tmp_path / "1/2/3/4/deep.log", "no")
    put(tmp_path / "fresh.log", "now", age=1)
    put(tmp_path / "long.log", "".join(f"{k}\n" for k in range(25_000)), age=500)
    read = spark.read.format("settled_files").option("extensions", "log, json").option("settle", 30)
    files = {r.path: r.bytes for r in read.load(str(tmp_path)).collect()}
    assert files == {str(tmp_path / p): (tmp_path / p).stat().st_size for p in ("a.log", "x/y/b.LOG", "long.log")}
    lines = read.option("content", "lines").load(str(tmp_path))
    assert [(r.line, r.text) for r in lines.where(F.col("path").endswith("a.log")).orderBy("line").collect()] == [(0, "one"), (1, "two"), (2, ""), (3, "last")]
    assert [r.text for r in lines.where(F.col("path").contains("b.LOG")).collect()] == ["ä"]
    assert {r.text: r.line for r in lines.where("bytes > 1000").collect()} == {str(k): k for k in range(25_000)}
    assert lines.where("bytes > 1000 and line = 7 and text = '7'").count() == 1
    read = read.option("content", "none")
    assert all(read.load(scheme + str(tmp_path)).count() == 3 for scheme in ("file://", "file:")) and read.load(str(tmp_path / "none")).count() == 0
    since = int((time.time() - 300) * 1e6)
    assert read.option("since", since).load(str(tmp_path)).where("path like '%long%'").count() == 0


def test_filters_are_pushed():
    reader = folders.BatchReader({"path": "/x"})
    keep = [folders.GreaterThan(("line",), 3), folders.StringContains(("text",), "a")]
    assert list(reader.pushFilters([folders.GreaterThan(("bytes",), 5), *keep, folders.StringEndsWith(("path",), "g")])) == keep
    assert len(reader.wanted) == 2


def test_tasks_hold_a_bounded_size():
    folder = folders.Folder({"path": "/x"})
    files = [(str(k), size << 20, k) for k, size in enumerate((100, 20, 20, 300, 5, 5))]
    assert [[f[0] for f in p.files] for p in folder.dealt(files)] == [["0", "1"], ["2"], ["3"], ["4", "5"]]


def test_stream_of_growing_files(spark, tmp_path):
    folders.register(spark)
    top = tmp_path / "in"
    put(top / "a.log", "a1\na2\n", age=90)
    put(top / "sub/b.log", "b1\n", age=80)
    growing = put(top / "c.log", "c1\n", age=1)

    def run() -> None:
        rows = spark.readStream.format("settled_files").option("content", "lines").option("settle", 20).load(str(top))
        # Python sources have no bounded trigger: all that has settled is given, then the query is stopped.
        query = rows.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(processingTime="200 milliseconds").start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    seen = lambda: sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect())
    run()
    assert seen() == ["a1", "a2", "b1"]
    # A restart gives nothing twice; what has settled since, and what was written again, comes whole.
    put(growing, "c1\nc2\n", age=40)
    put(top / "sub/b.log", "b1\nb2\n", age=30)
    run()
    assert seen() == ["a1", "a2", "b1", "b1", "b2", "c1", "c2"]
    run()
    assert len(seen()) == 7

"""Profiles: folders of small documents that parameterise an analysis, read strictly and resolved for files by table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from momentis.functions.events import duration_us

_SCALAR = {"true": True, "false": False, "null": None, "~": None, "": None}


def _scalar(text: str):
    text = text.strip()
    if len(text) > 1 and text[0] in "\"'" and text[-1] == text[0]:
        return text[1:-1]
    if text.startswith("[") and text.endswith("]"):
        return [_scalar(x) for x in re.findall(r"\"[^\"]*\"|'[^']*'|[^,\s][^,]*", text[1:-1])]
    if text.lower() in _SCALAR:
        return _SCALAR[text.lower()]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def parse_yaml(text: str):
    """Maps, lists and scalars of a block-style document; comments go. A line that is none of these is an error."""
    lines = []
    for n, raw in enumerate(text.lstrip("﻿").splitlines(), 1):
        line = re.sub(r"(^|\s)#[^\"']*$", "", raw).rstrip()
        if line.strip() and line.strip() != "---":
            lines.append((n, len(line) - len(line.lstrip()), line.strip()))

    def block(at: int, depth: int):
        if lines[at][2].startswith("- ") or lines[at][2] == "-":
            out: list = []
            while at < len(lines) and lines[at][1] == depth and (lines[at][2].startswith("- ") or lines[at][2] == "-"):
                n, _, body = lines[at]
                rest = body[1:].strip()
                if not rest:
                    value, at = block(at + 1, lines[at + 1][1])
                elif re.match(r"[\w.\-]+:(\s|$)", rest):
                    lines[at] = (n, depth + 2, rest)
                    value, at = block(at, depth + 2)
                else:
                    value, at = _scalar(rest), at + 1
                out.append(value)
            return out, at
        own: dict = {}
        while at < len(lines) and lines[at][1] == depth:
            n, _, body = lines[at]
            m = re.match(r"([\w.\- ]+?)\s*:(?:\s+(.*))?$", body)
            if not m:
                raise ValueError(f"line {n} is neither a key nor an entry: {body}")
            if m[1] in own:
                raise ValueError(f"line {n} has the key {m[1]} again")
            at += 1
            if m[2]:
                own[m[1]] = _scalar(m[2])
            elif at < len(lines) and (lines[at][1] > depth or (lines[at][1] == depth and lines[at][2].startswith("-"))):
                own[m[1]], at = block(at, lines[at][1])
            else:
                own[m[1]] = None
        if at < len(lines) and lines[at][1] > depth:
            raise ValueError(f"line {lines[at][0]} is set in too far")
        return own, at

    if not lines:
        return None
    value, at = block(0, lines[0][1])
    if at < len(lines):
        raise ValueError(f"line {lines[at][0]} is out of place")
    return value


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """(id, name, priority, needles, document) of a folder's profiles, sorted by file; two of one id are an error.

    A folder of profiles is a few small files, read by Spark from wherever they lie and parsed on the driver.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value").orderBy("file").collect()
    rows, seen = [], {}
    for file, text in files:
        own = parse_yaml(text)
        if not isinstance(own, dict) or not isinstance(own.get("id"), str):
            raise ValueError(f"{file} has no id")
        if own["id"] in seen:
            raise ValueError(f"{file} and {seen[own['id']]} are both called {own['id']}")
        seen[own["id"]] = file
        match = own.get("match") or {}
        rows.append((own["id"], own.get("name") or own["id"], int(match.get("priority") or 0), [str(x) for x in match.get("pathContains") or []], text))
    return spark.createDataFrame(rows, "id string, name string, priority int, needles array<string>, document string")


def resolve(files: DataFrame, profiles: DataFrame, path: str = "path", default: str = "default") -> DataFrame:
    """files with the profile whose needle lies in the path, whatever its case; of several the one of the highest priority, then first by id."""
    needles = F.broadcast(profiles.select(F.col("id").alias("profile"), "priority", F.explode("needles").alias("needle")))
    names = files.columns
    hits = files.select(path).distinct().join(needles, F.contains(F.lower(path), F.lower("needle")))
    best = hits.withColumn("_n", F.row_number().over(Window.partitionBy(path).orderBy(F.desc("priority"), "profile"))).where("_n = 1").select(path, "profile")
    return files.join(best, path, "left").select(*names, F.coalesce("profile", F.lit(default)).alias("profile"))


_TRUTH = {"capture", "tolerance", "lead", "profile", "events", "gates"}


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(capture, kind, at_us, tolerance_us) of labelled events from a folder of documents; unknown keys and events without a kind or time are errors."""
    rows = []
    for file, text in spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value").orderBy("file").collect():
        own = parse_yaml(text) or {}
        if odd := sorted(set(own) - _TRUTH):
            raise ValueError(f"{file} has the unknown key {odd[0]}")
        for event in own.get("events") or []:
            if not isinstance(event, dict) or set(event) != {"kind", "at"}:
                raise ValueError(f"{file} has an event that isn't a kind and a time")
            rows.append((str(own["capture"]), str(event["kind"]), str(event["at"]), str(own.get("tolerance") or "3s")))
    plain = spark.createDataFrame(rows, "capture string, kind string, at string, tolerance string")
    return plain.select("capture", "kind", duration_us(F.col("at")).alias("at_us"), duration_us(F.col("tolerance")).alias("tolerance_us"))

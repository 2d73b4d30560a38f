"""Parsers of tool output: lines of logs and probe documents as columns. They take DataFrames of text, so any reader can feed them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def loudness(lines: DataFrame, file: str = "file", order: str = "n", line: str = "value") -> DataFrame:
    """(file, t, lufs) of loudness logs: each level belongs to the last frame time before it."""
    t = F.regexp_extract(line, r"pts_time:([0-9.]+)", 1).try_cast("double")
    level = F.regexp_extract(line, r"lavfi\.r128\.M=(-?[0-9.]+|nan|-inf)", 1).try_cast("double")
    upto = Window.partitionBy(file).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.select(file, order, t.alias("t"), level.alias("lufs")).withColumn("t", F.last("t", ignorenulls=True).over(upto))
    return rows.where("lufs is not null and not isnan(lufs) and lufs > double('-infinity') and t is not null").select(F.col(file).alias("file"), "t", "lufs")


def speech(lines: DataFrame, totals: DataFrame, file: str = "file", order: str = "n", line: str = "value") -> DataFrame:
    """(file, s, e) of what lies between the silences of a log, up to the file's total; a silence that doesn't end lasts to the end."""
    start = F.regexp_extract(line, r"silence_start: (-?[0-9.]+)", 1).try_cast("double")
    end = F.regexp_extract(line, r"silence_end: (-?[0-9.]+)", 1).try_cast("double")
    marks = lines.select(file, order, start.alias("start"), end.alias("end")).where("start is not null or end is not null")
    by = Window.partitionBy(file).orderBy(order)
    silences = marks.withColumn("stop", F.lead("end").over(by)).where("start is not null").select(F.col(file).alias("file"), F.greatest("start", F.lit(0.0)).alias("start"), "stop")
    both = totals.select(F.col(file).alias("file"), "total").join(silences, "file", "left").withColumn("stop", F.least(F.coalesce("stop", "total"), "total"))
    own = Window.partitionBy("file").orderBy("start")
    before = F.coalesce(F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    gaps = both.where("start is not null").select("file", before.alias("s"), F.col("start").alias("e"))
    tail = both.groupBy("file").agg(F.max(F.when(F.col("start").isNotNull(), F.col("stop")).otherwise(0.0)).alias("s"), F.first("total").alias("e"))
    return gaps.unionByName(tail).where("s < e")


PROBE = "format struct<filename:string,duration:string,size:string,tags:map<string,string>>, streams array<struct<index:int,codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string,channels:int,sample_rate:string,tags:map<string,string>>>"


def media(documents: DataFrame, text: str = "value") -> DataFrame:
    """One row per probe document: path, size, duration in microseconds, creation time, the first video stream and all audio streams."""
    x = documents.select("*", F.from_json(text, PROBE).alias("x")).where("x.format is not null")
    video = F.get(F.filter("x.streams", lambda s: s["codec_type"] == "video"), F.lit(0))
    rate = F.split(video["r_frame_rate"], "/")
    sound = F.filter("x.streams", lambda s: s["codec_type"] == "audio")
    audio = F.transform(sound, lambda s, i: F.struct(s["index"].alias("index"), i.alias("audio_index"), s["codec_name"].alias("codec"), s["channels"].alias("channels"), s["sample_rate"].try_cast("int").alias("sample_rate"), F.element_at(s["tags"], "title").alias("title")))
    return x.select(
        F.col("x.format.filename").alias("path"), F.col("x.format.size").try_cast("long").alias("size_bytes"), F.round(F.col("x.format.duration").try_cast("double") * 1e6).cast("long").alias("duration_us"),
        F.element_at("x.format.tags", "creation_time").try_cast("timestamp").alias("created_at"), video["width"].alias("width"), video["height"].alias("height"),
        (F.get(rate, F.lit(0)).try_cast("double") / F.nullif(F.get(rate, F.lit(1)).try_cast("double"), F.lit(0.0))).alias("fps"), audio.alias("audio"),
    )


def name_time(name) -> Column:
    """The time that a recorder wrote into a file's name, by three patterns in order (`2026-11-17 21-08-40`, `2026.11.17 - 21.08.40`, month first `9-22-2026_22-55-31`); impossible dates
    are passed over."""
    part = lambda pattern, k: F.regexp_extract(name, pattern, k)
    first = r"(?<![\d-])(\d{4}-\d{2}-\d{2})[ _](\d{2})-(\d{2})-(\d{2})"
    second = r"(\d{4})\.(\d{2})\.(\d{2}) - (\d{2})\.(\d{2})\.(\d{2})"
    third = r"(?<![\d-])(\d{1,2})-(\d{1,2})-(\d{4})[ _](\d{1,2})-(\d{1,2})-(\d{1,2})"
    two = lambda k: F.lpad(part(third, k), 2, "0")
    return F.coalesce(
        F.concat(part(first, 1), F.lit(" "), F.concat_ws(":", part(first, 2), part(first, 3), part(first, 4))).try_cast("timestamp_ntz"),
        F.concat(F.concat_ws("-", *(part(second, k) for k in (1, 2, 3))), F.lit(" "), F.concat_ws(":", *(part(second, k) for k in (4, 5, 6)))).try_cast("timestamp_ntz"),
        F.concat(F.concat_ws("-", part(third, 3), two(1), two(2)), F.lit(" "), F.concat_ws(":", two(4), two(5), two(6))).try_cast("timestamp_ntz"),
    )

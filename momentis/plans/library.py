"""Sources, sinks, names, captions and metadata: what a library of captures is read from and written to. Text that tools would write is made from the tables and parsed."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from momentis.functions import events as fn
from momentis.functions.events import HOUR, load_events
from momentis.operators import intervals
from momentis.plans.moments import EV, H
from momentis.plans.registry import query
from momentis.plans.sessions import GROUPS, kill_groups
from momentis.session import scratch, table
from momentis.sources import folders, logs, profiles, tables


@query("loudness_log", EV + " SELECT cap AS file, round(CAST(t // 1000 AS DOUBLE) / 1000, 3) AS t, round(-v, 1) + 0.0 AS lufs FROM ev WHERE kind = 'shot' AND t >= 0")
def loudness_log(spark, sf_dir):
    """Levels read from log lines: a frame's time on one, its level on the next."""
    e = load_events(spark, sf_dir).where("kind = 'shot' and t >= 0").withColumn("lufs", F.round(-F.col("v"), 1))
    at = F.concat(F.lit("frame:"), F.col("id").cast("string"), F.lit(" pts:1 pts_time:"), F.format_string("%d.%03d", F.floor(F.col("t") / 1_000_000), F.floor(F.col("t") / 1000) % 1000))
    level = F.concat(F.lit("lavfi.r128.M="), F.col("lufs").cast("decimal(20,1)").cast("string"))
    lines = e.select("cap", F.inline(F.array(F.struct((2 * F.col("id")).alias("n"), at.alias("value")), F.struct((2 * F.col("id") + 1).alias("n"), level.alias("value")))))
    ordered = lines.withColumn("n", F.col("n"))
    return logs.loudness(ordered, "cap").select("file", F.round("t", 3).alias("t"), (F.round("lufs", 1) + 0.0).alias("lufs"))


@query("speech_ranges", EV + f""", s AS (SELECT cap, t // {24 * H} AS day, min(t) AS a, min(t) + {6 * H} AS b FROM ev WHERE kind = 'assist' AND t BETWEEN 0 AND {700 * H} GROUP BY ALL), k AS (SELECT *, lag(b) OVER (PARTITION BY cap ORDER BY a) AS pb FROM s),
 c AS (SELECT DISTINCT cap FROM ev) SELECT cap AS file, round(coalesce(pb, 0) / 1000000, 0) AS s, round(a / 1000000, 0) AS e FROM k WHERE a // 1000000 > coalesce(pb, 0) // 1000000 UNION ALL SELECT c.cap, round(coalesce(max(b), 0) / 1000000, 0), {720 * 3600}::DOUBLE FROM c LEFT JOIN s ON s.cap = c.cap GROUP BY c.cap""".replace("round(coalesce(pb, 0) / 1000000, 0) AS s, round(a / 1000000, 0) AS e", "CAST(coalesce(pb, 0) // 1000000 AS DOUBLE) AS s, CAST(a // 1000000 AS DOUBLE) AS e").replace("round(coalesce(max(b), 0) / 1000000, 0)", "CAST(coalesce(max(b), 0) // 1000000 AS DOUBLE)"))
def speech_ranges(spark, sf_dir):
    """What lies between the silences of a log (here the six hours from each day's first assist), up to the end of the capture."""
    e = load_events(spark, sf_dir)
    quiet = e.where(f"kind = 'assist' and t between 0 and {700 * HOUR}").groupBy("cap", F.floor(F.col("t") / (24 * HOUR)).alias("day")).agg(F.min("t").alias("a"))
    second = lambda x: F.floor(x / 1_000_000).cast("string")
    start = F.concat(F.lit("[silencedetect] silence_start: "), second(F.col("a")))
    stop = F.concat(F.lit("[silencedetect] silence_end: "), second(F.col("a") + 6 * HOUR), F.lit(" | silence_duration: 1"))
    lines = quiet.select("cap", F.inline(F.array(F.struct((2 * F.col("day")).alias("n"), start.alias("value")), F.struct((2 * F.col("day") + 1).alias("n"), stop.alias("value")))))
    return logs.speech(lines, e.select("cap").distinct().withColumn("total", F.lit(720.0 * 3600)), "cap")


@query("media_probe", """SELECT 'C:/clips/' || s_suppkey || '.mkv' AS path, CAST(s_suppkey * 1000 + 7 AS BIGINT) AS size_bytes, CAST(s_suppkey AS BIGINT) * 1500000 AS duration_us, CASE WHEN s_suppkey % 4 <> 0 THEN 1700000000 + s_suppkey END AS created_s,
 CAST(CASE WHEN s_suppkey % 5 <> 0 THEN 1920 END AS INTEGER) AS width, CASE WHEN s_suppkey % 5 <> 0 THEN round(60000 / 1001, 4) END AS fps, CAST(1 + s_suppkey % 2 AS BIGINT) AS tracks, 'Mic' AS first_title FROM supplier""")  # fmt: skip
def media_probe(spark, sf_dir):
    """Files described by probe documents: sizes, times, the first video stream and the audio streams."""
    k = F.col("s_suppkey")
    quote = lambda x: F.concat(F.lit('"'), x, F.lit('"'))
    tags = F.when(k % 4 != 0, F.concat(F.lit('{"creation_time":"'), F.date_format(F.timestamp_seconds(1_700_000_000 + k), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"}'))).otherwise("{}")
    video = F.when(k % 5 != 0, '{"index":0,"codec_type":"video","codec_name":"h264","width":1920,"height":1080,"r_frame_rate":"60000/1001"},').otherwise("")
    audio = F.concat(F.lit('{"index":1,"codec_type":"audio","codec_name":"aac","channels":2,"sample_rate":"48000","tags":{"title":"Mic"}}'), F.when(k % 2 == 1, ',{"index":2,"codec_type":"audio","codec_name":"aac","channels":1,"unknown":[1]}').otherwise(""))
    path = F.concat(F.lit("C:/clips/"), k.cast("string"), F.lit(".mkv"))
    head = F.concat(F.lit('{"format":{"filename":'), quote(path), F.lit(',"duration":'), quote(F.format_string("%d.%d", F.floor(k * 1.5), F.when(k % 2 == 1, 5).otherwise(0))), F.lit(',"size":'), quote((k * 1000 + 7).cast("string")), F.lit(',"tags":'), tags, F.lit('},"streams":['))
    docs = table(spark, sf_dir, "supplier").select(F.concat(head, video, audio, F.lit("]}")).alias("value"))
    m = logs.media(docs)
    return m.select("path", "size_bytes", "duration_us", F.unix_seconds("created_at").alias("created_s"), "width", F.round("fps", 4).alias("fps"), F.size("audio").cast("long").alias("tracks"), F.get("audio", F.lit(0))["title"].alias("first_title"))


PATHS = """WITH p AS (SELECT page_id, coalesce(url, '') AS path FROM pages), pr(id, priority, needles) AS (VALUES ('blog', 2, ['BLOG.']), ('mobile', 3, ['//m.', 'mobile']), ('lang', 1, ['/fr/', '/en/']), ('word', 1, ['th'])),
 m AS (SELECT path, id, row_number() OVER (PARTITION BY path ORDER BY priority DESC, id) AS n FROM (SELECT DISTINCT path FROM p) d, (SELECT id, priority, unnest(needles) AS needle FROM pr) u WHERE contains(lower(path), lower(needle)))"""


@query("profile_table", PATHS + " SELECT page_id, coalesce(id, 'default') AS profile FROM p LEFT JOIN m ON m.path = p.path AND n = 1")
def profile_table(spark, sf_dir):
    """Profiles from a table, resolved for paths: the needle may lie anywhere in the path, the highest priority wins."""
    rows = [("blog", 2, ["BLOG."]), ("mobile", 3, ["//m.", "mobile"]), ("lang", 1, ["/fr/", "/en/"]), ("word", 1, ["th"])]
    own = spark.createDataFrame(rows, "id string, priority int, needles array<string>")
    return profiles.resolve(table(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("path")), own).select("page_id", "profile")


@query("library_lookup", """WITH f AS (SELECT s_suppkey AS file, lower(replace('D:\\Clips\\' || (s_suppkey % 4) || '\\Game ' || (s_suppkey // 3) || '.mp4', '\\', '/')) AS path FROM supplier), l AS (SELECT s_suppkey AS entry, lower('d:/clips/' || (s_suppkey % 4) || '/game ' || (s_suppkey // 3 + CASE WHEN s_suppkey % 7 = 0 THEN 500 ELSE 0 END) || '.mp4') AS path FROM supplier),
 b AS (SELECT split_part(path, '/', 4) AS base, min(entry) AS entry FROM l GROUP BY 1 HAVING count(*) = 1), x AS (SELECT path, min(entry) AS entry FROM l GROUP BY path)
 SELECT file, coalesce(x.entry, b.entry) AS entry, CASE WHEN x.entry IS NOT NULL THEN 'path' WHEN b.entry IS NOT NULL THEN 'name' END AS how FROM f LEFT JOIN x ON x.path = f.path LEFT JOIN b ON b.base = split_part(f.path, '/', 4)""")  # fmt: skip
def library_lookup(spark, sf_dir):
    """Captures found in a library by their whole path, whatever its slashes and case, else by a file name that only one entry has."""
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    game = F.floor(k / 3)
    files = s.select(k.alias("file"), F.lower(F.replace(F.concat(F.lit("D:\\Clips\\"), k % 4, F.lit("\\Game "), game, F.lit(".mp4")), F.lit("\\"), F.lit("/"))).alias("path"))
    entries = s.select(k.alias("entry"), F.lower(F.concat(F.lit("d:/clips/"), k % 4, F.lit("/game "), game + F.when(k % 7 == 0, 500).otherwise(0), F.lit(".mp4"))).alias("path"))
    base = F.substring_index("path", "/", -1)
    by_path = entries.groupBy("path").agg(F.min("entry").alias("exact"))
    by_name = entries.groupBy(base.alias("base")).agg(F.count("*").alias("n"), F.min("entry").alias("named")).where("n = 1").drop("n")
    rows = files.withColumn("base", base).join(by_path, "path", "left").join(by_name, "base", "left")
    return rows.select("file", F.coalesce("exact", "named").alias("entry"), F.when(F.col("exact").isNotNull(), "path").when(F.col("named").isNotNull(), "name").alias("how"))


@query("stale_entries", "SELECT s_suppkey AS path, CAST(s_suppkey % 5 AS BIGINT) AS mtime FROM supplier WHERE s_suppkey % 3 <> 0 OR s_suppkey % 5 <> 2")
def stale_entries(spark, sf_dir):
    """Files whose session is newer than the index, or that the index doesn't know: to be counted again."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"), (F.col("s_suppkey") % 5).cast("long").alias("mtime"), F.lit(1).alias("size"))
    index = s.where("path % 3 = 0").withColumn("mtime", F.lit(2).cast("long"))
    return tables.stale(index, s).select("path", "mtime")


@query("forgotten_entries", "SELECT s_suppkey, s_nationkey, NOT EXISTS (SELECT 1 FROM supplier o WHERE o.s_nationkey = s.s_nationkey AND o.s_suppkey % 4 <> 0) AS session_goes FROM supplier s WHERE s_suppkey % 4 = 0")
def forgotten_entries(spark, sf_dir):
    """Index rows that are forgotten, and whether the session file they share may go too: only where no row that stays uses it."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    stays = s.where("s_suppkey % 4 <> 0").select("s_nationkey").distinct().withColumn("used", F.lit(True))
    return s.where("s_suppkey % 4 = 0").join(stays, "s_nationkey", "left").select("s_suppkey", "s_nationkey", F.col("used").isNull().alias("session_goes"))


@query("folder_walk", """WITH f AS (SELECT p_partkey AS file, 'root/' || repeat('sub/', CAST(p_size % 5 AS INTEGER)) || 'f' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.MP4' WHEN 1 THEN '.mkv' WHEN 2 THEN '.txt' ELSE '' END AS path, p_size AS age FROM part)
 SELECT file, path FROM f WHERE regexp_matches(lower(path), '\\.(mp4|mkv|mov|webm)$') AND length(path) - length(replace(path, '/', '')) <= 3 AND age >= 15""")  # fmt: skip
def folder_walk(spark, sf_dir):
    """Files of known extensions, down to a depth, that have been still for long enough."""
    end = F.element_at(F.array(F.lit(".MP4"), F.lit(".mkv"), F.lit(".txt"), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))
    path = F.concat(F.lit("root/"), F.expr("repeat('sub/', cast(p_size % 5 as int))"), F.lit("f"), "p_partkey", end)
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file"), path.alias("path"), F.col("p_size").alias("age"))
    return rows.where(F.lower("path").rlike(r"\.(mp4|mkv|mov|webm)$") & (F.regexp_count("path", F.lit("/")) <= 3) & (F.col("age") >= 15)).select("file", "path")


@query("music_misses", "SELECT s_suppkey AS song, CASE WHEN s_suppkey % 6 = 5 THEN 'new' WHEN s_suppkey % 4 = 0 THEN 'changed' ELSE 'old version' END AS why FROM supplier WHERE s_suppkey % 6 = 5 OR s_suppkey % 4 = 0 OR s_suppkey % 9 = 0")
def music_misses(spark, sf_dir):
    """Songs whose cached analysis doesn't hold: unknown, of another stamp, or by an older version."""
    k = F.col("s_suppkey")
    songs = table(spark, sf_dir, "supplier").select(k.alias("song"), (k * 10 + F.when(k % 4 == 0, 1).otherwise(0)).alias("stamp"))
    cache = table(spark, sf_dir, "supplier").where("s_suppkey % 6 <> 5").select(k.alias("song"), (k * 10).alias("seen"), F.when(k % 9 == 0, 1).otherwise(2).alias("version"))
    why = F.when(F.col("seen").isNull(), "new").when(F.col("seen") != F.col("stamp"), "changed").when(F.col("version") < 2, "old version")
    return songs.join(cache, "song", "left").select("song", why.alias("why")).where("why is not null")


@query("report_files", EV + GROUPS + " SELECT cap, grp, kills, CAST(s AS BIGINT) AS s FROM gr WHERE kills >= 2")
def report_files(spark, sf_dir):
    """A report written as lines of JSON and read back under its schema."""
    path = scratch(spark)
    rows = kill_groups(spark, sf_dir).where("kills >= 2").select("cap", "grp", "kills", "s")
    rows.write.mode("overwrite").json(path)
    return spark.read.schema("cap long, grp long, kills long, s long, later string").json(path).drop("later")


@query("session_files", EV + GROUPS + " SELECT CAST(cap AS VARCHAR) AS capture, count(*) AS moments, CAST(sum(kills) AS BIGINT) AS kills FROM gr WHERE cap % 5 <> 0 GROUP BY cap")
def session_files(spark, sf_dir):
    """Sessions written one to a line and read under a version gate: newer versions are left out."""
    path = scratch(spark)
    moment = F.struct(F.col("grp").cast("string").alias("id"), F.col("s").alias("start_us"), F.col("e").alias("end_us"), F.col("kills").cast("double").alias("score"), F.lit(True).alias("enabled"))
    rows = kill_groups(spark, sf_dir).groupBy("cap").agg(F.collect_list(moment).alias("moments"), F.max("e").alias("duration_us"))
    tables.write_sessions(rows.select(F.when(F.col("cap") % 5 == 0, 2).otherwise(1).alias("version"), F.col("cap").cast("string").alias("capture"), "duration_us", "moments"), path)
    back = tables.read_sessions(spark, path, lines=True)
    return back.select("capture", F.size("moments").cast("long").alias("moments"), F.aggregate("moments", F.lit(0.0), lambda n, m: n + m["score"]).cast("long").alias("kills"))


@query("log_folder", EV + " SELECT cap, count(*) AS kills, min(t) AS first, max(t) AS last FROM ev WHERE kind = 'kill' AND cap IS NOT NULL GROUP BY cap")
def log_folder(spark, sf_dir):
    """Kills from a folder of event logs with a sub-folder for each kind; the other kinds' files aren't opened."""
    path = scratch(spark)
    e = load_events(spark, sf_dir).where("cap IS NOT NULL")
    e.select("kind", F.concat_ws(" ", "cap", "id", "t").alias("value")).write.partitionBy("kind").text(path)
    folders.register(spark)
    lines = spark.read.format("settled_files").option("extensions", "txt").option("content", "lines").load(path)
    word = F.split("text", " ")
    rows = lines.where(F.col("path").contains("kind=kill/")).select(word[0].cast("long").alias("cap"), word[2].cast("long").alias("t"))
    return rows.groupBy("cap").agg(F.count("*").alias("kills"), F.min("t").alias("first"), F.max("t").alias("last"))


@query("class_names", "SELECT CAST(p_partkey AS INTEGER) AS idx, CASE WHEN p_partkey % 2 = 0 THEN 'Speech, ' || p_name ELSE p_name END AS name FROM part")
def class_names(spark, sf_dir):
    """A table of class names read from CSV, with commas inside quotes."""
    path = scratch(spark)
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Speech, "), "p_name")).otherwise(F.col("p_name"))
    table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("index"), F.lit("/m/0").alias("mid"), name.alias("display_name")).write.option("header", True).option("escape", '"').csv(path)
    return spark.read.option("header", True).option("escape", '"').schema("index int, mid string, display_name string").csv(path).select(F.col("index").alias("idx"), F.col("display_name").alias("name"))


@query("output_names", "WITH s AS (SELECT page_id, coalesce(nullif(left(trim(regexp_replace(lower(regexp_replace(coalesce(url, ''), '^[a-z]+://', '')), '[^a-z0-9]+', '-', 'g'), '-'), 12), ''), 'video') AS slug FROM pages), n AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY page_id) AS n FROM s) SELECT page_id, slug || '_moments' || CASE WHEN n > 1 THEN '_' || n ELSE '' END || '.mp4' AS name FROM n")
def output_names(spark, sf_dir):
    """Names of outputs from slugs; the second and later of one name are numbered."""
    bare = F.regexp_replace(F.coalesce("url", F.lit("")), "^[a-z]+://", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(bare), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    rows = table(spark, sf_dir, "pages").select("page_id", F.coalesce(F.nullif(F.substring(slug, 1, 12), F.lit("")), F.lit("video")).alias("slug"))
    n = F.row_number().over(Window.partitionBy("slug").orderBy("page_id"))
    return rows.withColumn("n", n).select("page_id", F.concat("slug", F.lit("_moments"), F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise(""), F.lit(".mp4")).alias("name"))


@query("shared_scan", EV + " SELECT cap, t // 86400000000 AS day, count(*) FILTER (WHERE kind = 'kill') AS kills, max(v) FILTER (WHERE kind = 'shot') AS loudest, bool_or(kind = 'death' AND v > 50) AS died, round(avg(v) FILTER (WHERE kind = 'assist'), 6) AS voice FROM ev WHERE t >= 0 GROUP BY ALL")
def shared_scan(spark, sf_dir):
    """One scan that feeds four detectors' measures of each day."""
    kind = F.col("kind")
    return load_events(spark, sf_dir).where("t >= 0").groupBy("cap", F.floor(F.col("t") / (24 * HOUR)).alias("day")).agg(
        F.count_if(kind == "kill").alias("kills"), F.max(F.when(kind == "shot", F.col("v"))).alias("loudest"), F.bool_or((kind == "death") & (F.col("v") > 50)).alias("died"), F.round(F.avg(F.when(kind == "assist", F.col("v"))), 6).alias("voice")
    )


# Names and times ----------------------------------------------------------------------------------------------------------------------------------

TIMES = EV + """, n AS (SELECT id, t // 1000000 + 1704067200 AS at_s, id % 5 AS form FROM ev)"""


def _named(spark, sf_dir: str) -> DataFrame:
    at = F.timestamp_seconds(F.floor(F.col("t") / 1_000_000) + 1_704_067_200)
    month = F.concat(F.month(at), F.lit("-"), F.date_format(at, "dd"), F.lit("-"), F.date_format(at, "yyyy"), F.lit("_"), F.hour(at), F.lit("-"), F.date_format(at, "mm-ss"))
    name = F.when(F.col("id") % 5 == 0, F.date_format(at, "yyyy-MM-dd HH-mm-ss'.mkv'")).when(F.col("id") % 5 == 1, F.concat(F.lit("Game "), F.date_format(at, "yyyy.MM.dd - HH.mm.ss'.05.mp4'"))).when(F.col("id") % 5 == 2, F.concat(F.lit("GAME_"), month, F.lit("-983.mp4")))
    return load_events(spark, sf_dir).select("id", "t", F.coalesce(name, F.when(F.col("id") % 5 == 3, "clip 2024-13-45 99-99-99.mkv").otherwise("holiday.mp4")).alias("name"))


@query("recorder_times", TIMES + " SELECT id, CASE WHEN form < 3 THEN at_s END AS seconds FROM n")
def recorder_times(spark, sf_dir):
    """Times in file names by the three recorders' patterns in order; impossible dates give null."""
    return _named(spark, sf_dir).select("id", F.unix_seconds(logs.name_time(F.col("name")).cast("timestamp")).alias("seconds"))


@query("recorded_at", TIMES + " SELECT id, CASE WHEN id % 7 = 0 THEN at_s + 5 WHEN form < 3 THEN at_s WHEN id % 11 <> 0 THEN at_s + 99 END AS seconds, id % 7 = 0 OR form < 3 AS reliable FROM n")
def recorded_at(spark, sf_dir):
    """When a file was recorded: by its metadata, else its name, else its own date, which isn't reliable."""
    own = F.floor(F.col("t") / 1_000_000) + 1_704_067_200
    rows = _named(spark, sf_dir).withColumns({"created": F.when(F.col("id") % 7 == 0, own + 5), "named": F.unix_seconds(logs.name_time(F.col("name")).cast("timestamp")), "modified": F.when(F.col("id") % 11 != 0, own + 99)})
    return rows.select("id", F.coalesce("created", "named", "modified").alias("seconds"), (F.col("created").isNotNull() | F.col("named").isNotNull()).alias("reliable"))


@query("timecode_forms", EV + """, m AS (SELECT id, t // 1000 AS ms FROM ev WHERE t >= 0) SELECT id, printf('%02d:%02d.%03d', ms // 60000, (ms // 1000) % 60, ms % 1000) AS short, printf('%d:%02d:%02d.%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS long,
 CASE WHEN ms < 60000 THEN printf('%ds', ms // 1000) ELSE printf('%dm%02ds', ms // 60000, (ms // 1000) % 60) END AS spoken FROM m""")  # fmt: skip
def timecode_forms(spark, sf_dir):
    """Three ways to write a time: `mm:ss.mmm`, `h:mm:ss.mmm` and `4m05s`."""
    ms = F.floor(F.col("t") / 1000)
    s = F.floor(F.col("t") / 1_000_000)
    minutes = F.floor(s / 60)
    spoken = F.when(ms < 60_000, F.format_string("%ds", s)).otherwise(F.format_string("%dm%02ds", minutes, s % 60))
    return load_events(spark, sf_dir).where("t >= 0").select("id", F.format_string("%02d:%02d.%03d", minutes, s % 60, ms % 1000).alias("short"), fn.timecode(F.col("t")).alias("long"), spoken.alias("spoken"))


@query("region_rescale", """WITH r AS (SELECT p_partkey, (p_size % 10) / 12.0::DOUBLE AS x, 0.05 + (p_partkey % 4) / 20.0::DOUBLE AS w, CASE p_partkey % 3 WHEN 0 THEN 1.6 WHEN 1 THEN 16 / 9.0::DOUBLE ELSE 21 / 9.0::DOUBLE END AS target FROM part),
 k AS (SELECT *, (16 / 9.0::DOUBLE) / target AS k, least(w * (16 / 9.0::DOUBLE) / target, 1.0) AS w2, CASE WHEN x + w <= 0.4 THEN 'left' WHEN x >= 0.6 THEN 'right' ELSE 'centre' END AS anchor FROM r),
 n AS (SELECT *, CASE WHEN k BETWEEN 0.999 AND 1.001 THEN x ELSE least(greatest(CASE anchor WHEN 'left' THEN x * k WHEN 'right' THEN 1 - (1 - x - w) * k - w2 ELSE 0.5 + (x + w / 2 - 0.5) * k - w2 / 2 END, 0), 1 - w2) END AS nx FROM k)
 SELECT p_partkey, anchor, round(nx, 6) AS x, round(CASE WHEN k BETWEEN 0.999 AND 1.001 THEN w ELSE w2 END, 6) AS width FROM n""")  # fmt: skip
def region_rescale(spark, sf_dir):
    """Regions of a screen on one of another shape: those at a side keep their distance from it, others from the middle."""
    x, w = (F.col("p_size") % 10) / F.lit(12.0), 0.05 + (F.col("p_partkey") % 4) / F.lit(20.0)
    target = F.when(F.col("p_partkey") % 3 == 0, 1.6).when(F.col("p_partkey") % 3 == 1, F.lit(16) / F.lit(9.0)).otherwise(F.lit(21) / F.lit(9.0))
    rows = table(spark, sf_dir, "part").select("p_partkey", x.alias("x"), w.alias("w"), (F.lit(16) / F.lit(9.0) / target).alias("k"))
    same = F.col("k").between(0.999, 1.001)
    rows = rows.withColumns({"w2": F.least(F.col("w") * F.col("k"), F.lit(1.0)), "anchor": F.when(F.col("x") + F.col("w") <= 0.4, "left").when(F.col("x") >= 0.6, "right").otherwise("centre")})
    moved = F.when(F.col("anchor") == "left", F.col("x") * F.col("k")).when(F.col("anchor") == "right", 1 - (1 - F.col("x") - F.col("w")) * F.col("k") - F.col("w2")).otherwise(0.5 + (F.col("x") + F.col("w") / 2 - 0.5) * F.col("k") - F.col("w2") / 2)
    return rows.select("p_partkey", "anchor", F.round(F.when(same, F.col("x")).otherwise(F.least(F.greatest(moved, F.lit(0.0)), 1 - F.col("w2"))), 6).alias("x"), F.round(F.when(same, F.col("w")).otherwise(F.col("w2")), 6).alias("width"))


# Captions and metadata ----------------------------------------------------------------------------------------------------------------------------

@query("blocked_captions", r"""WITH c AS (SELECT conv_id, turn, trim(regexp_replace(regexp_replace(text, '\[[^\]]*\]|\([^)]*\)|\*[^*]*\*', '', 'g'), '\s+', ' ', 'g')) AS text FROM conversations)
 SELECT conv_id, turn, length(text) AS n FROM c WHERE regexp_matches(text, '\p{L}') AND NOT regexp_matches(lower(text), 'password|subscribe|thanks for watching')""")  # fmt: skip
def blocked_captions(spark, sf_dir):
    """Captions without sound tags; those without letters go, and those that hold a phrase of the block list."""
    bare = F.trim(F.regexp_replace(F.regexp_replace("text", r"\[[^\]]*\]|\([^)]*\)|\*[^*]*\*", ""), r"\s+", " "))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", bare.alias("text"))
    return rows.where(F.col("text").rlike(r"\p{L}") & ~F.lower("text").rlike("password|subscribe|thanks for watching")).select("conv_id", "turn", F.length("text").cast("long").alias("n"))


CAP = """WITH c AS (SELECT conv_id, turn, conv_id * 1000 + turn * 3 AS at_s, lower(left(trim(text), 3)) AS k FROM conversations)"""


@query("caption_repeats", CAP + """, f AS (SELECT conv_id, k, list_reduce(list_transform(list(at_s ORDER BY at_s), lambda x: [x]), lambda a, b: CASE WHEN b[1] - a[len(a)] > 10 THEN list_concat(a, b) ELSE a END) AS kept FROM c GROUP BY conv_id, k) SELECT conv_id, k, unnest(kept) AS at_s FROM f""")
def caption_repeats(spark, sf_dir):
    """Captions of one text: those within ten seconds of the last that was kept go."""
    from momentis.operators.keyed import per_key

    rows = table(spark, sf_dir, "conversations").select("conv_id", (F.col("conv_id") * 1000 + F.col("turn") * 3).alias("at_s"), F.lower(F.substring(F.trim("text"), 1, 3)).alias("k"))

    def run(g) -> list[tuple]:
        last, out = {}, []
        for k, t in zip(g.k, g.at_s.tolist(), strict=True):
            if k not in last or t - last[k] > 10:
                last[k] = t
                out.append((k, t))
        return out

    return per_key(rows, "conv_id", run, {"k": "string", "at_s": "long"}, ["at_s"])


@query("recurring_captions", CAP + " SELECT conv_id, turn FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.conv_id = c.conv_id AND o.k = c.k AND abs(o.at_s - c.at_s) >= 10)")
def recurring_captions(spark, sf_dir):
    """Captions whose text doesn't come again ten seconds or more away: the first and last time of a text decide."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn") * 3).alias("at_s"), F.lower(F.substring(F.trim("text"), 1, 3)).alias("k"))
    own = Window.partitionBy("conv_id", "k")
    far = F.greatest(F.max("at_s").over(own) - F.col("at_s"), F.col("at_s") - F.min("at_s").over(own))
    return rows.withColumn("far", far).where("far < 10 or far is null").select("conv_id", "turn")


@query("paused_sentences", """WITH c AS (SELECT conv_id, turn, text, regexp_matches(trim(text), '[.!?]$') OR turn % 4 = 3 AS ends FROM conversations), s AS (SELECT *, coalesce(sum(CAST(ends AS INTEGER)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM c)
 SELECT conv_id, CAST(sentence AS BIGINT) AS sentence, count(*) AS parts FROM s GROUP BY conv_id, sentence HAVING NOT bool_or(contains(lower(text), 'password'))""")  # fmt: skip
def paused_sentences(spark, sf_dir):
    """Sentences end at a full stop or before a pause (here after each fourth turn); one with a hit in any part goes whole."""
    ends = F.trim("text").rlike("[.!?]$") | (F.col("turn") % 4 == 3)
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = table(spark, sf_dir, "conversations").withColumn("sentence", F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)).cast("long"))
    return rows.groupBy("conv_id", "sentence").agg(F.count("*").alias("parts"), F.bool_or(F.contains(F.lower("text"), F.lit("password"))).alias("x")).where("not x").drop("x")


@query("caption_pacing", EV + f""", c AS (SELECT cap, list({{'s': t, 'n': least(400000 + 45000 * CAST(floor(v) AS BIGINT), 3000000) * 3600}} ORDER BY t, id) AS x FROM ev WHERE kind = 'assist' GROUP BY cap),
 p AS (SELECT cap, list_reduce(list_transform(x, lambda y: [{{'s': y.s, 'n': y.s + y.n}}]), lambda a, b: list_concat(a, [{{'s': greatest(b[1].s, a[len(a)].n), 'n': greatest(b[1].s, a[len(a)].n) + b[1].n - b[1].s}}])) AS y FROM c) SELECT cap, u.s AS s, u.n AS e FROM (SELECT cap, unnest(y) AS u FROM p) z""")  # fmt: skip
def caption_pacing(spark, sf_dir):
    """Captions one after another, each for as long as its text takes to read (here an hour for a second).

    A caption starts at its own time or where the one before ends: the greatest over all before of their time and the reading since, a running maximum.
    """
    rows = load_events(spark, sf_dir).where("kind = 'assist'").select("cap", "id", "t", (F.least(400_000 + 45_000 * F.floor("v"), F.lit(3_000_000)) * 3600).alias("n"))
    order = Window.partitionBy("cap").orderBy("t", "id")
    rows = rows.withColumn("done", F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    start = F.max(F.col("t") - F.col("done")).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("done")
    return rows.withColumn("s", start).select("cap", "s", (F.col("s") + F.col("n")).alias("e"))


@query("text_rows", EV + """, w AS (SELECT cap, id, t, v, CASE WHEN v - lag(v) OVER (PARTITION BY cap ORDER BY v, id) <= 0.5 THEN 0 ELSE 1 END AS f FROM ev WHERE kind = 'shot'), g AS (SELECT *, sum(f) OVER (PARTITION BY cap ORDER BY v, id) AS line FROM w)
 SELECT cap, CAST(line AS BIGINT) AS line, string_agg(CAST(id AS VARCHAR), ' ' ORDER BY t, id) AS text FROM g GROUP BY cap, line""")  # fmt: skip
def text_rows(spark, sf_dir):
    """Words whose heights lie close together are one row, read from left to right."""
    words = intervals.islands(load_events(spark, sf_dir).where("kind = 'shot'").select("cap", "id", "t", "v"), "cap", "v", 0.5, into="line")
    return words.groupBy("cap", "line").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t", "id"))), lambda x: x["id"].cast("string")), " ").alias("text"))


@query("filled_templates", r"""WITH f AS (SELECT s_suppkey, replace(replace(replace('{game} | {hook} | {kills} kills — {missing}', '{game}', s_name), '{hook}', CASE WHEN s_suppkey % 3 = 0 THEN 'ACE' ELSE '' END), '{kills}', CAST(s_nationkey AS VARCHAR)) AS t FROM supplier),
 c AS (SELECT s_suppkey, regexp_replace(regexp_replace(t, ' {2,}', ' ', 'g'), '\s*([—|·])(\s*[—|·])+\s*', ' \1 ', 'g') AS t FROM f) SELECT s_suppkey, trim(regexp_replace(regexp_replace(t, '^[—|·:, -]+', ''), '[—|·:, -]+$', '')) AS title FROM c""")  # fmt: skip
def filled_templates(spark, sf_dir):
    """Templates with their fields filled in; separators that an empty field leaves behind go, unknown fields stay."""
    values = {"game": F.col("s_name"), "hook": F.when(F.col("s_suppkey") % 3 == 0, "ACE").otherwise(""), "kills": F.col("s_nationkey").cast("string")}
    text = F.lit("{game} | {hook} | {kills} kills — {missing}")
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    text = F.regexp_replace(F.regexp_replace(text, " {2,}", " "), r"\s*([—|·])(\s*[—|·])+\s*", " $1 ")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.trim(F.regexp_replace(F.regexp_replace(text, "^[—|·:, -]+", ""), "[—|·:, -]+$", "")).alias("title"))


@query("tag_lists", """WITH t AS (SELECT p_size, 'tag ' || p_name AS tag, min(p_partkey) AS k FROM part GROUP BY ALL), l AS (SELECT p_size, list({'t': [tag], 'n': length(tag) + 2} ORDER BY k) AS x FROM t GROUP BY p_size),
 f AS (SELECT p_size, list_reduce(x, lambda a, b: CASE WHEN a.n + 1 + b.n <= 120 THEN {'t': list_concat(a.t, b.t), 'n': a.n + 1 + b.n} ELSE a END) AS y FROM l) SELECT p_size, array_to_string(y.t, ',') AS tags, CAST(y.n AS BIGINT) AS n FROM f""")  # fmt: skip
def tag_lists(spark, sf_dir):
    """Distinct tags in order, as many as fit the greatest length (tags with a space count their quotes, and commas between); one that doesn't fit is left out, shorter ones may follow."""
    tags = table(spark, sf_dir, "part").groupBy("p_size", F.concat(F.lit("tag "), "p_name").alias("tag")).agg(F.min("p_partkey").alias("k"))
    lists = tags.groupBy("p_size").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "tag"))), lambda x: F.struct(F.array(x["tag"]).alias("t"), (F.length(x["tag"]) + 2).cast("long").alias("n"))).alias("x"))
    join = lambda a, b: F.when(a["n"] + 1 + b["n"] <= 120, F.struct(F.concat(a["t"], b["t"]).alias("t"), (a["n"] + 1 + b["n"]).alias("n"))).otherwise(a)
    best = F.aggregate(F.slice("x", 2, 1 << 20), F.element_at("x", 1), join)
    return lists.select("p_size", best.alias("y")).select("p_size", F.array_join("y.t", ",").alias("tags"), "y.n")


@query("metadata_problems", r"""SELECT doc_id, array_to_string(list_filter([CASE WHEN trim(left(coalesce(text, ''), 120)) = '' THEN 'no title' END, CASE WHEN length(left(text, 120)) > 100 THEN 'title too long' END, CASE WHEN octet_length(encode(text)) > 5000 THEN 'description too long' END, CASE WHEN regexp_matches(text, '[<>]') THEN 'angle brackets' END, CASE WHEN NOT regexp_matches(source, '^[0-9]+$') THEN 'category' END], lambda x: x IS NOT NULL), ';') AS problems FROM documents""")
def metadata_problems(spark, sf_dir):
    """What keeps a text from being published, as a list."""
    title = F.substring("text", 1, 120)
    found = F.array(
        F.when(F.trim(F.coalesce(title, F.lit(""))) == "", "no title"), F.when(F.length(title) > 100, "title too long"), F.when(F.octet_length("text") > 5000, "description too long"),
        F.when(F.col("text").rlike("[<>]"), "angle brackets"), F.when(~F.col("source").rlike("^[0-9]+$"), "category"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.filter(found, lambda x: x.isNotNull()), ";").alias("problems"))


@query("plural_forms", """SELECT p_partkey, p_size AS n, CASE WHEN p_size = 1 THEN 'one' ELSE 'other' END AS english, CASE WHEN p_size < 2 THEN 'one' ELSE 'other' END AS french, CASE WHEN p_size % 10 = 1 AND p_size % 100 <> 11 THEN 'one' WHEN p_size % 10 BETWEEN 2 AND 4 AND p_size % 100 NOT BETWEEN 12 AND 14 THEN 'few' ELSE 'many' END AS slavic, 'other' AS japanese FROM part""")
def plural_forms(spark, sf_dir):
    """Which form of a noun goes with a number, by families of languages."""
    n = F.col("p_size")
    slavic = F.when((n % 10 == 1) & (n % 100 != 11), "one").when((n % 10).between(2, 4) & ~(n % 100).between(12, 14), "few").otherwise("many")
    return table(spark, sf_dir, "part").select("p_partkey", n.alias("n"), F.when(n == 1, "one").otherwise("other").alias("english"), F.when(n < 2, "one").otherwise("other").alias("french"), slavic.alias("slavic"), F.lit("other").alias("japanese"))


# Learners -----------------------------------------------------------------------------------------------------------------------------------------

@query("clip_lengths", EV + GROUPS + """, l AS (SELECT cap % 7 AS profile, e - s AS x, row_number() OVER (PARTITION BY cap % 7 ORDER BY e - s) AS n, count(*) OVER (PARTITION BY cap % 7) AS c FROM gr WHERE kills >= 2), m AS (SELECT profile, min(x) FILTER (WHERE n = c // 2 + 1) AS med, min(c) AS c FROM l GROUP BY profile),
 d AS (SELECT l.profile, med, m.c, abs(x - med) AS d, row_number() OVER (PARTITION BY l.profile ORDER BY abs(x - med)) AS n FROM l JOIN m USING (profile)) SELECT profile, min(med) AS length, min(d) FILTER (WHERE n = c // 2 + 1) AS spread, min(c) AS n FROM d GROUP BY profile HAVING min(c) >= 3""")  # fmt: skip
def clip_lengths(spark, sf_dir):
    """The usual length of clips for each profile, an upper median with its deviation, from three on."""
    rows = kill_groups(spark, sf_dir).where("kills >= 2").select((F.col("cap") % 7).alias("profile"), (F.col("e") - F.col("s")).alias("x"))

    def upper(rows: DataFrame, x: str, into: str) -> DataFrame:
        own = Window.partitionBy("profile")
        ranked = rows.withColumns({"n": F.row_number().over(own.orderBy(x)), "c": F.count("*").over(own)})
        return ranked.where(F.col("n") == F.floor(F.col("c") / 2) + 1).select("profile", F.col(x).alias(into), F.col("c").alias(f"{into}_n"))

    middle = upper(rows, "x", "length")
    apart = upper(rows.join(middle, "profile").withColumn("d", F.abs(F.col("x") - F.col("length"))), "d", "spread")
    return middle.join(apart, "profile").where("length_n >= 3").select("profile", "length", "spread", F.col("length_n").alias("n"))


@query("trait_gates", """WITH s AS (SELECT d.lang AS trait, d.source, l.quality AS q FROM documents d JOIN labels l USING (doc_id) WHERE quality IS NOT NULL), t AS (SELECT sum(q) / (count(*) + 4) AS base, count(*) AS n FROM s),
 g AS (SELECT trait, count(*) AS n, count(DISTINCT source) AS actions, least(greatest(1.5 * (sum(q) / (count(*) + 4) - any_value(base)), -0.75), 0.75) AS taste FROM s, t GROUP BY trait) SELECT trait, n, round(CASE WHEN n < 5 OR actions < 3 OR abs(taste) < 0.01 THEN 0 ELSE taste END, 3) AS taste FROM g""")  # fmt: skip
def trait_gates(spark, sf_dir):
    """Shrunk taste for each trait; 0 with too few edits or actions, and in the dead zone; three digits."""
    s = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").where("quality is not null").select(F.col("lang").alias("trait"), "source", F.col("quality").alias("q"))
    base = s.agg((F.sum("q") / (F.count("*") + 4)).alias("base"))  # one row
    by = s.groupBy("trait").agg(F.count("*").alias("n"), F.count_distinct("source").alias("actions"), (F.sum("q") / (F.count("*") + 4)).alias("own")).crossJoin(F.broadcast(base))
    taste = F.least(F.greatest(1.5 * (F.col("own") - F.col("base")), F.lit(-0.75)), F.lit(0.75))
    return by.select("trait", "n", F.round(F.when((F.col("n") < 5) | (F.col("actions") < 3) | (F.abs(taste) < 0.01), 0.0).otherwise(taste), 3).alias("taste"))


@query("gated_offsets", EV + """, m AS (SELECT cap, v - 50 AS x, median(v - 50) OVER (PARTITION BY cap) AS med FROM ev WHERE kind = 'shot'), r AS (SELECT cap, min(med) AS med, median(abs(x - med)) AS mad, count(*) AS n FROM m GROUP BY cap)
 SELECT cap, n, round(CASE WHEN n < 4 OR mad > 28 OR abs(med) < 2 THEN 0 ELSE least(greatest(med, -15), 15) END, 6) AS shift FROM r""")  # fmt: skip
def gated_offsets(spark, sf_dir):
    """The offset of each source: its median, capped; 0 with few samples, a wide spread, or in the dead zone."""
    rows = load_events(spark, sf_dir).where("kind = 'shot'").select("cap", (F.col("v") - 50).alias("x")).withColumn("med", F.median("x").over(Window.partitionBy("cap")))
    by = rows.groupBy("cap").agg(F.min("med").alias("med"), F.median(F.abs(F.col("x") - F.col("med"))).alias("mad"), F.count("*").alias("n"))
    shift = F.when((F.col("n") < 4) | (F.col("mad") > 28) | (F.abs("med") < 2), 0.0).otherwise(F.least(F.greatest("med", F.lit(-15.0)), F.lit(15.0)))
    return by.select("cap", "n", F.round(shift, 6).alias("shift"))


@query("pin_offsets", EV + """, r AS (SELECT cap, id, v - 50 AS x, row_number() OVER (PARTITION BY cap ORDER BY v, id) AS n, count(*) OVER (PARTITION BY cap) AS c FROM ev WHERE kind = 'kill'),
 a AS (SELECT cap, max(x) FILTER (WHERE n = c // 2) AS p, max(x) FILTER (WHERE n = c // 2 + 1) AS q, max(x) FILTER (WHERE n = c // 2 + 2) AS s FROM r GROUP BY cap),
 l AS (SELECT r.cap, abs(x - CASE WHEN c % 2 = 1 THEN CASE WHEN n < c // 2 + 1 THEN (q + s) / 2 WHEN n = c // 2 + 1 THEN (p + s) / 2 ELSE (p + q) / 2 END ELSE CASE WHEN n <= c // 2 THEN q ELSE p END END) AS e, abs(x) AS b FROM r JOIN a USING (cap) WHERE c >= 3)
 SELECT cap, count(*) AS n, round(avg(e), 6) AS held_out, round(avg(b), 6) AS baseline, avg(e) < 0.9 * avg(b) AS trusted FROM l GROUP BY cap""")  # fmt: skip
def pin_offsets(spark, sf_dir):
    """The error of the median of all other samples, against that of no offset, and whether the offset can be trusted. The other samples' median follows from three ranks."""
    own = Window.partitionBy("cap")
    r = load_events(spark, sf_dir).where("kind = 'kill'").select("cap", (F.col("v") - 50).alias("x"), F.row_number().over(own.orderBy("v", "id")).alias("n"), F.count("*").over(own).alias("c")).withColumn("h", F.floor(F.col("c") / 2))
    at = lambda k: F.max(F.when(F.col("n") == F.col("h") + k, F.col("x"))).over(own)
    r = r.withColumns({"p": at(0), "q": at(1), "s": at(2)}).where("c >= 3")
    odd = F.when(F.col("n") < F.col("h") + 1, (F.col("q") + F.col("s")) / 2).when(F.col("n") == F.col("h") + 1, (F.col("p") + F.col("s")) / 2).otherwise((F.col("p") + F.col("q")) / 2)
    others = F.when(F.col("c") % 2 == 1, odd).otherwise(F.when(F.col("n") <= F.col("h"), F.col("q")).otherwise(F.col("p")))
    by = r.select("cap", F.abs(F.col("x") - others).alias("e"), F.abs("x").alias("b")).groupBy("cap").agg(F.count("*").alias("n"), F.avg("e").alias("e"), F.avg("b").alias("b"))
    return by.select("cap", "n", F.round("e", 6).alias("held_out"), F.round("b", 6).alias("baseline"), (F.col("e") < 0.9 * F.col("b")).alias("trusted"))


@query("pair_agreement", EV + """, p AS (SELECT a.cap, a.id AS won, b.id AS lost, 0.6 * (a.v - b.v) / 100 + 0.4 * ((a.id % 10) - (b.id % 10)) / 10.0 AS d FROM ev a JOIN ev b ON a.cap = b.cap AND a.kind = 'kill' AND b.kind = 'kill' AND a.t // 86400000000 = b.t // 86400000000 AND a.v > b.v)
 SELECT cap, count(*) AS pairs, round(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), 6) AS agreement, round(avg(ln(1 + exp(-4 * d))), 6) AS loss FROM p GROUP BY cap""")  # fmt: skip
def pair_agreement(spark, sf_dir):
    """How often given weights put the chosen of two above the other, and their logistic loss; pairs are those of one day."""
    k = load_events(spark, sf_dir).where("kind = 'kill'").select("cap", "id", F.floor(F.col("t") / (24 * HOUR)).alias("day"), "v")
    a, b = k.toDF("cap", "won", "day", "v"), k.toDF("cap", "lost", "day", "w")
    d = 0.6 * (F.col("v") - F.col("w")) / 100 + 0.4 * ((F.col("won") % 10) - (F.col("lost") % 10)) / 10.0
    rows = a.join(b, ["cap", "day"]).where("v > w").withColumn("d", d)
    return rows.groupBy("cap").agg(F.count("*").alias("pairs"), F.round(F.avg(F.when(F.col("d") > 0, 1.0).otherwise(0.0)), 6).alias("agreement"), F.round(F.avg(F.log(1 + F.exp(-4 * F.col("d")))), 6).alias("loss"))

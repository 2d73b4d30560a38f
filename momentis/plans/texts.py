"""Text, vector, map and JSON functions over documents, conversations, pages and embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from momentis.functions import events as fn
from momentis.operators import folds
from momentis.plans.moments import EV
from momentis.plans.registry import query
from momentis.session import table


@query("letters", r"""SELECT doc_id, regexp_replace(translate(translate(upper(replace(text, 'ß', 'ss')), 'ÀÂÄÁÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜ', 'AAAAAACEEEEIIIINOOOOOUUUU'), '01|!5$8', 'OIIISSB'), '[^A-Z]', '', 'g') AS letters FROM documents""")
def letters(spark, sf_dir):
    """Misread text as plain capitals."""
    return table(spark, sf_dir, "documents").select("doc_id", fn.letters(F.col("text")).alias("letters"))


@query("redaction", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+', '<email>', 'g'), 'Bearer [A-Za-z0-9._-]+', 'Bearer <token>', 'g'),
 '(password|token|secret)( ?[=:] ?"?)[A-Za-z0-9]+', '\1\2<secret>', 'g'), '(/home/|/Users/)[A-Za-z0-9._-]+', '\1<user>', 'g') AS text FROM documents""")  # fmt: skip
def redaction(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", fn.redacted(F.col("text")).alias("text"))


@query("timecodes", EV + " SELECT id, printf('%d:%02d:%02d.%03d', ms // 3600000, (ms // 60000) % 60, (ms // 1000) % 60, ms % 1000) AS code FROM (SELECT id, t // 1000 AS ms FROM ev)")
def timecodes(spark, sf_dir):
    return fn.load_events(spark, sf_dir).select("id", fn.timecode(F.col("t")).alias("code"))


@query("durations", EV + " SELECT id, (t // 1000000) // 3600 || 'h' || ((t // 1000000) // 60) % 60 || 'm' || (t // 1000000) % 60 || 's' AS text, (t // 1000000) * 1000000 AS us FROM ev")
def durations(spark, sf_dir):
    """Durations formatted from events and parsed again; the tests hold the parser against fixed texts."""
    e = fn.load_events(spark, sf_dir)
    s = F.floor(F.col("t") / 1_000_000).cast("long")
    text = F.concat(F.floor(s / 3600).cast("string"), F.lit("h"), (F.floor(s / 60) % 60).cast("string"), F.lit("m"), (s % 60).cast("string"), F.lit("s"))
    return e.select("id", text.alias("text"), fn.duration_us(text).alias("us"))


@query("json_params", EV + " SELECT id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM ev")
def json_params(spark, sf_dir):
    return fn.load_events(spark, sf_dir).select("id", F.from_json("props", "k long")["k"].alias("k"))


@query("rounding", EV + " SELECT id, floor(v * 100 + 0.5) / 100 AS rounded, round(1 - least(greatest((v - 20.0) / 60.0, 0), 1), 9) AS share FROM ev")
def rounding(spark, sf_dir):
    """Half-up rounding and linear falloff."""
    return fn.load_events(spark, sf_dir).select("id", fn.rounded(F.col("v"), 2).alias("rounded"), F.round(fn.falloff(F.col("v"), 20.0, 80.0), 9).alias("share"))


@query("fingerprints", "SELECT doc_id, substr(sha256(lang || '|' || source || '|' || CAST(n_chars AS VARCHAR)), 1, 24) AS fingerprint FROM documents")
def fingerprints(spark, sf_dir):
    """The first twelve bytes of a digest over canonical fields."""
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.sha2(F.concat_ws("|", "lang", "source", F.col("n_chars").cast("string")), 256), 1, 24).alias("fingerprint"))


@query("caption_cleaning", r"""WITH c AS (SELECT conv_id, turn, role, trim(regexp_replace(regexp_replace(text, '\[[^\]]*\]|\([^)]*\)|\*[^*]*\*', '', 'g'), '\s+', ' ', 'g')) AS text FROM conversations)
 SELECT conv_id, turn, text FROM c WHERE regexp_matches(text, '[A-Za-z]')""")  # fmt: skip
def caption_cleaning(spark, sf_dir):
    """Sound tags stripped, white space collapsed; captions without letters dropped."""
    bare = F.trim(F.regexp_replace(F.regexp_replace("text", r"\[[^\]]*\]|\([^)]*\)|\*[^*]*\*", ""), r"\s+", " "))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", bare.alias("text"))
    return rows.where(F.col("text").rlike("[A-Za-z]"))


@query("near_repeats", """WITH c AS (SELECT conv_id, turn, lower(trim(text)) AS k, text FROM conversations), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, k ORDER BY turn) AS n FROM c) SELECT conv_id, turn, n FROM r WHERE n > 1""")
def near_repeats(spark, sf_dir):
    """Captions that repeat an earlier one of their conversation."""
    n = F.row_number().over(Window.partitionBy("conv_id", "k").orderBy("turn"))
    return table(spark, sf_dir, "conversations").withColumn("k", F.lower(F.trim("text"))).withColumn("n", n.cast("long")).where("n > 1").select("conv_id", "turn", "n")


@query("slugs", r"SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace(F.lower("url"), "[^a-z0-9]+", "-"), "^-+|-+$", "").alias("slug"))


@query("profile_resolution", """WITH p(id, needle, priority) AS (VALUES ('blog', 'blog.', 2), ('mobile', '//m.', 3), ('french', '/fr/', 1), ('english', '/en/', 1)),
 m AS (SELECT page_id, id, row_number() OVER (PARTITION BY page_id ORDER BY priority DESC, id) AS n FROM pages JOIN p ON contains(lower(url), needle))
 SELECT pages.page_id, coalesce(id, 'default') AS profile FROM pages LEFT JOIN m ON pages.page_id = m.page_id AND n = 1""")  # fmt: skip
def profile_resolution(spark, sf_dir):
    """The profile of highest priority whose needle a path holds, else the default. The four rules become one expression, so no join is needed."""
    rules = sorted([("blog", "blog.", 2), ("mobile", "//m.", 3), ("french", "/fr/", 1), ("english", "/en/", 1)], key=lambda x: (-x[2], x[0]))
    url = F.lower("url")
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(*(F.when(F.contains(url, F.lit(needle)), name) for name, needle, _ in rules), F.lit("default")).alias("profile"))


@query("cosine_to_centroid", """WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
 f AS (SELECT label, vec_id, v, min(vec_id) OVER (PARTITION BY label) AS first FROM e), a AS (SELECT label, v AS c FROM f WHERE vec_id = first)
 SELECT e.vec_id, round(list_cosine_similarity(e.v, a.c), 6) AS cosine FROM e JOIN a USING (label)""")  # fmt: skip
def cosine_to_centroid(spark, sf_dir):
    """Cosine of each vector to the first of its label."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c"))
    return e.join(first, "label").select("vec_id", F.round(fn.cosine(F.col("embedding"), F.col("c")), 6).alias("cosine"))


@query("shape_dice", """WITH f AS (SELECT label, arg_min(embedding, vec_id) AS c FROM embeddings GROUP BY label), n AS (SELECT vec_id, len(list_filter(embedding, lambda x: x > 0)) + len(list_filter(c, lambda x: x > 0)) AS lit,
 len(list_filter(list_zip(embedding, c), lambda z: z[1] > 0 AND z[2] > 0)) AS both_lit FROM embeddings JOIN f USING (label)) SELECT vec_id, CASE WHEN lit = 0 THEN 0 ELSE round(2.0 * both_lit / lit, 6) END AS dice FROM n""")  # fmt: skip
def shape_dice(spark, sf_dir):
    """How much of each vector's positive part it shares with the first of its label."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c"))
    return e.join(first, "label").select("vec_id", F.round(fn.dice(F.col("embedding"), F.col("c"), 0.0), 6).alias("dice"))


#: Letters of the phrases that a task holds at once, and captions it compares with them.
PHRASE_LETTERS, CAPTIONS = 1 << 17, 256


@query("fuzzy_needles")
def fuzzy_needles(spark, sf_dir):
    """The first benchmark phrase (its item, by number) that lies in a caption within a fifth of its length in edits; phrases and captions whole.

    Every caption meets every block of phrases: both are dealt out by block and part, a block's phrases come first in the sorted rows and the part's captions pass by them.
    `folds.Needles` finds the phrases with enough pieces on neighbouring diagonals of a caption and compares those. Phrases of one letter at most lie in every caption.
    """
    phrases = table(spark, sf_dir, "benchmark").select("item_id", F.coalesce(fn.letters(F.col("text")), F.lit("")).alias("needle")).where("item_id IS NOT NULL")
    anywhere = phrases.where("length(needle) <= 1").agg(F.min("item_id")).first()[0]
    cut = phrases.where("length(needle) > 1").groupBy("needle").agg(F.min("item_id").cast("long").alias("item"))
    captions = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(fn.letters(F.col("text")), F.lit("")).alias("letters")).withColumn("tid", F.md5("letters"))
    blocks = (cut.agg(F.sum(F.length("needle"))).first()[0] or 0) // PHRASE_LETTERS + 1
    parts = captions.count() // CAPTIONS + 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda x, n: F.pmod(F.xxhash64(x), F.lit(n)).cast("int")
    sought = cut.select(dealt("needle", blocks).alias("block"), every(parts).alias("part"), "item", F.lit(None).cast("string").alias("tid"), F.col("needle").alias("letters"))
    held = captions.select("tid", "letters").dropDuplicates(["tid"]).select(every(blocks).alias("block"), dealt("tid", parts).alias("part"), F.lit(None).cast("long").alias("item"), "tid", "letters")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, items, needles, block = None, [], [], None
        for batch in batches:
            found = []
            for *own, item, tid, letters in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if own != key:
                    key, items, needles, block = own, [], [], None
                if tid is None:
                    items.append(item)
                    needles.append(letters)
                    continue
                block = block or folds.Needles(needles)
                k = block.first(letters)
                if k is not None:
                    found.append((tid, items[k]))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.int64())], ["tid", "item"])

    met = sought.unionByName(held).repartition("block", "part").sortWithinPartitions("block", "part", F.asc_nulls_last("item"))
    first = met.mapInArrow(compared, "tid string, item long").groupBy("tid").agg(F.min("item").alias("item"))
    rule = F.least(F.col("item"), F.lit(anywhere).cast("long"))
    return captions.join(first, "tid", "left").select("conv_id", "turn", rule.alias("rule"))


@query("map_functions", EV + """, m AS (SELECT cap, kind, count(*) AS n FROM ev GROUP BY ALL) SELECT cap, coalesce(max(n) FILTER (WHERE kind = 'kill'), 0) AS kills, coalesce(max(n) FILTER (WHERE kind = 'death'), 0) AS deaths, count(*) AS kinds FROM m GROUP BY cap""")
def map_functions(spark, sf_dir):
    """Counts by kind as a map, read back with defaults."""
    counts = fn.load_events(spark, sf_dir).groupBy("cap", "kind").agg(F.count("*").alias("n"))
    maps = counts.groupBy("cap").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("m"))
    return maps.select("cap", F.coalesce(F.try_element_at("m", F.lit("kill")), F.lit(0)).alias("kills"), F.coalesce(F.try_element_at("m", F.lit("death")), F.lit(0)).alias("deaths"), F.size("m").cast("long").alias("kinds"))


@query("label_agreement", """SELECT source, count(*) AS n, round(avg(quality), 6) AS quality, CAST(sum(toxic) AS BIGINT) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY source""")
def label_agreement(spark, sf_dir):
    both = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    return both.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg("quality"), 6).alias("quality"), F.sum("toxic").cast("long").alias("toxic"))

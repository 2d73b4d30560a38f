"""Quality rules of documents and of the hosts they come from, in DataFrame functions only.

Each text gives counts (words, characters in words, symbols, repeated lines, words in repeated five-word windows), a base verdict and two
weaker signs (many symbols, many repeated lines). Per host (the `source` column) the failures of each rule are added up. Failures are
beta-binomial: each rule's prior is fitted to all hosts by moments, weighted by their documents and with the binomial part of the
variance taken off, and shrinks a host's rate to (failures + a) / (documents + a + b). A host's verdict follows its posterior:

* rejected: the rate of some rule is over `HOST_LIMIT` at `SURE` standard deviations; all its documents go;
* suspect under a rule: the rate is over `FACTOR` times that of all documents at `SURE` standard deviations; its documents that fail that
  rule go. Elsewhere a weak sign alone condemns no document.

So few documents can't condemn a host, and a clean document goes only with a host of which most fails.

Scale: one pass over the texts that stays in the row (no shuffle of texts or words); host sums are pre-aggregated; the verdicts of hosts
are broadcast only if the table of condemned hosts has at most `BROADCAST_HOSTS` rows, else they are joined by a shuffle whose large keys
adaptive execution splits.

Windows are compared by 64-bit hashes within one text. Null and empty texts have no words and fail the base rules; very long texts are
measured whole; a null source is a host of its own; repeated rows count each; ids may be null or repeated; an empty table gives an empty
result; other columns pass, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from momentis.llm.common import WORD_BREAK, materialize

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_SYMBOL_PERCENT = 10
MAX_LINE_PERCENT = 30
HOST_LIMIT = 0.5
FACTOR = 2.0
SURE = 1.645
BROADCAST_HOSTS = 100_000
WINDOW = 5
RULES = ("base", "symbols", "lines")


def _repeat_words(words: Column, n: Column) -> Column:
    """Words inside windows of five that the text holds at least twice."""
    starts = F.sequence(F.lit(1), n - WINDOW + 1)
    hashes = F.transform(starts, lambda i: F.xxhash64(*(F.element_at(words, i + k) for k in range(WINDOW))))
    return F.when(n >= WINDOW, hashes)


def _pairs(hashes: Column) -> Column:
    """(hash, place) of each window, sorted."""
    return F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _places(pairs: Column) -> Column:
    """Sorted places of the windows that stand beside one of the same hash."""
    beside = F.transform(pairs, lambda p, k: F.when(F.coalesce(F.get(pairs, k - 1)["h"] == p["h"], F.lit(False)) | F.coalesce(F.get(pairs, k + 1)["h"] == p["h"], F.lit(False)), p["i"]))
    return F.sort_array(F.filter(beside, lambda i: i.isNotNull()))


def _reach(places: Column) -> Column:
    """Length of the union of [p, p + 5) over sorted places."""
    return F.aggregate(
        places,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"],
    )


def _with(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with more columns, through a generator of one row each: what follows can't be moved before it, so that no
    filter or later column repeats the work of these."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the counts of each text under names with a leading `q_`, and `q_base` for a failure of the base rules."""
    own = _with(docs, q_text=F.coalesce(F.col(f"`{text}`"), F.lit("")))
    lines = F.filter(F.split("q_text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    own = _with(own, q_words=F.filter(F.split("q_text", WORD_BREAK), lambda w: w != ""), q_lines=lines)
    own = _with(
        own,
        q_n_words=F.size("q_words").cast("long"),
        q_word_chars=F.length(F.array_join("q_words", "")).cast("long"),
        q_n_symbols=F.regexp_count("q_text", F.lit(r"[#*$%&|<>]")).cast("long"),
        q_n_lines=F.size("q_lines").cast("long"),
        q_n_dup_lines=(F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        q_hashes=_repeat_words(F.col("q_words"), F.size("q_words")),
    ).drop("q_words", "q_lines", "q_text")
    own = _with(own, q_pairs=F.when(F.size(F.array_distinct("q_hashes")) < F.size("q_hashes"), _pairs(F.col("q_hashes")))).drop("q_hashes")
    own = _with(own, q_places=_places(F.col("q_pairs"))).drop("q_pairs")
    own = _with(own, q_n_repeat_words=F.coalesce(_reach(F.col("q_places")), F.lit(0)).cast("long")).drop("q_places")
    return _with(own, q_base=(F.col("q_n_words") < MIN_WORDS) | (100 * F.col("q_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("q_n_words")))


def failures() -> dict[str, Column]:
    """Whether a measured text fails each rule that hosts are judged by."""
    return {
        "base": F.col("q_base"),
        "symbols": 100 * F.col("q_n_symbols") > MAX_SYMBOL_PERCENT * F.col("q_word_chars"),
        "lines": 100 * F.col("q_n_dup_lines") > MAX_LINE_PERCENT * F.col("q_n_lines"),
    }


def condemned_hosts(rows: DataFrame, host: str = "source") -> DataFrame:
    """Hosts (column q_host) with a verdict: q_bad_host, and q_suspect_ and the rule for each rule; rows are measured."""
    sums = rows.groupBy(F.col(f"`{host}`").alias("q_host")).agg(F.count("*").alias("n"), *(F.count_if(x).alias(k) for k, x in failures().items()))
    sums = materialize(sums)
    totals = sums.agg(F.sum("n").alias("all"), F.count("*").alias("hosts"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), *(F.sum(k).alias(f"t_{k}") for k in RULES))
    with_mean = sums.crossJoin(F.broadcast(totals))  # one row
    spread = [F.sum(F.col("n") * F.pow(F.col(k) / F.col("n") - F.col(f"t_{k}") / F.col("all"), 2)).alias(f"v_{k}") for k in RULES]
    prior = totals.crossJoin(F.broadcast(with_mean.agg(*spread)))  # one row
    bad, suspect = F.lit(False), {}
    for k in RULES:
        m = F.col(f"t_{k}") / F.col("all")
        # Of the spread between hosts, what binomial chance alone doesn't give: the correlation r of two documents of a host, a + b = 1 / r - 1.
        excess = F.col(f"v_{k}") / (m * (1 - m)) - (F.col("hosts") - 1)
        scale = F.col("all") - F.col("squares") / F.col("all") - (F.col("hosts") - 1)
        r = F.when((m > 0) & (m < 1) & (scale > 0), F.least(F.greatest(excess / scale, F.lit(0.001)), F.lit(0.5))).otherwise(F.lit(0.5))
        strength = 1 / r - 1
        rate = (F.col(k) + m * strength) / (F.col("n") + strength)
        sure = rate - SURE * F.sqrt(rate * (1 - rate) / (F.col("n") + strength + 1))
        bad = bad | (sure > HOST_LIMIT)
        suspect[f"q_suspect_{k}"] = sure > FACTOR * m
    judged = sums.crossJoin(F.broadcast(prior)).select("q_host", bad.alias("q_bad_host"), *(x.alias(n) for n, x in suspect.items()))
    return judged.where(" or ".join(["q_bad_host", *suspect]))


def with_host_verdict(rows: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """rows with q_kept."""
    if verdicts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        verdicts = F.broadcast(verdicts)
    gone = F.col("q_base") | F.coalesce("q_bad_host", F.lit(False))
    for k, failed in failures().items():
        gone = gone | (F.coalesce(f"q_suspect_{k}", F.lit(False)) & failed)
    return rows.join(verdicts, F.col(f"`{host}`").eqNullSafe(F.col("q_host")), "left").withColumn("q_kept", ~gone)


def keep_good(docs: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """The rows of docs that the rules keep. Texts are measured once: rows and flags are written, without a shuffle."""
    names = docs.columns
    inner = [f"_k{i}" for i in range(len(names))]
    own = docs.select(*(F.col(f"`{x}`").alias(y) for x, y in zip(names, inner, strict=True)))
    host = inner[names.index(host)]
    rows = materialize(measured(own, inner[names.index(text)]))
    kept = with_host_verdict(rows, materialize(condemned_hosts(rows, host)), host).where("q_kept")
    return kept.select(*(F.col(y).alias(x) for x, y in zip(names, inner, strict=True)))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows = materialize(measured(docs).drop("text"))
    judged = with_host_verdict(rows, materialize(condemned_hosts(rows)))
    counts = [F.col(f"q_{x}").alias(x) for x in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *counts, F.col("q_base").alias("base_failed"), F.col("q_kept").alias("kept"))


OP3_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, source FROM documents),
w AS (SELECT rid, doc_id, source, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM docs),
g AS (SELECT rid, i, list_slice(words, i, i + 4) AS gram FROM w, unnest(range(1, CASE WHEN len(words) >= 5 THEN len(words) - 3 ELSE 1 END)) AS t(i)),
pp AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, sum(least(5, d)) AS n FROM (SELECT rid, coalesce(lead(i) OVER (PARTITION BY rid ORDER BY i) - i, 5) AS d FROM pp) GROUP BY rid),
m AS (SELECT w.rid, doc_id, source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
             CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN rep ON w.rid = rep.rid),
f AS (SELECT *, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed, 100 * n_symbols > 10 * word_chars AS symbols, 100 * n_dup_lines > 30 * n_lines AS lines_failed FROM m),
k AS (SELECT source, rule, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE failed) AS DOUBLE) AS k
      FROM (SELECT source, unnest([{'rule': 'b', 'failed': base_failed}, {'rule': 's', 'failed': symbols}, {'rule': 'l', 'failed': lines_failed}], recursive := true) FROM f) GROUP BY source, rule),
t AS (SELECT rule, sum(n) AS docs, count(*) AS hosts, sum(n * n) AS squares, sum(k) / sum(n) AS m FROM k GROUP BY rule),
v AS (SELECT rule, sum(n * (k / n - m) * (k / n - m)) AS v FROM k JOIN t USING (rule) GROUP BY rule),
z AS (SELECT rule, m, CASE WHEN m > 0 AND m < 1 AND docs - squares / docs - (hosts - 1) > 0
             THEN least(greatest((v / (m * (1 - m)) - (hosts - 1)) / (docs - squares / docs - (hosts - 1)), 0.001), 0.5) ELSE 0.5 END AS r FROM t JOIN v USING (rule)),
p AS (SELECT source, rule, m, n + 1 / r - 1 AS w, (k + m * (1 / r - 1)) / (n + 1 / r - 1) AS q FROM k JOIN z USING (rule)),
y AS (SELECT source, rule, m, q - 1.645 * sqrt(q * (1 - q) / (w + 1)) AS low FROM p),
h AS (SELECT source, bool_or(low > 0.5) AS bad, bool_or(rule = 's' AND low > 2 * m) AS sus_s, bool_or(rule = 'l' AND low > 2 * m) AS sus_l FROM y GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT (base_failed OR bad OR (sus_s AND symbols) OR (sus_l AND lines_failed)) AS kept
FROM f JOIN h ON h.source IS NOT DISTINCT FROM f.source
"""

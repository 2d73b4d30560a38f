"""Conversation structure repair: faults of each turn by windows, and the cheapest edits to `(s?(ua)+)?` by a fold in Spark SQL functions.

A conversation's turns are taken by turn (nulls first), then role and text. A turn's first fault counts: blank (no character but ASCII
white space), duplicate (its role and text stand earlier) or truncated (the last character that is no white space ends no sentence).
The edits of turns are K (keep, 0), R (give it the role user or assistant, 2), D (delete, 3; a must for blank and duplicate turns) and
I (an empty user or assistant turn before the next one or at the end, 2); a truncated turn that stays adds 1. The fold `aggregate()`
carries for each of the four places of the pattern (nothing yet, after s, after u, after a) the least struct (cost, audit) that leads
there. The edits of a row set alone fix its cost, so no two audits of one cost are beginnings of one another: a least audit stays
least whatever follows, and both the fold and its blocks below keep the ASCII-least audit.

Scale: conversations whose turns lie in one block of `BLOCK` turn numbers take one shuffle, by conversation, which windows, lists and folds
share. Longer ones (found beforehand from ids and turn numbers alone) are split into blocks by turn number: each block is folded from
each of the four places, and a second fold joins the blocks' ways, so no task sorts or folds a whole long conversation; only the
result row has a conversation's length. Earlier turns of other blocks are found by a pre-aggregated join on role and text.

Null roles and texts read as one space (so a null text is blank); null turns come first, all in one block; an id may be null (a
conversation of its own); very long texts are taken whole; equal rows are duplicates of the first; equal turns are put in order by role
and text; a conversation without rows (see `present`) has no edits; an empty table gives an empty result; only the four columns named
are read, so other columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024
BROADCAST_LONG = 100_000
STATES = ("none", "s", "u", "a")
_SPACE = r"[^\x20\x09-\x0D]"


def damage(rows: DataFrame) -> DataFrame:
    """The rows with made faults, by a checksum of `conv_id:turn`; a dropped row stays with `present` false and names its conversation only."""
    text = F.coalesce("text", F.lit(" "))
    case = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    own = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), case.alias("case"))
    here = F.col("case") != 0
    changed = own.select(
        "conv_id",
        F.when(here, F.col("turn")).alias("turn"),
        F.when(F.col("case") == 4, F.lit("user")).when(here, F.col("role")).alias("role"),
        F.when(F.col("case") == 1, F.lit("")).when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).when(here, F.col("text")).alias("text"),
        here.alias("present"),
        F.when(F.col("case") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))).alias("copies"),
    )
    return changed.select("conv_id", "turn", "role", "text", "present", F.explode("copies")).drop("col")


#: The cost of a place that no edits reach: over any real cost.
_NEVER = 1 << 40


def _let(value: Column, body) -> Column:
    """body of a value that is evaluated once, however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _plus(way: Column, cost: Column | int, letter: Column | str) -> Column:
    """A way with one more edit."""
    letter = F.lit(letter) if isinstance(letter, str) else letter
    return F.struct((way["cost"] + cost).alias("cost"), F.concat(way["audit"], letter).alias("audit"))


def _ways(*found: Column) -> Column:
    return F.struct(*(x.alias(n) for x, n in zip(found, STATES, strict=True)))


def _closed(ways: Column) -> Column:
    """Ways with the turns that may be inserted next: a user turn after all but u, an assistant turn after u."""
    open_u = lambda w: F.least(w["none"], w["s"], w["a"])
    return _let(ways, lambda w: _let(open_u(w), lambda o: _let(F.least(w["u"], _plus(o, 2, "I")), lambda u: _ways(w["none"], w["s"], u, F.least(w["a"], _plus(u, 2, "I"))))))


def _step(w: Column, t: Column) -> Column:
    """Closed ways after one more turn; w are closed."""
    more = t["truncated"].cast("long")
    free = ~(t["blank"] | t["duplicate"])

    def taken(way: Column, initial: str) -> Column:
        same = t["initial"] == initial
        return F.when(free, _plus(way, F.when(same, more).otherwise(more + 2), F.when(same, F.lit("K")).otherwise(F.lit("R"))))

    return _closed(
        _ways(
            _plus(w["none"], 3, "D"),
            F.least(_plus(w["s"], 3, "D"), F.when(free & (t["initial"] == "s"), _plus(w["none"], more, "K"))),
            F.least(_plus(w["u"], 3, "D"), _let(F.least(w["none"], w["s"], w["a"]), lambda o: taken(o, "u"))),
            F.least(_plus(w["a"], 3, "D"), taken(w["u"], "a")),
        )
    )


def _start(place: int) -> Column:
    """Ways at the start of a block entered at a place."""
    return _ways(*(F.struct(F.lit(0 if k == place else _NEVER).cast("long").alias("cost"), F.lit("").alias("audit")) for k in range(4)))


def _folded(turns: Column, place: int) -> Column:
    return F.aggregate(turns, _closed(_start(place)), _step)


def _finished(ways: Column) -> Column:
    """The cheapest way that ends the conversation well."""
    return F.least(ways["none"], ways["a"])


def _flagged(rows: DataFrame, keys: list[str], seen: Column | None = None) -> DataFrame:
    """The rows of each group with their faults; `seen` tells that role and text stand in an earlier group of the conversation."""
    # Rows without presence stand last, so that no turn follows one.
    order = [F.col("present").desc(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    blank = ~F.col("text").rlike(_SPACE)
    again = F.row_number().over(Window.partitionBy(*keys, "role", "text").orderBy(F.col("present").desc(), F.col("turn").asc_nulls_first())) > 1
    own = rows.withColumn("again", again if seen is None else (again | seen))
    within = Window.partitionBy(*keys).orderBy(*order)
    own = own.select(
        *keys, "present", "turn", "role", "text", F.row_number().over(within).alias("n"), F.substring("role", 1, 1).alias("initial"),
        F.lag(F.substring("role", 1, 1)).over(within).alias("before"), blank.alias("blank"), (~blank & F.col("again")).alias("duplicate"),
    )
    ends = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    return own.withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & ~F.substring(ends, -1, 1).isin(".", "!", "?"))


def _gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A row per group: counts, and its turns as a sorted array."""
    here = F.col("present")
    illegal = here & F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")
    # A deleted turn's text is never read again.
    text = F.when(~F.col("blank") & ~F.col("duplicate"), F.col("text"))
    turn = F.struct("n", "initial", "blank", "duplicate", "truncated", "role", text.alias("text"))
    counts = [F.count_if(here & F.col(x)).alias(x) for x in ("blank", "duplicate", "truncated")]
    return rows.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.when(here, turn))).alias("turns"), *counts, F.count_if(illegal).alias("illegal"),
        F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count_distinct("turn").alias("distinct_turns"),
    )


def _letters(audit: Column) -> Column:
    """The audit cut by turns: the insertions before a turn with its own letter, and those at the end."""
    return F.regexp_extract_all(audit, F.lit("(I*[KRD]|I+$)"))


def _edited(turns: Column, letters: Column, before: Column | int, odd: Column) -> Column:
    """The (role, text) that the letters make of the turns; before: turns that stand before them in the repaired conversation.

    odd: whether the repaired conversation has a first s, which only its length being odd tells; the roles after it alternate.
    """
    single = F.flatten(
        F.transform(
            letters,
            lambda x, i: F.transform(
                F.filter(F.split(x, ""), lambda c: ~c.isin("", "D")),
                lambda c: F.struct((c == "K").alias("keep"), (c == "I").alias("new"), F.get(turns, i)["role"].alias("role"), F.get(turns, i)["text"].alias("text")),
            ),
        )
    )
    kind = lambda j: F.when((F.lit(before) + j - odd) % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))
    return F.transform(single, lambda c, j: F.struct(F.when(c["keep"], c["role"]).otherwise(kind(j)).alias("role"), F.when(c["new"], F.lit("")).otherwise(c["text"]).alias("text")))


def _stay(audit: Column) -> Column:
    """How many turns an audit leaves or makes."""
    return F.length(F.translate(audit, "D", ""))


_OUT = ["blank", "duplicate", "truncated", "illegal"]


def _gaps(first: str, last: str, distinct: str) -> Column:
    return F.coalesce(F.col(last) - F.col(first) + 1 - F.col(distinct), F.lit(0)).alias("gaps")


def _barrier(rows: DataFrame, **columns: Column) -> DataFrame:
    """rows with more columns that later steps read without evaluating them anew."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def _short(rows: DataFrame) -> DataFrame:
    own = _gathered(_flagged(rows.repartition("conv_id"), ["conv_id"]), ["conv_id"])
    own = _barrier(_barrier(own, ways=_folded(F.col("turns"), 0)), way=_finished(F.col("ways")))
    audit = F.col("way.audit")
    repaired = _edited(F.col("turns"), _letters(audit), 0, _stay(audit) % 2)
    return own.select("conv_id", _gaps("first_turn", "last_turn", "distinct_turns"), *_OUT, F.col("way.cost").alias("cost"), audit.alias("audit"), repaired.alias("repaired"))


def _joined(ways: Column, block: Column) -> Column:
    """Ways over one more block: block has its own ways from each place."""

    def both(a: Column, b: Column) -> Column:
        return F.struct((a["cost"] + b["cost"]).alias("cost"), F.concat(a["audit"], b["audit"]).alias("audit"))

    return _ways(*(F.least(*(both(ways[p], F.get(block["ways"], k)[q]) for k, p in enumerate(STATES))) for q in STATES))


def _long(rows: DataFrame) -> DataFrame:
    """The same for conversations of several blocks."""
    same = [F.col(f"f.{x}").eqNullSafe(F.col(f"r.{x}")) for x in ("conv_id", "role", "text")]
    firsts = rows.where("present").groupBy("conv_id", "role", "text").agg(F.min("block").alias("first_block"))
    known = rows.alias("r").join(firsts.alias("f"), same, "left").select("r.*", "first_block")
    keys = ["conv_id", "block"]
    # The blocks are written once: the second fold and the repaired texts both read them.
    from momentis.llm.common import materialize

    flagged = _flagged(known, keys, F.coalesce(F.col("first_block") < F.col("block"), F.lit(False)))
    own = materialize(_gathered(flagged, keys).withColumn("ways", F.array(*(_folded(F.col("turns"), k) for k in range(4)))))
    edge = F.struct(F.get("turns", F.lit(0))["initial"].alias("first"), F.get("turns", F.size("turns") - 1)["initial"].alias("last"))
    parts = F.sort_array(F.collect_list(F.struct("block", "ways", F.size("turns").alias("n"), edge.alias("edge"))))
    sums = [F.sum(x).alias(x) for x in (*_OUT, "distinct_turns")]
    convs = own.groupBy("conv_id").agg(parts.alias("blocks"), *sums, F.min("first_turn").alias("first_turn"), F.max("last_turn").alias("last_turn"))
    convs = _barrier(_barrier(convs, ways=F.aggregate("blocks", _start(0), _joined)), way=_finished(F.col("ways")))
    full = F.filter("blocks", lambda b: b["n"] > 0)
    convs = _barrier(convs, letters=_letters(F.col("way.audit")), odd=_stay(F.col("way.audit")) % 2, full=full)
    crossings = F.transform(F.slice("full", 2, F.greatest(F.size("full") - 1, F.lit(0))), lambda b, i: F.concat(F.get("full", i)["edge"]["last"], b["edge"]["first"]))
    legal = F.array(F.lit("su"), F.lit("ua"), F.lit("au"))
    convs = convs.withColumn("illegal", F.col("illegal") + F.size(F.filter(crossings, lambda x: ~F.array_contains(legal, x))))
    ends = F.aggregate("blocks", F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + b["n"])))
    spread = convs.withColumn("ends", ends).select("conv_id", "letters", "odd", "ends", F.posexplode("blocks").alias("k", "b"))
    begin, last = F.get("ends", F.col("k")), F.col("k") == F.size("ends") - 2
    count = F.when(last, F.size("letters") - begin).otherwise(F.col("b.n"))
    before = _stay(F.array_join(F.slice("letters", 1, begin), ""))
    spread = spread.select("conv_id", F.col("b.block").alias("block"), "k", F.slice("letters", begin + 1, count).alias("letters"), before.alias("before"), "odd")
    meet = [F.col("o.conv_id").eqNullSafe(F.col("s.conv_id")), F.col("o.block") == F.col("s.block")]
    texts = own.select(*keys, "turns").alias("o").join(spread.alias("s"), meet).select("s.conv_id", "k", _edited(F.col("turns"), F.col("letters"), F.col("before"), F.col("odd")).alias("part"))
    texts = texts.groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "part"))), lambda x: x["part"])).alias("repaired"))
    found = convs.alias("c").join(texts.alias("t"), F.col("c.conv_id").eqNullSafe(F.col("t.conv_id")))
    return found.select("c.conv_id", _gaps("first_turn", "last_turn", "distinct_turns"), *_OUT, F.col("way.cost").alias("cost"), F.col("way.audit").alias("audit"), "repaired")


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Per conversation of the rows (conv_id, turn, role, text and, if given, present): gaps between turns, faults, and the cheapest edits.

    Columns: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, and repaired, an array of (role, text).
    """
    present = F.col("present") if "present" in rows.columns else F.lit(True)
    texts = [F.when(present, F.coalesce(x, F.lit(" "))).alias(x) for x in ("role", "text")]
    # Blocks in turn order; what has no turn comes first, what is not present counts for no block.
    place = F.when(present, F.coalesce(F.floor(F.col("turn") / block).cast("long"), F.lit(-(1 << 62))))
    own = rows.select("conv_id", F.when(present, F.col("turn")).cast("long").alias("turn"), *texts, present.alias("present"), place.alias("block"))
    long = own.groupBy("conv_id").agg(F.min("block").alias("low"), F.max("block").alias("high")).where("low < high").select(F.col("conv_id").alias("long_id"))
    some = long.limit(BROADCAST_LONG + 1).count()
    if not some:
        return _short(own)
    if some <= BROADCAST_LONG:
        long = F.broadcast(long)
    at = F.col("conv_id").eqNullSafe(F.col("long_id"))
    several = own.join(long, at, "left_semi").withColumn("block", F.coalesce("block", F.lit(1 << 62)))
    return _short(own.join(long, at, "left_anti")).unionByName(_long(several))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    found = repair(damage(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    joined = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    longs = [F.col(x).cast("long").alias(x) for x in ("gaps", *_OUT, "cost")]
    return found.select("conv_id", *longs, "audit", F.sha2(joined, 256).alias("repaired_sha256"))


def _p(way: str, cost: str, letter: str) -> str:
    """A way in SQL, its cost in ten digits and its audit, with one more edit."""
    return f"(printf('%010d', CAST(left({way}, 10) AS BIGINT) + {cost}) || substr({way}, 11) || {letter})"


OP13_SQL = rf"""
WITH RECURSIVE tab AS (SELECT list(list_reduce(list_prepend(CAST(b AS BIGINT), [CAST(k AS BIGINT) FOR k IN range(8)]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS crc FROM range(256) AS r(b)),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
summed AS (SELECT raw.* EXCLUDE key, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), [CAST(ord(c) AS BIGINT) FOR c IN string_split(key, '')]),
             lambda c, b: xor(tab.crc[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS kind FROM raw, tab),
dam AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
               CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM summed, range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END) AS c(i)),
num AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM dam),
lst AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, left(role, 1) AS ini,
               lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) AS prev FROM num),
flt AS (SELECT conv_id, n, turn, role, text, ini, prev, blank, NOT blank AND again AS dup, NOT blank AND NOT again AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS trunc FROM lst),
cid AS (SELECT DISTINCT conv_id FROM conversations),
dp AS (SELECT conv_id, 0 AS n, '0000000000' AS z, CAST(NULL AS VARCHAR) AS s, CAST(NULL AS VARCHAR) AS u, CAST(NULL AS VARCHAR) AS a FROM cid
  UNION ALL
  SELECT conv_id, n, {_p("z", "3", "'D'")}, CASE WHEN NOT gone AND ini = 's' THEN least({_p("s", "3", "'D'")}, {_p("z", "t", "'K'")}) ELSE {_p("s", "3", "'D'")} END,
         CASE WHEN gone THEN {_p("u", "3", "'D'")} ELSE least({_p("u", "3", "'D'")}, {_p("least(b, a)", "t + CASE WHEN ini = 'u' THEN 0 ELSE 2 END", "CASE WHEN ini = 'u' THEN 'K' ELSE 'R' END")}) END,
         CASE WHEN gone THEN {_p("a", "3", "'D'")} ELSE least({_p("a", "3", "'D'")}, {_p("u", "t + CASE WHEN ini = 'a' THEN 0 ELSE 2 END", "CASE WHEN ini = 'a' THEN 'K' ELSE 'R' END")}) END
  FROM (SELECT conv_id, n, z, s, b, u, least(a, {_p("u", "2", "'I'")}) AS a, ini, gone, t
        FROM (SELECT conv_id, n, z, s, b, least(u, {_p("b", "2", "'I'")}) AS u, a, ini, gone, t
              FROM (SELECT f.conv_id, f.n, z, s, least(z, s, a) AS b, u, a, f.ini, f.blank OR f.dup AS gone, CAST(f.trunc AS BIGINT) AS t
                    FROM dp JOIN flt f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.n = dp.n + 1)))),
fin AS (SELECT conv_id, least(z, a, {_p("u", "2", "'I'")}, {_p("least(z, s, a)", "4", "'II'")}) AS way FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) AS r FROM dp) WHERE r = 1),
ops AS (SELECT conv_id, i, substr(way, CAST(i + 10 AS BIGINT), 1) AS op FROM fin, range(1, length(way) - 9) AS g(i)),
plc AS (SELECT conv_id, i, op, count(*) FILTER (WHERE op <> 'I') OVER (PARTITION BY conv_id ORDER BY i) AS n, count(*) FILTER (WHERE op <> 'D') OVER (PARTITION BY conv_id ORDER BY i) AS j,
               count(*) FILTER (WHERE op <> 'D') OVER (PARTITION BY conv_id) AS total FROM ops),
txt AS (SELECT plc.conv_id, string_agg(CASE WHEN op = 'K' THEN f.role WHEN (j - 1 - total % 2) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN op = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY i) AS repaired
        FROM plc LEFT JOIN flt f ON f.conv_id IS NOT DISTINCT FROM plc.conv_id AND f.n = plc.n WHERE op <> 'D' GROUP BY plc.conv_id),
cnt AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
               count(*) FILTER (WHERE trunc) AS truncated, count(*) FILTER (WHERE prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM flt GROUP BY conv_id)
SELECT cid.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       CAST(left(way, 10) AS BIGINT) AS cost, substr(way, 11) AS audit, sha256(coalesce(repaired, '')) AS repaired_sha256
FROM cid JOIN fin ON fin.conv_id IS NOT DISTINCT FROM cid.conv_id LEFT JOIN cnt ON cnt.conv_id IS NOT DISTINCT FROM cid.conv_id LEFT JOIN txt ON txt.conv_id IS NOT DISTINCT FROM cid.conv_id
"""

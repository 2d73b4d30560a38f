"""The event model over the driver's tables, and scalar expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from momentis.session import table

HOUR = 3_600_000_000
DAY = 24 * HOUR
#: 2024-01-01 in microseconds; captures last 30 days from there.
ORIGIN = 1_704_067_200_000_000
TOTAL = 30 * DAY

KINDS = {"purchase": "kill", "error": "death", "signup": "headshot", "click": "shot", "view": "assist"}


def load_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of captures: cap, id, t (microseconds from the origin), kind, v."""
    e = table(spark, sf_dir, "events")
    kind = F.lit(None).cast("string")
    for own, name in KINDS.items():
        kind = F.when(F.col("event_type") == own, name).otherwise(kind)
    return e.select(F.col("user_id").alias("cap"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) - ORIGIN).alias("t"), kind.alias("kind"), F.col("value").alias("v"), "props")


def rounded(x: Column, digits: int) -> Column:
    """Half up towards positive infinity."""
    return F.floor(x * 10**digits + F.lit(0.5)) / 10**digits


def clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def falloff(x: Column, good: float, bad: float) -> Column:
    """1 up to good, 0 from bad, linear between."""
    return 1 - clamp((x - good) / (bad - good), 0.0, 1.0)


def duration_us(text: Column) -> Column:
    """Microseconds of a duration: `90`, `12.5s`, `1h2m3.5s300ms`, `m:ss.fff`, `h:mm:ss`, ISO `PT1M2S`, any with a leading minus; else null."""
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    x = F.regexp_replace(F.lower(F.trim(text)), r"^-", "")
    iso = F.regexp_replace(x, "^pt", "")
    number = r"\d+(?:\.\d+)?"

    def part(unit: str) -> Column:
        return F.coalesce(F.regexp_extract(iso, rf"({number}){unit}(?![a-z])", 1).try_cast("double"), F.lit(0.0))

    units = part("h") * 3600 + part("m") * 60 + part("s") + part("ms") / 1000
    clock = F.split(x, ":")
    clocked = F.aggregate(F.transform(clock, lambda p: p.try_cast("double")), F.lit(0.0), lambda a, p: a * 60 + p)
    seconds = (
        F.when(x.rlike(rf"^{number}$"), x.try_cast("double"))
        .when(x.rlike(r"^\d+(:\d{1,2}){1,2}(\.\d+)?$"), clocked)
        .when(iso.rlike(rf"^({number}h)?({number}m)?({number}s)?({number}ms)?$") & (iso != ""), units)
    )
    return F.round(sign * seconds * 1e6).cast("long")


def timecode(us: Column) -> Column:
    """`h:mm:ss.mmm`."""
    ms = F.floor(us / 1000).cast("long")
    return F.format_string("%d:%02d:%02d.%03d", F.floor(ms / 3_600_000).cast("long"), F.floor(ms / 60_000).cast("long") % 60, F.floor(ms / 1000).cast("long") % 60, ms % 1000)


def letters(text: Column) -> Column:
    """Upper-case letters of a misread text: accents stripped, signs that stand for letters read as these."""
    plain = F.translate(F.upper(text), "ÀÂÄÁÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜ", "AAAAAACEEEEIIIINOOOOOUUUU")
    return F.regexp_replace(F.translate(plain, "01|!5$8", "OIIISSB"), "[^A-Z]", "")


def redacted(text: Column) -> Column:
    """Addresses, bearer tokens, assigned secrets and home folders blanked."""
    out = F.regexp_replace(text, r"[A-Za-z0-9._+-]+@[A-Za-z0-9.-]+\.[A-Za-z]+", "<email>")
    out = F.regexp_replace(out, r"Bearer [A-Za-z0-9._-]+", "Bearer <token>")
    out = F.regexp_replace(out, r"(password|token|secret)( ?[=:] ?\"?)[A-Za-z0-9]+", "$1$2<secret>")
    return F.regexp_replace(out, r"(/home/|/Users/)[A-Za-z0-9._-]+", "$1<user>")


def dice(a: Column, b: Column, bright: float) -> Column:
    """Likeness of two shapes, the components above `bright`: twice those in both over those in either, 0 where neither has any."""
    lit = lambda x: x > bright
    both = F.size(F.filter(F.zip_with(a, b, lambda x, y: lit(x) & lit(y)), lambda x: x))
    all_ = F.size(F.filter(a, lit)) + F.size(F.filter(b, lit))
    return F.when(all_ == 0, 0.0).otherwise(2.0 * both / F.greatest(all_, F.lit(1)))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, z: s + z)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))

"""Counters, scores, keys and buckets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def engagement(views: Column, likes: Column, comments: Column, fallback: Column) -> Column:
    """Weighted counters; the fallback where none of them is known."""
    signal = F.coalesce(views, F.lit(0)) * 0.2 + F.coalesce(likes, F.lit(0)) * 1.5 + F.coalesce(comments, F.lit(0)) * 3.0
    return F.when(signal > 0, signal).otherwise(fallback)


def trend_score(views: Column, likes: Column, comments: Column) -> Column:
    return views * 0.5 + likes * 2.0 + comments * 3.0


def days_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400_000_000.0


def views_per_day(views: Column, age_days: Column) -> Column:
    return views / F.greatest(age_days, F.lit(1.0))


def engagement_rate(views: Column, likes: Column, comments: Column) -> Column:
    return F.when(views > 0, (likes + comments) / views)


def performance(per_day: Column, rate: Column) -> Column:
    return F.round(F.log1p(per_day) * (1 + F.least(rate * 10, F.lit(1.0))), 6)


def iso_seconds(text: Column) -> Column:
    """Seconds of PnDTnHnMnS; null if it is no such text."""
    of = lambda unit: F.coalesce(F.when(F.regexp_extract(text, rf"([0-9]+){unit}", 1) != "", F.regexp_extract(text, rf"([0-9]+){unit}", 1).cast("long")), F.lit(0))
    ok = text.rlike(r"^P(?:[0-9]+D)?(?:T(?:[0-9]+H)?(?:[0-9]+M)?(?:[0-9]+S)?)?$")
    return F.when(ok, of("D") * 86400 + of("H") * 3600 + of("M") * 60 + of("S"))


def count_text(text: Column) -> Column:
    """The number that a text such as 1.2M+ or 12,345 views stands for; null if none."""
    plain = F.upper(F.regexp_replace(text, ",", ""))
    number = F.regexp_extract(plain, r"([0-9]+(?:\.[0-9]+)?)\s*([KMB]?)", 1)
    unit = F.regexp_extract(plain, r"([0-9]+(?:\.[0-9]+)?)\s*([KMB]?)", 2)
    scale = F.when(unit == "K", 1000).when(unit == "M", 1_000_000).when(unit == "B", 1_000_000_000).otherwise(1)
    return F.when(number != "", (number.cast("decimal(18,3)") * scale.cast("long")).cast("long"))


def video_id(url: Column) -> Column:
    """The 11-character id of a video URL in its watch, short and path forms; null for other hosts and forms."""
    host = F.regexp_extract(url, r"^https?://(?:www\.|m\.)?([^/?#]+)", 1)
    found = F.when(host == "youtu.be", F.regexp_extract(url, r"youtu\.be/([A-Za-z0-9_-]{11})(?:[/?#]|$)", 1)).when(
        host == "youtube.com",
        F.coalesce(
            F.nullif(F.regexp_extract(url, r"/watch\?(?:[^#]*&)?v=([A-Za-z0-9_-]{11})(?:[&#]|$)", 1), F.lit("")),
            F.regexp_extract(url, r"/(?:shorts|embed|live)/([A-Za-z0-9_-]{11})(?:[/?#]|$)", 1),
        ),
    )
    return F.nullif(found, F.lit(""))


def stable_key(platform: Column, url: Column, title: Column) -> Column:
    return F.sha1(F.concat_ws("|", platform, F.coalesce(F.nullif(url, F.lit("")), title)))


def age_bucket(days: Column) -> Column:
    return (
        F.when(days.isNull(), "unknown").when(days < 0, "invalid").when(days < 7, "0-7").when(days < 30, "7-30").when(days < 90, "30-90")
        .when(days < 365, "90-365").otherwise("365+")
    )


def duration_bucket(seconds: Column) -> Column:
    return F.when(seconds.isNull(), "unknown").when(seconds <= 180, "<=180").otherwise(">180")


def canonical_count(text: Column) -> Column:
    """A non-negative 64-bit count in its plain form; null for signs, leading zeros, fractions and overflow."""
    return F.when(text.rlike("^(?:0|[1-9][0-9]*)$"), text.try_cast("long"))

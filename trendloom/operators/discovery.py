"""Topics found in and counted over observed titles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trendloom.functions.text import STOPWORDS

c = F.col
LAST_RANK = 50


def count_observations(rows: DataFrame, catalog: list[str], by: list[str]) -> DataFrame:
    """Every topic of ``catalog`` for every observation: its number of videos, and how good the observation is.

    ``rows``: ``by``, video_id, rank, place (the order within the observation) and topics (array). Rows are read by rank, then
    place. A row without video or with a rank outside 1 to ``LAST_RANK`` is invalid, a video that was taken before a duplicate,
    a row whose rank was taken before invalid. Which row of a rank is taken depends on the ranks before it, so the
    choice runs through the ranks; as at most 49 videos are taken before a rank, its first 50 different videos suffice,
    and an observation is at most 2,500 short entries in one row, however many rows it has. An observation is complete
    if no row is invalid. Rows with a null in ``by`` belong to no observation and are left out.
    """
    rows = rows.dropna(subset=by)
    ok = c("video_id").isNotNull() & c("rank").between(1, LAST_RANK)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("source_rows"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("_bad"))
    seen = rows.where(ok).groupBy(*by, "rank", "video_id").agg(F.count("*").alias("n"), F.min("place").alias("place"), F.min_by("topics", "place").alias("topics"))
    near = seen.withColumn("_p", F.row_number().over(Window.partitionBy(*by, "rank").orderBy("place", "video_id"))).where(c("_p") <= LAST_RANK)
    ranks = near.groupBy(*by, "rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "video_id"))), lambda x: x.video_id).alias("videos"))
    steps = ranks.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("rank", "videos"))).alias("steps"))
    kind = f"array<struct<rank:{dict(rows.dtypes)['rank']},video_id:{dict(rows.dtypes)['video_id']}>>"

    def step(taken, x):
        fresh = F.filter(x.videos, lambda v: ~F.exists(taken, lambda t: t.video_id == v))
        return F.concat(taken, F.transform(F.slice(fresh, 1, 1), lambda v: F.struct(x.rank.alias("rank"), v.alias("video_id"))))

    taken = steps.select(*by, F.inline(F.aggregate("steps", F.array().cast(kind), step)).alias("_rank", "video_id"))
    placed = seen.join(taken, [*by, "video_id"], "left")
    hit = c("_rank") == c("rank")
    counts = placed.groupBy(*by).agg(
        F.count_if(hit).alias("eligible"), F.coalesce(F.sum(F.when(hit, c("n") - 1).when(c("_rank") < c("rank"), c("n"))), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(F.when(c("_rank").isNull() | (c("_rank") > c("rank")), c("n"))), F.lit(0)).alias("_late"),
    )
    hits = placed.where(hit).select(*by, F.explode(F.array_distinct("topics")).alias("topic")).groupBy(*by, "topic").agg(F.count("*").alias("videos"))
    grid = sizes.join(counts, by, "left").withColumn("topic", F.explode(F.array(*[F.lit(x) for x in catalog]))).join(hits, [*by, "topic"], "left")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("long")
    invalid = zero("_bad") + zero("_late")
    return grid.select(
        *by, "topic", zero("videos").alias("videos"), "source_rows", zero("eligible").alias("eligible"), invalid.alias("invalid"), zero("duplicates").alias("duplicates"),
        F.when(invalid == 0, "complete").otherwise("insufficient_source").alias("quality"),
    )


def discover_topics(titles: DataFrame, longest: int = 3, videos: int = 3, channels: int = 2) -> DataFrame:
    """(phrase, label, n, nc): runs of up to ``longest`` words that enough different titles and channels use.

    ``titles``: video_id, title, channel. Titles that are equal in words and case count once, by the least video_id. A phrase
    neither begins nor ends with a stop word and is no mere number; a title counts once for each of its phrases. The label
    is the commonest spelling, ties the first in order. Titles without words and null titles give nothing; a null channel
    is none.
    """
    words = F.regexp_extract_all("title", F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0))
    t = titles.where("title is not null").select("video_id", "channel", words.alias("w")).where(F.size("w") > 0)
    t = t.groupBy(F.lower(F.array_join("w", " ")).alias("_t")).agg(F.min_by(F.struct("channel", "w"), "video_id").alias("r")).select("_t", "r.*")
    grams = lambda k: F.when(F.size("w") >= k, F.transform(F.sequence(F.lit(1), F.size("w") - (k - 1)), lambda i: F.array_join(F.slice("w", i, k), " "))).otherwise(F.array().cast("array<string>"))
    flat = t.select("_t", "channel", F.posexplode(F.concat(*[grams(k) for k in range(1, longest + 1)])).alias("pos", "surface")).withColumn("phrase", F.lower("surface"))
    edge = ~F.substring_index("phrase", " ", 1).isin(*STOPWORDS) & ~F.substring_index("phrase", " ", -1).isin(*STOPWORDS) & ~c("phrase").rlike("^[0-9 ]+$")
    each = flat.where(edge).groupBy("_t", "channel", "phrase").agg(F.min_by("surface", "pos").alias("surface"))
    spelled = each.groupBy("phrase", "surface").agg(F.count("*").alias("n")).groupBy("phrase").agg(F.sum("n").alias("n"), F.min_by("surface", F.struct(-c("n"), "surface")).alias("label")).where(c("n") >= videos)
    spread = each.where("channel is not null").groupBy("phrase", "channel").agg(F.lit(1).alias("_1")).groupBy("phrase").agg(F.count("*").alias("nc")).where(c("nc") >= channels)
    return spelled.join(spread, "phrase").select("phrase", "label", "n", "nc")

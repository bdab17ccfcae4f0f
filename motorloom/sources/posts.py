"""Posts from channels, result pages and forums, as frames of fetched content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FLOOD = ("подписывайтесь", "розыгрыш", "реклама", "вакансия")


def channel_names(stored: DataFrame, fallback: str) -> DataFrame:
    """Active channels; the comma-separated fallback only if none is stored."""
    clean = lambda c: F.concat(F.lit("@"), F.regexp_replace(F.trim(c), "^(https?://)?(t[.]me/)?@?", ""))
    active = stored.filter("is_active").select(clean(F.col("username")).alias("channel"))
    spare = stored.sparkSession.range(1).select(F.explode(F.split(F.lit(fallback), ",")).alias("u"))
    spare = spare.filter(F.trim("u") != "").select(clean(F.col("u")).alias("channel"))
    none = active.limit(1).agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(F.lit(True).alias("ok"))
    return active.unionByName(spare.join(F.broadcast(none), F.lit(True)).select("channel")).distinct()


def post_title(c: Column) -> Column:
    """First line, or the first 120 characters where that line is short."""
    line = F.trim(F.substring_index(c, "\n", 1))
    return F.when(F.length(line) >= 20, line).otherwise(F.substring(c, 1, 120))


def channel_posts(posts: DataFrame, channel: str, text: str, order: str) -> DataFrame:
    """Posts worth keeping: long enough, no flood words, few links, the first of equal texts of a channel."""
    low = F.lower(F.col(text))
    links = (F.length(low) - F.length(F.replace(low, F.lit("http"), F.lit("")))) / 4
    flood = F.exists(F.array(*(F.lit(w) for w in FLOOD)), lambda w: F.contains(low, w))
    fit = posts.filter((F.length(F.trim(text)) >= 15) & (links <= 5) & ~flood)
    first = fit.groupBy(channel, text).agg(F.min(order).alias(order))
    return first.select(channel, order, post_title(F.col(text)).alias("title"), F.substring(text, 1, 5000).alias("content"))


def thread_links(html: Column, most: int = 100) -> Column:
    """Distinct thread addresses of a forum page, in order."""
    return F.slice(F.array_distinct(F.regexp_extract_all(html, F.lit("href=\"([^\"]*/threads/[^\"]*[.][0-9]+)/?\""), 1)), 1, most)


def card_links(html: Column) -> Column:
    """Listing addresses of a result page: pages deeper than three parts, none denied."""
    all_ = F.array_distinct(F.regexp_extract_all(html, F.lit("href=\"(https?://[^\"#?]+[.]html)"), 1))
    return F.filter(all_, lambda u: (F.size(F.split(u, "/")) > 5) & ~u.rlike("login|help|about|/rules"))


def sample_posts(spark: SparkSession, n: int) -> DataFrame:
    """Generated listings with known mileage, for trials."""
    i = F.col("id")
    return spark.range(n).select(
        "id", F.format_string("https://sample.example/item/%d", i).alias("source_url"),
        F.format_string("Vostrum KG12 2019, пробег %d 000 км, цена 2 500 000 руб", i + 40).alias("content"),
    )

"""Reports over searches, listings and users: frames in, frames out, every "now" a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_counts(rows: DataFrame, by: str, most: int, keep: Column | None = None) -> DataFrame:
    """The most frequent non-null values; ties by value."""
    kept = rows.filter(F.col(by).isNotNull() & (keep if keep is not None else F.lit(True)))
    return kept.groupBy(by).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), by).limit(most)


def newest(rows: DataFrame, at: str, key: str, most: int) -> DataFrame:
    return rows.orderBy(F.desc(at), F.desc(key)).limit(most)


def ratio_by(rows: DataFrame, by: str, flag: Column, digits: int = 3) -> DataFrame:
    """Share of flagged rows per group; a null group is named after grouping."""
    g = rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"), F.count_if(flag).alias("flagged"))
    share = F.round(F.col("flagged").cast("double") / F.col("total"), digits)
    return g.select(F.coalesce(by, F.lit("unknown")).alias(by), "total", "flagged", share.alias("ratio"))


def overall_ratio(rows: DataFrame, flag: Column) -> DataFrame:
    g = rows.agg(F.count(F.lit(1)).alias("total"), F.count_if(flag).alias("flagged"))
    share = F.when(F.col("total") > 0, F.round(F.col("flagged").cast("double") / F.col("total"), 6)).otherwise(F.lit(0.0))
    return g.select("total", "flagged", share.alias("ratio"))


def demand_gap(searches: DataFrame, listings: DataFrame, most: int) -> DataFrame:
    """The most searched brands that no listing has."""
    asked = searches.select(F.get_json_object("structured_query", "$.brand").alias("brand"))
    top = top_counts(asked, "brand", most)
    there = listings.filter("brand is not null").select(F.lower(F.trim("brand")).alias("known")).distinct()
    return top.join(there, F.lower(F.trim("brand")) == F.col("known"), "left_anti")


def thin_sources(raw: DataFrame, normalized: DataFrame, below: float) -> DataFrame:
    """Sources of whose raw rows a small share was normalised."""
    a = raw.groupBy("source").agg(F.count(F.lit(1)).alias("raw_rows"))
    b = normalized.groupBy("source").agg(F.count(F.lit(1)).alias("kept"))
    joined = a.join(b, "source", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    share = F.round(F.col("kept").cast("double") / F.col("raw_rows"), 3)
    return joined.withColumn("ratio", share).filter(F.col("ratio") < below)


def search_stats(searches: DataFrame, as_of: str) -> DataFrame:
    """All counters in one pass over the log."""
    now = F.to_timestamp_ntz(F.lit(as_of))
    today = F.col("created_at") >= F.date_trunc("day", now)
    last = F.col("created_at") >= now - F.expr("INTERVAL 24 HOURS")
    return searches.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(today).alias("today"),
        F.count_if(last).alias("last_24h"),
        F.count_if(today & F.coalesce("empty_result", F.lit(False))).alias("empty_today"),
        F.floor(F.avg("latency_ms")).cast("bigint").alias("avg_latency_ms"),
    )


def latest_per(rows: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.filter(F.col("rn") <= most)


def active_subscription(subscriptions: DataFrame, as_of: str) -> DataFrame:
    """The one valid subscription of each user: open-ended last, latest end first."""
    valid = subscriptions.filter(
        (F.col("status") == "active") & (F.col("expires_at").isNull() | (F.col("expires_at") > F.to_timestamp_ntz(F.lit(as_of))))
    )
    return latest_per(valid, "user_id", [F.desc_nulls_last("expires_at"), F.desc("id")], 1).drop("rn")


def usage(users: DataFrame, searches: DataFrame, favorites: DataFrame, plans: DataFrame, limits: dict[str, int]) -> DataFrame:
    """What each user has left of the quotas; users with a plan have no limit (null)."""
    s = searches.groupBy("user_id").agg(F.count(F.lit(1)).alias("searches"))
    f = favorites.groupBy("user_id").agg(F.count(F.lit(1)).alias("favorites"))
    joined = users.join(s, "user_id", "left").join(f, "user_id", "left").join(plans.select("user_id", "plan"), "user_id", "left")
    out = joined.select("user_id", "plan", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("searches", "favorites")))
    for c, most in limits.items():
        out = out.withColumn(f"{c}_left", F.when(F.col("plan").isNull(), F.greatest(F.lit(most) - F.col(c), F.lit(0))))
    return out

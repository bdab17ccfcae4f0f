"""State changes as frames: insert-if-absent, upsert, expiry, event folds, new-item detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def insert_new(new: DataFrame, held: DataFrame, shortest: int = 10) -> DataFrame:
    """New posts with an address and some text whose (source, address) isn't held yet, first of each."""
    fit = new.filter((F.coalesce("source_url", F.lit("")) != "") & (F.length("content") >= shortest))
    fresh = fit.join(held.select("source", "source_url").distinct(), ["source", "source_url"], "left_anti")
    return keep_first(fresh, ["source", "source_url"], ["id"])


def insert_absent(new: DataFrame, held: DataFrame, key: str, order: str) -> DataFrame:
    return keep_first(new.join(held.select(key).distinct(), key, "left_anti"), [key], [order])


def upsert(held: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Last write wins by ``order``."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    rows = held.unionByName(new, allowMissingColumns=True)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def expire(subscriptions: DataFrame, as_of: str) -> DataFrame:
    """Overdue active rows become expired; every user's premium flag follows from what stays active."""
    now = F.to_timestamp_ntz(F.lit(as_of))
    overdue = (F.col("status") == "active") & F.coalesce(F.col("expires_at") < now, F.lit(False))
    out = subscriptions.withColumn("status", F.when(overdue, "expired").otherwise(F.col("status")))
    return out.withColumn("is_premium", F.max(F.col("status") == "active").over(Window.partitionBy("user_id")))


def replace_active(subscriptions: DataFrame, new: DataFrame, as_of: str) -> DataFrame:
    """Active rows of users with a new subscription are cancelled; the new rows are added."""
    users = new.select("user_id").distinct().withColumn("_new", F.lit(True))
    old = subscriptions.join(users, "user_id", "left")
    hit = F.col("_new") & (F.col("status") == "active")
    old = old.withColumn("status", F.when(hit, "canceled").otherwise(F.col("status")))
    old = old.withColumn("canceled_at", F.when(hit, F.to_timestamp_ntz(F.lit(as_of)))).drop("_new")
    return old.unionByName(new, allowMissingColumns=True)


def fold_events(events: DataFrame) -> DataFrame:
    """Repeated deliveries within an hour count once; the last event gives the state."""
    hour = F.date_trunc("hour", "ts")
    once = keep_first(events.withColumn("_h", hour), ["user_id", "event_type", "_h"], ["ts", "event_id"])
    return once.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"), F.max_by("event_type", F.struct("ts", "event_id")).alias("last_type"),
        F.countDistinct("event_type").alias("kinds"),
    )


def sliding_count(rows: DataFrame, key: str, at: str, seconds: int, block: int = 24) -> DataFrame:
    """Rows of the same key in the last ``seconds``, the row's own moment included.

    A key's rows are cut into stretches of ``block`` times the span; the last span of a
    stretch is also sent on to the next one, so no key is one group, whatever it holds.
    """
    span = seconds * 1_000_000
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    cut = rows.withColumn("_t", micros).withColumn("_b", F.floor(F.col("_t") / (span * block)))
    near_end = F.col("_t") >= (F.col("_b") + 1) * (span * block) - span
    sent = cut.withColumn("_to", F.explode(F.when(near_end, F.array("_b", F.col("_b") + 1)).otherwise(F.array("_b"))))
    w = Window.partitionBy(key, "_to").orderBy("_t").rangeBetween(-span, 0)
    counted = sent.withColumn("n", F.count(F.lit(1)).over(w))
    return counted.filter("_to <=> _b").drop("_t", "_b", "_to")


def new_items(rows: DataFrame, marks: DataFrame, key: str, item: str, order: list[Column], most: int) -> DataFrame:
    """Items ranked before the last seen one; all if it is gone; none on the first run (no marker).

    Only the first ``most`` of a key count, so each task sends no more than those on.
    """
    ranked = rows.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("pos") <= most)
    joined = ranked.join(marks, key).filter("marker is not null")
    at = F.min(F.when(F.col(item) == F.col("marker"), F.col("pos"))).over(Window.partitionBy(key))
    return joined.withColumn("_at", at).filter(F.col("_at").isNull() | (F.col("pos") < F.col("_at"))).select(key, item)


def within_budget(rows: DataFrame, order: str, cost: str, budget: int, block: int = 1024) -> DataFrame:
    """Rows, in order, while the running cost stays within the budget.

    Costs aren't negative, so sums of large blocks come first, and only the blocks that
    begin within the budget are looked into: blocks of ``block`` cubed, squared and plain.
    """
    levels = [block**3, block**2, block]
    open_ = None
    for k, size in enumerate(levels):
        part = rows.withColumn("_b", F.floor(F.col(order) / size)).withColumn("_up", F.floor(F.col(order) / levels[k - 1]) if k else F.lit(0).cast("bigint"))
        sums = part.groupBy("_up", "_b").agg(F.coalesce(F.sum(cost), F.lit(0)).alias("_s"))
        sums = sums.withColumn("_start", F.lit(0).cast("bigint")) if open_ is None else sums.join(open_, "_up")
        before = F.coalesce(F.sum("_s").over(Window.partitionBy("_up").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_start")
        open_ = sums.withColumn("_before", before).filter(F.col("_before") <= budget).select(F.col("_b").alias("_up"), F.col("_before").alias("_start"))
    run = F.sum(cost).over(Window.partitionBy("_up").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_start")
    found = rows.withColumn("_up", F.floor(F.col(order) / block)).join(open_, "_up")
    return found.withColumn("_run", run).filter(F.col("_run") <= budget).select(order)

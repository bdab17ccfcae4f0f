"""Analytic queries (A*) and table access (S*)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorloom.operators import analytics as an
from motorloom.operators import lifecycle as life
from motorloom.plans import fixtures as fx
from motorloom.plans.registry import query
from motorloom.sources.tables import table

NOW = "2024-01-05 12:00:00"
PAID_NOW = "2001-08-02 00:00:00"
Frame = DataFrame


def _log(s: SparkSession, d: str) -> Frame:
    return table(s, d, "search_events")


@query("a01_recent_searches", "SELECT id, raw_query, results_count FROM search_events ORDER BY created_at DESC, id DESC LIMIT 20")
def a01(s, d):
    return an.newest(_log(s, d), "created_at", "id", 20).select("id", "raw_query", "results_count")


@query("a02_top_queries", "SELECT raw_query, count(*) AS n FROM search_events WHERE raw_query IS NOT NULL GROUP BY 1 ORDER BY n DESC, raw_query LIMIT 50")
def a02(s, d):
    return an.top_counts(_log(s, d), "raw_query", 50)


@query("a03_empty_queries", "SELECT raw_query, count(*) AS n FROM search_events WHERE raw_query IS NOT NULL AND empty_result GROUP BY 1 ORDER BY n DESC, raw_query LIMIT 50")
def a03(s, d):
    return an.top_counts(_log(s, d), "raw_query", 50, F.col("empty_result"))


@query("a04_top_brands", "SELECT brand, count(*) AS n FROM normalized_documents WHERE brand IS NOT NULL GROUP BY 1 ORDER BY n DESC, brand LIMIT 20")
def a04(s, d):
    return an.top_counts(table(s, d, "normalized_documents"), "brand", 20)


@query("a05_source_noise", """SELECT coalesce(source, 'unknown') AS source, count(*) AS total,
  count(*) FILTER (empty_result) AS flagged, round(count(*) FILTER (empty_result) / count(*)::DOUBLE, 3) AS ratio
  FROM search_events GROUP BY search_events.source""")
def a05(s, d):
    return an.ratio_by(_log(s, d), "source", F.col("empty_result"))


@query("a06_no_results_rate", """SELECT count(*) AS total, count(*) FILTER (empty_result) AS flagged,
  CASE WHEN count(*) > 0 THEN round(count(*) FILTER (empty_result) / count(*)::DOUBLE, 6) ELSE 0.0 END AS ratio FROM search_events""")
def a06(s, d):
    return an.overall_ratio(_log(s, d), F.col("empty_result"))


@query("a07_brand_gap", """WITH t AS (SELECT json_extract_string(structured_query, '$.brand') AS brand, count(*) AS n FROM search_events
  WHERE json_extract_string(structured_query, '$.brand') IS NOT NULL GROUP BY 1 ORDER BY n DESC, brand LIMIT 50)
  SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM part p WHERE lower(trim(p.p_brand)) = lower(trim(t.brand)))""")
def a07(s, d):
    return an.demand_gap(_log(s, d), table(s, d, "part").select(F.col("p_brand").alias("brand")), 50)


@query("a08_thin_sources", """SELECT r.source, r.n AS raw_rows, coalesce(k.n, 0) AS kept, round(coalesce(k.n, 0) / r.n::DOUBLE, 3) AS ratio
  FROM (SELECT source, count(*) n FROM raw_documents GROUP BY 1) r LEFT JOIN (SELECT source, count(*) n FROM normalized_documents GROUP BY 1) k
  ON r.source = k.source WHERE round(coalesce(k.n, 0) / r.n::DOUBLE, 3) < 0.95""")
def a08(s, d):
    return an.thin_sources(table(s, d, "raw_documents"), table(s, d, "normalized_documents"), 0.95)


@query("a09_data_signals", """SELECT 'no_results' AS signal, 'all' AS item, round(count(*) FILTER (empty_result) / count(*)::DOUBLE, 3) AS v FROM search_events
  UNION ALL SELECT 'thin_source', r.source, round(coalesce(k.n, 0) / r.n::DOUBLE, 3)
  FROM (SELECT source, count(*) n FROM raw_documents GROUP BY 1) r LEFT JOIN (SELECT source, count(*) n FROM normalized_documents GROUP BY 1) k
  ON r.source = k.source WHERE round(coalesce(k.n, 0) / r.n::DOUBLE, 3) < 0.95""")
def a09(s, d):
    rate = an.overall_ratio(_log(s, d), F.col("empty_result")).select(F.lit("no_results").alias("signal"), F.lit("all").alias("item"), F.round("ratio", 3).alias("v"))
    thin = an.thin_sources(table(s, d, "raw_documents"), table(s, d, "normalized_documents"), 0.95)
    return rate.unionByName(thin.select(F.lit("thin_source").alias("signal"), F.col("source").alias("item"), F.col("ratio").alias("v")))


@query("a10_search_stats", f"""SELECT count(*) AS total, count(*) FILTER (created_at >= date_trunc('day', TIMESTAMP '{NOW}')) AS today,
  count(*) FILTER (created_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR) AS last_24h,
  count(*) FILTER (created_at >= date_trunc('day', TIMESTAMP '{NOW}') AND empty_result) AS empty_today,
  CAST(floor(avg(latency_ms)) AS BIGINT) AS avg_latency_ms FROM search_events""")
def a10(s, d):
    return an.search_stats(_log(s, d), NOW)


@query("a11_top_queries_day", f"""SELECT raw_query, count(*) AS n, round(avg(latency_ms), 4) AS avg_latency, sum(CAST(empty_result AS INT))::BIGINT AS empty_count
  FROM search_events WHERE created_at >= date_trunc('day', TIMESTAMP '{NOW}') AND raw_query IS NOT NULL
  GROUP BY 1 ORDER BY n DESC, raw_query LIMIT 20""")
def a11(s, d):
    today = _log(s, d).filter((F.col("created_at") >= F.date_trunc("day", F.to_timestamp_ntz(F.lit(NOW)))) & F.col("raw_query").isNotNull())
    g = today.groupBy("raw_query").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 4).alias("avg_latency"), F.sum(F.col("empty_result").cast("int")).alias("empty_count"))
    return g.orderBy(F.desc("n"), "raw_query").limit(20)


@query("a12_latest_payments", f"SELECT id, status, amount FROM ({fx.PAYMENTS_SQL}) ORDER BY paid_at DESC, id DESC LIMIT 50")
def a12(s, d):
    return an.newest(fx.payments(s, d), "paid_at", "id", 50).select("id", "status", "amount")


@query("a13_favorites_top", f"""WITH f AS ({fx.FAVORITES_SQL}), j AS (SELECT l.* FROM f JOIN ({fx.LISTINGS_SQL}) l ON f.listing_id = l.id),
  u AS (SELECT 'brand' AS kind, brand AS v FROM j UNION ALL SELECT 'fuel', fuel FROM j UNION ALL SELECT 'source', source FROM j),
  c AS (SELECT kind, v, count(*) AS n FROM u WHERE v IS NOT NULL GROUP BY 1, 2)
  SELECT kind, v, n FROM c QUALIFY row_number() OVER (PARTITION BY kind ORDER BY n DESC, v) <= 20""")
def a13(s, d):
    j = fx.favorites(s, d).join(fx.listings(s, d), F.col("listing_id") == F.col("id"))
    u = j.select(F.expr("stack(3, 'brand', brand, 'fuel', fuel, 'source', source) AS (kind, v)")).filter("v is not null")
    c = u.groupBy("kind", "v").agg(F.count(F.lit(1)).alias("n"))
    return an.latest_per(c, "kind", [F.desc("n"), F.asc("v")], 20).drop("rn")


@query("a14_user_stats", """SELECT count(*) AS total, count(*) FILTER (c_acctbal > 5000) AS premium, count(*) FILTER (c_acctbal >= 0) AS active,
  count(*) FILTER (c_mktsegment = 'MACHINERY') AS admins FROM customer""")
def a14(s, d):
    return table(s, d, "customer").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("c_acctbal") > 5000).alias("premium"),
        F.count_if(F.col("c_acctbal") >= 0).alias("active"), F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("admins"),
    )


@query("a15_saved_search_stats", f"SELECT status, count(*) AS n, count(*) FILTER (expires_at IS NULL) AS open_ended FROM ({fx.SUBSCRIPTIONS_SQL}) GROUP BY 1")
def a15(s, d):
    return fx.subscriptions(s, d).groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("expires_at").isNull()).alias("open_ended"))


@query("a16_payment_stats", f"""SELECT count(*) AS total, count(*) FILTER (status = 'succeeded') AS succeeded, count(*) FILTER (status = 'failed') AS failed,
  coalesce(sum(amount) FILTER (status = 'succeeded'), 0)::DECIMAL(22,2) AS revenue,
  coalesce(sum(amount) FILTER (status = 'succeeded' AND paid_at >= TIMESTAMP '{PAID_NOW}' - INTERVAL 30 DAY), 0)::DECIMAL(22,2) AS revenue_30d FROM ({fx.PAYMENTS_SQL})""")
def a16(s, d):
    ok = F.col("status") == "succeeded"
    recent = ok & (F.col("paid_at") >= F.to_timestamp_ntz(F.lit(PAID_NOW)) - F.expr("INTERVAL 30 DAYS"))
    money = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0)).cast("decimal(22,2)")
    return fx.payments(s, d).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(F.col("status") == "failed").alias("failed"),
        money(ok).alias("revenue"), money(recent).alias("revenue_30d"),
    )


@query("a17_subscription_stats", f"SELECT status, plan, count(*) AS n FROM ({fx.SUBSCRIPTIONS_SQL}) GROUP BY 1, 2")
def a17(s, d):
    return fx.subscriptions(s, d).groupBy("status", "plan").agg(F.count(F.lit(1)).alias("n"))


@query("a18_notification_stats", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def a18(s, d):
    return table(s, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"))


_ACTIVE = f"""SELECT id, user_id, plan, expires_at FROM ({fx.SUBSCRIPTIONS_SQL}) WHERE status = 'active'
  AND (expires_at IS NULL OR expires_at > TIMESTAMP '{PAID_NOW}') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY expires_at DESC NULLS LAST, id DESC) = 1"""


@query("a19_active_subscription", _ACTIVE)
def a19(s, d):
    return an.active_subscription(fx.subscriptions(s, d), PAID_NOW).select("id", "user_id", "plan", "expires_at")


@query("a20_usage_snapshot", f"""SELECT c.c_custkey AS user_id, a.plan, coalesce(e.n, 0) AS searches, coalesce(f.n, 0) AS favorites,
  CASE WHEN a.plan IS NULL THEN greatest(25 - coalesce(e.n, 0), 0) END AS searches_left,
  CASE WHEN a.plan IS NULL THEN greatest(50 - coalesce(f.n, 0), 0) END AS favorites_left
  FROM customer c LEFT JOIN (SELECT user_id, count(*) n FROM events GROUP BY 1) e ON c.c_custkey = e.user_id
  LEFT JOIN (SELECT user_id, count(*) n FROM ({fx.FAVORITES_SQL}) GROUP BY 1) f ON c.c_custkey = f.user_id LEFT JOIN ({_ACTIVE}) a ON c.c_custkey = a.user_id""")
def a20(s, d):
    users = table(s, d, "customer").select(F.col("c_custkey").alias("user_id"))
    plans = an.active_subscription(fx.subscriptions(s, d), PAID_NOW)
    return an.usage(users, table(s, d, "events"), fx.favorites(s, d), plans, {"searches": 25, "favorites": 50})


@query("a21_alert_queue", f"""SELECT b.id, b.user_id, b.expires_at FROM ({fx.SUBSCRIPTIONS_SQL}) b JOIN customer c ON b.user_id = c.c_custkey
  WHERE b.status = 'active' AND c.c_acctbal >= 0 ORDER BY b.expires_at ASC NULLS FIRST, b.id LIMIT 100""")
def a21(s, d):
    users = table(s, d, "customer").filter("c_acctbal >= 0").select(F.col("c_custkey").alias("user_id"))
    queue = fx.subscriptions(s, d).filter("status = 'active'").join(users, "user_id")
    return queue.orderBy(F.asc_nulls_first("expires_at"), "id").limit(100).select("id", "user_id", "expires_at")


@query("a22_pending_first", f"SELECT id, user_id FROM ({fx.PAYMENTS_SQL}) WHERE status = 'pending' ORDER BY paid_at, id LIMIT 50")
def a22(s, d):
    return fx.payments(s, d).filter("status = 'pending'").orderBy("paid_at", "id").limit(50).select("id", "user_id")


@query("a23_latest_per_user", "SELECT user_id, id, raw_query FROM search_events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) <= 3")
def a23(s, d):
    rows = _log(s, d).filter("user_id is not null")
    return an.latest_per(rows, "user_id", [F.desc("created_at"), F.desc("id")], 3).select("user_id", "id", "raw_query")


@query("a24_system_status", "SELECT (SELECT count(*) FROM raw_documents) AS raw_rows, (SELECT count(*) FROM normalized_documents) AS normalized_rows, (SELECT count(*) FROM document_chunks) AS chunks, (SELECT count(*) FROM vector_points) AS points")
def a24(s, d):
    names = {"raw_rows": "raw_documents", "normalized_rows": "normalized_documents", "chunks": "document_chunks", "points": "vector_points"}
    one = [table(s, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("k"), "n") for k, t in names.items()]
    tall = one[0].unionByName(one[1]).unionByName(one[2]).unionByName(one[3])
    return tall.groupBy().agg(*(F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in names))


@query("a25_history_list", "SELECT id, raw_query, source FROM search_events ORDER BY id DESC LIMIT 50")
def a25(s, d):
    return _log(s, d).orderBy(F.desc("id")).limit(50).select("id", "raw_query", "source")


@query("s01_newest_raw", "SELECT id, source, title FROM raw_documents ORDER BY id DESC LIMIT 500")
def s01(s, d):
    return table(s, d, "raw_documents").orderBy(F.desc("id")).limit(500).select("id", "source", "title")


@query("s02_point_lookup", "SELECT id, source, title FROM raw_documents WHERE id = 77")
def s02(s, d):
    return table(s, d, "raw_documents").filter("id = 77").select("id", "source", "title")


@query("s13_union_sources", "SELECT id, source, content AS body FROM raw_documents UNION ALL SELECT doc_id, source, text FROM documents")
def s13(s, d):
    a = table(s, d, "raw_documents").select("id", "source", F.col("content").alias("body"))
    return a.unionByName(table(s, d, "documents").select(F.col("doc_id").alias("id"), "source", F.col("text").alias("body")))


@query("s14_insert_new", """SELECT id, source, source_url FROM (SELECT * FROM raw_documents WHERE batch_no >= 20 AND source_url IS NOT NULL AND source_url <> '' AND length(content) >= 10) n
  WHERE NOT EXISTS (SELECT 1 FROM raw_documents o WHERE o.batch_no < 20 AND o.source = n.source AND o.source_url = n.source_url)
  QUALIFY row_number() OVER (PARTITION BY source, source_url ORDER BY id) = 1""")
def s14(s, d):
    raw = table(s, d, "raw_documents")
    return life.insert_new(raw.filter("batch_no >= 20"), raw.filter("batch_no < 20")).select("id", "source", "source_url")


@query("s16_upsert", """SELECT source_url, id, batch_no FROM raw_documents WHERE source_url IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY batch_no DESC, id DESC) = 1""")
def s16(s, d):
    raw = table(s, d, "raw_documents").filter("source_url is not null")
    return life.upsert(raw.filter("batch_no < 20"), raw.filter("batch_no >= 20"), "source_url", ["batch_no", "id"]).select("source_url", "id", "batch_no")


@query("s21_counts", "SELECT source, count(*) AS n, count(*) FILTER (indexed) AS indexed FROM raw_documents GROUP BY 1")
def s21(s, d):
    return table(s, d, "raw_documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if("indexed").alias("indexed"))


@query("m01_expire", f"""SELECT id, CASE WHEN status = 'active' AND expires_at < TIMESTAMP '{PAID_NOW}' THEN 'expired' ELSE status END AS status,
  max(CASE WHEN status = 'active' AND (expires_at IS NULL OR expires_at >= TIMESTAMP '{PAID_NOW}') THEN 1 ELSE 0 END) OVER (PARTITION BY user_id) = 1 AS is_premium FROM ({fx.SUBSCRIPTIONS_SQL})""")
def m01(s, d):
    return life.expire(fx.subscriptions(s, d), PAID_NOW).select("id", "status", "is_premium")


@query("m03_first_payment", f"SELECT id, user_id, amount FROM ({fx.PAYMENTS_SQL}) QUALIFY row_number() OVER (PARTITION BY user_id, amount ORDER BY paid_at, id) = 1")
def m03(s, d):
    return life.keep_first(fx.payments(s, d), ["user_id", "amount"], ["paid_at", "id"]).select("id", "user_id", "amount")


@query("m04_event_fold", """SELECT user_id, count(*) AS events, max_by(event_type, (ts, event_id)) AS last_type, count(DISTINCT event_type) AS kinds
  FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type, date_trunc('hour', ts) ORDER BY ts, event_id) = 1) GROUP BY 1""")
def m04(s, d):
    return life.fold_events(table(s, d, "events"))


SPLIT_DATE = "1996-01-01"


@query("m06_insert_absent", f"""SELECT o_orderkey AS id FROM orders n WHERE (o_orderdate >= TIMESTAMP '{SPLIT_DATE}' OR o_orderdate IS NULL)
  AND NOT EXISTS (SELECT 1 FROM orders h WHERE h.o_orderdate < TIMESTAMP '{SPLIT_DATE}' AND h.o_custkey = n.o_custkey)
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""")
def m06(s, d):
    """The whole table without remainder: orders before the date are held, all others are new."""
    rows = table(s, d, "orders").withColumnsRenamed({"o_orderkey": "id", "o_custkey": "dedup_key"})
    held = F.coalesce(F.col("o_orderdate") < F.to_timestamp_ntz(F.lit(SPLIT_DATE)), F.lit(False))
    return life.insert_absent(rows.filter(~held), rows.filter(held), "dedup_key", "id").select("id")


@query("q19_fixed_window", "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1, 2")
def q19a(s, d):
    return table(s, d, "events").groupBy("user_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(F.count(F.lit(1)).alias("n"))


@query("q19_sliding_window", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
def q19b(s, d):
    return life.sliding_count(table(s, d, "events"), "user_id", "ts", 3600).select("event_id", "n")


@query("w03_batch_dedup", "SELECT id FROM raw_documents QUALIFY row_number() OVER (PARTITION BY batch_no, coalesce(nullif(source_url, ''), CAST(id AS VARCHAR)) ORDER BY id) = 1")
def w03(s, d):
    rows = table(s, d, "raw_documents").withColumn("key", F.coalesce(F.nullif("source_url", F.lit("")), F.col("id").cast("string")))
    return life.keep_first(rows, ["batch_no", "key"], ["id"]).select("id")


@query("w05_new_items", """WITH r AS (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS pos FROM search_events WHERE user_id IS NOT NULL),
  m AS (SELECT user_id, max(id) FILTER (id % 5 = 0) AS marker FROM search_events GROUP BY 1)
  SELECT r.user_id, r.id FROM r JOIN m ON r.user_id = m.user_id WHERE m.marker IS NOT NULL AND r.pos <= 20
  AND r.pos < coalesce((SELECT min(k.pos) FROM r k WHERE k.user_id = m.user_id AND k.id = m.marker), 1000000000)""")
def w05(s, d):
    rows = _log(s, d).filter("user_id is not null")
    marks = rows.groupBy("user_id").agg(F.max(F.when(F.col("id") % 5 == 0, F.col("id"))).alias("marker"))
    return life.new_items(rows, marks, "user_id", "id", [F.desc("created_at"), F.desc("id")], 20)


@query("w07_run_limit", "SELECT id FROM (SELECT id, sum(results_count) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS run FROM search_events) WHERE run <= 50")
def w07(s, d):
    return life.within_budget(_log(s, d).select("id", "results_count"), "id", "results_count", 50)


@query("w10_daily_window", "SELECT date_trunc('day', created_at) AS day, count(*) AS n, count(*) FILTER (empty_result) AS empty FROM search_events GROUP BY 1")
def w10(s, d):
    rows = _log(s, d).groupBy(F.date_trunc("day", "created_at").cast("timestamp_ntz").alias("day"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("empty_result").alias("empty"))

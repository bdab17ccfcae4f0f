"""Ranking over the listings for the queries of search_events whose id is divisible by 100 (R6-R8, R12-R18, R23, R24).

A query meets every listing of its brand: a stated query set, joined by brand. The share of
the query's words that the listing's text holds stands in for the vector similarity
(``semantic``) and for ``bm25``.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType, StructField, StructType

from motorloom.functions import extract as ex
from motorloom.functions.text import norm_tok, strict_key
from motorloom.operators import ranking as rk
from motorloom.plans.registry import query
from motorloom.plans.runtime import join_dictionary, stash
from motorloom.sources.tables import table

AS_OF = 1704844800  # 2024-01-10 UTC

_TOK = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[-_/]', ' ', 'g'), '([a-zа-яё])([0-9])', '\1 \2', 'g'), '([0-9])([a-zа-яё])', '\1 \2', 'g'), '[\s\x{{00A0}}]+', ' ', 'g'))"
_STRICT = "replace(replace(replace(lower({0}), '-', ''), '_', ''), ' ', '')"
_FUEL = "".join(
    f" WHEN regexp_matches(q, '{p}') THEN '{f}'"
    for f, p in (
        ("electric", "(^|[^а-яa-z])(электро|электромобиль|electric)([^а-яa-z]|$)"), ("hybrid", "(^|[^а-яa-z])(гибрид|hybrid)([^а-яa-z]|$)"), ("diesel", "(^|[^а-яa-z])(дизель|дизельный|диз|diesel)([^а-яa-z]|$)"),
        ("gas_petrol", "газ/бензин|бензин [+] гбо|(^|[^а-яa-z])lpg([^а-яa-z]|$)"), ("gas", "(^|[^а-яa-z])(газ|метан|пропан)([^а-яa-z]|$)"), ("petrol", "(^|[^а-яa-z])(бензин|бензиновый|бенз|petrol)([^а-яa-z]|$)"),
    )
)
_ASKED = f"""(SELECT DISTINCT id AS query_id, lower(raw_query) AS q, nullif(json_extract_string(structured_query, '$.brand'), '') AS w_brand, nullif(json_extract_string(structured_query, '$.model'), '') AS w_model,
  CASE {_FUEL} END AS w_fuel, 1000 * try_cast(nullif(regexp_extract(q, 'пробег до ([0-9]+) тыс', 1), '') AS BIGINT) AS mileage_max,
  regexp_extract_all(q, '([a-zа-яё0-9][a-zа-яё0-9-]*)', 1) AS words FROM search_events WHERE id % 100 = 0 AND raw_query IS NOT NULL)"""
_PAIRS = f"""(SELECT a.*, n.id, n.title, n.normalized_text AS txt, n.brand, n.model, n.fuel, n.year, n.price, n.mileage, n.source, n.source_url, n.sale_intent, n.created_at_ts
  FROM {_ASKED} a JOIN normalized_documents n ON lower(n.brand) = lower(a.w_brand))"""
_SOFT = f"""coalesce(CASE WHEN regexp_matches(w_model, '[0-9]') THEN {_STRICT.format('model')} = {_STRICT.format('w_model')}
  WHEN {_STRICT.format('model')} = {_STRICT.format('w_model')} AND {_STRICT.format('w_model')} <> '' THEN TRUE WHEN len(ta) = 0 OR len(tb) = 0 THEN FALSE
  WHEN len(tb) = 1 THEN list_contains(ta, tb[1]) OR array_to_string(ta, '') = tb[1]
  ELSE len(list_filter(tb, lambda w: NOT list_contains(ta, w))) = 0 OR starts_with(array_to_string(ta, ''), array_to_string(tb, '')) OR ends_with(array_to_string(ta, ''), array_to_string(tb, '')) OR (len(ta) = 1 AND list_contains(tb, ta[1])) END, FALSE)"""
_TEXT = _TOK.format("concat_ws(' ', brand, model, title, substring(txt, 1, 600))")
_SIGNALS = f"""(SELECT *, least(1.0::DOUBLE, (CAST(coalesce(contains(t, {_TOK.format('w_brand')}), FALSE) AS INT) * 1.5::DOUBLE
    + CAST(coalesce(contains(t, {_TOK.format('w_model')}) OR contains(replace(t, ' ', ''), replace({_TOK.format('w_model')}, ' ', '')), FALSE) AS INT) * 1.5::DOUBLE
    + CAST(coalesce(fuel = w_fuel, FALSE) AS INT) * 0.8::DOUBLE + len(list_filter(words, lambda w: {_TOK.format('w')} <> '' AND contains(t, {_TOK.format('w')}))) * 0.15::DOUBLE) / 3.0::DOUBLE) AS text_match,
  CASE WHEN len(words) = 0 THEN 0.0::DOUBLE ELSE len(list_filter(list_distinct(words), lambda w: contains(lower(txt), w))) / len(list_distinct(words))::DOUBLE END AS semantic,
  least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.0::DOUBLE - ((1704844800 - created_at_ts) / 86400.0::DOUBLE) / 180.0::DOUBLE)) AS freshness,
  (CAST(brand IS NOT NULL AS INT) + CAST(model IS NOT NULL AS INT) + CAST(year IS NOT NULL AS INT) + CAST(price IS NOT NULL AS INT) + CAST(mileage IS NOT NULL AS INT) + CAST(fuel IS NOT NULL AS INT)) / 6.0::DOUBLE AS completeness,
  CASE WHEN price IS NULL THEN 0.15::DOUBLE ELSE greatest(0.0::DOUBLE, 1.0::DOUBLE - price / 5000000::DOUBLE) END AS price_fit,
  CASE WHEN mileage IS NULL THEN CASE WHEN mileage_max IS NOT NULL THEN 0.15::DOUBLE ELSE 0.5 END ELSE least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1.0::DOUBLE - mileage / coalesce(mileage_max, 250000)::DOUBLE)) END AS mileage_fit,
  CASE WHEN w_fuel IS NULL THEN 0.5::DOUBLE WHEN fuel IS NULL THEN 0.35 WHEN fuel = w_fuel THEN 1.0 ELSE 0.0 END AS fuel_match, 1.0::DOUBLE AS brand_match,
  CASE WHEN w_model IS NULL THEN 0.5::DOUBLE WHEN {_SOFT} THEN 1.0 ELSE 0.0 END AS model_match,
  CASE WHEN coalesce(lower(trim(source)), 'unknown') = 'telegram' THEN 0.6::DOUBLE WHEN contains(host, 'avito.ru') OR contains(host, 'drom.ru') THEN 0.9 ELSE 0.5 END AS source_quality,
  CAST(coalesce(sale_intent = 1, FALSE) AS INT)::DOUBLE AS sale_intent_signal, 0.85::DOUBLE AS representation_quality
  FROM (SELECT *, {_TEXT} AS t, list_filter(string_split({_TOK.format('model')}, ' '), lambda w: w <> '') AS ta, list_filter(string_split({_TOK.format('w_model')}, ' '), lambda w: w <> '') AS tb,
    regexp_extract(lower(trim(source_url)), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1) AS host FROM {_PAIRS}))"""
_SCORED = f"""(SELECT *, round((semantic * 0.25::DOUBLE + text_match * 0.20::DOUBLE + freshness * 0.10::DOUBLE + completeness * 0.08::DOUBLE + price_fit * 0.08::DOUBLE + mileage_fit * 0.06::DOUBLE + fuel_match * 0.12::DOUBLE
    + brand_match * 0.15::DOUBLE + model_match * 0.18::DOUBLE + source_quality * 0.03::DOUBLE + sale_intent_signal * 0.02::DOUBLE + representation_quality * 0.02::DOUBLE + semantic * 0.15::DOUBLE) / 1.44::DOUBLE
  * CASE WHEN w_fuel IS NULL THEN 1.0::DOUBLE WHEN fuel IS NULL THEN 0.15 WHEN fuel <> w_fuel THEN 0.01 ELSE 1.0 END
  * CASE WHEN mileage_max IS NULL THEN 1.0::DOUBLE WHEN mileage IS NULL THEN CASE WHEN year >= 2024 THEN 1.0 ELSE 0.3 END WHEN mileage > mileage_max THEN 0.01 ELSE 1.0 END, 6) AS score FROM {_SIGNALS})"""


#: Pairs that one group of listings and queries may have, its listings, and its queries.
PAIRS, LISTINGS, ASKED = 1_000_000, 20_000, 1_000
#: Rows of a dictionary (brands, queries) that may be broadcast; more are shuffled.
FEW = 200_000


def _asked(s, d):
    rows = table(s, d, "search_events").filter("id % 100 = 0 and raw_query is not null").select(F.col("id").alias("query_id"), F.lower("raw_query").alias("q"), "structured_query").distinct()
    part = lambda name: F.nullif(F.get_json_object("structured_query", f"$.{name}"), F.lit(""))
    most = F.regexp_extract("q", "пробег до ([0-9]+) тыс", 1).try_cast("bigint") * 1000
    parts = (part("brand").alias("w_brand"), part("model").alias("w_model"), ex.fuel(F.col("q")).alias("w_fuel"), most.alias("mileage_max"), ex.tokens(F.col("q")).alias("words"))
    return rows.select("query_id", "q", *parts).distinct().withColumn("_b", F.lower("w_brand"))


def _listings(s, d):
    rows = table(s, d, "normalized_documents").select(
        "id", "title", F.col("normalized_text").alias("txt"), "brand", "model", "fuel", "year", "price", "mileage", "source", "source_url", "sale_intent", "created_at_ts"
    )
    return rows.withColumn("_b", F.lower("brand"))


def _pairs(s, d):
    return _asked(s, d).join(_listings(s, d), "_b").drop("_b")


def _alike(s, d):
    """(head, all, ids): queries that ask the very same are answered once, under the smallest id, ``head``."""
    wish = F.struct("_b", "w_brand", "w_model", "w_fuel", "mileage_max", "words")
    own = _asked(s, d).filter("_b is not null").groupBy("query_id").agg(F.sort_array(F.collect_list(wish)).alias("all"))
    return own.groupBy("all").agg(F.min("query_id").alias("head"), F.collect_list("query_id").alias("ids"))


def _heads(s, d, alike=None):
    """The wishes of the queries that stand for all, numbered within their brand; their normalised words are made here, once."""
    w = Window.partitionBy("_b").orderBy("query_id", "words", "w_brand", "w_model", "w_fuel", "mileage_max")
    wishes = (alike or _alike(s, d)).select(F.col("head").alias("query_id"), F.explode("all").alias("a")).select("query_id", "a.*").withColumn("_n", F.row_number().over(w) - 1)
    c = F.col
    return wishes.select(
        "query_id", "_b", "w_brand", "w_model", "w_fuel", "mileage_max", "words", (c("_n") / ASKED).cast("int").alias("_q"), (c("_n") % ASKED).alias("at"),
        norm_tok(c("w_brand")).alias("n_brand"), norm_tok(c("w_model")).alias("n_model"), F.transform("words", norm_tok).alias("n_words"), F.size(F.array_distinct("words")).alias("different"),
        strict_key(c("w_model")).alias("w_strict"), rk.model_words(c("w_model")).alias("w_parts"), c("w_model").rlike("[0-9]").alias("w_digits"),
    )


def _for_all(rows, s, d, alike=None):
    """Rows of the heads, for every query that asks the same."""
    ids = (alike or _alike(s, d)).select(F.col("head").alias("query_id"), F.explode("ids").alias("_id"))
    names = [F.col("_id").alias(k) if k == "query_id" else F.col(k) for k in rows.columns]
    return join_dictionary(rows, ids, "query_id", most=FEW).select(*names)


def _groups(heads, listed, *columns):
    """Listings (``columns``, ``_b``, ``_l``, ``_q``) and queries of one brand, dealt to groups of a bounded number of pairs; the number of groups."""
    c = F.col
    sizes = heads.groupBy("_b").agg(F.count(F.lit(1)).alias("nq")).join(listed.groupBy("_b").agg(F.count(F.lit(1)).alias("n")), "_b").select(
        "_b", F.ceil(c("nq") / ASKED).cast("int").alias("_qs"), F.ceil(F.greatest(c("n") * c("nq") / PAIRS, c("n") / LISTINGS)).cast("int").alias("_ls")
    )
    found = sizes.agg(F.count(F.lit(1)).alias("n"), F.sum(c("_qs") * c("_ls")).alias("groups")).first()
    parts = max(1, min(20_000, found["groups"] or 0))
    blocks = listed.join(F.broadcast(sizes) if found["n"] <= FEW else sizes, "_b").select(
        *columns, "_b", F.pmod(F.xxhash64("id"), "_ls").cast("int").alias("_l"), F.explode(F.sequence(F.lit(0), c("_qs") - 1)).alias("_q"),
        rk.match_text(["brand", "model", "title"], "txt").alias("text"),
    )
    asked = heads.join(F.broadcast(sizes) if found["n"] <= FEW else sizes, "_b").withColumn("_l", F.explode(F.sequence(F.lit(0), c("_ls") - 1)))
    keys = ["_b", "_l", "_q"]
    return blocks.repartition(parts, *keys), asked, keys, parts


def _signals(s, d, more=None):
    """Signals of every listing for the heads of its brand; ``more``: columns of the listing that are carried, by name.

    What depends on the listing alone, or on the query alone, is made before they meet. Words
    are looked for in groups of listings and queries of one brand (``rk.mentions``).
    """
    c = F.col
    more = more or {}
    heads = _heads(s, d)
    blocks, asked, keys, parts = _groups(
        heads, _listings(s, d), "id", "brand", "fuel", "year", "mileage", "source", *(v.alias(k) for k, v in more.items()),
        strict_key(c("model")).alias("strict"), rk.model_words(c("model")).alias("parts"), F.lower("txt").alias("content"),
        rk.freshness(c("created_at_ts"), AS_OF).alias("freshness"), rk.completeness(["brand", "model", "year", "price", "mileage", "fuel"]).alias("completeness"),
        rk.price_fit(c("price"), F.lit(None).cast("int")).alias("price_fit"), rk.source_quality(c("source"), c("source_url")).alias("source_quality"),
        F.coalesce((c("sale_intent") == 1).cast("double"), F.lit(0.0)).alias("sale_intent"),
    )
    asked = asked.select("_b", "_l", "_q", "at", "n_brand", "n_model", "n_words", "words")
    schema = StructType([*(f for f in blocks.schema if f.name not in ("text", "content")), *(StructField(n, ArrayType(t())) for n, t in (("said", FloatType), ("named", IntegerType), ("held", IntegerType)))])
    met = blocks.groupBy(*keys).cogroup(asked.repartition(parts, *keys).groupBy(*keys)).applyInArrow(rk.mentions, schema)
    pairs = join_dictionary(met.drop("_l"), heads.drop("n_brand", "n_model", "n_words"), ["_b", "_q"], most=FEW)
    semantic = F.when(c("different") == 0, 0.0).otherwise(F.get("held", "at") / c("different"))
    fits = rk.soft_parts(c("strict"), c("parts"), c("w_strict"), c("w_parts"), c("w_digits"))
    own = ("query_id", "id", "brand", "fuel", "year", "mileage", "source", *more, "w_brand", "w_model", "w_fuel", "mileage_max", "freshness", "completeness", "price_fit", "source_quality", "sale_intent")
    return pairs.select(
        *own, semantic.alias("semantic"), rk.match_share(F.get("said", "at"), c("fuel") == c("w_fuel"), F.get("named", "at")).alias("text_match"), fits.alias("fits")
    ).withColumns({
        "bm25": c("semantic"), "mileage_fit": rk.mileage_fit(c("mileage"), c("mileage_max")),
        "fuel_match": F.when(c("w_fuel").isNull(), 0.5).when(c("fuel").isNull(), 0.35).when(c("fuel") == c("w_fuel"), 1.0).otherwise(0.0),
        "brand_match": F.lit(1.0), "model_match": F.when(c("w_model").isNull(), 0.5).when(c("fits"), 1.0).otherwise(0.0),
        "representation_quality": rk.representation_quality(F.lit("title")),
    })


def _four(c, digits: int = 4):
    """Digits as the SQL twin rounds a double: scaled first (0.57905 * 10000 lies below 5790.5)."""
    return F.round(c * 10**digits) / 10**digits


def _scored(s, d, more=None):
    c = F.col
    return _signals(s, d, more).withColumn("score", rk.full_score(c("w_fuel"), c("fuel"), c("mileage_max"), c("mileage"), F.lit(None), c("year")))


@query("r06_model_soft", f"SELECT query_id, id, {_SOFT} AS fits FROM (SELECT *, list_filter(string_split({_TOK.format('model')}, ' '), lambda w: w <> '') AS ta, list_filter(string_split({_TOK.format('w_model')}, ' '), lambda w: w <> '') AS tb FROM {_PAIRS})")
def r06(s, d):
    return _pairs(s, d).select("query_id", "id", rk.soft_model(F.col("model"), F.col("w_model")).alias("fits"))


@query("r07_text_match", f"SELECT query_id, id, round(text_match, 5) AS text_match FROM {_SIGNALS}")
def r07(s, d):
    return _for_all(_signals(s, d).select("query_id", "id", F.round("text_match", 5).alias("text_match")), s, d)


@query("r12_source_quality", """SELECT id, CASE WHEN source IN ('auto_ru') THEN 0.95::DOUBLE WHEN source IN ('avito', 'avito.ru', 'drom', 'drom.ru') THEN 0.9 WHEN source = 'telegram' THEN 0.6 WHEN contains(host, 'avito.ru') OR contains(host, 'drom.ru') THEN 0.9 ELSE 0.5 END AS prior
  FROM (SELECT id, lower(trim(source)) AS source, regexp_extract(lower(trim(source_url)), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1) AS host FROM raw_documents)""")
def r12(s, d):
    return table(s, d, "raw_documents").select("id", rk.source_quality(F.col("source"), F.col("source_url")).alias("prior"))


_KEYS = ("semantic", "text_match", "freshness", "completeness", "price_fit", "mileage_fit", "fuel_match", "model_match", "source_quality")


@query("r13_all_signals", f"SELECT query_id, id, {', '.join(f'round({k}, 5) AS {k}' for k in _KEYS)} FROM {_SIGNALS}")
def r13(s, d):
    return _for_all(_signals(s, d).select("query_id", "id", *(_four(F.col(k), 5).alias(k) for k in _KEYS)), s, d)


@query("r15_full_score", f"SELECT query_id, id, round(score, 4) AS score FROM {_SCORED}")
def r15(s, d):
    return _for_all(_scored(s, d).select("query_id", "id", _four(F.col("score")).alias("score")), s, d)


@query("r16_signal_averages", f"SELECT query_id, count(*) AS hits, round(avg(text_match), 4) AS text_match, round(avg(freshness), 4) AS freshness, round(avg(model_match), 4) AS model_match FROM {_SIGNALS} GROUP BY 1")
def r16(s, d):
    """Sums of each group of listings and queries, of each brand and of each model of a brand; pairs are met only where texts are looked through."""
    c = F.col
    alike = stash(_alike(s, d), "alike")
    heads, listed = stash(_heads(s, d, alike), "heads"), _listings(s, d)
    blocks, asked, keys, parts = _groups(heads, listed, "fuel")
    asked = asked.select(*keys, "query_id", "w_fuel", "n_brand", "n_model", "n_words").repartition(parts, *keys)
    met = blocks.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(rk.match_sums, "query_id bigint, text_match double, hits bigint")
    said = met.groupBy("query_id").agg(F.sum("text_match").alias("text_match"), F.sum("hits").alias("hits"))
    fresh = listed.groupBy("_b").agg(F.sum(rk.freshness(c("created_at_ts"), AS_OF)).alias("freshness"))
    fresh = heads.select("query_id", "_b").join(fresh, "_b").groupBy("query_id").agg(F.sum("freshness").alias("freshness"))
    models = listed.groupBy("_b", "model").agg(F.count(F.lit(1)).alias("n")).select("_b", "n", strict_key(c("model")).alias("strict"), rk.model_words(c("model")).alias("parts"))
    fits = rk.soft_parts(c("strict"), c("parts"), c("w_strict"), c("w_parts"), c("w_digits"))
    match = F.when(c("w_model").isNull(), 0.5).when(fits, 1.0).otherwise(0.0)
    fitted = heads.join(models, "_b").groupBy("query_id").agg(F.sum(c("n") * match).alias("model_match"))
    means = said.join(fresh, "query_id").join(fitted, "query_id").select("query_id", "hits", *(_four(c(k) / c("hits")).alias(k) for k in ("text_match", "freshness", "model_match")))
    return _for_all(means, s, d, alike)


def _canonical() -> str:
    rest = "regexp_replace(regexp_replace(trim(source_url), '#.*$', ''), '^[a-zA-Z][a-zA-Z0-9+.-]*://', '')"
    return f"lower(regexp_extract({rest}, '^([^/?]*)', 1)), lower(regexp_replace(regexp_extract({rest}, '^[^/?]*([^?]*)', 1), '/+$', ''))"


@query("r17_fingerprint", f"""SELECT id, array_to_string(list_transform([{_canonical()}, {_TOK.format('brand')}, {_TOK.format('model')}, CAST(year AS VARCHAR), CAST(price AS VARCHAR), CAST(mileage AS VARCHAR)], lambda x: coalesce(x, '')), '|') AS print FROM normalized_documents""")
def r17(s, d):
    return table(s, d, "normalized_documents").select("id", rk.fingerprint(F.col("source_url"), F.col("brand"), F.col("model"), "year", "price", "mileage").alias("print"))


@query("r18_four_keys")
def r18(s, d):
    """Rows by score; a row goes if its listing, document, page or fingerprint was accepted before."""
    c = F.col
    held = lambda key: F.when(key.isNotNull(), F.xxhash64(key))  # noqa: E731  (as near to the key as the 64 bits of ``listing``)
    keys = {
        "listing": F.substring(F.md5(F.coalesce("source_url", F.concat_ws("_", "title", "price"))), 1, 16), "page": rk.canonical_url(c("source_url")),
        "print": rk.fingerprint(c("source_url"), c("brand"), c("model"), "year", "price", "mileage"),
    }
    rows = _scored(s, d, {k: held(key) for k, key in keys.items()}).select("query_id", "id", "score", *keys)
    rows = rk.ordered_dedup(rows, ["listing", "id", "page", "print"], (F.desc("score"), "id"), "rank")
    return _for_all(rows.select("query_id", "id", "rank"), s, d)


@query("r24_multiplied", f"""SELECT query_id, id, round(CASE WHEN w_model IS NULL THEN f WHEN {_SOFT} THEN least(1.0::DOUBLE, f * 1.4::DOUBLE) ELSE round(f * 0.6::DOUBLE, 6) END, 3) AS score FROM (SELECT *,
  least(1.0::DOUBLE, round(score * CASE WHEN w_fuel IS NULL OR coalesce(lower(fuel), '') = w_fuel THEN 1.0::DOUBLE WHEN w_fuel = 'electric' THEN 0.3 ELSE 0.85 END, 6)) AS f FROM {_SCORED})""")
def r24(s, d):
    c = F.col
    return _for_all(_scored(s, d).select("query_id", "id", F.round(rk.multiplied(c("score"), c("w_fuel"), c("fuel"), c("w_model"), c("fits")), 3).alias("score")), s, d)


_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM {_SCORED})"


def _best(s, d, most, by=("query_id",)):
    """The first rows of each head by score, ranked; the limit is applied in each task before rows are shuffled."""
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "id")
    return _scored(s, d).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


@query("r05_drop_reasons", f"""SELECT query_id, reason, count(*) AS n FROM (SELECT query_id, unnest(list_filter([CASE WHEN w_brand IS NOT NULL AND (brand IS NULL OR brand <> w_brand) THEN 'brand_mismatch' END,
  CASE WHEN w_model IS NOT NULL AND NOT {_SOFT} THEN 'model_mismatch' END, CASE WHEN mileage > mileage_max THEN 'mileage_over' END, CASE WHEN w_fuel IS NOT NULL AND fuel <> w_fuel THEN 'fuel_mismatch' END], lambda x: x IS NOT NULL)) AS reason
  FROM {_SIGNALS}) GROUP BY 1, 2""")
def r05(s, d):
    c = F.col
    why = rk.drop_reasons(c("w_brand"), c("w_model"), c("mileage_max"), c("w_fuel"))
    return _pairs(s, d).select("query_id", F.explode(why).alias("reason")).groupBy("query_id", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("r19_source_cap", f"SELECT query_id, id, source FROM {_RANKED} QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY rank) <= 20")
def r19(s, d):
    return _for_all(_best(s, d, 20, ("query_id", "source")).select("query_id", "id", "source"), s, d)


@query("r20_top", f"SELECT query_id, id, round(score, 4) AS score FROM {_RANKED} WHERE rank <= 50")
def r20(s, d):
    return _for_all(_best(s, d, 50).select("query_id", "id", _four(F.col("score")).alias("score")), s, d)


@query("r21_blend", f"""SELECT query_id, id, round(score * 0.8::DOUBLE + CASE WHEN max(semantic) OVER w > min(semantic) OVER w THEN (semantic - min(semantic) OVER w) / (max(semantic) OVER w - min(semantic) OVER w) ELSE 0.5 END * 0.2::DOUBLE, 6) AS v
  FROM {_RANKED} WHERE rank <= 50 WINDOW w AS (PARTITION BY query_id)""")
def r21(s, d):
    """The share of the query's words stands in for the score of a reranking model."""
    top = _best(s, d, 50)
    return _for_all(top.select("query_id", "id", F.round(rk.blend(F.col("score"), F.col("semantic"), ["query_id"]), 6).alias("v")), s, d)


@query("r22_brand_guard", f"""SELECT query_id, id FROM {_RANKED} QUALIFY brand = w_brand OR max(CAST(brand = w_brand AS INT)) OVER (PARTITION BY query_id) = 0""")
def r22(s, d):
    """Letter for letter: rows of the brand as asked, if there are any."""
    hit = F.coalesce(F.col("brand") == F.col("w_brand"), F.lit(False))
    return _pairs(s, d).withColumn("any", F.max(hit).over(Window.partitionBy("query_id"))).filter(hit | ~F.col("any")).select("query_id", "id")


@query("r26_page", f"SELECT query_id, id, rank AS pos FROM {_RANKED} WHERE rank BETWEEN 21 AND 30")
def r26(s, d):
    return _for_all(rk.page(_best(s, d, 30), 3, 10).select("query_id", "id", F.col("pos").cast("bigint").alias("pos")), s, d)


@query("r27_source_counts", f"SELECT query_id, source, count(*) AS n FROM {_RANKED} GROUP BY 1, 2")
def r27(s, d):
    return _pairs(s, d).groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("n"))


@query("r28_groups", f"""SELECT query_id, source, count(*) AS n, count(*) >= 10 AS dominant, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) FILTER (WHERE k <= 3) AS shown, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rank) FILTER (WHERE k BETWEEN 4 AND 8) AS more
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS k FROM {_RANKED}) GROUP BY 1, 2""")
def r28(s, d):
    """Results by source: how many, whether the source dominates, the first three and the next five."""
    held = _listings(s, d).groupBy("_b", "source").agg(F.count(F.lit(1)).alias("n"))
    sizes = _heads(s, d).join(held, "_b").groupBy("query_id", F.coalesce("source", F.lit("")).alias("_s")).agg(F.sum("n").alias("n"))
    ordered = lambda low, high: F.nullif(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k").between(low, high), F.struct("k", "id")))), lambda x: x["id"].cast("string")), ","), F.lit(""))
    first = _best(s, d, 8, ("query_id", "source")).withColumnRenamed("rank", "k").groupBy("query_id", "source").agg(ordered(1, 3).alias("shown"), ordered(4, 8).alias("more")).withColumn("_s", F.coalesce("source", F.lit("")))
    return _for_all(first.join(sizes, ["query_id", "_s"]).select("query_id", "source", "n", (F.col("n") >= 10).alias("dominant"), "shown", "more"), s, d)


@query("r29_precision", f"""SELECT query_id, round(avg(CAST(brand = w_brand AS INT)), 3) AS p_brand, round(avg(CAST(CASE WHEN w_model IS NOT NULL THEN {_SOFT} END AS INT)), 3) AS p_model,
  round(avg(CAST(CASE WHEN w_fuel IS NOT NULL THEN coalesce(fuel = w_fuel, FALSE) END AS INT)), 3) AS p_fuel, round(avg(CAST(CASE WHEN mileage_max IS NOT NULL THEN mileage IS NULL OR mileage <= mileage_max END AS INT)), 3) AS p_mileage
  FROM {_RANKED} WHERE rank <= 10 GROUP BY 1""")
def r29(s, d):
    """Shares of the first ten that keep each wish of the query; an unknown mileage keeps it."""
    c = F.col
    rate = lambda wish, ok, name: F.round(F.avg(F.when(wish, ok.cast("int"))), 3).alias(name)
    top = _best(s, d, 10)
    rates = top.groupBy("query_id").agg(
        rate(F.lit(True), c("brand") == c("w_brand"), "p_brand"), rate(c("w_model").isNotNull(), c("fits"), "p_model"),
        rate(c("w_fuel").isNotNull(), F.coalesce(c("fuel") == c("w_fuel"), F.lit(False)), "p_fuel"), rate(c("mileage_max").isNotNull(), c("mileage").isNull() | (c("mileage") <= c("mileage_max")), "p_mileage"),
    )
    return _for_all(rates, s, d)

"""Queries over texts, extraction, gates, indexing and ranking (T*, E*, Q*, V*, R*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorloom.functions import extract as ex
from motorloom.functions import gates
from motorloom.functions import text as tx
from motorloom.operators import indexing as ix
from motorloom.operators import ranking as rk
from motorloom.plans import fixtures as fx
from motorloom.plans.registry import query
from motorloom.sources.tables import table

AS_OF = 1704844800  # 2024-01-10 UTC
RAW, NORM = "raw_documents", "normalized_documents"
SP = r"'[\s\x{00A0}]+'"


def _sq(x: str) -> str:
    return f"trim(regexp_replace({x}, {SP}, ' ', 'g'))"


@query("t01_squeeze", f"SELECT id, {_sq('content')} AS t FROM raw_documents")
def t01(s, d):
    return table(s, d, RAW).select("id", tx.squeeze(F.col("content")).alias("t"))


_TOK = "regexp_replace(regexp_replace(regexp_replace(lower({0}), '[-_/]', ' ', 'g'), '([a-zа-яё])([0-9])', '\\1 \\2', 'g'), '([0-9])([a-zа-яё])', '\\1 \\2', 'g')"


@query("t04_norm_tok", f"SELECT id, {_sq(_TOK.format('title'))} AS t FROM raw_documents")
def t04(s, d):
    return table(s, d, RAW).select("id", tx.norm_tok(F.col("title")).alias("t"))


@query("t05_strict_key", "SELECT id, replace(replace(replace(lower(model), '-', ''), '_', ''), ' ', '') AS t FROM normalized_documents")
def t05(s, d):
    return table(s, d, NORM).select("id", tx.strict_key(F.col("model")).alias("t"))


@query("t02_title_format", f"""SELECT id, {_sq("regexp_replace(regexp_replace(replace(regexp_replace(title, '[\\t\\n\\r]', ' ', 'g'), '₽', ' ₽ '), ',([0-9]{4})', ', \\1', 'g'), '([0-9]{4})г', '\\1 г', 'g')")} AS t FROM raw_documents""")
def t02(s, d):
    return table(s, d, RAW).select("id", tx.title_format(F.col("title")).alias("t"))


@query("t10_parse_text", f"""SELECT id, {_sq("regexp_replace(regexp_replace(replace(lower(raw_query), 'ё', 'е'), '([0-9]) *миллион[а-я]*', '\\1 млн', 'g'), '([0-9]) *[kк]([^a-zа-я0-9]|$)', '\\1к\\2', 'g')")} AS t FROM search_events""")
def t10(s, d):
    return table(s, d, "search_events").select("id", tx.parse_text(F.col("raw_query")).alias("t"))


def _url_sql(exact: bool) -> str:
    rule = "'^(utm_[^=]*|yclid|gclid|fbclid|from|ref)(=|$)'" if exact else "'^(utm_|yclid|gclid|fbclid|ref)'"
    none = "''" if exact else "'https://'"
    return f"""WITH b AS (SELECT id, regexp_replace(trim(source_url), '#.*$', '') AS u FROM raw_documents),
  p AS (SELECT id, u, lower(regexp_extract(u, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) AS sch, regexp_replace(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://', '') AS r FROM b),
  q AS (SELECT id, u, sch, lower(regexp_extract(r, '^([^/?]*)', 1)) AS host, regexp_replace(regexp_extract(r, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_filter(string_split(regexp_extract(r, '[?](.*)$', 1), '&'), lambda x: NOT regexp_matches(x, {rule}) AND x <> ''), '&') AS kept FROM p)
  SELECT id, CASE WHEN u IS NULL THEN NULL ELSE concat(CASE WHEN sch = '' THEN {none} ELSE sch || '://' END, host, path, CASE WHEN kept = '' THEN '' ELSE '?' || kept END) END AS t FROM q"""


@query("t15_canonical_url", _url_sql(False))
def t15(s, d):
    return table(s, d, RAW).select("id", tx.canonical_url(F.col("source_url")).alias("t"))


@query("t16_canonical_url_exact", _url_sql(True))
def t16(s, d):
    return table(s, d, RAW).select("id", tx.canonical_url(F.col("source_url"), True).alias("t"))


@query("t17_url_class", """SELECT id, CASE WHEN source_url IS NULL OR NOT regexp_matches(lower(trim(source_url)), '^https?://') THEN 'bad'
  WHEN regexp_matches(lower(trim(source_url)), '[?&](q|query|search)=') THEN 'search'
  WHEN regexp_matches(lower(trim(source_url)), '(/[0-9]{3,}([/.?]|$))|([?&]id=[0-9]+)|/card') THEN 'listing' ELSE 'other' END AS t FROM raw_documents""")
def t17(s, d):
    return table(s, d, RAW).select("id", tx.url_class(F.col("source_url")).alias("t"))


@query("t19_prefixes", "SELECT id, left(content, 1200) AS body, left(title, 40) AS head, length(content) AS n FROM raw_documents")
def t19(s, d):
    return table(s, d, RAW).select("id", F.substring("content", 1, 1200).alias("body"), F.substring("title", 1, 40).alias("head"), F.length("content").cast("bigint").alias("n"))


@query("e01_year", """SELECT id, list_filter(list_transform(list_concat(regexp_extract_all(normalized_text, '((?:19|20)[0-9]{2}) ?г', 1),
  regexp_extract_all(normalized_text, '((?:19|20)[0-9]{2})', 1)), lambda y: CAST(y AS INT)), lambda y: y BETWEEN 1985 AND 2027)[1] AS year FROM normalized_documents""")
def e01(s, d):
    return table(s, d, NORM).select("id", ex.year(F.col("normalized_text"), 2027).alias("year"))


@query("e02_query_years", """SELECT id, CASE WHEN a IS NOT NULL THEN a WHEN lo IS NOT NULL OR hi IS NOT NULL THEN lo ELSE one END AS year_min,
  CASE WHEN b IS NOT NULL THEN b WHEN lo IS NOT NULL OR hi IS NOT NULL THEN hi ELSE one END AS year_max FROM (SELECT id,
  TRY_CAST(regexp_extract(q, '((?:19|20)[0-9]{2}) ?[-–] ?((?:19|20)[0-9]{2})', 1) AS INT) a, TRY_CAST(regexp_extract(q, '((?:19|20)[0-9]{2}) ?[-–] ?((?:19|20)[0-9]{2})', 2) AS INT) b,
  TRY_CAST(regexp_extract(q, '(?:^|[^0-9])((?:19|20)[0-9]{2})(?: ?г| год|$)', 1) AS INT) one,
  TRY_CAST(regexp_extract(q, '(?:от|с|после) ((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1) AS INT) lo,
  TRY_CAST(regexp_extract(q, '(?:до|не старше) ((?:19|20)[0-9]{2})(?:[^0-9]|$)', 1) AS INT) hi FROM (SELECT id, lower(raw_query) q FROM search_events))""")
def e02(s, d):
    low, high = ex.year_range(F.lower("raw_query"))
    return table(s, d, "search_events").select("id", low.alias("year_min"), high.alias("year_max"))


@query("e03_price", """SELECT id, CASE WHEN v BETWEEN 10000 AND 200000000 THEN v END AS price FROM (SELECT id, coalesce(
  CAST(TRY_CAST(replace(nullif(regexp_extract(normalized_text, '([0-9]+[.,]?[0-9]*) ?млн', 1), ''), ',', '.') AS DECIMAL(12,3)) * 1000000 AS BIGINT),
  TRY_CAST(regexp_replace(nullif(regexp_extract(normalized_text, '([0-9][0-9 ]{3,12}) ?(?:руб|₽|р[.])', 1), ''), '[^0-9]', '', 'g') AS BIGINT)) AS v FROM normalized_documents)""")
def e03(s, d):
    return table(s, d, NORM).select("id", ex.price(F.col("normalized_text")).alias("price"))


@query("e04_query_price", """SELECT id, nullif(CAST(TRY_CAST(replace(nullif(regexp_extract(lower(raw_query), '(?:^|[^а-я])до ([0-9]+(?:[.,][0-9]+)?) ?(?:млн)', 1), ''), ',', '.') AS DECIMAL(14,3)) * 1000000 AS BIGINT), 0) AS price_max FROM search_events""")
def e04(s, d):
    return table(s, d, "search_events").select("id", ex.bound(F.lower("raw_query"), "до", "млн", 1_000_000).alias("price_max"))


@query("e05_mileage", """SELECT id, CASE WHEN v <= 1500000 THEN v END AS mileage FROM (SELECT id, coalesce(
  CASE WHEN contains(normalized_text, 'без пробега') AND NOT contains(normalized_text, 'без пробега по') THEN 0::BIGINT END,
  TRY_CAST(regexp_replace(nullif(regexp_extract(normalized_text, 'пробег:? ?([0-9][0-9 ]*) ?км', 1), ''), '[^0-9]', '', 'g') AS BIGINT),
  TRY_CAST(nullif(regexp_extract(normalized_text, '([0-9]{1,3}) ?тыс[.а-я]* ?км', 1), '') AS BIGINT) * 1000) AS v FROM normalized_documents)""")
def e05(s, d):
    return table(s, d, NORM).select("id", ex.mileage(F.col("normalized_text")).alias("mileage"))


@query("e07_query_mileage", """SELECT id, nullif(CAST(TRY_CAST(replace(nullif(regexp_extract(lower(raw_query), '(?:^|[^а-я])до ([0-9]+(?:[.,][0-9]+)?) ?(?:тыс[.]? ?км|к км|т[.]?км)', 1), ''), ',', '.') AS DECIMAL(14,3)) * 1000 AS BIGINT), 0) AS mileage_max FROM search_events""")
def e07(s, d):
    return table(s, d, "search_events").select("id", ex.bound(F.lower("raw_query"), "до", "тыс[.]? ?км|к км|т[.]?км", 1000).alias("mileage_max"))


_FUEL_SQL = "CASE " + " ".join(f"WHEN regexp_matches(normalized_text, '{p}') THEN '{n}'" for n, p in ex.FUELS) + " END"


@query("e09_fuel", f"SELECT id, {_FUEL_SQL} AS fuel FROM normalized_documents")
def e09(s, d):
    return table(s, d, NORM).select("id", ex.fuel(F.col("normalized_text")).alias("fuel"))


@query("e12_paint", """SELECT id, CASE WHEN contains(normalized_text, 'не бит') OR contains(normalized_text, 'родной окрас') OR contains(normalized_text, 'заводском окрасе') THEN 'original'
  WHEN contains(normalized_text, 'краш') OR contains(normalized_text, 'перекрас') THEN 'repainted' END AS paint FROM normalized_documents""")
def e12(s, d):
    return table(s, d, NORM).select("id", ex.paint(F.col("normalized_text")).alias("paint"))


_TOKENS = "unnest(list_distinct(regexp_extract_all(lower({0}), '([a-zа-яё0-9][a-zа-яё0-9-]*)', 1)))"


@query("e13_city", f"""WITH t AS (SELECT id, {_TOKENS.format('normalized_text')} AS word FROM normalized_documents)
  SELECT id, arg_min(city, ord) AS city, arg_min(region, ord) AS region FROM t JOIN city_dictionary USING (word) GROUP BY id""")
def e13(s, d):
    return ex.first_entry(table(s, d, NORM), "id", F.col("normalized_text"), table(s, d, "city_dictionary"), "word", ["city", "region"], False)


@query("e15_color", "SELECT id, nullif(regexp_extract(normalized_text, '(?:^|[^а-яё])((?:бел|черн|чёрн|сер|красн|син|голуб|зелен|зелён|желт|жёлт|оранжев|коричнев|вишнёв|бордов|молочн|графит|бирюз|беж)[а-яё]*)', 1), '') AS color FROM normalized_documents")
def e15(s, d):
    return table(s, d, NORM).select("id", ex.color(F.col("normalized_text")).alias("color"))


@query("e16_keywords", "SELECT id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(raw_query), '([a-zа-яё0-9][a-zа-яё0-9-]*)', 1), lambda w: w NOT IN ('до', 'от', 'с', 'и', 'в', 'км')))) AS words FROM search_events WHERE raw_query IS NOT NULL")
def e16(s, d):
    stop = F.array(*(F.lit(w) for w in ("до", "от", "с", "и", "в", "км")))
    rows = table(s, d, "search_events").filter("raw_query is not null")
    return rows.select("id", F.array_sort(F.array_distinct(F.array_except(ex.tokens(F.col("raw_query")), stop))).alias("words"))


@query("e19_brand", f"""WITH t AS (SELECT id, {_TOKENS.format('title')} AS alias_norm FROM raw_documents)
  SELECT id, arg_min(brand, (-length(alias_norm), ord)) AS brand FROM t JOIN brand_aliases USING (alias_norm) GROUP BY id""")
def e19(s, d):
    return ex.first_entry(table(s, d, RAW), "id", F.col("title"), table(s, d, "brand_aliases"), "alias_norm", ["brand"], True)


@query("e20_model", f"""WITH t AS (SELECT id, {_TOKENS.format('title')} AS alias_norm FROM raw_documents)
  SELECT id, arg_min(brand, (-length(alias_norm), ord)) AS brand, arg_min(model, (-length(alias_norm), ord)) AS model FROM t JOIN model_aliases USING (alias_norm) GROUP BY id""")
def e20(s, d):
    return ex.first_entry(table(s, d, RAW), "id", F.col("title"), table(s, d, "model_aliases"), "alias_norm", ["brand", "model"], True)


@query("q04_quality", """SELECT id, round(least(CASE WHEN price IS NOT NULL THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN year IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN mileage IS NOT NULL THEN 0.15::DOUBLE ELSE 0 END
  + CASE WHEN fuel IS NOT NULL THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN brand IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN model IS NOT NULL THEN 0.25::DOUBLE ELSE 0 END, 1.0::DOUBLE), 3) AS quality FROM normalized_documents""")
def q04(s, d):
    c = F.col
    return table(s, d, NORM).select("id", gates.quality_signals(c("price"), c("year"), c("mileage"), c("fuel"), c("brand"), c("model")).alias("quality"))


@query("q11_listing_quality", """SELECT id, round(least(CASE WHEN brand IS NOT NULL THEN 0.35::DOUBLE ELSE 0 END + CASE WHEN model IS NOT NULL THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN coalesce(price, 0) <> 0 THEN 0.2::DOUBLE ELSE 0 END
  + CASE WHEN coalesce(year, 0) <> 0 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN coalesce(mileage, 0) <> 0 THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN city IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN fuel IS NOT NULL THEN 0.05::DOUBLE ELSE 0 END + 0.15::DOUBLE, 1.0::DOUBLE), 4) AS quality FROM normalized_documents""")
def q11(s, d):
    c = F.col
    return table(s, d, NORM).select("id", gates.listing_quality(c("brand"), c("model"), c("price"), c("year"), c("mileage"), c("city"), c("fuel")).alias("quality"))


@query("q12_source_boost", "SELECT id, CASE WHEN regexp_matches(source, 'forum|club') THEN 1.5::DOUBLE WHEN source IS NULL OR source = '' OR source = 'telegram' THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS boost FROM raw_documents")
def q12(s, d):
    return table(s, d, RAW).select("id", gates.source_boost(F.col("source")).alias("boost"))


@query("q15_clamps", "SELECT id, CASE WHEN price BETWEEN 10000 AND 200000000 THEN price END AS price, CASE WHEN mileage BETWEEN 0 AND 700000 THEN mileage END AS mileage, CASE WHEN year BETWEEN 1985 AND 2027 THEN year END AS year FROM normalized_documents")
def q15(s, d):
    c = F.col
    return table(s, d, NORM).select("id", gates.clamp(c("price"), 10_000, 200_000_000).alias("price"), gates.clamp(c("mileage"), 0, 700_000).alias("mileage"), gates.clamp(c("year"), 1985, 2027).alias("year"))


@query("v01_chunks")
def v01(s, d):
    return ix.chunk_table(table(s, d, NORM), "id", "normalized_text")


@query("v03_chunk_join", "SELECT c.id AS chunk_id, c.chunk_index, n.brand, n.model FROM document_chunks c JOIN normalized_documents n ON c.normalized_id = n.id")
def v03(s, d):
    n = table(s, d, NORM).select(F.col("id").alias("normalized_id"), "brand", "model")
    return table(s, d, "document_chunks").join(n, "normalized_id").select(F.col("id").alias("chunk_id"), "chunk_index", "brand", "model")


_STRUCT = "concat_ws(' ', brand, model, 'brand ' || brand, 'model ' || model, 'fuel ' || fuel, CASE WHEN year <> 0 THEN 'year ' || year END, CASE WHEN price <> 0 THEN 'price ' || price END, CASE WHEN mileage <> 0 THEN 'mileage ' || mileage END)"


@query("v04_structured_text", f"SELECT id, {_STRUCT} AS t FROM normalized_documents")
def v04(s, d):
    return table(s, d, NORM).select("id", ix.structured_text().alias("t"))


@query("v05_points", f"""WITH j AS (SELECT c.id AS chunk_id, n.title, c.chunk_text, {_STRUCT} AS st FROM document_chunks c JOIN normalized_documents n ON c.normalized_id = n.id),
  u AS (SELECT chunk_id, 'title' AS kind, title AS body FROM j UNION ALL SELECT chunk_id, 'title_boost', title FROM j UNION ALL SELECT chunk_id, 'content', chunk_text FROM j UNION ALL SELECT chunk_id, 'structured', st FROM j)
  SELECT chunk_id, kind, CAST(concat('0x', substr(sha1(concat(chunk_id, '_', kind)), 1, 16))::UBIGINT AS DECIMAL(20,0)) AS point_id FROM u WHERE coalesce(body, '') <> ''""")
def v05(s, d):
    n = table(s, d, NORM).select(F.col("id").alias("normalized_id"), "title", "brand", "model", "fuel", "year", "price", "mileage")
    j = table(s, d, "document_chunks").select(F.col("id").alias("chunk_id"), "normalized_id", "chunk_text").join(n, "normalized_id")
    return ix.representations(j)


@query("v07_listing_ids", "SELECT id, substr(sha1(concat_ws('|', coalesce(source_url, ''), coalesce(brand, ''), coalesce(model, ''), coalesce(CAST(year AS VARCHAR), ''))), 1, 24) AS key FROM normalized_documents")
def v07(s, d):
    return table(s, d, NORM).select("id", ix.listing_key("source_url", ["brand", "model", "year"]).alias("key"))


@query("v10_text_vectors")
def v10(s, d):
    chunks = table(s, d, "document_chunks").select("id", ex.tokens(F.col("chunk_text")).alias("words"))
    return ix.hashed_vectors(chunks, "id", "words")


def _hits_frame(s, d, k=10):
    """Every vector whose id is divisible by 100 asks all vectors; the set grows with the table."""
    e = table(s, d, "embeddings")
    q = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), "label")
    p = e.select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("vector"), "label")
    return rk.top_k_blocks(q, p, k, "label")


_TOPK = """SELECT q.vec_id AS query_id, p.vec_id AS point_id, p.label, round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS sim
  FROM embeddings q JOIN embeddings p ON q.label = p.label WHERE q.vec_id % 100 = 0
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) DESC, p.vec_id) <= 10"""


@query("v11_topk", _TOPK)
def v11(s, d):
    return _hits_frame(s, d).select("query_id", "point_id", "label", "sim")


@query("v12_multi_query", f"SELECT query_id // 300 AS request, point_id, max(sim) AS sim FROM ({_TOPK}) GROUP BY 1, 2")
def v12(s, d):
    """Requests of up to three vectors."""
    hits = _hits_frame(s, d).withColumn("request", F.floor(F.col("query_id") / 300))
    return hits.groupBy("request", "point_id").agg(F.max("sim").alias("sim"))


@query("v13_max_per_doc", f"SELECT query_id, point_id // 3 AS doc_id, max(sim) AS sim, arg_max(point_id, (sim, -point_id)) AS point_id FROM ({_TOPK}) GROUP BY 1, 2")
def v13(s, d):
    return rk.max_per_document(_hits_frame(s, d).withColumn("doc_id", F.floor(F.col("point_id") / 3)), "doc_id")


@query("r14_bm25", """WITH w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '([a-zа-яё0-9][a-zа-яё0-9-]*)', 1)) AS word FROM documents),
  l AS (SELECT doc_id AS id, len(regexp_extract_all(lower(text), '([a-zа-яё0-9][a-zа-яё0-9-]*)', 1)) AS len FROM documents WHERE text IS NOT NULL),
  q AS (SELECT DISTINCT id AS query_id, unnest(regexp_extract_all(lower(raw_query), '([a-zа-яё0-9][a-zа-яё0-9-]*)', 1)) AS word FROM search_events WHERE id % 100 = 0),
  tf AS (SELECT id, word, count(*) AS tf FROM w WHERE word IN (SELECT word FROM q) GROUP BY 1, 2), df AS (SELECT word, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(*) AS n, avg(len) AS al FROM l)
  SELECT q.query_id, tf.id, round(sum(ln((n.n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l.len / n.al))), 4) AS score
  FROM q JOIN df USING (word) JOIN tf USING (word) JOIN l ON l.id = tf.id CROSS JOIN n GROUP BY 1, 2""")
def r14(s, d):
    docs = table(s, d, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), ex.tokens(F.col("text")).alias("words"))
    asked = table(s, d, "search_events").filter("id % 100 = 0 and raw_query is not null")
    return rk.bm25(docs, asked.select(F.col("id").alias("query_id"), ex.tokens(F.col("raw_query")).alias("words")))


@query("r01_parse", f"""WITH t AS (SELECT id, {_TOKENS.format('raw_query')} AS alias_norm FROM search_events),
  b AS (SELECT id, arg_min(brand, (-length(alias_norm), ord)) AS brand FROM t JOIN brand_aliases USING (alias_norm) GROUP BY id)
  SELECT e.id, b.brand, nullif(CAST(TRY_CAST(replace(nullif(regexp_extract(lower(raw_query), '(?:^|[^а-я])до ([0-9]+(?:[.,][0-9]+)?) ?(?:млн)', 1), ''), ',', '.') AS DECIMAL(14,3)) * 1000000 AS BIGINT), 0) AS price_max,
  {_FUEL_SQL.replace('normalized_text', 'lower(raw_query)')} AS fuel, nullif(regexp_extract(lower(raw_query), '(?:^|[^а-яё])((?:бел|черн|чёрн|сер|красн|син|голуб|зелен|зелён|желт|жёлт|оранжев|коричнев|вишнёв|бордов|молочн|графит|бирюз|беж)[а-яё]*)', 1), '') AS color
  FROM search_events e LEFT JOIN b ON b.id = e.id""")
def r01(s, d):
    """Typed queries as structured ones."""
    log, low = table(s, d, "search_events"), F.lower("raw_query")
    brand = ex.first_entry(log, "id", F.col("raw_query"), table(s, d, "brand_aliases"), "alias_norm", ["brand"], True)
    fields = log.select("id", ex.bound(low, "до", "млн", 1_000_000).alias("price_max"), ex.fuel(low).alias("fuel"), ex.color(low).alias("color"))
    return fields.join(brand, "id", "left").select("id", "brand", "price_max", "fuel", "color")


@query("e14_query_city", f"""WITH t AS (SELECT id, {_TOKENS.format('raw_query')} AS word FROM search_events)
  SELECT id, arg_min(city, ord) AS city, arg_min(region, ord) AS region FROM t JOIN city_dictionary USING (word) GROUP BY id""")
def e14(s, d):
    return ex.first_entry(table(s, d, "search_events"), "id", F.col("raw_query"), table(s, d, "city_dictionary"), "word", ["city", "region"], False)


@query("r01_parse_full")
def r01_full(s, d):
    """Typed queries with all parts that r01_parse leaves out; a named brand limits the models, a model alone names its brand."""
    log, low = table(s, d, "search_events"), F.lower("raw_query")
    brand, city, words, mileage = r01(s, d), e14(s, d), e16(s, d), e07(s, d)
    aliases = table(s, d, "model_aliases").select("alias_norm", "model", "ord", F.col("brand").alias("model_brand"))
    parts = log.select("id", F.explode(F.array_distinct(ex.tokens(F.col("raw_query")))).alias("alias_norm"))
    hits = parts.join(F.broadcast(aliases), "alias_norm").join(brand.select("id", "brand"), "id")  # dictionaries are bounded
    rank = F.struct(-F.length("alias_norm"), "ord")
    model = hits.filter("brand is null or brand = model_brand").groupBy("id").agg(*(F.min_by(c, rank).alias(c) for c in ("model", "model_brand")))
    years = log.select("id", *(c.alias(n) for c, n in zip(ex.year_range(low), ("year_min", "year_max"))))
    for part in (model, years, mileage, city, words):
        brand = brand.join(part, "id", "left")
    return brand.withColumn("brand", F.coalesce("brand", "model_brand")).drop("model_brand")


@query("q18_route", """SELECT id, CASE WHEN raw_query IS NULL OR trim(raw_query) = '' THEN 'empty' WHEN regexp_matches(lower(raw_query), '[0-9]') THEN 'structured'
  WHEN len(string_split(trim(raw_query), ' ')) = 1 THEN 'brand_only' ELSE 'semantic' END AS route FROM search_events""")
def q18(s, d):
    c = F.col("raw_query")
    route = F.when(c.isNull() | (F.trim(c) == ""), "empty").when(F.lower(c).rlike("[0-9]"), "structured").when(F.size(F.split(F.trim(c), " ")) == 1, "brand_only").otherwise("semantic")
    return table(s, d, "search_events").select("id", route.alias("route"))


@query("q14_chunk_gate", "SELECT id, length(trim(chunk_text)) >= 30 AND NOT contains(lower(chunk_text), 'подписывайтесь') AS kept FROM document_chunks")
def q14(s, d):
    kept = (F.length(F.trim("chunk_text")) >= 30) & ~F.lower("chunk_text").contains("подписывайтесь")
    return table(s, d, "document_chunks").select("id", kept.alias("kept"))


@query("q16_timestamps", """SELECT id, coalesce(floor(epoch(created_at))::BIGINT, created_at_ts, floor(epoch(fetched_at))::BIGINT) AS at,
  CASE WHEN created_at IS NOT NULL THEN 'source' WHEN created_at_ts IS NOT NULL THEN 'normalized' ELSE 'ingested' END AS origin FROM raw_documents""")
def q16(s, d):
    """One epoch per post and where it comes from."""
    epoch = lambda c: F.unix_timestamp(F.col(c).cast("timestamp"))
    at = F.coalesce(epoch("created_at"), F.col("created_at_ts"), epoch("fetched_at"))
    origin = F.when(F.col("created_at").isNotNull(), "source").when(F.col("created_at_ts").isNotNull(), "normalized").otherwise("ingested")
    return table(s, d, RAW).select("id", at.alias("at"), origin.alias("origin"))


@query("t18_card", """SELECT id, concat_ws(' · ', coalesce(brand, '?'), CAST(year AS VARCHAR), CASE WHEN price > 0 THEN replace(format('{:,}', price), ',', ' ') || ' ₽' END) AS card FROM normalized_documents""")
def t18(s, d):
    money = F.when(F.col("price") > 0, F.concat(F.replace(F.format_number("price", 0), F.lit(","), F.lit(" ")), F.lit(" ₽")))
    return table(s, d, NORM).select("id", F.concat_ws(" · ", F.coalesce("brand", F.lit("?")), F.col("year").cast("string"), money).alias("card"))

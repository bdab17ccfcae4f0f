"""Queries over names and entities (T6-T9, E6-E8, E10, E17-E24, E26, E30); the twins spell out their own constants."""

from __future__ import annotations

from pyspark.sql import functions as F

from motorloom.functions import extract as ex
from motorloom.functions import taxonomy as tax
from motorloom.operators import entities as en
from motorloom.plans.registry import query
from motorloom.sources.tables import table

RAW, NORM, ASKED = "raw_documents", "normalized_documents", "search_events"


def _squeezed(x: str) -> str:
    return rf"trim(regexp_replace({x}, '[\s\x{{00A0}}]+', ' ', 'g'))"


def _norm(x: str) -> str:
    out = f"lower({_squeezed(x)})"
    for pair in "аa вb сc еe нh кk мm оo рp тt хx уy".split():
        out = rf"regexp_replace({out}, '(^|[^0-9a-zа-яё_]){pair[0]}([0-9-])', '\1{pair[1]}\2', 'g')"
        out = rf"regexp_replace({out}, '([0-9-]){pair[0]}([^0-9a-zа-яё_]|$)', '\1{pair[1]}\2', 'g')"
    out = f"regexp_replace({out}, '[-_/]+', ' ', 'g')"
    out = rf"regexp_replace({out}, '([a-zа-яё])([0-9])', '\1 \2', 'g')"
    return _squeezed(rf"regexp_replace({out}, '([0-9])([a-zа-яё])', '\1 \2', 'g')")


def _words(x: str) -> str:
    return f"regexp_extract_all({_norm(x)}, '([0-9a-zа-яё]+)', 1)"


def _phrase(x: str) -> str:
    return f"nullif(array_to_string({_words(x)}, ''), '')"


def _compact(x: str) -> str:
    return rf"regexp_replace(lower({x}), '[-_\s\x{{00A0}}]+', '', 'g')"


def _runs(tbl: str, key: str, x: str) -> str:
    """(key, run): every joined run of up to four words."""
    lists = ", ".join(f"list_transform(generate_series(1, len(w) - {k - 1}), lambda i: array_to_string(w[i:i+{k - 1}], ''))" for k in (1, 2, 3, 4))
    return f"(SELECT {key}, unnest(list_distinct(flatten([{lists}]))) AS run FROM (SELECT {key}, {_words(x)} AS w FROM {tbl}))"


@query("t06_taxonomy_norm", f"SELECT id, {_norm('title')} AS t FROM raw_documents")
def t06(s, d):
    return table(s, d, RAW).select("id", tax.norm(F.col("title")).alias("t"))


@query("t07_keys", f"SELECT id, replace({_norm('model')}, ' ', '_') AS k, {_compact('model')} AS compact FROM normalized_documents")
def t07(s, d):
    return table(s, d, NORM).select("id", tax.key(F.col("model")).alias("k"), tax.compact(F.col("model")).alias("compact"))


@query("t08_alias_variants", f"""SELECT DISTINCT model, unnest([n, {_compact('n')}, replace(n, ' ', '')]) AS variant FROM (SELECT model, {_norm('alias_norm')} AS n FROM model_aliases)""")
def t08(s, d):
    return table(s, d, "model_aliases").select("model", F.explode(tax.variants(F.col("alias_norm"))).alias("variant")).distinct()


@query("t09_phrase_hits", f"""SELECT DISTINCT r.id, a.model FROM {_runs('raw_documents', 'id', 'title')} r JOIN (SELECT model, {_phrase('alias_norm')} AS p FROM model_aliases) a ON r.run = a.p""")
def t09(s, d):
    return en.hits(table(s, d, RAW), "id", F.col("title"), table(s, d, "model_aliases")).select("id", "model").distinct()


_BRAND_HITS = f"""(SELECT r.id, a.brand, a.n, a.ord FROM {_runs('{tbl}', 'id', '{x}')} r
  JOIN (SELECT brand, ord, length({_norm('alias_norm')}) AS n, {_phrase('alias_norm')} AS p FROM brand_aliases) a ON r.run = a.p)"""


def _brand_hits(tbl: str, x: str) -> str:
    return _BRAND_HITS.replace("{tbl}", tbl).replace("{x}", x)


def _brand(tbl: str, x: str) -> str:
    return f"(SELECT id, arg_min(brand, (-n, ord)) AS brand, round(least(1.0, 0.95 + max(n) / 100.0::DOUBLE), 4) AS confidence FROM {_brand_hits(tbl, x)} GROUP BY id)"


_OWNED = f"""(SELECT {_phrase('alias_norm')} AS p, any_value(brand) AS brand, any_value(model) AS model, max(length({_norm('alias_norm')})) AS n FROM model_aliases
  GROUP BY 1 HAVING count(DISTINCT (brand, model)) = 1 AND length(p) >= 3)"""
_FROM_MODEL = f"""(WITH met AS (SELECT r.id, o.brand, o.model, max(o.n) AS n FROM {_runs('raw_documents', 'id', 'title')} r JOIN {_OWNED} o ON r.run = o.p GROUP BY 1, 2, 3),
  best AS (SELECT id, any_value(brand) AS brand, any_value(model) AS model, count(*) AS m FROM met JOIN (SELECT id, max(n) AS n FROM met GROUP BY id) USING (id, n) GROUP BY id)
  SELECT id, brand, model FROM best WHERE m = 1 AND id NOT IN (SELECT b.id FROM best b JOIN {_brand_hits('raw_documents', 'title')} h ON h.id = b.id WHERE h.brand <> b.brand))"""


@query("e19_brand_phrase", f"""SELECT id, coalesce(b.brand, m.brand) AS brand, coalesce(b.confidence, 0.75) AS confidence FROM {_brand('raw_documents', 'title')} b
  FULL JOIN {_FROM_MODEL} m USING (id)""")
def e19p(s, d):
    rows, brands = table(s, d, RAW), table(s, d, "brand_aliases")
    direct = en.brand_of(rows, "id", F.col("title"), brands)
    by_model = en.brand_from_model(rows, "id", F.col("title"), table(s, d, "model_aliases"), brands).select("id", F.col("brand").alias("b2"))
    return direct.join(by_model, "id", "full").select("id", F.coalesce("brand", "b2").alias("brand"), F.coalesce("confidence", F.lit(0.75)).alias("confidence"))


@query("e21_brand_from_model", f"SELECT id, brand, model FROM {_FROM_MODEL}")
def e21(s, d):
    return en.brand_from_model(table(s, d, RAW), "id", F.col("title"), table(s, d, "model_aliases"), table(s, d, "brand_aliases"))


def _model_in(tbl: str, x: str, brand: str) -> str:
    return f"""(SELECT id, arg_min(model, (-score, ord)) AS model FROM (SELECT id, model, ord, own + CASE WHEN list_contains(runs, p) THEN 10 * n WHEN length(p) >= 4 AND contains(txt, p) THEN 8 * length(p) END AS score
    FROM (SELECT t.id, {brand} AS brand, {_compact('t.' + x)} AS txt, r.runs FROM {tbl} t JOIN (SELECT id, list(run) AS runs FROM {_runs(tbl, 'id', x)} GROUP BY id) r USING (id)) q
    JOIN (SELECT brand, model, ord, {_phrase('alias_norm')} AS p, length({_norm('alias_norm')}) AS n, CAST({_norm('model')} = {_norm('alias_norm')} AS INT) AS own FROM model_aliases) a USING (brand)) WHERE score IS NOT NULL GROUP BY id)"""


@query("e20_model_in_brand", f"SELECT id, brand, model FROM {_brand('raw_documents', 'title')} b JOIN {_model_in('(SELECT x.id, x.title, y.brand FROM raw_documents x JOIN ' + _brand('raw_documents', 'title') + ' y USING (id))', 'title', 't.brand')} m USING (id)")
def e20m(s, d):
    rows = table(s, d, RAW)
    brand = en.brand_of(rows, "id", F.col("title"), table(s, d, "brand_aliases")).select("id", "brand")
    found = en.model_in_brand(rows.join(brand, "id"), "id", F.col("title"), "brand", table(s, d, "model_aliases"))
    return brand.join(found, "id")


@query("e22_canonical", f"""WITH b AS (SELECT {_phrase('alias_norm')} AS p, arg_min(brand, ord) AS entry FROM brand_aliases GROUP BY 1),
  m AS (SELECT brand AS entry, {_phrase('alias_norm')} AS q, arg_min(model, ord) AS name FROM model_aliases GROUP BY 1, 2)
  SELECT n.id, coalesce(b.entry, nullif(replace({_norm('n.brand')}, ' ', '_'), '')) AS brand, coalesce(m.name, nullif(replace({_norm('n.model')}, ' ', '_'), '')) AS model
  FROM normalized_documents n LEFT JOIN b ON b.p = {_phrase('n.brand')} LEFT JOIN m ON m.entry = b.entry AND m.q = {_phrase('n.model')}""")
def e22(s, d):
    return en.canonical(table(s, d, NORM), "id", "brand", "model", table(s, d, "brand_aliases"), table(s, d, "model_aliases"))


@query("e23_alias_index", f"""SELECT alias, arg_min(brand, ord) AS brand, arg_min(model, ord) AS model FROM (SELECT brand, model, ord, unnest([n, {_compact('n')}]) AS alias
  FROM (SELECT brand, model, ord, {_norm('alias_norm')} AS n FROM model_aliases)) WHERE length(alias) > 1 AND NOT regexp_matches(alias, '^[0-9 ]+$') GROUP BY alias""")
def e23(s, d):
    return en.alias_index(table(s, d, "model_aliases"))


@query("e24_brands_listed", f"""WITH w AS (SELECT id, {_words('content')} AS w FROM raw_documents), t AS (SELECT id, generate_subscripts(w, 1) AS pos, unnest(w) AS word FROM w),
  f AS (SELECT id, brand, min(pos) AS pos FROM t JOIN (SELECT {_phrase('alias_norm')} AS word, arg_min(brand, ord) AS brand FROM brand_aliases GROUP BY 1) USING (word) GROUP BY 1, 2)
  SELECT id, string_agg(brand, ',' ORDER BY pos) AS brands FROM f GROUP BY id""")
def e24(s, d):
    return en.brands_listed(table(s, d, RAW), "id", F.col("content"), table(s, d, "brand_aliases"))


_SEGMENT = "regexp_extract(regexp_replace(source_url, '^[a-zA-Z]+://[^/]*', ''), '^/([^/?#]+)/', 1)"


@query("e18_brand_by_address", f"SELECT id, brand FROM {_brand('raw_documents', _SEGMENT)}")
def e18(s, d):
    segment = F.regexp_extract(F.regexp_replace("source_url", "^[a-zA-Z]+://[^/]*", ""), "^/([^/?#]+)/", 1)
    return en.brand_of(table(s, d, RAW), "id", segment, table(s, d, "brand_aliases")).select("id", "brand")


_FUSED = f"""WITH o AS (SELECT r.id, r.title, r.content, coalesce(t.brand, c.brand, a.brand) AS brand, CASE WHEN t.brand IS NOT NULL THEN 'title' WHEN c.brand IS NOT NULL THEN 'text' ELSE 'address' END AS origin
  FROM raw_documents r LEFT JOIN {_brand('raw_documents', 'title')} t USING (id) LEFT JOIN {_brand('raw_documents', 'content')} c USING (id) LEFT JOIN {_brand('raw_documents', _SEGMENT)} a USING (id)
  WHERE coalesce(t.brand, c.brand, a.brand) IS NOT NULL)
  SELECT o.id, o.brand, CASE WHEN lower(coalesce(x.model, y.model)) <> lower(o.brand) THEN coalesce(x.model, y.model) END AS model, o.origin
  FROM o LEFT JOIN {_model_in('o', 'title', 't.brand')} x ON x.id = o.id LEFT JOIN {_model_in('o', 'content', 't.brand')} y ON y.id = o.id"""


@query("e26_fused", _FUSED)
def e26(s, d):
    return en.fused(table(s, d, RAW), "id", F.col("title"), F.col("content"), F.col("source_url"), table(s, d, "brand_aliases"), table(s, d, "model_aliases"))


_SPACED = r"regexp_replace(regexp_replace(replace(lower(content), chr(160), ' '), '([0-9])[.,]([0-9]{3})([^0-9a-zа-яё_]|$)', '\1\2\3', 'g'), '(км|km)', ' \1', 'g')"


def _digits(group: str) -> str:
    return f"try_cast(regexp_replace({group}, '[^0-9.]', '', 'g') AS DOUBLE)"


_OK = "CASE WHEN v BETWEEN 1000 AND 1500000 THEN v END"


@query("e06_mileage_fallback", f"""WITH t AS (SELECT id, lower(content) AS low, {_SPACED} AS x FROM raw_documents WHERE content IS NOT NULL), p AS (SELECT id, low, x, [
    trunc({_digits("nullif(regexp_extract(x, 'пробег\\s*[:-]?\\s*([0-9][0-9\\s]{1,7})', 1), '')")}), trunc({_digits("nullif(regexp_extract(x, '([0-9]{1,3}[\\s.,]?[0-9]{1,3})\\s*(?:км|km)', 1), '')")}),
    trunc(1000 * {_digits("nullif(replace(regexp_extract(x, '([0-9]{1,3}(?:[.,][0-9]+)?)\\s*(?:тыс|т.км|ткм|k|к)([^0-9a-zа-яё_]|$)', 1), ',', ''), '')")}), trunc({_digits("nullif(regexp_extract(x, '([0-9]{4,7})\\s*(?:км|km)', 1), '')")})] AS vs FROM t)
  SELECT id, CASE WHEN regexp_matches(low, 'км/ч|скорость') THEN NULL ELSE CAST(coalesce(list_filter(vs, lambda v: v BETWEEN 1000 AND 1500000)[1],
    CASE WHEN contains(x, 'без пробега') AND NOT regexp_matches(x, 'по рф|по россии|по р[.]ф[.]') AND NOT regexp_matches(x, '[0-9]{1,3}[\\s.,]?[0-9]{3}\\s*(км|km)') THEN 0 END) AS BIGINT) END AS mileage FROM p""")
def e06(s, d):
    return table(s, d, RAW).filter("content is not null").select("id", ex.mileage_fallback(F.col("content")).alias("mileage"))


@query("e08_mileage_context", "SELECT id, regexp_matches(lower(raw_query), 'пробег|км|km') AS about FROM search_events")
def e08(s, d):
    return table(s, d, ASKED).select("id", ex.about_mileage(F.col("raw_query")).alias("about"))


@query("e10_fuel_canonical", """SELECT id, CASE WHEN f IN ('бензин','бензиновый','бенз','petrol','gasoline','mpi','tsi','tfsi','fsi') THEN 'petrol' WHEN f IN ('дизель','дизельный','диз','diesel','tdi','dci','cdi') THEN 'diesel'
  WHEN f IN ('гибрид','hybrid','phev','hev') THEN 'hybrid' WHEN f IN ('электро','электр','electric','ev') THEN 'electric' WHEN f IN ('газ','lpg','gbo','cng','gas') THEN 'gas'
  WHEN f IN ('газ/бензин','газ бензин','gas_petrol') THEN 'gas_petrol' END AS fuel FROM (SELECT id, lower(trim(fuel)) AS f FROM normalized_documents)""")
def e10(s, d):
    return table(s, d, NORM).select("id", ex.fuel_canonical(F.col("fuel")).alias("fuel"))


@query("e17_image_url", r"""SELECT id, nullif(regexp_extract(content, '(?i)(https?://[^\s"''<>]+?[.](?:jpg|jpeg|png|webp))', 1), '') AS image FROM raw_documents""")
def e17(s, d):
    return table(s, d, RAW).select("id", ex.image_url(F.col("content")).alias("image"))


@query("e30_model_tokens", r"""SELECT id, list_distinct(list_filter(string_split(lower(title), ' '), lambda w: regexp_matches(w, '^[0-9a-zа-яё-]+$') AND NOT regexp_matches(w, '^(19|20)[0-9]{2}$')
  AND ((regexp_matches(w, '[0-9]') AND regexp_matches(w, '[a-zа-яё]')) OR contains(w, '-')))) AS words FROM raw_documents WHERE title IS NOT NULL""")
def e30(s, d):
    return table(s, d, RAW).filter("title is not null").select("id", ex.model_tokens(F.col("title")).alias("words"))

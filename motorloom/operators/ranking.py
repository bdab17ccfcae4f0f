"""Search: vector top-k with pre-filter, hard filters, signals, score, ordered dedup, caps, pages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from motorloom.functions.text import canonical_url, norm_tok, strict_key


def cosine(a: str, b: str) -> Column:
    """Cosine of two float arrays, summed in double; null where either has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def top_k(queries: DataFrame, points: DataFrame, k: int, on: list[str]) -> DataFrame:
    """The k best points of each query among those equal in ``on`` (the pre-filter is the join key)."""
    scored = queries.join(points, on).withColumn("sim", F.round(cosine("query_vector", "vector"), 6))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "point_id")))
    return ranked.filter(F.col("rank") <= k)


def top_k_blocks(queries: DataFrame, points: DataFrame, k: int, on: str, query_block: int = 2_000, point_block: int = 20_000) -> DataFrame:
    """The k best points of each query among those equal in ``on``, by cosine: every pair is scored, in blocks of bounded size.

    Queries and points are dealt to counted numbers of blocks by hash; each pair of blocks
    meets in one task per value of ``on``, which keeps the k best of its points, and the
    k best of these are the result. Neither side is broadcast.
    """
    blocks = lambda rows, most: max(1, -(-rows.count() // most))
    nq, np_ = blocks(queries, query_block), blocks(points, point_block)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    left = queries.withColumn("_q", F.pmod(F.xxhash64("query_id"), F.lit(nq))).withColumn("_p", each(np_))
    right = points.withColumn("_p", F.pmod(F.xxhash64("point_id"), F.lit(np_))).withColumn("_q", each(nq))

    def unit(vectors: pd.Series) -> np.ndarray:
        rows = np.stack([np.asarray(v, np.float64) for v in vectors])
        with np.errstate(invalid="ignore"):
            return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))

    def score(q: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "point_id", on, "sim"]
        q, p = q[q["query_vector"].notna()], p[p["vector"].notna()].sort_values("point_id")
        if q.empty or p.empty:
            return pd.DataFrame(columns=columns)
        ids, base, out = p["point_id"].to_numpy(), unit(p["vector"]), []
        for query, vector in zip(q["query_id"], unit(q["query_vector"])):
            sim = np.round(base @ vector, 6)
            best = np.argsort(-sim, kind="stable")[:k]  # ties by id, no similarity last
            out.append(pd.DataFrame({"query_id": query, "point_id": ids[best], on: q[on].iloc[0], "sim": sim[best]}))
        return pd.concat(out)[columns]

    kinds = {**dict(queries.dtypes), **dict(points.dtypes)}
    schema = f"query_id {kinds['query_id']}, point_id {kinds['point_id']}, {on} {kinds[on]}, sim double"
    keys = ["_q", "_p", on]
    part = left.filter(F.col(on).isNotNull()).groupBy(*keys).cogroup(right.filter(F.col(on).isNotNull()).groupBy(*keys)).applyInPandas(score, schema)
    part = part.withColumn("sim", F.when(~F.isnan("sim"), F.col("sim")))
    ranked = part.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "point_id")))
    return ranked.filter(F.col("rank") <= k)


def max_per_document(hits: DataFrame, key: str) -> DataFrame:
    best = F.struct("sim", -F.col("point_id"))
    return hits.groupBy("query_id", key).agg(F.max("sim").alias("sim"), F.max_by("point_id", best).alias("point_id"))


def drop_reasons(brand: Column, model: Column, mileage_max: Column, fuel: Column) -> Column:
    """Reasons why a listing fails a query; unknown mileage and fuel pass, an unknown brand or model fails."""
    row = lambda c, why: F.when(c, why)
    return F.array_compact(F.array(
        row(brand.isNotNull() & (F.col("brand").isNull() | (F.col("brand") != brand)), "brand_mismatch"),
        row(model.isNotNull() & ~soft_model(F.col("model"), model), "model_mismatch"),
        row(F.coalesce(F.col("mileage") > mileage_max, F.lit(False)), "mileage_over"),
        row(fuel.isNotNull() & F.coalesce(F.col("fuel") != fuel, F.lit(False)), "fuel_mismatch"),
    ))


def price_fit(price: Column, most: Column) -> Column:
    denom = F.coalesce(most, F.lit(5_000_000)).cast("double")
    return F.when(price.isNull(), 0.15).when(F.coalesce(price > most, F.lit(False)), 0.05).otherwise(F.greatest(F.lit(0.0), F.lit(1.0) - price / denom))


def mileage_fit(mileage: Column, most: Column) -> Column:
    """A bound of zero is met by a mileage of zero at most."""
    denom = F.coalesce(most, F.lit(250_000)).cast("double")
    share = F.when(denom == 0, F.when(mileage > 0, 0.0).otherwise(1.0)).otherwise(F.lit(1.0) - F.try_divide(mileage, denom))
    return F.when(mileage.isNull(), F.when(most.isNotNull(), 0.15).otherwise(0.5)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))


def freshness(epoch: Column, as_of: int) -> Column:
    age = (F.lit(as_of) - epoch).cast("double") / 86400.0
    return F.when(epoch.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - age / 180.0)))


def completeness(cols: list[str]) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0)).cast("double") / len(cols)


def ordered_dedup(rows: DataFrame, keys: list[str], order: tuple[str | Column, ...] = ("rank",), number: str | None = None) -> DataFrame:
    """Walk each query's rows in ``order``; a row goes if any of its keys was already accepted.

    The walk is sequential by nature. It streams a query's rows in order and holds
    the accepted keys only, so any number of rows of a query is walked. Null keys match nothing.
    ``number``: a further column for the place of the row among all rows of its query, from 1.
    """
    fields = [k for k in rows.columns]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, seen, at = None, [set() for _ in keys], 0
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in keys]
            keep, places = [], []
            for query, *values in zip(batch.column("query_id").to_pylist(), *columns):
                if query != asked:
                    asked, seen, at = query, [set() for _ in keys], 0
                at += 1
                for known, v in zip(seen, values):
                    if v in known:  # null is never added
                        keep.append(False)
                        break
                else:
                    keep.append(True)
                    for known, v in zip(seen, values):
                        if v is not None:
                            known.add(v)
                places.append(at)
            out = batch.select(fields)
            if number:
                out = pa.RecordBatch.from_arrays([*out.columns, pa.array(places, pa.int32())], names=[*fields, number])
            yield out.filter(pa.array(keep, pa.bool_()))

    schema = StructType([*rows.schema.fields, *([StructField(number, IntegerType())] if number else [])])
    return rows.repartition("query_id").sortWithinPartitions("query_id", *order).mapInArrow(walk, schema)


def source_cap(rows: DataFrame, most: int) -> DataFrame:
    w = Window.partitionBy("query_id", "source").orderBy("rank")
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= most).drop("_n")


def page(rows: DataFrame, number: int, size: int) -> DataFrame:
    size = max(1, min(50, size))
    w = Window.partitionBy("query_id").orderBy("rank")
    return rows.withColumn("pos", F.row_number().over(w)).filter(F.col("pos").between((number - 1) * size + 1, number * size))


def blend(base: Column, rerank: Column, by: list[str], share: float = 0.2) -> Column:
    """Min-max of the rerank score within each query (.5 if flat), mixed into the base score."""
    w = Window.partitionBy(*by)
    low, high = F.min(rerank).over(w), F.max(rerank).over(w)
    scaled = F.when(high > low, (rerank - low) / (high - low)).otherwise(0.5)
    return base * (1 - share) + scaled * share


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """Corpus BM25 of (id, words) for (query_id, words); only rows that share a word are touched.

    Word counts are summed before anything is joined, and lengths travel with them.
    """
    totals = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("words")).alias("avg_len"))
    asked = queries.select("query_id", F.explode(F.array_distinct("words")).alias("word"))
    wanted = asked.select("word").distinct()
    tf = (
        docs.select("id", F.size("words").alias("len"), F.explode("words").alias("word"))
        .join(wanted, "word", "left_semi").groupBy("id", "len", "word").agg(F.count(F.lit(1)).alias("tf"))
    )
    df = tf.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return (
        asked.join(df, "word").join(tf, "word").crossJoin(F.broadcast(totals))  # totals: one row
        .groupBy("query_id", "id").agg(F.round(F.sum(part), 4).alias("score"))
    )


def model_words(c: Column) -> Column:
    return F.filter(F.split(norm_tok(c), " "), lambda w: w != "")


def soft_model(have: Column, wanted: Column) -> Column:
    """Whether a listing's model fits the wanted one: with digits letter for letter, else by words, joined words or their ends."""
    return soft_parts(strict_key(have), model_words(have), strict_key(wanted), model_words(wanted), wanted.rlike("[0-9]"))


def soft_parts(have: Column, a: Column, wanted: Column, b: Column, digits: Column) -> Column:
    """``soft_model`` of strict keys and words that were made beforehand, once a listing and once a query."""
    strict = have == wanted
    ja, jb = F.array_join(a, ""), F.array_join(b, "")
    one = F.array_contains(a, jb) | (ja == jb)
    several = F.forall(b, lambda w: F.array_contains(a, w)) | ja.startswith(jb) | ja.endswith(jb) | ((F.size(a) == 1) & F.array_contains(b, ja))
    loose = (F.size(a) > 0) & (F.size(b) > 0) & F.when(F.size(b) == 1, one).otherwise(several)
    return F.coalesce(F.when(digits, strict).otherwise((strict & (wanted != "")) | loose), F.lit(False))


def match_text(parts: list[str], content: str) -> Column:
    """The text in which the query's values are looked for: its content by the first 600 characters."""
    return norm_tok(F.concat_ws(" ", *parts, F.substring(content, 1, 600)))


def _table(texts: list, terms: list, look) -> np.ndarray:
    return np.array([[look(i, w) for w in terms] for i in range(len(texts))], np.float32).reshape(len(texts), len(terms))


def _hits(texts: list, lists: list[list[str]], look) -> np.ndarray:
    """How many words of each list each text holds; a word is looked up once a text."""
    number: dict[str, int] = {}
    times = [[number.setdefault(w, len(number)) for w in words] for words in lists]
    wanted = np.zeros((len(number), len(lists)), np.float32)
    for j, words in enumerate(times):
        np.add.at(wanted, (words, j), 1)
    return np.rint(_table(texts, list(number), look) @ wanted).astype(np.int32)


def _said_named(texts: list, asked: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """``said`` and ``named`` of ``mentions``: a row for each text, a column for each query."""
    joined = [t.replace(" ", "") for t in texts]
    brands, models = asked.column("n_brand").to_pylist(), asked.column("n_model").to_pylist()

    def each(values: list, look) -> np.ndarray:
        number = {v: k for k, v in enumerate(dict.fromkeys(values))}
        return _table(texts, list(number), look)[:, [number[v] for v in values]]

    said = 1.5 * each(brands, lambda i, w: w in texts[i])
    said += 1.5 * each(models, lambda i, w: w is not None and (w in texts[i] or w.replace(" ", "") in joined[i]))
    named = _hits(texts, [[w for w in words if w] for words in asked.column("n_words").to_pylist()], lambda i, w: w in texts[i])
    return said.astype(np.float32), named


def mentions(rows: pa.Table, asked: pa.Table) -> pa.Table:
    """What each listing's texts hold of each query: one row a listing, lists in the queries' order ``at``.

    ``said``: 1.5 for the brand in ``text`` and 1.5 for the model, ``named``: how many of the
    normalised words ``text`` holds, ``held``: how many different words ``content`` holds.
    A word is looked up once a listing, however many queries have it.
    """
    asked = asked.sort_by("at")
    texts, contents = rows.column("text").to_pylist(), rows.column("content").to_pylist()
    said, named = _said_named(texts, asked)
    held = _hits(texts, [list(dict.fromkeys(words)) for words in asked.column("words").to_pylist()], lambda i, w: contents[i] is not None and w in contents[i])
    out = rows.drop_columns(["text", "content"])
    ends = pa.array(np.arange(len(texts) + 1) * asked.num_rows, pa.int32())
    for name, values in (("said", said), ("named", named), ("held", held)):
        out = out.append_column(name, pa.ListArray.from_arrays(ends, pa.array(values.ravel())))
    return out


def match_sums(rows: pa.Table, asked: pa.Table) -> pa.Table:
    """(query_id, text_match, hits): ``match_share`` summed over the listings (text, fuel), one row a query; the pairs never leave this group."""
    texts, fuels = rows.column("text").to_pylist(), rows.column("fuel").to_pylist()
    said, named = _said_named(texts, asked)
    number = {f: k for k, f in enumerate(dict.fromkeys(f for f in fuels if f is not None))}
    have, want = (np.array([number.get(f, none) for f in values], np.int64) for values, none in ((fuels, -1), (asked.column("w_fuel").to_pylist(), -2)))
    share = np.minimum((said.astype(np.float64) + (have[:, None] == want) * 0.8 + named * 0.15) / 3.0, 1.0)
    return pa.table({"query_id": asked.column("query_id"), "text_match": share.sum(axis=0), "hits": np.full(asked.num_rows, len(texts), np.int64)})


def match_share(said: Column, fits: Column, named: Column) -> Column:
    """Weighted mentions of the query's values in the listing's text, over three, at most 1."""
    return F.least((said.cast("double") + F.coalesce(fits, F.lit(False)).cast("double") * 0.8 + named * 0.15) / 3.0, F.lit(1.0))


#: Prior quality by source; anything else has .5.
PRIORS = {"auto_ru": 0.95, "avito": 0.90, "avito.ru": 0.90, "drom": 0.90, "drom.ru": 0.90, "telegram": 0.60, "unknown": 0.50}


def source_quality(source: Column, address: Column) -> Column:
    """Prior by name of the source, else by host, else by a known name inside the host."""
    prior = F.create_map(*(F.lit(x) for kv in PRIORS.items() for x in kv))
    name = F.lower(F.trim(F.coalesce(source, F.lit("unknown"))))
    host = F.regexp_extract(F.lower(F.trim(address)), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    inside = F.when(host.contains("avito.ru"), PRIORS["avito.ru"]).when(host.contains("drom.ru"), PRIORS["drom.ru"])
    return F.coalesce(F.try_element_at(prior, name), F.try_element_at(prior, host), inside, F.lit(0.5))


#: Weights of the signals before they are scaled to one.
FULL_WEIGHTS = {
    "semantic": 0.25, "text_match": 0.20, "freshness": 0.10, "completeness": 0.08, "price_fit": 0.08, "mileage_fit": 0.06, "fuel_match": 0.12,
    "brand_match": 0.15, "model_match": 0.18, "source_quality": 0.03, "sale_intent": 0.02, "representation_quality": 0.02, "bm25": 0.15,
}


def representation_quality(kind: Column) -> Column:
    return F.when(kind == "title_boost", 1.0).when(kind == "title", 0.85).when(kind == "structured", 0.70).otherwise(0.50)


def full_score(w_fuel: Column, fuel: Column, mileage_max: Column, mileage: Column, w_year: Column, year: Column) -> Column:
    """Weighted mean of all signals (columns of their names), with penalties where a wanted value is unknown or missed."""
    total = sum((F.col(k) * w for k, w in FULL_WEIGHTS.items()), F.lit(0.0)) / sum(FULL_WEIGHTS.values())
    by_fuel = F.when(w_fuel.isNull(), 1.0).when(fuel.isNull(), 0.15).when(fuel != w_fuel, 0.01).otherwise(1.0)
    young = F.coalesce(year >= 2024, F.lit(False))
    by_mileage = F.when(mileage_max.isNull(), 1.0).when(mileage.isNull(), F.when(young, 1.0).otherwise(0.3)).when(mileage > mileage_max, 0.01).otherwise(1.0)
    by_year = F.when(w_year.isNotNull() & year.isNull(), 0.1).otherwise(1.0)
    return F.round(total * by_fuel * by_mileage * by_year, 6)


def fingerprint(address: Column, brand: Column, model: Column, *numbers: str) -> Column:
    """Host, path, brand, model and numbers of a listing in one string; missing parts are empty."""
    canonical = canonical_url(address)
    host = F.regexp_extract(canonical, "^[a-z][a-z0-9+.-]*://([^/?]*)", 1)
    path = F.lower(F.regexp_extract(canonical, "^[a-z][a-z0-9+.-]*://[^/?]*([^?]*)", 1))
    parts = [host, path, norm_tok(brand), norm_tok(model), *(F.col(n).cast("string") for n in numbers)]
    return F.concat_ws("|", *(F.coalesce(p, F.lit("")) for p in parts))


def multiplied(score: Column, w_fuel: Column, fuel: Column, w_model: Column, fits: Column) -> Column:
    """Score after the multipliers of fuel and model (``fits``: whether it is the wanted one); at most 1."""
    other = F.when(w_fuel == "electric", 0.3).otherwise(0.85)
    by_fuel = F.when(w_fuel.isNull(), 1.0).when(F.coalesce(F.lower(fuel), F.lit("")) == w_fuel, 1.0).otherwise(other)
    first = F.least(F.lit(1.0), F.round(score * by_fuel, 6))
    return F.when(w_model.isNull(), first).when(fits, F.least(F.lit(1.0), first * 1.4)).otherwise(F.round(first * 0.6, 6))

"""Chunks, representations, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK, CARRY, SHORT = 1200, 200, 30


def chunks(c: Column) -> Column:
    """Sentences packed greedily into chunks of at most 1,200 characters; each chunk begins with the last 200 of the one before.

    A longer sentence is cut into slices of the free space, so no text is lost.
    """
    room = CHUNK - CARRY - 1
    text = F.trim(F.regexp_replace(F.regexp_replace(c, "[;•*]", ". "), "[\\s ]+", " "))
    slices = F.flatten(F.transform(
        F.split(text, "(?<=[.!?]) "),
        lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length(s), F.lit(1)) - 1) / room).cast("int")), lambda k: F.substring(s, k * room + 1, F.lit(room))),
    ))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))
    fits = lambda a, s: F.length(a["cur"]) + F.length(s) + 1 <= CHUNK
    grow = lambda a, s: F.when(a["cur"] == "", s).otherwise(F.concat(a["cur"], F.lit(" "), s))
    step = lambda a, s: F.when(fits(a, s), F.struct(a["done"].alias("done"), grow(a, s).alias("cur"))).otherwise(
        F.struct(F.array_append(a["done"], a["cur"]).alias("done"), F.concat(F.substring(a["cur"], -CARRY, CARRY), F.lit(" "), s).alias("cur"))
    )
    folded = F.aggregate(slices, start, step, lambda a: F.when(a["cur"] == "", a["done"]).otherwise(F.array_append(a["done"], a["cur"])))
    return F.filter(folded, lambda s: F.length(s) >= SHORT)


def chunk_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk_index, chunk_text); a chunk that repeats an earlier one of its document is left out."""
    all_ = docs.select(key, F.posexplode(chunks(F.col(text))).alias("chunk_index", "chunk_text"))
    return all_.groupBy(key, "chunk_text").agg(F.min("chunk_index").alias("chunk_index")).select(key, "chunk_index", "chunk_text")


def structured_text() -> Column:
    there = lambda name, label: F.when(F.col(name).isNotNull() & (F.col(name).cast("string") != "0"), F.concat(F.lit(label + " "), F.col(name).cast("string")))
    return F.concat_ws(" ", "brand", "model", there("brand", "brand"), there("model", "model"), there("fuel", "fuel"), there("year", "year"), there("price", "price"), there("mileage", "mileage"))


def point_id(chunk: Column, kind: Column) -> Column:
    """First 64 bits of the SHA-1 of chunk and kind."""
    digest = F.sha1(F.concat_ws("_", chunk.cast("string"), kind))
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")


def representations(docs: DataFrame) -> DataFrame:
    """Up to four points a chunk; empty texts give none."""
    kinds = F.array(*(
        F.struct(F.lit(k).alias("kind"), c.alias("body"))
        for k, c in (("title", F.col("title")), ("title_boost", F.col("title")), ("content", F.col("chunk_text")), ("structured", structured_text()))
    ))
    rows = docs.select("chunk_id", F.explode(F.filter(kinds, lambda x: F.coalesce(x["body"], F.lit("")) != "")).alias("p"))
    return rows.select("chunk_id", "p.kind", point_id(F.col("chunk_id"), F.col("p.kind")).alias("point_id"))


def listing_key(url: str, parts: list[str]) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", F.coalesce(F.col(url), F.lit("")), *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))), 1, 24)


def hashed_vectors(rows: DataFrame, key: str, words: str, size: int = 64) -> DataFrame:
    """Offline text vector: counts of hashed words, unit length; rows without words have none."""
    slot = F.pmod(F.xxhash64("w"), F.lit(size)).cast("int")
    counted = rows.select(key, F.explode(words).alias("w")).groupBy(key, slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    per = counted.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    parts = (F.coalesce(F.try_element_at("m", F.lit(k)), F.lit(0)) / F.col("norm") for k in range(size))
    return per.select(key, F.array(*(p.cast("float") for p in parts)).alias("vector"))

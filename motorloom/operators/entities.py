"""Brands and models out of texts: phrase lookup by equality joins, never a pattern per alias and text.

A dictionary alias of several words, with any separators, equals one joined run of the
words of the text. Texts are turned into such runs and joined with the dictionary, which
is broadcast only within a counted bound and shuffled beyond it.

Defined results: null and empty texts have no entity; an alias that stands twice in the
dictionary counts by its first row; equal candidates go to the first row; an empty
dictionary finds nothing; further columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorloom.functions import taxonomy as tax
from motorloom.plans.runtime import join_dictionary, stash


def hits(rows: DataFrame, key: str, text: Column, listing: DataFrame, alias: str = "alias_norm") -> DataFrame:
    """Rows of ``listing`` whose alias occurs in the text as a phrase: key, its columns, norm."""
    runs = rows.select(F.col(key), tax.words(text).alias("_w")).select(key, F.explode(tax.spans(F.col("_w"))).alias("_run"))
    names = listing.withColumn("_run", tax.phrase(F.col(alias))).withColumn("norm", tax.norm(F.col(alias))).filter("_run is not null")
    return join_dictionary(runs, names, "_run").drop("_run")


def brand_of(rows: DataFrame, key: str, text: Column, brands: DataFrame) -> DataFrame:
    """(key, brand, confidence): the longest brand phrase of the text."""
    best = F.struct(-F.length("norm"), F.col("ord"))
    found = hits(rows, key, text, brands).groupBy(key).agg(F.min_by("brand", best).alias("brand"), F.max(F.length("norm")).alias("n"))
    return found.select(key, "brand", F.round(F.least(F.lit(1.0), F.lit(0.95) + F.col("n") / 100.0), 4).alias("confidence"))


def brand_from_model(rows: DataFrame, key: str, text: Column, models: DataFrame, brands: DataFrame) -> DataFrame:
    """(key, brand, model) by the longest model phrase of at least three letters that one brand and model own.

    Texts that name another brand, or two longest phrases of different models, give none.
    """
    joined = tax.phrase(F.col("alias_norm"))
    one = models.withColumn("_p", joined).filter(F.length("_p") >= 3)
    owned = one.groupBy("_p").agg(
        F.countDistinct("brand", "model").alias("owners"), F.first("brand").alias("brand"), F.first("model").alias("model"), F.min("ord").alias("ord"), F.first("alias_norm").alias("alias_norm")
    ).filter("owners = 1").drop("owners", "_p")
    met = hits(rows, key, text, owned).groupBy(key, "brand", "model").agg(F.max(F.length("norm")).alias("n"))
    top = met.groupBy(key).agg(F.max("n").alias("n"))
    best = met.join(top, [key, "n"]).groupBy(key).agg(F.count(F.lit(1)).alias("m"), F.first("brand").alias("brand"), F.first("model").alias("model"))
    named = hits(rows, key, text, brands).select(F.col(key), F.col("brand").alias("named")).distinct()
    other = best.join(named, key).filter("named <> brand").select(key)
    return best.filter("m = 1").join(other, key, "left_anti").select(key, "brand", "model")


def model_in_brand(rows: DataFrame, key: str, text: Column, brand: str, models: DataFrame) -> DataFrame:
    """(key, model): best alias among the models of the row's brand.

    A phrase scores ten a letter, an alias of four letters or more inside the joined text
    eight a letter; the model's own name scores one more; equal scores go to the first row.
    """
    texts = rows.select(F.col(key), F.col(brand).alias("brand"), tax.words(text).alias("_w"), tax.compact(text).alias("_text"))
    texts = texts.withColumn("_runs", tax.spans(F.col("_w"))).drop("_w")
    names = models.select(
        "brand", "model", "ord", tax.norm(F.col("alias_norm")).alias("norm"), tax.phrase(F.col("alias_norm")).alias("_p"), (tax.norm(F.col("model")) == tax.norm(F.col("alias_norm"))).cast("int").alias("own")
    ).filter("_p is not null")
    both = join_dictionary(texts, names, "brand")
    score = F.when(F.array_contains("_runs", F.col("_p")), F.length("norm") * 10).when((F.length("_p") >= 4) & F.col("_text").contains(F.col("_p")), F.length("_p") * 8)
    scored = both.select(F.col(key), "model", "ord", (score + F.col("own")).alias("score")).filter("score is not null")
    return scored.groupBy(key).agg(F.min_by("model", F.struct(-F.col("score"), "ord")).alias("model"))


def canonical(rows: DataFrame, key: str, brand: str, model: str, brands: DataFrame, models: DataFrame) -> DataFrame:
    """(key, brand, model): dictionary entries of typed names, else their keys."""
    first_brand = brands.withColumn("_b", tax.phrase(F.col("alias_norm"))).groupBy("_b").agg(F.min_by("brand", "ord").alias("entry"))
    first_model = models.withColumn("_m", tax.phrase(F.col("alias_norm"))).groupBy("brand", "_m").agg(F.min_by("model", "ord").alias("name"))
    typed = rows.select(F.col(key), tax.phrase(F.col(brand)).alias("_b"), tax.key(F.col(brand)).alias("kb"), tax.phrase(F.col(model)).alias("_m"), tax.key(F.col(model)).alias("km"))
    with_brand = join_dictionary(typed, first_brand, "_b", "left").withColumnRenamed("entry", "brand")
    with_model = join_dictionary(with_brand, first_model, ["brand", "_m"], "left")
    none = lambda c: F.nullif(c, F.lit(""))
    return with_model.select(key, F.coalesce("brand", none(F.col("kb"))).alias("brand"), F.coalesce("name", none(F.col("km"))).alias("model"))


def alias_index(models: DataFrame) -> DataFrame:
    """(alias, brand, model): every spelling of every alias once, the first row wins; numbers and single letters are left out."""
    spelled = models.select("brand", "model", "ord", F.explode(tax.variants(F.col("alias_norm"))).alias("alias"))
    useful = spelled.filter((F.length("alias") > 1) & ~F.col("alias").rlike("^[0-9 ]+$"))
    return useful.groupBy("alias").agg(F.min_by("brand", "ord").alias("brand"), F.min_by("model", "ord").alias("model"))


def brands_listed(rows: DataFrame, key: str, text: Column, brands: DataFrame) -> DataFrame:
    """(key, brands): every brand that a single word names, in order of first mention, joined by commas."""
    parts = rows.select(F.col(key), F.posexplode(tax.words(text)).alias("pos", "_run"))
    names = brands.withColumn("_run", tax.phrase(F.col("alias_norm"))).groupBy("_run").agg(F.min_by("brand", "ord").alias("brand"))
    firsts = join_dictionary(parts, names, "_run").groupBy(key, "brand").agg(F.min("pos").alias("pos"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "brand")))
    return firsts.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["brand"]), ",").alias("brands"))


def fused(rows: DataFrame, key: str, title: Column, text: Column, address: Column, brands: DataFrame, models: DataFrame) -> DataFrame:
    """(key, brand, model, origin): brand by title, else by text, else by the address; the model within it by title, else by text."""
    segment = F.regexp_extract(F.regexp_replace(address, "^[a-zA-Z]+://[^/]*", ""), "^/([^/?#]+)/", 1)
    left, parts = rows, []
    for name, c in (("title", title), ("text", text), ("address", segment)):  # each way sees only what the ways before left open
        part = stash(brand_of(left, key, c, brands).select(key, "brand", F.lit(name).alias("origin")), "fused-brand")
        left = left.join(part.select(key), key, "left_anti")
        parts.append(part)
    brand = reduce(DataFrame.unionByName, parts)
    found = rows.join(brand.withColumnRenamed("brand", "_brand").drop("origin"), key)
    by_title = stash(model_in_brand(found, key, title, "_brand", models), "fused-model")
    by_text = model_in_brand(found.join(by_title.select(key), key, "left_anti"), key, text, "_brand", models)
    joined = brand.join(by_title.unionByName(by_text), key, "left")
    return joined.select(key, "brand", F.when(F.lower("model") != F.lower("brand"), F.col("model")).alias("model"), "origin")

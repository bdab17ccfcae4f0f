"""All core queries by name, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorloom.operators import quantities
from motorloom.plans import entities, posts, registry, reports, search, texts  # noqa: F401  (they register their queries)
from motorloom.plans.registry import Query, query
from motorloom.sources.tables import table


@query("p3_found")
def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    listings, rates = table(spark, folder, "normalized_documents"), table(spark, folder, "fx_rates")
    return quantities.converted(quantities.common_amounts(listings, rates))


def _both_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Recorded prices and mileages of each source, one row an amount."""
    listings = table(spark, folder, "normalized_documents").filter("source is not null")
    field = lambda name: listings.filter(F.col(name) > 0).select("source", "id", F.lit(name).alias("field_name"), F.col(name).cast("double").alias("amount"))
    return field("price").unionByName(field("mileage")).withColumn("history", F.concat("field_name", F.lit("|"), "source"))


def _split_history(df: DataFrame) -> DataFrame:
    at = F.locate("|", "key")
    fields = [F.substring("key", F.lit(1), at - 1).alias("field_name"), F.substring("key", at + 1, F.length("key")).alias("key")]
    return df.select(*fields, *(c for c in df.columns if c != "key"))


@query("p3_unit_shifts")
def p3_unit_shifts(spark: SparkSession, folder: str) -> DataFrame:
    """Changepoints in each source's recorded prices and mileages, in order of id."""
    return _split_history(quantities.unit_shifts(_both_fields(spark, folder), "history", "id", "amount"))


@query("p3_unit_values")
def p3_unit_values(spark: SparkSession, folder: str) -> DataFrame:
    """The recorded prices and mileages with the matched factors reversed."""
    return _split_history(quantities.reversed_values(_both_fields(spark, folder), "history", "id", "amount"))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Batch search over all vectors: filter, cosine, best per document, top k of every query."""
    return registry.QUERIES["v13_max_per_doc"](spark, folder)


def queries() -> dict[str, Query]:
    return dict(registry.QUERIES)


def oracles() -> dict[str, str]:
    return dict(registry.ORACLES)

"""Queries of the training-data operators, one or more per problem."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motorloom.llm import at_once, leakage, mapping, near_dup, neighbours, packing, pii, subjects
from motorloom.sources.tables import table


def _posts(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "raw_documents")
    return raw.select(F.lit("content").alias("grp"), "id", F.col("content").alias("text"))


def _normalized(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "normalized_documents")
    return rows.select(F.lit("normalized_text").alias("grp"), "id", F.col("normalized_text").alias("text"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    members, links = near_dup.similar_classes(_posts(spark, sf), 3, 0.5, _normalized(spark, sf))
    return near_dup.pairs_of_rows(members, links).withColumnRenamed("grp", "field_name")


def p1_members(spark: SparkSession, sf: str) -> DataFrame:
    """Classes and number of linked classes of the very rows that ``p1_found`` pairs."""
    members, links = near_dup.similar_classes(_posts(spark, sf), 3, 0.5, _normalized(spark, sf))
    return near_dup.class_report(members, links).withColumnRenamed("grp", "field_name")


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    members, links = near_dup.similar_classes(_posts(spark, sf), 5, 0.8)
    return near_dup.class_report(members, links).select("id", "cls", "links")


def _mapped(spark: SparkSession, sf: str) -> DataFrame:
    lists = {
        "brand": (table(spark, sf, "brand_aliases"), "brand", "alias_norm", "ord"),
        "model": (table(spark, sf, "model_aliases"), "model", "alias_norm", "ord"),
        "city": (table(spark, sf, "city_dictionary"), "city", "word", "ord"),
    }
    return mapping.map_values(table(spark, sf, "normalized_documents"), "id", lists)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return mapping.unlike(_mapped(spark, sf))


def p2_misses(spark: SparkSession, sf: str) -> DataFrame:
    """Typed values that reach no entry, with their number of rows."""
    missed = _mapped(spark, sf).filter(F.col("canonical") == mapping.UNMATCHED)
    return missed.groupBy("field_name", "typed").agg(F.count(F.lit(1)).alias("n"))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "vector_points").select(F.col("chunk_id").alias("id"), "vector")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.neighbour_pairs(_points(spark, sf))


def p4_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.neighbour_lists(_points(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return pii.found(pii.tag_posts(table(spark, sf, "raw_documents")))


def p5_clean(spark: SparkSession, sf: str) -> DataFrame:
    """The posts with typed placeholders in place of the finds."""
    return pii.tag_posts(table(spark, sf, "raw_documents")).select("raw_id", "clean_text")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return at_once.dedupe_batches(table(spark, sf, "raw_documents"))


def p7_packed(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_all(table(spark, sf, "documents"), table(spark, sf, "pack_containers"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(p7_packed(spark, sf))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaked(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p8_items(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leak_report(p8_found(spark, sf))


def _subjects(spark: SparkSession, sf: str) -> DataFrame:
    areas = [r.subject for r in table(spark, sf, "subject_areas").select("subject").orderBy("subject").limit(1000).collect()]
    examples = table(spark, sf, "subject_examples").select("text", "subject")
    items = table(spark, sf, "eval_items").select("text", F.lit(subjects.NONE).alias("subject"))
    listings = table(spark, sf, "normalized_documents").filter("sale_intent = 1 and normalized_text is not null")
    sale = listings.select(F.col("normalized_text").alias("text"), F.lit("trade").alias("subject"))
    sale = sale.orderBy(F.xxhash64("text"), "text").limit(1500)  # a bounded labelled sample, the same in any file layout
    return subjects.assign(table(spark, sf, "documents"), examples.unionByName(items).unionByName(sale), areas)


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _subjects(spark, sf).select("doc_id", "subject").distinct()


def p9_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Composition of the corpus by subject."""
    return _subjects(spark, sf).groupBy("subject").agg(F.countDistinct("doc_id").alias("documents"))


QUERIES = {
    "p5_found": p5_found, "p5_clean": p5_clean,
    "p4_found": p4_found, "p4_neighbours": p4_neighbours,
    "p7_packed": p7_packed, "p7_fill": p7_fill,
    "p9_found": p9_found, "p9_mix": p9_mix,
    "p6_found": p6_found, "p8_found": p8_found, "p8_items": p8_items,
    "p1_found": p1_found, "p1_members": p1_members, "p1_classes": p1_classes, "p2_found": p2_found, "p2_misses": p2_misses}
ORACLES: dict[str, str] = {}

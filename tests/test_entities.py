"""Names and entities: aliases of several words, ties, empty and clashing inputs."""

from pyspark.sql import functions as F

from motorloom.functions import extract as ex
from motorloom.functions import taxonomy as tax
from motorloom.operators import entities as en

BRANDS = [("Land Rover", "land rover", 0), ("Land Rover", "ленд-ровер", 1), ("Rover", "rover", 2), ("Alfa Romeo", "alfa romeo", 3)]
MODELS = [("Land Rover", "Range Sport", "range sport", 0), ("Land Rover", "E-200", "e 200", 1), ("Rover", "75", "75", 2), ("Rover", "Sport", "sport", 3), ("Alfa Romeo", "Giulia", "giulia", 4), ("Alfa Romeo", "Giulia", "джулия", 5)]


def frames(spark):
    return spark.createDataFrame(BRANDS, "brand string, alias_norm string, ord int"), spark.createDataFrame(MODELS, "brand string, model string, alias_norm string, ord int")


def texts(spark):
    rows = [(1, "Land-Rover Range_Sport 2015"), (2, "LANDROVER е200, как новый"), (3, "rover 75"), (4, None), (5, ""), (6, "Джулия 2019"), (7, "alfa romeos"), (8, "rover giulia"), (8, "rover giulia")]
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "id bigint, t string, brand_ string, ord int")


def test_phrases_of_two_words_with_any_separator(spark):
    brands, models = frames(spark)
    got = {r.id: (r.brand, r.confidence) for r in en.brand_of(texts(spark), "id", F.col("t"), brands).collect()}
    assert got == {1: ("Land Rover", 1.0), 2: ("Land Rover", 1.0), 3: ("Rover", 1.0), 8: ("Rover", 1.0)}
    rows = texts(spark).join(en.brand_of(texts(spark), "id", F.col("t"), brands).select("id", "brand"), "id")
    assert {r.id: r.model for r in en.model_in_brand(rows, "id", F.col("t"), "brand", models).collect()} == {1: "Range Sport", 2: "E-200", 3: "75"}
    assert en.brand_of(texts(spark), "id", F.col("t"), brands.limit(0)).count() == 0
    assert en.brand_of(texts(spark).limit(0), "id", F.col("t"), brands).count() == 0


def test_brand_from_model_needs_one_owner_and_no_other_brand(spark):
    brands, models = frames(spark)
    got = {r.id: (r.brand, r.model) for r in en.brand_from_model(texts(spark), "id", F.col("t"), models, brands).collect()}
    assert got[6] == ("Alfa Romeo", "Giulia") and 8 not in got and 4 not in got
    shared = models.unionByName(models.filter("ord = 5").selectExpr("'Rover' AS brand", "model", "alias_norm", "9 AS ord"))
    assert 6 not in {r.id for r in en.brand_from_model(texts(spark), "id", F.col("t"), shared, brands).collect()}


def test_fusion_takes_the_title_first(spark):
    brands, models = frames(spark)
    rows = spark.createDataFrame(
        [(1, "rover", "alfa romeo giulia", "http://h/land-rover/x"), (2, "нет", "alfa romeo, giulia", None), (3, None, None, "http://h/land-rover/x"), (4, None, "", "")],
        "id bigint, title string, text string, url string",
    )
    got = {r.id: (r.brand, r.model, r.origin) for r in en.fused(rows, "id", F.col("title"), F.col("text"), F.col("url"), brands, models).collect()}
    assert got == {1: ("Rover", None, "title"), 2: ("Alfa Romeo", "Giulia", "text"), 3: ("Land Rover", None, "address")}


def test_canonical_names_fall_back_to_keys(spark):
    brands, models = frames(spark)
    rows = spark.createDataFrame([(1, "LAND ROVER", "E200"), (2, "No Name", "X 1"), (3, None, None), (4, "", "75")], "id bigint, b string, m string")
    got = {r.id: (r.brand, r.model) for r in en.canonical(rows, "id", "b", "m", brands, models).collect()}
    assert got == {1: ("Land Rover", "E-200"), 2: ("no_name", "x_1"), 3: (None, None), 4: (None, "75")}


def test_listed_brands_keep_their_order(spark):
    brands, _ = frames(spark)
    rows = spark.createDataFrame([(1, "rover или ROVER, а не alfa"), (2, None)], "id bigint, t string")
    assert [tuple(r) for r in en.brands_listed(rows, "id", F.col("t"), brands).collect()] == [(1, "Rover")]


def test_dictionaries_are_read_whole(spark):
    """An entry far down a long dictionary is found too."""
    many = spark.range(120_000).select(F.concat(F.lit("слово"), "id").alias("word"), F.col("id").alias("entry"), F.col("id").alias("ord"))
    rows = spark.createDataFrame([(1, "слово119999 слово3")], "id bigint, t string")
    assert ex.first_entry(rows, "id", F.col("t"), many, "word", ["entry"], False).first().entry == 3
    rows = spark.createDataFrame([(1, "слово119999")], "id bigint, t string")
    assert ex.first_entry(rows, "id", F.col("t"), many, "word", ["entry"], False).first().entry == 119_999


def test_expressions(spark):
    one = lambda text, f: spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]
    assert one("пробег: 6.000 km", ex.mileage_fallback) == 6000 and one("150 тыс", ex.mileage_fallback) == 150_000
    assert one("200 км/ч", ex.mileage_fallback) is None and one("без пробега", ex.mileage_fallback) == 0 and one("без пробега по рф", ex.mileage_fallback) is None
    assert one("Бензин ", ex.fuel_canonical) == "petrol" and one("уголь", ex.fuel_canonical) is None
    assert one("см https://a/b.JPG и c", ex.image_url) == "https://a/b.JPG"
    assert one("Продам E-200 2019 bmw", ex.model_tokens) == ["e-200"]
    assert one("Х5 и 3-С", tax.norm) == "x 5 и 3 c"

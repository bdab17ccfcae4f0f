import pytest
from pyspark.sql import functions as F

from motorloom.functions import extract, gates, text
from motorloom.operators import indexing, lifecycle, ranking


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    "f,value,expected",
    [
        (text.norm_tok, "BMW-X5_2019/дизель", "bmw x 5 2019 дизель"),
        (text.strict_key, "X-5 M", "x5m"),
        (text.thousands, "120.000 км", "120000 км"),
        (text.canonical_url, "HTTPS://Auto.Example.RU/Bmw/x5/?utm_source=a&id=5&ref=z#top", "https://auto.example.ru/Bmw/x5?id=5"),
        (text.canonical_url, "http://a.example/x?from=mail&id=5", "http://a.example/x?from=mail&id=5"),
        (lambda c: text.canonical_url(c, True), "http://a.example/x?from=mail&id=5", "http://a.example/x?id=5"),
        (text.html_text, "<style>p{}</style><p>a<b>b</b></p><script>x</script>", "a b"),
        (text.forum_text, "a [quote=x]\ny[/quote] b\nSent from phone", "a b"),
        (text.squeeze, " a  b\n", "a b"),
        (text.squeeze, None, None),
        (extract.fuel, "электропривод зеркал, бензин", "petrol"),
        (extract.paint, "не бит, крашен", "original"),
    ],
)
def test_text_values(spark, f, value, expected):
    assert one(spark, value, f) == expected


@pytest.mark.parametrize("value,expected", [(9_999, None), (10_000, 10_000), (200_000_000, 200_000_000), (200_000_001, None), (None, None)])
def test_price_clamp(spark, value, expected):
    assert one(spark, value, lambda c: gates.clamp(c, 10_000, 200_000_000), "bigint") == expected


def test_meta_header(spark):
    assert one(spark, "_meta_: a=1; b=2\nrest", text.meta_map) == {"a": "1", "b": "2"}


def test_point_id(spark):
    got = spark.range(1).select(indexing.point_id(F.lit(1), F.lit("title")).alias("p")).first()["p"]
    assert int(got) == 10037877070131712752


def test_chunks_keep_all_words_and_the_limit(spark):
    long = " ".join(f"Слово{i} идёт дальше." for i in range(400)) + " " + "х" * 3000
    parts = one(spark, long, indexing.chunks)
    assert max(map(len, parts)) <= 1200 and len(parts) > 5
    assert all(f"Слово{i} " in " ".join(parts) for i in range(400)) and " ".join(parts).count("х" * 900) >= 3
    assert one(spark, None, indexing.chunks) is None and one(spark, "", indexing.chunks) == []


@pytest.mark.parametrize("price,most,expected", [(2_400_000, 3_000_000, 0.2), (3_100_000, 3_000_000, 0.05), (None, None, 0.15)])
def test_price_fit(spark, price, most, expected):
    got = spark.createDataFrame([(price, most)], "p int, m int").select(ranking.price_fit(F.col("p"), F.col("m")).alias("v")).first()["v"]
    assert abs(got - expected) < 1e-9


def test_ordered_dedup_is_sequential(spark):
    rows = [(1, 1, "a", "f"), (1, 2, "b", "f"), (1, 3, "b", "g"), (1, 4, None, None)]
    df = spark.createDataFrame(rows, "query_id int, rank int, page string, print string")
    assert sorted(r["rank"] for r in ranking.ordered_dedup(df, ["page", "print"]).collect()) == [1, 3, 4]


def test_new_items_bootstrap_and_marker(spark):
    rows = spark.createDataFrame([("u", 1, 3), ("u", 2, 2), ("u", 3, 1), ("w", 9, 1)], "k string, item bigint, at int")
    seen = lambda m: sorted(r["item"] for r in lifecycle.new_items(rows, spark.createDataFrame([("u", m)], "k string, marker bigint"), "k", "item", [F.desc("at")], 20).collect())
    assert seen(3) == [1, 2] and seen(1) == [] and seen(77) == [1, 2, 3] and seen(None) == []


def test_budget_matches_running_sum(spark):
    rows = [(i, i % 4) for i in range(5000)]
    got = lifecycle.within_budget(spark.createDataFrame(rows, "id bigint, c int"), "id", "c", 3000, block=100)
    run, expected = 0, []
    for i, c in rows:
        run += c
        if run <= 3000:
            expected.append(i)
    assert sorted(r["id"] for r in got.collect()) == expected

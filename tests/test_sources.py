from pyspark.sql import functions as F

from motorloom.functions import extract
from motorloom.sources import posts


def test_channel_names_fall_back_only_if_none_is_stored(spark):
    stored = spark.createDataFrame([("https://t.me/a", True), ("@b", True), ("c", False)], "username string, is_active boolean")
    names = lambda df: sorted(r.channel for r in posts.channel_names(df, "t.me/x, @y,").collect())
    assert names(stored) == ["@a", "@b"] and names(stored.filter("username = 'c'")) == ["@x", "@y"]


def test_channel_posts(spark):
    rows = [(1, "c", "Продам машину, цена 5\nвторая строка"), (2, "c", "Продам машину, цена 5\nвторая строка"), (3, "c", "коротко"),
            (4, "c", "http " * 6 + "много ссылок"), (5, "c", "Розыгрыш призов каждый день"), (6, "d", None)]
    out = posts.channel_posts(spark.createDataFrame(rows, "id bigint, ch string, t string"), "ch", "t", "id").collect()
    assert [(r.id, r.title) for r in out] == [(1, "Продам машину, цена 5")]


def test_links(spark):
    html = '<a href="/f/threads/bmw.12/">x</a><a href="/f/threads/bmw.12/">x</a><a href="https://s.example/a/b/c/1.html">y</a><a href="https://s.example/login/a/b/2.html">z</a>'
    row = spark.createDataFrame([(html,)], "h string").select(posts.thread_links(F.col("h")).alias("t"), posts.card_links(F.col("h")).alias("c")).first()
    assert row.t == ["/f/threads/bmw.12"] and row.c == ["https://s.example/a/b/c/1.html"]


def test_sample_posts_read_back(spark):
    out = posts.sample_posts(spark, 3).select(extract.mileage(F.col("content")).alias("m"), extract.price(F.col("content")).alias("p")).collect()
    assert [r.m for r in out] == [40_000, 41_000, 42_000] and {r.p for r in out} == {2_500_000}

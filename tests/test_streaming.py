from pyspark.sql import functions as F

from motorloom.streaming import standing as st

SCHEMA = "id bigint, brand string, price int, at timestamp"


def _write(spark, folder, rows):
    df = spark.createDataFrame(rows, "id bigint, brand string, price int, at string").withColumn("at", F.to_timestamp("at"))
    df.coalesce(1).write.mode("append").parquet(folder)


def test_ttl_dedup_stream_survives_restart(spark, tmp_path):
    folder, out, mark = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    keep = lambda df, _: df.select("id").write.mode("append").parquet(out)
    run = lambda: st.run_available(st.fresh_only(st.read_posts(spark, folder, SCHEMA), "at", ["brand", "price"]), keep, mark)
    _write(spark, folder, [(1, "a", 5, "2024-01-01 00:00:00"), (2, "a", 6, "2024-01-01 01:00:00"), (3, None, None, "2024-01-01 02:00:00")])
    run()
    _write(spark, folder, [(4, "a", 5, "2024-01-02 00:00:00"), (5, "a", 7, "2024-01-20 00:00:00")])
    run()
    _write(spark, folder, [(6, "a", 5, "2024-01-21 00:00:00")])
    run()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 5, 6]


def test_daily_counts_equal_batch(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    _write(spark, folder, [(i, "a", i, f"2024-01-0{1 + i % 3} 00:00:00") for i in range(12)])
    st.run_available(st.read_posts(spark, folder, SCHEMA), lambda df, _: df.write.mode("append").parquet(out), str(tmp_path / "cp"))
    batch = spark.read.parquet(out).groupBy(F.window("at", "1 day")).count().collect()
    assert sorted(r["count"] for r in batch) == [4, 4, 4]
    assert [f.name for f in st.daily_counts(spark.read.parquet(folder), "at").schema] == ["day", "n"]

"""Queries that answer for whole tables, on tables made here."""

import datetime

import numpy as np

import __spark_entry__ as entry


def test_every_hundredth_vector_is_asked(spark, tmp_path):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(701, 8)).astype("float32")
    v[300] = 0  # no length: no similarity
    rows = [(i, [float(x) for x in v[i]], i % 3) for i in range(701)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in entry.queries()["v11_topk"](spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, {})[r.point_id] = r.sim
    assert sorted(got) == list(range(0, 701, 100))
    unit = v.astype("float64") / np.maximum(np.linalg.norm(v.astype("float64"), axis=1, keepdims=True), 1e-300)
    for q in set(got) - {300}:
        same = [i for i in range(701) if i % 3 == q % 3 and i != 300]
        best = sorted(same, key=lambda i: (-round(float(unit[i] @ unit[q]), 6), i))[:10]
        assert sorted(got[q]) == sorted(best)
    assert {r.query_id for r in entry.queries()["v13_max_per_doc"](spark, str(tmp_path)).select("query_id").collect()} == set(got)


def test_blocks_do_not_change_the_hits(spark):
    from motorloom.operators import ranking as rk

    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)], i % 2) for i in range(120)]
    p = spark.createDataFrame(rows, "point_id bigint, vector array<float>, label int")
    q = p.filter("point_id % 10 = 0").selectExpr("point_id query_id", "vector query_vector", "label")
    look = lambda df: sorted(map(tuple, df.select("query_id", "point_id", "sim").filter("sim is not null").collect()))
    whole = look(rk.top_k(q, p, 5, ["label"]))
    assert whole and look(rk.top_k_blocks(q, p, 5, "label", query_block=5, point_block=30)) == whole


def test_every_order_is_held_or_new(spark, tmp_path):
    day = lambda year: datetime.datetime(year, 5, 1)
    rows = [(2, 1, day(1999)), (5, 1, day(1999)), (8, 2, None), (11, 3, day(1995)), (12, 3, day(1999)), (14, None, day(1999))]
    spark.createDataFrame(rows, "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    got = [r.id for r in entry.queries()["m06_insert_absent"](spark, str(tmp_path)).collect()]
    assert sorted(got) == [2, 8, 14]


def _whole_optimum(v, penalty):
    n, s1, s2 = len(v), np.append(0, np.cumsum(v)), np.append(0, np.cumsum(v * v))
    best, last = np.full(n + 1, -penalty), np.zeros(n + 1, int)
    for t in range(1, n + 1):
        a = np.arange(t)
        cost = best[:t] + s2[t] - s2[:t] - (s1[t] - s1[:t]) ** 2 / (t - a)
        last[t] = int(cost.argmin())
        best[t] = cost[last[t]] + penalty
    cuts, t = [], n
    while t:
        cuts.append((int(last[t]), t))
        t = int(last[t])
    return cuts[::-1]


def test_segments_are_the_optimum_of_whole_histories():
    from motorloom.operators.quantities import Segmenter, best_segments

    rng = np.random.default_rng(3)
    for spread in (0.0, 0.3, 3.0):
        for n in (1, 2, 400, 1500):
            v = rng.normal(size=n) + np.repeat(rng.normal(0, 1, n // 100 + 1), 100)[:n] + spread * (rng.random(n) < 0.1) * rng.normal(size=n)
            work, got = Segmenter(12.0), []
            for k in range(0, n, 37):
                work.push(v[k : k + 37])
                got += work.settled()
            assert got + work.rest() == best_segments(v, 12.0) == _whole_optimum(v, 12.0)


def test_history_is_not_cut_at_block_edges(spark):
    from motorloom.operators import quantities as q

    rng = np.random.default_rng(4)
    ids = range(0, 60_000, 100)  # a sparse source: 600 rows over 29 former blocks
    rows = [("a", i, float(np.exp(11 + 0.1 * rng.normal() + (0.4758 if i >= 30_000 else 0)))) for i in ids]
    df = spark.createDataFrame(rows, "k string, i bigint, v double")
    for block in (50, 2048):
        got = [(r.first_at, r.n, r.factor) for r in q.unit_shifts(df, "k", "i", "v", block=block).collect()]
        assert got == [(0, 300, None), (30_000, 300, "mile")]
    values = q.reversed_values(df, "k", "i", "v").collect()
    assert len(values) == 600 and all(abs(r.common_value - r.recorded / (1.609344 if r.at >= 30_000 else 1)) < 1e-6 * r.recorded for r in values)


def test_both_fields_of_each_source_are_segmented(spark, tmp_path):
    rows = [(i, "s", 100_000 if i < 30 else 100, 5_000 if i < 40 else 5) for i in range(60)]
    spark.createDataFrame(rows, "id bigint, source string, price int, mileage int").write.parquet(f"{tmp_path}/normalized_documents.parquet")
    shifts = entry.queries()["p3_unit_shifts"](spark, str(tmp_path)).filter("factor is not null").collect()
    assert sorted((r.field_name, r.key, r.first_at, r.factor) for r in shifts) == [("mileage", "s", 40, "1/thousand"), ("price", "s", 30, "1/thousand")]
    values = entry.queries()["p3_unit_values"](spark, str(tmp_path)).collect()
    assert {(r.field_name, round(r.common_value)) for r in values} == {("price", 100_000), ("mileage", 5_000)} and len(values) == 120


def test_parsed_query_has_every_part(spark, tmp_path):
    make = lambda name, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    make("search_events", [(1, "Келарион h6 бензин от 2015 до 109 тыс км до 2 млн Ольховск"), (2, "h6"), (3, None)], "id bigint, raw_query string")
    make("brand_aliases", [("Kelarion", "келарион", 0)], "brand string, alias_norm string, ord int")
    make("model_aliases", [("Other", "X6", "h6", 0), ("Kelarion", "H6", "h6", 1)], "brand string, model string, alias_norm string, ord int")
    make("city_dictionary", [("ольховск", "Ольховск", "Край", 0)], "word string, city string, region string, ord int")
    got = {r.id: r for r in entry.queries()["r01_parse_full"](spark, str(tmp_path)).collect()}
    a = got[1]
    assert (a.brand, a.model, a.fuel, a.price_max, a.year_min, a.mileage_max, a.city, a.region) == ("Kelarion", "H6", "petrol", 2_000_000, 2015, 109_000, "Ольховск", "Край")
    assert "h6" in a.words and (got[2].brand, got[2].model) == ("Other", "X6") and len(got) == 3 and got[3].model is None

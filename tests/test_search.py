"""Rankings against their SQL twins on tables made here: bounds of zero, queries asked twice, missing values."""

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry
from motorloom.operators import ranking as rk
from motorloom.plans import search
from tests.test_catalog import norm

NAMES = [f"r{k}" for k in ("05", "06", "07", "13", "15", "16", "19", "20", "21", "22", "24", "26", "27", "28", "29")]
ASKED = [
    (100, "Kelarion пробег до 0 тыс", "Kelarion", None), (200, "Kelarion h6 бензин до 100 тыс", "Kelarion", "H6"), (300, "Kelarion h6 бензин до 100 тыс", "Kelarion", "H6"),
    (400, "kelarion h6 h6 пробег до 90 тыс", "KELARION", "Lark Sun"), (500, "ormavit дизель", "Ormavit", "Sun"), (600, "!", "Ormavit", None), (700, "без марки", None, None), (701, "kelarion", "Kelarion", None),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("search"))
    brands, models, fuels = ("Kelarion", "kelarion", "Ormavit", "Other"), ("H6", "h-6", "Lark Sun", "sun", "Lark"), ("petrol", "diesel", None)
    rows = []
    for i in range(240):
        text = None if i % 17 == 0 else f"Продам {brands[i % 4]} {models[i % 5]} бензин пробег {i} тыс до 100"
        address = None if i % 13 == 0 else f"https://www.drom.ru/{i % 60}/?utm_x={i}" if i % 2 else f"https://site.ru/{i % 50}"
        rows.append((i, f"{brands[i % 4]} {i % 7}", text, brands[i % 4], models[i % 5], fuels[i % 3], 2000 + i % 25 if i % 6 else None, i % 70 * 1000, (None, 0, 5000, 95_000)[i % 4 if i % 8 < 4 else (i // 8) % 4], ("telegram", "forum", "x", "y")[i // 4 % 4], address, i % 3, 1704000000 - i * 40_000))
    schema = "id bigint, title string, normalized_text string, brand string, model string, fuel string, year int, price int, mileage int, source string, source_url string, sale_intent int, created_at_ts bigint"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/normalized_documents.parquet")
    wish = lambda b, m: "{" + ", ".join(f'"{k}": "{v}"' for k, v in (("brand", b), ("model", m)) if v) + "}"
    events = [(i, q, wish(b, m)) for i, q, b, m in ASKED]
    spark.createDataFrame(events + events[:2], "id bigint, raw_query string, structured_query string").coalesce(1).write.parquet(f"{d}/search_events.parquet")
    return d


@pytest.mark.parametrize("name", sorted(n for n in entry.oracle_sql() if n[:3] in NAMES))
def test_ranking_equals_sql(spark, folder, name):
    c = duckdb.connect()
    for t in ("normalized_documents", "search_events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = entry.queries()[name](spark, folder)
    mine = sorted(repr([norm(r[k]) for k in sorted(df.columns)]) for r in df.collect())
    rel = c.sql(entry.oracle_sql()[name])
    cols = list(rel.columns)
    assert mine and mine == sorted(repr([norm(r[cols.index(k)]) for k in sorted(cols)]) for r in rel.fetchall())


def test_four_keys_walk_every_query(spark, folder):
    got = sorted(map(tuple, entry.queries()["r18_four_keys"](spark, folder).collect()))
    ranked = search._scored(spark, folder).select("query_id", "id", "score").collect()
    held = {r.id: r for r in spark.read.parquet(f"{folder}/normalized_documents.parquet").select("*", rk.canonical_url(search.F.col("source_url")).alias("page"), rk.fingerprint(search.F.col("source_url"), search.F.col("brand"), search.F.col("model"), "year", "price", "mileage").alias("print")).collect()}
    heads = {}
    for r in ranked:
        heads.setdefault(r.query_id, []).append((-r.score, r.id))
    want = []
    for ids, head in (((100,), 100), ((200, 300), 200), ((400,), 400), ((500,), 500), ((600,), 600)):
        seen = set()
        for place, (_, i) in enumerate(sorted(heads[head]), 1):
            r = held[i]
            keys = {("listing", r.source_url or f"{r.title}_{r.price}"), ("document", i), ("print", r.print)} | ({("page", r.page)} if r.page is not None else set())
            if not keys & seen:
                seen |= keys
                want += [(q, i, place) for q in ids]
    assert got == sorted(want)


def test_queries_alike_are_met_once(spark, folder):
    heads = search._heads(spark, folder).select("query_id").collect()
    assert sorted(r.query_id for r in heads) == [100, 200, 400, 500, 600]


def test_mentions_equal_looking_pair_by_pair():
    rows = pa.table({"id": [1, 2, 3], "text": ["kelarion h 6 чистый", "ormavit", ""], "content": ["h6 чистый чистый", None, ""]})
    asked = pa.table({
        "at": pa.array([1, 0], pa.int32()), "n_brand": ["ormavit", "kelarion"], "n_model": [None, "h6"],
        "n_words": [["", "ormavit"], ["h 6", "h 6", "чистый"]], "words": [["-", "ormavit"], ["h6", "h6", "чистый"]],
    })
    got = rk.mentions(rows, asked)
    assert got.column_names == ["id", "said", "named", "held"]
    assert got.column("said").to_pylist() == [[3.0, 0.0], [0.0, 1.5], [0.0, 0.0]]
    assert got.column("named").to_pylist() == [[3, 0], [0, 1], [0, 0]] and got.column("held").to_pylist() == [[2, 0], [0, 0], [0, 0]]


def test_signals_round_halves_as_sql(spark):
    fit = 1.0 - 18239 / 104000.0  # 0.824625, of which Spark's own rounding makes 0.82462
    got = spark.createDataFrame([(fit,)], "v double").select(search._four(search.F.col("v"), 5), search._four(search.F.col("v"))).first()
    assert tuple(got) == duckdb.sql(f"SELECT round({fit!r}::DOUBLE, 5), round({fit!r}::DOUBLE, 4)").fetchall()[0] == (0.82463, 0.8246)


def test_match_sums_equal_the_pairs(spark, folder):
    rows = pa.table({"text": ["kelarion h 6 чистый", "ormavit", ""], "fuel": ["petrol", None, "diesel"]})
    asked = pa.table({
        "query_id": [7, 9], "w_fuel": [None, "petrol"], "n_brand": ["ormavit", "kelarion"], "n_model": [None, "h6"],
        "n_words": [["", "ormavit"], ["h 6", "h 6", "чистый"]],
    })
    got = rk.match_sums(rows, asked).to_pydict()
    assert got["query_id"] == [7, 9] and got["hits"] == [3, 3]
    assert got["text_match"] == [pytest.approx(1.65 / 3), pytest.approx(1.0)]
    none = rk.match_sums(rows.slice(0, 0), asked).to_pydict()
    assert none["text_match"] == [0.0, 0.0] and none["hits"] == [0, 0]


def test_averages_meet_no_pairs_outside_of_their_groups(spark, folder):
    plan = entry.queries()["r16_signal_averages"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "held" not in plan and "said" not in plan

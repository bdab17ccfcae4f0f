from decimal import Decimal
from itertools import product

import numpy as np
import pytest

from motorloom.operators import quantities as q


@pytest.mark.parametrize(
    "text,amount,code",
    [
        ("цена 0,76 млн. рублей!", 760_000, "RUB"),
        ("отдам за 1 245тр, торг", 1_245_000, "RUB"),
        ("продаю за 4,3 тысяч евро", 4_300, "EUR"),
        ("asking 2,020,000 тенге!", 2_020_000, "KZT"),
        ("стоимость €7 800", 7_800, "EUR"),
        ("ценник 12.400 белорусских рублей", 12_400, "BYN"),
        ("хочу 2 090 000", 2_090_000, None),
        ("вложено 463 тысяч рублей. резина за 66 000 руб", None, None),
    ],
)
def test_stated_price(text, amount, code):
    got = q.stated_price(text)
    assert (got is None) if amount is None else got == (Decimal(amount), code)


@pytest.mark.parametrize(
    "text,km",
    [
        ("пробег: 33'000 км.", "33000"),
        ("на одометре 62,2 т. миль", "100101.1968"),
        ("прошла 1.000 километров", "1000"),
        ("новая, без пробега", "0"),
        ("масло меняю каждые 3 500 км", None),
        ("odometer 126.5 thousand mi.", "203582.016"),
    ],
)
def test_stated_mileage(text, km):
    got = q.stated_mileage(text)
    assert got == (None if km is None else Decimal(km))


def test_common_amounts_edge_cases(spark):
    rows = [
        (1, None, 500, 10, "тыс. руб", 1704067200, 9),
        (2, "", None, None, None, 1704067200, 9),
        (3, "цена 100 usd. пробег 10 миль", None, 10, "RUB", 1704067200, 9),
        (3, "цена 100 usd. пробег 10 миль", None, 10, "RUB", 1704067200, 9),
        (4, "цена 5 млн", 5_000_000, None, None, None, 9),
        (5, "x" * 50_000, 7, 7, "KZT", 1704067200, 9),
    ]
    schema = "id bigint, normalized_text string, price int, mileage int, currency string, created_at_ts bigint, common_value int"
    rates = spark.createDataFrame([("USD", "2024-01", Decimal("85.37"))], "currency string, rate_month string, rub_per_unit decimal(12,2)")
    out = q.converted(q.common_amounts(spark.createDataFrame(rows, schema), rates))
    assert sorted(map(tuple, out.collect())) == [(1, "price", 500_000), (3, "mileage", 16), (3, "price", 8537)]
    assert q.converted(q.common_amounts(spark.createDataFrame([], schema), rates)).count() == 0


def _brute(values, penalty):
    n = len(values)
    best = None
    for marks in product((0, 1), repeat=n - 1):
        cuts = [0, *(i + 1 for i, m in enumerate(marks) if m), n]
        cost = sum(((values[a:b] - values[a:b].mean()) ** 2).sum() for a, b in zip(cuts, cuts[1:])) + penalty * (len(cuts) - 1)
        if best is None or cost < best[0] - 1e-9:
            best = (cost, list(zip(cuts, cuts[1:])))
    return best[1]


def test_best_segments_equals_brute_force():
    rng = np.random.default_rng(0)
    for _ in range(20):
        v = rng.normal(size=9) + np.repeat(rng.normal(0, 4, 3), 3)
        assert q.best_segments(v, 3.0) == _brute(v, 3.0)


def test_unit_shift_is_named(spark):
    rows = [("a", i, float(200_000 if i < 50 else 200)) for i in range(100)] + [("b", 1, None), (None, 2, 3.0), ("c", 5, 0.0)]
    out = q.unit_shifts(spark.createDataFrame(rows, "k string, i bigint, v double").filter("v > 0 or v is null"), "k", "i", "v")
    got = [(r.key, r.first_at, r.factor) for r in out.collect()]
    assert got == [("a", 0, None), ("a", 50, "1/thousand")]

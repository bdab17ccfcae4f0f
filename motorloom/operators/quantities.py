"""Quantities recorded in different units.

``common_amounts`` converts the asking price and the mileage of each listing to
whole roubles and kilometres; ``unit_shifts`` finds, per source, the places where a
whole recording changes its unit, by exact penalised changepoint search.

In this data units vary from row to row inside every source (each post names its
own), so a level shift of a source cannot tell the unit of a row. The amounts
therefore come from the statement in the text, then the currency column; the
changepoint search serves recordings without any text, and is reported apart.

Defined results: null or empty texts leave the column and its currency as the only
evidence; a row without any evidence gives no amount; repeated rows give repeated
results; empty tables give empty results; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorloom.plans.runtime import bounded_rows

MILE_KM = Decimal("1.609344")
_GAP = "    "
NUMBER = rf"\d{{1,3}}(?:[{_GAP}.,'’]\d{{3}})+(?!\d)|\d+(?:[.,]\d+)?"
#: Words of each currency as people type them; the longer ones come first.
CURRENCY_WORDS = {
    "BYN": r"byn|br\b|бел(?:орусск\w+|\.)?\s*руб\w*",
    "USD": r"us\$|usd|\$|долл\w*|бакс\w*",
    "EUR": r"eur\w*|€|евро",
    "CNY": r"cny|rmb|юан\w*|¥",
    "JPY": r"jpy|[ий]ен\w?\b",
    "KRW": r"krw|₩|вон\w?\b",
    "KZT": r"kzt|₸|тенге|тг\b",
    "AED": r"aed|дирхам\w*",
    "GEL": r"gel|₾|лари",
    "RUB": r"rub\w*|rur|₽|руб\w*|р\b",
}
MILLION = r"млн\.?|миллион\w*|million|m(?![a-zа-я])|лям\w*"
THOUSAND = r"тысяч\w*|тыс\.?|thousand|т\.?\s?(?=р)|т\.?(?![а-яё])|[kк](?![a-zа-яё])|[kк](?=р\b|руб)"
PRICE_WORDS = r"цен(?:а|ник)|стоимость|прошу|(?:отдам|продаю)\s+за|хочу"
PRICE_WORDS_EN = r"asking(?:\s+price)?|price|yours\s+for"
MILEAGE_WORDS = r"пробег|накатал[аи]?|на\s+одометре|прошла"
MILEAGE_WORDS_EN = r"mileage|odometer|driven"
#: Latin letters that stand in for Cyrillic ones in typed words.
LOOK_ALIKES = str.maketrans("aceopxykmtbh", "асеорхукмтвн")

_CURRENCY = re.compile("|".join(f"(?P<{k}>{v})" for k, v in CURRENCY_WORDS.items()))
_BEFORE = r"(?P<lead>us\$|[$€₽₩₸₾¥])?\s?"
_AMOUNT = re.compile(rf"{_BEFORE}(?P<num>{NUMBER})\s?(?:(?P<mln>{MILLION})|(?P<tys>{THOUSAND}))?\s?(?P<rest>.{{0,24}})")
_DISTANCE = re.compile(rf"(?P<num>{NUMBER})\s?(?P<tys>тысяч\w*|тыс\.?|thousand|т\.?(?=\s?[кk]м|[кk]m)|т\.?(?![а-яё])|[kк](?![a-zа-яё])|[kк](?=км|km))?\s?(?P<unit>миль|мили|mile\w*|mi\b)?")
_PRICE_RU = re.compile(rf"(?<!\w)(?:{PRICE_WORDS})[:\s]+(?=[$€₽₩₸₾¥\d]|us\$)")
_PRICE_EN = re.compile(rf"(?<!\w)(?:{PRICE_WORDS_EN})[:\s]+(?=[$€₽₩₸₾¥\d]|us\$)")
_MILE_RU = re.compile(rf"(?<!\w)(?:{MILEAGE_WORDS})[:\s]+(?=\d)")
_MILE_EN = re.compile(rf"(?<!\w)(?:{MILEAGE_WORDS_EN})[:\s]+(?=\d)")
_UNUSED = re.compile(r"(?<!\w)без\s+пробега(?!\s+по)|(?<!\w)(?:no|zero)\s+mileage|delivery\s+mileage")


def read_number(typed: str, scaled: bool) -> Decimal:
    """The number as typed; one group of three behind a mark is a fraction only before "million"."""
    plain = re.sub(rf"[{_GAP}'’]", "", typed)
    if re.fullmatch(r"\d{1,3}(?:[.,]\d{3})+", plain) and not (scaled and len(re.findall("[.,]", plain)) == 1):
        return Decimal(re.sub("[.,]", "", plain))
    if len(re.findall("[.,]", plain)) > 1:
        return Decimal(re.sub("[.,]", "", plain))
    return Decimal(plain.replace(",", "."))


def currency_code(typed: str | None) -> str | None:
    """ISO code of a typed currency; None if it names none."""
    found = _CURRENCY.search(typed.lower()) if typed else None
    return found.lastgroup if found else None


def currency_scale(typed: str | None) -> int:
    """1000 where the currency itself is typed as thousands of it."""
    return 1000 if typed and re.match(r"\s*(тыс|т\.?\s?р)", typed.lower()) else 1


def _start(text: str, folded: str, russian: re.Pattern, english: re.Pattern) -> int | None:
    a, b = russian.search(folded), english.search(text)
    ends = [m for m in (a, b) if m]
    return min(ends, key=lambda m: m.start()).end() if ends else None


def stated_price(text: str) -> tuple[Decimal, str | None] | None:
    """Asking price in the text and its currency, if named."""
    at = _start(text, text.translate(LOOK_ALIKES), _PRICE_RU, _PRICE_EN)
    found = at is not None and _AMOUNT.match(text, at)
    if not found:
        return None
    value = read_number(found["num"], bool(found["mln"]))
    value *= 1_000_000 if found["mln"] else 1_000 if found["tys"] else 1
    if found["lead"]:
        return value, currency_code(found["lead"])
    named = _CURRENCY.match(found["rest"])
    return value, named.lastgroup if named else None


def stated_mileage(text: str) -> Decimal | None:
    """Mileage in the text, in kilometres."""
    at = _start(text, text.translate(LOOK_ALIKES), _MILE_RU, _MILE_EN)
    found = at is not None and _DISTANCE.match(text, at)
    if not found:
        return Decimal(0) if _UNUSED.search(text) else None
    value = read_number(found["num"], False) * (1_000 if found["tys"] else 1)
    return value * MILE_KM if found["unit"] else value


def _whole(value: Decimal) -> int:
    return int(value.quantize(Decimal(1), ROUND_HALF_UP))


def common_amounts(listings: DataFrame, rates: DataFrame, most_rates: int = 100_000) -> DataFrame:
    """(id, field_name, recorded, common_value) for every row and field with an amount."""
    table = {
        (r.currency, r.rate_month): Decimal(r.rub_per_unit)
        for r in bounded_rows(rates.select("currency", "rate_month", "rub_per_unit"), most_rates, "rates")
        if r.currency and r.rate_month and r.rub_per_unit is not None
    }
    held = listings.sparkSession.sparkContext.broadcast(table)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rate = held.value
        for batch in batches:
            out = []
            for id_, text, price, mileage, currency, month in batch.itertuples(index=False):
                text = text or ""
                recorded = None if pd.isna(price) else int(price)
                stated = stated_price(text)
                if stated or recorded is not None:
                    value, named = stated or (Decimal(recorded) * currency_scale(currency), None)
                    code = named or currency_code(currency) or "RUB"
                    factor = Decimal(1) if code == "RUB" else rate.get((code, month))
                    if factor is not None:
                        out.append((id_, "price", recorded, _whole(value * factor)))
                recorded = None if pd.isna(mileage) else int(mileage)
                value = stated_mileage(text)
                if value is not None or recorded is not None:
                    out.append((id_, "mileage", recorded, _whole(value) if value is not None else recorded))
            frame = pd.DataFrame(out, columns=["id", "field_name", "recorded", "common_value"])
            yield frame.astype({"id": "int64", "recorded": "Int64", "common_value": "int64"})

    narrow = listings.select(
        F.col("id").cast("bigint"),
        F.lower("normalized_text").alias("text"),
        F.col("price").cast("bigint"),
        F.col("mileage").cast("bigint"),
        F.col("currency").cast("string"),
        F.date_format(F.timestamp_seconds("created_at_ts"), "yyyy-MM").alias("month"),
    )
    return narrow.mapInPandas(work, "id bigint, field_name string, recorded bigint, common_value bigint")


def converted(amounts: DataFrame) -> DataFrame:
    """Rows whose amount differs from what the column records."""
    changed = amounts.filter(~F.col("recorded").eqNullSafe(F.col("common_value")))
    return changed.select("id", "field_name", "common_value").distinct()


class Segmenter:
    """Exact optimum of squared error plus ``penalty`` per segment over values that arrive piece by piece.

    A start stays alive only for the levels at which it can still win (functional
    pruning); each keeps up to two intervals that contain these levels. ``settled``
    gives the segments that every live start has in common, so a long history needs
    memory only for its open end.
    """

    def __init__(self, penalty: float) -> None:
        self.penalty, self.t, self.s1, self.s2 = penalty, 0, 0.0, 0.0
        self.done = 0
        self.last: list[int] = [0]  # best start of the segment that ends at done + k
        self.start = np.zeros(1, np.int64)
        self.base, self.at1, self.at2 = np.array([-penalty]), np.zeros(1), np.zeros(1)
        self.low, self.high = np.array([-np.inf]), np.array([np.inf])

    def push(self, values: np.ndarray) -> None:
        for v in values.tolist():
            self.t += 1
            self.s1 += v
            self.s2 += v * v
            n, s1 = self.t - self.start, self.s1 - self.at1
            mean = s1 / n
            cost = self.base + np.maximum(self.s2 - self.at2 - s1 * mean, 0.0)
            k = int(cost.argmin())
            best = cost[k] + self.penalty
            self.last.append(int(self.start[k]))
            reach = np.sqrt(np.maximum(best - cost + 1e-9 * (1.0 + abs(best)), 0.0) / n)
            # The levels at which the best start beats a new one for good.
            inner = np.sqrt(max(self.penalty - 1e-9 * (1.0 + abs(best)), 0.0) / n[k])
            left, right = mean[k] - inner, mean[k] + inner
            low, high = np.maximum(self.low, mean - reach), np.minimum(self.high, mean + reach)
            keep = (low <= high) & (cost <= best + 1e-9 * (1.0 + abs(best)))
            t = self.t
            self.start = np.concatenate((self.start[keep], (t, t)))
            self.base = np.concatenate((self.base[keep], (best, best)))
            self.at1 = np.concatenate((self.at1[keep], (self.s1, self.s1)))
            self.at2 = np.concatenate((self.at2[keep], (self.s2, self.s2)))
            self.low = np.concatenate((low[keep], (-np.inf, right)))
            self.high = np.concatenate((high[keep], (left, np.inf)))

    def _path(self, end: int) -> list[int]:
        out = []
        while end > self.done:
            out.append(end)
            end = self.last[end - self.done]
        return out[::-1]

    def _take(self, ends: list[int]) -> list[tuple[int, int]]:
        out = list(zip([self.done, *ends], ends))
        if ends:
            self.last = self.last[ends[-1] - self.done :]
            self.done = ends[-1]
        return out

    def settled(self) -> list[tuple[int, int]]:
        """Segments that no later value can change; each is given once."""
        common = None
        for end in {int(x) for x in self.start}:
            path = self._path(end)
            if common is None:
                common = path
            else:
                k = 0
                while k < min(len(common), len(path)) and common[k] == path[k]:
                    k += 1
                common = common[:k]
            if not common:
                break
        return self._take(common or [])

    def rest(self) -> list[tuple[int, int]]:
        """Segments up to the last value, if no more come."""
        return self._take(self._path(self.t))


def best_segments(values: np.ndarray, penalty: float) -> list[tuple[int, int]]:
    """Exact optimum of squared error plus ``penalty`` per segment."""
    work = Segmenter(penalty)
    work.push(values)
    return work.rest()


KNOWN_FACTORS = {"thousand": 1000.0, "million": 1_000_000.0, "mile": 1.609344, "cent": 100.0}

def _factor(shift: float, tolerance: float) -> tuple[str | None, float]:
    """Name of the unit factor of a shift of the log level, and its log."""
    found = (None, 0.0)
    for name, size in KNOWN_FACTORS.items():
        log = float(np.log(size))
        for sign, label in ((1.0, name), (-1.0, f"1/{name}")):
            if abs(shift - sign * log) <= tolerance * min(1.0, log):
                found = (label, sign * log)
    return found


SEGMENTS = "key string, first_at bigint, last_at bigint, n bigint, level double, shift double, factor string"
REVERSED = "key string, at bigint, recorded double, factor double, common_value double"


def _histories(rows: DataFrame, key: str, order: str, value: str, penalty: float, tolerance: float, block: int, each_row: bool) -> DataFrame:
    logs = rows.select(
        F.col(key).cast("string").alias("key"), F.col(order).cast("bigint").alias("at"), F.col(value).cast("double").alias("x")
    ).withColumn("v", F.log("x")).filter(F.col("key").isNotNull() & F.col("at").isNotNull() & F.col("v").isNotNull())

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = seg = level = None
        scale, origin = 0.0, 0.0
        at, x, v = np.zeros(0, np.int64), np.zeros(0), np.zeros(0)

        def emit(cuts: list[tuple[int, int]]) -> Iterator[pd.DataFrame]:
            nonlocal at, x, v, level, scale
            out, used = [], 0
            for a, b in cuts:
                n = b - a
                cut = slice(used, used + n)
                now = round(float(np.median(v[cut])), 6)
                shift = None if level is None else round(now - level, 6)
                name, log = (None, 0.0) if shift is None else _factor(shift, tolerance)
                level, scale, used = now, scale + log, used + n
                if each_row:
                    out.append(pd.DataFrame({"key": key, "at": at[cut], "recorded": x[cut], "factor": np.exp(scale), "common_value": x[cut] / np.exp(scale)}))
                else:
                    out.append(pd.DataFrame([(key, at[cut][0], at[cut][-1], n, now, shift, name)], columns=[c.split()[0] for c in SEGMENTS.split(", ")]))
            at, x, v = at[used:], x[used:], v[used:]
            if out:
                yield pd.concat(out)

        for batch in batches:
            for name, part in batch.groupby("key", sort=False):
                if name != key:
                    if seg is not None:
                        yield from emit(seg.rest())
                    key, seg, level, scale, origin = name, Segmenter(penalty), None, 0.0, float(part["v"].iloc[0])
                for k in range(0, len(part), block):
                    piece = part.iloc[k : k + block]
                    new = piece["v"].to_numpy()
                    at, x, v = np.append(at, piece["at"].to_numpy()), np.append(x, piece["x"].to_numpy()), np.append(v, new)
                    seg.push(new - origin)
                    yield from emit(seg.settled())
        if seg is not None:
            yield from emit(seg.rest())

    ordered = logs.repartition("key").sortWithinPartitions("key", "at", "v")
    return ordered.mapInPandas(work, REVERSED if each_row else SEGMENTS)


def unit_shifts(
    rows: DataFrame,
    key: str,
    order: str,
    value: str,
    penalty: float = 12.0,
    tolerance: float = 0.25,
    block: int = 2048,
) -> DataFrame:
    """Segments of each key's history and the unit factor that relates each to the segment before.

    The history of a key is its rows by ``order`` (ties by value), and its segmentation
    is the exact optimum over the whole of it: the programme's state is carried through
    the sorted rows, and after each ``block`` rows the segments that can't change any
    more are given out. One key is one task. Nulls and amounts that aren't positive
    are skipped. ``factor`` is a name of KNOWN_FACTORS (with "1/" when the level falls),
    else null.
    """
    return _histories(rows, key, order, value, penalty, tolerance, block, each_row=False)


def reversed_values(rows: DataFrame, key: str, order: str, value: str, penalty: float = 12.0, tolerance: float = 0.25, block: int = 2048) -> DataFrame:
    """Every value in the unit of its key's first segment: the matched factors up to its segment are divided out."""
    return _histories(rows, key, order, value, penalty, tolerance, block, each_row=True)

"""Text-cleaning expressions (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "[\\s\\u00a0]+"
TRACKING = ("utm_", "yclid", "gclid", "fbclid", "ref")


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def norm_tok(c: Column) -> Column:
    """Lower case, separators as spaces, a space between letter and digit."""
    out = F.regexp_replace(F.lower(c), "[-_/]", " ")
    out = F.regexp_replace(out, "([a-zа-яё])([0-9])", "$1 $2")
    return squeeze(F.regexp_replace(out, "([0-9])([a-zа-яё])", "$1 $2"))


def strict_key(c: Column) -> Column:
    return F.translate(F.lower(c), "-_ ", "")


def title_format(c: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(c, "[\\t\\n\\r]", " "), "₽", " ₽ ")
    out = F.regexp_replace(F.regexp_replace(out, ",([0-9]{4})", ", $1"), "([0-9]{4})г", "$1 г")
    return squeeze(out)


def thousands(c: Column) -> Column:
    return F.regexp_replace(c, "(?<![0-9])([0-9]{1,3})[.,]([0-9]{3})(?![0-9])", "$1$2")


def parse_text(c: Column) -> Column:
    """Query wording in one form: ё as е, millions and thousands as units."""
    out = F.translate(F.lower(c), "ё", "е")
    out = F.regexp_replace(out, "([0-9]) *миллион[а-я]*", "$1 млн")
    return squeeze(F.regexp_replace(out, "([0-9]) *[kк](?![a-zа-я0-9])", "$1к"))


def meta_map(c: Column) -> Column:
    """``_meta_: k=v; k=v`` header line as a map; null without header."""
    head = F.regexp_extract(c, r"^_meta_: ([^\n]*)", 1)
    return F.when(head != "", F.transform_keys(F.str_to_map(head, F.lit(";"), F.lit("=")), lambda k, _: F.trim(k)))


def meta_build(meta: dict[str, Column], c: Column) -> Column:
    """The text under a ``_meta_`` header of the values that are there; unchanged without any."""
    pairs = F.concat_ws("; ", *(F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in meta.items()))
    return F.when(pairs == "", c).otherwise(F.concat(F.lit("_meta_: "), pairs, F.lit("\n"), F.coalesce(c, F.lit(""))))


#: Words of page frames, and marks at which a page's own text ends.
FRAME_WORDS = ("Спецтехника", "Отзывы", "Каталог", "Шины", "Форумы", "ОСАГО", "ПДД", "Проверка по VIN")
END_MARKS = ("Отзывы владельцев", "Мнения владельцев", "Вы смотрите раздел", 'В разделе "Продажа авто"', "Запчасти на", "Статистика цен", "О проекте Помощь Правила Для СМИ")


def clean_text(c: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "₽", " ₽ "), "|".join(FRAME_WORDS), ""))


def strip_frame(c: Column, least: int = 200) -> Column:
    """The text up to the first mark in list order that stands behind ``least`` characters, then up to a fourth price behind them."""
    out = c
    places = [F.locate(m, c) for m in END_MARKS]
    first = F.coalesce(*(F.when(p > least, p) for p in places))
    out = F.when(first.isNotNull(), F.trim(F.substring(c, F.lit(1), first - 1))).otherwise(c)
    head = F.regexp_extract(out, r"(?s)^((?:.*?(?:^|[^0-9a-zа-яёA-ZА-ЯЁ_])[0-9][0-9\s]{2,10}\s*₽){3}.*?(?:^|[^0-9a-zа-яёA-ZА-ЯЁ_]))[0-9][0-9\s]{2,10}\s*₽", 1)
    return F.when(F.length(head) > least, F.trim(head)).otherwise(out)


def html_text(c: Column) -> Column:
    """Text of a page without scripts and styles."""
    out = F.regexp_replace(c, r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    return squeeze(F.regexp_replace(F.regexp_replace(out, "(?s)<!--.*?-->", " "), "<[^>]*>", " "))


def forum_text(c: Column) -> Column:
    out = F.regexp_replace(c, r"(?is)\[quote[^\]]*\].*?\[/quote\]", " ")
    return squeeze(F.regexp_replace(out, r"(?iu)(sent from|отправлено)[^\n]*", " "))


def canonical_url(c: Column, exact: bool = False) -> Column:
    """Address without fragment and tracking parameters, host in lower case, https where no scheme is given.

    ``exact``: parameters are compared with whole keys and ``from`` is one of them.
    """
    bare = F.regexp_replace(F.trim(c), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, "^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    rest = F.regexp_replace(bare, "^[a-zA-Z][a-zA-Z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(rest, "^([^/?]*)", 1))
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(rest, "[?](.*)$", 1)
    drop = "^(utm_[^=]*|yclid|gclid|fbclid|from|ref)(=|$)" if exact else "^(" + "|".join(TRACKING) + ")"
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~p.rlike(drop) & (p != "")), "&")
    start = F.when(scheme == "", F.lit("" if exact else "https")).otherwise(scheme)
    return F.concat(F.when(start == "", "").otherwise(F.concat(start, F.lit("://"))), host, path, F.when(kept == "", "").otherwise(F.concat(F.lit("?"), kept)))


def url_class(c: Column) -> Column:
    """Whether an address leads to one listing."""
    low = F.lower(F.trim(c))
    return (
        F.when(c.isNull() | ~low.rlike("^https?://"), "bad")
        .when(low.rlike("[?&](q|query|search)="), "search")
        .when(low.rlike("(/[0-9]{3,}([/.?]|$))|([?&]id=[0-9]+)|/card"), "listing")
        .otherwise("other")
    )

"""Quality gates and scores; every gate gives a reason and drops nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of sale posts and of talk.
SALE_WORDS = (
    "продам", "продаю", "продается", "продаётся", "продажа", "в продаже", "в наличии", "срочно продам", "торг", "обмен", "рассмотрю обмен",
    "for sale", "sale", "selling", "sell",
)
TALK_WORDS = (
    "ищу", "куплю", "нужен", "нужна", "подскажите", "помогите", "обсуждение", "вопрос", "что лучше", "ремонт", "не заводится", "ошибка", "диагностика",
    "looking for", "help", "question", "repair",
)
PARTS_WORDS = (
    "фары отдельно", "бампер отдельно", "капот отдельно", "дверь отдельно", "крыло отдельно", "редуктор отдельно", "двигатель отдельно", "акпп отдельно",
    "кпп отдельно", "ноускат", "разборка", "на запчасти",
)
BLACK_WORDS = ("ищу", "куплю", "что лучше", "ремонт", "диагностика", "ошибка", "проблема", "запчасти", "разбор")
#: Fixed values of channel posts.
CHANNEL_SALE = ("продам", "продаю", "продается", "продаётся", "продажа", "срочно продам", "торг", "обмен", "рассмотрю обмен", "for sale", "selling", "sell")
CHANNEL_TALK = ("ищу", "куплю", "нужен", "подскажите", "помогите", "вопрос", "looking for", "help", "question", "repair")
CAR_WORDS = ("двигатель", "пробег", "год", "комплектация", "коробка")
SPAM_WORDS = ("подпишись", "подписывайтесь", "ссылка в био", "мой канал", "перейдите")
STOP_WORDS = (
    "подписывайтесь", "вакансия", "работа", "акция", "обсуждение", "опрос", "новости", "ремонт", "диагностика", "ошибка", "запчасти", "разбор", "по запчастям",
    "подскажите", "вопрос", "приобрету", "сервис", "колодки", "ваносы", "ксентри", "xentry", "кодирование", "чиптюнинг", "чип тюнинг",
)
NOISE_WORDS = ("подписывайтесь", "репост", "лайк", "разбор", "запчаст", "км/ч", "скорость")
DOUBT_WORDS = ("это норм", "это цена", "шутка", "реальная цена", "подскажите", "кто знает", "?")
PRICE = r"(^|[^0-9a-zа-яё_])[0-9]+([.,][0-9]+)?(\s(руб|₽|р|долл|usd|€|eur|тыс|к|k|млн|m)|₽|€)|[0-9][0-9\s]\s(млн|миллион|m|тыс|к|k|₽|руб|р|долл|usd|€|eur)"
CHANNEL_PRICE = r"[0-9][0-9\s.]{1,15}\s*(млн|миллион|🍋|лимон|₽|руб|р|тыс|k|к|[$]|€|usd|eur)"
YEAR = r"(^|[^0-9a-zа-яё_])(19|20)[0-9]{2}([^0-9a-zа-яё_]|$)"
CHANNEL_YEAR = r"(^|[^0-9a-zа-яё_])(19[89][0-9]|20[0-2][0-9])([^0-9a-zа-яё_]|$)|(^|[^0-9])([89][0-9]|[012][0-9])\s*(год|г[.]?\s|\s)"
FUEL = "бензин|дизель|гибрид|электро|газ|hybrid|diesel|petrol|electric|ev"


def hits(c: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, (c.contains(w).cast("int") for w in words))


def sale_score(c: Column) -> Column:
    """Two for each word of sale, one for a price, minus two for each word of talk."""
    low = F.lower(c)
    return 2 * hits(low, SALE_WORDS) + low.rlike(PRICE).cast("int") - 2 * hits(low, TALK_WORDS)


def channel_sale_score(c: Column) -> Column:
    low = F.lower(c)
    extra = low.rlike(CHANNEL_PRICE).cast("double") + low.rlike(r"[+]?[0-9][0-9()\s-]{8,}").cast("double") + low.rlike(r"[0-9][0-9\s]{1,8}\s*км").cast("double") * 0.5
    return 2 * hits(low, CHANNEL_SALE) + extra + 0.5 * hits(low, CAR_WORDS) - 2 * hits(low, CHANNEL_TALK)


def sale_flag(c: Column) -> Column:
    return F.lower(c).rlike("продам|продаю|продажа|цена|₽|руб")


def noise(c: Column, entity: Column) -> Column:
    """Whether a channel post is noise: hard words, invitations, or a price without a car in doubtful words."""
    low = F.lower(c)
    return (hits(low, NOISE_WORDS) > 0) | low.rlike(r"t(elegram)?[.]me/joinchat/|подпис(ывай|ыва)т(ь|есь)|подел(ись|итесь)") | (low.rlike(PRICE) & ~entity & (hits(low, DOUBT_WORDS) > 0))


def channel_post(c: Column, entity: Column) -> Column:
    """First reason against a channel post, or ok; ``entity``: whether it names a car."""
    low = F.trim(F.lower(c))
    priced, selling = low.rlike(CHANNEL_PRICE), channel_sale_score(low) >= 2
    stop = low.rlike("(^|[^0-9a-zа-яё_])(" + "|".join(STOP_WORDS) + ")([^0-9a-zа-яё_]|$)")
    return (
        F.when(F.coalesce(c, F.lit("")) == "", "spam")
        .when(~low.rlike(CHANNEL_YEAR), "no_year_found")
        .when(F.regexp_count(low, F.lit(r"[\x{2711}-\x{10FFFF}]")) > 20, "emoji_spam")
        .when(F.regexp_count(low, F.lit("@")) > 5, "mention_spam")
        .when(F.regexp_count(low, F.lit("http")) > 3, "link_spam")
        .when(hits(low, SPAM_WORDS) > 0, "spam_pattern")
        .when(F.length(low) < 40, "too_short")
        .when(stop, "blocked_by_stop_word")
        .when(entity & (priced | (selling & (F.length(low) >= 80))), "ok")
        .when(~entity, "no_car_entity")
        .when(~priced, "no_price")
        .otherwise("discussion")
    )


def quality_signals(price: Column, year: Column, mileage: Column, fuel: Column, brand: Column, model: Column) -> Column:
    parts = ((price, 0.25), (year, 0.15), (mileage, 0.15), (fuel, 0.10), (brand, 0.20), (model, 0.25))
    total = reduce(lambda a, b: a + b, (F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts))
    return F.round(F.least(total, F.lit(1.0)), 3)


def skip_reason(c: Column, channel: Column, brand: Column) -> Column:
    """First reason to leave a post out, or ok. ``channel``: it comes from a channel; ``brand``: it names a brand."""
    low = F.lower(F.coalesce(c, F.lit("")))
    sale, priced = sale_score(low) >= 2, low.rlike(PRICE)
    signs = brand | priced | low.rlike(YEAR) | low.rlike(r"[0-9]\s") | low.rlike(FUEL)
    return (
        F.when(low == "", "empty_text")
        .when(channel & noise(low, brand), "telegram_noise")
        .when(hits(low, PARTS_WORDS) > 0, "parts_listing")
        .when((F.length(F.trim(low)) < 40) & ~sale & ~channel & ~brand & ~priced & ~low.rlike(YEAR), "too_short")
        .when((hits(low, BLACK_WORDS) > 0) & ~sale & ~brand & ~priced, "blacklist_word")
        .when(~signs & ~sale, F.when(channel, "low_entity_signal").otherwise("low_entity_signal_marketplace"))
        .otherwise("ok")
    )


def listing_quality(brand: Column, model: Column, price: Column, year: Column, mileage: Column, city: Column, fuel: Column) -> Column:
    """Weighted completeness; zeros of numbers count as missing; a source bonus of .15; at most 1."""
    there = lambda c: F.coalesce(c != 0, F.lit(False))
    parts = (
        (brand.isNotNull(), 0.35), (model.isNotNull(), 0.20), (there(price), 0.20), (there(year), 0.10),
        (there(mileage), 0.05), (city.isNotNull(), 0.05), (fuel.isNotNull(), 0.05),
    )
    total = reduce(lambda a, b: a + b, (F.when(c, F.lit(w)).otherwise(F.lit(0.0)) for c, w in parts))
    return F.round(F.least(total + 0.15, F.lit(1.0)), 4)


def source_boost(source: Column) -> Column:
    return F.when(source.rlike("forum|club"), 1.5).when(source.isNull() | (source == "") | (source == "telegram"), 1.0).otherwise(0.8)


def clamp(c: Column, low: int, high: int) -> Column:
    return F.when(c.between(low, high), c)

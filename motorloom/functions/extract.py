"""Typed values out of listing and query text; first match wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorloom.plans.runtime import join_dictionary

FUELS = (  # the order decides
    ("electric", "(^|[^а-яa-z])(электро|электромобиль|electric)([^а-яa-z]|$)"),
    ("hybrid", "(^|[^а-яa-z])(гибрид|hybrid)([^а-яa-z]|$)"),
    ("diesel", "(^|[^а-яa-z])(дизель|дизельный|диз|diesel)([^а-яa-z]|$)"),
    ("gas_petrol", "газ/бензин|бензин [+] гбо|(^|[^а-яa-z])lpg([^а-яa-z]|$)"),
    ("gas", "(^|[^а-яa-z])(газ|метан|пропан)([^а-яa-z]|$)"),
    ("petrol", "(^|[^а-яa-z])(бензин|бензиновый|бенз|petrol)([^а-яa-z]|$)"),
)


def number(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "").try_cast("bigint")


def year(c: Column, last: int) -> Column:
    """A year before г/год first, then any; between 1985 and ``last``."""
    found = F.concat(F.regexp_extract_all(c, F.lit("((?:19|20)[0-9]{2}) ?г"), 1), F.regexp_extract_all(c, F.lit("((?:19|20)[0-9]{2})"), 1))
    return F.try_element_at(F.filter(F.transform(found, lambda y: y.cast("int")), lambda y: y.between(1985, last)), F.lit(1))


def mileage(c: Column) -> Column:
    """Kilometres by label or unit; 0 for unused cars; null above a million and a half."""
    labelled = F.regexp_extract(c, "пробег:? ?([0-9][0-9 ]*) ?км", 1)
    thousand = F.regexp_extract(c, "([0-9]{1,3}) ?тыс[.а-я]* ?км", 1)
    value = F.coalesce(
        F.when(c.contains("без пробега") & ~c.contains("без пробега по"), F.lit(0).cast("bigint")), number(F.nullif(labelled, F.lit(""))), number(F.nullif(thousand, F.lit(""))) * 1000
    )
    return F.when(value <= 1_500_000, value)


def price(c: Column) -> Column:
    """Roubles by unit, from ten thousand to two hundred million."""
    million = F.regexp_extract(c, "([0-9]+[.,]?[0-9]*) ?млн", 1)
    plain = F.regexp_extract(c, "([0-9][0-9 ]{3,12}) ?(?:руб|₽|р[.])", 1)
    value = F.coalesce((F.regexp_replace(F.nullif(million, F.lit("")), ",", ".").try_cast("decimal(12,3)") * 1_000_000).cast("bigint"), number(F.nullif(plain, F.lit(""))))
    return F.when(value.between(10_000, 200_000_000), value)


def fuel(c: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(FUELS):
        out = F.when(c.rlike(pattern), name).otherwise(out)
    return out


def paint(c: Column) -> Column:
    original = c.contains("не бит") | c.contains("родной окрас") | c.contains("заводском окрасе")
    return F.when(original, "original").when(c.contains("краш") | c.contains("перекрас"), "repainted")


def color(c: Column) -> Column:
    stems = "бел|черн|чёрн|сер|красн|син|голуб|зелен|зелён|желт|жёлт|оранжев|коричнев|вишнёв|бордов|молочн|графит|бирюз|беж"
    return F.nullif(F.regexp_extract(c, f"(?:^|[^а-яё])((?:{stems})[а-яё]*)", 1), F.lit(""))


def year_range(c: Column) -> tuple[Column, Column]:
    """(min, max) of a query: a range, от/до, or one year."""
    ends = lambda k: F.regexp_extract(c, "((?:19|20)[0-9]{2}) ?[-–] ?((?:19|20)[0-9]{2})", k).try_cast("int")
    one = F.regexp_extract(c, "(?:^|[^0-9])((?:19|20)[0-9]{2})(?: ?г| год|$)", 1).try_cast("int")
    low = F.regexp_extract(c, "(?:от|с|после) ((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1).try_cast("int")
    high = F.regexp_extract(c, "(?:до|не старше) ((?:19|20)[0-9]{2})(?:[^0-9]|$)", 1).try_cast("int")
    open_ = low.isNotNull() | high.isNotNull()
    return (
        F.when(ends(1).isNotNull(), ends(1)).when(open_, low).otherwise(one),
        F.when(ends(2).isNotNull(), ends(2)).when(open_, high).otherwise(one),
    )


def bound(c: Column, side: str, unit: str, scale: int) -> Column:
    """Number after от/до before a unit, times a scale; null for none or zero."""
    got = F.regexp_extract(c, f"(?:^|[^а-я]){side} ([0-9]+(?:[.,][0-9]+)?) ?(?:{unit})", 1)
    value = (F.regexp_replace(F.nullif(got, F.lit("")), ",", ".").try_cast("decimal(14,3)") * scale).cast("bigint")
    return F.nullif(value, F.lit(0).cast("bigint"))


def mileage_fallback(c: Column) -> Column:
    """Kilometres by looser wordings, in order; null where speed is meant; 0 for unused cars."""
    low = F.lower(c)
    out = F.regexp_replace(F.translate(low, "\u00a0", " "), "([0-9])[.,]([0-9]{3})([^0-9a-zа-яё_]|$)", "$1$2$3")
    out = F.regexp_replace(out, "(км|km)", " $1")
    plain = lambda pattern: F.regexp_replace(F.nullif(F.regexp_extract(out, pattern, 1), F.lit("")), "[^0-9.]", "").try_cast("double")
    found = F.array(
        plain("пробег\\s*[:-]?\\s*([0-9][0-9\\s]{1,7})"),
        plain("([0-9]{1,3}[\\s.,]?[0-9]{1,3})\\s*(?:км|km)"),
        plain("([0-9]{1,3}(?:[.,][0-9]+)?)\\s*(?:тыс|т.км|ткм|k|к)(?:[^0-9a-zа-яё_]|$)") * 1000,
        plain("([0-9]{4,7})\\s*(?:км|km)"),
    )
    first = F.try_element_at(F.filter(F.transform(found, lambda v: v.cast("bigint")), lambda v: v.between(1000, 1_500_000)), F.lit(1))
    unused = out.contains("без пробега") & ~out.rlike("по рф|по россии|по р[.]ф[.]") & ~out.rlike("[0-9]{1,3}[\\s.,]?[0-9]{3}\\s*(км|km)")
    return F.when(~low.rlike("км/ч|скорость"), F.coalesce(first, F.when(unused, F.lit(0).cast("bigint"))))


def about_mileage(c: Column) -> Column:
    return F.lower(c).rlike("пробег|км|km")


#: Spellings of each fuel.
FUEL_WORDS = {
    "petrol": ("бензин", "бензиновый", "бенз", "petrol", "gasoline", "mpi", "tsi", "tfsi", "fsi"),
    "diesel": ("дизель", "дизельный", "диз", "diesel", "tdi", "dci", "cdi"),
    "hybrid": ("гибрид", "hybrid", "phev", "hev"),
    "electric": ("электро", "электр", "electric", "ev"),
    "gas": ("газ", "lpg", "gbo", "cng", "gas"),
    "gas_petrol": ("газ/бензин", "газ бензин", "gas_petrol"),
}


def fuel_canonical(c: Column) -> Column:
    """One of six fuels; null for any other word."""
    low, out = F.lower(F.trim(c)), F.lit(None).cast("string")
    for fuel_, words in FUEL_WORDS.items():
        out = F.when(low.isin(*words), fuel_).otherwise(out)
    return out


def image_url(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, "(?i)(https?://[^\\s\"'<>]+?[.](?:jpg|jpeg|png|webp))", 1), F.lit(""))


def model_tokens(c: Column) -> Column:
    """Words that look like a model: letters with digits, or hyphened; no years."""
    plain = F.filter(F.split(F.lower(c), " "), lambda w: w.rlike("^[0-9a-zа-яё-]+$") & ~w.rlike("^(19|20)[0-9]{2}$"))
    return F.array_distinct(F.filter(plain, lambda w: (w.rlike("[0-9]") & w.rlike("[a-zа-яё]")) | w.contains("-")))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-zа-яё0-9][a-zа-яё0-9-]*)"), 1)


def first_entry(rows: DataFrame, key: str, text: Column, listing: DataFrame, alias: str, entry: list[str], longest: bool) -> DataFrame:
    """For each row the list entry whose alias is a token of the text: longest alias or list order first.

    Texts are split into tokens and joined by equality; the dictionary is never compared with every text.
    """
    parts = rows.select(F.col(key), F.explode(F.array_distinct(tokens(text))).alias(alias))
    hits = join_dictionary(parts, listing, alias)
    rank = F.struct(-F.length(alias), "ord") if longest else F.struct("ord")
    return hits.groupBy(key).agg(*(F.min_by(e, rank).alias(e) for e in entry))

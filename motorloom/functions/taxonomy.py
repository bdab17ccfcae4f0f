"""Normal forms of names: one spelling for brand and model names, their variants and spans of texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from motorloom.functions.text import squeeze

#: Cyrillic letters and the Latin ones that look alike, in this order.
LOOK_ALIKE = (("а", "a"), ("в", "b"), ("с", "c"), ("е", "e"), ("н", "h"), ("к", "k"), ("м", "m"), ("о", "o"), ("р", "p"), ("т", "t"), ("х", "x"), ("у", "y"))
EDGE = "[^0-9a-zа-яё_]"


def norm(c: Column) -> Column:
    """Lower case; a single look-alike letter beside a digit or hyphen is Latin; separators are spaces; letters and digits stand apart."""
    low = out = F.lower(squeeze(c))
    for cyrillic, latin in LOOK_ALIKE:
        out = F.regexp_replace(out, f"(^|{EDGE}){cyrillic}([0-9-])", f"$1{latin}$2")
        out = F.regexp_replace(out, f"([0-9-]){cyrillic}({EDGE}|$)", f"$1{latin}$2")
    letters = "".join(a for a, _ in LOOK_ALIKE)  # few texts hold such a letter at all
    out = F.when(low.rlike(f"(^|{EDGE})[{letters}][0-9-]|[0-9-][{letters}]({EDGE}|$)"), out).otherwise(low)
    out = F.regexp_replace(out, "[-_/]+", " ")
    out = F.regexp_replace(out, "([a-zа-яё])([0-9])", "$1 $2")
    return squeeze(F.regexp_replace(out, "([0-9])([a-zа-яё])", "$1 $2"))


def key(c: Column) -> Column:
    return F.translate(norm(c), " ", "_")


def compact(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[-_\s\x{00a0}]+", "")


def variants(c: Column) -> Column:
    """Distinct non-empty spellings: normal, without separators, spaced, joined."""
    spaced = norm(c)
    return F.array_distinct(F.filter(F.array(norm(c), compact(norm(c)), spaced, F.translate(spaced, " ", "")), lambda v: v != ""))


def words(c: Column) -> Column:
    return F.regexp_extract_all(norm(c), F.lit("([0-9a-zа-яё]+)"), 1)


def _joined(w: Column, k: int) -> Column:
    runs = F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), lambda i: F.array_join(F.slice(w, i, k), ""))
    return F.when(F.size(w) >= k, runs).otherwise(F.array().cast("array<string>"))


def spans(w: Column, most: int = 4) -> Column:
    """Every run of up to ``most`` of the words, joined: a phrase occurs in a text if its own joined words are among them.

    ``w`` should be a column of words that already stands: it is used many times.
    """
    return F.array_distinct(reduce(lambda a, b: F.concat(a, b), (_joined(w, k) for k in range(1, most + 1))))


def phrase(c: Column) -> Column:
    """What a name looks like among ``spans``; null for an empty one."""
    return F.nullif(F.array_join(words(c), ""), F.lit(""))

"""Freely typed values mapped to the closest entry of a reference list.

Method: a symmetric-delete dictionary (every key of the list with up to two
characters deleted) is broadcast; a typed value is looked up by its own deletes,
candidates are verified by weighted Damerau-Levenshtein distance and ranked by
distance, then by how often the entry occurs in the data, then by list order.
Values are folded first: case, punctuation, look-alike letters, the wrong keyboard
layout and romanisation. Values that reach no entry are reported as ``unmatched``.

A value may hold further words: with up to three of them the name may be misspelled too,
with more it counts letter for letter only.

Rows are mapped where they lie: no shuffle, however often one value occurs. Each
worker remembers values it has resolved (bounded).

Defined results: null gives null; empty or blank text is ``unmatched``; equal
distances go to the more frequent, then the earlier entry; an empty list leaves
everything unmatched; clashing column names don't matter, as only the named id and
value columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorloom.plans.runtime import bounded_rows

UNMATCHED = "unmatched"
MOST_ENTRIES = 100_000
_CACHE_LIMIT = 200_000

# The two keyboard layouts key by key, look-alike letters, romanisation.
EN_KEYS = "`qwertyuiop[]asdfghjkl;'zxcvbnm,."
RU_KEYS = "ёйцукенгшщзхъфывапролджэячсмитьбю"
LATIN_LIKE = "aceopxyktmhbi"
CYRILLIC_LIKE = "асеорхуктмнві"
ROMAN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "yo", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}

_TO_RU = str.maketrans(EN_KEYS, RU_KEYS)
_TO_EN = str.maketrans(RU_KEYS, EN_KEYS)
_LIKE_LATIN = str.maketrans(CYRILLIC_LIKE, LATIN_LIKE)
_LIKE_CYRILLIC = str.maketrans(LATIN_LIKE, CYRILLIC_LIKE)
_SPLIT = re.compile(r"[\s/|(),;]+")
_CYRILLIC = re.compile(r"[а-яё]")
_LATIN = re.compile(r"[a-z]")


def squeeze(text: str) -> str:
    """Letters and digits only, lower case, ё as е."""
    return "".join(c for c in text.lower().replace("ё", "е") if c.isalnum())


def romanise(text: str) -> str:
    return "".join(ROMAN.get(c, c) for c in text)


def sounded(text: str) -> str:
    """Romanised spelling of a Latin name once it is written by ear in Cyrillic."""
    for a, b in (("qu", "kv"), ("ph", "f"), ("x", "ks"), ("h", "kh"), ("w", "v")):
        text = text.replace(a, b)
    return text


def deletes(key: str, depth: int) -> set[str]:
    found, layer = {key}, {key}
    for _ in range(depth):
        layer = {w[:i] + w[i + 1 :] for w in layer for i in range(len(w))}
        found |= layer
    return found


def allowed(length: int) -> int:
    """Edits that a word of this length may carry."""
    return 0 if length < 4 else 1 if length < 7 else 2


_NEAR: dict[str, int] = {
    c: 100 * row + col for keys in ((EN_KEYS), (RU_KEYS)) for row, (a, b) in enumerate(((1, 13), (13, 24), (24, 33))) for col, c in enumerate(keys[a:b])
}


def _swap_cost(a: str, b: str) -> float:
    """A slip to a neighbouring key or between like vowels is cheaper than any other change."""
    x, y = _NEAR.get(a), _NEAR.get(b)
    if x is not None and y is not None and abs(x // 100 - y // 100) <= 1 and abs(x % 100 - y % 100) <= 1:
        return 0.8
    return 1.0


def distance(a: str, b: str, most: float) -> float:
    """Weighted Damerau-Levenshtein distance (restricted transpositions), or infinity beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return float("inf")
    before, row = [], [float(j) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [float(i)]
        for j, y in enumerate(b, 1):
            double = 0.7 if (x == y and i > 1 and a[i - 2] == x) or (x == y and j > 1 and b[j - 2] == y) else 1.0
            cost = min(before[j] + double, row[j - 1] + double, before[j - 1] + (0.0 if x == y else _swap_cost(x, y)))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                cost = min(cost, older[j - 2] + 0.8)
            row.append(cost)
        if min(row) > most:
            return float("inf")
    return row[-1] if row[-1] <= most else float("inf")


@dataclass
class Reference:
    """A reference list in the form that is broadcast."""

    keys: dict[str, list[tuple[str, int]]] = field(default_factory=dict)  # key -> entries with their order
    near: dict[str, list[str]] = field(default_factory=dict)  # delete -> keys
    weight: dict[str, int] = field(default_factory=dict)  # entry -> occurrences
    longest: int = 0  # length of the longest key
    ordered: list[str] = field(default_factory=list)  # keys in order, for beginnings

    def add(self, alias: str, entry: str, order: int) -> None:
        plain = squeeze(alias)
        for key in {plain, romanise(alias.lower().replace("-", "")), romanise(plain), plain if re.search(r"\d", plain) else sounded(plain)}:
            key = "".join(c for c in key if c.isalnum())
            if not key:
                continue
            if key not in self.keys:
                self.keys[key] = []
                self.longest = max(self.longest, len(key))
                for d in deletes(key, allowed(len(key))):
                    self.near.setdefault(d, []).append(key)
            if all(e != entry for e, _ in self.keys[key]):
                self.keys[key].append((entry, order))

    def best(self, key: str) -> tuple[float, str] | None:
        """Closest entry of one folded key."""
        if not key or len(key) > self.longest + 2:
            return None
        digits = re.sub(r"\D", "", key)
        most, found = allowed(len(key)), []
        near = {k for d in deletes(key, most) for k in self.near.get(d, ())} if key not in self.keys else {key}
        for k in near:
            if re.sub(r"\D", "", k) != digits or (digits and k != key and len(k) < 6):
                continue
            gap = distance(key, k, min(most, allowed(len(k))))
            if gap < float("inf"):
                found += [(gap, -self.weight.get(e, 0), order, e) for e, order in self.keys[k]]
        return (min(found)[0], min(found)[3]) if found else None

    def begins(self, key: str) -> str | None:
        """The one entry that a cut-off word begins."""
        if len(key) < 3:
            return None
        if len(self.ordered) != len(self.keys):
            self.ordered = sorted(self.keys)
        found: set[str] = set()
        for k in self.ordered[bisect_left(self.ordered, key) :]:
            if not k.startswith(key) or len(found) > 1:
                break
            found.update(e for e, _ in self.keys[k])
        return found.pop() if len(found) == 1 else None

    def resolve(self, value: str) -> str:
        """The entry that a typed value means, or UNMATCHED."""
        low = value.lower().strip()
        if not low:
            return UNMATCHED
        readings = list(forms(low))
        for _, form in readings:
            if (plain := squeeze(form)) in self.keys:
                return self.best(plain)[1]
        best: tuple[float, int, str] | None = None
        tried: dict[str, tuple[float, str] | None] = {}
        for cost, form in readings:
            if best is not None and best[0] <= cost:
                break
            words = [w for w in _SPLIT.split(form) if w]
            runs = [(0, len(words))] + [(a, b) for n in (3, 2, 1) for a in range(len(words) - n + 1) for b in [a + n] if n < len(words)]
            for a, b in runs:
                rest = words[:a] + words[b:]
                key = squeeze("".join(words[a:b]))
                if len(rest) > 3 and key not in self.keys:
                    continue  # inside a longer text only a name letter for letter counts
                if key not in tried:
                    tried[key] = self.best(key)
                if (got := tried[key]) is None:
                    continue
                rank = (got[0] + cost + 0.05 * len(rest), a, got[1])
                if best is None or rank < best:
                    best = rank
        if best is not None:
            return best[2]
        if low.endswith((".", "…")) or len(squeeze(low)) >= 4:
            for form in (low, low.translate(_LIKE_LATIN), low.translate(_LIKE_CYRILLIC)):
                cut = self.begins(squeeze(form))
                if cut and (low.endswith((".", "…")) or len(squeeze(form)) >= 5):
                    return cut
        return UNMATCHED


def forms(low: str) -> Iterable[tuple[float, str]]:
    """Readings of a typed value with what each costs."""
    yield 0.0, low
    cyr, lat = bool(_CYRILLIC.search(low)), bool(_LATIN.search(low))
    if cyr:
        yield 0.1, low.translate(_LIKE_LATIN)
    if lat:
        yield 0.1, low.translate(_LIKE_CYRILLIC)
    if lat and not _CYRILLIC.search(low.replace("ё", "")):
        yield 0.3, low.translate(_TO_RU)
    if cyr and not lat:
        yield 0.3, low.translate(_TO_EN)
        yield 0.4, romanise(low)


def map_values(
    rows: DataFrame,
    id_column: str,
    fields: dict[str, tuple[DataFrame, str, str, str]],
    most: int = MOST_ENTRIES,
) -> DataFrame:
    """(id, field_name, typed, canonical) of every non-null value of the fields.

    ``fields``: column -> (reference list, entry column, alias column, order column).
    """
    references: dict[str, Reference] = {}
    for name, (listing, entry, alias, order) in fields.items():
        ref = references[name] = Reference()
        for r in bounded_rows(listing.select(entry, alias, order), most, f"the reference list of {name}"):
            if r[0]:
                ref.add(r[1] or r[0], r[0], r[2] or 0)
                ref.add(r[0], r[0], r[2] or 0)
        entries = listing.select(F.col(entry).alias("e")).distinct()
        counted = rows.select(F.col(name).alias("e")).join(F.broadcast(entries), "e").groupBy("e").count()
        ref.weight = {r[0]: r[1] for r in counted.collect()}  # at most one row per entry of the list
    held = rows.sparkSession.sparkContext.broadcast(references)
    names = list(fields)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refs, known = held.value, {n: {} for n in names}
        for batch in batches:
            ids, fields_, typed, entries = [], [], [], []
            for name in names:
                some = batch[["__id", name]].dropna()
                seen = known[name]
                if len(seen) > _CACHE_LIMIT:
                    seen.clear()
                values = some[name].tolist()
                for value in set(values) - seen.keys():
                    seen[value] = refs[name].resolve(value)
                ids += some["__id"].tolist()
                fields_ += [name] * len(values)
                typed += values
                entries += [seen[v] for v in values]
            yield pd.DataFrame(
                {
                    "id": np.array(ids, np.int64),
                    "field_name": pd.Series(fields_, dtype=object),
                    "typed": pd.Series(typed, dtype=object),
                    "canonical": pd.Series(entries, dtype=object),
                }
            )

    narrow = rows.select(F.col(id_column).cast("bigint").alias("__id"), *(F.col(n).cast("string").alias(n) for n in names))
    return narrow.mapInPandas(work, "id bigint, field_name string, typed string, canonical string")


def unlike(mapped: DataFrame) -> DataFrame:
    """Values that aren't letter for letter the entry they mean."""
    return mapped.filter(F.col("typed") != F.col("canonical")).select("id", "field_name", "canonical").distinct()

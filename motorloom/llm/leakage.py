"""Passages of held-out items inside a corpus.

A document leaks an item if it holds ``window`` successive words of it, of which at
most one differs. Method: every item window is the set of its word 5-grams; one
wrong word spoils at most five of the eight, so three must be shared, and by rarity
order (document frequencies counted over the whole corpus) one of the rarest six is
among the shared ones. Only those necessary prefix members are looked up; a hit
fixes the alignment of document and item, which bounds length and position, and the
item-sized windows on that alignment are verified word by word.

The items are broadcast in blocks of at most ``block`` rows, whatever their number;
the corpus is never shuffled. Case, punctuation, line breaks, ё/е and look-alike
letters of other alphabets are folded on both sides.

Defined results: null or short texts and items leak nothing; repeated documents are
reported each; repeated items too; empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorloom.llm.shingles import HASHES, WORD, ngrams
from motorloom.plans.runtime import bounded_rows

WINDOW, GRAM, WRONG = 12, 5, 1
BLOCK = 20_000
# Letters of other alphabets and the Latin ones they look like.
_FOLD = str.maketrans("аевкмнорстухіјѕԁһԛԝгёαεορχυικτνз", "aebkmhopctyxijsdhqwreaeopxyiktv3")
_DROP = {0xAD: None, 0x200B: None, 0x200C: None, 0x200D: None, 0x2060: None, 0xFEFF: None, 0x301: None}
_FOLD.update(_DROP)


def fold(text: str) -> str:
    return text.lower().translate(_FOLD)


def folded_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of many folded texts and their offsets."""
    found = [WORD.findall(fold(t)) if t else () for t in texts]
    ends = np.cumsum([0, *map(len, found)])
    return np.fromiter((HASHES[w] for ws in found for w in ws), dtype=np.uint64, count=int(ends[-1])), ends


class Items:
    """Word hashes of one block of items and the positions of their 5-grams."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.ids = np.array(ids, np.int64)
        self.words, self.ends = folded_hashes(texts)
        grams = ngrams(self.words, GRAM)
        inside = np.zeros(len(grams), bool)
        for a, b in zip(self.ends[:-1], self.ends[1:]):
            if b - a >= WINDOW:
                inside[a : b - GRAM + 1] = True
        self.at = np.flatnonzero(inside)
        order = np.argsort(grams[self.at], kind="stable")
        self.at = self.at[order]
        self.grams = grams[self.at]
        self.distinct = np.unique(self.grams)

    def necessary(self, frequency: np.ndarray) -> None:
        """Keep only the prefix members: of each window's 5-grams the rarest that can't all be spoilt."""
        rarity = np.full(len(self.words), np.iinfo(np.int64).max)
        value = np.zeros(len(self.words), np.uint64)
        rarity[self.at] = frequency[np.searchsorted(self.distinct, self.grams)]
        value[self.at] = self.grams
        per = WINDOW - GRAM + 1
        prefix = per - (per - GRAM * WRONG) + 1
        keep = np.zeros(len(self.words), bool)
        for a, b in zip(self.ends[:-1], self.ends[1:]):
            for s in range(a, b - WINDOW + 1):
                span = np.arange(s, s + per)
                keep[span[np.lexsort((value[span], rarity[span]))[:prefix]]] = True
        chosen = keep[self.at]
        self.at, self.grams = self.at[chosen], self.grams[chosen]

    def _verify(self, words: np.ndarray, grams: np.ndarray, hit: np.ndarray, lo: np.ndarray) -> np.ndarray:
        if not len(hit):
            return self.ids[:0]
        hi = np.searchsorted(self.grams, grams[hit], "right")
        lines = set()
        for i, a, b in zip(hit.tolist(), lo[hit].tolist(), hi.tolist()):
            lines.update((int(x) - i, int(x)) for x in self.at[a:b])
        found, seen = set(), set()
        for shift, x in lines:
            k = int(np.searchsorted(self.ends, x, "right")) - 1
            if k in found or (shift, k) in seen:
                continue
            seen.add((shift, k))
            a, b = max(int(self.ends[k]), shift), min(int(self.ends[k + 1]), shift + len(words))
            if b - a < WINDOW:
                continue
            wrong = np.concatenate(([0], np.cumsum(self.words[a:b] != words[a - shift : b - shift])))
            if (wrong[WINDOW:] - wrong[:-WINDOW]).min() <= WRONG:
                found.add(k)
        return self.ids[sorted(found)]


def _frequencies(docs: DataFrame, held) -> np.ndarray:
    """Over the whole corpus, the number of documents with each 5-gram of the items."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = held.value.distinct
        counts = np.zeros(len(wanted) + 1, np.int64)
        for batch in batches:
            flat, ends = folded_hashes(batch.column("text").to_pylist())
            grams = ngrams(flat, GRAM)
            at = np.searchsorted(wanted, grams)
            at[at == len(wanted)] = 0
            hit = np.flatnonzero(wanted[at] == grams) if len(wanted) else np.empty(0, np.int64)
            doc = np.searchsorted(ends, hit, "right") - 1
            hit, doc = hit[hit + GRAM <= ends[doc + 1]], doc[hit + GRAM <= ends[doc + 1]]
            pairs = np.unique(np.stack([doc, at[hit]]), axis=1)
            np.add.at(counts, pairs[1], 1)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["k", "n"])

    rows = docs.select("text").mapInArrow(work, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n"))
    out = np.zeros(len(held.value.distinct) + 1, np.int64)
    for r in rows.collect():  # at most one row per 5-gram of the item block
        out[r.k] = r.n
    return out[: len(held.value.distinct)]


def leaked(corpus: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id) for every document that holds a passage of an item.

    ``corpus``: doc_id, text. ``items``: item_id, text.
    """
    docs = corpus.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    slim = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, math.ceil(slim.count() / block))
    context = corpus.sparkSession.sparkContext
    parts = []
    for k in range(blocks):
        part = slim if blocks == 1 else slim.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        rows = bounded_rows(part, 2 * block, "one block of items")
        held = Items([r.item_id for r in rows], [r.text for r in rows])
        held.necessary(_frequencies(docs, context.broadcast(held)))
        parts.append(_scan(docs, context.broadcast(held)))
    return reduce(DataFrame.unionByName, parts).distinct() if blocks > 1 else parts[0]


def _scan(docs: DataFrame, held) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            flat, ends = folded_hashes(batch.column("text").to_pylist())
            grams = ngrams(flat, GRAM)
            lo = np.searchsorted(items.grams, grams, "left")
            lo[lo == len(items.grams)] = 0
            hits = np.flatnonzero(items.grams[lo] == grams) if len(items.grams) else np.empty(0, np.int64)
            owner = np.searchsorted(ends, hits, "right") - 1
            docs_out, items_out = [], []
            cuts = np.flatnonzero(np.diff(owner, prepend=-1, append=-1))
            for a, b in zip(cuts[:-1], cuts[1:]):
                k = int(owner[a])
                s, e = int(ends[k]), int(ends[k + 1])
                at = hits[a:b][hits[a:b] + GRAM <= e] - s
                for item in items._verify(flat[s:e], grams[s:e], at, lo[s:e]).tolist():
                    docs_out.append(ids[k])
                    items_out.append(item)
            yield pa.RecordBatch.from_arrays(
                [pa.array(docs_out, pa.int64()), pa.array(items_out, pa.int64())], names=["doc_id", "item_id"]
            )

    return docs.mapInArrow(work, "doc_id bigint, item_id bigint")


def leak_report(found: DataFrame) -> DataFrame:
    """Per item, the number of documents it leaked into."""
    return found.groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"))

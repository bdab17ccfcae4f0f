"""Texts of varying length packed into containers of fixed capacity.

Method: hierarchical multi-length packing. Each length (tokens of a public tokenizer) is
routed to the smallest context-size tier that holds it: the capacity, half of it, a
quarter and so on. Tiers are packed from the longest to the shortest: a container of tier
j has room for 2**j windows of the tier's size, one text each, longest first; what the
windows of a container leave over is one gap, and it is filled from the shorter tiers,
longest fitting text first, and last from what the tier itself still has.

Lengths are whole numbers up to the capacity, so the packing is planned on their
histogram. The plan holds patterns with multiplicities, bounded by the capacity and not by
the corpus, and covers all texts at once. Texts are then dealt to the planned places by
their rank among texts of equal length; ranks are taken in salted groups, so that one
length may hold any share of the rows. Containers are dealt to step groups in snake order
of their fill, which balances the tokens of each step.

A text is split only if it alone exceeds the capacity: into full pieces and a rest.
Defined results: null and empty texts take no tokens and lie in container 0; equal
texts are packed each; an empty table gives an empty result; further columns are
ignored; the result doesn't depend on the partitioning of the input.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motorloom.plans.runtime import bounded_rows, stash

TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Fixed value: the splitting pattern that goes with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SALTS = 64
#: Context-size tiers of one capacity.
TIERS = 7


@cache
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and number of tokens of the whole text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64())], names=["doc_id", "tokens"])

    return docs.mapInArrow(work, "doc_id bigint, tokens bigint")


def tiers(capacity: int, most: int = TIERS) -> list[int]:
    """Context sizes: the capacity and its halves, ``most`` at most."""
    out = [capacity]
    while out[-1] > 1 and len(out) < most:
        out.append(out[-1] // 2)
    return out


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Patterns (how many containers, {length: pieces in each}) for all lengths of the histogram."""
    left = {s: n for s, n in histogram.items() if s > 0 and n > 0}
    sizes = tiers(capacity)
    routed: list[list[int]] = [[] for _ in sizes]
    for length in sorted(left):
        routed[max(j for j, size in enumerate(sizes) if size >= length)].append(length)
    patterns: list[tuple[int, dict[int, int]]] = []
    shorter: list[int] = sorted(left)
    for size, own in zip(sizes, routed):
        shorter = shorter[: len(shorter) - len(own)]  # rising; the lengths of this tier are its end
        windows = capacity // size
        for length in reversed(own):
            while left[length]:
                per = min(windows, capacity // length)
                many, per = (left[length] // per, per) if left[length] >= per else (1, left[length])
                left[length] -= many * per
                open_ = [(many, {length: per}, per, capacity - per * length)]
                while open_:
                    many, pattern, used, gap = open_.pop()
                    found = _longest(own, gap, left) if used < windows else None
                    found = found or _longest(shorter, gap, left) or _longest(own, gap, left)
                    if not found:
                        patterns.append((many, pattern))
                        continue
                    some = min(many, left[found])
                    left[found] -= some
                    open_.append((some, pattern | {found: pattern.get(found, 0) + 1}, used + 1, gap - found))
                    if some < many:
                        open_.append((many - some, pattern, used, gap))
    return sorted(patterns, key=lambda x: (-sum(s * n for s, n in x[1].items()), sorted(x[1].items(), reverse=True)))


def _longest(lengths: list[int], gap: int, left: dict[int, int]) -> int | None:
    """The longest of the rising lengths that fits the gap and is not used up."""
    for k in range(bisect_right(lengths, gap) - 1, -1, -1):
        if left[lengths[k]]:
            return lengths[k]
    return None


def places(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """For each length rows (first rank, pieces a container, first container), by rank."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    dealt: dict[int, int] = {}
    base = 0
    for many, pattern in patterns:
        for length, per in pattern.items():
            out.setdefault(length, []).append((dealt.get(length, 0), per, base))
            dealt[length] = dealt.get(length, 0) + many * per
        base += many
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(counts: DataFrame, name: str, capacity: int, group: int = 64, salts: int = SALTS) -> DataFrame:
    """Container and step group of every piece of every text, for one capacity.

    ``counts``: doc_id, tokens. ``group``: containers in a step.
    """
    full = F.floor(F.col("tokens") / F.lit(capacity)).cast("int")
    rest = F.col("tokens") % F.lit(capacity)
    last = F.when((rest > 0) | (full == 0), F.array(F.struct(full.alias("piece"), rest.alias("size"))))
    whole = F.transform(
        F.when(full > 0, F.sequence(F.lit(0), full - 1)).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(k.alias("piece"), F.lit(capacity).cast("bigint").alias("size")),
    )
    pieces = counts.select("doc_id", F.explode(F.concat(whole, F.coalesce(last, F.array().cast(
        "array<struct<piece:int,size:bigint>>")))).alias("p")).select("doc_id", "p.piece", "p.size")
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    tallied = stash(salted.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n")), "pack-sizes")
    rows = bounded_rows(tallied.groupBy("size").agg(F.sum("n").alias("n")), capacity + 1, "lengths up to the capacity")
    patterns = plan({r["size"]: r["n"] for r in rows}, capacity)
    where = places(patterns)
    total = sum(m for m, _ in patterns)
    held = counts.sparkSession.sparkContext.broadcast(where)
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tallied.select("size", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # the offsets grow to capacity x salts rows: joined by a merge on the partitioning that the ranks need anyway
    rank = F.row_number().over(Window.partitionBy("size", "salt").orderBy("doc_id", "piece")) - 1
    ranked = salted.withColumn("r", rank).join(offsets.hint("merge"), ["size", "salt"]).withColumn("r", F.col("r") + F.col("offset"))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = held.value
        steps = max(1, -(-total // group))
        for batch in batches:
            container = np.zeros(len(batch), np.int64)
            size, r = batch["size"].to_numpy(), batch["r"].to_numpy()
            for s in np.unique(size):
                if s:
                    mine = size == s
                    table = at[int(s)]
                    k = np.searchsorted(table[:, 0], r[mine], "right") - 1
                    container[mine] = table[k, 2] + (r[mine] - table[k, 0]) // table[k, 1]
            row, column = np.divmod(container, steps)
            batch["container_id"] = container
            batch["step_group"] = np.where(row % 2 == 0, column, steps - 1 - column)
            yield batch[["doc_id", "piece", "size", "container_id", "step_group"]]

    dealt = ranked.select("doc_id", "piece", "size", "r").mapInPandas(
        deal, "doc_id bigint, piece int, size bigint, container_id bigint, step_group bigint"
    )
    return dealt.select(
        F.lit(name).alias("container_name"), F.lit(capacity).cast("int").alias("capacity_tokens"), "doc_id", "piece",
        (F.col("piece").cast("bigint") * F.lit(capacity)).alias("first_token"), F.col("size").alias("tokens"),
        "container_id", "step_group",
    )


def pack_all(documents: DataFrame, containers: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """All texts packed once for each capacity of ``containers`` (container_name, capacity_tokens)."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = stash(token_counts(docs, f"{folder}/{vocabulary}"), "token-counts")
    kinds = bounded_rows(containers.select("container_name", "capacity_tokens"), 1000, "containers")
    return reduce(DataFrame.unionByName, [pack(counts, r.container_name, r.capacity_tokens) for r in kinds])


def fill_report(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens and the share of space that is used."""
    total = F.countDistinct("container_id")
    return packed.groupBy("container_name", "capacity_tokens").agg(
        total.alias("containers"), F.sum("tokens").alias("tokens"),
        F.round(F.sum("tokens") / (total * F.first("capacity_tokens")), 6).alias("filled"),
    )

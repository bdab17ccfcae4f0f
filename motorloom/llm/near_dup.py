"""Near-duplicate texts: exact Jaccard join on word n-grams.

Method: rare-first prefix filtering. Every text becomes its set of word n-grams;
texts with equal sets form one *class* and only one of them takes part in the
join. Set members are ordered by a corpus-wide rarity sketch; two sets with
Jaccard >= t must share members within their prefixes, so only prefix members are
joined; prefixes are long enough that a pair must share SHARED of them, and pairs
that share fewer are dropped as they are counted. A match must also pass the length
filter, the positional filter and a suffix filter on 256-bit parity signatures (the
Hamming distance of two signatures never exceeds the symmetric difference, so no
true pair is lost). Each surviving pair is verified once on the whole sets.

The rarity sketch has a fixed number of buckets (``SKETCH_BITS``) whatever the
size of the corpus; any total order is a correct one, so collisions in it cost
time, never pairs. Set members are 64-bit hashes.

Defined results: null, empty and short texts (fewer than n words) have class null
and never match; equal texts share a class; an empty table gives empty results;
further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motorloom.llm.shingles import batch_ngram_sets, mix
from motorloom.plans.runtime import join_dictionary, stash

SKETCH_BITS = 24
SIGNATURE_WORDS = 4
SIGNATURE = tuple(f"s{j}" for j in range(SIGNATURE_WORDS))
#: Prefix members that a pair must share; prefixes are longer by as many, so no pair is lost.
SHARED = 6
#: Lower bits of a 64-bit member that make room for its position (positions beyond count as the last).
POSITION_BITS = 24
EXPAND_LIMIT = 64

SIGNED = "grp string, id bigint, cls bigint, n int, grams array<bigint>"


def class_of(grams: np.ndarray) -> int | None:
    """One 64-bit key of a set; None for the empty set."""
    if not len(grams):
        return None
    with np.errstate(over="ignore"):
        rank = np.arange(1, len(grams) + 1, dtype=np.uint64)
        total = np.bitwise_xor.reduce(mix(grams + rank * np.uint64(0xD6E8FEB86659FD93)))
    return int(total.astype(np.int64))


def _list_array(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)], dtype=np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def sign(texts: DataFrame, n: int, keep_grams: bool) -> DataFrame:
    """(grp, id, text) -> class, size and, if asked, the n-gram set of every text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = batch_ngram_sets(batch.column("text").to_pylist(), n)
            cols = {
                "grp": batch.column("grp"),
                "id": batch.column("id"),
                "cls": pa.array([class_of(s) for s in sets], pa.int64()),
                "n": pa.array([len(s) for s in sets], pa.int32()),
            }
            if keep_grams:
                cols["grams"] = _list_array(sets)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    schema = SIGNED if keep_grams else SIGNED.rpartition(",")[0]
    narrow = texts.select(F.col("grp").cast("string"), F.col("id").cast("bigint"), F.col("text").cast("string"))
    return narrow.mapInArrow(work, schema)


def rarity_sketch(signed: DataFrame, bits: int = SKETCH_BITS, chunk_bits: int = 16) -> np.ndarray:
    """Logarithmic count per hash bucket over all texts; 0 where at most one text has it.

    Each task counts its texts in one array and sends it in compressed chunks; chunks
    are added where they meet, and 2**bits levels of one byte reach the driver.
    """
    size = 1 << chunk_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.uint16)
        for batch in batches:
            flat = batch.column("grams").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            part, times = np.unique((flat >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
            counts[part] = np.minimum(counts[part] + times, 65535).astype(np.uint16)
        rows = counts.reshape(-1, size)
        some = np.flatnonzero(rows.any(axis=1))
        packed = [zlib.compress(rows[k].tobytes(), 1) for k in some]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(packed, pa.binary())], names=["k", "part"])

    def add(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.float64)
        for batch in parts:  # streamed: one chunk of one task at a time
            for part in batch.column("part"):
                total += np.frombuffer(zlib.decompress(part.as_py()), np.uint16)
        level = np.where(total > 1, np.clip(np.floor(np.log2(np.maximum(total, 1)) * 8), 1, 255), 0)
        packed = zlib.compress(level.astype(np.uint8).tobytes(), 1)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([packed], pa.binary())], names=["k", "level"])

    parts = signed.select("grams").mapInArrow(count, "k int, part binary")
    sketch = np.zeros((1 << bits) // size * size, np.uint8)
    for r in parts.groupBy("k").applyInArrow(add, "k int, level binary").collect():
        sketch[r.k * size : (r.k + 1) * size] = np.frombuffer(zlib.decompress(r.level), np.uint8)
    return sketch


def signature(grams: np.ndarray) -> np.ndarray:
    """Parity bits of a set in a 256-bit field."""
    slots = (grams & np.uint64(64 * SIGNATURE_WORDS - 1)).astype(np.int64)
    bits = (np.bincount(slots, minlength=64 * SIGNATURE_WORDS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def prefix_of(part: np.ndarray, levels: np.ndarray, threshold: float, drop_single: bool, shared: int = SHARED) -> tuple[np.ndarray, int]:
    """Prefix members of one set, rare first, and the position of the first of them."""
    level = levels[(part >> np.uint64(64 - int(len(levels)).bit_length() + 1)).astype(np.int64)]
    order = np.lexsort((part, level))[: len(part) - int(np.ceil(threshold * len(part) - 1e-9)) + shared]
    first = int(np.count_nonzero(level[order] == 0)) if drop_single else 0
    return part[order[first:]], first


def rare_first(reps: DataFrame, sketch: np.ndarray, threshold: float, drop_single: bool = True, shared: int = SHARED) -> DataFrame:
    """(cls, n, first, s0-s3, prefix): the prefix members of each set, rare first, its size and signature; ``first`` is the position of the first member.

    ``drop_single`` leaves out members that the sketch proves to be in one set only;
    they come first in the order.
    """
    held = reps.sparkSession.sparkContext.broadcast(zlib.compress(sketch.tobytes(), 1))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = np.frombuffer(zlib.decompress(held.value), np.uint8)
        for batch in batches:
            grams = batch.column("grams")
            flat = grams.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            ends = (grams.offsets.to_numpy() - grams.offsets[0].as_py()).tolist()
            prefixes, sizes, firsts, bits = [], [], [], []
            for a, b in zip(ends, ends[1:]):
                part, first = prefix_of(flat[a:b], levels, threshold, drop_single, shared)
                prefixes.append(part)
                sizes.append(b - a)
                firsts.append(first)
                bits.append(signature(flat[a:b]))
            words = np.array(bits, np.int64).reshape(-1, SIGNATURE_WORDS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("cls"), pa.array(sizes, pa.int32()), pa.array(firsts, pa.int32()),
                    *(pa.array(np.ascontiguousarray(words[:, j])) for j in range(SIGNATURE_WORDS)), _list_array(prefixes),
                ],
                names=["cls", "n", "first", *SIGNATURE, "prefix"],
            )

    words = ", ".join(f"{w} bigint" for w in SIGNATURE)
    return reps.select("cls", "grams").mapInArrow(work, f"cls bigint, n int, first int, {words}, prefix array<bigint>")


def postings(prefixes: DataFrame, *also: str) -> DataFrame:
    """One row (mark, cls, n) per prefix member of each set; ``mark`` holds the member's upper bits and its position.

    Members whose upper bits are equal meet too; such pairs fail the exact check.
    """
    one = prefixes.select("cls", "n", "first", *also, F.posexplode("prefix").alias("k", "gram"))
    mark = F.shiftleft(F.shiftright("gram", POSITION_BITS), POSITION_BITS) + F.least(F.col("first") + F.col("k"), F.lit((1 << POSITION_BITS) - 1))
    return one.select(mark.alias("mark"), "cls", "n", *also)


def candidates(left: DataFrame, right: DataFrame, threshold: float, same: bool = False, shared: int = SHARED) -> DataFrame:
    """Distinct pairs of classes (cls_a from ``left``, cls_b from ``right``) that pass every filter.

    ``same``: both are one table, and every unordered pair comes once, cls_a < cls_b.
    Postings with signatures pass the suffix filter too.
    """
    a, b = left.alias("a"), right.alias("b")
    apart = sum((F.bit_count(F.col(f"a.{w}").bitwiseXOR(F.col(f"b.{w}"))) for w in SIGNATURE), F.lit(0)) if "s0" in left.columns else F.lit(0)
    need = (F.col("a.n") + F.col("b.n")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-6)
    key = lambda side: F.shiftright(f"{side}.mark", POSITION_BITS)
    rest = lambda side: F.col(f"{side}.n") - F.col(f"{side}.mark").bitwiseAND((1 << POSITION_BITS) - 1) + (shared - 1)
    met = a.join(
        b,
        (key("a") == key("b"))
        & ((F.col("a.cls") < F.col("b.cls")) if same else (F.col("a.cls") != F.col("b.cls")))
        & (rest("a") >= need)
        & (rest("b") >= need)
        & (F.col("a.n") >= need)
        & (F.col("b.n") >= need)
        & (F.col("a.n") + F.col("b.n") - apart >= 2 * need),
    ).select(F.col("a.cls").alias("cls_a"), F.col("b.cls").alias("cls_b"), F.least(F.lit(shared), F.ceil(need)).cast("int").alias("least"))
    counted = met.groupBy("cls_a", "cls_b").agg(F.count(F.lit(1)).alias("shared"), F.max("least").alias("least"))
    return counted.filter(F.col("shared") >= F.col("least")).select("cls_a", "cls_b")


def verify(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Exact Jaccard of each candidate pair (a, b) of rows of ``sets`` (row, cls, grams); those at or above the threshold remain."""
    ends = stash(pairs.select(F.col("a").alias("row")).union(pairs.select(F.col("b").alias("row"))).distinct(), "ends")
    needed = join_dictionary(sets, ends, "row", "left_semi", most=1_000_000)
    one = needed.select(F.col("row").alias("a"), F.col("cls").alias("x"), F.col("grams").alias("ga"))
    two = needed.select(F.col("row").alias("b"), F.col("cls").alias("y"), F.col("grams").alias("gb"))
    shared = F.size(F.array_intersect("ga", "gb"))
    joined = pairs.join(one, "a").join(two, "b")
    scored = joined.select("x", "y", shared.alias("o"), (F.size("ga") + F.size("gb")).alias("t"))
    return scored.select(
        F.least("x", "y").alias("cls_a"), F.greatest("x", "y").alias("cls_b"), (F.col("o") / (F.col("t") - F.col("o"))).alias("similarity")
    ).filter(F.col("similarity") >= F.lit(threshold - 1e-9))


def representatives(signed: DataFrame) -> DataFrame:
    """One row (cls, grams) per class, by a shuffle of ids, not of sets, unless copies are many."""
    keyed = signed.filter("cls is not null")
    repeated = (
        keyed.groupBy("cls")
        .agg(F.min(F.struct("grp", "id")).alias("first"), F.count(F.lit(1)).alias("m"))
        .filter("m > 1")
    )
    others = stash(
        keyed.select("grp", "id", "cls")
        .join(repeated.select("cls", "first"), "cls")
        .filter(~((F.col("grp") == F.col("first.grp")) & (F.col("id") == F.col("first.id"))))
        .select("grp", "id"),
        "copies",
    )
    return join_dictionary(keyed, others, ["grp", "id"], "left_anti", most=1_000_000).select("cls", "grams")


def similar_classes(
    main: DataFrame, n: int = 5, threshold: float = 0.8, twins: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Classes and links of all texts.

    ``main`` and ``twins`` hold (grp, id, text). ``twins`` is for texts that mostly
    repeat those of ``main`` (a second form of the same field): only their classes
    that ``main`` lacks bring sets of their own. Returns members (grp, id, cls) and
    links (cls_a, cls_b, similarity), cls_a < cls_b, between different sets.
    """
    signed = stash(sign(main, n, True), "signed")
    members = signed.select("grp", "id", "cls")
    sets = representatives(signed)
    if twins is not None:
        thin = stash(sign(twins, n, False), "signed-twins")
        members = members.unionByName(thin.select("grp", "id", "cls"))
        known = signed.filter("cls is not null").select("cls").distinct()
        new = thin.filter("cls is not null").join(known, "cls", "left_anti")
        first = stash(new.groupBy("cls").agg(F.min(F.struct("grp", "id")).alias("k")).select("k.grp", "k.id"), "new-twins")
        extra = sign(join_dictionary(twins, first, ["grp", "id"], "left_semi", most=1_000_000), n, True)
        sets = sets.unionByName(extra.filter(F.col("cls").isNotNull()).select("cls", "grams"))
    # rows are numbered: short numbers take less of every shuffle than 64-bit hashes
    sets = stash(sets.withColumn("row", F.monotonically_increasing_id()), "sets")
    sketch = rarity_sketch(sets)
    prefixes = rare_first(sets.select(F.col("row").alias("cls"), "grams"), sketch, threshold)
    posted = postings(prefixes, *SIGNATURE)
    pairs = stash(candidates(posted, posted, threshold, same=True).toDF("a", "b"), "pairs")
    return members, stash(verify(pairs, sets, threshold), "links")


def pairs_of_rows(members: DataFrame, links: DataFrame, expand_limit: int = EXPAND_LIMIT) -> DataFrame:
    """Pairs of ids within each grp from classes and links.

    Copies of one class are paired with one another while the class has at most
    ``expand_limit`` rows of the grp. Beyond that its smallest id stands for all:
    each copy is paired with it, and links of the class are given for it, so that
    the groups stay whole and no quadratic output arises; ``class_report`` on the same
    classes holds the membership, so every pair can be had from both.
    """
    held = members.filter("cls is not null").select("grp", "id", "cls")
    sizes = held.groupBy("grp", "cls").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("m"))
    crowd = sizes.filter("m > 1")
    twins = held.join(crowd, ["grp", "cls"]).filter(F.col("m") <= expand_limit)
    small = (
        twins.alias("a")
        .join(twins.alias("b"), ["grp", "cls"])
        .filter("a.id < b.id")
        .select("grp", F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
    )
    large = held.join(crowd.filter(F.col("m") > expand_limit), ["grp", "cls"]).filter("id > head")
    star = large.select("grp", F.col("head").alias("id_a"), F.col("id").alias("id_b"))
    heads = sizes.filter(F.col("m") > expand_limit).select("grp", "cls", "head")
    linked = links.select(F.col("cls_a").alias("cls")).union(links.select("cls_b")).distinct()
    shown = (
        held.join(linked, "cls", "left_semi")
        .join(heads, ["grp", "cls"], "left")
        .filter("head is null or id = head")
        .select("grp", "id", "cls")
    )
    left = shown.select("grp", F.col("cls").alias("cls_a"), F.col("id").alias("x"))
    right = shown.select(F.col("grp").alias("grp_b"), F.col("cls").alias("cls_b"), F.col("id").alias("y"))
    across = (
        links.select("cls_a", "cls_b")
        .join(left, "cls_a")
        .join(right, "cls_b")
        .filter("grp = grp_b and x <> y")
        .select("grp", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    )
    return small.unionByName(star).unionByName(across).distinct()


def class_report(members: DataFrame, links: DataFrame, expand_limit: int = EXPAND_LIMIT) -> DataFrame:
    """One row per text: its class, the number of other classes it is linked with, and whether
    ``pairs_of_rows`` gives its copies pair by pair (else by their smallest id)."""
    ends = links.select(F.col("cls_a").alias("cls")).unionAll(links.select("cls_b"))
    degree = ends.groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    crowd = members.filter("cls is not null").groupBy("grp", "cls").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") > expand_limit)
    return members.join(degree, "cls", "left").join(crowd, ["grp", "cls"], "left").select(
        "grp", "id", "cls", F.coalesce("links", F.lit(0)).cast("bigint").alias("links"), F.col("m").isNull().alias("expanded")
    )

"""The k most similar vectors of every vector, by cosine.

Method: a hierarchical k-means tree, walked best bin first: the open node most similar
to the query is expanded next, and leaves are visited in the order in which they leave
the priority queue. That order is the one of the least similarity on the path from the
root to the leaf (a leaf leaves the queue after its worst ancestor, and leaves behind the
same ancestor by what lies below it), so a batch of queries gets its order from one table
of similarities instead of a queue each; near-ties of up to a thousandth may swap. How many
leaves every query visits is widened until the calibrated recall is reached: for a
sample of queries the true neighbours are found among all vectors, and the position of
their leaves in the query's visiting order tells the recall of any number of visits.

The tree is fitted on a bounded sample (``SAMPLE`` vectors, by hash of the id); every
vector is indexed. Neighbouring leaves form cells of about ``MEMBERS`` vectors. A vector
is stored once, in the cell of its leaf; a query is sent once to each cell that it
visits, with the list of its leaves there. Both sides of a cell come in blocks of
bounded size, so a cell may hold any share of the rows. A leaf that holds more than
``SPLIT`` vectors is split further inside its cell from its own members, and the number
of parts a query visits there is calibrated on queries of the cell, so the size of
leaves doesn't grow with the collection. Vectors that are equal up to length form one
class and are searched once; copies are set in afterwards, smallest ids first.

Defined results: null vectors, vectors with null or NaN parts, all-zero vectors and
those of another length than the most common one take no part; ties go to the smaller
id; fewer than k others give fewer neighbours; repeated ids count once; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motorloom.llm.shingles import mix
from motorloom.plans.runtime import stash

SAMPLE, CALIBRATION, LEAF, BRANCH = 20_000, 400, 64, 16
MEMBERS, QUERIES = 32_768, 32_768
SPLIT, INNER_RECALL, INNER_QUERIES = 256, 0.995, 256


class Tree:
    """Centres of all nodes; children of each node as a range; leaves numbered in order."""

    def __init__(self, sample: np.ndarray, leaf: int, branch: int = BRANCH, seed: int = 7):
        self.random = np.random.default_rng(seed)
        self.centres: list[np.ndarray] = [sample.mean(0) if len(sample) else np.zeros(1)]
        self.first, self.last, self.parent, self.leaf_of = [0], [0], [0], [-1]
        todo = [(0, sample)]
        leaves = 0
        while todo:
            node, part = todo.pop()
            groups = self._split(part, min(branch, 1 + 3 * len(part) // (2 * leaf))) if len(part) > leaf else []
            if len(groups) < 2:
                self.leaf_of[node] = leaves
                leaves += 1
                continue
            self.first[node] = len(self.centres)
            for g in groups:
                self.centres.append(g.mean(0))
                self.first.append(0)
                self.last.append(0)
                self.parent.append(node)
                self.leaf_of.append(-1)
            self.last[node] = len(self.centres)
            todo += [(self.first[node] + k, g) for k, g in enumerate(groups)]
        self.leaves = leaves
        self.levels, order = [], [np.array([0])]
        while len(order[-1]):
            order.append(np.concatenate([np.arange(self.first[n], self.last[n]) for n in order[-1]]).astype(np.int64))
        by_level = np.concatenate(order)
        place = np.empty(len(by_level), np.int64)
        place[by_level] = np.arange(len(by_level))
        starts = np.cumsum([len(o) for o in order])
        self.levels = [np.arange(a, b) for a, b in zip(starts, starts[1:]) if b > a]
        self.centres = np.array(self.centres, np.float32)[by_level]
        self.parent = place[np.array(self.parent)[by_level]]
        self.leaf_of = np.array(self.leaf_of)[by_level]
        first, last = np.array(self.first)[by_level], np.array(self.last)[by_level]
        some = last > first
        self.first, self.last = np.zeros_like(first), np.zeros_like(last)
        self.first[some] = place[first[some]]
        self.last[some] = self.first[some] + (last - first)[some]
        self.node_of_leaf = np.zeros(leaves, np.int64)
        self.node_of_leaf[self.leaf_of[self.leaf_of >= 0]] = np.flatnonzero(self.leaf_of >= 0)

    def _split(self, part: np.ndarray, branch: int) -> list[np.ndarray]:
        centres = part[self.random.choice(len(part), min(branch, len(part)), replace=False)]
        mine = np.zeros(len(part), np.int64)
        for _ in range(8):
            mine = np.argmax(part @ centres.T - 0.5 * (centres * centres).sum(1), 1)
            centres = np.stack([part[mine == k].mean(0) if (mine == k).any() else centres[k] for k in range(len(centres))])
        return [part[mine == k] for k in range(len(centres)) if (mine == k).any()]

    def leaf_keys(self, queries: np.ndarray) -> np.ndarray:
        """(queries, leaves): a key by which best bin first visits leaves in falling order.

        The least similarity on the way to the leaf decides; leaves behind the same bottleneck
        are told apart by the least similarity below it, then by their own, at a thousandth of
        the weight each.
        """
        own = self.centres @ queries.T.astype(np.float32)
        own -= 0.5 * (self.centres * self.centres).sum(1)[:, None]
        least, below = own.copy(), own.copy()
        least[0] = below[0] = np.float32(np.inf)
        for level in self.levels:
            a, b = level[0], level[-1] + 1  # levels are runs of nodes
            above, under = least[self.parent[level]], below[self.parent[level]]
            np.minimum(below[a:b], under, out=below[a:b], where=(own[a:b] > above) & (under > above))
            np.minimum(least[a:b], above, out=least[a:b])
        at = self.node_of_leaf
        keys = least[at].astype(np.float64)
        keys += below[at] * np.float32(1e-3)
        keys += own[at] * np.float32(1e-6)
        return np.ascontiguousarray(keys.T)

    def visits(self, queries: np.ndarray, most: int) -> np.ndarray:
        """For each query its first ``most`` leaves, best bin first."""
        most = min(most, self.leaves)
        out = np.empty((len(queries), most), np.int64)
        for a in range(0, len(queries), 1000):
            keys = self.leaf_keys(queries[a : a + 1000])
            if most == 1:
                out[a : a + 1000, 0] = keys.argmax(1)
                continue
            np.negative(keys, out=keys)
            pick = np.argpartition(keys, most - 1, axis=1)[:, :most] if most < self.leaves else np.broadcast_to(np.arange(most), keys.shape)
            order = np.argsort(np.take_along_axis(keys, pick, 1), axis=1, kind="stable")
            out[a : a + 1000] = np.take_along_axis(pick, order, 1)
        return out


def best_bin_first(tree: Tree, query: np.ndarray) -> list[int]:
    """The visiting order of one query by a priority queue; ``Tree.visits`` gives the same for many at once."""
    queue, out = [(-np.inf, 0)], []
    while queue:
        _, node = heappop(queue)
        if tree.leaf_of[node] >= 0:
            out.append(int(tree.leaf_of[node]))
        for child in range(tree.first[node], tree.last[node]):
            centre = tree.centres[child]
            heappush(queue, (-float(centre @ query - 0.5 * (centre @ centre)), child))
    return out


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Unit vectors from a column of float32 bytes."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.float32).astype(np.float64).reshape(-1, dims)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _usable(points: DataFrame) -> tuple[DataFrame, int]:
    clean = points.select(F.col("id").cast("bigint").alias("id"), F.col("vector").cast("array<float>").alias("vector"))
    clean = clean.filter(
        F.col("id").isNotNull() & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    common = clean.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dims = common["d"] if common else 0
    return clean.filter(F.size("vector") == dims).dropDuplicates(["id"]), dims


def _classes(clean: DataFrame, dims: int) -> DataFrame:
    """id, key of the direction, vector as float32 bytes."""
    factors = np.random.default_rng(5).integers(1, 1 << 62, dims, np.uint64) * np.uint64(2) + np.uint64(1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dims)
            unit = flat.astype(np.float64)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            with np.errstate(over="ignore"):
                keys = mix((np.round(unit * 1e6).astype(np.int64).view(np.uint64) * factors).sum(1)).view(np.int64)
            raw = pa.array([r.tobytes() for r in flat], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(keys), raw], names=["id", "cls", "vector"])

    return clean.mapInArrow(work, "id bigint, cls bigint, vector binary")


def _collect(points: DataFrame, most: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """A bounded sample by hash of the id: ids and vectors."""
    rows = points.orderBy(F.xxhash64("id", F.lit(salt)), "id").limit(most).select("id", "vector").collect()
    flat = np.frombuffer(b"".join(r.vector for r in rows), np.float32).astype(np.float64).reshape(len(rows), -1)
    return np.array([r.id for r in rows], np.int64), flat / np.linalg.norm(flat, axis=1, keepdims=True)


def _truth(points: DataFrame, ids: np.ndarray, queries: np.ndarray, tree: Tree, k: int, dims: int) -> pd.DataFrame:
    """The k true neighbours of each sampled query among all vectors, with their leaves."""
    held = points.sparkSession.sparkContext.broadcast((ids, queries, tree))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, q, t = held.value
        for batch in batches:
            if not len(batch):
                continue
            got = _matrix(pa.array(batch["vector"]), dims)
            ids_ = batch["id"].to_numpy()
            sims = np.round(q @ got.T, 9)
            sims[own[:, None] == ids_[None]] = -2
            top = np.argpartition(-sims, min(k, len(ids_)) - 1, axis=1)[:, :k]
            leaf = t.visits(got[np.unique(top)], 1)[:, 0]
            at = np.searchsorted(np.unique(top), top)
            yield pd.DataFrame(
                {"q": np.repeat(np.arange(len(own)), top.shape[1]), "id": ids_[top].ravel(), "leaf": leaf[at].ravel(),
                 "sim": np.take_along_axis(sims, top, 1).ravel()}
            )

    rows = points.select("id", "vector").mapInPandas(work, "q int, id bigint, leaf bigint, sim double")
    best = rows.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("sim")).alias("s"), "id", "leaf"))), 1, k).alias("b"))
    return best.select("q", F.explode("b").alias("b")).select("q", "b.leaf", "b.s").filter("s <= 1").toPandas()


def calibrate(points: DataFrame, tree: Tree, k: int, target: float, dims: int) -> int:
    """The least number of leaf visits that reaches the target recall on the calibration queries."""
    ids, queries = _collect(points, CALIBRATION, 11)
    truth = _truth(points, ids, queries, tree, k, dims)
    if not len(truth):
        return 1
    order = tree.visits(queries, tree.leaves)
    place = np.argsort(order, 1)
    need = np.sort(place[truth["q"].to_numpy(), truth["leaf"].to_numpy()])
    return int(need[min(len(need) - 1, int(np.ceil(target * len(need))))]) + 1


def cells_of(sizes: np.ndarray, most: int = MEMBERS) -> np.ndarray:
    """Cell of each leaf: runs of neighbouring leaves with at most ``most`` members, or one larger leaf."""
    out, cell, held = np.zeros(len(sizes), np.int32), 0, 0
    for leaf, n in enumerate(map(int, sizes)):
        if held and held + n > most:
            cell, held = cell + 1, 0
        out[leaf], held = cell, held + n
    return out


class Best:
    """The best ``keep`` members of every query so far; offers are pooled and merged in blocks."""

    def __init__(self, queries: int, keep: int, pool: int = 1_000_000):
        self.keep, self.pool = keep, pool
        self.sims = np.full((queries, keep), -2, np.float32)
        self.members = np.full((queries, keep), -1, np.int32)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def offer(self, rows: np.ndarray, sims: np.ndarray, first: int) -> None:
        """Similarities of ``rows`` with the members from ``first`` on."""
        r, c = np.nonzero(sims > self.sims[rows, -1][:, None])
        if len(r):
            self.waiting.append((rows[r], sims[r, c], (first + c).astype(np.int32)))
            self.held += len(r)
            if self.held > self.pool:
                self.merge()

    def merge(self) -> None:
        if not self.waiting:
            return
        rows, sims, members = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting, self.held = [], 0
        hit = np.unique(rows)
        rows = np.concatenate([rows, np.repeat(hit, self.keep)]).astype(np.uint64)
        sims = np.concatenate([sims, self.sims[hit].ravel()])
        members = np.concatenate([members, self.members[hit].ravel()])
        falling = ((np.float32(4) - sims).view(np.uint32)).astype(np.uint64)  # positive floats sort like their bits
        order = np.argsort((rows << np.uint64(32)) | falling)
        starts = np.flatnonzero(np.diff(rows[order].astype(np.int64), prepend=-1))
        take = order[(starts[:, None] + np.arange(self.keep)).ravel()]
        self.sims[hit] = sims[take].reshape(-1, self.keep)
        self.members[hit] = members[take].reshape(-1, self.keep)


def search_cell(
    x: np.ndarray, mid: np.ndarray, home: np.ndarray, y: np.ndarray, qid: np.ndarray, asked: np.ndarray, row: np.ndarray, k: int, split: int = SPLIT
) -> tuple[np.ndarray, np.ndarray]:
    """Similarities and ids of the k best members for each query, over the leaves it asks for.

    ``x``, ``mid``, ``home``: members with ids and leaves; ``y``, ``qid``: queries;
    ``asked``, ``row``: leaves and the query that asks, best first for each query.
    """
    order = np.argsort(home, kind="stable")
    x, mid, home = x[order], mid[order], home[order]
    x4, y4 = x.astype(np.float32), y.astype(np.float32)
    by_id = np.argsort(mid)
    at = by_id[np.minimum(np.searchsorted(mid, qid, sorter=by_id), len(mid) - 1)]
    own = np.where(mid[at] == qid, at, -1)
    best = Best(len(y), k + 4)

    def meet(rows: np.ndarray, a: int, b: int) -> None:
        pace = max(16, 2_000_000 // max(1, b - a))  # bounds the block of similarities
        for s in range(0, len(rows), pace):
            part = rows[s : s + pace]
            sims = y4[part] @ x4[a:b].T
            mine = np.flatnonzero((own[part] >= a) & (own[part] < b))
            sims[mine, own[part[mine]] - a] = -2
            best.offer(part, sims, a)

    first = np.diff(row, prepend=-1) != 0
    for chosen in (first, ~first):  # the best leaf of every query sets its bar
        leaves, rows = asked[chosen], row[chosen]
        by_leaf = np.argsort(leaves, kind="stable")
        leaves, rows = leaves[by_leaf], rows[by_leaf]
        for leaf in np.unique(leaves):
            a, b = np.searchsorted(home, [leaf, leaf + 1])
            r0, r1 = np.searchsorted(leaves, [leaf, leaf + 1])
            if a == b:
                continue
            if b - a <= split:
                meet(rows[r0:r1], a, b)
                continue
            parts, where = _parts(x[a:b], y[rows[r0:r1]], own[rows[r0:r1]] - a, k, split)
            inner = np.argsort(parts, kind="stable")
            for z in (x4, x, mid):
                z[a:b] = z[a:b][inner]
            moved = np.empty(b - a, np.int64)
            moved[inner] = np.arange(b - a)
            inside = (own >= a) & (own < b)
            own[inside] = a + moved[own[inside] - a]
            best.merge()
            old = (best.members >= a) & (best.members < b)
            best.members[old] = a + moved[best.members[old] - a]
            ends = np.searchsorted(parts[inner], np.arange(where.shape[1] + 1))
            for p in range(where.shape[1]):
                meet(rows[r0:r1][where[:, p]], a + ends[p], a + ends[p + 1])
        best.merge()
    sims, ids = np.full((len(y), best.keep), -2.0), np.full((len(y), best.keep), -1, np.int64)
    for s in range(0, len(y), 4096):
        got = best.members[s : s + 4096]
        exact = np.round(np.einsum("qd,qkd->qk", y[s : s + 4096], x[got]), 9)
        sims[s : s + 4096] = np.where(got >= 0, exact, -2)
        ids[s : s + 4096] = np.where(got >= 0, mid[got], -1)
    top = np.lexsort((ids, -sims), axis=1)[:, :k]
    return np.take_along_axis(sims, top, 1), np.take_along_axis(ids, top, 1)


def _parts(x: np.ndarray, y: np.ndarray, own: np.ndarray, k: int, split: int) -> tuple[np.ndarray, np.ndarray]:
    """Split a large leaf: part of each member, and (queries, parts) which parts each query visits.

    As many parts are visited as hold the k best members, within the leaf, of nearly all of up to
    ``INNER_QUERIES`` queries that are asked exactly.
    """
    tree = Tree(x[:: max(1, len(x) // 20_000)], max(32, split // 2))
    parts = tree.visits(x, 1)[:, 0]
    probe = np.unique(np.linspace(0, len(y) - 1, INNER_QUERIES).astype(np.int64))
    sims = y[probe] @ x.T
    seen = np.flatnonzero((own[probe] >= 0) & (own[probe] < len(x)))
    sims[seen, own[probe[seen]]] = -2
    true = np.argpartition(-sims, min(k, len(x)) - 1, axis=1)[:, :k]
    place = np.argsort(tree.visits(y[probe], tree.leaves), 1)
    need = np.sort(place[np.arange(len(probe))[:, None], parts[true]].ravel())
    visits = int(need[int(np.ceil(INNER_RECALL * (len(need) - 1)))]) + 1
    where = np.zeros((len(y), tree.leaves), bool)
    np.put_along_axis(where, tree.visits(y, visits), True, 1)
    return parts, where


def nearest_classes(reps: DataFrame, tree: Tree, sizes: np.ndarray, visits: int, k: int, dims: int) -> DataFrame:
    """(id, near: array<struct<s, id>>) with the k best other representatives, over the visited leaves; s is minus the similarity.

    ``sizes``: members of each leaf, as the sample estimates them; they shape cells and blocks only.
    """
    spark = reps.sparkSession
    cells = cells_of(sizes)
    held = spark.sparkContext.broadcast((tree, cells))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, cell_of = held.value
        for batch in (whole.slice(a, 4000) for whole in batches for a in range(0, whole.num_rows, 4000)):
            n = batch.num_rows
            seen = t.visits(_matrix(batch.column("vector"), dims), visits)
            cell = cell_of[seen]
            key = (np.arange(n)[:, None] * (int(cell_of[-1]) + 1) + cell).ravel()
            order = np.argsort(key, kind="stable")  # within a cell the leaves stay best first
            key, leaves = key[order], seen.ravel()[order].astype(np.int32)
            starts = np.flatnonzero(np.diff(key, prepend=-1))
            ends = [*starts[1:].tolist(), len(leaves)]
            rows, to = np.divmod(key[starts], int(cell_of[-1]) + 1)
            home = seen[:, 0].astype(np.int32)
            lists = [h.tobytes() for h in home] + [leaves[a:b].tobytes() for a, b in zip(starts.tolist(), ends)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").take(pa.array(np.concatenate([np.arange(n), rows]))),
                    pa.array(np.concatenate([cell[:, 0], to]).astype(np.int32)),
                    pa.array(np.concatenate([np.zeros(n, bool), np.ones(len(rows), bool)])),
                    pa.array(lists, pa.binary()),
                    batch.column("vector").take(pa.array(np.concatenate([np.arange(n), rows]))),
                ],
                names=["id", "cell", "asks", "leaves", "vector"],
            )

    routed = reps.select("id", "vector").mapInArrow(route, "id bigint, cell int, asks boolean, leaves binary, vector binary")
    _, probe = _collect(reps, 2000, 17)
    asked = cells[tree.visits(probe, visits)] if len(probe) else np.zeros((0, 1), np.int32)
    many = np.bincount(cells, weights=sizes, minlength=1)
    share = np.array([(asked == c).any(1).mean() if len(asked) else 0 for c in range(len(many))])
    blocks = [(c, max(1, -(-int(m) // MEMBERS)), max(1, int(np.ceil(q * many.sum() / QUERIES)))) for c, (m, q) in enumerate(zip(many, share))]
    shape = spark.createDataFrame(blocks, "cell int, mb int, qb int")  # one row a cell of the bounded tree
    h = F.xxhash64("id", "cell")
    spread = routed.join(F.broadcast(shape), "cell").select(
        "id", "cell", "asks", "leaves", "vector",
        F.explode(
            F.when(F.col("asks"), F.transform(F.sequence(F.lit(0), F.col("mb") - 1), lambda a: F.struct(a.alias("a"), F.pmod(h, F.col("qb")).cast("int").alias("b"))))
            .otherwise(F.transform(F.sequence(F.lit(0), F.col("qb") - 1), lambda b: F.struct(F.pmod(h, F.col("mb")).cast("int").alias("a"), b.alias("b"))))
        ).alias("at"),
    ).select("id", "cell", "at.a", "at.b", "asks", "leaves", "vector")

    def search(group: pa.Table) -> pa.Table:
        asks = group.column("asks").to_numpy()
        mem, ask = group.filter(pa.array(~asks)), group.filter(pa.array(asks))
        ids, s, lens = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        qid = ask.column("id").to_numpy()
        if len(mem) and len(ask):
            x, y = _matrix(mem.column("vector"), dims), _matrix(ask.column("vector"), dims)
            home = np.frombuffer(b"".join(mem.column("leaves").to_pylist()), np.int32)
            lists = ask.column("leaves").to_pylist()
            row = np.repeat(np.arange(len(ask)), [len(v) // 4 for v in lists])
            sims, near = search_cell(x, mem.column("id").to_numpy(), home, y, qid, np.frombuffer(b"".join(lists), np.int32), row, k)
            some = sims > -2
            lens, s, ids = some.sum(1), -sims[some], near[some]
        else:
            qid = qid[:0]
        ends = pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
        pairs = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(s, pa.float64()), pa.array(ids, pa.int64())], names=["s", "id"]))
        return pa.table({"id": pa.array(qid, pa.int64()), "p": pairs})

    partial = spread.groupBy("cell", "a", "b").applyInArrow(search, "id bigint, p array<struct<s:double,id:bigint>>")
    merged = partial.groupBy("id").agg(F.flatten(F.collect_list("p")).alias("p"))
    return merged.select("id", F.slice(F.array_sort("p"), 1, k).alias("near"))


def neighbour_lists(points: DataFrame, k: int = 5, target: float = 0.97) -> DataFrame:
    """(id, neighbour, rank) of every usable vector; ``points``: id, vector."""
    clean, dims = _usable(points)
    spark = points.sparkSession
    if not dims:
        return spark.createDataFrame([], "id bigint, neighbour bigint, rank int")
    keyed = stash(_classes(clean, dims), "vectors")
    firsts = keyed.groupBy("cls").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m"))
    copied = stash(firsts.filter("m > 1"), "copied")
    later = keyed.select("id", "cls").join(copied.withColumnRenamed("id", "head"), "cls").filter("id > head").select("id", "cls", "head")
    reps = keyed.join(later.select("id"), "id", "left_anti").select("id", "vector")
    total = keyed.count()
    _, sample = _collect(reps, SAMPLE, 3)
    tree = Tree(sample, max(12, int(LEAF * len(sample) / max(1, total))))
    sizes = np.bincount(tree.visits(sample, 1)[:, 0], minlength=tree.leaves) * (total / max(1, len(sample)))
    near = nearest_classes(reps, tree, sizes, calibrate(reps, tree, k, target, dims), k, dims)
    return _with_copies(reps, near, keyed, later, k)


def _with_copies(reps: DataFrame, near: DataFrame, keyed: DataFrame, later: DataFrame, k: int) -> DataFrame:
    """Set copies back in: of every class its k + 1 smallest ids can be neighbours, and every id asks."""
    from pyspark.sql import Window

    ranked = later.withColumn("r", F.row_number().over(Window.partitionBy("head").orderBy("id"))).filter(F.col("r") <= k)
    small = ranked.groupBy("head").agg(F.collect_list("id").alias("more"))
    flat = reps.select("id").join(near, "id", "left").select("id", F.explode_outer("near").alias("n"))
    found = flat.select("id", F.col("n.s").alias("s"), F.col("n.id").alias("head")).join(small, "head", "left")
    wide = found.filter("head is not null").select(
        "id", "s", F.explode(F.concat(F.array("head"), F.coalesce("more", F.array().cast("array<bigint>")))).alias("other")
    )
    own = small.select(F.col("head").alias("id"), F.lit(-1.0).alias("s"), F.explode(F.concat(F.array("head"), "more")).alias("other"))
    offers = wide.unionByName(own).groupBy("id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("s", "other"))), 1, k + 1).alias("o")
    )
    asking = reps.select("id", F.col("id").alias("head")).unionByName(later.select("id", "head"))
    joined = asking.join(offers.withColumnRenamed("id", "head"), "head")
    mine = F.slice(F.filter("o", lambda x: x["other"] != F.col("id")), 1, k)
    return joined.select("id", F.posexplode(mine).alias("rank", "x")).select("id", F.col("x.other").alias("neighbour"), (F.col("rank") + 1).alias("rank"))


def neighbour_pairs(points: DataFrame, k: int = 5, target: float = 0.97) -> DataFrame:
    """Distinct unordered pairs where one is among the k nearest of the other."""
    lists = neighbour_lists(points, k, target)
    return lists.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()

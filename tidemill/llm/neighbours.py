"""Approximate nearest neighbours: a hierarchical k-means tree searched best bin first.

The upper levels are fitted on the driver from a bounded sample; their leaves are regions. Every row
is put into its region, a region that holds many rows is dealt into parts of bounded size, and each
part grows the lower levels of the tree over its own rows, down to leaves of a few, so leaves grow in
number with the rows and a region of any size is spread over tasks. A query walks the upper levels
through a priority queue that always opens the nearest unopened node, and so names its regions
nearest first; in each part of these it walks the lower levels in the same way. How many regions it
visits, and which share of a part's leaves, is calibrated: a bounded draw of the queries themselves, which may lie
elsewhere than most rows, is answered by brute force over all rows, and visits widen until the wanted recall is
reached, by all of them together and nearly (EACH) by all but a few of them. Only vectors and ids
travel, a row once and a query once for each part that it visits; rows of a key stream through a task.

Rows of equal vectors beyond the k + 1 smallest ids can be nobody's nearest, so a very common vector
is cut to these before anything else.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common, wordhash

#: Rows that the upper levels are fitted on, at most, and numbers in them.
SAMPLE, NUMBERS = 12_000, 4_000_000
#: Queries that visits are calibrated with, at most.
PROBES = 400
#: What a single query should find of its nearest.
EACH = 0.9
BRANCH = 8
#: Rows of a leaf, at most, and of a part, about.
LEAF, PART = 4, 16_384
RECALL = 0.95
_FOUND = "query_id long, vec_id long, score double"
_SENT = "region int, part int, kind int, id long, v array<double>"


class Tree:
    """Node i has the children kids[i] with centres[i]; leaf j stands as -1 - j and holds the rows order[ends[j] : ends[j + 1]]."""

    def __init__(self, x: np.ndarray, most: int, seed: int = 3):
        """Split the rows of x by k-means until no more than `most` are together, or they are all equal."""
        self.centres, self.squares, self.kids, self._members = [], [], [], []
        self._grow(x, np.arange(len(x)), max(1, most), np.random.default_rng(seed))
        self.leaves = len(self._members)
        self.ends = np.concatenate(([0], np.cumsum([len(m) for m in self._members])))
        self.order = np.concatenate(self._members)
        del self._members

    def _grow(self, x: np.ndarray, own: np.ndarray, most: int, rng: np.random.Generator) -> int:
        parts = self._split(x[own], rng) if len(own) > most else []
        if len(parts) < 2:
            self._members.append(own)
            return -len(self._members)
        at = len(self.kids)
        centres = np.stack([x[own[p]].mean(0) for p in parts])
        self.centres.append(centres)
        self.squares.append((centres * centres).sum(1))
        self.kids.append([])
        self.kids[at] = [self._grow(x, own[p], most, rng) for p in parts]
        return at

    def _split(self, x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
        centres = np.unique(x[rng.choice(len(x), min(BRANCH, len(x)), replace=False)], axis=0)
        if len(centres) < 2:  # one vector very many times, perhaps among others
            centres = np.unique(x, axis=0)
            centres = centres[rng.choice(len(centres), min(BRANCH, len(centres)), replace=False)]
        of = nearest(x, centres)
        for _ in range(6 if len(centres) > 1 else 0):
            used = np.unique(of)
            centres = np.stack([x[of == j].mean(0) for j in used])
            of = nearest(x, centres)
        return [np.flatnonzero(of == j) for j in np.unique(of)]

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row, by the nearest centre at each level."""
        out = np.zeros(len(x), np.int64)
        stack = [(0 if self.kids else -1, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                of = nearest(x[rows], self.centres[node])
                stack += [(kid, rows[of == j]) for j, kid in enumerate(self.kids[node])]
        return out

    def visits(self, q: np.ndarray) -> Iterator[int]:
        """The leaves in the order in which best-bin-first traversal reaches them."""
        queue = [(0.0, 0 if self.kids else -1)]
        while queue:
            _, node = heapq.heappop(queue)
            if node < 0:
                yield -1 - node
                continue
            for d, kid in zip((self.squares[node] - 2 * (self.centres[node] @ q)).tolist(), self.kids[node]):
                heapq.heappush(queue, (d, kid))

    def rows(self, q: np.ndarray, share: float, least: int) -> np.ndarray:
        """The rows of the first leaves that q visits: so great a share of them, and as many as hold `least` rows."""
        most, held, got = int(np.ceil(share * self.leaves)), 0, []
        for n, leaf in enumerate(self.visits(q)):
            if n >= most and held >= least:
                break
            got.append(self.order[self.ends[leaf] : self.ends[leaf + 1]])
            held += len(got[-1])
        return np.concatenate(got)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * (x @ centres.T)).argmin(1)


def usable(v: Column) -> Column:
    """Neither null nor empty nor zero, and no component null or not finite."""
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(~bad & F.exists(v, lambda c: c != 0), F.lit(False))


def best(q: np.ndarray, qid: int, x: np.ndarray, xid: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row ids, distances) of the k nearest rows of q but itself, ties to the smaller id."""
    other = xid != qid
    x, xid = x[other], xid[other]
    d = np.sqrt(((x - q) ** 2).sum(1))
    if len(d) > 4 * k:
        near = d <= np.partition(d, k - 1)[k - 1]
        xid, d = xid[near], d[near]
    order = np.lexsort((xid, d))[:k]
    return xid[order], d[order]


def _arrays(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of a batch."""
    return batch.column("id").to_numpy(), batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _sent(region: np.ndarray, part: np.ndarray, kind: int, ids: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    ends = pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32())
    v = pa.ListArray.from_arrays(ends, pa.array(x.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(region, pa.int32()), pa.array(part, pa.int32()), pa.array(np.full(len(x), kind), pa.int32()), pa.array(ids), v], names=[c.split()[0] for c in _SENT.split(", ")])


def _regions(tree_bc, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        region, n = np.unique(tree_bc.value.leaf(_arrays(batch, width)[1]), return_counts=True)
        yield pa.RecordBatch.from_pydict({"region": pa.array(region, pa.int32()), "n": pa.array(n, pa.int64())})


def _dealt(tree_bc, width: int, parts: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their region and part."""
    for batch in batches:
        ids, x = _arrays(batch, width)
        region = tree_bc.value.leaf(x)
        yield _sent(region, (wordhash.mix(ids.astype(np.uint64)) % parts[region]).astype(np.int64), 0, ids, x)


def _asked(tree_bc, width: int, parts: np.ndarray, regions: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Queries with each part of the regions that they visit."""
    for batch in batches:
        ids, x = _arrays(batch, width)
        for lo in range(0, len(ids), 256):
            region, part, of = [], [], []
            for i, q in enumerate(x[lo : lo + 256], lo):
                for _, r in zip(range(regions), tree_bc.value.visits(q)):
                    region += [r] * int(parts[r])
                    part += range(int(parts[r]))
                    of += [i] * int(parts[r])
            yield _sent(np.array(region), np.array(part), 1, ids[of], x[of])


def _keyed(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], int, np.ndarray, np.ndarray]]:
    """(key, kind, ids, vectors) of runs of rows alike in key and kind."""
    for batch in batches:
        if len(batch):
            ids, x = _arrays(batch, width)
            key = np.stack([batch.column(c).to_numpy() for c in ("region", "part", "kind")])
            edge = np.flatnonzero((np.diff(key) != 0).any(0)) + 1
            for lo, hi in zip([0, *edge.tolist()], [*edge.tolist(), len(ids)]):
                yield (int(key[0, lo]), int(key[1, lo])), int(key[2, lo]), ids[lo:hi], x[lo:hi]


def _found(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=["query_id", "vec_id", "score"])


def _search(width: int, k: int, share: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The k nearest that each query finds in a part; a part's rows come before its queries."""
    at, held, tree = None, [], None
    for key, kind, ids, x in _keyed(width, batches):
        if kind == 0:
            if key != at:
                at, held, tree = key, [], None
            held.append((ids, x))
        elif key == at:
            if tree is None:
                own, rows = (np.concatenate(c) for c in zip(*held))
                tree, held = Tree(rows, LEAF), []
            out = []
            for i, q in zip(ids.tolist(), x):
                seen = tree.rows(q, share, k + 1)
                found, d = best(q, i, rows[seen], own[seen], k)
                out.append((np.full(len(found), i), found, d))
            yield _found(out)


def _places(width: int, wanted_bc, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(probe, region, share of the part's leaves that are visited until it is found) of each wanted neighbour of a probe."""
    wanted = wanted_bc.value
    at, held, out = None, [], []

    def place() -> None:
        ids, x = (np.concatenate(c) for c in zip(*held))
        here = {int(i): n for n, i in enumerate(ids.tolist())}
        if any(int(w) in here for _, near in wanted.values() for w in near):
            tree = Tree(x, LEAF)
            leaf = np.empty(len(x), np.int64)
            leaf[tree.order] = np.repeat(np.arange(tree.leaves), np.diff(tree.ends))
            for probe, (q, near) in wanted.items():
                if own := {int(leaf[here[w]]): 0 for w in near if w in here}:
                    many = count(1)
                    for seen in tree.visits(q):
                        n = next(many)
                        if seen in own:
                            own[seen] = n
                            if all(own.values()):
                                break
                    out.extend((probe, at[0], own[int(leaf[here[w]])] / tree.leaves) for w in near if w in here)

    for key, _, ids, x in _keyed(width, batches):
        if key != at:
            if held:
                place()
            at, held = key, []
        held.append((ids, x))
    if held:
        place()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["probe", "region", "share"])


def _scan(q_bc, width: int, k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Brute force of a few queries over this task's rows, k rows per query kept."""
    ids, qs = q_bc.value
    top = [(np.empty(0, np.int64), np.empty(0)) for _ in ids]
    for batch in batches:
        xid, x = _arrays(batch, width)
        for n, (i, q) in enumerate(zip(ids.tolist(), qs)):
            a, d = (np.concatenate(c) for c in zip(top[n], best(q, i, x, xid, k)))
            order = np.lexsort((a, d))[:k]
            top[n] = a[order], d[order]
    yield _found([(np.full(len(a), i), a, d) for i, (a, d) in zip(ids.tolist(), top)])


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact(rows: DataFrame, qid: np.ndarray, q: np.ndarray, width: int, k: int) -> DataFrame:
    """The k nearest of a bounded set of queries by a scan of all rows, in blocks."""
    bc = rows.sparkSession.sparkContext.broadcast((qid, q))
    return _ranked(rows.mapInArrow(partial(_scan, bc, width, k), _FOUND), k)


def _sampled(rows: DataFrame, total: int, most: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` rows of the smallest hash, by id; a hash is drawn so that few more than those are sorted."""
    share = min(1.0, 1.5 * most / max(total, 1) + 1e-9)
    drawn = rows.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    got = drawn.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id", "v").limit(most).collect()
    got.sort(key=lambda r: (r.id, r.v))
    return np.array([r.id for r in got], np.int64), np.array([r.v for r in got], np.float64)


def search(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding", recall: float = RECALL, opened: tuple[int, float] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance, in double precision): each query's k nearest found.

    `is_query` is a condition on the column `id`. Null, empty and zero vectors and those with a null
    or non-finite component take no part, nor do rows with a null id. Vectors of each width, however
    long, are searched among themselves, width by width. A query never finds its own id; it finds k
    rows wherever so many are; ties go to the smaller id, rows of one id and vector are one. An id with
    several vectors may be found by each, and asks for what is nearest to any. An empty table gives no rows; other columns, whatever their
    names, are not read. With `opened`, (regions, share of a part's leaves), nothing is calibrated.
    """
    spark = rows.sparkSession
    v = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v")).where(F.col("id").isNotNull() & usable(F.col("v")))
    widths = sorted(r.w for r in v.where(is_query).select(F.size("v").alias("w")).distinct().collect())
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for width in widths:
        own = v.where(F.size("v") == width)
        out = out.unionByName(_search_width(own, own.where(is_query), width, k, recall, opened))
    return out


def _search_width(v: DataFrame, queries: DataFrame, width: int, k: int, recall: float, opened: tuple[int, float] | None) -> DataFrame:
    spark = v.sparkSession
    alike = Window.partitionBy(F.xxhash64("v"), "v").orderBy("id")
    few = v.withColumn("n", F.dense_rank().over(alike)).where(F.col("n") <= k + 1)
    few = few.withColumn("n", F.lag("id").over(alike)).where(F.col("n").isNull() | (F.col("n") != F.col("id"))).drop("n")
    data = common.staged(few, "vectors")
    total = data.count()
    _, sample = _sampled(data, total, max(BRANCH, min(SAMPLE, NUMBERS // width)), 1)
    tree = Tree(sample, len(sample) * PART // total)
    tree_bc = spark.sparkContext.broadcast(tree)
    sizes = np.zeros(tree.leaves, np.int64)
    for r in data.mapInArrow(partial(_regions, tree_bc, width), "region int, n long").groupBy("region").agg(F.sum("n").alias("n")).collect():
        sizes[r.region] = r.n
    parts = np.maximum(1, -(-sizes // PART)).astype(np.uint64)
    dealt = data.mapInArrow(partial(_dealt, tree_bc, width, parts), _SENT)
    keys = int(parts.sum())
    if opened is None:
        opened = calibrate(data, queries, dealt, tree, keys, width, k, recall)
    asked = queries.distinct().mapInArrow(partial(_asked, tree_bc, width, parts, opened[0]), _SENT)
    both = dealt.union(asked).repartition(max(common.width(spark), keys), "region", "part").sortWithinPartitions("region", "part", "kind", "id", "v")
    return _ranked(both.mapInArrow(partial(_search, width, k, opened[1]), _FOUND).distinct(), k)


def _enough(cost: np.ndarray, probe: np.ndarray, recall: float) -> float:
    """The least cost by which neighbours of these costs are found: `recall` of all, and by that share of the probes EACH of its own."""
    def at(x: np.ndarray, share: float) -> float:
        return np.sort(x)[min(len(x) - 1, int(np.ceil(share * len(x))))]

    order = np.lexsort((cost, probe))
    first = np.flatnonzero(np.diff(probe[order], prepend=probe[order[0]] - 1))
    last = first + np.ceil(EACH * np.diff(np.append(first, len(probe)))).astype(int) - 1
    return float(max(at(cost, recall), at(cost[order][last], recall)))


def calibrate(data: DataFrame, queries: DataFrame, dealt: DataFrame, tree: Tree, keys: int, width: int, k: int, recall: float) -> tuple[int, float]:
    """The fewest regions, and of their parts' leaves the least share, by which a draw of the queries find `recall` of their k nearest; brute force over all rows is the truth."""
    spark = data.sparkSession
    qid, q = _sampled(queries, queries.count(), PROBES, 2)
    qid, kept = np.unique(qid, return_index=True)
    q = q[kept]
    wanted = {int(i): (x, set()) for i, x in zip(qid, q)}
    for r in exact(data, qid, q, width, k).collect():
        wanted[r.query_id][1].add(r.vec_id)
    near = {r for _, own in wanted.values() for r in own}
    if not near:
        return 1, 0.0
    both = dealt.repartition(max(common.width(spark), keys), "region", "part").sortWithinPartitions("region", "part", "id", "v")
    got = both.mapInArrow(partial(_places, width, spark.sparkContext.broadcast(wanted)), "probe long, region long, share double").collect()
    place = {i: {r: n for n, r in enumerate(tree.visits(x), 1)} for i, (x, _) in wanted.items()}
    probe, rank = np.array([r.probe for r in got]), np.array([place[r.probe][r.region] for r in got])
    share = np.array([r.share for r in got])
    # what is lost by regions and what by leaves add up, so each may lose half
    regions = int(_enough(rank, probe, recall**0.5))
    inside = rank <= regions
    return regions, _enough(share[inside], probe[inside], recall**0.5)


def op4_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest vectors of every hundredth vector of `embeddings`."""
    return search(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("id") % 100 == 0)

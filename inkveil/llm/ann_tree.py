"""Approximate nearest neighbours by a hierarchical k-means tree with best-bin-first search.

Method. A tree of k-means splits is fitted on a bounded sample (`sample` rows, the smallest by a hash of id and vector; its
size is a parameter and the only part that doesn't read all rows). Every valid vector of the table goes to one leaf.
Equal vectors are one index row with their k + 1 smallest ids (no query can need more, as ties go to smaller ids), gathered
per chunk first, so a vector that a third of all rows share is no hot row. A query's vector walks the tree with a
priority queue: nearest bins first, leaf after leaf. How many leaves are visited is calibrated: for `probes` query vectors
the exact neighbours are found in one scan of all rows, and the visits widen until `recall` of them lie in visited leaves.
A query whose leaves hold fewer than k + 1 ids goes on to further ones.
Leaves that follow each other are one parcel of about `block` distinct vectors. A query goes once to each parcel that has a leaf it visits, and is
held against the whole parcel; both sides of a parcel are cut into blocks, and a block of queries gives one partial result a query, so what is
shuffled grows with queries times parcels, not with queries times leaves. Partial results merge by query vector.
Products of whole blocks leave only vectors that may be among the nearest; their distances are computed exactly, in double precision on the original vectors.

Defined results. Vectors that are null, zero, or hold null or non-finite components, or whose length isn't the table's most frequent
one (of equally frequent ones the smallest), and rows without vec_id take no part. Repeated vec_ids are one id: a query gives its rows once for each of its vectors; an id is
listed once per vector. Fewer candidates than k: all of them. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import stash


class Tree(NamedTuple):
    centers: list[np.ndarray]  # of each inner node
    children: list[np.ndarray]  # node numbers, or -1 - leaf
    leaves: int


def fit(sample: np.ndarray, leaf_points: int, branching: int = 8, rounds: int = 8, seed: int = 7) -> Tree:
    """Splits the sample until a node has leaf_points or fewer points, or all of them are equal."""
    rng, centers, children, leaves = np.random.default_rng(seed), [], [], 0
    root: list = []
    todo = [(np.arange(len(sample)), root)]
    while todo:
        own, slot = todo.pop()
        parts = _split(sample[own], branching, rounds, rng) if len(own) > leaf_points else None
        if parts is None:
            slot.append(-1 - leaves)
            leaves += 1
            continue
        label, means = parts
        slot.append(len(centers))
        centers.append(means)
        below: list = [[] for _ in means]
        children.append(below)
        todo += [(own[label == c], below[c]) for c in range(len(means))]
    if not centers:
        return Tree([], [], 1)
    return Tree(centers, [np.array([b[0] for b in below], np.int64) for below in children], leaves)


def _squares(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)


def _split(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray] | None:
    distinct = np.unique(x, axis=0)
    if len(distinct) < 2:
        return None
    centers = distinct[rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
    for _ in range(rounds):
        label = _squares(x, centers).argmin(1)
        used = np.unique(label)
        centers = np.stack([x[label == c].mean(0) for c in used])
    label = _squares(x, centers).argmin(1)
    used, label = np.unique(label, return_inverse=True)
    return (label, centers[used]) if len(used) > 1 else None


def assign(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Leaf of each row, by the nearest center at every node."""
    leaf = np.zeros(len(x), np.int64)
    todo = [(0, np.arange(len(x)))] if tree.centers else []
    while todo:
        node, own = todo.pop()
        to = tree.children[node][_squares(x[own], tree.centers[node]).argmin(1)]
        for child in np.unique(to):
            part = own[to == child]
            if child < 0:
                leaf[part] = -1 - child
            else:
                todo.append((int(child), part))
    return leaf


def best_bins(tree: Tree, x: np.ndarray, visits: int, held: np.ndarray | None = None, least: int = 0) -> list[int]:
    """Leaves in the order of best-bin-first search: the nearest waiting bin's own branch is followed to a leaf each time.

    With `held`, the ids in each leaf, beyond `visits` until those visited hold `least` ids.
    """
    if not tree.centers:
        return [0]
    queue, out, ids = [(0.0, 0)], [], 0
    while queue and (len(out) < visits or (held is not None and ids < least)):
        _, node = heapq.heappop(queue)
        while node >= 0:
            far = ((tree.centers[node] - x) ** 2).sum(1)
            order = far.argsort()
            for c in order[1:]:
                heapq.heappush(queue, (float(far[c]), int(tree.children[node][c])))
            node = int(tree.children[node][order[0]])
        out.append(-1 - node)
        ids += 0 if held is None else int(held[-1 - node])
    return out


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the array column that are valid vectors, and their values as doubles."""
    lengths = np.diff(column.offsets.to_numpy())
    good = np.asarray(column.is_valid()) & (lengths == width)
    flat = column.flatten()  # of the rows that aren't null
    missing = np.asarray(flat.is_null())
    values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64) + 0.0
    lengths = np.where(np.asarray(column.is_valid()), lengths, 0)
    begin = np.cumsum(lengths) - lengths
    rows = np.flatnonzero(good)
    at = begin[rows][:, None] + np.arange(width)
    x = values[at] if len(rows) else np.zeros((0, width))
    ok = np.isfinite(x).all(1) & (x != 0).any(1) & ~missing[at].any(1) if len(rows) else np.zeros(0, bool)
    return rows[ok], x[ok]


def _vectors(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        batch = batch.filter(batch.column("vec_id").is_valid())
        if batch.num_rows:
            rows, x = matrix(batch.column("embedding"), width)
            if len(rows):
                yield batch.column("vec_id").to_numpy().astype(np.int64)[rows], x


def _nearest(ids: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, far))[:k]


ROWS = 256  # queries at a time against a block of vectors


def _partial(queries: np.ndarray, x: np.ndarray, ids: list[np.ndarray], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query row: the k nearest ids among the vectors x, each of which has several ids, and their distances."""
    with np.errstate(over="ignore"):
        norms, own = (x * x).sum(1), (queries * queries).sum(1)
    # Squares by products are off by so much at most; what may be nearest by them is measured exactly.
    off = (np.sqrt(own) + np.sqrt(norms.max())) ** 2 * (8 * (x.shape[1] + 8) * np.finfo(float).eps)
    pick = len(x) > k and np.isfinite(off).all()
    for start in range(0, len(queries), ROWS):
        some = queries[start : start + ROWS]
        if pick:
            rough = some @ x.T
            rough *= -2
            rough += norms
            limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * off[start : start + ROWS]
        for q, v in enumerate(some):
            near = np.flatnonzero(rough[q] <= limit[q]) if pick else np.arange(len(x))
            with np.errstate(over="ignore"):
                far = np.sqrt(((x[near] - v) ** 2).sum(1))
            if len(far) > k:
                least = far <= np.partition(far, k - 1)[k - 1]
                near, far = near[least], far[least]
            own_ids = np.concatenate([ids[i] for i in near])
            score = np.repeat(far, [len(ids[i]) for i in near])
            best = _nearest(own_ids, score, k)
            yield start + q, own_ids[best], score[best]


def parcels(sizes: np.ndarray, block: int) -> np.ndarray:
    """The parcel of each leaf: leaves in order of number, a new parcel where the vectors before fill another block."""
    before = np.cumsum(sizes) - sizes
    return np.unique(before // block, return_inverse=True)[1].astype(np.int64)


def _merged(parts: DataFrame, by: str, k: int) -> DataFrame:
    found = F.array_sort(F.flatten(F.collect_list("found")))
    return parts.groupBy(by).agg(F.slice(found, 1, k).alias("found"))


def drawn_rows(rows: DataFrame, sample: int) -> DataFrame:
    """The `sample` rows (vec_id, embedding) smallest by a hash of both; all, if there are fewer.

    A sorted limit sends so many rows of every partition to the driver. So only rows below a bound on the hash are sorted, not many more than are wanted.
    """
    order = [F.xxhash64("vec_id", "embedding"), F.col("vec_id"), F.col("embedding")]
    total, share = rows.count(), 0.0
    while share < 1 and total > sample:
        share = min(1.0, max(4 * share, 1.2 * (sample + 50) / total))
        below = rows.where(order[0] <= int(-(2**63) + share * (2**64 - 2**11)))
        found = below.count()
        if found >= sample:
            # Far too many: rows that are there many times, which one hash lets in or keeps out together.
            kept = below.dropDuplicates(["vec_id", "embedding"]) if found > 4 * sample else below
            return kept.orderBy(*order).limit(sample)
    return rows.orderBy(*order).limit(sample)


class Searcher:
    """The index of one table, ready for queries."""

    def __init__(self, table: DataFrame, k: int = 10, sample: int = 20_000, leaf_rows: int = 256, recall: float = 0.97, probes: int = 64, block: int = 16_384):
        self.table, self.k, self.recall, self.block = table.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding"), k, recall, block
        spark = table.sparkSession
        usable = self.table.where("embedding IS NOT NULL AND size(embedding) > 0 AND vec_id IS NOT NULL")
        common = usable.groupBy(F.size("embedding").alias("width")).count().orderBy(F.desc("count"), "width").first()
        self.width = common["width"] if common else 1
        drawn = [r["embedding"] for r in drawn_rows(usable.where(F.size("embedding") == self.width), sample).select("embedding").collect()]
        _, points = matrix(pa.array(drawn, pa.list_(pa.float64())), self.width)
        share = max(self.table.count(), 1) / max(len(drawn), 1)
        self.tree = fit(points, max(8, int(leaf_rows / share)))
        self.sent = spark.sparkContext.broadcast(self.tree)
        self.index = stash(self._index(), "ann-index")
        self.held = np.zeros(self.tree.leaves, np.int64)  # ids in each leaf, up to k + 1 of a vector
        distinct = np.zeros(self.tree.leaves, np.int64)
        for r in self.index.groupBy("leaf").agg(F.sum(F.size("ids")).alias("n"), F.count("*").alias("vectors")).collect():
            self.held[r["leaf"]], distinct[r["leaf"]] = r["n"], r["vectors"]
        self.parcel = parcels(distinct, block)
        self.probes = probes

    def _index(self) -> DataFrame:
        """(leaf, vector, ids): each distinct vector with its k + 1 smallest ids."""
        sent, width, k = self.sent, self.width, self.k

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, x in _vectors(batches, width):
                keys = np.ascontiguousarray(x).view(f"V{8 * width}").ravel()
                order = np.lexsort((ids, pd.factorize(np.array([v.tobytes() for v in keys], object))[0]))
                same = np.flatnonzero(np.concatenate([[True], keys[order][1:] != keys[order][:-1], [True]]))
                heads = order[same[:-1]]
                own = [np.unique(ids[order[a:b]])[: k + 1] for a, b in zip(same[:-1], same[1:], strict=True)]
                leaf = assign(sent.value, x[heads])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf), pa.array([keys[h].tobytes() for h in heads], pa.binary()), pa.array(own, pa.list_(pa.int64()))], ["leaf", "vector", "ids"]
                )

        parts = self.table.mapInArrow(run, "leaf long, vector binary, ids array<long>")
        ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
        return parts.groupBy("leaf", "vector").agg(ids.alias("ids"))

    def keys(self, queries: DataFrame) -> DataFrame:
        """(query_id, vector) of the valid query rows (vec_id, embedding)."""
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, x in _vectors(batches, width):
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([v.tobytes() for v in x], pa.binary())], ["query_id", "vector"])

        return queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(run, "query_id long, vector binary").distinct()

    def exact(self, vectors: list[bytes]) -> dict[bytes, list[tuple[float, int, int]]]:
        """(distance, id, leaf) of the k + 1 nearest of a few vectors, in one scan of the index."""
        width, k = self.width, self.k
        q = np.array([np.frombuffer(v) for v in vectors])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.frombuffer(b"".join(b.column("vector").to_pylist())).reshape(-1, width)
                leaf, ids = b.column("leaf").to_pylist(), b.column("ids").to_pylist()
                home = {i: own_leaf for own, own_leaf in zip(ids, leaf, strict=True) for i in own}
                for n, own, score in _partial(q, x, [np.array(i) for i in ids], k + 1):
                    found = [{"score": float(s), "vec_id": int(i), "leaf": home[int(i)]} for i, s in zip(own, score, strict=True)]
                    yield pa.RecordBatch.from_pylist([{"q": n, "found": found}], schema=pa.schema([("q", pa.int32()), ("found", pa.list_(pa.struct([("score", pa.float64()), ("vec_id", pa.int64()), ("leaf", pa.int64())])))]))

        parts = self.index.mapInArrow(run, "q int, found array<struct<score: double, vec_id: long, leaf: long>>")
        return {vectors[r["q"]]: [tuple(x) for x in r["found"]] for r in _merged(parts, "q", k + 1).collect()}

    def calibrate(self, keys: DataFrame) -> int:
        """Leaves to visit so that `recall` of the probes' true neighbours lie in them."""
        drawn = [bytes(r["vector"]) for r in keys.select("vector").distinct().orderBy(F.xxhash64("vector")).limit(self.probes).collect()]
        if not drawn or not self.tree.centers:
            return 1
        truth, ranks = self.exact(drawn), []
        for v, found in truth.items():
            place = {leaf: i for i, leaf in enumerate(best_bins(self.tree, np.frombuffer(v), self.tree.leaves))}
            ranks += [place[leaf] for _, _, leaf in found[1:]]  # the first is the probe itself
        visits = 1
        while ranks and np.mean(np.array(ranks) < visits) < self.recall:
            visits = min(self.tree.leaves, visits + max(1, visits // 4))
        return visits

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, rank, vec_id, score) for query rows (vec_id, embedding)."""
        width, k, block = self.width, self.k, self.block
        sent = queries.sparkSession.sparkContext.broadcast((self.tree, self.held, self.parcel))
        keys = stash(self.keys(queries), "ann-queries")
        visits = self.visits = self.calibrate(keys)
        # A query's id may stand at several vectors, none of which counts for it: so many more are looked for.
        most = keys.groupBy("query_id").agg(F.count_distinct("vector").alias("n")).agg(F.max("n")).first()[0]
        wanted = k + (most or 1)

        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, held, parcel = sent.value
            for b in batches:
                vectors = b.column("vector").to_pylist()
                found = [np.unique(parcel[best_bins(tree, np.frombuffer(v), visits, held, wanted)]) for v in vectors]
                yield pa.RecordBatch.from_arrays([pa.array(vectors, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["vector", "parcels"])

        def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                parcel = sent.value[2][b.column("leaf").to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array(parcel), b.column("vector"), b.column("ids")], ["parcel", "vector", "ids"])

        spread_out = max(queries.sparkSession.sparkContext.defaultParallelism, 1)  # the walk is the work of the few rows of queries
        walked = keys.select("vector").distinct().repartition(spread_out, "vector").mapInArrow(walk, "vector binary, parcels array<long>")
        walked = stash(walked.select("vector", F.explode("parcels").alias("parcel")), "ann-visits")
        index = self.index.mapInArrow(placed, "parcel long, vector binary, ids array<long>")
        # Both sides of a parcel are cut into blocks; each block of queries meets each block of vectors.
        pieces = lambda df, name: df.groupBy("parcel").agg(F.ceil(F.count("*") / block).cast("int").alias(name))
        sizes = pieces(index, "v_blocks").join(pieces(walked, "q_blocks"), "parcel")
        spread = lambda df, own, other, a, b: (
            df.join(sizes, "parcel").withColumn(a, F.pmod(F.xxhash64("vector"), F.col(own)).cast("int")).withColumn(b, F.explode(F.sequence(F.lit(0), F.col(other) - 1))).drop("v_blocks", "q_blocks")
        )
        left, right = spread(walked, "q_blocks", "v_blocks", "qb", "vb"), spread(index, "v_blocks", "q_blocks", "vb", "qb")

        def meet(q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
            if not len(q) or not len(v):
                return pd.DataFrame({"vector": [], "found": []})
            x, asked = (np.frombuffer(b"".join(d["vector"])).reshape(-1, width) for d in (v, q))
            found = [[{"score": float(s), "vec_id": int(i)} for i, s in zip(own, score, strict=True)] for _, own, score in _partial(asked, x, list(v["ids"]), wanted)]
            return pd.DataFrame({"vector": q["vector"], "found": found})

        group = ["parcel", "qb", "vb"]
        parts = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInPandas(meet, "vector binary, found array<struct<score: double, vec_id: long>>")
        merged = _merged(parts, "vector", wanted)
        mine = keys.join(merged, "vector").withColumn("found", F.slice(F.filter("found", lambda f: f["vec_id"] != F.col("query_id")), 1, k))
        out = mine.select("query_id", F.posexplode("found").alias("at", "f"))
        return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("f.vec_id").alias("vec_id"), F.col("f.score").alias("score"))

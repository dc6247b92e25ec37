"""Approximate nearest neighbours by an inverted multi-index.

The two halves of each vector are quantised separately by k-means codebooks, fitted on at most ``sample`` vectors; a
cell is a pair of centroids.  For a query, pairs are visited from the largest sum of the halves' inner products on,
with a heap, until their cells hold ``visit`` vectors; the entries of visited cells are reranked by the exact measure.

``visit_share`` makes the count visited a share of all: vectors without clusters need one (see the README), others
keep it at 0.

Equal vectors are one entry with its smallest ids (k + 1 are enough for any answer), and equal queries are searched once,
so a vector that a third of all rows share costs as much as any other.  Cells are dealt to
parts of about ``block`` entries, a crowded cell to many by a hash of the vector, and queries to blocks of about
``block_queries``; a task has one part and one block, so neither grows with the table, and keeps its best k + 1 ids for each of
its queries before results meet.  Codebooks (``2 * centroids`` half vectors) and cell sizes (``centroids ** 2`` at most)
are bounded and go to the tasks with the code.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null or non-finite
components take no part, neither as queries nor as candidates; ties go to the smaller id; rows with a null id are
candidates of no one and no queries; with fewer candidates than k all are returned; rows that share an id count as one
row each, but a query never finds its own id; of the tables' columns only the id and the vector are read, so others cannot
clash.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)
        n = np.bincount(own, minlength=len(c))
        for j in range(x.shape[1]):
            s = np.bincount(own, x[:, j], len(c))
            c[n > 0, j] = s[n > 0] / n[n > 0]
    return c


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(x @ c.T - 0.5 * (c * c).sum(axis=1), axis=1)


def visited(q: np.ndarray, first: np.ndarray, second: np.ndarray, sizes: np.ndarray, visit: int) -> list[int]:
    """Cells in the order of their centroids' summed inner products with the query, until they hold ``visit`` entries."""
    h = len(q) // 2
    a, b = first @ q[:h], second @ q[h:]
    ia, ib = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    a, b = a[ia], b[ib]
    heap, seen, out, held = [(-(a[0] + b[0]), 0, 0)], {(0, 0)}, [], 0
    while heap and held < visit:
        _, i, j = heapq.heappop(heap)
        cell = int(ia[i]) * len(second) + int(ib[j])
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(a[x] + b[y]), x, y))
    return out


def layout(sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The first part of each cell and its count of parts: small cells share a part of about ``block`` entries, a crowded
    cell has parts of its own."""
    part, parts = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // block))
    at, held = 0, 0
    for cell in np.flatnonzero(sizes):
        n = int(sizes[cell])
        if held and held + n > block:
            at, held = at + 1, 0
        part[cell] = at
        held += n
        if parts[cell] > 1:
            at, held = at + int(parts[cell]), 0
    return part, parts


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of one query with rows, each summed alike wherever it is computed."""
    return (v * q).sum(axis=1)


def _clean(width: int):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, data = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if i is None or not v or len(v) != width or None in v:
                    continue
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    data.append((x + 0.0).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], ["id", "v"])

    return emit


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 20, centroids: int = 64, visit: int = 200, visit_share: float = 0.0, sample: int = 20_000, block: int = 2000, block_queries: int = 4000, id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors nearest to each query, by inner product."""
    lengths = vectors.groupBy(F.size(vector_col).alias("n")).count().where("n > 0").orderBy(F.desc("count"), "n").first()
    spark = vectors.sparkSession
    if lengths is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = lengths["n"]
    half = width // 2
    read = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).mapInArrow(_clean(width), "id long, v binary")
    keyed = lambda df: df.withColumn("key", F.xxhash64("v"))

    # Distinct vectors with their k + 1 smallest ids; Spark cuts each to its first rows before the shuffle.
    firsts = Window.partitionBy("v").orderBy("id")
    entries = cut(keyed(read(vectors)).withColumn("n", F.row_number().over(firsts)).where(F.col("n") <= k + 1).groupBy("key", "v").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    share = -(-entries.count() // sample)
    taken = entries.where(F.pmod(F.xxhash64("key"), F.lit(max(1, share))) == 0).limit(sample).select("v").toArrow()
    if not taken.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = _matrix(taken.column(0).combine_chunks(), width)
    first, second = kmeans(x[:, :half], centroids), kmeans(x[:, half:], centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column("v"), width)
            cell = nearest_centroid(v[:, :half], first) * len(second) + nearest_centroid(v[:, half:], second)
            yield batch.append_column("cell", pa.array(cell.astype(np.int64)))

    placed = entries.mapInArrow(assign, "key long, v binary, ids array<long>, cell long")
    sizes = np.zeros(len(first) * len(second), np.int64)
    for r in placed.groupBy("cell").count().collect():
        sizes[r["cell"]] = r["count"]
    visit = max(visit, int(visit_share * sizes.sum()))
    part, parts = layout(sizes, block)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, key = np.asarray(batch.column("cell")), np.asarray(batch.column("key"))
            yield batch.append_column("part", pa.array(part[cell] + np.mod(key, parts[cell])))

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, to, cells = [], [], []
            for i, q in enumerate(_matrix(batch.column("v"), width)):
                found = np.array(visited(q, first, second, sizes, visit), np.int64)
                found = np.repeat(found, parts[found])
                begins = np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1])))
                at = part[found] + np.arange(len(found)) - np.repeat(begins, np.diff(np.append(begins, len(found))))
                order = np.argsort(at, kind="stable")
                for own in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                    rows.append(i)
                    to.append(int(at[own[0]]))
                    cells.append(found[own].astype(np.int32))
            out = batch.take(pa.array(rows, pa.int64()))
            yield out.append_column("cells", pa.array(cells, pa.list_(pa.int32()))).append_column("part", pa.array(to, pa.int64()))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        """The best k + 1 ids of one part for each of its queries."""
        keys, more, ids, scores = [], [], [], []
        if left.num_rows and right.num_rows:
            v, cell = _matrix(right.column("v").combine_chunks(), width), np.asarray(right.column("cell"))
            own = right.column("ids").to_pylist()
            lowest = np.array([x[0] for x in own])
            open_ = np.zeros(len(sizes), bool)
            for key, check, q, cells in zip(left.column("key").to_pylist(), left.column("check").to_pylist(), _matrix(left.column("v").combine_chunks(), width), left.column("cells").to_pylist()):
                open_[cells] = True
                at = np.flatnonzero(open_[cell])
                open_[cells] = False
                if len(at) > 4 * k:
                    rough = v[at] @ q
                    at = at[rough >= np.partition(rough, -k - 1)[-k - 1] - 1e-9 * np.abs(rough).max()]
                s = exact(q, v[at])
                top = np.lexsort((lowest[at], -s))[: k + 1]
                rows = sorted((-x, i) for x, a in zip(s[top].tolist(), at[top].tolist()) for i in own[a])[: k + 1]
                keys.append(key)
                more.append(check)
                ids.append([i for _, i in rows])
                scores.append([-x for x, _ in rows])
        return pa.table([pa.array(keys, pa.int64()), pa.array(more, pa.int32()), pa.array(ids, pa.list_(pa.int64())), pa.array(scores, pa.list_(pa.float64()))], ["query", "check", "ids", "scores"])

    def merge(table: pa.Table) -> pa.Table:
        """The best k + 1 ids of a query vector."""
        rows = sorted((-s, i) for ids, scores in zip(table.column("ids").to_pylist(), table.column("scores").to_pylist()) for i, s in zip(ids, scores))[: k + 1]
        return pa.table([table.column("query")[:1], table.column("check")[:1], pa.array([[i for _, i in rows]], pa.list_(pa.int64())), pa.array([[-s for s, _ in rows]], pa.list_(pa.float64()))], ["query", "check", "ids", "scores"])

    # Two hashes stand for a query's vector where results meet.
    asked = cut(keyed(read(queries)).withColumn("check", F.hash("v")))
    distinct = asked.select("key", "check", "v").distinct()
    blocks = max(1, -(-distinct.count() // block_queries))
    dealt = placed.mapInArrow(deal, "key long, v binary, ids array<long>, cell long, part long").withColumn("of", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # As many tasks as there are pairs of a part and a block need.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks * (int(part.max()) + 1) // 4)
    found = (
        distinct.withColumn("of", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
        .repartition(max(blocks, spark.sparkContext.defaultParallelism))
        .mapInArrow(visits, "key long, check int, v binary, of int, cells array<int>, part long")
        .repartition(tasks, "part", "of")
        .groupBy("part", "of")
        .cogroup(dealt.repartition(tasks, "part", "of").groupBy("part", "of"))
        .applyInArrow(best, "query long, check int, ids array<long>, scores array<double>")
        .groupBy("query", "check")
        .applyInArrow(merge, "query long, check int, ids array<long>, scores array<double>")
    )
    pairs = asked.select("id", "key", F.col("check").alias("own")).join(found, (F.col("key") == F.col("query")) & (F.col("own") == F.col("check")))
    others = F.slice(F.filter(F.arrays_zip("ids", "scores"), lambda r: r["ids"] != F.col("id")), 1, k)
    return pairs.select(F.col("id").alias("query_id"), F.posexplode(others).alias("rank", "r")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("r.ids").alias("vec_id"), F.col("r.scores").alias("score"))

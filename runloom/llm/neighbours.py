"""Approximate nearest neighbours by a permutation index.

Every vector is represented by its nearest pivots in order. The rows of a partition form shards; a shard holds, for each
pivot, the file of the vectors that have it among their ``indexed`` nearest, with the place it has there. A query walks the
files of its own ``searched`` nearest pivots and adds up, for each vector, by how much the places differ (footrule distance;
a pivot that a vector doesn't have counts as the farthest). Pivots tell of directions only, so the distance gives an
estimate of the cosine, and times the vector's length one of the inner product. The vectors with the largest estimate are
compared with the query exactly, and the best of all shards are merged.

The permutations are computed once and stored in the shared folder; shards and queries are read from there. Queries go to
the shards in blocks of bounded size; a block's result is stored before the next block is fetched. The pivots are a bounded
sample of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Sent, stored

#: Vectors of a shard, and queries of a block.
SHARD_ROWS, BLOCK_ROWS = 4096, 16384
#: Queries of a block from which a shard learns what cosine a distance stands for, and by how many standard deviations the
#: estimate is raised: a long vector may be among the best although its direction is a middling one.
LEARNED, RAISED = 32, 2.0


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector of doubles) of the rows that take part: an id, and a vector that is not zero and all finite."""
    value = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), value.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(finite & F.exists("vector", lambda x: x != 0))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """The k nearest pivots of each row (largest cosine), nearest first; equal ones in order of the pivots."""
    length = np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    return np.argsort(-np.round((vectors / length) @ pivots.T, 12), axis=1, kind="stable")[:, :k].astype(np.int32)


class Shard:
    """The pivot files of some vectors."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, near: np.ndarray, pivots: int) -> None:
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids, self.vectors, near = rows[order], ids[order], vectors[order], near[order]
        posted = np.argsort(near.ravel(), kind="stable")
        self.row, self.place = posted // near.shape[1], posted % near.shape[1]
        self.file = np.searchsorted(near.ravel()[posted], np.arange(pivots + 1))
        self.indexed = near.shape[1]

    def _saved(self, near: np.ndarray) -> np.ndarray:
        """What each vector's distance from a query is less than the largest."""
        saved = np.zeros(len(self.ids), np.int32)
        for place, pivot in enumerate(near):
            own = slice(self.file[pivot], self.file[pivot + 1])
            saved[self.row[own]] += self.indexed - np.abs(self.place[own] - place)
        return saved

    def _cosines(self, own: np.ndarray, queries: np.ndarray, near: np.ndarray, lengths: np.ndarray) -> tuple[float, float]:
        """Cosine that nothing saved stands for (raised), and what each unit saved adds: the line fitted to some queries."""
        x, y = [], []
        for q in range(0, len(own), max(1, len(own) // LEARNED)):
            others = self.rows != own[q]
            x.append(self._saved(near[q])[others].astype(np.float64))
            y.append((exact(self.vectors, queries[q]) / (lengths * np.linalg.norm(queries[q])))[others])
        x, y = np.concatenate(x or [np.zeros(0)]), np.concatenate(y or [np.zeros(0)])
        spread = x.var() if len(x) else 0.0
        slope = max(((x - x.mean()) * (y - y.mean())).mean() / spread, 0.0) if spread > 0 else 0.0
        rest = y - slope * x
        return (float(rest.mean() + RAISED * rest.std()), float(slope)) if len(x) else (1.0, 0.0)

    def search(self, own: np.ndarray, own_ids: np.ndarray, queries: np.ndarray, near: np.ndarray, rerank: float, k: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(row and id of the query, ids, scores): the k best of the candidates of each query, its own row left out."""
        some = min(len(self.ids), max(int(rerank * len(self.ids)), 4 * k))
        if some < len(self.ids):
            lengths = np.linalg.norm(self.vectors, axis=1)
            least, slope = self._cosines(own, queries, near, lengths)
        for q in range(len(own)):
            if some < len(self.ids):
                estimate = lengths * (least + slope * self._saved(near[q]))
                candidates = np.sort(np.argpartition(-estimate, some - 1)[:some])
            else:
                candidates = np.arange(len(self.ids))
            candidates = candidates[self.rows[candidates] != own[q]]
            score = exact(self.vectors[candidates], queries[q])
            best = np.lexsort((self.ids[candidates], -score))[:k]
            yield np.full(len(best), own[q]), np.full(len(best), own_ids[q]), self.ids[candidates[best]], score[best]


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed in the same order for every row."""
    return np.einsum("ij,j->i", vectors, query)


def _index(points: Sent, dims: int, indexed: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            vectors = matrix(batch.column("vector"), dims)
            near = nearest_pivots(vectors, points.value, indexed)
            ends = pa.array(np.arange(len(near) + 1) * near.shape[1], pa.int32())
            posted = pa.ListArray.from_arrays(ends, pa.array(near.ravel().astype(np.int16)))
            yield pa.record_batch([pa.array(at + np.arange(batch.num_rows)), batch.column("vec_id"), batch.column("vector"), posted], names=["row", "vec_id", "vector", "near"])
            at += batch.num_rows

    return task


def permutation_index(rows: DataFrame, dims: int, pivots: int = 256, indexed: int = 64, seed: int = 5) -> DataFrame:
    """(row, vec_id, vector, near): each vector with its ``indexed`` nearest pivots in order, stored; ``row`` numbers it.

    ``pivots`` rows, by a hash of vec_id, are the pivots; they are all that the index is fitted on.
    """
    drawn = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id", "vector").limit(pivots).select("vector").toArrow()
    points = matrix(drawn["vector"], dims)
    points = points / np.linalg.norm(points, axis=1, keepdims=True)
    made = rows.mapInArrow(_index(Sent(rows.sparkSession, points), dims, indexed), "row bigint, vec_id bigint, vector array<double>, near array<smallint>")
    return stored(made)


def _search(block: Sent, dims: int, pivots: int, rerank: float, k: int):
    names = ["row", "query_id", "vec_id", "score"]

    def found(parts: list) -> Iterator[pa.RecordBatch]:
        shard = Shard(*(np.concatenate(x) for x in zip(*parts, strict=True)), pivots)
        out, rows = ([], [], [], []), 0
        for result in shard.search(*block.value, rerank, k):
            for x, v in zip(out, result, strict=True):
                x.append(v)
            rows += len(result[0])
            if rows > 1 << 16:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in out], names=names)
                out, rows = ([], [], [], []), 0
        if rows:
            yield pa.record_batch([pa.array(np.concatenate(x)) for x in out], names=names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, rows = [], 0
        for batch in batches:
            parts.append((batch.column("row").to_numpy(), batch.column("vec_id").to_numpy(), matrix(batch.column("vector"), dims), permutations(batch.column("near"), batch.num_rows)))
            rows += batch.num_rows
            if rows >= SHARD_ROWS:
                yield from found(parts)
                parts, rows = [], 0
        if rows:
            yield from found(parts)

    return task


def permutations(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(rows, -1)


def nearest(
    vectors: DataFrame, every: int = 20, k: int = 20, pivots: int = 256, indexed: int = 64, searched: int = 32, rerank: float = 0.25, seed: int = 5
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of all other rows for each row whose vec_id is divisible by ``every``.

    Takes vec_id and embedding; other columns are ignored. Nearness is the inner product in double precision, ties go to
    the smaller vec_id; vectors may have any lengths. Vectors that are null, zero or hold null or non-finite components, rows
    without vec_id, and vectors of another length than the most frequent take no part. Rows that repeat a vec_id are
    candidates of their own, and queries of their own too, each with ranks from 1. ``pivots`` bounds the sample that the
    index is fitted on, ``rerank`` is the share of a shard that is compared exactly. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = usable(vectors)
    common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dims = common.n
    index = permutation_index(rows.where(F.size("vector") == dims), dims, pivots, indexed, seed)
    wanted = index.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-wanted.count() // BLOCK_ROWS))
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    found = None
    for b in range(blocks):
        block = wanted.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).toArrow()
        near = permutations(block["near"], block.num_rows)[:, :searched] if block.num_rows else np.zeros((0, 1), np.int32)
        sent = Sent(spark, (block["row"].to_numpy(), block["vec_id"].to_numpy(), matrix(block["vector"], dims), near))
        part = index.mapInArrow(_search(sent, dims, pivots, rerank, k), "row bigint, query_id bigint, vec_id bigint, score double")
        part = stored(part.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))
        sent.sent.unpersist()
        found = part if found is None else found.unionByName(part)
    return found

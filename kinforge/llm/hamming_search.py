"""Operator 10: exact top-k search of binary codes by incremental multi-index hashing.

A vector's code has one bit for each dimension, set where the value is positive. Codes are cut into segments, each indexed by its value. A query
grows the radius of its segment searches one segment at a time: with radius r done in all m segments and r + 1 in the first j, every code
within m * (r + 1) + j - 1 bits has been met. It stops once the k-th verified distance is at most that bound, so the answer is exact, ties included.

All rows are indexed: each task indexes slices of at most `slice_rows` rows and answers a block of queries on it; the best k of all slices are
merged. Queries (ids divisible by `every`) come in blocks of at most `block` codes, so what is broadcast at a time has a fixed bound; a search
touches only the rows that its probes meet, never the whole slice.

Defined results: rows with a null or empty vector or a null id have no code and take no part; missing or null dimensions are unset bits;
a row is no neighbour of its own id; equal distances rank by id; repeated rows count once. With fewer than k others, all are returned. Other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, EVERY = 10, 100
SEGMENT_BITS = 16


def codes(vectors: DataFrame, id_column: str, column: str, dims: int) -> DataFrame:
    """(id, code): code as binary of ceil(dims / 16) * 2 bytes, bit i of byte i // 8 (highest first) for dimension i."""
    width = -(-dims // SEGMENT_BITS) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            offs = lists.offsets.to_numpy().astype(np.int64)
            values = np.nan_to_num(lists.values.to_numpy(zero_copy_only=False).astype(np.float64))
            bits = np.zeros((len(lists), width * 8), np.uint8)
            size = np.minimum(np.diff(offs), width * 8)
            row = np.repeat(np.arange(len(lists)), size)
            col = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            bits[row, col] = values[np.repeat(offs[:-1], size) + col] > 0
            packed = np.packbits(bits, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in packed], pa.binary())], names=["id", "code"])

    usable = vectors.filter(F.col(id_column).isNotNull() & F.col(column).isNotNull() & (F.size(column) > 0))
    return usable.select(F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).mapInArrow(run, "id long, code binary").distinct()


class Slice:
    """The segment indexes of some codes."""

    def __init__(self, ids: np.ndarray, packed: np.ndarray):
        self.ids, self.packed = ids, packed
        self.parts = packed.view(">u2").astype(np.int64)
        self.m = self.parts.shape[1]
        self.order = [np.argsort(self.parts[:, s], kind="stable") for s in range(self.m)]
        self.first = [np.searchsorted(self.parts[o, s], np.arange((1 << SEGMENT_BITS) + 1)) for s, o in enumerate(self.order)]
        self.by_id = np.argsort(ids, kind="stable")
        self.sorted_ids = ids[self.by_id]
        self.seen, self.turn = np.zeros(len(ids), np.int64), 0  # a row counts as seen in the query whose turn it names
        self.masks = [np.array([sum(1 << b for b in c) for c in combinations(range(SEGMENT_BITS), r)] or [0], np.int64) for r in range(SEGMENT_BITS + 1)]

    def search(self, own: int, code: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of the k nearest other ids by (distance, id)."""
        self.turn += 1
        seen, turn = self.seen, self.turn
        seen[self.by_id[np.searchsorted(self.sorted_ids, own, "left") : np.searchsorted(self.sorted_ids, own, "right")]] = turn
        near_ids, near_d = np.zeros(0, np.int64), np.zeros(0, np.int64)
        parts = code.view(">u2").astype(np.int64)
        for radius in range(SEGMENT_BITS + 1):
            for s in range(self.m):
                values = parts[s] ^ self.masks[radius]
                low, high = self.first[s][values], self.first[s][values + 1]
                size = high - low
                if size.any():
                    at = np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())
                    rows = self.order[s][at]
                    rows = rows[seen[rows] != turn]
                    if len(rows):
                        seen[rows] = turn
                        d = np.bitwise_count(self.packed[rows] ^ code).sum(1, dtype=np.int64)
                        near_ids, near_d = np.append(near_ids, self.ids[rows]), np.append(near_d, d)
                        best = np.lexsort((near_ids, near_d))[:k]
                        near_ids, near_d = near_ids[best], near_d[best]
                covered = self.m * radius + s  # every code within this many bits has been met
                if len(near_d) == k and near_d[-1] <= covered:
                    return near_ids, near_d
        return near_ids, near_d


def nearest(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", k: int = K, every: int = EVERY, block: int = 65_536, slice_rows: int = 200_000) -> DataFrame:
    """query_id, rank (from 1), neighbor_id, distance."""
    spark = vectors.sparkSession
    dims = vectors.agg(F.max(F.size(column))).first()[0] or 0
    schema = "query_id long, neighbor_id long, distance long"
    if dims <= 0:
        return spark.createDataFrame([], "query_id long, rank int, neighbor_id long, distance long")
    coded = codes(vectors, id_column, column, dims)

    def answers(queries) -> DataFrame:
        shared = spark.sparkContext.broadcast(queries)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def flush() -> pa.RecordBatch:
                index, out = Slice(np.concatenate(ids), np.concatenate(rows)), [[], [], []]
                for own, code in shared.value:
                    found, d = index.search(own, np.frombuffer(code, np.uint8), k)
                    for values, v in zip(out, (np.full(len(found), own), found, d), strict=True):
                        values.append(v)
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in out], names=["query_id", "neighbor_id", "distance"])

            ids, rows, held = [], [], 0
            for batch in batches:
                if batch.num_rows:
                    ids.append(batch.column(0).to_numpy())
                    rows.append(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1))
                    held += batch.num_rows
                if held >= slice_rows:
                    yield flush()
                    ids, rows, held = [], [], 0
            if held:
                yield flush()

        return coded.mapInArrow(run, schema)

    results, queries = [], []
    for r in coded.filter(F.col("id") % every == 0).toLocalIterator():
        queries.append((r["id"], bytes(r["code"])))
        if len(queries) == block:
            results.append(answers(queries))
            queries = []
    if queries or not results:
        results.append(answers(queries) if queries else spark.createDataFrame([], schema))
    every_block = results[0]
    for r in results[1:]:
        every_block = every_block.union(r)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbor_id"))
    return every_block.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "neighbor_id", "distance")


def op10_search(vectors: DataFrame) -> DataFrame:
    return nearest(vectors)


#: Brute force over all rows, for vectors of 64 dimensions.
SQL = """
WITH c AS (SELECT DISTINCT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0),
p AS (SELECT q.id AS query_id, n.id AS neighbor_id,
      CAST(len(q.b) - list_dot_product(list_transform(q.b, lambda x: CAST(2 * x - 1 AS DOUBLE)), list_transform(n.b, lambda x: CAST(2 * x - 1 AS DOUBLE))) AS BIGINT) // 2 AS distance
      FROM c q JOIN c n ON q.id <> n.id WHERE q.id % 100 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10
"""

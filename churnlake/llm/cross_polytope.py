"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is turned by fast pseudo-random rotations (three rounds of random signs and a Hadamard
transform) and assigned to the nearest of the 2d signed axes. ``TABLES`` rotations give as many tables. A
query looks into the buckets of the ``PROBES`` axes that are nearest to it, in every table, and the vectors
found there are ranked by their exact distance in double precision.

Vectors and query probes meet by (table, bucket, part). A bucket is cut into parts of about ``PART_ROWS``
vectors, however large it is (a vector that a third of all rows share makes a hot bucket), and its queries
into blocks of about ``PART_QUERIES``; each block goes to each part. Within such a cell the queries come first and vectors stream past them in
blocks; each query keeps its best k there, so a part sends k rows for each query, and a query's best k
over all parts are its answer. A query that meets fewer than k vectors is answered exactly, against all
rows, in blocks of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnlake.llm.common import pick
from churnlake.session import slice_count, staged

TABLES, PROBES = 8, 16
PART_ROWS, PART_QUERIES = 20_000, 20_000
BLOCK_QUERIES = 2_000
FOUND = "query_id long, vec_id long, distance double"


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """Pseudo-random rotation number ``table`` of rows, padded to a power of two."""
    size = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, size - x.shape[1])))
    signs = np.random.default_rng(1000 + table).choice([-1.0, 1.0], (3, size))
    for sign in signs:
        x, width = x * sign, 1
        while width < size:
            pairs = x.reshape(len(x), -1, 2, width)
            x = np.concatenate([pairs[:, :, :1] + pairs[:, :, 1:], pairs[:, :, :1] - pairs[:, :, 1:]], 2).reshape(len(x), size)
            width *= 2
        x = x / math.sqrt(size)
    return x


def nearest_axes(x: np.ndarray, table: int, probes: int) -> np.ndarray:
    """The ``probes`` nearest signed axes of each unit row, nearest first: 2 * axis, or 2 * axis + 1 for minus."""
    turned = rotate(x, table)
    sides = np.stack([turned, -turned], 2).reshape(len(x), -1)
    probes = min(probes, sides.shape[1])
    best = np.argpartition(-sides, probes - 1, axis=1)[:, :probes]
    order = np.argsort(-np.take_along_axis(sides, best, 1), axis=1, kind="stable")
    return np.take_along_axis(best, order, 1)


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    rows = pick(vectors, vec_id=id_col, vector=vector_col)
    rows = rows.select(rows.vec_id.cast("long").alias("vec_id"), rows.vector.cast("array<double>").alias("vector"))
    finite = "forall(vector, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < double('infinity')) AND exists(vector, v -> v <> 0)"
    return rows.where(f"vec_id IS NOT NULL AND vector IS NOT NULL AND {finite}")


def _hashed(rows: DataFrame, tables: int, probes: int) -> DataFrame:
    """vec_id, vector, table, bucket: one row for each table and probe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                x = _matrix(part.column(1))
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                for table in range(tables):
                    axes = nearest_axes(x, table, probes)
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0),
                            part.column(1),
                            pa.array(np.full(len(x), table), pa.int32()),
                            pa.FixedSizeListArray.from_arrays(pa.array(axes.ravel(), pa.int32()), axes.shape[1]).cast(pa.list_(pa.int32())),
                        ],
                        ["vec_id", "vector", "table", "buckets"],
                    )

    hashed = rows.mapInArrow(run, "vec_id long, vector array<double>, table int, buckets array<int>")
    return hashed.select("vec_id", "vector", "table", F.explode("buckets").alias("bucket"))


def _keep_best(best: dict, ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int) -> None:
    """Merge a block of vectors into each query's best k (distance, id)."""
    rough = (queries**2).sum(1)[:, None] - 2 * queries @ vectors.T + (vectors**2).sum(1)[None, :]
    rough[query_ids[:, None] == ids[None, :]] = np.inf
    for i, query_id in enumerate(query_ids.tolist()):
        row = rough[i]
        if len(row) > 4 * k:  # all that may be among the k nearest once distances are exact
            edge = np.partition(row, k)[k]
            near = np.flatnonzero(row <= edge + 1e-9 * max(1.0, abs(edge)))
        else:
            near = np.arange(len(row))
        near = near[ids[near] != query_id]
        exact = np.sqrt(((vectors[near] - queries[i]) ** 2).sum(1))
        old_distances, old_ids = best.get(query_id, (np.zeros(0), np.zeros(0, np.int64)))
        distances, known = np.concatenate([old_distances, exact]), np.concatenate([old_ids, ids[near]])
        order = np.lexsort((known, distances))[:k]
        best[query_id] = distances[order], known[order]


def _emit(best: dict) -> pa.RecordBatch:
    n = [len(d) for d, _ in best.values()]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.repeat(np.fromiter(best, np.int64, len(best)), n), pa.int64()),
            pa.array(np.concatenate([v for _, v in best.values()] or [np.zeros(0, np.int64)]), pa.int64()),
            pa.array(np.concatenate([d for d, _ in best.values()] or [np.zeros(0)]), pa.float64()),
        ],
        ["query_id", "vec_id", "distance"],
    )


def _search_parts(meeting: DataFrame, k: int) -> DataFrame:
    """Rows sorted by (table, bucket, part), queries before vectors within each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, best, queries, query_ids = None, {}, [], []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)  # table, bucket, part, kind
            ids, x = batch.column(4).to_numpy(), _matrix(batch.column(5))
            cuts = np.flatnonzero(np.any(np.diff(keys, axis=0) != 0, axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(ids)]):
                here = tuple(keys[a, :3])
                if here != key:
                    if best:
                        yield _emit(best)
                    key, best, queries, query_ids = here, {}, [], []
                if keys[a, 3] == 0:
                    queries.append(x[a:b])
                    query_ids.append(ids[a:b])
                    continue
                asked = np.concatenate(query_ids) if query_ids else np.zeros(0, np.int64)
                for first in range(0, len(asked), 256):
                    block = slice(first, first + 256)
                    _keep_best(best, ids[a:b], x[a:b], np.concatenate(queries)[block], asked[block], k)
        if best:
            yield _emit(best)

    return meeting.mapInArrow(run, FOUND)


def _search_all(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame | None:
    """Each query against all rows: the driver holds one block of queries at a time."""
    spark = rows.sparkSession
    count = queries.count()
    parts = []
    for number in range(-(-count // BLOCK_QUERIES)):
        mine = F.pmod(F.xxhash64("vec_id"), F.lit(-(-count // BLOCK_QUERIES))) == number
        held = [(r["vec_id"], r["vector"]) for r in queries.where(mine).collect()]
        shared = spark.sparkContext.broadcast(held)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            best: dict = {}
            asked, x = np.array([i for i, _ in shared.value], np.int64), np.array([v for _, v in shared.value], np.float64)
            for batch in batches:
                if len(asked):
                    for first in range(0, len(asked), 256):
                        block = slice(first, first + 256)
                        _keep_best(best, batch.column(0).to_numpy(), _matrix(batch.column(1)), x[block], asked[block], k)
            if best:
                yield _emit(best)

        parts.append(rows.select("vec_id", "vector").mapInArrow(run, FOUND))
    found = None
    for part in parts:
        found = part if found is None else found.union(part)
    return found


def nearest_neighbours(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    tables: int = TABLES,
    probes: int = PROBES,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest vectors found for each query, itself excluded.

    is_query: a condition over the column ``vec_id``. score: the Euclidean distance of the vectors as they
    are; equal distances go to the smaller id. A query gets min(k, all others) rows.

    Rows without id, null or zero vectors and vectors with null or non-finite components take no part. All
    vectors must have one length; others are an error. Rows that repeat an id are one vector (the smallest).
    An empty table, or one without queries, gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = _usable(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    rows = staged(rows, "vectors")
    lengths = rows.agg(F.min(F.size("vector")), F.max(F.size("vector")), F.count("*")).first()
    if lengths[0] != lengths[1]:
        raise ValueError(f"vectors of {lengths[0]} to {lengths[1]} components")
    asked = rows.where(is_query)
    index = staged(_hashed(rows, tables, 1), "buckets")
    probed = staged(_hashed(asked, tables, probes), "probes")
    parts = index.groupBy("table", "bucket").agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("rows"))
    blocks = probed.groupBy("table", "bucket").agg(F.ceil(F.count("*") / PART_QUERIES).cast("int").alias("blocks"))
    grid = F.broadcast(parts.join(blocks, ["table", "bucket"]))  # at most tables * 2 * components rows
    kind = ["table", "bucket", "part", "kind", "vec_id", "vector"]
    points = index.join(grid, ["table", "bucket"]).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("kind")
    )
    points = points.withColumn("part", F.expr("cast(pmod(xxhash64(vec_id), rows) * blocks + block AS int)"))
    queries = probed.join(grid, ["table", "bucket"]).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), F.lit(0).alias("kind")
    )
    queries = queries.withColumn("part", F.expr("cast(row * blocks + pmod(xxhash64(vec_id, 1), blocks) AS int)"))
    meeting = (
        points.select(*kind).unionByName(queries.select(*kind))
        .repartition(slice_count(spark), "table", "bucket", "part")
        .sortWithinPartitions("table", "bucket", "part", "kind")
        .select(*kind)
    )

    def best_k(found: DataFrame) -> DataFrame:
        nearest = Window.partitionBy("query_id").orderBy("distance", "vec_id")
        return found.distinct().withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)

    answers = staged(best_k(_search_parts(meeting, k)), "neighbours")
    wanted = min(k, max(0, lengths[2] - 1))
    full = answers.groupBy("query_id").count().where(F.col("count") >= wanted)
    short = asked.join(full.select(F.col("query_id").alias("full_id")), F.expr("vec_id = full_id"), "left_anti")
    rest = _search_all(rows, staged(short, "unanswered"), k)
    if rest is not None:
        keep = answers.join(full.select("query_id"), "query_id", "left_semi")
        answers = keep.unionByName(best_k(rest).select(*keep.columns))
    return answers.select("query_id", F.col("rank").cast("int"), "vec_id", F.col("distance").alias("score"))

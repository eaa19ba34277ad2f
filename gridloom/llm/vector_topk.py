"""Exact top-k by inner product with vector-approximation files.

Each vector is a row of exact integers; beside it stands an approximation, one byte a component: its cell of a grid of 2^bits
cells per dimension and block. Only cells travel to the queries. A block of queries scans a block's cells for bounds on all
inner products, in whole numbers, and keeps the vectors whose upper bound reaches the kth best lower bound. Of those the best
by their bounds are read exactly first; the kth best score found so far then tells which others must be read as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors in a block, queries in a block, bits of a cell's number.
BLOCK, QUERIES, BITS = 4096, 1024, 8
#: Groups of blocks that run apart from one another, for parallel work, and blocks in a group at least beyond that.
GROUPS = 8

PACKED = "dim int, uids binary, cells binary, low binary, step binary"
FOUND = "q_uid long, uid long, lower double, upper double"


def _cells(m: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells, each dimension's lowest value, and the (whole) width of its cells; Python's integers, as they may not overflow."""
    low = [int(x) for x in m.min(axis=0)]
    step = [max(1, -(-(int(x) - a + 1) // (1 << bits))) for x, a in zip(m.max(axis=0), low, strict=True)]
    wide = m.view(np.uint64) - np.array(low, np.int64).view(np.uint64)  # distances from the lowest fit 64 bits without a sign
    return (wide // np.array(step, np.uint64)).astype(np.uint8), np.array(low, np.int64), np.array(step, np.uint64)


def _packed(size: int, bits: int):
    """(uid, v) to blocks of at most size vectors of one number of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {}

        def emit(dim: int) -> pa.RecordBatch:
            uids, rows = zip(*waiting.pop(dim), strict=True)
            m = np.array(rows, np.int64).reshape(len(uids), dim)
            values = [[dim], [np.array(uids, np.int64).tobytes()], *[[x.tobytes()] for x in _cells(m, bits)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, [pa.int32()] + [pa.binary()] * 4, strict=True)], [x.split()[0] for x in PACKED.split(", ")])

        for batch in batches:
            for uid, v in zip(*[batch.column(k).to_pylist() for k in range(2)], strict=True):
                waiting.setdefault(len(v), []).append((uid, v))
                if len(waiting[len(v)]) >= size:
                    yield emit(len(v))
        for dim in [*waiting]:
            yield emit(dim)

    return run


def _asked(size: int):
    """(uid, v) of queries to blocks: their exact integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[int, list[tuple]] = {}
            for uid, v in zip(*[batch.column(k).to_pylist() for k in range(2)], strict=True):
                rows.setdefault(len(v), []).append((uid, v))
            for dim, some in rows.items():
                for a in range(0, len(some), size):
                    uids, m = zip(*some[a : a + size], strict=True)
                    values = [[dim], [np.array(uids, np.int64).tobytes()], [np.array(m, np.int64).tobytes()]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["dim", "q_uids", "q_exact"])

    return run


def bounds(q: np.ndarray, cells: np.ndarray, low: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products. A component is low + step * cell + r with r from 0 to step - 1, so a
    product is a constant, a product with the cells and what r adds or takes away. All numbers are whole: single precision is
    exact below 2^24, double below 2^53; beyond 2^62 products may wrap, and there is no bound."""
    steps, dim = step.astype(np.float64), max(1, q.shape[1])
    last = cells.max(axis=0, initial=0).astype(np.float64)
    reach = np.abs(q.astype(np.float64)).max(initial=0) * (np.abs(low.astype(np.float64)) + steps * (last + 1)).max(initial=0) * dim
    if reach >= 1 << 62:
        return np.full((len(q), len(cells)), -np.inf), np.full((len(q), len(cells)), np.inf)
    scaled, exact = q.astype(np.float64) * steps, reach < 1 << 52
    kind = np.float32 if (np.abs(scaled).max(initial=0) * 255 * dim) < 1 << 24 else np.float64
    middle = (scaled.astype(kind) @ cells.astype(kind).T).astype(np.float64) + (q.astype(np.float64) @ low.astype(np.float64))[:, None]
    rest = q.astype(np.float64) * (steps - 1)
    margin = 0.0 if exact else reach * dim * 2.0**-50
    return middle + np.minimum(rest, 0).sum(axis=1)[:, None] - margin, middle + np.maximum(rest, 0).sum(axis=1)[:, None] + margin


def _search(k: int):
    """Rows of (part, query block, vector block), sorted by the first two: of each query the vectors of the part that may be
    among its k best, with their bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, head = None, np.zeros(0, np.int64)
        near: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def emit() -> Iterator[pa.RecordBatch]:
            n = [len(u) for u, *_ in near]
            if sum(n):
                columns = [np.repeat(head, n), *[np.concatenate(c) for c in zip(*near, strict=True)]]
                for a in range(0, sum(n), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 10_000]) for c in columns], ["q_uid", "uid", "lower", "upper"])

        for batch in batches:
            for r in batch.to_pylist():
                dim = r["dim"]
                if (r["part"], r["q_block"]) != at:
                    yield from emit()
                    at, head = (r["part"], r["q_block"]), np.frombuffer(r["q_uids"], np.int64)
                    near = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0)) for _ in head]
                uids, q = np.frombuffer(r["uids"], np.int64), np.frombuffer(r["q_exact"], np.int64).reshape(len(head), dim)
                cells = np.frombuffer(r["cells"], np.uint8).reshape(len(uids), dim)
                lower, upper = bounds(q, cells, np.frombuffer(r["low"], np.int64), np.frombuffer(r["step"], np.uint64))
                for i in range(len(head)):
                    u, lo, up = near[i]
                    # the kth best lower bound of this block, of the vectors before, and of both
                    known = -np.inf if len(uids) <= k else np.partition(lower[i], -(k + 1))[-(k + 1)]  # one may be the query itself
                    if len(lo) >= k:
                        known = max(known, np.partition(lo, -k)[-k])
                    some = np.flatnonzero(upper[i] >= known)
                    some = some[uids[some] != head[i]]
                    u, lo, up = np.concatenate([u, uids[some]]), np.concatenate([lo, lower[i, some]]), np.concatenate([up, upper[i, some]])
                    if len(lo) > k:
                        keep = up >= np.partition(lo, -k)[-k]
                        u, lo, up = u[keep], lo[keep], up[keep]
                    near[i] = u, lo, up
        yield from emit()

    return run


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(q_uid, uid, q, v) to exact scores, in 64 bits that wrap beyond."""
    for batch in batches:
        scores = [int((np.array(q, np.int64) * np.array(v, np.int64)).sum()) for q, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.int64())], ["q_uid", "uid", "score"])


def top_k(vectors: DataFrame, k: int = 20, scale: int = 64, vec_id: str = "vec_id", embedding: str = "embedding", every: int = 20, bits: int = BITS) -> DataFrame:
    """Per query its k highest scores: query_id, rank int (from 1), vec_id, score (long).

    Components become floor(scale * x), x as double; the score is the integer inner product (64 bits, wrapping beyond). The
    queries are the rows whose vec_id is divisible by every, the candidates every other row of the same number of components,
    ties to the smaller vec_id. Vectors that are null or hold null or non-finite components take no part, nor do rows
    without vec_id; rows that share a vec_id are candidates, and queries, each for itself. Fewer than k candidates give all;
    an empty table gives an empty one; extra columns aren't carried.
    Queries meet vectors in blocks, as the method is a stated query set against all rows; what each part of the blocks yields
    is the vectors that its bounds can't rule out, and only those are joined with their exact components. bits (1 to 8)
    changes how many these are, not the result.
    """
    x = F.col(f"`{embedding}`")
    whole = F.transform(x, lambda v: F.floor(v.cast("double") * scale).cast("long"))
    sound = x.isNotNull() & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")), F.lit(False)))
    rows = vectors.where(F.col(f"`{vec_id}`").isNotNull() & sound).select(F.col(f"`{vec_id}`").cast("long").alias("id"), whole.alias("v"))
    rows = written(rows.withColumn("uid", F.monotonically_increasing_id()).select("uid", "id", "v"), "vectors")
    queries = rows.where(F.col("id") % every == 0)
    n, m = rows.count(), queries.count()
    few = lambda df, size, count: df.select("uid", "v").repartition(max(1, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // size))), "uid")
    blocks = written(few(rows, BLOCK, n).mapInArrow(_packed(BLOCK, bits), PACKED).withColumn("block", F.monotonically_increasing_id()), "vector-blocks")
    asked = written(few(queries, QUERIES, m).mapInArrow(_asked(QUERIES), "dim int, q_uids binary, q_exact binary").withColumn("q_block", F.monotonically_increasing_id()), "query-blocks")
    count = -(-n // BLOCK)
    parts = max(1, min(count, GROUPS), -(-count // 64))
    right = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)))
    left = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    pairs = right.join(left, ["part", "dim"]).repartition(max(1, parts * -(-m // QUERIES)), "part", "q_block").sortWithinPartitions("part", "q_block")
    near = written(pairs.mapInArrow(_search(k), FOUND), "near-vectors")

    def exact(some: DataFrame) -> DataFrame:
        both = some.join(queries.select(F.col("uid").alias("q_uid"), F.col("v").alias("q")), "q_uid").join(rows.select("uid", "v"), "uid")
        return both.select("q_uid", "uid", "q", "v").mapInArrow(_products, "q_uid long, uid long, score long")

    by_bound = Window.partitionBy("q_uid").orderBy(F.desc("lower"), F.desc("upper"), "uid")
    ranked = near.withColumn("place", F.row_number().over(by_bound))
    first = written(exact(ranked.where(F.col("place") <= k)), "first-scores")
    kth = first.groupBy("q_uid").agg(F.min("score").cast("double").alias("kth"), F.count("*").alias("have"))
    # a score is exact as a double below 2^53; beyond, what is equal after rounding is read as well
    others = ranked.where(F.col("place") > k).join(kth, "q_uid").where((F.col("upper") >= F.col("kth")) | (F.col("have") < k))
    scores = first.unionByName(exact(others))
    named = scores.join(rows.select("uid", F.col("id").alias("vec_id")), "uid").join(queries.select(F.col("uid").alias("q_uid"), F.col("id").alias("query_id")), "q_uid")
    best = Window.partitionBy("q_uid").orderBy(F.desc("score"), "vec_id")
    return named.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

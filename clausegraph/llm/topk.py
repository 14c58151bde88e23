"""Exact top-k by integer inner product: columnar branch-and-bound (operator 8).

Vectors lie in blocks, dimension by dimension. A group of query blocks meets a run of candidate blocks in one task, which
holds the run and takes the queries block by block; scores grow by one block of dimensions at a time, and a candidate leaves as soon as its score so far plus the most that the remaining
dimensions can add (the product of the remaining norms) is below the query's k-th best score. Candidates that could tie
stay, so ties go to the smaller id exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.llm.common import materialise

#: Rows of a block of candidates and of queries at most, and components of a block; blocks of a run and of a group, about.
CANDIDATES, QUERIES, VALUES, RUN, GROUP = 8192, 1024, 1 << 19, 16, 64
DIMENSIONS = 16
#: Rows of a few bytes: up to so many are broadcast.
MOST_DIMENSIONS = 10_000
BLOCK = "side int, dim int, block long, ids binary, matrix binary"


def matrix(values: pa.ListArray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their float64 matrix) by dimension; leaves out null vectors and any with a null or non-finite component."""
    n = len(values)
    if n == 0:
        return []
    offsets = values.offsets.to_numpy().astype(np.int64)
    flat = values.values
    numbers = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    bad = np.r_[0, np.cumsum(~np.isfinite(numbers))]
    good = (bad[offsets[1:]] == bad[offsets[:-1]]) & values.is_valid().to_numpy(zero_copy_only=False)
    out = []
    for dim in np.unique(sizes[good]):
        rows = np.flatnonzero(good & (sizes == dim))
        out.append((rows, numbers[offsets[rows][:, None] + np.arange(dim)]))
    return out


def integer_type(largest: float, dim: int) -> np.dtype:
    """The quickest type in which sums of ``dim`` products are exact."""
    bound = float(largest) * float(largest) * max(dim, 1)
    if bound >= 1 << 63:
        raise ValueError("components so large that an inner product may not lie in 64 bits")
    return np.dtype("f4") if bound < 1 << 24 else np.dtype("f8") if bound < 1 << 53 else np.dtype("i8")


def narrow(rows: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes each that hold them all."""
    top = np.abs(rows).max(initial=0)
    if top >= 1 << 62:
        raise ValueError("components so large that an inner product may not lie in 64 bits")
    return rows.astype(next(f"<i{b}" for b in (1, 2, 4, 8) if top < 1 << (8 * b - 1))).tobytes()


def unpacked(raw: bytes, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{max(1, len(raw) // max(1, dim * n))}").reshape(dim, n)


def blocks(vectors: DataFrame, query_step: int, scale: float = 64.0, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """Vectors as blocks of integer columns: side 0 candidates, side 1 queries (ids divisible by ``query_step``), one for each
    distinct id and vector. Blocks of long vectors have fewer rows."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int], list] = {}
        part = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
        number = 0

        def block(side: int, dim: int, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            number += 1
            values = [side, dim, part + number, ids.astype("<i8").tobytes(), narrow(np.ascontiguousarray(rows.T))]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()], strict=True)], ["side", "dim", "block", "ids", "matrix"])

        def full(key: tuple[int, int], size: int) -> Iterator[pa.RecordBatch]:
            ids, rows = (np.concatenate(x) for x in zip(*waiting[key], strict=True))
            while len(ids) >= size:
                yield block(*key, ids[:size], rows[:size])
                ids, rows = ids[size:], rows[size:]
            waiting[key] = [(ids, rows)] if len(ids) else []

        for batch in batches:
            ids, asks = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            known = ids.is_valid().to_numpy(zero_copy_only=False)
            numbers = ids.fill_null(0).to_numpy()
            for rows, values in matrix(batch.column(1)):
                keep = known[rows]
                rows, values = rows[keep], np.floor(values[keep] * scale)
                ask = asks[rows]
                for side, most, chosen in ((0, candidates, ~ask), (1, queries, ask)):
                    key, size = (side, values.shape[1]), max(1, min(most, VALUES // max(1, values.shape[1])))
                    if not chosen.any():
                        continue
                    waiting.setdefault(key, []).append((numbers[rows][chosen], values[chosen]))
                    if sum(len(w[0]) for w in waiting[key]) >= size:
                        yield from full(key, size)
        for key in list(waiting):
            if waiting[key] and sum(len(w[0]) for w in waiting[key]):
                yield from full(key, 1 << 62)
                ids, rows = waiting[key][0]
                yield block(*key, ids, rows)

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    asked = rows.where(F.pmod("vec_id", F.lit(query_step)) == 0).distinct()
    return rows.withColumn("asks", F.lit(False)).union(asked.withColumn("asks", F.lit(True))).mapInArrow(built, BLOCK)


class TopK:
    """The best ``k`` so far of each query of a block, by score, then smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.queries = queries  # one row a query
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]
        squares = queries.astype(float) ** 2
        self.rest = [np.sqrt(squares[:, d:].sum(axis=1)) for d in range(0, queries.shape[1] + 1)]

    def offer(self, ids: np.ndarray, columns: np.ndarray) -> None:
        """A block of candidates, ``columns`` being dimension by dimension."""
        dim, n = columns.shape
        if n == 0:
            return
        kind = integer_type(max(np.abs(columns).max(initial=0), np.abs(self.queries).max(initial=0)), dim)
        columns, queries = columns.astype(kind), self.queries.astype(kind)
        squares = columns.astype(float) ** 2
        tails = {d: np.sqrt(squares[d:].sum(axis=0)) for d in range(0, dim + DIMENSIONS, DIMENSIONS)}
        for i, query in enumerate(queries):
            score, at = None, np.arange(n)
            scores, who = self.best[i]
            least = scores[-1] if len(scores) == self.k else -np.inf
            for d in range(0, dim, DIMENSIONS):
                part = columns[d : d + DIMENSIONS]
                part = query[d : d + DIMENSIONS] @ (part if len(at) == n else part[:, at])
                score = part if score is None else score + part
                if np.isfinite(least) and d + DIMENSIONS < dim:
                    more = self.rest[d + DIMENSIONS][i] * (tails[d + DIMENSIONS] if len(at) == n else tails[d + DIMENSIONS][at])
                    alive = score + more >= least - 1e-12 * (np.abs(score) + more + abs(least))  # room for rounding: ties stay
                    if 2 * np.count_nonzero(alive) < len(at):
                        score, at = score[alive], at[alive]
            if score is None:
                score = np.zeros(n)
            others = ids[at] != self.ids[i]  # before the k-th is found: any number of rows may have the query's own id
            if not others.all():
                score, at = score[others], at[others]
            if not np.isfinite(least) and len(score) > self.k:
                least = -np.partition(-score, self.k - 1)[self.k - 1]
            keep = np.flatnonzero(score >= least)
            if len(keep) > 4 * self.k:  # many at the k-th score: those of the smallest ids are enough
                tied = keep[score[keep] == least]
                tied = tied[np.argsort(ids[at[tied]])[: self.k]]
                keep = np.r_[keep[score[keep] > least], tied]
            scores, who = np.r_[scores, score[keep]], np.r_[who, ids[at[keep]]]
            order = np.lexsort((who, -scores))[: self.k]
            self.best[i] = scores[order], who[order]


def top_k(vectors: DataFrame, k: int = 20, query_step: int = 20, scale: float = 64.0, candidates: int = CANDIDATES, queries: int = QUERIES, run: int = RUN, group: int = GROUP) -> DataFrame:
    """Per query (ids divisible by ``query_step``) its ``k`` highest integer inner products among all other rows.

    Components are ``floor(scale * x)``. Vectors that are null or hold a null or non-finite component, and null ids, take
    no part; vectors of different dimension are not compared; rows that repeat an id stay separate candidates, but a row
    never meets its own id. Each distinct id and vector is one query: an id that repeats with other vectors has a list, ranked
    from 1, for each of them, and equal rows have one list. Fewer than k candidates: all of them; an empty table: no rows.
    Components so large that a score may not lie in 64 bits raise. Runs of candidate blocks and groups of query blocks
    form a grid; a cell is a task's work: it holds the run and takes the group's blocks one by one. Bytes shuffled are
    candidates * groups + queries * runs, a group being ``group * queries`` queries and a run ``run * candidates`` rows; a
    small table has more runs, so that every core has a cell. The final rank is over at most k rows a run and query.
    """
    made = materialise(blocks(vectors, query_step, scale, candidates, queries), "topk-blocks")
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    sizes = made.groupBy("dim").agg(F.count_if(F.col("side") == 0).alias("c"), F.greatest(F.lit(1), F.ceil(F.count_if(F.col("side") == 1) / group)).alias("groups"))
    sizes = materialise(sizes.select("dim", "groups", F.greatest(F.ceil(F.col("c") / run), F.least("c", F.ceil(F.lit(tasks) / F.col("groups"))), F.lit(1)).alias("runs")), "topk-sizes")
    if sizes.count() <= MOST_DIMENSIONS:
        sizes = F.broadcast(sizes)
    both = made.join(sizes, "dim")
    own = lambda n: F.pmod(F.xxhash64("block"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    kept = ["side", "block", "ids", "matrix"]
    cells = both.where("side = 0").select("dim", own("runs").alias("run"), every("groups").alias("group"), *kept).union(both.where("side = 1").select("dim", every("runs").alias("run"), own("groups").alias("group"), *kept))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            for x in range(batch.num_rows):
                dim, run, group, side, block, ids, columns = (batch.column(c)[x].as_py() for c in range(7))
                if key != (dim, run, group):
                    key, held = (dim, run, group), []
                ids = np.frombuffer(ids, "<i8")
                columns = unpacked(columns, dim, len(ids))
                if side == 0:
                    held.append((ids, columns))
                    continue
                best = TopK(ids, columns.T, k)
                for other in held:
                    best.offer(*other)
                yield result(block, best)

    def result(asks: int, best: TopK) -> pa.RecordBatch:
        sizes = [len(b[0]) for b in best.best]
        score = np.concatenate([b[0] for b in best.best]).astype(np.int64)
        who = np.concatenate([b[1] for b in best.best])
        place = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(who), asks)), pa.array(place), pa.array(np.repeat(best.ids, sizes)), pa.array(who), pa.array(score)], ["asks", "place", "query_id", "vec_id", "score"])

    dealt = cells.repartition("dim", "run", "group").sortWithinPartitions("dim", "run", "group", "side", "block")
    partial = dealt.mapInArrow(search, "asks long, place int, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("asks", "place").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 20, query_step: int = 20, scale: float = 64.0) -> str:
    """DuckDB SQL of :func:`top_k` over ``embeddings``."""
    return f"""
WITH whole AS (
  SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: floor({scale}::DOUBLE * x)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(CAST(embedding AS DOUBLE[]), lambda x: x IS NULL OR NOT isfinite(x))) = 0),
queries AS (SELECT row_number() OVER () AS number, vec_id AS query_id, v AS q FROM (SELECT DISTINCT vec_id, v FROM whole WHERE vec_id % {query_step} = 0)),
scored AS (
  SELECT number, query_id, vec_id, CAST(list_inner_product(q, v) AS BIGINT) AS score
  FROM queries JOIN whole ON vec_id <> query_id AND len(q) = len(v)),
placed AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id) AS place FROM scored)
SELECT query_id, CAST(place AS INT) AS rank, vec_id, score FROM placed WHERE place <= {k}"""

"""k nearest neighbours by cosine, exact: blocks of vectors meet blocks of vectors, with matrix products in each task."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.operators.ranking import fixed

BLOCK, SIDE, CELLS = 2048, 1 << 16, 10


def unit_blocks(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """``vectors(id, embedding)`` as blocks of unit vectors; null or zero vectors have no neighbours."""

    def built(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for k in range(0, batch.num_rows, block):
                rows = batch.slice(k, block).filter(pa.array(batch.slice(k, block).column(1).is_valid()))
                by_dim: dict[int, list[tuple[int, np.ndarray]]] = {}
                for i, v in zip(rows.column(0).to_pylist(), rows.column(1).to_numpy(zero_copy_only=False), strict=True):
                    v = np.asarray(v, float)
                    if np.isfinite(v).all() and np.any(v) and i is not None:
                        by_dim.setdefault(len(v), []).append((i, v / np.linalg.norm(v)))
                for dim, own in by_dim.items():
                    number += 1
                    values = [dim, part + number, np.array([o[0] for o in own], "<i8").tobytes(), np.array([o[1] for o in own], "<f8").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [pa.int32(), pa.int64(), pa.binary(), pa.binary()], strict=True)], ["dim", "block", "ids", "x"])

    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(built, "dim int, block long, ids binary, x binary")


def nearest(vectors: DataFrame, k: int) -> DataFrame:
    """(a, b, score): each row's k nearest rows by cosine, itself included; ties to the smaller id. All vectors meet all, in a
    grid whose cells hold ``SIDE`` vectors a side at most; a cell is a task and keeps k rows a vector, whatever it meets."""
    blocks = fixed(unit_blocks(vectors))
    total = blocks.agg(F.sum(F.octet_length("ids") / 8)).first()[0] or 0
    parts = max(1, math.ceil(total / min(SIDE, max(BLOCK, total / CELLS))))
    # A row a block: thousands of vectors.
    place = blocks.select("block", ((F.row_number().over(Window.orderBy("block")) - 1) % parts).alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    dealt = blocks.join(F.broadcast(place), "block")
    left, right = dealt.withColumn("other", every).withColumn("side", F.lit(0)), dealt.withColumn("other", every).withColumn("side", F.lit(1))
    cell = F.when(F.col("side") == 0, F.col("own") * parts + F.col("other")).otherwise(F.col("other") * parts + F.col("own"))
    cells = left.union(right).select(cell.cast("int").alias("cell"), "side", "dim", "ids", "x").repartitionById(parts * parts, F.col("cell")).sortWithinPartitions("side")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[Nearest]] = {}
        for batch in batches:
            for _, side, dim, ids, x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, x = np.frombuffer(ids, "<i8"), np.frombuffer(x).reshape(-1, dim)
                if side == 0:
                    held.setdefault(dim, []).append(Nearest(ids, x, k))
                    continue
                for own in held.get(dim, []):
                    own.meet(ids, x)
        for own in (n for group in held.values() for n in group):
            yield pa.RecordBatch.from_arrays([pa.array(own.ids[own.rows]), pa.array(own.found), pa.array(own.values)], ["a", "b", "score"])

    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return cells.mapInArrow(met, "a long, b long, score double").withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


class Nearest:
    """The k nearest so far of a block of unit vectors. Products in single precision exclude what cannot be among them; what is
    left is measured in double precision, rounded to nine digits."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k, self.single = ids, x, k, x.astype("f4")
        self.rows, self.found, self.values = np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0)
        self.least = None  # of each row, once it has k

    def meet(self, ids: np.ndarray, y: np.ndarray) -> None:
        error = 1.2e-7 * (self.x.shape[1] + 4)  # twice what single precision may be off, of unit vectors
        rough = self.single @ y.astype("f4").T
        if self.least is not None:
            least = self.least - 2e-9 - error
        elif len(ids) > self.k:
            least = np.partition(rough, len(ids) - self.k, axis=1)[:, len(ids) - self.k] - 2e-9 - 2 * error
        else:
            least = np.full(len(self.ids), -np.inf)
        rows, cols = np.nonzero(rough >= least.astype("f4")[:, None] - np.float32(1e-7))
        values = np.round(np.einsum("ij,ij->i", self.x[rows], y[cols]), 9)
        rows, found, values = np.concatenate([self.rows, rows]), np.concatenate([self.found, ids[cols]]), np.concatenate([self.values, values])
        order = np.lexsort((found, -values, rows))
        rows = rows[order]
        kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < self.k
        self.rows, self.found, self.values = rows[kept], found[order][kept], values[order][kept]
        if len(self.rows) == self.k * len(self.ids):
            self.least = self.values[self.k - 1 :: self.k]

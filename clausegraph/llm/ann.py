"""Approximate nearest neighbours by inner product: NN-descent and greedy graph search (operator 9).

Equal vectors are one node, which keeps their smallest ids. Nodes are dealt into shards of at most about 65 536. In each
shard a graph starts from random-hyperplane buckets and is refined by NN-descent: Spark joins bring each node's neighbours
and their reverse together, neighbours of one node are compared to each other, and a node keeps its best. A query then
walks each shard's graph greedily from sampled entry nodes with a bounded beam; nodes found are scored in double precision
on the original vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.llm.common import materialise
from clausegraph.llm.topk import matrix

SHARD_NODES, NEIGHBOURS, REVERSE = 1 << 16, 24, 24
TREES, BUCKET, ROUNDS, GAIN = 3, 256, 4, 8
BEAM, ENTRIES, STEP, PART_QUERIES, MOST_QUERIES, BLOCK_QUERIES = 448, 512, 4, 512, 16384, 128


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, dim, x (float64 bytes): vectors without null or non-finite components, not null and not zero."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, values in matrix(batch.column(1)):
                rows = rows[np.any(values != 0, axis=1)]
                values = values[np.any(values != 0, axis=1)] + 0.0
                if len(rows):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(np.full(len(rows), values.shape[1], np.int32)), pa.array([v.tobytes() for v in values], pa.binary())], ["vec_id", "dim", "x"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id IS NOT NULL")
    return rows.mapInArrow(kept, "vec_id long, dim int, x binary")


def small(x: np.ndarray) -> bytes:
    """A vector in a byte a component, with its scale: enough to rank neighbours while the graph is built."""
    scale = np.float32(max(np.abs(x).max() / 127, 1e-300))
    return scale.tobytes() + np.rint(x / scale).astype(np.int8).tobytes()


def large(rows: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), -1)
    return np.ascontiguousarray(raw[:, 4:]).view(np.int8).astype(np.float32) * np.ascontiguousarray(raw[:, :4]).view(np.float32)


def grouped(batches: Iterator[pa.RecordBatch], keys: int, most: int) -> Iterator[list[tuple]]:
    """Runs of rows with equal leading ``keys`` columns, in runs of at most ``most``."""
    held: list[tuple] = []
    for batch in batches:
        for k in range(0, batch.num_rows, 4096):
            part = batch.slice(k, 4096)
            for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
                if held and (row[:keys] != held[0][:keys] or len(held) >= most):
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held


def compared(key_columns: int, most: int, gain: int, floor: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Compares the nodes of each group (columns after the keys: node, q, and with ``floor`` the similarity to beat)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list[np.ndarray]] = [[], [], []]
        size = 0
        for rows in grouped(batches, key_columns, most):
            if len(rows) < 2:
                continue
            ids, q = np.array([r[key_columns] for r in rows]), large([r[key_columns + 1] for r in rows])
            sim = q @ q.T
            np.fill_diagonal(sim, -np.inf)
            n = min(gain, len(rows) - 1)
            best = np.argpartition(-sim, n - 1, axis=1)[:, :n]
            value = np.take_along_axis(sim, best, axis=1)
            good = value > (np.array([r[key_columns + 2] for r in rows])[:, None] if floor else -np.inf)
            good &= ids[best] != ids[:, None]
            for o, v in zip(out, (np.repeat(ids, n).reshape(-1, n)[good], ids[best][good], value[good]), strict=True):
                o.append(v)
            size += int(good.sum())
            if size > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["u", "v", "sim"])
                out, size = [[], [], []], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["u", "v", "sim"])

    return run


EDGE = "u long, v long, sim float"


def best_edges(edges: DataFrame, count: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("sim"), "v"))
    return edges.groupBy("u", "v").agg(F.max("sim").alias("sim")).withColumn("rank", rank).where(F.col("rank") <= count).drop("rank")


def nearest_graph(nodes: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Edges (u, v, sim) of ``nodes(node, shard, dim, q)``: each node's nearest found in its shard."""
    per_shard = max(2, nodes.groupBy("shard").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0])
    bits = max(1, int(np.ceil(np.log2(per_shard / BUCKET))) + 1)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                part = batch.take(pa.array(rows))
                planes = np.random.default_rng(int(dim)).normal(size=(int(dim), TREES * bits))
                sides = (large(part.column(3).to_pylist()) @ planes > 0).reshape(-1, TREES, bits)
                codes = (sides * (1 << np.arange(bits))).sum(axis=2)
                for tree in range(TREES):
                    yield pa.RecordBatch.from_arrays([part.column(1), pa.array(np.full(len(rows), tree, np.int32)), pa.array(codes[:, tree]), part.column(0), part.column(3)], ["shard", "tree", "code", "node", "q"])

    base = nodes.select("node", "shard", "dim", "q")
    dealt = base.mapInArrow(hashed, "shard long, tree int, code long, node long, q binary")
    dealt = dealt.repartition("shard", "tree", "code").sortWithinPartitions("shard", "tree", "code", F.xxhash64("node"))
    edges = materialise(best_edges(dealt.mapInArrow(compared(3, 2 * BUCKET, NEIGHBOURS, False), EDGE), NEIGHBOURS), "ann-edges")
    for _ in range(rounds):
        back = best_edges(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim"), REVERSE)
        both = edges.select("u", "v").union(back.select("u", "v")).distinct()
        worst = edges.groupBy("u").agg(F.when(F.count("*") >= NEIGHBOURS, F.min("sim")).otherwise(F.lit(float("-inf"))).cast("float").alias("worst"))
        known = base.select("node", "q").join(worst, F.col("node") == F.col("u"), "left").select(F.col("node").alias("v"), "q", F.coalesce("worst", F.lit(float("-inf"))).alias("worst"))
        rows = both.join(known, "v").select("u", "v", "q", "worst").repartition("u").sortWithinPartitions("u")
        found = rows.mapInArrow(compared(1, NEIGHBOURS + REVERSE, GAIN, True), EDGE)
        edges = materialise(best_edges(edges.union(found), NEIGHBOURS), "ann-edges")
    return edges


class Graph:
    """One shard in memory, and its search."""

    def __init__(self, nodes: np.ndarray, x: np.ndarray, ids: list[list[int]], u: np.ndarray, v: np.ndarray):
        order = np.argsort(nodes)
        self.x, self.ids = x[order], [ids[i] for i in order]
        nodes = nodes[order]
        u, v = np.searchsorted(nodes, u), np.searchsorted(nodes, v)
        count = np.bincount(u, minlength=len(nodes))
        self.links = np.repeat(np.arange(len(nodes), dtype=np.int32)[:, None], max(1, int(count.max(initial=1))), axis=1)  # padded by itself
        by = np.argsort(u, kind="stable")
        self.links[u[by], np.arange(len(u)) - np.repeat(np.cumsum(count) - count, count)] = v[by]
        self.single = self.x.astype(np.float32)
        self.entries = np.random.default_rng(7).permutation(len(nodes))[:ENTRIES]

    def search(self, queries: np.ndarray, beam: int) -> np.ndarray:
        """The beam of nodes by query, best first; -1 where there are fewer."""
        n, b = len(self.x), len(queries)
        q = queries.astype(np.float32)
        lines = np.arange(b)[:, None]
        seen = np.zeros((b, n), bool)
        first = np.broadcast_to(self.entries, (b, len(self.entries)))
        seen[:, self.entries] = True
        nodes, score = first, q @ self.single[self.entries].T
        todo = np.ones(nodes.shape, bool)
        while True:
            keep = np.argsort(-score, axis=1, kind="stable")[:, :beam] if score.shape[1] <= beam else np.argpartition(-score, beam - 1, axis=1)[:, :beam]
            nodes, score, todo = nodes[lines, keep], score[lines, keep], todo[lines, keep]
            waiting = np.where(todo, score, -np.inf)
            pick = np.argpartition(-waiting, min(STEP, waiting.shape[1]) - 1, axis=1)[:, :STEP]
            live = np.isfinite(waiting[lines, pick])
            if not live.any():
                break
            todo[lines, pick] = False
            near = self.links[nodes[lines, pick]]
            near = np.where(live[:, :, None], near, nodes[lines, pick][:, :, None]).reshape(b, -1)
            new = ~seen[lines, near]
            order = np.argsort(near, axis=1, kind="stable")  # a node met twice in one step counts once
            ranked = near[lines, order]
            again = np.zeros_like(new)
            again[lines, order] = np.c_[np.zeros(b, bool), ranked[:, 1:] == ranked[:, :-1]]
            new &= ~again
            seen[lines, near] = True
            width = int(new.sum(axis=1).max(initial=0))
            if width == 0:
                continue
            front = np.argsort(~new, axis=1, kind="stable")[:, :width]
            near, new = near[lines, front], new[lines, front]
            value = np.where(new, np.einsum("bd,bmd->bm", q, self.single[near]), -np.inf)
            nodes, score, todo = np.c_[nodes, near], np.c_[score, value], np.c_[todo, new]
        order = np.argsort(-score, axis=1, kind="stable")
        return np.where(np.isfinite(score), nodes, -1)[lines, order]

    def answer(self, query_ids: np.ndarray, numbers: np.ndarray, queries: np.ndarray, k: int, beam: int) -> Iterator[tuple[np.ndarray, ...]]:
        """By query its number and id, the ids and exact scores of its nearest found: the best nodes, enough for k ids besides its own."""
        for at in range(0, len(queries), BLOCK_QUERIES):
            part = queries[at : at + BLOCK_QUERIES]
            for own, number, x, nodes in zip(query_ids[at : at + BLOCK_QUERIES], numbers[at : at + BLOCK_QUERIES], part, self.search(part, beam), strict=True):
                nodes = np.array(list(islice((i for i in nodes[nodes >= 0].tolist() if any(j != own for j in self.ids[i])), 2 * k + 2)), np.int64)
                score = np.array([float(np.dot(self.x[i], x)) for i in nodes])
                ids = [self.ids[i] for i in nodes]
                who = np.array([j for i in ids for j in i], np.int64)
                value = np.repeat(score, [len(i) for i in ids])
                value, who = value[who != own], who[who != own]
                order = np.lexsort((who, -value))[:k]
                yield np.full(len(order), number), np.full(len(order), own), who[order], value[order]


def search(vectors: DataFrame, k: int = 20, query_step: int = 20, beam: int = BEAM) -> DataFrame:
    """Per query (ids divisible by ``query_step``) its ``k`` nearest found: query_id, rank, vec_id, score.

    Every usable row is indexed and may be found; vectors that are null, zero or hold a null or non-finite component, and
    null ids, take no part; vectors of different dimension never meet. Rows of equal vectors stay separate candidates;
    a row never meets its own id. Each distinct id and vector is one query with its own list. Fewer candidates than k: all found; an empty table: no rows. A task holds one shard and
    one block of queries; queries * shards rows meet in the end, at most k for each.
    """
    own = materialise(usable(vectors), "ann-vectors")
    shards = max(1, -(-own.count() // SHARD_NODES))
    rank = F.row_number().over(Window.partitionBy("dim", "x").orderBy("vec_id"))
    # Smaller ids win ties, and a query leaves out the rows of one id: more ids, or more rows of an id, are never asked for.
    few = own.groupBy("vec_id", "dim", "x").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    few = few.withColumn("rank", rank).where(F.col("rank") <= k + 1)

    def shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = [small(np.frombuffer(x, np.float64)) for x in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(q, pa.binary())], [*batch.schema.names, "q"])

    nodes = few.groupBy("dim", "x").agg(F.slice(F.sort_array(F.flatten(F.collect_list(F.array_repeat("vec_id", F.col("copies"))))), 1, 2 * k).alias("ids"))
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), (F.pmod(F.xxhash64("x"), F.lit(shards)) + F.shiftleft(F.col("dim").cast("long"), 32)).alias("shard"), "dim", "x", "ids")
    nodes = materialise(nodes.mapInArrow(shrunk, "node long, shard long, dim int, x binary, ids array<long>, q binary"), "ann-nodes")
    edges = nearest_graph(nodes)
    both = best_edges(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim")), NEIGHBOURS + REVERSE)
    lists = both.groupBy("u").agg(F.collect_list("v").alias("near"))
    indexed = nodes.join(lists, F.col("node") == F.col("u"), "left").select("shard", "node", "x", "ids", F.coalesce("near", F.array().cast("array<long>")).alias("near"))

    # Each part of the queries gets every shard of its dimension: the shard's rows come first, then the queries.
    asked = own.where(F.pmod("vec_id", F.lit(query_step)) == 0).distinct()
    asked = materialise(asked.select("*", F.monotonically_increasing_id().alias("number")), "ann-queries")
    # Enough parts to use the cluster, none of more than MOST_QUERIES: each costs a copy of the shards it meets.
    queries, tasks = asked.count(), int(own.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    parts = max(1, min(-(-queries // PART_QUERIES), max(-(-queries // MOST_QUERIES), -(-tasks // shards))))
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    index_rows = indexed.select("shard", part, F.lit(0).alias("kind"), F.col("node").alias("id"), "x", "ids", "near", F.col("node").alias("number"))
    shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s")
    query_rows = asked.select("vec_id", "dim", "x", "number", shard).select(
        (F.col("s") + F.shiftleft(F.col("dim").cast("long"), 32)).alias("shard"), F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"), F.lit(1).alias("kind"),
        F.col("vec_id").alias("id"), "x", F.array().cast("array<long>").alias("ids"), F.array().cast("array<long>").alias("near"), "number")
    meeting = index_rows.union(query_rows).repartition(shards * parts, "shard", "part").sortWithinPartitions("shard", "part", "kind", "id")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, graph, asks = None, [], None, []

        def built() -> Graph | None:
            if not held:
                return None
            nodes = np.concatenate([h[0] for h in held])
            near = np.concatenate([h[3] for h in held])
            sizes = np.concatenate([h[4] for h in held])
            x = np.frombuffer(b"".join(b for h in held for b in h[1]), np.float64).reshape(len(nodes), -1)
            return Graph(nodes, x, [i for h in held for i in h[2]], np.repeat(nodes, sizes), near)

        def answered() -> Iterator[pa.RecordBatch]:
            if graph and asks:
                x = np.frombuffer(b"".join(a[1] for a in asks), np.float64).reshape(len(asks), -1)
                found = list(graph.answer(np.array([a[0] for a in asks]), np.array([a[2] for a in asks]), x, k, beam))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["number", "query_id", "vec_id", "score"])

        for batch in batches:
            shard, part, kind = (batch.column(c).to_numpy() for c in range(3))
            change = np.flatnonzero(np.r_[True, (shard[1:] != shard[:-1]) | (part[1:] != part[:-1]) | (kind[1:] != kind[:-1])])
            for a, b in zip(change, np.r_[change[1:], batch.num_rows], strict=True):
                if key != (shard[a], part[a]):
                    yield from answered()
                    key, held, graph, asks = (shard[a], part[a]), [], None, []
                rows = batch.slice(a, b - a)
                if kind[a] == 0:
                    near = rows.column(6)
                    held.append((rows.column(3).to_numpy(), rows.column(4).to_pylist(), rows.column(5).to_pylist(), near.flatten().to_numpy(), np.diff(near.offsets.to_numpy())))
                    continue
                if graph is None:
                    graph = built()
                    held = []
                asks += list(zip(rows.column(3).to_pylist(), rows.column(4).to_pylist(), rows.column(7).to_pylist(), strict=True))
                if len(asks) >= PART_QUERIES:
                    yield from answered()
                    asks = []
        yield from answered()

    partial = meeting.mapInArrow(walk, "number long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), "vec_id"))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

"""Near-duplicate classes by HyperMinHash (operator 5).

A document's set holds 64-bit hashes of its word shingles. The first bits of a hash choose a bucket; a bucket's
register keeps the smallest hash in it as a count of leading zeros (6 bits) and the 10 bits after the first one. Bands of
8 registers find candidates, the registers' agreement corrected for chance collisions discards unlikely ones, and full
sets confirm the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausegraph.llm.common import SLICE_BYTES, forget, kept_between_tasks, let_go, materialise, numbered, slices, small_batches, text_buffer

REGISTER_BITS, MANTISSA_BITS, BAND = 9, 10, 8
REGISTERS = 1 << REGISTER_BITS
BANDS = REGISTERS // BAND
EMPTY = 0xFFFF
_U = np.uint64
_WORD_END = np.zeros(256, bool)
_WORD_END[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + _U(0x9E3779B97F4A7C15 * (2 * seed + 1) & (1 << 64) - 1)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(256, dtype=np.uint64), 7)
_SEEDS = mix(np.arange(REGISTERS, dtype=np.uint64), 11)
_BASE = 0x5851F42D4C957F2D
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
kept_between_tasks.append(_powers.clear)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, at least ``n`` of them."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = (np.full(size, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word ``[^\\x20\\x09-\\x0D]+`` of texts laid end to end starts and ends."""
    if len(data) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = _WORD_END[data]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    before, after = np.r_[True, space[:-1]], np.r_[space[1:], True]
    before[edge] = True
    after[edge - 1] = True
    return np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash by word, with A-Z as a-z."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):  # stretches of bounded size, cut between words
        stop = max(k + 1, int(np.searchsorted(ends, starts[k] + SLICE_BYTES, side="right")))
        a, b = starts[k], ends[stop - 1]
        up, down = powers(int(b - a))
        sums = np.r_[_U(0), np.cumsum(_BYTE[_LOWER[data[a:b]]] * up[: b - a])]
        out[k:stop] = (sums[ends[k:stop] - a] - sums[starts[k:stop] - a]) * down[starts[k:stop] - a]
        k = stop
    return mix(out ^ (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words end to end, and offsets into them by text."""
    starts, ends = word_spans(data, offsets)
    return word_hashes(data, starts, ends), np.searchsorted(starts, offsets)


def shingle_sets(values: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; fewer words than ``size`` make one shingle, none make none."""
    hashes, offsets = words(*text_buffer(values))
    n = len(hashes)
    whole = np.zeros(n, np.uint64)
    factors = mix(np.arange(size, dtype=np.uint64), 3) | _U(1)
    for j in range(size):
        if n > j:
            whole[: n - j] += hashes[j:] * factors[j]
    whole = mix(whole, 1)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= size:
            yield np.unique(whole[a : b - size + 1])
        elif b > a:
            yield mix(np.array([(hashes[a:b] * factors[: b - a]).sum()], np.uint64), 8 + int(b - a))
        else:
            yield np.zeros(0, np.uint64)


def size_class(n: int) -> int:
    """Sets are compared within a class: sizes from 2**c to below 2**(c+1)."""
    return n.bit_length() - 1


def registers(hashes: np.ndarray, cls: int) -> np.ndarray:
    """HyperMinHash registers of distinct hashes for a class. Buckets are so few that a set of the class fills most, at
    most 512; as many hash functions as make 512 registers in all share them."""
    bits = min(REGISTER_BITS, max(0, cls - 2))
    rounds = REGISTERS >> bits
    spread = mix(hashes[None, :] + _SEEDS[:rounds, None], 5)
    bucket = (spread >> _U(64 - bits) if bits else np.zeros_like(spread)) + (np.arange(rounds, dtype=np.uint64) << _U(bits))[:, None]
    least = np.full(REGISTERS, ~_U(0))
    np.minimum.at(least, bucket.ravel().astype(np.int64), ((spread << _U(bits)) >> _U(1)).ravel())
    filled = least != ~_U(0)
    rest = (least[filled] << _U(1)) | _U(1)
    zeros = 64 - np.frexp((rest >> _U(11)).astype(np.float64) + 0.5)[1] - 11
    zeros = np.minimum(zeros, 62).astype(np.uint64)
    mantissa = (rest << zeros << _U(1)) >> _U(64 - MANTISSA_BITS)
    out = np.full(REGISTERS, EMPTY, np.uint16)
    out[filled] = (zeros << _U(MANTISSA_BITS) | mantissa).astype(np.uint16)
    return out


#: Chance that two registers with different minima look alike, for sets of like size: the leading zeros agree with
#: probability 1/3, then the mantissa bits.
COLLISION = 1 / 3 / (1 << MANTISSA_BITS)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Collision-corrected Jaccard estimates of register rows, and the number of registers that either side fills."""
    filled = (a != EMPTY) | (b != EMPTY)
    used = filled.sum(axis=-1)
    alike = ((a == b) & filled).sum(axis=-1) / np.maximum(used, 1)
    return (alike - COLLISION) / (1 - COLLISION), used


def likely(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether register rows may belong to sets of that similarity: within 4.5 standard deviations of the estimate."""
    found, used = estimate(a, b)
    return found >= similarity - 4.5 * np.sqrt(similarity * (1 - similarity) / np.maximum(used, 1))


def signatures(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Per row of ``docs(row_id, doc_id, text)``: row_id, doc_id, n_shingles, a 128-bit key of its set, and registers by size class. A set also joins the
    next class where a larger set of the given similarity may stand."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, keys, classes, regs, ends = [], [], [], [], [0]
                for own in shingle_sets(part.column(2), shingle):
                    n = len(own)
                    sizes.append(n)
                    keys.append(np.array([mix(own, 21).sum(), mix(own, 22).sum()], np.uint64).tobytes() if n else None)
                    if n:
                        cls = size_class(n)
                        for c in range(cls, size_class(int(n / similarity)) + 1):
                            classes.append(c)
                            regs.append(registers(own, c).tobytes())
                    ends.append(len(classes))
                both = pa.StructArray.from_arrays([pa.array(classes, pa.int32()), pa.array(regs, pa.binary())], ["cls", "registers"])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), both)], names)

    schema = "row_id long, doc_id long, n_shingles long, set_key binary, classes array<struct<cls int, registers binary>>"
    names = ["row_id", "doc_id", "n_shingles", "set_key", "classes"]
    return docs.select("row_id", "doc_id", "text").mapInArrow(signed, schema)


def shingle_table(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """set_id and the sorted shingle hashes, as bytes, of the rows of ``docs(row_id, text)`` whose row_id is in ``wanted(set_id)``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own.tobytes() for own in shingle_sets(part.column(1), shingle)], pa.binary())], ["set_id", "shingles"])

    rows = docs.select(F.col("row_id").alias("set_id"), "text")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    return rows.join(wanted, "set_id", "left_semi").mapInArrow(cut, "set_id long, shingles binary")


#: Ids of 8 bytes: up to so many are broadcast (of wider rows a quarter), more are joined by a shuffle of the texts.
BROADCAST_IDS = 1_000_000
TILE = 512


def alike(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether sorted distinct hashes meet 100 * intersection >= percent * union."""
    both = np.sort(np.concatenate([x, y]), kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike."""
    side = lambda c: sets.select(F.col("set_id").alias(c), F.col("shingles").alias(f"set_{c}"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "set_a", "set_b")
    return materialise(both.mapInArrow(check, "a long, b long"), "neardup-links")


def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable) of the nodes that have edges (a, b): large star and small star in turn,
    each a minimum per node and a join, until no edge changes."""
    now = edges.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct()
    now = materialise(now, "components")
    while True:
        both = now.union(now.select("u", "v"))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.where("u > v").join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        small = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(small, "v")
        new = joined.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u")).union(small.select("v", F.col("m").alias("u"))).distinct()
        new = materialise(new, "components")
        mark = lambda e: e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("v", "u")).alias("h")).first()
        if mark(new) == mark(now):
            return new.select(F.col("v").alias("node"), F.col("u").alias("component")).union(new.select("u", "u").distinct())
        now = new


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, row_id: str | None = None) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: row_id, doc_id, n_shingles, component_id, kept.

    Rows are linked where 100 * intersection >= percent * union of their shingle sets (``percent`` at least 80: the bands
    find a pair of just that similarity with probability 0.99999, closer ones more surely). ``component_id`` is the
    smallest doc_id reachable; ``kept`` holds for one row of each component, the first by doc_id. A null, empty or wordless
    text has an empty set and is linked with nothing; a text of fewer words than ``shingle`` has one shingle. Null doc_ids
    come last; if all of a component are null so is component_id. Repeated rows are copies. Further columns are ignored; an
    empty table gives no rows. ``row_id`` numbers the rows once and is stored with id and text, which are read from there from
    then on; or it is the named column of ``docs``, which must then be a stored table, as by :func:`numbered`.

    Rows of equal sets are one set from then on. In a bucket of equal bands every set is first compared to the smallest
    one, and confirmed links are joined to components. Only buckets that still hold several components go on: sets of
    different components meet in tiles of 512 by 512 registers, and what the registers cannot exclude is confirmed on
    full sets in the same task. So a large group of copies costs about one comparison a set, and no pair is left out.
    """
    if not 80 <= percent <= 100:
        raise ValueError("percent must lie from 80 to 100")
    similarity = percent / 100
    small_batches(docs.sparkSession)
    rows = docs.select(*([] if row_id is None else [F.col(row_id).alias("row_id")]), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = rows if row_id else numbered(rows, "neardup-documents")[0]
    signed = materialise(signatures(docs, shingle, similarity), "neardup-signatures")
    sets = materialise(signed.where("n_shingles > 0").groupBy("set_key").agg(F.min("row_id").alias("set_id")), "neardup-set-ids")
    firsts = sets.select(F.col("set_id").alias("row_id"))
    copies = signed.where("n_shingles > 0").select("row_id").join(firsts, "row_id", "left_anti")
    copies = materialise(copies, "neardup-copies")
    if copies.count() <= BROADCAST_IDS:
        copies = F.broadcast(copies)
    distinct = signed.where("n_shingles > 0").join(copies, "row_id", "left_anti").select(F.col("row_id").alias("set_id"), F.col("n_shingles").alias("n"), "classes")

    # A bucket's number ends in its class and its band, so a row of the large shuffle is two numbers.
    byte = 2 * BAND
    one = distinct.select("set_id", "n", F.explode("classes").alias("c")).select("set_id", "n", "c.cls", "c.registers")
    number = lambda b: F.xxhash64("cls", b, F.substring("registers", b * byte + 1, F.lit(byte))).bitwiseAND(F.lit(-4096)) + F.col("cls") * BANDS + b
    bands = one.select("set_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), number)).alias("bucket")).repartition("bucket")
    buckets = bands.groupBy("bucket").agg(F.count("*").alias("n"), F.min("set_id").alias("pivot")).where("n > 1")
    members = materialise(bands.join(buckets, "bucket").withColumn("cls", F.expr(f"cast((bucket & 4095) div {BANDS} as int)")), "neardup-members")

    def excluded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array(likely(x, y, similarity)))

    # What of the table any candidate needs: its registers here, its whole set later.
    candidates = materialise(members.select("set_id").distinct(), "neardup-candidates")
    few = F.broadcast(candidates) if candidates.count() <= BROADCAST_IDS else candidates
    sides = materialise(one.join(few, "set_id", "left_semi"), "neardup-registers")
    stars = members.where("pivot <> set_id").select(F.col("pivot").alias("a"), F.col("set_id").alias("b"), "cls").groupBy("a", "b").agg(F.min("cls").alias("cls"))
    stars = stars.join(sides.select(F.col("set_id").alias("a"), "cls", F.col("registers").alias("x")), ["a", "cls"]).join(sides.select(F.col("set_id").alias("b"), "cls", F.col("registers").alias("y")), ["b", "cls"])
    stars = materialise(stars.select("a", "b", "x", "y").mapInArrow(excluded, "a long, b long"), "neardup-stars")
    full = materialise(shingle_table(docs, candidates, shingle), "neardup-sets")
    if row_id is None:
        forget(docs)  # ids and sets stand in tables of their own
    links = confirmed(stars, full, percent)
    labels = components(links)

    # What is still apart within a bucket. One that fits a tile is a cell. Else its largest component lies in tiles, and so do
    # all others; each tile of those meets every tile of both (of one stranger's component only the first's), so a large
    # component with few strangers is copied about once, not once a tile.
    named = members.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("component", "set_id"))
    apart = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("bucket")
    rest = held = materialise(named.join(apart, "bucket", "left_semi").select("bucket", "set_id", "cls", "label", "n"), "neardup-apart")
    per_label = rest.groupBy("bucket", "label").agg(F.count("*").alias("m"))
    tops = per_label.groupBy("bucket").agg(F.max(F.struct("m", "label")).alias("top"), F.count("*").alias("labels")).select("bucket", F.col("top.label").alias("top"), F.col("top.m").alias("m"), "labels")
    rest = rest.join(tops, "bucket").withColumn("big", F.col("label") == F.col("top")).withColumn("tiles", F.ceil(F.col("m") / TILE)).withColumn("others", F.ceil((F.col("n") - F.col("m")) / TILE))
    rest = rest.withColumn("tile", F.pmod(F.xxhash64("set_id"), F.when(F.col("big"), F.col("tiles")).otherwise(F.col("others"))))
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    cell = lambda kind, lo, hi, side: F.struct(F.lit(kind).alias("kind"), lo.alias("lo"), hi.alias("hi"), side.cast("long").alias("side"))
    mine = F.col("tile")
    zero, none = F.lit(0).cast("long"), F.array().cast("array<struct<kind:int,lo:bigint,hi:bigint,side:bigint>>")
    among = F.when(F.col("labels") > 2, F.transform(upto("others"), lambda o: cell(0, F.least(mine, o), F.greatest(mine, o), mine))).otherwise(none)
    across = F.when(F.col("n") <= TILE, F.array(cell(0, zero, zero, zero))).when(F.col("big"), F.transform(upto("others"), lambda o: cell(1, mine, o, F.lit(0)))).otherwise(F.concat(among, F.transform(upto("tiles"), lambda o: cell(1, o, mine, F.lit(1)))))
    rest = rest.select("bucket", "set_id", "cls", "label", across.alias("cells")).join(sides, ["set_id", "cls"]).join(full, "set_id").withColumn("band", F.expr(f"cast((bucket & 4095) % {BANDS} as int)")).withColumn("c", F.explode("cells"))
    rest = rest.select("bucket", "c.kind", "c.lo", "c.hi", "c.side", "set_id", "label", F.col("n").alias("size"), "band", "registers", "shingles")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def found() -> pa.RecordBatch:
            ids, labels, sizes, sides = (np.array([h[k] for h in held]) for k in range(4))
            regs = np.frombuffer(b"".join(h[4] for h in held), np.uint16).reshape(-1, REGISTERS)
            own = [np.frombuffer(h[6], np.uint64) for h in held]
            band, (_, kind, lo, hi) = held[0][5], key
            within = kind == 0 and lo == hi
            out = [], []
            for i in range(len(held)):
                later = np.flatnonzero((ids > ids[i]) & (labels != labels[i]) & ((sides != sides[i]) | within) & (np.minimum(sizes, sizes[i]) * 100 >= percent * np.maximum(sizes, sizes[i])))
                if len(later):
                    later = later[likely(regs[later], regs[i], similarity)]
                if len(later):  # only in the first band that the two share
                    same = (regs[later].reshape(-1, BANDS, BAND) == regs[i].reshape(BANDS, BAND)).all(axis=2)
                    later = [j for j in later[same.argmax(axis=1) == band] if alike(own[i], own[j], percent)]
                    out[0].append(np.full(len(later), ids[i]))
                    out[1].append(ids[np.array(later, np.int64)])
            ends = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
            return pa.RecordBatch.from_arrays([pa.array(e, pa.int64()) for e in ends], ["a", "b"])

        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                keys = list(zip(*(part.column(c).to_pylist() for c in range(4)), strict=True))
                values = zip(*(part.column(c).to_pylist() for c in (5, 6, 7, 4, 9, 8, 10)), strict=True)
                for now, value in zip(keys, values, strict=True):
                    if now != key:
                        if len(held) > 1:
                            yield found()
                        key, held = now, []
                    held.append(value)
        if len(held) > 1:
            yield found()

    tiled = rest.repartition("bucket", "kind", "lo", "hi").sortWithinPartitions("bucket", "kind", "lo", "hi")
    more = materialise(tiled.mapInArrow(meet, "a long, b long"), "neardup-links")
    labels = materialise(components(links.union(more)), "neardup-labels")
    forget(members, sides, stars, full, held)

    # Back to rows: set -> component -> its first row.
    of_set = sets.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").select("set_key", F.coalesce("component", "set_id").alias("component"))
    rows = signed.select("row_id", "doc_id", "n_shingles", "set_key").join(of_set, "set_key", "left").withColumn("component", F.coalesce("component", "row_id"))
    rows = materialise(rows.drop("set_key"), "neardup-rows")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id")).alias("first")
    heads = materialise(rows.groupBy("component").agg(first, F.count("*").alias("n")).where("n > 1").select("component", "first"), "neardup-heads")
    out = rows.join(F.broadcast(heads) if heads.count() <= BROADCAST_IDS // 4 else heads, "component", "left")
    alone = F.col("first").isNull()
    return out.select("row_id", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component_id"), (alone | (F.col("first.row_id") == F.col("row_id"))).alias("kept"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def oracle(shingle: int, percent: int) -> str:
    """DuckDB SQL of :func:`digest` over ``documents``: every pair that shares a shingle, then labels along the links."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    return f"""
WITH RECURSIVE split AS (
  SELECT row_number() OVER () AS number, doc_id, coalesce(regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+'), []) AS w
  FROM documents),
sets AS (
  SELECT number, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {shingle} THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - {shingle - 2}), lambda i: array_to_string(w[i : i + {shingle - 1}], ' '))) END AS s
  FROM split),
shingles AS MATERIALIZED (SELECT number, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS MATERIALIZED (
  SELECT x.number AS a, y.number AS b FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.number < y.number
  GROUP BY x.number, y.number, x.n, y.n HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))),
edges AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT number AS a, number AS b FROM sets UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a),
found AS (SELECT r.a AS number, min(s.doc_id) AS component_id FROM reach r JOIN sets s ON s.number = r.b GROUP BY r.a)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN found USING (number)"""

"""Mixing sources to target weights (operator 4), in DataFrame functions only.

Each source's documents stand in a hashed order, laid end to end twice (two epochs). The first ``target`` words of that
stream are the source's share, so a source meets its target to the word: at most one document per source is cut, and no
document is taken more than twice. The stream is cut into blocks of ``block_words``; a document belongs to the block in
which it starts. A splitting tree deals each source's blocks to output shards: every node halves its number of blocks, and
how many of each source go left is a multivariate hypergeometric draw, made by inversion from a hashed uniform. Sources'
block counts are kept exactly at every node. A shard draws its blocks from the source's permuted blocks, disjoint from
other shards' by its offset, and its rows are shuffled in the shard.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.llm.common import materialise

WEIGHTS = (3, 1, 2)
SHARE, CAP = 1.5, 2
BLOCK_WORDS, SHARD_BLOCKS = 4096, 1024
WORD = "[^\\x20\\x09-\\x0D]+"
#: Sources stand in one array at each node of the tree; more than this raises.
MAX_SOURCES = 1 << 16


@dataclass
class Mix:
    """``documents``: a row per input row with its take; ``rows``: a row per document and epoch that the mix takes."""

    documents: DataFrame
    rows: DataFrame


def sized(docs: DataFrame, seed: str, row_id: str | None = None) -> DataFrame:
    """row_id (the named column, or a new number), doc_id, source, its key (never null), size in words, place in the hashed order."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    source = F.col("source").cast("string")
    return docs.select(
        (F.col(row_id) if row_id else F.monotonically_increasing_id()).alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), source.alias("source"),
        F.coalesce(F.concat(F.lit("="), source), F.lit("")).alias("key"), size.alias("size"),
        F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).alias("place"),
    )


def targets(rows: DataFrame) -> DataFrame:
    """key, source, source_size, target: weights repeat over sources by code point, null last; what a cap of twice the
    size cuts off is shared again by weight. Filling in order of cap per weight finds the level in one pass."""
    sizes = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    level = Window.orderBy(F.col("cap") / F.col("weight"), "key").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(level), F.lit(0.0))
    goal = F.sum("source_size").over(everything) * F.lit(SHARE)
    total = F.sum("weight").over(everything)
    full = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size").cast("double") * CAP)
    full = full.withColumn("capped", F.col("cap") <= F.col("weight") * (goal - before("cap")) / (total - before("weight")))
    of_capped = lambda c: F.sum(F.when(F.col("capped"), F.col(c)).otherwise(0.0)).over(everything)
    share = F.col("weight") * (goal - of_capped("cap")) / (total - of_capped("weight"))
    return full.select("key", "source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(share).alias("target"))


def starts(rows: DataFrame) -> DataFrame:
    """Adds ``start``, the words of the source before this row in its hashed order. No task sees a whole source: rows are
    summed by three bytes of their place, and each level of at most 256 sums is laid end to end by itself."""
    byte = lambda k: F.substring("place", 2 * k - 1, 2).alias(f"b{k}")
    dealt = rows.select("*", byte(1), byte(2), byte(3))
    keys = ["key", "b1", "b2", "b3"]

    def before(value: str, group: list[str], order: list[str]) -> Column:
        return F.sum(value).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)

    inner = dealt.withColumn("start", before("size", keys, ["place", "row_id"]))
    sums = dealt.groupBy(*keys).agg(F.sum("size").alias("words"))
    for k in (3, 2, 1):
        group = keys[:k]
        level = sums.withColumn("at", before("words", group, [f"b{k}"])).select(*keys[: k + 1], F.col("at").alias(f"at{k}"))
        inner = inner.join(level, keys[: k + 1])
        sums = sums.groupBy(*group).agg(F.sum("words").alias("words"))
    return inner.withColumn("start", F.col("start") + F.col("at1") + F.col("at2") + F.col("at3")).drop("b1", "b2", "b3", "at1", "at2", "at3")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda's variable stands for it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hypergeometric(population: Column, marked: Column, drawn: Column, uniform: Column) -> Column:
    """Marked items among ``drawn`` of ``population``: the inverse of the distribution function, summed outwards from the
    mode by the ratios of neighbouring probabilities; beyond 9 standard deviations nothing is left in double precision."""

    def steps(count: Column) -> Column:
        return F.when(count >= 1, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(F.array().cast("array<int>"))

    def rise(a: Column, i: Column) -> Column:
        return (a["k"] - a["mode"] - i) * (a["n"] - a["mode"] - i) / ((a["mode"] + i + 1) * (a["rest"] - a["n"] + a["mode"] + i + 1))

    def fall(a: Column, i: Column) -> Column:
        return (a["mode"] - i) * (a["rest"] - a["n"] + a["mode"] - i) / ((a["k"] - a["mode"] + i + 1) * (a["n"] - a["mode"] + i + 1))

    def mass(a: Column, count: str, ratio: Callable[[Column, Column], Column]) -> Column:
        begin = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("t"))
        step = lambda s, i: let(s["p"] * ratio(a, i), lambda p: F.struct(p.alias("p"), (s["t"] + p).alias("t")))
        return F.aggregate(steps(a[count]), begin, step)["t"]

    def walk(a: Column, count: str, ratio: Callable[[Column, Column], Column], done: Column, sign: int) -> Column:
        begin = F.struct(F.lit(1.0).alias("p"), done.alias("t"), F.lit(None).cast("double").alias("x"))
        reached = lambda s, i, p: F.coalesce(s["x"], F.when(a["goal"] < s["t"] + p, a["mode"] + sign * (i + 1)))
        step = lambda s, i: let(s["p"] * ratio(a, i), lambda p: F.struct(p.alias("p"), (s["t"] + p).alias("t"), reached(s, i, p).alias("x")))
        return F.aggregate(steps(a[count]), begin, step)["x"]

    def more(a: Column, **values: Column) -> Column:
        return F.struct(*[a[c].alias(c) for c in fields], *[v.alias(c) for c, v in values.items()])

    def limits(a: Column) -> Column:
        low, high = F.greatest(F.lit(0.0), a["n"] - a["rest"]), F.least(a["n"], a["k"])
        share = F.when(a["k"] + a["rest"] > 0, a["k"] / (a["k"] + a["rest"])).otherwise(0.0)
        return F.struct(*[a[c].alias(c) for c in ("k", "rest", "n", "u")], low.alias("low"), high.alias("high"), F.ceil(9 * F.sqrt(a["n"] * share * (1 - share)) + 12).cast("double").alias("reach"))

    def middle(a: Column) -> Column:
        mode = F.least(a["high"], F.greatest(a["low"], F.floor((a["n"] + 1) * (a["k"] + 1) / (a["k"] + a["rest"] + 2)).cast("double")))
        return F.struct(*[a[c].alias(c) for c in ("k", "rest", "n", "u", "low", "high", "reach")], mode.alias("mode"))

    fields = ("k", "rest", "n", "u", "mode")
    ends = lambda a: more(a, up=F.least(a["high"] - a["mode"], a["reach"]), down=F.least(a["mode"] - a["low"], a["reach"]))
    sums = lambda a: more(a, up=a["up"], down=a["down"], above=mass(a, "up", rise), below=mass(a, "down", fall))
    goal = lambda a: more(a, up=a["up"], down=a["down"], above=a["above"], goal=a["u"] * (1.0 + a["above"] + a["below"]))
    find = lambda a: F.when(a["goal"] < 1.0, a["mode"]).otherwise(F.coalesce(walk(a, "up", rise, F.lit(1.0), 1), walk(a, "down", fall, 1.0 + a["above"], -1), a["mode"] - a["down"]))
    begin = F.struct(marked.cast("double").alias("k"), (population - marked).cast("double").alias("rest"), drawn.cast("double").alias("n"), uniform.alias("u"))
    found = let(begin, lambda a: let(limits(a), lambda b: let(middle(b), lambda c: let(ends(c), lambda d: let(sums(d), lambda e: let(goal(e), find))))))
    return found.cast("long")


#: Primes above any step of interest; a source's blocks are multiplied by one that does not divide their number.
MULTIPLIERS = (1000003, 1000033, 1000037, 1000039, 1000081, 1000099, 1000117, 1000121)


def permutation(seed: str, key: Column, blocks: Column) -> tuple[Column, Column]:
    """Multiplier and shift by which ``pmod(block * multiplier + shift, blocks)`` permutes a source's blocks. Both hang on
    seed and source; a multiplier that would leave neighbours side by side is taken only where there is no other (as of
    fewer than five blocks)."""
    first = F.xxhash64(F.lit(seed), F.lit("multiplier"), key)
    turned = F.transform(F.sequence(F.lit(0), F.lit(len(MULTIPLIERS) - 1)), lambda i: F.element_at(F.array(*map(F.lit, MULTIPLIERS)), (F.pmod(first + i, F.lit(len(MULTIPLIERS))) + 1).cast("int")))
    whole = F.filter(turned, lambda p: blocks % p != 0)
    mixed = F.filter(whole, lambda p: ~(p % blocks).isin(1, blocks - 1))
    return F.coalesce(F.get(mixed, F.lit(0)), F.get(whole, F.lit(0))).cast("long"), F.pmod(F.xxhash64(F.lit(seed), F.lit("shift"), key), blocks)


def splitting_tree(sources: DataFrame, levels: int, seed: str) -> DataFrame:
    """``sources(key, blocks)`` to leaves: shard, key, quota, offset (blocks of the source that earlier shards hold)."""
    entries = F.sort_array(F.collect_list(F.struct("key", "blocks")))
    nodes = sources.groupBy().agg(entries.alias("e")).select(
        F.lit(0).cast("long").alias("shard"), F.col("e.key").alias("keys"), F.col("e.blocks").alias("quotas"), F.transform("e", lambda _: F.lit(0).cast("long")).alias("offsets"))
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    for level in range(levels):
        if level and level % 4 == 0:
            nodes = nodes.repartition(max(parts, min(1 << level, 10_000)), "shard")
        total = F.aggregate("quotas", F.lit(0).cast("long"), lambda a, q: a + q)
        nodes = nodes.withColumn("total", total)
        uniform = lambda i: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(level), F.col("shard"), i), 11) * F.lit(2.0**-53)  # noqa: B023, E731
        zero = F.struct(F.col("total").alias("n"), F.floor(F.col("total") / 2).alias("take"), F.array().cast("array<long>").alias("left"))

        def draw(a: Column, i: Column) -> Column:
            quota = F.element_at("quotas", i)
            drawn = hypergeometric(a["n"], quota, a["take"], uniform(i))  # noqa: B023
            return let(drawn, lambda x: F.struct((a["n"] - quota).alias("n"), (a["take"] - x).alias("take"), F.array_append(a["left"], x).alias("left")))

        left = F.aggregate(F.sequence(F.lit(1), F.size("quotas")), zero, draw)["left"]
        nodes = nodes.withColumn("left", left)
        halves = F.array(
            F.struct((F.col("shard") * 2).alias("shard"), F.col("left").alias("quotas"), F.col("offsets").alias("offsets")),
            F.struct((F.col("shard") * 2 + 1).alias("shard"), F.zip_with("quotas", "left", lambda q, x: q - x).alias("quotas"), F.zip_with("offsets", "left", lambda o, x: o + x).alias("offsets")),
        )
        nodes = nodes.select("keys", F.explode(halves).alias("h")).select("h.shard", "keys", "h.quotas", "h.offsets")
    leaf = F.explode(F.arrays_zip("keys", "quotas", "offsets")).alias("z")
    return nodes.select("shard", leaf).select("shard", F.col("z.keys").alias("key"), F.col("z.quotas").alias("quota"), F.col("z.offsets").alias("offset")).where("quota > 0")


def mix(docs: DataFrame, seed: str = "mix", block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, row_id: str | None = None) -> Mix:
    """Mix ``docs(doc_id, text, source)``.

    ``documents``: row_id, doc_id, source, size, source_size, target, taken. ``rows``: row_id, doc_id, epoch (0, 1), words
    (the first so many of the document), size, block, shard, position in the shard. A null or wordless text has size 0 and
    is never taken; null sources are one source, last; a null doc_id is a document like others; repeated rows stay separate
    documents. An empty table gives no rows. Reruns agree: order and draws hang on ``seed`` and ids alone.
    To find rows again by row_id, name a stored column of ``docs`` that numbers them.
    """
    base = materialise(sized(docs, seed, row_id), "mix-sizes")
    shares = materialise(targets(base), "mix-targets")  # a row per source
    n_sources = shares.count()
    if n_sources > MAX_SOURCES:
        raise ValueError(f"{n_sources} sources; the tree holds {MAX_SOURCES}")
    quota = shares.select("key", "source_size", "target", F.floor(F.col("target") + 0.5).alias("words")).withColumn("blocks", F.ceil(F.col("words") / block_words))
    multiplier, shift = permutation(seed, F.col("key"), F.greatest(F.lit(1), F.col("blocks")))
    quota = quota.withColumn("multiplier", multiplier).withColumn("shift", shift)
    total = quota.agg(F.coalesce(F.sum("blocks"), F.lit(0)).alias("n")).first()["n"]
    levels = max(0, -(-total // shard_blocks) - 1).bit_length()
    # At most MAX_SOURCES rows, as checked.
    placed = starts(base).join(F.broadcast(quota), "key")
    take = lambda epoch: F.greatest(F.lit(0), F.least(F.col("size"), F.col("words") - F.col("source_size") * epoch - F.col("start"))).cast("long")
    placed = materialise(placed.withColumn("taken", take(0) + take(1)), "mix-placed")
    epochs = placed.select("row_id", "doc_id", "key", "size", "place", "source_size", "start", "blocks", "multiplier", "shift", F.explode(F.array(*[F.struct(F.lit(e).alias("epoch"), take(e).alias("words")) for e in (0, 1)])).alias("e"))
    rows = epochs.where("e.words > 0").select("row_id", "doc_id", "key", "size", "place", "blocks", "multiplier", "shift", "e.epoch", "e.words", F.floor((F.col("source_size") * F.col("e.epoch") + F.col("start")) / block_words).alias("block"))
    cells = F.greatest(F.lit(1), F.ceil(F.col("blocks") / (1 << levels)))
    rows = rows.withColumn("drawn", F.pmod(F.col("block") * F.col("multiplier") + F.col("shift"), F.col("blocks"))).withColumn("cell", F.floor(F.col("drawn") / cells))
    leaves = splitting_tree(quota.where("blocks > 0").select("key", "blocks"), levels, seed)
    leaves = leaves.join(F.broadcast(quota.select("key", "blocks")), "key").select("key", "shard", "quota", "offset", F.explode(F.sequence(F.floor(F.col("offset") / cells), F.floor((F.col("offset") + F.col("quota") - 1) / cells))).alias("cell"))
    dealt = rows.join(leaves, ["key", "cell"]).where((F.col("drawn") >= F.col("offset")) & (F.col("drawn") < F.col("offset") + F.col("quota")))
    position = F.row_number().over(Window.partitionBy("shard").orderBy(F.xxhash64(F.lit(seed), "shard", "epoch", "place"), "row_id", "epoch")) - 1
    out = dealt.withColumn("position", position).select("row_id", "doc_id", "epoch", "words", "size", "block", "shard", "position")
    return Mix(placed.select("row_id", "doc_id", "source", "size", "source_size", "target", "taken"), out)


def digest(mixed: Mix) -> DataFrame:
    """Per document what the mix's rows take of it: doc_id, size, source_size, target, taken."""
    took = mixed.rows.groupBy("row_id").agg(F.sum("words").alias("took"))
    return mixed.documents.join(took, "row_id", "left").select("doc_id", "size", "source_size", "target", F.coalesce("took", F.lit(0)).alias("taken"))


def oracle(seed: str = "mix") -> str:
    """DuckDB SQL of :func:`digest`."""
    weights = " ".join(f"WHEN {i} THEN {w}.0" for i, w in enumerate(WEIGHTS))
    return f"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS size, md5(concat_ws('|', '{seed}', coalesce(CAST(doc_id AS VARCHAR), ''))) AS place
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} {weights} END AS weight, CAST(source_size AS DOUBLE) * {CAP} AS cap FROM sources),
levels AS (
  SELECT *, cap <= weight * (sum(source_size) OVER () * {SHARE}::DOUBLE - coalesce(sum(cap) OVER w, 0.0::DOUBLE)) / (sum(weight::DOUBLE) OVER () - coalesce(sum(weight::DOUBLE) OVER w, 0.0::DOUBLE)) AS capped
  FROM weighed WINDOW w AS (ORDER BY cap / weight::DOUBLE, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
shares AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE weight::DOUBLE * (sum(source_size) OVER () * {SHARE}::DOUBLE - sum(CASE WHEN capped THEN cap ELSE 0.0::DOUBLE END) OVER ()) / (sum(weight::DOUBLE) OVER () - sum(CASE WHEN capped THEN weight::DOUBLE ELSE 0.0::DOUBLE END) OVER ()) END AS target
  FROM levels),
placed AS (
  SELECT d.doc_id, d.size, s.source_size, s.target, CAST(floor(s.target + 0.5) AS BIGINT) AS words,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
  FROM sized d JOIN shares s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(greatest(0, least(size, words - start)) + greatest(0, least(size, words - source_size - start)) AS BIGINT) AS taken
FROM placed"""

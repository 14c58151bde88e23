"""Detectors and channels on documents: definitions, overlapping validity, defective derogations, inversions, structure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.operators.detection import stricter


def divergent_definitions(rows: DataFrame) -> DataFrame:
    """A6: (concept, a, b): definitions of one canonical concept in different documents whose texts differ. Equal texts are one
    row with its smallest id, so copies make no pairs. ``rows(id, doc, concept, definition)``."""
    one = rows.where("concept IS NOT NULL").groupBy("concept", "doc", "definition").agg(F.min("id").alias("id"))
    x, y = one.alias("x"), one.alias("y")
    met = x.join(y, (F.col("x.concept") == F.col("y.concept")) & (F.col("x.doc") != F.col("y.doc")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.definition") != F.col("y.definition")))
    return met.select(F.col("x.concept").alias("concept"), F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def overlapping(contradictions: DataFrame, periods: DataFrame) -> DataFrame:
    """A7: ``contradictions(a, b)`` whose sides are in force on a common day, with that period; open bounds are infinite.
    ``periods(id, starts, ends)``; a side without a row is always in force."""
    side = lambda c: periods.select(F.col("id").alias(c), F.col("starts").alias(f"starts_{c}"), F.col("ends").alias(f"ends_{c}"))
    both = contradictions.join(side("a"), "a", "left").join(side("b"), "b", "left")
    starts, ends = F.greatest("starts_a", "starts_b"), F.least("ends_a", "ends_b")
    return both.select("a", "b", starts.alias("starts"), ends.alias("ends")).where("starts IS NULL OR ends IS NULL OR starts <= ends")


def cited_while_invalid(citations: DataFrame, periods: DataFrame) -> DataFrame:
    """A7: ``citations(id, target, day)`` of a target that is not in force on that day. ``periods(id, starts, ends)``."""
    known = periods.select(F.col("id").alias("target"), "starts", "ends")
    return citations.join(known, "target").where("day < starts OR day > ends").select("id", "target", "day")


def derogation_defect(target_found: Column, target_replaced: Column, justification: Column, approver: Column, due: Column, day: Column) -> Column:
    """A8: the first of ORPHAN, OBSOLETE_TARGET, UNTRACED, EXPIRED; null for a sound derogation."""
    return (
        F.when(~F.coalesce(target_found, F.lit(False)), "ORPHAN").when(F.coalesce(target_replaced, F.lit(False)), "OBSOLETE_TARGET")
        .when(justification.isNull() | approver.isNull() | due.isNull(), "UNTRACED").when(due < day, "EXPIRED")
    )


def inverted(level_a: Column, level_b: Column, value_a: Column, value_b: Column, role: Column) -> Column:
    """A9: the lower document (higher level number) asks less than the one above it; null levels and values never do."""
    strict = stricter(value_a, value_b, role)
    return F.coalesce(((level_a > level_b) & (strict == "B")) | ((level_b > level_a) & (strict == "A")), F.lit(False))


def structural_channel(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """Channel 1: pairs (a, b, score 1) of clauses joined by an explicit edge between documents. ``edges(a, b)``, ``owners(id, doc)``."""
    doc = lambda c: owners.select(F.col("id").alias(c), F.col("doc").alias(f"doc_{c}"))
    met = edges.select("a", "b").join(doc("a"), "a").join(doc("b"), "b").where("doc_a <> doc_b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(1.0).alias("score")).distinct()


def temporal_relation(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Relation of two periods as conditions, open bounds infinite: IDENTITY, DISJOINT, INCLUDED_IN, INCLUDES or OVERLAPS."""
    low, high = F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date")
    a0, a1, b0, b1 = F.coalesce(start_a, low), F.coalesce(end_a, high), F.coalesce(start_b, low), F.coalesce(end_b, high)
    return F.when((a0 == b0) & (a1 == b1), "IDENTITY").when((a1 < b0) | (b1 < a0), "DISJOINT").when((a0 >= b0) & (a1 <= b1), "INCLUDED_IN").when((a0 <= b0) & (a1 >= b1), "INCLUDES").otherwise("OVERLAPS")


def population_relation(a: Column, b: Column) -> Column:
    """Relation of two populations given as arrays of members; an empty one is everybody."""
    meet = F.size(F.array_intersect(a, b))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), "IDENTITY").when(F.size(a) == 0, "INCLUDES").when(F.size(b) == 0, "INCLUDED_IN").when(meet == 0, "DISJOINT")
        .when((meet == F.size(F.array_distinct(a))) & (meet == F.size(F.array_distinct(b))), "IDENTITY").when(meet == F.size(F.array_distinct(a)), "INCLUDED_IN").when(meet == F.size(F.array_distinct(b)), "INCLUDES").otherwise("OVERLAPS")
    )


def vector_relation(cosine: Column, same: float = 0.92) -> Column:
    """Level 3: conditions of like meaning are identical, others stay undetermined."""
    return F.when(cosine >= same, "IDENTITY").otherwise("UNDETERMINED")


def agreed(votes: DataFrame, share: float = 0.6) -> DataFrame:
    """Judge guards: ``votes(a, b, swapped, verdict, confidence)``. A pair's verdict holds if both orders of its sides have the same
    most frequent verdict and that has ``share`` of all votes; else it is ABSTENTION. (a, b, verdict, votes, confidence)."""
    counted = votes.groupBy("a", "b", "swapped", "verdict").agg(F.count("*").alias("n"), F.avg("confidence").alias("c"))
    first = F.row_number().over(Window.partitionBy("a", "b", "swapped").orderBy(F.desc("n"), "verdict"))
    total = F.sum("n").over(Window.partitionBy("a", "b", "swapped"))
    best = counted.withColumn("all", total).withColumn("place", first).where("place = 1")
    both = best.groupBy("a", "b").agg(F.count_distinct("verdict").alias("kinds"), F.count("*").alias("orders"), F.min("verdict").alias("verdict"), F.sum("n").alias("n"), F.sum("all").alias("all"), F.avg("c").alias("c"))
    holds = (F.col("kinds") == 1) & (F.col("orders") == 2) & (F.col("n") >= share * F.col("all"))
    return both.select("a", "b", F.when(holds, F.col("verdict")).otherwise("ABSTENTION").alias("verdict"), F.col("all").alias("votes"), F.round("c", 6).alias("confidence"))

"""Condition algebra: relations of distinct conditions over a place lattice and thresholds; relations of whole scopes.

Relations: IDENTITY, INCLUDED_IN, INCLUDES, OVERLAPS, DISJOINT, UNDETERMINED. Unknown never becomes disjoint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.operators.ranking import fixed


def ancestors(parents: DataFrame) -> DataFrame:
    """(place, ancestor, distance) from ``parents(place, parent)``, to any depth: until no pair is new, so cycles end too."""
    step = parents.where("parent IS NOT NULL").select("place", "parent").distinct()
    out = level = fixed(step.select("place", F.col("parent").alias("ancestor"), F.lit(1).alias("distance")))
    distance = 1
    while not level.isEmpty():
        distance += 1
        met = level.alias("l").join(step.alias("s"), F.col("l.ancestor") == F.col("s.place")).select("l.place", F.col("s.parent").alias("ancestor")).distinct()
        level = fixed(met.join(out, ["place", "ancestor"], "left_anti").withColumn("distance", F.lit(distance)))
        out = out.union(level)
    return out


def spatial_relation(a: Column, b: Column, a_below_b: Column, b_below_a: Column, siblings: Column) -> Column:
    """Places: equal, one below the other, of one parent, or unknown. A null place is everywhere."""
    return (
        F.when(a.isNull() & b.isNull(), "IDENTITY").when(a.isNull(), "INCLUDES").when(b.isNull(), "INCLUDED_IN").when(a == b, "IDENTITY")
        .when(a_below_b, "INCLUDED_IN").when(b_below_a, "INCLUDES").when(siblings, "DISJOINT").otherwise("UNDETERMINED")
    )


def threshold_relation(op_a: Column, value_a: Column, op_b: Column, value_b: Column) -> Column:
    """Half-lines given by < <= > >= and a bound."""
    up_a, up_b = op_a.isin(">", ">="), op_b.isin(">", ">=")
    same = (op_a == op_b) & (value_a == value_b)
    tighter = F.when(up_a, (value_a > value_b) | ((value_a == value_b) & (op_a == ">"))).otherwise((value_a < value_b) | ((value_a == value_b) & (op_a == "<")))
    low, high = F.when(up_a, value_a).otherwise(value_b), F.when(up_a, value_b).otherwise(value_a)
    closed = op_a.isin(">=", "<=") & op_b.isin(">=", "<=")
    apart = (low > high) | ((low == high) & ~closed)
    return (
        F.when(value_a.isNull() | value_b.isNull(), "UNDETERMINED").when(same, "IDENTITY").when((up_a == up_b) & tighter, "INCLUDED_IN")
        .when(up_a == up_b, "INCLUDES").when(apart, "DISJOINT").otherwise("OVERLAPS")
    )


def lattice_pairs(conditions: DataFrame, parents: DataFrame) -> DataFrame:
    """(a, b, relation) of distinct spatial ``conditions(id, place)`` that the lattice relates: only relatives are joined
    (ancestor paths and siblings), so unrelated places cost nothing and stay UNDETERMINED."""
    places = conditions.select("id", "place").distinct()
    up = ancestors(parents)
    one = places.select(F.col("id").alias("a"), F.col("place").alias("place_a"))
    two = places.select(F.col("id").alias("b"), F.col("place").alias("place_b"))
    below = one.join(up, F.col("place_a") == F.col("place")).join(two, F.col("ancestor") == F.col("place_b")).select("a", "b", F.lit("INCLUDED_IN").alias("relation"))
    kin = one.join(parents.select(F.col("place").alias("pa"), "parent"), F.col("place_a") == F.col("pa")).join(parents.select(F.col("place").alias("pb"), F.col("parent").alias("parent_b")), F.col("parent") == F.col("parent_b")).join(two, F.col("pb") == F.col("place_b"))
    apart = kin.where("place_a <> place_b AND a < b").select("a", "b", F.lit("DISJOINT").alias("relation"))
    return below.union(apart)


def scope_relation(relations: DataFrame) -> DataFrame:
    """(a, b, relation) of clauses from their conditions' ``relations(a, b, cond_a, cond_b, relation)``, a full grid of the
    two lists: any disjoint couple makes the scopes disjoint; a scope lies inside another if each of that one's conditions
    holds one of its own; both ways is identity; anything undetermined else stays undetermined."""
    is_in = lambda c, *r: F.max(F.col("relation").isin(*r).cast("int")).alias(c)
    of_b = relations.groupBy("a", "b", "cond_b").agg(is_in("covered", "IDENTITY", "INCLUDED_IN"))
    of_a = relations.groupBy("a", "b", "cond_a").agg(is_in("covered", "IDENTITY", "INCLUDES"))
    inside = of_b.groupBy("a", "b").agg(F.min("covered").alias("a_in_b"))
    around = of_a.groupBy("a", "b").agg(F.min("covered").alias("b_in_a"))
    any_ = relations.groupBy("a", "b").agg(is_in("apart", "DISJOINT"), is_in("open", "UNDETERMINED"))
    all_ = any_.join(inside, ["a", "b"]).join(around, ["a", "b"])
    verdict = (
        F.when(F.col("apart") == 1, "DISJOINT").when((F.col("a_in_b") == 1) & (F.col("b_in_a") == 1), "IDENTITY").when(F.col("a_in_b") == 1, "INCLUDED_IN")
        .when(F.col("b_in_a") == 1, "INCLUDES").otherwise("UNDETERMINED")
    )
    return all_.select("a", "b", verdict.alias("relation"))


def scopes(pairs: DataFrame, held: DataFrame, related: DataFrame) -> DataFrame:
    """(a, b, relation) for every row of ``pairs(a, b)`` from ``held(clause, cond)`` and ``related(cond_a, cond_b, relation)``:
    no condition on either side is the same scope, none on one side is the wider one. Equal conditions are identical, pairs
    that ``related`` lacks are undetermined; a relation counts in the other direction too."""
    a = held.select(F.col("clause").alias("a"), F.col("cond").alias("cond_a"))
    b = held.select(F.col("clause").alias("b"), F.col("cond").alias("cond_b"))
    back = F.when(F.col("relation") == "INCLUDED_IN", "INCLUDES").when(F.col("relation") == "INCLUDES", "INCLUDED_IN").otherwise(F.col("relation"))
    known = related.unionByName(related.select(F.col("cond_b").alias("cond_a"), F.col("cond_a").alias("cond_b"), back.alias("relation"))).distinct()
    grid = pairs.select("a", "b").distinct().join(a, "a").join(b, "b").join(known, ["cond_a", "cond_b"], "left")
    grid = grid.withColumn("relation", F.when(F.col("cond_a") == F.col("cond_b"), "IDENTITY").otherwise(F.coalesce("relation", F.lit("UNDETERMINED"))))
    has_a, has_b = (held.select(F.col("clause").alias(c), F.lit(True).alias(f"has_{c}")).distinct() for c in ("a", "b"))
    both = pairs.select("a", "b").distinct().join(has_a, "a", "left").join(has_b, "b", "left").join(scope_relation(grid), ["a", "b"], "left")
    empty_a, empty_b = F.col("has_a").isNull(), F.col("has_b").isNull()
    return both.select("a", "b", F.when(empty_a & empty_b, "IDENTITY").when(empty_b, "INCLUDED_IN").when(empty_a, "INCLUDES").otherwise(F.col("relation")).alias("relation"))


def typed_relation(kind_a: Column, kind_b: Column, spatial: Column, threshold: Column, same_surface: Column) -> Column:
    """Relation of two conditions by kind: equal surfaces are identical, other kinds than the other's undetermined."""
    return F.when(same_surface, "IDENTITY").when(kind_a != kind_b, "UNDETERMINED").when(kind_a == "SPATIAL", spatial).when(kind_a == "SEUIL", threshold).otherwise("UNDETERMINED")


def effective_scope(conditions: Column, quantities: Column) -> Column:
    """Condition surfaces without those that hold a quantity's surface."""
    return F.filter(conditions, lambda c: ~F.exists(quantities, lambda q: F.contains(c, q)))

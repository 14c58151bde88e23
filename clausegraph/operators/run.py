"""From texts to findings: segmentation, frames, channels, cascade, sealing, rubrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clausegraph.functions.text import condition_id
from clausegraph.operators import conditions, detection, frames, segmentation, sentences, targeting, vocabulary
from clausegraph.operators import extraction as X
from clausegraph.operators.ranking import fixed

CHANNELS = {"KEY": 1.5, "DIMENSION": 1.0, "CONCEPTUAL": 1.0}


def clause_frames(docs: DataFrame) -> DataFrame:
    """Frames of every clause of ``docs(id, text)``, stored."""
    found = segmentation.clauses(segmentation.structured(segmentation.lines(docs)))
    return fixed(frames.frames(sentences.standalone(found)).withColumn("proof", X.quantity_surface(F.col("text"))))


def channels(rows: DataFrame, wanted: tuple[str, ...] = tuple(CHANNELS), floor: float = 0.0) -> dict[str, DataFrame]:
    """Pairs (a, b, score) by channel; a channel left out of ``wanted`` is not planned at all."""
    q = rows.where("quantity IS NOT NULL").select(F.col("clause_id").alias("id"), F.col("id").alias("doc"), F.col("quantity.role").alias("role"), F.col("quantity.si").alias("value"))
    part = lambda c: F.get(c, F.lit(0))
    key = vocabulary.comparison_key(part("actors"), F.col("action"), part("objects"), F.col("quantity.role"), F.col("quantity.role"))
    made = {}
    if "KEY" in wanted:
        made["KEY"] = targeting.key_channel(rows.where(F.col("action").isNotNull() & (F.size("objects") > 0)).select(F.col("clause_id").alias("id"), F.col("id").alias("doc"), key.alias("key")))
    if "DIMENSION" in wanted:
        made["DIMENSION"] = targeting.dimension_channel(q.withColumn("dimension", F.col("role")).withColumn("weight", F.col("value").cast("double")).where("value IS NOT NULL"))
    if "CONCEPTUAL" in wanted:
        mentions = rows.select(F.col("clause_id").alias("id"), F.col("id").alias("doc"), F.explode("objects").alias("concept"))
        known = vocabulary.idf(mentions.select("id", "concept"), rows.count()).where(F.col("idf") > floor).select("concept", "idf")
        made["CONCEPTUAL"] = targeting.conceptual_channel(mentions.join(known, "concept")).select("a", "b", "score")
    return made


def candidates(rows: DataFrame, wanted: tuple[str, ...] = tuple(CHANNELS), k: int = 8) -> DataFrame:
    """(a, b, rrf, channels, ranks, kept): channels ranked, fused and put under the two-sided budget."""
    ranked = [targeting.rank_channel(pairs, name) for name, pairs in channels(rows, wanted).items()]
    return targeting.within_budget(targeting.fuse(ranked, CHANNELS), k)


def scope_relations(rows: DataFrame, pairs: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """(a, b, relation) of clause pairs. A condition that holds a quantity's words is no scope. ``places(place, parent)``, labels
    as in the conditions' surfaces, relates spatial ones; other conditions are equal or undetermined."""
    own = F.filter("conditions", lambda c: F.col("proof").isNull() | ~F.contains(c["surface"], F.lower(F.col("proof"))))
    held = rows.select(F.col("clause_id").alias("clause"), F.explode(own).alias("c")).select("clause", condition_id(F.col("c.kind"), F.col("c.surface")).alias("cond"), "c.kind", "c.surface")
    if places is None:
        related = held.sparkSession.createDataFrame([], "cond_a string, cond_b string, relation string")
    else:
        named = held.where("kind = 'SPATIAL'").select(F.col("cond").alias("id"), F.regexp_replace("surface", "^(?:en|sur|dans) ", "").alias("place")).distinct()
        related = conditions.lattice_pairs(named, places).select(F.col("a").alias("cond_a"), F.col("b").alias("cond_b"), "relation")
    return conditions.scopes(pairs, held.select("clause", "cond").distinct(), related)


def pair_verdicts(rows: DataFrame, pairs: DataFrame, norms: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Verdicts of stage A on ``pairs(a, b)``: value divergence, deontic conflict, diverging norms, up to the first firm one, firm
    only with literal proofs. (a, b, step, detector, verdict, motif, gravity, confidence, firm, scope, proof_a, proof_b)."""
    cited = F.array_distinct(F.transform(F.filter("references", lambda r: r["kind"] == "NORM"), lambda r: r["target"]))
    side = lambda c: rows.select(F.col("clause_id").alias(c), F.struct("text", "modality", "modality_surface", "quantity", "proof", "objects", cited.alias("norms"), F.transform(F.filter("references", lambda r: r["kind"] == "NORM"), lambda r: r["surface"]).alias("norm_words")).alias(f"f{c}"))
    both = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b").join(scope_relations(rows, pairs, places).withColumnRenamed("relation", "scope"), ["a", "b"])
    a, b = F.col("fa"), F.col("fb")
    shared = frames.shared_objects(a["objects"], b["objects"])
    literal = lambda p: F.coalesce(p.cast("string"), F.lit(""))

    def step(number: int, name: str, when: Column, found: dict[str, Column], proof_a: Column, proof_b: Column) -> DataFrame:
        firm = detection.sealed(found["firm"], proof_a, a["text"], proof_b, b["text"])
        motif = F.when(found["firm"] & ~firm, "PREUVE_LITTERALE_ABSENTE").otherwise(found["motif"])
        return both.where(when).select("a", "b", F.lit(number).alias("step"), F.lit(name).alias("detector"), found["verdict"].alias("verdict"), motif.alias("motif"), found["gravity"].alias("gravity"), found["confidence"].cast("double").alias("confidence"), firm.alias("firm"), "scope", literal(proof_a).alias("proof_a"), literal(proof_b).alias("proof_b"))

    same_role = F.coalesce(a["quantity"]["role"] == b["quantity"]["role"], F.lit(False))
    normal = (a["quantity"]["status"] == "NORMAL") & (b["quantity"]["status"] == "NORMAL")
    value = detection.divergence(a["quantity"]["si"].cast("double"), b["quantity"]["si"].cast("double"), a["quantity"]["role"], F.col("scope"), shared, normal)
    deontic = detection.deontic(a["modality"], b["modality"], F.col("scope"), shared)
    deontic["gravity"] = F.when(deontic["kind"] == "NEGATION", "CRITIQUE").when(deontic["kind"] == "PERSPECTIVE", "ELEVEE")
    apart = {"verdict": F.lit("CONTRADICTION"), "motif": F.lit("ETABLI"), "gravity": F.lit("ELEVEE"), "confidence": F.lit(0.95), "firm": F.lit(True)}
    steps = [
        step(1, "VALUE", same_role, value, a["proof"], b["proof"]), step(2, "DEONTIC", F.lit(True), deontic, a["modality_surface"], b["modality_surface"]),
        step(3, "NORMS", detection.diverging_norms(a["norms"], b["norms"]), apart, F.get(a["norm_words"], F.lit(0)), F.get(b["norm_words"], F.lit(0))),
    ]
    return detection.cascade(reduce(DataFrame.union, steps))


def clause_verdicts(rows: DataFrame, docs: DataFrame, norms: DataFrame) -> DataFrame:
    """Findings on one clause: unresolved internal references, obsolete norms. (clause, finding, confidence, proof)."""
    refs = rows.select(F.col("clause_id").alias("clause"), F.col("id").alias("doc"), F.explode("references").alias("r")).select("clause", "doc", "r.kind", "r.target", "r.section", "r.surface")
    head = segmentation.front_matter(segmentation.structured(segmentation.lines(docs)))
    known = frames.resolved(refs, head.select(F.col("id").alias("doc"), "code"), rows.select(F.col("id").alias("doc"), "section"))
    broken = known.where("NOT resolved").select("clause", F.lit("REFERENCE_CASSEE").alias("finding"), F.lit(0.98).alias("confidence"), F.col("surface").alias("proof"))
    old = norms.where("retired OR replaced_by IS NOT NULL").select(F.col("code").alias("target"))
    cited = known.where("kind = 'NORM'").join(old, "target", "left_semi").select("clause", F.lit("REFERENTIEL_OBSOLETE"), F.lit(0.97), "surface")
    return broken.union(cited)


def findings(docs: DataFrame, norms: DataFrame, places: DataFrame | None = None, wanted: tuple[str, ...] = tuple(CHANNELS)) -> DataFrame:
    """Everything that ``docs(id, text)`` gives: (a, b, detector, verdict, motif, gravity, confidence, firm, proof_a, proof_b,
    rubric), one row per pair verdict and per single-clause finding (b null). ``norms(code, retired, replaced_by)``."""
    rows = clause_frames(docs)
    pairs = fixed(candidates(rows, wanted).where("kept").select("a", "b"))
    found = pair_verdicts(rows, pairs, norms, places)
    rubric = detection.rubric(F.col("verdict"), F.col("firm"), F.col("confidence"), F.col("motif"))
    several = found.select("a", "b", "detector", "verdict", "motif", "gravity", "confidence", "firm", "proof_a", "proof_b", rubric.alias("rubric"))
    single = clause_verdicts(rows, docs, norms)
    none = F.lit(None).cast("string")
    alone = single.select(F.col("clause").alias("a"), none.alias("b"), F.lit("REFERENCE").alias("detector"), F.col("finding").alias("verdict"), F.lit("ETABLI").alias("motif"), F.when(F.col("finding") == "REFERENCE_CASSEE", "MOYENNE").otherwise("ELEVEE").alias("gravity"), "confidence", F.lit(True).alias("firm"), F.col("proof").alias("proof_a"), none.alias("proof_b"), F.lit("FINDING").alias("rubric"))
    return several.union(alone)

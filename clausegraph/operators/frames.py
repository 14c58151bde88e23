"""Clause frames: typed references and their resolution, threshold conditions, actors, actions, objects, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.functions.text import canonical_form, label
from clausegraph.operators import extraction as X

REFERENCE = "struct<kind:string,target:string,section:string,surface:string>"
# People and bodies that act, as labels; infinitives behind a modal stand as they are.
ACTORS = (
    "responsable qse", "responsable securite", "referent securite", "chef d equipe", "chef d atelier", "chef de site", "direction generale", "direction", "directeur", "encadrement", "superviseur", "operateur", "operateurs", "technicien",
    "intervenant", "intervenants", "salarie", "salaries", "personnel", "collaborateur", "collaborateurs", "sous traitant", "sous traitants", "gardien", "magasinier", "equipe", "equipes", "secouriste", "secouristes", "employeur", "visiteur", "visiteurs",
)
_CODE = r"[A-Z]{2,4}-[A-Z]{2,4}-\d{2,3}"
_AFTER = r"(?iu)§\s*(\d+(?:\.\d+)?)\s+de\s+la\s+(?:présente\s+procédure|présente\s+politique|politique|procédure|instruction)(?:\s+(" + _CODE + r"))?"
_BEFORE = r"(?iu)(?:politique|procédure|instruction)\s+(" + _CODE + r")\s+§\s*(\d+(?:\.\d+)?)"
_BARE = r"§\s*(\d+(?:\.\d+)?)"
_ISO, _OHSAS = r"(?iu)(?<!\p{L})ISO\s+(\d+)(?::(\d{4}))?", r"(?iu)(?<!\p{L})OHSAS\s+(\d+)"
_ARTICLE = r"(?iu)(?<!\p{L})article\s+([A-Z]?\.?\s?\d[\d.\-]*)"


def typed_references(text: Column) -> Column:
    """Array of struct(kind, target, section, surface): NORM, REQUIREMENT (articles) and INTERNAL; an internal one without a
    document's code means the own document. A paragraph sign with its document after it, then before it, then alone: what one
    form has taken is masked for the next."""
    every = lambda where, pattern, make: F.transform(F.regexp_extract_all(where, F.lit(pattern), F.lit(0)), lambda s: make(s))
    group = lambda s, pattern, g: F.nullif(F.trim(F.regexp_extract(s, pattern, g)), F.lit(""))
    ref = lambda kind, target, section, s: F.struct(F.lit(kind).alias("kind"), target.alias("target"), section.alias("section"), s.alias("surface")).cast(REFERENCE)
    none = F.lit(None).cast("string")
    second, third = F.regexp_replace(text, _AFTER, " "), F.regexp_replace(F.regexp_replace(text, _AFTER, " "), _BEFORE, " ")
    return F.concat(
        every(text, _ISO, lambda s: ref("NORM", F.concat(F.lit("ISO "), group(s, _ISO, 1)), none, s)), every(text, _OHSAS, lambda s: ref("NORM", F.concat(F.lit("OHSAS "), group(s, _OHSAS, 1)), none, s)),
        every(text, _ARTICLE, lambda s: ref("REQUIREMENT", group(s, _ARTICLE, 1), none, s)), every(text, _AFTER, lambda s: ref("INTERNAL", F.upper(group(s, _AFTER, 2)), group(s, _AFTER, 1), s)),
        every(second, _BEFORE, lambda s: ref("INTERNAL", F.upper(group(s, _BEFORE, 1)), group(s, _BEFORE, 2), s)), every(third, _BARE, lambda s: ref("INTERNAL", none, group(s, _BARE, 1), s)),
    )


def resolved(references: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """``references(clause, doc, kind, target, section, surface)`` with ``target_doc`` and ``resolved``: the first of
    ``documents(doc, code)`` with that code (the own one without a code), and whether ``sections(doc, section)`` has the
    section's head number. Null ``resolved`` for norms and requirements, false where the document is unknown."""
    codes = documents.where("code IS NOT NULL").groupBy(F.col("code").alias("target")).agg(F.min("doc").alias("found"))
    heads = sections.select(F.col("doc").alias("target_doc"), F.col("section").cast("string").alias("head"), F.lit(True).alias("there")).where("head IS NOT NULL").distinct()
    inner = F.col("kind") == "INTERNAL"
    named = references.join(codes, "target", "left").withColumn("target_doc", F.when(inner, F.when(F.col("target").isNull(), F.col("doc")).otherwise(F.col("found"))))
    named = named.withColumn("head", F.regexp_extract("section", r"^\d+", 0)).join(heads, ["target_doc", "head"], "left")
    return named.select(*references.columns, "target_doc", F.when(inner, F.coalesce("there", F.lit(False))).alias("resolved"))


def threshold_condition(text: Column) -> Column:
    """struct(surface, operator, value) of a condition such as ``dépasse 60 km/h``; null without an operator, or where a delay or
    the context of a quantity's role says that the number is a quantity."""
    pattern = X.NUMBER + r" *(km/h|minutes?|heures?)"
    low = F.lower(text)
    free = ~low.rlike("sous |dans un délai|délai|retard|archiv|conserv|formation|habilitation|recycl|secouriste|sauveteur")
    found = low.rlike(pattern) & free & (X.operator(text) != "=")
    return F.when(found, F.struct(F.regexp_extract(low, pattern, 0).alias("surface"), X.operator(text).alias("operator"), X.number(F.regexp_extract(low, pattern, 1)).alias("value")))


def actors(text: Column, gazetteer: tuple[str, ...] = ACTORS) -> Column:
    """Distinct actors of a text's label, in order; of names that overlap the longest counts."""
    names = "|".join(sorted(gazetteer, key=lambda n: (-len(n), n)))
    return F.array_distinct(F.regexp_extract_all(label(text), F.lit(rf"(?<![a-z0-9])({names})(?![a-z0-9])"), F.lit(1)))


def action(text: Column) -> Column:
    """The main verb, as an infinitive: behind a modal the infinitive, or the participle after ``être``; else the participle
    after an auxiliary. A rule for regular verbs; null where none fits."""
    low = F.lower(text)
    got = lambda pattern: F.nullif(F.regexp_extract(low, pattern, 1), F.lit(""))
    ending = lambda w: F.when(w.rlike("(?:é|ée|és|ées)$"), F.regexp_replace(w, "(?:é|ée|és|ées)$", "er")).when(w.rlike("(?:i|ie|is|ies|it|ite|its|ites)$"), F.regexp_replace(w, "(?:ies|ites|its|ite|ie|is|it|i)$", "ir")).otherwise(w)
    modal = r"(?<!\p{L})(?:doit|doivent|devra|devront|peut|peuvent)(?: pas)?"
    passive = ending(got(modal + r" être (\p{L}+)"))
    infinitive = got(modal + r" (\p{L}+(?:er|ir|re))(?!\p{L})")
    participle = ending(got(r"(?<!\p{L})(?:est|sont|a|ont)(?: pas)? (\p{L}+(?:é|ée|és|ées|ie|is|ies|i))(?!\p{L})"))
    return F.coalesce(passive, infinitive, participle)


def objects(text: Column) -> Column:
    """Distinct canonical noun phrases: a determiner's noun, with a noun that ``de`` adds to it and alone; no actor, no unit of
    time or number. A rule, as the action is."""
    low = F.regexp_replace(F.lower(X.without_dates(text)), "’", "'")
    pattern = r"(?<!\p{L})(?:l'|d'|le |la |les |un |une |des |du |de la |chaque |aux? |tous les |toutes les |son |sa |ses |leurs? )(\p{L}{3,}(?: (?:de |d'|des |du )\p{L}{3,})?)"
    whole = F.transform(F.regexp_extract_all(low, F.lit(pattern), F.lit(1)), canonical_form)
    heads = F.transform(whole, lambda w: F.regexp_extract(w, "^[a-z0-9]+", 0))
    known = F.transform(actors(text), canonical_form)
    units = "^(?:jour|semaine|mois|trimestre|semestre|an|annee|heure|minute|metre|fois|cas|zone|ensemble)"
    return F.filter(F.array_distinct(F.concat(whole, heads)), lambda o: (o != "") & ~F.array_contains(known, o) & ~o.rlike(units))


def frames(clauses: DataFrame) -> DataFrame:
    """One row per clause of ``clauses(id, clause_id, text, standalone, …)``: statement, modality, force and its surface, quantity,
    conditions, references, validity, derogation, actors, action, objects, and by field where it comes from (RULE)."""
    text, whole = F.col("text"), F.coalesce(F.col("standalone"), F.col("text"))
    from clausegraph.operators.detection import force

    rows = clauses.select(
        "*", X.modality(whole).alias("modality"), X.modality_surface(whole).alias("modality_surface"), X.quantity(text).alias("quantity"), X.conditions(text).alias("conditions"), threshold_condition(text).alias("threshold"),
        typed_references(text).alias("references"), X.validity(text).alias("validity"), X.derogation(text).alias("derogation"), X.statement(text).alias("statement"), actors(whole).alias("actors"), action(whole).alias("action"), objects(whole).alias("objects"),
    )
    rows = rows.withColumn("force", force(F.col("modality")))
    filled = {"modality": F.col("modality").isNotNull(), "quantity": F.col("quantity").isNotNull(), "conditions": F.size("conditions") > 0, "references": F.size("references") > 0, "derogation": F.col("derogation").isNotNull(), "action": F.col("action").isNotNull(), "objects": F.size("objects") > 0}
    source = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("field"), F.when(c, "RULE").alias("source")) for k, c in filled.items()]), lambda e: e["source"].isNotNull()))
    return rows.withColumn("source", source)


def coverage(rows: DataFrame) -> DataFrame:
    """(field, source, n): how many of ``rows(source map)`` fill a field, by where it comes from."""
    return rows.select(F.explode("source").alias("field", "source")).groupBy("field", "source").agg(F.count("*").alias("n"))


def context(clauses: DataFrame, quantities: DataFrame, norms: DataFrame, concepts: DataFrame, canonical: DataFrame) -> DataFrame:
    """One row per ``clauses(clause)``: sorted distinct quantities, norms, concepts and canonical concepts, each side gathered
    before the left joins. ``quantities(clause, value)``, ``norms(clause, value)``, ``concepts(clause, value)``, ``canonical(value, canonical)``."""
    gathered = lambda df, name, c="value": df.where(F.col(c).isNotNull()).groupBy("clause").agg(F.sort_array(F.collect_set(c)).alias(name))
    sides = [gathered(quantities, "quantities"), gathered(norms, "norms"), gathered(concepts, "concepts"), gathered(concepts.join(canonical, "value"), "canonical", "canonical")]
    out = clauses.select("clause").distinct()
    for side in sides:
        name = side.columns[1]
        out = out.join(side, "clause", "left").withColumn(name, F.coalesce(name, F.array().cast(side.schema[name].dataType)))
    return out


def shared_objects(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def comparable_couples(pairs: DataFrame, quantities: DataFrame) -> DataFrame:
    """(a, b, dimension, role, value_a, value_b, place): couples of quantities of one dimension and role of each pair (a, b),
    numbered by their places in both lists. ``quantities(clause, place, dimension, role, value)``."""
    side = lambda c: quantities.select(F.col("clause").alias(c), F.col("place").alias(f"place_{c}"), "dimension", "role", F.col("value").alias(f"value_{c}"))
    met = pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), ["b", "dimension", "role"])
    place = F.row_number().over(Window.partitionBy("a", "b").orderBy("place_a", "place_b")).cast("long")
    return met.select("a", "b", "dimension", "role", "value_a", "value_b", place.alias("place"))


def first_divergence(couples: DataFrame) -> DataFrame:
    """Of each pair the first couple whose known values differ; none: no row."""
    return couples.where("value_a IS NOT NULL AND value_b IS NOT NULL AND value_a <> value_b").groupBy("a", "b").agg(F.min(F.struct("place", "dimension", "role", "value_a", "value_b")).alias("c")).select("a", "b", "c.dimension", "c.role", "c.value_a", "c.value_b")

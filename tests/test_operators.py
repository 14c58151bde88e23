"""Operators on small hand-made rows, and the corpus of our own."""

import datetime

import pytest
from pyspark.sql import functions as F

from clausegraph.functions import text as T
from clausegraph.operators import conditions, detection, extraction, segmentation, targeting, vocabulary
from clausegraph.plans.catalog import corpus_clauses
from clausegraph.plans.corpus import TEXTS
from clausegraph.sources import files


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.fixture(scope="module")
def clauses(spark):
    return {(r["id"], r["ref"], r["kind"], r["part"]): r for r in segment(spark).collect()}


def segment(spark):
    docs = spark.createDataFrame(list(TEXTS), "id string, text string")
    found = corpus_clauses(spark)
    assert segmentation.offset_gaps(found, docs).count() == 0
    return found.withColumn("part", F.row_number().over(__import__("pyspark").sql.Window.partitionBy("id", "ref").orderBy("start")) - 1)


def test_segmentation(clauses):
    kinds = [k[2] for k in clauses]
    assert kinds.count("LIST") == 3 and kinds.count("TABLE") == 2
    assert clauses["D1", "2.3", "LIST", 0]["text"] == "Le chef d'équipe doit vider les cuves."
    assert clauses["D1", "2.4", "TABLE", 0]["text"] == "Relevé - Réalisation : Gardien ; Approbation : Chef de site."
    assert clauses["D2", "1.1", "TEXT", 0]["clause_id"] == "D2::S1::C01"
    assert len({r["clause_id"] for r in clauses.values()}) == len(clauses)


def test_front_matter(spark):
    docs = spark.createDataFrame(list(TEXTS), "id string, text string")
    rows = {r["id"]: r for r in segmentation.front_matter(segmentation.structured(segmentation.lines(docs))).collect()}
    assert (rows["D1"]["code"], rows["D1"]["version"], rows["D1"]["applies"], rows["D1"]["type"], rows["D1"]["level"]) == ("PR-TST-01", "4", datetime.date(2024, 5, 2), "PROCEDURE", 3)
    assert (rows["D2"]["type"], rows["D2"]["level"], rows["D2"]["title"]) == ("POLITIQUE", 1, "POLITIQUE SÉCURITÉ")


QUANTITIES = [
    ("Le rapport est transmis sous 48 heures.", "delai", 172800, None, "NORMAL"),
    ("La fiche est corrigée sous 5 jours ouvrés.", "delai", 432000, 604800, "NORMAL"),
    ("Les relevés sont archivés pendant 3 ans.", "duree_conservation", 94608000, None, "NORMAL"),
    ("Chaque extincteur doit être contrôlé tous les trimestres.", "periodicite", 7884000, None, "NORMAL"),
    ("La vérification est réalisée deux fois par an.", "periodicite", 15768000, None, "NORMAL"),
    ("Le contrôle est réalisé tous les 12 mois.", "periodicite", 31536000, None, "NORMAL"),
    ("Le suivi est présenté en revue mensuelle.", "periodicite", 2628000, None, "NORMAL"),
    ("La formation comporte au minimum 14 heures.", "duree_formation", 50400, None, "NORMAL"),
    ("L'habilitation est recyclée tous les 3 ans.", "validite_habilitation", 94608000, None, "NORMAL"),
    ("Chaque équipe comporte au minimum deux secouristes.", "effectif_minimum", 2, None, "NORMAL"),
    ("Le port d'un casque est obligatoire au-delà de 85 dB(A).", "seuil_exposition", 85, None, "NORMAL"),
    ("Le port du harnais est requis à plus de 3 mètres.", "seuil_declenchement", 3, None, "NORMAL"),
    ("Le compte rendu est remis dans la semaine.", "delai", 604800, None, "IMPRECIS"),
    ("La revue est bimensuelle.", "periodicite", None, None, "AMBIGU"),
]


def test_quantities(spark):
    rows = spark.createDataFrame([(t,) for t, *_ in QUANTITIES], "text string").select("text", extraction.quantity(F.col("text")).alias("q")).collect()
    assert {(r["text"], *r["q"]) for r in rows} == set(QUANTITIES)


def test_modality_references_validity(spark):
    assert value(spark, extraction.modality(F.lit("Les interventions ne sont pas autorisées."))) == "INTERDICTION"
    assert value(spark, extraction.modality(F.lit("On entend par « écart » un manquement."))) == "DEFINITION"
    assert value(spark, extraction.modality(F.lit("Rien de tel."))) is None
    refs = value(spark, extraction.references(F.lit("Voir ISO 45001:2018, § 12.3 et PR-QSE-04.")))
    assert [tuple(r) for r in refs] == [("NORM", "ISO 45001:2018"), ("DOCUMENT", "PR-QSE-04"), ("SECTION", "12.3")]
    assert value(spark, extraction.validity(F.lit("valable jusqu'au 31 février 2026")))["end"] is None
    text = "Par dérogation au § 2.1, le contrôle est semestriel, motivé par l'arrêt du four, approuvé par le Directeur le 3 mars 2026, valable jusqu'au 30 juin 2026."
    assert tuple(value(spark, extraction.derogation(F.lit(text)))) == ("2.1", "l'arrêt du four", "le directeur", datetime.date(2026, 3, 3), datetime.date(2026, 6, 30))


def test_text_functions(spark):
    assert value(spark, T.normalise(F.lit("l’écart : 3,5 m"))) == "l'écart : 3.5 m"
    assert value(spark, T.label(F.lit("Le Contrôle des EPI"))) == "controle des epi"
    assert value(spark, T.label(F.lit("de l'Équipement"))) == "equipement"


def test_components_and_canonical(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 6), (6, 5)], "a long, b long")
    found = vocabulary.components(edges)
    assert {(r["node"], r["component"]) for r in found.collect()} == {(1, 1), (2, 1), (3, 1), (9, 1), (5, 5), (6, 5)}
    counts = spark.createDataFrame([(1, 2), (2, 7), (3, 7), (9, 1), (5, 1), (6, 1)], "node long, frequency long")
    assert {r["canonical"] for r in vocabulary.canonical(found, counts).collect()} == {2, 5}
    assert vocabulary.components(edges.limit(0)).count() == 0


def test_two_sided_budget(spark):
    pairs = spark.createDataFrame([(1, b, 1.0 / b, "CONCEPTUAL") for b in range(2, 13)] + [(1, 99, 0.001, "KEY")], "a long, b long, rrf double, channels string")
    kept = {r["b"] for r in targeting.within_budget(pairs).where("kept").collect()}
    assert kept == {2, 3, 4, 5, 6, 7, 8, 9, 99}


def test_detectors(spark):
    d = detection.divergence(F.lit(172800.0), F.lit(432000.0), F.lit("delai"), F.lit("INCLUDED_IN"), F.lit(2), F.lit(True))
    assert (value(spark, d["verdict"]), value(spark, d["firm"])) == ("SPECIALISATION", True)
    assert value(spark, detection.sealed(F.lit(True), F.lit("x"), F.lit("axb"), F.lit("q"), F.lit("axb"))) is False
    assert value(spark, conditions.effective_scope(F.array(F.lit("sous 48 heures"), F.lit("en zone A")), F.array(F.lit("48 heures")))) == ["en zone A"]


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("﻿un\r\ndeux\rtrois".encode())
    docs = files.texts(spark, str(tmp_path))
    assert docs.first()["text"] == "un\ndeux\ntrois"
    assert files.substituted(docs, "a.txt", "deux", "2").first()["text"] == "un\n2\ntrois"
    with pytest.raises(Exception, match="one occurrence"):
        files.substituted(docs, "a.txt", "quatre", "4").collect()
    assert files.read_json(spark, str(tmp_path / "none.json"), "a int").count() == 0
    assert "&lt;b&gt;" in "".join(files.html_report(spark.createDataFrame([("<b>",)], "x string"), "r", ["x"]))


def test_quantity_of_any_size(spark):
    texts = ("Archivé pendant 3344906486400000000 ans.", "Remis sous 99999999999999999999 jours ouvrés.", "Contrôlé 0 fois par mois.", "Un bruit de 99999999999999999999 dB.", "Remis sous " + "9" * 400 + " jours.", "Archivé pendant 3 ans.")
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(extraction.quantity(F.col("text")).alias("q")).collect()
    found = [r.q and (r.q["role"], r.q["si"], r.q["calendar_si"], r.q["status"]) for r in rows]
    assert found == [("duree_conservation", None, None, "IMPRECIS"), ("delai", None, None, "IMPRECIS"), None, ("seuil_exposition", None, None, "IMPRECIS"), ("delai", None, None, "IMPRECIS"), ("duree_conservation", 94608000, None, "NORMAL")]

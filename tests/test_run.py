"""From texts to findings, segmentation and extraction rules on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from clausegraph.functions import text as T
from clausegraph.operators import conditions, extraction, frames, run, segmentation, sentences

PROCEDURE = """PR-ATL-03
PROCÉDURE DE L'ATELIER

Version : 2
Date d'application : 01/02/2024

1. OBJET

1.1 La présente procédure est conforme à la norme OHSAS 18001.

2. RÈGLES

2.1 Le rapport d'incident doit être transmis sous 48 heures.

2.2 Chaque extincteur à poudre doit être contrôlé, avec son support de fixation, tous les trimestres.

2.3 Les fiches de contrôle des presses sont archivées pendant 3 ans.

2.4 L'opérateur peut utiliser la meuleuse portative et la scie à ruban.

2.5 Le bilan du stock est établi selon le § 9.1 de la présente procédure.

2.6 Le port du casque de chantier est requis à plus de 3 mètres.

2.7 Le plan d'évacuation est affiché. Il doit être relu par la direction tous les mois.

2.8 Les pompes de relevage sont révisées tous les 6 mois.
"""

POLICY = """POL-ATL-01
POLITIQUE DE L'ATELIER

Version : 1
Date d'application : 2023-06-01

1. RÈGLES

1.1 Le rapport d'incident doit être transmis sous 5 jours.

1.2 Chaque extincteur à poudre doit être contrôlé, avec son support de fixation, tous les semestres.

1.3 Les fiches de contrôle des presses sont archivées pendant 5 ans.

1.4 L'opérateur ne peut utiliser la meuleuse portative et la scie à ruban.

1.5 Les audits internes suivent la norme ISO 45001.

1.6 Le port du casque de chantier est requis à plus de 3 mètres.

1.7 Les pompes de relevage sont révisées tous les 6 mois.

Remarque générale.
"""


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_texts_to_findings(spark):
    docs = spark.createDataFrame([("D1", PROCEDURE), ("D2", POLICY)], "id string, text string")
    norms = spark.createDataFrame([("OHSAS 18001", True, "ISO 45001"), ("ISO 45001", False, None)], "code string, retired boolean, replaced_by string")
    refs = {r["clause_id"]: r["ref"] for r in run.clause_frames(docs).collect()}
    assert len(refs) == 9 + 7
    found = run.findings(docs, norms).collect()
    firm = {(r["a"][:2] + " " + refs[r["a"]], r["b"] and r["b"][:2] + " " + refs[r["b"]], r["detector"]) for r in found if r["rubric"] == "FINDING"}
    assert firm == {
        ("D1 2.1", "D2 1.1", "VALUE"), ("D1 2.2", "D2 1.2", "VALUE"), ("D1 2.3", "D2 1.3", "VALUE"), ("D1 2.4", "D2 1.4", "DEONTIC"), ("D1 2.5", None, "REFERENCE"), ("D1 1.1", None, "REFERENCE"),
    }
    texts = {r["clause_id"]: r["text"] for r in run.clause_frames(docs).collect()}
    assert all(r["proof_a"] in texts[r["a"]] and (r["b"] is None or r["proof_b"] in texts[r["b"]]) for r in found if r["firm"])


def test_clause_ids_past_99_and_units_without_number(spark):
    body = "TITRE\n\n1. RÈGLES\n\n" + "\n\n".join(f"1.{i} La pompe {i} doit tourner." for i in range(1, 100)) + "\n\nLa vanne doit rester fermée.\n\nRemarque.\n\nLa porte doit rester close.\n"
    rows = segmentation.clauses(segmentation.structured(segmentation.lines(spark.createDataFrame([("D", body)], "id string, text string")))).orderBy("ord").collect()
    assert len(rows) == 101 == len({r["clause_id"] for r in rows})
    assert (rows[-1]["clause_id"], rows[-1]["ref"], rows[-2]["context"]) == ("D::S1::C101", "1.99+", ["Remarque."])
    cells = " | ".join(f"c{i}" for i in range(150))
    wide = f"1. T\n\n1.1 Les rôles :\n\n{cells}\n{cells}\n{cells}\n"
    rows = segmentation.clauses(segmentation.structured(segmentation.lines(spark.createDataFrame([("D", wide)], "id string, text string")))).collect()
    assert len(rows) == 2 and all("c149 : c149" in r["text"] for r in rows)


MODALITIES = [
    ("Une note indoit rien.", None), ("Nul ne peut entrer.", "INTERDICTION"), ("L'accès peut être ouvert.", "PERMISSION"), ("Ce port n'est pas autorisé ici.", "INTERDICTION"), ("Le gardien ne doit pas sortir.", "INTERDICTION"), ("Le tri n'est obligatoire qu'ici.", "INTERDICTION"),
    ("Les accès sont interdits.", "INTERDICTION"), ("Les badges sont obligatoires.", "OBLIGATION"), ("Il doit lire.", "OBLIGATION"), ("Un casque est recommandé.", "RECOMMANDATION"), ("On entend par « x » un mot.", "DEFINITION"), ("Cette règle prévaut.", "CONSTAT"), (None, None),
]


def test_modality_boundaries_and_negation(spark):
    rows = spark.createDataFrame(MODALITIES, "text string, want string").withColumn("got", extraction.modality(F.col("text"))).collect()
    assert [(r["text"], r["got"]) for r in rows] == MODALITIES
    assert value(spark, extraction.modality_surface(F.lit("Les accès Sont Interdits."))) == "Sont Interdits"


def test_sentences_spans_anaphora(spark):
    text = "Voir art. Cinq du code. La pompe tourne. Le n° 3. Elle est vidée ! Cf. Annexe A. Bien."
    assert value(spark, sentences.sentences(F.lit(text))) == ["Voir art. Cinq du code.", "La pompe tourne.", "Le n° 3. Elle est vidée !", "Cf. Annexe A. Bien."]
    rows = spark.createDataFrame([(1, i, s, a) for i, (s, a) in enumerate([("x", False), ("A", True), ("y", False), ("B", True)])] + [(2, 0, "p", False), (2, 1, "q", False)], "id int, pos int, sentence string, autonomous boolean")
    assert {tuple(r) for r in sentences.spans(rows).collect()} == {(1, 1, "x A y"), (1, 2, "B"), (2, 1, "p q")}
    rows = [("D", 1, i, "TEXT", t) for i, t in enumerate(["La cuve principale est vidée.", "Le rapport est signé.", "Elle doit être rincée.", "Ils sont formés."], 1)]
    got = sentences.standalone(spark.createDataFrame(rows, "id string, section int, ord int, kind string, text string")).orderBy("ord").collect()
    assert [r["standalone"] for r in got][2:] == ["La cuve principale doit être rincée.", "Le rapport sont formés."]


def test_references_and_thresholds(spark):
    text = "Selon § 6.4 de la politique POL-SEC-01, la procédure PR-QSE-02 § 3.1, le § 12.3, ISO 45001:2018 et l'article R.4321-1."
    refs = value(spark, frames.typed_references(F.lit(text)))
    assert [tuple(r)[:3] for r in refs] == [("NORM", "ISO 45001", None), ("REQUIREMENT", "R.4321-1.", None), ("INTERNAL", "POL-SEC-01", "6.4"), ("INTERNAL", "PR-QSE-02", "3.1"), ("INTERNAL", None, "12.3")]
    assert all(r["surface"] in text for r in refs)
    rows = spark.createDataFrame([("c", "D1", *r) for r in refs], "clause string, doc string, kind string, target string, section string, surface string")
    docs = spark.createDataFrame([("D1", "PR-QSE-04"), ("D2", "POL-SEC-01")], "doc string, code string")
    sections = spark.createDataFrame([("D1", 12), ("D2", 5)], "doc string, section int")
    assert [r["resolved"] for r in sorted(frames.resolved(rows, docs, sections).collect(), key=lambda r: [tuple(x)[1] for x in refs].index(r["target"]))] == [None, None, False, False, True]
    got = value(spark, frames.threshold_condition(F.lit("Interdit lorsque le vent dépasse 60 km/h.")))
    assert tuple(got) == ("60 km/h", ">", 60.0)
    assert value(spark, frames.threshold_condition(F.lit("Sous un délai de moins de 48 heures."))) is None
    assert value(spark, extraction.quantity(F.lit("Applicable au 3 mars 2026, revue mensuelle.")))["role"] == "periodicite"
    assert value(spark, T.canonical_form(F.lit("Les contrôles des journaux"))) == "controle des journal"
    assert value(spark, frames.actors(F.lit("Le chef d'équipe et l'opérateur préviennent la direction générale."))) == ["chef d equipe", "operateur", "direction generale"]
    assert value(spark, frames.action(F.lit("Chaque vanne doit être contrôlée."))) == "contrôler" and value(spark, frames.action(F.lit("Il doit vider la cuve."))) == "vider"


def test_scopes_of_empty_and_unknown_conditions(spark):
    held = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", "z"), ("e", "x"), ("e", "z")], "clause string, cond string")
    related = spark.createDataFrame([("x", "y", "INCLUDED_IN"), ("x", "z", "DISJOINT")], "cond_a string, cond_b string, relation string")
    pairs = [("a", "b"), ("a", "c"), ("c", "a"), ("a", "d"), ("c", "d"), ("a", "n"), ("n", "a"), ("n", "m"), ("a", "e")]
    got = {(r["a"], r["b"]): r["relation"] for r in conditions.scopes(spark.createDataFrame(pairs, "a string, b string"), held, related).collect()}
    assert got == dict(zip(pairs, ["IDENTITY", "INCLUDED_IN", "INCLUDES", "DISJOINT", "UNDETERMINED", "INCLUDED_IN", "INCLUDES", "IDENTITY", "DISJOINT"], strict=True))
    loop = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", None)], "place string, parent string")
    assert {(r["place"], r["ancestor"], r["distance"]) for r in conditions.ancestors(loop).collect()} >= {("a", "b", 1), ("a", "c", 2), ("a", "a", 3)}


def test_unknown_is_never_firm(spark):
    from clausegraph.operators import detection

    null = F.lit(None)
    d = detection.divergence(F.lit(1.0), F.lit(2.0), F.lit("delai"), null.cast("string"), F.lit(5), F.lit(True))
    assert (value(spark, d["firm"]), value(spark, d["motif"])) == (False, "PORTEE_INDETERMINEE")
    d = detection.deontic(F.lit("INTERDICTION"), F.lit("OBLIGATION"), F.lit("IDENTITY"), null.cast("int"))
    assert (value(spark, d["firm"]), value(spark, d["motif"])) == (False, "OBJETS_SANS_RECOUVREMENT")
    assert value(spark, detection.deontic(null.cast("string"), F.lit("OBLIGATION"), F.lit("IDENTITY"), F.lit(3))["firm"]) is False


@pytest.mark.parametrize("raw, want", [("é", "é"), (None, None)])
def test_normal_form(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(T.composed("t").alias("v")).first()["v"] == want

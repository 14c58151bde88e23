"""Steps whose cost must follow the input: what they keep, and that they lose nothing by it."""

import re
from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from conftest import DATA

from clausegraph.operators import arbitration, consolidation, evaluation, knn, sentences, targeting
from clausegraph.plans import catalog, decisions  # noqa: F401  (registers its queries in the catalogue)


def test_neighbours_keep_k_rows_a_vector_whatever_they_meet(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-3, 4, (400, 4)).astype(float) + 0.5  # few distinct vectors: many ties
    own = knn.Nearest(np.arange(400), x / np.linalg.norm(x, axis=1)[:, None], 7)
    for k in range(0, 400, 50):
        own.meet(own.ids[k : k + 50], own.x[k : k + 50])
        assert len(own.rows) <= 7 * 400
    score = np.round(own.x @ own.x.T, 9)
    assert np.array_equal(own.found.reshape(400, 7), np.lexsort((np.broadcast_to(own.ids, score.shape), -score))[:, :7])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    got = sorted((r.a, -r.score, r.b) for r in knn.nearest(rows, 7).collect())
    assert [g[2] for g in got] == own.found.tolist()


def test_dimension_channel_looks_at_few_rows_and_finds_the_same(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(rng.integers(40)), "d", "r" if i % 9 else "s", int(rng.integers(5)), None if i % 97 == 0 else float(rng.integers(60)) / 10) for i in range(1500)]
    rows += [(2000 + i, i, "d", "far", i % 2, w) for i, w in enumerate((1e9, 0.1, 0.1 + 1e-12, 0.3, float("nan"), None))] + [(3000, 1, None, "r", 1, 1.0), (3001, None, "d", "r", 1, 1.0), (3002, 1, "d", "r", None, 1.0)]
    got = sorted((r.a, r["rank"], r.b) for r in targeting.dimension_channel(spark.createDataFrame(rows, "id long, doc int, dimension string, role string, value int, weight double")).collect())
    place = lambda x, y: (2, 0.0) if x is None or y is None else (1, 0.0) if x != x or y != y else (0, abs(x - y))
    want = []
    for i, doc, dimension, role, value, weight in rows:
        near = sorted((place(weight, y[5]), y[0]) for y in rows if None not in (dimension, doc, value, y[1], y[4]) and (y[2], y[3]) == (dimension, role) and y[1] != doc and y[4] != value)
        want += [(i, n, b) for n, (_, b) in enumerate(near[:3], 1)]
    assert got == sorted(want)
    table = spark.createDataFrame(sorted((r for r in rows if r[3] == "r" and None not in r), key=lambda r: (r[5], r[0])), "id long, doc int, dimension string, role string, value int, weight double").coalesce(1).toArrow()
    alone = next(targeting.closest(table.to_batches(), 3))
    assert sum(b is None for b in alone["b"].to_pylist()) < 400


def test_conceptual_channel_shuffles_no_pairs_and_finds_the_same(spark, monkeypatch):
    monkeypatch.setattr(targeting, "SIDE", 70)
    monkeypatch.setattr(targeting, "CELLS", 3)
    rng = np.random.default_rng(3)
    held = {f"c{i:03}": (None if i == 5 else int(rng.integers(9)), {int(c) for c in rng.integers(0, 60, 6)}) for i in range(200)}
    idf = {c: 1.0 + c / 7 for c in range(61)}
    rows = [(i, doc, f"w{c}", idf[c]) for i, (doc, own) in held.items() for c in own]
    found = targeting.conceptual_channel(spark.createDataFrame([*rows, (None, 1, "w1", idf[1])], "id string, doc int, concept string, idf double"))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    want = {(a, b, round(sum(idf[c] for c in x & y), 6), len(x & y)) for a, (d, x) in held.items() for b, (e, y) in held.items() if a < b and None not in (d, e) and d != e and len(x & y) >= 2}
    got = [(r.a, r.b, round(r.score, 6), r.shared) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_group_pairs_are_dealt_to_many_tasks(spark):
    rows = spark.createDataFrame([(i, i * 2.0, "x" if i < 90 else None) for i in range(100)], "k long, v double, g string")
    pairs = targeting.group_pairs(rows, ["g"], "k", "v")
    assert sorted((r.a, r.va, r.b, r.vb) for r in pairs.collect()) == [(a, a * 2.0, b, b * 2.0) for a in range(90) for b in range(a + 1, 90)]
    assert pairs.rdd.getNumPartitions() == 192


def test_alias_channel_shuffles_no_pairs_and_finds_the_same(spark, monkeypatch):
    monkeypatch.setattr(targeting, "SIDE", 70)
    monkeypatch.setattr(targeting, "CELLS", 3)
    rng = np.random.default_rng(4)
    held = {f"c{i:03}": (int(rng.integers(9)), {int(c) for c in rng.integers(0, 60, int(rng.integers(1, 7)))}) for i in range(200)}
    idf = {c: 1.0 + c / 7 for c in range(60)}
    aliases = [(1, 2), (2, 1), (3, 3), (4, 5), (5, 6), (59, 4), (7, 99), (98, 99)]
    hop = {c: {c} | {y for x, y in aliases if x == c} | {x for x, y in aliases if y == c} for c in range(60)}
    rows = [(i, doc, f"w{c}", idf[c]) for i, (doc, own) in held.items() for c in own]
    mentions = spark.createDataFrame([*rows, (None, 1, "w1", idf[1]), ("c500", None, "w1", idf[1])], "id string, doc int, concept string, idf double")
    found = targeting.alias_conceptual_channel(mentions, spark.createDataFrame([(f"w{x}", f"w{y}") for x, y in aliases], "a string, b string"))
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    want = set()
    for a, (d, x) in held.items():
        for b, (e, y) in held.items():
            met = {c: len(hop[c] & y) for c in x if hop[c] & y}
            if a < b and d != e and len(met) >= 2:
                want.add((a, b, round(sum(idf[c] * n for c, n in met.items()), 6), len(met)))
    got = [(r.a, r.b, round(r.score, 6), r.shared) for r in found.collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_contribution_tests_pairs_where_they_meet(spark):
    rows = [(i % 290, "t" if i % 3 else None if i % 2 else "u", i % 4, None if i % 11 == 0 else f"b{i % 5}") for i in range(300)]
    found = evaluation.contribution(spark.createDataFrame(rows, "id long, kind string, size int, brand string"), ["kind", "size"], "brand")
    want = [(x[0], y[0]) for x in rows for y in rows if x[0] < y[0] and x[1] is not None and x[1:3] == y[1:3] and (None in (x[3], y[3]) or x[3] != y[3])]
    assert sorted((r.a, r.b) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Aggregate" not in plan


PROSE = ("Wenn Élan s.t. wird, Art. Deux reste. Ça va ! Oui ?\n\n Cf. Annexe. " + "ononder bleer esnt haan a aterble reeaha ones ntor it wasshndti inganing haingon thntble shble nd heonin " * 20) * 500


def test_sentences_look_back_only_at_ends(spark):
    before = r"(?iu)" + sentences._NO_END + r"(?-i)(?<=[.!?])\s+(?=\p{Lu})"
    texts = [PROSE[:3000], "A. B", "art. B. C", "x\n\tart.\n\nB", "Fin.  \r\n Élan. e. É ? \x0bÉ.", "123456789. A 1234567890. B", "", "   ", " . A"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    spaced = F.regexp_replace("text", r"\s{2,}|[\t\n\x0B\f\r]", " ")
    for r in rows.select(F.split("text", before).alias("old"), sentences.sentences(F.col("text")).alias("new"), sentences.sentences(spaced).alias("spaced")).collect():
        assert r.new == r.old and r.spaced == [re.sub(r"\s+", " ", x) for x in r.old]
    assert sentences.BOUNDARY.index("[.!?]") < sentences.BOUNDARY.index(sentences._NO_END)


def test_qualifies_matches_few_patterns_and_finds_the_same(spark):
    old = lambda t: reduce(lambda x, y: x | y, [t.rlike(p if "A-Z" in p else "(?iu)" + p) for p in sentences.STATEMENTS])
    words = "doit doivent devra peut peuvent est_interdit sont_obligatoire EST_REQUIS est_tenu_de est_chargé_de sont_autorisé EST_RECOMMANDÉ prévaut PRÉVALENT on_entend_par désigne s'entend_comme est_définie_comme signifie correspond_à «x» «» §_4 §4 ISO_9 AB-CD-12 article_R._4 quotidienne Journalier hebdomadaires mensuel bimestriel trimestriel semestriel annuel chaque tous_les Toutes_les rien"
    texts = [t.replace("_", " ") for t in words.split()]
    texts += [f + t for t in texts for f in ("x", "-")] + [t + "x" for t in texts] + [t.upper() for t in texts] + ["EST İNTERDİT", "peut".upper() + "ſ", "deſigne", "ſignifie", "déſigne", "menſuel", "quotıdien", "", "٣", PROSE[:5000]]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", old(F.col("t")).alias("old"), sentences.qualifies(F.col("t")).alias("new")).collect():
        assert r.new == r.old, r.t
    plan = spark.range(1).select(sentences.qualifies(F.col("id").cast("string")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1 + len(sentences.STEMS) and "Contains" in plan


def test_entailment_cuts_each_text_once_a_side(spark):
    plan = catalog.QUERIES["entailment_zones"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(lower(text") == 2 == plan.count("split(")
    rows = spark.createDataFrame([("a b c", "B d"), ("", "a"), (None, "a"), ("a a-b", "b.A")], "x string, y string")
    x, y = F.col("x"), F.col("y")
    got = rows.select(arbitration.overlap_score(x, y).alias("s"), arbitration.words_missing(arbitration.distinct_words(x), arbitration.distinct_words(y)).alias("w")).collect()
    assert [r.s for r in got] == [r.w for r in got] and [round(r.s, 6) for r in got] == [0.666667, 0.0, 0.0, 0.0]


def test_impact_streams_its_edges(spark, monkeypatch):
    plans, keep = [], consolidation.stored
    monkeypatch.setattr(consolidation, "stored", lambda df: (plans.append(df), keep(df))[1])
    edges = [(1, 2), (2, 3), (3, 4), (1, 2), (2, 1), (3, None), (None, 4), (5, 5), (6, 7)]
    got = consolidation.impact(spark.createDataFrame(edges, "a long, b long"), spark.createDataFrame([(1,), (1,), (5,), (9,)], "node long"), 2)
    assert sorted((r.node, r.priority) for r in got.collect()) == [(1, 0), (2, 1), (3, 2), (5, 0), (9, 0)]
    joins = [p._jdf.queryExecution().executedPlan().toString() for p in plans[1:]]
    assert len(joins) == 2 and all("ShuffledHashJoin" in j and "Sort" not in j for j in joins)

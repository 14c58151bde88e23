"""Queries for references, contexts, arbitration, evaluation and document-level detectors, with the DuckDB SQL each must equal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.operators import arbitration, conditions, evaluation, frames, knn, ranking, run, sentences, specified, targeting
from clausegraph.plans.catalog import COPIES, COSINE, FUSED, ORDER_PAIRS, Tables, _fused, _order_pairs, query
from clausegraph.plans.corpus import TEXTS
from clausegraph.sources import registries

LINE_SQL = "l_orderkey * 10 + l_linenumber"


def _line() -> Column:
    return (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("clause")


# --- texts -----------------------------------------------------------------------------------------------------------

MARKED = r"""replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '([.!?])\s+(\p{Lu})', '\1' || chr(1) || '\2', 'g'), '([.!?])\s+(\p{Lu})', '\1' || chr(1) || '\2', 'g'),
'(^|[^\p{L}\p{N}])((?i:art|cf|ex|n°|no|fig|réf|éd|av|ap|p|al|chap|tab)|\p{L}|[0-9]{1,9})\.' || chr(1), '\1\2. ', 'g'), '(^|[^\p{L}\p{N}])((?i:art|cf|ex|n°|no|fig|réf|éd|av|ap|p|al|chap|tab)|\p{L}|[0-9]{1,9})\.' || chr(1), '\1\2. ', 'g'), chr(2), '')"""


@query(f"SELECT doc_id, CAST(len(s) AS INT) AS n, md5(array_to_string(list_transform(s, lambda x: regexp_replace(x, '\\s+', ' ', 'g')), '|')) AS digest FROM (SELECT doc_id, string_split({MARKED}, chr(1)) AS s FROM documents)")
def sentence_bounds(t: Tables) -> DataFrame:
    found = sentences.sentences(F.regexp_replace("text", r"\s{2,}|[\t\n\x0B\f\r]", " "))  # white space moves no end
    return t.documents.select("doc_id", F.size(found).alias("n"), F.md5(F.array_join(found, "|")).alias("digest"))


LINES_SQL = "SELECT doc_id AS id, i - 1 AS pos, l[i] AS line, length(l[i]) > 60 AS whole FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"


@query(f"""WITH s AS ({LINES_SQL}), n AS (SELECT *, sum(whole::INT) OVER (PARTITION BY id ORDER BY pos) AS n, sum(whole::INT) OVER (PARTITION BY id) AS every FROM s)
SELECT id, CAST(CASE WHEN every = 0 THEN 1 ELSE greatest(n, 1) END AS BIGINT) AS span, md5(string_agg(line, ' ' ORDER BY pos)) AS digest FROM n GROUP BY 1, 2""")
def sentence_spans(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n")).alias("pos", "sentence")).withColumn("autonomous", F.length("sentence") > 60)
    return sentences.spans(rows).select("id", "span", F.md5("text").alias("digest"))


@query(r"""SELECT doc_id, regexp_matches(text, '(?i)(^|[^\p{L}])(doit|doivent|devra|peut|peuvent|est interdit|sont interdit|est obligatoire|sont obligatoire|est requis|sont requis|est tenu de|est chargé de|est autorisé|sont autorisé|est recommandé|prévaut|prévalent)')
OR regexp_matches(text, '(?i)on entend par|désigne|s''entend comme|est définie? comme|signifie|correspond à') OR regexp_matches(text, '«[^»]+»|§ ?[0-9]|[A-Z]{2,4}-[A-Z]{2,4}-[0-9]{2,3}|[0-9]') OR regexp_matches(text, '(?i)(^|[^\p{L}])(quotidien|journalier|hebdomadaire|mensuel|bimestriel|trimestriel|semestriel|annuel)')
OR regexp_matches(text, '(?i)(^|[^\p{L}])(chaque|tous les|toutes les)([^\p{L}]|$)') AS qualifies FROM documents""")
def statements_qualified(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", sentences.qualifies(F.col("text")).alias("qualifies"))


@query("SELECT a, b FROM (SELECT event_id AS a, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NOT NULL")
def next_clauses(t: Tables) -> DataFrame:
    place = F.struct("ts", "event_id")
    return sentences.followers(t.events.select(F.col("user_id").alias("id"), place.alias("ord"), F.col("event_id").alias("clause_id")))



@query("""SELECT p_partkey, list_distinct_in_order AS actors FROM (SELECT p_partkey, list_filter(a, lambda x, i: list_position(a, x) = i) AS list_distinct_in_order FROM (SELECT p_partkey,
regexp_extract_all(trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g')), '(economy|large brushed|large|brushed|part|standard|promo)', 1) AS a FROM part))""")
def actors_found(t: Tables) -> DataFrame:
    names = ("large", "large brushed", "brushed", "economy", "part", "standard", "promo")
    return t.part.select("p_partkey", frames.actors(F.concat_ws(" ", "p_name", "p_type"), names).alias("actors"))


REFERENCES = """r AS (SELECT l_orderkey * 10 + l_linenumber AS clause, l_suppkey AS doc, CASE WHEN l_returnflag = 'A' THEN 'NORM' ELSE 'INTERNAL' END AS kind, CASE WHEN l_linenumber > 3 THEN 'C' || l_partkey % 40 END AS target, (l_partkey % 30) || '.1' AS section FROM lineitem),
d AS (SELECT 'C' || s_suppkey % 35 AS target, min(s_suppkey) AS found FROM supplier GROUP BY 1), s AS (SELECT DISTINCT s_suppkey AS doc, CAST(s_nationkey AS VARCHAR) AS head FROM supplier)"""


@query(f"""WITH {REFERENCES}, n AS (SELECT r.*, CASE WHEN kind = 'INTERNAL' THEN CASE WHEN r.target IS NULL THEN r.doc ELSE d.found END END AS target_doc FROM r LEFT JOIN d ON r.target = d.target)
SELECT clause, kind, target_doc, CASE WHEN kind = 'INTERNAL' THEN s.doc IS NOT NULL END AS resolved FROM n LEFT JOIN s ON n.target_doc = s.doc AND regexp_extract(section, '^[0-9]+', 0) = s.head""")
def references_resolved(t: Tables) -> DataFrame:
    refs = t.lineitem.select(_line(), F.col("l_suppkey").alias("doc"), F.when(F.col("l_returnflag") == "A", "NORM").otherwise("INTERNAL").alias("kind"), F.when(F.col("l_linenumber") > 3, F.concat(F.lit("C"), (F.col("l_partkey") % 40).cast("string"))).alias("target"), F.concat((F.col("l_partkey") % 30).cast("string"), F.lit(".1")).alias("section"))
    docs = t.supplier.select(F.col("s_suppkey").alias("doc"), F.concat(F.lit("C"), (F.col("s_suppkey") % 35).cast("string")).alias("code"))
    return frames.resolved(refs, docs, t.supplier.select(F.col("s_suppkey").alias("doc"), F.col("s_nationkey").alias("section"))).select("clause", "kind", "target_doc", "resolved")


# --- contexts and couples --------------------------------------------------------------------------------------------

CONTEXT = "SELECT l_orderkey AS clause, l_linenumber, l_quantity::INT AS q, CASE WHEN l_returnflag = 'R' THEN l_linestatus END AS norm, l_partkey AS concept FROM lineitem"


@query(f"""WITH l AS ({CONTEXT}), g AS (SELECT clause, list_sort(list(DISTINCT q)) AS quantities, list_sort(list(DISTINCT norm) FILTER (norm IS NOT NULL)) AS norms, list_sort(list(DISTINCT concept)) AS concepts, list_sort(list(DISTINCT concept % 100) FILTER (concept % 3 = 0)) AS canonical FROM l GROUP BY clause)
SELECT o_orderkey AS clause, coalesce(quantities, []) AS quantities, coalesce(norms, []) AS norms, coalesce(concepts, []) AS concepts, coalesce(canonical, []) AS canonical FROM orders LEFT JOIN g ON o_orderkey = clause""")
def clause_contexts(t: Tables) -> DataFrame:
    side = lambda c: t.lineitem.select(F.col("l_orderkey").alias("clause"), c.alias("value"))
    parts = t.part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("value"), (F.col("p_partkey") % 100).alias("canonical"))
    return frames.context(t.orders.select(F.col("o_orderkey").alias("clause")), side(F.col("l_quantity").cast("int")), side(F.when(F.col("l_returnflag") == "R", F.col("l_linestatus"))), side(F.col("l_partkey")), parts)


QUANTITIES = "q AS (SELECT l_orderkey AS clause, (l_linenumber * 1000000 + l_partkey) * 100 + l_quantity::BIGINT AS place, l_returnflag AS dimension, l_linestatus AS role, CASE WHEN l_linenumber % 5 <> 0 THEN l_quantity END AS value FROM lineitem)"
COUPLES = f"p AS ({ORDER_PAIRS}), {QUANTITIES}, c AS (SELECT p.a, p.b, x.dimension, x.role, x.value AS value_a, y.value AS value_b, row_number() OVER (PARTITION BY p.a, p.b ORDER BY x.place, y.place) AS place FROM p JOIN q x ON x.clause = p.a JOIN q y ON y.clause = p.b AND y.dimension = x.dimension AND y.role = x.role)"


def _couples(t: Tables) -> DataFrame:
    q = t.lineitem.select(F.col("l_orderkey").alias("clause"), ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 100 + F.col("l_quantity").cast("long")).alias("place"), F.col("l_returnflag").alias("dimension"), F.col("l_linestatus").alias("role"), F.when(F.col("l_linenumber") % 5 != 0, F.col("l_quantity")).alias("value"))
    return frames.comparable_couples(_order_pairs(t), q)


@query(f"WITH {COUPLES} SELECT * FROM c")
def quantity_couples(t: Tables) -> DataFrame:
    return _couples(t)


@query(f"WITH {COUPLES}, f AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY place) AS r FROM c WHERE value_a <> value_b) SELECT a, b, dimension, role, value_a, value_b FROM f WHERE r = 1")
def first_divergences(t: Tables) -> DataFrame:
    return frames.first_divergence(_couples(t))


@query(f"WITH p AS ({ORDER_PAIRS}), o AS (SELECT l_orderkey AS k, list(DISTINCT l_partkey % 50) AS c FROM lineitem GROUP BY 1) SELECT a, b, CAST(len(list_intersect(x.c, y.c)) AS INT) AS shared FROM p JOIN o x ON x.k = a JOIN o y ON y.k = b WHERE a IS NOT NULL")
def objects_shared(t: Tables) -> DataFrame:
    o = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set(F.col("l_partkey") % 50).alias("c"))
    both = _order_pairs(t).select("a", "b").join(o.select(F.col("k").alias("a"), F.col("c").alias("x")), "a").join(o.select(F.col("k").alias("b"), F.col("c").alias("y")), "b")
    return both.select("a", "b", frames.shared_objects(F.col("x"), F.col("y")).alias("shared"))


HELD = "h AS (SELECT DISTINCT l_orderkey AS clause, l_returnflag AS cond FROM lineitem WHERE l_linenumber <= 2 AND l_quantity > 15), e(x, y, r) AS (VALUES ('A', 'N', 'INCLUDED_IN'), ('A', 'R', 'DISJOINT'), ('A', 'A', 'IDENTITY'), ('N', 'N', 'IDENTITY'), ('R', 'R', 'IDENTITY'), ('N', 'A', 'INCLUDES'), ('R', 'A', 'DISJOINT'))"


@query(f"""WITH p AS (SELECT DISTINCT a, b FROM ({ORDER_PAIRS}) WHERE a IS NOT NULL), {HELD}, g AS (SELECT a, b, ha.cond AS ca, hb.cond AS cb, coalesce(e.r, 'UNDETERMINED') AS r FROM p JOIN h ha ON ha.clause = a JOIN h hb ON hb.clause = b LEFT JOIN e ON e.x = ha.cond AND e.y = hb.cond),
b AS (SELECT a, b, min(m) AS i FROM (SELECT a, b, cb, max((r IN ('IDENTITY', 'INCLUDED_IN'))::INT) AS m FROM g GROUP BY ALL) GROUP BY a, b), c AS (SELECT a, b, min(m) AS i FROM (SELECT a, b, ca, max((r IN ('IDENTITY', 'INCLUDES'))::INT) AS m FROM g GROUP BY ALL) GROUP BY a, b), d AS (SELECT a, b, bool_or(r = 'DISJOINT') AS apart FROM g GROUP BY a, b)
SELECT p.a, p.b, CASE WHEN p.a NOT IN (SELECT clause FROM h) AND p.b NOT IN (SELECT clause FROM h) THEN 'IDENTITY' WHEN p.b NOT IN (SELECT clause FROM h) THEN 'INCLUDED_IN' WHEN p.a NOT IN (SELECT clause FROM h) THEN 'INCLUDES' WHEN apart THEN 'DISJOINT' WHEN b.i = 1 AND c.i = 1 THEN 'IDENTITY' WHEN b.i = 1 THEN 'INCLUDED_IN' WHEN c.i = 1 THEN 'INCLUDES' ELSE 'UNDETERMINED' END AS relation
FROM p LEFT JOIN b ON b.a = p.a AND b.b = p.b LEFT JOIN c ON c.a = p.a AND c.b = p.b LEFT JOIN d ON d.a = p.a AND d.b = p.b""")
def scopes_with_empty(t: Tables) -> DataFrame:
    held = t.lineitem.where("l_linenumber <= 2 AND l_quantity > 15").select(F.col("l_orderkey").alias("clause"), F.col("l_returnflag").alias("cond")).distinct()
    related = t.spark.createDataFrame([("A", "N", "INCLUDED_IN"), ("A", "R", "DISJOINT")], "cond_a string, cond_b string, relation string")
    return conditions.scopes(_order_pairs(t), held, related)


@query("""WITH c AS (SELECT DISTINCT 'SEUIL' AS kind, CASE WHEN p_size % 2 = 0 THEN '>=' ELSE '<' END AS op, p_size::DOUBLE AS v, 'p' || p_size AS s FROM part UNION ALL SELECT 'SPATIAL', NULL, NULL, n_name FROM nation)
SELECT x.s AS a, y.s AS b, CASE WHEN x.s = y.s THEN 'IDENTITY' WHEN x.kind <> y.kind THEN 'UNDETERMINED' WHEN x.kind = 'SPATIAL' THEN 'UNDETERMINED' WHEN x.op = y.op THEN CASE WHEN (x.op = '>=') = (x.v > y.v) THEN 'INCLUDED_IN' ELSE 'INCLUDES' END
WHEN (CASE WHEN x.op = '>=' THEN x.v ELSE y.v END) >= (CASE WHEN x.op = '>=' THEN y.v ELSE x.v END) THEN 'DISJOINT' ELSE 'OVERLAPS' END AS relation FROM c x JOIN c y ON x.s < y.s""")
def condition_relations(t: Tables) -> DataFrame:
    sizes = t.part.select("p_size").distinct().select(F.lit("SEUIL").alias("kind"), F.when(F.col("p_size") % 2 == 0, ">=").otherwise("<").alias("op"), F.col("p_size").cast("double").alias("v"), F.concat(F.lit("p"), F.col("p_size").cast("string")).alias("s"))
    rows = sizes.union(t.nation.select(F.lit("SPATIAL"), F.lit(None).cast("string"), F.lit(None).cast("double"), "n_name"))
    both = rows.toDF("ka", "oa", "va", "a").join(rows.toDF("kb", "ob", "vb", "b"), F.col("a") < F.col("b"))  # distinct conditions, a bounded dictionary
    no = F.lit(False)
    relation = conditions.typed_relation(F.col("ka"), F.col("kb"), conditions.spatial_relation(F.col("a"), F.col("b"), no, no, no), conditions.threshold_relation(F.col("oa"), F.col("va"), F.col("ob"), F.col("vb")), F.col("a") == F.col("b"))
    return both.select("a", "b", relation.alias("relation"))


@query("SELECT x.l_orderkey * 10 + x.l_linenumber AS clause, y.l_orderkey * 10 + y.l_linenumber AS target FROM lineitem x JOIN lineitem y ON y.l_suppkey = x.l_suppkey AND y.l_partkey = x.l_partkey AND y.l_orderkey > x.l_orderkey")
def cross_references(t: Tables) -> DataFrame:
    x = t.lineitem.select(_line(), F.col("l_orderkey").alias("k"), "l_suppkey", "l_partkey")
    y = t.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("target"), F.col("l_orderkey").alias("k2"), "l_suppkey", "l_partkey")
    return x.join(y, ["l_suppkey", "l_partkey"]).where("k2 > k").select("clause", "target")


# --- alias bridge and judge ------------------------------------------------------------------------------------------

@query(f"{COSINE} SELECT a, b, score FROM near WHERE rank <= 5 AND a < b AND list_sort([a % 4, a % 3 + 10]) <> list_sort([b % 4, b % 3 + 10])")
def alias_pairs(t: Tables) -> DataFrame:
    near = knn.nearest(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), 5).where("a < b")
    coverage = t.embeddings.select(F.col("vec_id").alias("concept"), F.explode(F.array(F.col("vec_id") % 4, F.col("vec_id") % 3 + 10)).alias("doc"))
    return arbitration.coverage_differs(near, coverage).select("a", "b", F.round("score", 6).alias("score"))


@query("SELECT vec_id, greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (vec_id % 1000) / 999.0::DOUBLE * 2.0::DOUBLE - 1.0::DOUBLE)) AS cosine FROM embeddings")
def cosine_scale(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", arbitration.cosine_from_index((F.col("vec_id") % 1000) / F.lit(999.0)).alias("cosine"))


@query("""WITH p AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b, x.n_name AS na, y.n_name AS nb FROM nation x JOIN nation y ON y.n_nationkey = x.n_nationkey + 1), g AS (SELECT n_name AS name, n_regionkey AS grp, min(n_name) OVER (PARTITION BY n_regionkey) AS first FROM nation)
SELECT a, b, EXISTS (SELECT 1 FROM g WHERE name <> first AND ((na = first AND nb = name) OR (nb = first AND na = name))) AS listed FROM p""")
def lexicon_pairs(t: Tables) -> DataFrame:
    groups = t.nation.select(F.col("n_regionkey").alias("group"), F.col("n_name").alias("name"))
    pairs = t.nation.select(F.col("n_nationkey").alias("a"), (F.col("n_nationkey") + 1).alias("b"), F.col("n_name").alias("name_a")).join(t.nation.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("name_b")), "b")
    return arbitration.listed(pairs, arbitration.group_pairs(groups)).select("a", "b", "listed")


@query("SELECT l_orderkey AS a, l_orderkey * 10 + l_linenumber AS b, CASE WHEN l_returnflag = 'A' THEN 'EXACT' WHEN l_linestatus = 'F' THEN 'LEXICON' WHEN l_quantity / 50 >= 0.86 THEN 'VECTOR' ELSE 'NONE' END AS would_be FROM lineitem WHERE l_partkey % 7 = 0")
def veto_trace(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("a"), _line().alias("b"), (F.col("l_partkey") % 7 == 0).alias("veto"), (F.col("l_returnflag") == "A").alias("exact"), (F.col("l_linestatus") == "F").alias("lexical"), (F.col("l_quantity") / 50).alias("cosine"))
    return arbitration.vetoed(rows)


@query(f"{COSINE} SELECT a, b, score AS cosine FROM near WHERE rank <= 5 AND a < b AND score < 0.4 ORDER BY score DESC, a, b LIMIT 2")
def grey_zone(t: Tables) -> DataFrame:
    near = knn.nearest(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), 5).where("a < b").select("a", "b", F.round("score", 6).alias("cosine"))
    return arbitration.grey_zone(near.where("cosine < 0.4").withColumn("method", F.lit("GREY"))).select("a", "b", "cosine")


@query(f"WITH RECURSIVE {COPIES}, more AS (SELECT a, b FROM edges UNION SELECT doc_id, doc_id + 1 FROM documents WHERE doc_id % 50 = 0 AND doc_id % 100 >= 50 AND doc_id + 1 IN (SELECT doc_id FROM documents)), u AS (SELECT a, b FROM more UNION SELECT b, a FROM more), r AS (SELECT a AS node, a AS reach FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.reach), c AS (SELECT node, min(reach) AS component FROM r GROUP BY node) SELECT node, component, first_value(node) OVER (PARTITION BY component ORDER BY node % 5 DESC, node) AS canonical FROM c")
def alias_arbitrated(t: Tables) -> DataFrame:
    after = F.lead("doc_id").over(Window.partitionBy(F.md5("text")).orderBy("doc_id"))
    edges = t.documents.select(F.col("doc_id").alias("a"), after.alias("b")).where("b IS NOT NULL")
    asked = t.documents.where("doc_id % 50 = 0").select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"), F.lit(True).alias("same"), F.when(F.col("doc_id") % 100 >= 50, 0.9).otherwise(0.5).alias("confidence"))
    asked = asked.join(t.documents.select(F.col("doc_id").alias("b")), "b", "left_semi")
    return arbitration.arbitrated(edges, asked, t.documents.select(F.col("doc_id").alias("node"), (F.col("doc_id") % 5).alias("frequency")))


@query(f"{FUSED} SELECT a, b, row_number() OVER (ORDER BY rrf DESC, a, b) AS place FROM budget WHERE kept")
def judge_order(t: Tables) -> DataFrame:
    return arbitration.submission_order(targeting.within_budget(_fused(t)).where("kept").select("a", "b", "rrf")).select("a", "b", "place")


CALLS = "c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place, value < 40 AS failed FROM events)"


def _calls(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("user_id", "event_id", place.alias("place"), (F.col("value") < 40).alias("failed"))


@query(f"""WITH {CALLS}, r AS (SELECT *, sum(failed::INT) OVER (PARTITION BY user_id ORDER BY place ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM c), f AS (SELECT user_id, min(place) AS trip FROM r WHERE n = 3 GROUP BY user_id)
SELECT event_id, CASE WHEN place > trip THEN 'SKIPPED' ELSE 'CALLED' END AS state FROM r LEFT JOIN f ON f.user_id = r.user_id""")
def circuit_breaker(t: Tables) -> DataFrame:
    return arbitration.broken_circuit(_calls(t), ["user_id"]).select("event_id", "state")


@query("""SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'ABSTENTION_COUPE_CIRCUIT' WHEN doc_id % 11 = 0 THEN 'ABSTENTION_JSON' WHEN doc_id % 7 = 0 THEN 'AUCUNE' WHEN NOT (length(substr(text, 3, 9)) > 0 AND length(text) > 0 AND contains(lower(text), substr(text, 1, 5))) THEN 'PREUVE_INVENTEE' WHEN doc_id % 10 < 4 THEN 'ABSTENTION_CONFIANCE' ELSE 'CONTRADICTION' END AS verdict FROM documents""")
def judge_answers(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    verdict = arbitration.interpreted(F.when(i % 13 == 0, "SKIPPED").otherwise("CALLED"), i % 11 != 0, F.when(i % 7 == 0, "AUCUNE").otherwise("CONTRADICTION"), F.when(i % 10 < 4, 0.5).otherwise(0.8), F.substring("text", 3, 9), F.col("text"), F.substring("text", 1, 5), F.lower("text"))
    return t.documents.select("doc_id", verdict.alias("verdict"))


@query("""WITH v AS (SELECT l_orderkey AS a, l_suppkey % 3 = 0 AS swapped, l_returnflag AS verdict, count(*) AS n, avg(l_discount) AS c FROM lineitem GROUP BY ALL), p AS (SELECT *, sum(n) OVER w AS every, row_number() OVER (w ORDER BY n DESC, verdict) AS r FROM v WINDOW w AS (PARTITION BY a, swapped)),
g AS (SELECT a, count(DISTINCT verdict) AS kinds, count(*) AS orders, min(verdict) AS verdict, sum(n) AS n, sum(every) AS every, avg(c) AS c FROM p WHERE r = 1 GROUP BY a) SELECT a, a + 1 AS b, CASE WHEN kinds = 1 AND orders = 2 AND n >= 0.6 * every THEN verdict ELSE 'ABSTENTION' END AS verdict, CAST(every AS BIGINT) AS votes, round(c, 6) AS confidence FROM g""")
def judge_votes(t: Tables) -> DataFrame:
    votes = t.lineitem.select(F.col("l_orderkey").alias("a"), (F.col("l_orderkey") + 1).alias("b"), (F.col("l_suppkey") % 3 == 0).alias("swapped"), F.col("l_returnflag").alias("verdict"), F.col("l_discount").alias("confidence"))
    return specified.agreed(votes)


@query("SELECT event_type AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS place FROM events GROUP BY event_type")
def abstention_histogram(t: Tables) -> DataFrame:
    return arbitration.histogram(t.events, "event_type")


@query("SELECT count(*) AS calls, count(*) FILTER (NOT cached) AS network, count(*) FILTER (cached) AS from_cache, count(*) FILTER (repaired) AS repairs, count(*) FILTER (failed) AS failures, round(count(*) FILTER (cached) / count(*)::DOUBLE, 6) AS cache_rate FROM (SELECT event_type = 'view' OR event_id % 3 = 0 AS cached, event_id % 5 = 0 AS repaired, value < 40 AS failed FROM events)")
def model_costs(t: Tables) -> DataFrame:
    return arbitration.call_costs(t.events.select(((F.col("event_type") == "view") | (F.col("event_id") % 3 == 0)).alias("cached"), (F.col("event_id") % 5 == 0).alias("repaired"), (F.col("value") < 40).alias("failed")))


OVERLAP = lambda x, y: f"CASE WHEN len({x}) > 0 THEN 1 - len(list_intersect({x}, {y})) / len({x})::DOUBLE ELSE 0.0::DOUBLE END"


@query(f"""WITH w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS w FROM documents), s AS (SELECT x.doc_id AS a, y.doc_id AS b, greatest({OVERLAP('x.w', 'y.w')}, {OVERLAP('y.w', 'x.w')}) AS score FROM w x JOIN w y ON y.doc_id = x.doc_id + 1)
SELECT a, b, round(score, 9) AS score, CASE WHEN score <= 0.3 THEN 'REJECTED' WHEN score >= 0.9 THEN 'HIGH' ELSE 'BETWEEN' END AS zone FROM s""")
def entailment_zones(t: Tables) -> DataFrame:
    words = arbitration.distinct_words(F.col("text"))  # once a text and side, before the join
    d = t.documents.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"), words.alias("text_a")).join(t.documents.select(F.col("doc_id").alias("b"), words.alias("text_b")), "b")
    return arbitration.entailment(d, arbitration.words_missing, 0.3, 0.9).select("a", "b", F.round("score", 9).alias("score"), "zone")


# --- detectors on documents ------------------------------------------------------------------------------------------

@query("WITH r AS (SELECT min(p_partkey) AS id, p_brand AS doc, p_type AS concept, p_size % 3 AS definition FROM part GROUP BY 2, 3, 4) SELECT x.concept, x.id AS a, y.id AS b FROM r x JOIN r y ON x.concept = y.concept AND x.doc <> y.doc AND x.id < y.id AND x.definition <> y.definition")
def definitions_divergent(t: Tables) -> DataFrame:
    return specified.divergent_definitions(t.part.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("doc"), F.col("p_type").alias("concept"), (F.col("p_size") % 3).alias("definition")))


@query(f"WITH p AS ({ORDER_PAIRS}) SELECT a, b, CASE WHEN start_a >= start_b THEN start_a ELSE start_b END AS starts, least(end_a, end_b) AS ends FROM p WHERE a IS NOT NULL AND (least(end_a, end_b) IS NULL OR greatest(start_a, start_b) <= least(end_a, end_b))")
def validity_overlaps(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    periods = t.orders.select(F.col("o_orderkey").alias("id"), day.alias("starts"), F.when(F.col("o_orderstatus") != "O", F.date_add(day, 90)).alias("ends"))
    return specified.overlapping(_order_pairs(t).select("a", "b"), periods)


@query("SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS target, CAST(l_shipdate AS DATE) AS day FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE CAST(l_shipdate AS DATE) < CAST(o_orderdate AS DATE) + 10 OR CAST(l_shipdate AS DATE) > CAST(o_orderdate AS DATE) + 60")
def cited_while_invalid(t: Tables) -> DataFrame:
    day = F.col("o_orderdate").cast("date")
    periods = t.orders.select(F.col("o_orderkey").alias("id"), F.date_add(day, 10).alias("starts"), F.date_add(day, 60).alias("ends"))
    return specified.cited_while_invalid(t.lineitem.select(_line().alias("id"), F.col("l_orderkey").alias("target"), F.col("l_shipdate").cast("date").alias("day")), periods)


@query("SELECT o_orderkey, CASE WHEN o_custkey % 6 = 0 THEN 'ORPHAN' WHEN o_orderstatus = 'P' THEN 'OBSOLETE_TARGET' WHEN o_custkey % 4 = 0 OR o_totalprice < 20000 THEN 'UNTRACED' WHEN CAST(o_orderdate AS DATE) < DATE '1996-01-01' THEN 'EXPIRED' END AS defect FROM orders")
def derogations_defective(t: Tables) -> DataFrame:
    defect = specified.derogation_defect(F.col("o_custkey") % 6 != 0, F.col("o_orderstatus") == "P", F.when(F.col("o_custkey") % 4 != 0, "x"), F.when(F.col("o_totalprice") >= 20000, "x"), F.col("o_orderdate").cast("date"), F.lit("1996-01-01").cast("date"))
    return t.orders.select("o_orderkey", defect.alias("defect"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = l_suppkey % 3 THEN false WHEN l_linenumber % 3 > l_suppkey % 3 THEN l_discount > l_tax ELSE l_tax > l_discount END AS inverted FROM lineitem")
def hierarchy_inversions(t: Tables) -> DataFrame:
    return t.lineitem.select("l_orderkey", "l_linenumber", specified.inverted(F.col("l_linenumber") % 3, F.col("l_suppkey") % 3, F.col("l_discount"), F.col("l_tax"), F.lit("delai")).alias("inverted"))


@query("SELECT DISTINCT least(x.doc_id, y.doc_id) AS a, greatest(x.doc_id, y.doc_id) AS b, 1.0::DOUBLE AS score FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 3 AND x.source <> y.source")
def channel_structural(t: Tables) -> DataFrame:
    edges = t.documents.select(F.col("doc_id").alias("a"), (F.col("doc_id") + 3).alias("b"))
    return specified.structural_channel(edges, t.documents.select(F.col("doc_id").alias("id"), F.col("source").alias("doc")))


@query(f"""WITH p AS (SELECT a, b, start_a AS a0, coalesce(end_a, DATE '9999-12-31') AS a1, start_b AS b0, coalesce(end_b, DATE '9999-12-31') AS b1 FROM ({ORDER_PAIRS}) WHERE a IS NOT NULL)
SELECT a, b, CASE WHEN a0 = b0 AND a1 = b1 THEN 'IDENTITY' WHEN a1 < b0 OR b1 < a0 THEN 'DISJOINT' WHEN a0 >= b0 AND a1 <= b1 THEN 'INCLUDED_IN' WHEN a0 <= b0 AND a1 >= b1 THEN 'INCLUDES' ELSE 'OVERLAPS' END AS relation FROM p""")
def temporal_relations(t: Tables) -> DataFrame:
    return _order_pairs(t).select("a", "b", specified.temporal_relation(*[F.col(c) for c in ("start_a", "end_a", "start_b", "end_b")]).alias("relation"))


POPULATIONS = "SELECT o_custkey AS k, list(DISTINCT o_orderpriority) FILTER (o_orderstatus <> 'P') AS m FROM orders GROUP BY 1"


@query(f"""WITH c AS (SELECT k, coalesce(m, []) AS m FROM ({POPULATIONS})), p AS (SELECT x.k AS a, y.k AS b, len(list_intersect(x.m, y.m)) AS n, len(x.m) AS p, len(y.m) AS q FROM c x JOIN c y ON y.k = x.k + 1)
SELECT a, b, CASE WHEN p = 0 AND q = 0 THEN 'IDENTITY' WHEN p = 0 THEN 'INCLUDES' WHEN q = 0 THEN 'INCLUDED_IN' WHEN n = 0 THEN 'DISJOINT' WHEN n = p AND n = q THEN 'IDENTITY' WHEN n = p THEN 'INCLUDED_IN' WHEN n = q THEN 'INCLUDES' ELSE 'OVERLAPS' END AS relation FROM p""")
def population_relations(t: Tables) -> DataFrame:
    c = t.orders.groupBy(F.col("o_custkey").alias("k")).agg(F.collect_set(F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority"))).alias("m"))
    both = c.select(F.col("k").alias("a"), (F.col("k") + 1).alias("b"), F.col("m").alias("x")).join(c.select(F.col("k").alias("b"), F.col("m").alias("y")), "b")
    return both.select("a", "b", specified.population_relation(F.col("x"), F.col("y")).alias("relation"))


# --- evaluation ------------------------------------------------------------------------------------------------------

MATCHED = """t AS (SELECT least(l_partkey, l_suppkey) || '' AS x, list_sort(list_distinct(['p' || l_partkey, 's' || l_suppkey])) AS sides, l_linenumber < 4 AS in_scope FROM lineitem WHERE l_returnflag = 'A'), f AS (SELECT list_sort(list_distinct(['s' || l_suppkey, 'p' || l_partkey])) AS sides FROM lineitem WHERE l_quantity > 20),
a AS (SELECT array_to_string(sides, '|') AS key, bool_or(in_scope) AS in_scope FROM t GROUP BY 1), b AS (SELECT DISTINCT array_to_string(sides, '|') AS key FROM f), m AS (SELECT coalesce(a.key, b.key) AS key, coalesce(in_scope, true) AS in_scope, a.key IS NOT NULL AS expected, b.key IS NOT NULL AS found FROM a FULL JOIN b ON a.key = b.key)"""


def _matched(t: Tables) -> DataFrame:
    p, s = F.concat(F.lit("p"), F.col("l_partkey").cast("string")), F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))
    truth = t.lineitem.where("l_returnflag = 'A'").select(F.array(p, s).alias("sides"), (F.col("l_linenumber") < 4).alias("in_scope"))
    return evaluation.matched(t.lineitem.where("l_quantity > 20").select(F.array(s, p).alias("sides")), truth)


@query(f"WITH {MATCHED} SELECT key, in_scope, expected, found FROM m")
def truth_matches(t: Tables) -> DataFrame:
    return _matched(t)


@query(f"""WITH {MATCHED}, r AS (SELECT *, key IN (SELECT key FROM m WHERE length(key) % 2 = 0) AS targeted FROM m), s AS (SELECT 'ALL' AS scope, * FROM r UNION ALL SELECT 'IN_SCOPE', * FROM r WHERE in_scope), c AS (SELECT scope, count(*) FILTER (expected AND found) AS tp, count(*) FILTER (NOT expected AND found) AS fp, count(*) FILTER (expected AND NOT found) AS fn, count(*) FILTER (expected AND targeted) AS reached FROM s GROUP BY scope)
SELECT scope, tp, fp, fn, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / (tp + fn)::DOUBLE, 6) AS recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) AS f1, round(reached / (tp + fn)::DOUBLE, 6) AS targeting_recall FROM c""")
def eval_scopes(t: Tables) -> DataFrame:
    rows = _matched(t)
    return evaluation.scale(rows, rows.where(F.length("key") % 2 == 0).select("key"))


@query("SELECT CAST(p_type || p_size % 4 AS VARCHAR) AS key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def truth_collisions(t: Tables) -> DataFrame:
    return evaluation.repeated(t.part.select(F.concat("p_type", (F.col("p_size") % 4).cast("string")).alias("key")), "key")


@query("SELECT 4 * max(n) AS budget FROM (SELECT count(*) AS n FROM documents GROUP BY source)")
def budget_of_corpus(t: Tables) -> DataFrame:
    return evaluation.global_budget(t.documents.select(F.col("source").alias("doc")))


TARGETS = (">= 10/12", "80 a 140", ">= 0,91", "0", "sans", "3 / 0")


@query("SELECT * FROM (VALUES ('>= 10/12', 10 / 12.0::DOUBLE, 10.0::DOUBLE, 12.0::DOUBLE), ('80 a 140', 80, 80, 140), ('>= 0,91', 0.91, NULL, NULL), ('0', 0, NULL, NULL), ('sans', NULL, NULL, NULL), ('3 / 0', 0, 3, 0)) AS t(target, number, low, high)")
def target_verdicts(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(x,) for x in TARGETS], "target string")
    both = evaluation.target_range(F.col("target"))
    return rows.select("target", evaluation.target_number(F.col("target")).alias("number"), both["low"].alias("low"), both["high"].alias("high"))


@query("""SELECT rubric, id, motif FROM (SELECT CASE doc_id % 3 WHEN 0 THEN 'FINDING' WHEN 1 THEN 'OCCURRENCE' ELSE 'DEROGATION' END AS rubric, doc_id AS id, CASE WHEN doc_id % 3 = 1 AND doc_id % 2 = 0 THEN NULL WHEN p = '' AND doc_id % 3 = 0 THEN 'PREUVE_ABSENTE' WHEN p = '' THEN NULL WHEN doc_id % 7 = 0 THEN 'TEXTE_SOURCE_ABSENT' WHEN NOT contains(text, q) THEN 'PREUVE_NON_LITTERALE' END AS motif
FROM (SELECT *, trim(q) AS p FROM (SELECT doc_id, text, CASE WHEN doc_id % 4 = 0 THEN '' ELSE upper(substr(text, 1, 3)) END AS q FROM documents))) WHERE motif IS NOT NULL""")
def proofs_audited(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    sides = t.documents.select(F.when(i % 3 == 0, "FINDING").when(i % 3 == 1, "OCCURRENCE").otherwise("DEROGATION").alias("rubric"), i.alias("id"), (i % 2 == 0).alias("representative"), F.when(i % 4 == 0, "").otherwise(F.upper(F.substring("text", 1, 3))).alias("proof"), F.when(i % 7 != 0, F.col("text")).alias("source"))
    return evaluation.proof_audit(sides)


@query("SELECT a, b FROM (SELECT x.p_partkey AS a, y.p_partkey AS b FROM part x JOIN part y ON x.p_type = y.p_type AND x.p_size = y.p_size AND x.p_partkey < y.p_partkey EXCEPT ALL SELECT x.p_partkey, y.p_partkey FROM part x JOIN part y ON x.p_type = y.p_type AND x.p_size = y.p_size AND x.p_brand = y.p_brand AND x.p_partkey < y.p_partkey)")
def bridge_contribution(t: Tables) -> DataFrame:
    return evaluation.contribution(t.part.select(F.col("p_partkey").alias("id"), "p_type", "p_size", "p_brand"), ["p_type", "p_size"], "p_brand")


ABLATION = "k AS (SELECT x.doc_id AS a, y.doc_id AS b FROM documents x JOIN documents y ON x.lang = y.lang AND x.n_chars = y.n_chars AND x.doc_id < y.doc_id), s AS (SELECT x.doc_id AS a, y.doc_id AS b FROM documents x JOIN documents y ON y.doc_id = x.doc_id + 3 AND x.source <> y.source), truth AS (SELECT x.doc_id AS a, y.doc_id AS b FROM documents x JOIN documents y ON x.n_chars = y.n_chars AND x.source = y.source AND x.doc_id < y.doc_id)"


@query(f"WITH {ABLATION}, u AS (SELECT 'ALL' AS branch, a, b FROM (SELECT * FROM k UNION SELECT * FROM s) UNION ALL SELECT 'NO_STRUCTURE', a, b FROM k UNION ALL SELECT 'NO_KEY', a, b FROM s) SELECT branch, count(*) AS pairs, count(t.a) AS hits FROM u LEFT JOIN truth t ON t.a = u.a AND t.b = u.b GROUP BY branch")
def channel_ablations(t: Tables) -> DataFrame:
    key = targeting.key_channel(t.documents.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("doc"), F.concat_ws("|", "lang", F.col("n_chars").cast("string")).alias("key"))).select("a", "b")
    structure = channel_structural(t).select("a", "b")
    truth = targeting.key_channel(t.documents.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("doc"), F.concat_ws("|", "source", F.col("n_chars").cast("string")).alias("key")))
    return evaluation.ablation({"ALL": key.union(structure), "NO_STRUCTURE": key, "NO_KEY": structure}, truth)


@query(f"SELECT {LINE_SQL} AS clause, min(o_orderkey) AS host FROM lineitem JOIN orders ON o_custkey = l_suppkey AND o_orderkey <> l_orderkey WHERE l_linenumber = 7 GROUP BY 1")
def derogation_targets(t: Tables) -> DataFrame:
    rows = t.lineitem.where("l_linenumber = 7").select(_line(), F.col("l_suppkey").alias("k"), F.col("l_orderkey").alias("own"))
    met = rows.join(t.orders.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("host")), "k").where("host <> own")
    return ranking.top(met, ["clause"], [F.col("host")], 1).select("clause", "host")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def derogations_listed(t: Tables) -> DataFrame:
    return t.orders.where("o_orderstatus = 'F'").join(t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey")


@query("SELECT 'orders' AS label, '{\"a\":' || o_custkey || ',\"b\":\"' || o_orderpriority || '\"}' AS key, count(*) AS n FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1")
def key_violations(t: Tables) -> DataFrame:
    found = registries.violations({"Pair": t.orders.select(F.col("o_custkey").alias("a"), F.col("o_orderpriority").alias("b"))})
    return found.withColumn("label", F.lit("orders"))


@query(f"{FUSED} SELECT a, b, row_number() OVER (ORDER BY rrf DESC, a, b) AS place, channels, 'r1' AS run FROM budget WHERE kept")
def candidates_stored(t: Tables) -> DataFrame:
    kept = targeting.within_budget(_fused(t)).where("kept")
    return registries.candidates_table(arbitration.submission_order(kept), "r1")


# --- from texts to findings ------------------------------------------------------------------------------------------

def corpus_findings(t: Tables) -> DataFrame:
    docs = t.spark.createDataFrame(list(TEXTS), "id string, text string").union(t.documents.select(F.concat(F.lit("T"), F.col("doc_id").cast("string")), "text"))
    norms = t.spark.createDataFrame([("ISO 9001", True, None)], "code string, retired boolean, replaced_by string")
    return run.findings(docs, norms)


def documents_frames(t: Tables) -> DataFrame:
    rows = run.clause_frames(t.documents.select(F.col("doc_id").cast("string").alias("id"), "text"))
    return rows.select("id", "clause_id", "ref", "kind", "modality", "statement", "action", F.size("objects").alias("objects"), F.size("references").alias("references"), F.size("conditions").alias("conditions"))


query()(corpus_findings)
query()(documents_frames)

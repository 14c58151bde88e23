"""Sentences, autonomous spans, qualification and anaphora, as column expressions and windows; no parser."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.functions.text import let

# Abbreviations after which a full stop ends no sentence; words that make a unit a statement; finite verbs;
# determiners with the gender and number of their noun; pronouns that stand for a subject.
ABBREVIATIONS = ("art", "cf", "ex", "n°", "no", "fig", "réf", "éd", "av", "ap", "p", "al", "chap", "tab")
STATEMENTS = (
    r"(?<!\p{L})(?:doit|doivent|devra|peut|peuvent|est interdit|sont interdit|est obligatoire|sont obligatoire|est requis|sont requis|est tenu de|est chargé de|est autorisé|sont autorisé|est recommandé|prévaut|prévalent)",
    r"on entend par|désigne|s'entend comme|est définie? comme|signifie|correspond à", r"«[^»]+»", r"§ ?\d", r"(?<!\p{L})(?:ISO|OHSAS) \d", r"[A-Z]{2,4}-[A-Z]{2,4}-\d{2,3}", r"(?<!\p{L})article [A-Z]?\.? ?\d", r"\d",
    r"(?<!\p{L})(?:quotidien|journalier|hebdomadaire|mensuel|bimestriel|trimestriel|semestriel|annuel)", r"(?<!\p{L})(?:chaque|tous les|toutes les)(?!\p{L})",
)
# Of the statements that need no digit, by place, parts of which one stands in the text's lower case; and letters
# that a pattern without case takes for others.
STEMS = {
    0: ("doi", "devra", "peu", "t interdit", "t obligatoire", "t requis", "est tenu de", "est chargé de", "t autorisé", "est recommandé", "préva"),
    1: ("on entend par", "désigne", "s'entend comme", "est défini", "signifie", "correspond à"), 2: ("«",),
    8: ("quotidien", "journalier", "hebdomadaire", "mensuel", "mestriel", "annuel"), 9: ("chaque", "tous les", "toutes les"),
}
ODD_CASE = {"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"}
FINITE = r"(?<!\p{L})(?:est|sont|a|ont|doit|doivent|devra|devront|peut|peuvent|fait|font|comporte|comprend|désigne|prévaut|s'applique|s'appliquent|renvoie|reste|restent|veille|\p{L}{3,}(?:era|eront|ait|aient))(?!\p{L})"
DETERMINER = {"le": "ms", "un": "ms", "ce": "ms", "cet": "ms", "la": "fs", "une": "fs", "cette": "fs", "les": "p", "des": "p", "ces": "p", "l'": "s", "chaque": "s"}
PRONOUN = {"il": "ms", "elle": "fs", "ils": "p", "elles": "p", "celui-ci": "ms", "celle-ci": "fs", "ceux-ci": "p", "celles-ci": "p", "ce dernier": "ms", "cette dernière": "fs"}
LOOK_BACK = 3

_NO_END = r"(?<![^\p{L}\p{N}](?:" + "|".join(ABBREVIATIONS) + r"|\p{L}|\d{1,9})\.)(?<!^(?:" + "|".join(ABBREVIATIONS) + r"|\p{L}|\d{1,9})\.)"
# What stands at an end is asked before what may not, as the long look back costs much and ends are few.
BOUNDARY = r"(?u)(?<=[.!?])(?=\s)(?i)" + _NO_END + r"(?-i)\s+(?=\p{Lu})"


def sentences(text: Column) -> Column:
    """Array of sentences: cut after . ! ? before a capital, but not after an abbreviation, a number or a single letter."""
    return F.split(text, BOUNDARY)


def qualifies(text: Column) -> Column:
    """Whether a text states something: a modal or defining word, a quoted term, a reference or a quantity. A digit tells at once, and
    all references have one; a pattern is matched only where one of its stems stands."""
    any_of = lambda tests: reduce(lambda x, y: x | y, tests)
    stated = lambda low: any_of([any_of([F.contains(low, F.lit(p)) for p in parts]) & text.rlike("(?iu)" + STATEMENTS[i]) for i, parts in STEMS.items()])
    low = F.lower(reduce(lambda t, odd: F.replace(t, F.lit(odd[0]), F.lit(odd[1])), ODD_CASE.items(), text))
    return F.coalesce(text.rlike(r"\d") | let(low, stated), F.lit(False))


def autonomous(sentence: Column) -> Column:
    """Whether a sentence can stand alone: a finite verb with words before it. A rule; another boolean serves as well."""
    return F.coalesce(F.lower(sentence).rlike(r"\p{L}.*" + FINITE), F.lit(False))


def spans(rows: DataFrame) -> DataFrame:
    """(id, span, text) from ``rows(id, pos, sentence, autonomous)``: an autonomous sentence opens a span, others join the span
    before, leading ones the first; without any the whole is one span."""
    here = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opened = rows.withColumn("n", F.sum(F.col("autonomous").cast("long")).over(here)).withColumn("all", F.sum(F.col("autonomous").cast("long")).over(Window.partitionBy("id")))
    named = opened.withColumn("span", F.when(F.col("all") == 0, 1).otherwise(F.greatest(F.col("n"), F.lit(1))).cast("long"))
    return named.groupBy("id", "span").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("text"))


def _value(key: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(key == k, v).otherwise(out)
    return out


def subject(text: Column) -> Column:
    """struct(noun_phrase, form): the leading noun phrase before the first finite verb, and its gender and number where its
    determiner tells them; null without one."""
    pattern = r"(?iu)^((le |la |les |l'|un |une |des |ce |cet |cette |ces |chaque )[^,.;:]*?) " + FINITE
    phrase = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    return F.when(phrase.isNotNull(), F.struct(phrase.alias("noun_phrase"), _value(F.trim(F.lower(F.regexp_extract(text, pattern, 2))), DETERMINER).alias("form")))


def standalone(clauses: DataFrame) -> DataFrame:
    """``clauses(id, section, ord, kind, text)`` with ``standalone``: a leading pronoun replaced by the subject of one of the three
    text clauses before it in its section: the nearest that agrees in gender and number, else the nearest."""
    before = Window.partitionBy("id", "section").orderBy("ord").rowsBetween(-LOOK_BACK, -1)
    pattern = r"(?iu)^(celui-ci|celle-ci|ceux-ci|celles-ci|ce dernier|cette dernière|ils|elles|il|elle)(?!\p{L})"
    pronoun = F.lower(F.regexp_extract("text", pattern, 1))
    near = F.reverse(F.filter(F.collect_list(F.struct(F.when(F.col("kind") == "TEXT", subject(F.col("text"))).alias("s"))).over(before), lambda x: x["s"].isNotNull()))
    form = _value(pronoun, PRONOUN)
    agree = F.filter("_near", lambda x: x["s"]["form"].isNull() | (x["s"]["form"] == F.col("_form")) | (x["s"]["form"] == F.substring("_form", 2, 1)))
    rows = clauses.withColumn("_near", near).withColumn("_form", form).withColumn("_agree", agree)
    best = F.coalesce(F.get("_agree", F.lit(0))["s"]["noun_phrase"], F.get("_near", F.lit(0))["s"]["noun_phrase"])
    rest = F.expr("substring(text, length(_pronoun) + 1)")
    rows = rows.withColumn("_best", best).withColumn("_pronoun", pronoun)
    return rows.withColumn("standalone", F.when((F.col("_pronoun") != "") & F.col("_best").isNotNull(), F.concat("_best", rest)).otherwise(F.col("text"))).drop("_near", "_form", "_agree", "_best", "_pronoun")


def followers(clauses: DataFrame) -> DataFrame:
    """(a, b): each clause and the next one of its document, from ``clauses(id, ord, clause_id)``."""
    after = F.lead("clause_id").over(Window.partitionBy("id").orderBy("ord"))
    return clauses.select(F.col("clause_id").alias("a"), after.alias("b")).where("b IS NOT NULL")

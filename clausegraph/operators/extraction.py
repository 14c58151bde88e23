"""Clause frames from French normative sentences, as column expressions over the clause's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clausegraph.functions.text import MONTHS, let

# The vocabulary of obligations, quantities, conditions, references and dates in French procedures.
MARKERS = {
    "n'est pas autorisé": "INTERDICTION", "ne sont pas autorisé": "INTERDICTION", "ne doit pas": "INTERDICTION", "ne doivent pas": "INTERDICTION",
    "est interdit": "INTERDICTION", "sont interdit": "INTERDICTION", "est proscrit": "INTERDICTION", "est prohibé": "INTERDICTION", "est suspendu": "INTERDICTION", "sont suspendu": "INTERDICTION",
    "est obligatoire": "OBLIGATION", "sont obligatoire": "OBLIGATION", "est requis": "OBLIGATION", "sont requis": "OBLIGATION", "est tenu de": "OBLIGATION", "est chargé de": "OBLIGATION", "s'engage à": "OBLIGATION", "veille à": "OBLIGATION",
    "doit": "OBLIGATION", "doivent": "OBLIGATION", "devra": "OBLIGATION", "est recommandé": "RECOMMANDATION", "est privilégié": "RECOMMANDATION", "sont privilégié": "RECOMMANDATION",
    "est autorisé": "PERMISSION", "sont autorisé": "PERMISSION", "est dispensé": "PERMISSION", "sont dispensé": "PERMISSION", "peut": "PERMISSION", "peuvent": "PERMISSION", "prévaut": "CONSTAT", "prévalent": "CONSTAT",
}
DEFINITIONS = "on entend par|désigne|s'entend comme|est défini comme|est définie comme|signifie|correspond à|«[^»]+» (est|sont) "
NUMBERS = {"un": 1, "une": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "six": 6, "sept": 7, "huit": 8, "neuf": 9, "dix": 10}
OPERATORS = {"supérieur": ">", "inférieur": "<", "au-delà de": ">", "au minimum": ">=", "au maximum": "<=", "en deçà de": "<", "dépasse": ">", "à plus de": ">", "moins de": "<"}
VAGUE = {"dans la semaine": 604800, "sous quinzaine": 1209600, "sans délai": 0, "immédiatement": 0}
PERIODS = {"hebdomadaire": 7 * 86400, "mensuel": 2628000, "trimestriel": 7884000, "semestriel": 15768000, "annuel": 31536000}
PERIOD_NOUNS = {"semaine": 604800, "mois": 2628000, "trimestre": 7884000, "semestre": 15768000, "an": 31536000, "année": 31536000}
CONDITIONS = {
    "en cas d'": "CIRCONSTANCIEL", "en cas de": "CIRCONSTANCIEL", "lorsque": "CIRCONSTANCIEL", "dès lors que": "CIRCONSTANCIEL", "dès que": "CIRCONSTANCIEL", "quelle que soit": "CIRCONSTANCIEL", "sauf": "CIRCONSTANCIEL",
    "à l'exception de": "CIRCONSTANCIEL", "en zone": "SPATIAL", "sur l'ensemble du site": "SPATIAL", "sur le site": "SPATIAL", "lors des": "ORGANISATIONNEL", "lors de": "ORGANISATIONNEL", "pour les": "POPULATIONNEL", "pour toute": "POPULATIONNEL",
    "avant chaque": "TEMPOREL", "avant sa": "TEMPOREL", "après validation": "TEMPOREL",
}
START_MARKERS, END_MARKERS = ("à compter du", "applicable au", "en vigueur depuis", "depuis le"), ("jusqu'au", "abrogé le")
NUMBER = r"(\d+(?:[.,]\d+)?|un|une|deux|trois|quatre|cinq|six|sept|huit|neuf|dix)"


def first_key(text: Column, table: dict) -> Column:
    """The value of the longest key that the text holds."""
    out = F.lit(None)
    for key, value in sorted(table.items(), key=lambda kv: (len(kv[0]), kv[0])):
        out = F.when(F.contains(text, F.lit(key)), F.lit(value)).otherwise(out)
    return out


# What a negated modality becomes; words between a negation and its verb.
INVERTED = {"OBLIGATION": "INTERDICTION", "INTERDICTION": "PERMISSION", "PERMISSION": "INTERDICTION"}
NEGATION = r"(?<!\p{L})n(?:e |'|’)(?:(?:l'|le |la |les |y |en )?)"


def modality(text: Column) -> Column:
    """DEFINITION first, else the longest marker's modality; null without one. A marker stands between word boundaries, with
    a participle's ending or none; right after a negation that is no part of it, it is inverted."""
    def longest(low: Column) -> Column:
        found = F.lit(None).cast("string")
        for marker, value in sorted(MARKERS.items(), key=lambda kv: (len(kv[0]), kv[0])):
            word = marker + r"(?:e|s|es)?(?!\p{L})"
            own = F.lit(value)
            if not marker.startswith(("ne ", "n'")) and value in INVERTED:
                own = F.when(low.rlike(NEGATION + word), INVERTED[value]).otherwise(value)
            found = F.when(low.contains(marker) & low.rlike(r"(?<!\p{L})" + word), own).otherwise(found)
        return F.when(low.rlike(DEFINITIONS), "DEFINITION").otherwise(found)

    return let(F.lower(text), longest)


def modality_surface(text: Column) -> Column:
    """The words of the longest marker as they stand in the text; null without one."""
    found = F.lit(None).cast("string")
    for marker in sorted(MARKERS, key=lambda m: (len(m), m)):
        pattern = r"(?iu)(?<!\p{L})(" + marker + r"(?:e|s|es)?)(?!\p{L})"
        found = F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(found)
    return found


def number(found: Column) -> Column:
    """Digits with a decimal point or comma, or a word up to ten."""

    def read(x: Column) -> Column:
        word = F.lit(None).cast("double")
        for name, value in NUMBERS.items():
            word = F.when(x == name, float(value)).otherwise(word)
        return F.when(x.rlike(r"^\d+(?:[.,]\d+)?$"), F.regexp_replace(x, ",", ".").cast("double")).otherwise(word)

    return let(found, read)


def operator(text: Column) -> Column:
    return F.coalesce(first_key(F.lower(text), OPERATORS), F.lit("="))


def duration_seconds(value: Column, unit: Column) -> Column:
    """Minutes to years as whole seconds, a double of any size; a month is a twelfth of 365 days, rounded half to even."""
    per = F.when(unit.startswith("minute"), 60).when(unit.startswith("heure"), 3600).when(unit.startswith("jour"), 86400).when(unit.startswith("semaine"), 604800).when(unit.startswith("an"), 31536000)
    return F.when(unit.startswith("mois"), F.bround(value * 31536000 / 12)).otherwise(F.bround(value * per))


def without_dates(text: Column) -> Column:
    """The text with its dates in words blanked, so that their numbers are no quantities."""
    return F.regexp_replace(text, r"(?iu)\d{1,2}(?:er)? (?:" + "|".join(MONTHS) + r") \d{4}", " ")


def quantity(text: Column) -> Column:
    """The first that applies, as struct(role, si, calendar_si, status): vague delay, retention, training, accreditation,
    headcount, periodicity, delay, decibels, metres. Null without one. A value beyond a long keeps its role, without si, as
    IMPRECIS; zero times a period is no periodicity."""
    return let(F.lower(without_dates(text)), _first_quantity)


def _first_quantity(low: Column) -> Column:
    got = lambda pattern, g: F.nullif(F.regexp_extract(low, pattern, g), F.lit(""))
    span = NUMBER + r" +(minutes?|heures?|jours?|semaines?|mois|ans?|années?)"
    every = r"(?:tous|toutes) les " + NUMBER + r" +(semaines?|mois|ans?|années?|trimestres?|semestres?|jours?)"
    single = r"(?:chaque|tous les|toutes les) +(semaine|mois|trimestre|semestre|an|année)"
    times = NUMBER + r" fois par (semaine|mois|trimestre|semestre|an|année)"
    noun = lambda u: first_key(u, PERIOD_NOUNS).cast("long")

    def make(role: str, si: Column, status: str = "NORMAL", cal: Column | None = None) -> Column:
        fitted = si.try_cast("long")
        return F.struct(F.lit(role).alias("role"), fitted.alias("si"), (F.lit(None) if cal is None else cal).try_cast("long").alias("calendar_si"), F.when(si.isNotNull() & fitted.isNull(), "IMPRECIS").otherwise(status).alias("status"))

    # Each step stands on values of the one before, bound once.
    words = F.struct(
        number(got(span, 1)).alias("value"), got(span, 2).alias("unit"), number(got(times, 1)).alias("times"), got(times, 2).alias("times_in"), number(got(every, 1)).alias("every"), got(every, 2).alias("every_unit"),
        got(single, 1).alias("single"), first_key(low, VAGUE).alias("vague"))

    def spans(w: Column) -> Column:
        days = F.when(low.rlike(span + " ouvr"), F.bround(F.bround(w["value"] * 7 / 5) * 86400))
        step = F.when(w["every_unit"].startswith("jour"), 86400).otherwise(noun(w["every_unit"]))
        period = F.coalesce(F.bround(F.try_divide(noun(w["times_in"]), w["times"])), F.bround(w["every"] * step), noun(w["single"]), first_key(low, PERIODS).cast("long"))
        return F.struct(w["vague"].alias("vague"), duration_seconds(w["value"], w["unit"]).alias("seconds"), days.alias("calendar"), period.alias("period"))

    def chosen(s: Column) -> Column:
        vague, seconds, period = s["vague"], s["seconds"], s["period"]
        return (
            F.when(vague.isNotNull() & seconds.isNull(), make("delai", vague, "IMPRECIS")).when(low.rlike("archiv|conserv") & seconds.isNotNull(), make("duree_conservation", seconds))
            .when(low.rlike("formation") & seconds.isNotNull(), make("duree_formation", seconds)).when(low.rlike("habilitation|recycl") & F.coalesce(period, seconds).isNotNull(), make("validite_habilitation", F.coalesce(period, seconds)))
            .when(low.rlike("sauveteur|secouriste|effectif") & got(NUMBER + r"\b", 1).isNotNull() & low.rlike("minim|fixé"), make("effectif_minimum", number(got(r"(?:minimum|fixé à) " + NUMBER, 1))))
            .when(low.rlike("bimensuel|bimestriel"), make("periodicite", F.lit(None), "AMBIGU")).when(period.isNotNull(), make("periodicite", period)).when(low.rlike("sous |dans un délai de |délai|retard") & seconds.isNotNull(), make("delai", seconds, "NORMAL", s["calendar"]))
            .when(low.rlike(r"\d db"), make("seuil_exposition", got(r"(\d+) ?db", 1))).when(low.rlike(r"\d mètres?"), make("seuil_declenchement", got(r"(\d+) mètres?", 1)))
        )

    return let(words, lambda w: let(spans(w), chosen))


def quantity_surface(text: Column) -> Column:
    """The words of the text that a quantity stands in, as they are; null without one."""
    units = r"(?:minutes?|heures?|jours?(?: ouvrés?)?|semaines?|mois|trimestres?|semestres?|ans?|années?|mètres?|dB(?:\(A\))?)"
    patterns = (NUMBER + " +" + units + r"(?!\p{L})", NUMBER + r" fois par \p{L}+", r"(?:chaque|tous les|toutes les) +(?:semaine|mois|trimestre|semestre|an|année)s?(?!\p{L})", r"(?:hebdomadaire|mensuel|trimestriel|semestriel|annuel|bimensuel|bimestriel)\p{L}*", "dans la semaine|sous quinzaine|sans délai|immédiatement", r"(?:minimum|fixé à) " + NUMBER)
    return F.coalesce(*[F.nullif(F.regexp_extract(text, f"(?iu)(?<!\\p{{L}})(?:{p})", 0), F.lit("")) for p in patterns])


def conditions(text: Column) -> Column:
    """Each marker at most once, longest first: array of struct(kind, surface), a surface running to the next , . or ;"""
    low = F.lower(text)
    found = [F.struct(F.lit(kind).alias("kind"), F.nullif(F.trim(F.regexp_extract(low, f"({m}[^,.;]*)", 1)), F.lit("")).alias("surface")) for m, kind in sorted(CONDITIONS.items(), key=lambda kv: (-len(kv[0]), kv[0]))]
    return F.filter(F.array(*found), lambda c: c["surface"].isNotNull())


def references(text: Column) -> Column:
    """Array of struct(kind, code): NORM (ISO, OHSAS), ARTICLE, DOCUMENT codes and SECTION numbers after a paragraph sign."""
    all_ = lambda kind, pattern, g: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(g)), lambda c: F.struct(F.lit(kind).alias("kind"), c.alias("code")))
    return F.concat(all_("NORM", r"((?:ISO|OHSAS) \d+(?::\d{4})?)", 1), all_("ARTICLE", r"article ([A-Z]?\.?[\d-]+)", 1), all_("DOCUMENT", r"([A-Z]{2,4}-[A-Z]{2,4}-\d{2,3})", 1), all_("SECTION", r"§ ?(\d+(?:\.\d+)?)", 1))


def long_date(text: Column, marker: str) -> Column:
    """The date in words after a marker; an impossible one is null."""
    pattern = marker + r" (\d{1,2})(?:er)? (" + "|".join(MONTHS) + r") (\d{4})"
    parts = F.struct(*[F.regexp_extract(text, pattern, g).alias(c) for g, c in ((1, "day"), (2, "month"), (3, "year"))])

    def date(p: Column) -> Column:
        month = F.array_position(F.array(*map(F.lit, MONTHS)), p["month"])
        iso = F.concat_ws("-", p["year"], F.lpad(month.cast("string"), 2, "0"), F.lpad(p["day"], 2, "0"))
        return F.when(p["month"] != "", F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"))

    return let(parts, date)


def validity(text: Column) -> Column:
    """struct(start, end), each from the first of its markers that a date follows."""
    low = F.lower(text)
    return F.struct(F.coalesce(*[long_date(low, m) for m in START_MARKERS]).alias("start"), F.coalesce(*[long_date(low, m) for m in END_MARKERS]).alias("end"))


def derogation(text: Column) -> Column:
    """struct(target, justification, approver, approved, due) of a derogating clause; null for others."""
    low = F.lower(text)
    after = lambda pattern: F.nullif(F.trim(F.regexp_extract(low, pattern + r" ([^,.]+?)(?: le \d| *[,.])", 1)), F.lit(""))
    mark = low.rlike("par dérogation (à|au)|nonobstant|en dérogation de")
    return F.when(mark, F.struct(F.nullif(F.regexp_extract(text, r"§ ?(\d+(?:\.\d+)?)", 1), F.lit("")).alias("target"), after("(?:motivée?|justifiée) par").alias("justification"), after("approuvée? par").alias("approver"), long_date(low, r"approuvée? par [^,.]+? le").alias("approved"), long_date(low, "valable jusqu'au").alias("due")))


def statement(text: Column) -> Column:
    """DEROGATION, DEFINITION, PRESCRIPTION, REFERENCE or CONSTAT, in this order."""
    derogates = derogation(text).isNotNull()
    rest = lambda m: F.when(m == "DEFINITION", "DEFINITION").when(m.isin("OBLIGATION", "INTERDICTION", "PERMISSION", "RECOMMANDATION"), "PRESCRIPTION").when((F.size(references(text)) > 0) & m.isNull(), "REFERENCE").otherwise("CONSTAT")
    return F.when(derogates, "DEROGATION").otherwise(let(modality(text), rest))

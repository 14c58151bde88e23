"""Text columns: length-preserving normalisation, labels, hashes, ids."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that stand for others, one for one, so that offsets stay.
SPACES, APOSTROPHES, QUOTES, DASHES = "    ", "‘’ʼ", "“”„", "‐‑‒–—−"
ACCENTED, PLAIN = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
# The months in French.
MONTHS = ("janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre")
# Determiners that a label loses at its head.
DETERMINERS = ("l'", "d'", "le", "la", "les", "un", "une", "des", "du", "de", "au", "aux", "ce", "cet", "cette", "ces", "son", "sa", "ses", "leur", "leurs", "tout", "toute", "tous", "toutes", "chaque", "notre", "nos", "présent", "présente")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once: a lambda's variable stands for it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalise(text: Column) -> Column:
    """One character for one: odd spaces, apostrophes, quotes and dashes, and the decimal comma between digits."""
    plain = F.translate(text, SPACES + APOSTROPHES + QUOTES + DASHES, " " * len(SPACES) + "'" * len(APOSTROPHES) + '"' * len(QUOTES) + "-" * len(DASHES))
    return F.regexp_replace(plain, r"(?<=\d),(?=\d)", ".")


def line_ends(text: Column) -> Column:
    """Without a byte-order mark, with \\n for every line end."""
    return F.regexp_replace(F.regexp_replace(text, "^﻿", ""), "\r\n?", "\n")


def label(text: Column) -> Column:
    """Lower case, no accents, punctuation as single spaces, leading determiners gone, however many."""
    heads = "|".join(sorted({d.rstrip("'").translate(str.maketrans(ACCENTED, PLAIN)) for d in DETERMINERS}, key=lambda d: (-len(d), d)))
    plain = F.regexp_replace(F.translate(F.lower(text), ACCENTED + APOSTROPHES, PLAIN + "'" * len(APOSTROPHES)), "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.trim(plain), f"^(?:(?:{heads}) )+", ""))


@F.pandas_udf(StringType())
def composed(values: pd.Series) -> pd.Series:
    """Unicode normal form C: no built-in function has it."""
    return values.map(lambda v: v if v is None else unicodedata.normalize("NFC", v))


def lemma(words: Column) -> Column:
    """A label with each word of four letters or more as its singular: s and x go, -aux becomes -al, -ss stays."""
    one = lambda w: F.when(F.length(w) < 4, w).when(w.rlike("eaux$"), F.regexp_replace(w, "x$", "")).when(w.rlike("aux$"), F.regexp_replace(w, "aux$", "al")).when(w.rlike("[^s]s$|[^o]x$"), F.regexp_replace(w, ".$", "")).otherwise(w)
    return F.array_join(F.transform(F.split(words, " "), one), " ")


def canonical_form(text: Column) -> Column:
    return lemma(label(text))


def fingerprint(text: Column) -> Column:
    """The first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def condition_id(kind: Column, surface: Column) -> Column:
    return F.concat(F.lit("C"), fingerprint(F.concat(kind, F.lit("\u0000"), surface)))


def unordered(a: Column, b: Column) -> tuple[Column, Column]:
    """A pair's identity: smaller, then larger."""
    return F.least(a, b), F.greatest(a, b)

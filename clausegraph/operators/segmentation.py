"""Segmentation of texts into lines, blocks, sections and clauses, with code-point offsets into the source text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clausegraph.functions.text import fingerprint
from clausegraph.operators.sentences import qualifies

# The numbering and bullets of a procedure.
CLAUSE = r"^(\d{1,2})\.(\d{1,2})[ \t]+\S"
TITLE = r"^(\d{1,2})\.[ \t]+\S"
BULLET = r"^[ \t]*([a-z]\)|\d{1,2}\)|[-•*–])[ \t]+"
TITLE_LENGTH = 80
CODE_LEVELS = {"POL": ("POLITIQUE", 1), "MAN": ("MANUEL", 2), "PR": ("PROCEDURE", 3), "IT": ("INSTRUCTION", 4), "FOR": ("FORMULAIRE", 5)}


def lines(docs: DataFrame) -> DataFrame:
    """(id, pos, line, start): every line of ``docs(id, text)``, 0-based, with its offset in the text."""
    cut = docs.select("id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    before = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long"))


def is_title(line: Column) -> Column:
    return line.rlike(TITLE) & ~line.rlike(CLAUSE) & (F.length(line) <= TITLE_LENGTH) & ~line.endswith(".")


def structured(rows: DataFrame) -> DataFrame:
    """Adds to :func:`lines`: block (blank lines so far), section (number of the last title), ref (of a numbered clause),
    body (offset of the first title, 0 without one)."""
    here = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    blank = (F.trim("line") == "").cast("long")
    title = F.when(is_title(F.col("line")), F.regexp_extract("line", TITLE, 1).cast("int"))
    ref = F.when(F.col("line").rlike(CLAUSE), F.concat_ws(".", F.regexp_extract("line", CLAUSE, 1), F.regexp_extract("line", CLAUSE, 2)))
    body = F.coalesce(F.min(F.when(is_title(F.col("line")), F.col("start"))).over(Window.partitionBy("id")), F.lit(0))
    return rows.withColumn("block", F.sum(blank).over(here)).withColumn("section", F.last(title, True).over(here)).withColumn("ref", ref).withColumn("body", body)


def clauses(rows: DataFrame) -> DataFrame:
    """Clauses of :func:`structured` rows: clause_id ``doc::Ssec::Cnn``, ord (in the document), ref, kind (TEXT, LIST, TABLE),
    text, start, context, hash.

    A numbered line opens a unit and what follows in its block belongs to it; a block under a unit that ends with ``:``
    does too; any other block is a unit without a number, whose ref is the last one and ``+``, or section and ``.0``. A unit
    without a number that is no statement (:func:`~clausegraph.operators.sentences.qualifies`) is no clause but context of
    the clause before it. A head with bullets alone gives a clause per bullet, head and item joined; a head with two lines or
    more of two separators gives a clause per row under the header."""
    order = Window.partitionBy("id").orderBy("pos")
    here = order.rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.where((F.trim("line") != "") & ~is_title(F.col("line")) & (F.col("start") >= F.col("body")))
    new_block = F.coalesce(F.col("block") != F.lag("block").over(order), F.lit(True))
    after_colon = F.coalesce(F.rtrim(F.lag("line").over(order)).endswith(":"), F.lit(False))
    opens = F.col("ref").isNotNull() | (new_block & ~after_colon)
    opened = filled.withColumn("unit", F.sum(opens.cast("long")).over(here))
    unit = opened.groupBy("id", "unit").agg(F.first("section", True).alias("section"), F.first("ref", True).alias("ref"), F.sort_array(F.collect_list(F.struct("pos", "line", "start"))).alias("all"))
    last_ref = F.last("ref", True).over(Window.partitionBy("id", "section").orderBy("unit").rowsBetween(Window.unboundedPreceding, 0))
    unit = unit.withColumn("numbered", F.col("ref").isNotNull()).withColumn("ref", F.coalesce("ref", F.concat(last_ref, F.lit("+")), F.concat(F.coalesce(F.col("section").cast("string"), F.lit("0")), F.lit(".0"))))
    head, rest = F.element_at("all", 1), F.slice("all", 2, F.size("all"))
    head_text = F.regexp_replace(head["line"], r"^\d{1,2}\.\d{1,2}[ \t]+", "")
    colon = F.rtrim(head_text).endswith(":") & (F.size(rest) > 0)
    bullets = colon & F.forall(rest, lambda x: x["line"].rlike(BULLET))
    bars = F.filter(rest, lambda x: F.size(F.split(x["line"], r"\|")) >= 3)
    table = colon & (F.size(bars) >= 2)
    names = F.transform(F.split(F.element_at(bars, 1)["line"], r"\|"), lambda c: F.trim(c))

    def item(x: Column) -> Column:
        text = F.regexp_replace(F.regexp_replace(x["line"], BULLET, ""), r"[ \t]*[;.,]?[ \t]*$", "")
        return F.struct(F.lit("LIST").alias("kind"), F.concat(F.regexp_replace(head_text, r"[ \t]*:[ \t]*$", " "), text, F.lit(".")).alias("text"), x["start"].alias("start"))

    def row(x: Column) -> Column:
        cells = F.transform(F.split(x["line"], r"\|"), lambda c: F.trim(c))
        pairs = F.slice(F.zip_with(names, cells, lambda n, c: F.concat(n, F.lit(" : "), c)), 2, F.size(cells))
        return F.struct(F.lit("TABLE").alias("kind"), F.concat(F.element_at(cells, 1), F.lit(" - "), F.array_join(pairs, " ; "), F.lit(".")).alias("text"), x["start"].alias("start"))

    # A sentence's text is the source itself: head and following lines as they stand.
    plain = F.array(F.struct(F.lit("TEXT").alias("kind"), F.rtrim(F.concat_ws("\n", head_text, F.array_join(F.transform(rest, lambda x: x["line"]), "\n"))).alias("text"), (head["start"] + F.length(head["line"]) - F.length(head_text)).cast("long").alias("start")))
    plain = F.transform(plain, lambda x: F.struct(x["kind"].alias("kind"), F.regexp_replace(x["text"], "\n$", "").alias("text"), x["start"].alias("start")))
    parts = F.when(bullets, F.transform(rest, item)).when(table, F.transform(F.slice(bars, 2, F.size(bars)), row)).otherwise(plain)
    out = unit.select("id", "section", "ref", "numbered", F.posexplode(parts).alias("part", "c")).select("id", "section", "ref", "numbered", "part", "c.kind", "c.text", "c.start")
    # Units that state nothing are gathered under the clause before them.
    out = out.withColumn("states", F.col("numbered") | (F.col("kind") != "TEXT") | qualifies(F.col("text")))
    out = out.withColumn("place", F.sum(F.col("states").cast("long")).over(Window.partitionBy("id").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, 0)))
    beside = out.where(~F.col("states")).groupBy("id", "place").agg(F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda x: x["text"]).alias("context"))
    out = out.where("states").join(beside, ["id", "place"], "left").withColumn("context", F.coalesce("context", F.array().cast("array<string>")))
    number = F.row_number().over(Window.partitionBy("id", "section").orderBy("start", "part"))
    name = F.concat(F.col("id").cast("string"), F.lit("::S"), F.coalesce(F.col("section").cast("string"), F.lit("0")), F.lit("::C"), F.when(number < 10, F.lpad(number.cast("string"), 2, "0")).otherwise(number.cast("string")))
    return out.select("id", name.alias("clause_id"), F.col("place").alias("ord"), "section", "ref", "kind", "text", "start", "context", fingerprint(F.col("text")).alias("hash"))


def offset_gaps(found: DataFrame, docs: DataFrame) -> DataFrame:
    """TEXT clauses whose slice of the source is not their text: none, if segmentation is right."""
    both = found.where("kind = 'TEXT'").join(docs.select("id", F.col("text").alias("source")), "id")
    return both.where(F.expr("substring(source, start + 1, length(text)) <> text")).select("id", "clause_id")


def front_matter(rows: DataFrame) -> DataFrame:
    """(id, code, title, version, applies, type, level, notes) from the lines before the first title; notes are the lines after
    the first ``key : value`` line that are none themselves."""
    head = rows.where(F.col("start") < F.col("body"))
    key = F.lower(F.trim(F.regexp_extract("line", r"^([^:]+):", 1)))
    value = F.trim(F.regexp_extract("line", r"^[^:]+:(.*)$", 1))
    code = F.min(F.when(F.col("line").rlike(r"^[A-Z]{2,4}-[A-Z]{2,4}-\d{2,3}\s*$"), F.trim("line")))
    first_key = F.min(F.when(key.isin("version", "date d'application"), F.col("pos"))).over(Window.partitionBy("id"))
    titled = head.withColumn("first_key", first_key).withColumn("is_title", (F.col("pos") < F.coalesce("first_key", F.lit(1 << 30))) & (F.trim("line") != "") & ~F.col("line").rlike(r"^[A-Z]{2,4}-[A-Z]{2,4}-\d{2,3}\s*$"))
    title = F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.when(F.col("is_title"), F.struct("pos", F.trim("line").alias("line"))))), lambda x: x["line"]))
    after = (F.col("pos") > F.col("first_key")) & (F.trim("line") != "") & ~F.col("line").rlike(r"^[^:]+ ?:")
    notes = F.transform(F.sort_array(F.collect_list(F.when(after, F.struct("pos", F.trim("line").alias("line"))))), lambda x: x["line"])
    date = F.max(F.when(key == "date d'application", F.coalesce(F.try_to_timestamp(value, F.lit("dd/MM/yyyy")), F.try_to_timestamp(value, F.lit("yyyy-MM-dd"))).cast("date")))
    got = titled.groupBy("id").agg(code.alias("code"), title.alias("title"), F.max(F.when(key == "version", value)).alias("version"), date.alias("applies"), notes.alias("notes"))
    kind, level = F.lit("INCONNU"), F.lit(None).cast("int")
    for prefix, (k, n) in sorted(CODE_LEVELS.items(), key=lambda x: len(x[0])):
        kind, level = F.when(F.startswith("code", F.lit(prefix)), k).otherwise(kind), F.when(F.startswith("code", F.lit(prefix)), n).otherwise(level)
    return got.withColumn("type", kind).withColumn("level", level)

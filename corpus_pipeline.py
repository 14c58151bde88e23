"""The corpus pipeline: documents through five operators; each stage is written as Parquet and read by the next.

quality classifier (documents scored below the threshold go), language ID (documents of no learned language go),
near-duplicates (one document of each group stays), mixing (documents repeat or go to meet the source targets), packing.
All but the last return the columns of documents, whatever further columns those have and however they are named.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.llm import catalog, langid, mixing, neardup, packing, quality
from clausegraph.llm.common import free_name, materialise, numbered

#: Least quality score; least posterior of a document's language; least fit: log-probability a character, against that of the
#: texts the language was learned from. Set on texts of sf0.1 (all above -1.9) and a few probes. It does not part foreign texts
#: from clean ones cleanly: Italian, Dutch and Latin probes lay at -2.4 to -3.0, a plain French sentence outside the corpus's
#: wording at -2.5, a short English one with a long random key at -4.3. The README gives what it costs.
QUALITY, LANGUAGE, FIT = 0.3, 0.5, -2.0


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is ``QUALITY`` or more; labels come from the ``labels`` table beside the documents."""
    model = quality.learn(docs, catalog.table(spark, sf_dir, "labels"))
    name = free_name(docs, "quality_score")
    return quality.score(docs, model, name).where(F.col(name) >= QUALITY).drop(name)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language: its posterior is ``LANGUAGE`` or more, and the text fits it by ``FIT`` or more, which
    most texts in other languages and noise do not, though one learned language is always the least unlikely. A mixture of
    learned languages may stay; a short clean text that is mostly names, keys or unusual words may go."""
    model = langid.learn(docs, catalog.vocabulary("piece_bpe_32k.model"))
    names = tuple(free_name(docs, n) for n in ("lang_pred", "lang_score", "lang_fit"))
    named = langid.identify(docs, model, names)
    sure = (F.col(names[0]) != langid.UNDETERMINED) & (F.col(names[1]) >= LANGUAGE) & (F.col(names[2]) >= FIT)
    return named.where(sure).drop(*names)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8."""
    stored, number = numbered(docs, "pipeline-documents")
    found = neardup.near_duplicates(stored, shingle=5, percent=80, row_id=number)
    gone = materialise(found.where(~F.col("kept")).select(F.col("row_id").alias(number)), "pipeline-gone")
    if gone.count() <= neardup.BROADCAST_IDS:
        gone = F.broadcast(gone)
    return stored.join(gone, number, "left_anti").drop(number)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per document and epoch that the mix takes. Of a document that a source's target cuts (one a source and epoch
    at most) the first words stay, joined by single spaces; n_chars follows the text."""
    stored, number = numbered(docs, "pipeline-documents")
    took = free_name(docs, "took")
    take = F.struct("words", F.col("size").alias("of")).alias(took)
    rows = stored.join(mixing.mix(stored, row_id=number).rows.select(F.col("row_id").alias(number), take), number)
    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    part = F.col(took)["words"] < F.col(took)["of"]
    text = F.when(part, F.array_join(F.slice(words, 1, F.col(took)["words"].cast("int")), " ")).otherwise(F.col("text"))
    out = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens, a row per piece."""
    return packing.pack_documents(docs, catalog.vocabulary("word_bpe_49k.json"), with_ids=False)


STAGES = [("quality", keep_quality), ("language", keep_language), ("neardup", keep_distinct), ("mixing", mix_sources), ("packing", pack)]

#: Trained models and a tokenizer decide; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = catalog.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

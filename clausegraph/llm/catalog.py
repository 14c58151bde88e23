"""The operators as queries over the test tables: name -> function(spark, sf_dir), and DuckDB SQL where it can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from clausegraph.llm import chat, licenses, mixing, neardup, topk

#: What both sides of the conversation beside the table's say.
TRIAL = "</s>[INST] ok [/INST]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausegraph.llm import common, sstable

    path = common.scratch(spark, "sstable")
    sstable.write_shards(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"))
    return sstable.digest(spark, path)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from clausegraph.llm import common

    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    trial = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRIAL).alias("text"))
    return chat.digest(common.materialise(chat.format_conversations(turns.unionByName(trial)), "chat"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(mixing.mix(table(spark, sf_dir, "documents")))


def op5_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.digest(neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausegraph.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausegraph.llm import langid

    docs = table(spark, sf_dir, "documents")
    return langid.digest(docs, langid.learn(docs, vocabulary("piece_bpe_32k.model")))


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausegraph.llm import ann

    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clausegraph.llm import packing

    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), with_ids=False)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sstable": op1_sstable,
    "op2_chat": op2_chat,
    "op3_licenses": op3_licenses,
    "op4_mixing": op4_mixing,
    "op5_neardup": op5_neardup,
    "op6_quality": op6_quality,
    "op7_langid": op7_langid,
    "op8_topk": op8_topk,
    "op9_neighbours": op9_neighbours,
    "op10_packing": op10_packing,
}

ORACLES: dict[str, str] = {
    "op2_chat": chat.oracle(TRIAL),
    "op3_licenses": licenses.oracle(),
    "op4_mixing": mixing.oracle(),
    "op5_neardup": neardup.oracle(shingle=4, percent=80),
    "op8_topk": topk.oracle(),
}

"""Files in and out. Reads and writes go through Spark's sources, so any Hadoop file system serves."""

from __future__ import annotations

import html
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausegraph.functions.text import composed, line_ends


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(id, text): whole text files, id being the file's name; line ends, byte-order marks and Unicode form normalised."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), "([^/]+)$", 1).alias("id"), F.col("value").alias("text"))
    return raw.withColumn("text", composed(line_ends(F.col("text"))))


def substituted(docs: DataFrame, doc_id: str, old: str, new: str) -> DataFrame:
    """A derived corpus: ``old`` as ``new`` in one document; raises at run time unless it stands there exactly once."""
    count = ((F.length("text") - F.length(F.replace("text", F.lit(old), F.lit("")))) / len(old)).cast("int")
    checked = F.when(count == 1, F.replace("text", F.lit(old), F.lit(new))).otherwise(F.raise_error(F.concat(F.lit("substitution needs one occurrence, found "), count.cast("string"))).cast("string"))
    return docs.withColumn("text", F.when(F.col("id") == doc_id, checked).otherwise(F.col("text")))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A multi-line JSON file; a missing one is an empty frame."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).json(path, multiLine=True)


def write_report(findings: DataFrame, path: str) -> None:
    """Findings as JSON lines."""
    findings.write.mode("overwrite").json(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with ``new``'s rows in place of those of the same keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def graph_counts(frames: dict[str, DataFrame]) -> DataFrame:
    """(label, n) of entity and edge frames."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(label).alias("label"), "n") for label, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def html_report(findings: DataFrame, title: str, order: list) -> Iterator[str]:
    """One self-contained page of all findings by ``order``, piece by piece: a partition at a time is on the driver."""
    head = "".join(f"<th>{html.escape(c)}</th>" for c in findings.columns)
    yield f"<!doctype html><html lang='fr'><meta charset='utf-8'><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table><tr>{head}</tr>"
    for row in findings.orderBy(*order).toLocalIterator():
        yield "<tr>" + "".join(f"<td>{html.escape(str(v if v is not None else ''))}</td>" for v in row) + "</tr>"
    yield "</table></html>"

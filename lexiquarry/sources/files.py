"""Reading files into documents and tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.text import count_of
from ..operators.tables import chunk_rows
from ..params import DELIMITERS
from .records import read_records


def clean_utf8(raw) -> F.Column:
    """Bytes as text, without the bytes that are not UTF-8."""
    text = F.make_valid_utf8(raw.cast("string"))
    return F.when(F.is_valid_utf8(raw.cast("string")), text).otherwise(F.replace(text, F.lit("�"), F.lit("")))


def _base_name(path) -> F.Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def read_text(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """One document per file: (source, path, content)."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select(
        _base_name(F.col("path")).alias("source"), "path", clean_utf8(F.col("content")).alias("content")
    )


def detect_delimiter(spark: SparkSession, path: str) -> str:
    """The delimiter most frequent in the header line; a comma if there is none."""
    lines = spark.read.text(path).limit(1)
    counts = lines.select(*[count_of(F.col("value"), d).alias(f"d{i}") for i, d in enumerate(DELIMITERS)]).head()
    if counts is None or max(counts) == 0:
        return ","
    return DELIMITERS[max(range(len(DELIMITERS)), key=lambda i: (counts[i], -i))]


def read_delimited(
    spark: SparkSession, path: str, sep: str | None = None, schema: T.StructType | str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """A table with a header line. A given ``schema`` saves the pass that infers one.

    Spark splits large files. With line breaks inside cells, ``multi_line=True`` is needed; such files are cut at the
    true ends of records first, so they are split as well.
    """
    sep = sep or detect_delimiter(spark, path)
    if multi_line:
        return read_records(spark, path, sep, schema)
    reader = spark.read.option("header", "true").option("sep", sep).option("quote", '"').option("escape", '"')
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", "true")
    return reader.csv(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",") -> None:
    df.write.mode("error").option("header", "true").option("sep", sep).option("escape", '"').csv(path)


def read_docs(
    spark: SparkSession, path: str, kind: str = "text", order_by: str | None = None, **options
) -> DataFrame:
    """Documents (source, content) of a path: whole texts, or row blocks of a delimited table."""
    if kind == "text":
        return read_text(spark, path, options.get("glob")).select("source", "content")
    if kind == "table":
        table = read_delimited(spark, path, options.get("sep"), options.get("schema"), options.get("multi_line", False))
        blocks = chunk_rows(table, order_by or table.columns[0], options.get("n", 5))
        return blocks.select(F.lit(path).alias("source"), "content", "chunk_index", "total_chunks", "row_start", "row_end")
    raise ValueError("kind must be text or table")

"""Readers and writers: landed files in place of live connectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE


def url_list(lines: DataFrame, c: str = "value") -> DataFrame:
    """(url) from lines of text: blank lines and lines that begin with '#' dropped, the rest stripped. A '#' after blanks stays."""
    stripped = F.regexp_replace(F.col(c), f"^{SPACE}+|{SPACE}+$", "")
    return lines.where((stripped != "") & ~F.col(c).startswith("#")).select(stripped.alias("url"))


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """The URLs of a text file; a missing file is an empty list."""
    try:
        lines = spark.read.text(path)
        lines.schema  # noqa: B018
    except Exception as e:  # the path does not exist
        if "PATH_NOT_FOUND" not in str(e):
            raise
        lines = spark.createDataFrame([], "value string")
    return url_list(lines)


def read_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A nested JSON document, one value over many lines."""
    return (spark.read.schema(schema) if schema else spark.read).json(path, multiLine=True)


DEPENDENCIES = "struct<dependencies:array<struct<source_company:string,target_company:string,dependency_type:string,product:string,confidence_score:double,source_ticker:string,target_ticker:string>>>"


def parse_extraction(replies: DataFrame, key: str, reply: str, default_type: str = "Unknown", default_confidence: float = 0.5) -> DataFrame:
    """(key, pos, source_company, ...) for each dependency in a model's JSON reply; bad JSON, null or no list gives none.

    Rows with a null or empty company are dropped; a missing or null type and confidence take the defaults.
    """
    lists = replies.select(key, F.coalesce(F.from_json(reply, DEPENDENCIES)["dependencies"], F.array().cast("array<struct<source_company:string,target_company:string,dependency_type:string,product:string,confidence_score:double,source_ticker:string,target_ticker:string>>")).alias("l"))
    rows = lists.select(key, F.posexplode("l").alias("pos", "d")).select(key, "pos", "d.*")
    return rows.where("source_company <> '' and target_company <> ''").withColumns({"dependency_type": F.coalesce("dependency_type", F.lit(default_type)), "confidence_score": F.coalesce("confidence_score", F.lit(default_confidence))})


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines with null fields kept; non-finite numbers must be nulls already (clean_number)."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_snapshot(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """The next snapshot of a table, at a path of its own: files in use are never overwritten."""
    (df.write.partitionBy(*partitions) if partitions else df.write).mode("errorifexists").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)

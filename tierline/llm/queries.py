"""Queries of this subpackage, with the SQL that checks them where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .companies import company_groups, mention_links
from .consensus import survivors
from .encoding import garbled
from .leakage import leaks
from .merkle import collapse, copies
from .packing import pack, token_counts
from .vocabulary import map_values


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RELATION = ["source_id", "target_id", "dependency_type"]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return copies(read(spark, d, "edges"), "id", RELATION)


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return collapse(read(spark, d, "edges"), "id", RELATION)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return garbled(read(spark, d, "documents")).select("doc_id")


def p10_repaired(spark: SparkSession, d: str) -> DataFrame:
    return garbled(read(spark, d, "documents"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = read(spark, d, "nodes")
    links = mention_links(read(spark, d, "dependencies"), nodes, read(spark, d, "alias_hits"))
    exact = nodes.select(F.col("name").alias("text")).distinct()
    return links.join(exact, "text", "left_anti").select(F.col("row_id").alias("dep_id"), "field_name", F.col("group_id").alias("node_id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors(read(spark, d, "nodes")).select("group_id", "name_id", "ticker_id", "cap_id")


def p6_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Survivors by vote: the value closest to the tokens that most rows of a company have, whatever its age."""
    return survivors(read(spark, d, "nodes"), trust_latest=False)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    terms = read(spark, d, "canon_terms")
    exact = terms.select("field_name", F.col("term").alias("text"))
    mapped = map_values(read(spark, d, "dependencies"), terms)
    return mapped.join(exact, ["field_name", "text"], "left_anti").select(F.col("row_id").alias("dep_id"), "field_name", "term_id")


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack(token_counts(read(spark, d, "documents"), tokenizer=TOKENIZER))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(read(spark, d, "documents"), read(spark, d, "eval_items")).select("doc_id", "item_id")


QUERIES = {f.__name__: f for f in (p8_pack, p9_found, p2_found, p6_found, p6_consensus, p7_found, p3_found, p3_collapsed, p10_found, p10_repaired)}

_KEPT = """
WITH w AS (SELECT id, source_id, target_id, list_sort(list_filter(string_split_regex(lower(upper(dependency_type)), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS words FROM edges),
g AS (SELECT id, min(id) OVER (PARTITION BY source_id, target_id, words) AS kept_id, count(*) OVER (PARTITION BY source_id, target_id, words) AS n FROM w)
"""
SQL = {
    "p3_found": _KEPT + "SELECT kept_id, id AS copy_id FROM g WHERE id <> kept_id",
    "p3_collapsed": _KEPT + "SELECT kept_id, n AS n_copies FROM g WHERE id = kept_id",
}

"""Queries of the core's operators for training data, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators.history import versions
from .operators.impute import STAND_INS, fill_nodes, impute_nodes
from .operators.references import orphan_report, orphans


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans(read(spark, d, "edges"), read(spark, d, "node_log")).select(F.col("row_id").alias("edge_id"), "field_name")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(read(spark, d, "edges"), read(spark, d, "node_log"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    return versions(read(spark, d, "node_snapshots"), "id", "last_updated", "loaded_at", ["current_price", "market_cap", "recommendation"], texts=("recommendation",))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
    return _versions(spark, d).select(F.col("id").alias("node_id"), text("valid_from").alias("valid_from"), text("valid_to").alias("valid_to"))


def p5_history(spark: SparkSession, d: str) -> DataFrame:
    return _versions(spark, d).select("id", "version", "valid_from", "valid_to", "last_seen", "n_states")


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p5_found, p5_history)}

_REFS = """
WITH refs AS (
  SELECT id AS edge_id, 'source_id' AS field_name, source_id AS key, last_verified AS seen FROM edges
  UNION ALL SELECT id, 'target_id', target_id, last_verified FROM edges),
state AS (
  SELECT r.edge_id, r.field_name, r.key, r.seen, max_by(l.op, (l.effective_at, l.log_id)) AS op
  FROM (SELECT * FROM refs WHERE key IS NOT NULL) r
  LEFT JOIN node_log l ON l.node_id = r.key AND l.effective_at <= coalesce(r.seen, TIMESTAMP '9999-12-31 23:59:59')
  GROUP BY ALL)
"""
_VERSIONS = """
WITH s AS (
  SELECT id, last_updated AS t, arg_max(struct_pack(p := current_price, c := market_cap, r := recommendation), loaded_at) AS v
  FROM (SELECT *, row_number() OVER (PARTITION BY id, last_updated ORDER BY loaded_at DESC, current_price DESC, market_cap DESC, recommendation DESC) AS k FROM node_snapshots WHERE last_updated IS NOT NULL AND id IS NOT NULL)
  WHERE k = 1 GROUP BY id, last_updated),
n AS (SELECT id, t, v.p AS p, v.c AS c, trim(replace(lower(v.r), '_', ' ')) AS r FROM s),
m AS (
  SELECT id, t, CASE WHEN lag(t) OVER w IS NOT NULL AND p IS NOT DISTINCT FROM lag(p) OVER w AND c IS NOT DISTINCT FROM lag(c) OVER w
    AND r IS NOT DISTINCT FROM lag(r) OVER w THEN 0 ELSE 1 END AS ch
  FROM n WINDOW w AS (PARTITION BY id ORDER BY t)),
i AS (SELECT id, t, sum(ch) OVER (PARTITION BY id ORDER BY t) AS version FROM m),
g AS (SELECT id, CAST(version AS BIGINT) AS version, min(t) AS valid_from, max(t) AS last_seen, count(*) AS n_states FROM i GROUP BY id, version),
v AS (SELECT *, lead(valid_from) OVER (PARTITION BY id ORDER BY version) AS valid_to FROM g)
"""

SQL = {
    "p1_found": _REFS + "SELECT edge_id, field_name FROM state WHERE op IS DISTINCT FROM 'insert'",
    "p1_report": _REFS
    + """SELECT 'edges' AS table_name, field_name, coalesce(strftime(seen, '%Y-%m'), '') AS month, count(*) AS n_refs,
      count(*) FILTER (WHERE op IS DISTINCT FROM 'insert') AS n_orphans, count(DISTINCT key) FILTER (WHERE op IS DISTINCT FROM 'insert') AS n_keys
      FROM state GROUP BY 1, 2, 3""",
    "p5_found": _VERSIONS + "SELECT id AS node_id, strftime(valid_from, '%Y-%m-%d %H:%M:%S') AS valid_from, coalesce(strftime(valid_to, '%Y-%m-%d %H:%M:%S'), '') AS valid_to FROM v",
    "p5_history": _VERSIONS + "SELECT id, version, valid_from, valid_to, last_seen, n_states FROM v",
}


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return impute_nodes(read(spark, d, "nodes")).select(F.col("row_id").alias("node_id"), "field_name")


def p4_filled(spark: SparkSession, d: str) -> DataFrame:
    return fill_nodes(read(spark, d, "nodes")).select("id", *[x for f in ("trailing_pe", "gross_margin", "sector", "industry") for x in (f, f"{f}_filled", f"{f}_donor", f"{f}_level")])


QUERIES |= {f.__name__: f for f in (p4_found, p4_filled)}
_STAND_INS = ", ".join(f"'{x}'" for x in STAND_INS)
_KNOWN = lambda c: f"(({c}) IS NULL OR lower(regexp_replace({c}, '^\\s+|\\s+$', '', 'g')) IN ({_STAND_INS}))"
SQL["p4_found"] = f"""
SELECT id AS node_id, 'trailing_pe' AS field_name FROM nodes WHERE trailing_pe IS NULL OR isnan(trailing_pe) OR NOT (trailing_pe > 0 AND trailing_pe < 1000)
UNION ALL SELECT id, 'gross_margin' FROM nodes WHERE gross_margin IS NULL OR isnan(gross_margin) OR NOT gross_margin BETWEEN -1 AND 1
UNION ALL SELECT id, 'sector' FROM nodes WHERE {_KNOWN("sector")}
UNION ALL SELECT id, 'industry' FROM nodes WHERE {_KNOWN("industry")}
"""

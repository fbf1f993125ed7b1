"""Schemas of the stored tables, and tables made from them where they are missing."""

from __future__ import annotations

from pyspark.sql import SparkSession

NODES = (
    "id BIGINT NOT NULL, name STRING NOT NULL, ticker STRING, entity_type STRING NOT NULL, sector STRING, industry STRING, current_price DOUBLE, percent_change DOUBLE, "
    "market_cap DOUBLE, enterprise_value DOUBLE, trailing_pe DOUBLE, forward_pe DOUBLE, price_to_book DOUBLE, dividend_yield STRING, fifty_two_week_high DOUBLE, fifty_two_week_low DOUBLE, "
    "total_revenue DOUBLE, gross_margin DOUBLE, target_price DOUBLE, recommendation STRING, ceo_name STRING, employees BIGINT, business_summary STRING, hierarchy_level INT, metadata_json STRING, last_updated TIMESTAMP_NTZ"
)
EDGES = "id BIGINT NOT NULL, source_id BIGINT NOT NULL, target_id BIGINT NOT NULL, dependency_type STRING NOT NULL, confidence_score DOUBLE, source_url STRING, last_verified TIMESTAMP_NTZ"
TABLES = {"nodes": NODES, "edges": EDGES}


def create_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Creates the stored tables that are missing, as Parquet; existing ones are left as they are. Returns their names."""
    for name, columns in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")
    return [f"{database}.{name}" for name in TABLES]

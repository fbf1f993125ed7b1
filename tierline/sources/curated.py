"""The curated edges with which a graph is begun."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Fixed values: (supplier, customer, type) by ticker.
EDGES = (
    ("ASML", "TSM", "EUV Lithography Equipment"),
    ("TSM", "AMD", "Advanced Silicon Fabrication"),
    ("TSM", "NVDA", "Advanced Silicon Fabrication"),
    ("TSM", "AAPL", "Advanced Silicon Fabrication"),
    ("MU", "NVDA", "HBM3e Memory"),
    ("MU", "AMD", "HBM3e Memory"),
    ("VRT", "NVDA", "Data Center Liquid Cooling"),
    ("NVDA", "SMCI", "AI Accelerator Chips"),
    ("AMD", "SMCI", "MI-Series / EPYC Processors"),
    ("INTC", "DELL", "Server CPUs"),
)


def curated_edges(spark: SparkSession, rows: tuple[tuple[str, str, str], ...] = EDGES) -> DataFrame:
    """(source, target, type), for graph.insert_by_ticker."""
    return spark.createDataFrame(list(rows), "source string, target string, type string")

"""Nodes and directed supplier-to-customer edges: isolation, adjacency, neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .skew import heavy_keys, salted_join


def endpoints(edges: DataFrame) -> DataFrame:
    """(edge_id, node_id) for both ends of each edge; a self-loop counts once."""
    return edges.select(F.col("id").alias("edge_id"), F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("node_id"))


def lonely_nodes(nodes: DataFrame, edges: DataFrame, floor: float, k: int | None = None, sectors: list[str] | None = None, without: list[str] | None = None) -> DataFrame:
    """Nodes that are at neither end of an edge, market_cap above ``floor``, largest first (ties by id); ``k`` keeps the top.

    The join on either end is an anti-join on exploded ends, so it stays an equi-join. An empty or missing
    ``sectors`` allows all but the sectors in ``without``; as in SQL's NOT IN, a null sector is then out, too.
    """
    keep = (F.col("market_cap") > floor) & ~F.isnan("market_cap")
    if sectors:
        keep = keep & F.col("sector").isin(sectors)
    elif without:
        keep = keep & ~F.col("sector").isin(without)
    ends = endpoints(edges).select(F.col("node_id").alias("id")).distinct()
    out = nodes.where(keep).join(ends, "id", "left_anti").orderBy(F.desc("market_cap"), "id")
    return out if k is None else out.limit(k)


def deep_dive(nodes: DataFrame, edges: DataFrame, floor: float, k: int, distinct: bool = False) -> DataFrame:
    """(id, market_cap) of the largest nodes.

    Faithful form: the limit ``k`` falls on rows fanned out by the edges of either end, so a hub uses up
    several places. With ``distinct`` it falls on nodes.
    """
    rich = nodes.where((F.col("market_cap") > floor) & ~F.isnan("market_cap")).select("id", "market_cap")
    if distinct:
        return rich.orderBy(F.desc("market_cap"), "id").limit(k)
    fanned = rich.join(endpoints(edges), rich["id"] == F.col("node_id"), "left").select("id", "market_cap")
    return fanned.orderBy(F.desc("market_cap"), "id").limit(k).distinct()


def links(nodes: DataFrame, edges: DataFrame, direction: str) -> DataFrame:
    """(node_id, edge_id, name, ticker, type): suppliers ('upstream') or customers ('downstream') of each node; null tickers are ''."""
    here, there = ("target_id", "source_id") if direction == "upstream" else ("source_id", "target_id")
    other = nodes.select(F.col("id").alias(there), "name", F.coalesce("ticker", F.lit("")).alias("ticker"))
    return edges.select(F.col("id").alias("edge_id"), here, there, F.col("dependency_type").alias("type")).join(other, there).select(F.col(here).alias("node_id"), "edge_id", "name", "ticker", "type")


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree): edges at either end of a node, a self-loop counted once."""
    return endpoints(edges).where("node_id is not null").groupBy(F.col("node_id").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def adjacency_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, n_upstream, n_downstream): edges of each node by direction, 0 when none."""
    up = edges.groupBy(F.col("target_id").alias("id")).agg(F.count(F.lit(1)).alias("n_upstream"))
    down = edges.groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("n_downstream"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return nodes.select("id").join(up, "id", "left").join(down, "id", "left").select("id", zero("n_upstream"), zero("n_downstream"))


def neighbourhood(nodes: DataFrame, edges: DataFrame, node_id: int) -> DataFrame:
    """(id, highlighted): every node, true for ``node_id`` and the nodes one edge away in either direction."""
    near = edges.where((F.col("source_id") == node_id) | (F.col("target_id") == node_id)).select(F.explode(F.array("source_id", "target_id", F.lit(node_id).cast("bigint"))).alias("id")).distinct()
    return nodes.select("id").join(near.withColumn("highlighted", F.lit(True)), "id", "left").select("id", F.coalesce("highlighted", F.lit(False)).alias("highlighted"))


def tracked_links(nodes: DataFrame, edges: DataFrame, tracked: Column) -> DataFrame:
    """Downstream links with the live change of the linked ticker and a flag whether it is tracked.

    Of several tracked nodes with one ticker the first by (sector, id) counts.
    """
    first = W.partitionBy("ticker").orderBy(F.col("sector").asc_nulls_first(), "id")
    live = nodes.where(tracked & F.col("ticker").isNotNull()).withColumn("rn", F.row_number().over(first)).where("rn = 1").select("ticker", F.col("percent_change").alias("live_change"), F.lit(True).alias("hit"))
    return links(nodes, edges, "downstream").join(live, "ticker", "left").select("node_id", "edge_id", "ticker", "live_change", F.coalesce("hit", F.lit(False)).alias("tracked"))


def neighbourhoods(nodes: DataFrame, edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """(chosen_id, id): for each id of ``chosen`` itself and the nodes one edge away in either direction, all at once."""
    c = chosen.select(F.col("id").alias("chosen_id")).distinct()
    ends = edges.select("source_id", "target_id").distinct()
    pairs = ends.unionByName(ends.select(F.col("target_id").alias("source_id"), F.col("source_id").alias("target_id"))).distinct()
    near = salted_join(pairs.withColumnRenamed("source_id", "chosen_id"), c, ["chosen_id"], "inner", heavy_keys(pairs.withColumnRenamed("source_id", "chosen_id"), ["chosen_id"]), spread=["target_id"])
    every = near.select("chosen_id", F.col("target_id").alias("id")).unionByName(c.select("chosen_id", F.col("chosen_id").alias("id"))).distinct()
    return every.join(nodes.select("id"), "id", "left_semi").select("chosen_id", "id")


def insert_by_ticker(nodes: DataFrame, edges: DataFrame, curated: DataFrame, confidence: float = 1.0, source_url: str = "curated") -> DataFrame:
    """Edges to add for curated pairs (source, target, type) of tickers: both known, and not stored yet between the two nodes.

    A ticker of several nodes means the lowest id. Repeats inside ``curated`` all come out, as the stored edges alone are looked at.
    """
    known = nodes.where("ticker is not null").groupBy("ticker").agg(F.min("id").alias("id"))
    end = lambda c: known.select(F.col("ticker").alias(c), F.col("id").alias(f"{c}_id"))
    new = curated.join(end("source"), "source").join(end("target"), "target").join(edges.select("source_id", "target_id").distinct(), ["source_id", "target_id"], "left_anti")
    return new.select("source_id", "target_id", F.col("type").alias("dependency_type"), F.lit(confidence).alias("confidence_score"), F.lit(source_url).alias("source_url"))


def flat_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, id, json): one JSON element per node and edge of the flat graph document."""
    whole = {"ignoreNullFields": "false"}
    n = nodes.select(F.lit("node").alias("kind"), F.col("id"), F.to_json(F.struct(F.struct(F.col("id").cast("string").alias("id"), "name", F.col("entity_type").alias("type"), F.col("hierarchy_level").alias("level")).alias("data")), whole).alias("json"))
    e = edges.select(F.lit("edge").alias("kind"), F.col("id"), F.to_json(F.struct(F.struct(F.concat(F.lit("e_"), "id").alias("id"), F.col("source_id").cast("string").alias("source"), F.col("target_id").cast("string").alias("target"), F.col("dependency_type").alias("label"), F.col("confidence_score").alias("weight")).alias("data")), whole).alias("json"))
    return n.unionByName(e)

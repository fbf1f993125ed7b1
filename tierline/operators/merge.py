"""Inserts, upserts and the admission of extracted links, set at a time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .skew import ranked

PAIR = ["source_id", "target_id"]


def assets(roster: DataFrame, **wanted: str) -> DataFrame:
    """Roster rows whose columns have the wanted values, such as an asset class and a status; null is no."""
    keep = F.lit(True)
    for c, v in wanted.items():
        keep = keep & (F.col(c) == v)
    return roster.where(keep)


def roster_filter(roster: DataFrame, exchanges: tuple[str, ...] = ("NASDAQ", "NYSE", "ARCA", "BATS")) -> DataFrame:
    """Plain symbols (no '.' or '-') of the allowed exchanges that are both marginable and tradable; null is no."""
    s = F.col("symbol")
    return roster.where(~s.contains(".") & ~s.contains("-") & F.col("exchange").isin(*exchanges) & F.coalesce("marginable", F.lit(False)) & F.coalesce("tradable", F.lit(False)))


def roster_merge(roster: DataFrame, existing: DataFrame, limit: int | None = None) -> DataFrame:
    """Roster rows to insert: symbol not stored yet, first arrival of its name and of its symbol; the first ``limit`` of them by arrival.

    ``existing`` has a column ticker; null and '' are no tickers. A limit of 0 or None is no limit.
    """
    known = existing.where("ticker <> ''").select(F.col("ticker").alias("symbol")).distinct()
    first = lambda c: F.row_number().over(W.partitionBy(c).orderBy("arrival"))
    new = roster.join(known, "symbol", "left_anti").withColumn("__k", first("name")).where("__k = 1").withColumn("__k", first("symbol")).where("__k = 1").drop("__k")
    return new.orderBy("arrival").limit(limit) if limit else new


def insert_if_absent(stored: DataFrame, batch: DataFrame, order: list[str], dedupe_batch: bool = True) -> DataFrame:
    """Rows of ``batch`` whose (source_id, target_id) is not stored; with ``dedupe_batch`` only the first of each pair by ``order``.

    Without it, repeats inside one batch all come through, as where the existence test cannot see pending rows.
    """
    new = batch.join(stored.select(*PAIR).distinct().hint("merge"), PAIR, "left_anti")
    if not dedupe_batch:
        return new
    return new.withColumn("__k", F.row_number().over(W.partitionBy(*PAIR).orderBy(*order))).where("__k = 1").drop("__k")


def next_ids(rows: DataFrame, stored: DataFrame, order: str, out: str = "id") -> DataFrame:
    """Surrogate keys max(stored id) + 1, 2, ... by ``order`` (distinct values), without sorting all rows in one task (see skew.ranked)."""
    start = stored.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("m")).first()["m"]
    return ranked(rows, [], [F.col(order).asc()], out).withColumn(out, F.col(out) + F.lit(start))


def get_or_create(nodes: DataFrame, dependencies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new nodes, edges) for extracted dependencies, companies found by their exact name.

    Rows with a null or empty company are dropped. A name that several nodes have means the lowest id. New
    names get ids in the order of their first appearance (dep_id, source before target). Every kept row
    makes an edge, repeats and self-loops included; a missing type is 'Unknown', a missing confidence 0.5.
    """
    kept = dependencies.where("source_company <> '' and target_company <> ''")
    names = kept.select("dep_id", F.posexplode(F.array("source_company", "target_company")).alias("pos", "name"))
    first = names.groupBy("name").agg(F.min(F.col("dep_id") * 2 + F.col("pos")).alias("seen"))
    known = nodes.groupBy("name").agg(F.min("id").alias("id"))
    created = next_ids(first.join(known, "name", "left_anti"), nodes, "seen").select("id", "name")
    every = known.select("id", "name").unionByName(created)
    s, t = every.select(F.col("id").alias("source_id"), F.col("name").alias("source_company")), every.select(F.col("id").alias("target_id"), F.col("name").alias("target_company"))
    edges = kept.join(s, "source_company").join(t, "target_company").select(
        "dep_id", "source_id", "target_id", F.coalesce("dependency_type", F.lit("Unknown")).alias("dependency_type"), F.coalesce("confidence_score", F.lit(0.5)).alias("confidence_score")
    )
    return created, edges


def seeded(rows: DataFrame, **defaults: str) -> DataFrame:
    """New rows with constant columns, such as a sector that is still pending."""
    return rows.withColumns({c: F.lit(v) for c, v in defaults.items()})


def unresolved(resolved: DataFrame) -> DataFrame:
    """Rejects of admit_links: the links of which an end is not known."""
    return resolved.where("source_id is null or target_id is null")


def admit_links(resolved: DataFrame, company_id: int | None = None) -> DataFrame:
    """Resolved links (source_id, target_id) with both ends known and different; with ``company_id`` only those at one of its ends."""
    out = resolved.where("source_id is not null and target_id is not null and source_id <> target_id")
    return out if company_id is None else out.where((F.col("source_id") == company_id) | (F.col("target_id") == company_id))


def json_value(payload: Column, path: str) -> tuple[Column, Column]:
    """(present, text value) of a key of a JSON object; a key with null is present, its value null."""
    *parents, key = path.split(".")
    holder = F.get_json_object(payload, "$." + ".".join(parents)) if parents else payload
    return F.coalesce(F.array_contains(F.json_object_keys(holder), key), F.lit(False)), F.get_json_object(payload, f"$.{path}")


def merge_payload(target: DataFrame, payloads: DataFrame, key: str, rules: dict[str, tuple[str, str, str | None]]) -> DataFrame:
    """``target`` updated from one JSON payload per key, telling absent keys from null ones.

    ``rules``: column -> (mode, JSON path, default). Mode 'keep' takes the value only if its key is there, else
    the old one stays; 'replace' always takes it, null included; 'default' takes the default where the key is
    missing and null where it is null. A row whose payload is no JSON object (an error text) is left as it is;
    a row without a payload is treated as an empty object. Columns keep their types.
    """
    joined = target.join(payloads.select(key, F.col("payload").alias("__p")), key, "left")
    p = F.coalesce("__p", F.lit("{}"))
    fine = F.json_object_keys(p).isNotNull()
    new = {}
    for c, (mode, path, default) in rules.items():
        present, value = json_value(p, path)
        value = value.try_cast(target.schema[c].dataType)
        taken = {"keep": F.when(present, value).otherwise(F.col(c)), "replace": value, "default": F.when(present, value).otherwise(F.lit(default).cast(target.schema[c].dataType))}[mode]
        new[c] = F.when(fine, taken).otherwise(F.col(c))
    return joined.withColumns(new).drop("__p").select(*target.columns)


def snapshot_upsert(stored: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The stored rows whose key has no change, and the changes: the next snapshot of a table without in-place updates."""
    return stored.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)

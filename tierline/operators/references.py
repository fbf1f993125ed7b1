"""Problem 1: references to records that do not exist, or not at that time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .skew import heavy_of, neighbours, quantile_cuts, salted_join

#: Stands for "the end of the log" where a reference has no time.
END = "9999-12-31 23:59:59"


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def existence(log: DataFrame, key: str = "node_id", op: str = "op", at: str = "effective_at", seq: str = "log_id") -> DataFrame:
    """Periods [alive_from, alive_to) in which a key exists, in microseconds; alive_to null: open.

    Repeated entries collapse; of several entries with one key and time the highest ``seq`` counts.
    Entries with a null key or time say nothing and are left out. An empty log gives no periods.
    """
    states = (
        log.select(F.col(key).alias("key"), _micros(at).alias("t"), F.col(op).alias("op"), F.col(seq).alias("seq"))
        .dropna(subset=["key", "t"])
    )
    cuts = quantile_cuts(states, ["key"], "t")
    states = states.groupBy("key", "t").agg(F.max_by("op", F.struct("seq", "op")).alias("op"))
    spans = neighbours(states.withColumn("s", F.struct("t")), ["key"], "t", {"next_s": "s"}, cuts)
    return spans.where("op = 'insert'").select(F.col("key").alias("parent"), F.col("t").alias("alive_from"), F.col("next_s.t").alias("alive_to"))


def references(edges: DataFrame, row_id: str, fields: list[str], at: str) -> DataFrame:
    """One row per non-null foreign key: row id, field_name, key, t (microseconds) and the time itself."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("key")) for f in fields])
    when = F.coalesce(_micros(at), F.unix_micros(F.to_timestamp(F.lit(END))))
    return edges.select(F.col(row_id).alias("row_id"), F.col(at).alias("at"), when.alias("t"), F.explode(pairs).alias("p")).select("row_id", "at", "t", "p.field_name", "p.key").where("key is not null")


def orphans(edges: DataFrame, log: DataFrame, row_id: str = "id", fields: tuple[str, ...] = ("source_id", "target_id"), at: str = "last_verified") -> DataFrame:
    """Every reference whose parent does not exist at the reference's time.

    Distinct (key, time) pairs are anti-joined against the parents' periods of existence, then joined
    back to the references. Heavy keys are salted in both joins. Null keys are no references; a null
    time is the end of the log. Repeated rows each come out. Columns: row_id, field_name, key, at.
    """
    refs = references(edges, row_id, list(fields), at)
    pairs = written(refs.groupBy("key", "t").agg(F.count(F.lit(1)).alias("n")))  # counted once for all that follows
    by_key = heavy_of(pairs.groupBy("key").agg(F.sum("n").alias("n")), "n", "key")
    spans = existence(log)
    alive = (F.col("t") >= F.col("alive_from")) & (F.col("alive_to").isNull() | (F.col("t") < F.col("alive_to")))
    missing = salted_join(pairs.select("key", "t"), spans.withColumnRenamed("parent", "key"), ["key"], "left_anti", by_key, alive, spread=["t"])
    return salted_join(refs, missing, ["key", "t"], "left_semi", heavy_of(pairs, "n", "key", "t"), spread=["row_id", "field_name"]).select("row_id", "field_name", "key", "at")


def orphan_report(edges: DataFrame, log: DataFrame, table: str = "edges", row_id: str = "id", fields: tuple[str, ...] = ("source_id", "target_id"), at: str = "last_verified") -> DataFrame:
    """Counts per table, endpoint field and month: references, those without a parent, distinct lost keys.

    The month of a reference without a time is ''. Columns: table_name, field_name, month, n_refs, n_orphans, n_keys.
    """
    month = F.coalesce(F.date_format("at", "yyyy-MM"), F.lit("")).alias("month")
    n = references(edges, row_id, list(fields), at).groupBy("field_name", month).agg(F.count(F.lit(1)).alias("n_refs"))
    lost = orphans(edges, log, row_id, fields, at).groupBy("field_name", month, "key").agg(F.count(F.lit(1)).alias("c")).groupBy("field_name", "month").agg(F.sum("c").alias("n_orphans"), F.count(F.lit(1)).alias("n_keys"))
    out = n.join(lost, ["field_name", "month"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return out.select(F.lit(table).alias("table_name"), "field_name", "month", "n_refs", zero("n_orphans"), zero("n_keys"))

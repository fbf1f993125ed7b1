"""Problem 5: the history of changing attributes, from snapshots (gaps and islands)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import neighbours, quantile_cuts, running_sum


def normal_text(c: str):
    """Text compared without regard to case, outer blanks and '_' for a blank."""
    return F.trim(F.regexp_replace(F.lower(F.col(c)), "_", " "))


def versions(snapshots: DataFrame, key: str, at: str, loaded: str, attributes: list[str], texts: tuple[str, ...] = ()) -> DataFrame:
    """One row per version of an entity: key, version number, attributes, valid_from, valid_to, last_seen, n_states.

    Of several rows with one key and time the one loaded last counts (null is earliest; equal load
    times: the greatest attributes). A version starts at the first state and wherever the hash of the
    attributes differs from the state before; null equals null; ``texts`` are compared by
    ``normal_text``. valid_to is the next version's start, null for the last. Rows with a null key or
    time have no place in a history and are left out. Heavy keys are worked in ranges of time.
    """
    vals = F.struct(*[F.col(a).alias(a) for a in attributes])
    states = (
        snapshots.dropna(subset=[key, at])
        .select(F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"), F.struct(F.col(loaded).alias("l"), vals.alias("v")).alias("s"))
    )
    cuts = quantile_cuts(states, ["key"], "t")
    states = (
        states.groupBy("key", "t")
        .agg(F.max("s").alias("s"))
        .select("key", "t", *[F.col(f"s.v.{a}").alias(a) for a in attributes])
    )
    same = [normal_text(a) if a in texts else F.col(a) for a in attributes]
    told = [F.coalesce(c.cast("string"), F.lit("\x01")) for c in same]
    states = states.withColumn("h", F.struct(F.sha2(F.concat_ws("\x02", *told), 256).alias("x")))
    marked = neighbours(states, ["key"], "t", {"prev_h": "h"}, cuts).withColumn("change", F.when(F.col("prev_h.x") == F.col("h.x"), 0).otherwise(1).cast("bigint"))
    numbered = running_sum(marked.drop("prev_h", "h"), ["key"], "t", "change", "version", cuts)
    islands = numbered.groupBy("key", "version").agg(
        F.min("t").alias("t"), F.max("t").alias("seen"), F.count(F.lit(1)).alias("n_states"),
        F.min_by(F.struct(*attributes), "t").alias("v"),
    )
    ended = neighbours(islands.withColumn("s", F.struct("t")), ["key"], "t", {"next_s": "s"}, cuts)
    ntz = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return ended.select(F.col("key").alias(key), "version", "v.*", ntz(F.col("t")).alias("valid_from"), ntz(F.col("next_s.t")).alias("valid_to"), ntz(F.col("seen")).alias("last_seen"), "n_states")

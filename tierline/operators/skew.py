"""Work on keyed rows when one key may hold a large share of all rows.

A key is heavy if it holds more than ``SHARE`` of the rows and more than ``LEAST`` rows. There are fewer
than ``1 / SHARE`` heavy keys whatever the data; this bound allows to bring them to the driver and to
broadcast them. Where there are none the plans are the plain ones. Results never depend on this.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut

#: A key is heavy if it holds more than this share of the rows,
SHARE = 1 / 200
#: and more rows than a task handles with ease.
LEAST = 50_000
#: Pieces into which the rows of a heavy key are cut.
PIECES = 64


def heavy_keys(df: DataFrame, keys: list[str], share: float = SHARE, least: int = LEAST) -> DataFrame | None:
    """The heavy keys of ``df`` as a local table of fewer than 1/share rows, or None. Null keys don't count.

    Counts are combined map-side; only the heavy keys reach the driver.
    """
    counts = df.select(*keys).dropna().groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    total = counts.select(F.sum("__n")).scalar()
    rows = counts.where((F.col("__n") > F.lit(least)) & (F.col("__n") > total * F.lit(share))).select(*keys).collect()
    return df.sparkSession.createDataFrame(rows, df.select(*keys).schema) if rows else None


def heavy_of(counts: DataFrame, n: str, *keys: str, share: float = SHARE, least: int = LEAST) -> DataFrame | None:
    """As heavy_keys, from a table of how many rows (``n``) each key has; keys left out of it must be light, and only lower the bar."""
    total = counts.select(F.sum(n)).scalar()
    rows = counts.where((F.col(n) > F.lit(least)) & (F.col(n) > total * F.lit(share))).select(*keys).collect()
    return counts.sparkSession.createDataFrame(rows, counts.select(*keys).schema) if rows else None


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str, heavy: DataFrame | None, cond: Column | None = None, spread: list[str] | None = None, salts: int = 32) -> DataFrame:
    """Equi-join that spreads the left rows of the ``heavy`` keys over ``salts`` pieces.

    The right rows of those keys, and only those, are repeated once per piece. ``spread`` names left
    columns whose hash gives the piece (default: all). ``how`` keeps left rows: inner, left, left_semi
    or left_anti. ``cond`` may refer to columns of both sides, whose other names must differ.
    """
    assert how in {"inner", "left", "left_semi", "left_anti"}, how
    keys = list(on)
    if heavy is not None:
        mark = F.broadcast(heavy.select(*on, F.lit(True).alias("__heavy")))  # fewer than 1/SHARE rows
        piece = F.pmod(F.xxhash64(*(spread or left.columns)), F.lit(salts)).cast("int")
        left = left.join(mark, on, "left").withColumn("__salt", F.when(F.col("__heavy"), piece).otherwise(F.lit(0))).drop("__heavy")
        all_pieces = F.when(F.col("__heavy"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
        right = right.join(mark, on, "left").withColumn("__salt", F.explode(all_pieces)).drop("__heavy")
        keys.append("__salt")
    if cond is None:
        return left.join(right, keys, how).drop("__salt")
    names = {k: f"__r_{k}" for k in keys}
    both = reduce(lambda x, y: x & y, [F.col(k) == F.col(r) for k, r in names.items()]) & cond
    return left.join(right.withColumnsRenamed(names), both, how).drop("__salt", *names.values())


def quantile_cuts(df: DataFrame, keys: list[str], order: str, share: float = SHARE, least: int = LEAST, pieces: int = PIECES) -> DataFrame | None:
    """For each heavy key the quantiles of ``order`` that part its rows: a local table, or None.

    It has fewer than 1/share rows of ``pieces`` - 1 numbers.
    """
    heavy = heavy_keys(df, keys, share, least)
    if heavy is None:
        return None
    at = F.col(order).cast("double")
    cuts = df.select(*keys, order).join(F.broadcast(heavy), keys, "left_semi").groupBy(*keys).agg(F.percentile_approx(at, [i / pieces for i in range(1, pieces)], 2000).alias("__cuts"))
    return df.sparkSession.createDataFrame(cuts.collect(), cuts.schema)


def _blocks(df: DataFrame, keys: list[str], order: str, cuts: DataFrame) -> DataFrame:
    at = F.col(order).cast("double")
    return (
        df.join(F.broadcast(cuts), keys, "left")
        .withColumn("__cut", F.col("__cuts").isNotNull())
        .withColumn("__block", F.when(F.col("__cut"), F.size(F.filter("__cuts", lambda c: c <= at))).otherwise(F.lit(0)))
        .drop("__cuts")
    )


def neighbours(df: DataFrame, keys: list[str], order: str, payload: dict[str, str], cuts: DataFrame | None) -> DataFrame:
    """For each row the nearest earlier and later non-null payload of its key, by ``order``.

    ``payload`` maps an output column to the struct column it takes: ``{"prev_x": "x"}``; names that
    begin with ``next`` look forward, others back. ``order`` is numeric and not null; where it ties, the
    payload's hash decides.

    With ``cuts`` (see quantile_cuts) the rows of heavy keys are sorted range by range. What a range
    needs from outside is the last (first) payload of the ranges before (after) it; it arrives as one
    extra row. ``df`` is then written once, as it is read twice.
    """
    sources = list(dict.fromkeys(payload.values()))
    tie = F.xxhash64(*[F.col(c) for c in sources])
    if cuts is None:
        rows, part, side = df, W.partitionBy(*keys), []
    else:
        df = cut(df)
        b = _blocks(df, keys, order, cuts)
        there = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.col(order).alias("o"), tie.alias("h"))).alias("w")
        per = (
            b.where("__cut")
            .groupBy(*keys, "__block")
            .agg(
                *[F.max_by(F.col(c), there(c)).alias(f"__last_{c}") for c in sources],
                *[F.min_by(F.col(c), there(c)).alias(f"__first_{c}") for c in sources],
                F.min(order).alias("__lo"), F.max(order).alias("__hi"),
            )
        )
        back = W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
        ahead = W.partitionBy(*keys).orderBy(F.desc("__block")).rowsBetween(W.unboundedPreceding, -1)
        carried = per.select(
            *keys, "__block", "__lo", "__hi",
            *[F.last(f"__last_{c}", True).over(back).alias(f"__b_{c}") for c in sources],
            *[F.last(f"__first_{c}", True).over(ahead).alias(f"__a_{c}") for c in sources],
        )
        base = b.drop("__cut").withColumn("__side", F.lit(0))
        kept = [c for c in base.columns if c not in {*keys, "__block", "__side", order, *sources}]
        blank = [F.lit(None).cast(base.schema[c].dataType).alias(c) for c in kept]
        ghost = lambda where, at, mark: carried.select(*keys, "__block", F.lit(where).alias("__side"), F.col(at).cast(base.schema[order].dataType).alias(order), *[F.col(f"{mark}{c}").alias(c) for c in sources], *blank)
        rows = base.unionByName(ghost(-1, "__lo", "__b_")).unionByName(ghost(1, "__hi", "__a_"))
        part, side = W.partitionBy(*keys, "__block"), [F.col("__side")]
    up = part.orderBy(F.col(order), *side, tie).rowsBetween(W.unboundedPreceding, -1)
    down = part.orderBy(F.col(order).desc(), *[c.desc() for c in side], tie.desc()).rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumns({name: F.last(c, True).over(down if name.startswith("next") else up) for name, c in payload.items()})
    return out if cuts is None else out.where("__side = 0").drop("__side", "__block")


def running_sum(df: DataFrame, keys: list[str], order: str, value: str, out: str, cuts: DataFrame | None) -> DataFrame:
    """Inclusive running sum of ``value`` (a bigint) per key by ``order`` (unique in its key); heavy keys range by range."""
    frame = lambda *k: W.partitionBy(*k).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    if cuts is None:
        return df.withColumn(out, F.sum(value).over(frame(*keys)))
    df = cut(df)
    b = _blocks(df, keys, order, cuts)
    sums = b.where("__cut").groupBy(*keys, "__block").agg(F.sum(value).alias("__s"))
    before = sums.select(*keys, "__block", F.coalesce(F.sum("__s").over(W.partitionBy(*keys).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return (
        b.join(F.broadcast(before), [*keys, "__block"], "left")  # fewer than PIECES / SHARE rows
        .withColumn(out, (F.sum(value).over(frame(*keys, "__block")) + F.coalesce("__before", F.lit(0))).cast("bigint"))
        .drop("__before", "__block", "__cut")
    )


def ranked(df: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """``df`` with the place (from 1) of each row in its key by ``order``, whose values are distinct in a key; no key is sorted in one task.

    Rows are range-partitioned by key and order and written once with the number of their partition, so that it stays what
    it is whatever task runs again; each partition counts on from the rows of its key in those before it. Null is a key.
    """
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(df.repartitionByRange(tasks, *keys, *order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    frame = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # at most one row a partition for each key
    before = counts.select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col("__part").alias("__r_part"), F.coalesce(F.sum("__n").over(frame), F.lit(0)).alias("__before"))
    same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys], F.col("__part") == F.col("__r_part"))
    within = ranged.withColumn("__k", F.row_number().over(W.partitionBy(*keys, "__part").orderBy(*order)))
    return within.join(before, same).withColumn(out, (F.col("__before") + F.col("__k")).cast("bigint")).drop("__part", "__k", "__before", "__r_part", *[f"__r_{k}" for k in keys])

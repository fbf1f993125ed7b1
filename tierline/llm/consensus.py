"""Problem 6: the best representative of each duplicate group, by token-level consensus."""

from __future__ import annotations

import json
import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import heavy_keys, salted_join
from ..session import cut
from .companies import company_groups
from .names import NO_TICKER

#: Values or partial profiles that one alignment takes.
FAN_IN = 256


def align(a: list[dict[str, float]], b: list[dict[str, float]]) -> list[dict[str, float]]:
    """Merge two profiles (token weights per column) by global alignment; '' stands for a gap.

    Two columns score the weight share of the tokens they have in common; a gap scores a little below zero.
    """
    total = [sum(c.values()) for c in a], [sum(c.values()) for c in b]
    gap = -0.3

    def match(i: int, j: int) -> float:
        x, y = a[i], b[j]
        return sum(min(w / total[0][i], y[t] / total[1][j]) for t, w in x.items() if t in y and t) - 0.5

    n, m = len(a), len(b)
    best = [[gap * j for j in range(m + 1)]] + [[gap * (i + 1)] + [0.0] * m for i in range(n)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            best[i][j] = max(best[i - 1][j - 1] + match(i - 1, j - 1), best[i - 1][j] + gap, best[i][j - 1] + gap)
    wa, wb = max(total[0], default=0.0), max(total[1], default=0.0)
    out, i, j = [], n, m
    while i or j:
        if i and j and abs(best[i][j] - best[i - 1][j - 1] - match(i - 1, j - 1)) < 1e-12:
            i, j = i - 1, j - 1
            col = dict(a[i])
            for t, w in b[j].items():
                col[t] = col.get(t, 0.0) + w
        elif i and abs(best[i][j] - best[i - 1][j] - gap) < 1e-12:
            i -= 1
            col = dict(a[i])
            col[""] = col.get("", 0.0) + wb
        else:
            j -= 1
            col = dict(b[j])
            col[""] = col.get("", 0.0) + wa
        out.append(col)
    return out[::-1]


@F.pandas_udf(T.StringType())
def merge_profiles(lists: pd.Series) -> pd.Series:
    """Progressive alignment of a list of profiles (as JSON), the weightiest first."""

    def one(profiles) -> str:
        all_ = [json.loads(p) for p in profiles]
        all_.sort(key=lambda p: (-max((sum(c.values()) for c in p), default=0.0), repr(p)))
        done = all_[0]
        for p in all_[1:]:
            done = align(done, p)
        return json.dumps(done)

    return lists.map(one)


@F.pandas_udf(T.ArrayType(T.StringType()))
def vote(profiles: pd.Series) -> pd.Series:
    """The weightiest token of each column, columns won by the gap left out."""

    def one(p: str) -> list[str]:
        won = [max(sorted(c.items()), key=lambda x: x[1])[0] for c in json.loads(p)]
        return [t for t in won if t]

    return profiles.map(one)


@F.pandas_udf(T.IntegerType())
def token_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Edits of whole tokens between two token lists."""

    def one(x, y) -> int:
        row = list(range(len(y) + 1))
        for i, s in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, t in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (s != t))
        return row[-1]

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def consensus(cells: DataFrame, trust_latest: bool = True) -> DataFrame:
    """(grp, field_name, value, row_id) chosen for each group and field of ``cells`` (grp, field_name, value, row_id, at).

    The distinct values of a group are aligned token by token, each with the number of its rows as weight;
    with ``trust_latest`` the value of the latest row (null times are oldest; ties: smallest row_id)
    outweighs all others together, so that completeness is decided by who has a value and conflicts by
    recency; without it the majority of tokens wins. The existing value closest to the voted tokens is
    taken, at equal distance the latest; row_id is the latest row that has it. ``cells`` hold usable
    values only. Groups of any size: equal values are counted map-side, distinct ones aligned in a tree
    of about FAN_IN profiles a step; a group of one distinct value has nothing to align.
    """
    latest = F.struct(F.coalesce(F.col("at").cast("timestamp_ntz"), F.lit("0001-01-01 00:00:00").cast("timestamp_ntz")).alias("at"), (-F.col("row_id")).alias("neg"))
    keys = ["grp", "field_name"]
    values = cut(cells.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"), F.max(latest).alias("last")))
    per = values.groupBy(*keys).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("k"), F.max("last").alias("newest"))
    heavy = heavy_keys(values, keys)
    joined = cut(salted_join(values, per.hint("merge"), keys, "inner", heavy, spread=["value"]))
    several = joined.where("k > 1")
    weight = (F.col("n") + (F.when(F.col("last") == F.col("newest"), F.col("rows") + 1).otherwise(0) if trust_latest else F.lit(0))).cast("double")
    tokens = F.filter(F.split("value", r"\s+"), lambda t: t != "")
    level = several.select(*keys, "k", F.xxhash64("value").alias("h"), F.to_json(F.transform(tokens, lambda t: F.create_map(t, weight))).alias("profile"))
    most = several.agg(F.max("k")).first()[0] or 1
    for _ in range(max(1, math.ceil(math.log(max(most, 2), FAN_IN)))):
        parts = F.greatest(F.ceil(F.col("k") / FAN_IN), F.lit(1)).cast("long")
        level = (
            level.withColumn("part", F.pmod("h", parts))
            .groupBy(*keys, "part")
            .agg(F.max(parts).alias("k"), F.collect_list("profile").alias("all"))
            .select(*keys, "k", F.xxhash64("part").alias("h"), merge_profiles("all").alias("profile"))
        )
    voted = level.select(*keys, vote("profile").alias("voted"))
    scored = salted_join(several, voted.hint("merge"), keys, "inner", heavy, spread=["value"]).withColumn("far", token_distance(tokens, "voted"))
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("value", "last"), F.struct((-F.col("far")).alias("near"), "last")).alias("b")).select(*keys, "b.value", (-F.col("b.last.neg")).alias("row_id"))
    return best.unionByName(joined.where("k = 1").select(*keys, "value", (-F.col("last.neg")).alias("row_id")))


def usable_ticker(c: str) -> Column:
    t = F.trim(F.col(c))
    return F.when(~F.upper(t).isin(*NO_TICKER), F.col(c))


def survivors(nodes: DataFrame, trust_latest: bool = True) -> DataFrame:
    """One row per company with two or more rows: group_id (smallest id), n_rows, and for name, ticker and market_cap the value and the id of its row (0 and null if no row has a usable one)."""
    groups = cut(company_groups(nodes).select("row_id", F.col("group_id").alias("grp")))
    several = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")
    member = salted_join(groups, several.hint("merge"), ["grp"], "inner", heavy_keys(groups, ["grp"]), spread=["row_id"]).select("row_id", "grp")
    cap = F.col("market_cap").cast("double")
    usable = {"name": F.col("name"), "ticker": usable_ticker("ticker"), "market_cap": F.when((cap > 0) & ~F.isnan(cap) & (cap < float("inf")), cap).cast("string")}
    wide = nodes.select(F.col("id").alias("row_id"), F.col("last_updated").alias("at"), *[v.alias(f"u_{k}") for k, v in usable.items()]).join(member.hint("merge"), "row_id")
    cells = wide.select("row_id", "at", "grp", F.explode(F.array(*[F.struct(F.lit(k).alias("field_name"), F.col(f"u_{k}").alias("value")) for k in usable])).alias("c")).select("row_id", "at", "grp", "c.*").where("value is not null")
    best = consensus(cells, trust_latest)
    one = lambda f, c: F.max(F.when(F.col("field_name") == f, F.col(c)))
    flat = best.groupBy("grp").agg(*[x for f, p in (("name", "name"), ("ticker", "ticker"), ("market_cap", "cap")) for x in (one(f, "value").alias(f), one(f, "row_id").alias(f"{p}_id"))])
    out = several.join(flat.hint("merge"), "grp", "left")
    return out.select(F.col("grp").alias("group_id"), "n_rows", "name", "ticker", F.col("market_cap").cast("double").alias("market_cap"), *[F.coalesce(f"{p}_id", F.lit(0)).cast("bigint").alias(f"{p}_id") for p in ("name", "ticker", "cap")])

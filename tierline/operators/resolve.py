"""Staged resolution of company mentions: ticker, fuzzy name, alias list."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, scratch, written
from .skew import heavy_keys, salted_join

#: Lengths of the q-grams by which texts are sought; longer ones stand in fewer texts.
GRAMS = (1, 2, 3, 5, 8)


def guarded(mentions: DataFrame) -> DataFrame:
    """Distinct mentions of two or more characters (counted before the strip) with their stripped text."""
    return mentions.where(F.length("mention") >= 2).select("mention").distinct().withColumn("said", F.regexp_replace("mention", r"(?U)^\s+|\s+$", ""))


def by_ticker(mentions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(mention, id): the node whose ticker is the mention in capitals; lowest id of several."""
    t = nodes.where("ticker is not null").groupBy(F.col("ticker").alias("key")).agg(F.min("id").alias("id"))
    return guarded(mentions).withColumn("key", F.upper("said")).join(t.hint("merge"), "key").select("mention", "id")


def substring_candidates(mentions: DataFrame, nodes: DataFrame, floor: float) -> DataFrame:
    """(mention, id, name, market_cap) where a name or ticker contains the mention, case ignored, and market_cap is above ``floor``; see substring_matches. Wildcard signs are plain characters."""
    rich = nodes.where((F.col("market_cap") > floor) & ~F.isnan("market_cap")).select("id", "name", "ticker", "market_cap")
    m = guarded(mentions).withColumn("low", F.lower("said")).where("low <> ''").select("mention", "low")
    return substring_matches(m, rich).distinct()


def substring_matches(m: DataFrame, nodes: DataFrame, sizes: tuple[int, ...] = GRAMS) -> DataFrame:
    """(mention, and the columns of ``nodes`` but ticker) where a name or ticker in lower case contains ``low`` of ``m`` (mention, low), which is not empty.

    A text that contains ``low`` contains each of its q-grams, so both sides meet on one of them: an equi-join with a check of
    the whole, in place of a join on LIKE. q is the largest of ``sizes`` that ``low`` has; of its q-grams at every half q and at its
    end the rarest in the texts is taken, and where one is in no text nothing is sought. Only numbers are spread over the q-grams,
    and no side that grows is broadcast: a plan's guess of what q-grams weigh is that of the table they are cut from. The result is written.
    """
    spark = nodes.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the q-grams are work for all, however few bytes the tables have
    rest = [c for c in nodes.columns if c != "ticker"]
    gram = lambda c, n: lambda at: F.xxhash64(F.substring(F.col(c), at, F.lit(n)))
    every = lambda n: F.when(F.length("text") >= n, F.transform(F.sequence(F.lit(1), F.length("text") - n + 1), gram("text", n))).otherwise(F.array().cast("array<bigint>"))
    last = lambda n: F.length("low") - n + 1
    some = lambda n: F.array_distinct(F.transform(F.concat(F.sequence(F.lit(1), last(n), F.lit((n + 1) // 2)), F.array(last(n))), gram("low", n)))
    with scratch(spark) as keep:
        q = F.coalesce(*[F.when(F.length("low") >= n, n) for n in sorted(sizes, reverse=True)])
        said = keep(m.repartition(tasks).select(F.monotonically_increasing_id().alias("i"), "mention", "low", q.alias("q")).where("q is not null"))
        used = [r["q"] for r in said.select("q").distinct().orderBy("q").collect()] or [min(sizes)]
        texts = nodes.repartition(tasks).select(*rest, F.explode(F.array(F.lower("name"), F.lower("ticker"))).alias("__text")).where("__text is not null")
        texts = keep(texts.select(F.monotonically_increasing_id().alias("__j"), "*"))
        pieces = texts.select("__j", F.col("__text").alias("text")).select("__j", F.explode(F.array_distinct(F.concat(*[every(n) for n in used]))).alias("gram"))
        df = pieces.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
        cuts = F.coalesce(*[F.when(F.col("q") == n, some(n)) for n in used])
        grams = said.select("i", F.explode(cuts).alias("gram")).join(df.hint("merge"), "gram", "left")
        rarest = grams.groupBy("i").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "gram")).alias("r")).where("r.df > 0")
        rarest = keep(rarest.select("i", "r.gram"))
        met = salted_join(rarest, pieces.hint("merge"), ["gram"], "inner", heavy_keys(rarest, ["gram"]), spread=["i"]).select("i", "__j")
        both = met.join(said.select("i", "mention", "low").hint("merge"), "i").join(texts.hint("merge"), "__j")
        return written(both.where(F.contains("__text", "low")).select("mention", *rest))


def _lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit by bit."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & places.get(c, 0)
        s = (s + u | s - u) & full
    return len(a) - s.bit_count()


def token_set_ratio(a: str, b: str) -> int:
    """Similarity of two texts as sets of words, 0 to 100: 100 if one set holds the other, else by the indel distance of what differs."""
    x, y = (set(re.sub(r"[^0-9a-z]+", " ", re.sub(r"[^\x00-\x7f]", "", t).lower()).split()) for t in (a, b))
    if not x or not y:
        return 0
    both, only_x, only_y = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not only_x or not only_y):
        return 100
    i, p, q = " ".join(both), " ".join(only_x), " ".join(only_y)
    left, right = " ".join(filter(None, (i, p))), " ".join(filter(None, (i, q)))
    best = 1 - (len(p) + len(q) - 2 * _lcs(p, q)) / (len(left) + len(right))
    if both:
        best = max(best, 1 - (1 + len(p)) / (len(i) + len(left)), 1 - (1 + len(q)) / (len(i) + len(right)))
    return round(best * 100)


@F.pandas_udf(T.IntegerType())
def name_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_set_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="int32")


def fold_best(scored: DataFrame, accept: int = 85, near: int = 5) -> DataFrame:
    """(mention, id, best_score): the ordered choice among scored candidates (mention, id, score, market_cap); ids are unique in a mention.

    Candidates are taken by id. A higher score replaces the choice and the best score; a score within
    ``near`` of the best with a larger market cap replaces the choice only. Accepted if the best score is
    above ``accept``. What came before the first candidate with the highest score has no say; from there on the largest cap wins,
    at equal caps the lowest id. So two aggregations do, and no mention's candidates have to fit one row. They are read three
    times, so they are written once.
    """
    rows = written(scored.select("mention", "id", F.col("score").cast("int").alias("score"), F.coalesce(F.col("market_cap").cast("double"), F.lit(0.0)).alias("cap")))
    top = rows.groupBy("mention").agg(F.max(F.struct("score", (-F.col("id")).alias("neg"))).alias("top")).select("mention", F.col("top.score").alias("best_score"), (-F.col("top.neg")).alias("first")).where(F.col("best_score") > accept)
    left = salted_join(rows, top.hint("merge"), ["mention"], "inner", heavy_keys(rows, ["mention"]), spread=["id"]).where((F.col("id") >= F.col("first")) & (F.col("best_score") - F.col("score") < near))
    return left.groupBy("mention").agg(F.max_by("id", F.struct("cap", (-F.col("id")).alias("neg"))).alias("id"), F.max("best_score").alias("best_score"))


def alias_first(aliases: DataFrame) -> DataFrame:
    """(query_text, symbol): the first hit of each landed symbol search."""
    return aliases.groupBy("query_text").agg(F.min_by("symbol", F.struct("hit_rank", "symbol")).alias("symbol"))


def resolve(mentions: DataFrame, nodes: DataFrame, aliases: DataFrame, floor: float = 1e8) -> DataFrame:
    """(mention, id, stage): the first stage that resolves a mention of two or more characters.

    Stage 1 is the exact ticker, without a cap floor; 2 the fuzzy name among candidates above ``floor``; 3 the
    first alias hit's exact ticker. Unresolved mentions do not come out.
    """
    one = written(by_ticker(mentions, nodes).withColumn("stage", F.lit(1)))
    rest = mentions.select("mention").distinct().join(one.hint("merge"), "mention", "left_anti")
    cand = substring_candidates(rest, nodes, floor)
    two = written(fold_best(cand.withColumn("score", name_score(F.lower(F.trim("mention")), F.lower("name")))).select("mention", "id", F.lit(2).alias("stage")))
    left = guarded(rest.join(two.hint("merge"), "mention", "left_anti"))
    tickers = nodes.where("ticker is not null").groupBy(F.col("ticker").alias("symbol")).agg(F.min("id").alias("id"))
    found = alias_first(aliases).withColumn("symbol", F.upper("symbol")).join(tickers.hint("merge"), "symbol")
    three = left.join(found.hint("merge"), F.col("said") == F.col("query_text")).select("mention", "id", F.lit(3).alias("stage"))
    return one.unionByName(two).unionByName(three)


def resolve_links(dependencies: DataFrame, nodes: DataFrame, aliases: DataFrame, floor: float = 1e8) -> DataFrame:
    """``dependencies`` with source_id and target_id: by the given ticker of each end (source_ticker, target_ticker) or else by its name; null where neither resolves."""
    ends = [(f"{e}_ticker", f"{e}_company", f"{e}_id") for e in ("source", "target")]
    said = dependencies.select(F.explode(F.array(*[c for t, n, _ in ends for c in (t, n)])).alias("mention")).where("mention is not null").distinct()
    found = cut(resolve(said, nodes, aliases, floor).select("mention", "id"))
    out = dependencies
    for t, n, i in ends:
        by = lambda c, name: found.select(F.col("mention").alias(c), F.col("id").alias(name)).hint("merge")
        out = out.join(by(t, "__t"), t, "left").join(by(n, "__n"), n, "left").withColumn(i, F.coalesce("__t", "__n")).drop("__t", "__n")
    return out

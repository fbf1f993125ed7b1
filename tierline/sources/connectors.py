"""Landed answers in place of live connectors, and the interface that a live one would fill."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a live connector is asked for at a time.
BATCH = 100


def ask(rows: DataFrame, c: str, answer: Callable[[list[str]], list[str | None]], out: str = "reply", size: int = BATCH) -> DataFrame:
    """``rows`` with what ``answer`` says to each value of ``c``, asked in lists of up to ``size`` within a partition.

    A connector or a model is such a function; one that fails gives '' for its whole list, as null values do, and the other
    lists go on. The number of partitions is the number of askers at a time.
    """

    def one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            said: list[str] = []
            for at in range(0, len(pdf), size):
                asked = pdf[c].iloc[at : at + size].tolist()
                try:
                    there = [x for x in asked if x is not None]
                    got = iter(answer(there) if there else [])
                    said += ["" if x is None else (next(got) or "") for x in asked]
                except Exception:  # whatever a service may raise
                    said += [""] * len(asked)
            yield pdf.assign(**{out: said})

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(one, f"{names}, `{out}` string")


def replayed(rows: DataFrame, landed: DataFrame, key: str, reply: str = "reply") -> DataFrame:
    """``rows`` with the landed answer of their key, '' where none was landed or it was an error (null)."""
    answers = landed.groupBy(F.col(key).alias("__key")).agg(F.min(reply).alias(reply))
    return rows.join(answers, rows[key] == F.col("__key"), "left").drop("__key").withColumn(reply, F.coalesce(reply, F.lit("")))


def prompt(template: str, **parts: str) -> Column:
    """``template`` with each {part} replaced by a column; null is ''. Braces in the columns' texts stay as they are."""
    pieces, rest = [], template
    while rest:
        at, name = min(((i, n) for n in parts if (i := rest.find("{" + n + "}")) >= 0), default=(len(rest), ""))
        pieces.append(F.lit(rest[:at]))
        if name:
            pieces.append(F.coalesce(F.col(parts[name]).cast("string"), F.lit("")))
        rest = rest[at + len(name) + 2 :] if name else ""
    return F.concat(*pieces)


def first_answered(keys: DataFrame, key: str, attempts: list[Column], landed: DataFrame, query: str = "query_text", rank: str = "hit_rank", page: str = "symbol") -> DataFrame:
    """(key, attempt, page): the first attempt (from 1) that has landed hits, and its best hit; keys without any don't come out."""
    tried = keys.select(F.col(key), F.posexplode(F.array(*attempts)).alias("at", query)).where(F.col(query).isNotNull())
    best = landed.where(F.col(query).isNotNull()).groupBy(query).agg(F.min_by(page, F.struct(rank, page)).alias(page))
    hits = tried.join(best, query)
    return hits.groupBy(key).agg((F.min("at") + 1).alias("attempt"), F.min_by(page, "at").alias(page))

"""Problem 4: missing values filled from similar records by predictive mean matching."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .skew import neighbours, quantile_cuts

#: Texts that stand for "not known (yet)", compared in lower case without outer blanks.
STAND_INS = (
    "", "-", "--", "---", "?", "??", "???", "n/a", "na", "n.a.", "none", "null", "nil", "nan", "unknown", "not known", "not yet known",
    "not available", "not specified", "unspecified", "undefined", "tbd", "tba", "tbc", "to be determined", "to be confirmed",
    "pending", "pending update", "uncategorized", "uncategorised", "unclassified",
)
#: Words of legal forms and share classes that don't tell companies apart.
FORM_WORDS = (
    "the", "inc", "incorporated", "corp", "corporation", "co", "company", "ltd", "limited", "plc", "ag", "sa", "nv", "se", "holdings", "group",
    "class", "a", "b", "c", "common", "stock", "ordinary", "shares", "american", "depositary", "sponsored", "adr",
)


def known_text(c: str) -> Column:
    """The text without outer blanks, or null if it is blank or a stand-in for "not known"."""
    t = F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", "")
    return F.when(~F.lower(t).isin(*STAND_INS), t)


def known_number(c: str, lo: float, hi: float, open_lo: bool = False, open_hi: bool = False) -> Column:
    """The number, or null if it is not finite or outside the range."""
    x = F.col(c).cast("double")
    low, high = (x > lo) if open_lo else (x >= lo), (x < hi) if open_hi else (x <= hi)
    return F.when(~F.isnan(x) & low & high, x)


def company_key(c: str) -> Column:
    """Plain key of a company: the sorted words of its name in lower case, without legal forms; null if none is left."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.col(c)), r"[.']", ""), r"[^\p{L}\p{N}]+", " ")), " ")
    key = F.array_join(F.array_sort(F.filter(words, lambda w: ~w.isin(*FORM_WORDS))), " ")
    return F.when(key != "", key)


class _Fit:
    """Solves each group's normal equations, shrunk towards the field's overall ones by ``prior`` rows' weight."""

    def __init__(self, columns: int, ridge: float, prior: float, overall: dict[str, list[float]]):
        self.k, self.prior = columns + 1, prior
        self.penalty = ridge * np.eye(self.k)
        self.penalty[0, 0] = 1e-9
        self.overall = {f: self._means(v) for f, v in overall.items()}

    def _matrices(self, v: list[float]) -> tuple[np.ndarray, np.ndarray]:
        upper, v = np.triu_indices(self.k), np.asarray(v, dtype=float)
        a = np.zeros((self.k, self.k))
        a[upper] = v[: len(upper[0])]
        return a + np.triu(a, 1).T, v[len(upper[0]) :]

    def _means(self, v: list[float]) -> tuple[np.ndarray, np.ndarray]:
        a, b = self._matrices(v)
        n = max(a[0, 0], 1.0)
        return a / n, b / n

    def beta(self, field: str, v: list[float] | None) -> list[float]:
        a, b = self.overall[field]
        if v is not None:
            own, right = self._matrices(v)
            a, b = own + self.prior * a, right + self.prior * b
        else:
            a, b = self.prior * a, self.prior * b
        return np.linalg.solve(a + self.penalty, b).tolist()

    def __call__(self, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf[["field_name", "fit_group"]].assign(beta=[self.beta(f, v) for f, v in zip(pdf["field_name"], pdf["stats"], strict=True)])


def _codes(cells: DataFrame, k: int) -> DataFrame:
    """(field_name, text, code): the mean of each category's features, projected on the first axis of the scatter between categories.

    The scatter is one row of about k * k / 2 numbers a field, which is what reaches the driver; the categories stay where they are.
    """
    features = [F.element_at("x", i + 2) for i in range(k)]
    means = cut(cells.where("text is not null").groupBy("field_name", "text").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(f) for f in features]).alias("m")))
    m, pairs = (lambda i: F.col("m")[i]), [(i, j) for i in range(k) for j in range(i, k)]
    sums = means.groupBy("field_name").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("n") * m(i)) for i in range(k)]).alias("one"), F.array(*[F.sum(F.col("n") * m(i) * m(j)) for i, j in pairs]).alias("two"))
    axes = []
    for r in sums.collect():
        mu, b = np.array(r["one"]) / r["n"], np.zeros((k, k))
        for (i, j), v in zip(pairs, r["two"], strict=True):
            b[i, j] = b[j, i] = v / r["n"]
        axis = np.linalg.eigh(b - np.outer(mu, mu))[1][:, -1]
        axes += [F.lit(r["field_name"]), F.array(*[F.lit(float(v)) for v in axis * (1 if axis[np.abs(axis).argmax()] > 0 else -1)])]
    if not axes:
        return means.select("field_name", "text", F.lit(0.0).alias("code"))
    along = F.zip_with("m", F.element_at(F.create_map(*axes), F.col("field_name")), lambda p, q: p * q)
    return means.select("field_name", "text", F.aggregate(along, F.lit(0.0), lambda s, v: s + v).alias("code"))


def impute(df: DataFrame, row_id: str, numeric: dict[str, Column], categorical: dict[str, Column], features: dict[str, Column], groups: dict[str, list[Column | None]], fit_group: Column, ridge: float = 1.0, prior: float = 30.0) -> DataFrame:
    """One row per missing cell: row_id, field_name, value_num, value_text, donor_id, level.

    ``numeric`` and ``categorical`` give each field's usable value, null where it is missing.
    ``features`` are numbers (null: the mean is taken), ``fit_group`` the group whose regression
    predicts. ``groups[field]`` lists group keys from the closest to the widest; a null key means that a
    row has no such group, and all rows form the last group of every field.

    Predictive mean matching: a ridge regression per field and group, fitted on sums of products
    (combined map-side, a few dozen numbers a group) and shrunk towards the fit over all rows, predicts
    every row. A categorical field is coded by the means of its categories along the direction in which they differ most. A cell
    takes the observed value of the donor with the nearest prediction within the first group that has a
    donor; at equal distance the donor below. Donors are found by sorting predictions within groups, so
    no pairs are formed; groups of a large share of the rows are sorted range by range. Where a field
    has no observed value at all the cell still comes out, its value, donor and level null.
    """
    fields = [*numeric, *categorical]
    names = list(features)
    base = df.select(
        F.col(row_id).cast("bigint").alias("row_id"), F.coalesce(fit_group, F.lit("")).alias("fit_group"),
        *[c.alias(f"f_{n}") for n, c in features.items()],
        *[c.cast("double").alias(f"n_{n}") for n, c in numeric.items()], *[c.alias(f"t_{n}") for n, c in categorical.items()],
        *[(g if g is not None else F.lit(None)).cast("string").alias(f"g_{f}_{i}") for f in fields for i, g in enumerate(groups[f])],
    )
    scale = base.agg(*[x for n in names for x in (F.avg(f"f_{n}").alias(f"m_{n}"), F.stddev_pop(f"f_{n}").alias(f"s_{n}"))]).first()
    z = lambda n: F.coalesce((F.col(f"f_{n}") - F.lit(scale[f"m_{n}"] or 0.0)) / F.lit(scale[f"s_{n}"] or 1.0), F.lit(0.0))
    x = [F.lit(1.0), *[z(n) for n in names]]
    base = base.withColumn("x", F.array(*x))
    depth = max(len(g) for g in groups.values()) + 1

    def cell(f: str) -> Column:
        num, text = (F.col(f"n_{f}"), F.lit(None).cast("string")) if f in numeric else (F.lit(None).cast("double"), F.col(f"t_{f}"))
        keys = [F.col(f"g_{f}_{i}") for i in range(len(groups[f]))] + [F.lit(None).cast("string")] * (depth - 1 - len(groups[f])) + [F.lit("")]
        return F.struct(F.lit(f).alias("field_name"), num.alias("num"), text.alias("text"), F.array(*keys).alias("keys"))

    cells = base.select("row_id", "fit_group", "x", F.explode(F.array(*[cell(f) for f in fields])).alias("c")).select("row_id", "fit_group", "x", "c.*")
    cells = cells.join(_codes(cells, len(names)), ["field_name", "text"], "left").withColumn("y", F.coalesce("num", "code"))

    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    at = lambda i: F.col("x")[i]
    sums = lambda d: d.agg(F.array(*[F.sum(at(i) * at(j)) for i, j in pairs], *[F.sum(at(i) * F.col("y")) for i in range(len(x))]).alias("stats"))
    seen = cells.where("y is not null")
    overall = {r["field_name"]: r["stats"] for r in sums(seen.groupBy("field_name")).collect()}  # one row a field
    fit = _Fit(len(names), ridge, prior, {f: overall.get(f) or [0.0] * (len(pairs) + len(x)) for f in fields})
    fits = sums(seen.groupBy("field_name", "fit_group")).mapInPandas(fit, "field_name string, fit_group string, beta array<double>")
    general = F.create_map(*[c for f in fields for c in (F.lit(f), F.array(*[F.lit(b) for b in fit.beta(f, None)]))])
    fallback = F.element_at(general, F.col("field_name"))
    dot = F.aggregate(F.zip_with("x", F.coalesce("beta", fallback), lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    predicted = cells.join(fits, ["field_name", "fit_group"], "left").withColumn("pred", dot).select("row_id", "field_name", "num", "text", "y", "keys", "pred")
    predicted = cut(predicted)  # read twice

    donor = F.struct(F.col("pred").alias("p"), F.col("row_id").alias("id"), F.col("num").alias("num"), F.col("text").alias("text"))
    spread = (
        predicted.withColumn("donor", F.when(F.col("y").isNotNull(), donor))
        .select("row_id", "field_name", "pred", "donor", F.posexplode("keys").alias("level", "group"))
        .where("group is not null")
    )
    keys = ["field_name", "level", "group"]
    near = neighbours(spread, keys, "pred", {"prev_d": "donor", "next_d": "donor"}, quantile_cuts(spread, keys, "pred")).where("donor is null")
    gap = lambda c: F.abs(F.col("pred") - F.col(f"{c}.p"))
    best = F.when(F.col("next_d").isNull() | (gap("prev_d") <= gap("next_d")), F.col("prev_d")).otherwise(F.col("next_d"))
    best = F.coalesce(best, F.col("next_d"))
    picked = near.withColumn("best", best).groupBy("row_id", "field_name").agg(F.min_by(F.struct("best", "level"), F.when(F.col("best").isNotNull(), F.col("level"))).alias("m"))
    return picked.select("row_id", "field_name", F.col("m.best.num").alias("value_num"), F.col("m.best.text").alias("value_text"), F.col("m.best.id").alias("donor_id"), F.when(F.col("m.best").isNotNull(), F.col("m.level")).alias("level"))


def impute_nodes(nodes: DataFrame) -> DataFrame:
    """The missing cells of trailing_pe, gross_margin, sector and industry, filled (see impute).

    Groups from close to wide: the company itself (its other rows), its industry or sector, all.
    """
    sector, industry, company = known_text("sector"), known_text("industry"), company_key("name")
    log = lambda c: F.when((F.col(c) > 0) & ~F.isnan(c) & (F.col(c) < 1e18), F.log(F.col(c)))
    features = {c: log(c) for c in ("market_cap", "total_revenue", "forward_pe", "price_to_book", "current_price", "employees")}
    both = F.concat_ws("\x01", sector, industry)
    close = F.when(sector.isNotNull() & industry.isNotNull(), both)
    return impute(
        nodes, "id",
        numeric={"trailing_pe": known_number("trailing_pe", 0, 1000, open_lo=True, open_hi=True), "gross_margin": known_number("gross_margin", -1, 1)},
        categorical={"sector": sector, "industry": industry},
        features=features,
        groups={"trailing_pe": [company, close, sector], "gross_margin": [company, close, sector], "sector": [company, industry, None], "industry": [company, sector, None]},
        fit_group=sector,
    )


def fill_nodes(nodes: DataFrame, filled: DataFrame | None = None) -> DataFrame:
    """Every row of ``nodes`` with the four fields filled, and for each field a mark, a donor id and a level.

    All other columns stay. A usable value is kept as it is. Ids must be unique.
    """
    cells = impute_nodes(nodes) if filled is None else filled
    fields = {"trailing_pe": "value_num", "gross_margin": "value_num", "sector": "value_text", "industry": "value_text"}
    one = lambda f, c: F.max(F.when(F.col("field_name") == f, F.col(c)))
    wide = cells.groupBy(F.col("row_id").alias("id")).agg(*[
        x for f, v in fields.items() for x in (one(f, v).alias(f"__v_{f}"), F.max(F.col("field_name") == f).alias(f"__m_{f}"), one(f, "donor_id").alias(f"{f}_donor"), one(f, "level").alias(f"{f}_level"))
    ])
    out = nodes.join(wide, "id", "left")
    for f in fields:
        out = out.withColumn(f"{f}_filled", F.coalesce(f"__m_{f}", F.lit(False))).withColumn(f, F.when(F.col(f"{f}_filled"), F.col(f"__v_{f}")).otherwise(F.col(f)))
    return out.drop(*[f"__{m}_{f}" for f in fields for m in "vm"])

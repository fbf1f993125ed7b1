"""Screener queries and the nested document by sector."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_number, date_label, or_default
from .graph import links
from .resolve import substring_matches
from .skew import ranked

#: Columns that a table can be sorted by; texts ascend first, numbers descend.
SORTABLE = ("name", "ticker", "current_price", "percent_change", "market_cap", "trailing_pe")


#: Names of the document's company fields where they differ from the columns'.
RENAMED = {"current_price": "price", "percent_change": "change", "dividend_yield": "dividend", "fifty_two_week_high": "high_52w", "fifty_two_week_low": "low_52w", "total_revenue": "revenue", "gross_margin": "margin", "ceo_name": "ceo", "business_summary": "summary"}


def eligible(nodes: DataFrame, positive: tuple[str, ...] = ("market_cap",), there: tuple[str, ...] = ("current_price",), without: tuple[str, ...] = ()) -> DataFrame:
    """Rows whose ``positive`` numbers are above 0, whose numbers ``there`` are neither null, NaN nor 0, and whose sector is not in ``without``; a null or empty sector counts as Uncategorized."""
    keep = or_default("sector", "Uncategorized").isin(*without) == F.lit(False) if without else F.lit(True)
    for c in positive:
        keep = keep & (F.col(c) > 0) & ~F.isnan(c)
    for c in there:
        keep = keep & (F.col(c) != 0) & ~F.isnan(c)
    return nodes.where(keep)


def document_fields(nodes: DataFrame) -> DataFrame:
    """company_fields under the document's names."""
    return company_fields(nodes).withColumnsRenamed(RENAMED)


def sector_grid(nodes: DataFrame) -> DataFrame:
    """(sector, n_companies), null and '' as 'Uncategorized'."""
    return nodes.groupBy(or_default("sector", "Uncategorized").alias("sector")).agg(F.count(F.lit(1)).alias("n_companies"))


def order_by(column: str, descending: bool, collation: str | None = None) -> list[Column]:
    """Order with nulls last in both directions; NaN counts as null; ties by id. ``collation`` sorts texts as people do."""
    c = F.col(column) if column in ("name", "ticker", "sector") else clean_number(column)
    if collation and column in ("name", "ticker", "sector"):
        c = F.collate(c, collation)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col("id").asc()]


def sort_table(nodes: DataFrame, column: str, descending: bool, collation: str | None = None) -> DataFrame:
    """All rows of a table in a total order, as a range-partitioned sort."""
    return nodes.orderBy(*order_by(column, descending, collation))


def positions_in_sector(nodes: DataFrame) -> DataFrame:
    """(id, sector, by_<column>): the place of each company in its sector's table under each sortable column's first direction; ids are unique.

    Each ranking is a range-partitioned sort, so that a sector of any size is no task of its own.
    """
    out = nodes.select("id", "sector")
    for c in SORTABLE:
        places = ranked(nodes.select("id", "sector", c), ["sector"], order_by(c, c not in ("name", "ticker")), f"by_{c}").select("id", f"by_{c}")
        out = out.join(places, "id")
    return out


def searches(nodes: DataFrame, terms: DataFrame, least: int = 2) -> DataFrame:
    """(term, id): the rows that each term of ``terms`` finds (see search), all terms at once, by the rarest piece that they share."""
    found = substring_matches(terms.select(F.col("term").alias("mention"), F.lower("term").alias("low")).where(F.length("term") >= least), nodes.select("id", "name", "ticker"))
    return found.select(F.col("mention").alias("term"), "id").distinct()


def search(nodes: DataFrame, term: str, least: int = 2) -> DataFrame:
    """Rows whose name or ticker contains the term literally, case ignored and blanks kept; a shorter term finds nothing."""
    if len(term) < least:
        return nodes.where(F.lit(False))
    t = F.lit(term.lower())
    return nodes.where(F.contains(F.lower("name"), t) | F.coalesce(F.contains(F.lower("ticker"), t), F.lit(False)))


def typeahead(nodes: DataFrame, term: str, k: int = 10) -> DataFrame:
    """The first k matches by id of a trimmed term."""
    return search(nodes, term.strip(), 1).orderBy("id").limit(k)


def company_fields(nodes: DataFrame) -> DataFrame:
    """Flat projection of the document's company fields: finite numbers, defaults for null and '', dates as text."""
    numbers = ("current_price", "market_cap", "enterprise_value", "trailing_pe", "forward_pe", "price_to_book", "fifty_two_week_high", "fifty_two_week_low", "total_revenue", "gross_margin", "target_price")
    return nodes.select(
        "id", "name", "ticker", or_default("sector", "Uncategorized").alias("sector"), or_default("industry", "N/A").alias("industry"),
        *[clean_number(c).alias(c) for c in numbers], F.coalesce(clean_number("percent_change"), F.lit(0.0)).alias("percent_change"),
        or_default("dividend_yield", "N/A").alias("dividend_yield"), or_default("recommendation", "N/A").alias("recommendation"), or_default("ceo_name", "N/A").alias("ceo_name"),
        "employees", or_default("business_summary", "No summary available.").alias("business_summary"), date_label("last_updated").alias("last_updated"),
    )


def sector_parts(nodes: DataFrame, edges: DataFrame, linked: DataFrame | None = None, rows_per_part: int = 500) -> DataFrame:
    """(sector, part, json): the document's sectors, each cut into parts of about ``rows_per_part`` companies in id order.

    A company carries its upstream and downstream links in edge order, [] when none; those of one company form one array,
    as the document requires. A part is one JSON array, so no sector has to fit one row. Links lead to ``linked``, which are
    ``nodes`` themselves by default.
    """
    there = nodes if linked is None else linked
    one = lambda d: links(there, edges, d).groupBy("node_id", F.floor(F.col("edge_id") / 1_000_000).alias("span")).agg(F.array_sort(F.collect_list(F.struct("edge_id", "name", "ticker", "type"))).alias("l")).groupBy("node_id").agg(F.transform(F.flatten(F.array_sort(F.collect_list("l"))), lambda x: F.struct(x["name"].alias("name"), x["ticker"].alias("ticker"), x["type"].alias("type"))).alias(d))
    base = document_fields(nodes).join(one("upstream").withColumnRenamed("node_id", "id"), "id", "left").join(one("downstream").withColumnRenamed("node_id", "id"), "id", "left")
    empty = F.array().cast("array<struct<name:string,ticker:string,type:string>>")
    base = base.withColumns({d: F.coalesce(d, empty) for d in ("upstream", "downstream")})
    fields = [c for c in base.columns if c not in ("sector",)]
    part = F.floor(F.col("id") / rows_per_part).alias("part")
    return base.groupBy("sector", part).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields))), {"ignoreNullFields": "false"}).alias("json"))

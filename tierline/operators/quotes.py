"""Merge of landed quote payloads (nested JSON, one a ticker) into stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merge import json_value

#: Column -> path of the payload. These take what the payload has, null included.
REPLACED = {
    "trailing_pe": "summaryDetail.trailingPE", "forward_pe": "summaryDetail.forwardPE",
    "fifty_two_week_high": "summaryDetail.fiftyTwoWeekHigh", "fifty_two_week_low": "summaryDetail.fiftyTwoWeekLow",
    "enterprise_value": "defaultKeyStatistics.enterpriseValue", "price_to_book": "defaultKeyStatistics.priceToBook",
    "total_revenue": "financialData.totalRevenue", "gross_margin": "financialData.grossMargins", "target_price": "financialData.targetMeanPrice",
    "employees": "assetProfile.fullTimeEmployees", "business_summary": "assetProfile.longBusinessSummary",
}
PRICE, CAP, OPEN = "price.regularMarketPrice", "price.marketCap", "price.regularMarketOpen"
DIVIDEND, ADVICE, OFFICERS = "summaryDetail.dividendYield", "financialData.recommendationKey", "assetProfile.companyOfficers"


def fixed_places(x: Column, places: int = 2) -> Column:
    """The number with so many decimals, halves of the exact binary value to even, without grouping."""
    return F.regexp_replace(F.format_number(x, places), ",", "")


def capitalised(x: Column) -> Column:
    """'strong_buy' as 'Strong Buy'."""
    return F.initcap(F.regexp_replace(x, "_", " "))


def merge_quotes(rows: DataFrame, quotes: DataFrame, now: Column | None = None, default: str = "Uncategorized", key: str = "ticker") -> DataFrame:
    """``rows`` with what their quote (``key``, payload) says; columns and types stay.

    A payload that is no JSON object (an error text) leaves the row alone; a missing one counts as an empty object.
    Price and cap are taken together, where the price's key is there, null included. The change in percent needs a price and
    an open that are neither null nor 0; an open whose key is missing is 1; else the old change stays. A null or zero
    dividend is 'N/A'. The recommendation and the first officer's name only replace where there is one, an officer without a
    name is 'N/A'. Sector and industry are ``default`` where their key is missing, null where it is null. All else is
    replaced, null included. With ``now`` rows that a quote touched take it as last_updated. Keys of ``quotes`` are
    unique; rows with a null key meet no quote and are left alone.
    """
    q = quotes.where(F.col(key).isNotNull()).select(F.col(key).alias("__key"), F.coalesce("payload", F.lit("null")).alias("__p"))
    joined = rows.join(q, rows[key] == F.col("__key"), "left")
    p = F.coalesce("__p", F.lit("{}"))
    touched = F.col(key).isNotNull() & F.json_object_keys(p).isNotNull()
    kind = {f.name: f.dataType for f in rows.schema.fields}
    number = lambda path: json_value(p, path)[1].try_cast("double")
    priced = json_value(p, PRICE)[0]
    price, has_open, cap = number(PRICE), json_value(p, OPEN)[0], number(CAP)
    opened = F.when(has_open, number(OPEN)).otherwise(F.lit(1.0))
    dividend, advice = number(DIVIDEND), json_value(p, ADVICE)[1]
    officers = F.from_json(F.get_json_object(p, f"$.{OFFICERS}"), "array<struct<name:string>>")
    named = lambda c, path: F.when(json_value(p, path)[0], json_value(p, path)[1]).otherwise(F.lit(default))
    new = {c: json_value(p, path)[1].try_cast(kind[c]) for c, path in REPLACED.items() if c in kind} | {
        "current_price": F.when(priced, price).otherwise(F.col("current_price")),
        "market_cap": F.when(priced, cap).otherwise(F.col("market_cap")),
        "percent_change": F.when(priced & (price != 0) & (opened != 0), (price - opened) / opened * 100).otherwise(F.col("percent_change")),
        "dividend_yield": F.when(dividend != 0, F.concat(fixed_places(dividend * 100), F.lit("%"))).otherwise(F.lit("N/A")),
        "recommendation": F.when(advice != "", capitalised(advice)).otherwise(F.col("recommendation")),
        "ceo_name": F.when(F.size(officers) > 0, F.coalesce(officers[0]["name"], F.lit("N/A"))).otherwise(F.col("ceo_name")),
        "sector": named("sector", "assetProfile.sector"), "industry": named("industry", "assetProfile.industry"),
    }
    if now is not None:
        new["last_updated"] = now.cast(kind["last_updated"])
    return joined.withColumns({c: F.when(touched, v).otherwise(F.col(c)).cast(kind[c]) for c, v in new.items() if c in kind}).select(*rows.columns)


def rejects(quotes: DataFrame) -> DataFrame:
    """The quotes whose payload is there but no JSON object."""
    return quotes.where(F.col("payload").isNotNull() & F.json_object_keys("payload").isNull())

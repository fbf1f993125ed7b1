"""Text and number expressions."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space as Unicode and Python have it, spelt out as engines differ in what \s covers.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Phrases from which the rest of the line is cut, and patterns that are deleted one after the other.
CUT_FROM = ("American Depositary", "ADR", "Sponsored ADR", "Unsponsored ADR", "Representing", "Each representing")
DELETED = (
    r"\bInc\.?\b", r"\bCorp\.?\b", r"\bCorporation\b", r"\bCompany\b", r"\bLLC\b", r"\bPlc\b", r"\bLtd\.?\b", r"\bCommon Stock\b",
    r"\bClass A\b", r"\bClass B\b", r"\bOrdinary Shares\b", r"\bTrust\b", r"\bHoldings\b", r"\bHolding\b", r"\bGroup\b", r"\bS A\b", r"\bAG\b",
)


def clean_number(c: str) -> Column:
    """The number, or null for NaN and infinities."""
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def or_default(c: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(default))


def clean_company_name(c: str, cut_from: tuple[str, ...] = CUT_FROM, deleted: tuple[str, ...] = DELETED) -> Column:
    """A company name without share-class tails, brackets, legal forms and commas.

    Everything from the first of ``cut_from`` to the end of its line goes, then (...) , then each of
    ``deleted`` in turn; case is ignored and inner double blanks stay.
    """
    out = F.regexp_replace(F.col(c), f"(?i)({'|'.join(cut_from)})[^\\n]*", "")
    out = F.regexp_replace(out, r"\(.*?\)", "")
    for w in deleted:
        out = F.regexp_replace(out, f"(?i){w}", "")
    return F.trim(F.regexp_replace(out, ",", ""))


def collapse_space(c: str) -> Column:
    return F.trim(F.regexp_replace(F.col(c), f"{SPACE}+", " "))


def section_windows(c: str, words: list[str], width: int = 2500) -> Column:
    """For each word that occurs, ``width`` characters from its first place, put together in the list's order."""
    return F.concat(*[F.when(F.locate(w, F.col(c)) > 0, F.substring(F.col(c), F.locate(w, F.col(c)), F.lit(width))).otherwise(F.lit("")) for w in words])


def confidence(c: str) -> Column:
    """A confidence typed on the scale 0-1, 1-10 or 10-100, on the scale 0-1; exactly 10 is ten of ten."""
    x = F.col(c)
    return F.when(x > 10, x / 100).when(x > 1, x / 10).otherwise(x)


def title_words(c: str) -> Column:
    """'strong_buy' as 'Strong Buy'; blank is null."""
    return F.nullif(F.initcap(F.regexp_replace(F.col(c), "_", " ")), F.lit(""))


def _fixed(x: Column) -> Column:
    return F.regexp_replace(F.format_number(x, 2), ",", "")


def humanise(c: str, kind: str = "currency") -> Column:
    """A label for a number: $1.50T, $2.00B, $3.25M, else $ and grouped digits; 'percent' of a share; 'ratio'; null, NaN and infinities are N/A."""
    x = F.col(c).cast("double")
    if kind == "percent":
        label = F.concat(_fixed(x * 100), F.lit("%"))
    elif kind == "ratio":
        label = _fixed(x)
    else:
        label = F.lit(None).cast("string")
        plain = F.concat(F.lit("$"), F.regexp_replace(F.regexp_replace(F.format_number(x, 3), r"(\.\d*?)0+$", "$1"), r"\.$", ""))
        big = lambda unit, sign: F.concat(F.lit("$"), _fixed(x / unit), F.lit(sign))
        label = F.when(x >= 1e12, big(1e12, "T")).when(x >= 1e9, big(1e9, "B")).when(x >= 1e6, big(1e6, "M")).otherwise(plain)
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit("N/A")).otherwise(label)


def signed_percent(c: str) -> Column:
    x = F.coalesce(F.col(c), F.lit(0.0))
    return F.concat(F.when(x > 0, F.lit("+")).otherwise(F.lit("")), _fixed(x), F.lit("%"))


def money(c: str) -> Column:
    """A price with two decimals; null and NaN are $0.00."""
    x = F.col(c).cast("double")
    return F.concat(F.lit("$"), _fixed(F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x)))


def grouped(c: str) -> Column:
    """A whole number with grouped digits; null and 0 are N/A."""
    return F.when(F.col(c) != 0, F.format_number(F.col(c), 0)).otherwise(F.lit("N/A"))


def date_label(c: str) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("N/A"))


def paragraphs_simple(c: str) -> Column:
    """Text between <p> and the next </p>, tags dropped, joined by one blank and with white space collapsed."""
    inner = F.regexp_extract_all(F.col(c), F.lit(r"(?is)<p\b[^>]*>(.*?)</p>"), F.lit(1))
    return F.trim(F.regexp_replace(F.regexp_replace(F.array_join(inner, " "), r"<[^>]*>", ""), f"{SPACE}+", " "))


class _Paragraphs(HTMLParser):
    """Text of every <p> element; one that is not closed holds those that follow."""

    def __init__(self) -> None:
        super().__init__()
        self.open: list[tuple[str, int]] = []
        self.texts: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in ("br", "img", "hr", "meta", "link", "input"):
            return
        self.open.append((tag, len(self.texts) if tag == "p" else -1))
        if tag == "p":
            self.texts.append([])

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        for tag, at in self.open:
            if tag == "p":
                self.texts[at].append(data)


def paragraph_text(html: str | None) -> str | None:
    if html is None:
        return None
    p = _Paragraphs()
    p.feed(html)
    p.close()
    return re.sub(r"\s+", " ", " ".join("".join(t) for t in p.texts)).strip()


@F.pandas_udf(T.StringType())
def paragraphs(html: pd.Series) -> pd.Series:
    """Paragraph text by an HTML parser; null stays null, broken markup gives what can be read."""
    return html.map(paragraph_text)

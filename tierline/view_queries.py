"""Queries of the exported document and its views, quote merges, curated links and landed connectors, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .functions import text as X
from .graph_queries import _DEFAULT, _NUM, _ROSTER, FLOOR, LATE, QUERIES, SECTIONS, SQL, _by_name, _mentions, _roster, query, table
from .operators import graph, merge, quotes, resolve, screener
from .operators.skew import ranked
from .sources import curated
from .sources.connectors import first_answered, prompt, replayed
from .sources.io import parse_extraction

__all__ = ["QUERIES", "SQL"]

#: Sectors left out of the document, and of the research queue: parameters of these queries.
NOT_EXPORTED = ("Shell Companies", "Uncategorized", "Financial Services", "Real Estate")
NOT_QUEUED = ["Financial Services", "Real Estate", "Financial", "Asset Management", "Insurance", "Banks", "Shell Companies"]
#: Start of the period in which a company must have a verified link not to count as lonely.
RECENT = "2026-01-24 00:00:00"

_quoted = lambda xs: ", ".join(f"'{x}'" for x in xs)
_EXPORTED = f"exported AS (SELECT * FROM nodes WHERE market_cap > 0 AND NOT isnan(market_cap) AND current_price <> 0 AND NOT isnan(current_price) AND coalesce(nullif(sector, ''), 'Uncategorized') NOT IN ({_quoted(NOT_EXPORTED)}))"


def _exported(s, d):
    return screener.eligible(table(s, d, "nodes"), without=NOT_EXPORTED)


# research queue
_LONELY = f"SELECT id, name, market_cap FROM nodes n WHERE market_cap > 1e9 AND NOT isnan(market_cap) AND sector NOT IN ({_quoted(NOT_QUEUED)}) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.last_verified >= TIMESTAMP '{RECENT}' AND (e.source_id = n.id OR e.target_id = n.id))"


def _recent(s, d):
    return table(s, d, "edges").where(F.col("last_verified") >= F.lit(RECENT).cast("timestamp_ntz"))


@query(_LONELY + " ORDER BY market_cap DESC, id LIMIT 25")
def lonely_since(s, d):
    """The largest companies without a link verified in the period."""
    return graph.lonely_nodes(table(s, d, "nodes"), _recent(s, d), FLOOR, 25, without=NOT_QUEUED).select("id", "name", "market_cap")


@query(_LONELY)
def lonely_since_all(s, d):
    return graph.lonely_nodes(table(s, d, "nodes"), _recent(s, d), FLOOR, without=NOT_QUEUED).select("id", "name", "market_cap")


@query("SELECT id, CAST(count(*) AS BIGINT) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges WHERE source_id IS DISTINCT FROM target_id) WHERE id IS NOT NULL GROUP BY id")
def degrees(s, d):
    return graph.degrees(table(s, d, "edges"))


@query(
    "WITH c AS (SELECT id FROM nodes WHERE id % 50 = 0), p AS (SELECT source_id AS a, target_id AS b FROM edges UNION SELECT target_id, source_id FROM edges) "
    "SELECT DISTINCT chosen_id, id FROM (SELECT c.id AS chosen_id, p.b AS id FROM c JOIN p ON p.a = c.id UNION ALL SELECT id, id FROM c) WHERE id IN (SELECT id FROM nodes)"
)
def neighbourhoods(s, d):
    """Of every node whose id is divisible by 50."""
    n = table(s, d, "nodes")
    return graph.neighbourhoods(n, table(s, d, "edges"), n.where("id % 50 = 0"))


@query("WITH t AS (SELECT DISTINCT name AS term FROM nodes WHERE id % 50 = 0) SELECT DISTINCT term, id FROM t JOIN nodes ON length(term) >= 2 AND (contains(lower(nodes.name), lower(term)) OR contains(lower(ticker), lower(term)))")
def searches(s, d):
    """The name of every node whose id is divisible by 50, sought among all."""
    n = table(s, d, "nodes")
    return screener.searches(n, n.where("id % 50 = 0").select(F.col("name").alias("term")).distinct())


# the document and its views
_FIELDS = {
    "current_price": "price", "market_cap": "market_cap", "enterprise_value": "enterprise_value", "trailing_pe": "trailing_pe", "forward_pe": "forward_pe", "price_to_book": "price_to_book",
    "fifty_two_week_high": "high_52w", "fifty_two_week_low": "low_52w", "total_revenue": "revenue", "gross_margin": "margin", "target_price": "target_price",
}
_DOCUMENT = ", ".join(f"{_NUM.format(c)} AS {n}" for c, n in _FIELDS.items())
_TEXTS = _DEFAULT.replace("AS dividend_yield", "AS dividend").replace("AS ceo_name", "AS ceo").replace("AS business_summary", "AS summary")


@query(f"WITH {_EXPORTED} SELECT id, name, ticker, {_TEXTS}, {_DOCUMENT}, coalesce({_NUM.format('percent_change')}, 0.0) AS change, employees, coalesce(strftime(last_updated, '%Y-%m-%d'), 'N/A') AS last_updated FROM exported")
def export_eligible(s, d):
    return screener.document_fields(_exported(s, d))


_SIDE = "WITH {0} SELECT x.id, e.id AS edge_id, n.name, coalesce(n.ticker, '') AS ticker, e.dependency_type AS type FROM exported x JOIN edges e ON e.{1} = x.id JOIN nodes n ON n.id = e.{2}"


def _side(s, d, way):
    ids = _exported(s, d).select(F.col("id").alias("node_id"))
    return graph.links(table(s, d, "nodes"), table(s, d, "edges"), way).join(ids, "node_id").withColumnRenamed("node_id", "id")


@query(_SIDE.format(_EXPORTED, "target_id", "source_id"))
def export_upstream(s, d):
    return _side(s, d, "upstream")


@query(_SIDE.format(_EXPORTED, "source_id", "target_id"))
def export_downstream(s, d):
    return _side(s, d, "downstream")


def _document(s, d):
    return screener.sector_parts(_exported(s, d), table(s, d, "edges"), table(s, d, "nodes"))


@query()
def export_document(s, d):
    return _document(s, d)


@query(
    f"WITH {_EXPORTED}, up AS (SELECT e.target_id AS id, count(*) AS n FROM edges e JOIN nodes n ON n.id = e.source_id GROUP BY 1), down AS (SELECT e.source_id AS id, count(*) AS n FROM edges e JOIN nodes n ON n.id = e.target_id GROUP BY 1) "
    "SELECT coalesce(nullif(sector, ''), 'Uncategorized') AS sector, x.id, name, coalesce(up.n, 0) AS n_upstream, coalesce(down.n, 0) AS n_downstream FROM exported x LEFT JOIN up ON up.id = x.id LEFT JOIN down ON down.id = x.id"
)
def export_document_read_back(s, d):
    """The document, parsed and taken apart again."""
    link = "array<struct<name:string,ticker:string,type:string>>"
    rows = _document(s, d).select("sector", F.explode(F.from_json("json", f"array<struct<id:bigint,name:string,upstream:{link},downstream:{link}>>")).alias("c"))
    return rows.select("sector", "c.id", "c.name", *[F.size(f"c.{w}").cast("bigint").alias(f"n_{w}") for w in ("upstream", "downstream")])


@query(
    "SELECT 'node' AS kind, id, CAST(id AS VARCHAR) AS key, name AS a, entity_type AS b, CAST(hierarchy_level AS VARCHAR) AS c FROM nodes "
    "UNION ALL SELECT 'edge', id, 'e_' || id, CAST(source_id AS VARCHAR), CAST(target_id AS VARCHAR), dependency_type FROM edges"
)
def flat_graph_read_back(s, d):
    """The flat graph document, parsed and taken apart again."""
    data = F.from_json("json", "struct<data:struct<id:string,name:string,type:string,level:int,source:string,target:string,label:string>>")["data"]
    g = graph.flat_graph(table(s, d, "nodes"), table(s, d, "edges")).withColumn("x", data)
    return g.select("kind", "id", F.col("x.id").alias("key"), F.coalesce("x.name", "x.source").alias("a"), F.coalesce("x.type", "x.target").alias("b"), F.coalesce(F.col("x.level").cast("string"), "x.label").alias("c"))


@query(f"WITH {_EXPORTED} SELECT coalesce(nullif(sector, ''), 'Uncategorized') AS sector, count(*) AS n_companies, row_number() OVER (ORDER BY coalesce(nullif(sector, ''), 'Uncategorized')) AS place FROM exported GROUP BY 1")
def export_sector_grid(s, d):
    """Sector cards in code-unit order; as many rows as sectors."""
    return screener.sector_grid(_exported(s, d)).withColumn("place", F.row_number().over(W.orderBy("sector")).cast("bigint"))


@query(f"WITH {_EXPORTED} SELECT id, name, ticker, market_cap, row_number() OVER (ORDER BY market_cap DESC NULLS LAST, id) AS place FROM exported WHERE sector = 'Technology'")
def sector_table(s, d):
    """One sector's table in the default order, with the place of each row."""
    rows = _exported(s, d).where("sector = 'Technology'").select("id", "name", "ticker", "market_cap")
    return ranked(rows, [], screener.order_by("market_cap", True), "place")


@query(f"WITH {_EXPORTED} SELECT id, name, count(*) OVER () AS n_found FROM exported WHERE contains(lower(name), 'steel') OR contains(lower(ticker), 'steel')")
def export_search(s, d):
    """The search over exported companies with the number of hits."""
    found = screener.search(_exported(s, d), "Steel").select("id", "name")
    return found.crossJoin(F.broadcast(found.agg(F.count(F.lit(1)).alias("n_found"))))  # one row


_FIX = lambda x: f"printf('%.2f', {x})"
_CAP = f"CASE WHEN NOT coalesce(isfinite({{0}}), false) THEN 'N/A' WHEN {{0}} >= 1e12 THEN '$' || {_FIX('{0} / 1e12')} || 'T' WHEN {{0}} >= 1e9 THEN '$' || {_FIX('{0} / 1e9')} || 'B' WHEN {{0}} >= 1e6 THEN '$' || {_FIX('{0} / 1e6')} || 'M' ELSE '' END"
_MONEY = lambda c: f"'$' || {_FIX(f'CASE WHEN {c} IS NULL OR isnan({c}) THEN 0.0 ELSE {c} END')}"
_CHANGE = lambda c: f"CASE WHEN coalesce({c}, 0.0) > 0 THEN '+' ELSE '' END || {_FIX(f'coalesce({c}, 0.0)')} || '%'"


@query(
    f"SELECT id, {_MONEY('current_price')} AS price, {_CHANGE('percent_change')} AS change, CASE WHEN coalesce(percent_change, 0.0) >= 0 THEN 'positive' ELSE 'negative' END AS tone, {_CAP.format('market_cap')} AS cap, {_CAP.format('total_revenue')} AS revenue, "
    f"CASE WHEN NOT coalesce(isfinite(gross_margin), false) THEN 'N/A' ELSE {_FIX('gross_margin * 100')} || '%' END AS margin, CASE WHEN NOT coalesce(isfinite(trailing_pe), false) THEN 'N/A' ELSE {_FIX('trailing_pe')} END AS pe, "
    "CASE WHEN employees <> 0 THEN format('{:,}', employees) ELSE 'N/A' END AS employees, coalesce(nullif(industry, ''), 'Uncategorized') AS industry FROM nodes"
)
def detail_panel(s, d):
    """Labels of a company's panel; amounts under a million, whose grouping SQL lacks, are left blank here."""
    big = lambda c: F.when((F.col(c) < 1e6) & ~F.isnan(c), F.lit("")).otherwise(X.humanise(c))
    tone = F.when(F.coalesce("percent_change", F.lit(0.0)) >= 0, "positive").otherwise("negative")
    return table(s, d, "nodes").select(
        "id", X.money("current_price").alias("price"), X.signed_percent("percent_change").alias("change"), tone.alias("tone"), big("market_cap").alias("cap"), big("total_revenue").alias("revenue"),
        X.humanise("gross_margin", "percent").alias("margin"), X.humanise("trailing_pe", "ratio").alias("pe"), X.grouped("employees").alias("employees"), X.or_default("industry", "Uncategorized").alias("industry"),
    )


EMPTY = "No known downstream exposure tracked."


@query(
    f"WITH {_EXPORTED}, live AS (SELECT ticker, percent_change, row_number() OVER (PARTITION BY ticker ORDER BY sector NULLS FIRST, id) AS rn FROM exported WHERE ticker IS NOT NULL), "
    "l AS (SELECT x.id AS node_id, e.id AS edge_id, n.name, coalesce(n.ticker, '') AS ticker, e.dependency_type AS type FROM exported x JOIN edges e ON e.source_id = x.id JOIN nodes n ON n.id = e.target_id) "
    f"SELECT x.id AS node_id, l.edge_id, CASE WHEN l.edge_id IS NULL THEN '{EMPTY}' ELSE l.name || CASE WHEN l.ticker = '' THEN '' ELSE ' (' || l.ticker || ')' END END AS label, CASE WHEN v.rn = 1 THEN {_CHANGE('v.percent_change')} END AS live FROM exported x LEFT JOIN l ON l.node_id = x.id LEFT JOIN live v ON v.ticker = l.ticker AND v.rn = 1"
)
def xray_cards(s, d):
    """One card a link of each exported company, with the live change where the linked company is exported; a message where there is no link."""
    shown = _exported(s, d)
    cards = graph.links(table(s, d, "nodes"), table(s, d, "edges"), "downstream")
    first = W.partitionBy("ticker").orderBy(F.col("sector").asc_nulls_first(), "id")
    live = shown.where("ticker is not null").withColumn("rn", F.row_number().over(first)).where("rn = 1").select("ticker", X.signed_percent("percent_change").alias("live"))
    cards = cards.join(live, "ticker", "left")
    label = F.when(F.col("edge_id").isNull(), EMPTY).otherwise(F.concat("name", F.when(F.col("ticker") == "", "").otherwise(F.concat(F.lit(" ("), "ticker", F.lit(")")))))
    return shown.select(F.col("id").alias("node_id")).join(cards, "node_id", "left").select("node_id", "edge_id", label.alias("label"), "live")


# stored rows: quotes, roster, curated links
def _quotes(s, d):
    """Landed quotes made of the node snapshots: latest price, the first as open, with missing, null and error payloads among them."""
    snaps = table(s, d, "node_snapshots").where("last_updated is not null").groupBy("id").agg(*[F.max_by(c, F.struct("last_updated", "loaded_at", F.coalesce(c, F.lit(-1e300)))).alias(a) for c, a in (("current_price", "p"), ("market_cap", "c"))], F.min_by("current_price", F.struct("last_updated", "loaded_at", F.coalesce("current_price", F.lit(1e300)))).alias("o"))
    q = table(s, d, "nodes").where("ticker is not null").select("id", "ticker", "price_to_book", "gross_margin", "recommendation", "ceo_name").join(snaps, "id")
    k = F.col("id") % 8
    num = lambda c: F.coalesce(F.when(F.isnan(c), None).otherwise(F.col(c)).cast("string"), F.lit("null"))
    price = F.concat(F.lit('{"marketCap":'), num("c"), F.when(k == 0, "").otherwise(F.concat(F.lit(',"regularMarketPrice":'), num("p"))), F.when(k == 1, "").when(k == 2, ',"regularMarketOpen":null').otherwise(F.concat(F.lit(',"regularMarketOpen":'), num("o"))), F.lit("}"))
    fields = F.concat(F.lit('{"price":'), price, F.lit(',"defaultKeyStatistics":{"priceToBook":'), num("price_to_book"), F.lit('},"assetProfile":{'), F.when(k == 3, "").when(k == 4, '"sector":null,').otherwise('"sector":"Energy",'),
                      F.when(k == 5, '"companyOfficers":[]').when(k == 6, '"companyOfficers":[{"age":1}]').otherwise('"companyOfficers":[{"name":"A. Person"},{"name":"B"}]'), F.lit('},"financialData":{"recommendationKey":"'), F.when(k == 1, "").otherwise("strong_buy"), F.lit('"}}'))
    return q.where(k != 7).select("ticker", F.when(F.col("id") % 16 == 3, "Quote not found").otherwise(fields).alias("payload"))


_QUOTE = """WITH s AS (SELECT id, arg_max(struct_pack(v := current_price), (last_updated, loaded_at, coalesce(current_price, -1e300))).v AS p, arg_max(struct_pack(v := market_cap), (last_updated, loaded_at, coalesce(market_cap, -1e300))).v AS c,
  arg_min(struct_pack(v := current_price), (last_updated, loaded_at, coalesce(current_price, 1e300))).v AS o FROM node_snapshots WHERE last_updated IS NOT NULL GROUP BY id),
q AS (SELECT n.*, n.ticker IS NOT NULL AND NOT (s.id IS NOT NULL AND n.id % 8 <> 7 AND n.id % 16 = 3) AS touched, s.id IS NOT NULL AND n.id % 8 <> 7 AS there,
  CASE WHEN isnan(s.p) THEN NULL ELSE s.p END AS p, CASE WHEN isnan(s.c) THEN NULL ELSE s.c END AS c, CASE WHEN n.id % 8 = 1 THEN 1.0 WHEN n.id % 8 = 2 OR isnan(s.o) THEN NULL ELSE s.o END AS o FROM nodes n LEFT JOIN s ON s.id = n.id AND n.ticker IS NOT NULL)
"""


@query(
    _QUOTE + """SELECT id, CASE WHEN touched AND there AND id % 8 <> 0 THEN p ELSE current_price END AS current_price, CASE WHEN touched AND there AND id % 8 <> 0 THEN c ELSE market_cap END AS market_cap,
  CASE WHEN touched AND there AND id % 8 <> 0 AND p <> 0 AND o <> 0 THEN (p - o) / o * 100 ELSE percent_change END AS percent_change,
  CASE WHEN NOT touched THEN price_to_book WHEN there AND NOT isnan(price_to_book) THEN price_to_book END AS price_to_book, CASE WHEN NOT touched THEN trailing_pe END AS trailing_pe,
  CASE WHEN NOT touched THEN sector WHEN there AND id % 8 = 4 THEN NULL WHEN there AND id % 8 <> 3 THEN 'Energy' ELSE 'Uncategorized' END AS sector FROM q"""
)
def quote_merge(s, d):
    out = quotes.merge_quotes(table(s, d, "nodes"), _quotes(s, d))
    return out.select("id", "current_price", "market_cap", "percent_change", "price_to_book", "trailing_pe", "sector")


@query(
    _QUOTE + """SELECT id, CASE WHEN touched AND there AND id % 8 <> 1 THEN 'Strong Buy' ELSE recommendation END AS recommendation, CASE WHEN NOT touched OR NOT there OR id % 8 = 5 THEN ceo_name WHEN id % 8 = 6 THEN 'N/A' ELSE 'A. Person' END AS ceo_name,
  CASE WHEN touched THEN 'N/A' ELSE dividend_yield END AS dividend_yield, CASE WHEN touched THEN TIMESTAMP '2026-02-01' ELSE last_updated END AS last_updated FROM q"""
)
def quote_labels(s, d):
    out = quotes.merge_quotes(table(s, d, "nodes"), _quotes(s, d), F.lit("2026-02-01 00:00:00"))
    return out.select("id", "recommendation", "ceo_name", "dividend_yield", "last_updated")


@query("SELECT n.ticker FROM nodes n WHERE ticker IS NOT NULL AND id IN (SELECT id FROM node_snapshots WHERE last_updated IS NOT NULL) AND id % 8 <> 7 AND id % 16 = 3")
def quote_rejects(s, d):
    return quotes.rejects(_quotes(s, d)).select("ticker")


@query("SELECT id, ticker FROM nodes WHERE ticker IS NOT NULL ORDER BY id LIMIT 100")
def quote_queue(s, d):
    """The first hundred rows with a ticker, by id: one run of the update with its limit."""
    return table(s, d, "nodes").where("ticker is not null").orderBy("id").limit(100).select("id", "ticker")


_MERGED = _ROSTER + ", n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY arrival) AS k FROM kept WHERE symbol NOT IN (SELECT ticker FROM nodes WHERE ticker <> '')), m AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY arrival) AS j FROM n WHERE k = 1)"


@query(_MERGED + " SELECT symbol, name, 'Pending Update' AS sector, 'Company' AS entity_type FROM m WHERE j = 1 ORDER BY arrival LIMIT 20")
def roster_seeded(s, d):
    """The first new roster rows by arrival, with their constant columns."""
    new = merge.roster_merge(merge.roster_filter(_roster(s, d)), table(s, d, "nodes"), 20)
    return merge.seeded(new, sector="Pending Update", entity_type="Company").select("symbol", "name", "sector", "entity_type")


_PAIRS = "WITH hit AS (SELECT query_text, max(CASE WHEN hit_rank = 1 THEN symbol END) AS source, max(CASE WHEN hit_rank = 2 THEN symbol END) AS target FROM alias_hits GROUP BY query_text), t AS (SELECT ticker, min(id) AS id FROM nodes WHERE ticker IS NOT NULL GROUP BY ticker)"


@query(_PAIRS + " SELECT a.id AS source_id, b.id AS target_id, query_text AS dependency_type, 1.0::DOUBLE AS confidence_score, 'curated' AS source_url FROM hit JOIN t a ON a.ticker = hit.source JOIN t b ON b.ticker = hit.target WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.source_id = a.id AND e.target_id = b.id)")
def seed_edges(s, d):
    """Curated pairs of tickers, made of the first two hits of each search."""
    hit = lambda k: F.max(F.when(F.col("hit_rank") == k, F.col("symbol")))
    pairs = table(s, d, "alias_hits").groupBy(F.col("query_text").alias("type")).agg(hit(1).alias("source"), hit(2).alias("target"))
    return graph.insert_by_ticker(table(s, d, "nodes"), table(s, d, "edges"), pairs)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in curated.EDGES) + ") t(source, target, type)")
def curated_edges(s, d):
    return curated.curated_edges(s)


@query("WITH known AS (SELECT DISTINCT name FROM nodes) SELECT dep_id FROM dependencies WHERE source_company IS NULL OR target_company IS NULL OR source_company NOT IN (SELECT name FROM known WHERE name IS NOT NULL) OR target_company NOT IN (SELECT name FROM known WHERE name IS NOT NULL)")
def unresolved_links(s, d):
    return merge.unresolved(_by_name(s, d)).select("dep_id")


@query(
    "SELECT 'nodes' AS what, count(*) AS n FROM nodes UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'dependencies', count(*) FROM dependencies UNION ALL SELECT 'new edges', count(*) FROM edges e "
    f"WHERE last_verified >= TIMESTAMP '{LATE}'"
)
def row_counts(s, d):
    count = lambda what, df: df.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n"))
    e = table(s, d, "edges")
    parts = [count(x, table(s, d, x)) for x in ("nodes", "edges", "dependencies")] + [count("new edges", e.where(F.col("last_verified") >= F.lit(LATE).cast("timestamp_ntz")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# landed connectors and extraction
_ATTEMPTS = "SELECT id, 1 AS attempt, name || ' ' || ticker AS q FROM nodes UNION ALL SELECT id, 2, name FROM nodes UNION ALL SELECT id, 3, ticker FROM nodes"


@query(f"WITH a AS ({_ATTEMPTS}), best AS (SELECT query_text AS q, arg_min(symbol, (hit_rank, symbol)) AS symbol FROM alias_hits WHERE query_text IS NOT NULL GROUP BY query_text) SELECT id, CAST(min(attempt) AS INTEGER) AS attempt, arg_min(symbol, attempt) AS symbol FROM a JOIN best USING (q) GROUP BY id")
def first_answer(s, d):
    """Fallback searches of each company: the first wording that has landed hits."""
    attempts = [F.concat("name", F.lit(" "), "ticker"), F.col("name"), F.col("ticker")]
    return first_answered(table(s, d, "nodes"), "id", attempts, table(s, d, "alias_hits"))


_WINDOWS = " || ".join(f"CASE WHEN instr(text, '{w}') > 0 THEN substr(text, instr(text, '{w}'), 2500) ELSE '' END" for w in SECTIONS)


@query(
    f"WITH w AS (SELECT *, {_WINDOWS} AS win FROM documents WHERE ticker IS NOT NULL), p AS (SELECT ticker, arg_min(struct_pack(b := 'SOURCE: ENCYCLOPEDIA (Page: ' || coalesce(title, 'None') || ')' || chr(10) || 'DATA:' || chr(10) || CASE WHEN win = '' THEN coalesce(title, '') || chr(10) || coalesce(substr(text, 1, 3500), '') ELSE win END || chr(10)), doc_id).b AS page FROM w WHERE text IS NOT NULL GROUP BY ticker), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY published_at DESC NULLS LAST, doc_id) AS k FROM documents WHERE ticker IS NOT NULL), b AS (SELECT ticker, 'SOURCE: RECENT NEWS' || chr(10) || string_agg('- ' || coalesce(title, 'None') || ': ' || coalesce(text, 'None'), chr(10) ORDER BY k) AS news FROM r WHERE k <= 5 GROUP BY ticker), "
    "z AS (SELECT ticker, substr(coalesce(page, '') || news, 1, 6500) AS blob FROM b LEFT JOIN p USING (ticker)) SELECT ticker, length(blob) AS n, md5(blob) AS digest FROM z WHERE length(blob) >= 400"
)
def intel_blob(s, d):
    """Context of each ticker: its first page's section windows and its newest articles, cut to 6,500 characters, 400 at least."""
    docs = table(s, d, "documents").where("ticker is not null")
    win = F.coalesce(F.nullif(X.section_windows("text", SECTIONS), F.lit("")), F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.substring("text", 1, 3500)))
    page = F.concat(F.lit("SOURCE: ENCYCLOPEDIA (Page: "), F.coalesce("title", F.lit("None")), F.lit(")\nDATA:\n"), win, F.lit("\n"))
    first = docs.where("text is not null").groupBy("ticker").agg(F.min("doc_id").alias("doc_id"))
    pages = docs.select("doc_id", page.alias("page")).join(first, "doc_id").drop("doc_id")
    newest = docs.select("ticker", "published_at", "doc_id", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc_nulls_last("published_at"), "doc_id")).alias("k")).where("k <= 5")
    line = F.concat(F.lit("- "), F.coalesce("title", F.lit("None")), F.lit(": "), F.coalesce("text", F.lit("None")))
    lines = docs.select("doc_id", line.alias("line")).join(newest.select("ticker", "doc_id", "k"), "doc_id")
    news = lines.groupBy("ticker").agg(F.concat(F.lit("SOURCE: RECENT NEWS\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n")).alias("news"))  # five rows
    blob = news.join(pages, "ticker", "left").select("ticker", F.substring(F.concat(F.coalesce("page", F.lit("")), "news"), 1, 6500).alias("blob"))
    return blob.select("ticker", F.length("blob").cast("bigint").alias("n"), F.md5(F.col("blob").cast("binary")).alias("digest")).where("n >= 400")


ASK = "You research {name} ({ticker}). List its suppliers and customers as JSON."


@query("SELECT id, 'You research ' || coalesce(name, '') || ' (' || coalesce(ticker, '') || '). List its suppliers and customers as JSON.' AS prompt FROM nodes")
def prompts(s, d):
    return table(s, d, "nodes").select("id", prompt(ASK, name="name", ticker="ticker").alias("prompt"))


@query("SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE confidence_score IS NULL) AS n_default FROM dependencies WHERE source_company <> '' AND target_company <> '' AND doc_id % 10 <> 3 AND doc_id IN (SELECT doc_id FROM documents) GROUP BY doc_id")
def extract_replayed(s, d):
    """Replies landed for each document, one in ten of them broken, parsed again."""
    dep = table(s, d, "dependencies")
    fields = ("source_company", "target_company", "dependency_type", "product", "confidence_score")
    # one reply a dependency, as a service answers part by part
    landed = dep.select("doc_id", "dep_id", F.when(F.col("doc_id") % 10 == 3, F.lit('{"dependencies": [{"source')).otherwise(F.to_json(F.struct(F.array(F.struct(*fields)).alias("dependencies")))).alias("reply"))
    asked = table(s, d, "documents").select("doc_id").join(landed.select("doc_id", "dep_id"), "doc_id")
    got = parse_extraction(replayed(asked, landed.drop("doc_id"), "dep_id"), "doc_id", "reply", default_confidence=-1.0)
    return got.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("confidence_score") == -1.0, 1)).alias("n_default"))


_T = "(SELECT ticker, min(id) AS id FROM nodes WHERE ticker IS NOT NULL GROUP BY ticker)"


@query(
    f"WITH a AS (SELECT query_text, arg_min(symbol, (hit_rank, symbol)) AS symbol FROM alias_hits GROUP BY query_text), r AS (SELECT d.dep_id, a.symbol AS given, d.source_company AS said FROM dependencies d LEFT JOIN a ON a.query_text = d.source_company) "
    f"SELECT dep_id, coalesce(g.id, n.id) AS source_id FROM r LEFT JOIN {_T} g ON length(r.given) >= 2 AND g.ticker = upper(trim(r.given)) LEFT JOIN {_T} n ON length(r.said) >= 2 AND n.ticker = upper(regexp_replace(r.said, '^{X.SPACE}+|{X.SPACE}+$', '', 'g'))"
)
def given_ticker_first(s, d):
    """The ticker given for an end goes before its name; here both resolve as exact tickers."""
    nodes = table(s, d, "nodes")
    dep = table(s, d, "dependencies").select("dep_id", "source_company").join(resolve.alias_first(table(s, d, "alias_hits")).withColumnsRenamed({"query_text": "source_company", "symbol": "given"}), "source_company", "left")
    hit = resolve.by_ticker(_mentions(s, d).unionByName(dep.select(F.col("given").alias("mention"))).where("mention is not null").distinct(), nodes)
    by = lambda c, out: hit.select(F.col("mention").alias(c), F.col("id").alias(out))
    return dep.join(by("given", "g"), "given", "left").join(by("source_company", "n"), "source_company", "left").select("dep_id", F.coalesce("g", "n").alias("source_id"))


@query()
def resolved_links(s, d):
    """Both ends of each dependency through all stages, tickers given for those sources that the symbol search knows."""
    alias = resolve.alias_first(table(s, d, "alias_hits")).withColumnsRenamed({"query_text": "source_company", "symbol": "source_ticker"})
    dep = table(s, d, "dependencies").select("dep_id", "source_company", "target_company").join(alias.hint("merge"), "source_company", "left").withColumn("target_ticker", F.lit(None).cast("string"))
    return resolve.resolve_links(dep, table(s, d, "nodes"), table(s, d, "alias_hits")).select("dep_id", "source_id", "target_id")

"""Queries of the graph engine's own operators, over whole tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .functions import text as X
from .operators import graph, merge, resolve, screener
from .session import written
from .sources.io import parse_extraction, url_list

#: Cap above which a company is worth research, or a candidate for a mention.
FLOOR, CANDIDATE_FLOOR = 1e9, 1e8
#: Edges verified from this time on are the batch that meets the stored ones.
LATE = "2025-07-01 00:00:00"
HUB = 7

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# isolation and adjacency
_LONELY = "SELECT id, name, market_cap FROM nodes n WHERE market_cap > 1e9 AND NOT isnan(market_cap) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.source_id = n.id) AND NOT EXISTS (SELECT 1 FROM edges e WHERE e.target_id = n.id)"


@query(_LONELY + " ORDER BY market_cap DESC, id LIMIT 25")
def lonely_nodes(s, d):
    return graph.lonely_nodes(table(s, d, "nodes"), table(s, d, "edges"), FLOOR, 25).select("id", "name", "market_cap")


@query(_LONELY + " AND sector IN ('Technology', 'Energy')")
def lonely_nodes_sector(s, d):
    return graph.lonely_nodes(table(s, d, "nodes"), table(s, d, "edges"), FLOOR, sectors=["Technology", "Energy"]).select("id", "name", "market_cap")


@query("SELECT DISTINCT id, market_cap FROM (SELECT n.id, n.market_cap FROM nodes n LEFT JOIN edges e ON e.source_id = n.id OR e.target_id = n.id WHERE market_cap > 1e9 AND NOT isnan(market_cap) ORDER BY market_cap DESC, n.id LIMIT 50)")
def deep_dive_fanout(s, d):
    return graph.deep_dive(table(s, d, "nodes"), table(s, d, "edges"), FLOOR, 50)


@query("SELECT id, market_cap FROM nodes WHERE market_cap > 1e9 AND NOT isnan(market_cap) ORDER BY market_cap DESC, id LIMIT 50")
def deep_dive_distinct(s, d):
    return graph.deep_dive(table(s, d, "nodes"), table(s, d, "edges"), FLOOR, 50, distinct=True)


_LINKS = "SELECT e.{here} AS node_id, e.id AS edge_id, n.name, coalesce(n.ticker, '') AS ticker, e.dependency_type AS type FROM edges e JOIN nodes n ON n.id = e.{there}"


@query(_LINKS.format(here="target_id", there="source_id"))
def upstream_links(s, d):
    return graph.links(table(s, d, "nodes"), table(s, d, "edges"), "upstream")


@query(_LINKS.format(here="source_id", there="target_id"))
def downstream_links(s, d):
    return graph.links(table(s, d, "nodes"), table(s, d, "edges"), "downstream")


@query("SELECT id, (SELECT count(*) FROM edges e WHERE e.target_id = n.id) AS n_upstream, (SELECT count(*) FROM edges e WHERE e.source_id = n.id) AS n_downstream FROM nodes n")
def adjacency_counts(s, d):
    return graph.adjacency_counts(table(s, d, "nodes"), table(s, d, "edges"))


@query(f"SELECT id, id = {HUB} OR id IN (SELECT target_id FROM edges WHERE source_id = {HUB}) OR id IN (SELECT source_id FROM edges WHERE target_id = {HUB}) AS highlighted FROM nodes")
def neighbourhood(s, d):
    return graph.neighbourhood(table(s, d, "nodes"), table(s, d, "edges"), HUB)


@query(
    "WITH live AS (SELECT ticker, percent_change, row_number() OVER (PARTITION BY ticker ORDER BY sector NULLS FIRST, id) AS rn FROM nodes WHERE ticker IS NOT NULL AND market_cap > 0 AND NOT isnan(market_cap)), "
    "l AS (" + _LINKS.format(here="source_id", there="target_id") + ") SELECT l.node_id, l.edge_id, l.ticker, v.percent_change AS live_change, v.rn IS NOT NULL AS tracked FROM l LEFT JOIN live v ON v.ticker = l.ticker AND v.rn = 1"
)
def live_links(s, d):
    return graph.tracked_links(table(s, d, "nodes"), table(s, d, "edges"), (F.col("market_cap") > 0) & ~F.isnan("market_cap"))


@query()
def flat_graph(s, d):
    return graph.flat_graph(table(s, d, "nodes"), table(s, d, "edges"))


# screener
@query("SELECT coalesce(nullif(sector, ''), 'Uncategorized') AS sector, count(*) AS n_companies FROM nodes GROUP BY 1")
def sector_grid(s, d):
    return screener.sector_grid(table(s, d, "nodes"))


_NUM = "CASE WHEN isfinite({0}) THEN {0} END"
_ORDER = ", ".join(
    f"row_number() OVER (PARTITION BY sector ORDER BY {c if c in ('name', 'ticker') else _NUM.format(c)} {'ASC' if c in ('name', 'ticker') else 'DESC'} NULLS LAST, id) AS by_{c}" for c in screener.SORTABLE
)


@query(f"SELECT id, sector, {_ORDER} FROM nodes")
def screener_sort(s, d):
    return screener.positions_in_sector(table(s, d, "nodes"))


@query("SELECT id, name FROM nodes")
def screener_collated(s, d):
    return screener.sort_table(table(s, d, "nodes"), "name", False, "UNICODE").select("id", "name")


@query("SELECT id, name, ticker FROM nodes WHERE contains(lower(name), 'steel') OR contains(lower(ticker), 'steel')")
def global_search(s, d):
    return screener.search(table(s, d, "nodes"), "Steel").select("id", "name", "ticker")


@query("SELECT id, name FROM nodes WHERE contains(lower(name), 'ba') OR contains(lower(ticker), 'ba') ORDER BY id LIMIT 10")
def typeahead(s, d):
    return screener.typeahead(table(s, d, "nodes"), " ba ").select("id", "name")


_CLEAN = ", ".join(f"{_NUM.format(c)} AS {c}" for c in ("current_price", "market_cap", "enterprise_value", "trailing_pe", "forward_pe", "price_to_book", "fifty_two_week_high", "fifty_two_week_low", "total_revenue", "gross_margin", "target_price"))
_DEFAULT = ", ".join(f"coalesce(nullif({c}, ''), '{v}') AS {c}" for c, v in {"sector": "Uncategorized", "industry": "N/A", "dividend_yield": "N/A", "recommendation": "N/A", "ceo_name": "N/A", "business_summary": "No summary available."}.items())


@query(f"SELECT id, name, ticker, {_DEFAULT}, {_CLEAN}, coalesce({_NUM.format('percent_change')}, 0.0) AS percent_change, employees, coalesce(strftime(last_updated, '%Y-%m-%d'), 'N/A') AS last_updated FROM nodes")
def company_fields(s, d):
    return screener.company_fields(table(s, d, "nodes"))


@query()
def sector_document(s, d):
    return screener.sector_parts(table(s, d, "nodes"), table(s, d, "edges"))


# inserts and upserts
def _roster(s, d):
    part = table(s, d, "part")
    return part.select(F.col("p_partkey").alias("arrival"), F.concat(F.substring("p_brand", 7, 2), F.when(F.col("p_partkey") % 5 == 0, "-").when(F.col("p_partkey") % 7 == 0, ".").otherwise(""), F.col("p_partkey") % 400).alias("symbol"), F.col("p_name").alias("name"),
                       F.element_at(F.array(*[F.lit(x) for x in ("NASDAQ", "NYSE", "AMEX", "BATS")]), (F.col("p_size") % 4 + 1).cast("int")).alias("exchange"), (F.col("p_size") % 3 > 0).alias("marginable"), F.when(F.col("p_size") % 11 != 0, F.col("p_size") % 13 != 0).alias("tradable"))


_ROSTER = """WITH roster AS (SELECT p_partkey AS arrival, substr(p_brand, 7, 2) || CASE WHEN p_partkey % 5 = 0 THEN '-' WHEN p_partkey % 7 = 0 THEN '.' ELSE '' END || CAST(p_partkey % 400 AS VARCHAR) AS symbol, p_name AS name,
  (['NASDAQ', 'NYSE', 'AMEX', 'BATS'])[p_size % 4 + 1] AS exchange, p_size % 3 > 0 AS marginable, CASE WHEN p_size % 11 <> 0 THEN p_size % 13 <> 0 END AS tradable FROM part),
kept AS (SELECT * FROM roster WHERE NOT contains(symbol, '.') AND NOT contains(symbol, '-') AND exchange IN ('NASDAQ', 'NYSE', 'ARCA', 'BATS') AND coalesce(marginable, false) AND coalesce(tradable, false))"""


@query(_ROSTER + " SELECT arrival, symbol, name FROM kept")
def roster_filter(s, d):
    return merge.roster_filter(_roster(s, d)).select("arrival", "symbol", "name")


@query(_ROSTER + ", n AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY arrival) AS k FROM kept WHERE symbol NOT IN (SELECT ticker FROM nodes WHERE ticker <> '')), m AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY arrival) AS j FROM n WHERE k = 1) SELECT arrival, symbol, name FROM m WHERE j = 1")
def roster_merge(s, d):
    return merge.roster_merge(merge.roster_filter(_roster(s, d)), table(s, d, "nodes")).select("arrival", "symbol", "name")


def _late(s, d):
    e = table(s, d, "edges")
    late = F.col("last_verified") >= F.lit(LATE).cast("timestamp_ntz")
    return e.where(~F.coalesce(late, F.lit(False))), e.where(late)


_BATCH = f"WITH stored AS (SELECT * FROM edges WHERE last_verified IS NULL OR last_verified < TIMESTAMP '{LATE}'), fresh AS (SELECT * FROM edges e WHERE last_verified >= TIMESTAMP '{LATE}' AND NOT EXISTS (SELECT 1 FROM stored o WHERE o.source_id = e.source_id AND o.target_id = e.target_id))"


@query(_BATCH + " SELECT id, source_id, target_id FROM fresh")
def edge_insert_faithful(s, d):
    return merge.insert_if_absent(*_late(s, d), ["id"], dedupe_batch=False).select("id", "source_id", "target_id")


@query(_BATCH + " SELECT min(id) AS id, source_id, target_id FROM fresh GROUP BY source_id, target_id")
def edge_insert_deduped(s, d):
    return merge.insert_if_absent(*_late(s, d), ["id"]).select("id", "source_id", "target_id")


_CREATE = """WITH kept AS (SELECT * FROM dependencies WHERE source_company <> '' AND target_company <> ''),
names AS (SELECT source_company AS name, dep_id * 2 AS seen FROM kept UNION ALL SELECT target_company, dep_id * 2 + 1 FROM kept),
known AS (SELECT name, min(id) AS id FROM nodes GROUP BY name),
created AS (SELECT (SELECT max(id) FROM nodes) + row_number() OVER (ORDER BY seen) AS id, name FROM (SELECT name, min(seen) AS seen FROM names WHERE name NOT IN (SELECT name FROM known WHERE name IS NOT NULL) GROUP BY name)),
every AS (SELECT id, name FROM known UNION ALL SELECT id, name FROM created)"""


@query(_CREATE + " SELECT id, name FROM created")
def get_or_create_nodes(s, d):
    return merge.get_or_create(table(s, d, "nodes"), table(s, d, "dependencies"))[0]


@query(_CREATE + " SELECT k.dep_id, a.id AS source_id, b.id AS target_id, coalesce(k.dependency_type, 'Unknown') AS dependency_type, coalesce(k.confidence_score, 0.5) AS confidence_score FROM kept k JOIN every a ON a.name = k.source_company JOIN every b ON b.name = k.target_company")
def get_or_create_edges(s, d):
    return merge.get_or_create(table(s, d, "nodes"), table(s, d, "dependencies"))[1]


def _by_name(s, d):
    known = table(s, d, "nodes").groupBy("name").agg(F.min("id").alias("id"))
    dep = table(s, d, "dependencies").select("dep_id", "source_company", "target_company")
    side = lambda c, out: known.select(F.col("name").alias(c), F.col("id").alias(out))
    return dep.join(side("source_company", "source_id"), "source_company", "left").join(side("target_company", "target_id"), "target_company", "left")


_NAMED = "WITH known AS (SELECT name, min(id) AS id FROM nodes GROUP BY name) SELECT d.dep_id, a.id AS source_id, b.id AS target_id FROM dependencies d JOIN known a ON a.name = d.source_company JOIN known b ON b.name = d.target_company WHERE a.id <> b.id"


@query(_NAMED)
def admit_links(s, d):
    return merge.admit_links(_by_name(s, d)).select("dep_id", "source_id", "target_id")


@query(_NAMED + f" AND (a.id = {HUB} OR b.id = {HUB})")
def admit_links_of_one(s, d):
    return merge.admit_links(_by_name(s, d), HUB).select("dep_id", "source_id", "target_id")


@query("SELECT id, CASE WHEN confidence_score > 10 THEN confidence_score / 100 WHEN confidence_score > 1 THEN confidence_score / 10 ELSE confidence_score END AS confidence FROM edges")
def confidence_norm(s, d):
    return table(s, d, "edges").select("id", X.confidence("confidence_score").alias("confidence"))


_EVENT = "WITH e AS (SELECT user_id, max_by(struct_pack(v := value, p := props, t := event_type), (ts, event_id)) AS x FROM events WHERE user_id IS NOT NULL GROUP BY user_id), c AS (SELECT c.*, e.x.p AS p FROM customer c LEFT JOIN e ON e.user_id = c.c_custkey)"


def _payloads(s, d):
    return table(s, d, "events").where("user_id is not null").groupBy(F.col("user_id").alias("c_custkey")).agg(F.max_by("props", F.struct("ts", "event_id")).alias("payload"))


@query(
    _EVENT + " SELECT c_custkey, CASE WHEN p IS NULL THEN c_acctbal WHEN json_exists(p, '$.k') THEN TRY_CAST(p ->> '$.k' AS DOUBLE) ELSE c_acctbal END AS c_acctbal, TRY_CAST(p ->> '$.k' AS INTEGER) AS c_nationkey, CASE WHEN p IS NOT NULL AND json_exists(p, '$.segment') THEN p ->> '$.segment' ELSE 'Uncategorized' END AS c_mktsegment FROM c"
)
def payload_merge(s, d):
    rules = {"c_acctbal": ("keep", "k", None), "c_nationkey": ("replace", "k", None), "c_mktsegment": ("default", "segment", "Uncategorized")}
    return merge.merge_payload(table(s, d, "customer"), _payloads(s, d), "c_custkey", rules).select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")


@query("SELECT id, recommendation FROM node_snapshots WHERE id IS NULL OR id NOT IN (SELECT id FROM nodes WHERE id IS NOT NULL) UNION ALL SELECT id, recommendation FROM nodes")
def snapshot_upsert(s, d):
    """Every stored snapshot, whenever it was loaded."""
    return merge.snapshot_upsert(table(s, d, "node_snapshots").select("id", "recommendation"), table(s, d, "nodes").select("id", "recommendation"), ["id"])


@query("SELECT DISTINCT ticker FROM nodes WHERE ticker <> ''")
def distinct_tickers(s, d):
    return table(s, d, "nodes").where("ticker <> ''").select("ticker").distinct()


@query("SELECT query_text, arg_min(symbol, (hit_rank, symbol)) AS symbol FROM alias_hits GROUP BY query_text")
def alias_first_hit(s, d):
    return resolve.alias_first(table(s, d, "alias_hits"))


# text
_T1 = "name"
for _p, _r in [(f"({'|'.join(X.CUT_FROM)}).*", ""), (r"\(.*?\)", ""), *[(w, "") for w in X.DELETED]]:
    _T1 = f"regexp_replace({_T1}, '{_p}', '{_r}', 'gi')"


@query(f"SELECT id, trim(replace({_T1}, ',', '')) AS cleaned FROM nodes")
def clean_company_name(s, d):
    return table(s, d, "nodes").select("id", X.clean_company_name("name").alias("cleaned"))


@query(f"SELECT doc_id, md5(trim(regexp_replace(text, '{X.SPACE}+', ' ', 'g'))) AS collapsed FROM documents")
def ws_collapse(s, d):
    return table(s, d, "documents").select("doc_id", F.md5(X.collapse_space("text").cast("binary")).alias("collapsed"))


#: Words whose surroundings are taken from a page.
SECTIONS = ["Operations", "Products", "Supply chain", "Partnerships", "Customers", "Infrastructure", "Manufacturing"]
_WINDOWS = " || ".join(f"CASE WHEN instr(text, '{w}') > 0 THEN substr(text, instr(text, '{w}'), 2500) ELSE '' END" for w in SECTIONS)


@query(f"SELECT doc_id, length(w) AS n, md5(CASE WHEN w = '' THEN coalesce(title, '') || chr(10) || substr(text, 1, 3500) ELSE w END) AS digest FROM (SELECT doc_id, title, text, {_WINDOWS} AS w FROM documents)")
def section_windows(s, d):
    w = table(s, d, "documents").withColumn("w", X.section_windows("text", SECTIONS))
    text = F.when(F.col("w") == "", F.concat(F.coalesce("title", F.lit("")), F.lit("\n"), F.substring("text", 1, 3500))).otherwise(F.col("w"))
    return w.select("doc_id", F.length("w").cast("bigint").alias("n"), F.md5(text.cast("binary")).alias("digest"))


@query(
    "WITH r AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY published_at DESC NULLS LAST, doc_id) AS k FROM documents WHERE ticker IS NOT NULL), b AS (SELECT ticker, 'SOURCE: RECENT NEWS' || chr(10) || string_agg('- ' || coalesce(title, 'None') || ': ' || coalesce(text, 'None'), chr(10) ORDER BY k) AS blob FROM r WHERE k <= 5 GROUP BY ticker) SELECT ticker, length(substr(blob, 1, 6500)) AS n, md5(substr(blob, 1, 6500)) AS digest FROM b WHERE length(substr(blob, 1, 6500)) >= 400"
)
def context_blob(s, d):
    docs = table(s, d, "documents").where("ticker is not null")
    top = docs.withColumn("k", F.row_number().over(W.partitionBy("ticker").orderBy(F.desc_nulls_last("published_at"), "doc_id"))).where("k <= 5")
    line = F.concat(F.lit("- "), F.coalesce("title", F.lit("None")), F.lit(": "), F.coalesce("text", F.lit("None")))
    blob = top.groupBy("ticker").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"]), "\n").alias("b"))
    cut = F.substring(F.concat(F.lit("SOURCE: RECENT NEWS\n"), "b"), 1, 6500)
    return blob.select("ticker", F.length(cut).cast("bigint").alias("n"), F.md5(cut.cast("binary")).alias("digest")).where("n >= 400")


@query("SELECT id, nullif(array_to_string(list_transform(string_split(replace(lower(recommendation), '_', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || substr(w, 2)), ' '), '') AS label, coalesce(strftime(last_updated, '%Y-%m-%d'), 'N/A') AS day FROM node_snapshots")
def labels(s, d):
    return table(s, d, "node_snapshots").select("id", X.title_words("recommendation").alias("label"), X.date_label("last_updated").alias("day"))


@query(
    """SELECT id, CASE WHEN NOT coalesce(isfinite(market_cap), false) THEN 'N/A' WHEN market_cap >= 1e12 THEN '$' || printf('%.2f', market_cap / 1e12) || 'T' WHEN market_cap >= 1e9 THEN '$' || printf('%.2f', market_cap / 1e9) || 'B'
      WHEN market_cap >= 1e6 THEN '$' || printf('%.2f', market_cap / 1e6) || 'M' ELSE '$' || regexp_replace(regexp_replace(format('{:,.3f}', market_cap), '(\\.[0-9]*?)0+$', '\\1'), '\\.$', '') END AS cap,
      CASE WHEN coalesce(isfinite(gross_margin), false) THEN printf('%.2f', gross_margin * 100) || '%' ELSE 'N/A' END AS margin, CASE WHEN coalesce(isfinite(trailing_pe), false) THEN printf('%.2f', trailing_pe) ELSE 'N/A' END AS pe,
      CASE WHEN coalesce(percent_change, 0.0) > 0 THEN '+' ELSE '' END || printf('%.2f', coalesce(percent_change, 0.0)) || '%' AS change FROM nodes"""
)
def humanise(s, d):
    return table(s, d, "nodes").select("id", X.humanise("market_cap").alias("cap"), X.humanise("gross_margin", "percent").alias("margin"), X.humanise("trailing_pe", "ratio").alias("pe"), X.signed_percent("percent_change").alias("change"))


@query("SELECT trim(title) AS url FROM documents WHERE trim(title) <> '' AND NOT starts_with(title, '#')")
def url_list_lines(s, d):
    return url_list(table(s, d, "documents").select(F.col("title").alias("value")))


_HTML = "'<html><P class=x>' || replace(text, chr(10) || chr(10), '</p><p>') || '</p></html>'"


@query(f"SELECT doc_id, md5(trim(regexp_replace(regexp_replace(array_to_string(regexp_extract_all(h, '(?is)<p\\b[^>]*>(.*?)</p>', 1), ' '), '<[^>]*>', '', 'g'), '{X.SPACE}+', ' ', 'g'))) AS digest FROM (SELECT doc_id, {_HTML} AS h FROM documents)")
def page_paragraphs_simple(s, d):
    html = F.concat(F.lit("<html><P class=x>"), F.replace("text", F.lit("\n\n"), F.lit("</p><p>")), F.lit("</p></html>"))
    return table(s, d, "documents").withColumn("h", html).select("doc_id", F.md5(X.paragraphs_simple("h").cast("binary")).alias("digest"))


@query(
    "WITH d AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS l FROM documents WHERE text IS NOT NULL) SELECT doc_id, CAST(len(l) AS BIGINT) AS n, "
    f"md5(trim(regexp_replace(array_to_string(list_transform(range(1, len(l) + 1), lambda i: array_to_string(l[i:], '')), ' '), '{X.SPACE}+', ' ', 'g'))) AS digest FROM d"
)
def page_paragraphs(s, d):
    """Pages whose paragraphs are never closed, so that each holds those that follow."""
    escaped = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    html = F.concat(F.lit("<html><p>"), F.replace(escaped, F.lit("\n\n"), F.lit("<p>")), F.lit("</html>"))
    docs = table(s, d, "documents").where("text is not null")
    return docs.select("doc_id", F.size(F.split("text", "\n\n")).cast("bigint").alias("n"), F.md5(X.paragraphs(html).cast("binary")).alias("digest"))


@query("SELECT dep_id, source_company, target_company, coalesce(dependency_type, 'Unknown') AS dependency_type, coalesce(confidence_score, 0.5) AS confidence_score FROM dependencies WHERE source_company <> '' AND target_company <> ''")
def extract_parse(s, d):
    fields = ("source_company", "target_company", "dependency_type", "product", "confidence_score")
    replies = table(s, d, "dependencies").select("dep_id", F.to_json(F.struct(F.array(F.struct(*fields)).alias("dependencies"))).alias("reply"))
    return parse_extraction(replies, "dep_id", "reply").select("dep_id", "source_company", "target_company", "dependency_type", "confidence_score")


# resolution
def _mentions(s, d):
    return table(s, d, "dependencies").select(F.explode(F.array("source_company", "target_company")).alias("mention")).where("mention is not null").distinct()


_MENTIONS = f"WITH m AS (SELECT mention, regexp_replace(mention, '^{X.SPACE}+|{X.SPACE}+$', '', 'g') AS said FROM (SELECT source_company AS mention FROM dependencies UNION SELECT target_company FROM dependencies) WHERE length(mention) >= 2)"
_CANDIDATES = _MENTIONS + ", c AS (SELECT mention, id, name, market_cap FROM m, nodes WHERE said <> '' AND market_cap > 1e8 AND NOT isnan(market_cap) AND (contains(lower(name), lower(said)) OR contains(lower(ticker), lower(said))))"


@query(_MENTIONS + " SELECT mention, min(id) AS id FROM m JOIN nodes ON ticker = upper(said) GROUP BY mention")
def resolve_ticker(s, d):
    return resolve.by_ticker(_mentions(s, d), table(s, d, "nodes"))


@query(_CANDIDATES + " SELECT mention, id, name, market_cap FROM c")
def resolve_candidates(s, d):
    return resolve.substring_candidates(_mentions(s, d), table(s, d, "nodes"), CANDIDATE_FLOOR)


@query()
def resolve_score(s, d):
    c = resolve.substring_candidates(_mentions(s, d), table(s, d, "nodes"), CANDIDATE_FLOOR)
    return c.select("mention", "id", resolve.name_score(F.lower(F.trim("mention")), F.lower("name")).alias("score"))


_SET = "list_distinct(list_filter(string_split_regex(regexp_replace(lower({0}), '[^\\x00-\\x7f]', '', 'g'), '[^0-9a-z]+'), lambda w: w <> ''))"


@query(_CANDIDATES + f" SELECT mention, id, 100 AS score FROM c WHERE len({_SET.format('mention')}) > 0 AND list_has_all({_SET.format('name')}, {_SET.format('mention')})")
def resolve_score_contained(s, d):
    """The scores of those candidates whose name has every word of the mention."""
    split = lambda c: F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\x00-\x7f]", ""), "[^0-9a-z]+"), lambda w: w != ""))
    c = resolve.substring_candidates(_mentions(s, d), table(s, d, "nodes"), CANDIDATE_FLOOR)
    held = c.where((F.size(split("mention")) > 0) & (F.size(F.array_except(split("mention"), split("name"))) == 0))
    return held.select("mention", "id", resolve.name_score(F.lower(F.trim("mention")), F.lower("name")).alias("score"))


@query(
    _CANDIDATES + """, o AS (SELECT mention, list(struct_pack(id := id, score := CAST(80 + (length(name) + id) % 9 AS INTEGER), cap := CAST(market_cap AS DOUBLE)) ORDER BY id) AS l FROM c GROUP BY mention),
    f AS (SELECT mention, list_reduce(l, lambda a, x: CASE WHEN x.score > a.score THEN x WHEN abs(x.score - a.score) < 5 AND x.cap > a.cap THEN struct_pack(id := x.id, score := a.score, cap := x.cap) ELSE a END) AS r FROM o)
    SELECT mention, r.id AS id, r.score AS best_score FROM f WHERE r.score > 85"""
)
def resolve_fold(s, d):
    c = resolve.substring_candidates(_mentions(s, d), table(s, d, "nodes"), CANDIDATE_FLOOR)
    return resolve.fold_best(c.withColumn("score", (80 + (F.length("name") + F.col("id")) % 9).cast("int")))


@query()
def resolve_full(s, d):
    return resolve.resolve(_mentions(s, d), table(s, d, "nodes"), table(s, d, "alias_hits"))


@query()
def discover_links(s, d):
    """From landed extractions to new edges: parse, resolve, admit, insert if absent."""
    dep = extract_parse(s, d)
    found = written(resolve_full(s, d))
    side = lambda c, out: found.select(F.col("mention").alias(c), F.col("id").alias(out)).hint("merge")
    both = dep.join(side("source_company", "source_id"), "source_company").join(side("target_company", "target_id"), "target_company")
    new = merge.insert_if_absent(table(s, d, "edges"), merge.admit_links(both), ["dep_id"])
    return new.select("dep_id", "source_id", "target_id", "dependency_type", X.confidence("confidence_score").alias("confidence_score"))

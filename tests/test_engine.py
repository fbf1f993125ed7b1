"""The graph engine's operators on hand-built rows, and each query against its SQL on the smallest tables."""

import random

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tests.verify import compare, connect
from tierline import graph_queries, queries, view_queries
from tierline.functions import text as X
from tierline.operators import graph, merge, quotes, resolve, screener, skew
from tierline.sources import connectors, io, schemas

SF = "/root/testdata/sf0.001"
ALL = queries.QUERIES | view_queries.QUERIES
CHECKED = queries.SQL | view_queries.SQL


@pytest.fixture(scope="session")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, con, name):
    if name in CHECKED:
        assert compare(spark, con, ALL[name], CHECKED[name], SF) == ""
    else:
        assert ALL[name](spark, SF).count() > 0


#: Queries whose tables all grow: no side of a join may be broadcast on a plan's guess of its size.
NO_BROADCAST = ["resolve_candidates", "resolve_fold", "resolve_full", "discover_links", "resolved_links", "searches", "resolve_score", "resolve_score_contained"]


@pytest.mark.parametrize("name", NO_BROADCAST)
def test_no_growing_side_is_broadcast(spark, monkeypatch, name):
    plans, real = [], DataFrameWriter.parquet
    plan = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (plan(self._df), real(self, *a, **k))[1])
    plan(ALL[name](spark, SF))
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_substrings_of_every_length(spark):
    texts = [None, "", "a", "Ab", "abc", "abcd", "ABCDE", "abcdefgh", "xabcdefghi", "abcdefg abcdefgh", "ÄÖÜ % _ 𝄞x", "aaaaaaaaaaaa"]
    nodes = spark.createDataFrame([(i, t, u) for i, (t, u) in enumerate(zip(texts, reversed(texts), strict=True))], "id int, name string, ticker string")
    terms = sorted({t[i:j] for t in texts if t for i in range(len(t)) for j in range(i + 1, len(t) + 1)} | {"zz", "abcdefghq", "qabcdefgh", "abcdxfgh", "aaaaaaaaaaaaa"})
    m = spark.createDataFrame([(t, t.lower()) for t in terms], "mention string, low string")
    want = sorted({(t, r.id) for t in terms for r in nodes.collect() if any(t.lower() in (x or "").lower() for x in (r.name, r.ticker))})
    assert sorted({(r.mention, r.id) for r in resolve.substring_matches(m, nodes).collect()}) == want
    assert resolve.substring_matches(m.where("false"), nodes).count() == 0


def test_all_snapshots_are_stored(spark, con):
    got = graph_queries.QUERIES["snapshot_upsert"](spark, SF)
    stored = con.execute("SELECT count(*) FROM node_snapshots WHERE id NOT IN (SELECT id FROM nodes)").fetchone()[0]
    assert got.count() == stored + con.execute("SELECT count(*) FROM nodes").fetchone()[0]


def column(spark, values, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, c string").orderBy("i")
    return [r[0] for r in rows.select(expr).collect()]


def test_company_names(spark):
    cases = {"Apple Inc. Common Stock": "Apple .", "Alphabet Inc. Class A Common Stock": "Alphabet .", "Sony Group Corporation": "Sony", "Foo (The) Inc": "Foo", "AGCO AG": "AGCO", "Quadrant Corp": "Qu", "Trust Holdings, Inc": "", "SAP SE Sponsored ADR": "SAP SE", "Taiwan Semi Ltd. American Depositary Shares": "Taiwan Semi ."}
    assert column(spark, cases, X.clean_company_name("c")) == list(cases.values())


def test_numbers(spark):
    df = spark.createDataFrame([(1.5e12,), (2e9,), (3.25e6,), (None,), (-5e9,), (float("nan"),), (10.5,)], "c double")
    assert [r[0] for r in df.select(X.humanise("c")).collect()] == ["$1.50T", "$2.00B", "$3.25M", "N/A", "$-5,000,000,000", "N/A", "$10.5"]
    c = spark.createDataFrame([(0.9,), (1.0,), (1.5,), (10.0,), (10.5,), (90.0,), (None,)], "c double")
    assert [r[0] for r in c.select(X.confidence("c")).collect()] == [0.9, 1.0, 0.15, 1.0, 0.105, 0.9, None]


def test_paragraphs():
    assert X.paragraph_text("<p>a<p>b</p>") == "ab b"
    assert X.paragraph_text("<p>x &amp; y</p><div>no</div><p>z</p>") == "x & y z"
    assert X.paragraph_text("") == "" and X.paragraph_text(None) is None


def test_url_list(spark):
    lines = spark.createDataFrame([("# a",), ("  ",), ("  # b",), (" http://x ",)], "value string")
    assert [r.url for r in io.url_list(lines).collect()] == ["# b", "http://x"]
    assert io.read_url_list(spark, "/nonexistent/urls.txt").count() == 0


def test_extraction(spark):
    replies = spark.createDataFrame([(1, '{"dependencies":[{"source_company":"A","target_company":"B"},{"source_company":"","target_company":"B"}]}'), (2, "oops"), (3, "{}"), (4, None), (5, '{"dependencies":null}')], "k int, reply string")
    assert [(r.k, r.pos, r.source_company, r.dependency_type, r.confidence_score) for r in io.parse_extraction(replies, "k", "reply").collect()] == [(1, 0, "A", "Unknown", 0.5)]


def graph_rows(spark):
    n = spark.createDataFrame([(1, "Ann", "A", 9e9, "S", 1.0), (2, "Bob", None, 8e9, None, 2.0), (3, "Cy", "C", 7e9, "S", None), (4, "Di", "D", 6e9, "", 0.0)], "id bigint, name string, ticker string, market_cap double, sector string, percent_change double")
    e = spark.createDataFrame([(1, 1, 2, "t"), (2, 1, 3, "t"), (3, 2, 3, "t"), (4, 3, 3, "loop"), (5, None, 9, "t")], "id bigint, source_id bigint, target_id bigint, dependency_type string")
    return n, e


def test_graph(spark):
    n, e = graph_rows(spark)
    assert [r.id for r in graph.lonely_nodes(n, e, 1e9).collect()] == [4]
    assert sorted(r.id for r in graph.deep_dive(n, e, 1e9, 3).collect()) == [1, 2]
    assert sorted(r.id for r in graph.deep_dive(n, e, 1e9, 3, distinct=True).collect()) == [1, 2, 3]
    assert sorted((r.node_id, r.name, r.ticker) for r in graph.links(n, e, "upstream").collect()) == [(2, "Ann", "A"), (3, "Ann", "A"), (3, "Bob", ""), (3, "Cy", "C")]
    assert sorted(r.id for r in graph.neighbourhood(n, e, 2).where("highlighted").collect()) == [1, 2, 3]
    assert [r.id for r in n.orderBy(*screener.order_by("percent_change", True)).collect()] == [2, 1, 4, 3]
    assert screener.search(n, "a", 2).count() == 0 and [r.id for r in screener.typeahead(n, " A ").collect()] == [1]


def test_inserts(spark):
    n, e = graph_rows(spark)
    batch = spark.createDataFrame([(1, 1, 2), (2, 4, 1), (3, 4, 1)], "k int, source_id bigint, target_id bigint")
    assert [r.k for r in merge.insert_if_absent(e, batch, ["k"]).collect()] == [2]
    assert sorted(r.k for r in merge.insert_if_absent(e, batch, ["k"], dedupe_batch=False).collect()) == [2, 3]
    dep = spark.createDataFrame([(1, "New", "Ann", None, None), (2, "Ann", "Other", "x", 0.7), (3, "", "Ann", None, None), (4, "Other", "Other", None, None)], "dep_id bigint, source_company string, target_company string, dependency_type string, confidence_score double")
    created, added = merge.get_or_create(n, dep)
    assert sorted((r.id, r.name) for r in created.collect()) == [(5, "New"), (6, "Other")]
    assert sorted((r.source_id, r.target_id) for r in added.collect()) == [(1, 6), (5, 1), (6, 6)]
    none, _ = merge.get_or_create(n, dep.limit(0))
    assert none.count() == 0


def test_roster(spark):
    rows = [(1, "AAA", "Alpha", "NYSE", True, True), (2, "AAB", "Alpha", "NYSE", True, True), (3, "BRK.B", "Beta", "NYSE", True, True), (4, "X-P", "Gamma", "NYSE", True, True), (5, "AMX", "Delta", "AMEX", True, True), (6, "NMG", "Eps", "NASDAQ", False, True), (7, "OLD", "Zeta", "BATS", True, True), (8, "NUL", "Eta", "BATS", None, True)]
    r = spark.createDataFrame(rows, "arrival int, symbol string, name string, exchange string, marginable boolean, tradable boolean")
    stored = spark.createDataFrame([("OLD",), (None,), ("",)], "ticker string")
    kinds = spark.createDataFrame([("us_equity", "active", 1), ("crypto", "active", 2), ("us_equity", None, 3)], "class string, status string, k int")
    assert [x.k for x in merge.assets(kinds, **{"class": "us_equity", "status": "active"}).collect()] == [1]
    assert [x.symbol for x in merge.roster_merge(merge.roster_filter(r), stored, 0).collect()] == ["AAA"]


def test_payload_presence(spark):
    t = spark.createDataFrame([(k, 1.0, 2.0, "old") for k in range(6)], "k int, price double, pe double, sector string")
    p = spark.createDataFrame([(0, '{"p":{"price":110},"s":"Tech"}'), (1, '{"p":{"price":null},"s":null}'), (2, "error text"), (4, "{}"), (5, '{"pe":3}')], "k int, payload string")
    got = {r.k: (r.price, r.pe, r.sector) for r in merge.merge_payload(t, p, "k", {"price": ("keep", "p.price", None), "pe": ("replace", "pe", None), "sector": ("default", "s", "Uncategorized")}).collect()}
    assert got == {0: (110.0, None, "Tech"), 1: (None, None, None), 2: (1.0, 2.0, "old"), 3: (1.0, None, "Uncategorized"), 4: (1.0, None, "Uncategorized"), 5: (1.0, 3.0, "Uncategorized")}


def test_token_set_ratio():
    assert resolve.token_set_ratio("apple", "apple inc") == 100 and resolve.token_set_ratio("", "x") == 0
    assert resolve.token_set_ratio("micron tech", "micron technology") == 79
    assert resolve.token_set_ratio("abcd", "abce") == 75


def fold(items):
    best, hi, cap = None, 0, 0.0
    for i, s, c in items:
        if s > hi:
            best, hi, cap = i, s, c
        elif abs(s - hi) < 5 and best is not None and c > cap:
            best, cap = i, c
    return (best, hi) if hi > 85 else None


def test_fold_matches_a_loop(spark):
    r = random.Random(4)
    cases = {"a": [(1, 90, 5.0), (2, 87, 9.0), (3, 83, 99.0)], "b": [(1, 85, 1.0)], **{f"r{k}": [(i, r.randrange(80, 100), float(r.randrange(50))) for i in range(8)] for k in range(30)}}
    df = spark.createDataFrame([(m, *x) for m, l in cases.items() for x in l], "mention string, id bigint, score int, market_cap double")
    got = {x.mention: (x.id, x.best_score) for x in resolve.fold_best(df).collect()}
    assert got == {m: f for m, l in cases.items() if (f := fold(l))} and got["a"] == (2, 90)


def test_resolution_stages(spark):
    n = spark.createDataFrame([(1, "Ford Motor", "F", 1e6), (2, "Micron Technology", "MU", 5e9), (3, "Tiny Micron", "TM", 1e8)], "id bigint, name string, ticker string, market_cap double")
    m = spark.createDataFrame([("F",), (" f ",), ("micron",), ("nobody",), ("Chipco",), (None,), ("",), ("mu",)], "mention string")
    a = spark.createDataFrame([("Chipco", 2, "X"), ("Chipco", 1, "mu")], "query_text string, hit_rank int, symbol string")
    assert sorted((r.mention, r.id, r.stage) for r in resolve.resolve(m, n, a).collect()) == [(" f ", 1, 1), ("Chipco", 2, 3), ("micron", 2, 2), ("mu", 2, 1)]


def test_quotes(spark):
    old = "id bigint, ticker string, current_price double, market_cap double, percent_change double, trailing_pe double, dividend_yield string, recommendation string, ceo_name string, sector string, industry string, last_updated timestamp_ntz, other int"
    rows = spark.createDataFrame([(i, t, 1.0, 2.0, 3.0, 4.0, "old", "Old", "Boss", "S", "I", None, i) for i, t in enumerate(["A", "B", "C", "D", "E", "F", "G", None])], old)
    price = lambda **kw: {"price": kw}
    import json

    p = {
        "A": price(regularMarketPrice=110, regularMarketOpen=100, marketCap=7) | {"assetProfile": {"sector": "Tech", "companyOfficers": [{"name": "N"}]}, "summaryDetail": {"dividendYield": 0.125, "trailingPE": 9}, "financialData": {"recommendationKey": "strong_buy"}},
        "B": price(regularMarketPrice=110) | {"assetProfile": {"sector": None, "companyOfficers": [{}]}},
        "C": price(regularMarketPrice=110, regularMarketOpen=None) | {"assetProfile": {"companyOfficers": []}, "financialData": {"recommendationKey": ""}},
        "D": price(regularMarketPrice=110, regularMarketOpen=0), "E": price(regularMarketOpen=5),
    }
    q = spark.createDataFrame([(k, json.dumps(v)) for k, v in p.items()] + [("F", "No data found")], "ticker string, payload string")
    out = quotes.merge_quotes(rows, q, F.lit("2024-01-01 00:00:00"))
    got = {r.id: r for r in out.collect()}
    assert [got[i].percent_change for i in range(8)] == [10.0, 10900.0, 3.0, 3.0, 3.0, 3.0, 3.0, 3.0]
    assert [got[i].current_price for i in range(8)] == [110.0] * 4 + [1.0] * 4 and [got[i].market_cap for i in range(8)] == [7.0, None, None, None, 2.0, 2.0, 2.0, 2.0]
    assert [got[i].trailing_pe for i in range(8)] == [9.0, None, None, None, None, 4.0, None, 4.0]
    assert [got[i].sector for i in range(8)] == ["Tech", None, "Uncategorized", "Uncategorized", "Uncategorized", "S", "Uncategorized", "S"]
    assert [got[i].dividend_yield for i in range(8)] == ["12.50%", *["N/A"] * 4, "old", "N/A", "old"]
    assert [got[i].ceo_name for i in range(3)] == ["N", "N/A", "Boss"] and [got[i].recommendation for i in range(3)] == ["Strong Buy", "Old", "Old"]
    assert [got[i].last_updated is None for i in (0, 5, 6, 7)] == [False, True, False, True] and out.columns == rows.columns
    assert [r.ticker for r in quotes.rejects(q).collect()] == ["F"]


def test_eligible(spark):
    cases = [(5e9, 10.0, "Technology"), (None, 10.0, "Technology"), (0.0, 10.0, "Technology"), (-1.0, 10.0, "Technology"), (5e9, 0.0, "Technology"), (5e9, -1.0, "Technology"), (5e9, 10.0, None), (5e9, 10.0, "Pending Update"), (5e9, 10.0, "Real Estate"), (float("nan"), 1.0, "Technology"), (5e9, float("nan"), "Technology"), (5e9, 1.0, "")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "id int, market_cap double, current_price double, sector string")
    assert [r.id for r in screener.eligible(df, without=view_queries.NOT_EXPORTED).orderBy("id").collect()] == [0, 5, 7]
    queue = spark.createDataFrame([(1, 5e9, None, "a"), (2, 5e9, "Uncategorized", "b"), (3, 5e9, "Insurance", "c")], "id bigint, market_cap double, sector string, name string")
    none = spark.createDataFrame([], "id bigint, source_id bigint, target_id bigint")
    assert [r.id for r in graph.lonely_nodes(queue, none, 1e9, without=["Insurance"]).collect()] == [2]
    assert [r.id for r in graph.lonely_nodes(queue, none, 1e9, sectors=[]).orderBy("id").collect()] == [1, 2, 3]


def test_links_by_ticker_and_around(spark):
    n, e = graph_rows(spark)
    pairs = spark.createDataFrame([("A", "C", "stored"), ("C", "A", "new"), ("C", "A", "again"), ("A", "ZZ", "lost"), (None, "A", "null")], "source string, target string, type string")
    assert sorted((r.source_id, r.target_id, r.dependency_type, r.confidence_score) for r in graph.insert_by_ticker(n, e, pairs).collect()) == [(3, 1, "again", 1.0), (3, 1, "new", 1.0)]
    assert {(r.id, r.degree) for r in graph.degrees(e).collect()} == {(1, 2), (2, 2), (3, 3), (9, 1)}
    assert sorted(map(tuple, graph.neighbourhoods(n, e, n.where("id in (2, 4)")).collect())) == [(2, 1), (2, 2), (2, 3), (4, 4)]
    assert sorted(map(tuple, screener.searches(n, spark.createDataFrame([("BO",), ("zz",), ("d",), (None,)], "term string")).collect())) == [("BO", 2)]


def test_connectors(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None), (3, "bad"), (4, "c")], "k int, q string").coalesce(1)

    def answer(asked):
        if "bad" in asked:
            raise ValueError
        return [x.upper() for x in asked]

    assert {r.k: r.reply for r in connectors.ask(rows, "q", answer, size=2).collect()} == {1: "A", 2: "", 3: "", 4: ""}
    landed = spark.createDataFrame([(1, "x"), (3, None)], "k int, reply string")
    assert {r.k: r.reply for r in connectors.replayed(rows, landed, "k").collect()} == {1: "x", 2: "", 3: "", 4: ""}
    assert [r.p for r in rows.orderBy("k").select(connectors.prompt("{q}: {k} {x}", q="q", k="k").alias("p")).collect()] == ["a: 1 {x}", ": 2 {x}", "bad: 3 {x}", "c: 4 {x}"]
    hits = spark.createDataFrame([("c d", 1, "P"), ("a", 2, "Q"), ("a", 1, "R"), (None, 1, "S")], "query_text string, hit_rank int, symbol string")
    got = connectors.first_answered(rows, "k", [F.concat("q", F.lit(" d")), F.col("q")], hits)
    assert sorted(map(tuple, got.collect())) == [(1, 2, "R"), (4, 1, "P")]
    spark.sql("CREATE DATABASE IF NOT EXISTS made")
    assert schemas.create_tables(spark, "made") == schemas.create_tables(spark, "made") and spark.table("made.edges").count() == 0
    spark.sql("DROP DATABASE made CASCADE")


def test_ranks(spark):
    r = random.Random(6)
    rows = [(i, r.choice(["a", "a", "a", "b", None]), r.choice([None, 1.0, 2.0, 3.0])) for i in range(300)]
    got = skew.ranked(spark.createDataFrame(rows, "id int, k string, x double"), ["k"], [F.col("x").desc_nulls_last(), F.col("id").asc()], "place")
    want: dict = {}
    for k in ("a", "b", None):
        for place, (i, _, _) in enumerate(sorted((x for x in rows if x[1] == k), key=lambda x: (x[2] is None, -(x[2] or 0), x[0])), 1):
            want[i] = place
    assert {x.id: x.place for x in got.collect()} == want


def test_ids_and_writers(spark, tmp_path):
    new = spark.createDataFrame([(i * 7 % 101, f"n{i}") for i in range(101)], "seen bigint, name string")
    stored = spark.createDataFrame([(41,), (7,)], "id bigint")
    assert [r.id for r in merge.next_ids(new, stored, "seen").orderBy("seen").collect()] == list(range(42, 143))
    assert merge.next_ids(new.limit(0), stored, "seen").count() == 0
    io.append_rows(new, f"{tmp_path}/t")
    io.append_rows(new, f"{tmp_path}/t")
    io.write_snapshot(spark.read.parquet(f"{tmp_path}/t").distinct(), f"{tmp_path}/u")
    io.write_json(spark.createDataFrame([(1, None)], "a int, b int"), f"{tmp_path}/j")
    assert spark.read.parquet(f"{tmp_path}/u").count() == 101 and spark.read.text(f"{tmp_path}/j").first()[0] == '{"a":1,"b":null}'
    with open(f"{tmp_path}/d.json", "w") as f:
        f.write('{"x":\n [1, 2]}')
    assert io.read_document(spark, f"{tmp_path}/d.json").first().x == [1, 2]
    roster = spark.createDataFrame([(i, f"S{i}", f"N{i}") for i in (3, 1, 2)], "arrival int, symbol string, name string")
    none = spark.createDataFrame([], "ticker string")
    assert [r.arrival for r in merge.roster_merge(roster, none, 2).collect()] == [1, 2] and merge.seeded(roster, sector="x").first().sector == "x"

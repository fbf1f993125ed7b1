"""Orphan references, filling and history on small hand-made rows, heavy keys included."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tierline.operators import history, impute, references, skew

NODE = "id bigint, name string, sector string, industry string, trailing_pe double, gross_margin double, market_cap double, total_revenue double, forward_pe double, price_to_book double, current_price double, employees bigint"


@pytest.fixture(params=[False, True], ids=["plain", "heavy"])
def heavy(request, monkeypatch):
    """Runs a test as it is and with every key treated as heavy."""
    if request.param:
        monkeypatch.setattr(skew.heavy_of, "__kwdefaults__", {"share": 0, "least": 0})
        for f in (skew.heavy_keys, skew.quantile_cuts):
            d = list(f.__defaults__)
            names = f.__code__.co_varnames[: f.__code__.co_argcount][-len(d) :]
            monkeypatch.setattr(f, "__defaults__", tuple(0 if n in ("least", "share") else 3 if n == "pieces" else v for n, v in zip(names, d)))
    return request.param


def day(n):
    return datetime(2024, 1, 1) + timedelta(days=n)


def edges(spark, rows):
    return spark.createDataFrame(rows, "id bigint, source_id bigint, target_id bigint, last_verified timestamp_ntz, key string, t string")


def log(spark, rows):
    return spark.createDataFrame(rows, "log_id bigint, node_id bigint, op string, effective_at timestamp_ntz, logged_at timestamp_ntz")


def test_orphans_by_time(spark, heavy):
    l = log(spark, [(1, 1, "insert", day(0), day(0)), (1, 1, "insert", day(0), day(0)), (2, 2, "insert", day(5), day(5)), (3, 2, "delete", day(9), day(20)), (4, None, "insert", day(1), day(1)), (5, 3, "insert", None, day(1))])
    e = edges(spark, [(10, 1, 2, day(3), "k", "t"), (11, 1, 2, day(6), None, None), (12, 2, 9, day(9), None, None), (13, None, 1, None, None, None), (14, 1, 2, None, None, None), (14, 1, 2, None, None, None), (15, 3, 1, day(2), None, None)])
    got = sorted((r.row_id, r.field_name) for r in references.orphans(e, l).collect())
    assert got == [(10, "target_id"), (12, "source_id"), (12, "target_id"), (14, "target_id"), (14, "target_id"), (15, "source_id")]
    report = {(r.field_name, r.month): (r.n_refs, r.n_orphans, r.n_keys) for r in references.orphan_report(e, l).collect()}
    assert report["target_id", ""] == (3, 2, 1) and report["source_id", "2024-01"] == (4, 2, 2)


def test_orphans_of_empty_tables(spark):
    e, l = edges(spark, []), log(spark, [])
    assert references.orphans(e, l).count() == 0
    one = edges(spark, [(1, 5, 6, day(0), "", "")])
    assert references.orphans(one, l).count() == 2


def test_random_orphans_match_a_loop(spark, heavy):
    r = random.Random(3)
    entries = [(i, r.randrange(5), r.choice(["insert", "delete"]), day(r.randrange(30)), day(0)) for i in range(80)]
    rows = [(i, r.choice([1, 1, 1, r.randrange(6)]), r.randrange(6), day(r.randrange(-2, 33)), "", "") for i in range(120)]
    want = set()
    for i, s, t, at, _, _ in rows:
        for f, k in (("source_id", s), ("target_id", t)):
            seen = [(x[3], x[0], x[2]) for x in entries if x[1] == k and x[3] <= at]
            if not seen or max(seen)[2] != "insert":
                want.add((i, f))
    assert {(x.row_id, x.field_name) for x in references.orphans(edges(spark, rows), log(spark, entries)).collect()} == want


def versions(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, p double, r string, at timestamp_ntz, loaded timestamp_ntz, version string, s string")
    out = history.versions(df, "id", "at", "loaded", ["p", "r"], texts=("r",)).collect()
    return sorted((x.id, x.version, x.p, x.valid_from, x.valid_to, x.n_states) for x in out)


def test_versions(spark, heavy):
    rows = [
        (1, 1.0, "Strong Buy", day(1), day(1), "x", "y"), (1, 1.0, " strong_buy ", day(2), day(2), "x", "y"), (1, 2.0, "Sell", day(3), day(3), None, None),
        (1, 1.0, "strong buy", day(3), day(4), None, None),  # corrected later
        (1, None, None, day(5), day(5), None, None), (1, None, None, day(6), day(6), None, None), (1, 1.0, None, None, day(1), None, None), (None, 1.0, None, day(1), day(1), None, None),
        (2, float("nan"), "", day(1), None, None, None), (2, float("nan"), "", day(2), None, None, None),
    ]
    got = versions(spark, rows)
    assert [(g[0], g[1], g[3], g[4], g[5]) for g in got] == [(1, 1, day(1), day(5), 3), (1, 2, day(5), None, 2), (2, 1, day(1), None, 2)]
    assert versions(spark, []) == []


def test_random_versions_match_a_loop(spark, heavy):
    r = random.Random(5)
    rows = [(r.choice([1, 1, 1, 2]), float(r.randrange(2)), "a", day(r.randrange(60)), day(i), None, None) for i in range(150)]
    last = {}
    for x in rows:
        last[x[0], x[3]] = x[1]  # loaded in this order
    want = []
    for k in (1, 2):
        states = sorted((t, p) for (i, t), p in last.items() if i == k)
        starts = [t for j, (t, p) in enumerate(states) if not j or states[j - 1][1] != p]
        want += [(k, n + 1, t, starts[n + 1] if n + 1 < len(starts) else None) for n, t in enumerate(starts)]
    assert [(g[0], g[1], g[3], g[4]) for g in versions(spark, rows)] == want


def nodes(spark, n=60):
    r = random.Random(1)
    out = []
    for i in range(n):
        s = r.choice(["Energy", "Steel"])
        cap = 10 ** r.uniform(6, 11)
        out.append((i, f"Firm{i % 50} {s} Inc.", s, {"Energy": "Solar", "Steel": "Mills"}[s], (10 if s == "Energy" else 40) + r.random(), 0.3, cap, cap / 5, 12.0, 2.0, 5.0, 100))
    out[0] = (*out[0][:2], "N/A", *out[0][3:])
    out[1] = (*out[1][:3], None, 99999.0, float("inf"), *out[1][6:])
    out[2] = (2, None, " ", "?", None, None, None, None, None, None, None, None)
    return spark.createDataFrame(out, NODE)


def test_every_missing_cell_is_filled_from_a_donor(spark, heavy):
    df = nodes(spark)
    cells = {(r.row_id, r.field_name): r for r in impute.impute_nodes(df).collect()}
    assert set(cells) == {(0, "sector"), (1, "industry"), (1, "trailing_pe"), (1, "gross_margin"), *((2, f) for f in ("sector", "industry", "trailing_pe", "gross_margin"))}
    source = {r.id: r for r in df.collect()}
    for (i, f), c in cells.items():
        assert c.donor_id != i and source[c.donor_id][f] == (c.value_text if f in ("sector", "industry") else c.value_num)
    assert cells[0, "sector"].value_text == source[0].industry.replace("Solar", "Energy").replace("Mills", "Steel")
    filled = {r.id: r for r in impute.fill_nodes(df).collect()}
    assert len(filled) == 60 and filled[1].trailing_pe_filled and filled[1].trailing_pe < 1000 and not filled[3].sector_filled and filled[3].sector == source[3].sector


def test_filling_without_any_donor_or_row(spark):
    lone = spark.createDataFrame([(1, "X", None, None, None, None, None, None, None, None, None, None)], NODE)
    assert {(r.field_name, r.donor_id) for r in impute.impute_nodes(lone).collect()} == {(f, None) for f in ("sector", "industry", "trailing_pe", "gross_margin")}
    assert impute.impute_nodes(lone.limit(0)).count() == 0


def test_salted_join_equals_a_join(spark):
    r = random.Random(2)
    a = spark.createDataFrame([(i, r.choice([1, 1, 1, 2, None])) for i in range(300)], "i int, k int")
    b = spark.createDataFrame([(1, "x"), (1, "y"), (3, "z")], "k int, v string")
    heavy = skew.heavy_keys(a, ["k"], 0.4, 0)
    assert [r.k for r in heavy.collect()] == [1]
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert sorted(skew.salted_join(a, b, ["k"], how, heavy).select("i").collect()) == sorted(a.join(b, ["k"], how).select("i").collect())


def test_filling_beats_the_mean(spark):
    """One known cell in ten is hidden and filled again."""
    n = spark.read.parquet("/root/testdata/sf0.1/nodes.parquet")
    known = {"trailing_pe": impute.known_number("trailing_pe", 0, 1000, open_lo=True, open_hi=True), "gross_margin": impute.known_number("gross_margin", -1, 1), "sector": impute.known_text("sector")}
    hidden = lambda f: (F.pmod(F.xxhash64("id", F.lit(f)), F.lit(10)) == 0) & known[f].isNotNull()
    masked = n.withColumns({f: F.when(~hidden(f), F.col(f)) for f in known})
    got = impute.fill_nodes(masked).select("id", *[F.col(f).alias(f"v_{f}") for f in known])
    both = n.join(got, "id")
    means = n.agg(*[F.avg(known[f]).alias(f) for f in ("trailing_pe", "gross_margin")]).first()
    err = lambda f, x: F.avg(F.when(hidden(f), F.abs(F.col(f) - x)))
    e = both.agg(
        err("trailing_pe", F.col("v_trailing_pe")).alias("pe"), err("trailing_pe", F.lit(means["trailing_pe"])).alias("pe0"), err("gross_margin", F.col("v_gross_margin")).alias("gm"), err("gross_margin", F.lit(means["gross_margin"])).alias("gm0"),
        F.avg(F.when(hidden("sector"), (F.lower("sector") == F.lower("v_sector")).cast("int"))).alias("sector"),
    ).first()
    assert e.pe < 0.6 * e.pe0 and e.gm < 0.85 * e.gm0 and e.sector > 0.75, e


def test_categories_of_like_size_are_told_apart(spark):
    """Two sectors of the same market cap that differ in another feature."""
    rows = [(i, f"Firm {i}", None if i % 10 == 0 else ("A" if i % 2 else "B"), None, None, None, 1e9 * (1 + i % 7), 1e6 * (1 + i % 5), 10.0 if i % 2 else 40.0, None, None, None) for i in range(1, 201)]
    rows += [(1000 + i, f"Odd {i}", None, None, None, None, 1e9 * (1 + i % 7), 1e6 * (1 + i % 5), 10.0 if i % 2 else 40.0, None, None, None) for i in range(20)]
    got = {r.row_id: r.value_text for r in impute.impute_nodes(spark.createDataFrame(rows, NODE)).where("field_name = 'sector'").collect()}
    assert all(got[1000 + i] == ("A" if i % 2 else "B") for i in range(20)) and len(got) == 40

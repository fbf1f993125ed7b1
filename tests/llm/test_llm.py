"""The subpackage's operators on small fixtures, against brute force, exact round trips and each query's SQL."""

import random
import time
from collections import Counter, defaultdict
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tierline.llm")

from tests.verify import compare, connect
from tierline.llm import companies, consensus, encoding, leakage, merkle, minhash, names, packing, queries, vocabulary
from tierline.operators import skew

SF = "/root/testdata/sf0.001"


@pytest.fixture(params=[False, True], ids=["plain", "heavy"])
def heavy(request, monkeypatch):
    """Runs a test as it is and with every key treated as heavy."""
    if request.param:
        monkeypatch.setattr(skew.heavy_keys, "__defaults__", (0, 0))
        monkeypatch.setattr(skew.heavy_of, "__kwdefaults__", {"share": 0, "least": 0})
    return request.param


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name in queries.SQL:
        assert compare(spark, connect(SF), queries.QUERIES[name], queries.SQL[name], SF) == ""
    else:
        queries.QUERIES[name](spark, SF).count()


# problem 3
def test_merkle_nested(spark):
    schema = "id bigint, r struct<b:string,a:array<string>,m:map<string,int>>"
    rows = [(1, ("Raw  Materials", ["x"], {"p": 1, "q": 2})), (2, ("materials raw!", ["X "], {"q": 2, "p": 1})), (3, ("raw", ["x"], {"p": 1, "q": 2})), (4, None), (5, None), (6, (None, None, None)), (7, ("", [], {})), (8, ("raw raw", ["x"], {"p": 1, "q": 2}))]
    got = {r.kept_id: r.n_copies for r in merkle.collapse(spark.createDataFrame(rows, schema), "id", ["r"]).collect()}
    assert got == {1: 2, 3: 1, 4: 2, 6: 1, 7: 1, 8: 1}
    swapped = spark.createDataFrame([(1, (["x"], "a b"))], "id bigint, r struct<a:array<string>,b:string>")
    plain = spark.createDataFrame([(1, ("b A", ["x"]))], "id bigint, r struct<b:string,a:array<string>>")
    assert merkle.roots(swapped, "id", ["r"]).first().root == merkle.roots(plain, "id", ["r"]).first().root


def test_copies(spark, heavy):
    rows = [(i, 1, 2, t) for i, t in enumerate(["A b", "b,A", None, "", "-", None, "a-b ä", "Ä B a"])]
    df = spark.createDataFrame(rows, "id bigint, s bigint, t bigint, k string")
    assert sorted(map(tuple, merkle.copies(df, "id", ["s", "t", "k"]).collect())) == [(0, 1), (2, 5), (3, 4), (6, 7)]
    assert merkle.copies(df.limit(0), "id", ["k"]).count() == 0


# problem 10
TEXTS = ["Die Größe der Prüfung wäre später über Köln zu klären.", "La société a dû arrêter près de l’usine à Crévoix — hélas.", "Zakład wydłużył się, więc ceny wzrosły już później.", "Компания закупает детали и хранит их на складе."]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("read_as", ["cp1252", "latin-1", "cp437", "mac_roman", "cp1250", "cp1251"])
@pytest.mark.parametrize("layers", [1, 2])
def test_round_trip(text, read_as, layers):
    bad = text
    try:
        for _ in range(layers):
            bad = bad.encode("utf-8").decode(read_as)
    except UnicodeDecodeError:
        pytest.skip("these bytes have no meaning there")
    fixed, n, garbled, whole = encoding.repair(bad)
    assert garbled and n >= 1
    if layers == 1:
        assert fixed == text and whole


@pytest.mark.parametrize("deep", [5, 7])
def test_many_layers(deep):
    bad = TEXTS[0]
    for _ in range(deep):
        bad = bad.encode("utf-8").decode("latin-1")
    assert encoding.repair(bad) == (TEXTS[0], deep, True, True)


def test_sound_texts():
    for t in [*TEXTS, "Güte „Å“, Ø 12 × 3 mm ± 5 %", "SITUAÇÃO DA PRODUÇÃO: AMANHÃ NÃO", "Schaltplan: ├─ Ofen ┬ Pumpe └─ Filter", "grade Γ-7, √2 µm, ∂ ≤ 0,5", "café &quot;x&quot; &#246;", "", "plain", "Партия «Ђ», знак «Г‑2»."]:
        assert encoding.repair(t)[0] == t and not encoding.repair(t)[2], t


def test_references_and_residue():
    assert encoding.repair("caf&#195;&#169;-sized &#246;ffnet &amp; f&#xC3;&#xBC;r &Atilde;&copy; &quot;x&quot;") == ("café-sized &#246;ffnet &amp; für é &quot;x&quot;", 1, True, True)
    for t in ("&#246;&#223; gro&#223;e &Uuml;&ouml;", "на заводе\xa0работают люди", "a &#12; b&#55555; &#99999999; &nosuch;&#; &", "x" * 100_000 + "&#" * 50_000):
        assert encoding.repair(t) == (t, 0, False, True), t[:40]
    fixed, _, garbled, whole = encoding.repair("Πα∂√ω ωr∂π √ωn∂ab πxα√o ∂oωr√ μa∂π " * 3)
    assert garbled and not whole


def test_sound_documents_stay(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    rest = docs.where(~F.col("text").rlike(encoding.SUSPECT) & ~F.col("text").rlike(encoding.REFERENCES))
    texts = [r.text for r in rest.select("text").collect()]
    assert len(texts) > 800 and all(encoding.repair(t)[0] == t for t in texts)


def test_garbled(spark):
    df = spark.createDataFrame([(1, "cafÃ© au lait"), (2, None), (3, ""), (4, "café"), (5, "besch�ftigt"), (6, "Ã©" * 20_000), (1, "cafÃ© au lait")], "doc_id bigint, text string").selectExpr("*", "'x' AS repaired", "1 AS layers")
    got = sorted((r.doc_id, r.whole) for r in encoding.garbled(df).collect())
    assert got == [(1, True), (1, True), (5, False), (6, True)]


# problems 6 and 7
def test_names():
    same = ["The Kondtrem Brexzond Medical Inc.", "KONDTREM BREXZOND MEDICAL", "Kondtrem-Brexzond Med. Corp. Sponsored ADR", "Medical of Kondtrem Brexzond plc", "Kóndtrem Brexzond Mdcl (Göllheide)", "kondtrem_brexzond medical's", "Kondtrem  Brexzond  Medical, N.V. ", "medical kondtrem brexzond"]
    lex = names.lexicon_of(("automation", "data", "foods", "manufacturing", "medical", "mining", "services", "steel"))
    assert {names.parse(s, lex) for s in same} == {(("kondtrem", "brexzond"), "medical")}
    assert names.parse("Data Services Rilvolt Rindgark", lex)[1] == "data services" == names.parse("Rilvolt Rindgark Data Svcs Ltd.", lex)[1]
    assert names.parse("", lex) == ((), "") and names.parse("Inc.", lex)[0] == ("inc",) and names.parse("Girmil Srvs Mfg", lex) == (("girmil", "srvs"), "manufacturing")
    assert [lex.kin(t) for t in ("auto'n".replace("'", ""), "mng", "mfg", "steeel", "fds", "m", "xyz", "kondtrem")] == ["automation", "mining", "manufacturing", "steel", "foods", "", "", ""]
    assert [names.ticker_of(t) for t in ("NYSE: abcd", "$ABCD", "(abcd)", "ticker ABCD", "ABCD US", "N/A", None, " ", "Two Words")] == ["ABCD"] * 5 + [""] * 4


def test_osa_matches_a_full_table():
    def full(a, b):
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    r = random.Random(1)
    for _ in range(1500):
        a, b = ("".join(r.choice("abc") for _ in range(r.randrange(8))) for _ in "12")
        for most in (1, 2, 3):
            assert names.osa(a, b, most) == min(full(a, b), most + 1)


def test_collision_curve(spark):
    assert minhash.bands_for(0.5, 4, 0.97) == 55
    assert [minhash.tuned(n, 0.5, 0.97, 0.1) for n in (0, 40_000, 1_000_000)] == [(4, 55), (4, 55), (5, 111)]
    by_chance = [n * 0.1 ** minhash.tuned(n, 0.5, 0.97, 0.1)[0] for n in (10**4, 10**6, 10**8, 10**10)]  # a band
    assert max(by_chance) < 60
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghijklmnopqrst") for _ in range(14)) for _ in range(400)]
    typos = [w[:4] + "z" + w[5:9] + "y" + w[10:] for w in words]  # two edits
    df = spark.createDataFrame([(i, w, 0) for i, w in enumerate(words)] + [(i, w, 1) for i, w in enumerate(typos)], "i int, w string, s int")
    keys = df.select("i", "s", minhash.band_keys(companies.Q, 4, 55)("w").alias("k")).collect()
    by = {(x.i, x.s): set(x.k) for x in keys}
    assert np.mean([bool(by[i, 0] & by[i, 1]) for i in range(400)]) > 0.93
    assert spark.createDataFrame([(None,), ("",)], "w string").select(minhash.band_keys(2, 4, 3)("w").alias("k")).where("size(k) > 0").count() == 0


def company_rows(spark):
    at = lambda n: datetime(2024, 1, n)
    rows = [
        (1, "Kondtrem Brexzond Medical Inc.", "KBMED", "Healthcare", "Devices", 5e9, at(1)), (2, "KONDTREM BREXZOND MEDICAL", "$KBMED", None, None, -1.0, at(3)), (3, "Kondtrm Brexzond Med.", None, "Healthcare", "Devices", None, at(2)),
        (4, "Kondtrem Brexzond Foods Corp.", "KBFOO", "Food", "Farm", 1e9, None), (5, "Kondtrem Brexzond", "NYSE:KBFOO", "Food", "Farm", 1e9, None),
        (6, "Lonely Harbul Steel", None, "S", "I", 1.0, at(1)), (7, None, None, None, None, None, None), (8, "", "", "", "", float("nan"), None),
    ]
    # enough names for words to be learned from
    rows += [(100 + i, f"{a}{b} {w} plc", None, None, None, None, None) for i, (a, (b, w)) in enumerate((a, x) for a in ("Zul", "Quor", "Wyx", "Jip", "Obr") for x in (("aq", "Medical"), ("ewir", "Foods"), ("opsy", "Steel"), ("ugtha", "Paper")))]
    return spark.createDataFrame(rows, "id bigint, name string, ticker string, sector string, industry string, market_cap double, last_updated timestamp_ntz")


def test_groups_and_survivors(spark, heavy):
    df = company_rows(spark).selectExpr("*", "1 AS group_id", "'x' AS core")
    groups = {r.row_id: r.group_id for r in companies.company_groups(df).collect() if r.row_id < 100}
    assert groups == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    assert companies.company_groups(df.limit(0)).count() == 0
    got = {r.group_id: (r.n_rows, r.name_id, r.ticker_id, r.cap_id) for r in consensus.survivors(df).collect()}
    assert got == {1: (3, 2, 2, 1), 4: (2, 4, 4, 4)}
    assert consensus.survivors(df.limit(0)).count() == 0


def test_mentions(spark, heavy):
    said = ["Kondtrem Brexzond Mdcl", "Brexzond Kondtrem Medical plc", "Kondtrem Brexznod Foods", "Kondtrem Brexzond", "KBFOO US", "Kondtrem Brexzond Steel", "Nickname", "Unknown Company Paper", "", " ", None]
    m = spark.createDataFrame([(s,) for s in said], "t string")
    a = spark.createDataFrame([("Nickname", 2, "KBMED"), ("Nickname", 1, "KBFOO")], "query_text string, hit_rank int, symbol string")
    got = {r.text: r.group_id for r in companies.link_mentions(m, "t", company_rows(spark), a).collect()}
    assert got == {"Kondtrem Brexzond Mdcl": 1, "Brexzond Kondtrem Medical plc": 1, "Kondtrem Brexznod Foods": 4, "KBFOO US": 4, "Nickname": 4}


def test_names_off_any_list(spark):
    said = ["Goldman Sachs Group Inc", "Goldmann Sachs Group", "Microsoft Corporation", "Microsft Corp.", "Acme Textiles Ltd", "Acme Textils Ltd", "Acme Foods", "Компания Ромашка", "компания ромашка ltd", "Bank of New York Mellon", "Bank of New York Trust"]
    df = spark.createDataFrame([(i, n, None, None, None, None) for i, n in enumerate(said)], "id bigint, name string, ticker string, sector string, industry string, market_cap double")
    assert {r.row_id: r.group_id for r in companies.company_groups(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9, 10: 10}
    m = spark.createDataFrame([("microsoft inc",), ("Sachs Goldman",), ("Nobody",), ("Acme Txtls",)], "t string")
    a = spark.createDataFrame([], "query_text string, hit_rank int, symbol string")
    assert {r.text: r.group_id for r in companies.link_mentions(m, "t", df, a).collect()} == {"microsoft inc": 2, "Sachs Goldman": 0, "Acme Txtls": 4}


def test_very_long_names(spark):
    words = [f"w{i}" for i in range(800)]
    said = ["Long " + "w" * 20_000, "Long " + "w" * 19_999, " ".join(words), " ".join(words[:-1]) + " wz", "the " * 5000, "Acme Foo", "acme foo " * 3000]
    df = spark.createDataFrame([(i, n, None, None, None, None) for i, n in enumerate(said)], "id bigint, name string, ticker string, sector string, industry string, market_cap double").selectExpr("*", "1 AS v", "2 AS words", "3 AS t", "4 AS company")
    assert {r.row_id: r.group_id for r in companies.company_groups(df).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5, 6: 6}


def test_descriptors(spark):
    df = company_rows(spark)
    assert companies.descriptors(df, "name") == ("foods", "medical", "paper", "steel") and companies.descriptors(df.limit(0), "name") == ()


def test_letters_bound_the_edits():
    r = random.Random(8)
    for _ in range(500):
        a = tuple("".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 10))) for _ in range(r.randrange(1, 4)))
        b = list(a)
        r.shuffle(b)
        for _ in range(r.randrange(3)):
            i = r.randrange(len(b))
            j = r.randrange(len(b[i]))
            b[i] = r.choice([b[i][:j] + "x" + b[i][j:], b[i][:j] + "y" + b[i][j + 1 :], b[i][: max(j, 1)] + b[i][max(j, 1) + 1 :]])
        b = tuple(b)
        if names.monge_elkan(a, b) >= companies.LEAST:
            bits = ((names.letters(a) ^ names.letters(b)) & (1 << 64) - 1).bit_count()
            assert bits <= max(names.slack(c, companies.LEAST, companies.EDITS) for c in (a, b)), (a, b)


def test_star_clusters(spark):
    ranks = {c: i for i, c in enumerate("abcdef")}
    links = [("a", "b", 0.9), ("b", "c", 0.95), ("c", "d", 0.8)]
    e = spark.createDataFrame([(u, v, s, ranks[u], ranks[v]) for a, b, s in links for u, v in ((a, b), (b, a))], "u string, v string, like double, u_rank int, v_rank int")
    assert {r.v: r.center for r in companies.star(e).collect()} == {"a": "a", "b": "c", "c": "c", "d": "c"}
    assert companies.star(e.limit(0)).count() == 0


def test_stars_match_a_loop(spark):
    r = random.Random(12)
    pairs = {(a, b): r.choice([0.8, 0.9, 1.0]) for a in range(40) for b in range(a) if r.random() < 0.08}
    near: dict = defaultdict(dict)
    for (a, b), s in pairs.items():
        near[a][b] = near[b][a] = s
    centers: set = set()
    for v in sorted(near):
        if not centers & {u for u in near[v] if u < v}:
            centers.add(v)
    want = {v: v if v in centers else min((-near[v][u], u) for u in near[v] if u in centers)[1] for v in near}
    e = spark.createDataFrame([(u, v, near[v][u], u, v) for v in near for u in near[v]], "u int, v int, like double, u_rank int, v_rank int")
    assert {x.v: x.center for x in companies.star(e).collect()} == want


def test_candidates_match_brute_force(spark):
    r = random.Random(11)
    swap = lambda w, i: w[:i] + w[i + 1] + w[i] + w[i + 2 :]
    words = ["".join(r.choice(["b", "d", "k", "l", "m", "n", "r", "s", "t", "v"]) + r.choice("aeiou") for _ in range(4)) for _ in range(30)]
    firm = [tuple(words[i : i + 3]) for i in range(0, 30, 3)] + [("northern", "pacific", "railways")]
    typed = [("notrhern", "pacfiic", "railwasy")] + [tuple(swap(w, r.randrange(1, 6)) for w in r.sample(f, 3)) for f in firm for _ in range(4)]
    typed += [tuple(w[:i] + "z" + w[i + 1 :] for w, i in zip(f, (1, 3, 5), strict=True)) for f in firm]
    rows = [(" ".join(c), c in firm, names.letters(c), names.slack(c, companies.LEAST, companies.EDITS)) for c in dict.fromkeys(firm + typed)]
    vertices = spark.createDataFrame(rows, "words string, face boolean, bits bigint, slack int").selectExpr("cast(words as binary) AS v", "*", "'' AS trade")
    keys = minhash.band_keys(companies.Q, *minhash.tuned(len(firm), companies.SIMILARITY, companies.RECALL, companies.BACKGROUND))
    bands = {tuple(x.words.split()): set(x.k) for x in vertices.select("words", keys(F.regexp_replace("words", " ", "")).alias("k")).collect()}
    meet = lambda a, b: bands[a] & bands[b] or sorted("".join(a)) == sorted("".join(b))
    alike = lambda a, b: meet(a, b) and names.monge_elkan(a, b, companies.EDITS) >= companies.LEAST
    want = {(" ".join(a), " ".join(b)) for a in {*typed} - {*firm} for b in firm if alike(a, b)} | {tuple(sorted((" ".join(a), " ".join(b)))) for a in firm for b in firm if a < b and alike(a, b)}
    got = {(bytes(x.l).decode(), bytes(x.r).decode()) for x in companies.candidates(vertices, ["face"]).collect()}
    assert got == want and (" ".join(typed[0]), " ".join(firm[-1])) in got and len(want) > 45


def test_bands_a_few_at_a_time(spark, monkeypatch):
    r = random.Random(13)
    words = ["".join(r.choice("bdklmnrst") + r.choice("aeiou") for _ in range(4)) for _ in range(60)]
    firm = [" ".join(words[i : i + 2]) for i in range(0, 60, 2)]
    typed = [f[:i] + "z" + f[i + 1 :] for f in firm for i in (1, 3, 5)] + [f.replace("a", "").replace("e", "") for f in firm]
    rows = [(f"{i:04}", w, i < 30, names.letters(c := tuple(w.split())), names.slack(c, companies.LEAST, companies.EDITS)) for i, w in enumerate(dict.fromkeys(firm + typed))]
    vertices = spark.createDataFrame(rows, "v string, words string, face boolean, bits bigint, slack int").withColumn("trade", F.lit("")).repartition(3)
    joined, join = [], companies.salted_join
    monkeypatch.setattr(companies, "salted_join", lambda left, *a, **k: joined.append(left.count()) or join(left, *a, **k))
    results = []
    for abreast, whole in ((1, 10**6), (5, 0), (5, 15 * len(rows)), (60, 0)):
        monkeypatch.setattr(companies, "ABREAST", abreast, raising=False)
        monkeypatch.setattr(companies, "WHOLE", whole, raising=False)
        joined.clear()
        results.append(sorted((x.l, x.r, x.like, x.l_face) for x in companies.candidates(vertices, ["face"]).collect()))
        most = max(abreast, whole // len(rows))
        assert max(joined) <= most * len(rows) and len(joined) == -(-57 // most)  # what is spread follows the names, not the bands
    assert results[0] == results[1] == results[2] == results[3] and len(results[0]) > 80 and len({x[:2] for x in results[0]}) == len(results[0])


def test_bands_by_parts(spark):
    df = spark.createDataFrame([("kondtrembrexzond",), ("ab",), ("",), (None,)], "w string")
    whole, *parts = (df.select(k("w").alias("k")).collect() for k in (minhash.band_keys(2, 4, 7), minhash.band_keys(2, 4, 3), minhash.band_keys(2, 4, 4, first=3)))
    assert [x.k for x in whole] == [x.k + y.k for x, y in zip(*parts, strict=True)] and len(whole[0].k) == 7


def test_mentions_leave_no_files(spark):
    from tierline import session

    left, jvm = Path(session._folder(spark).removeprefix("file:")), spark._jvm
    shuffles = lambda: sum(f.getName().startswith("shuffle_") for f in jvm.scala.jdk.javaapi.CollectionConverters.asJava(jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    m = spark.createDataFrame([("Kondtrem Brexzond Mdcl",), ("KBFOO US",)], "t string")
    a = spark.createDataFrame([], "query_text string, hit_rank int, symbol string")
    tables, files = set(left.iterdir()), shuffles()
    found = companies.link_mentions(m, "t", company_rows(spark), a)
    new = set(left.iterdir()) - tables
    assert len(new) == 1 and next(iter(new)).name.startswith("table-")  # the result
    for _ in range(100):  # files are removed beside the work
        if shuffles() <= files:
            break
        time.sleep(0.1)
    assert shuffles() <= files
    assert {x.text: x.group_id for x in found.collect()} == {"Kondtrem Brexzond Mdcl": 1, "KBFOO US": 4}


def test_consensus_by_majority(spark, heavy):
    at = datetime(2024, 1, 1)
    vals = ["Alpha Beta Corp", "Alpha Beta Corp", "Alpha Betta Corp", "Alpha Beta Corp Ltd", "The Alpha Beta"]
    df = spark.createDataFrame([(1, "name", v, i, at + timedelta(days=i)) for i, v in enumerate(vals)], "grp bigint, field_name string, value string, row_id bigint, at timestamp_ntz")
    assert consensus.consensus(df, trust_latest=False).first().value == "Alpha Beta Corp"
    assert consensus.consensus(df).first().value == "The Alpha Beta"


@pytest.mark.parametrize("fan_in", [256, 3])
def test_consensus_in_a_tree(spark, monkeypatch, fan_in):
    monkeypatch.setattr(consensus, "FAN_IN", fan_in)
    r = random.Random(9)
    base = {g: [f"w{g}{i}" for i in range(5)] for g in range(6)}
    rows, want = [], {}
    for g, tokens in base.items():
        said = [tokens[:i] + ["odd" + str(k)] + tokens[i + 1 :] for k, i in enumerate(r.choices(range(5), k=12))] + [tokens] * (3 + g % 2)
        r.shuffle(said)
        rows += [(g, "f", " ".join(t), 100 * g + i, None) for i, t in enumerate(said)]
        want[g] = (" ".join(tokens), min(100 * g + i for i, t in enumerate(said) if t == tokens))
    rows.append((50, "f", "alone", 7, None))
    df = spark.createDataFrame(rows, "grp bigint, field_name string, value string, row_id bigint, at timestamp_ntz")
    got = {x.grp: (x.value, x.row_id) for x in consensus.consensus(df, trust_latest=False).collect()}
    assert got == want | {50: ("alone", 7)}


# problem 2
def test_vocabulary(spark, heavy):
    terms = spark.createDataFrame([(1, "f", "Raw Materials", "feedstock; base stuff"), (2, "f", "Printed Circuit Boards", None), (3, "f", "Raw Sugar", None), (4, "g", "Raw Materials", None)], "term_id int, field_name string, term string, aka string")
    cases = {"raw materials": 1, "MATERIALS, raw": 1, "Rwa Matreials": 1, "Raw Mtrls": 1, "RawMaterials": 1, "raw mater.": 1, "K012 Raw Materials": 1, "Feedstok": 1, "base stuff": 1, "PCB": 2, "Boards Printed Circuit etc.": 2, "Raw": 0, "Raw Fish": 0, "n/a": 0, "Raw Materials Sugar": 0, "x" * 5000: 0}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)] + [(90, None), (91, "  \t"), (92, "PCB"), (92, "PCB")], "id bigint, f string")
    got = [(r.row_id, r.term_id) for r in vocabulary.map_values(df, terms, "id", ("f",)).collect()]
    assert dict(got) == {i: t for i, t in enumerate(cases.values())} | {92: 2} and len(got) == len(cases) + 2
    assert {r.term_id for r in vocabulary.map_values(df, terms.limit(0), "id", ("f",)).collect()} == {0}


def test_vocabulary_long_tokens_codes_and_fillers(spark):
    r = random.Random(5)
    long = ["".join(r.choice("abcdefghij") for _ in range(n)) for n in (13, 64, 65, 66, 300, 3000)]
    terms = spark.createDataFrame([(i, "f", t, None) for i, t in enumerate(long, 1)] + [(50, "f", "H2 Tanks", None), (51, "f", "Power Supply", None), (52, "f", "Gas Valves", None), (53, "f", "Copper Wire", None), (54, "f", "Steel Rods", None), (55, "f", "Glass Wool", None)], "term_id int, field_name string, term string, aka string")
    typo = lambda t: t[: len(t) // 3] + "z" + t[len(t) // 3 : -3] + t[-2:]
    cases = {typo(t): i for i, t in enumerate(long, 1)} | {"h2 tanks": 50, "tanks": 50, "Gas Valves urgent": 52, "h3 tanks": 50, "fish tanks x": 0}
    names = {51: "Power Supply", 52: "Gas Valves", 53: "Copper Wire", 54: "Steel Rods", 55: "Glass Wool"}
    cases |= {f"supply of {n}": i for i, n in names.items() if i > 51} | {f"{n} bulk": i for i, n in names.items()} | {f"{n} 12": i for i, n in names.items()} | {"supply": 0, "gsa valves bulk 7": 52, "supply power": 51}
    df = spark.createDataFrame(list(enumerate(cases)), "id bigint, f string")
    got = {r.row_id: r.term_id for r in vocabulary.map_values(df, terms, "id", ("f",)).collect()}
    assert {t: got[i] for i, t in enumerate(cases)} == cases


# problem 8
def test_differencing():
    assert sorted(np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == [14, 16]
    r = np.random.default_rng(1)
    for _ in range(30):
        sizes = np.sort(r.integers(1, 100, r.integers(1, 60)))[::-1]
        bins = packing.fit(sizes, 100)
        assert np.bincount(bins, weights=sizes).max() <= 100 and len(bins) == len(sizes)


def test_pack(spark):
    r = random.Random(3)
    sizes = {i: r.choice([1, 5, 20, 99, 100, 101, 250, 300]) for i in range(300)}
    df = spark.createDataFrame([*sizes.items(), (1000, 0), (1001, None)], "doc_id bigint, n_tokens bigint")
    rows = packing.pack(df, 100, 4).collect()
    load, parts = Counter(), defaultdict(list)
    for x in rows:
        load[x.window_id] += x.n_tokens
        parts[x.doc_id].append((x.piece, x.start_token, x.n_tokens))
    assert max(load.values()) <= 100 and set(parts) == set(sizes)
    for d, p in parts.items():
        p.sort()
        assert sum(n for *_, n in p) == sizes[d] and all(s == i * 100 for i, s, _ in p) and len(p) == -(-sizes[d] // 100)
    assert sum(load.values()) / (100 * len(load)) > 0.85
    assert packing.pack(df.limit(0)).count() == 0


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "doc_id bigint, text string")
    assert [tuple(r) for r in packing.token_counts(df, tokenizer=queries.TOKENIZER).orderBy("doc_id").collect()] == [(1, 2), (2, 0), (3, 0)]


# problem 9
ITEM = "Between March and June the panel heard 412 carriers at Vorlund. A drum stamped 7719 was opened twice by Hexmar Tolvind. Nobody could say why bill 3308 named Drasko Pell as its payee."
OTHER = "Between April and May the panel heard 95 drivers at Sundmoor. A drum stamped 1120 was opened often by Kelbro Vant. Nobody could say why bill 9910 named Untor Zill as its payee."


def test_leaks(spark):
    a, b, c = ITEM.split(". ")
    docs = {
        1: f"Intro words. {ITEM} Outro.", 2: f"{c} {b}. {a}.", 3: OTHER, 4: b, 5: f"Some text. {a.upper()},\t {b.replace('twice', 'thrice')}", 6: None, 7: "", 8: "filler " * 20_000 + a + ". " + b,
        9: a.replace("panel", "&quot;panel&quot;") + " x " + c, 10: "Read the passage above and answer in one word.",
    }
    d = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").selectExpr("*", "1 AS item_id")
    stock = " Read the passage above and answer in one word."
    items = spark.createDataFrame([(7, ITEM + stock), (8, "Something wholly different about lacquered barrels and idle cranes near Fenwick harbour." + stock), (9, None)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(d, items).collect()}
    assert got == {(1, 7), (2, 7), (5, 7), (8, 7), (9, 7)}
    assert leakage.leaks(d, items.limit(0)).count() == 0


@pytest.mark.parametrize("block", [leakage.BLOCK_CHARS, 150])
def test_copies_and_stock(spark, monkeypatch, block):
    monkeypatch.setattr(leakage, "BLOCK_CHARS", block)
    monkeypatch.setattr(leakage, "SCAN_BLOCKS", 2)
    stock = "Read the whole passage above with care and then answer in one word."
    single = "Lacquered barrels stood near Fenwick harbour while idle cranes rusted."
    items = [(1, ITEM), (2, ITEM.upper()), (3, f"{ITEM} Who was it?"), *[(k, f"{single.replace('Fenwick', w)} {stock}") for k, w in ((4, "Fenwick"), (5, "Garrowby"), (6, "Tolmachev"))]]
    docs = spark.createDataFrame([(1, f"Intro. {ITEM}"), (2, stock), (3, single)], "doc_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(docs, spark.createDataFrame(items, "item_id bigint, text string"), 0.4).collect()}
    assert {x for x in got if x[0] < 3} == {(1, 1), (1, 2), (1, 3)} and (3, 4) in got


def test_short_sentences(spark):
    items = {1: "A. Yes. B. No. C. Both. D. Neither. E. Unsure.", 2: "Who paid Pell?", 3: "Why? He fled. Where? To Sundmoor. Who? Pell."}
    docs = {1: f"Quiz: {items[1]} End.", 2: "so who paid  Pell", 3: f"Intro {items[3]}", 4: "Yes. No. Pell was paid by nobody. Who?"}
    frame = lambda rows, c: spark.createDataFrame([*rows.items()], f"{c} bigint, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(frame(docs, "doc_id"), frame(items, "item_id")).collect()}
    assert got == {(1, 1), (2, 2), (3, 3)}


def test_the_filter_keeps_its_budget(spark):
    r = random.Random(13)
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(3, 9)))
    items, docs = [], []
    for i in range(30):
        text = " ".join(word() for _ in range(40)).capitalize() + "."
        k = int((len(text) - leakage.Q) * leakage.SURE)
        at = [int((j + 0.5) * len(text) / k) for j in range(k)]
        items.append((i, text))
        docs.append((i, "Before it. " + "".join("#" if j in at else c for j, c in enumerate(text)).replace("#", "qz"[i % 2]) + " After it."))
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), coverage=0.01)
    assert {(x.doc_id, x.item_id) for x in got.collect()} == {(i, i) for i in range(30)}


def test_repeated_grams(spark):
    items = spark.createDataFrame([(1, "Tick tock tick tock tick tock tick tock tick tock tick tock tick tock."), (2, "Ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha.")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "So the clock went tick tock tick tock tick tock tick tock tick tock tick tock tick tock. Then it stopped."), (2, "x " * 500 + "ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha ha. End."), (3, "tick and tock and tick, ha and ha and ha")], "doc_id bigint, text string")
    assert {(x.doc_id, x.item_id) for x in leakage.leaks(docs, items).collect()} == {(1, 1), (2, 2)}


def test_distance_matches_a_full_table():
    def full(a, b):
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return min(row)

    r = random.Random(6)
    for _ in range(300):
        a = [r.choice([97, 98, 99]) for _ in range(12)]
        b = [r.choice([97, 98, 99]) for _ in range(2)] + [x for x in a if r.random() > 0.1] + [r.choice([97, 98])] * 2
        d = full(a, b)
        if d <= 4:
            assert leakage.distance(np.array(a, dtype=np.uint8), np.array(b, dtype=np.uint8), 8) == d

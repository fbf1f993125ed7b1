"""Problems 6 and 7: rows and mentions that stand for one company, whatever the spelling."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from ..operators.skew import heavy_keys, salted_join
from ..session import cut, scratch, written
from .minhash import band_keys, tuned
from .names import CONSONANTS, FORMS, letters, lexicon_of, monge_elkan, osa, parse, skeleton, slack, ticker_of

#: Padded q-grams of the joined core words; the Jaccard similarity (two edits in a dozen letters) and the recall that the bands are tuned to, and the similarity of unlike names, as measured.
Q, SIMILARITY, RECALL, BACKGROUND = 2, 0.5, 0.97, 0.1
#: Least Monge–Elkan similarity of names that can mean one company, and the most edits of a word in it.
LEAST, EDITS = 0.8, 2
#: Letters of a name up to which a bound by Spark's own edit distance, whose time grows with their square, is worth its while.
WORTH = 128
#: A word describes and does not name if it stands with this share of the distinct names, and with so many of them.
COMMON, SEVERAL = 1 / 200, 5
#: Bands met at a time, and the keys of all names up to which more are, as a pass has a cost of its own.
ABREAST, WHOLE = 4, 1_000_000

_NAME = T.StructType([*[T.StructField(c, T.StringType()) for c in ("words", "trade", "tick")], T.StructField("bits", T.LongType()), T.StructField("slack", T.IntegerType())])


def descriptors(names: DataFrame, c: str, share: float = COMMON, least: int = SEVERAL) -> tuple[str, ...]:
    """The words that describe companies rather than name them, learned as those that stand with many different names.

    A word counts by the different words that lead the names in which it stands (the next word, where it leads itself), so
    many spellings of one company make no descriptor of its name. Legal forms count as nothing. The names have so many words
    each on average, divided by ``share``, as such words at most.
    """
    distinct = names.select(F.lower(c).alias("name")).where("name is not null").distinct()
    tokens = F.filter(F.split("name", r"[^\p{L}\p{N}]+"), lambda w: (F.length(w) >= 3) & ~w.isin(*sorted(FORMS)))
    stands = F.transform("tokens", lambda w, i: F.struct(w.alias("word"), F.when(i == 0, F.get("tokens", F.lit(1))).otherwise(F.get("tokens", F.lit(0))).alias("with")))
    every = F.array(F.struct(F.lit("").alias("word"), F.col("name").alias("with")))  # '' counts the names
    counts = distinct.withColumn("tokens", tokens).select(F.explode(F.concat(every, stands)).alias("s")).select("s.*").groupBy("word").agg(F.count_distinct("with").alias("n"))
    total = counts.where("word = ''").select("n").scalar()
    return tuple(sorted(r["word"] for r in counts.where((F.col("word") != "") & (F.col("n") >= least) & (F.col("n") >= total * F.lit(share))).select("word").collect()))


def parsed(known: tuple[str, ...]):
    """Arrow UDF: a name to its core words (between blanks), descriptors, ticker, and the sketch of its letters."""

    @F.pandas_udf(_NAME)
    def parse_names(names: pd.Series) -> pd.DataFrame:
        lexicon, out = lexicon_of(known), []
        for n in names:
            core, trade = parse(n, lexicon) if n else ((), "")
            out.append((" ".join(core), trade, ticker_of(n), letters(core), slack(core, LEAST, EDITS)))
        return pd.DataFrame(out, columns=["words", "trade", "tick", "bits", "slack"])

    return parse_names


@F.pandas_udf(T.StringType())
def ticker(texts: pd.Series) -> pd.Series:
    return texts.map(ticker_of)


@F.pandas_udf(T.ArrayType(T.LongType()))
def whole_keys(words: pd.Series) -> pd.Series:
    """Two more keys of a core: its consonants, and all its letters in sorted order."""

    def one(core: str) -> list[int]:
        tokens = tuple(core.split(" "))
        k = skeleton(tokens)
        return [xxh3_64_intdigest(x) - (1 << 63) for x in ("c" + k, "l" + "".join(sorted("".join(tokens))))] if len(k) >= 5 else []

    return words.map(one)


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Monge–Elkan similarity of core words; a word without vowels equals the words of its consonants."""

    def one(x: tuple[str, ...], y: tuple[str, ...]) -> float:
        s = monge_elkan(x, y, EDITS)
        if s < 1 and len(k := skeleton(x)) >= 5 and k == skeleton(y):
            p, q = "".join(x), "".join(y)  # nearly 1 for consonants alone, less the more vowels differ
            s = max(s, 0.97 if len(p) != len(q) else 1 - osa(p, q, 4) / max(len(p), 1))
        return round(s, 9)

    return pd.Series([one(tuple(x.split(" ")), tuple(y.split(" "))) for x, y in zip(a, b, strict=True)], dtype="float64")


def _within_reach(l: str, r: str) -> Column:
    """Whether likeness can reach LEAST for two cores: whole in some rotation, by consonants, or word by word in any order.

    A swap is one edit there and two in Levenshtein's distance, so twice the edits are let through, and so are pairs
    of more than WORTH letters, for which the bound costs more than the measure.
    """
    a, b = F.split(l, " "), F.split(r, " ")
    one, n = F.regexp_replace(l, " ", ""), F.size(F.split(r, " "))
    turned = lambda k: F.array_join(F.concat(F.slice(b, k + 1, n), F.slice(b, F.lit(1), k)), "")
    whole = (F.abs(F.length(one) - F.length(F.regexp_replace(r, " ", ""))) <= EDITS) & F.exists(F.sequence(F.lit(0), n - 1), lambda k: F.levenshtein(one, turned(k), 2 * EDITS) >= 0)
    bare = lambda c: F.translate(c, "aeiou ", "")

    def most(x: Column, y: Column) -> Column:
        d = F.levenshtein(x, y, 2 * EDITS)
        return F.when(d < 0, 0.0).otherwise(1 - F.ceil(d / 2) / F.greatest(F.length(x), F.length(y), F.lit(1)))

    def by_word(xs: Column, ys: Column) -> Column:
        best = F.transform(xs, lambda x: F.array_max(F.transform(ys, lambda y: most(x, y))))
        return F.aggregate(best, F.lit(0.0), lambda total, s: total + s) / F.size(xs) >= LEAST - 1e-9

    return F.when(F.greatest(F.length(l), F.length(r)) > WORTH, True).otherwise(whole | (bare(l) == bare(r)) | ((F.size(a) == n) & (n > 1) & by_word(a, b) & by_word(b, a)))


def candidates(vertices: DataFrame, keep: list[str], into: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """Pairs (l, r, like, l_*, r_* for each of ``keep``) of vertices whose cores are alike by LEAST or more, found by MinHash banding.

    ``vertices``: v (distinct), words, trade, face, bits, slack. Of a pair r is a face; of two faces either order comes out,
    but only one. Descriptors that both have must be the same. Beside their bands cores also meet by their consonants and
    by their letters in sorted order. Pairs whose letters differ by more than the edits that LEAST allows, and not in vowels
    alone, do not count as alike; that is told from two numbers, so only they and a number for v are spread over the bands. The
    others are verified by Monge–Elkan, those first set aside inside the JVM that cannot reach LEAST by a bound (see
    _within_reach). No pair that met is lost otherwise.

    Bands are met ABREAST at a time, or as many as make WHOLE keys, and what a pass spread is removed before the next one: disk
    follows the names, not the names times their bands. A pair is measured once, in the first pass in which it meets.
    """
    spark = vertices.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the hashing is work for all, however few bytes the names have
    columns = dict.fromkeys(["v", "words", "face", "bits", "slack", *keep])
    with scratch(spark) as store:
        th = F.when(F.col("trade") != "", F.xxhash64("trade")).otherwise(0).alias("th")
        flat = store(vertices.repartitionByRange(tasks, "v").sortWithinPartitions("v").select(F.monotonically_increasing_id().alias("i"), th, *columns))  # i in the order of v
        n, faces = flat.agg(F.count(F.lit(1)), F.count_if("face")).first()
        rows, bands = tuned(faces, SIMILARITY, RECALL, BACKGROUND)
        passes = math.ceil((bands + 2) / max(ABREAST, WHOLE // max(n, 1)))
        starts = [max(0, (bands + 2) * k // passes - 2) for k in range(passes + 1)]  # the first pass has the two other keys, too
        side = lambda s: flat.select(F.col("i").alias(s), F.col("words").alias(f"{s}_words")).hint("merge")
        done = None
        for first, end in zip(starts, starts[1:], strict=False):
            keys = band_keys(Q, rows, end - first, first=first)(F.regexp_replace("words", " ", ""))
            with scratch(spark) as spread:
                met = _met(spread(flat.select("i", "face", "bits", "slack", "th", F.array_distinct(F.concat(keys, whole_keys("words")) if done is None else keys).alias("keys"))))
                if done is not None:
                    met = met.join(done.select("l", "r").hint("merge"), ["l", "r"], "left_anti")
                pairs = met.join(side("l"), "l").join(side("r"), "r").where(_within_reach("l_words", "r_words"))
                done = store(pairs.select("l", "r", likeness("l_words", "r_words").alias("like")), "pairs")
        side = lambda s: flat.select(F.col("i").alias(f"{s}_i"), F.col("v").alias(s), *[F.col(c).alias(f"{s}_{c}") for c in keep]).hint("merge")
        pairs = done.where(F.col("like") >= LEAST).withColumnsRenamed({"l": "l_i", "r": "r_i"})
        return into(pairs.join(side("l"), "l_i").join(side("r"), "r_i").drop("l_i", "r_i"))


def _met(spread: DataFrame) -> DataFrame:
    """Pairs (l, r) of numbers i that share one of their ``keys``, r that of a face, and are not told apart by their letters or descriptors."""
    banded = spread.select(F.explode("keys").alias("band"), "i", "face", "bits", "slack", "th")
    faces = banded.where("face").select("band", *[F.col(c).alias(f"r_{c}") for c in ("i", "bits", "slack", "th")])
    differ = F.col("bits").bitwiseXOR(F.col("r_bits"))
    near = (F.bit_count(differ) <= F.greatest("slack", "r_slack")) | (differ.bitwiseAND(F.lit(CONSONANTS)) == 0)
    compatible = (F.col("th") == F.col("r_th")) | (F.col("th") == 0) | (F.col("r_th") == 0)
    once = (F.col("i") != F.col("r_i")) & (~F.col("face") | (F.col("i") < F.col("r_i")))
    met = salted_join(banded, faces.hint("merge"), ["band"], "inner", heavy_keys(faces, ["band"]), near & compatible & once, spread=["i"])
    return met.select(F.col("i").alias("l"), F.col("r_i").alias("r")).distinct()


def star(links: DataFrame, keep: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Star clustering: (v, center) of every vertex that has a link; ``links`` have u, v, like, u_rank, v_rank, both ways (distinct ranks, lower is better).

    A vertex is a center if none of its better-ranked neighbours is one; others join the likest center
    beside them. Decided in rounds, each cut by ``keep``.
    """
    watch, better = Observation(), F.col("u_rank") < F.col("v_rank")
    seen = lambda d: keep(d.observe(watch, F.count(F.when(F.col("s") == 0, 1)).alias("open")))
    state = seen(links.groupBy("v").agg(F.when(F.max(better), 0).otherwise(1).alias("s")))  # 0 open, 1 center, 2 satellite
    beside = lambda state: links.join(state.select(F.col("v").alias("u"), F.col("s").alias("u_s")).hint("merge"), "u")
    while watch.get["open"]:
        facts = beside(state).groupBy("v").agg(F.max((F.col("u_s") == 1) & better).alias("taken"), F.max((F.col("u_s") == 0) & better).alias("waits"))
        watch = Observation()
        state = seen(state.join(facts.hint("merge"), "v").select("v", F.when(F.col("s") > 0, F.col("s")).when(F.col("taken"), 2).when(F.col("waits"), 0).otherwise(1).alias("s")))
    likest = F.when(F.col("u_s") == 1, F.struct((-F.col("like")).alias("like"), "u_rank"))  # no two centers are neighbours
    return beside(state).groupBy("v").agg(F.min_by("u", likest).alias("center")).select("v", F.coalesce("center", "v").alias("center"))


def _vertex(words: str, trade: str, key: str) -> Column:
    """16 bytes: one for each core and descriptors, one for each ``key`` without a core."""
    return F.unhex(F.md5(F.when(F.col(words) != "", F.concat_ws("|", words, trade)).otherwise(F.concat(F.lit("#"), key)).cast("binary")))


def _rows(nodes: DataFrame, row_id: str, known: tuple[str, ...], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    n = nodes.select(F.col(row_id).alias("row_id"), F.col("name").alias("__name"), ticker("ticker").alias("t"), F.lower("sector").alias("sector"), F.lower("industry").alias("industry"), F.col("market_cap").alias("cap"))
    p = n.withColumn("p", parsed(known)("__name")).select("row_id", "p.words", "p.trade", "p.bits", "p.slack", "t", "sector", "industry", "cap")
    return keep(p.withColumn("v", _vertex("words", "trade", "row_id")))


def _graph(rows: DataFrame, keep: Callable[[DataFrame], DataFrame], others: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertices, links): the distinct names of ``rows``, which are nodes, and of ``others`` (v, words, trade, bits, slack, face), and the pairs that are alike."""
    cols = ["v", "words", "trade", "bits", "slack"]
    one = rows.select(*cols, F.lit(True).alias("face"), F.lit(False).alias("said"), F.lit(1).alias("node"), "row_id")
    if others is not None:
        one = one.unionByName(others.select(*cols, "face", (~F.col("face")).alias("said"), F.lit(0).alias("node"), F.lit(None).cast("bigint").alias("row_id")))
    vertices = one.where("words <> ''").groupBy("v").agg(*[F.min(c).alias(c) for c in cols[1:]], F.max("face").alias("face"), F.max("said").alias("said"), F.sum("node").alias("n"), F.min("row_id").alias("low"))
    vertices = keep(vertices.withColumn("rank", F.struct((-F.col("n")).alias("n"), "low")).drop("n", "low"))
    return vertices, candidates(vertices, ["trade", "rank", "face", "said"], keep)


def _either(links: DataFrame) -> DataFrame:
    """Each pair both ways: u, v, like and u_* and v_* for trade, rank, face, said."""
    other = {"l": "r", "r": "l"}
    way = lambda a: links.select("like", F.col(a).alias("u"), F.col(other[a]).alias("v"), *[F.col(f"{s}_{c}").alias(f"{x}_{c}") for s, x in ((a, "u"), (other[a], "v")) for c in ("trade", "rank", "face", "said")])
    return way("l").unionByName(way("r"))


def _members(rows: DataFrame, links: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(row_id, v, words, trade, t, group_id, company_trade) for every row; see company_groups."""
    nodes = _either(links).where("u_rank.n < 0 and v_rank.n < 0")
    stars = keep(star(keep(nodes.where("u_trade = v_trade").select("u", "v", "like", "u_rank", "v_rank")), keep))
    # names without a descriptor: all companies with a core as like as any
    bare = nodes.where("v_trade = '' and u_trade <> ''").select("v", F.col("u").alias("option"), "like")
    found = bare.join(stars.select(F.col("v").alias("option"), "center").hint("merge"), "option", "left").groupBy("v", F.coalesce("center", "option").alias("option")).agg(F.max("like").alias("like"))
    top = found.join(found.groupBy("v").agg(F.max("like").alias("most")).hint("merge"), "v").where("like >= most").select("v", "option")
    plain = rows.select("row_id", "v", "words", "trade", "t", "sector", "industry", "cap")
    placed = keep(salted_join(plain, stars.hint("merge"), ["v"], "left", heavy_keys(rows, ["v"]), spread=["row_id"]).withColumn("center", F.coalesce("center", "v")))
    # what is known of each company: its tickers, and its rows' sector, industry and cap
    full = F.col("trade") != ""
    owner = placed.where("t <> '' and words <> ''").groupBy("t", "center").agg(F.count(F.lit(1)).alias("n"), F.max(full).alias("full")).groupBy("t").agg(F.max_by(F.struct("center", "full"), F.struct("full", "n", "center")).alias("of"))
    traits = placed.where(full).groupBy(F.col("center").alias("option")).agg(F.max("cap").alias("hi"), F.min(F.when(F.col("cap") > 0, F.col("cap"))).alias("lo"), F.max(F.struct(F.length("industry") > 3, "industry")).alias("i"), F.max(F.struct(F.length("sector") > 3, "sector")).alias("s"))
    loose = placed.where("trade = '' and words <> ''")
    fit = (
        F.when(F.col("industry") == F.col("i.industry"), 2).otherwise(0) + F.when(F.col("sector") == F.col("s.sector"), 1).otherwise(0)
        + F.when((F.col("cap") > F.col("lo") / 1.2) & (F.col("cap") < F.col("hi") * 1.2), 2).otherwise(0)
    )
    judged = salted_join(loose, top.join(traits.hint("merge"), "option").hint("merge"), ["v"], "inner", heavy_keys(loose, ["v"]), spread=["row_id"]).withColumn("fit", fit)
    judged = judged.groupBy("row_id").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("fit", "option")).alias("hi"), F.min(F.struct((-F.col("fit")).alias("fit"), "option")).alias("lo"))
    settled = judged.where("k = 1 or (hi.fit > 0 and hi.option = lo.option)").select("row_id", F.col("hi.option").alias("settled"))
    chosen = salted_join(placed, owner.hint("merge"), ["t"], "left", heavy_keys(placed, ["t"]), spread=["row_id"]).join(settled.hint("merge"), "row_id", "left")
    member = keep(chosen.select("row_id", "v", "words", "trade", "t", F.coalesce(F.when(F.col("of.full"), F.col("of.center")), "settled", "of.center", "center").alias("company")))
    ids = member.groupBy("company").agg(F.min("row_id").alias("group_id"), F.max("trade").alias("company_trade"))
    return salted_join(member, ids.hint("merge"), ["company"], "inner", heavy_keys(member, ["company"]), spread=["row_id"]).drop("company")


def company_groups(nodes: DataFrame, row_id: str = "id") -> DataFrame:
    """(row_id, group_id) and v, trade, t, company_trade for every row: group_id is the smallest id of the company's rows.

    Names are parsed into core words and descriptors (see ``descriptors``); rows of one core and the same descriptors
    form a vertex. Vertices of the same descriptors, or of none, whose cores are alike are clustered by stars around the
    most frequent spelling. A row with the ticker of another company's rows follows the ticker. A name without
    descriptors goes to the only company of its core that has some, or, where several share it, to the one whose industry,
    sector and market cap fit best; with nothing to tell them apart it stays in its own cluster. A name without
    any core (null, blank) is a company of its own unless its ticker tells more.
    """
    with scratch(nodes.sparkSession) as keep:
        rows = _rows(nodes, row_id, descriptors(nodes, "name"), keep)
        return cut(_members(rows, _graph(rows, keep)[1], keep))


def link_mentions(mentions: DataFrame, text: str, nodes: DataFrame, aliases: DataFrame) -> DataFrame:
    """(text, group_id, how, like) for each distinct text that means a company of ``nodes``; see company_groups for the ids.

    A text means a company by a ticker that it states, by the first hit of the alias list, or by its
    name: the likest name in the MinHash candidates whose descriptors are the same, or that of the only such
    company where the text has none. Texts that fit several companies equally stay out, as do null and
    blank ones.
    """
    with scratch(nodes.sparkSession) as keep:
        known = descriptors(nodes, "name")
        rows = _rows(nodes, "id", known, keep)
        said = mentions.select(F.col(text).alias("text"), F.lit(None).cast("string").alias("symbol")).where(F.col("text").rlike(r"(?U)\S")).distinct()
        first = aliases.where("query_text is not null and symbol is not null").groupBy(F.col("query_text").alias("text")).agg(F.min_by("symbol", F.struct("hit_rank", "symbol")).alias("symbol"))
        texts = said.unionByName(first).withColumn("p", parsed(known)("text")).select("text", "p.*", ticker("symbol").alias("t"), F.col("symbol").isNotNull().alias("face"))
        texts = keep(texts.withColumn("v", _vertex("words", "trade", "text")))
        vertices, links = _graph(rows, keep, texts)
        groups = keep(_members(rows, links, keep))
        tickers = groups.where("t <> ''").groupBy("t").agg(F.min("group_id").alias("group_id"), F.max("company_trade").alias("company_trade"))
        by_alias = texts.where("face and words <> ''").join(tickers.hint("merge"), "t").select("v", "group_id", F.when(F.col("trade") != "", F.col("trade")).otherwise(F.col("company_trade")).alias("has"))
        faces = groups.where("words <> ''").groupBy("v", "group_id").agg(F.max("company_trade").alias("has")).unionByName(by_alias).withColumnRenamed("v", "f")

        met = _either(links).where("v_said and u_face").select("v", F.col("u").alias("f"), F.col("v_trade").alias("trade"), "like")
        met = met.unionByName(vertices.where("said and face").select("v", F.col("v").alias("f"), "trade", F.lit(1.0).alias("like")))
        fits = salted_join(met, faces.hint("merge"), ["f"], "inner", heavy_keys(met, ["f"]), spread=["v"]).where("trade = '' or trade = has")
        best = fits.groupBy("v").agg(F.max(F.struct("like", "group_id")).alias("hi"), F.max(F.struct("like", (-F.col("group_id")).alias("neg"))).alias("lo"))
        best = best.where("hi.group_id = -lo.neg").select("v", "hi.group_id", "hi.like")
        ours = texts.where("not face")
        named = salted_join(ours.where("words <> ''").select("text", "v"), best.hint("merge"), ["v"], "inner", heavy_keys(ours, ["v"]), spread=["text"]).select("text", "group_id", F.lit("name").alias("how"), "like")
        stated = ours.where("tick <> ''").select("text", F.col("tick").alias("t")).join(tickers.hint("merge"), "t").select("text", "group_id", F.lit("ticker").alias("how"), F.lit(1.0).alias("like"))
        order = F.struct((F.col("how") == "ticker").alias("stated"), "like")
        return written(stated.unionByName(named).groupBy("text").agg(F.max_by("group_id", order).alias("group_id"), F.max_by("how", order).alias("how"), F.max("like").alias("like")))


def mention_links(dependencies: DataFrame, nodes: DataFrame, aliases: DataFrame, row_id: str = "dep_id", fields: tuple[str, ...] = ("source_company", "target_company")) -> DataFrame:
    """(row_id, field_name, text, group_id) for each cell that means a company, exact names included; heavy texts are salted."""
    cells = dependencies.select(F.col(row_id).alias("row_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("c")).select("row_id", "c.*").where("text is not null")
    links = link_mentions(cells, "text", nodes, aliases).select("text", "group_id")
    with scratch(nodes.sparkSession):
        heavy = heavy_keys(cells, ["text"])
    return salted_join(cells, links.hint("merge"), ["text"], "inner", heavy, spread=["row_id", "field_name"])

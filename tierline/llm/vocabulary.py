"""Problem 2: free-entered values mapped to a reference list by token-level repair and soft TF-IDF."""

from __future__ import annotations

import re
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_hexdigest

from ..operators.skew import heavy_keys, salted_join
from ..session import cut
from .names import ascii_lower, osa

#: Words of English grammar, which say nothing.
GRAMMAR = frozenset("a an and of the our my for".split())
#: Least similarity of a repaired token, least score of an entry, shortest abbreviation.
TOKEN, ENTRY, ABBREVIATION = 0.6, 0.6, 3
#: A word is a filler if it stands beside so many different entries that are typed in full without it, and in this share of the distinct values.
BESIDE, SHARE = 4, 1 / 1000
#: Tokens longer than this meet by segments instead of deletions, whose number grows with the square of the length.
LONG = 12
#: What stands for all item codes and counts when fillers are learned; such a token is only a filler where no entry has it.
CODE = "#"

_TEXTS = T.ArrayType(T.StringType())


def words(text: str) -> list[str]:
    """The words of an entry in lower case without accents."""
    s = ascii_lower(text).replace("’", "'").replace("'", "")
    return [t for t in re.findall(r"[^\W_]+", s) if t not in GRAMMAR]


def _is_code(token: Column) -> Column:
    return F.rlike(token, F.lit(r"^\p{L}?\d+$"))


def _edits(n: int) -> int:
    """Edits allowed in a token of n letters."""
    return 0 if n < 4 else 1 if n < 6 else 2


def bones(token: str) -> str:
    """First letter and consonants."""
    return token[:1] + re.sub("[aeiou]", "", token[1:])


def _deletions(token: str) -> set[str]:
    out = {token}
    for k in range(1, _edits(len(token)) + 1):
        out |= {"".join(c for i, c in enumerate(token) if i not in gone) for gone in combinations(range(len(token)), k)}
    return out


def _cuts(n: int, pieces: int = 3) -> list[tuple[int, int]]:
    """Where the segments of a token of n letters begin and end; two edits leave one of three as it is."""
    at = [n * i // pieces for i in range(pieces + 1)]
    return list(zip(at, at[1:], strict=False))


def _segments_of_entry(token: str) -> set[str]:
    n = len(token)
    return {f"s{n}:{i}:{xxh3_64_hexdigest(token[p:q])}" for i, (p, q) in enumerate(_cuts(n))} if n > LONG - 2 else set()


def _segments_of_typed(token: str) -> set[str]:
    """The places where a segment of an entry up to two letters longer or shorter can stand: some 75 keys, however long the token."""
    n = len(token)
    lengths = range(n - 2, n + 3) if n > LONG - 2 else ()
    return {f"s{m}:{i}:{xxh3_64_hexdigest(token[p + d : q + d])}" for m in lengths for i, (p, q) in enumerate(_cuts(m)) for d in range(-2, 3) if 0 <= p + d and q + d <= n}


def _near(token: str) -> set[str]:
    return {"d" + x for x in _deletions(token)} if len(token) <= LONG else {"d" + token}


@F.pandas_udf(T.StructType([T.StructField("tokens", _TEXTS), T.StructField("all", T.StringType())]))
def tokenised(texts: pd.Series) -> pd.DataFrame:
    """Words, and all letters put together, which a missing or moved blank leaves as they are."""
    rows = [words(t) if t else [] for t in texts]
    return pd.DataFrame({"tokens": rows, "all": [re.sub(r"[\W_]", "", ascii_lower(t)) if t else "" for t in texts]})


@F.pandas_udf(_TEXTS)
def keys_of_entry(tokens: pd.Series) -> pd.Series:
    """Join keys of a reference token: its deletion neighbourhood (segments if it is long), its bones and its beginnings."""
    return tokens.map(lambda t: sorted(_near(t) | _segments_of_entry(t) | {"b" + bones(t)} | {"p" + t[:k] for k in range(ABBREVIATION, min(len(t), LONG))}))


@F.pandas_udf(_TEXTS)
def keys_of_typed(tokens: pd.Series) -> pd.Series:
    """Join keys of a typed token: its deletion neighbourhood (segments if it is long), and itself as bones and as a beginning."""

    def one(t: str) -> list[str]:
        out = _near(t) | _segments_of_typed(t)
        if len(t) >= ABBREVIATION:
            out |= {"b" + bones(t), "p" + t} | ({"p" + t[:-1]} if t.endswith("s") and len(t) > ABBREVIATION else set())
        return sorted(out)

    return tokens.map(one)


@F.pandas_udf(T.DoubleType())
def repair(typed: pd.Series, entry: pd.Series) -> pd.Series:
    """How well a reference token explains a typed one: by edit distance, as a word without vowels, or cut short."""

    def one(x: str, y: str) -> float:
        if x == y:
            return 1.0
        most = _edits(max(len(x), len(y)))
        d = osa(x, y, most)
        s = 1 - d / max(len(x), len(y)) if d <= most else 0.0
        if len(x) >= ABBREVIATION and x == bones(y) or len(x) >= 5 and bones(x) == x and osa(x, bones(y), 1) <= 1:
            s = max(s, 0.9 if x == bones(y) else 0.7)
        if len(x) >= ABBREVIATION and len(y) > len(x) and (y.startswith(x) or (x.endswith("s") and len(x) > ABBREVIATION and y.startswith(x[:-1]))):
            s = max(s, 0.85)
        return s

    return pd.Series([one(x, y) for x, y in zip(typed, entry, strict=True)])


def entries(terms: DataFrame) -> DataFrame:
    """(field_name, term_id, label_id, tokens, all): one row per name of a reference entry, other names included."""
    names = terms.select("field_name", F.col("term_id").cast("bigint").alias("term_id"), F.explode(F.concat(F.array("term"), F.coalesce(F.split("aka", r"\s*;\s*"), F.array().cast("array<string>")))).alias("label")).where("label is not null and trim(label) <> ''")
    return names.select("field_name", "term_id", F.xxhash64("field_name", "term_id", "label").alias("label_id"), tokenised("label").alias("w")).select("field_name", "term_id", "label_id", "w.*").where("size(tokens) > 0")


def fillers(typed: DataFrame, ref: DataFrame) -> dict[str, list[str]]:
    """For each field the words that people add to entries of every kind, learned from the values that hold an entry letter for letter.

    A filler stands beside BESIDE different entries or more and in SHARE of the distinct values, so a field has fewer than
    its values' mean number of words divided by SHARE. CODE among them stands for item codes and counts.
    """
    said = typed.select("field_name", "text", "tokens", F.explode(F.array_distinct("tokens")).alias("entry"))
    labels = ref.select("field_name", "label_id", "term_id", F.array_distinct("tokens").alias("own"), F.explode(F.array_distinct("tokens")).alias("entry"))
    held = salted_join(said, labels, ["field_name", "entry"], "inner", heavy_keys(said, ["field_name", "entry"]), spread=["text"]).groupBy("field_name", "text", "label_id").agg(F.count(F.lit(1)).alias("k"), F.min("own").alias("own"), F.min("tokens").alias("tokens"), F.min("term_id").alias("term_id"))
    rest = held.where("k = size(own)").select("field_name", "text", "term_id", F.explode(F.array_except("tokens", "own")).alias("t"))
    rest = rest.select("field_name", "text", "term_id", F.when(_is_code(F.col("t")), CODE).otherwise(F.col("t")).alias("t"))
    counts = rest.groupBy("field_name", "t", "term_id").agg(F.count_distinct("text").alias("n")).groupBy("field_name", "t").agg(F.count(F.lit(1)).alias("beside"), F.sum("n").alias("n"))
    total = typed.groupBy("field_name").agg(F.count(F.lit(1)).alias("every"))
    out: dict[str, list[str]] = {}
    for r in counts.join(total, "field_name").where((F.col("beside") >= BESIDE) & (F.col("n") >= F.col("every") * SHARE)).select("field_name", "t").collect():
        out.setdefault(r["field_name"], []).append(r["t"])
    return out


def match(values: DataFrame, terms: DataFrame) -> DataFrame:
    """(field_name, text, term_id, score) for each distinct (field_name, text) of ``values`` that means an entry.

    Distinct typed tokens meet the vocabulary of their field through shared deletion neighbours, bones and
    beginnings (long ones through shared segments), an equi-join whose pairs are verified by edit distance. The repaired tokens
    of a value are combined with soft TF-IDF (idf over the reference entries) into a score for each entry that has them. An
    entry must have every one of its words typed, in any order, and explain every typed word that some entry has; a typed word
    that none has lowers the score by the mean weight of a word. Fillers (see ``fillers``) do neither. Where no entry explains a value
    letter for letter, the letters of the whole value are one more token, so that lost or moved blanks do no harm, and so are the initials of entries
    of three or more words. The best score wins; two entries that share it leave the value unmatched.
    """
    tasks = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # pairs are work for all, however few bytes they have
    ref = cut(entries(terms))
    typed = cut(values.select("field_name", "text").distinct().withColumn("w", tokenised("text")).select("field_name", "text", "w.*").where("size(tokens) > 0"))
    idle = fillers(typed, ref)
    n = ref.groupBy("field_name").agg(F.count(F.lit(1)).alias("n"))
    vocabulary = ref.select("field_name", F.explode(F.array_distinct("tokens")).alias("entry")).groupBy("field_name", "entry").agg(F.count(F.lit(1)).alias("df")).join(n, "field_name").select("field_name", "entry", F.log(1 + F.col("n") / F.col("df")).alias("idf"))
    usual = vocabulary.groupBy("field_name").agg(F.avg(F.col("idf") * F.col("idf")).alias("usual"))

    def idles(field: str, token: Column) -> Column:
        there = idle.get(field, [])
        return token.isin(*there) | (_is_code(token) if CODE in there else F.lit(False)) if there else F.lit(False)

    is_idle = lambda token: reduce(lambda x, f: F.when(F.col("field_name") == f, idles(f, token)).otherwise(x), sorted(idle), F.lit(False))

    # token level
    tokens = typed.select("field_name", F.explode("tokens").alias("token")).distinct().repartition(tasks)
    left = tokens.select("field_name", "token", F.explode(keys_of_typed("token")).alias("key"))
    right = vocabulary.select("field_name", "entry", "idf", F.explode(keys_of_entry("entry")).alias("key"))
    met = salted_join(left, right, ["field_name", "key"], "inner", heavy_keys(right, ["field_name", "key"]), spread=["token"]).select("field_name", "token", "entry", "idf").distinct().repartition(tasks)
    repaired = cut(met.withColumn("sim", repair("token", "entry")).where(F.col("sim") >= TOKEN))

    # entry level: tokens of the value against tokens of the entries
    places = ref.select("field_name", "label_id", "term_id", F.size(F.array_distinct("tokens")).alias("words"), F.explode(F.array_distinct("tokens")).alias("entry"))
    meant = repaired.join(places, ["field_name", "entry"])
    said = typed.select("field_name", "text", F.posexplode("tokens").alias("pos", "token")).withColumn("idle", is_idle(F.col("token")))
    heavy = heavy_keys(said, ["field_name", "token"])
    hits = salted_join(said, meant.hint("merge"), ["field_name", "token"], "inner", heavy, spread=["text"])
    weight = F.col("idf") * F.col("idf")
    by_entry = hits.groupBy("field_name", "text", "term_id", "label_id", "words").agg(
        F.size(F.collect_set(F.when(~F.col("idle"), F.col("pos")))).alias("explained"), F.size(F.collect_set("entry")).alias("found"),
        F.sum(F.col("sim") * weight).alias("dot"), F.sum(weight).alias("norm"),
    )
    known = salted_join(said.where("not idle"), repaired.select("field_name", "token").distinct().withColumn("known", F.lit(True)).hint("merge"), ["field_name", "token"], "left", heavy, spread=["text"])
    needed = known.groupBy("field_name", "text").agg(F.count("known").alias("known"), F.count(F.when(F.col("known").isNull(), 1)).alias("foreign"))
    whole = by_entry.where("found = words").join(needed.hint("merge"), ["field_name", "text"], "left").join(F.broadcast(usual), "field_name")  # one row a field
    whole = whole.where(F.col("explained") == F.coalesce("known", F.lit(0))).select("field_name", "text", "term_id", (F.col("dot") / (F.col("norm") + F.coalesce("foreign", F.lit(0)) * F.col("usual"))).alias("score"))
    whole = cut(whole)

    # other values as one token, with and without their fillers, against whole entries and initials
    joined = ref.select("field_name", "term_id", F.explode(F.array_distinct(F.array(F.array_join("tokens", ""), "all"))).alias("entry")).distinct()
    rest = typed.join(whole.where("score >= 1").select("field_name", "text").distinct().hint("merge"), ["field_name", "text"], "left_anti")
    spelt = rest.select("field_name", "text", F.explode(F.array_distinct(F.array("all", F.array_join("tokens", ""), F.array_join(F.filter("tokens", lambda t: ~is_idle(t)), "")))).alias("letters")).where("letters <> ''")
    letters = spelt.select("field_name", "letters").distinct().repartition(tasks)
    keyed = lambda df, c, keys: df.withColumn("key", F.explode(keys(c))).where(~F.col("key").startswith("p"))
    near = keyed(letters, "letters", keys_of_typed).join(keyed(joined, "entry", keys_of_entry), ["field_name", "key"]).select("field_name", "letters", "term_id", "entry").distinct()
    as_one = near.withColumn("score", repair("letters", "entry")).where(F.col("score") >= TOKEN).select("field_name", "term_id", "letters", F.when(F.length("entry") > F.length("letters") + 2, F.least("score", F.lit(0.7))).otherwise(F.col("score")).alias("score"))
    initials = ref.where(F.size("tokens") >= 3).select("field_name", "term_id", F.array_join(F.transform("tokens", lambda t: F.substring(t, 1, 1)), "").alias("letters"), F.lit(0.8).alias("score"))
    by_letters = salted_join(spelt, as_one.unionByName(initials).hint("merge"), ["field_name", "letters"], "inner", heavy_keys(spelt, ["field_name", "letters"]), spread=["text"]).select("field_name", "text", "term_id", "score")

    all_ = whole.unionByName(by_letters).groupBy("field_name", "text", "term_id").agg(F.round(F.max("score"), 9).alias("score")).where(F.col("score") >= ENTRY)
    top = all_.groupBy("field_name", "text").agg(F.max(F.struct("score", "term_id")).alias("hi"), F.max(F.struct("score", (-F.col("term_id")).alias("neg"))).alias("lo"))
    return top.where("hi.term_id = -lo.neg").select("field_name", "text", "hi.term_id", "hi.score")


def map_values(rows: DataFrame, terms: DataFrame, row_id: str = "dep_id", fields: tuple[str, ...] = ("dependency_type", "product")) -> DataFrame:
    """(row_id, field_name, text, term_id, score) for each non-blank cell; term_id is 0 where no entry is meant.

    Null and blank cells are left out. Heavy values are salted in the join back. A reference list without
    rows leaves everything unmatched.
    """
    cells = rows.select(F.col(row_id).alias("row_id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("c")).select("row_id", "c.*").where(F.col("text").rlike(r"(?U)\S"))
    found = cut(match(cells, terms))
    out = salted_join(cells, found.hint("merge"), ["field_name", "text"], "left", heavy_keys(cells, ["field_name", "text"]), spread=["row_id"])
    return out.select("row_id", "field_name", "text", F.coalesce("term_id", F.lit(0)).cast("bigint").alias("term_id"), "score")

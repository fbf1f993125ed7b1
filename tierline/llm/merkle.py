"""Problem 3: duplicates hidden by formatting, by Merkle-style hashing of nested records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.skew import heavy_of, salted_join
from ..session import cut, written


def words(c: Column) -> Column:
    """The words of a text in sorted order, repeats kept: runs of letters and digits, case folded. Null stays null."""
    plain = F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))
    folded = F.lower(F.upper(plain))
    return F.when(plain == "", F.when(c.isNotNull(), F.array().cast("array<string>"))).otherwise(F.array_sort(F.split(folded, " ")))


def _digest(kind: str, parts: Column) -> Column:
    return F.md5(F.concat(F.lit(kind), F.concat_ws("|", parts)).cast("binary"))


def structure(c: Column, kind: T.DataType, bags: bool = True) -> tuple[Column, Column]:
    """(digest, canonical text) of a column of any nesting, built from the leaves up.

    Texts are normalised (to the sorted words of ``words``, or with ``bags`` false to one blank between
    words and lower case); other leaves are taken as their text; null is a leaf of its own. Children are
    digested first: the elements of an array in their order, the fields of a struct and the entries of a
    map sorted, as their order says nothing; a field's name belongs to its child.
    """
    if isinstance(kind, T.StructType):
        kids = [(f.name, *structure(c.getField(f.name), f.dataType, bags)) for f in sorted(kind.fields, key=lambda f: f.name.lower())]
        digest = _digest("s", F.array_sort(F.array(*[F.concat(F.lit(n.lower() + "="), d) for n, d, _ in kids])))
        text = F.concat(F.lit("{"), *[x for n, _, t in kids for x in (F.lit(n.lower() + "="), t, F.lit(";"))], F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        each = F.transform(c, lambda x: F.struct(*[v.alias(a) for v, a in zip(structure(x, kind.elementType, bags), "dt", strict=True)]))
        digest, text = _digest("a", F.transform(each, lambda x: x.getField("d"))), F.concat(F.lit("["), F.concat_ws(",", F.transform(each, lambda x: x.getField("t"))), F.lit("]"))
    elif isinstance(kind, T.MapType):
        item = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
        each = F.array_sort(F.transform(F.map_entries(c), lambda x: F.struct(*[v.alias(a) for v, a in zip(structure(x, item, bags), "dt", strict=True)])))
        digest, text = _digest("m", F.transform(each, lambda x: x.getField("d"))), F.concat(F.lit("<"), F.concat_ws(",", F.transform(each, lambda x: x.getField("t"))), F.lit(">"))
    elif isinstance(kind, T.StringType):
        leaf = F.concat_ws(" ", words(c)) if bags else F.lower(F.upper(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))))
        text = F.concat(F.lit("'"), leaf, F.lit("'"))
        digest = _digest("t", F.array(leaf))
    else:
        text = c.cast("string")
        digest = _digest("v", F.array(text))
    return F.when(c.isNull(), F.lit("0")).otherwise(digest), F.when(c.isNull(), F.lit("null")).otherwise(text)


def _record(df: DataFrame, fields: list[str]) -> tuple[Column, Column]:
    return structure(F.struct(*[F.col(f) for f in fields]), T.StructType([df.schema[f] for f in fields]))


def roots(df: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """row_id, root digest (16 bytes) and canonical text of the record made of ``fields``."""
    digest, text = _record(df, fields)
    return df.select(F.col(row_id).alias("row_id"), F.unhex(digest).alias("root"), text.alias("canonical"))


def _hashed(df: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """row_id, root and the fields as f_0, f_1, ..., digested once and written."""
    digest, _ = _record(df, fields)
    return written(df.select(F.col(row_id).alias("row_id"), F.unhex(digest).alias("root"), *[F.col(f).alias(f"f_{i}") for i, f in enumerate(fields)]))


def _compared(rows: DataFrame, repeated: DataFrame, df: DataFrame, fields: list[str]) -> DataFrame:
    """(row_id, root, canonical) of the rows whose root is in ``repeated`` (root, n): only there are structures worth comparing."""
    kinds = T.StructType([T.StructField(f, df.schema[f].dataType) for f in fields])
    named = F.struct(*[F.col(f"f_{i}").alias(f) for i, f in enumerate(fields)])
    again = salted_join(rows, repeated.select("root").hint("merge"), ["root"], "inner", heavy_of(repeated, "n", "root"), spread=["row_id"])
    return cut(again.select("row_id", "root", structure(named, kinds)[1].alias("canonical")))


def groups(rows: DataFrame) -> DataFrame:
    """One row per distinct record: root, canonical, kept_id (smallest), n_copies (rows of the record).

    Grouping by the canonical text beside the digest is the full structural comparison: records whose
    digests collide stay apart. Counts are combined map-side, so a group of any size is no burden.
    """
    return rows.groupBy("root", "canonical").agg(F.min("row_id").alias("kept_id"), F.count(F.lit(1)).alias("n_copies"))


def collapse(df: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """One row per distinct record: kept_id and n_copies. Ids must be unique; null fields equal each other.

    Records are digested in one pass and grouped by their roots; canonical texts are built and compared within repeated roots.
    """
    rows = _hashed(df, row_id, fields)
    found = cut(rows.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("kept_id")))
    several = groups(_compared(rows, found.where("n > 1"), df, fields)).select("kept_id", "n_copies")
    return found.where("n = 1").select("kept_id", F.col("n").alias("n_copies")).unionByName(several)


def copies(df: DataFrame, row_id: str, fields: list[str]) -> DataFrame:
    """(kept_id, copy_id) for each row that is not the kept one of its record; heavy records are salted in the joins back.

    As in ``collapse`` each record is digested once.
    """
    rows = _hashed(df, row_id, fields)
    repeated = cut(rows.groupBy("root").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    same = _compared(rows, repeated, df, fields)
    kept = groups(same).where("n_copies > 1").select("root", F.col("canonical").alias("text"), "kept_id")
    out = salted_join(same, kept.hint("merge"), ["root"], "inner", heavy_of(repeated, "n", "root"), F.col("canonical") == F.col("text"), spread=["row_id"])
    return out.where("row_id <> kept_id").select("kept_id", F.col("row_id").alias("copy_id"))

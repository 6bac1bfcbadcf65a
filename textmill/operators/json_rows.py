"""JSON beyond one value: duplicate keys of objects, and pruning of empty containers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textmill.functions.arrow import text_slices

#: Strings with a following colon (keys), strings, and brackets.
TOKEN = re.compile(r'"[^"\\]*+(?:\\[^\n\r\u0085\u2028\u2029][^"\\]*+)*+"(?:\s*:)?|[{}\[\]]', re.ASCII)


def repeats(text: str) -> int:
    """Keys of a text beyond the first of their name in their object; in time linear in it, with the names of the open objects at hand."""
    depth = again = 0
    names: dict[int, set[str]] = {}
    for m in TOKEN.finditer(text):
        token = m[0]
        if token in "{[":
            depth += 1
            if token == "{":
                names[depth] = set()
        elif token in "}]":
            depth -= 1
        elif token[-1] == ":":
            own, name = names.setdefault(depth, set()), token[:-1].rstrip(" \t\n\v\f\r")
            again += name in own
            own.add(name)
    return again


def repeats_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        for some in text_slices(texts):
            yield pa.array([0 if t is None else repeats(t) for t in some.to_pylist()], pa.int64())


def duplicate_keys(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and duplicates: keys beyond the first of their name in their object, over all objects of a text (0 for a null); a row for each of df's."""
    return df.select(key, F.arrow_udf(repeats_of, "long")(F.col(text)).alias("duplicates"))


def prune_empty(c: Column, kind: T.DataType) -> Column:
    """c with objects and arrays that hold nothing as nulls, bottom-up; to_json then leaves them out. Empty strings and null elements stay."""
    if isinstance(kind, T.StructType):
        parts = [prune_empty(c[f.name], f.dataType).alias(f.name) for f in kind.fields]
        full = F.lit(False)
        for p in parts:
            full |= p.isNotNull()
        return F.when(full, F.struct(*parts))
    if isinstance(kind, T.ArrayType):
        kept = F.filter(c, lambda x: x.isNull() | prune_empty(x, kind.elementType).isNotNull())
        kept = F.transform(kept, lambda x: prune_empty(x, kind.elementType))
        return F.when(F.size(kept) > 0, kept)
    return c


#: A string, a mark, or a run of anything else; a body is its pieces end to end.
PIECE = r'("[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],:]|[^"{}\[\],:]+)'


def pieces(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, ix, piece, depth and where a piece stands in nested objects and arrays: k1, i2, k3, i4, k5, and is_key.

    depth counts the containers around a piece, a bracket being within its own; k1, k3 and k5 are the last
    keys at these depths, i2 and i4 the places in the arrays at those. White space outside strings is gone.
    """
    rows = df.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(PIECE), F.lit(1))).alias("ix", "piece"))
    rows = rows.withColumn("piece", F.when(F.col("piece").startswith('"'), F.col("piece")).otherwise(F.regexp_replace("piece", r"^\s++|(?<!\s)\s++$", ""))).where("piece <> ''")
    order = Window.partitionBy(key).orderBy("ix")
    closes = F.col("piece").isin("}", "]")
    opens = F.col("piece").isin("{", "[")
    rows = rows.withColumn("depth", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(order) + F.when(closes, 1).otherwise(0))
    rows = rows.withColumn("is_key", F.coalesce((F.lead("piece").over(order) == ":") & F.col("piece").startswith('"'), F.lit(False)))
    for d in (1, 3, 5):
        name = F.expr("substring(piece, 2, length(piece) - 2)")
        rows = rows.withColumn(f"k{d}", F.last(F.when(F.col("is_key") & (F.col("depth") == d), name), ignorenulls=True).over(order))
    for d in (2, 4):
        commas = F.sum(F.when((F.col("piece") == ",") & (F.col("depth") == d), 1).otherwise(0)).over(order)
        rows = rows.withColumn("commas", commas)
        rows = rows.withColumn(f"i{d}", (F.col("commas") - F.last(F.when(opens & (F.col("depth") == d), F.col("commas")), ignorenulls=True).over(order)).cast("int"))
    return rows.drop("commas")

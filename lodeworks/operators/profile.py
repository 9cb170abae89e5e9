"""Profiles of tables: column statistics, unique keys, prose columns and foreign-key candidates.

One aggregate a table gives all its column statistics. Inclusion of one column's values in another is measured for all
pairs at once over one long table of distinct values, not by a query a pair.
"""

from __future__ import annotations

import functools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import shape

# fixed values: what makes a column prose, and the share of values a foreign key must find
PROSE_CHARS, PROSE_SENTENCES, INCLUSION = 120, 0.5, 0.95
KEY_TYPES = ("integer", "text", "date")


def type_name(t: T.DataType) -> str:
    if isinstance(t, T.IntegralType):
        return "integer"
    if isinstance(t, T.NumericType):
        return "float"
    if isinstance(t, T.StringType):
        return "text"
    if isinstance(t, T.DateType):
        return "date"
    return "datetime" if isinstance(t, (T.TimestampType, T.TimestampNTZType)) else t.simpleString()


def columns(df: DataFrame, name: str) -> DataFrame:
    """A row per column: dtype, rows, nulls, distinct, avg_chars, multi_sentence, is_unique, is_prose. Distinct counts are exact."""
    aggs: list[Column] = [F.count("*").alias("rows")]
    for i, f in enumerate(df.schema):
        c = F.col(f"`{f.name}`")
        plain = not isinstance(f.dataType, (T.ArrayType, T.MapType))
        aggs += [F.count(c).alias(f"n{i}"), (F.count_distinct(c) if plain else F.count_distinct(F.to_json(c))).alias(f"d{i}")]
        if isinstance(f.dataType, T.StringType):
            aggs += [F.avg(F.length(c)).alias(f"c{i}"), F.avg(c.rlike(r"[.!?]\s+\S").cast("int")).alias(f"s{i}")]
    told = df.agg(*aggs)
    rows = []
    for i, f in enumerate(df.schema):
        text = isinstance(f.dataType, T.StringType)
        rows.append(
            F.struct(
                F.lit(name).alias("table"),
                F.lit(f.name).alias("column"),
                F.lit(type_name(f.dataType)).alias("dtype"),
                F.col("rows"),
                (F.col("rows") - F.col(f"n{i}")).alias("nulls"),
                F.col(f"d{i}").alias("distinct"),
                (F.col(f"c{i}") if text else F.lit(None).cast("double")).alias("avg_chars"),
                (F.col(f"s{i}") if text else F.lit(None).cast("double")).alias("multi_sentence"),
            )
        )
    out = told.select(F.explode(F.array(*rows)).alias("x")).select("x.*")
    unique = (F.col("rows") > 0) & (F.col("nulls") == 0) & (F.col("distinct") == F.col("rows"))
    prose = (F.col("avg_chars") >= PROSE_CHARS) & (F.col("multi_sentence") >= PROSE_SENTENCES)
    return out.withColumn("is_unique", unique).withColumn("is_prose", F.coalesce(prose, F.lit(False)))


def profile(tables: Mapping[str, DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, [columns(df, name) for name, df in sorted(tables.items())])


def values(tables: Mapping[str, DataFrame], as_text: bool = False) -> DataFrame:
    """(table, column, dtype, v): the distinct values of every flat column; integers print as integers."""
    out = []
    for name, df in sorted(tables.items()):
        flat = [f for f in df.schema if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
        cells = F.array(*[F.struct(F.lit(f.name).alias("column"), F.lit(type_name(f.dataType)).alias("dtype"), F.col(f"`{f.name}`").cast("string").alias("v")) for f in flat])
        out.append(df.select(F.lit(name).alias("table"), F.explode(cells).alias("x")).select("table", "x.*").where("v is not null").distinct())
    return functools.reduce(DataFrame.unionByName, out)


def name_match(from_column: Column, to_column: Column, to_table: Column) -> Column:
    """Equal names, or the target's table name (without a plural s) inside the source column."""
    a = F.lower(from_column)
    return (a == F.lower(to_column)) | F.contains(a, F.rtrim(F.lower(to_table), F.lit("s")))


def foreign_keys(tables: Mapping[str, DataFrame], least: float = INCLUSION, declared: DataFrame | None = None) -> DataFrame:
    """(from_table, from_column, to_table, to_column, inclusion, name_match, declared), best first.

    A candidate's target is unique and of a key type, both columns have one type, and at least ``least`` of the source's
    distinct values stand in the target. Declared keys (from/to columns) are marked, or added with their inclusion.
    """
    known = values(tables)
    told = profile(tables).select("table", "column", "distinct", "is_unique", "dtype")
    keys = told.where(F.col("is_unique") & F.col("dtype").isin(*KEY_TYPES))
    source = known.select(F.col("table").alias("from_table"), F.col("column").alias("from_column"), "dtype", "v")
    target = known.join(F.broadcast(keys.select("table", "column")), ["table", "column"]).select(F.col("table").alias("to_table"), F.col("column").alias("to_column"), F.col("dtype").alias("to_dtype"), "v")
    met = source.join(target, "v").groupBy("from_table", "from_column", "dtype", "to_table", "to_column", "to_dtype").agg(F.count("*").alias("found"))
    size = told.select(F.col("table").alias("from_table"), F.col("column").alias("from_column"), "distinct")
    met = met.join(F.broadcast(size), ["from_table", "from_column"]).withColumn("inclusion", F.col("found") / F.col("distinct"))
    own = (F.col("from_table") == F.col("to_table")) & (F.col("from_column") == F.col("to_column"))
    names = ["from_table", "from_column", "to_table", "to_column"]
    found = met.where(~own & (F.col("dtype") == F.col("to_dtype")) & (F.col("inclusion") >= least))
    if declared is not None:
        # keys of tables that aren't here are left out
        stated = declared.where(F.col("from_table").isin(*tables) & F.col("to_table").isin(*tables)).select(*names).distinct().withColumn("declared", F.lit(True))
        every = met.select(*names, "inclusion")
        found = found.select(*names, "inclusion").unionByName(stated.join(every, names, "left").select(*names, F.coalesce("inclusion", F.lit(0.0)).alias("inclusion")))
        found = found.distinct().join(stated, names, "left")
    else:
        found = found.withColumn("declared", F.lit(False))
    out = found.select(*names, "inclusion", name_match(F.col("from_column"), F.col("to_column"), F.col("to_table")).alias("name_match"), F.coalesce("declared", F.lit(False)).alias("declared"))
    return out.orderBy(F.desc("declared"), F.desc("name_match"), F.desc("inclusion"), *names)


def examples(df: DataFrame, column: str, count: int = 3) -> DataFrame:
    """``count`` values of a column that show as many of its shapes as fit: the least of each shape, then the least others."""
    v = df.select(F.col(f"`{column}`").alias("v")).where("v is not null").distinct()
    form = shape(F.col("v")) if isinstance(v.schema["v"].dataType, T.StringType) else F.lit("")
    first = v.groupBy(form.alias("form")).agg(F.min("v").alias("v")).orderBy("v").limit(count).select("v", F.lit(0).alias("turn"))
    rest = v.join(first.select("v"), "v", "left_anti").orderBy("v").limit(count).select("v", F.lit(1).alias("turn"))
    return first.unionByName(rest).orderBy("turn", "v").limit(count).select("v").orderBy("v")

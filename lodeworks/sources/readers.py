"""Readers: CSV as types or as text, JSON records, text documents, databases, JSON lines with their errors.

Only Spark's readers touch a path. Listing a folder goes through Hadoop's file system, so any store will do.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def files(spark: SparkSession, folder: str, endings: tuple[str, ...]) -> list[str]:
    """Paths below a folder with one of the endings, sorted."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    it = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True)
    out = []
    while it.hasNext():
        path = it.next().getPath().toString()
        if path.lower().endswith(endings):
            out.append(path)
    return sorted(out)


def csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Typed rows; without a schema the types are inferred once (dates too), to be frozen by the caller."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).option("prefersDate", True).csv(path)


def csv_text(spark: SparkSession, path: str) -> DataFrame:
    """Cells as text, stripped; a blank cell is null."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.select(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")).alias(c) for c in rows.columns])


def flatten(df: DataFrame) -> DataFrame:
    """Nested objects as dotted columns, arrays and maps as JSON text."""

    def cells(schema: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out: list[Column] = []
        for f in schema:
            at = (*path, f.name)
            column = F.col(".".join(f"`{p}`" for p in at))
            if isinstance(f.dataType, T.StructType):
                out += cells(f.dataType, at)
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                out.append(F.to_json(column).alias(".".join(at)))
            else:
                out.append(column.alias(".".join(at)))
        return out

    return df.select(*cells(df.schema, ()))


def json_records(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """Records of a JSON file, flattened: a list, the only list of objects inside one object, or a line each."""
    if lines or (lines is None and path.endswith((".ndjson", ".jsonl"))):
        return flatten(spark.read.json(path))
    whole = spark.read.option("multiLine", True).json(path)
    lists = [f.name for f in whole.schema if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)]
    if len(lists) > 1 and whole.count() == 1:
        raise ValueError(f"{path} holds several lists: {', '.join(lists)}")
    if len(lists) == 1 and whole.count() == 1:
        return flatten(whole.select(F.explode(F.col(f"`{lists[0]}`")).alias("r")).select("r.*"))
    return flatten(whole)


def json_column(df: DataFrame, column: str, schema: str) -> DataFrame:
    """``df`` with a JSON text column parsed and flattened beside the others."""
    rest = [c for c in df.columns if c != column]
    return flatten(df.select(*rest, F.from_json(column, schema).alias(column)))


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, errors): lines that fit the schema, and (line) of those that don't."""
    bad = "__bad"
    whole = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r")).select("r.*")
    return rows.where(F.col(bad).isNull()).drop(bad), rows.where(F.col(bad).isNotNull()).select(F.col(bad).alias("line"))


def documents(spark: SparkSession, folder: str, endings: tuple[str, ...] = (".md", ".txt")) -> DataFrame:
    """(doc_id, title, text) of text files; bad bytes are replaced, blank files left out."""
    found = files(spark, folder, endings)
    if not found:
        return spark.createDataFrame([], "doc_id string, title string, text string")
    raw = spark.read.format("binaryFile").load(found)
    name = F.element_at(F.split("path", "/"), -1)
    text = F.decode(F.col("content"), "UTF-8") if not hasattr(F, "make_valid_utf8") else F.make_valid_utf8(F.col("content").cast("string"))
    return raw.select(name.alias("doc_id"), F.regexp_replace(name, r"\.[^.]*$", "").alias("title"), text.alias("text")).where(F.trim("text") != "")


def jdbc(spark: SparkSession, url: str, table: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """A database table; arrays come as JSON text, and order is not kept."""
    return flatten(spark.read.format("jdbc").options(url=url, dbtable=table, **(options or {})).load())


def declared_keys(spark: SparkSession, url: str, schema: str, options: Mapping[str, str] | None = None) -> DataFrame:
    """Foreign keys a database declares, from its information schema."""
    query = (
        "(SELECT k.table_name AS from_table, k.column_name AS from_column, c.table_name AS to_table, c.column_name AS to_column "
        "FROM information_schema.referential_constraints r "
        "JOIN information_schema.key_column_usage k ON k.constraint_name = r.constraint_name "
        "JOIN information_schema.constraint_column_usage c ON c.constraint_name = r.unique_constraint_name "
        f"WHERE k.table_schema = '{schema}') q"
    )
    return spark.read.format("jdbc").options(url=url, dbtable=query, **(options or {})).load()


@dataclass
class Staging:
    tables: dict[str, DataFrame] = field(default_factory=dict)
    skipped: dict[str, str] = field(default_factory=dict)


def stage(spark: SparkSession, folder: str) -> Staging:
    """Tables of a folder by their path without its ending; files that can't be read as a table are reported with why."""
    out = Staging()
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    base = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/") + "/"
    for path in files(spark, folder, ("",)):
        name, _, ending = path.removeprefix(base).rpartition(".")
        try:
            if name in out.tables:
                raise ValueError("another file has this name")
            if ending == "csv":
                out.tables[name] = csv(spark, path)
            elif ending in ("json", "ndjson", "jsonl"):
                out.tables[name] = json_records(spark, path)
            elif ending == "parquet":
                out.tables[name] = spark.read.parquet(path)
            else:
                out.skipped[path] = "no table format"
        except Exception as e:  # a file is reported, not fatal
            out.skipped[path] = str(e).splitlines()[0][:200]
    return out


def views(staged: Mapping[str, DataFrame]) -> list[str]:
    """Registers a view a table and returns their names."""
    for name, df in staged.items():
        df.createOrReplaceTempView(name.replace("/", "_"))
    return sorted(x.replace("/", "_") for x in staged)

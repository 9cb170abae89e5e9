"""Writers: idempotent tables by key, retrieval units that change only where their text did, JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(stored: DataFrame | None, rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows by key, new ones in place of stored ones; writing the same rows twice changes nothing.

    Of new rows with one key, the least by all their columns in order stays, however the rows are laid out.
    """
    rest = [c for c in rows.columns if c not in key]
    one = rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__row")).select(*key, "__row.*").select(*rows.columns) if rest else rows.distinct()
    return one if stored is None else stored.join(one.select(*key), key, "left_anti").unionByName(one)


def replace(rows: DataFrame, path: str, partition: str | None = None) -> None:
    """The table holds exactly ``rows``; with ``partition``, only the partitions they touch are replaced."""
    writer = rows.write.mode("overwrite")
    if partition:
        writer = writer.partitionBy(partition).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def units_to_write(units: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(to embed, kept, stale): a unit is kept while its id, text hash, version and model are stored; ids no longer made are stale."""
    same = ["unit_id", "text_hash", "version", "model"]
    hashed = units.withColumn("text_hash", F.sha2(F.col("text").cast("binary"), 256))
    return hashed.join(stored.select(*same), same, "left_anti"), stored.join(hashed.select(*same), same, "left_semi"), stored.join(hashed.select("unit_id"), "unit_id", "left_anti")


def replace_documents(chunks: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks with those of re-read documents replaced; a document's stale chunks go."""
    return chunks.join(fresh.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(fresh)


def json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)

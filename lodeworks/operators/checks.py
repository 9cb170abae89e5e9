"""Graph checks: what should be there, what has no support, what contradicts itself. Each gives a row a rule with a count."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .claims import triples


def finding(df: DataFrame, rule: str, bad: Column | None = None) -> DataFrame:
    """(rule, n): all rows, or those for which ``bad`` holds."""
    return df.agg(F.lit(rule).alias("rule"), (F.count("*") if bad is None else F.count_if(bad)).alias("n"))


def together(*findings: DataFrame) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, findings)


def domain(nodes: DataFrame, report: DataFrame) -> DataFrame:
    """(label, expected, found) of every label whose records differ in number from what its rule wrote."""
    found = nodes.groupBy("label").agg(F.count("*").alias("found"))
    stated = report.select(F.col("rule").alias("label"), F.col("written").alias("expected"))
    both = stated.join(found, "label", "left").withColumn("found", F.coalesce("found", F.lit(0)))
    return both.where("expected <> found")


def lexical(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks of no document, documents without chunks, and gaps in a document's chunk numbers."""
    step = chunks.withColumn("before", F.lag("idx", 1, -1).over(W.partitionBy("doc_id").orderBy("idx")))
    return together(
        finding(chunks.join(documents.select("doc_id"), "doc_id", "left_anti"), "chunk_without_document"),
        finding(documents.join(chunks.select("doc_id"), "doc_id", "left_anti"), "document_without_chunks"),
        finding(step, "gap", F.col("idx") != F.col("before") + 1),
    )


def provenance(claims: DataFrame, chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """Claims whose chunk is missing, whose evidence doesn't stand in it, or whose ends are no mentions. Texts are normalised."""
    met = claims.join(chunks.select("chunk_id", "text_norm"), "chunk_id", "left")
    ids = mentions.select("mention_id")
    return together(
        finding(met, "chunk_missing", F.col("text_norm").isNull()),
        finding(met, "quote_missing", F.col("text_norm").isNotNull() & ~F.contains("text_norm", "evidence_norm")),
        finding(claims.join(ids, claims["subject_id"] == ids["mention_id"], "left_anti"), "subject_missing"),
        finding(claims.join(ids, claims["object_id"] == ids["mention_id"], "left_anti"), "object_missing"),
    )


def consistency(claims: DataFrame, refers_to: DataFrame, schema: DataFrame) -> DataFrame:
    """Mentions with several identities, claims about themselves, and claims of no allowed pattern."""
    several = refers_to.groupBy("mention_id").agg(F.count_distinct("canonical").alias("n")).where("n > 1")
    return together(
        finding(several, "several_identities"),
        finding(claims, "self_reference", F.col("subject") == F.col("object")),
        finding(claims.join(schema.distinct(), ["subject_type", "predicate", "object_type"], "left_anti"), "off_schema"),
    )


def contradictions(claims: DataFrame) -> DataFrame:
    """(subject, predicate, object) both affirmed and denied."""
    return triples(claims).groupBy("subject", "predicate", "object").agg(F.count("*").alias("n")).where("n > 1").drop("n")


def unfaithful(built: DataFrame, replayed: DataFrame) -> DataFrame:
    """Decisions that a replay makes differently, with the side each stands on."""
    return built.exceptAll(replayed).withColumn("side", F.lit("built")).unionByName(replayed.exceptAll(built).withColumn("side", F.lit("replayed")))


def fidelity(counted: DataFrame, logged: DataFrame) -> DataFrame:
    """(what, counted, logged) of the counts (what, n) that differ or stand on one side only."""
    a, b = counted.select("what", F.col("n").alias("counted")), logged.select("what", F.col("n").alias("logged"))
    return a.join(b, "what", "full").where(~F.col("counted").eqNullSafe(F.col("logged")))

"""Claims: statements with two ends, their truth, the entities their ends refer to, and aggregates over them.

``claims`` are (claim_id, chunk_id, doc_id, predicate, subject_id, object_id, truth, modality, condition, evidence);
``refers_to`` is (mention_id, canonical). A mention that refers to nothing is its own canonical entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import digest


def canonical(mentions: DataFrame, refers_to: DataFrame, id: str = "mention_id") -> DataFrame:
    to = refers_to.select(F.col("mention_id").alias(id), "canonical")
    return mentions.join(to, id, "left").withColumn("canonical", F.coalesce("canonical", id))


def aliases(mentions: DataFrame, refers_to: DataFrame) -> DataFrame:
    """(canonical, names, documents): spellings and documents of each entity."""
    return canonical(mentions, refers_to).groupBy("canonical").agg(F.array_sort(F.collect_set("name")).alias("names"), F.count_distinct("doc_id").alias("documents"))


def with_ends(claims: DataFrame, refers_to: DataFrame) -> DataFrame:
    """``claims`` with ``subject`` and ``object``, the canonical ids of their ends."""
    to = refers_to.select("mention_id", "canonical")
    s = to.select(F.col("mention_id").alias("subject_id"), F.col("canonical").alias("subject"))
    o = to.select(F.col("mention_id").alias("object_id"), F.col("canonical").alias("object"))
    joined = claims.join(s, "subject_id", "left").join(o, "object_id", "left")
    return joined.withColumns({"subject": F.coalesce("subject", "subject_id"), "object": F.coalesce("object", "object_id")})


def triples(claims: DataFrame) -> DataFrame:
    """Claims with ends as (subject, predicate, object, truth), without self references and repeats."""
    return claims.where("subject <> object").select("subject", "predicate", "object", "truth").distinct()


def opposites(claims: DataFrame) -> DataFrame:
    """(claim_id, sibling): claims of one triple that differ in truth. ``claims`` have canonical ends."""
    a = claims.select("claim_id", "subject", "predicate", "object", "truth")
    b = a.select(F.col("claim_id").alias("sibling"), "subject", "predicate", "object", F.col("truth").alias("other"))
    return a.join(b, ["subject", "predicate", "object"]).where("truth <> other").select("claim_id", "sibling")


def held(claims: DataFrame) -> DataFrame:
    """A row per statement: how often it is stated and denied, with its first claim's evidence."""
    keys = ["subject", "predicate", "object", "modality", "condition"]
    return claims.groupBy(*keys).agg(F.count_if(F.col("truth") != "negated").alias("stated"), F.count_if(F.col("truth") == "negated").alias("denied"), F.min_by("evidence", "claim_id").alias("evidence"))


def find(claims: DataFrame, predicate: str | None = None, subjects: DataFrame | None = None, objects: DataFrame | None = None, truth: str | None = "affirmed", modality: str | None = "actual") -> DataFrame:
    """Claims by predicate, ends in the given sets (ref), truth and modality."""
    for column, value in (("predicate", predicate), ("truth", truth), ("modality", modality)):
        if value is not None:
            claims = claims.where(F.col(column) == value)
    for column, refs in (("subject", subjects), ("object", objects)):
        if refs is not None:
            claims = claims.join(refs.select(F.col("ref").alias(column)).distinct(), column, "left_semi")
    return claims


def either_end(claims: DataFrame, refs: DataFrame) -> DataFrame:
    """(claim_id) of claims with an end in ``refs`` (ref)."""
    r = refs.select("ref").distinct()
    return claims.join(r, claims["subject"] == r["ref"], "left_semi").select("claim_id").unionByName(claims.join(r, claims["object"] == r["ref"], "left_semi").select("claim_id")).distinct()


def concepts(mentions: DataFrame) -> DataFrame:
    """(concept_id, type, key, name, mentions, aliases): mentions (type, name, name_norm) of one type and normalised name."""
    grouped = mentions.groupBy("type", F.col("name_norm").alias("key")).agg(F.count("*").alias("mentions"), F.min("name").alias("name"), F.array_sort(F.collect_set("name")).alias("aliases"))
    return grouped.select(digest(16, F.col("type"), F.col("key")).alias("concept_id"), "type", "key", "name", "mentions", "aliases")


def split_census(mentions: DataFrame) -> DataFrame:
    """(type, name_norm, entities): names of one type that stand for several canonical entities."""
    return mentions.groupBy("type", "name_norm").agg(F.count_distinct("canonical").alias("entities")).where("entities > 1")


def triple_truth(claims: DataFrame) -> DataFrame:
    """``claims`` with ``triple_truth``: a negation word inside an end's own name denies nothing of the triple."""
    negation = F.lower(F.coalesce("negation", F.lit("")))
    inside = (negation != "") & (F.contains(F.lower("subject_name"), negation) | F.contains(F.lower("object_name"), negation))
    return claims.withColumn("triple_truth", F.when((F.col("truth") == "negated") & inside, F.lit("affirmed")).otherwise(F.col("truth")))


#: Subjects and objects that name nothing.
PRONOUNS = ("it", "its", "he", "she", "they", "them", "this", "that", "these", "those", "we", "i", "you", "who", "which")


def verify(claims: DataFrame, schema: DataFrame) -> DataFrame:
    """``claims`` with ``rejected``: the first rule a claim breaks, null if none.

    Claims are (subject_name, subject_type, predicate, object_name, object_type, evidence, text); names, evidence and text
    are normalised. ``schema`` holds the allowed (subject_type, predicate, object_type).
    """
    allowed = schema.select("subject_type", "predicate", "object_type").distinct().withColumn("__ok", F.lit(True))
    s, o = F.col("subject_name"), F.col("object_name")
    rule = (
        F.when(F.col("__ok").isNull(), "schema")
        .when((F.coalesce("evidence", F.lit("")) == "") | ~F.contains("text", "evidence"), "quote")
        .when(s.isin(*PRONOUNS) | o.isin(*PRONOUNS), "pronoun")
        .when(s == o, "self_reference")
        .when(~F.contains("text", s) | ~F.contains("text", o), "name")
    )
    return claims.join(allowed, ["subject_type", "predicate", "object_type"], "left").withColumn("rejected", rule).drop("__ok")


def accepted(claims: DataFrame) -> DataFrame:
    """Verified claims, once a chunk, ends, predicate and truth: the least by its other columns."""
    key = ["chunk_id", "subject_name", "predicate", "object_name", "truth"]
    rest = [c for c in claims.columns if c not in key]
    kept = claims.where("rejected is null")
    return kept.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__row")).select(*key, "__row.*").select(*claims.columns) if rest else kept.distinct()


def unsupported(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations (answer, chunk_id, quote_norm) whose quote doesn't stand in their chunk (chunk_id, text_norm)."""
    met = citations.join(chunks, "chunk_id", "left")
    return met.where(F.col("text_norm").isNull() | (F.col("quote_norm") == "") | ~F.contains("text_norm", "quote_norm")).select("answer", "chunk_id", "quote_norm")

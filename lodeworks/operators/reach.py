"""From things to passages and back: which chunks an item reaches, what a chunk concerns, evidence lines, gold matching.

Tables: ``mentions`` (mention_id, name, doc_id), ``refers_to`` (mention_id, canonical), ``chunk_mentions`` (chunk_id,
mention_id), ``claims`` with canonical ends (``claims.with_ends``), ``attachments`` (ref, claim_id), ``about`` (kind, id,
ref: a document or a chunk and the record it is about), ``chunks`` (chunk_id, doc_id, idx, ...).
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import compatible_names
from .resolve import candidate_pairs


@dataclass(frozen=True)
class Texts:
    chunks: DataFrame
    claims: DataFrame
    mentions: DataFrame
    refers_to: DataFrame
    chunk_mentions: DataFrame
    attachments: DataFrame
    about: DataFrame


def item_chunks(kind: str, t: Texts) -> DataFrame:
    """(item, chunk_id, pattern): every chunk that items of a kind reach, by each pattern that reaches it."""
    claim = t.claims.select("claim_id", "chunk_id")
    held = t.attachments.join(claim, "claim_id").select(F.col("ref").alias("item"), "chunk_id", F.lit("held").alias("pattern"))
    ends = t.claims.select(F.explode(F.array("subject", "object")).alias("item"), "chunk_id", F.lit("end").alias("pattern"))
    if kind == "record":
        of_docs = t.about.where("kind = 'document'").select(F.col("id").alias("doc_id"), F.col("ref").alias("item"))
        by_doc = of_docs.join(t.chunks.select("doc_id", "chunk_id"), "doc_id").select("item", "chunk_id", F.lit("document").alias("pattern"))
        by_chunk = t.about.where("kind = 'chunk'").select(F.col("ref").alias("item"), F.col("id").alias("chunk_id"), F.lit("section").alias("pattern"))
        parts = [held, by_doc, by_chunk, ends]
    elif kind == "entity":
        canonical = t.mentions.join(t.refers_to, "mention_id", "left").select("mention_id", F.coalesce("canonical", "mention_id").alias("item"))
        named = t.chunk_mentions.join(canonical, "mention_id").select("item", "chunk_id", F.lit("named").alias("pattern"))
        parts = [ends, named, held]
    elif kind == "claim":
        parts = [claim.select(F.col("claim_id").alias("item"), "chunk_id", F.lit("from").alias("pattern"))]
    else:
        parts = [t.chunks.select(F.col("chunk_id").alias("item"), "chunk_id", F.lit("itself").alias("pattern"))]
    return functools.reduce(DataFrame.unionByName, parts).distinct()


def chunks_of(items: DataFrame, kind: str, t: Texts) -> DataFrame:
    """(item, chunk_id) of the given items (id)."""
    return item_chunks(kind, t).join(items.select(F.col("id").alias("item")).distinct(), "item", "left_semi").select("item", "chunk_id").distinct()


def documents_of(items: DataFrame, kind: str, t: Texts) -> DataFrame:
    """(item, doc_id)."""
    return chunks_of(items, kind, t).join(t.chunks.select("chunk_id", "doc_id"), "chunk_id").select("item", "doc_id").distinct()


def concerned(t: Texts) -> DataFrame:
    """(chunk_id, ref): the records a chunk is about itself, or else those its document is about."""
    own = t.about.where("kind = 'chunk'").select(F.col("id").alias("chunk_id"), "ref")
    docs = t.about.where("kind = 'document'").select(F.col("id").alias("doc_id"), "ref")
    rest = t.chunks.select("chunk_id", "doc_id").join(own.select("chunk_id"), "chunk_id", "left_anti")
    return own.unionByName(rest.join(docs, "doc_id").select("chunk_id", "ref")).distinct()


def in_reading_order(chunks: DataFrame, about: DataFrame, named: DataFrame) -> DataFrame:
    """(chunk_id, ref, place): what a chunk concerns, records it is about first, then nodes by where a name first stands.

    ``named`` is (chunk_id, ref, names); a name that isn't found comes last, ties go by ref.
    """
    text = F.lower("text")
    spots = F.filter(F.transform("names", lambda n: F.when(n != "", F.instr(text, F.lower(n)))), lambda p: p > 0)
    first = named.join(chunks.select("chunk_id", "text"), "chunk_id").select("chunk_id", "ref", F.lit(1).alias("turn"), F.coalesce(F.array_min(spots), F.lit(2**31 - 1)).alias("at"))
    every = about.select("chunk_id", "ref", F.lit(0).alias("turn"), F.lit(0).alias("at")).unionByName(first)
    once = every.groupBy("chunk_id", "ref").agg(F.min(F.struct("turn", "at")).alias("o"))
    return once.select("chunk_id", "ref", F.row_number().over(W.partitionBy("chunk_id").orderBy("o", "ref")).alias("place"))


def evidence_lines(lines: DataFrame, most: int = 5) -> DataFrame:
    """(ref, line, place): each thing's first distinct lines in reading order (ref, doc_id, idx, line)."""
    once = lines.groupBy("ref", "line").agg(F.min(F.struct("doc_id", "idx")).alias("o"))
    place = F.row_number().over(W.partitionBy("ref").orderBy("o", "line"))
    return once.select("ref", "line", place.alias("place")).where(F.col("place") <= most)


def thing_joins(claims: DataFrame, attachments: DataFrame, plain: DataFrame) -> DataFrame:
    """(a, b, witness): things that one claim joins, and whether they are joined without claims too (``plain``: a, b)."""
    ends = claims.select("claim_id", F.explode(F.array("subject", "object")).alias("x"))
    things = ends.unionByName(attachments.select("claim_id", F.col("ref").alias("x"))).distinct()
    pairs = things.select("claim_id", F.col("x").alias("a")).join(things.select("claim_id", F.col("x").alias("b")), "claim_id").where("a < b").select("a", "b").distinct()
    known = plain.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("witness", F.lit(True))
    return pairs.join(known, ["a", "b"], "left").withColumn("witness", F.coalesce("witness", F.lit(False)))


def outside_scope(links: DataFrame, scopes: DataFrame) -> DataFrame:
    """Links (doc_id, ref) to records that aren't in the document's scope (doc_id, ref)."""
    return links.join(scopes, ["doc_id", "ref"], "left_anti")


def part_of(claims: DataFrame, parts: DataFrame) -> DataFrame:
    """(claim, ref, evidence): wholes of the claim's subject, by part-of claims of its document: (doc_id, subject, whole_ref, quote)."""
    met = claims.join(parts, ["doc_id", "subject"])
    return met.groupBy("claim", F.col("whole_ref").alias("ref")).agg(F.min("quote").alias("evidence"))


def key_beside(normed: Column, name: Column, key: Column) -> Column:
    """Whether a key stands right beside a name, with a bracket, colon or number sign between at most. All are normalised."""
    safe = lambda c: F.regexp_replace(c, r"([^a-z0-9 ])", r"\\$1")
    after = F.concat(F.lit(r"(?<![a-z0-9])"), safe(name), F.lit(r"\s*[(\[:#]?\s*"), safe(key), F.lit(r"(?![a-z0-9])"))
    before = F.concat(F.lit(r"(?<![a-z0-9])"), safe(key), F.lit(r"\s*[)\]]?\s*"), safe(name), F.lit(r"(?![a-z0-9])"))
    return F.regexp_like(normed, after) | F.regexp_like(normed, before)


def containing(names: DataFrame, candidates: DataFrame) -> DataFrame:
    """(ref, mention_id): the mention whose words hold all of a record's; the most mentioned, shortest, least.

    ``names`` are (doc_id, ref, key), ``candidates`` (doc_id, mention_id, key, mentions); keys are normalised names.
    """
    met = names.join(candidates.withColumnRenamed("key", "said"), "doc_id")
    met = met.where((F.col("key") != "") & (F.size(F.array_except(F.split("key", " "), F.split("said", " "))) == 0))
    best = met.groupBy("doc_id", "ref").agg(F.min(F.struct((-F.col("mentions")).alias("m"), F.length("said").alias("n"), "mention_id")).alias("b"))
    return best.select("doc_id", "ref", "b.mention_id")


def nominated(units: DataFrame, borderline: float = 80.0, near: DataFrame | None = None) -> DataFrame:
    """(a, b, signal): pairs of units (id, type, name) that are name variants, spelled alike, or near in meaning (a, b).

    Variants share a last word; they meet on it. Spelling goes through the blocked candidates.
    """
    last = F.regexp_extract(F.lower("name"), r"([\p{L}\p{N}]+)[^\p{L}\p{N}]*$", 1)
    x = units.select("type", F.col("id").alias("a"), F.col("name").alias("na"), last.alias("w"))
    y = units.select("type", F.col("id").alias("b"), F.col("name").alias("nb"), last.alias("w"))
    variants = x.join(y, ["type", "w"]).where("a < b").where(compatible_names("na", "nb")).select("a", "b", F.lit(0).alias("s"))
    spelled = candidate_pairs(units, borderline).select("a", "b", F.lit(1).alias("s"))
    every = variants.unionByName(spelled)
    if near is not None:
        every = every.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(2).alias("s")))
    names = F.array(F.lit("variant"), F.lit("spelling"), F.lit("meaning"))
    return every.groupBy("a", "b").agg(F.min("s").alias("s")).select("a", "b", F.get(names, F.col("s")).alias("signal"))


def gold_matches(gold: DataFrame, facts: DataFrame) -> DataFrame:
    """(gold_id, fact_id): facts of a gold triple's predicate whose ends go by its names, in its document if it names one.

    Gold is (gold_id, doc_id, subject, predicate, object), facts (fact_id, doc_id, subject_names, predicate, object_names);
    names are normalised. The join goes over predicate and subject name.
    """
    rows = facts.select("fact_id", F.col("doc_id").alias("of"), "predicate", F.explode("subject_names").alias("subject"), "object_names")
    met = gold.join(rows, ["predicate", "subject"]).where(F.array_contains("object_names", F.col("object")))
    return met.where(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("of"))).select("gold_id", "fact_id").distinct()


def judged(gold: DataFrame, matches: DataFrame, verdicts: DataFrame | None = None) -> DataFrame:
    """(gold_id, status): ``exact`` where a fact matches, else a judge's verdict (gold_id, status), else ``open``."""
    out = gold.select("gold_id").join(matches.select("gold_id").distinct().withColumn("m", F.lit("exact")), "gold_id", "left")
    if verdicts is not None:
        out = out.join(verdicts.select("gold_id", F.col("status").alias("v")), "gold_id", "left")
    else:
        out = out.withColumn("v", F.lit(None).cast("string"))
    return out.select("gold_id", F.coalesce("m", "v", F.lit("open")).alias("status"))


def technique_table(scores: DataFrame) -> DataFrame:
    """(budget, best, runner_up, ahead): of scores (system, budget, complete), the best system a budget and its lead; ties by name."""
    w = W.partitionBy("budget").orderBy(F.desc("complete"), "system")
    top = scores.withColumn("n", F.row_number().over(w)).withColumn("second", F.lead("system").over(w)).withColumn("behind", F.lead("complete").over(w))
    return top.where("n = 1").select("budget", F.col("system").alias("best"), F.col("second").alias("runner_up"), (F.col("complete") - F.col("behind")).alias("ahead"))


def code_like(value: Column) -> Column:
    """Letters and digits joined by ``_``, ``.`` or ``-`` without blanks: a code, not a name."""
    return value.rlike(r"^[\p{L}\p{N}]+(?:[_.\-][\p{L}\p{N}]+)+$")

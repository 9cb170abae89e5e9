"""Evaluation: proportions with intervals, paired tests, set answers, pair scores, percentiles, reports at budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import mcnemar, nearest_rank, wilson


def proportion(df: DataFrame, passed: Column, by: str | None = None) -> DataFrame:
    """(by, k, n, share, low, high); with ``by``, a row a value and one (null) overall."""
    k, n = F.count_if(passed).alias("k"), F.count(passed).alias("n")
    told = df.rollup(by).agg(k, n) if by else df.agg(k, n)
    low, high = wilson(F.col("k"), F.col("n"))
    return told.withColumns({"share": F.when(F.col("n") > 0, F.col("k") / F.col("n")), "low": low, "high": high})


def paired(outcomes: DataFrame, by: str | None = None) -> DataFrame:
    """(by, both, only_a, only_b, neither, p) of outcomes (a, b booleans); a null ``by`` is the whole."""
    a, b = F.col("a"), F.col("b")
    counts = [F.count_if(a & b).alias("both"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.count_if(~a & ~b).alias("neither")]
    told = outcomes.rollup(by).agg(*counts) if by else outcomes.agg(*counts)
    return told.withColumn("p", mcnemar("only_a", "only_b"))


def paired_join(a: DataFrame, b: DataFrame, id: str = "question") -> DataFrame:
    """Outcomes (id, passed) of two systems over the same questions; refuses questions that one of them lacks."""
    if not a.join(b, id, "left_anti").isEmpty() or not b.join(a, id, "left_anti").isEmpty():
        raise ValueError("the systems answered different questions")
    return a.select(id, F.col("passed").alias("a")).join(b.select(id, F.col("passed").alias("b")), id)


def percentile(df: DataFrame, value: str, shares: list[float], by: list[str] | None = None) -> DataFrame:
    """Nearest-rank percentiles, exact: the value at rank ceil(share * n)."""
    held = df.groupBy(*(by or [])).agg(F.sort_array(F.collect_list(value)).alias("__v"))
    return held.select(*(by or []), *[nearest_rank(F.col("__v"), s).alias(f"p{round(s * 100)}") for s in shares])


def confusion(df: DataFrame, expected: str, given: str) -> DataFrame:
    return df.groupBy(expected, given).agg(F.count("*").alias("n"))


def precision_recall(found: DataFrame, gold: DataFrame, on: list[str]) -> DataFrame:
    """(found, gold, hits, precision, recall) of two sets."""
    found, gold = found.select(*on).distinct(), gold.select(*on).distinct()
    hits = found.join(gold, on, "left_semi").agg(F.count("*").alias("hits"))
    told = found.agg(F.count("*").alias("found")).join(gold.agg(F.count("*").alias("gold"))).join(hits)
    return told.withColumns({"precision": F.when(F.col("found") > 0, F.col("hits") / F.col("found")), "recall": F.when(F.col("gold") > 0, F.col("hits") / F.col("gold"))})


def pair_scores(pairs: DataFrame, canonical: DataFrame) -> DataFrame:
    """Identity pairs (a, b, same) against canonical ids (id, canonical): counts of each kind of right and wrong."""
    c = canonical.select("id", "canonical")
    joined = pairs.join(c.select(F.col("id").alias("a"), F.col("canonical").alias("ca")), "a", "left").join(c.select(F.col("id").alias("b"), F.col("canonical").alias("cb")), "b", "left")
    one = F.coalesce(F.coalesce("ca", "a") == F.coalesce("cb", "b"), F.lit(False))
    return joined.agg(F.count_if(F.col("same") & one).alias("joined"), F.count_if(F.col("same") & ~one).alias("missed"), F.count_if(~F.col("same") & one).alias("wrong"), F.count_if(~F.col("same") & ~one).alias("apart"))


def sets_match(expected: Column, given: Column) -> Column:
    """Answers as sets of name keys."""
    return (F.size(F.array_except(expected, given)) == 0) & (F.size(F.array_except(given, expected)) == 0)


def counts_by_reason(rows: DataFrame, reason: str, every: DataFrame) -> DataFrame:
    """Counts of each reason of ``every`` (reason), zeros kept."""
    n = rows.groupBy(reason).agg(F.count("*").alias("n"))
    return every.join(n, reason, "left").select(reason, F.coalesce("n", F.lit(0)).alias("n"))


def selectivity(reach: DataFrame, total: int, hub_share: float) -> DataFrame:
    """(median, p90, hubs) of the share of the corpus that each start (start, chunk_id) reaches."""
    share = reach.groupBy("start").agg((F.count_distinct("chunk_id") / F.lit(total)).alias("share"))
    return share.agg(F.percentile("share", F.lit(0.5)).alias("median"), nearest_rank(F.sort_array(F.collect_list("share")), 0.9).alias("p90"), F.count_if(F.col("share") >= hub_share).alias("hubs"))

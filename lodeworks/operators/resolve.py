"""Entity resolution: blocked candidates, scores, guards, decisions, merge groups, record links and attachments.

Pairs are never formed by comparing everything with everything. Names at a token-sort score must share a number of letter
pairs that follows from the score; so their rarest pairs, as many as a name may lose and one more, must meet (``blocks``).
Every pair that could reach the cutoff meets there. The score itself is an Arrow UDF over the pairs.
"""

from __future__ import annotations

import functools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import name_blocks, name_score, name_words, near_name, ratio, untitled
from ..functions.text import contains_words, name_key, squash
from .graph import components

# fixed values: score bounds and the order of the attachment routes
BORDERLINE, AUTO_MERGE = 80.0, 92.0
ROUTES = ("key_in_sentence", "part_of", "section", "document")
# ids of a type in one row
RUN = 10_000


@F.pandas_udf(T.DoubleType())
def key_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio`` of two name keys (normalised names with sorted words): the token-sort score."""
    return pd.Series([ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b, strict=True)], dtype="float64")


def pairs_kept(length: Column, cutoff: float) -> Column:
    """Least number of letter pairs that a key of ``length`` shares with any key at ``cutoff``.

    Keys of la and lb letters at share s differ by (1 - s)(la + lb) insertions and deletions at most; a deletion takes two
    pairs of the key and an insertion one, so it loses 1.5 (1 - s)(la + lb) + (la - lb) / 2 of its la - 1 pairs at most. lb
    lies between la s / (2 - s) and la (2 - s) / s; the loss is linear in lb and greatest at an end.
    """
    s = cutoff / 100
    loss = max(1.5 * (1 - s) * (1 + r) + (1 - r) / 2 for r in (s / (2 - s), (2 - s) / s))
    return F.ceil(length - 1 - length * F.lit(loss) - F.lit(1e-9))


def letter_pairs(key: Column) -> Column:
    """Pairs of neighbouring letters, each with the number of times it stood before."""
    n = F.length(key) - 1
    each = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(key, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.transform(each, lambda g, i: F.concat(g, F.size(F.filter(F.slice(each, 1, i), lambda h: h == g)).cast("string")))


def blocks(keyed: DataFrame, cutoff: float) -> DataFrame:
    """(id, type, key, block): two rows at the cutoff share a block.

    A key that keeps c of its n pairs shows its n - c + 1 rarest, rarity over all keys of the type. Keys too short to be
    sure of a pair show their letters, and keys not much longer than such show theirs as well.
    """
    s = cutoff / 100
    pairs = keyed.select("id", "type", F.explode(letter_pairs(F.col("key"))).alias("g"))
    seen = pairs.groupBy("type", "g").agg(F.count("*").alias("n"))
    ranked = pairs.join(seen, ["type", "g"]).groupBy("id", "type").agg(F.array_sort(F.collect_list(F.struct("n", "g"))).alias("gs"))
    rows = keyed.join(ranked, ["id", "type"], "left")
    sure = pairs_kept(F.length("key"), cutoff)
    shown = F.when(sure >= 1, F.transform(F.slice("gs", 1, F.size("gs") - sure.cast("int") + 1), lambda x: x["g"])).otherwise(F.transform(F.coalesce("gs", F.array().cast("array<struct<n:bigint,g:string>>")), lambda x: x["g"]))
    loose = [n for n in range(200) if n - 1 - n * max(1.5 * (1 - s) * (1 + r) + (1 - r) / 2 for r in (s / (2 - s), (2 - s) / s)) - 1e-9 <= 0]
    longest = int(max(loose, default=0) * (2 - s) / s)
    letters = F.when(F.length("key") <= longest, F.array_distinct(F.split("key", ""))).otherwise(F.array().cast("array<string>"))
    empty = F.when(F.length("key") == 0, F.array(F.lit("\x00"))).otherwise(F.array().cast("array<string>"))
    return rows.select("id", "type", "key", F.explode(F.concat(shown, letters, empty)).alias("block"))


def candidate_pairs(entities: DataFrame, cutoff: float = BORDERLINE) -> DataFrame:
    """(type, a, b, score), a < b: pairs of one type whose names score ``cutoff`` or more.

    ``entities`` are (id, type, name). Equal keys pair through their least id; others meet in a block.
    """
    keyed = entities.select("id", "type", name_key(F.col("name")).alias("key"))
    groups = keyed.groupBy("type", "key").agg(F.min("id").alias("id"))
    same = keyed.join(groups.withColumnRenamed("id", "lead"), ["type", "key"]).where("id <> lead").select("type", F.col("lead").alias("a"), F.col("id").alias("b"), F.lit(100.0).alias("score"))
    rows = blocks(groups.select("id", "type", "key"), cutoff)
    a, b = rows.alias("a"), rows.alias("b")
    size = F.least(F.length("a.key"), F.length("b.key")) / F.greatest(F.length("a.key"), F.length("b.key"))
    # a score s needs lengths within s / (200 - s) of each other
    met = a.join(b, (F.col("a.type") == F.col("b.type")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.id") < F.col("b.id")) & (size >= cutoff / (200 - cutoff) - 1e-9))
    pairs = met.select(F.col("a.type").alias("type"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.key").alias("ka"), F.col("b.key").alias("kb")).distinct()
    scored = pairs.select("type", "a", "b", key_ratio("ka", "kb").alias("score")).where(F.col("score") >= cutoff)
    return scored.unionByName(same)


def mutual_nearest(scores: DataFrame, k: int = 1) -> DataFrame:
    """Pairs (type, a, b, score) that are among each other's ``k`` best, ties by id."""
    both = scores.select("type", "a", "b", "score").unionByName(scores.select("type", F.col("b").alias("a"), F.col("a").alias("b"), "score"))
    w = W.partitionBy("type", "a").orderBy(F.desc("score"), "b")
    best = both.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")
    back = best.select("type", F.col("b").alias("a"), F.col("a").alias("b"))
    return best.join(back, ["type", "a", "b"], "left_semi").where("a < b")


def value_scores(items: DataFrame, most: float) -> DataFrame:
    """(type, a, b, score), a < b: every pair of one type of items (type, id, v); the nearer the values, the higher the score, up to ``most``.

    These are as many as a type's pairs.
    """
    x, y = items.alias("x"), items.alias("y")
    met = x.join(y, (F.col("x.type") == F.col("y.type")) & (F.col("x.id") < F.col("y.id")))
    return met.select(F.col("x.type").alias("type"), F.col("x.id").alias("a"), F.col("y.id").alias("b"), (F.lit(most) - F.abs(F.col("x.v") - F.col("y.v"))).alias("score"))


def mutual_nearest_values(items: DataFrame, most: float) -> DataFrame:
    """``mutual_nearest(value_scores(items, most))`` without its pairs: an item's best is beside it in the order of values.

    That is the least id of its own value, of the next value below or of the next above. It needs values whose scores can't
    round to one; types with values closer than that, with nulls, with values that aren't finite or with repeated ids keep
    all their pairs.
    """
    items = items.where("type is not null and id is not null").select("type", "id", "v")
    of_type = W.partitionBy("type").orderBy("v")
    values = items.groupBy("type", "v").agg(F.min("id").alias("least"))
    values = values.select("*", *[f(c).over(of_type).alias(f"{side}_{c}") for c in ("v", "least") for side, f in (("below", F.lag), ("above", F.lead))])
    apart = F.lit(1e-14) * (F.lit(most) + 4 * F.max(F.abs("v")))
    strange = F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))
    close = values.groupBy("type").agg((F.coalesce(F.bool_or(strange), F.lit(False)) | F.coalesce(F.min(F.col("above_v") - F.col("v")) < apart, F.lit(False))).alias("odd"))
    repeated = items.groupBy("type", "id").agg(F.count("*").alias("n")).where("n > 1").select("type")
    odd = close.where("odd").select("type").unionByName(repeated).distinct()
    plain = items.join(odd, "type", "left_anti").join(values, ["type", "v"])
    of_value = W.partitionBy("type", "v").orderBy("id")
    other = F.when(F.col("id") == F.col("least"), F.lead("id").over(of_value)).otherwise(F.col("least"))
    score = lambda v: F.lit(most) - F.abs(F.col("v") - v)
    of = lambda v, b: F.when(b.isNotNull(), F.struct((-score(v)).alias("s"), b.alias("b")))
    plain = plain.withColumn("other", other)
    best = F.least(of(F.col("v"), F.col("other")), of(F.col("below_v"), F.col("below_least")), of(F.col("above_v"), F.col("above_least")))
    best = plain.select("type", F.col("id").alias("a"), best.alias("best")).where("best is not null").select("type", "a", F.col("best.b").alias("b"), (-F.col("best.s")).alias("score"))
    back = best.select("type", F.col("b").alias("a"), F.col("a").alias("b"))
    near = best.where("a < b").join(back, ["type", "a", "b"], "left_semi")
    return near.unionByName(mutual_nearest(value_scores(items.join(odd, "type", "left_semi"), most)))


# guards: pairs that must not merge


def opposed(a: Column, b: Column) -> Column:
    """One only praised and the other only blamed."""
    one = lambda x, p, n: F.array_contains(x, p) & ~F.array_contains(x, n)
    return (one(a, "positive", "negative") & one(b, "negative", "positive")) | (one(a, "negative", "positive") & one(b, "positive", "negative"))


def compound(a: Column, b: Column) -> Column:
    """One normalised name is the other with one more word at its end: the last word names the kind."""
    words = lambda c: F.regexp_extract_all(c, F.lit("([a-z0-9]+)"), F.lit(1))
    longer = lambda p, q: (F.size(q) > 0) & (F.size(p) == F.size(q) + 1) & (F.slice(p, 1, F.size(q)) == q)
    x, y = words(a), words(b)
    return longer(x, y) | longer(y, x)


def same_sentence(pairs: DataFrame, named: DataFrame) -> DataFrame:
    """Pairs (a, b) without those that one sentence names both; ``named`` is (sentence, id)."""
    x = named.select("sentence", F.col("id").alias("a")).distinct()
    y = named.select("sentence", F.col("id").alias("b")).distinct()
    together = x.join(y, "sentence").where("a < b").select("a", "b").distinct()
    return pairs.join(together, ["a", "b"], "left_anti")


def pairs_apart(items: DataFrame, named: DataFrame) -> DataFrame:
    """(type, a, b), a < b: every pair of one type of items (type, id), without those that one sentence names both.

    The same as ``same_sentence`` over all pairs, which are never dealt: an item meets its type's ids in runs of ``RUN``
    and leaves out its own list of ids named beside it. Only ids of one type are looked for in a sentence.
    """
    items = items.select("type", "id").where("type is not null and id is not null")
    said = named.select("sentence", "id").join(items.distinct(), "id").select("sentence", "type", "id").distinct()
    met = said.withColumnRenamed("id", "a").join(said.withColumnRenamed("id", "b"), ["sentence", "type"]).where("a < b")
    beside = met.groupBy(F.col("type"), F.col("a")).agg(F.collect_set("b").alias("beside"))
    place = F.row_number().over(W.partitionBy("type").orderBy("id"))
    runs = items.withColumn("run", F.floor(place / F.lit(RUN))).groupBy("type", "run").agg(F.collect_list("id").alias("ids"), F.max("id").alias("last"))
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = items.withColumnRenamed("id", "a").join(beside, ["type", "a"], "left").repartition(parts, "type", "a")
    every = each.join(F.broadcast(runs), "type").where("last > a").select("type", "a", "beside", F.explode("ids").alias("b")).where("b > a")
    return every.where(F.col("beside").isNull() | ~F.array_contains("beside", F.col("b"))).select("type", "a", "b")


def part_and_whole(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """Pairs without those that a claim calls part and whole; ``parts`` is (part, whole)."""
    joined = parts.select(F.least("part", "whole").alias("a"), F.greatest("part", "whole").alias("b")).distinct()
    return pairs.join(joined, ["a", "b"], "left_anti")


def decide(candidates: DataFrame, verdicts: DataFrame | None = None, auto: float = AUTO_MERGE) -> DataFrame:
    """(…, decision): ``auto`` at the bound or above; else what a verdict (a, b, same) says, ``skipped`` without one."""
    if verdicts is None:
        verdict = F.lit("skipped")
    else:
        candidates = candidates.join(verdicts.select("a", "b", "same"), ["a", "b"], "left")
        verdict = F.when(F.col("same").isNull(), "skipped").when(F.col("same"), "model").otherwise("keep")
    return candidates.withColumn("decision", F.when(F.col("score") >= auto, "auto").otherwise(verdict)).drop("same")


def merge_groups(entities: DataFrame, decisions: DataFrame) -> DataFrame:
    """(id, canonical) of every entity (id, name, mentions): its group's most mentioned, shortest named, least member."""
    merged = decisions.where(F.col("decision").isin("auto", "model"))
    comps = components(merged, "a", "b").select(F.col("node").alias("id"), "comp")
    of = entities.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    lead = of.groupBy("comp").agg(F.min(F.struct((-F.col("mentions")).alias("m"), F.length("name").alias("l"), "id")).alias("lead"))
    return of.join(lead, "comp").select("id", F.col("lead.id").alias("canonical"))


def merged_view(entities: DataFrame, canonical: DataFrame) -> DataFrame:
    """(canonical, name, names, mentions): one row a group."""
    of = entities.join(canonical, "id")
    name = F.max(F.when(F.col("id") == F.col("canonical"), F.col("name"))).alias("name")
    return of.groupBy("canonical").agg(name, F.array_sort(F.collect_set("name")).alias("names"), F.sum("mentions").alias("mentions"))


def in_passes(entities: DataFrame, cutoff: float = BORDERLINE, auto: float = AUTO_MERGE, passes: int = 3) -> DataFrame:
    """(id, canonical) after merging, and merging the merged, until nothing merges or the passes are over."""
    now = entities.select("id", F.col("id").alias("canonical"))
    view = entities.select("id", "type", "name", "mentions")
    for _ in range(passes):
        decisions = decide(candidate_pairs(view, cutoff), auto=auto)
        if decisions.where(F.col("decision").isin("auto", "model")).isEmpty():
            break
        step = merge_groups(view, decisions)
        now = now.join(step.select(F.col("id").alias("canonical"), F.col("canonical").alias("next")), "canonical").select("id", F.col("next").alias("canonical"))
        merged = merged_view(view, step).join(view.select(F.col("id").alias("canonical"), "type"), "canonical")
        view = merged.select(F.col("canonical").alias("id"), "type", "name", "mentions")
    return now


def best_matches(scores: DataFrame, threshold: float) -> DataFrame:
    """All best (mention, record, score) at the threshold or above; several rows of a mention are an ambiguity, kept."""
    w = W.partitionBy("mention").orderBy(F.desc("score"))
    return scores.where(F.col("score") >= threshold).withColumn("n", F.rank().over(w)).where("n = 1").drop("n")


def match_records(mentions: DataFrame, records: DataFrame, threshold: float = AUTO_MERGE, borderline: float = BORDERLINE) -> tuple[DataFrame, DataFrame]:
    """(matches, near misses) of mentions (mention, type, name) and records (ref, type, name, key).

    A key in the name decides alone. Otherwise names meet whose words all agree up to their endings, or all letters
    without spaces, as a score needs (``name_blocks``); the best score at the threshold or above matches, ties kept.
    Mentions without a match keep their near misses for an adjudicator; those share a word's first letters only, so they
    are as many as the pairs with such a word.
    """
    squashed = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    words = lambda c: F.explode(F.array_distinct(name_words(c)))
    tokens = F.concat(F.transform(F.split("name", r"\s+"), squashed), F.array(squashed(F.col("name"))))
    said = mentions.select("mention", F.explode(F.array_distinct(tokens)).alias("k"))
    keys = records.where(F.col("key").rlike("[0-9]")).select("ref", squashed(F.col("key")).alias("k"))
    by_key = said.join(keys, "k").select("mention", F.col("ref").alias("record"), F.lit(100.0).alias("score")).distinct()
    rest = mentions.join(by_key.select("mention"), "mention", "left_anti")
    named = records.select("ref", "type", F.col("name").alias("record_name"))
    columns = ["mention", "name", F.col("ref").alias("record"), "record_name"]

    said_words = rest.select("mention", "type", "name", name_words(F.col("name")).alias("ws")).withColumn("bare", untitled(F.col("ws")))
    left_blocks = said_words.select("mention", "type", "name", F.explode(F.array_union(name_blocks(F.col("ws")), name_blocks(F.col("bare")))).alias("w"))
    right_blocks = named.withColumn("ws", name_words(F.col("record_name"))).select("ref", "type", "record_name", F.explode(name_blocks(F.col("ws"))).alias("w"))
    alike = left_blocks.join(right_blocks, ["type", "w"]).select(*columns).distinct()
    scored = alike.withColumn("score", name_score(threshold)("name", "record_name"))
    best = best_matches(scored.where("score is not null").select("mention", "record", "score"), threshold)
    matches = by_key.unionByName(best)

    first = F.substring("w", 1, 3)
    whole = lambda c: F.concat(F.lit("="), squash(c))
    left = rest.join(matches.select("mention"), "mention", "left_anti").select("mention", "type", "name")
    left_words = left.select("*", words(F.col("name")).alias("w")).withColumn("w", first).unionByName(left.select("*", whole(F.col("name")).alias("w")))
    right_words = named.select("*", words(F.col("record_name")).alias("w")).withColumn("w", first).unionByName(named.select("*", whole(F.col("record_name")).alias("w")))
    near = left_words.join(right_words, ["type", "w"]).select(*columns).distinct()
    return matches, near.where(near_name(borderline)("name", "record_name")).select("mention", "record")


def choose_routes(candidates: DataFrame, order: tuple[str, ...] = ROUTES) -> DataFrame:
    """Attachments (claim, kind, ref, route): only the most specific route's rows of each claim and kind stay."""
    place = functools.reduce(lambda c, x: c.when(F.col("route") == x[1], x[0]), enumerate(order[1:], 1), F.when(F.col("route") == order[0], 0))
    w = W.partitionBy("claim", "kind").orderBy("place")
    return candidates.withColumn("place", place).withColumn("n", F.rank().over(w)).where("n = 1").drop("n", "place")


def by_title(documents: DataFrame, records: DataFrame) -> DataFrame:
    """(doc_id, ref): the record whose squashed name is the longest inside the squashed title, ties by ref.

    A name meets the titles that hold its first three letters (all of a shorter name), and only those are searched.
    """
    title = F.col("squashed_title")
    piece = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length(title) - (k - 1), F.lit(1))), lambda i: F.substring(title, i, F.lit(k)))
    pieces = documents.where(title != "").withColumn("p", F.explode(F.array_distinct(F.flatten(F.array(piece(1), piece(2), piece(3))))))
    names = records.where(F.col("squashed_name") != "").withColumn("p", F.substring("squashed_name", 1, 3))
    met = pieces.join(names, "p").where(F.contains(title, F.col("squashed_name")))
    best = met.groupBy("doc_id").agg(F.min(F.struct((-F.length("squashed_name")).alias("n"), "ref")).alias("b"))
    return best.select("doc_id", "b.ref")


def by_heading(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """(chunk_id, ref): records (ref, key) whose squashed key is a word of a heading of the chunk (chunk_id, text)."""
    headings = F.regexp_extract_all(F.col("text"), F.lit(r"(?m)^\s*#+\s*(.+?)\s*$"), F.lit(1))
    words = F.explode(F.split(F.lower(F.array_join(headings, " ")), r"[\s()\[\],;:]+")).alias("w")
    tokens = chunks.select("chunk_id", words).select("chunk_id", F.regexp_replace("w", "[^a-z0-9]", "").alias("key")).where("key <> ''").distinct()
    keys = records.select("ref", F.regexp_replace(F.lower("key"), "[^a-z0-9]", "").alias("key")).where(r"key rlike '[0-9]'")
    return tokens.join(keys, "key").select("chunk_id", "ref")


def named_in(claims: DataFrame, things: DataFrame) -> DataFrame:
    """(claim, ref): things (doc_id, ref, name_norm) whose name the claim's quote (claim, doc_id, quote_norm) holds as whole words."""
    return claims.join(things, "doc_id").where(contains_words(F.col("quote_norm"), F.col("name_norm"))).select("claim", "ref").distinct()


def dominant(counts: DataFrame) -> DataFrame:
    """(doc_id, ref): the record most sentences name, if two or more do and twice as many as name the next."""
    w = W.partitionBy("doc_id").orderBy(F.desc("n"), "ref")
    top = counts.withColumn("r", F.row_number().over(w)).withColumn("second", F.lead("n", 1, 0).over(w)).where("r = 1")
    return top.where((F.col("n") >= 2) & (F.col("n") >= 2 * F.col("second"))).select("doc_id", "ref")

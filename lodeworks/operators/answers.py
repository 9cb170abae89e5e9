"""What an answer rests on: verdicts, citations, passages left out, arms compared, pools reordered, stored layers.

Model calls stay outside: their replies come as tables, and everything here is a join or an aggregate over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm
from .evaluate import paired


def first_values(rows: DataFrame, value: str, order: str, by: str = "query") -> DataFrame:
    """(by, names): the distinct values of a result's first column as text, in the order they first stand; nulls are skipped, lists opened."""
    is_list = rows.schema[value].dataType.typeName() == "array"
    each = rows.select(by, order, F.posexplode(value).alias("at", "v")) if is_list else rows.select(by, order, F.lit(0).alias("at"), F.col(value).alias("v"))
    once = each.where("v is not null").groupBy(by, F.col("v").cast("string").alias("v")).agg(F.min(F.struct(order, "at")).alias("first"))
    return once.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "v"))), lambda x: x["v"]).alias("names"))


def single_number(rows: DataFrame, value: str, order: str, by: str = "query") -> DataFrame:
    """(by, number): the first row's value; null where it is no finite number."""
    first = rows.groupBy(by).agg(F.min_by(value, order).alias("v"))
    plain = F.col("v").cast("double") if rows.schema[value].dataType.typeName() != "boolean" else F.lit(None).cast("double")
    return first.select(by, F.when(~F.isnan(plain) & (F.abs(plain) != float("inf")), plain).alias("number"))


def cited(citations: DataFrame, returned: DataFrame, claim_chunks: DataFrame) -> DataFrame:
    """(answer, id, known, via): the ids an answer (answer, id) cites, known if a tool returned them (answer, id), and the chunks of known claims (id, chunk_id)."""
    told = citations.select("answer", "id", F.lit(True).alias("own"), F.lit(False).alias("known")).unionByName(returned.select("answer", "id", F.lit(False).alias("own"), (F.col("answer").isNotNull() & F.col("id").isNotNull()).alias("known")))
    own = told.groupBy("answer", "id").agg(F.bool_or("own").alias("own"), F.bool_or("known").alias("known")).where("own").select("answer", "id", "known")
    chunks = own.where("known").join(claim_chunks.select("id", "chunk_id").distinct(), "id").select("answer", F.col("chunk_id").alias("id"), F.lit(True).alias("known"))
    every = own.withColumn("place", F.lit(0)).unionByName(chunks.withColumn("place", F.lit(1)))
    # a number is aggregated by hash, a text by sorting
    met = every.groupBy("answer", "id").agg(F.bool_or("known").alias("known"), F.min("place").alias("place"))
    return met.select("answer", "id", "known", F.when(F.col("place") == 0, "cited").otherwise("claim").alias("via"))


def holds_number(text: Column, number: Column) -> Column:
    """Whether a number stands in a text as a whole token: 10 not inside 2010 or 10.5."""
    spelled = F.regexp_replace(F.when(number == F.floor(number), number.cast("long").cast("string")).otherwise(number.cast("string")), r"([.\-])", r"\\$1")
    return F.regexp_like(F.regexp_replace(text, r"(?<=[0-9]),(?=[0-9]{3})", ""), F.concat(F.lit(r"(?<![0-9.\-])"), spelled, F.lit(r"(?![0-9]|\.[0-9])")))


def citation_checks(kept: DataFrame, contents: DataFrame) -> DataFrame:
    """(answer, id, quote_found, entities_found, number_found) of kept citations (answer, id, quote, entities, number) against each id's own content (id, text).

    Nothing is judged where nothing was said: a null or empty quote and a null number give null.
    """
    met = kept.join(contents.select("id", norm("text").alias("held")), "id", "left").withColumn("held", F.coalesce("held", F.lit("")))
    quote = norm("quote")
    met = met.withColumn("quote_norm", F.when(quote != "", quote)).withColumn("quote_found", F.when(F.col("quote_norm").isNotNull(), F.contains("held", "quote_norm")))
    named = met.select("answer", "id", "held", F.explode("entities").alias("entity"))
    found = named.where(F.contains("held", norm("entity"))).groupBy("answer", "id").agg(F.array_sort(F.collect_set("entity")).alias("entities_found"))
    out = met.join(found, ["answer", "id"], "left")
    number = F.when(F.col("number").isNotNull(), holds_number(F.col("held"), F.col("number")))
    return out.select("answer", "id", "quote_found", F.coalesce("entities_found", F.array().cast("array<string>")).alias("entities_found"), number.alias("number_found"))


def verdict_marks(verdicts: DataFrame, items: DataFrame) -> DataFrame:
    """(id, include, quote_found): an item's first verdict (id, place, include, quote); include is null where there is none, quote_found where nothing is included.

    Verdicts on unknown ids go. A quote must stand in its item (id, text) as it is, but for case, accents and spaces.
    """
    first = verdicts.select(F.trim("id").alias("id"), "place", "include", "quote").groupBy("id").agg(F.min_by(F.struct("include", "quote"), "place").alias("v"))
    met = items.select("id", "text").join(first, "id", "left").select("id", F.col("v.include").alias("include"), norm("text").alias("held"), norm(F.col("v.quote")).alias("q"))
    found = (F.coalesce("q", F.lit("")) != "") & F.contains("held", F.coalesce("q", F.lit("")))
    return met.select("id", "include", F.when(F.col("include"), found).alias("quote_found"))


def left_out(marks: DataFrame, citations: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of ``marks`` (answer, id, thing, include, quote_found) that support an answer which neither cites them (answer, id) nor names their thing (answer, name)."""
    proven = marks.where("include and quote_found")
    uncited = proven.join(citations.select("answer", "id").distinct(), ["answer", "id"], "left_anti").withColumn("name", norm("thing"))
    return uncited.join(names.select("answer", norm("name").alias("name")).distinct(), ["answer", "name"], "left_anti").drop("name")


def compare_arms(a: DataFrame, b: DataFrame, budgets: list[int]) -> DataFrame:
    """(budget, both, only_a, only_b, neither, p) of two arms (question, needed): the rank at which each question's evidence is whole, null if never."""
    met = a.select("question", F.col("needed").alias("x")).join(b.select("question", F.col("needed").alias("y")), "question", "full")
    each = met.withColumn("budget", F.explode(F.array(*map(F.lit, budgets))))
    within = lambda c: F.coalesce(F.col(c) <= F.col("budget"), F.lit(False))
    told = paired(each.select("budget", within("x").alias("a"), within("y").alias("b")), "budget")
    return told.where("budget is not null")


def reranked(pool: DataFrame, replies: DataFrame) -> DataFrame:
    """(query, id, rank) of a pool (query, id, rank) in a reranker's order (query, id, place): unknown and repeated ids go, ids it left out follow in their old order."""
    told = replies.groupBy("query", "id").agg(F.min("place").alias("place"))
    met = pool.join(told, ["query", "id"], "left")
    order = F.array_sort(F.collect_list(F.struct(F.col("place").isNull().alias("late"), "place", "rank", "id")))
    return met.groupBy("query").agg(order.alias("o")).select("query", F.posexplode("o").alias("at", "x")).select("query", "x.id", (F.col("at") + 1).alias("rank"))


def layer_faults(units: DataFrame, wanted: DataFrame) -> DataFrame:
    """(kind, fault): unit kinds of ``wanted`` (kind, version, model) that ``units`` lack or hold in another version or from another model."""
    state = units.groupBy("kind").agg(F.array_sort(F.collect_set("version")).alias("versions"), F.array_sort(F.collect_set("model")).alias("models"))
    met = wanted.join(state, "kind", "left")
    fault = F.when(F.col("versions").isNull(), "missing").when(F.col("versions") != F.array("version"), "version").when(F.col("models") != F.array("model"), "model")
    return met.select("kind", fault.alias("fault")).where("fault is not null")


def graph_rows(triples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mentions, bridges, claims) of triples (chunk_id, subject, subject_type, predicate, object, object_type): distinct ends, (mention, chunk) pairs, and the claims between them."""
    key = lambda kind, name: F.concat_ws("|", kind, norm(name))
    ends = [triples.select("chunk_id", F.col(f"{e}_type").alias("type"), F.col(e).alias("name"), key(F.col(f"{e}_type"), e).alias("mention")) for e in ("subject", "object")]
    every = ends[0].unionByName(ends[1])
    mentions = every.groupBy("mention").agg(F.min("type").alias("type"), F.min("name").alias("name"))
    claims = triples.select("chunk_id", key(F.col("subject_type"), "subject").alias("subject"), "predicate", key(F.col("object_type"), "object").alias("object")).distinct()
    return mentions, every.select("mention", "chunk_id").distinct(), claims


def new_pairs(found: DataFrame, stored: DataFrame) -> DataFrame:
    """(mention, chunk_id) pairs that are found and not yet stored."""
    return found.select("mention", "chunk_id").distinct().join(stored.select("mention", "chunk_id").distinct(), ["mention", "chunk_id"], "left_anti")

"""Evaluation queries over labels, events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import Z95
from ..operators import cards, checks
from ..operators import evaluate as ev
from ..registry import query, table
from ..sources import writers

LOW = f"(k / n + {Z95} * {Z95} / (2 * n)) / (1 + {Z95} * {Z95} / n) - {Z95} * sqrt(k / n * (1 - k / n) / n + {Z95} * {Z95} / (4 * n * n)) / (1 + {Z95} * {Z95} / n)"
HIGH = LOW.replace(f") - {Z95} * sqrt", f") + {Z95} * sqrt")


@query("eval_wilson", f"WITH c AS (SELECT toxic, CAST(count(*) FILTER (quality = 1) AS DOUBLE) AS k, CAST(count(quality = 1) AS DOUBLE) AS n FROM labels GROUP BY ROLLUP (toxic)) SELECT toxic, CAST(k AS BIGINT) AS k, CAST(n AS BIGINT) AS n, round(k / n, 6) AS share, round(greatest({LOW}, 0), 6) AS low, round(least({HIGH}, 1), 6) AS high FROM c")
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = ev.proportion(table(spark, sf_dir, "labels"), F.col("quality") == 1, "toxic")
    return told.withColumns({c: F.round(c, 6) for c in ("share", "low", "high")})


OUTCOMES = "o AS (SELECT event_type, event_id % 3 = 0 AS a, event_id % 4 = 0 AS b FROM events)"


@query("eval_mcnemar", f"WITH {OUTCOMES} SELECT event_type, count(*) FILTER (a AND b) AS \"both\", count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither FROM o GROUP BY ROLLUP (event_type)")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 3 == 0).alias("a"), (F.col("event_id") % 4 == 0).alias("b"))
    return ev.paired(rows, "event_type").drop("p")


LOG_HALF = "-0.6931471805599453"


@query(
    "eval_mcnemar_p",
    f"WITH {OUTCOMES}, c AS (SELECT event_type, count(*) FILTER (a AND NOT b) AS x, count(*) FILTER (NOT a AND b) AS y FROM o GROUP BY ROLLUP (event_type)), t AS (SELECT event_type, x + y AS n, unnest(range(least(x, y) + 1)) AS i FROM c) SELECT event_type, round(least(1.0, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * {LOG_HALF}))), 9) AS p FROM t GROUP BY event_type",
)
def mcnemar_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 3 == 0).alias("a"), (F.col("event_id") % 4 == 0).alias("b"))
    return ev.paired(rows, "event_type").select("event_type", F.round("p", 9).alias("p"))


@query("eval_percentile", "SELECT event_type, list_sort(list(value))[greatest(CAST(ceil(0.5 * count(*)) AS BIGINT), 1)] AS p50, list_sort(list(value))[greatest(CAST(ceil(0.95 * count(*)) AS BIGINT), 1)] AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.percentile(table(spark, sf_dir, "events").where("value is not null"), "value", [0.5, 0.95], ["event_type"])


@query("eval_confusion", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


@query("eval_precision_recall", "WITH f AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 150000), g AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), c AS (SELECT (SELECT count(*) FROM f) AS found, (SELECT count(*) FROM g) AS gold, (SELECT count(*) FROM f WHERE k IN (SELECT k FROM g)) AS hits) SELECT *, round(hits / found, 6) AS \"precision\", round(hits / gold, 6) AS recall FROM c")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    told = ev.precision_recall(o.where("o_totalprice > 150000"), o.where("o_orderstatus = 'F'"), ["o_custkey"])
    return told.withColumns({c: F.round(c, 6) for c in ("precision", "recall")})


@query("eval_pair_scores", "WITH p AS (SELECT a.c_custkey AS a, b.c_custkey AS b, a.c_mktsegment = b.c_mktsegment AS same, a.c_nationkey = b.c_nationkey AS one FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1) SELECT count(*) FILTER (same AND one) AS joined, count(*) FILTER (same AND NOT one) AS missed, count(*) FILTER (NOT same AND one) AS wrong, count(*) FILTER (NOT same AND NOT one) AS apart FROM p")
def pair_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    a = c.select(F.col("c_custkey").alias("a"), F.col("c_mktsegment").alias("sa"))
    b = c.select((F.col("c_custkey") - 1).alias("a"), F.col("c_custkey").alias("b"), F.col("c_mktsegment").alias("sb"))
    pairs = a.join(b, "a").select("a", "b", (F.col("sa") == F.col("sb")).alias("same"))
    return ev.pair_scores(pairs, c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("canonical")))


@query("eval_sets_match", "SELECT count(*) AS n FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING list_sort(list(DISTINCT o_orderstatus)) = ['F', 'O', 'P'])")
def sets_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("s"))
    return given.where(ev.sets_match(F.array(F.lit("O"), F.lit("P"), F.lit("F")), F.col("s"))).agg(F.count("*").alias("n"))


@query("eval_counts_by_reason", "SELECT r AS event_type, (SELECT count(*) FROM events WHERE event_type = r) AS n FROM (SELECT unnest(['click', 'view', 'never']) AS r)")
def counts_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.counts_by_reason(table(spark, sf_dir, "events"), "event_type", spark.createDataFrame([("click",), ("view",), ("never",)], "event_type string"))


@query("eval_selectivity", "WITH s AS (SELECT l_suppkey, count(DISTINCT l_partkey) / 2000.0 AS share FROM lineitem GROUP BY 1) SELECT round(median(share), 6) AS median, round(list_sort(list(share))[CAST(ceil(0.9 * count(*)) AS BIGINT)], 6) AS p90, count(*) FILTER (share >= 0.25) AS hubs FROM s")
def selectivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    reach = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("start"), F.col("l_partkey").alias("chunk_id"))
    told = ev.selectivity(reach, 2000, 0.25)
    return told.select(F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90"), "hubs")


@query("units_incremental", "SELECT 'write' AS part, count(*) FILTER (doc_id % 5 = 0 OR doc_id % 7 = 0) AS n FROM documents UNION ALL SELECT 'kept', count(*) FILTER (doc_id % 5 <> 0 AND doc_id % 7 <> 0) FROM documents UNION ALL SELECT 'stale', CAST(1 AS BIGINT)")
def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units whose text changed (every fifth) or that are new (every seventh) are written; one stored unit is stale."""
    docs = table(spark, sf_dir, "documents")
    now = docs.select(F.col("doc_id").alias("unit_id"), "text", F.lit("v1").alias("version"), F.lit("m").alias("model"))
    old = now.where("unit_id % 7 <> 0").withColumn("text", F.when(F.col("unit_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    stored = old.select("unit_id", F.sha2(F.col("text").cast("binary"), 256).alias("text_hash"), "version", "model")
    stored = stored.unionByName(spark.createDataFrame([(-1, "x", "v1", "m")], stored.schema))
    parts = zip(("write", "kept", "stale"), writers.units_to_write(now, stored), strict=True)
    a, b, c = (df.agg(F.lit(name).alias("part"), F.count("*").alias("n")) for name, df in parts)
    return a.unionByName(b).unionByName(c)


@query("upsert_by_key", "SELECT o_orderkey, o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS o_totalprice FROM orders")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    fresh = rows.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1)
    return writers.upsert(writers.upsert(rows, fresh, ["o_orderkey"]), fresh, ["o_orderkey"])


@query("check_domain", "SELECT 'Customer' AS label, count(*) + 1 AS expected, count(*) AS found FROM customer")
def check_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers against a report that claims one more, nations against a right one."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    nodes = c.select(F.lit("Customer").alias("label")).unionByName(n.select(F.lit("Nation").alias("label")))
    report = c.agg(F.lit("Customer").alias("rule"), (F.count("*") + 1).alias("written")).unionByName(n.agg(F.lit("Nation").alias("rule"), F.count("*").alias("written")))
    return checks.domain(nodes, report)


@query(
    "check_lexical",
    "SELECT 'chunk_without_document' AS rule, count(*) FILTER (conv_id % 10 = 0) AS n FROM conversations UNION ALL SELECT 'document_without_chunks', CAST(1 AS BIGINT) UNION ALL SELECT 'gap', count(*) FROM (SELECT conv_id FROM conversations GROUP BY conv_id HAVING max(turn) >= 2)",
)
def check_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents and turns as chunks, with turn 1 missing, every tenth document missing and one empty."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"))
    docs = turns.select("doc_id").where("doc_id % 10 <> 0").distinct().unionByName(spark.createDataFrame([(-5,)], "doc_id long"))
    gaps = checks.lexical(docs, turns.where("idx <> 1")).where("rule = 'gap'")
    return checks.lexical(docs, turns).where("rule <> 'gap'").unionByName(gaps)


@query("check_fidelity", "SELECT 'labels' AS what, count(*) AS counted, count(*) + 2 AS logged FROM labels")
def check_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda t, more=0: table(spark, sf_dir, t).agg(F.lit(t).alias("what"), (F.count("*") + more).alias("n"))
    return checks.fidelity(n("labels").unionByName(n("pages")), n("labels", 2).unionByName(n("pages")))


@query("check_unfaithful", "SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS canonical, 'built' AS side FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT s_suppkey, CAST(-1 AS BIGINT), 'replayed' FROM supplier WHERE s_suppkey % 5 = 0")
def check_unfaithful(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").cast("long").alias("canonical"))
    return checks.unfaithful(built, built.withColumn("canonical", F.when(F.col("id") % 5 == 0, F.lit(-1)).otherwise(F.col("canonical"))))


@query("card_text", "SELECT 's' || s_suppkey AS ref, s_name || ' (Supplier)' || chr(10) || 'balance ' || CAST(CAST(floor(s_acctbal) AS BIGINT) AS VARCHAR) || chr(10) || 'nation ' || s_nationkey AS text FROM supplier")
def card_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A card a supplier; a line too long for the cap is left out."""
    s = table(spark, sf_dir, "supplier").withColumn("ref", F.concat(F.lit("s"), F.col("s_suppkey").cast("string")))
    lines = F.array(
        F.struct(F.lit(1).alias("ord"), F.concat(F.lit("balance "), F.floor("s_acctbal").cast("string")).alias("line")),
        F.struct(F.lit(2).alias("ord"), F.repeat(F.lit("long "), 300).alias("line")),
        F.struct(F.lit(3).alias("ord"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("line")),
    )
    facts = s.select("ref", F.explode(lines).alias("x")).select("ref", "x.ord", "x.line")
    return cards.cards(s.select("ref", F.lit("Supplier").alias("label"), F.col("s_name").alias("name")), facts, 400)


@query("claim_sentences", "SELECT l_orderkey, l_linenumber, 's' || l_suppkey || ' (Supplier) sold part ' || 'p' || l_partkey || ' (Part)' AS text FROM lineitem")
def claim_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    s, p = F.concat(F.lit("s"), F.col("l_suppkey").cast("string")), F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    return li.select("l_orderkey", "l_linenumber", cards.claim_text(s, F.lit("Supplier"), F.lit("SOLD_PART"), p, F.lit("Part")).alias("text"))


@query("summary_grounding", "SELECT s_suppkey, [CAST(s_suppkey * 7 AS VARCHAR)] AS missing FROM supplier WHERE s_suppkey > 1")
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary's number that its sources don't hold."""
    s = table(spark, sf_dir, "supplier").where("s_suppkey > 1")
    id = F.col("s_suppkey").cast("string")
    summary = F.concat(F.lit("The works "), id, F.lit(" makes "), (F.col("s_suppkey") * 7).cast("string"), F.lit(" pumps"))
    return s.select("s_suppkey", cards.ungrounded_words(summary, F.array(F.concat(F.lit("works "), id))).alias("missing"))

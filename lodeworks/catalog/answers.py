"""Queries over verdicts, citations, pools and stored layers made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers
from ..registry import query, table


@query("ans_first_values", "WITH f AS (SELECT p_brand AS query, p_type AS v, min(p_partkey) AS k FROM part GROUP BY ALL) SELECT query, list(v ORDER BY k) AS names FROM f GROUP BY query")
def first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.first_values(table(spark, sf_dir, "part").withColumnRenamed("p_brand", "query"), "p_type", "p_partkey")


@query("ans_single_number", "SELECT o_custkey AS query, arg_min(o_totalprice, o_orderkey) AS number FROM orders GROUP BY o_custkey")
def single_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.single_number(table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "query"), "o_totalprice", "o_orderkey")


@query(
    "ans_cited",
    "WITH c AS (SELECT DISTINCT l_orderkey AS answer, l_partkey AS id FROM lineitem), r AS (SELECT DISTINCT l_orderkey AS answer, l_partkey AS id FROM lineitem WHERE l_returnflag <> 'R'), o AS (SELECT c.answer, c.id, r.id IS NOT NULL AS known, 'cited' AS via FROM c LEFT JOIN r USING (answer, id)), x AS (SELECT * FROM o UNION ALL SELECT answer, 1000000 + p_size, true, 'claim' FROM o JOIN part ON p_partkey = id WHERE known) SELECT answer, id, bool_or(known) AS known, min(via) AS via FROM x GROUP BY ALL",
)
def cited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders cite parts; returned lines are unknown; a part's size stands for its chunk."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("answer"), F.col("l_partkey").alias("id"), "l_returnflag")
    chunks = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") + 1000000).cast("long").alias("chunk_id"))
    return answers.cited(lines, lines.where("l_returnflag <> 'R'"), chunks)


@query(
    "ans_citation_checks",
    r"SELECT p_partkey AS answer, p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE contains(lower(p_name || ' size ' || p_size || '.'), lower(CASE WHEN p_size % 3 = 1 THEN p_name ELSE 'no ' || p_name END)) END AS quote_found, list_sort(list_filter([p_name, 'Nobody'], lambda e: contains(lower(p_name || ' size ' || p_size || '.'), lower(e)))) AS entities_found, CASE WHEN p_size % 2 = 0 THEN regexp_matches(p_name || ' size ' || p_size || '.', '(^|[^0-9.\-])' || (p_size // 2 * 2) || '([^0-9.]|[.]?$|[.][^0-9])') END AS number_found FROM part",
)
def citation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, size = table(spark, sf_dir, "part"), F.col("p_size")
    quote = F.when(size % 3 == 1, F.col("p_name")).when(size % 3 == 2, F.concat(F.lit("no "), "p_name"))
    kept = p.select(F.col("p_partkey").alias("answer"), F.col("p_partkey").alias("id"), quote.alias("quote"), F.array("p_name", F.lit("Nobody")).alias("entities"), F.when(size % 2 == 0, size.cast("double")).alias("number"))
    return answers.citation_checks(kept, p.select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit(" size "), size.cast("string"), F.lit(".")).alias("text")))


VERDICTS = "SELECT CAST(p_partkey AS VARCHAR) AS id, p_size % 4 <> 0 AS include, CASE WHEN p_size % 5 = 0 THEN 'else' ELSE upper(p_name) END AS quote FROM part WHERE p_size % 7 <> 0"


@query("ans_verdict_marks", f"WITH v AS ({VERDICTS}) SELECT CAST(p_partkey AS VARCHAR) AS id, include, CASE WHEN include THEN contains(lower(p_name), lower(quote)) END AS quote_found FROM part LEFT JOIN v ON v.id = CAST(p_partkey AS VARCHAR)")
def verdict_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part judged by its size, some not; the first of two verdicts counts."""
    p = table(spark, sf_dir, "part")
    id, quote = F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 5 == 0, "else").otherwise(F.upper("p_name"))
    told = p.where("p_size % 7 <> 0").select(F.concat(F.lit(" "), id).alias("id"), F.lit(0).alias("place"), (F.col("p_size") % 4 != 0).alias("include"), quote.alias("quote"))
    again = told.withColumn("place", F.lit(1)).withColumn("include", ~F.col("include"))
    return answers.verdict_marks(told.unionByName(again), p.select(id.alias("id"), F.col("p_name").alias("text")))


@query(
    "ans_left_out",
    "WITH m AS (SELECT DISTINCT l_orderkey AS answer, l_partkey AS id, p_brand AS thing FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_linestatus = 'F' AND l_returnflag <> 'A'), c AS (SELECT DISTINCT l_orderkey AS answer, l_partkey AS id FROM lineitem WHERE l_quantity < 10), n AS (SELECT DISTINCT l_orderkey AS answer, p_brand AS thing FROM lineitem JOIN part ON p_partkey = l_partkey WHERE l_quantity > 45) SELECT answer, id, thing FROM m ANTI JOIN c USING (answer, id) ANTI JOIN n USING (answer, thing)",
)
def left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("thing")), "l_partkey")
    lines = lines.select(F.col("l_orderkey").alias("answer"), F.col("l_partkey").alias("id"), "thing", (F.col("l_linestatus") == "F").alias("include"), (F.col("l_returnflag") != "A").alias("quote_found"), "l_quantity")
    named = lines.where("l_quantity > 45").select("answer", F.upper("thing").alias("name"))
    return answers.left_out(lines, lines.where("l_quantity < 10"), named).select("answer", "id", "thing").distinct()


@query(
    "ans_compare_arms",
    "WITH q AS (SELECT event_id AS question, CASE WHEN event_id % 5 <> 0 THEN event_id % 23 + 1 END AS x, CASE WHEN event_id % 7 <> 0 THEN event_id % 19 + 1 END AS y, b AS budget FROM events, (SELECT unnest([5, 10, 20]) AS b)), p AS (SELECT budget, coalesce(x <= budget, false) AS a, coalesce(y <= budget, false) AS b FROM q) SELECT budget, count(*) FILTER (a AND b) AS \"both\", count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither FROM p GROUP BY budget",
)
def compare_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, id = table(spark, sf_dir, "events"), F.col("event_id")
    a = e.select(id.alias("question"), F.when(id % 5 != 0, id % 23 + 1).alias("needed"))
    b = e.select(id.alias("question"), F.when(id % 7 != 0, id % 19 + 1).alias("needed"))
    return answers.compare_arms(a, b, [5, 10, 20]).drop("p")


@query(
    "ans_reranked",
    "WITH p AS (SELECT c_nationkey AS query, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rank FROM customer), r AS (SELECT c_nationkey AS query, c_custkey AS id, min(c_acctbal) AS place FROM customer WHERE c_mktsegment = 'BUILDING' GROUP BY ALL) SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY place IS NULL, place, rank, id) AS INTEGER) AS rank FROM p LEFT JOIN r USING (query, id)",
)
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("query"), F.col("c_custkey").alias("id"), "c_mktsegment", F.col("c_acctbal").alias("place"))
    replies = c.where("c_mktsegment = 'BUILDING'").select("query", "id", "place")
    unknown = replies.withColumn("id", -F.col("id"))
    return answers.reranked(c.select("query", "id", F.col("id").alias("rank")), replies.unionByName(unknown))


@query("ans_layer_faults", "SELECT o_orderpriority AS kind, CASE WHEN count(DISTINCT o_orderstatus) <> 1 OR min(o_orderstatus) <> 'O' THEN 'version' END AS fault FROM orders GROUP BY 1 UNION ALL SELECT 'none', 'missing'")
def layer_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("version"), F.lit("m").alias("model"))
    wanted = units.select("kind").distinct().unionByName(spark.createDataFrame([("none",)], "kind string"))
    return answers.layer_faults(units, wanted.withColumns({"version": F.lit("O"), "model": F.lit("m")}))


TRIPLES = "SELECT l_orderkey AS chunk_id, 'Part ' || l_partkey AS subject, 'Sold by ' || l_suppkey AS object, l_returnflag AS predicate FROM lineitem"


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    spelled = lambda word, c: F.concat(F.lit(word), F.col(c).cast("string"))
    return lines.select(F.col("l_orderkey").alias("chunk_id"), spelled("Part ", "l_partkey").alias("subject"), F.lit("part").alias("subject_type"), F.col("l_returnflag").alias("predicate"), spelled("Sold by ", "l_suppkey").alias("object"), F.lit("seller").alias("object_type"))


@query("ans_graph_mentions", f"WITH t AS ({TRIPLES}) SELECT 'part|' || lower(subject) AS mention, 'part' AS type, subject AS name FROM t UNION SELECT 'seller|' || lower(object), 'seller', object FROM t")
def graph_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.graph_rows(triples(spark, sf_dir))[0]


@query("ans_graph_claims", f"WITH t AS ({TRIPLES}) SELECT DISTINCT chunk_id, 'part|' || lower(subject) AS subject, predicate, 'seller|' || lower(object) AS object FROM t")
def graph_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.graph_rows(triples(spark, sf_dir))[2]


@query("ans_new_pairs", f"WITH t AS ({TRIPLES}), b AS (SELECT 'part|' || lower(subject) AS mention, chunk_id FROM t UNION SELECT 'seller|' || lower(object), chunk_id FROM t) SELECT mention, chunk_id FROM b WHERE mention LIKE 'part|%' AND chunk_id % 3 = 0 OR mention LIKE 'seller|%'")
def new_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bridges of all triples, those of parts in two thirds of the orders stored already."""
    bridges = answers.graph_rows(triples(spark, sf_dir))[1]
    return answers.new_pairs(bridges, bridges.where("mention like 'part|%' and chunk_id % 3 <> 0"))

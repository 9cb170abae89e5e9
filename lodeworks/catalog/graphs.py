"""Construction, graph and step-plan queries over a graph built from the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..plans import construction as con
from ..plans.steps import Run, Step, Store, related_groups, value_groups
from ..plans.typed import Path, Where, along
from ..registry import query, table

PLAN = con.Plan(
    nodes=(
        con.NodeRule("region", "Region", ("r_regionkey",), ("r_name",)),
        con.NodeRule("nation", "Nation", ("n_nationkey",), ("n_name",)),
        con.NodeRule("customer", "Customer", ("c_custkey",), ("c_name", "c_acctbal", "c_mktsegment")),
        con.NodeRule("supplier", "Supplier", ("s_suppkey",), ("s_name", "s_acctbal")),
        con.NodeRule("orders", "Order", ("o_orderkey",), ("o_totalprice", "o_orderdate", "o_orderpriority")),
    ),
    edges=(
        con.EdgeRule("nation", "IN_REGION", "Nation", ("n_nationkey",), "Region", ("n_regionkey",)),
        con.EdgeRule("customer", "LIVES_IN", "Customer", ("c_custkey",), "Nation", ("c_nationkey",)),
        con.EdgeRule("supplier", "BASED_IN", "Supplier", ("s_suppkey",), "Nation", ("s_nationkey",)),
        con.EdgeRule("orders", "PLACED", "Customer", ("o_custkey",), "Order", ("o_orderkey",)),
    ),
)


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {t: table(spark, sf_dir, t) for t in names or ("region", "nation", "customer", "supplier", "orders")}


def built(spark: SparkSession, sf_dir: str) -> con.Graph:
    return con.build(PLAN, tables(spark, sf_dir))


def store(g: con.Graph) -> Store:
    return Store(g.records, g.nodes, g.edges)


NODES = (
    "SELECT 'Region:' || r_regionkey AS ref, 'Region' AS label, CAST(r_regionkey AS VARCHAR) AS key, r_name AS name FROM region UNION ALL "
    "SELECT 'Nation:' || n_nationkey, 'Nation', CAST(n_nationkey AS VARCHAR), n_name FROM nation UNION ALL "
    "SELECT 'Customer:' || c_custkey, 'Customer', CAST(c_custkey AS VARCHAR), c_name FROM customer UNION ALL "
    "SELECT 'Supplier:' || s_suppkey, 'Supplier', CAST(s_suppkey AS VARCHAR), s_name FROM supplier UNION ALL "
    "SELECT 'Order:' || o_orderkey, 'Order', CAST(o_orderkey AS VARCHAR), CAST(o_orderkey AS VARCHAR) FROM orders"
)
EDGES = (
    "SELECT 'IN_REGION' AS type, 'Nation:' || n_nationkey AS src, 'Region:' || n_regionkey AS dst FROM nation UNION ALL "
    "SELECT 'LIVES_IN', 'Customer:' || c_custkey, 'Nation:' || c_nationkey FROM customer UNION ALL "
    "SELECT 'BASED_IN', 'Supplier:' || s_suppkey, 'Nation:' || s_nationkey FROM supplier UNION ALL "
    "SELECT 'PLACED', 'Customer:' || o_custkey, 'Order:' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey"
)


@query("plan_nodes", NODES)
def plan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).nodes


@query("plan_edges", EDGES)
def plan_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).edges


@query(
    "plan_dangling",
    "SELECT 'PLACED' AS rule, count(*) AS rows_read, count(*) FILTER (o_custkey IS NULL OR o_orderkey IS NULL) AS null_key, count(DISTINCT CASE WHEN c_acctbal > 0 THEN o_orderkey END) AS written, count(*) FILTER (c_custkey IS NULL OR c_acctbal <= 0) AS unmatched FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def plan_dangling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconciliation of all orders against the customers in credit; those of the others dangle."""
    t = tables(spark, sf_dir)
    t["customer"] = t["customer"].where("c_acctbal > 0")
    return con.build(PLAN, t).report.where("rule = 'PLACED'")


@query("plan_composite_key", "SELECT l_orderkey || '|' || l_linenumber AS key, count(*) AS n FROM lineitem GROUP BY 1")
def plan_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(con.key_of(("l_orderkey", "l_linenumber")).alias("key")).agg(F.count("*").alias("n"))


@query("plan_report", "SELECT 'Customer' AS rule, count(*) AS rows_read, CAST(0 AS BIGINT) AS null_key, count(DISTINCT c_custkey) AS written, CAST(0 AS BIGINT) AS unmatched FROM customer UNION ALL SELECT 'LIVES_IN', count(*), 0, count(DISTINCT c_custkey), 0 FROM customer")
def plan_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return built(spark, sf_dir).report.where("rule in ('Customer', 'LIVES_IN')")


@query(
    "plan_record_documents",
    "SELECT 'record/Nation/' || n_nationkey AS doc_id, n_name AS title, '# ' || n_name || chr(10) || chr(10) || '## n_name' || chr(10) || chr(10) || n_name AS text, 'Nation:' || n_nationkey AS record_ref FROM nation",
)
def plan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return con.record_documents(built(spark, sf_dir).records["Nation"], "Nation", ("n_name",))


@query("graph_patterns", f"SELECT s.label AS from_label, e.type, t.label AS to_label, count(*) AS n FROM ({EDGES}) e JOIN ({NODES}) s ON s.ref = e.src JOIN ({NODES}) t ON t.ref = e.dst GROUP BY ALL")
def patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = built(spark, sf_dir)
    return graph.schema_patterns(g.edges, g.nodes)


@query("graph_related", "SELECT 'Customer:' || c_custkey AS ref FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def graph_related(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = built(spark, sf_dir)
    nations = graph.related(spark.createDataFrame([("Region:1",)], "ref string"), g.edges, g.nodes, "in", "IN_REGION")
    return graph.related(nations, g.edges, g.nodes, label="Customer")


@query("graph_path", "SELECT 'Supplier:' || s_suppkey AS ref FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey = 2")
def graph_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = built(spark, sf_dir)
    return along(g.nodes, g.edges, spark.createDataFrame([("Region:2",)], "ref string"), Path(("IN_REGION", "BASED_IN"))).select("ref")


@query("graph_parts_of", "SELECT 'Nation:' || c_nationkey AS ref FROM customer UNION SELECT 'Region:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def graph_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = built(spark, sf_dir)
    items = g.records["Customer"]
    return graph.parts_of(items, g.edges, g.nodes, ["Nation", "Region"])


HOPS = f"""
WITH RECURSIVE e AS (SELECT src AS a, dst AS b FROM ({EDGES}) WHERE type <> 'PLACED' UNION ALL SELECT dst, src FROM ({EDGES}) WHERE type <> 'PLACED'),
w AS (SELECT 'Nation:3' AS ref, 0 AS hops UNION SELECT e.b, w.hops + 1 FROM w JOIN e ON e.a = w.ref WHERE w.hops < 3)
SELECT 'Nation:3' AS start, ref, CAST(min(hops) AS INTEGER) AS hops FROM w GROUP BY ref
"""


@query("graph_min_hops", HOPS)
def min_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = built(spark, sf_dir)
    return graph.hops(spark.createDataFrame([("Nation:3",)], "ref string"), g.edges.where("type <> 'PLACED'"), 3)


@query("graph_components", "SELECT 'Customer:' || c_custkey AS node, (SELECT min('Customer:' || c2.c_custkey) FROM customer c2 WHERE c2.c_nationkey = c.c_nationkey) AS comp FROM customer c UNION ALL SELECT 'Nation:' || n_nationkey, (SELECT min('Customer:' || c_custkey) FROM customer WHERE c_nationkey = n_nationkey) FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer)")
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.components(built(spark, sf_dir).edges.where("type = 'LIVES_IN'"))


@query("graph_neighbours", "SELECT 'Nation:' || n_nationkey AS ref, 'LIVES_IN' AS type, 'in' AS direction, 'Customer' AS label, (list_sort(list(DISTINCT c_name)))[1:5] AS names, count(DISTINCT c_custkey) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = built(spark, sf_dir)
    return graph.neighbours(g.nodes, g.edges.where("type = 'LIVES_IN'"), 5).where("ref like 'Nation:%'")


@query("graph_overview", f"SELECT ref, label, name, coalesce(d, 0) AS degree FROM ({NODES}) LEFT JOIN (SELECT x, count(*) AS d FROM (SELECT src AS x FROM ({EDGES}) UNION ALL SELECT dst FROM ({EDGES})) GROUP BY x) ON x = ref ORDER BY 4 DESC, 1 LIMIT 20")
def graph_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = built(spark, sf_dir)
    return graph.overview(g.nodes, g.edges)


@query("graph_digest")
def graph_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = built(spark, sf_dir)
    return graph.graph_digest(g.nodes, g.edges)


def steps(name: str, sql: str, *plan: Step) -> None:
    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Run(store(built(spark, sf_dir)), plan).result

    query(name, sql)(go)


steps(
    "step_filter_related_count",
    "SELECT count(DISTINCT o_orderkey) AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000",
    Step("filter_records", label="Customer", where=(Where("c_mktsegment", "=", "building"), Where("c_acctbal", ">", 5000))),
    Step("related", input=0, relationship="PLACED", label="Order"),
    Step("count", input=1),
)
steps(
    "step_find_list",
    "SELECT 'Customer:' || c_custkey AS id, c_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey = 4 ORDER BY 2, 1 LIMIT 200",
    Step("filter_records", label="Nation", where=(Where("n_nationkey", "=", 4),)),
    Step("related", input=0, relationship="LIVES_IN", label="Customer"),
    Step("list", input=1),
)
steps(
    "step_sum",
    "SELECT round(sum(c_acctbal), 2) AS value, CAST(0 AS BIGINT) AS skipped FROM customer WHERE c_acctbal > 0",
    Step("filter_records", label="Customer", where=(Where("c_acctbal", ">", 0),)),
    Step("sum", input=0, label="Customer", property="c_acctbal"),
)
steps(
    "step_rank_ties",
    "WITH n AS (SELECT c_custkey, c_name, CAST(count(*) AS DOUBLE) AS score FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL) SELECT 'Customer:' || c_custkey AS ref, c_name AS name, score FROM n WHERE score = (SELECT max(score) FROM n)",
    Step("filter_records", label="Customer"),
    Step("rank", input=0, relationship="PLACED"),
)
steps(
    "step_rank_least",
    "SELECT 'Supplier:' || s_suppkey AS ref, s_name AS name, s_acctbal AS score FROM supplier WHERE s_acctbal = (SELECT min(s_acctbal) FROM supplier)",
    Step("filter_records", label="Supplier"),
    Step("rank", input=0, label="Supplier", property="s_acctbal", descending=False),
)
steps(
    "step_parts_count",
    "SELECT count(DISTINCT x) AS value FROM (SELECT 'n' || c_nationkey AS x FROM customer WHERE c_acctbal > 9000 UNION SELECT 'r' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 9000 UNION SELECT 'o' || o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000)",
    Step("filter_records", label="Customer", where=(Where("c_acctbal", ">", 9000),)),
    Step("parts", input=0),
    Step("count", input=1),
)


@query("step_value_groups", "SELECT CAST(year(o_orderdate) AS INTEGER) AS v, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1")
def step_value_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return value_groups(built(spark, sf_dir).records["Order"], "o_orderdate", by_year=True)


@query("step_related_groups", "SELECT 'Nation:' || c_nationkey AS \"to\", count(DISTINCT c_custkey) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1")
def step_related_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = built(spark, sf_dir)
    return related_groups(g.records["Customer"].where("c_acctbal < 0"), g.edges, "LIVES_IN")


@query(
    "sample_fixpoint",
    "SELECT 'customer' AS name, count(*) AS n FROM customer WHERE c_custkey <= 10 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey <= 10 "
    "UNION ALL SELECT 'lineitem', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey <= 10 "
    "UNION ALL SELECT 'part', count(DISTINCT l_partkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_custkey <= 10",
)
def sample_fixpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables(spark, sf_dir, "customer", "orders", "lineitem", "part")
    keys = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey")]
    kept = graph.sample_rows(t, keys, "customer", t["customer"].where("c_custkey <= 10"))
    out = [df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in kept.items()]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])

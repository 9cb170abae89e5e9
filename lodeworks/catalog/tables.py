"""Typed queries, checked SQL, profiles, JSON and streaming plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import number_in, quantity, shape, truncated, year_in
from ..operators import profile as prof
from ..plans.sql import query_sql, tables_read
from ..plans.typed import Query, Where, run
from ..registry import query, table
from ..sources.readers import json_column
from ..streaming.reingest import latest, windowed_counts


def typed(name: str, source: str, q: Query, sql: str, total: bool = False, **rounded: int) -> None:
    """Registers a typed query; doubles are rounded as its SQL rounds them."""

    def go(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = run(table(spark, sf_dir, source), q, total)
        return out.withColumns({c: F.round(c, n) for c, n in rounded.items()}) if rounded else out

    query(name, sql)(go)


typed(
    "tq_group_priority_1996",
    "orders",
    Query(where=(Where("o_orderdate", "year", 1996),), measure="count", group_by="o_orderpriority"),
    "SELECT o_orderpriority AS bucket, count(*) AS value FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50",
)
typed(
    "tq_decade",
    "orders",
    Query(measure="count", group_by="o_orderdate", period="decade"),
    "SELECT CAST((year(o_orderdate) // 10) * 10 AS VARCHAR) || 's' AS bucket, count(*) AS value FROM orders GROUP BY 1",
)
typed(
    "tq_year_sum",
    "orders",
    Query(measure="sum", field="o_totalprice", group_by="o_orderdate", period="year"),
    "SELECT CAST(year(o_orderdate) AS INTEGER) AS bucket, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1",
    value=2,
)
typed(
    "tq_contains",
    "documents",
    Query(where=(Where("text", "contains", "LICENSE"),), measure="count", group_by="lang"),
    "SELECT lang AS bucket, count(*) AS value FROM documents WHERE contains(lower(text), 'license') GROUP BY 1",
)
typed(
    "tq_word",
    "documents",
    Query(where=(Where("text", "word", "the of"),), measure="count", group_by="source", limit=1000),
    r"SELECT source AS bucket, count(*) AS value FROM documents WHERE regexp_matches(lower(text), '(^|[^\p{L}\p{N}])the of($|[^\p{L}\p{N}])') GROUP BY 1",
)
typed(
    "tq_text_number",
    "customer",
    Query(measure="max", field="c_name", group_by="c_mktsegment"),
    r"SELECT c_mktsegment AS bucket, max(TRY_CAST(regexp_replace(replace(c_name, ',', ''), '[^0-9.\-]', '', 'g') AS DOUBLE)) AS value FROM customer GROUP BY 1",
)
typed(
    "tq_text_number_filter",
    "supplier",
    Query(where=(Where("s_name", "<", "$20"),), measure="count"),
    r"SELECT count(*) AS value FROM supplier WHERE TRY_CAST(regexp_replace(replace(s_name, ',', ''), '[^0-9.\-]', '', 'g') AS DOUBLE) < 20",
)
typed(
    "tq_group_split",
    "part",
    Query(measure="count", group_by="p_type", split=" ", limit=1000),
    "SELECT bucket, count(*) AS value FROM (SELECT unnest(list_distinct(list_transform(string_split(p_type, ' '), lambda x: trim(x)))) AS bucket FROM part) WHERE bucket <> '' GROUP BY 1",
)
typed(
    "tq_distinct",
    "lineitem",
    Query(where=(Where("l_quantity", ">=", 30), Where("l_returnflag", "!=", "a")), measure="distinct", field="l_partkey"),
    "SELECT count(DISTINCT l_partkey) AS value FROM lineitem WHERE l_quantity >= 30 AND lower(l_returnflag) <> 'a'",
)
typed(
    "tq_average",
    "lineitem",
    Query(where=(Where("l_shipdate", ">=", "1995-01-01"), Where("l_shipdate", "<", "1997-01-01")), measure="average", field="l_extendedprice", group_by="l_returnflag"),
    "SELECT l_returnflag AS bucket, round(avg(l_extendedprice), 4) AS value FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY 1",
    value=4,
)
typed(
    "tq_min",
    "lineitem",
    Query(measure="min", field="l_extendedprice", group_by="l_linestatus"),
    "SELECT l_linestatus AS bucket, min(l_extendedprice) AS value FROM lineitem GROUP BY 1",
)
typed(
    "tq_in",
    "orders",
    Query(where=(Where("o_orderpriority", "in", ("1-urgent", "2-HIGH")), Where("o_orderstatus", "=", "f")), measure="count"),
    "SELECT count(*) AS value FROM orders WHERE lower(o_orderpriority) IN ('1-urgent', '2-high') AND lower(o_orderstatus) = 'f'",
)
typed(
    "tq_empty",
    "events",
    Query(where=(Where("props", "!=", ""), Where("value", "=", "")), measure="count"),
    "SELECT count(*) AS value FROM events WHERE NOT (props IS NULL OR props = '') AND (value IS NULL OR CAST(value AS VARCHAR) = '')",
)
typed(
    "tq_pair_fields",
    "lineitem",
    Query(where=(Where("l_discount", ">", other="l_tax"),), measure="count", group_by="l_returnflag"),
    "SELECT l_returnflag AS bucket, count(*) AS value FROM lineitem WHERE l_discount > l_tax GROUP BY 1",
)
typed(
    "tq_page_total",
    "orders",
    Query(where=(Where("o_totalprice", ">", 100000),), order_by="o_totalprice", descending=True, offset=20, limit=30),
    "SELECT *, count(*) OVER () AS total FROM orders WHERE o_totalprice > 100000 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority LIMIT 30 OFFSET 20",
    total=True,
)
typed(
    "tq_groups_total",
    "lineitem",
    Query(measure="count", group_by="l_suppkey", limit=10),
    "SELECT l_suppkey AS bucket, count(*) AS value, count(*) OVER () AS total FROM lineitem GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    total=True,
)


@query("tq_year_in_text", r"SELECT CAST(TRY_CAST(regexp_extract(text, '(^|[^0-9])([0-9]{4})([^0-9]|$)', 2) AS INTEGER) AS INTEGER) AS y, count(*) AS n FROM documents GROUP BY 1")
def year_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(year_in(F.col("text")).alias("y")).agg(F.count("*").alias("n"))


SQL = "SELECT n_name, count(*) AS n, sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS owing FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"


@query("sql_free_select", "SELECT n_name, count(*) AS n, CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS owing FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def free_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_sql(spark, SQL, {t: table(spark, sf_dir, t) for t in ("customer", "nation")})


@query("sql_tables_read", "SELECT unnest(['customer', 'nation']) AS name")
def sql_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in tables_read(spark, f"WITH x AS ({SQL}) SELECT * FROM x")], "name string")


@query("cells_truncated", "SELECT doc_id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '...' ELSE coalesce(text, '') END AS cell FROM documents")
def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", truncated(F.col("text"), 40).alias("cell"))


def profile_sql(t: str, c: str, dtype: str) -> str:
    text = dtype == "text"
    chars = f"round(avg(length({c})), 4)" if text else "CAST(NULL AS DOUBLE)"
    many = rf"round(avg(CAST(regexp_matches({c}, '[.!?]\s+\S') AS INTEGER)), 4)" if text else "CAST(NULL AS DOUBLE)"
    prose = rf"coalesce(avg(length({c})) >= 120 AND avg(CAST(regexp_matches({c}, '[.!?]\s+\S') AS INTEGER)) >= 0.5, false)" if text else "false"
    return f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", '{dtype}' AS dtype, count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS \"distinct\", {chars} AS avg_chars, {many} AS multi_sentence, count(*) > 0 AND count({c}) = count(*) AND count(DISTINCT {c}) = count(*) AS is_unique, {prose} AS is_prose FROM {t}"


PROFILED = {
    "documents": [("doc_id", "integer"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "integer")],
    "orders": [("o_orderkey", "integer"), ("o_custkey", "integer"), ("o_orderstatus", "text"), ("o_totalprice", "float"), ("o_orderdate", "datetime"), ("o_orderpriority", "text")],
    "nation": [("n_nationkey", "integer"), ("n_name", "text"), ("n_regionkey", "integer")],
}


@query("prof_columns", " UNION ALL ".join(profile_sql(t, c, k) for t, cs in PROFILED.items() for c, k in cs))
def profile_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = prof.profile({t: table(spark, sf_dir, t) for t in PROFILED})
    return told.withColumns({c: F.round(c, 4) for c in ("avg_chars", "multi_sentence")})


@query("prof_prose", r"SELECT 'text' AS col WHERE (SELECT avg(length(text)) >= 120 AND avg(CAST(regexp_matches(text, '[.!?]\s+\S') AS INTEGER)) >= 0.5 FROM documents)")
def profile_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.columns(table(spark, sf_dir, "documents"), "documents").where("is_prose").select(F.col("column").alias("col"))


INCLUSION = [("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("nation", "n_regionkey", "region", "r_regionkey"), ("orders", "o_custkey", "customer", "c_custkey")]


def fk_sql(a: str, ca: str, b: str, cb: str) -> str:
    return f"SELECT '{a}' AS from_table, '{ca}' AS from_column, '{b}' AS to_table, '{cb}' AS to_column, round(count(*) FILTER (v IN (SELECT {cb} FROM {b})) / count(*), 6) AS inclusion FROM (SELECT DISTINCT {ca} AS v FROM {a} WHERE {ca} IS NOT NULL)"


@query("prof_fk_inclusion", " UNION ALL ".join(fk_sql(*x) for x in INCLUSION))
def fk_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusions of the declared keys, from the same long table of values that finds undeclared ones."""
    tables = {t: table(spark, sf_dir, t) for t in ("customer", "supplier", "nation", "region", "orders")}
    tables["orders"] = tables["orders"].select("o_custkey")
    declared = spark.createDataFrame(INCLUSION, "from_table string, from_column string, to_table string, to_column string")
    found = prof.foreign_keys(tables, declared=declared).where("declared")
    return found.select("from_table", "from_column", "to_table", "to_column", F.round("inclusion", 6).alias("inclusion"))


@query(
    "prof_fk_candidates",
    "SELECT 'supplier' AS from_table, 's_nationkey' AS from_column, 'nation' AS to_table, 'n_nationkey' AS to_column WHERE (SELECT count(*) FILTER (s_nationkey IN (SELECT n_nationkey FROM nation)) >= 0.95 * count(*) FROM (SELECT DISTINCT s_nationkey FROM supplier)) "
    "UNION ALL SELECT 'nation', 'n_regionkey', 'region', 'r_regionkey' WHERE (SELECT count(*) FILTER (n_regionkey IN (SELECT r_regionkey FROM region)) >= 0.95 * count(*) FROM (SELECT DISTINCT n_regionkey FROM nation))",
)
def fk_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = prof.foreign_keys({t: table(spark, sf_dir, t) for t in ("supplier", "nation", "region")})
    return found.where("name_match or from_column rlike 'nationkey$|regionkey$'").where("from_column <> to_column and to_column rlike '_nationkey$|_regionkey$' and regexp_extract(from_column, '[a-z]+$', 0) = regexp_extract(to_column, '[a-z]+$', 0)").select("from_table", "from_column", "to_table", "to_column")


@query("prof_examples", r"SELECT v FROM (SELECT min(o_orderpriority) AS v FROM orders GROUP BY regexp_replace(regexp_replace(o_orderpriority, '[0-9]+', '9', 'g'), '\p{L}+(\s+\p{L}+)*', 'a', 'g') UNION SELECT v FROM (SELECT DISTINCT o_orderpriority AS v FROM orders ORDER BY 1 LIMIT 3)) ORDER BY 1 LIMIT 3")
def profile_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prof.examples(table(spark, sf_dir, "orders"), "o_orderpriority")


@query("text_shapes", r"SELECT regexp_replace(regexp_replace(regexp_replace(p_name, '\p{Nd}+', '9', 'g'), '\p{L}+(\s+\p{L}+)*', 'a', 'g'), '\s+', ' ', 'g') AS form, count(*) AS n FROM part GROUP BY 1")
def text_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(shape(F.col("p_name")).alias("form")).agg(F.count("*").alias("n"))


@query("text_quantity", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS value, CASE p_size % 3 WHEN 0 THEN 'kg' WHEN 1 THEN 'cm' ELSE 'rubs' END AS unit FROM part")
def text_quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelled = F.concat(F.col("p_size").cast("string"), F.when(F.col("p_size") % 3 == 0, " Kilograms").when(F.col("p_size") % 3 == 1, "cm").otherwise(" rubs"))
    return table(spark, sf_dir, "part").select("p_partkey", quantity(spelled).alias("q")).select("p_partkey", "q.value", "q.unit")


@query("text_number_sum", r"SELECT round(sum(TRY_CAST(regexp_replace(replace(p_name, ',', ''), '[^0-9.\-]', '', 'g') AS DOUBLE)), 2) AS total, count(*) - count(TRY_CAST(regexp_replace(replace(p_name, ',', ''), '[^0-9.\-]', '', 'g') AS DOUBLE)) AS skipped FROM part")
def text_number_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = number_in(F.col("p_name"))
    return table(spark, sf_dir, "part").agg(F.round(F.sum(n), 2).alias("total"), F.count_if(n.isNull()).alias("skipped"))


@query("json_flatten", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS \"props.k\" FROM events")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return json_column(table(spark, sf_dir, "events").select("event_id", "props"), "props", "k bigint")


@query("stream_latest", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) AS r FROM events) WHERE r = 1")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that an idempotent re-import keeps."""
    return latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), "user_id", "ts").select("user_id", "event_id", "event_type")


@query("stream_window_counts", "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windowed_counts(table(spark, sf_dir, "events"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "n")

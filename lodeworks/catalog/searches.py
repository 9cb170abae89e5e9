"""Text, chunk and retrieval queries over documents, pages, benchmark items and embeddings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import form_pattern, name_key, norm, sentences, squash
from ..operators import chunking, retrieval
from ..registry import query, table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc "), F.col("doc_id").cast("string")).alias("title"), "text")


@query("text_norm", r"SELECT nation.n_nationkey, trim(regexp_replace(regexp_replace(lower(strip_accents(n_name)), '[*_`#>]', '', 'g'), '\s+', ' ', 'g')) AS key FROM nation")
def text_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", norm("n_name").alias("key"))


@query("text_squash", "SELECT c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS key FROM customer")
def text_squash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", squash(F.col("c_name")).alias("key"))


@query("text_name_key", "SELECT p_partkey, array_to_string(list_sort(string_split(trim(regexp_replace(regexp_replace(lower(p_name), '[*_`#>]', '', 'g'), '\\s+', ' ', 'g')), ' ')), ' ') AS key FROM part")
def text_name_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", name_key(F.col("p_name")).alias("key"))


@query("text_sentences")
def text_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", F.posexplode(sentences("text")).alias("idx", "sentence"))


@query("text_chunks")
def text_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(documents(spark, sf_dir))


@query("text_chunks_overlap")
def text_chunks_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunks(documents(spark, sf_dir), most=800, least=100, overlap=80)


@query("text_context", r"SELECT doc_id, coalesce(nullif(regexp_extract(text, '(?m)^\s*#+\s*(.+?)\s*$', 1), ''), 'doc ' || doc_id) AS context FROM documents")
def text_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", chunking.context(F.col("text"), F.col("title")).alias("context"))


@query("text_next_chunks", "SELECT conv_id || '#' || turn AS chunk_id, lag(conv_id || '#' || turn) OVER w AS previous, lead(conv_id || '#' || turn) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def text_next_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    id = F.concat(F.col("conv_id").cast("string"), F.lit("#"), F.col("turn").cast("string"))
    return chunking.next_chunks(turns.select(id.alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx")))


@query("text_read_document", "SELECT conv_id AS doc_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text, count(*) AS n FROM conversations WHERE conv_id % 100 = 0 GROUP BY conv_id")
def text_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), "text")
    return retrieval.read_documents(turns, turns.where("doc_id % 100 = 0").select("doc_id").distinct())


@query("text_find_all_words", r"SELECT doc_id FROM documents WHERE regexp_matches(lower(text), 'license|(^|[^a-z])licens(ing|ed|es|s|e)?([^a-z]|$)') AND contains(lower(text), 'under')")
def text_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", "text", F.lit(None).cast("string").alias("context"), F.lit(0).alias("idx"))
    return retrieval.find_passages(rows, [form_pattern("license"), form_pattern("under")]).select("doc_id")


@query("text_excerpt")
def text_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).where(F.lower("text").rlike(form_pattern("license")))
    return rows.select("doc_id", retrieval.excerpt(sentences("text"), [form_pattern("license")]).alias("excerpt"))


@query("text_spans", "SELECT r_regionkey, CASE WHEN len(string_split(r_name, ' ')) >= 1 THEN string_split(r_name, ' ') ELSE [] END AS spans FROM region")
def text_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "region").select("r_regionkey", retrieval.spans(F.split("r_name", " "), 1).alias("spans"))


COSINE = "list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return v, v.where("id % 100 = 0").select(F.col("id").alias("query"), "v")


@query("ret_cosine_topk", f"SELECT query, id, rank, round(score, 5) AS score FROM (SELECT q.vec_id AS query, e.vec_id AS id, {COSINE} AS score, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE} DESC, e.vec_id) AS INTEGER) AS rank FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, q = vectors(spark, sf_dir)
    return retrieval.nearest(v, q, 10).select("query", "id", "rank", F.round("score", 5).alias("score"))


@query("ret_cosine_pairs", f"SELECT q.vec_id AS a, e.vec_id AS b, round({COSINE}, 5) AS score FROM embeddings e JOIN embeddings q ON q.label = e.label AND q.vec_id <> e.vec_id AND q.vec_id % 100 = 0")
def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all of its label."""
    e = table(spark, sf_dir, "embeddings").where("label is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("g"))
    met = retrieval.all_cosines(e, e.where("id % 100 = 0").withColumnRenamed("id", "query"), group=True)
    return met.where("query <> id").select(F.col("query").alias("a"), F.col("id").alias("b"), F.round("score", 5).alias("score"))


BM25 = r"""
tok AS (SELECT doc_id AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS term FROM documents),
tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL), size AS (SELECT id, count(*) AS size FROM tok GROUP BY id),
st AS (SELECT count(*) AS n, avg(size) AS average FROM size),
q AS (SELECT DISTINCT item_id AS query, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS term FROM benchmark WHERE item_id % 100 = 0),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm AS (SELECT query, id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / average))) AS score FROM q JOIN tf USING (term) JOIN df USING (term) JOIN size USING (id), st GROUP BY query, id)
"""


def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    posted = retrieval.postings(table(spark, sf_dir, "documents"), "doc_id")
    asked = table(spark, sf_dir, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query"), "text")
    return retrieval.bm25(posted, asked)


@query("ret_bm25", f"WITH {BM25} SELECT query, id, round(score, 4) AS score FROM bm")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_scores(spark, sf_dir).select("query", "id", F.round("score", 4).alias("score"))


LISTS = """
l AS (SELECT o_custkey % 7 AS query, o_orderkey AS id, CAST(row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank, 0 AS list FROM orders
UNION ALL SELECT o_custkey % 7, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderdate, o_orderkey) AS INTEGER), 1 FROM orders),
top AS (SELECT * FROM l WHERE rank <= 200)
"""


def lists(spark: SparkSession, sf_dir: str, depth: int = 200) -> DataFrame:
    """Two ranked lists of orders a query: by price, and by date."""
    orders = table(spark, sf_dir, "orders").withColumn("query", F.col("o_custkey") % 7)
    price = orders.select("query", F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    date = orders.select("query", F.col("o_orderkey").alias("id"), (-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("score"))
    one = retrieval.ranked(price, depth).withColumn("list", F.lit(0)).drop("score")
    return one.unionByName(retrieval.ranked(date, depth).withColumn("list", F.lit(1)).drop("score"))


FUSED = "f AS (SELECT query, id, sum(1.0 / (60 + rank)) AS score, min({'rank': rank, 'list': list}) AS best FROM top GROUP BY query, id), r AS (SELECT query, id, score, CAST(row_number() OVER (PARTITION BY query ORDER BY round(score, 12) DESC, best, id) AS INTEGER) AS rank FROM f)"


@query("ret_rrf", f"WITH {LISTS}, {FUSED} SELECT query, id, round(score, 8) AS score, rank FROM r")
def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.rrf(lists(spark, sf_dir)).withColumn("score", F.round("score", 8))


@query("ret_interleave", f"WITH {LISTS}, f AS (SELECT query, id, min({{'rank': rank, 'list': list}}) AS t FROM top GROUP BY ALL) SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY t, id) AS INTEGER) AS rank FROM f")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.interleave(lists(spark, sf_dir))


@query(
    "ret_round_robin",
    "WITH t AS (SELECT l_linenumber AS query, CAST(l_suppkey AS INTEGER) AS pos, l_partkey AS id, row_number() OVER (PARTITION BY l_linenumber, l_suppkey ORDER BY l_orderkey, l_partkey) AS turn FROM lineitem), f AS (SELECT query, id, min({'turn': turn, 'pos': pos}) AS t FROM t GROUP BY ALL) SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY t, id) AS INTEGER) AS rank FROM f",
)
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query a line number, a list a supplier, in the order of the orders."""
    items = table(spark, sf_dir, "lineitem")
    return retrieval.round_robin(items.select(F.col("l_linenumber").alias("query"), F.col("l_suppkey").cast("int").alias("pos"), F.col("l_partkey").alias("id"), F.col("l_orderkey").alias("ord")))


@query(
    "ret_whole_groups",
    f"WITH {LISTS}, g AS (SELECT query, id % 50 AS grp, min(rank) AS lead, count(*) AS n FROM top WHERE list = 0 GROUP BY ALL), k AS (SELECT *, sum(n) OVER w AS upto, row_number() OVER w AS first FROM g WINDOW w AS (PARTITION BY query ORDER BY lead, grp)) SELECT t.query, t.id, t.rank FROM top t JOIN k ON k.query = t.query AND k.grp = t.id % 50 WHERE t.list = 0 AND (upto <= 60 OR first = 1)",
)
def whole_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = lists(spark, sf_dir).where("list = 0").withColumn("group", F.col("id") % 50)
    return retrieval.whole_groups(items, 60).select("query", "id", "rank")


@query(
    "ret_recall_at_k",
    f"WITH {LISTS}, {FUSED}, g AS (SELECT o_custkey % 7 AS query, o_orderkey AS id FROM orders WHERE o_totalprice > 300000), h AS (SELECT query, rank, b FROM g LEFT JOIN r USING (query, id), (SELECT unnest([5, 20, 100]) AS b)), p AS (SELECT b, query, count(*) FILTER (rank <= b) AS found, count(*) AS total FROM h GROUP BY ALL) SELECT CAST(b AS INTEGER) AS budget, CAST(sum(found) AS BIGINT) AS found, CAST(sum(total) AS BIGINT) AS total, count(*) FILTER (found = total) AS complete, count(*) AS questions FROM p GROUP BY b",
)
def recall_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select((F.col("o_custkey") % 7).alias("query"), F.col("o_orderkey").alias("id"))
    return retrieval.recall_at(retrieval.rrf(lists(spark, sf_dir)), gold, [5, 20, 100])


@query("ret_rank_chunks", "SELECT query, chunk_id, CAST(row_number() OVER (PARTITION BY query ORDER BY n DESC, least, chunk_id) AS INTEGER) AS rank FROM (SELECT l_suppkey % 5 AS query, l_partkey AS chunk_id, count(DISTINCT l_orderkey) AS n, min(l_linenumber) AS least FROM lineitem GROUP BY ALL)")
def rank_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    walks = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 5).alias("query"), F.col("l_orderkey").alias("start"), F.col("l_partkey").alias("chunk_id"), F.col("l_linenumber").alias("steps"))
    return retrieval.rank_chunks(walks)


@query("ret_by_name", "WITH w AS (SELECT 1 AS query, 'building' AS q UNION ALL SELECT 2, 'supplier#000000007'), n AS (SELECT s_suppkey AS id, lower(s_name) AS key FROM supplier) SELECT query, id, CAST(1 AS INTEGER) AS rank FROM w JOIN n ON n.key = w.q")
def by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lower("s_name").alias("key"), F.lit(1).alias("mentions"))
    return retrieval.by_name(names, spark.createDataFrame([(1, "building"), (2, "supplier#000000007")], "query int, key string"), 3)


@query("ret_checked_order", "SELECT n_nationkey, CASE n_regionkey WHEN 1 THEN [1, 2] WHEN 2 THEN [2, 1] ELSE [n_regionkey, 1, 2] END AS fixed FROM nation")
def checked_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reply of a known id, an unknown one and the known one again, over three known ids."""
    r = F.col("n_regionkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", retrieval.checked_order(F.array(r, F.lit(9), r), F.array(F.lit(1), F.lit(2), r)).alias("fixed"))


@query("sample_seeded", "SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || '|3'), o_orderkey LIMIT 100")
def sample_seeded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.seeded_sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, seed=3)


@query("sample_stratified", "SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(o_orderkey || '|3'), o_orderkey) AS n FROM orders) WHERE n <= 20")
def sample_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.stratified_sample(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey", 20, seed=3)


@query("ret_cross_encoder")
def cross_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reranking of a pool by a scorer loaded once a worker; here a word-overlap scorer stands for the model."""

    @F.pandas_udf("double")
    def scored(question: pd.Series, passage: pd.Series) -> pd.Series:
        return pd.Series([len(set(a.lower().split()) & set(b.lower().split())) / max(1, len(set(a.lower().split()))) for a, b in zip(question, passage, strict=True)])

    pool = retrieval.ranked(bm25_scores(spark, sf_dir), 10)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("passage"))
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("question"))
    rows = pool.join(texts, "id").join(asked, "query").select("query", "id", scored("question", "passage").alias("score"))
    return retrieval.ranked(rows).select("query", "id", "rank")

"""Ranked retrieval: exact cosine, BM25 over a postings table, fusion of ranked lists, cuts that keep groups whole.

A ranked list is (query, id, rank) with ranks from 1; several lists carry a ``list`` position. Top-k goes by
``TakeOrdered`` or by a window a query, never by one window over everything.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numbers import cosine, jaccard

# fixed values: BM25 and fusion constants
K1, B, RRF_K = 1.2, 0.75, 60
# vectors of a block, scores computed at once, rows of an answer
ROWS, TILE, OUT = 4096, 1 << 15, 1 << 16


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def postings(texts: DataFrame, id: str = "id", text: str = "text") -> DataFrame:
    """(id, term, tf, size): how often each term stands in each text."""
    rows = texts.select(F.col(id).alias("id"), tokens(F.col(text)).alias("t")).withColumn("size", F.size("t"))
    return rows.select("id", "size", F.explode("t").alias("term")).groupBy("id", "size", "term").agg(F.count("*").alias("tf"))


def bm25(posted: DataFrame, queries: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(query, id, score) of every text that shares a term with a query (query, text).

    Only the queries' terms are taken from the postings before they are counted.
    """
    asked = queries.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    texts = posted.select("id", "size").distinct().agg(F.count("*").alias("n"), F.avg("size").alias("average"))
    used = posted.join(asked.select("term").distinct(), "term", "left_semi")
    df = used.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.col("average")))
    weighed = used.join(df, "term").join(F.broadcast(texts)).select("term", "id", (idf * tf).alias("w"))
    return weighed.join(asked, "term").groupBy("query", "id").agg(F.sum("w").alias("score"))


def ranked(scores: DataFrame, k: int | None = None) -> DataFrame:
    """(query, id, rank, score), the best first, ties by id."""
    w = W.partitionBy("query").orderBy(F.col("score").desc_nulls_last(), "id")
    out = scores.withColumn("rank", F.row_number().over(w))
    return out if k is None else out.where(F.col("rank") <= k)


def even(v: Column) -> Column:
    """Whether a vector is made of finite numbers, so that its scores need no null rules."""
    return F.coalesce((F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < 1e100)), F.lit(False))


def packed_vectors(vectors: DataFrame, id: str, group: bool = False) -> DataFrame:
    """(g, n, ids, m): vectors (id, v[, g]) of one length, and of one ``g``, as matrices of ``ROWS`` rows at most, row after row."""
    kind = vectors.schema[id].dataType.simpleString()
    held = "g" if group else "0"
    of = vectors.schema["g"].dataType.simpleString() if group else "int"

    def pack(batches):
        import numpy as np
        import pyarrow as pa

        def out(g, n, ids, rows):
            m = np.concatenate(rows)
            return pa.RecordBatch.from_arrays([pa.array([g], schema.field("g").type), pa.array([n], pa.int32()), pa.array([pa.concat_arrays(ids)], schema.field("ids").type), pa.array([m.tobytes()], pa.binary())], schema=schema)

        schema = None
        held: dict = {}
        for batch in batches:
            if schema is None:
                schema = pa.schema([("g", batch.schema.field("g").type), ("n", pa.int32()), ("ids", pa.list_(batch.schema.field("id").type)), ("m", pa.binary())])
            v, ids, gs = batch.column("v"), batch.column("id"), batch.column("g").to_pylist()
            lengths = v.value_lengths().to_numpy()
            of: dict = {}
            for i, key in enumerate(zip(gs, lengths.tolist(), strict=True)):
                of.setdefault(key, []).append(i)
            for key, at in of.items():
                for k in range(0, len(at), ROWS):
                    some = pa.array(at[k : k + ROWS])
                    rows = v.take(some).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), key[1])
                    n, kept_ids, kept = held.get(key, (0, [], []))
                    if n and n + len(some) > ROWS:
                        yield out(*key, kept_ids, kept)
                        n, kept_ids, kept = 0, [], []
                    held[key] = (n + len(some), [*kept_ids, ids.take(some)], [*kept, rows])
        for key, (_, kept_ids, kept) in held.items():
            yield out(*key, kept_ids, kept)

    return vectors.select(F.expr(held).cast(of).alias("g"), F.col(id).alias("id"), "v").mapInArrow(pack, f"g {of}, n int, ids array<{kind}>, m binary")


def scored_blocks(met: DataFrame, a: str, b: str, kinds: tuple[str, str], k: int | None = None) -> DataFrame:
    """(a, b, score): the cosines of packed pairs of blocks (n, a_ids, a_m, b_ids, b_m), or each a's ``k`` best of a block.

    Products are summed element after element, as ``cosine`` sums them, so both give the same doubles.
    """

    def score(batches):
        import numpy as np
        import pyarrow as pa

        types = None
        for batch in batches:
            if types is None:
                types = [batch.schema.field(c).type.value_type for c in ("a_ids", "b_ids")]
            n, a_ids, b_ids, a_m, b_m = (batch.column(c) for c in ("n", "a_ids", "b_ids", "a_m", "b_m"))
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(m[i].as_buffer(), np.float64).reshape(-1, n[i].as_py()) for m in (a_m, b_m))
                ids, others = a_ids[i].values, b_ids[i].values
                columns = np.ascontiguousarray(y.T)
                across = sizes(y)
                order = others.to_numpy(zero_copy_only=False)
                step = max(1, TILE // len(y))
                for at in range(0, len(x), step):
                    part = x[at : at + step]
                    dots, products = np.zeros((len(part), len(y))), np.empty((len(part), len(y)))
                    for d in range(part.shape[1]):
                        np.multiply(part[:, d, None], columns[d], out=products)
                        dots += products
                    size = sizes(part)[:, None] * across
                    with np.errstate(all="ignore"):
                        scores = np.where(size == 0, 0.0, dots / size)
                    if k is None or len(y) <= k:
                        rows, cols = np.divmod(np.arange(scores.size), len(y))
                    else:
                        # all from the k-th best score on, of which the least ids stay
                        least = np.partition(scores, len(y) - k, axis=1)[:, len(y) - k]
                        rows, cols = np.nonzero(scores >= least[:, None])
                        best = np.lexsort((order[cols], -scores[rows, cols], rows))
                        rows, cols = rows[best], cols[best]
                        starts = np.searchsorted(rows, np.arange(len(part)))
                        first = np.arange(len(rows)) - starts[rows] < k
                        rows, cols = rows[first], cols[first]
                    for cut in range(0, len(rows), OUT):
                        r, c = rows[cut : cut + OUT], cols[cut : cut + OUT]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(r + at)), others.take(pa.array(c)), pa.array(scores[r, c])], names=[a, b, "score"])

    def sizes(m):
        import numpy as np

        total = np.zeros(len(m))
        for d in range(m.shape[1]):
            total += m[:, d] * m[:, d]
        return np.sqrt(total)

    return met.mapInArrow(score, f"`{a}` {kinds[0]}, `{b}` {kinds[1]}, score double")


def all_cosines(vectors: DataFrame, queries: DataFrame, group: bool = False, k: int | None = None) -> DataFrame:
    """(query, id, score) of vectors (id, v) and queries (query, v), or of those of one ``g``; with ``k``, at least each query's best ``k``.

    Pairs of whole blocks of vectors are scored in an Arrow function. Vectors with nulls or without finite numbers, and
    pairs of two lengths, follow the column's null rules instead. Work is the number of pairs. Every executor gets the
    queries; vectors pass in blocks.
    """
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    q, v = queries.withColumnRenamed("v", "q"), vectors
    ok_q, ok_v = queries.where(even(F.col("v"))), v.where(even(F.col("v")))
    kinds = (queries.schema["query"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString())
    x = packed_vectors(ok_q, "query", group).select("g", "n", F.col("ids").alias("a_ids"), F.col("m").alias("a_m"))
    y = packed_vectors(ok_v.repartition(parts, "id"), "id", group).select(F.col("g").alias("of"), F.col("n").alias("size"), F.col("ids").alias("b_ids"), F.col("m").alias("b_m"))
    met = y.join(F.broadcast(x), (F.col("n") == F.col("size")) & (F.col("g") == F.col("of")))
    fast = scored_blocks(met.select("n", "a_ids", "b_ids", "a_m", "b_m"), "query", "id", kinds, k)
    slow = lambda p, r: (p.join(F.broadcast(r), "g") if group else p.crossJoin(F.broadcast(r))).select("query", "id", cosine(F.col("v"), F.col("q")).alias("score"))
    fits = even(F.col("v")) & even(F.col("q")) & (F.size("v") == F.size("q"))
    lengths = ok_v.select(F.size("v").alias("n")).distinct()
    odd = slow(v.where(~even(F.col("v"))), q)
    odd = odd.unionByName(slow(ok_v, q.where(~even(F.col("q")))))
    other = ok_q.select(F.size("v").alias("n")).distinct().crossJoin(lengths.withColumnRenamed("n", "m")).where("n <> m")
    unlike = ok_v.join(F.broadcast(other.select("m").distinct()), F.size("v") == F.col("m"), "left_semi")
    against = F.broadcast(q.where(even(F.col("q"))))
    pairs = unlike.join(against, "g") if group else unlike.crossJoin(against)
    return fast.unionByName(odd).unionByName(pairs.where(~fits).select("query", "id", cosine(F.col("v"), F.col("q")).alias("score")))


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Exact top-k by cosine: vectors (id, v) against query vectors (query, v), block by block; ties by id."""
    return ranked(all_cosines(vectors.select("id", "v"), queries.select("query", "v"), k=k), k)


def rrf(lists: DataFrame, k: int = RRF_K, depth: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query, list, id, rank): (query, id, score, rank); ties by best rank, list, id."""
    if depth is not None:
        lists = lists.where(F.col("rank") <= depth)
    fused = lists.groupBy("query", "id").agg(F.sum(F.lit(1.0) / (F.lit(k) + F.col("rank"))).alias("score"), F.min(F.struct("rank", "list")).alias("best"))
    w = W.partitionBy("query").orderBy(F.round("score", 12).desc(), "best", "id")
    return fused.select("query", "id", "score", F.row_number().over(w).alias("rank"))


def interleave(lists: DataFrame) -> DataFrame:
    """Lists taken in turns, first occurrences only: (query, id, rank)."""
    first = lists.groupBy("query", "id").agg(F.min(F.struct("rank", "list")).alias("turn"))
    return first.select("query", "id", F.row_number().over(W.partitionBy("query").orderBy("turn", "id")).alias("rank"))


def round_robin(groups: DataFrame) -> DataFrame:
    """(query, id, rank) of (query, pos, id, ord): each group's next item in turn, groups by pos."""
    turn = F.row_number().over(W.partitionBy("query", "pos").orderBy("ord", "id"))
    return interleave(groups.select("query", "id", F.col("pos").alias("list"), turn.alias("rank")))


def whole_groups(items: DataFrame, limit: int) -> DataFrame:
    """Groups (query, group, rank, id) in order of their best rank, as long as whole groups fit the limit; the first always stays."""
    size = items.groupBy("query", "group").agg(F.min("rank").alias("lead"), F.count("*").alias("n"))
    upto = F.sum("n").over(W.partitionBy("query").orderBy("lead", "group"))
    first = F.row_number().over(W.partitionBy("query").orderBy("lead", "group"))
    fit = size.withColumn("upto", upto).withColumn("first", first).where((F.col("upto") <= limit) | (F.col("first") == 1))
    return items.join(fit.select("query", "group"), ["query", "group"], "left_semi")


def recall_at(lists: DataFrame, gold: DataFrame, budgets: list[int]) -> DataFrame:
    """(budget, found, total, complete, questions): gold (query, id) found in the first ranks of each list."""
    hit = gold.join(lists.select("query", "id", "rank"), ["query", "id"], "left")
    per = hit.select("query", "rank", F.explode(F.array(*[F.lit(b) for b in budgets])).alias("budget"))
    per = per.groupBy("budget", "query").agg(F.count_if(F.col("rank") <= F.col("budget")).alias("found"), F.count("*").alias("total"))
    return per.groupBy("budget").agg(F.sum("found").alias("found"), F.sum("total").alias("total"), F.count_if(F.col("found") == F.col("total")).alias("complete"), F.count("*").alias("questions"))


def find_passages(chunks: DataFrame, patterns: list[str]) -> DataFrame:
    """Chunks that hold every pattern in their text or in their context, by document and position."""
    text, context = F.lower("text"), F.lower(F.coalesce(F.col("context"), F.lit("")))
    every = functools.reduce(lambda a, b: a & b, [text.rlike(p) | context.rlike(p) for p in patterns])
    return chunks.where(every).orderBy("doc_id", "idx")


def read_documents(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, text, n): the chunks (doc_id, idx, text) of the wanted documents (doc_id), in reading order, blank lines between."""
    mine = chunks.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi")
    parts = F.array_sort(F.collect_list(F.struct("idx", F.coalesce("text", F.lit("")).alias("text"))))
    return mine.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "\n\n").alias("text"), F.count("*").alias("n"))


def excerpt(sentences: Column, patterns: list[str], most: int = 600) -> Column:
    """Sentences that match a pattern, and headings, joined and cut."""
    keep = F.filter(sentences, lambda s: functools.reduce(lambda a, b: a | b, [F.lower(s).rlike(p) for p in patterns]) | s.startswith("#"))
    return F.substring(F.array_join(keep, " "), 1, most)


def by_name(names: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(query, id, rank) of names (id, key, mentions) for (query, key): equal first, then by shared words, mentions, id.

    Candidates share a word; the join goes over words.
    """
    w1 = wanted.select("query", F.col("key").alias("q"), F.explode(F.array_distinct(F.split("key", " "))).alias("w"))
    w2 = names.select("id", "key", "mentions", F.explode(F.array_distinct(F.split("key", " "))).alias("w"))
    met = w1.join(w2, "w").select("query", "q", "id", "key", "mentions").distinct()
    alike = jaccard(F.split("key", " "), F.split("q", " "))
    w = W.partitionBy("query").orderBy((F.col("q") == F.col("key")).desc(), alike.desc(), F.desc("mentions"), "id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "id", "rank")


def rank_chunks(walks: DataFrame) -> DataFrame:
    """(query, chunk_id, rank) of walks (query, start, chunk_id, steps): reached by most starts, then by the shortest walk, then id."""
    met = walks.groupBy("query", "chunk_id").agg(F.count_distinct("start").alias("n"), F.min("steps").alias("least"))
    return met.select("query", "chunk_id", F.row_number().over(W.partitionBy("query").orderBy(F.desc("n"), "least", "chunk_id")).alias("rank"))


def spans(words: Column, length: int) -> Column:
    """Every run of ``length`` words, joined."""
    n = F.size(words) - (length - 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.array_join(F.slice(words, i, length), " "))).otherwise(F.array().cast("array<string>"))


def checked_order(reply: Column, known: Column) -> Column:
    """A reranker's order made sound: unknown and repeated ids go, missing ones follow in their old order."""
    return F.array_union(F.array_intersect(reply, known), known)


def drawn(id: str, seed: int) -> Column:
    return F.md5(F.concat(F.col(id).cast("string"), F.lit(f"|{seed}")).cast("binary"))


def seeded_sample(df: DataFrame, id: str, n: int, seed: int = 0) -> DataFrame:
    """The same ``n`` rows for one seed, whatever the partitions: least digests of id and seed."""
    return df.orderBy(drawn(id, seed), id).limit(n)


def stratified_sample(df: DataFrame, stratum: str, id: str, n: int, seed: int = 0) -> DataFrame:
    w = W.partitionBy(stratum).orderBy(drawn(id, seed), id)
    return df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n")

"""Graph operators over ``nodes(ref, label, ...)`` and ``edges(type, src, dst)``.

Bounded hops are chains of joins with the visited nodes taken out by anti joins. Loops of unknown length write each round
to the shared checkpoint folder, so that plans stay short and a lost executor costs one round.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIRECTIONS = ("out", "in", "both")


def saved(df: DataFrame) -> DataFrame:
    """``df`` written below ``spark.checkpoint.dir`` and read back."""
    spark = df.sparkSession
    try:
        root = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # unknown to the session
        root = None
    if not root:
        root = tempfile.mkdtemp(prefix="lodeworks-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/lodeworks/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def steps(edges: DataFrame, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """(ref, to, type): each edge in the directions asked for."""
    if types is not None:
        edges = edges.where(F.col("type").isin(types))
    out = edges.select(F.col("src").alias("ref"), F.col("dst").alias("to"), "type")
    back = edges.select(F.col("dst").alias("ref"), F.col("src").alias("to"), "type")
    return {"out": out, "in": back, "both": out.unionByName(back)}[direction]


def related(items: DataFrame, edges: DataFrame, nodes: DataFrame, direction: str = "both", type: str | None = None, label: str | None = None) -> DataFrame:
    """(ref) of the nodes one step from ``items`` (ref), the item itself left out."""
    to = steps(edges, direction, [type] if type else None).join(items.select("ref").distinct(), "ref", "left_semi").where("ref <> to").select(F.col("to").alias("ref"))
    kept = nodes if label is None else nodes.where(F.col("label") == label)
    return to.join(kept.select("ref"), "ref", "left_semi").distinct()


def parts_of(items: DataFrame, edges: DataFrame, nodes: DataFrame, labels: list[str] | None = None) -> DataFrame:
    """(ref) one or two outgoing steps below ``items`` through nodes of ``labels`` only.

    Steps are taken from the items before their ends are looked up, each end once.
    """
    allowed = (nodes if labels is None else nodes.where(F.col("label").isin(labels))).select("ref")
    down = steps(edges, "out").select("ref", "to")
    below = lambda rows: down.join(rows, "ref", "left_semi").select(F.col("to").alias("ref")).distinct().join(allowed, "ref", "left_semi")
    one = below(items.select("ref"))
    return one.unionByName(below(one)).distinct().join(items.select("ref"), "ref", "left_anti")


def hops(starts: DataFrame, edges: DataFrame, most: int, allowed: DataFrame | None = None) -> DataFrame:
    """(start, ref, hops): every node within ``most`` undirected steps of each start, at its least distance; the start at 0."""
    step = steps(edges).select("ref", "to").distinct()
    if allowed is not None:
        step = step.join(allowed.select(F.col("ref").alias("to")), "to", "left_semi")
    here = starts.select(F.col("ref").alias("start"), "ref").distinct()
    seen = here.withColumn("hops", F.lit(0))
    for k in range(1, most + 1):
        here = here.join(step, "ref").select("start", F.col("to").alias("ref")).distinct().join(seen.select("start", "ref"), ["start", "ref"], "left_anti")
        if k > 1 or most > 2:
            here = saved(here)
        seen = seen.unionByName(here.withColumn("hops", F.lit(k)))
    return seen


def components(edges: DataFrame, a: str = "src", b: str = "dst") -> DataFrame:
    """(node, comp) of every node on an edge to another node; comp is the least node of its connected group.

    Each round gives every node the least label among itself and its neighbours and then the label of its label, until a
    round changes nothing.
    """
    pairs = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = saved(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    labels = saved(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("comp")))
    while True:
        near = both.join(labels.select(F.col("node").alias("y"), "comp"), "y").groupBy("x").agg(F.min("comp").alias("near"))
        best = labels.join(near, labels["node"] == near["x"]).select("node", "comp", F.least("comp", "near").alias("best"))
        jump = best.join(labels.select(F.col("node").alias("best"), F.col("comp").alias("far")), "best")
        nxt = saved(jump.select("node", "comp", F.least("best", "far").alias("new")))
        changed = nxt.where("new <> comp").count()
        labels = nxt.select("node", F.col("new").alias("comp"))
        if not changed:
            return labels


def schema_patterns(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(from_label, type, to_label, n)."""
    n = nodes.select("ref", "label")
    named = edges.join(n.select(F.col("ref").alias("src"), F.col("label").alias("from_label")), "src").join(n.select(F.col("ref").alias("dst"), F.col("label").alias("to_label")), "dst")
    return named.groupBy("from_label", "type", "to_label").agg(F.count("*").alias("n"))


def direction_of(patterns: DataFrame, type: str, from_label: str, to_label: str | None = None) -> str:
    """The direction in which a relationship leaves a label, read off the few schema patterns."""
    rows = patterns.where(F.col("type") == type).collect()
    out = any(r["from_label"] == from_label and to_label in (None, r["to_label"]) for r in rows)
    back = any(r["to_label"] == from_label and to_label in (None, r["from_label"]) for r in rows)
    return "both" if out == back else "out" if out else "in"


def neighbours(nodes: DataFrame, edges: DataFrame, cap: int = 10) -> DataFrame:
    """(ref, type, direction, label, names, n): a node's neighbours grouped, names sorted and cut at ``cap``, counted whole."""
    n = nodes.select(F.col("ref").alias("to"), "label", "name")
    out = steps(edges, "out").withColumn("direction", F.lit("out")).unionByName(steps(edges, "in").withColumn("direction", F.lit("in")))
    grouped = out.distinct().join(n, "to").groupBy("ref", "type", "direction", "label").agg(F.array_sort(F.collect_set("name")).alias("names"), F.count_distinct("to").alias("n"))
    return grouped.withColumn("names", F.slice("names", 1, cap))


def overview(nodes: DataFrame, edges: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` nodes of the greatest degree, ties by ref."""
    degree = steps(edges).groupBy("ref").agg(F.count("*").alias("degree"))
    top = nodes.select("ref").join(degree, "ref", "left").select("ref", F.coalesce("degree", F.lit(0)).alias("degree")).orderBy(F.desc("degree"), "ref").limit(n)
    return nodes.join(F.broadcast(top.distinct()), "ref").select("ref", "label", "name", "degree").orderBy(F.desc("degree"), "ref").limit(n)


def graph_digest(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: a digest of the counts of every label and relationship type."""
    counts = nodes.groupBy(F.concat(F.lit("node "), "label").alias("k")).count().unionByName(edges.groupBy(F.concat(F.lit("edge "), "type").alias("k")).count())
    return counts.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("k", "count")))).cast("binary"), 256).alias("digest"))


def sample_rows(tables: dict[str, DataFrame], keys: list[tuple[str, str, str, str]], root: str, wanted: DataFrame) -> dict[str, DataFrame]:
    """A key-consistent sample: the root's ``wanted`` rows, all rows below them, and every row those refer to.

    ``keys`` are (child table, child column, parent table, parent column). Children are taken from the root downwards;
    then parents of kept rows are added until no table grows. Every round is written.
    """
    kept = {root: wanted}
    todo = [root]
    while todo:
        parent = todo.pop()
        for child, cc, p, pc in keys:
            if p == parent and child not in kept and child != root:
                kept[child] = saved(tables[child].join(kept[p].select(F.col(pc).alias(cc)).distinct(), cc, "left_semi").select(*tables[child].columns))
                todo.append(child)
    while True:
        grew = False
        for child, cc, parent, pc in keys:
            if child not in kept:
                continue
            need = kept[child].select(F.col(cc).alias(pc)).where(F.col(pc).isNotNull()).distinct()
            rows = tables[parent].join(need, pc, "left_semi").select(*tables[parent].columns)
            if parent in kept:
                more = rows.join(kept[parent].select(pc).distinct(), pc, "left_anti").select(*rows.columns)
                if more.isEmpty():
                    continue
                rows = kept[parent].unionByName(more)
            kept[parent] = saved(rows)
            grew = True
        if not grew:
            return kept

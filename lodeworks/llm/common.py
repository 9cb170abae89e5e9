"""What the operators of this subpackage share: tables, scratch tables, grouped Arrow streams and components.

Scratch tables are Parquet folders below ``spark.checkpoint.dir``, the one folder every executor and the driver share.
They cut lineage as a checkpoint does and survive the loss of any executor.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts that split on ASCII white space only.
ASCII_SPACE = r"[\x20\x09-\x0D]+"
ASCII_WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: str.translate table of the contracts that lower-case A-Z and nothing else.
LOWER_AZ = {c: c + 32 for c in range(65, 91)}

MASK64 = np.uint64(0xFFFFFFFFFFFFFFFF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table; only Spark's reader touches the path, so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a folder of this machine if all tasks run on it; a cluster must name one."""
    try:
        root = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # the setting is unknown to the session
        root = None
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lodeworks-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/lodeworks/{uuid.uuid4().hex}/{name}"


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` written to the shared scratch folder and read back: computed once, lineage cut, safe from lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the folder behind a ``kept`` table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(f).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path.getParent(), True)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers whose bits look independent."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordIds(dict):
    """word -> 64-bit hash, computed once a word; emptied when it would outgrow its bound."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` words; of a shorter text, one hash over all its words."""
    n = len(h)
    if not n:
        return h
    k = min(size, n)
    acc = np.full(n - k + 1, 0x9E3779B97F4A7C15 + k, np.uint64)
    for i in range(k):  # a polynomial of well-mixed word hashes, mixed once at the end
        acc *= np.uint64(0xD6E8FEB86659FD93)
        acc += h[i : n - k + 1 + i]
    return mix64(acc)


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows that share ``key``, from batches sorted by it. One run is in memory at a time."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        col = b.column(b.schema.get_field_index(key))
        keys = col.to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py() != keys[0]:
            yield pa.Table.from_batches(held)
            held = []
        start = 0
        for at in cut:
            held.append(b.slice(start, at - start))
            yield pa.Table.from_batches(held)
            held, start = [], at
        held.append(b.slice(start, n - start))
    if held:
        yield pa.Table.from_batches(held)


def by_runs(df: DataFrame, key: str, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, *order: str) -> DataFrame:
    """Deals rows out by ``key``, sorts each partition and streams it through ``f``."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, key).sortWithinPartitions(key, *order).mapInArrow(f, schema)


class Forest:
    """Union-find over 0..n-1; the smallest member leads."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, comp)`` of every node that an edge of another node touches; comp is the least node of its component.

    Alternating star contraction: each round hangs every node's neighbours on the least of them. Every round is written
    to the shared folder, and only a count and a sum come to the driver. Self loops and repeated edges do no harm.
    An empty edge table gives an empty result.
    """
    e = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u <> v")
    e = kept(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    spins, before = 0, None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        nxt = kept(small.where("u <> v").distinct(), "edges")
        state = nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(e)
        e, spins = nxt, spins + 1
        if tuple(state) == before or not state[0]:
            break
        before = tuple(state)
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


#: Bits of a filter of wanted nodes, at least and at most, and for each node.
FILTER_BITS, NODE_BITS = (1 << 16, 1 << 26), 16


def wanted_filter(nodes: DataFrame) -> np.ndarray:
    """A Bloom filter of ``nodes``, 8 MB at most however many they are; beyond that it lets more through, and loses none."""
    most = FILTER_BITS[1]
    n = nodes.count()
    size = max(FILTER_BITS[0], min(most, 1 << (NODE_BITS * max(n, 1)).bit_length()))
    bit = F.explode(F.array(*[F.shiftrightunsigned("node", k).bitwiseAND(F.lit(size - 1)) for k in (0, 32)]))
    words = nodes.select(bit.alias("bit")).groupBy(F.shiftright("bit", 5).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit & 31))")).alias("bits"))
    t = words.toArrow()
    out = np.zeros(size // 32, np.uint32)
    out[t.column("at").to_numpy()] = t.column("bits").to_numpy().astype(np.uint32)
    return out


def in_filter(bits: np.ndarray, node: np.ndarray) -> np.ndarray:
    out = np.ones(len(node), bool)
    for k in (0, 32):
        at = (node.view(np.uint64) >> np.uint64(k)) & np.uint64(32 * len(bits) - 1)
        out &= (bits[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32) & np.uint32(1)).astype(bool)
    return out


#: Rows of a bucket beyond which its members aren't compared by sketch but all hang on one of them.
HOT_BUCKET = 200_000


def sketch_forest(sketches: np.ndarray, close: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Spanning forest, as index pairs, of the pairs that ``close`` holds to be close."""
    edges, left = [], np.arange(len(sketches))
    while len(left):
        todo, left = [int(left[0])], left[1:]
        while todo and len(left):
            i = todo.pop()
            near = close(sketches[left], sketches[i])
            found = left[near].tolist()
            left = left[~near]
            edges += [(i, j) for j in found]
            todo += found
    return edges


def bucket_groups(rows: DataFrame, close: Callable[[np.ndarray, np.ndarray], np.ndarray], hot: int = HOT_BUCKET, kinds: int = 1) -> DataFrame:
    """(comp, node, sketch): the groups of nodes that chains of close pairs connect within one bucket; ``rows`` are (key, node, sketch), all long.

    A group is named by its least node and the kind of its bucket, the key modulo ``kinds`` (sketches compare within a kind
    only); groups of several buckets with one name are one. Never all pairs of a bucket. One bucket is in memory at a time; one of more
    than ``hot`` rows is a group as it is, unseen, so that what follows compares its members exactly.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def members(comp: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(comp), pa.array(node), pa.array(signed(sketch))], ["comp", "node", "sketch"])

        def name(node: np.ndarray, key: np.ndarray) -> np.ndarray:
            return signed(mix64(node.view(np.uint64) + key.view(np.uint64) % np.uint64(kinds)))

        def found(key: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
            own = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
            key, node, sketch = key[own], node[own], sketch[own]
            cuts = np.flatnonzero(np.append(True, np.append(key[1:] != key[:-1], True)))
            first, n = cuts[:-1], np.diff(cuts)
            two = first[n == 2]
            two = two[close(sketch[two], sketch[two + 1])]
            sizes, at_rows = [np.full(len(two), 2)], [np.stack([two, two + 1], axis=1).ravel()]
            for at, m in zip(first[n > 2].tolist(), n[n > 2].tolist(), strict=True):
                edges = sketch_forest(sketch[at : at + m], close)
                if not edges:
                    continue
                trees: dict[int, list[int]] = {}
                root: dict[int, int] = {}
                for i, j in edges:  # a tree's edges come from its root on
                    r = root[j] = root.setdefault(i, i)
                    trees.setdefault(r, [r]).append(j)
                for t in trees.values():
                    at_rows.append(at + np.sort(t))
                    sizes.append(np.array([len(t)]))
            sizes, rows = np.concatenate(sizes), np.concatenate(at_rows)
            first = rows[np.cumsum(sizes) - sizes]
            return members(np.repeat(name(node[first], key[first]), sizes), node[rows], sketch[rows])

        key, node, sketch = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
        hung: tuple[int, int] | None = None  # key of a hot bucket and the name of its group
        for batch in batches:
            if not batch.num_rows:
                continue
            k, v, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy().view(np.uint64)
            if hung is not None:
                at = int(np.searchsorted(k, hung[0], "right"))
                yield members(np.full(at, hung[1]), v[:at], x[:at])
                k, v, x = k[at:], v[at:], x[at:]
                if not len(k):
                    continue
                hung = None
            key, node, sketch = np.concatenate([key, k]), np.concatenate([node, v]), np.concatenate([sketch, x])
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield found(key[:last], node[:last], sketch[:last])
                key, node, sketch = key[last:], node[last:], sketch[last:]
            if len(key) > hot:
                hung = int(key[0]), int(name(node[:1], key[:1])[0])
                yield members(np.full(len(node), hung[1]), node, sketch)
                key, node, sketch = key[:0], node[:0], sketch[:0]
        if len(key):
            yield found(key, node, sketch)

    return by_runs(rows.select("key", "node", "sketch"), "key", join, "comp long, node long, sketch long", "node").distinct()


#: Bytes of text that a verification unit holds, about; a member counts ``LEAST_BYTES`` at least, which bounds its rows.
UNIT_BYTES, LEAST_BYTES = 2 << 20, 1 << 10


def weighed(members: DataFrame) -> DataFrame:
    """(comp, parts, lead) of each group: parts of about half a unit, and its least node."""
    size = F.sum(F.greatest("bytes", F.lit(LEAST_BYTES)))
    parts = (F.floor(size / F.lit(UNIT_BYTES // 2)) + 1).cast("long")
    return members.groupBy("comp").agg(F.when(parts <= 2, F.lit(1).cast("long")).otherwise(parts).alias("parts"), F.min("node").alias("lead"))


def first_units(members: DataFrame) -> DataFrame:
    """``members`` (comp, node, bytes, ...) with ``unit`` and ``role``; rows of role 0 are compared with all of their unit, rows of role 1 with those of role 0.

    A group of bounded bytes is one unit, all of role 0. A larger one is cut into parts, each a unit with the group's
    least node as the only row of role 0: a group of copies of one text is settled in time proportional to it.
    """
    # few groups are cut: one a megabyte of text at most, so the rows of the others needn't move
    m = members.join(weighed(members).where("parts > 1"), "comp", "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("long")))
    own = F.pmod(F.xxhash64("node"), F.col("parts"))
    is_lead = F.coalesce(F.col("node") == F.col("lead"), F.lit(False))
    part = F.explode(F.when((F.col("parts") > 1) & is_lead, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(own)))
    m = m.withColumn("part", part).withColumn("unit", F.xxhash64("comp", "part"))
    return m.withColumn("role", ((F.col("parts") > 1) & ~is_lead).cast("int")).drop("parts", "lead", "part")


def second_units(members: DataFrame, links: DataFrame) -> DataFrame | None:
    """Units for the members of cut groups that ``links`` doesn't tie to their least node: each is compared with all members of its group."""
    big = weighed(members).where("parts > 1")
    m = members.join(big, "comp")
    tied = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    m = m.join(tied.select(F.col("a").alias("node"), F.col("b").alias("lead"), F.lit(True).alias("tied")), ["node", "lead"], "left")
    m = kept(m.withColumn("loose", F.col("tied").isNull() & (F.col("node") != F.col("lead"))).drop("tied"), "settled")
    rest = weighed(m.where("loose").select("comp", "node", "bytes")).select("comp", F.col("parts").alias("loose_parts"))
    if m.where("loose").isEmpty():
        return None
    m = m.join(rest, "comp")
    row, column = F.pmod(F.xxhash64("node", F.lit(1)), F.col("loose_parts")), F.pmod(F.xxhash64("node"), F.col("parts"))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    probes = m.where("loose").withColumn("row", row).withColumn("column", F.explode(every("parts"))).withColumn("role", F.lit(0))
    others = m.withColumn("column", column).withColumn("row", F.explode(every("loose_parts"))).withColumn("role", F.lit(1))
    out = probes.unionByName(others).withColumn("unit", F.xxhash64("comp", "row", "column"))
    return out.drop("parts", "loose_parts", "lead", "loose", "row", "column")


def compared(members: DataFrame, links_in: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): links among the members of each group such that any two members whose texts are similar end up connected.

    ``links_in`` turns rows of ``members`` with ``unit`` and ``role`` into links. ``members`` should be ``kept``.
    """
    links = kept(links_in(first_units(members)), "links")
    more = second_units(members, links)
    return links if more is None else links.unionByName(kept(links_in(more), "links"))

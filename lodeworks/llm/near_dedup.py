"""Near-duplicate documents by DartMinHash, banded joining and exact verification.

A text is the weighted set of its 5-word shingles. Darts are thrown at every element: each unit layer of an element's
weight receives a stream of darts at hashed arrival ranks (a Poisson stream, the same in every text), and each dart has a
hashed coordinate and a hashed height in its layer. Darts above the element's weight miss; of those that hit, the
earliest of each coordinate makes the signature. A text needs the darts of the first few ranks only, about t log t of
them however long it is. Bands of the signature are joined. Texts of a bucket whose 64-bit sketches (a bit a coordinate)
differ in ``RADIUS`` bits at most are candidates; chains of them make groups within one bucket, never across buckets.
Groups are brought together, and there Jaccard similarities are computed from the whole texts. Pairs at the threshold or
above link; a class is a connected group of links, named by its least document id.

Exact copies (equal lower-cased word sequences) are grouped by a 128-bit digest first and stand for each other, so groups
of copies are never expanded. A candidate group is verified in units of bounded bytes and rows; a large one is held against
its least member first, and only members that this doesn't settle are compared with all others. Signatures of b bands of r
rows miss a pair of similarity 0.8 with probability (1 - 0.8^r)^b, 3e-6 for 24 bands of 4, and its sketches differ in more
than 16 of 64 bits (6.4 expected) with probability 2e-4.

Weights: ``counts`` (production: a shingle weighs as often as it stands in the text) or ``binary`` (the plain Jaccard
similarity of shingle sets).

Defined results: a text of fewer than five words is one shingle; texts without words (null and empty ones too) are copies
of each other; null ids are kept, and sort before others in no class name unless a class has nothing else; repeated rows
share a class and ``keep`` marks one row of them only in ``near_dedup``; an empty table gives an empty table; only id and
text are read by ``near_classes``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Forest, WordIds, bucket_groups, by_runs, compared, components, in_filter, kept, mix64, runs, signed, table, wanted_filter, window_hashes

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
#: Most differing bits of two sketches.
RADIUS = 16
#: Words that are signed together.
SIGNED_TOKENS = 50_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> list[str]:
    """Lower-cased words between white space."""
    return text.decode("utf-8", "replace").lower().split() if text else []


def shingle_set(words: list[str], ids: WordIds, weights: str = "counts") -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted, and their weights."""
    h, n = np.unique(window_hashes(ids.of(words), SHINGLE), return_counts=True)
    return h, (n if weights == "counts" else np.ones(len(h))).astype(np.float64)


def uniform(x: np.ndarray) -> np.ndarray:
    """0 < u < 1 from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def darts(h: np.ndarray, w: np.ndarray, until: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element, coordinate, rank, identity) of the darts that hit elements ``h`` of weights ``w`` at ranks up to each one's ``until``."""
    layers = np.ceil(w).astype(np.int64)
    element = np.repeat(np.arange(len(h)), layers)
    first = np.repeat(np.cumsum(layers) - layers, layers)
    layer = np.arange(len(element)) - first
    top = w[element] - layer  # a last, partial layer is hit below its top only
    seed = mix64(h[element] ^ mix64(layer.astype(np.uint64) + GOLDEN))
    limit = until[element]
    rank = np.zeros(len(seed))
    out: list[tuple[np.ndarray, ...]] = []
    while len(seed):
        seed = mix64(seed + GOLDEN)
        rank = rank - np.log(uniform(seed))
        on = np.flatnonzero(rank <= limit)
        seed, rank, top, element, limit = seed[on], rank[on], top[on], element[on], limit[on]
        own = mix64(seed ^ np.uint64(0xDA27))
        hit = np.flatnonzero((top >= 1) | (uniform(mix64(own)) < top))
        out.append((element[hit], (own[hit] % np.uint64(t)).astype(np.int64), rank[hit], own[hit]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.uint64))


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], t: int) -> np.ndarray:
    """A row a set: the identity of the earliest dart of each of ``t`` coordinates; no set may be empty."""
    sig = np.zeros((len(sets), t), np.uint64)
    todo = np.arange(len(sets))
    until = np.array([(t * np.log(t) + 2 * t) / w.sum() for _, w in sets])
    while len(todo):
        h, w = (np.concatenate([sets[k][i] for k in todo]) for i in (0, 1))
        owner = np.repeat(np.arange(len(todo)), [len(sets[k][0]) for k in todo])
        element, at, rank, own = darts(h, w, until[todo][owner], t)
        slot = owner[element] * t + at
        order = np.lexsort((own, rank, slot))
        slot = slot[order]
        first = np.flatnonzero(np.diff(slot, prepend=-1))
        full = np.bincount(slot[first] // t, minlength=len(todo)) == t
        got = first[full[slot[first] // t]]
        sig[todo[full]] = own[order[got]].reshape(-1, t)
        todo = todo[~full]  # a coordinate was empty: look further
        until[todo] *= 1.5
    return sig


def signature(h: np.ndarray, w: np.ndarray, t: int) -> np.ndarray:
    return signatures([(h, w)], t)[0]


def bands_of(sigs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(sets, bands): a hash of each band's rows and number."""
    acc = np.tile(mix64(np.arange(bands, dtype=np.uint64) + GOLDEN), (len(sigs), 1))
    parts = sigs.reshape(len(sigs), bands, rows)
    for i in range(rows):
        acc = mix64(acc ^ parts[:, :, i]) + GOLDEN
    return acc


def sketches_of(sigs: np.ndarray) -> np.ndarray:
    """A bit of each of the first 64 coordinates."""
    bits = np.zeros((len(sigs), 64), bool)
    k = min(64, sigs.shape[1])
    bits[:, :k] = mix64(sigs[:, :k]) & np.uint64(1)
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= RADIUS


def raw_hash(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def signed_documents(docs: DataFrame, id_column: str, text: str, bands: int, rows: int, weights: str) -> DataFrame:
    """(id, raw, h1, h2, bytes, sketch, bands) per row: a hash of the raw text, the digest of its words; bands is empty where there are no words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for b in batches:
            h1, h2, size = [], [], []
            found: dict[bytes, int] = {}  # digest -> row of bands; copies are signed once a batch
            of: list[int] = []
            sets: list[tuple[np.ndarray, np.ndarray]] = []
            made: list[np.ndarray] = [np.empty((0, bands), np.uint64)]
            drawn: list[np.ndarray] = [np.empty(0, np.uint64)]
            held = 0

            def flush() -> None:
                if sets:
                    sigs = signatures(sets, bands * rows)
                    made.append(bands_of(sigs, bands, rows))
                    drawn.append(sketches_of(sigs))
                    sets.clear()

            for t in b.column(2):
                t = t.as_py()
                words = words_of(t)
                d = hashlib.blake2b(" ".join(words).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                if not words:
                    of.append(-1)
                else:
                    if d not in found:
                        found[d] = len(found)
                        sets.append(shingle_set(words, ids, weights))
                        held += len(words)
                        if held >= SIGNED_TOKENS:
                            flush()
                            held = 0
                    of.append(found[d])
                h1.append(int.from_bytes(d[:8], "big", signed=True))
                h2.append(int.from_bytes(d[8:], "big", signed=True))
                size.append(len(t or b""))
            flush()
            every, at = signed(np.concatenate(made)), np.array(of, np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.where(at < 0, 0, bands))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(every[at[at >= 0]].ravel(), pa.int64()))
            sketch = signed(np.append(np.concatenate(drawn), np.uint64(0))[at])
            cols = [b.column(0), b.column(1), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(size, pa.int64()), pa.array(sketch), lists]
            yield pa.RecordBatch.from_arrays(cols, ["id", "raw", "h1", "h2", "bytes", "sketch", "bands"])

    kind = docs.schema[id_column].dataType.simpleString()
    rows_in = docs.select(F.col(id_column).alias("id"), raw_hash(F.col(text)).alias("raw"), F.col(text).cast("binary").alias("text"))
    return rows_in.mapInArrow(sign, f"id {kind}, raw long, h1 long, h2 long, bytes long, sketch long, bands array<long>")


def jaccard_links(sets: list[tuple[np.ndarray, np.ndarray]], rest: np.ndarray, similarity: float) -> Forest:
    """Union-find over the pairs at ``similarity`` or above: all pairs of a unit but those among ``rest``, by blocks of the overlap matrix.

    Weighted overlap is summed layer by layer: an element of weight k is k columns. Overlaps come from a dense
    text-by-shingle matrix over a few thousand shingles at a time.
    """
    n = len(sets)
    forest = Forest(n)
    if n == 2:
        (a, wa), (b, wb) = sets
        both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        low = np.minimum(wa[i], wb[j]).sum()
        if low >= similarity * (wa.sum() + wb.sum() - low) - 1e-9:
            forest.join(0, 1)
        return forest
    cells, owners = [], []
    for k, (h, w) in enumerate(sets):
        whole = np.repeat(h, w.astype(np.int64))
        layer = np.arange(len(whole)) - np.repeat(np.cumsum(w.astype(np.int64)) - w.astype(np.int64), w.astype(np.int64))
        cells.append(mix64(whole ^ mix64(layer.astype(np.uint64) + GOLDEN)))
        owners.append(np.full(len(whole), k))
    size = np.array([len(c) for c in cells], np.float64)
    cell, owner = np.concatenate(cells), np.concatenate(owners)
    _, column, times = np.unique(cell, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner = owner[shared]
    _, column = np.unique(column[shared], return_inverse=True)
    overlap = np.zeros((n, n), np.float32)
    width = max(1, (8 << 20) // max(1, 4 * n))
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, (at, at + width))
        m = np.zeros((n, width), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        overlap += m @ m.T
    like = np.empty((n, n), bool)
    for at in range(0, n, 256):
        some = slice(at, at + 256)
        union = size[some, None] + size[None, :] - overlap[some]
        like[some] = (overlap[some] >= similarity * union - 1e-6) & ~(rest[some, None] & rest[None, :])
    left = np.ones(n, bool)  # a walk over the links, as a list of them may be quadratic
    for k in range(n):
        todo = [k] if left[k] else []
        left[k] = False
        while todo:
            i = todo.pop()
            found = np.flatnonzero(like[i] & left)
            left[found] = False
            for j in found.tolist():
                forest.join(i, j)
                todo.append(j)
    return forest


def verified_links(rows: DataFrame, similarity: float, weights: str) -> DataFrame:
    """(a, b) of a spanning forest of the links of each unit; ``rows`` are (unit, role, node, text)."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for t in runs(batches, "unit"):
            nodes, at = np.unique(t.column("node").to_numpy(), return_index=True)
            if len(nodes) < 2:
                continue
            texts = [t.column("text")[int(i)].as_py() for i in at]
            sets = [shingle_set(words_of(x), ids, weights) for x in texts]
            forest = jaccard_links(sets, t.column("role").to_numpy()[at] == 1, similarity)  # rows come by role within a node
            pairs = [(int(nodes[k]), int(nodes[forest.find(k)])) for k in range(len(nodes)) if forest.find(k) != k]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    return by_runs(rows.select("unit", "node", "role", "text"), "unit", verify, "a long, b long", "node", "role")


def texts_of(docs: DataFrame, picked: DataFrame, id_column: str, text: str) -> DataFrame:
    """(node, text): the whole texts of the nodes of ``picked`` (node, pick_id, pick_raw), by id and raw hash of their first rows.

    A filter of the wanted rows keeps most other texts out of the shuffle; the join settles which are wanted.
    """
    wanted = kept(picked.select(F.xxhash64("pick_id", "pick_raw").alias("key"), "node").distinct(), "wanted")
    sent = docs.sparkSession.sparkContext.broadcast(wanted_filter(wanted.select(F.col("key").alias("node"))))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(in_filter(sent.value, b.column(0).to_numpy())))

    rows = docs.select(F.xxhash64(F.col(id_column), raw_hash(F.col(text))).alias("key"), F.col(text).cast("binary").alias("text"))
    rows = rows.mapInArrow(pick, "key long, text binary").groupBy("key").agg(F.first("text").alias("text"))
    return rows.join(wanted.hint("merge"), "key").select("node", "text")


def near_rows(docs: DataFrame, id_column: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weights: str = "counts") -> DataFrame:
    """(id, raw, class_id, lead) per row of ``docs``: raw is ``raw_hash`` of the text, lead marks the rows equal to the one that stands for the class."""
    known = kept(signed_documents(docs, id_column, text, bands, rows, weights), "signed")
    # copies stand for each other: one row a digest, that of the least id (null ids last)
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "raw", "bytes", "sketch", "bands")).alias("first")
    copies = known.groupBy("h1", "h2").agg(first).select("h1", "h2", F.xxhash64("h1", "h2").alias("node"), "first")
    copies = kept(copies, "copies")
    banded = copies.select(F.explode("first.bands").alias("key"), "node", F.col("first.sketch").alias("sketch"))
    candidates = bucket_groups(banded, close)
    picked = copies.join(candidates.hint("merge"), "node").select("comp", "node", F.col("first.bytes").alias("bytes"), F.col("first.id").alias("pick_id"), F.col("first.raw").alias("pick_raw"))
    picked = kept(picked, "picked")
    texts = kept(texts_of(docs, picked, id_column, text), "texts")

    def links_in(units: DataFrame) -> DataFrame:
        # merged at every size: which side is small must not decide what a larger corpus costs
        return verified_links(texts.join(units.select("unit", "role", "node").hint("merge"), "node"), similarity, weights)

    links = compared(picked.select("comp", "node", "bytes"), links_in)
    classes = copies.join(components(links), "node", "left").select("h1", "h2", F.struct("first.no_id", "first.id", "first.raw").alias("first"), F.coalesce("comp", "node").alias("comp"))
    classes = kept(classes, "classes")
    named = classes.join(classes.groupBy("comp").agg(F.min("first").alias("of")), "comp").select("h1", "h2", "of")
    lead = F.col("id").eqNullSafe(F.col("of.id")) & (F.col("raw") == F.col("of.raw"))
    return known.select("id", "raw", "h1", "h2").join(named, ["h1", "h2"]).select("id", "raw", F.col("of.id").alias("class_id"), lead.alias("lead"))


def near_classes(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """(id, class_id, keep) per row of ``docs``; keep marks the row that stands for its class (and rows equal to it)."""
    return near_rows(docs, id_column, text, **settings).select(F.col("id").alias(id_column), "class_id", F.col("lead").alias("keep"))


def near_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """One row of each class of ``docs``, with all its columns: the row of the class's least id."""
    lead = near_rows(docs, id_column, text, **settings).where("lead").select(F.col("id").alias("__lead_id"), F.col("raw").alias("__lead_raw")).distinct()
    rows = docs.withColumn("__raw", raw_hash(F.col(text)))
    rows = rows.join(lead, F.col(id_column).eqNullSafe(F.col("__lead_id")) & (F.col("__raw") == F.col("__lead_raw")), "left_semi")
    return rows.dropDuplicates([id_column, "__raw"]).drop("__raw")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))

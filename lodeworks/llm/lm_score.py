"""Language-model scoring with a hashed maximum-entropy model over a class-factored softmax.

P(word | context) = P(class | context) * P(word | class). A word's class is a hash of it. P(class | context) is a softmax
whose features are a bias, the hashed previous word, the hashed previous two words and a skip feature (the word before
the previous one); its weights are trained by distributed gradient updates: each round, every task starts from the
broadcast weights, takes Adagrad steps over all its training tokens and the tasks' weights are averaged by their token
counts. Within a class only the word's own feature counts, whose maximum-entropy weights have a closed form: smoothed
relative counts. Every training token trains; each round takes one half of the training texts, so rounds make one epoch.

The table of hashed features is bounded, so contexts share its rows. Every context of the corpus also has a row of its own
with the counts of the classes after it, in closed form as well: by kind of context, skip feature first and two words last,
P = (count of the class + m * P so far) / (count of the context + m), from the softmax on. These rows grow with the corpus
and are never in one place. Chunks of texts ask for theirs (distinct keys and training counts, dealt out by ranges of
keys), a part sums what it is asked and answers every chunk, and a chunk's texts meet its answers.

Word counts grow with the corpus and are never broadcast whole. The most frequent words (``HEAD_WORDS`` at most) are; a
text's other words leave the scoring pass as rows and meet their counts in a shuffled join.

Defined results: a null or empty text is the end token alone; a null id counts as the empty text when ids are divided
into training and held-out; a class without training words gives its unknown-word share to any word; with no training
text at all every weight is zero and counts are zero, so both scores stay finite; repeated rows are scored each; empty
tables give empty tables; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_runs, kept, mix64, runs, table

CLASSES = 32
FEATURE_ROWS = 1 << 14
HEAD_WORDS = 200_000
ROUNDS = 2
RATE = 0.05
BATCH = 8192
#: Weight tables that are summed in one place.
FAN_IN = 8
#: Tokens that a task holds as Python objects at a time, and distinct words it remembers.
HELD_TOKENS, HELD_WORDS = 200_000, 400_000
#: Bytes of text that ask for contexts together, and training tokens to a part of the keys.
CHUNK_BYTES, PART_TOKENS = 4 << 20, 1_000_000
#: Weight of the lower order in the counts of a context: skip feature, previous word, previous two words.
LOWER = (32.0, 8.0, 4.0)
#: Bits of a context's key beyond those that number all tokens' contexts, and bits of a class.
SPARE_BITS, CLASS_BITS = 10, 5
#: The end token; no word is empty.
END = b""
LOG10E = float(np.log10(np.e))


def tokens_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, split on ASCII white space (what bytes.lower and bytes.split do), then the end token."""
    words = text.lower().split() if text else []
    words.append(END)
    return words


def remainder(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5))


class Words(dict):
    """word -> small index into arrays of hashes, classes and (if given) head counts; -1 counts as "not in the head"."""

    def __init__(self, head: dict[bytes, int] | None = None):
        super().__init__()
        self.head, self.names = head or {}, []
        self.hashes, self.counts = [], []
        self.done = 0
        self.h = np.empty(0, np.uint64)
        self.c = np.empty(0, np.int64)

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self.names)
        self.names.append(word)
        self.hashes.append(xxhash.xxh3_64_intdigest(word))
        self.counts.append(self.head.get(word, -1))
        return k

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self.names) > HELD_WORDS:
            self.clear()
            self.names, self.hashes, self.counts, self.done = [], [], [], 0
            self.h, self.c = np.empty(0, np.uint64), np.empty(0, np.int64)
        ids = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.done < len(self.names):
            self.h = np.concatenate([self.h, np.array(self.hashes[self.done :], np.uint64)])
            self.c = np.concatenate([self.c, np.array(self.counts[self.done :], np.int64)])
            self.done = len(self.names)
        return ids


def class_of(h: np.ndarray) -> np.ndarray:
    return (mix64(h ^ np.uint64(0x5EED)) % np.uint64(CLASSES)).astype(np.int64)


def context_hashes(h: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Hashes of each token's previous word, previous two words and the word before that. ``starts`` marks the first token of a text."""
    n = len(h)
    one = np.empty(n, np.uint64)
    one[0], one[1:] = 1, h[:-1]
    one[starts] = 1
    two = np.empty(n, np.uint64)
    two[0], two[1:] = 2, one[:-1]
    two[starts] = 2
    return [mix64(x) for x in (one ^ np.uint64(0xA11CE), mix64(one) + two, two ^ np.uint64(0xB0B5))]


def contexts(hashes: list[np.ndarray]) -> list[np.ndarray]:
    """Rows of the weight table that each token's features hash to."""
    rows = np.uint64(FEATURE_ROWS)
    return [(x % rows).astype(np.uint16) for x in hashes]


def context_keys(hashes: list[np.ndarray], kind: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """Keys of every token's context with its class, one kind of context at a time, ascending: skip feature, previous word, previous two words."""
    one, two, skip = hashes
    kind = kind.astype(np.uint64)
    for k, x in enumerate((skip, one, two)):
        yield (x >> np.uint64(64 - bits) | np.uint64(k << bits)) << np.uint64(CLASS_BITS) | kind


def key_bits(n_all: int) -> int:
    """Bits of a context's key: so many that a corpus of ``n_all`` training tokens leaves next to no two contexts with one key."""
    return min(56, (3 * n_all + 1).bit_length() + SPARE_BITS)


def packed(x: np.ndarray) -> bytes:
    """64-bit numbers by planes of bytes, compressed."""
    return pa.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True) if len(x) else b""


def unpacked(raw: bytes, n: int) -> np.ndarray:
    if not n:
        return np.empty(0, np.uint64)
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def firsts(x: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    return np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.empty(0, np.int64)


def sums_at(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, first) if len(first) else x[:0]


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of about ``CHUNK_BYTES`` of text, numbered by partition and first row; rows are (id, held_out, text, partition)."""
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        if key is None:
            key = b.column(3)[0].as_py() << 40
        b = b.select([0, 1, 2])
        size = pc.fill_null(pc.binary_length(b.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = firsts((np.cumsum(size) - size) // CHUNK_BYTES)
        for at, end in zip(cuts, np.append(cuts[1:], len(size)), strict=True):
            yield key + int(at), b.slice(at, end - at)
        key += len(size)


def context_rows(rows: DataFrame, n_all: int) -> DataFrame:
    """(chunk, part, n, digest, a, b): for each chunk its texts (part -1; Arrow stream in ``a``) and, by part, the training counts of its keys.

    ``rows`` are (id, held_out, text) and are read twice, so their order must not change. A chunk's distinct keys ascend over its parts; in
    an answer ``a`` has the counts of its keys and ``b`` those of their contexts. ``digest`` is one of all keys of the chunk.
    """
    # a task's number counts the tables of a union through, that of a partition doesn't
    rows = rows.withColumn("partition", F.spark_partition_id())
    shuffles = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = min(1 << 16, max(1, n_all // PART_TOKENS, min(2 * shuffles, n_all // 50_000)))
    bits = key_bits(n_all)
    schema = "chunk long, part long, n long, digest long, a binary, b binary"
    names = ["chunk", "part", "n", "digest", "a", "b"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for chunk, batch in chunks(batches):
            h, first = [], []
            for _, _, texts in groups([batch], 2):
                flat_words, starts = flat(texts)
                first.append(starts + sum(map(len, h)))
                ids = words.of(flat_words)
                h.append(words.h[ids])
            h, first = np.concatenate(h), np.concatenate(first)
            train = ~batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            train = np.repeat(train, np.diff(np.append(first, len(h)))).astype(np.uint64)
            keys, counts = [], []
            for key in context_keys(context_hashes(h, first), class_of(h), bits):
                key <<= np.uint64(1)
                key |= train
                key.sort()
                at = firsts(key >> np.uint64(1))
                counts.append(sums_at(key & np.uint64(1), at))
                keys.append(key[at] >> np.uint64(1))
            key, n = np.concatenate(keys), np.concatenate(counts)
            part = part_of(key, bits, parts)
            cuts = firsts(part)
            ends = np.append(cuts[1:], len(key))
            mark = digest(key)
            cols = [[], []]
            for x, y in zip(cuts, ends, strict=True):
                cols[0].append(packed(np.diff(key[x:y], prepend=np.uint64(0))))
                cols[1].append(packed(n[x:y]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(cuts), chunk)), pa.array(part[cuts].astype(np.int64)), pa.array(ends - cuts), pa.array(np.full(len(cuts), mark)), pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary())],
                names,
            )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "part"):
            size = t.column("n").to_numpy()
            key = np.concatenate([np.cumsum(unpacked(x.as_py(), m), dtype=np.uint64) for x, m in zip(t.column("a"), size, strict=True)])
            n = np.concatenate([unpacked(x.as_py(), m) for x, m in zip(t.column("b"), size, strict=True)])
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            found = []
            for x in (key, key >> np.uint64(CLASS_BITS)):
                at = firsts(x)
                back = np.empty(len(x), np.uint64)
                back[order] = np.repeat(sums_at(n, at), np.diff(np.append(at, len(x))))
                found.append(np.split(back, np.cumsum(size)[:-1]))
            packs = [pa.array([packed(x) for x in f], pa.binary()) for f in found]
            one = t.combine_chunks()
            yield pa.RecordBatch.from_arrays([*(one.column(c).combine_chunks() for c in names[:4]), *packs], names)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, batch in chunks(batches):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_batch(batch)
            raw = sink.getvalue().to_pybytes()
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([-1]), pa.array([0]), pa.array([0]), pa.array([raw], pa.binary()), pa.array([None], pa.binary())], names)

    answers = by_runs(rows.mapInArrow(ask, schema), "part", answer, schema)
    return answers.unionByName(rows.mapInArrow(texts, schema))


def part_of(key: np.ndarray, bits: int, parts: int) -> np.ndarray:
    """Parts are ranges of keys; a kind of context has a third of them, about."""
    top = min(bits, 32)
    return (key >> np.uint64(CLASS_BITS + bits - top)) * np.uint64(parts) // np.uint64(3 << top)


def digest(key: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(key.tobytes()) >> 1


def groups(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, list[list[bytes]]]]:
    """Rows a few at a time: batch, first row, their tokens."""
    for b in batches:
        held, n, first = [], 0, 0
        for i, text in enumerate(b.column(column)):
            t = tokens_of(text.as_py())
            held.append(t)
            n += len(t)
            if n >= HELD_TOKENS:
                yield b, first, held
                held, n, first = [], 0, i + 1
        if held:
            yield b, first, held


def flat(texts: list[list[bytes]]) -> tuple[list[bytes], np.ndarray]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    return [w for t in texts for w in t], np.cumsum(sizes) - sizes


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, class, c) of the training tokens; rows of ``docs`` are (text bytes). Tasks send a row a distinct word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, sums = Words(), np.zeros(0, np.int64)

        def out() -> pa.RecordBatch:
            kind = class_of(words.h) if len(words.h) else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(words.names, pa.binary()), pa.array(kind, pa.int64()), pa.array(sums, pa.int64())], ["word", "class", "c"])

        for _, _, texts in groups(batches, 0):
            if len(words.names) > HELD_WORDS - HELD_TOKENS:
                yield out()
                words, sums = Words(), np.zeros(0, np.int64)
            ids = words.of(flat(texts)[0])
            more = np.bincount(ids, minlength=len(words.names))
            more[: len(sums)] += sums
            sums = more
        yield out()

    return docs.mapInArrow(count, "word binary, class long, c long").groupBy("word", "class").agg(F.sum("c").alias("c"))


def head_of(counts: DataFrame, most: int = HEAD_WORDS) -> dict[bytes, int]:
    """Every word at or above the least count that keeps the head within ``most`` words."""
    step = F.floor(F.log2(F.col("c").cast("double")) * 8).cast("long")
    sizes = sorted(((r["step"], r["n"], r["least"]) for r in counts.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("c").alias("least")).collect()), reverse=True)
    total, least = 0, None
    for _, n, low in sizes:
        if total + n > most:
            break
        total, least = total + n, low
    if least is None:
        return {}
    t = counts.where(F.col("c") >= least).select("word", "c").toArrow()
    return dict(zip(t.column("word").to_pylist(), t.column("c").to_pylist(), strict=True))


def logits_of(w: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    z = w.take(rows[0], axis=0)
    for r in rows[1:]:
        z += w.take(r, axis=0)
    z += bias
    z -= z.max(axis=1, keepdims=True)
    return z


def row_sums(rows: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the sums of ``g`` over each."""
    order = np.argsort(rows, kind="stable")  # 16-bit rows take a radix sort
    ordered = rows[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    return ordered[first], np.add.reduceat(g.take(order, axis=0), first, axis=0)


def train_round(docs: DataFrame, weights: np.ndarray, bias: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights after one round: local Adagrad steps from the given weights, averaged by token counts in a tree."""
    spark = docs.sparkSession
    start = spark.sparkContext.broadcast((weights, bias))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = (x.copy() for x in start.value)
        aw, ab = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
        words, seen = Words(), 0
        for _, _, texts in groups(batches, 0):
            flat_words, first = flat(texts)
            ids = words.of(flat_words)
            h = words.h[ids]
            rows, y = contexts(context_hashes(h, first)), class_of(words.h)[ids]
            seen += len(ids)
            for at in range(0, len(ids), BATCH):
                part, target = [r[at : at + BATCH] for r in rows], y[at : at + BATCH]
                g = np.exp(logits_of(w, b, part))
                g /= g.sum(axis=1, keepdims=True)
                g[np.arange(len(target)), target] -= 1
                gb = g.sum(axis=0)
                ab += gb * gb
                b -= RATE * gb / np.sqrt(ab)
                for r in part:
                    u, gu = row_sums(r, g)
                    au = aw.take(u, axis=0) + gu * gu
                    aw[u] = au
                    w[u] -= RATE * gu / np.sqrt(au)
        if seen:
            both = np.vstack([w, b[None]]).astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays([pa.array([seen], pa.int64()), pa.array([both.astype(np.float32).tobytes()], pa.binary())], ["n", "w"])

    def summed(a, b):
        return a[0] + b[0], a[1] + b[1]

    # a tree of fixed fan-in: no task and not the driver gets more than a few weight tables, however many tasks trained
    parts = docs.mapInArrow(local, "n long, w binary").rdd.map(lambda r: (r["n"], np.frombuffer(bytes(r["w"]), np.float32).astype(np.float64)))
    left = parts.getNumPartitions()
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        parts = parts.mapPartitionsWithIndex(lambda i, rows, m=left: ((i % m, x) for x in rows)).reduceByKey(summed, left).values()
    n, total = parts.fold((0, 0.0), summed)
    start.unpersist()
    if not n:
        return weights, bias
    both = (total / n).astype(np.float32).reshape(-1, CLASSES)
    return both[:-1].copy(), both[-1].copy()


def lm_scores(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score per row of ``docs``; learns from rows whose id's remainder isn't 1."""
    spark = docs.sparkSession
    if "Relation" not in docs._jdf.queryExecution().optimizedPlan().nodeName():  # only a plain scan is sure to give its rows in one order
        docs = kept(docs.select(id_column, text), "docs")
    rest = remainder(F.col(id_column))
    raw = F.col(text).cast("binary").alias("text")
    train = docs.where(rest != 1)
    counts = kept(word_counts(train.select(raw)), "counts")
    per_class = {r["class"]: (r["n"], r["v"]) for r in counts.groupBy("class").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    n_class, v_class = (np.array([per_class.get(k, (0, 0))[i] for k in range(CLASSES)], np.float64) for i in (0, 1))
    n_all, v_all = int(n_class.sum()), int(v_class.sum())
    head = head_of(counts)

    weights = np.zeros((FEATURE_ROWS, CLASSES), np.float32)
    bias = np.log((n_class + 0.5) / (n_all + 0.5 * CLASSES)).astype(np.float32)
    half = F.pmod(F.xxhash64(id_column), F.lit(ROUNDS))
    for k in range(ROUNDS):
        weights, bias = train_round(train.where(half == k).select(raw), weights, bias)

    sent = spark.sparkContext.broadcast((head, weights, bias))
    base_denominator = float(np.log10(n_all + 0.5 * (v_all + 1)))
    class_denominator = np.log10(n_class + 0.5 * (v_class + 1))

    bits = key_bits(n_all)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_head, w, b = sent.value
        words = Words(known_head)
        for t in runs(batches, "chunk"):
            chunk, marks, size = t.column("chunk")[0].as_py(), t.column("digest").to_numpy()[1:], t.column("n").to_numpy()[1:]
            if t.column("part")[0].as_py() != -1:
                raise RuntimeError("rows of the input changed their order between two reads")
            batch = pa.ipc.open_stream(t.column("a")[0].as_py()).read_all().combine_chunks().to_batches()[0]
            n_key, n_context = (np.concatenate([unpacked(x.as_py(), m) for x, m in zip(t.column(c)[1:], size, strict=True)]).astype(np.float64) for c in "ab")
            h, c, first, tails, tail_ends, seen = [], [], [], [], [], 0
            for _, _, texts in groups([batch], 2):
                flat_words, starts = flat(texts)
                ids = words.of(flat_words)
                h.append(words.h[ids])
                c.append(words.c[ids])
                first.append(starts + seen)
                loose = np.flatnonzero(c[-1] < 0)
                tail_ends.append(np.searchsorted(loose, np.append(starts[1:], len(ids))) + len(tails))
                tails += [flat_words[i] for i in loose]
                seen += len(ids)
            h, c, first = np.concatenate(h), np.concatenate(c), np.concatenate(first)
            hashes, kind = context_hashes(h, first), class_of(h)
            rows = contexts(hashes)
            of_class = np.empty(len(h))
            for at in range(0, len(h), BATCH):
                z = np.exp(logits_of(w, b, [r[at : at + BATCH] for r in rows]))
                y = kind[at : at + BATCH]
                of_class[at : at + BATCH] = z[np.arange(len(y)), y] / z.sum(axis=1)
            asked, done = [], 0
            for key, m in zip(context_keys(hashes, kind, bits), LOWER, strict=True):
                order = np.argsort(key)
                key = key[order]
                at = firsts(key)
                asked.append(key[at])
                mine = slice(done, done + len(at))
                done = mine.stop
                if done > len(n_key):
                    break
                many = np.diff(np.append(at, len(key)))
                of_class[order] = (np.repeat(n_key[mine], many) + m * of_class[order]) / (np.repeat(n_context[mine], many) + m)
            if done != len(n_key) or (marks != digest(np.concatenate(asked))).any():
                raise RuntimeError("rows of the input changed their order between two reads")
            own = np.where(c >= 0, np.log10(np.maximum(c, 0) + 0.5), 0.0)
            n = np.diff(np.append(first, len(h)))
            base = np.add.reduceat(own - base_denominator, first)
            model = np.add.reduceat(np.log10(of_class) + own - class_denominator[kind], first)
            known = np.add.reduceat((c > 0).astype(np.int64), first)
            offsets = np.append(0, np.concatenate(tail_ends)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunk + np.arange(len(n)), pa.int64()), batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(model), pa.ListArray.from_arrays(pa.array(offsets), pa.array(tails, pa.binary()))],
                ["key", "id", "held_out", "n_tokens", "n_known", "base", "model", "tail"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    rows = docs.select(F.col(id_column).alias("id"), (rest == 1).alias("held_out"), raw)
    spark._jvm.System.gc()  # lets Spark delete the shuffle files of what is done, before the largest shuffle
    scored = by_runs(context_rows(rows, n_all), "chunk", score, f"key long, id {kind}, held_out boolean, n_tokens long, n_known long, base double, model double, tail array<binary>", "part")
    scored = kept(scored, "scored")
    tails = scored.select("key", F.explode("tail").alias("word")).join(counts.select("word", "c"), "word", "left")
    found = tails.groupBy("key").agg(F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(0.5))).alias("more"), F.count("c").alias("known"))
    more = F.coalesce("more", F.lit(0.0))
    return scored.drop("tail").join(found, "key", "left").select(
        F.col("id").alias(id_column),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"),
        (F.col("model") + more).alias("score"),
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))

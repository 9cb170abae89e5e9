"""Benchmark decontamination: a BM25 index of test items, block-max WAND, and overlap checks.

Test items are indexed by BM25 impacts, each divided by the item's threshold (a share of the score that the whole item
gets of itself), so an item is retrieved when its impacts sum to 1 or more. Every training text is cut into overlapping
passages; each passage is a query to block-max WAND: its upper bound, the sum of its terms' greatest impacts, must reach
1, then that of each block of items, the sum of the terms' maxima in the block; blocks below are skipped whole and only
the postings of the others are scored. Bounds never fall below scores, so every item at or above its threshold is
retrieved. A retrieved item counts if enough of its question (5-word shingles) and of its answer (words) stands in the
text. The question is the item without its last line or, in an item of one line, without the last quarter of its words.

Items come in blocks of bounded size; each block's index (arrays of postings, impacts and shingle hashes, and one entry
for each distinct word) is broadcast and every text is held against each block. Words are lower-cased in A-Z only and cut at
ASCII white space, in texts, items and document frequencies alike.

Defined results: null and empty texts and items without words match nothing; an item shorter than five words is one
shingle; long texts and long items are compared whole (items are indexed in parts); repeated items are found each under
their own id, repeated texts each; an empty table on either side gives no match; columns of the texts pass through.
"""

from __future__ import annotations

import math
import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import ASCII_SPACE, table, window_hashes

K1, B = 1.2, 0.75
#: Share of an item's own score that a passage must reach.
RETRIEVE = 0.5
#: Shares of the question's shingles and of the answer's words that must stand in the text.
QUESTION, ANSWER = 0.5, 0.5
SHINGLE = 5
#: Words of an indexed part, parts of a block, bytes of item text in a broadcast index.
PART_WORDS, POSTING_BLOCK, INDEX_BYTES = 128, 8, 4 << 20


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []


def shingles(words: list[bytes], size: int = SHINGLE) -> set[tuple[bytes, ...]]:
    if len(words) < size:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(size)), strict=False))


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """Distinct hashes of the shingles, ascending."""
    return np.unique(window_hashes(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)), size))


def halves(text: bytes) -> tuple[list[bytes], list[bytes]]:
    """Words of the question and of the answer."""
    lines = [x for x in (words_of(line) for line in text.split(b"\n")) if x]
    if len(lines) > 1:
        return [w for x in lines[:-1] for w in x], lines[-1]
    words = lines[0] if lines else []
    cut = len(words) - max(1, len(words) // 4)
    return (words[:cut], words[cut:]) if cut > 0 else (words, words)


class Index:
    """Postings of (part, impact / threshold) with block maxima."""

    def __init__(self, items: list[tuple[int, bytes]], df: dict[bytes, int], n: int, average: float):
        self.items = []
        parts: list[tuple[int, Counter[bytes], int]] = []
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            q, a = halves(text)
            self.items.append((item_id, shingle_hashes(q), min(len(q), SHINGLE), frozenset(a)))
            for at in range(0, len(words), PART_WORDS):
                part = words[at : at + PART_WORDS]
                parts.append((len(self.items) - 1, Counter(part), len(part)))
        self.item_of = [k for k, _, _ in parts]
        self.part_words = max((size for _, _, size in parts), default=1)
        lists: dict[bytes, list[tuple[int, float]]] = defaultdict(list)
        for p, (_, tf, size) in enumerate(parts):
            impact = {w: math.log(1 + (n - df.get(w, 0) + 0.5) / (df.get(w, 0) + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / average)) for w, f in tf.items()}
            least = RETRIEVE * sum(impact.values())
            for w, x in impact.items():
                lists[w].append((p, x / least))
        self.words = {w: k for k, w in enumerate(lists)}
        self.n_parts, self.n_blocks = len(parts), -(-len(parts) // POSTING_BLOCK)
        # postings of all terms one after the other, each term's by part; the same for its block maxima
        sizes = np.array([len(x) for x in lists.values()], np.int64)
        self.start, self.size = np.cumsum(sizes) - sizes, sizes
        self.part = np.array([p for x in lists.values() for p, _ in x], np.int64)
        self.impact = np.array([x for y in lists.values() for _, x in y], np.float64)
        maxima: list[dict[int, float]] = []
        for x in lists.values():
            top: dict[int, float] = {}
            for p, y in x:
                top[p // POSTING_BLOCK] = max(top.get(p // POSTING_BLOCK, 0.0), y)
            maxima.append(top)
        sizes = np.array([len(x) for x in maxima], np.int64)
        self.block_start, self.block_size = np.cumsum(sizes) - sizes, sizes
        self.block = np.array([k for x in maxima for k in x], np.int64)
        self.block_max = np.array([y for x in maxima for y in x.values()], np.float64)
        self.most = np.array([max(x.values()) for x in maxima] + [0.0])  # the last is that of unknown words

    @staticmethod
    def spans(start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Indices of several runs of a flat array."""
        ends = np.cumsum(size)
        return np.arange(ends[-1]) + np.repeat(start - (ends - size), size)

    def retrieve(self, terms: np.ndarray) -> dict[int, float]:
        """part -> score / threshold of every part at 1 or more.

        Block-max pruning: terms whose greatest impacts can't sum to 1 end the query; a block of parts whose terms'
        block maxima don't sum to 1 is skipped; only parts of the other blocks are scored from their postings.
        """
        least = 1 - 1e-9
        if not len(terms) or self.most[terms].sum() < least:
            return {}
        at = self.spans(self.block_start[terms], self.block_size[terms])
        live = np.bincount(self.block[at], self.block_max[at], self.n_blocks) >= least
        if not live.any():
            return {}
        at = self.spans(self.start[terms], self.size[terms])
        at = at[live[self.part[at] // POSTING_BLOCK]]
        score = np.bincount(self.part[at], self.impact[at], self.n_parts)
        return {int(p): float(score[p]) for p in np.flatnonzero(score >= least)}

    def leaks(self, text: bytes | None) -> list[tuple[int, float, float, float]]:
        """(item, best score as a share of its own, question overlap, answer overlap) of the items that stand in the text."""
        words = words_of(text)
        if not words or not self.words:
            return []
        get, unknown = self.words.get, len(self.words)
        ids = np.fromiter((get(w, unknown) for w in words), np.int64, len(words))
        bound = np.concatenate([[0.0], np.cumsum(self.most[ids])])
        step = self.part_words
        starts = np.arange(0, max(1, len(words) - step), step)
        stops = np.minimum(starts + 2 * step, len(words))
        best: dict[int, float] = {}
        for k in np.flatnonzero(bound[stops] - bound[starts] >= 1 - 1e-6):
            terms = np.unique(ids[starts[k] : stops[k]])
            for p, score in self.retrieve(terms[terms != unknown]).items():
                i = self.item_of[p]
                best[i] = max(best.get(i, 0.0), score)
        if not best:
            return []
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        known, mine = set(words), {}
        out = []
        for i, score in sorted(best.items()):
            item_id, question, size, answer = self.items[i]
            if size not in mine:  # a question of fewer words than a shingle is one shingle of its size
                mine[size] = np.unique(window_hashes(h, size)) if size <= len(words) else np.empty(0, np.uint64)
            q = len(np.intersect1d(question, mine[size], assume_unique=True)) / max(1, len(question))
            a = len(answer & known) / max(1, len(answer))
            if q >= QUESTION and a >= ANSWER:
                out.append((item_id, score * RETRIEVE, q, a))
        return out


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the items in blocks of about ``INDEX_BYTES``; document frequencies are those of all items."""
    items = benchmark.select("item_id", F.col("text").cast("binary").alias("text"))
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-size // INDEX_BYTES))
    lower = F.translate(F.col("text").cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    words = items.select(F.array_distinct(F.filter(F.split(lower, ASCII_SPACE), lambda w: w != "")).alias("w"))
    total = items.select(F.sum(F.regexp_count(F.col("text").cast("string"), F.lit(r"[^\x20\x09-\x0D]+")))).first()[0] or 1
    df = words.select(F.explode("w").alias("w")).groupBy("w").count()
    for k in range(blocks):
        rows = [(r["item_id"], bytes(r["text"] or b"")) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]
        mine = {w for _, t in rows for w in words_of(t)}
        known = df if blocks == 1 else df.join(F.broadcast(benchmark.sparkSession.createDataFrame([(w.decode(),) for w in mine] or [("",)], "w string")), "w")
        yield Index(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1])), {r["w"].encode(): r["count"] for r in known.collect()}, max(n, 1), total / max(n, 1))


LEAK = "array<struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double>>"


def with_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", column: str = "leaks") -> DataFrame:
    """``docs`` with a list of the test items that stand in each text; a column of that name is replaced."""
    spark = docs.sparkSession
    docs = docs.drop(column)
    out = docs.withColumn(column, F.array().cast(LEAK))
    for index in indexes(benchmark):
        sent = spark.sparkContext.broadcast(vars(index))  # plain data: a broadcast isn't pickled by value
        schema = T.StructType([f for f in out.schema if f.name != column] + [T.StructField(column, T._parse_datatype_string(LEAK))])
        kind = to_arrow_schema(schema).field(column).type
        at, so_far = out.columns.index(text), out.columns.index(column)

        def find(batches: Iterator[pa.RecordBatch], sent=sent, at=at, so_far=so_far, kind=kind, names=tuple(out.columns)) -> Iterator[pa.RecordBatch]:
            index = Index.__new__(Index)
            vars(index).update(sent.value)
            for b in batches:
                rows = []
                for old, t in zip(b.column(so_far).to_pylist(), b.column(at), strict=True):
                    t = t.as_py()
                    new = index.leaks(t.encode() if t is not None else None)
                    rows.append(old + [dict(zip(("item_id", "score", "question_overlap", "answer_overlap"), x, strict=True)) for x in new])
                cols = [pa.array(rows, kind) if i == so_far else c for i, c in enumerate(b.columns)]
                yield pa.RecordBatch.from_arrays(cols, list(names))

        out = out.mapInArrow(find, schema)
    return out


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per (document, test item in it)."""
    found = with_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("x")).select("doc_id", "x.item_id", "x.score", "x.question_overlap", "x.answer_overlap")

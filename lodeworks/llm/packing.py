"""Variable-capacity best-fit packing of token counts into sequences of several permitted lengths.

Pieces (documents, longer ones cut at the largest length) are dealt out by hash to shards of a bounded size. Each shard
is packed by best-fit in decreasing order: a piece goes to the open bin with the least room that still takes it; where
none does, the least-cost bin size opens: the one with the least cost a token that the remaining pieces can put in it.
The permitted lengths are optimised jointly: packings with each length as the largest that may open are compared by
their total cost and the cheapest stays. Finally every bin is downsized to the least permitted length that holds its
contents. A bin costs a fixed part and its length, padding included.

Defined results: a text without words has one row with no bin; a null id is packed like any other; ties go by id and
piece; repeated rows are pieces of their own; an empty table gives an empty table; only id and length (or text) are read.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_runs, runs, table

#: Permitted sequence lengths and the fixed cost of a sequence, in tokens.
SIZES = (512, 1024, 2048, 4096)
FIXED_COST = 32
#: Pieces of a shard, about: the bound of what one task packs.
SHARD_PIECES = 20_000


def cost(size: int, fixed: int = FIXED_COST) -> int:
    return fixed + size


def best_fit(lengths: Sequence[int], sizes: Sequence[int], fixed: int = FIXED_COST) -> tuple[list[int], list[int]]:
    """(bin of each piece, contents of each bin) for lengths in decreasing order; ``sizes`` ascending, the last holds every piece."""
    room: list[int] = []  # distinct rooms of open bins, ascending
    bins: dict[int, list[int]] = {}
    contents: list[int] = []
    put: list[int] = []
    left = sum(lengths)
    for n in lengths:
        k = bisect_left(room, n)
        if k < len(room):
            r = room[k]
            b = bins[r].pop()
            if not bins[r]:
                del bins[r], room[k]
        else:
            # what is left can fill a bin up to min(size, left)
            r = min((s for s in sizes if s >= n), key=lambda s: (cost(s, fixed) / min(s, left), s))
            b = len(contents)
            contents.append(0)
        contents[b] += n
        put.append(b)
        left -= n
        if r > n:
            if r - n not in bins:
                bins[r - n] = []
                insort(room, r - n)
            bins[r - n].append(b)
    return put, contents


def least_size(content: int, sizes: Sequence[int]) -> int:
    return sizes[bisect_left(sizes, content)]


def pack(lengths: Sequence[int], sizes: Sequence[int] = SIZES, fixed: int = FIXED_COST) -> tuple[list[int], list[int]]:
    """(bin of each piece, size of each bin), the cheapest over the choices of the largest length that may open."""
    best = None
    for k in range(len(sizes)):
        if lengths and sizes[k] < lengths[0]:
            continue
        put, contents = best_fit(lengths, sizes[: k + 1], fixed)
        final = [least_size(c, sizes) for c in contents]
        total = sum(cost(s, fixed) for s in final)
        if best is None or total < best[0]:
            best = total, put, final
    return (best[1], best[2]) if best else ([], [])


def pieces_of(docs: DataFrame, n_tokens: Column, id_column: str = "doc_id", largest: int = SIZES[-1]) -> DataFrame:
    """(id, piece, start, n_tokens): texts longer than ``largest`` are cut; nothing is dropped."""
    cut = docs.select(F.col(id_column).alias("id"), n_tokens.cast("long").alias("n"))
    many = F.greatest(F.ceil(F.col("n") / F.lit(largest)).cast("long"), F.lit(1).cast("long"))
    rows = cut.select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), many - 1)).alias("piece"))
    start = F.col("piece") * largest
    return rows.select("id", "piece", start.alias("start"), F.least(F.lit(largest).cast("long"), F.col("n") - start).alias("n_tokens"))


def pack_documents(docs: DataFrame, n_tokens: Column, id_column: str = "doc_id", sizes: Sequence[int] = SIZES, fixed: int = FIXED_COST, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """id, piece, start, n_tokens, bin_id, bin_size, offset: a row per piece of each row of ``docs``."""
    sizes = sorted(sizes)
    pieces = pieces_of(docs, n_tokens, id_column, sizes[-1])
    n = pieces.count()
    shards = max(1, -(-n // shard_pieces))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece", F.monotonically_increasing_id()), F.lit(shards)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, "shard"):
            t = t.sort_by([("n_tokens", "descending"), ("id", "ascending"), ("piece", "ascending")])
            lengths = t.column("n_tokens").to_numpy()
            worded = int((lengths > 0).sum())
            put, final = pack(lengths[:worded].tolist(), sizes, fixed)
            shard = t.column("shard")[0].as_py()
            at = np.zeros(worded, np.int64)
            order = np.argsort(np.array(put, np.int64), kind="stable")
            if worded:
                b, s = np.array(put)[order], lengths[:worded][order]
                run = np.array(list(accumulate(s.tolist())), np.int64) - s
                first = np.flatnonzero(np.diff(b, prepend=-1))
                at[order] = run - np.repeat(run[first], np.diff(np.append(first, worded)))
            none = [None] * (len(lengths) - worded)
            cols = [pa.array([shard << 32 | x for x in put] + none, pa.int64()), pa.array([final[x] for x in put] + none, pa.int64()), pa.array(at.tolist() + none, pa.int64())]
            yield from pa.Table.from_arrays([t.column(c) for c in ("id", "piece", "start", "n_tokens")] + [pa.chunked_array([c]) for c in cols], ["id", "piece", "start", "n_tokens", "bin_id", "bin_size", "offset"]).combine_chunks().to_batches()

    kind = docs.schema[id_column].dataType.simpleString()
    out = by_runs(dealt, "shard", packed, f"id {kind}, piece long, start long, n_tokens long, bin_id long, bin_size long, offset long")
    return out.withColumnRenamed("id", id_column)


def packed_sequences(docs: DataFrame, packed: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """bin_id, bin_size, tokens, bounds: each sequence's words in order, and for each piece (id, piece, offset, n_tokens).

    ``packed`` is what ``pack_documents`` made of the words of ``docs``, whose ids are distinct. A sequence holds at most
    ``bin_size`` words, so a row is bounded; pieces without a bin (texts without words) give none.
    """
    words = docs.select(F.col(id_column).alias("__id"), F.regexp_extract_all(F.col(text), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)).alias("__w"))
    cut = packed.where("bin_id is not null").join(words, F.col(id_column).eqNullSafe(F.col("__id")))
    held = F.slice("__w", F.col("start").cast("int") + 1, F.col("n_tokens").cast("int"))
    rows = cut.groupBy("bin_id", "bin_size").agg(F.array_sort(F.collect_list(F.struct("offset", F.col(id_column).alias("id"), "piece", "n_tokens", held.alias("words")))).alias("p"))
    bounds = F.transform("p", lambda x: F.struct(x["id"].alias("id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["n_tokens"].alias("n_tokens")))
    return rows.select("bin_id", "bin_size", F.flatten(F.transform("p", lambda x: x["words"])).alias("tokens"), bounds.alias("bounds"))


def word_count(text: Column) -> Column:
    """Tokens of a text: its words between ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), word_count(F.col("text")))

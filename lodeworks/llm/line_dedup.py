"""Fuzzy line deduplication: hashed sketches of lines, joined on blocks, edit similarity, one occurrence per connected group.

Lines (split at ``\\n``, of two words or of ``MIN_BYTES`` bytes or more) are normalised: lower-cased, runs of ASCII white
space made one space. Lines equal after that are one node. Two nodes link if the edit similarity of the normalised lines,
1 - distance / length of the longer, is 0.8 or more. Of each connected group of links the first occurrence in the corpus
(least document id, then line) stays; the others are removed from their texts.

Candidates: a line's fingerprint is a row of MinHash values over its grams of bytes, cut into blocks: two values, the next
block's first, the distance of the two in the line and about the place of the first (from the line's start in one half of
the blocks, from its end in the other). Lines that agree in a block meet in a bucket. Short lines, of which an edit changes a greater
share, have shorter grams; of long lines a quarter of the grams, picked by hash, takes part (``SCHEMES``). In a bucket,
64-bit sketches (four bits of each of fourteen values, and the length) must agree in ``AGREE`` places and about in length.
Chains of close pairs make groups within one bucket, never across buckets; close lines of a group are compared whole, in
units of bounded bytes. The groups of all lines are the connected groups of the links so verified. SimHash fingerprints, whose blocks of bits carry far less, lose half of the links at
as many blocks; the README gives the measured shares of both.

Defined results: null and empty texts and other lines are left as they are; documents stay, with an empty text where every
line was removed; of repeated rows (same id and text) one keeps its lines; null ids come after others; ids are integers;
an empty table gives an empty table; other columns pass through.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Forest, bucket_groups, by_runs, compared, components, in_filter, kept, mix64, runs, signed, table, wanted_filter

SIMILARITY = 0.8
#: Bytes from which a line of one word counts.
MIN_BYTES = 24
#: (least bytes of a line, bytes it stays below, bytes of a gram, one gram in so many, bytes that distances are rounded to).
#: Lines whose lengths lie on both sides of a bound meet by the scheme that they share.
SCHEMES = ((0, 48, 3, 1, 4), (38, 256, 6, 1, 16), (204, 1 << 62, 6, 4, 16))
BLOCKS = 8
#: A key modulo this is the number of its scheme.
KINDS = np.uint64(4)
#: Values of a sketch, four bits each, and how many must agree; steps of the length in it to a doubling, and how many lengths may differ.
SKETCH, AGREE, LENGTH_STEPS, LENGTH_APART = 14, 5, 16, 6
#: Lines that a task remembers as sent.
SENT_LINES = 200_000
NO_ID = -(1 << 63)
#: Bytes of lines that are hashed together.
HELD_BYTES = 300_000


#: White space that a normalised text doesn't hold.
LOOSE = (b"  ", b" \n", b"\n ", b"\t", b"\r", b"\x0b", b"\x0c")


def lines_of_text(text: bytes) -> list[bytes]:
    """Normalised lines: lower-cased, one space between words, none around them. White space is ASCII's."""
    low = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    lines = low.split(b"\n")
    if low[:1] == b" " or low[-1:] == b" " or any(x in low for x in LOOSE):
        return [b" ".join(x.split()) for x in lines]
    return lines


def counted(lines: list[bytes]) -> list[int]:
    """The numbers of the lines that count."""
    return [k for k, x in enumerate(lines) if b" " in x or len(x) >= MIN_BYTES]


def row_keys(docs: DataFrame, id_column: str, text: str) -> list[Column]:
    """Columns that name a row by its id and text."""
    return [F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("raw")]


SEEDS = mix64(np.arange(1, 1 + 4 * BLOCKS, dtype=np.uint64)).reshape(2, -1)
SEEDS[1] |= np.uint64(1)
#: A MinHash value's low bits tell where its gram stands.
PLACE = np.uint64(0xFFFF)


#: Bytes of lines whose grams are hashed at once, few enough that they stay in a processor's cache.
CACHED_BYTES = 1 << 15


def min_hashes(lines: list[bytes], gram: int, every: int) -> np.ndarray:
    """MinHash values of each line over its grams, places in the low bits; grams at the end of a line reach over it."""
    size = np.array([len(x) for x in lines])
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // CACHED_BYTES)) + 1
    if len(cuts):
        edges = [0, *cuts.tolist(), len(lines)]
        return np.concatenate([gram_minima(lines[i:j], size[i:j], gram, every) for i, j in zip(edges, edges[1:], strict=False)])
    return gram_minima(lines, size, gram, every)


def gram_minima(lines: list[bytes], size: np.ndarray, gram: int, every: int) -> np.ndarray:
    gap = b"\n" * gram
    raw = np.frombuffer(gap.join(lines) + gap, np.uint8).astype(np.uint64)
    raw += np.uint64(1)
    h = raw[: len(raw) - gram].copy()
    for k in range(1, gram):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += raw[k : k + len(h)]
    starts = np.cumsum(size) - size
    line = np.repeat(np.arange(len(lines)), size)
    h = mix64(h[np.arange(size.sum()) + gram * line])
    place = np.arange(size.sum()) - np.repeat(starts, size)
    if every > 1:  # the same grams in every line; a line without such grams takes all
        on = h % np.uint64(every) == 0
        on |= (np.add.reduceat(on, starts) == 0)[line]
        h, line, place = h[on], line[on], place[on]
        starts = np.searchsorted(line, np.arange(len(lines)))
    place = place.astype(np.uint64) & PLACE
    out = np.empty((len(lines), 2 * BLOCKS), np.uint64)
    x = np.empty_like(h)
    for k in range(2 * BLOCKS):
        np.bitwise_xor(h, SEEDS[0, k], out=x)
        x *= SEEDS[1, k]
        x &= ~PLACE
        x |= place
        out[:, k] = np.minimum.reduceat(x, starts)
    out ^= out >> np.uint64(32) & ~PLACE
    return out


#: Places of a sketch's values.
NIBBLES = np.arange(0, 4 * SKETCH, 4, dtype=np.uint64)


def block_keys(lines: list[bytes], scheme: int) -> tuple[np.ndarray, np.ndarray]:
    """(lines, blocks) keys of the buckets and a sketch of each line."""
    *_, gram, every, step = SCHEMES[scheme]
    low = min_hashes(lines, gram, every)
    value, place = low & ~PLACE, (low & PLACE).astype(np.int64)
    sketch = ((mix64(value[:, :SKETCH]) & np.uint64(15)) << NIBBLES).sum(axis=1, dtype=np.uint64)
    steps = np.minimum(np.rint(LENGTH_STEPS * np.log2([max(1, len(x)) for x in lines])), 255).astype(np.uint64)
    sketch |= steps << np.uint64(56)
    apart = signed_steps(place[:, ::2] - place[:, 1::2], step)
    place = place[:, ::2].copy()
    place[:, 1::2] -= np.array([min(len(x), int(PLACE)) for x in lines])[:, None]
    about = signed_steps(place, 8 * step)
    block = np.arange(BLOCKS, dtype=np.uint64) * np.uint64(64) + np.uint64(scheme)
    key = mix64(block ^ value[:, ::2])
    for more in (value[:, 1::2], np.roll(value[:, ::2], -1, axis=1), apart, about):
        key = mix64(key + more)
    return key - key % KINDS + np.uint64(scheme), sketch


def signed_steps(x: np.ndarray, step: int) -> np.ndarray:
    return ((x + step // 2) // step).astype(np.uint64)


def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sketches agree in ``AGREE`` values or more, and about in length."""
    x = (a ^ b) & np.uint64((1 << 56) - 1)
    x = x | x >> np.uint64(1)
    x = (x | x >> np.uint64(2)) & np.uint64(0x11111111111111)
    apart = (a >> np.uint64(56)).astype(np.int64) - (b >> np.uint64(56)).astype(np.int64)
    return (np.bitwise_count(x) <= SKETCH - AGREE) & (abs(apart) <= LENGTH_APART)


def line_rows(docs: DataFrame, id_column: str, text: str) -> DataFrame:
    """(id, raw, line, bytes, h1, h2, keys, sketches): a row per line that counts; h1 and h2 are the normalised line's digest.

    keys are ``BLOCKS`` bucket keys for each scheme of the line, sketches one for each. A task leaves both null in a line
    that it has lately sent, so repeats of a common line don't fill its buckets.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()

        def out(ids: np.ndarray, raws: np.ndarray, line: list[int], held: list[bytes]) -> pa.RecordBatch:
            digests = list(map(xxhash.xxh3_128_digest, held))
            n = len(held)
            fresh = np.zeros(n, bool)
            for i, d in enumerate(digests):
                if d not in sent:
                    if len(sent) >= SENT_LINES:
                        sent.clear()
                    sent.add(d)
                    fresh[i] = True
            size = np.fromiter(map(len, held), np.int64, n)
            mine = [np.flatnonzero(fresh & (least <= size) & (size < below)) for least, below, *_ in SCHEMES]
            many = sum(np.bincount(at, minlength=n) for at in mine)
            start = np.cumsum(many) - many
            keys, sketches = np.empty((many.sum(), BLOCKS), np.uint64), np.empty(many.sum(), np.uint64)
            for k, at in enumerate(mine):
                if len(at):
                    keys[start[at]], sketches[start[at]] = block_keys([held[i] for i in at], k)
                    start[at] += 1  # a line's next scheme goes behind
            ends = np.append(0, np.cumsum(many)).astype(np.int32)
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            lists = [pa.ListArray.from_arrays(pa.array(ends * w), pa.array(signed(x.ravel())), mask=pa.array(many == 0)) for w, x in ((BLOCKS, keys), (1, sketches))]
            cols = [pa.array(ids), pa.array(raws), pa.array(line, pa.int32()), pa.array(size.astype(np.int32)), pa.array(d[:, 0]), pa.array(d[:, 1]), *lists]
            return pa.RecordBatch.from_arrays(cols, ["id", "raw", "line", "bytes", "h1", "h2", "keys", "sketches"])

        for b in batches:
            ids, raws = b.column(0).to_numpy(), b.column(1).to_numpy()
            row, line, held, size = [], [], [], 0
            for i, t in enumerate(b.column(2)):
                t = t.as_py()
                if not t:
                    continue
                found = lines_of_text(t)
                mine = counted(found)
                row += [i] * len(mine)
                line += mine
                held += [found[k] for k in mine]
                size += len(t) if mine else 0
                if size >= HELD_BYTES:
                    yield out(ids[row], raws[row], line, held)
                    row, line, held, size = [], [], [], 0
            if row:
                yield out(ids[row], raws[row], line, held)

    rows = docs.select(*row_keys(docs, id_column, text), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(cut, "id long, raw long, line int, bytes int, h1 long, h2 long, keys array<long>, sketches array<long>")


def bucket_rows(lines: DataFrame) -> DataFrame:
    """(key, node, sketch): a row per line and block; ``lines`` are those of ``line_rows``."""
    rows = lines.where("keys is not null").select(F.col("h1").alias("node"), "sketches", F.posexplode("keys").alias("at", "key"))
    return rows.select("key", "node", F.get("sketches", F.floor(F.col("at") / BLOCKS).cast("int")).alias("sketch"))


def common_start(a: str, b: str) -> int:
    if a[:1] != b[:1]:
        return 0
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


#: Columns between two looks at the distance.
COLUMNS = 32


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance by bit-parallel columns, one big integer a column; any number above ``most`` if it is greater."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    whole = (1 << len(b)) - 1
    plus, minus = whole, 0
    for start in range(0, len(a), COLUMNS):
        for c in a[start : start + COLUMNS]:
            match = at.get(c, 0)
            down = match | minus
            across = (((match & plus) + plus) ^ plus) | match
            less = plus & across
            more = (minus | (across | plus) ^ whole) << 1 | 1  # what stands above the top bit is dropped below
            plus, minus = (less << 1 | (down | more) ^ whole) & whole, more & down
        done = min(start + COLUMNS, len(a))
        distance = done + plus.bit_count() - minus.bit_count()
        if most is not None and distance - (len(a) - done) > most:  # a column lowers the distance by one at most
            return distance
    return distance


#: Characters that two texts must share to be cut there.
ANCHOR = 10


def trimmed(a: str, b: str) -> tuple[str, str]:
    """Both without their common start and end."""
    k = common_start(a, b)
    a, b = a[k:], b[k:]
    k = common_start(a[::-1], b[::-1]) if a[-1:] == b[-1:] else 0
    return (a[:-k], b[:-k]) if k else (a, b)


def most_edits(a: str, b: str) -> int:
    """An upper bound of the distance: texts are cut at pieces that both hold, and what is left between counts as changed."""
    total, todo = 0, [(a, b)]
    while todo:
        a, b = trimmed(*todo.pop())
        n = len(a)
        for m in (n // 2, n // 4, 3 * n // 4) if n >= 2 * ANCHOR <= len(b) else ():
            at = m - ANCHOR // 2
            k = b.find(a[at : at + ANCHOR])
            if k >= 0:
                todo += [(a[:at], b[:k]), (a[at + ANCHOR :], b[k + ANCHOR :])]
                break
        else:
            total += max(n, len(b))
    return total


def similar(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    """Whether 1 - distance / longer length reaches ``similarity``."""
    longer = max(len(a), len(b))
    most = int((1 - similarity) * longer + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    a, b = trimmed(a, b)
    return max(len(a), len(b)) <= most or most_edits(a, b) <= most or edit_distance(a, b, most) <= most


def places_of(text: str) -> dict[str, bytes]:
    """character -> its places in the text, a bit each, with a spare bit at the top."""
    at: dict[str, int] = {}
    for i, c in enumerate(text):
        at[c] = at.get(c, 0) | 1 << i
    width = len(text) // 8 + 1
    return {c: x.to_bytes(width, "little") for c, x in at.items()}


def edit_distances(a: str, others: list[str], places: list[dict[str, bytes]]) -> list[int]:
    """Levenshtein distance of ``a`` to each of ``others``: the columns of all of them side by side in one integer.

    Every text has a field of its own with a spare bit, which takes what an addition or a shift carries over.
    """
    widths = [len(x) // 8 + 1 for x in others]
    none = [bytes(w) for w in widths]
    joined = lambda parts: int.from_bytes(b"".join(parts), "little")
    at = {c: joined(p.get(c, z) for p, z in zip(places, none, strict=True)) for c in set(a)}
    whole = joined(((1 << len(x)) - 1).to_bytes(w, "little") for x, w in zip(others, widths, strict=True))
    lowest = joined((1).to_bytes(w, "little") for w in widths)
    plus, minus = whole, 0
    for c in a:
        match = at[c]
        down = match | minus
        across = (((match & plus) + plus) ^ plus) | match
        less = plus & across
        more = (minus | (across | plus) ^ whole) << 1 | lowest  # a bit over the top of a field falls on a lowest bit or is dropped
        plus, minus = (less << 1 | (down | more) ^ whole) & whole, more & down
    ups, downs = (x.to_bytes(sum(widths), "little") for x in (plus, minus))
    out, start = [], 0
    for w in widths:
        out.append(len(a) + int.from_bytes(ups[start : start + w], "little").bit_count() - int.from_bytes(downs[start : start + w], "little").bit_count())
        start += w
    return out


GRAM = 3
#: Bits of a place in a text; longer texts aren't held against marks.
PLACE_BITS = 22


def marks_of_all(texts: list[str]) -> list[np.ndarray]:
    """A hash and the place of each gram of characters, ascending, for each text."""
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(max(0, len(c) - GRAM + 1), np.uint64)
    for k in range(GRAM if len(h) else 0):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += c[k : k + len(h)]
    h = mix64(h) >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)
    place, out, start = np.arange(max(map(len, texts), default=0), dtype=np.uint64), [], 0
    for x in texts:
        n = max(0, len(x) - GRAM + 1)
        marks = h[start : start + n] + place[:n]
        marks.sort()
        out.append(marks)
        start += len(x)
    return out


def gram_marks(text: str) -> np.ndarray:
    return marks_of_all([text])[0]


def any_may_be_similar(one: np.ndarray, others: list[np.ndarray], longer: np.ndarray) -> np.ndarray:
    """False only where the text of marks ``one`` and another can't be similar; ``longer`` are the lengths of the longer of both.

    An edit takes ``GRAM`` grams from the longer text at most; the others stand in both texts, no further apart than there
    are edits.
    """
    most = ((1 - SIMILARITY) * longer + 1e-9).astype(np.int64)
    least = longer - GRAM + 1 - GRAM * most
    many = np.array([len(x) for x in others])
    out = (least <= 0) | (longer >= 1 << PLACE_BITS)
    if not len(one):
        return out
    held = np.flatnonzero(~out & (many > 0))
    if len(held):
        a = np.concatenate([others[k] for k in held.tolist()]) if len(held) > 1 else others[held[0]]
        many = many[held]
        far = np.repeat(most[held].astype(np.uint64), many)
        low = a - np.minimum(a & np.uint64((1 << PLACE_BITS) - 1), far)
        at = np.minimum(np.searchsorted(one, low), len(one) - 1)
        found = one[at]
        out[held] = np.add.reduceat((found >= low) & (found <= a + far), np.cumsum(many) - many, dtype=np.int64) >= least[held]
    return out


def may_be_similar(a: np.ndarray, b: np.ndarray, longer: int) -> bool:
    return bool(any_may_be_similar(a, [b], np.array([longer]))[0])


#: Links that a task holds before it sends them.
HELD_LINKS = 5_000
#: Characters of texts that are marked together.
MARKED = 1 << 15
#: Members of a unit up to which all their sketches are compared at once.
AT_ONCE = 256


def line_links(rows: DataFrame) -> DataFrame:
    """(a, b): a forest of the verified links of each unit; ``rows`` are (unit, role, node, sketch, text)."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[int] = []
        b: list[int] = []

        def out() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a.clear()
            b.clear()
            return found

        for t in runs(batches, "unit"):
            if len(a) >= HELD_LINKS:
                yield out()
            if t.num_rows == 2 and t.column("role")[0].as_py() == 0:  # most units: one pair
                (x, y), (p, q) = t.column("node").to_pylist(), t.column("text").to_pylist()
                if x != y and similar(p, q):
                    a.append(x)
                    b.append(y)
                continue
            nodes, at = np.unique(t.column("node").to_numpy(), return_index=True)
            if len(nodes) < 2:
                continue
            rest = t.column("role").to_numpy()[at] == 1  # rows come by role within a node
            texts = t.column("text").take(at).to_pylist()
            size = np.array([len(x) for x in texts])
            sketch = t.column("sketch").to_numpy()[at].view(np.uint64)
            marks: list[np.ndarray | None] = [None] * len(nodes)
            share = (np.cumsum(size) // MARKED).tolist()
            forest = Forest(len(nodes))
            known: dict[int, np.ndarray] = {}

            def partners(i: int) -> np.ndarray:
                fits = abs(size - size[i]) <= (1 - SIMILARITY) * np.maximum(size, size[i]) + 1e-9
                fits &= close(sketch, sketch[i])
                fits[i] = False
                return np.flatnonzero(fits if not rest[i] else fits & ~rest)

            def marks_of(i: int) -> np.ndarray:
                if marks[i] is None:
                    lo, hi = bisect_left(share, share[i]), bisect_right(share, share[i])
                    marks[lo:hi] = marks_of_all(texts[lo:hi])
                return marks[i]

            def known_partners(i: int) -> np.ndarray:
                found = known.pop(i, None)
                return partners(i) if found is None else found

            def like(i: int) -> int:
                found = partners(i)
                if len(nodes) <= 1000:  # larger units would hold too many
                    known[i] = found
                return len(found)

            probes = np.flatnonzero(~rest)
            if len(nodes) <= AT_ONCE:  # the same partners and order, found at once
                fits = abs(size[:, None] - size) <= (1 - SIMILARITY) * np.maximum(size[:, None], size) + 1e-9
                fits &= close(sketch[:, None], sketch)
                fits &= ~(rest[:, None] & rest)
                np.fill_diagonal(fits, False)
                known = {i: np.flatnonzero(x) for i, x in enumerate(fits)}
                if len(nodes) > 3:
                    probes = probes[np.argsort(-fits.sum(axis=1)[probes], kind="stable")]
            elif len(nodes) > 3:  # those like most others first, so that fewer others are compared among each other
                probes = probes[np.argsort([-like(i) for i in probes.tolist()], kind="stable")]
            places: list[dict[str, bytes] | None] = [None] * len(nodes)
            met = np.zeros(len(nodes), bool)
            for i in probes.tolist():
                met[i] = True
                todo = [j for j in known_partners(i).tolist() if (rest[j] or not met[j]) and forest.find(i) != forest.find(j)]
                if todo:
                    may = any_may_be_similar(marks_of(i), [marks_of(j) for j in todo], np.maximum(size[i], size[todo]))
                    todo = [j for j, x in zip(todo, may.tolist(), strict=True) if x]
                if len(todo) > 2:
                    most = {j: int((1 - SIMILARITY) * max(size[i], size[j]) + 1e-9) for j in todo}
                    sure = [j for j in todo if most_edits(texts[i], texts[j]) <= most[j]]
                    unsure = [j for j in todo if j not in set(sure)]
                    for j in unsure:
                        if places[j] is None:
                            places[j] = places_of(texts[j])
                    far = edit_distances(texts[i], [texts[j] for j in unsure], [places[j] for j in unsure]) if unsure else []
                    todo = sure + [j for j, d in zip(unsure, far, strict=True) if d <= most[j]]
                else:
                    todo = [j for j in todo if similar(texts[i], texts[j])]
                for j in todo:
                    if forest.join(i, j):
                        a.append(int(nodes[i]))
                        b.append(int(nodes[j]))
        if a:
            yield out()

    return by_runs(rows.select("unit", "node", "role", "sketch", "text"), "unit", verify, "a long, b long", "node", "role")


def lines_of(docs: DataFrame, nodes: DataFrame, text: str) -> DataFrame:
    """(node, text): the normalised lines of ``nodes`` (node).

    A filter of the wanted nodes keeps most other lines out of the shuffle; the join settles which are wanted.
    """
    sent = docs.sparkSession.sparkContext.broadcast(wanted_filter(nodes))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            held, digests = [], []

            def out() -> pa.RecordBatch:
                node = np.frombuffer(b"".join(digests), np.int64)[::2]
                texts = []
                for i in np.flatnonzero(in_filter(sent.value, node)).tolist():
                    if digests[i] not in seen:
                        if len(seen) >= SENT_LINES:
                            seen.clear()
                        seen.add(digests[i])
                        texts.append((int(node[i]), held[i].decode()))
                return pa.RecordBatch.from_arrays([pa.array([x for x, _ in texts], pa.int64()), pa.array([x for _, x in texts], pa.string())], ["node", "text"])

            size = 0
            for t in b.column(0):
                t = t.as_py()
                if not t:
                    continue
                found = lines_of_text(t)
                mine = [found[k] for k in counted(found)]
                held += mine
                digests += map(xxhash.xxh3_128_digest, mine)
                size += len(t) if mine else 0
                if size >= HELD_BYTES:
                    yield out()
                    held, digests, size = [], [], 0
            if held:
                yield out()

    rows = docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(pick, "node long, text string")
    return rows.join(nodes.hint("merge"), "node").groupBy("node").agg(F.first("text").alias("text"))


def removed_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lines: DataFrame | None = None) -> DataFrame:
    """(id, raw, removed): the line numbers to remove from the rows so named."""
    lines = kept(line_rows(docs, id_column, text), "lines") if lines is None else lines
    # only numbers of fixed size here, which Spark sums by hash; which line is a group's first is asked of repeated lines alone
    nodes = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("bytes").alias("bytes"))
    nodes = kept(nodes.select("h1", "h2", F.col("h1").alias("node"), "n", "bytes"), "nodes")
    grouped = bucket_groups(bucket_rows(lines), close, kinds=int(KINDS))
    picked = kept(nodes.select("node", "bytes").join(grouped.hint("shuffle_hash"), "node").select("comp", "node", "sketch", "bytes"), "picked")
    texts = kept(lines_of(docs, kept(picked.select("node").distinct(), "wanted"), text), "texts")
    links = compared(picked, lambda rows: line_links(rows.join(texts.hint("merge"), "node")))
    same = kept(components(links), "groups")
    # groups of one node need no links; their occurrences meet by digest
    of = nodes.join(same.hint("shuffle_hash"), "node", "left").where("n > 1 or comp is not null").select("h1", "h2", F.coalesce("comp", "node").alias("comp"))
    repeated = kept(lines.select("id", "raw", "line", "h1", "h2").join(of.hint("shuffle_hash"), ["h1", "h2"]).select("id", "raw", "line", "comp"), "repeated")
    place = F.struct((F.col("id") == NO_ID).alias("no_id"), "id", "raw", "line")
    lead = repeated.groupBy("comp").agg(F.min(place).alias("lead"))
    # read from a table, so that Spark can split the lines of a large group among tasks
    lead = kept(lead.select("comp", F.col("lead.id").alias("lead_id"), F.col("lead.raw").alias("lead_raw"), F.col("lead.line").alias("lead_line")), "leads")
    out = repeated.join(lead.hint("shuffle_hash"), "comp").where("not (id = lead_id and raw = lead_raw and line = lead_line)")
    return out.groupBy("id", "raw").agg(F.array_sort(F.collect_set("line")).alias("removed"))


def marked(docs: DataFrame, id_column: str = "doc_id", text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """``docs`` (or ``columns`` of it) with ``__lines`` (of the text) and ``__removed`` (line numbers to remove)."""
    lines = kept(line_rows(docs, id_column, text), "lines")
    gone = removed_lines(docs, id_column, text, lines).select(F.col("id").alias("__id"), F.col("raw").alias("__raw"), F.col("removed").alias("__gone"))
    key, raw = row_keys(docs, id_column, text)
    rows = docs.select(*(columns or docs.columns), key.alias("__id"), raw.alias("__raw"), F.size(F.split(F.coalesce(F.col(text), F.lit("")), "\n")).alias("__lines"))
    if columns is not None:  # without the texts, which are then read once for both uses below
        rows = kept(rows, "rows")
    # rows equal to an earlier one keep no line: the few ids and texts that stand twice, with all their lines
    twice = rows.select(F.col("__id").alias("id"), F.col("__raw").alias("raw")).groupBy("id", "raw").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    every = lines.join(twice, ["id", "raw"], "left_semi").groupBy(F.col("id").alias("__id"), F.col("raw").alias("__raw")).agg(F.array_sort(F.collect_set("line")).alias("__every"))
    rows = rows.join(gone.hint("merge"), ["__id", "__raw"], "left").join(every.hint("merge"), ["__id", "__raw"], "left").withColumn("__copy", F.row_number().over(W.partitionBy("__id", "__raw").orderBy("__raw")))
    none = F.array().cast("array<int>")
    removed = F.when(F.col("__copy") > 1, F.coalesce("__every", none)).otherwise(F.coalesce("__gone", none))
    return rows.withColumn("__removed", removed).drop("__id", "__raw", "__gone", "__every", "__copy")


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed lines gone from the text; a null text stays null."""
    rows = marked(docs, id_column, text)
    lines = F.split(F.col(text), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__removed"))
    cut = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    rows = rows.withColumn(text, F.when(F.size("__removed") == 0, F.col(text)).otherwise(cut))
    return rows.select(*docs.columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its lines, and the numbers (from 0) of those removed."""
    docs = table(spark, sf_dir, "documents")
    rows = marked(docs, columns=["doc_id"])
    return rows.select("doc_id", F.col("__lines").cast("long").alias("n_lines"), F.size("__removed").cast("long").alias("n_removed"), F.col("__removed").alias("removed_lines"))

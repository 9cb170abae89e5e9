"""Operators that look at the whole corpus: line and near dedup, decontamination, LM scoring, packing, WARC, the pipeline."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import tracemalloc
import uuid
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodeworks.llm import line_dedup as ld
from lodeworks.llm import near_dedup as nd
from lodeworks.llm.common import Forest, WordIds, bucket_groups, components, kept, sketch_forest, window_hashes
from lodeworks.llm.decontamination import QUESTION, halves, op4_decontamination, shingles, with_leaks, words_of
from lodeworks.llm.line_dedup import AGREE, close, dedup_lines, edit_distance, edit_distances, gram_marks, may_be_similar, most_edits, op2_line_dedup, places_of, removed_lines, similar
from lodeworks.llm.lm_score import lm_scores, op9_lm_score
from lodeworks.llm.packing import SIZES, best_fit, op10_packing, pack, pack_documents, packed_sequences, word_count
from lodeworks.llm.quality_rules import cascade_order, first_failed
from lodeworks.llm.warc import chunked, op5_warc_segments, parse, read_archives, unchunked, write_archives


def texts_of(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


# components


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000 + i) for i in range(1, 50)]
    f = Forest(6000)
    for a, b in edges:
        f.join(a, b)
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: f.find(x) for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


# line dedup


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_edit_distance():
    rng = random.Random(2)
    for _ in range(300):
        a, b = ("".join(rng.choice("abé") for _ in range(rng.randrange(25))) for _ in range(2))
        assert edit_distance(a, b) == levenshtein(a, b)
        assert levenshtein(a, b) <= most_edits(a, b) <= max(len(a), len(b), 1) * 2
        assert similar(a, b) == (levenshtein(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9))
    for _ in range(40):
        a, *others = ("".join(rng.choice("abé") for _ in range(rng.randrange(1, 25))) for _ in range(8))
        assert edit_distances(a, others, list(map(places_of, others))) == [levenshtein(a, b) for b in others]


def test_distances_side_by_side():
    rng = random.Random(5)
    for _ in range(60):
        texts = ["".join(rng.choice("abé") for _ in range(rng.randrange(1, 70))) for _ in range(6)]
        far = [levenshtein(texts[0], t) for t in texts[1:]]
        assert edit_distances(texts[0], texts[1:], [places_of(t) for t in texts[1:]]) == far
        for t, d in zip(texts[1:], far, strict=True):
            most = rng.randrange(40)
            assert edit_distance(texts[0], t) == d and (edit_distance(texts[0], t, most) <= most) == (d <= most)


def test_links_leave_in_few_batches(monkeypatch):
    held = []
    monkeypatch.setattr(ld, "by_runs", lambda df, key, f, *rest: held.append(f))
    ld.line_links(type("Rows", (), {"select": lambda self, *names: self})())
    n = 50
    texts = [f"line number {k} of the units here{x}" for k in range(n) for x in ("", "!")]
    cols = [pa.array(np.repeat(np.arange(n), 2)), pa.array(np.arange(2 * n)), pa.array(np.zeros(2 * n, np.int32)), pa.array(np.zeros(2 * n, np.int64)), pa.array(texts)]
    got = list(held[0](iter([pa.RecordBatch.from_arrays(cols, ["unit", "node", "role", "sketch", "text"])])))
    assert len(got) == 1 and got[0].to_pydict() == {"a": list(range(0, 2 * n, 2)), "b": list(range(1, 2 * n, 2))}


def test_gram_marks():
    """Pairs that the count of shared grams rules out are never similar."""
    rng = random.Random(12)
    ruled = 0
    for _ in range(400):
        a = [rng.choice("abc é") for _ in range(rng.randrange(1, 90))]
        b = list(a)
        for _ in range(rng.randrange(len(a) // 2 + 1)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "x", "yz"])
        a, b = "".join(a), "".join(b)
        if not may_be_similar(gram_marks(a), gram_marks(b), max(len(a), len(b))):
            ruled += 1
            assert not similar(a, b)
    assert ruled > 50


def test_marks_of_one_text_against_many():
    rng = random.Random(13)
    for _ in range(60):
        texts = ["".join(rng.choice("abc é\U0001f600") for _ in range(rng.randrange(1, 90))) for _ in range(4)]
        texts += [texts[0][:k] + "x" + texts[0][k:] for k in range(0, len(texts[0]), 9)]
        marks = ld.marks_of_all(texts)
        assert all((x == gram_marks(t)).all() for x, t in zip(marks, texts, strict=True))
        may = ld.any_may_be_similar(marks[0], marks[1:], np.array([max(len(texts[0]), len(t)) for t in texts[1:]]))
        assert all(x or not similar(texts[0], t) for x, t in zip(may.tolist(), texts[1:], strict=True))


def test_line_keys_in_pieces(monkeypatch):
    """Keys and sketches of lines don't depend on how many lines are hashed at once."""
    rng = random.Random(14)
    for scheme, (least, below, *_) in enumerate(ld.SCHEMES):
        lines = [bytes(rng.randrange(97, 123) for _ in range(rng.randrange(max(1, least), min(below, 600)))) for _ in range(50)]
        got = []
        for size in (64, 1 << 30):
            monkeypatch.setattr(ld, "CACHED_BYTES", size)
            got.append(ld.block_keys(lines, scheme))
        assert all((x == y).all() for x, y in zip(*got, strict=True))


def test_links_of_units_compared_at_once(monkeypatch):
    """Units whose sketches are all compared at once give the links of those compared member by member."""
    held = []
    monkeypatch.setattr(ld, "by_runs", lambda df, key, f, *rest: held.append(f))
    ld.line_links(type("Rows", (), {"select": lambda self, *names: self})())
    rng = random.Random(15)
    rows = []
    for unit in range(30):
        texts = ["".join(rng.choice("abcdef ") for _ in range(60)) for _ in range(3)]
        for node in range(rng.randrange(3, 12)):
            text = list(rng.choice(texts))
            for _ in range(rng.randrange(16)):
                text[rng.randrange(60)] = rng.choice("xyz")
            rows.append((unit, 100 * unit + node, int(unit % 3 == 0 and node > 3), rng.choice([0, 1 << 3, 1 << 60]), "".join(text)))
    cols = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()), strict=True)]
    got = []
    for most in (0, 256):
        monkeypatch.setattr(ld, "AT_ONCE", most)
        got.append([b.to_pydict() for b in held[0](iter([pa.RecordBatch.from_arrays(cols, ["unit", "node", "role", "sketch", "text"])]))])
    assert got[0] == got[1] and len(got[0][0]["a"]) > 30


def test_line_digests_are_summed_by_hash(spark, docs, monkeypatch):
    """Sums over all lines hold numbers of fixed size only, else Spark sorts every line for them."""
    kinds = {}
    real = ld.kept
    monkeypatch.setattr(ld, "kept", lambda df, name="table": kinds.update({name: dict(df.dtypes)}) or real(df, name))
    rows = removed_lines(docs([(1, "a line here\nb"), (2, "A  line here\nown two words"), (3, "a line here")])).collect()
    assert sorted((r["id"], r["removed"]) for r in rows) == [(2, [0]), (3, [0])]
    assert set(kinds["nodes"].values()) <= {"bigint", "int"} and "leads" in kinds


def test_long_texts_without_lines_that_count(spark, docs):
    made = docs([(1, "ab\n" * 150_000), (2, "a line here"), (3, "a line here")])
    assert [(r["id"], r["removed"]) for r in removed_lines(made).collect()] == [(3, [0])]


def test_close_sketches():
    rng = random.Random(6)
    for _ in range(300):
        a = [rng.randrange(16) for _ in range(14)]
        b = [x if rng.random() < 0.3 else rng.randrange(16) for x in a]
        steps = rng.randrange(20), rng.randrange(20)
        packed = (np.array([sum(x << 4 * k for k, x in enumerate(y)) | n << 56], np.uint64) for y, n in zip((a, b), steps, strict=True))
        assert bool(close(*packed)[0]) == (sum(x == y for x, y in zip(a, b, strict=True)) >= AGREE and abs(steps[0] - steps[1]) <= 6)


@pytest.mark.parametrize("hot", [10, 1000])
def test_bucket_forests(spark, hot):
    """Forests connect what all close pairs of a bucket connect; buckets beyond the bound hang on one member."""
    rng = random.Random(3)
    rows = [(rng.randrange(6), node, rng.choice([0, 1, 3, -1, -2])) for node in range(60)]
    rows += [(100, node, 0) for node in range(500, 530)] + rows[:5]
    near = lambda a, b: np.bitwise_count(a ^ b) <= 1
    f = Forest(1000)
    for k, a, x in rows:
        size = len({r[1] for r in rows if r[0] == k})
        for j, b, y in rows:
            if j == k and (size > hot or bin((x ^ y) & (1 << 64) - 1).count("1") <= 1):
                f.join(a, b)
    g, first = Forest(1000), {}
    for r in bucket_groups(spark.createDataFrame(rows, "key long, node long, sketch long").coalesce(1), near, hot).collect():
        g.join(first.setdefault(r["comp"], r["node"]), r["node"])
    if hot == 1000:
        assert [f.find(i) for i in range(1000)] == [g.find(i) for i in range(1000)]
    else:  # a bucket at the bound may go either way: at least the close pairs are tied, at most the whole bucket
        assert len({g.find(i) for i in range(500, 530)}) == 1 and all(f.find(i) == f.find(g.find(i)) for i in range(1000))
    assert sketch_forest(np.array([1, 3, 8], np.uint64), near) == [(0, 1)]


def brute_lines(pairs):
    """Line numbers to remove by edit similarity alone: all pairs of lines that a bound on the edits by character counts leaves."""
    occurrences = defaultdict(list)
    for doc, text in pairs:
        for k, line in enumerate((text or "").split("\n")):
            w = line.lower().split()
            if len(w) >= 2 or len("".join(w).encode()) >= 24:
                occurrences[" ".join(w)].append((doc, k))
    keys = list(occurrences)
    size = np.array([len(k) for k in keys])
    held = np.array([np.bincount(np.frombuffer(k.encode("utf-32-le"), np.uint32) % 97, minlength=97) for k in keys]).reshape(-1, 97)
    f = Forest(len(keys))
    for i in range(len(keys)):
        most = np.floor(0.2 * np.maximum(size[i + 1 :], size[i]) + 1e-9)
        # an edit changes the counts of two characters by one at most
        for j in np.flatnonzero((abs(size[i + 1 :] - size[i]) <= most) & (np.abs(held[i + 1 :] - held[i]).sum(axis=1) <= 2 * most)) + i + 1:
            if f.find(i) != f.find(int(j)) and similar(keys[i], keys[j]):
                f.join(i, int(j))
    lead = {}
    for i, k in enumerate(keys):
        lead[f.find(i)] = min([*occurrences[k], *([lead[f.find(i)]] if f.find(i) in lead else [])])
    gone = defaultdict(list)
    for i, k in enumerate(keys):
        for o in occurrences[k]:
            if o != lead[f.find(i)]:
                gone[o[0]].append(o[1])
    return {d: sorted(v) for d, v in gone.items()}


def shares(got, want):
    """Share of the wanted (document, line) pairs that are found; no other may be."""
    got, want = ({(i, k) for i, v in x.items() for k in v} for x in (got, want))
    assert got <= want
    return len(got) / max(1, len(want))


def test_line_dedup_against_brute_force(spark, sf_dir):
    """Candidates are probabilistic: nothing goes that brute force keeps, and at most 5 % of what it removes stays."""
    rows = op2_line_dedup(spark, sf_dir).collect()
    assert all(r["n_removed"] == len(r["removed_lines"]) for r in rows)
    assert shares({r["doc_id"]: r["removed_lines"] for r in rows}, brute_lines(texts_of(spark, sf_dir))) >= 0.95


@pytest.mark.parametrize(("one_in", "share"), [(50, 0.95), (16, 0.6)])
def test_edited_lines_go(spark, docs, one_in, share):
    """Lines of 3 to 60 words with one character in so many edited singly, the hardest edits for grams, against edit similarity of 0.8 alone."""
    rng = random.Random(8)

    def word():
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))

    lines = []
    for k in range(60):
        line = " ".join(word() for _ in range(3 + k % 58))
        edited = list(line)
        for _ in range(max(1, len(line) // one_in)):
            edited[rng.choice([i for i, c in enumerate(edited) if c != " "])] = rng.choice("xyz")
        lines += [line, "".join(edited)]
    want = set()
    for j, x in enumerate(lines):
        if any(abs(len(x) - len(y)) <= 0.2 * max(len(x), len(y)) and levenshtein(x, y) <= 0.2 * max(len(x), len(y)) for y in lines[max(0, j - 1) : j]):
            want.add(j)
    assert len(want) == 60
    gone = {r["id"] for r in removed_lines(docs(list(enumerate(lines)))).collect()}
    assert gone <= want and len(gone) >= share * len(want)


def test_lines_with_a_changed_word_go(spark, docs):
    rng = random.Random(5)
    lines = []
    for k in range(60):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(4, 7))) for _ in range(8 + k)]
        at = rng.randrange(len(words))
        lines += [" ".join(words), " ".join([*words[:at], "zz" + words[at][2:], *words[at + 1 :]])]
    gone = {r["id"] for r in removed_lines(docs(list(enumerate(lines)))).collect()}
    assert gone <= set(range(1, 120, 2)) and len(gone) >= 57


def test_line_dedup_odd_rows(spark, docs):
    long = " ".join(f"w{i}" for i in range(400))
    made = docs([(2, "Same  line here\nown two"), (1, "same line HERE\nx"), (1, "same line HERE\nx"), (3, None), (4, ""), (5, long), (6, long + " w0"), (None, "own two\nlast words")])
    made = made.withColumnRenamed("lang", "removed").withColumnRenamed("source", "line")
    out = dedup_lines(made)
    assert out.columns == made.columns
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or ("" if r["text"] == "" else None) or "") for r in out.collect()))
    assert got == sorted([(False, 2, "own two"), (False, 1, "same line HERE\nx"), (False, 1, "x"), (False, 3, ""), (False, 4, ""), (False, 5, long), (False, 6, ""), (True, 0, "last words")])
    assert removed_lines(made.limit(0)).count() == 0


# near dedup


def test_dart_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    h = np.unique(rng.integers(0, 1 << 63, 900, dtype=np.uint64))
    w = rng.uniform(0.2, 3.0, len(h))
    v = np.where(rng.random(len(h)) < 0.3, w * rng.uniform(0.2, 1, len(h)), w)
    want = np.minimum(w, v).sum() / np.maximum(w, v).sum()
    got = np.mean(nd.signature(h, w, 2000) == nd.signature(h, v, 2000))
    assert abs(got - want) < 0.05
    assert len(nd.signature(h[:1], w[:1], 96)) == 96


def brute_classes(pairs, weighted=True):
    sets = []
    for doc, text in pairs:
        w = (text or "").lower().split()
        c = Counter(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else Counter([tuple(w)])
        sets.append((doc, c if weighted else Counter(set(c))))
    f, holders = Forest(len(sets)), defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x, n in s.items():
            holders[x].append((k, n))
    both = Counter()
    for v in holders.values():
        for i, (a, m) in enumerate(v):
            for b, n in v[i + 1 :]:
                both[a, b] += min(m, n)
    for (a, b), n in both.items():
        if n >= 0.8 * (sets[a][1].total() + sets[b][1].total() - n):
            f.join(a, b)
    least = {}
    for k, (doc, _) in enumerate(sets):
        least[f.find(k)] = min(least.get(f.find(k), doc), doc)
    return {doc: least[f.find(k)] for k, (doc, _) in enumerate(sets)}


def test_plain_jaccard_classes(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in nd.near_classes(docs, weights="binary").collect()}
    assert got == brute_classes(texts_of(spark, sf_dir), weighted=False)


def test_near_classes_against_brute_force(spark, sf_dir):
    want = brute_classes(texts_of(spark, sf_dir))
    rows = nd.op8_near_dedup(spark, sf_dir).collect()
    assert {r["doc_id"]: r["class_id"] for r in rows} == want
    assert {r["doc_id"] for r in rows if r["keep"]} == set(want.values())


@pytest.mark.parametrize("edits", [2, 3, 5])
def test_near_groups_are_cut_exactly(spark, docs, monkeypatch, edits):
    """A large group of near copies, verified in many units, comes out as in brute force, also where its least member ties few of them."""
    monkeypatch.setattr("lodeworks.llm.common.UNIT_BYTES", 4000)
    rng = random.Random(1)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    pairs = []
    for k in range(60):
        t = list(base)
        for _ in range(1 + k % edits):
            t[rng.randrange(120)] = f"x{k}"
        pairs.append((k, " ".join(t)))
    pairs += [(100 + k, " ".join(f"v{rng.randrange(3000)}" for _ in range(80))) for k in range(20)]
    got = {r["doc_id"]: r["class_id"] for r in nd.near_classes(docs(pairs)).collect()}
    assert got == brute_classes(pairs)


def test_near_texts_are_fetched_once(spark, docs, monkeypatch, tmp_path):
    """Texts are read to sign them and once more for all units of the candidates, also where a group needs further units."""
    monkeypatch.setattr("lodeworks.llm.common.UNIT_BYTES", 4000)
    rng, folder = random.Random(1), str(tmp_path)
    base = [f"w{rng.randrange(3000)}" for _ in range(120)]
    pairs = [(k, " ".join(f"x{k}" if i in rng.sample(range(120), 6) else w for i, w in enumerate(base))) for k in range(60)]

    def seen(batches):
        for b in batches:
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(b.num_rows))
            yield b

    made = docs(pairs)
    got = {r["doc_id"]: r["class_id"] for r in nd.near_classes(made.mapInArrow(seen, made.schema)).collect()}
    assert got == brute_classes(pairs)
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 2 * len(pairs)


def test_near_odd_rows(spark, docs):
    t = " ".join(f"w{i}" for i in range(50))
    made = docs([(5, t), (5, t), (4, t.upper()), (None, t), (1, None), (2, ""), (3, " \n"), (7, "a b"), (8, "a b"), (None, "only here")])
    made = made.withColumnRenamed("lang", "id").withColumnRenamed("source", "raw")
    got = sorted(((r["doc_id"], r["class_id"], r["keep"]) for r in nd.near_classes(made).collect()), key=repr)
    assert got == sorted([(5, 4, False), (5, 4, False), (4, 4, True), (None, 4, False), (1, 1, True), (2, 1, False), (3, 1, False), (7, 7, True), (8, 7, False), (None, None, True)], key=repr)
    assert sorted((r["doc_id"] for r in nd.near_dedup(made).collect()), key=repr) == sorted([4, 1, 7, None], key=repr)
    repeated = nd.near_dedup(docs([(5, t), (5, t), (6, t + " z")])).collect()
    assert [r["doc_id"] for r in repeated] == [5] and nd.near_dedup(made.limit(0)).count() == 0


def test_weighted_links():
    ids = WordIds()
    sets = [nd.shingle_set(t.split(), ids, "counts") for t in ("a b c d e " * 4, "a b c d e " * 4 + "a", "a b c d e")]
    f = nd.jaccard_links(sets, np.zeros(3, bool), 0.8)
    assert f.find(0) == f.find(1) != f.find(2)
    assert len(window_hashes(np.arange(3, dtype=np.uint64), 5)) == 1


def test_links_of_many_copies_take_little_memory():
    words = [f"w{i}" for i in range(60)]
    ids, n = WordIds(), 1200
    sets = [nd.shingle_set(words + [f"x{k}"], ids, "counts") for k in range(n)]
    rest = np.arange(n) > 600
    tracemalloc.start()
    f = nd.jaccard_links(sets, rest, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {f.find(k) for k in range(n)} == {0} and peak < 50 << 20


# decontamination


def brute_leaks(pairs, items):
    out = set()
    for item, text in items:
        q, a = halves(text.encode())
        for doc, t in pairs:
            w = words_of(t.encode())
            if q and len(shingles(q) & shingles(w)) >= QUESTION * len(shingles(q)) and len(set(a) & set(w)) >= 0.5 * len(set(a)):
                out.add((doc, item))
    return out


def test_leaks_against_brute_force(spark, sf_dir):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in op4_decontamination(spark, sf_dir).collect()}
    assert got == brute_leaks(texts_of(spark, sf_dir), items)


def test_edited_items_leak(spark, docs):
    """Items with one changed word in the middle of the question, against fixed shares of one half."""
    rng = random.Random(4)
    items, pairs = [], []
    for i in range(30):
        n = 15 + i % 6
        q, a = [f"q{i}x{k}" for k in range(n)], [f"a{i}x{k}" for k in range(4)]
        items.append((i, " ".join(q) + "\n" + " ".join(a)))
        q[n // 2] = "changed"
        pairs.append((i, " ".join([f"f{rng.randrange(50)}" for _ in range(40)] + q + a)))
    want = set()
    for d, t in pairs:
        w = t.split()
        for i, x in items:
            q, a = (y.split() for y in x.split("\n"))
            grams = {tuple(q[k : k + 5]) for k in range(len(q) - 4)}
            if 2 * len(grams & {tuple(w[k : k + 5]) for k in range(len(w) - 4)}) >= len(grams) and 2 * len(set(a) & set(w)) >= len(set(a)):
                want.add((d, i))
    assert want == {(i, i) for i in range(30)}
    found = with_leaks(docs(pairs), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], x["item_id"]) for r in found.collect() for x in r["leaks"]} == want


def test_leaks_odd_rows(spark, docs):
    rng = random.Random(9)
    word = lambda: f"q{rng.randrange(500)}"
    long = " ".join(word() for _ in range(700))
    items = [(1, long), (2, "one two three"), (3, None), (4, ""), (5, "alpha beta gamma delta epsilon zeta\nthe answer is here"), (5, "alpha beta gamma delta epsilon zeta\nthe answer is here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    filler = " ".join(f"z{rng.randrange(500)}" for _ in range(5000))
    made = docs([(1, filler + " " + long + " " + filler), (2, None), (3, ""), (None, "Alpha beta gamma DELTA epsilon zeta the answer is here"), (5, "alpha beta gamma unrelated"), (6, "one two three")])
    made = made.withColumnRenamed("lang", "leaks")
    out = with_leaks(made, bench)
    got = {(r["doc_id"], tuple(x["item_id"] for x in r["leaks"])) for r in out.collect()}
    assert got == {(1, (1,)), (2, ()), (3, ()), (None, (5, 5)), (5, ()), (6, (2,))}
    assert with_leaks(made, bench.limit(0)).where("size(leaks) > 0").count() == 0 and with_leaks(made.limit(0), bench).count() == 0


def test_leaks_outside_ascii(spark, docs):
    """Capitals outside A-Z are words of their own everywhere: the same idf in the index as in the texts."""
    words = [f"Ä{i}é" for i in range(30)]
    found = with_leaks(docs([(1, "x " + " ".join(words) + " y"), (2, " ".join(words).lower())]), spark.createDataFrame([(7, " ".join(words))], "item_id long, text string"))
    assert {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in found.collect()} == {1: [7], 2: []}


def test_leaks_in_blocks(spark, docs, monkeypatch):
    monkeypatch.setattr("lodeworks.llm.decontamination.INDEX_BYTES", 100)
    items = [(k, " ".join(f"i{k}w{j}" for j in range(20))) for k in range(12)]
    out = with_leaks(docs([(k, "x y " + t) for k, t in items]), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r["doc_id"], tuple(x["item_id"] for x in r["leaks"])) for r in out.collect()} == {(k, (k,)) for k, _ in items}


# language model


def lm_tokens(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", words)] + ["\0end"]


@pytest.mark.parametrize("head", [200_000, 50])
def test_lm_against_brute_force(spark, sf_dir, monkeypatch, head):
    monkeypatch.setattr("lodeworks.llm.lm_score.HEAD_WORDS", head)
    monkeypatch.setattr("lodeworks.llm.lm_score.head_of.__defaults__", (head,))
    pairs = texts_of(spark, sf_dir)
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in pairs if not held(i) for w in lm_tokens(t))
    n, v = sum(c.values()), len(c)
    rows = {r["doc_id"]: r for r in op9_lm_score(spark, sf_dir).collect()}
    for i, t in pairs:
        w, r = lm_tokens(t), rows[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(w), sum(c[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel_tol=1e-9)
    out = [r for r in rows.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_lm_weights_sum_in_a_tree(spark, docs, monkeypatch):
    """Summing the tasks' weights two at a time or all at once gives one model."""
    rng = random.Random(8)
    made = kept(docs([(i, " ".join(rng.choice("abcdef") for _ in range(40))) for i in range(60)]).repartition(7, "doc_id"), "docs").repartition(7, "doc_id")
    whole = {r["doc_id"]: r["score"] for r in lm_scores(made).collect()}
    monkeypatch.setattr("lodeworks.llm.lm_score.FAN_IN", 2)
    tree = {r["doc_id"]: r["score"] for r in lm_scores(made).collect()}
    assert all(math.isclose(whole[i], tree[i], rel_tol=1e-3) for i in whole) and len(whole) == 60


def test_lm_every_context_has_a_row(spark, docs, monkeypatch):
    """Contexts are told apart however few rows the table of hashed features has."""
    monkeypatch.setattr("lodeworks.llm.lm_score.FEATURE_ROWS", 1)
    held = [i for i in range(4000) if zlib.crc32(str(i).encode()) % 5 == 1]
    learnt = [i for i in range(4000) if i not in set(held)]
    made = [(i, " ".join(f"{x}{i % 700}" for x in "abcdefgh")) for i in learnt] + [(held[0], " ".join(f"{x}9" for x in "abcdefgh")), (held[1], " ".join(f"{x}9" for x in "hgfedcba"))]
    score = {r["doc_id"]: r["score"] for r in lm_scores(docs(made)).collect()}
    assert score[held[0]] > score[held[1]] + 2


def test_lm_contexts_against_brute_force(spark, docs, monkeypatch):
    """Counts of contexts, over several parts and chunks, on top of a softmax that only knows its bias."""
    from lodeworks.llm import lm_score as lm

    monkeypatch.setattr(lm, "train_round", lambda docs, weights, bias: (weights, bias))
    monkeypatch.setattr(lm, "PART_TOKENS", 500)
    monkeypatch.setattr(lm, "CHUNK_BYTES", 700)
    rng = random.Random(3)
    made = [(i, " ".join(rng.choice("abcdefghij") + rng.choice("xy") for _ in range(rng.randrange(40)))) for i in range(150)] + [(150, None), (151, "jy new ax"), (151, "jy new ax")]
    kind = lambda w: int(lm.class_of(np.array([lm.xxhash.xxh3_64_intdigest(b"" if w == "\0end" else w.encode())], np.uint64))[0])
    learnt = [lm_tokens(t) for i, t in made if zlib.crc32(str(i).encode()) % 5 != 1]
    words = Counter(w for t in learnt for w in t)
    n_class, v_class, n = Counter(), Counter(kind(w) for w in words), sum(words.values())
    for w, c in words.items():
        n_class[kind(w)] += c

    def contexts(t, i):
        one, two = (t[i - k] if i >= k else k - i for k in (1, 2))
        return ("skip", two), ("one", one), ("two", one, two)

    seen = Counter(x for t in learnt for i, w in enumerate(t) for c in contexts(t, i) for x in (c, (c, kind(w))))

    def score(t):
        total = 0
        for i, w in enumerate(t):
            k = kind(w)
            p = (n_class[k] + 0.5) / (n + 0.5 * lm.CLASSES)
            for c, m in zip(contexts(t, i), lm.LOWER, strict=True):
                p = (seen[c, k] + m * p) / (seen[c] + m)
            total += math.log10(p) + math.log10((words[w] + 0.5) / (n_class[k] + 0.5 * (v_class[k] + 1)))
        return total

    rows = lm_scores(docs(made).repartition(3)).collect()
    assert len(rows) == len(made)
    texts = dict(made)
    assert all(math.isclose(r["score"], score(lm_tokens(texts[r["doc_id"]])), rel_tol=1e-5) for r in rows)


def test_lm_odd_rows(spark, docs):
    made = docs([(1, None), (1, None), (2, ""), (None, "a b"), (3, "A b " * 30_000), (4, "unseen")]).withColumnRenamed("lang", "score").withColumnRenamed("source", "key")
    rows = lm_scores(made).collect()
    assert len(rows) == 6 and all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) for r in rows)
    assert Counter(r["n_tokens"] for r in rows) == {1: 3, 3: 1, 60_001: 1, 2: 1}
    assert lm_scores(made.limit(0)).count() == 0


# packing


def test_best_fit():
    put, contents = best_fit([900, 500, 300, 100, 24], [512, 1024], 10)
    assert put == [0, 1, 2, 0, 0] and contents == [1024, 500, 300]
    rng = random.Random(4)
    for _ in range(50):
        lengths = sorted((rng.randrange(1, 4097) for _ in range(rng.randrange(1, 200))), reverse=True)
        put, sizes = pack(lengths)
        full = Counter()
        for n, b in zip(lengths, put, strict=True):
            full[b] += n
        assert all(full[b] <= sizes[b] and sizes[b] in SIZES for b in full) and len(sizes) == len(full)
        assert all(s == min(x for x in SIZES if x >= full[b]) for b, s in enumerate(sizes))
    assert pack([]) == ([], [])


def check_packing(rows, words):
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["n_tokens"]))
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append((r["offset"], r["n_tokens"], r["bin_size"]))
    for doc, n in words.items():
        at = 0
        for k, (piece, start, size) in enumerate(sorted(pieces[doc])):
            assert piece == k and start == at
            at += size
        assert at == n
    for held in bins.values():
        at = 0
        for offset, n, size in sorted(held):
            assert offset == at and size in SIZES
            at += n
        assert held[0][2] == min(s for s in SIZES if s >= at)


def test_packing(spark, sf_dir):
    check_packing(op10_packing(spark, sf_dir).collect(), {i: len(lm_tokens(t)) - 1 for i, t in texts_of(spark, sf_dir)})


def test_packing_odd_rows(spark, docs):
    made = docs([(1, None), (2, ""), (3, "w " * 10_000), (None, "a b"), (5, "a"), (6, "w " * 4096)]).withColumnRenamed("lang", "bin_id").withColumnRenamed("source", "shard")
    rows = pack_documents(made, word_count(F.col("text")), shard_pieces=3).collect()
    check_packing(rows, {1: 0, 2: 0, 3: 10_000, None: 2, 5: 1, 6: 4096})
    twice = pack_documents(docs([(1, "a b"), (1, "a b")]), word_count(F.col("text"))).collect()
    assert len(twice) == 2 and pack_documents(made.limit(0), word_count(F.col("text"))).count() == 0


def test_packed_sequences_round_trip(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = kept(pack_documents(docs, word_count(F.col("text"))), "packed")
    pieces = defaultdict(dict)
    for r in packed_sequences(docs, packed).collect():
        assert len(r["tokens"]) <= r["bin_size"]
        for b in r["bounds"]:
            pieces[b["id"]][b["piece"]] = r["tokens"][b["offset"] : b["offset"] + b["n_tokens"]]
    for i, t in texts_of(spark, sf_dir):
        assert [w for k in sorted(pieces[i]) for w in pieces[i][k]] == __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")


# quality rules


def test_cascade_order_and_short_circuit(spark):
    """The share of a later rule is counted on what earlier ones leave, and a dear rule never sees a rejected row."""
    rows = spark.range(400).select("id", (F.col("id") % 10).alias("x"))
    order = cascade_order(rows, {"never": F.col("x") < 0, "most": F.col("x") < 8, "same": F.col("x") < 8}, columns=("x",))
    names = [k for k, _, _ in order]
    assert sorted(names) == ["most", "never", "same"] and names[0] != "never"
    assert [round(share, 2) for _, _, share in order if share] == [0.8]
    rules = {"cheap": F.col("x") < 5, "dear": F.when(F.col("x") < 5, F.raise_error(F.lit("seen")).cast("boolean")).otherwise(F.col("x") == 7)}
    got = Counter(r[0] for r in rows.select(first_failed(rules, ["cheap", "dear"])).collect())
    assert got == {"cheap": 200, "dear": 40, None: 160}


# WARC


def test_warc_against_brute_force(spark, sf_dir, as_tables):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html")
    extra = spark.createDataFrame([(9001, "x" * 70_000), (9000, "x" * 70_000), (9002, None), (9003, ""), (9004, "é\r\n\r\nWARC/1.1\r\n" * 3000)], "page_id long, html string")
    folder = as_tables(pages=pages.unionByName(extra).selectExpr("page_id", "html", "'u' as record_type"))
    rows = {r["page_id"]: r["html"] or "" for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i], i)
    got = op5_warc_segments(spark, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = rows[r["page_id"]].encode()
        lead = first[rows[r["page_id"]]]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if lead == r["page_id"] else ("revisit", lead))


def test_warc_payloads(spark, tmp_path):
    long = "é" * 40_000
    made = spark.createDataFrame([(1, long), (1, long), (None, "n"), (2, "short")], "page_id long, html string")
    write_archives(made, f"{tmp_path}/w", segment_bytes=1000)
    got = sorted((r["record_id"].split(":")[2], bytes(r["payload"]).decode(), r["complete"]) for r in read_archives(spark, f"{tmp_path}/w").collect())
    assert got == sorted([("1", long, True), ("1", long, True), ("", "n", True), ("2", "short", True)])
    write_archives(made.limit(0), f"{tmp_path}/none")
    assert read_archives(spark, f"{tmp_path}/none").count() == 0


def test_warc_parts():
    assert unchunked(chunked(b"abc" * 3000, 100)) == b"abc" * 3000 and unchunked(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        unchunked(b"9\r\nabc")
    with pytest.raises(ValueError):
        list(parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nabc"))


def test_warc_missing_segment(spark, tmp_path):
    made = spark.createDataFrame([(1, "z" * 5000)], "page_id long, html string")
    write_archives(made, f"{tmp_path}/w", segment_bytes=1000)
    import glob
    import gzip

    (path,) = glob.glob(f"{tmp_path}/w/part-*")
    raw = gzip.open(path).read()
    records = raw.split(b"WARC/1.1\r\n")
    cut = b"WARC/1.1\r\n".join(r for r in records if b"WARC-Segment-Number: 2" not in r)
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc").write_bytes(cut)
    (row,) = read_archives(spark, f"{tmp_path}/cut").collect()
    assert not row["complete"] and row["payload"] is None


# pipeline


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = kept(stage(spark, docs, sf_dir), name)
        if k < 4:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            after = {r["doc_id"]: r["text"] for r in out.collect()}
            assert set(after) <= set(before)
        if name == "line_dedup":
            gone = {r["id"]: r["removed"] for r in removed_lines(docs).collect()}
            assert shares(gone, brute_lines(before.items())) >= 0.95
            want = {i: "\n".join(x for j, x in enumerate(t.split("\n")) if j not in gone.get(i, [])) for i, t in before.items()}
            assert after == {i: t for i, t in want.items() if t.strip()}
        if name == "near_dedup":
            assert set(after) == set(brute_classes(before.items()).values())
        if name == "decontamination":
            assert set(after) == set(before) - {d for d, _ in brute_leaks(before.items(), bench)}
        docs = out
    check_packing(docs.collect(), {i: len(lm_tokens(t)) - 1 for i, t in after.items()})
    assert sorted(map(str, corpus_pipeline.run(spark, sf_dir).select("doc_id", "n_tokens").collect())) == sorted(map(str, docs.select("doc_id", "n_tokens").collect()))

"""Operators that work row by row: licence scan, quality rules, classifier, chat formatting."""

from __future__ import annotations

import re
import zlib

import numpy as np
import pytest

from lodeworks.llm import queries
from lodeworks.llm.chat_prefix import expand, read_digests, turns_of
from lodeworks.llm.license_scan import BASE, RareIndex, op1_license_scan, scan_licenses, templates, words_of
from lodeworks.llm.quality_classifier import FEATURES, Ranker, fit, number, op6_quality_classifier, order_statistics, ordered, score_quality
from lodeworks.llm.quality_rules import Rules, cascade_order, n_repeat_words, quality_cascade
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, sf_dir, name):
    same(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], sf_dir)


def brute_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    at = sorted((i, label) for phrase, label in BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split())
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in at}))


def test_licenses_against_brute_force(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in op1_license_scan(spark, sf_dir).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_licenses_odd_rows(spark, docs):
    long = "word " * 50_000 + "Released under the MIT-License. mit license"
    made = docs([(1, None), (2, ""), (3, "MIT license, mit LICENSE"), (3, "MIT license, mit LICENSE"), (None, long), (4, "Licensed under CC BY-NC 4.0.")])
    got = sorted(((r["doc_id"] or -1, r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["labels"]) for r in scan_licenses(made.withColumnRenamed("lang", "labels")).collect()), key=repr)
    assert got[0] == (-1, 1, 50_003, 50_003, "mit", "mit")
    assert got[1:] == [(1, 0, None, None, "", ""), (2, 0, None, None, "", ""), (3, 2, 0, 2, "mit", "mit"), (3, 2, 0, 2, "mit", "mit"), (4, 0, None, None, "", "cc-by-nc")]
    assert scan_licenses(made.limit(0)).count() == 0


def test_index_finds_every_place():
    """The rare postings lose no place that verification of every position would find."""
    found = templates()
    index = RareIndex(found, {}, 10)
    rng = np.random.default_rng(0)
    vocabulary = sorted({w for t in found for w in t.words})
    for _ in range(60):
        words = [vocabulary[i] for i in rng.integers(0, len(vocabulary), 60)] + words_of("you can redistribute it and or modify it under the terms of the gnu general public license")
        for k, t in enumerate(found):
            every = {s for s in range(-5, len(words)) if index.verified(t, words, s)}
            got = index.places(words).get(k, set())
            assert got <= every and bool(got) == bool(every)
            if t.base:
                assert got == every


def brute_repeat(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(words) - size + 1):
        seen.setdefault(tuple(words[i : i + size]), []).append(i)
    return len({i + k for at in seen.values() if len(at) > 1 for i in at for k in range(size)})


def test_repeat_words(spark, docs):
    texts = [None, "", "a", "a b c d", "a b c d e", "a b c d e a b c d e", "x " * 40, "a b c d e f a b c d e g a\tb\nc d  e", "q " * 3 + " ".join(map(str, range(30))) + " 3 4 5 6 7 8"]
    got = {r[0]: r[1] for r in docs(enumerate(texts)).selectExpr("doc_id", "coalesce(text, '') as text").select("doc_id", n_repeat_words(__import__("pyspark").sql.functions.col("text"))).collect()}
    assert got == {i: brute_repeat(t) for i, t in enumerate(texts)}


def test_cascade(spark, docs):
    clean = " ".join(f"word{i}" for i in range(30))
    made = docs([(1, clean), (2, None), (3, ""), (4, "%% " * 30), (5, clean.upper()), (None, clean), (1, clean), (6, clean + " " + "z" * 4000)])
    made = made.withColumnRenamed("lang", "failed_rule").withColumnRenamed("source", "kept")
    out = {(r["doc_id"], r["text"]): (r["kept"], r["failed_rule"]) for r in quality_cascade(made).collect()}
    assert out[1, clean] == out[None, clean] == (True, None)
    assert out[2, None] == out[3, ""] == (False, "few_words")
    assert not out[4, "%% " * 30][0] and out[5, clean.upper()] == (False, "upper_case")
    assert out[6, clean + " " + "z" * 4000] == (False, "word_length")
    assert quality_cascade(made.limit(0)).count() == 0
    rules = Rules().columns(__import__("pyspark").sql.functions.col("text"))
    assert sorted(x[0] for x in cascade_order(made.select("text"), rules)) == sorted(rules)


def test_classifier_held_out(spark, sf_dir):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = op6_quality_classifier(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    judged = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in judged) >= 0.9 * len(judged)


def test_classifier_odd_rows(spark, docs):
    made = docs([(1, None), (2, ""), (None, "x"), (3, "a b c"), (3, "a b c"), (4, "w " * 100_000)]).withColumnRenamed("lang", "score")
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    rows = score_quality(made, none).collect()
    assert len(rows) == 6 and {(r["score"], r["predicted"]) for r in rows} == {(0.5, 1)}
    assert score_quality(made.limit(0), none).count() == 0


def test_bradley_terry_ranks():
    rng = np.random.default_rng(1)
    label = rng.integers(0, 2, 400)
    x = rng.normal(size=(400, len(FEATURES)))
    x[:, 2] += 3 * label
    model = fit(x, label, pairs=4000)
    s = model.score(x)
    assert np.mean((s >= 0.3) == (label == 1)) > 0.9 and model.weights[2] > 0
    assert isinstance(fit(x, np.ones(400)), Ranker)


def test_all_pairs_count():
    rng = np.random.default_rng(3)
    label = rng.integers(0, 2, 300)
    x = rng.normal(size=(300, len(FEATURES)))
    x[:, 2] += label
    model = fit(x, label)
    z = np.clip((x - model.mean) / model.spread, -8, 8)
    d = (z[label == 1][:, None] - z[label == 0][None, :]).reshape(-1, len(FEATURES))
    slope = (d / (1 + np.exp(d @ model.weights))[:, None]).mean(axis=0) - 1e-3 * model.weights
    assert np.abs(slope).max() < 1e-3


def test_every_label_is_learned_from(spark, docs):
    rng = np.random.default_rng(4)
    letters = np.array(list("abcdefgABC012!;#é "))
    texts = ["".join(rng.choice(letters, 60 + k % 97)) for k in range(14_000)]
    label = [int(rng.random() < (0.8 if len(t) > 100 else 0.4)) for t in texts]
    labels = spark.createDataFrame(list(enumerate(label)), "doc_id long, quality int")
    rows = score_quality(docs(list(enumerate(texts))), labels).collect()
    trained = [r for r in rows if not r["held_out"]]
    assert len(trained) > 11_000
    # the threshold is the quantile of all training texts, so as many of them lie below it as have label 0
    bad = sum(1 - label[r["doc_id"]] for r in trained)
    assert len({r["score"] for r in trained}) > 0.99 * len(trained)
    assert abs(sum(1 - r["predicted"] for r in trained) - bad) <= 3


def test_order_statistics(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=500), 1)
    assert [number(int(k)) for k in ordered(x)] == (x + 0.0).tolist()
    keys = spark.createDataFrame([(int(k),) for k in ordered(x)], "key long")
    s = np.sort(x)
    for rank in (1, 2, 250, 400, 499):
        assert [number(k) for k in order_statistics(keys, rank)] == [s[rank - 1], s[rank]]


def test_chat_round_trip(spark):
    marks = ["</s>", "[INST]", "[/INST]", "\\", "\\b", "\\e", "</s", "[INST\\]", "", "\n", "é\U0001f600", None]
    turns = [(c, k, "assistant" if k % 2 else "user", a and a + (b or "")) for c, a in enumerate(marks) for k, b in enumerate(marks)]
    made = spark.createDataFrame([*turns, (99, 0, "user", "no reply"), (None, None, None, "x")], "conv_id long, turn long, role string, text string").selectExpr("*", "'q' as example", "1 as trained")
    rows = expand(made)
    read = {r["conv_id"]: [(x["role"], x["text"]) for x in r["t"]] for r in rows.select("conv_id", "example", turns_of(rows["text"]).alias("t")).orderBy("example").collect()}
    for c in range(len(marks)):
        assert read[c] == [(role, text or "") for cc, _, role, text in turns if cc == c]
    assert read[None] == [("", "x")]
    told = {r["conv_id"]: r for r in read_digests(rows).collect()}
    assert told[99]["loss_chars"] == 0 and told[99]["n_turns"] == 1
    assert told[0]["loss_chars"] == sum(len(text or "") for c, k, role, text in turns if c == 0 and role == "assistant")
    assert expand(made.limit(0)).count() == 0

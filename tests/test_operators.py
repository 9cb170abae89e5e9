from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodeworks.functions.names import compatible_names, name_blocks, name_score, name_words, near_name, ratio, untitled
from lodeworks.functions.numbers import cosine, mcnemar_p, nearest_rank, wilson
from lodeworks.functions.text import norm_text
from lodeworks.operators import checks, chunking
from lodeworks.operators import claims as cl
from lodeworks.operators import evaluate as ev
from lodeworks.operators import graph, reach, resolve, retrieval
from lodeworks.operators.answers import cited
from lodeworks.operators.cards import fitted, screen, ungrounded
from lodeworks.operators.chunking import chunk_text, chunks, within_budget
from lodeworks.operators.profile import examples, foreign_keys, profile
from lodeworks.plans import construction as con
from lodeworks.plans.steps import Run, Step, Store, check, read_steps
from lodeworks.plans.typed import Refused, Where


def test_profile_and_keys(spark):
    hives = spark.createDataFrame([("h1", "North"), ("h2", "South")], "hive_id string, hive_name string")
    prose = "A long first sentence of many words that goes on and on. And another one follows it, just as long as the first was."
    frames = spark.createDataFrame([("h1", 1, prose), ("h1", 2, prose), ("h2", 1, None), ("h9", 1, prose)], "hive_id string, frame_no int, note string")
    told = {(r["table"], r["column"]): r for r in profile({"hives": hives, "frames": frames}).collect()}
    assert told["hives", "hive_id"]["is_unique"] and not told["frames", "hive_id"]["is_unique"]
    assert told["frames", "note"]["nulls"] == 1 and told["frames", "note"]["is_prose"] == (len(prose) >= 120)
    tables = {"hives": hives, "frames": frames}
    assert foreign_keys(tables).count() == 0
    (loose,) = foreign_keys(tables, least=0.6).where("from_table = 'frames'").collect()
    assert (loose["to_table"], loose["name_match"], round(loose["inclusion"], 3)) == ("hives", True, 0.667)
    stated = spark.createDataFrame([("frames", "hive_id", "hives", "hive_id")], "from_table string, from_column string, to_table string, to_column string")
    assert foreign_keys(tables, declared=stated).first()["declared"]
    assert profile({"none": hives.limit(0)}).where("is_unique").count() == 0
    mixed = spark.createDataFrame([("2001",), ("2002",), ("2003",), ("2004-06",)], "v string")
    assert [r["v"] for r in examples(mixed, "v", 3).collect()] == ["2001", "2002", "2004-06"]


@pytest.fixture(scope="module")
def garden(spark):
    beds = spark.createDataFrame([(1, "Rose bed", "open. warm."), (2, "Herb bed", None), (2, "Herb bed two", None), (None, "lost", None)], "bed_id int, name string, notes string")
    plants = spark.createDataFrame([("p", 1, 1), ("p", 2, 2), ("q", 1, 9), ("q", None, 1), (" ", 3, 1)], "kind string, no int, bed int")
    plan = con.Plan((con.NodeRule("beds", "Bed", ("bed_id",), ("name", "notes")), con.NodeRule("plants", "Plant", ("kind", "no"))), (con.EdgeRule("plants", "GROWS_IN", "Plant", ("kind", "no"), "Bed", ("bed",)),))
    return plan, {"beds": beds, "plants": plants}


def test_construction(garden):
    plan, tables = garden
    g = con.build(plan, tables)
    assert sorted(r["ref"] for r in g.nodes.collect()) == ["Bed:1", "Bed:2", "Plant:p|1", "Plant:p|2", "Plant:q|1"]
    assert sorted((r["src"], r["dst"]) for r in g.edges.collect()) == [("Plant:p|1", "Bed:1"), ("Plant:p|2", "Bed:2")]
    report = {r["rule"]: tuple(r)[1:] for r in g.report.collect()}
    assert report == {"Bed": (4, 1, 2, 0), "Plant": (5, 2, 3, 0), "GROWS_IN": (5, 2, 2, 1)}
    assert con.record_documents(g.records["Bed"], "Bed", ("notes",)).collect()[0]["doc_id"] == "record/Bed/1"
    unique = con.unique_by(tables)
    assert con.check(plan, tables, unique) and not con.check(plan, tables)
    assert con.check(con.Plan(plan.nodes), tables) == ["some labels are joined to no others"]
    for bad in (con.Plan((con.NodeRule("nope", "A", ("x",)),)), con.Plan((con.NodeRule("beds", "A b", ("x",)),)), con.Plan(plan.nodes, (con.EdgeRule("plants", "E", "Plant", ("kind",), "Tree", ("bed",)),))):
        assert con.check(bad, tables)
    assert con.refine(lambda hint: plan if hint else con.Plan(plan.nodes), lambda p: con.check(p, tables)) == (plan, [])


def test_steps(garden):
    plan, tables = garden
    g = con.build(plan, tables)
    store = Store(g.records, g.nodes, g.edges)
    steps = (Step("filter_records", label="Bed", where=(Where("name", "contains", "bed"),)), Step("related", input=0, relationship="GROWS_IN", label="Plant"))
    assert Run(store, (*steps, Step("count", input=1))).result.first()["value"] == 2
    assert Run(store, (*steps, Step("rank", input=0, relationship="GROWS_IN"))).result.count() == 2
    assert [r["id"] for r in Run(store, (Step("find_entity", label="Bed", name="rose BED"), Step("list", input=0))).result.collect()] == ["Bed:1"]
    for bad in ((), steps, (Step("count"),), (Step("filter_records", label="X"), Step("count", input=0)), (Step("filter_records", label="Bed"), Step("about", input=0), Step("count", input=1)), (Step("count", input=0), Step("list", input=0))):
        assert check(bad, store)
        with pytest.raises(Refused):
            Run(store, bad)
    assert read_steps((Step("find_claims"), Step("list", input=0))) == {0} and read_steps((Step("find_claims"), Step("count", input=0))) == set()


def test_claim_steps(spark, garden):
    plan, tables = garden
    g = con.build(plan, tables)
    rows = [("c1", "k1", "likes", "Bed:1", "sun", "affirmed"), ("c2", "k2", "likes", "Bed:2", "sun", "negated"), ("c3", "k3", "needs", "Bed:2", "rain", "affirmed")]
    claims = spark.createDataFrame(rows, "claim_id string, chunk_id string, predicate string, subject string, object string, truth string")
    about = claims.select("claim_id", F.col("subject").alias("ref"))
    store = Store(g.records, g.nodes, g.edges, claims, about)
    count = lambda *plan: Run(store, (*plan, Step("count", input=len(plan) - 1))).result.first()["value"]
    assert count(Step("find_claims", predicate="likes")) == 1
    assert count(Step("filter_records", label="Bed"), Step("find_claims", input=0, truth=None)) == 3
    assert count(Step("find_claims"), Step("about", input=0, label="Bed")) == 2
    assert count(Step("find_claims"), Step("retrieve_chunks", input=0)) == 2


def test_graph(spark):
    edges = spark.createDataFrame([("E", "a", "b"), ("E", "b", "c"), ("E", "c", "d"), ("E", "x", "y"), ("E", "z", "z")], "type string, src string, dst string")
    start = spark.createDataFrame([("a",)], "ref string")
    assert {(r["ref"], r["hops"]) for r in graph.hops(start, edges, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r["node"]: r["comp"] for r in graph.components(edges).collect()} == {"a": "a", "b": "a", "c": "a", "d": "a", "x": "x", "y": "x"}
    assert graph.components(edges.limit(0)).count() == 0
    nodes = spark.createDataFrame([(c, "L") for c in "abcdxyz"], "ref string, label string")
    pats = graph.schema_patterns(edges, nodes)
    assert pats.first()["n"] == 5 and graph.direction_of(pats, "E", "L") == "both"


def test_sample(spark):
    a = spark.createDataFrame([(1,), (2,)], "a long")
    b = spark.createDataFrame([(10, 1, 7), (11, 2, 8), (12, 1, None)], "b long, a long, c long")
    c = spark.createDataFrame([(7, 8), (8, None), (9, None)], "c long, up long")
    kept = graph.sample_rows({"a": a, "b": b, "c": c}, [("b", "a", "a", "a"), ("b", "c", "c", "c"), ("c", "up", "c", "c")], "a", a.where("a = 1"))
    assert {k: sorted(r[0] for r in v.collect()) for k, v in kept.items()} == {"a": [1], "b": [10, 12], "c": [7, 8]}


def test_token_sort_pairs(spark):
    """Blocking loses no pair that all-pairs scoring finds."""
    rng = random.Random(6)
    stems = ["oak table", "side table", "oak tables", "lamp", "lamps", "bed", "beds", "stockholm chair", "chair stockholm", "stockholm chairs", "ab", "ba", "a"]
    names = [s if rng.random() < 0.5 else s[: rng.randrange(1, len(s) + 1)] + rng.choice("abcxyz") + s[rng.randrange(len(s)) :] for s in stems * 8]
    rows = [(i, rng.choice("KL"), n) for i, n in enumerate(names)]
    key = lambda n: " ".join(sorted(norm_text(n).split(" ")))
    want = set()
    for i, t, n in rows:
        for j, u, m in rows:
            if i < j and t == u and key(n) != key(m) and ratio(key(n), key(m)) >= 80:
                want.add((key(n), key(m), t) if key(n) < key(m) else (key(m), key(n), t))
    got = set()
    by = {i: (t, key(n)) for i, t, n in rows}
    for r in resolve.candidate_pairs(spark.createDataFrame(rows, "id long, type string, name string")).collect():
        x, y = by[r["a"]][1], by[r["b"]][1]
        if x != y:
            got.add((min(x, y), max(x, y), r["type"]))
    assert got == want
    assert ratio("tables", "table") == pytest.approx(90.909, abs=0.001) and ratio("", "") == 100


def test_resolution(spark):
    e = spark.createDataFrame([(1, "K", "Tables", 3), (2, "K", "Table", 5), (3, "K", "lamp", 1), (4, "K", "Lamps", 1), (5, "L", "table", 9)], "id long, type string, name string, mentions long")
    decisions = resolve.decide(resolve.candidate_pairs(e), auto=88.0)
    assert {(r["a"], r["b"], r["decision"]) for r in decisions.collect()} == {(1, 2, "auto"), (3, 4, "auto")}
    groups = {r["id"]: r["canonical"] for r in resolve.merge_groups(e, decisions).collect()}
    assert groups == {1: 2, 2: 2, 3: 3, 4: 3, 5: 5}
    assert {r["id"]: r["canonical"] for r in resolve.in_passes(e, auto=88.0).collect()} == groups
    parts = spark.createDataFrame([(2, 1)], "part long, whole long")
    assert [r["a"] for r in resolve.part_and_whole(decisions, parts).collect()] == [3]
    view = {r["canonical"]: r["names"] for r in resolve.merged_view(e, resolve.merge_groups(e, decisions)).collect()}
    assert view[2] == ["Table", "Tables"]


def test_claims(spark):
    m = spark.createDataFrame([("m1", "A", "d1"), ("m2", "a.", "d2"), ("m3", "B", "d2")], "mention_id string, name string, doc_id string")
    to = spark.createDataFrame([("m1", "E"), ("m2", "E")], "mention_id string, canonical string")
    assert {r["canonical"]: (r["names"], r["documents"]) for r in cl.aliases(m, to).collect()} == {"E": (["A", "a."], 2), "m3": (["B"], 1)}
    c = spark.createDataFrame([("c1", "no more", "Pumps", "negated", "no more")], "claim_id string, subject_name string, object_name string, truth string, negation string")
    assert cl.triple_truth(c).first()["triple_truth"] == "affirmed"
    quotes = spark.createDataFrame([("a", "k", "said"), ("a", "k", "never"), ("b", "zz", "x")], "answer string, chunk_id string, quote_norm string")
    texts = spark.createDataFrame([("k", "it said so")], "chunk_id string, text_norm string")
    assert {(r["answer"], r["quote_norm"]) for r in cl.unsupported(quotes, texts).collect()} == {("a", "never"), ("b", "x")}


def test_chunks(spark):
    text = "# Head\n\nshort\n---\n" + "word " * 500 + "\n\n" + "x" * 1700 + "\n---\nend"
    made = chunk_text(text)
    assert "".join("".join(c.split()) for c in made) == "".join(text.replace("---", "").split())
    assert all(len(c) >= 200 for c in made) and made[0].startswith("# Head")
    assert chunk_text("") == chunk_text(None) == [] and chunk_text("tiny") == ["tiny"]
    over = chunk_text("para one " * 300, most=500, least=10, overlap=40)
    assert all(b.split("\n\n")[0] in a for a, b in zip(over, over[1:], strict=False))
    docs = spark.createDataFrame([("d", "t", text), ("e", "t", None)], "doc_id string, title string, text string")
    rows = chunks(docs).collect()
    assert [r["chunk_id"] for r in rows] == [f"d#{i}" for i in range(len(made))] and {r["context"] for r in rows} == {"Head"}
    assert within_budget(chunks(docs), 2000).agg(F.sum(F.length("text"))).first()[0] <= 2000


def test_fusion(spark):
    lists = spark.createDataFrame([(0, 0, "a", 1), (0, 0, "b", 2), (0, 1, "b", 1), (0, 1, "c", 2)], "query int, list int, id string, rank int")
    order = lambda df: [r["id"] for r in df.orderBy("rank").collect()]
    assert order(retrieval.rrf(lists)) == ["b", "a", "c"] and order(retrieval.interleave(lists)) == ["a", "b", "c"]
    assert order(retrieval.rrf(lists.where("list = 0"))) == ["a", "b"] and retrieval.rrf(lists.limit(0)).count() == 0
    groups = spark.createDataFrame([(0, "g", 1, "a"), (0, "h", 2, "b"), (0, "g", 3, "c"), (0, "i", 4, "d")], "query int, group string, rank int, id string")
    assert {r["id"] for r in retrieval.whole_groups(groups, 3).collect()} == {"a", "b", "c"}
    assert {r["id"] for r in retrieval.whole_groups(groups, 1).collect()} == {"a", "c"}
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0])], "id int, v array<double>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "query int, v array<double>")
    assert [(r["id"], r["score"] is None) for r in retrieval.nearest(vectors, q, 9).orderBy("rank").collect()] == [(1, False), (4, False), (2, False), (3, True)]


def test_evaluation(spark):
    assert mcnemar_p(0, 0) == 1 and mcnemar_p(1, 9) == pytest.approx(0.021484375) and mcnemar_p(5, 5) == 1
    r = spark.range(1).select(*wilson(F.lit(191), F.lit(200)), nearest_rank(F.array(*map(F.lit, (1, 2, 3, 4))), 0.5)).first()
    assert (round(r[0], 3), round(r[1], 3), r[2]) == (0.917, 0.976, 2)
    a = spark.createDataFrame([(1, True), (2, False)], "question int, passed boolean")
    assert ev.paired(ev.paired_join(a, a)).first()["both"] == 1
    with pytest.raises(ValueError):
        ev.paired_join(a, a.where("question = 1"))


def test_names(spark):
    def told(f, *pairs):
        rows = spark.createDataFrame([(i, *x) for i, x in enumerate(pairs)], "i int, a string, b string")
        return [r[0] for r in rows.select(f("a", "b"), "i").orderBy("i").collect()]

    same = ("Chair Stockholm", "Stockholm Chair"), ("bed-side table", "Bedside Table"), ("Dr Jonathan Pike", "jonathan pike"), ("de luxe", "Deluxe"), ("Åsa", "asa")
    assert told(name_score(92), *same, ("Tables", "Table"), ("", "x"), (None, "x"), ("Dr", "Dr")) == [100, 100, 100, 100, 100, None, None, None, 100]
    assert told(name_score(85), ("Tables", "Table")) == [pytest.approx(90.909, abs=0.001)]
    assert told(name_score(80), ("drawer slides", "Drawer Sides"), ("A-1063", "A-1062")) == [None, None]
    assert told(near_name(99), ("drawer", "Drawer Unit"), ("legs", "Leg"), ("of", "of a"), ("", "")) == [True, True, False, False]
    assert told(compatible_names, ("J. Pike", "Dr. Jonathan Pike"), ("Jon Pike", "Jonathan A. Pike"), ("Jo Pike", "Joanna Pike"), ("Pike", "Jonathan Pike"), ("", "x"), (None, "x")) == [True, True, False, False, False, None]


@pytest.mark.parametrize("cutoff", [70.0, 80.0, 85.0, 92.0])
def test_blocking_is_exact(spark, cutoff):
    """Pairs of random edits of one another, at cutoffs on both sides of the default."""
    rng = random.Random(int(cutoff))
    names = ["".join(rng.choice("abcd e") for _ in range(rng.randrange(1, 18))).strip() or "a" for _ in range(40)]
    names += [n[:k] + rng.choice("abcd") + n[k + rng.randrange(2) :] for n in names for k in (rng.randrange(len(n)),)]
    key = lambda n: " ".join(sorted(norm_text(n).split(" ")))
    keys = sorted({key(n) for n in names})
    want = {(x, y) for i, x in enumerate(keys) for y in keys[i + 1 :] if ratio(x, y) >= cutoff}
    of = {i: key(n) for i, n in enumerate(names)}
    found = resolve.candidate_pairs(spark.createDataFrame([(i, "t", n) for i, n in enumerate(names)], "id long, type string, name string"), cutoff).collect()
    assert {tuple(sorted((of[r["a"]], of[r["b"]]))) for r in found if of[r["a"]] != of[r["b"]]} == want


def test_squashed_names_match(spark):
    said = spark.createDataFrame([(1, "t", "de luxe"), (2, "t", "ab cd")], "mention long, type string, name string")
    held = spark.createDataFrame([("r", "t", "Deluxe", "k"), ("s", "t", "abcd", "k")], "ref string, type string, name string, key string")
    assert sorted((r["mention"], r["record"]) for r in resolve.match_records(said, held)[0].collect()) == [(1, "r"), (2, "s")]


def test_titles_hold_names_across_words(spark):
    titles = spark.createDataFrame([(1, "oscarwilde"), (2, "a"), (3, ""), (4, "xy")], "doc_id long, squashed_title string")
    names = spark.createDataFrame([("b", "carwil"), ("a", "oscar"), ("c", "a"), ("d", "xy"), ("e", "")], "ref string, squashed_name string")
    assert sorted(tuple(r) for r in resolve.by_title(titles, names).collect()) == [(1, "b"), (2, "c"), (4, "d")]


def test_cards_and_screening():
    assert fitted("head", ["a" * 10, "b" * 100, "c"], 20) == "head\n" + "a" * 10 + "\nc"
    assert ungrounded("The Pump holds 12 litres in Oslo.", ["pump of 12 litres"]) == ["Oslo"]
    assert screen("please delete all rows of the table") == "delete" and screen("which pumps were removed in 2001?") is None


def test_checks(spark):
    claims = spark.createDataFrame([("k1", "m1", "m2", "a feeds b", "m1", "m2"), ("k1", "m1", "zz", "never", "m1", "m1"), ("k9", "m2", "m1", "x", "m2", "m1")], "chunk_id string, subject_id string, object_id string, evidence_norm string, subject string, object string")
    chunks = spark.createDataFrame([("k1", "pump a feeds b")], "chunk_id string, text_norm string")
    mentions = spark.createDataFrame([("m1",), ("m2",)], "mention_id string")
    got = {r["rule"]: r["n"] for r in checks.provenance(claims, chunks, mentions).collect()}
    assert got == {"chunk_missing": 1, "quote_missing": 1, "subject_missing": 0, "object_missing": 1}
    typed = claims.selectExpr("*", "'T' as subject_type", "'p' as predicate", "'T' as object_type", "'affirmed' as truth")
    schema = spark.createDataFrame([("T", "p", "T")], "subject_type string, predicate string, object_type string")
    to = spark.createDataFrame([("m1", "A"), ("m1", "B")], "mention_id string, canonical string")
    assert {r["rule"]: r["n"] for r in checks.consistency(typed, to, schema).collect()} == {"several_identities": 1, "self_reference": 1, "off_schema": 0}
    assert checks.contradictions(typed).count() == 0


def test_reach(spark):
    beside = lambda s, n, k: spark.range(1).select(reach.key_beside(F.lit(s), F.lit(n), F.lit(k))).first()[0]
    assert beside("the pump (hp40-1183) ran", "pump", "hp40-1183") and beside("hp40-1183 pump", "pump", "hp40-1183")
    assert not beside("pump, hp40-1183", "pump", "hp40-1183") and not beside("pumps hp40", "pump", "hp40")
    chunks = spark.createDataFrame([("k", "Oak table and lamp")], "chunk_id string, text string")
    named = spark.createDataFrame([("k", "n2", ["LAMP"]), ("k", "n1", ["gone"]), ("k", "n3", ["table", "oak"])], "chunk_id string, ref string, names array<string>")
    about = spark.createDataFrame([("k", "r")], "chunk_id string, ref string")
    assert [r["ref"] for r in reach.in_reading_order(chunks, about, named).orderBy("place").collect()] == ["r", "n3", "n2", "n1"]
    units = spark.createDataFrame([(1, "P", "Dr. J. Pike"), (2, "P", "Jonathan Pike"), (3, "P", "Jonathan Pikes"), (4, "P", "Ann Other")], "id long, type string, name string")
    near = spark.createDataFrame([(4, 1)], "a long, b long")
    assert {(r["a"], r["b"], r["signal"]) for r in reach.nominated(units, near=near).collect()} == {(1, 2, "variant"), (2, 3, "spelling"), (1, 4, "meaning")}
    names = spark.createDataFrame([("d", "R:1", "outback")], "doc_id string, ref string, key string")
    said = spark.createDataFrame([("d", "m1", "2019 subaru outback", 2), ("d", "m2", "outback", 1), ("d", "m3", "escape", 9)], "doc_id string, mention_id string, key string, mentions long")
    assert reach.containing(names, said).first()["mention_id"] == "m1"
    claims = spark.createDataFrame([("c", "a", "b")], "claim_id string, subject string, object string")
    held = spark.createDataFrame([("r", "c")], "ref string, claim_id string")
    plain = spark.createDataFrame([("b", "a")], "a string, b string")
    assert {(r["a"], r["b"], r["witness"]) for r in reach.thing_joins(claims, held, plain).collect()} == {("a", "b", True), ("a", "r", False), ("b", "r", False)}
    gold = spark.createDataFrame([(1,), (2,), (3,)], "gold_id long")
    got = reach.judged(gold, gold.where("gold_id = 1"), spark.createDataFrame([(2, "same")], "gold_id long, status string"))
    assert {r["gold_id"]: r["status"] for r in got.collect()} == {1: "exact", 2: "same", 3: "open"}


def test_match_records_meet_on_all_words(spark):
    """F1: names that share a common word only aren't compared; every name with a score still meets its record."""
    rng = random.Random(3)
    stems = ["work", "works", "working", "workshop", "workshops", "grinder", "grinders", "grin", "abcdefghijk", "abcdefghijkl", "abcdefghijklmno", "abcdefghijklmnop", "a1", "a1b", "ox", "dr", "été", "étés"]
    names = sorted({" ".join(rng.choices(stems, k=rng.randint(0, 7))) for _ in range(140)} | {"Dr. Works Grinder", "work sgrinder", "one two three four five six seven", "ones twos three four five six seven"})
    rows = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    x, y = rows.select(F.col("id").alias("a"), F.col("name").alias("na")), rows.select(F.col("id").alias("b"), F.col("name").alias("nb"))
    brute = {}
    for r in x.crossJoin(y).withColumn("s", name_score(70.0)("na", "nb")).where("s is not null").collect():
        brute.setdefault(r["a"], {})[r["b"]] = r["s"]
    best = {(a, b) for a, of in brute.items() for b, s in of.items() if s == max(of.values())}
    mentions = rows.select(F.col("id").alias("mention"), F.lit("t").alias("type"), "name")
    records = rows.select(F.col("id").alias("ref"), F.lit("t").alias("type"), "name", F.lit(None).cast("string").alias("key"))
    found, _ = resolve.match_records(mentions, records, 70.0)
    assert {(r["mention"], r["record"]) for r in found.collect()} == best and len(best) > len(names) / 2
    pairs = sorted((a, b) for a in brute for b in brute[a])
    blocks = {r["id"]: (set(r["w"]), set(r["u"])) for r in rows.select("id", name_blocks(name_words(F.col("name"))).alias("w"), name_blocks(untitled(name_words(F.col("name")))).alias("u")).collect()}
    assert all((blocks[a][0] | blocks[a][1]) & blocks[b][0] for a, b in pairs)
    common = spark.range(200).select(F.concat(F.lit("Works "), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(" Grinder")).alias("name"))
    met = common.select(F.explode(name_blocks(name_words(F.col("name")))).alias("w")).groupBy("w").count()
    assert met.agg(F.max("count")).first()[0] == 1


def test_mutual_nearest_values(spark):
    """the same pairs as from all scores, with ties, copies, nulls and crowded values, and without forming all pairs."""
    rng = random.Random(5)
    rows = [(t, 100 * t + i, v) for t in range(30) for i, v in enumerate(rng.choice([round(rng.uniform(-3, 3), 1), rng.randint(0, 4) / 100]) for _ in range(rng.randint(1, 14)))]
    rows += [(40, 1, None), (40, 2, 1.0), (40, 3, 2.0), (41, 1, None), (41, 2, None), (42, 1, float("nan")), (42, 2, 1.0), (42, 3, 1.5), (43, 1, float("inf")), (43, 2, 1.0)]
    rows += [(44, 5, 0.0), (44, 4, 0.5), (44, 1, 0.5 + 1e-13), (45, 1, 0.0), (45, 1, 0.0), (45, 2, 1.0), (46, 1, 0.0), (46, 2, -0.0), (46, 3, 0.0), (None, 1, 1.0), (None, 2, 1.0), (47, None, 1.0), (47, 2, 1.0)]
    items = spark.createDataFrame(rows, "type int, id int, v double")
    told = lambda df: sorted(map(repr, df.select("type", "a", "b", "score").collect()))
    assert told(resolve.mutual_nearest_values(items, 1e6)) == told(resolve.mutual_nearest(resolve.value_scores(items, 1e6)))
    many = spark.range(200_000).select(F.lit(1).alias("type"), "id", (F.col("id") * F.col("id") / 100).alias("v"))
    assert resolve.mutual_nearest_values(many, 1e6).collect() == [(1, 0, 1, 1e6 - 0.01)]


def test_cosines_in_blocks(spark, monkeypatch):
    """blocks give the column's own doubles, with copies, nulls and vectors of other lengths, all pairs or the best."""
    monkeypatch.setattr(retrieval, "ROWS", 7)
    monkeypatch.setattr(retrieval, "TILE", 20)
    monkeypatch.setattr(retrieval, "OUT", 5)
    rng = random.Random(9)
    some = [[rng.uniform(-1, 1) for _ in range(6)] for _ in range(12)]
    vs = [rng.choice(some) for _ in range(50)] + [[0.0] * 6, None, [], [1.0, None, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], [3.0, 1.0], [float("nan")] * 6, [float("inf")] * 6, [1e200] * 6, [1e-200] * 6]
    v = spark.createDataFrame([(i, x, i % 3 if i % 10 else None) for i, x in enumerate(vs)], "id int, v array<double>, g int")
    q = v.where("id % 4 = 0 or id > 49").withColumnRenamed("id", "query")
    old = v.crossJoin(q.select("query", F.col("v").alias("q"), F.col("g").alias("h"))).select("query", "id", cosine(F.col("v"), F.col("q")).alias("score"), "g", "h")
    told = lambda df: sorted(repr(tuple(r)) for r in df.select("query", "id", "score").collect())
    assert told(retrieval.all_cosines(v, q)) == told(old)
    assert told(retrieval.all_cosines(v, q, group=True)) == told(old.where("g = h"))
    best = lambda df: sorted(repr(tuple(r)) for r in df.select("query", "id", "rank", "score").collect())
    for k in (1, 3, 100):
        assert best(retrieval.nearest(v, q, k)) == best(retrieval.ranked(old.select("query", "id", "score"), k))
    plan = retrieval.nearest(v, q, 3)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan


def test_edge_ends_meet_their_label_only(spark):
    """F8, F9, F10, F12: an end is looked up among its own label's records, and not at all if its row makes that record."""
    plan = con.Plan((con.NodeRule("a", "A", ("k",)), con.NodeRule("b", "B", ("k",), ("note",))), (con.EdgeRule("b", "OF", "A", ("a",), "B", ("k",)), con.EdgeRule("b", "NEXT", "B", ("k",), "B", ("next",))))
    a = spark.createDataFrame([("1",), ("2",), (None,)], "k string")
    b = spark.createDataFrame([("x", "1", "y", "n"), ("y", "9", "z", "n"), (None, "2", "x", "n"), (" ", "2", "x", "n"), ("w", None, "w", None), ("x", "1", "y", "m")], "k string, a string, next string, note string")
    g = con.build(plan, {"a": a, "b": b})
    assert sorted(map(tuple, g.edges.collect())) == [("NEXT", "B:w", "B:w"), ("NEXT", "B:x", "B:y"), ("OF", "A:1", "B:x")]
    of = g.typed_edges["OF:A:B"]._jdf.queryExecution().optimizedPlan().toString()
    assert of.count("Join LeftSemi") == 1
    assert sorted(map(tuple, con.relationships(b, plan.edges[0], g.nodes).collect())) == [("OF", "A:1", "B:x")]
    assert [tuple(r) for r in graph.overview(g.nodes, g.edges, 3).collect()] == [("B:w", "B", "w", 2), ("B:x", "B", "x", 2), ("A:1", "A", "1", 1)]
    assert {r["ref"] for r in graph.parts_of(spark.createDataFrame([("A:1",), ("A:2",)], "ref string"), g.edges, g.nodes).collect()} == {"B:x", "B:y"}
    assert {r["ref"] for r in graph.parts_of(spark.createDataFrame([("A:1",)], "ref string"), g.edges, g.nodes, ["A"]).collect()} == set()


def test_pairs_apart(spark, monkeypatch):
    """the pairs of ``same_sentence``, which aren't joined pair by pair."""
    monkeypatch.setattr(resolve, "RUN", 3)
    rng = random.Random(4)
    items = spark.createDataFrame([(i % 4, i, float(i)) for i in range(60)] + [(1, 2, 0.0), (2, 2, 0.0), (None, 99, 0.0)], "type int, id int, v double")
    named = spark.createDataFrame([(rng.randint(0, 60), rng.randint(0, 70)) for _ in range(300)] + [(None, 4), (None, 8), (3, None)], "sentence int, id int")
    told = lambda df: sorted(map(tuple, df.select("type", "a", "b").collect()))
    apart = resolve.pairs_apart(items, named)
    assert told(apart) == told(resolve.same_sentence(resolve.value_scores(items, 1.0), named))
    assert "LeftAnti" not in apart._jdf.queryExecution().optimizedPlan().toString()


def test_cited_by_hash(spark):
    """no sort by text; null ids are known to no tool."""
    rows = lambda r: spark.createDataFrame(r, "answer int, id int")
    told = cited(rows([(1, 1), (1, 1), (1, 2), (2, 1), (3, None), (None, 1), (4, 9)]), rows([(1, 1), (3, None), (None, 1), (4, 9), (7, 7)]), spark.createDataFrame([(1, 5), (1, 2), (9, 9), (9, 9)], "id int, chunk_id int"))
    assert sorted(map(repr, map(tuple, told.collect()))) == sorted(map(repr, [(1, 1, True, "cited"), (1, 2, True, "cited"), (1, 5, True, "claim"), (2, 1, False, "cited"), (3, None, False, "cited"), (None, 1, False, "cited"), (4, 9, True, "cited")]))
    assert "SortAggregate" not in told._jdf.queryExecution().executedPlan().toString()


def test_chunks_leave_in_pieces(spark, monkeypatch):
    """a document's chunks leave the function before all of a batch are cut."""
    monkeypatch.setattr(chunking, "ANSWER", 300)
    texts = ["word " * 100, None, "", "\n\n".join(["para " * 30] * 9), "# Head\n\nbody", "x" * 900]
    docs = spark.createDataFrame([(i, f"t{i}", t) for i, t in enumerate(texts)], "doc_id long, title string, text string").coalesce(1)
    told = chunks(docs, 120, 20, 15)
    assert [(r["doc_id"], r["idx"], r["text"]) for r in told.orderBy("doc_id", "idx").collect()] == [(i, k, c) for i, t in enumerate(texts) for k, c in enumerate(chunk_text(t, 120, 20, 15))]
    assert told.columns == ["chunk_id", "doc_id", "idx", "text", "context"] and told.where("doc_id = 4").first()["context"] == "Head"
    assert "MapInArrow" in told._jdf.queryExecution().executedPlan().toString()

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from lodeworks.functions.text import contains_words, norm, norm_text, quantity, sentences, shape, stem, year_in
from lodeworks.plans.sql import check_sql, query_sql, read_sql, tables_read
from lodeworks.plans.typed import Path, Query, Refused, Where, along, check, run

ROWS = [
    (1, "Alder", "$1,289", 1999, datetime.date(2001, 2, 3), "seen 11/07/2016", "a; b;a", True),
    (2, "alder", "980", 2004, datetime.date(1999, 5, 6), "none", "b", False),
    (3, None, "x", None, None, "20196", "", None),
    (4, "Birch", "-5.5", 2001, datetime.date(2011, 1, 1), "1850-01", " ; ", True),
]
SCHEMA = "id int, name string, price string, made int, since date, noted string, tags string, ok boolean"


@pytest.fixture(scope="module")
def things(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def ids(df):
    return sorted(r["id"] for r in df.collect())


@pytest.mark.parametrize(
    ("where", "want"),
    [
        (Where("name", "=", "ALDER"), [1, 2]),
        (Where("name", "!=", "alder"), [4]),
        (Where("price", ">", "$1,000"), [1]),
        (Where("price", "<", 0), [4]),
        (Where("since", ">=", "2001-02-03"), [1, 4]),
        (Where("since", "year", 1999), [2]),
        (Where("noted", "year", 2016), [1]),
        (Where("noted", "year", 1850), [4]),
        (Where("noted", "contains", "ONE"), [2]),
        (Where("noted", "word", "one"), []),
        (Where("noted", "word", "seen"), [1]),
        (Where("name", "=", ""), [3]),
        (Where("tags", "!=", ""), [1, 2, 4]),
        (Where("made", "in", (1999, "2001")), [1, 4]),
        (Where("ok", "=", True), [1, 4]),
        (Where("since", "year", other="made"), []),
        (Where("name", "!=", other="price"), [1, 2, 4]),
    ],
)
def test_conditions(things, where, want):
    assert ids(run(things, Query(where=(where,)))) == want


def test_measures_groups_and_pages(things):
    value = lambda q: run(things, q).collect()[0]["value"]
    assert value(Query(measure="sum", field="price")) == 1289 + 980 - 5.5
    assert value(Query(measure="distinct", field="made")) == 3
    groups = lambda q: [(r["bucket"], r["value"]) for r in run(things, q).collect()]
    assert groups(Query(measure="count", group_by="tags", split=";")) == [("b", 2), ("a", 1)]
    assert groups(Query(measure="count", group_by="since", period="decade")) == [("1990s", 1), ("2000s", 1), ("2010s", 1)]
    assert groups(Query(measure="count", group_by="noted", period="year")) == [(1850, 1), (2016, 1)]
    page = run(things, Query(order_by="made", descending=True, offset=1, limit=2), total=True).collect()
    assert [(r["id"], r["total"]) for r in page] == [(4, 4), (1, 4)]
    assert run(things, Query(offset=99), total=True).count() == 0
    assert run(things.limit(0), Query(measure="count")).collect()[0]["value"] == 0


@pytest.mark.parametrize(
    "query",
    [
        Query(where=(Where("nope", "=", 1),)),
        Query(where=(Where("made", "~", 1),)),
        Query(where=(Where("made", "contains", "1"),)),
        Query(where=(Where("made", "=", "many"),)),
        Query(where=(Where("since", ">", "soon"),)),
        Query(where=(Where("made", "year", 2000),)),
        Query(where=(Where("made", "in", ()),)),
        Query(where=(Where("name", "<", other="price"),)),
        Query(where=(Where("noted", "word", " "),)),
        Query(where=(Where("name", "=", None),)),
        Query(measure="sum", field="since"),
        Query(measure="median", field="made"),
        Query(measure="rows", group_by="made"),
        Query(measure="count", group_by="made", split=";"),
        Query(measure="count", group_by="made", period="year"),
        Query(measure="count", period="year"),
        Query(offset=-1),
    ],
)
def test_refusals(things, query):
    assert check(query, things.schema)
    with pytest.raises(Refused):
        run(things, query)


def test_path(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "ref string")
    edges = spark.createDataFrame([("R", "a", "b"), ("S", "c", "b"), ("S", "d", "c")], "type string, src string, dst string")
    start = spark.createDataFrame([("a",)], "ref string")
    assert [r["ref"] for r in along(nodes, edges, start, Path(("R", "S"))).collect()] == ["c"]
    with pytest.raises(Refused):
        along(nodes, edges, start, Path(("R",) * 4))


def test_sql(spark, things):
    assert query_sql(spark, "WITH t AS (SELECT * FROM things) SELECT count(*) AS n FROM t", {"things": things}).collect()[0]["n"] == 4
    assert tables_read(spark, "SELECT * FROM a WHERE x IN (SELECT y FROM b)") == ["a", "b"]
    for bad in ("DROP TABLE things", "SELECT * FROM other", "SELECT * FROM range(5)", "SELECT 1; SELECT 2", "INSERT INTO things SELECT 1", "SELECT * FROM things WHERE id IN (SELECT x FROM other)"):
        assert check_sql(spark, bad, {"things"}), bad
    for bad in ("SELECT reflect('java.lang.System', 'currentTimeMillis') FROM things", "SELECT `java_method` ('a', 'b')", "SELECT input_file_name() FROM things"):
        assert check_sql(spark, bad, {"things"}), bad
    assert not check_sql(spark, "SELECT count(*), 'reflect(' FROM things", {"things"})


def test_sql_stops_in_time(spark, things):
    rows, total = read_sql(spark, "SELECT id FROM things ORDER BY id", {"things": things}, 60, rows=2)
    assert len(rows) == 2 and total == 4 and not spark.catalog.tableExists("things")
    with pytest.raises(TimeoutError):
        read_sql(spark, "SELECT count(*) FROM things WHERE id % 7 = 9", {"things": spark.range(10**14)}, 1.5)


def test_text_rules(spark):
    assert norm_text("**Västerås**  Bookshelf\n") == "vasteras bookshelf"
    spoken = spark.createDataFrame([("Dr. J. Pike came. He left!\nNo stop",)], "t string").select(sentences("t")).first()[0]
    assert spoken == ["Dr. J. Pike came.", "He left!", "No stop"]
    assert (stem("installed"), stem("notes"), stem("lids"), stem("press"), stem("kv12s")) == ("install", "note", "lids", "press", "kv12s")
    row = spark.createDataFrame([("**Ä** b", "seen 20196 or 2017", "1,200 Kilograms", "Pot 12x  of A B")], "a string, b string, c string, d string")
    r = row.select(norm("a"), year_in(F.col("b")), quantity(F.col("c")), shape(F.col("d")), contains_words(F.lit("the car escaped"), F.lit("escape")), contains_words(F.lit("a (b.c) d"), F.lit("b.c"))).first()
    assert (r[0], r[1], tuple(r[2]), r[3], r[4], r[5]) == ("a b", 2017, (1200.0, "kg"), "a 9a", False, True)

"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Every rule is a boolean column over one text column: true means "reject". A bounded sample gives each rule's cost
(seconds a row) and selectivity (share rejected); rules run in the order of rejection per cost, inside one CASE, so a
text that a cheap rule rejects never reaches a dear one. The order changes the work only, never a verdict.

Defined results: a null text counts as empty, has no words and is rejected by ``few_words``; a text of one word has no
windows; repeated rows get equal verdicts; an empty table gives an empty table; extra columns pass through, and the
columns added here (``kept``, ``failed_rule``) replace columns of the same name.
"""

from __future__ import annotations

import time
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ASCII_SPACE, kept, table

#: Rows that the order of the rules is estimated on. The order is a plan, not a result: verdicts don't depend on it.
SAMPLE_ROWS = 1000
WINDOW = 5


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, ASCII_SPACE), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def word_chars(text: Column) -> Column:
    return (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long")


def n_upper(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[A-Z]")).cast("long")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def n_dup_lines(text: Column) -> Column:
    return let(worded_lines(text), lambda a: (F.size(a) - F.size(F.array_distinct(a))).cast("long"))


def covered(at: Column, size: int) -> Column:
    """Words that windows of ``size`` cover, given the sorted starts of the windows."""
    last = F.size(at) - 1
    steps = F.transform(at, lambda p, k: F.when(k == last, F.lit(size)).otherwise(F.least(F.lit(size), F.get(at, k + 1) - p)))
    return F.aggregate(steps, F.lit(0), lambda a, x: a + x)


def n_repeat_words(text: Column, size: int = WINDOW) -> Column:
    """Words in windows of ``size`` words that stand twice or more in the text.

    Windows are compared by 64-bit hashes. Texts without a repeated window stop at the hash set; the others sort
    (hash, start) and keep the starts whose neighbour has an equal hash, so no step is quadratic in the text.
    """

    def hashes(w: Column) -> Column:
        h = F.transform(w, lambda x: F.xxhash64(x))
        return let(
            h,
            lambda a: F.transform(
                F.slice(a, 1, F.greatest(F.size(a) - (size - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(a, i + k) for k in range(1, size)])
            ),
        )

    def repeated(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        # a neighbour outside the array is null, and null counts as unequal
        mine = lambda s: F.filter(s, lambda x, k: F.coalesce((F.get(s, k + 1)["h"] == x["h"]), F.lit(False)) | F.coalesce((k > 0) & (F.get(s, F.greatest(k - 1, F.lit(0)))["h"] == x["h"]), F.lit(False)))
        starts = let(pairs, lambda s: F.sort_array(F.transform(mine(s), lambda x: x["i"])))
        return let(starts, lambda at: covered(at, size))

    return let(let(words(text), hashes), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(repeated(h))).cast("long")


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; a document fails a rule when it passes the limit."""

    min_words: int = 10
    max_repeat_percent: int = 20
    max_symbols_per_100_words: int = 25
    max_dup_line_percent: int = 50
    max_upper_percent: int = 40
    min_word_chars: float = 2.0
    max_word_chars: float = 20.0

    def columns(self, text: Column, features: Mapping[str, Column] | None = None) -> dict[str, Column]:
        """Rule name -> "reject". ``features`` names columns that are there already; the others are computed where a rule needs them."""
        text = F.coalesce(text, F.lit(""))
        have = dict(features or {})
        f = lambda name: have[name] if name in have else FEATURES[name](text)
        return {
            "few_words": f("n_words") < self.min_words,
            "repeated_windows": 100 * f("n_repeat_words") > self.max_repeat_percent * f("n_words"),
            "symbols": 100 * f("n_symbols") > self.max_symbols_per_100_words * f("n_words"),
            "dup_lines": 100 * f("n_dup_lines") > self.max_dup_line_percent * F.size(worded_lines(text)),
            "upper_case": 100 * f("n_upper") > self.max_upper_percent * f("word_chars"),
            "word_length": (f("word_chars") < self.min_word_chars * f("n_words")) | (f("word_chars") > self.max_word_chars * f("n_words")),
        }


#: What the rules count.
FEATURES = {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat_words, "n_upper": n_upper}


def cascade_order(df: DataFrame, rules: Mapping[str, Column], sample_rows: int = SAMPLE_ROWS, columns: tuple[str, ...] = ("text",)) -> list[tuple[str, float, float]]:
    """``(rule, seconds a row, share rejected of what the rules before it leave)``, best rejection per cost first.

    The sample is written once. Each rule runs alone over it, once to warm up and twice on the clock; the faster run less
    that of a rule that does nothing is its cost. Shares are counted on the rows that the rules chosen so far keep. Ties
    keep the order in which the rules were given. An empty table leaves the rules as they were given.
    """
    n = df.count()
    if not n:
        return [(k, 0.0, 0.0) for k in rules]
    sample = kept(df.select(*columns).sample(min(1.0, sample_rows / n), seed=7), "sample").cache()
    # bounded by sample_rows: how many rows each combination of verdicts has
    seen = sample.select(*[F.coalesce(rule, F.lit(False)).alias(name) for name, rule in rules.items()]).groupBy(*rules).count().collect()
    m = max(1, sum(r["count"] for r in seen))

    def seconds(rule: Column) -> float:
        took = []
        for _ in range(3):
            began = time.perf_counter()
            sample.select(F.sum(rule.cast("int"))).collect()
            took.append(time.perf_counter() - began)
        return min(took[1:])

    idle = seconds(F.col(columns[0]).isNull())
    cost = {name: max(seconds(rule) - idle, 1e-6) / m for name, rule in rules.items()}
    sample.unpersist()
    order, left = [], list(rules)
    while left:
        rows = max(1, sum(r["count"] for r in seen))
        share = {name: sum(r["count"] for r in seen if r[name]) / rows for name in left}
        best = max(left, key=lambda name: share[name] / cost[name])
        order.append((best, cost[best], share[best]))
        seen = [r for r in seen if not r[best]]
        left.remove(best)
    return order


def first_failed(rules: Mapping[str, Column], order: list[str]) -> Column:
    """Name of the first rule that rejects, null if none does; later rules aren't evaluated."""
    out = None
    for name in order:
        out = F.when(rules[name], F.lit(name)) if out is None else out.when(rules[name], F.lit(name))
    return out


def quality_cascade(df: DataFrame, text: str = "text", limits: Rules = Rules(), features: Mapping[str, Column] | None = None) -> DataFrame:  # noqa: B008
    """``df`` with ``kept`` and ``failed_rule`` (the first rule of the cascade that rejects the text).

    The order is estimated with every rule computing what it needs; ``features`` are columns of ``df`` that a caller
    wants of every row anyway and that the rules then read.
    """
    order = [name for name, _, _ in cascade_order(df.select(text), limits.columns(F.col(text)), columns=(text,))]
    df = df.withColumn("failed_rule", first_failed(limits.columns(F.col(text), features), order))
    return df.withColumn("kept", F.col("failed_rule").isNull())


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    counted = docs.select("doc_id", "text", *[FEATURES[k](F.coalesce(F.col("text"), F.lit(""))).alias(k) for k in names])
    judged = quality_cascade(counted, features={k: F.col(k) for k in names})
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return judged.select("doc_id", *names, failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"))


OP3_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS a FROM d
), wins AS (
  SELECT r, i, array_to_string(a[i:i + 4], ' ') AS win
  FROM (SELECT r, a, unnest(range(1, greatest(len(a) - 3, 1))) AS i FROM w)
), rep AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM wins) WHERE n > 1
), cover AS (
  SELECT r, CAST(sum(least(5, coalesce(nxt - i, 5))) AS BIGINT) AS n_repeat_words
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM rep) GROUP BY r
), lines AS (
  SELECT r, unnest(string_split(text, chr(10))) AS line FROM d
), dup AS (
  SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r
), f AS (
  SELECT w.doc_id, CAST(len(a) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS uppers
  FROM w LEFT JOIN cover USING (r) LEFT JOIN dup USING (r)
), b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * n_symbols > 25 * n_words) AND NOT (100 * n_dup_lines > 50 * n_lines)
  AND NOT (100 * uppers > 40 * word_chars) AND word_chars >= 2 * n_words AND word_chars <= 20 * n_words AS kept
FROM b
"""

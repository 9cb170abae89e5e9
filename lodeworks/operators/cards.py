"""Cards: one text a node or claim for retrieval, fitted under a character cap, and the checks of written summaries."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import norm_text


def claim_text(subject: Column, subject_type: Column, predicate: Column, obj: Column, object_type: Column) -> Column:
    """A claim as a sentence; the predicate's underscores are blanks."""
    said = F.lower(F.replace(predicate, F.lit("_"), F.lit(" ")))
    return F.concat(subject, F.lit(" ("), subject_type, F.lit(") "), said, F.lit(" "), obj, F.lit(" ("), object_type, F.lit(")"))


def fitted(head: str, lines: list[str], most: int) -> str:
    """The head and as many whole lines as fit, in order; a line that is too long is left out and later ones may still fit."""
    out, size = [head[:most]], min(len(head), most)
    for line in lines:
        if size + 1 + len(line) <= most:
            out.append(line)
            size += 1 + len(line)
    return "\n".join(out)


def cards(nodes: DataFrame, facts: DataFrame, most: int = 1200) -> DataFrame:
    """(ref, text) of nodes (ref, label, name) with their facts (ref, ord, line)."""

    @F.pandas_udf(T.StringType())
    def render(head: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([fitted(h, [x for x in ls] if ls is not None else [], most) for h, ls in zip(head, lines, strict=True)])

    held = facts.groupBy("ref").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]).alias("lines"))
    head = F.concat("name", F.lit(" ("), "label", F.lit(")"))
    return nodes.join(held, "ref", "left").select("ref", render(head, F.col("lines")).alias("text"))


def evidence_hash(columns: list[str]) -> Column:
    """A digest of what a card is made from; equal values give equal digests."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).cast("binary"), 256)


def ungrounded(summary: str, sources: list[str]) -> list[str]:
    """Numbers and capitalised names of a summary that no source holds."""
    known = norm_text("\n".join(sources))
    found = re.findall(r"\d+(?:[.,]\d+)*|(?<![.!?]\s)(?<!^)\b[A-Z][\w-]+", summary)
    return [x for x in dict.fromkeys(found) if not re.search(rf"(?<![a-z0-9]){re.escape(norm_text(x))}(?![a-z0-9])", known)]


@F.pandas_udf(T.ArrayType(T.StringType()))
def ungrounded_words(summary: pd.Series, sources: pd.Series) -> pd.Series:
    return pd.Series([ungrounded(s or "", list(x) if x is not None else []) for s, x in zip(summary, sources, strict=True)])


@dataclass(frozen=True)
class ScreenRule:
    reason: str
    pattern: str


#: Requests to change data, in plain language.
WRITES = (
    ScreenRule("delete", r"\b(delete|remove|erase|drop|wipe)\b.{0,40}\b(record|row|table|node|graph|data|entry|entries|all)\b"),
    ScreenRule("change", r"\b(update|change|set|rename|edit|overwrite)\b.{0,40}\b(record|row|table|node|value|price|field)\b"),
    ScreenRule("add", r"\b(insert|add|create)\b.{0,40}\b(record|row|table|node|entry|relationship)\b"),
)


def screen(text: str, rules: tuple[ScreenRule, ...] = WRITES) -> str | None:
    """The reason to refuse a request, None for a question."""
    return next((r.reason for r in rules if re.search(r.pattern, text, re.I | re.S)), None)

"""Query plans: steps over item sets, checked in plain Python, interpreted to one lazy DataFrame a step.

An item set is (kind, id). Steps name earlier steps as inputs; exactly the last one is terminal. Only terminals make rows
that leave the engine, and ranks keep every item at the best score.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import number_in
from ..operators import claims as claim_ops
from ..operators import graph
from .typed import Refused, Where, filtered
from .typed import Query as TypedQuery
from .typed import check as check_typed

# fixed values: operations, what each takes and gives, and the cap of a listed step
GIVES = {"find_entity": "record", "filter_records": "record", "related": "record", "parts": "record", "find_claims": "claim", "about": "record", "retrieve_chunks": "chunk"}
TAKES = {"related": ("record",), "parts": ("record",), "about": ("claim",), "find_claims": ("record",), "filter_records": ("record",), "retrieve_chunks": ("record", "claim")}
TERMINALS = ("list", "count", "sum", "rank")
CAP = 200


@dataclass(frozen=True)
class Step:
    op: str
    input: int | None = None
    label: str | None = None
    where: tuple[Where, ...] = ()
    relationship: str | None = None
    direction: str = "both"
    predicate: str | None = None
    truth: str | None = "affirmed"
    property: str | None = None
    of: str = "items"
    name: str | None = None
    descending: bool = True


@dataclass(frozen=True)
class Store:
    """What plans read: records by label, the node and edge views, claims with canonical ends, chunks."""

    records: Mapping[str, DataFrame]
    nodes: DataFrame
    edges: DataFrame
    claims: DataFrame | None = None
    about: DataFrame | None = None


def check(plan: tuple[Step, ...], store: Store, types: set[str] | None = None) -> list[str]:
    """Reasons to refuse a plan."""
    faults = []
    gives: dict[int, str] = {}
    for k, s in enumerate(plan):
        at = f"step {k + 1}"
        last = k == len(plan) - 1
        if s.op in TERMINALS:
            if not last:
                faults.append(f"{at}: {s.op} ends a plan")
        elif s.op not in GIVES:
            faults.append(f"{at}: no operation {s.op!r}")
        elif last:
            faults.append(f"{at}: a plan ends in {', '.join(TERMINALS)}")
        if s.input is not None and not 0 <= s.input < k:
            faults.append(f"{at}: its input must be an earlier step")
        elif s.input is not None and s.op in TAKES and gives.get(s.input) not in TAKES[s.op]:
            faults.append(f"{at}: {s.op} takes {' or '.join(TAKES[s.op])}")
        elif s.input is None and s.op in ("related", "parts", "about", *TERMINALS):
            faults.append(f"{at}: {s.op} needs an input")
        if s.op in ("filter_records", "find_entity") and s.label not in store.records:
            faults.append(f"{at}: there is no label {s.label!r}")
        elif s.op == "filter_records":
            faults += [f"{at}: {x}" for x in check_typed(TypedQuery(where=s.where), store.records[s.label].schema)]
        if s.op in ("related",) and types is not None and s.relationship is not None and s.relationship not in types:
            faults.append(f"{at}: there is no relationship {s.relationship!r}")
        if s.op in ("sum",) and s.property is None:
            faults.append(f"{at}: sum needs a property")
        gives[k] = GIVES.get(s.op, "")
    return faults or ([] if plan else ["a plan has a step"])


class Run:
    """Interprets a checked plan; ``items`` holds each step's lazy item set."""

    def __init__(self, store: Store, plan: tuple[Step, ...]):
        if faults := check(plan, store):
            raise Refused("\n".join(faults))
        self.store, self.plan = store, plan
        self.items: list[DataFrame] = []
        self.result: DataFrame | None = None
        for s in plan:
            made = getattr(self, s.op)(s)
            if s.op in TERMINALS:
                self.result = made
            else:
                self.items.append(made)

    def refs(self, s: Step) -> DataFrame:
        return self.items[s.input].select(F.col("id").alias("ref"))

    @staticmethod
    def as_items(kind: str, ids: DataFrame, column: str) -> DataFrame:
        return ids.select(F.lit(kind).alias("kind"), F.col(column).alias("id")).distinct()

    def find_entity(self, s: Step) -> DataFrame:
        found = self.store.records[s.label].where(F.lower("name") == (s.name or "").lower())
        return self.as_items("record", found, "ref")

    def filter_records(self, s: Step) -> DataFrame:
        rows = self.store.records[s.label]
        if s.input is not None:
            rows = rows.join(self.refs(s), "ref", "left_semi")
        return self.as_items("record", filtered(rows, s.where), "ref")

    def related(self, s: Step) -> DataFrame:
        return self.as_items("record", graph.related(self.refs(s), self.store.edges, self.store.nodes, s.direction, s.relationship, s.label), "ref")

    def parts(self, s: Step) -> DataFrame:
        return self.as_items("record", graph.parts_of(self.refs(s), self.store.edges, self.store.nodes, [s.label] if s.label else None), "ref")

    def find_claims(self, s: Step) -> DataFrame:
        ends = None if s.input is None else self.refs(s)
        found = claim_ops.find(self.store.claims, s.predicate, truth=s.truth, modality=None)
        if ends is not None:
            found = found.join(claim_ops.either_end(found, ends), "claim_id", "left_semi")
        return self.as_items("claim", found, "claim_id")

    def about(self, s: Step) -> DataFrame:
        rows = self.store.about.join(self.items[s.input].select(F.col("id").alias("claim_id")), "claim_id", "left_semi")
        if s.label is not None:
            rows = rows.join(self.store.nodes.where(F.col("label") == s.label).select("ref"), "ref", "left_semi")
        return self.as_items("record", rows, "ref")

    def retrieve_chunks(self, s: Step) -> DataFrame:
        items = self.items[s.input]
        claims = self.store.claims.select(F.col("claim_id").alias("id"), "chunk_id")
        return self.as_items("chunk", items.join(claims, "id"), "chunk_id")

    # terminals

    def list(self, s: Step) -> DataFrame:
        names = self.store.nodes.select(F.col("ref").alias("id"), "name")
        return self.items[s.input].join(names, "id", "left").select("id", F.coalesce("name", "id").alias("name")).orderBy("name", "id").limit(CAP)

    def count(self, s: Step) -> DataFrame:
        return self.items[s.input].agg(F.count_distinct("id").alias("value"))

    def values(self, s: Step) -> DataFrame:
        rows = self.store.records[s.label].join(self.refs(s), "ref", "left_semi")
        return rows.select("ref", "name", F.col(f"`{s.property}`").alias("v"))

    def sum(self, s: Step) -> DataFrame:
        """The sum of a property's numbers and how many items had none."""
        n = number_in(F.col("v").cast("string"))
        return self.values(s).agg(F.sum(n).alias("value"), F.count_if(n.isNull()).alias("skipped"))

    def rank(self, s: Step) -> DataFrame:
        """Every item at the best score: a property's number, or the number of related records."""
        if s.property is not None:
            scored = self.values(s).select("ref", "name", number_in(F.col("v").cast("string")).alias("score")).where("score is not null")
        else:
            step = graph.steps(self.store.edges, s.direction, [s.relationship] if s.relationship else None)
            counts = step.join(self.refs(s), "ref", "left_semi").groupBy("ref").agg(F.count_distinct("to").cast("double").alias("score"))
            scored = counts.join(self.store.nodes.select("ref", "name"), "ref")
        best = scored.agg((F.max if s.descending else F.min)("score").alias("best"))
        return scored.join(F.broadcast(best), F.col("score") == F.col("best")).select("ref", "name", "score")


def read_steps(plan: tuple[Step, ...]) -> set[int]:
    """Steps whose items only reach the reader as text: nothing counts or ranks them, so truth needn't filter them."""
    if plan[-1].op != "list":
        return set()
    live, todo = set(), [plan[-1].input]
    while todo:
        k = todo.pop()
        if k is not None and k not in live:
            live.add(k)
            todo.append(plan[k].input)
    return {k for k in live if plan[k].op in ("find_claims", "retrieve_chunks")}


def value_groups(records: DataFrame, property: str, by_year: bool = False) -> DataFrame:
    """(v, n): records per value of a property, or per year of it."""
    v = F.year(property) if by_year else F.col(f"`{property}`")
    return records.select("ref", v.alias("v")).where("v is not null").groupBy("v").agg(F.count_distinct("ref").alias("n"))


def related_groups(items: DataFrame, edges: DataFrame, type: str, direction: str = "both") -> DataFrame:
    """(to, n): items per related record."""
    met = graph.steps(edges, direction, [type]).join(items.select("ref").distinct(), "ref")
    return met.groupBy("to").agg(F.count_distinct("ref").alias("n"))


def top_ties(scores: DataFrame, by: str, score: str) -> DataFrame:
    """Rows at the best score of each ``by``; ties all stay."""
    return scores.withColumn("__r", F.rank().over(W.partitionBy(by).orderBy(F.desc(score)))).where("__r = 1").drop("__r")

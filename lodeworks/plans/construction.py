"""Construction plans: rules that turn tables into typed records (nodes) and relationships (edges).

A plan is checked in plain Python against the tables' profile before anything is built. Building is lazy: a node table a
label and an edge table a type, each with a report of what was read, skipped and written.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class NodeRule:
    table: str
    label: str
    key: tuple[str, ...]
    properties: tuple[str, ...] = ()
    name: str | None = None

    @property
    def name_column(self) -> str:
        """The column shown as a record's name: the stated one, else one called so, else the key."""
        called = [p for p in self.properties if p.lower() == "name" or p.lower().endswith("_name")]
        return self.name or (called[0] if called else self.key[0])


@dataclass(frozen=True)
class EdgeRule:
    table: str
    type: str
    from_label: str
    from_key: tuple[str, ...]
    to_label: str
    to_key: tuple[str, ...]
    properties: tuple[str, ...] = ()


@dataclass(frozen=True)
class Plan:
    nodes: tuple[NodeRule, ...]
    edges: tuple[EdgeRule, ...] = ()


def key_of(columns: Sequence[str]) -> Column:
    """A record's key as text; several columns are joined by ``|``, and a blank part makes the key null."""
    parts = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for c in columns]
    return F.concat(*[x for p in parts for x in (F.lit("|"), p)][1:]) if len(parts) > 1 else parts[0]


def ref_of(label: str, key: Column) -> Column:
    return F.concat(F.lit(f"{label}:"), key)


def groups(items: Iterable[str], pairs: Iterable[tuple[str, str]]) -> dict[str, str]:
    """item -> least member of its connected group, for a plan's few labels."""
    lead = {x: x for x in items}
    for a, b in pairs:
        low, high = sorted((lead[a], lead[b]))
        lead = {k: low if v == high else v for k, v in lead.items()}
    return lead


def check(plan: Plan, tables: Mapping[str, DataFrame], unique: Callable[[str, tuple[str, ...]], bool] | None = None) -> list[str]:
    """Reasons to refuse a plan: unknown tables, columns or labels, names used twice, keys that aren't unique, loose labels."""
    faults: list[str] = []
    labels = {n.label: n for n in plan.nodes}
    if len(labels) < len(plan.nodes):
        faults.append("a label stands twice")
    for rule in (*plan.nodes, *plan.edges):
        what = rule.label if isinstance(rule, NodeRule) else rule.type
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", what):
            faults.append(f"{what!r} is no name")
        if rule.table not in tables:
            faults.append(f"{what}: there is no table {rule.table!r}")
            continue
        used = (*rule.key, *rule.properties, *([rule.name] if rule.name else [])) if isinstance(rule, NodeRule) else (*rule.from_key, *rule.to_key, *rule.properties)
        faults += [f"{what}: {rule.table} has no column {c!r}" for c in used if c not in tables[rule.table].columns]
        if isinstance(rule, NodeRule) and unique is not None and not unique(rule.table, rule.key):
            faults.append(f"{what}: {' + '.join(rule.key)} isn't a complete, unique key of {rule.table}")
        if isinstance(rule, EdgeRule):
            for label, key in ((rule.from_label, rule.from_key), (rule.to_label, rule.to_key)):
                if label not in labels:
                    faults.append(f"{what}: there is no label {label!r}")
                elif len(labels[label].key) != len(key):
                    faults.append(f"{what}: the key of {label} has {len(labels[label].key)} columns")
    if not faults and len({*groups(labels, [(e.from_label, e.to_label) for e in plan.edges]).values()}) > 1:
        faults.append("some labels are joined to no others")
    return faults


def unique_by(tables: Mapping[str, DataFrame]) -> Callable[[str, tuple[str, ...]], bool]:
    """A key test that reads the rows: every key complete and distinct, and at least one."""

    def test(table: str, key: tuple[str, ...]) -> bool:
        k = key_of(key)
        r = tables[table].agg(F.count("*"), F.count(k), F.count_distinct(k)).first()
        return r[0] > 0 and r[0] == r[1] == r[2]

    return test


def records(df: DataFrame, rule: NodeRule) -> DataFrame:
    """(ref, label, key, name, properties...) once a key; rows without a key are left out. Of repeated keys the least row stays.

    A property called like one of the first four columns is named ``p_...``; the name column itself is not repeated.
    """
    key = key_of(rule.key)
    own = [p for p in dict.fromkeys((*rule.key, *rule.properties)) if not p == rule.name_column == "name"]
    props = [F.col(f"`{p}`").alias(f"p_{p}" if p in RESERVED else p) for p in own]
    rows = df.select(key.alias("key"), F.col(f"`{rule.name_column}`").cast("string").alias("name"), *props).where("key is not null")
    rest = [c for c in rows.columns if c != "key"]
    one = rows.groupBy("key").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("r")).select("key", "r.*")
    return one.select(ref_of(rule.label, F.col("key")).alias("ref"), F.lit(rule.label).alias("label"), "key", *[F.col(f"`{c}`") for c in rest])


RESERVED = ("ref", "label", "key", "name")


def node_view(parts: Iterable[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, [p.select("ref", "label", "key", "name") for p in parts])


def ends(df: DataFrame, rule: EdgeRule) -> DataFrame:
    """(type, src, dst, properties...) of every row, ends unchecked, null where a key is."""
    return df.select(F.lit(rule.type).alias("type"), ref_of(rule.from_label, key_of(rule.from_key)).alias("src"), ref_of(rule.to_label, key_of(rule.to_key)).alias("dst"), *[F.col(f"`{p}`") for p in rule.properties])


def joined(rows: DataFrame, rule: EdgeRule, nodes: DataFrame | Mapping[str, DataFrame], owners: Mapping[str, NodeRule]) -> DataFrame:
    """Rows (src, dst) whose ends both exist. A ref begins with its label, so an end can only be a record of that label.

    An end that is the key of a record made of the same row exists if it isn't null. ``nodes`` is the node view or the
    records by label, ``owners`` the node rules by label.
    """
    for end, label, key in (("src", rule.from_label, rule.from_key), ("dst", rule.to_label, rule.to_key)):
        own = owners.get(label)
        if own is not None and (own.table, own.key) == (rule.table, key):
            rows = rows.where(F.col(end).isNotNull())
        else:
            refs = nodes[label] if isinstance(nodes, Mapping) else nodes.where(F.col("label") == label)
            rows = rows.join(refs.select(F.col("ref").alias(end)), end, "left_semi")
    return rows


def relationships(df: DataFrame, rule: EdgeRule, nodes: DataFrame | Mapping[str, DataFrame], owners: Mapping[str, NodeRule] | None = None) -> DataFrame:
    """Edges whose ends both exist, once a pair of ends; of repeated pairs the least properties stay."""
    both = joined(ends(df, rule), rule, nodes, owners or {})
    if not rule.properties:
        return both.select("src", "dst").distinct().select(F.lit(rule.type).alias("type"), "src", "dst")
    return both.groupBy("type", "src", "dst").agg(F.min(F.struct(*[F.col(f"`{p}`") for p in rule.properties])).alias("p")).select("type", "src", "dst", "p.*")


def node_report(df: DataFrame, rule: NodeRule) -> DataFrame:
    key = key_of(rule.key)
    return df.agg(F.lit(rule.label).alias("rule"), F.count("*").alias("rows_read"), F.count_if(key.isNull()).alias("null_key"), F.count_distinct(key).alias("written"), F.lit(0).cast("long").alias("unmatched"))


def edge_report(df: DataFrame, rule: EdgeRule, nodes: DataFrame) -> DataFrame:
    """Rows read, with a null end, with an end that no record has, and edges written."""
    refs = nodes.select("ref").distinct()
    rows = ends(df, rule).select("src", "dst")
    rows = rows.join(refs.select(F.col("ref").alias("src"), F.lit(True).alias("has_src")), "src", "left").join(refs.select(F.col("ref").alias("dst"), F.lit(True).alias("has_dst")), "dst", "left")
    none = F.col("src").isNull() | F.col("dst").isNull()
    ok = F.col("has_src") & F.col("has_dst")
    return rows.agg(
        F.lit(rule.type).alias("rule"), F.count("*").alias("rows_read"), F.count_if(none).alias("null_key"), F.count_distinct(F.when(ok, F.struct("src", "dst"))).alias("written"), F.count_if(~none & ~F.coalesce(ok, F.lit(False))).alias("unmatched")
    )


@dataclass(frozen=True)
class Graph:
    records: Mapping[str, DataFrame]
    nodes: DataFrame
    typed_edges: Mapping[str, DataFrame]
    edges: DataFrame
    report: DataFrame


def build(plan: Plan, tables: Mapping[str, DataFrame]) -> Graph:
    """All records, then all relationships over them."""
    if faults := check(plan, tables):
        raise ValueError("\n".join(faults))
    made = {r.label: records(tables[r.table], r) for r in plan.nodes}
    nodes = node_view(made.values())
    typed = {f"{e.type}:{e.from_label}:{e.to_label}": relationships(tables[e.table], e, made, {n.label: n for n in plan.nodes}) for e in plan.edges}
    none = nodes.select(F.lit("").alias("type"), F.col("ref").alias("src"), F.col("ref").alias("dst")).limit(0)
    edges = functools.reduce(DataFrame.unionByName, [e.select("type", "src", "dst") for e in typed.values()], none)
    report = functools.reduce(DataFrame.unionByName, [*(node_report(tables[r.table], r) for r in plan.nodes), *(edge_report(tables[e.table], e, nodes) for e in plan.edges)])
    return Graph(made, nodes, typed, edges, report)


def refine(propose: Callable[[str], Plan], faults_of: Callable[[Plan], list[str]], critique: Callable[[Plan], list[str]] | None = None, attempts: int = 3) -> tuple[Plan, list[str]]:
    """A proposer's plan, sent back with its faults until it has none; then one critique. Returns the last plan and its faults."""
    hint, plan, faults = "", None, []
    for _ in range(attempts):
        plan = propose(hint)
        faults = faults_of(plan) or (critique(plan) if critique else [])
        if not faults:
            break
        hint = "\n".join(faults)
    return plan, faults


def record_documents(records: DataFrame, label: str, prose: Sequence[str]) -> DataFrame:
    """(doc_id, title, text, record_ref): a document per record with prose, a heading and a section a filled column."""
    sections = [F.when(F.trim(F.col(f"`{c}`")) != "", F.concat(F.lit(f"## {c}\n\n"), F.trim(F.col(f"`{c}`")))) for c in prose]
    text = F.concat_ws("\n\n", F.concat(F.lit("# "), "name"), *sections)
    some = functools.reduce(lambda a, b: a | b, [s.isNotNull() for s in sections])
    return records.where(some).select(F.concat(F.lit(f"record/{label}/"), "key").alias("doc_id"), F.col("name").alias("title"), text.alias("text"), F.col("ref").alias("record_ref"))

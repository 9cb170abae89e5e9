"""Free SQL: one SELECT over known tables, checked on Spark's own parse tree before it runs."""

from __future__ import annotations

import hashlib
import re
import threading
import uuid

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from .typed import Refused

#: Parsed nodes that a read may not hold.
FORBIDDEN = re.compile(r"Command|Insert|Create|Drop|Alter|Delete|Update|Merge|SetCatalog|Truncate|LoadData|CacheTable|UnresolvedTableValuedFunction|ScriptTransformation|UnresolvedHint")


#: Functions that reach out of the query: into the JVM, files, the session or the clock of a running job.
FORBIDDEN_FUNCTIONS = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "current_user", "session_user", "user", "current_catalog", "current_database", "current_schema", "version", "raise_error", "assert_true", "spark_partition_id", "monotonically_increasing_id"}
FUNCTION = re.compile(r"(?<![\w.`])`?([a-z_]\w*)`?\s*\(", re.I)


def parsed(spark: SparkSession, statement: str):
    return spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)


def walk(plan):
    """Every node of a logical plan, subqueries and common tables included."""
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from walk(children.apply(i))
    inner = plan.innerChildren()  # common tables; some nodes list expressions here
    for i in range(inner.size()):
        if re.search(r"\.plans\.logical\.|\.analysis\.Unresolved(Relation|With)", inner.apply(i).getClass().getName()):
            yield from walk(inner.apply(i))
    subs = plan.subqueries()
    for i in range(subs.size()):
        yield from walk(subs.apply(i))


def tables_read(spark: SparkSession, statement: str) -> list[str]:
    """Tables a statement names, without its own common tables, sorted."""
    found, own = set(), set()
    for node in walk(parsed(spark, statement)):
        kind = node.getClass().getSimpleName()
        if kind == "UnresolvedRelation":
            found.add(node.tableName().replace("`", ""))
        elif kind == "UnresolvedWith":
            rules = node.cteRelations()
            own |= {rules.apply(i)._1() for i in range(rules.size())}
    return sorted(found - own)


def check_sql(spark: SparkSession, statement: str, tables: set[str]) -> list[str]:
    """Reasons to refuse a statement: not one SELECT, a write or a table function, an unknown table."""
    if not re.match(r"\s*(select|with|\()", statement, re.I):
        return ["one SELECT is needed"]
    try:
        plan = parsed(spark, statement)
    except ParseException as e:
        return [f"it doesn't parse: {str(e).strip().splitlines()[0]}"]
    faults = sorted({f"{node.getClass().getSimpleName()} isn't allowed" for node in walk(plan) if FORBIDDEN.search(node.getClass().getSimpleName())})
    text = re.sub(r"'(?:[^'\\\\]|\\\\.|'')*'|--[^\n]*|/\*.*?\*/", " ", statement, flags=re.S)
    faults += sorted(f"the function {f} isn't allowed" for f in {m.lower() for m in FUNCTION.findall(text)} & FORBIDDEN_FUNCTIONS)
    return faults + [f"there is no table {t!r}" for t in tables_read(spark, statement) if t not in tables]


def group_of(statement: str) -> str:
    return f"sql-{hashlib.sha256(statement.encode()).hexdigest()[:16]}-{uuid.uuid4().hex[:8]}"


def bound(spark: SparkSession, statement: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The lazy result of a checked statement over ``tables``; views of those names live only while it is analysed."""
    if faults := check_sql(spark, statement, set(tables)):
        raise Refused("\n".join(faults))
    before = {name: spark.table(name) for name in tables if spark.catalog.tableExists(name)}
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    try:
        return spark.sql(statement)
    finally:
        for name in tables:
            spark.catalog.dropTempView(name)
            if name in before:
                before[name].createOrReplaceTempView(name)


def query_sql(spark: SparkSession, statement: str, tables: dict[str, DataFrame]) -> DataFrame:
    return bound(spark, statement, tables)


def read_sql(spark: SparkSession, statement: str, tables: dict[str, DataFrame], seconds: float, rows: int = 1000) -> tuple[list, int]:
    """The first ``rows`` rows and the total, within ``seconds``: a timer cancels the statement's jobs, a group of their own, and no others."""
    df, group, context = bound(spark, statement, tables), group_of(statement), spark.sparkContext
    late = threading.Event()

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    context.setJobGroup(group, statement[:200], interruptOnCancel=True)
    timer.start()
    try:
        got = df.limit(rows).collect()
        total = len(got) if len(got) < rows else df.count()
        if late.is_set():
            raise TimeoutError(f"the statement took more than {seconds} s")
        return got, total
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"the statement took more than {seconds} s") from e
        raise
    finally:
        timer.cancel()
        for name in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel"):
            context.setLocalProperty(name, None)

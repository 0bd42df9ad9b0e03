"""Registry of named queries with their check SQL, and SQL text helpers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
COVERS: dict[str, str] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``. ``covers`` lists the inventory ids it shows."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        COVERS[name] = covers
        if sql is not None:
            CHECKS[name] = sql
        return fn
    return add


# --- SQL text ---------------------------------------------------------------

def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_sql(text: str, words: Sequence[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q(w)})" for w in words) + ")"


def count_sql(text: str, words: Sequence[str]) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {q(w)}) AS INT)" for w in words) + ")"


def label_sql(text: str, lexicon: Mapping[str, Sequence[str]], default: str | None) -> str:
    cases = " ".join(f"WHEN {any_sql(text, ws)} THEN {q(label)}" for label, ws in lexicon.items())
    return f"CASE {cases} ELSE {'NULL' if default is None else q(default)} END"


def first_sql(text: str, words: Sequence[str]) -> str:
    return "CASE " + " ".join(f"WHEN contains({text}, {q(w)}) THEN {q(w)}" for w in words) + " END"


def map_sql(value: str, table: Mapping[str, object], default: str) -> str:
    def lit(v):
        return q(v) if isinstance(v, str) else str(v)
    return f"CASE {value} " + " ".join(f"WHEN {q(k)} THEN {lit(v)}" for k, v in table.items()) + f" ELSE {default} END"


def list_sql(words: Sequence[str]) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def values_sql(rows: Sequence[Sequence[object]], alias: str, columns: Sequence[str]) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        return q(v) if isinstance(v, str) else repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) {alias}({', '.join(columns)})"

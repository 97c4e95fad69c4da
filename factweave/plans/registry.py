"""Query registry. Each entry pairs a Spark plan with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """The given tables of one scale factor, read lazily by attribute."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.root}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    key: str
    plan: Callable[[Tables], DataFrame]
    sql: str | None


_QUERIES: dict[str, Query] = {}
_SHARED_SQL: dict[str, tuple[str, tuple[str, ...]]] = {}


def shared_sql(name: str, text: str, uses: Iterable[str] = ()) -> None:
    """Register a common table expression that several statements use."""
    _SHARED_SQL[name] = (text.strip(), tuple(uses))


def _with_clause(names: Iterable[str]) -> str:
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for upstream in _SHARED_SQL[name][1]:
            visit(upstream)
        ordered.append(name)

    for name in names:
        visit(name)
    # Expressions that only one place reads are inlined by the engine; the others are computed once.
    def uses(name: str) -> int:
        return (name in names) + sum(name in _SHARED_SQL[other][1] for other in ordered)

    return ",\n".join(f"{name} AS {'MATERIALIZED ' if uses(name) > 1 or name in names else ''}(\n{_SHARED_SQL[name][0]}\n)" for name in ordered)


def query(key: str, sql: str | None = None, uses: Iterable[str] = ()):
    """Register a plan under `key`; `uses` names the shared expressions of its SQL."""

    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if key in _QUERIES:
            raise ValueError(f"query {key!r} is registered twice")
        text = None
        if sql is not None:
            ctes = _with_clause(uses)
            body = sql.strip()
            if not ctes:
                text = body
            elif body.upper().startswith("WITH "):
                text = f"WITH {ctes},\n{body[5:]}"
            else:
                text = f"WITH {ctes}\n{body}"
        _QUERIES[key] = Query(key, plan, text)
        return plan

    return register


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)

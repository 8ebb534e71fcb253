"""Query registry: a name, a Spark callable and an optional SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, sql: str, uses: tuple[str, ...] = ()) -> None:
    """A named subquery that checks can build on."""
    VIEWS[name] = (uses, sql)


def _chain(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for n in names:
        uses, _ = VIEWS[n]
        _chain(uses, seen)
        if n not in seen:
            seen.append(n)
    return seen


def _iso_days(df: DataFrame) -> DataFrame:
    """Days as ISO text, so that results compare the same in every engine."""
    days = {f.name: df[f.name].cast("string") for f in df.schema if f.dataType.typeName() == "date"}
    return df.withColumns(days) if days else df


def query(name: str, sql: str | None = None, uses: tuple[str, ...] = ("drive_day",), dates: tuple[str, ...] = ()):
    """Register ``fn`` under ``name`` with its SQL check; ``dates`` are the day columns of the result."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: _iso_days(fn(spark, sf_dir))
        if sql is not None:
            parts = ",\n".join(f"{n} AS ({VIEWS[n][1]})" for n in _chain(uses, []))
            body = f"WITH RECURSIVE {parts}\n{sql}" if parts else sql
            if dates:
                text = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in dates)
                body = f"SELECT * REPLACE ({text}) FROM (\n{body}\n) AS result"
            ORACLES[name] = body
        return fn
    return register

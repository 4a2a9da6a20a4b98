"""All registered queries of the library proper, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import adapters

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under its name, with the body of its twin over the adapter views."""

    def add(function: Callable) -> Callable:
        _QUERIES[function.__name__] = function
        if sql is not None:
            _SQL[function.__name__] = adapters.sql(sql)
        return function

    return add


def twin(name: str) -> str:
    """The SQL of a query registered before, for use in another's."""
    return _SQL[name]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a few digits: engines add them up in different orders."""
    return df.select(*[F.round(F.col(f"`{c}`"), digits).alias(c) if kind == "double" else F.col(f"`{c}`") for c, kind in df.dtypes])


def _load() -> None:
    from . import audit, boxes, curves, grids, records, scans, sequences, streams, tube_queries  # noqa: F401  they register


def queries() -> dict[str, Callable]:
    """Name to query."""
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    _load()
    return dict(_SQL)

"""A registry of named queries with optional SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..session import package_on_workers
from ..sources.bridge import SQL, Relations

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of Relations under its name; ``sql`` may use the bridge's relations."""

    def register(fn: Callable[[Relations], DataFrame]) -> Callable[[Relations], DataFrame]:
        name = fn.__name__
        QUERIES[name] = lambda spark, sf_dir: fn(Relations(package_on_workers(spark), sf_dir))
        if sql is not None:
            body = sql.strip()
            ORACLES[name] = f"WITH RECURSIVE {SQL}{',' if not body.upper().startswith('SELECT') else ''} {body}"
        return fn

    return register

"""Registry of runnable queries and of the SQL text that defines each result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from partner_analytics.session import tune
from partner_analytics.sources.tables import Warehouse


@dataclass(frozen=True)
class Entry:
    key: str
    build: Callable[[Warehouse], DataFrame]
    oracle: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Warehouse(tune(spark), sf_dir))


ENTRIES: dict[str, Entry] = {}


def query(key: str, oracle: str | None = None):
    """Register a query; ``oracle`` is SQL over the raw tables that must give the same rows."""

    def register(build):
        if key in ENTRIES:
            raise ValueError(f"query {key!r} registered twice")
        ENTRIES[key] = Entry(key, build, oracle)
        return build

    return register

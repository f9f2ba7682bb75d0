"""CRM extracts: quoted column names to canonical ones, and back for the upload."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def crm(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Keep the columns named in ``mapping`` (extract name to canonical name)."""
    return df.select(*[F.col(f"`{source}`").alias(name) for source, name in mapping.items()])


def labels(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Restore the labels of the extract at the sink."""
    return df.select(*[F.col(name).alias(source) for source, name in mapping.items()])

"""Registry of named queries: a Spark callable ``(spark, sf_dir) -> DataFrame`` and, where the
result is expressible in SQL, the DuckDB oracle SQL over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: str


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None, ops: str):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql, ops)
        return fn
    return deco


def round6(df: DataFrame) -> DataFrame:
    """Round every DOUBLE column to 6 decimals (both sides of the oracle compare do this)."""
    cols: list[Column] = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name).cast("double"), 6).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)

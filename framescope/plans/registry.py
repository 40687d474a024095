"""Named queries: a Spark function and, where SQL can say the same, the SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return keep


def r6(col, name: str) -> Column:
    """Rounded to six digits; adding zero turns -0.0 into 0.0."""
    col = F.col(col) if isinstance(col, str) else col
    return (F.round(col.cast("double"), 6) + F.lit(0.0)).alias(name)


def s6(expr: str, name: str) -> str:
    return f"round(({expr})::double, 6) + 0e0 AS {name}"


def clamp_sql(x: str, lo: float = 0, hi: float = 1) -> str:
    return f"greatest({float(lo)}::double, least({x}, {float(hi)}::double))"


def draw_sql(ident: str, seed: int, name: str) -> str:
    return f"(('0x' || substr(md5(concat_ws('|', ({ident})::varchar, '{seed}', '{name}')), 1, 8))::bigint / 4294967296e0)"

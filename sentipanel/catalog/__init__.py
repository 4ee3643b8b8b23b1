"""Registered queries: each is a Spark computation over the driver tables
(through the fixture views) paired with an independent DuckDB SQL oracle.

``Spec.dbl`` lists the double columns; both engines round them to
``Spec.digits`` decimals so the value hash is insensitive to summation order.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..plans.fixtures import Fixtures, cte_prefix

REGISTRY: dict[str, "Spec"] = {}


@dataclass
class Spec:
    name: str
    fn: Callable[[Fixtures], DataFrame]
    sql: str | None
    dbl: tuple[str, ...] = ()
    digits: int = 6
    note: str = ""


def register(name: str, sql: str | None, dbl: str = "", digits: int = 6, note: str = ""):
    def deco(fn):
        REGISTRY[name] = Spec(name, fn, sql, tuple(dbl.split()), digits, note)
        return fn
    return deco


# Added before rounding in both engines: values on a decimal grid (prices,
# 2-decimal fixture scores) often sit exactly on a rounding tie, where tiny
# summation-order differences would round different ways.
ROUND_OFFSET = 3.14159265e-9


def round_doubles(df: DataFrame, digits: int) -> DataFrame:
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    if not cols:
        return df
    return df.withColumns({c: F.round(F.col(c).cast("double") + F.lit(ROUND_OFFSET), digits) for c in cols})


def run_spec(spec: Spec, spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_doubles(spec.fn(Fixtures(spark, sf_dir)), spec.digits)


def oracle_text(spec: Spec) -> str | None:
    if spec.sql is None:
        return None
    if not spec.dbl:
        return spec.sql
    rep = ", ".join(f"CAST(round(CAST({c} AS DOUBLE) + {ROUND_OFFSET}, {spec.digits}) + 0.0 AS DOUBLE) AS {c}" for c in spec.dbl)
    return f"SELECT * REPLACE ({rep}) FROM (\n{spec.sql}\n) AS oracle_q"


def load_all():
    # import for side effect: registration
    from . import panel_q, text_q, stats_q, agg_q, ingest_q, window_q, model_q, join_q, scoring_q, causal_q, io_q  # noqa: F401
    return REGISTRY


def cte(*names: str) -> str:
    return cte_prefix(*names)

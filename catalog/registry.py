"""Registration of queries and the output form both engines share."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanledger.session import own_scratch, ship_packages

_ROOT = Path(__file__).resolve().parent.parent
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def portable(df: DataFrame) -> DataFrame:
    """Booleans as text, arrays joined by |, doubles rounded to six places."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.BooleanType):
            c = c.cast("string")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c, "|")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), 6)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


def _runner(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own_scratch(spark)
        ship_packages(spark, _ROOT / "spanledger", _ROOT / "catalog")
        return portable(fn(spark, sf_dir))
    return run


def query(name: str, sql: str | None = None, *, bools: str = "", arrays: str = "", doubles: str = "",
          longs: str = "") -> Callable[[Query], Query]:
    """Register a query; its oracle gets the same output form for the named columns."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = _runner(fn)
        if sql is not None:
            changes = [f"CAST({c} AS VARCHAR) AS {c}" for c in bools.split()]
            changes += [f"array_to_string({c}, '|') AS {c}" for c in arrays.split()]
            changes += [f"round({c}, 6) AS {c}" for c in doubles.split()]
            changes += [f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()]
            replace = f" REPLACE ({', '.join(changes)})" if changes else ""
            ORACLES[name] = f"SELECT *{replace} FROM (\n{sql}\n) q"
        return fn
    return register

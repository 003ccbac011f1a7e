"""The registry of queries: name, function, and DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with DuckDB SQL where SQL expresses it."""

    def run(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded_double(c: Column, digits: int) -> Column:
    """A double rounded as SQL does: what rounds to zero keeps its sign."""
    r = F.round(c, digits)
    return F.when(r == 0, F.signum(c) * F.lit(0.0)).otherwise(r)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.withColumns({c: rounded_double(F.col(c), digits) if kinds[c] == "double" else F.round(c, digits) for c in columns})

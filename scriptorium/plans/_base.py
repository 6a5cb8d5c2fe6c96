"""Registration of named queries with their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the DuckDB SQL of the same result."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(s: str) -> str:
    """A SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_map(d: dict) -> str:
    """A DuckDB map literal of strings."""
    return "MAP {" + ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in d.items()) + "}"

"""The queries of the driver contract, by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir) under a name, with SQL for its rows."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table with its time in microseconds (us) and, from props, k."""
    rows = table(spark, sf_dir, "events")
    return rows.withColumns({"us": F.unix_micros(F.col("ts").cast("timestamp")), "k": F.get_json_object("props", "$.k").cast("int")})


#: The same in DuckDB.
E = "(select *, epoch_us(ts) as us, cast(json_extract(props, '$.k') as int) as k from events)"

#: The fields of an event as JSON, its time in whole microseconds, as Spark's JSON has milliseconds only; and the same in DuckDB, without nulls.
FIELDS = ("event_id", "us", "user_id", "event_type", "value", "props")
JSON = "'{' || concat_ws(',', " + ", ".join(f"""'"{c}":' || cast(to_json({c}) as varchar)""" for c in FIELDS) + ") || '}'"


def queries() -> dict:
    from eventloom.plans import form_queries, named_queries, recording_queries, row_queries, stream_queries, summary_queries, view_queries  # noqa: F401

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)

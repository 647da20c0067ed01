"""Every query of the engine equals its SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from eventloom.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.fixture(scope="module")
def db(sf_dir):
    out = duckdb.connect()
    for t in TABLES:
        out.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return out


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_equals_sql(spark, sf_dir, db, name):
    df = catalogue.queries()[name](spark, sf_dir)
    found = db.execute(catalogue.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    wanted = sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in df.collect()), key=repr) == wanted


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = catalogue.queries()["filter_eq_and"](spark, sf_dir)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "EqualTo(event_type,view)" in plan
    scan = next(line for line in plan.splitlines() if line.startswith("ReadSchema"))
    assert "props" not in scan


def test_whole_tables_are_looked_at(spark, sf_dir, db, tmp_path):
    found = catalogue.queries()
    (n,) = db.execute("select count(*) from events").fetchone()
    assert found["sink_json_events"](spark, sf_dir).count() == n
    assert [r["rows"] for r in found["byte_tree_events"](spark, sf_dir).where("level = 0").collect()] == [n]
    users = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("user_id", F.col("user_id") + 20)
    users.write.parquet(f"{tmp_path}/events.parquet")
    assert found["agg_set"](spark, str(tmp_path)).count() == 0
    sets = {r["event_type"]: set(r["ks"].split(",")) for r in found["agg_set_all"](spark, str(tmp_path)).collect()}
    assert sets == {t: set(ks) for t, ks in db.execute("select event_type, list(distinct json_extract_string(props, '$.k')) from events group by 1").fetchall()}


def test_previous_times_are_taken_in_ranges(spark, sf_dir):
    plan = catalogue.queries()["delta_ts"](spark, sf_dir)._jdf.queryExecution().analyzed().toString()
    assert all("__slot" in line for line in plan.splitlines() if "lag(" in line) and "lag(" in plan

import duckdb
import pytest

from eventloom.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", ["op5_lm_score", "op5_lm_score_bigrams", "op10_near_copies"])
def test_query_equals_sql(spark, sf_dir, name):
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{sf_dir}/documents.parquet')")
    found = queries()[name](spark, sf_dir)
    wanted = db.execute(oracle_sql()[name])
    assert [c[0] for c in wanted.description] == found.columns
    assert sorted(map(tuple, found.collect())) == sorted(wanted.fetchall())

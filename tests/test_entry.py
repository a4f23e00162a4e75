import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
NAMES = ("vocabulary_topk", "tokenize_subwords", "tfidf_norm_check", "knn_topk", "near_dup_clusters", "exact_dup_pairs", "jaccard_pairs", "stratified_split", "audit_sample", "payload_extract", "cache_misses")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    got, want = entry.queries()[name](spark, DATA).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got) == sorted(want)
    key = lambda df: sorted(map(repr, df[sorted(df)].astype(object).itertuples(index=False, name=None)))
    assert key(got) == key(want)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())

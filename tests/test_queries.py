"""Every registered query: SQL-checked ones against DuckDB at sf0.01, the rest smoke-run at
sf0.001; the driver contract of ``__spark_entry__``."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as E  # noqa: E402
from oracle_compare import TABLES, _rows  # noqa: E402
from worthrank.plans import REGISTRY  # noqa: E402

SF01 = "/root/testdata/sf0.01"
SF001 = "/root/testdata/sf0.001"
# the corpus queries have their own tests
SQL = {n: q.sql for n, q in REGISTRY.items() if q.sql is not None}
ALL = {n: q.run for n, q in REGISTRY.items()}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c


def test_entry_contract(spark):
    df = E.entry(spark)
    assert df.columns[:3] == ["topic_id", "n", "n_rel"]
    assert df.count() > 0
    assert set(SQL) <= set(E.oracle_sql()) <= set(E.queries()) >= set(ALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_oracle(spark, con, name):
    sp = ALL[name](spark, SF01).toPandas()
    dk = con.execute(SQL[name]).df()
    c1, r1 = _rows(sp)
    c2, r2 = _rows(dk)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_rows_only_queries_run(spark, name):
    df = ALL[name](spark, SF001)
    assert df.count() > 0


RANGE_QUERIES = ["ranking_metrics", "order_ranking_metrics", "supplier_ranking_metrics", "precision_curve",
                 "segment_by_restart", "split_output_check", "train_val_split", "weighted_resample",
                 "ratio_sample", "leaderboard", "format_violations_2019", "manifest_check", "encode_pad",
                 "run_log_newest_first", "file_based_evaluation", "file_based_evaluation_2020"]


@pytest.mark.parametrize("name", RANGE_QUERIES)
def test_many_range_partitions_against_oracle(spark, con, name):
    """The two-level ranking gives the oracle's answer on every query that ranks, also over many partitions."""
    from worthrank.operators.ranking import PARTITIONS_CONF

    spark.conf.set(PARTITIONS_CONF, "9")
    try:
        sp = ALL[name](spark, SF01).toPandas()
    finally:
        spark.conf.unset(PARTITIONS_CONF)
    dk = con.execute(SQL[name]).df()
    c1, r1 = _rows(sp)
    c2, r2 = _rows(dk)
    assert c1 == c2 and len(r1) == len(r2) and r1 == r2

"""The driver's contract: names agree, and a few queries match their SQL on real tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_names():
    pedigree = [q for q in entry.queries() if not q.startswith("op") and q != "pipeline"]
    assert len(pedigree) > 60 and set(pedigree) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["count_pairs_scalar", "pairs_2c", "theta_per_gen", "inbreeding", "ne_hill", "pairs_subsample"])
def test_oracle(spark, name):
    got = entry.queries()[name](spark, SF)
    names = sorted(got.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{SF}/customer.parquet')")
    con.execute(f"SELECT {', '.join(names)} FROM ({entry.oracle_sql()[name]})")
    key = lambda row: tuple(str(v) for v in row)
    assert sorted((key(r[c] for c in names) for r in got.collect())) == sorted(map(key, con.fetchall()))

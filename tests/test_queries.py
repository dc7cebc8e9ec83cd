"""Every registered query of the engine against its SQL, and never empty."""

import os

import duckdb
import pytest

import __spark_entry__
from quireflow.plans.oracles import ORACLES
from quireflow.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, tmp_path, name):
    QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/out")
    out = f"'{tmp_path}/out/*.parquet'"
    db = duckdb.connect()
    assert db.execute(f"SELECT count(*) FROM {out}").fetchone()[0] > 0
    if name not in ORACLES:
        return
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    db.execute(f"CREATE TABLE o AS {ORACLES[name]}")
    names = ", ".join(sorted(r[0] for r in db.execute("DESCRIBE o").fetchall()))
    for a, b in (("o", out), (out, "o")):
        assert not db.execute(f"SELECT {names} FROM {a} EXCEPT ALL SELECT {names} FROM {b}").fetchall()


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

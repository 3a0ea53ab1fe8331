"""Every registered query of the core engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from lamina.plans import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def rows(table):
    names = sorted(table.column_names)
    return sorted(map(repr, zip(*(table.column(c).to_pylist() for c in names), strict=True))), names


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_oracle(spark, duck, name):
    got = core.queries()[name](spark, SF).toArrow()
    want = duck.sql(core.oracle_sql()[name]).to_arrow_table()
    assert rows(got) == rows(want)


def test_rows_only(spark):
    crc = core.queries()["wal_crc"](spark, SF)
    assert crc.count() == 1000
    probe = {r.is_member: r for r in core.queries()["bloom_probe"](spark, SF).collect()}
    assert probe[True].n == probe[True].passed
    assert probe[False].passed <= 0.15 * probe[False].n + 5
    assert 0 < probe[True].fill_ratio < 0.6

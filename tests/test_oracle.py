"""Every registered query against its SQL, on the given tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from contract.oracle import ORACLE_SQL
from contract.queries import QUERIES

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


def comparable(table):
    names = sorted(table.column_names)
    types = {n: str(table.schema.field(n).type).replace(", tz=UTC", "") for n in names}

    def value(v):
        if isinstance(v, float):
            return round(v, 9)
        return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v

    rows = sorted((tuple(value(r[n]) for n in names) for r in table.to_pylist()), key=repr)
    return names, {n: t.replace("large_", "") for n, t in types.items()}, rows


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE_SQL)
    assert set(QUERIES) <= set(entry_module.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_oracle(production, duck, name):
    ours = comparable(QUERIES[name](production, SF).toArrow())
    theirs = comparable(duck.sql(ORACLE_SQL[name]).to_arrow_table())
    assert ours[0] == theirs[0]
    assert ours[1] == theirs[1]
    assert ours[2] == theirs[2]


def test_entry(production):
    result = entry_module.entry(production)
    assert result.columns == ["day", "traffic_sum", "users"]
    assert result.count() == 21

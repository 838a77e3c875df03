"""Every registered query with SQL gives the rows of that SQL."""

import math

import duckdb
import pytest

from docloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(rows):
    return sorted(repr([round(v, 6) if isinstance(v, float) and math.isfinite(v) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_same_rows(spark, sql, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    want = sql.execute(f"SELECT {', '.join(names)} FROM ({registry.ORACLE_SQL[name].strip()})").fetchall()
    assert plain(map(tuple, df.select(*names).collect())) == plain(want)

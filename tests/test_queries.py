"""Every registered promotion query against its SQL, on the smallest tables."""

import math
from collections import Counter

import duckdb
import pytest

from larder.plans import more, sources, tables  # noqa: F401  register their queries
from larder.plans import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, duck, sf_dir, name):
    df = Q.QUERIES[name](spark, sf_dir)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    if name in Q.SQL:
        rel = duck.sql(Q.SQL[name])
        at = [rel.columns.index(n) for n in names]
        assert sorted(rel.columns) == names and got == Counter(tuple(plain(r[k]) for k in at) for r in rel.fetchall())
    else:
        assert names


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 3 and set(entry.oracle_sql()) <= set(entry.queries())

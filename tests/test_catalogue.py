"""Every registered query of the library against its SQL in DuckDB."""

import pytest

from tarnweave.catalogue import ORACLE_SQL, QUERIES


def plain(v):
    return tuple(v) if isinstance(v, list) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, data):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in ORACLE_SQL:
        assert columns
        return
    found = duck.sql(ORACLE_SQL[name])
    names = list(found.columns)
    assert sorted(names) == columns
    expected = sorted((tuple(plain(dict(zip(names, r))[c]) for c in columns) for r in found.fetchall()), key=repr)
    assert rows == expected


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

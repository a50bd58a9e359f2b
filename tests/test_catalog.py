"""Every query with an oracle gives the oracle's rows; the others give rows."""

from decimal import Decimal

import pytest

from quire import catalog


def rows_of(columns, rows):
    def plain(v):
        if isinstance(v, (float, Decimal)):
            return round(float(v), 6)
        return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, tiny, oracle, name):
    df = catalog.queries()[name](spark, tiny)
    found = rows_of(df.columns, df.collect())
    if name in catalog.oracle_sql():
        rel = oracle.sql(catalog.oracle_sql()[name])
        assert sorted(df.columns) == sorted(rel.columns)
        assert found == rows_of(rel.columns, rel.fetchall())
    else:
        assert found


def test_flagship(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every registered query against its SQL on the smallest tables, several at a time."""

import os
from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from tessera.plans import registry

SF = "/root/testdata/sf0.001"
LETTERS = sorted({n[0] for n in registry.queries()})


def plain(value):
    return float(f"{value:.9g}") if isinstance(value, float) else value


def table(names, at, rows):
    return sorted(repr(tuple(plain(r[i]) for i in at)) for r in rows)


def difference(spark, name):
    """What is wrong with a query, or None."""
    try:
        con = duckdb.connect()
        for f in os.listdir(SF):
            con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
        df = registry.queries()[name](spark, SF)
        cols = sorted(df.columns)
        want = con.sql(registry.oracle_sql()[name])
        if sorted(want.columns) != cols:
            return f"{name}: columns {cols} and {sorted(want.columns)}"
        got = table(cols, [df.columns.index(c) for c in cols], df.collect())
        told = table(cols, [want.columns.index(c) for c in cols], want.fetchall())
        return None if got == told else f"{name}: {len(got)} and {len(told)} rows, {sorted(set(got) ^ set(told))[:2]}"
    except Exception as e:  # noqa: BLE001  the assertion below reports it
        return f"{name}: {type(e).__name__} {str(e)[:300]}"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("letter", LETTERS)
def test_queries_equal_their_sql(spark, letter):
    names = [n for n in sorted(registry.oracle_sql()) if n[0] == letter]
    with ThreadPoolExecutor(4) as pool:
        assert [x for x in pool.map(lambda n: difference(spark, n), names) if x] == []


def test_every_sql_has_its_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"f6_cycle_paths"}

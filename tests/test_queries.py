"""Every query that SQL can express, against DuckDB on the small tables; the others must run and have rows."""

import pytest

from evidloom.plans import checks, data_quality, evidence, files, records
from tests.oracle import same

MODULES = (data_quality, evidence, files, records, checks)
WITH_SQL = [(m, n) for m in MODULES for n in m.SQL]
WITHOUT = [(m, n) for m in MODULES for n in m.QUERIES if n not in m.SQL]


@pytest.mark.parametrize(("module", "name"), WITH_SQL, ids=[n for _, n in WITH_SQL])
def test_equals_sql(spark, sf, module, name):
    same(spark, sf, module.QUERIES[name], module.SQL[name])


@pytest.mark.parametrize(("module", "name"), WITHOUT, ids=[n for _, n in WITHOUT])
def test_runs(spark, sf, module, name):
    df = module.QUERIES[name](spark, sf)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0

"""Every query with SQL gives the rows DuckDB gives, on the smallest tables."""

import importlib.util
from pathlib import Path

import pytest

DATA = Path("/root/testdata/sf0.001")


def entry():
    path = Path(__file__).resolve().parent.parent / "__spark_entry__.py"
    spec = importlib.util.spec_from_file_location("spark_entry_under_test", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def plain(rows):
    def one(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool):
            return v
        return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio") else str(v)

    return sorted((tuple(one(v) for v in r) for r in rows), key=repr)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_sql_gives_the_same_rows(spark):
    import duckdb

    from quire.plans import catalog

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    queries = catalog.queries()
    for name, sql in catalog.oracle_sql().items():
        got = queries[name](spark, str(DATA))
        columns = sorted(got.columns)
        want = con.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(names) == columns, name
        rows = want.fetchall()
        assert plain([tuple(r[c] for c in columns) for r in got.collect()]) == plain([tuple(r[names.index(c)] for c in columns) for r in rows]), name


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_entry(spark):
    e = entry()
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plan_prunes_columns(spark):
    if DATA.exists():
        from quire.plans import reference

        plan = reference.QUERIES["cache_newest"](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
        assert "page_json" not in plan

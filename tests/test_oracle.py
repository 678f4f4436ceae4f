"""Every registered query of the engine against its SQL, on the smallest tables."""

import duckdb
import pytest

from quillspark.plans.oracle import ORACLE
from quillspark.plans.queries import QUERIES


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for t in ("documents", "pages", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(rows, columns):
    def one(v):
        return None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(one(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, db, sf, name):
    got = QUERIES[name](spark, sf)
    want = db.execute(ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), columns)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


def test_responses_are_validated_without_python(spark, sf):
    plan = QUERIES["validate_response"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan

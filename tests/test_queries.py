"""Every registered query with SQL against DuckDB on the smallest tables."""

import pytest

from tests.compare import connect, rows
from tidemark.plans.base import DAY
from tidemark.plans.registry import QUERIES, SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), con.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_without_sql(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_greedy_spacing_takes_every_user(spark):
    d = "/root/testdata/sf0.01"
    events, last, want = connect(d).execute("select distinct user_id, epoch_us(ts) as us from events order by all").fetchall(), {}, set()
    for user, us in events:
        if user not in last or us > last[user] + DAY:
            last[user] = us
            want.add((user, us))
    got = [tuple(x) for x in QUERIES["w20_greedy_spacing"](spark, d).select("user_id", "us").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert set(got) == set(connect(d).execute(SQL["w20_greedy_spacing"]).fetchall())

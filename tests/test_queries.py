"""Every query with an oracle gives DuckDB's rows on the smallest tables; every other one runs."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for name in os.listdir(SF):
        c.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_equals_oracle(spark, con, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    rows = con.execute(registry.ORACLE_SQL[name])
    have = [d[0] for d in rows.description]
    assert sorted(have) == cols
    assert got == sorted(repr(tuple(r[have.index(c)] for c in cols)) for r in rows.fetchall())


def test_entry_has_a_row_for_each_cycle(spark):
    assert entry.entry(spark).count() == spark.read.parquet(f"{SF}/events.parquet").select("user_id").distinct().count()


def test_registered_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_run_history_by_owner_before_1970(spark, con, tmp_path):
    """Hours before the epoch are rounded down, as after it."""
    con.execute(f"copy (select * replace (ts - interval 54 year - interval 20 day as ts) from events) to '{tmp_path}/events.parquet'")
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = c.execute(registry.ORACLE_SQL["run_history_by_owner"]).fetchall()
    assert min(r[2] for r in want) < 0
    assert sorted(tuple(r) for r in registry.QUERIES["run_history_by_owner"](spark, str(tmp_path)).collect()) == sorted(want)


def test_stat_chips_of_cycles_whose_rise_is_near_half_a_cent(spark, tmp_path):
    """Users 877, 163, 162 and 498 of larger tables: their rise is below half a cent in binary, and above or at it in the shortest decimal."""
    c = duckdb.connect()
    moved = "select * replace (user_id + case user_id when 877 then 1500 when 163 then 1500 when 162 then 3000 else 4500 end as user_id)"
    c.execute(f"copy ({moved} from '/root/testdata/sf0.1/events.parquet' where user_id in (877, 163, 162, 498)) to '{tmp_path}/events.parquet' (format parquet)")
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = c.execute(registry.ORACLE_SQL["stat_chips"]).fetchall()
    assert sorted(tuple(r) for r in registry.QUERIES["stat_chips"](spark, str(tmp_path)).collect()) == sorted(want)
    assert len(want) == 4 and all("°C" in r[1] for r in want)


@pytest.mark.parametrize("kind", ["timestamp", "timestamptz"])
@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_run_history_by_owner_at_the_ends_of_hours(spark, tmp_path, kind, zone):
    """The SQL rounds to milliseconds before it takes hours, halves away from 0; it never looks at the session's zone."""
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    near = " union all ".join(f"select {k} as k, timestamp '{d}' + interval ({us}) microsecond as ts" for k, (d, us) in enumerate((d, us) for d in ("2024-01-01 05:00:00", "1970-01-01 00:00:00", "1969-07-01 04:00:00") for us in (-1501, -1500, -501, -500, -499, -1, 0, 499, 500)))
    odd = f"select 1000000 + k as event_id, ts, 90000 + k as user_id, 'view' as event_type, 0.0 as value, '' as props from ({near})"
    c.execute(f"copy (select * replace (ts::{kind} as ts) from (select * from '{SF}/events.parquet' union all {odd})) to '{tmp_path}/events.parquet' (format parquet)")
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    want = c.execute(registry.ORACLE_SQL["run_history_by_owner"]).fetchall()
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = registry.QUERIES["run_history_by_owner"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert (90003, 1000003, 473357) in want and sorted(tuple(r) for r in got) == sorted(want)

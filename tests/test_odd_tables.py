"""Queries against their SQL on small tables that hold what only larger ones do."""

import contextlib

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = {
    "events": "event_id BIGINT, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR, ts TIMESTAMP",
    "documents": "doc_id BIGINT, text VARCHAR",
}
PLANNED = [f"{i * 4 + 3}, 2317, 'view', {g * 3.125 + 1}, '{{\"k\": 1}}', TIMESTAMP '2024-01-01'" for i, g in enumerate((0, 8, 16, 24, 32, 33, 40))]


def plain(v):
    return repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)


def compared(spark, folder, name, rows, files=1):
    """Rows by table, written to so many files each; the query's result has to be its SQL's. Returns how many rows it has."""
    c = duckdb.connect()
    for table, columns in TABLES.items():
        c.sql(f"CREATE TABLE {table} ({columns})")
        for row in rows.get(table, []):
            c.sql(f"INSERT INTO {table} VALUES ({row})")
        at = folder / f"{table}.parquet"
        at.mkdir()
        for i in range(files):
            c.sql(f"COPY (SELECT * FROM {table} WHERE rowid % {files} = {i}) TO '{at}/{i}.parquet'")
    found = c.execute(entry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    want = [dict(zip(names, r)) for r in found.fetchall()]
    got = entry.queries()[name](spark, str(folder)).collect()
    told = lambda rs: sorted(str([plain(r[c]) for c in sorted(names)]) for r in rs)
    assert told(got) == told(want)
    return len(want)


@contextlib.contextmanager
def conf(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_cited_ids_of_more_than_three_digits(spark, tmp_path):
    rows = {"events": [f"{i}, {u}, 'view', 12.5, '{{\"k\": 9}}', TIMESTAMP '2024-01-01'" for i, u in ((4, 7), (9, 999), (14, 1000), (19, 1234567))], "documents": [f"{i}, 'a text'" for i in (4, 9, 14, 19)]}
    assert compared(spark, tmp_path, "cited_paths", rows) == 12


def test_proposals_of_a_run_stay_together_where_runs_turn_out_small(spark, tmp_path):
    rows = {"events": [f"{i}, 1, '{('error', 'view', 'signup', 'purchase')[i * 7 % 11 % 4]}', {i * 13 % 40}, '', TIMESTAMP '2024-01-01'" for i in range(480)]}
    with conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "20k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}):
        assert compared(spark, tmp_path, "proposal_effects", rows, files=6) == 480


def test_old_edges_recover_where_the_new_ones_do(spark, tmp_path):
    rows = {"events": [f"{m}, {u}, 'view', 1, '', TIMESTAMP '2024-01-01'" for m, u in ((740, 7), (40, 14), (400, 21), (800, 28), (500, 1))]}
    assert compared(spark, tmp_path, "regression_check", rows) == 5


@pytest.mark.parametrize("name", ["round_findings", "round_plan", "round_probes", "streamed_plan", "streamed_probes"])
def test_conditions_beyond_an_axis_are_no_places_of_its_scan(spark, tmp_path, name):
    assert compared(spark, tmp_path, name, {"events": PLANNED}) >= 1


def test_pages_of_one_small_file_are_read_in_many_tasks(spark):
    out = entry.queries()["uncited_figures"](spark, "/root/testdata/sf0.001")
    assert len([n for n in out.rdd.glom().map(len).collect() if n]) == int(spark.conf.get("spark.sql.shuffle.partitions"))

from pathlib import Path

import pytest

import __spark_entry__ as entry
from edgefield.queries import checking, comparing, costing, covering, preparing, recording, reporting, running, scoring, searching

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES = {k: f for g in (scoring, checking, comparing, searching, covering, costing, preparing, running, reporting, recording) for k, f in g.QUERIES.items()}
SQL = {k: q for g in (scoring, checking, comparing, searching, covering, costing, preparing, running, reporting, recording) for k, q in g.SQL.items()}

pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="the generated tables are not here")


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, duck, name):
    found = duck.execute(SQL[name])
    names = [x[0] for x in found.description]
    want = [dict(zip(names, r)) for r in found.fetchall()]
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(names)
    rows = lambda rs: sorted(str([plain(r[c]) for c in columns]) for r in rs)
    assert rows(got.collect()) == rows(want)


def test_entry_and_registry(spark):
    out = entry.entry(spark)
    assert out.columns == ["probe_id", "map50"] and out.count() == 5
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_corpus_operators():
    root = Path(entry.__file__).parent / "edgefield"
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "llm" not in path.read_text(), path

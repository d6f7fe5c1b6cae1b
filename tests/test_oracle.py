"""Every core query beside its DuckDB twin on the smallest tables, as the driver compares them."""

from pathlib import Path

import duckdb
import pytest
from conftest import SF

from tools.compare import canonical
from waymark.plans.data_queries import DATA
from waymark.plans.index_queries import INDEX

QUERIES = DATA.queries | INDEX.queries
SQL = DATA.sql | INDEX.sql


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = canonical([tuple(r) for r in df.select(*(df[c] for c in cols)).collect()])
    if name in SQL:
        assert sorted(x[0] for x in db.execute(f"SELECT * FROM ({SQL[name]}) LIMIT 0").description) == cols
        assert got == canonical(db.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall())


def test_ann_recall(spark):
    from waymark.operators.vectors import CellIndex, nearest_for_all
    from waymark.plans.index_queries import _vectors

    v = _vectors(spark, SF)
    q = v.where("id % 100 = 0")
    exact = {tuple(r) for r in nearest_for_all(v, q, 5).select("query_id", "id").collect()}
    found = {tuple(r) for r in CellIndex(v).search(q, 5).select("query_id", "id").collect()}
    assert len(exact & found) >= 0.9 * len(exact)

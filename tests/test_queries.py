"""Every registered query of the library against its DuckDB statement, as multisets of rows."""

import datetime
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tenderflow.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, datetime.date):
        return x.isoformat()
    return x


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in Path(FOLDER).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, db, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLE_SQL:
        return
    rel = db.sql(registry.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    kinds = dict(zip(rel.columns, map(str, rel.types), strict=True))
    mine = dict(df.dtypes)
    same = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}
    assert {c: same.get(kinds[c], kinds[c]) for c in columns} == {c: mine[c] for c in columns}
    place = [rel.columns.index(c) for c in columns]
    expected = Counter(tuple(plain(r[i]) for i in place) for r in rel.fetchall())
    assert rows == expected, (list((rows - expected).items())[:3], list((expected - rows).items())[:3])

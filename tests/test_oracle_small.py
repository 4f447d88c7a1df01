"""Every query that has an SQL oracle agrees with DuckDB on the sf0.001 tables."""
import math

import duckdb
import pandas as pd
import pytest

from siftwise.plans import ORACLE, QUERIES
from siftwise.sources.tables import TABLES

from .conftest import SF_SMALL


def _norm(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return int(v) if v.is_integer() else round(v, 9)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _spark_type(t) -> str:
    name = t.simpleString()
    simple = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
              "boolean": "BOOLEAN", "float": "FLOAT"}
    if name.startswith("array<"):
        return _spark_type(t.elementType) + "[]"
    return simple.get(name, name.upper())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, duck, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    s_types = {f.name: _spark_type(f.dataType) for f in sdf.schema.fields}
    s = sdf.toPandas()
    res = duck.execute(ORACLE[name])
    d_types = {c[0]: str(c[1]).upper() for c in res.description}
    d = res.df()
    assert sorted(s.columns) == sorted(d.columns)
    assert s_types == d_types
    cols = sorted(s.columns)
    rows = lambda df: sorted((tuple(_norm(x) for x in r) for r in df[cols].itertuples(index=False)), key=repr)
    assert len(s) == len(d)
    assert rows(s) == rows(d)

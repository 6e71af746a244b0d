"""Every query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from tracewright.plans import catalog

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def key(row):
    return tuple((v is None, "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)) for v in row)


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or math.isclose(a, b, rel_tol=1e-7, abs_tol=1e-7)
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(close(x, y) for x, y in zip(a, b))
    return a == b and type(a) is type(b)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, db, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()), key=key)
    cur = db.execute(catalog.ORACLES[name])
    assert sorted(d[0] for d in cur.description) == names
    order = [[d[0] for d in cur.description].index(n) for n in names]
    want = sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=key)
    assert got or not want
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want) if not all(close(a, b) for a, b in zip(g, w))]
    assert not bad, bad[:3]
    exact = sum(g == w for g, w in zip(got, want))
    if exact < len(want):
        print(f"INEXACT {name} {exact}/{len(want)}")

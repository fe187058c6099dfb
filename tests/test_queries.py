"""Every registered query with SQL gives what DuckDB gives on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from lodestone.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    return v.isoformat() if isinstance(v, datetime.datetime) else "~" if v is None else str(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in registry.ORACLES:
        assert mine
        return
    got = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    assert mine == sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall())


def test_plans_have_no_cartesian_product_and_limit_groups(spark):
    text = registry.QUERIES["topn_per_group"](spark, DATA)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in text
    for name in ("keyword_score", "discover_sequential", "metrics_table", "html_text"):
        text = registry.QUERIES[name](spark, DATA)._jdf.queryExecution().toString()
        assert "CartesianProduct" not in text and "BatchEvalPython" not in text


def test_pruned_scan(spark):
    text = registry.QUERIES["denormalise_corpus"](spark, DATA)._jdf.queryExecution().toString()
    assert "s_acctbal" not in text.split("Physical Plan")[-1]

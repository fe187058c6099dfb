"""Statements and types made of a table of one small file are worked on by all cores, and what repeats in them is worked out once."""

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ddl, dialect, perrow
from lodestone.plans import registry


@pytest.mark.parametrize("name", ["dialect_rewrite", "type_map", "ddl_parse", "lineage_tables"])
def test_rows_of_one_file_reach_all_cores(spark, name):
    cores = spark.sparkContext.defaultParallelism
    rows = registry.QUERIES[name](spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(rows) >= cores and max(r["count"] for r in rows) < sum(r["count"] for r in rows) / 2


def test_spread_keeps_rows(spark):
    df = spark.range(100, numPartitions=1)
    assert sorted(r.id for r in perrow.spread(df).collect()) == list(range(100))


def test_repeated_calls_are_rewritten_once():
    dialect._kept_call.cache_clear()
    for k in range(50):
        assert dialect.to_spark(f"SELECT 'n{k}', IFNULL(a, IIF(b, 1, 2)) FROM t_{k}") == f"SELECT 'n{k}', nvl(a, CASE WHEN b THEN 1 ELSE 2 END) FROM t_{k}"
    assert dialect._kept_call.cache_info().misses == 2
    long = "x" * dialect.SHORT_CALL
    assert dialect.to_spark(f"SELECT IFNULL({long}, \"a\"), iif (a, \"b c\", '\"'), f ( \"x\" ) FROM \"t\"") == f"SELECT nvl({long}, `a`), CASE WHEN a THEN `b c` ELSE '\"' END, f( `x` ) FROM `t`".replace("f( `x`", "f ( `x`")
    assert dialect._kept_call.cache_info().misses == 4  # the long call is not kept


def test_repeated_types_are_mapped_once():
    ddl.target_type.cache_clear()
    assert [ddl.target_type("VARCHAR(20)") for _ in range(50)] == ["VARCHAR2(20)"] * 50
    assert ddl.target_type.cache_info().misses == 1 and ddl.target_type(None) == ddl.target_type("") == "VARCHAR2(4000)"


def test_parts_of_definitions(spark):
    rows = ddl.column_rows("CREATE TABLE t (\n a INT, -- one, of two\n /* b, c */ b TEXT DEFAULT '(,)' ,\n -- no more\n CHECK (a > 1))")
    assert [(r[2], r[3], r[8]) for r in rows] == [("a", "INT", None), ("b", "TEXT", "'(,)'")]
    made = registry.QUERIES["ddl_parse"](spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism

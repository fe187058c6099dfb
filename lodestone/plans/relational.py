"""Corpora, ranking and relational operators over the star schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import corpus, sweep
from lodestone.operators.ranking import promote, top_n, with_normalised

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def minmax_normalise(spark, d):
    o = _table(spark, d, "orders")
    return with_normalised(o, "o_totalprice", ["o_orderpriority"], "score").select("o_orderkey", "o_orderpriority", F.round("score", 6).alias("score"))


def topn_per_group(spark, d):
    order = [F.desc("l_extendedprice"), F.asc("l_linenumber"), F.asc("l_partkey"), F.asc("l_suppkey"), F.asc("l_quantity")]
    out = top_n(_table(spark, d, "lineitem"), ["l_orderkey"], order, 3)
    return out.select("l_orderkey", "rank", "l_extendedprice", "l_linenumber", "l_partkey", "l_suppkey")


def topk_objects(spark, d):
    spent = _table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("total"))
    rows = spent.join(_table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")
    return rows.orderBy(F.desc("total"), F.asc("c_custkey")).limit(20)  # a top-k report


def denormalise_corpus(spark, d):
    n = _table(spark, d, "nation").join(_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = _table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select("s_suppkey", F.concat_ws(" ", "s_name", "n_name", "r_name").alias("search_text"))


def outer_apply_annotations(spark, d):
    pair = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.concat_ws(": ", "l_returnflag", F.col("l_partkey").cast("string")).alias("t"))
    notes = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(pair)), lambda x: x["t"]), "; ").alias("annotation"))
    return _table(spark, d, "orders").select("o_orderkey", "o_orderstatus").join(notes, "o_orderkey", "left")


def column_summary(spark, d):
    # Numbers of different sizes sort as numbers; pieces of a source are put in order within themselves before they are joined.
    return _table(spark, d, "documents").groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string")), " ").alias("column_summary"))


def catalog_columns(spark, d):
    found = corpus.catalog_columns(spark, {n: _table(spark, d, n) for n in NAMES})
    counts = reduce(lambda a, b: a.union(b), [_table(spark, d, n).agg(F.lit(n).alias("object_name"), F.count("*").alias("n_rows")) for n in NAMES])
    return corpus.column_corpus(found).select("object_name", "pos", "column_name", "data_type").join(counts, "object_name")


def object_corpus(spark, d):
    found = corpus.catalog_columns(spark, {n: _table(spark, d, n) for n in NAMES})
    return corpus.object_corpus(found).select("object_name", "column_summary", "search_text")


def upsert_merge(spark, d):
    base = _table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    rich = base.where("c_acctbal > 5000").select("c_custkey", F.upper("c_name").alias("c_name"), F.round(F.col("c_acctbal") + 1, 2).alias("c_acctbal"))
    new = base.where("c_acctbal > 9000").select((F.col("c_custkey") + 10_000_000_000).alias("c_custkey"), "c_name", "c_acctbal")
    return corpus.upsert(base, rich.union(new), "c_custkey")


def delete_reinsert(spark, d):
    base = _table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    fresh = base.where("o_orderpriority = '1-URGENT' AND o_totalprice > 100000").withColumn("o_totalprice", F.round("o_totalprice"))
    return corpus.replace_group(base, fresh, "o_orderpriority")


def promote_missing(spark, d):
    rich = _table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    bought = _table(spark, d, "orders").select(F.col("o_custkey").alias("key"))
    return rich.withColumn("how", F.lit("object")).union(promote(rich, bought, ["key"]).withColumn("how", F.lit("promoted")))


def fk_validate(spark, d):
    lines, orders, parts = (_table(spark, d, n) for n in ("lineitem", "orders", "part"))
    a = corpus.foreign_key_orphans(lines, "l_orderkey", orders, "o_orderkey").agg(F.count("*").alias("orphans")).withColumn("key", F.lit("l_orderkey"))
    b = corpus.foreign_key_orphans(lines, "l_partkey", parts, "p_partkey").agg(F.count("*").alias("orphans")).withColumn("key", F.lit("l_partkey"))
    return a.union(b).select("key", "orphans")


def pk_validate(spark, d):
    a = corpus.duplicate_keys(_table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).agg(F.count("*").alias("duplicates"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).withColumn("key", F.lit("lineitem"))
    b = corpus.duplicate_keys(_table(spark, d, "orders"), ["o_orderkey"]).agg(F.count("*").alias("duplicates"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows")).withColumn("key", F.lit("orders"))
    return a.union(b).select("key", "duplicates", "rows")


def json_props(spark, d):
    return _table(spark, d, "events").select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


def identifier_hash(spark, d):
    long = F.concat(F.repeat(F.concat(F.col("c_name"), F.lit("_")), 5), F.col("c_mktsegment"))
    return _table(spark, d, "customer").select("c_custkey", T.short_identifier(long).alias("name"), T.short_identifier(F.col("c_name")).alias("short"))


def batch_report(spark, d):
    rows = sweep.batches(_table(spark, d, "events").select("event_id", "value"), "event_id", 100)
    return rows.groupBy("batch").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("avg_value"))


def event_windows(spark, d):
    w = F.window("ts", "1 hour")
    return _table(spark, d, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_sessions(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))
    marked = _table(spark, d, "events").withColumn("new", F.when(gap.isNull() | (gap > 1_800_000_000), 1).otherwise(0))
    numbered = marked.withColumn("session", F.sum("new").over(w))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("begins"))


QUERIES = {
    f.__name__: f
    for f in (
        minmax_normalise, topn_per_group, topk_objects, denormalise_corpus, outer_apply_annotations, column_summary, catalog_columns, object_corpus, upsert_merge,
        delete_reinsert, promote_missing, fk_validate, pk_validate, json_props, identifier_hash, batch_report, event_windows, event_sessions,
    )
}

_counts = " UNION ALL ".join(f"SELECT '{n}' AS object_name, count(*) AS n_rows FROM {n}" for n in NAMES)
CATALOG = {
    "region": "r_regionkey int, r_name string", "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string", "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string", "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int", "pages": "page_id bigint, url string, html string", "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int", "conversations": "conv_id bigint, turn bigint, role string, text string",
}
_catalog = ", ".join(f"('{t}', {i}, '{c.split()[0]}', '{c.split()[1]}')" for t, cs in CATALOG.items() for i, c in enumerate(cs.split(", "), 1))
_objects = ", ".join(f"('{t}', '{' '.join(c.split()[0] for c in cs.split(', '))}')" for t, cs in CATALOG.items())

ORACLES = {
    "minmax_normalise": """SELECT o_orderkey, o_orderpriority, round(CASE WHEN max(o_totalprice) OVER w = min(o_totalprice) OVER w THEN 1.0::DOUBLE
ELSE (o_totalprice - min(o_totalprice) OVER w) / (max(o_totalprice) OVER w - min(o_totalprice) OVER w) END, 6) AS score FROM orders WINDOW w AS (PARTITION BY o_orderpriority)""",
    "topn_per_group": """SELECT l_orderkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey, l_quantity))::INT AS rank,
l_extendedprice, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY rank <= 3""",
    "topk_objects": "SELECT c_custkey, total, c_name FROM (SELECT o_custkey AS c_custkey, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) JOIN customer USING (c_custkey) ORDER BY total DESC, c_custkey LIMIT 20",
    "denormalise_corpus": "SELECT s_suppkey, concat_ws(' ', s_name, n_name, r_name) AS search_text FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "outer_apply_annotations": """SELECT o_orderkey, o_orderstatus, annotation FROM orders LEFT JOIN (SELECT l_orderkey,
string_agg(l_returnflag || ': ' || l_partkey, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag || ': ' || l_partkey) AS annotation FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
    "column_summary": "SELECT source, string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) AS column_summary FROM documents GROUP BY source",
    "catalog_columns": f"SELECT object_name, pos, column_name, data_type, n_rows FROM (VALUES {_catalog}) v(object_name, pos, column_name, data_type) JOIN ({_counts}) USING (object_name)",
    "object_corpus": f"SELECT object_name, column_summary, object_name || ' main TABLE ' || column_summary AS search_text FROM (VALUES {_objects}) v(object_name, column_summary)",
    "upsert_merge": """SELECT c_custkey, c_name, c_acctbal FROM customer WHERE NOT c_acctbal > 5000 OR c_acctbal IS NULL
UNION ALL SELECT c_custkey, upper(c_name), round(c_acctbal + 1, 2) FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT c_custkey + 10000000000, c_name, c_acctbal FROM customer WHERE c_acctbal > 9000""",
    "delete_reinsert": """SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderpriority <> '1-URGENT'
UNION ALL SELECT o_orderkey, o_orderpriority, round(o_totalprice) FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000""",
    "promote_missing": """SELECT c_custkey AS key, 'object' AS how FROM customer WHERE c_acctbal > 0
UNION ALL SELECT key, 'promoted' FROM (SELECT DISTINCT o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))""",
    "fk_validate": """SELECT 'l_orderkey' AS key, count(*) AS orphans FROM lineitem ANTI JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT 'l_partkey', count(*) FROM lineitem ANTI JOIN part ON l_partkey = p_partkey""",
    "pk_validate": """SELECT 'lineitem' AS key, count(*) AS duplicates, coalesce(sum(n), 0)::BIGINT AS rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'orders', count(*), coalesce(sum(n), 0)::BIGINT FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey HAVING count(*) > 1)""",
    "json_props": "SELECT event_id, (props->>'$.k')::INT AS k FROM events",
    "identifier_hash": """SELECT c_custkey, CASE WHEN length(n) <= 100 THEN n ELSE n[1:93] || '_' || sha1(n)[1:6] END AS name,
CASE WHEN length(c_name) <= 100 THEN c_name ELSE c_name[1:93] || '_' || sha1(c_name)[1:6] END AS short FROM (SELECT *, repeat(c_name || '_', 5) || c_mktsegment AS n FROM customer)""",
    "batch_report": "SELECT (rn - 1) // 100 AS batch, count(*) AS n, round(avg(value), 6) AS avg_value FROM (SELECT value, row_number() OVER (ORDER BY event_id) AS rn FROM events) GROUP BY 1",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_sessions": """WITH g AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 1800000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM g)
SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS begins FROM s GROUP BY user_id, session""",
}

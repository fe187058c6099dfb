"""SQL tooling: lineage, dialect rewriting, DDL, sweeps. Statements are forms that the rows of a table fill in, one of each form for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import ddl, dialect, lineage, sweep
from lodestone.operators.perrow import spread

STATEMENTS = [
    (1, "SELECT T1.o_orderkey, T2.c_name FROM orders AS T1 INNER JOIN customer AS T2 ON T1.o_custkey = T2.c_custkey WHERE T2.c_mktsegment = 'BUILDING'"),
    (2, "SELECT count(l_orderkey) FROM lineitem WHERE l_discount > 0.05 AND l_returnflag = 'A'"),
    (3, "SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey ORDER BY n.n_name"),
    (4, "SELECT `p_name` FROM part WHERE p_size BETWEEN 1 AND 5 -- sizes, from small"),
    (6, "WITH big AS (SELECT o_custkey FROM orders WHERE o_totalprice > 1000) SELECT o_custkey FROM big"),
    (5, "SELECT s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_name = 'from where')"),
]
LINEAGE = [
    (1, "orders", ["o_custkey", "o_orderkey"]), (1, "customer", ["c_custkey", "c_mktsegment", "c_name"]), (2, "lineitem", ["l_discount", "l_orderkey", "l_returnflag"]),
    (3, "nation", ["n_name", "n_regionkey"]), (3, "region", ["r_name", "r_regionkey"]), (4, "part", ["p_name", "p_size"]), (5, "supplier", ["n_name", "s_nationkey"]), (5, "nation", [None]), (6, "orders", ["o_custkey", "o_totalprice"]),
]
SQLITE = [
    (1, "SELECT IFNULL(a, 0) FROM t", "SELECT nvl(a, 0) FROM t"),
    (2, "SELECT IIF(a > 1, IIF(b, 'x', 'y'), 'IFNULL(z)') FROM t", "SELECT CASE WHEN a > 1 THEN CASE WHEN b THEN 'x' ELSE 'y' END ELSE 'IFNULL(z)' END FROM t"),
    (3, "SELECT GROUP_CONCAT(a) FROM t", "SELECT listagg(a, ',') WITHIN GROUP (ORDER BY a) FROM t"),
    (4, "SELECT CAST(a AS REAL), b AS text FROM t", "SELECT CAST(a AS DOUBLE), b AS text FROM t"),
    (5, "SELECT strftime('%Y-%m', d), strftime('%w', d) FROM t", "SELECT date_format(d, 'yyyy-MM'), CAST(dayofweek(d) - 1 AS STRING) FROM t"),
    (6, "SELECT date('now'), datetime('now'), RANDOM() FROM t", "SELECT current_date(), current_timestamp(), rand() FROM t"),
    (7, "SELECT TOTAL(a) FROM t", "SELECT coalesce(sum(a), 0D) FROM t"),
    (8, "SELECT a FROM t WHERE a GLOB 'x*.?'", "SELECT a FROM t WHERE a RLIKE '^x.*\\\\..$'"),
    (10, "SELECT strftime('%Y-%W', d) FROM t", "SELECT concat(date_format(d, 'yyyy-'), lpad((dayofyear(d) + 6 - weekday(d)) div 7, 2, '0')) FROM t"),
    (11, "SELECT date('now', '-1 day'), datetime(d, 'start of month', '+2 hours') FROM t", "SELECT CAST(CAST(current_timestamp() AS TIMESTAMP) + INTERVAL '-1' DAY AS DATE), CAST(CAST(date_trunc('MONTH', d) AS TIMESTAMP) + INTERVAL '2' HOUR AS TIMESTAMP) FROM t"),
    (12, "SELECT printf('%d: %.1f', a, b) FROM t", "SELECT format_string('%d: %.1f', CAST(a AS BIGINT), b) FROM t"),
    (9, "SELECT printf('%.2f', a) FROM t OFFSET 5 LIMIT 10", "SELECT format_string('%.2f', a) FROM t LIMIT 10 OFFSET 5"),
]
EXECUTED = "SELECT o_orderpriority AS priority, TOTAL(IIF(o_totalprice > 100000, 1, 0)) AS large, CAST(count(*) AS INTEGER) AS n, max(strftime('%Y', o_orderdate)) AS last_year, max(strftime('%j week %W of %Y', o_orderdate)) AS last_day, max(printf('%d', o_totalprice / 1000)) AS thousands, max(date(o_orderdate, 'start of month', '+1 month', '-1 day')) AS last_month FROM orders WHERE o_orderstatus GLOB '[FO]' GROUP BY o_orderpriority"
DDL = [
    "CREATE TABLE molecule (molecule_id TEXT PRIMARY KEY, label VARCHAR(20) DEFAULT 'a, (b)' NOT NULL, weight DECIMAL(8, 2), seen DATETIME DEFAULT CURRENT_TIMESTAMP)",
    "CREATE TABLE atom (atom_id INTEGER PRIMARY KEY AUTOINCREMENT, molecule_id TEXT REFERENCES molecule (molecule_id) ON DELETE CASCADE, -- which, of all\n charge REAL, flag BOOLEAN, note NVARCHAR(50), raw BLOB)",
    "CREATE TABLE bond (a INT NOT NULL, b INT, kind CHAR(5000), PRIMARY KEY (a, b), FOREIGN KEY (a) REFERENCES atom (atom_id), CONSTRAINT fk2 FOREIGN KEY (b) REFERENCES atom (atom_id) ON DELETE SET NULL, CHECK (a <> b))",
]
COLUMNS = [
    ("molecule", 1, "molecule_id", "TEXT", "VARCHAR2(4000)", "string", True, True, None), ("molecule", 2, "label", "VARCHAR(20)", "VARCHAR2(20)", "varchar(20)", False, True, "'a, (b)'"),
    ("molecule", 3, "weight", "DECIMAL(8,2)", "NUMBER(8,2)", "decimal(8,2)", False, False, None), ("molecule", 4, "seen", "DATETIME", "TIMESTAMP", "timestamp_ntz", False, False, "CURRENT_TIMESTAMP"),
    ("atom", 1, "atom_id", "INTEGER", "NUMBER", "bigint", True, True, None), ("atom", 2, "molecule_id", "TEXT", "VARCHAR2(4000)", "string", False, False, None),
    ("atom", 3, "charge", "REAL", "NUMBER", "double", False, False, None), ("atom", 4, "flag", "BOOLEAN", "NUMBER(1)", "boolean", False, False, None),
    ("atom", 5, "note", "NVARCHAR(50)", "VARCHAR2(4000)", "string", False, False, None), ("atom", 6, "raw", "BLOB", "BLOB", "binary", False, False, None),
    ("bond", 1, "a", "INT", "NUMBER", "bigint", True, True, None), ("bond", 2, "b", "INT", "NUMBER", "bigint", True, False, None), ("bond", 3, "kind", "CHAR(5000)", "CLOB", "string", False, False, None),
]
KEYS = [("atom", "FK_ATOM_1", "molecule_id", "molecule", "molecule_id", "CASCADE"), ("bond", "FK_BOND_1", "a", "atom", "atom_id", None), ("bond", "FK_BOND_2", "b", "atom", "atom_id", "SET NULL")]
TYPE_NAMES = ["TEXT", "VARCHAR(255)", "VARCHAR(9000)", "CLOB", "NCHAR", "UNSIGNED BIG INT", "DOUBLE PRECISION", "FLOAT(8)", "NUMERIC(5)", "DECIMAL(10,3)", "BOOLEAN", "DATE", "TIME", "BLOB", "GEOMETRY", ""]
TYPE_MAP = ["VARCHAR2(4000)", "VARCHAR2(255)", "CLOB", "CLOB", "NCHAR(4000)", "NUMBER", "NUMBER", "NUMBER", "NUMBER(5)", "NUMBER(10,3)", "NUMBER(1)", "DATE", "TIMESTAMP", "BLOB", "VARCHAR2(4000)", "VARCHAR2(4000)"]
MATRIX = {"modes": ["unified", "parallel"], "search_types": ["vector", "hybrid"], "dataset_forms": ["single-user"], "hybrid_scorers": ["RSF", "RRF"],
          "scorer_overrides": {"RSF": {"vector_score_weight": [10], "text_score_weight": [2, 4, 6, 8, 10]}, "RRF": {"vector_rank_penalty": [1, 2, 3, 4], "text_rank_penalty": [5]}}}


def _named(c: Column, names: list[str]) -> Column:
    """Names in a text get the row's key."""
    for name in names:
        c = F.replace(c, F.lit(name), F.concat(F.lit(f"{name}_"), "key"))
    return c


def _filled(df: DataFrame, forms: list[tuple[int, str]], names: list[str], label: str | None = None) -> DataFrame:
    """(key, statement, SQL): every form for every row of (key, label); a label stands as a literal at the start."""
    rows = df.select("*", F.inline(F.array(*[F.struct(F.lit(k).alias("statement"), F.lit(sql).alias("SQL")) for k, sql in forms])))
    sql = _named(F.col("SQL"), names)
    if label:
        sql = F.concat(F.lit("SELECT '"), label, F.lit("' AS own, "), F.substring(sql, F.lit(len("SELECT ") + 1), F.length(sql)))
    return rows.select("key", "statement", sql.alias("SQL"))


TABLES = ["orders", "customer", "lineitem", "nation", "region", "part", "supplier"]


def _parts(spark, d):
    """Keys, names and sizes of parts, dealt out while they are small: the statements and types that are made of them are not shuffled."""
    return spread(spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("key"), F.col("p_name").alias("label"), "p_size"))


def lineage_tables(spark, d):
    """Tables and columns of statements over tables of each supplier's own."""
    suppliers = spread(spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("key")))
    return lineage.lineage_frame(_filled(suppliers, STATEMENTS, TABLES))


def lineage_catalyst(spark, d):
    """The same tables by Spark's own parser, which runs on the driver: statements of each nation (a table of fixed size)."""
    nations = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("key"))
    asked = _filled(nations, STATEMENTS, TABLES).collect()
    rows = [(r["key"], r["statement"], t) for r in asked for t in lineage.catalyst_relations(spark, r["SQL"])[0]]
    return spark.createDataFrame(rows, "key int, statement int, table_name string")


def dialect_rewrite(spark, d):
    """Statements over tables of each part's own, which hold the part's name."""
    return dialect.rewritten(_filled(_parts(spark, d), [(k, sql) for k, sql, _ in SQLITE], [" FROM t"], "label"))


def dialect_executed(spark, d):
    spark.read.parquet(f"{d}/orders.parquet").createOrReplaceTempView("orders")
    return spark.sql(dialect.to_spark(EXECUTED))


NAMES = ["molecule", "atom", "bond"]


def _definitions(spark, d):
    return _filled(_parts(spark, d).where("p_size <= 25"), list(enumerate(DDL, 1)), NAMES)


def ddl_parse(spark, d):
    """Columns of tables that are defined for each of the smaller parts."""
    return ddl.parsed(_definitions(spark, d)).drop("statement")


def fk_numbering(spark, d):
    """Foreign keys of these tables, numbered over all statements."""
    return ddl.foreign_keys(_definitions(spark, d), "statement").drop("statement")


def type_map(spark, d):
    """Target types of fixed type names and of types with sizes from each part."""
    sized = [F.concat(F.lit("VARCHAR("), "key", F.lit(")")), F.concat(F.lit("DECIMAL("), "p_size", F.lit(",2)"))]
    types = _parts(spark, d).select("key", F.explode(F.array(*[F.lit(t) for t in TYPE_NAMES], *sized)).alias("source_type"))
    return ddl.mapped_types(types).drop("spark_type")


def sweep_matrix(spark, d):
    """Every run of a sweep over every database (order priorities), with the place of its results."""
    runs = sweep.sweep_frame(spark, MATRIX)
    paths = spark.createDataFrame([(i, sweep.result_path("results", "csv", r)) for i, r in enumerate(sweep.expand(MATRIX), 1)], "run_id long, path string")
    databases = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_orderpriority").alias("db_id")).agg(F.count("*").alias("questions"))
    each = databases.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(len(sweep.expand(MATRIX))).cast("long"))).alias("run_id"))
    return each.join(runs, "run_id").join(paths, "run_id").withColumn("path", F.concat_ws("/", "path", "db_id"))


QUERIES = {f.__name__: f for f in (lineage_tables, lineage_catalyst, dialect_rewrite, dialect_executed, ddl_parse, fk_numbering, type_map, sweep_matrix)}


def _lit(v) -> str:
    if v is None:
        return "NULL"
    return str(v) if isinstance(v, (bool, int, float)) else "'" + v.replace("'", "''") + "'"


def _values(rows: list[tuple], names: str) -> str:
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_lit, r)) + ')' for r in rows)}) v({names})"


def _renamed(c: str, names: list[str], key: str) -> str:
    for name in names:
        c = f"replace({c}, '{name}', '{name}_' || {key})"
    return c


ORACLES = {
    "lineage_tables": f"SELECT s_suppkey AS key, statement, {_renamed('table_name', TABLES, 's_suppkey')} AS table_name, {_renamed('column_name', TABLES, 's_suppkey')} AS column_name FROM supplier, ({_values([(k, t, c) for k, t, cs in LINEAGE for c in cs], 'statement, table_name, column_name')})",
    "lineage_catalyst": f"SELECT n_nationkey AS key, statement, {_renamed('table_name', TABLES, 'n_nationkey')} AS table_name FROM nation, ({_values([(k, t) for k, t, _ in LINEAGE], 'statement, table_name')})",
    "dialect_rewrite": f"SELECT p_partkey AS key, statement, 'SELECT ' || chr(39) || p_name || chr(39) || ' AS own, ' || {_renamed('rewritten', [' FROM t'], 'p_partkey')}[8:] AS rewritten FROM part, ({_values([(k, r) for k, _, r in SQLITE], 'statement, rewritten')})",
    "dialect_executed": "SELECT o_orderpriority AS priority, sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END)::DOUBLE AS large, count(*) AS n, max(strftime(o_orderdate, '%Y')) AS last_year, max(strftime(o_orderdate, '%j week %W of %Y')) AS last_day, max(trunc(o_totalprice / 1000)::BIGINT::VARCHAR) AS thousands, max(last_day(o_orderdate::DATE)) AS last_month FROM orders WHERE o_orderstatus GLOB '[FO]' GROUP BY 1",
    "ddl_parse": f"""SELECT p_partkey AS key, v.* REPLACE ({_renamed('table_name', NAMES, 'p_partkey')} AS table_name, {_renamed('column_name', NAMES, 'p_partkey')} AS column_name)
FROM part, ({_values(COLUMNS, 'table_name, pos, column_name, source_type, target_type, spark_type, is_primary, is_required, default_value')}) v WHERE p_size <= 25""",
    "fk_numbering": f"""SELECT p_partkey AS key, {_renamed('table_name', NAMES, 'p_partkey')} AS table_name, replace(replace(constraint_name, 'ATOM', 'ATOM_' || p_partkey), 'BOND', 'BOND_' || p_partkey) AS constraint_name,
{', '.join(f"{_renamed(c, NAMES, 'p_partkey')} AS {c}" for c in ('columns', 'target', 'target_columns'))}, on_delete FROM part, ({_values(KEYS, 'table_name, constraint_name, columns, target, target_columns, on_delete')}) WHERE p_size <= 25""",
    "type_map": f"""SELECT p_partkey AS key, source_type, target_type FROM part, ({_values(list(zip(TYPE_NAMES, TYPE_MAP, strict=True)), "source_type, target_type")})
UNION ALL SELECT p_partkey, 'VARCHAR(' || p_partkey || ')', CASE WHEN p_partkey > 4000 THEN 'CLOB' ELSE 'VARCHAR2(' || p_partkey || ')' END FROM part
UNION ALL SELECT p_partkey, 'DECIMAL(' || p_size || ',2)', 'NUMBER(' || p_size || ',2)' FROM part""",
    "sweep_matrix": """WITH m AS (SELECT * FROM (VALUES (1, 'unified'), (2, 'parallel')) v(i, mode)),
r AS (SELECT 0 AS j, 'vector' AS search_type, NULL AS scorer, NULL::DOUBLE AS vw, NULL::DOUBLE AS tw, NULL::DOUBLE AS vp, NULL::DOUBLE AS tp
UNION ALL SELECT n, 'hybrid', 'RSF', 10, n * 2, NULL, NULL FROM range(1, 6) x(n) UNION ALL SELECT 5 + n, 'hybrid', 'RRF', NULL, NULL, n, 5 FROM range(1, 5) x(n))
, runs AS (SELECT row_number() OVER (ORDER BY i, j) AS run_id, mode, search_type, 'single-user' AS dataset_form, scorer, vw AS vector_score_weight, tw AS text_score_weight, vp AS vector_rank_penalty,
  tp AS text_rank_penalty, 'results/csv/' || mode || CASE WHEN scorer IS NULL THEN '/vector' ELSE '/hybrid/' || scorer END || '/single-user/' || CASE WHEN scorer = 'RSF' THEN 'text_score_weight=' || tw::INT
  || '_vector_score_weight=' || vw::INT WHEN scorer = 'RRF' THEN 'text_rank_penalty=' || tp::INT || '_vector_rank_penalty=' || vp::INT ELSE 'default' END AS path FROM m, r),
db AS (SELECT o_orderpriority AS db_id, count(*) AS questions FROM orders GROUP BY 1)
SELECT runs.* REPLACE (path || '/' || db_id AS path), db_id, questions FROM runs, db""",
}

"""Reports over questions, unified corpora, statements for descriptions, searches within fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import corpus, ddl, evaluate, observed, ranking, search
from lodestone.operators.frozen import scratch
from lodestone.plans.retrieval import terms_sql
from lodestone.plans.texts import _first, _flat, _stop


def _table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _parts_of_suppliers(spark, d) -> DataFrame:
    """(l_orderkey, table, columns, score): each order's suppliers with their parts, an order standing for a question."""
    parts = F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("columns")
    rows = _table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_suppkey").cast("string").alias("table"))
    return rows.agg(parts, (F.max("l_quantity") / 50).alias("score"))


def question_stats(spark, d):
    tables = F.collect_list(F.struct(F.col("table").alias("name"), "columns")).alias("tables")
    return evaluate.question_stats(_parts_of_suppliers(spark, d).groupBy("l_orderkey").agg(tables))


def result_json(spark, d):
    rows = _parts_of_suppliers(spark, d).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("table", "score", "columns"))).alias("found"))
    expected, found = evaluate.result_json(F.filter("found", lambda x: x["score"] > 0.5), F.col("found"))
    return rows.select("l_orderkey", expected.alias("expected_json"), found.alias("found_json"))


def retrieval_report(spark, d):
    """Parts of an order in its lines' order, against those of which more than 25 are ordered; every seventh order has failed."""
    part = F.col("l_partkey").cast("string")
    each = _table(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("at"), F.max("l_quantity").alias("most"))
    lists = each.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("at", "l_partkey", part.alias("name")))).alias("r"), F.collect_list(F.when(F.col("most") > 25, part)).alias("expected"))
    rows = lists.select("expected", F.transform("r", lambda x: x["name"]).alias("found"), F.when(F.col("l_orderkey") % 7 == 0, "failed").alias("error"))
    return evaluate.retrieval_averages(evaluate.retrieval_metrics(rows))


def question_caps(spark, d):
    return ranking.capped(_table(spark, d, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", [F.asc("o_orderkey")], test=True)


def threshold_clamp(spark, d):
    given = F.when(F.col("value") < 80, F.col("value") / 50 - 0.5)
    return _table(spark, d, "events").select("event_id", ranking.threshold_or_default(given).alias("threshold"))


def unified_corpus(spark, d):
    p = _table(spark, d, "part")
    none = F.lit(None).cast("string")
    columns = p.select(
        F.col("p_brand").alias("owner"), F.col("p_type").alias("object_name"), F.col("p_name").alias("column_name"), F.lit("TABLE").alias("object_type"), F.col("p_size").cast("string").alias("data_type"),
        F.when(F.col("p_size") < 25, F.col("p_brand")).alias("comment_text"), F.when(F.col("p_size") % 2 == 1, F.col("p_name")).alias("annotation"),
    )
    tables = p.where("p_type <> 'PROMO'").select(F.col("p_type").alias("object_name"), F.lower("p_type").alias("comment_text"), none.alias("annotation")).distinct()
    return corpus.unified_corpus(columns, tables)


def object_texts(spark, d):
    """Objects of each customer's nation and segment, with comments and annotations from the nations, and customers of high numbers as columns."""
    c = _table(spark, d, "customer").where("c_custkey % 10 = 0")
    columns = c.select(
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("object_name"), F.lit("main").alias("owner"), F.lit("VIEW").alias("object_type"), F.col("c_custkey").alias("pos"), F.col("c_name").alias("column_name")
    )
    n = _table(spark, d, "nation").where("n_nationkey % 5 <> 4")
    tables = n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("object_name"), F.col("n_name").alias("comment_text"), F.when(F.col("n_regionkey") > 1, F.col("n_name")).alias("annotation"))
    return corpus.object_corpus(columns, tables).select("object_name", "column_summary", "search_text")


def per_database_run(spark, d):
    """Documents by language as databases, each with an index of its own; what was set up, asked and found, and that times were taken."""
    docs = _table(spark, d, "documents").select(F.col("lang").alias("db_id"), F.col("doc_id").alias("id"), "text")
    asked = _table(spark, d, "benchmark").where("item_id % 20 = 0").select("item_id", "text")
    questions = docs.select("db_id").distinct().select("db_id", F.lit(1).alias("_one")).join(asked.withColumn("_one", F.lit(1)), "_one").select("db_id", F.col("item_id").alias("query_id"), "text")
    _, times = observed.run_by_database(docs, questions, f"{scratch(spark)}/databases", 10)
    timed = (F.col("setup_ms") > 0) & (F.col("search_ms") > 0) & (F.abs(F.col("avg_execution_time_ms") * F.col("questions") - F.col("search_ms")) < 1e-3)
    return times.select("db_id", "documents", "questions", "hits", timed.alias("timed"))


def single_schema(spark, d):
    p = _table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("db"), F.repeat(F.concat("p_name", F.lit("_")), F.when(F.col("p_size") > 25, 12).otherwise(1)).alias("name"))
    rows = corpus.single_schema(p, "db", "name")
    return rows.select("p_partkey", "table_name", corpus.own_name(F.col("table_name"), F.col("db")).alias("own_name"))


def metadata_statements(spark, d):
    docs = _table(spark, d, "documents")
    rows = docs.select(F.col("source").alias("table_name"), F.concat(F.lit("c-"), F.col("doc_id").cast("string")).alias("column_name"), F.col("text").alias("description"), F.col("lang").alias("value_description"))
    return ddl.metadata_statements(rows)


#: Queries of the search within fields: a word counts in the field that is named only.
FIELD_QUERIES = [(1, "p_name", "a large widget"), (2, "p_type", "large economy"), (3, "p_brand", "large"), (4, "p_name", "cold large bolt rod")]


def field_search(spark, d):
    asked = spark.createDataFrame(FIELD_QUERIES, "query_id long, field string, text string")
    return search.within_fields(asked, _table(spark, d, "part"), "p_partkey", ["p_name", "p_brand", "p_type"])


def text_switch(spark, d):
    c = _table(spark, d, "conversations")
    return search.text_asked(c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("query_id"), "text", F.when(F.col("role") == "user", F.upper("text")).alias("text_contains")))


def keywords_tokens(spark, d):
    return _table(spark, d, "conversations").select("conv_id", "turn", T.keyword_query_tokens(F.col("text")).alias("keywords"))


QUERIES = {
    f.__name__: f
    for f in (question_stats, result_json, retrieval_report, question_caps, threshold_clamp, unified_corpus, single_schema, metadata_statements, field_search, text_switch, keywords_tokens, object_texts, per_database_run)
}

_suppliers = """s AS (SELECT l_orderkey, l_suppkey::VARCHAR AS t, list_sort(list(DISTINCT l_partkey::VARCHAR)) AS c, max(l_quantity) / 50 AS score FROM lineitem GROUP BY 1, 2)"""
_means = ", ".join(f"round(coalesce(avg(CASE WHEN ok THEN round({x}{k}, 6) END), 0), 6) AS {n}_at_{k}" for k in evaluate.REPORT_KS for x, n in (("p", "p"), ("r", "r"), ("f", "f1")))
_cuts = ", ".join(
    f"coalesce(h{k} / nullif(least(n, {k}), 0), 0) AS p{k}, coalesce(h{k} / nullif(e, 0), 0) AS r{k}, coalesce(2 * p{k} * r{k} / nullif(p{k} + r{k}, 0), 0) AS f{k}" for k in evaluate.REPORT_KS
)
_hits = ", ".join(f"count(*) FILTER (good AND rn <= {k}) AS h{k}" for k in evaluate.REPORT_KS)
_said = "CASE WHEN {x} <> '' AND lower({x}) NOT IN ('<comment>', 'comment', 'null', 'none', 'n/a') THEN CASE WHEN length({x}) > 3900 THEN {x}[1:3900] || '...' ELSE {x} END END"
_field = " UNION ALL ".join(f"SELECT p_partkey AS id, '{f}' AS field, unnest({terms_sql(f)}) AS term FROM part" for f in ("p_name", "p_brand", "p_type"))
_asked = ", ".join(f"({i}::BIGINT, '{f}', '{t}')" for i, f, t in FIELD_QUERIES)
_bare = r"regexp_replace(lower(text), 'n''t\b|''(s|re|ve|ll|d|m)\b', ' ', 'g')"
_english = ", ".join(f"'{w}'" for w in T.ENGLISH_STOPWORDS)
_tokens = rf"list_filter(regexp_split_to_array({_bare}, '[^\p{{L}}\p{{N}}_''-]+'), lambda w: regexp_full_match(w, '\p{{L}}+') AND NOT list_contains([{_english}], w) AND NOT regexp_matches(w, '{'|'.join(T.KEYWORD_TABOO)}'))"

ORACLES = {
    "question_stats": f"""WITH {_suppliers}, q AS (SELECT count(*) AS t, sum(len(c)) AS c FROM s GROUP BY l_orderkey)
SELECT count(*) AS questions, sum(t)::BIGINT AS "tables", sum(c)::BIGINT AS "columns", round(sum(t) / count(*), 2) AS tables_each, round(sum(c) / count(*), 2) AS columns_each FROM q""",
    "result_json": f"""WITH {_suppliers}, r AS (SELECT l_orderkey, list({{'table': t, 'score': score, 'columns': c}} ORDER BY t) AS f FROM s GROUP BY 1)
SELECT l_orderkey, to_json(list_transform(list_filter(f, lambda x: x.score > 0.5), lambda x: {{'table': x.table, 'columns': x.columns}}))::VARCHAR AS expected_json,
to_json(list_transform(f, lambda x: {{'table': x.table, 'score': round(x.score, 4), 'columns': x.columns}}))::VARCHAR AS found_json FROM r""",
    "retrieval_report": f"""WITH f AS (SELECT l_orderkey, max(l_quantity) > 25 AS good, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_partkey) AS rn FROM lineitem GROUP BY l_orderkey, l_partkey),
h AS (SELECT l_orderkey % 7 <> 0 AS ok, count(*) AS n, count(*) FILTER (good) AS e, {_hits} FROM f GROUP BY l_orderkey), m AS (SELECT ok, {_cuts} FROM h)
SELECT count(*) AS questions, count(*) FILTER (NOT ok) AS failures, {_means} FROM m""",
    "question_caps": """SELECT o_orderpriority, o_orderkey FROM orders WHERE o_orderpriority IN (SELECT DISTINCT o_orderpriority FROM orders ORDER BY 1 LIMIT 2)
QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 5""",
    "threshold_clamp": "SELECT event_id, greatest(0, least(1, coalesce(CASE WHEN value < 80 THEN value / 50 - 0.5 END, 0.5)))::DOUBLE AS threshold FROM events",
    "unified_corpus": """WITH t AS (SELECT DISTINCT p_type AS object_name, lower(p_type) AS table_comment FROM part WHERE p_type <> 'PROMO'),
c AS (SELECT p_brand AS owner, p_type AS table_name, p_name AS column_name, 'TABLE' AS object_type, p_size::VARCHAR AS data_type, CASE WHEN p_size < 25 THEN p_brand END AS column_comment,
CASE WHEN p_size % 2 = 1 THEN p_name END AS column_annotation, table_comment, NULL::VARCHAR AS table_annotation FROM part LEFT JOIN t ON p_type = object_name WHERE p_name IS NOT NULL)
SELECT *, concat_ws(' ', owner, table_name, column_name, object_type, data_type, column_comment, column_annotation, table_comment, table_annotation) AS search_text FROM c""",
    "single_schema": """WITH p AS (SELECT p_partkey, p_brand, p_brand || '_' || repeat(p_name || '_', CASE WHEN p_size > 25 THEN 12 ELSE 1 END) AS n FROM part),
t AS (SELECT p_partkey, p_brand, upper(CASE WHEN length(n) <= 100 THEN n ELSE n[1:93] || '_' || sha1(n)[1:6] END) AS table_name FROM p)
SELECT p_partkey, table_name, table_name[length(p_brand) + 2:] AS own_name FROM t""",
    "metadata_statements": f"""WITH d AS (SELECT source AS table_name, 'c-' || doc_id AS column_name, upper(source) AS s, doc_id, {_flat.format('text')} AS x, {_flat.format('lang')} AS y FROM documents),
q AS (SELECT *, CASE WHEN regexp_full_match(s, '[A-Za-z][A-Za-z0-9_$#]*') THEN s ELSE '"' || replace(s, '"', '""') || '"' END AS t, '"C-' || doc_id || '"' AS c FROM d),
u AS (SELECT table_name, column_name, 'comment' AS kind, 'COMMENT ON COLUMN ' || t || '.' || c || ' IS ''' || replace({_said.format(x='x')}, '''', '''''') || ''';' AS statement FROM q
UNION ALL SELECT table_name, column_name, 'annotation', 'ALTER TABLE ' || t || ' MODIFY (' || c || ' ANNOTATIONS (ADD value_description ''' || replace({_said.format(x='y')}, '''', '''''') || '''));' FROM q)
SELECT * FROM u WHERE statement IS NOT NULL""",
    "field_search": f"""WITH q AS (SELECT query_id, field, text FROM (VALUES {_asked}) v(query_id, field, text)), a AS (SELECT DISTINCT query_id, field, unnest({terms_sql('text')}) AS term FROM q),
h AS (SELECT DISTINCT * FROM ({_field})) SELECT query_id, id, count(*)::DOUBLE AS score FROM a JOIN h USING (field, term) GROUP BY query_id, id""",
    "text_switch": "SELECT conv_id * 100000 + turn AS query_id, text FROM conversations WHERE role = 'user' AND text IS NOT NULL",
    "keywords_tokens": f"WITH w AS (SELECT conv_id, turn, {_tokens} AS w FROM conversations), u AS (SELECT conv_id, turn, {_first.format(x='w')} AS w FROM w) SELECT conv_id, turn, nullif(upper(replace(array_to_string(w, ' OR '), 'ß', 'ss')), '') AS keywords FROM u",
}
ORACLES["object_texts"] = """WITH c AS (SELECT 'N' || c_nationkey AS object_name, string_agg(c_name, ' ' ORDER BY c_custkey) AS column_summary FROM customer WHERE c_custkey % 10 = 0 GROUP BY 1),
t AS (SELECT 'N' || n_nationkey AS object_name, n_name AS c, CASE WHEN n_regionkey > 1 THEN n_name END AS a FROM nation WHERE n_nationkey % 5 <> 4)
SELECT object_name, column_summary, concat_ws(' ', object_name, 'main', 'VIEW', c, a, column_summary) AS search_text FROM c LEFT JOIN t USING (object_name)"""
ORACLES["per_database_run"] = f"""WITH asked AS (SELECT DISTINCT item_id AS query_id, unnest({terms_sql('text')}) AS term FROM benchmark WHERE item_id % 20 = 0),
has AS (SELECT DISTINCT lang, doc_id, unnest({terms_sql('text')}) AS term FROM documents),
h AS (SELECT lang, query_id, least(10, count(DISTINCT doc_id)) AS n FROM has JOIN asked USING (term) GROUP BY lang, query_id),
s AS (SELECT lang, sum(n)::BIGINT AS hits FROM h GROUP BY lang)
SELECT lang AS db_id, count(*) AS documents, (SELECT count(*) FROM benchmark WHERE item_id % 20 = 0) AS questions, coalesce(any_value(hits), 0) AS hits, true AS timed
FROM documents LEFT JOIN s USING (lang) WHERE lang IS NOT NULL GROUP BY lang"""

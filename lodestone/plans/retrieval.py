"""Search, fusion, discovery and evaluation over the embeddings, documents and benchmark tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import ann, discover, evaluate, inverted, search, sweep, versions
from lodestone.operators.frozen import frozen, scratch
from lodestone.operators.ranking import top_n

#: Searches ask with every row whose id is divisible by this, against all rows.
EVERY = 20


def _table(spark, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _vectors(spark, d):
    e = _table(spark, d, "embeddings")
    corpus = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    return corpus, corpus.where(F.col("id") % EVERY == 0).select(F.col("id").alias("query_id"), "vector")


def _hits(spark, d, top, metric="cosine", group=None):
    corpus, queries = _vectors(spark, d)
    return search.vector_search(queries, corpus, top, metric, group)


def _labelled(spark, d, hits):
    return hits.join(_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label"), "id")


def _objects(spark, d):
    """(query_id, label, score): cosine of each query with each label's centroid."""
    corpus, queries = _vectors(spark, d)
    means = search.centroids(corpus, "label", "vector").select(F.col("label").alias("id"), "vector")
    return search.vector_search(queries, means, 1 << 30, skip_self=False).select("query_id", F.col("id").cast("int").alias("label"), "score")


def discover_unified(spark, d):
    hits = _labelled(spark, d, _hits(spark, d, 100))
    out = discover.unified(hits, "label", k=5, m=100, cols_per_obj=3, threshold=0.3)
    return out.select("query_id", "rank", "label", "score", F.array_join("columns", ",").alias("columns"))


def discover_sequential(spark, d):
    hits = _hits(spark, d, 60, group="label")
    out = discover.sequential(_objects(spark, d), hits, "label", k=4, k0=5, n=60, cols_per_obj=3, threshold=0.05)
    return out.select("query_id", "rank", "label", "score", F.array_join("columns", ",").alias("columns"))


def discover_parallel(spark, d):
    hits = _labelled(spark, d, _hits(spark, d, 40))
    out = discover.parallel(_objects(spark, d), hits, "label", k=3, m=40, cols_per_obj=3)
    return out.select("query_id", "rank", "label", "score", F.array_join("columns", ",").alias("columns"))


def vector_topk(spark, d):
    return _hits(spark, d, 10)


def vector_topk_dot(spark, d):
    return _hits(spark, d, 10, "dot")


def vector_topk_l2(spark, d):
    return _hits(spark, d, 10, "l2")


def filtered_search(spark, d):
    good = _table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    corpus, queries = _vectors(spark, d)
    return search.vector_search(queries, corpus.join(good, "id", "left_semi"), 10)


def _asked(spark, d):
    return _table(spark, d, "benchmark").where(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query_id"), "text")


def keyword_score(spark, d):
    found = search.keyword_overlap(_asked(spark, d), _table(spark, d, "documents"))
    return top_n(found, ["query_id"], [F.desc("score"), F.asc("id")], 50).select("query_id", "id", "score", "rank")


def keyword_bm25(spark, d):
    found = search.bm25(_asked(spark, d), _table(spark, d, "documents"))
    return top_n(found, ["query_id"], [F.desc("score"), F.asc("id")], 50).select("query_id", "id", "score")


def _fused(scorer, fusion):
    def query(spark, d):
        corpus, _ = _vectors(spark, d)
        asked = _asked(spark, d).select("query_id").join(corpus.select(F.col("id").alias("query_id"), "vector"), "query_id")
        vector = search.vector_search(asked, corpus, 50)
        return search.fuse(vector, keyword_score(spark, d).drop("rank"), scorer, fusion)

    return query


def _chunk_rows(spark, d):
    words = F.split(T.collapse(F.col("text")), " ")
    share = lambda c: F.size(F.filter(c, lambda w: F.length(w) >= 8)) / F.size(c)
    shares = F.transform(T.chunks(words), share)
    return _table(spark, d, "documents").where("trim(text) <> ''").select("doc_id", F.posexplode(shares).alias("chunk", "share"))


def chunk_aggregate_max(spark, d):
    return search.chunk_scores(_chunk_rows(spark, d), "doc_id", "share", "MAX")


def chunk_aggregate_avg(spark, d):
    return search.chunk_scores(_chunk_rows(spark, d), "doc_id", "share", "AVG")


def _measured(spark, d):
    """question_id, db_id and the metrics of the 20 nearest vectors, where those with the question's label are expected.

    Whether a found vector is expected is whether its label is the question's: nothing lists what a label has.
    """
    e = _table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    sizes = e.groupBy("label").agg((F.count("*") - 1).alias("n_expected"))
    asked = e.where(F.col("id") % EVERY == 0).join(sizes, "label").select(F.col("id").alias("question_id"), F.concat(F.lit("DB"), "label").alias("db_id"), "n_expected", "label")
    hits = top_n(_hits(spark, d, 20), ["query_id"], [F.desc("score"), F.asc("id")], 20).select(F.col("query_id").alias("question_id"), "rank", "id")
    named = hits.join(e, "id").join(asked.select("question_id", F.col("label").alias("_asked")), "question_id")
    found = named.select("question_id", "rank", F.col("id").cast("string").alias("name"), (F.col("label") == F.col("_asked")).alias("hit"))
    return evaluate.counted_metrics(asked.drop("label"), found)


def _metrics(*names):
    def query(spark, d):
        return _measured(spark, d).select("question_id", *names)

    return query


SUMMARY_METRICS = ["precision", "recall", "f1", "mrr", "jaccard", "hit_at_1", "recall_at_10", "f1_at_5"]


def summary_by_db(spark, d):
    rows = _measured(spark, d)
    failed = F.when(F.col("mrr") == 0, F.lit("nothing found"))
    return evaluate.summary(rows.withColumn("error", failed), "db_id", SUMMARY_METRICS)


def overall_weighted(spark, d):
    return evaluate.overall(summary_by_db(spark, d), SUMMARY_METRICS)


RUNS = {1: sweep.resolved({"mode": "unified", "k": 5, "m": 100, "score_threshold": 0.3}), 2: sweep.resolved({"mode": "parallel", "k": 3, "m": 40})}
RUN_METRICS = ["precision", "recall", "f1", "mrr", "hit_at_1", "hit_at_3", "recall_at_3"]


def _runs(spark, d):
    asked = _table(spark, d, "embeddings").where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query_id"), "label")
    questions = asked.select("query_id", F.concat(F.lit("DB"), "label").alias("db_id"), F.array(F.col("label").cast("string")).alias("expected"))
    objects = search.both_lists(_objects(spark, d).withColumnRenamed("label", "id"))
    return sweep.evaluated(RUNS, questions, _labelled(spark, d, search.both_lists(_hits(spark, d, 100))), "label", objects)


def evaluation_run(spark, d):
    """Questions x runs: every question's metrics under the settings of each run."""
    return _runs(spark, d).select("run_id", "mode", F.col("query_id").alias("question_id"), *RUN_METRICS)


def evaluation_summary(spark, d):
    """Averages of each run."""
    means = [F.round(F.avg(F.col(m).cast("double")), 6).alias(f"avg_{m}") for m in RUN_METRICS]
    return _runs(spark, d).groupBy("run_id", "mode").agg(F.count("*").alias("questions"), *means)


#: The sweep of two modes over vector search, weights of RSF and penalties of RRF.
SWEEP = {
    "modes": ["unified", "parallel"], "search_types": ["vector", "hybrid"], "hybrid_scorers": ["RSF", "RRF"], "common": {"discover_k": 4, "m": 40, "discover_score_threshold": 0.6},
    "scorer_overrides": {
        "RSF": [{"vector_score_weight": v, "text_score_weight": t} for v, t in [(2, 10), (4, 10), (6, 10), (8, 10), *((10, t) for t in (2, 4, 6, 8, 10))]],
        "RRF": [{"vector_rank_penalty": v, "text_rank_penalty": t} for v, t in [*((5, t) for t in (1, 2, 3, 4, 5)), *((v, 5) for v in (1, 2, 3, 4))]],
    },
}


def sweep_runs(spark, d, matrix=None):
    """Every run of a sweep over every question: both searches once, fused, rolled up and scored for all runs in one plan."""
    runs = dict(enumerate(sweep.expand(matrix or SWEEP), 1))
    corpus, _ = _vectors(spark, d)
    asked = _asked(spark, d).select("query_id").join(corpus.select(F.col("id").alias("query_id"), "vector", "label"), "query_id")
    keyword = frozen(search.keyword_overlap(_asked(spark, d), _table(spark, d, "documents")))
    best = lambda hits: top_n(hits, ["query_id"], [F.desc("score"), F.asc("id")], 50).drop("rank")
    vector = search.vector_search(asked.select("query_id", "vector"), corpus, 50)
    hits = frozen(_labelled(spark, d, search.both_lists(vector, best(keyword))))
    means = search.centroids(corpus, "label", "vector").select(F.col("label").alias("id"), "vector")
    by_vector = search.vector_search(asked.select("query_id", "vector"), means, 1 << 30, skip_self=False)
    by_words = _labelled(spark, d, keyword).groupBy("query_id", F.col("label").cast("long").alias("id")).agg(F.max("score").alias("score"))
    objects = frozen(search.both_lists(by_vector, by_words).withColumn("id", F.col("id").cast("int")))
    questions = asked.select("query_id", F.array(F.col("label").cast("string")).alias("expected"))
    return sweep.evaluated(runs, questions, hits, "label", objects).select("run_id", "mode", "search_type", "scorer", F.col("query_id").alias("question_id"), *RUN_METRICS)


def _keyword_index(spark, d):
    """A keyword index over all documents in the shared folder."""
    path = f"{scratch(spark)}/keywords-{uuid.uuid4().hex}"
    inverted.build(_table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), path)
    return path


def _found(spark, path, hits):
    """The hits, apart from the index, which is dropped."""
    out = frozen(hits)
    versions.drop(spark, path)
    return out


def indexed_bm25(spark, d):
    """The best 50 documents of each question by BM25, from a stored index."""
    path = _keyword_index(spark, d)
    return _found(spark, path, inverted.search(_asked(spark, d), path, 50).drop("rank"))


def indexed_overlap(spark, d):
    """The best 50 documents of each question by the number of its terms, from a stored index."""
    path = _keyword_index(spark, d)
    return _found(spark, path, inverted.search(_asked(spark, d), path, 50, "overlap"))


def index_refresh(spark, d):
    """BM25 after a tenth of the documents has been replaced, a tenth deleted, and the index compacted."""
    path = _keyword_index(spark, d)
    docs = _table(spark, d, "documents")
    inverted.refresh(docs.where("doc_id % 10 = 3").select(F.col("doc_id").alias("id"), F.concat_ws(" ", "text", F.lit("replaced"), "text").alias("text")), path)
    inverted.delete(docs.where("doc_id % 10 = 7").select(F.col("doc_id").alias("id")), path)
    inverted.compact(spark, path)
    return _found(spark, path, inverted.search(_asked(spark, d), path, 50).drop("rank"))


def _vector_index(spark, corpus, metric="cosine"):
    path = f"{scratch(spark)}/vectors-{uuid.uuid4().hex}"
    ann.build(corpus.select("id", "vector"), path, metric)
    return path


def ann_search(spark, d):
    """Ten nearest vectors by the index of cells and codes, built afresh in the shared folder."""
    corpus, queries = _vectors(spark, d)
    path = _vector_index(spark, corpus)
    return _found(spark, path, ann.search(queries, path, 10, scan=0.8, rescore=50))


#: What an approximate search must find of the exact results.
LEAST_RECALL = 0.9


def _judged(found, exact, **names):
    """One row: the names, the number of exact results, and whether enough of them were found."""
    row = ann.recall(found, exact).select(F.col("wanted").alias("wanted"), (F.col("recall") >= LEAST_RECALL).alias("enough"))
    return row.select(*[F.lit(v).alias(k) for k, v in names.items()], "wanted", "enough")


def ann_recall(spark, d):
    """Approximate against exact search for each metric, after a tenth of the rows was refreshed as it is; rows that were looked at stay below a share."""
    corpus, queries = _vectors(spark, d)
    out = []
    for metric in ann.METRICS:
        path = _vector_index(spark, corpus, metric)
        ann.refresh(corpus.where("id % 10 = 3"), path)
        found = _found(spark, path, ann.search(queries, path, 10, scan=0.8, rescore=50, metric=metric))
        out.append(_judged(found, search.vector_search(queries, corpus, 10, metric), metric=metric))
    return reduce(lambda a, b: a.union(b), out)


def filtered_ann(spark, d):
    """Approximate search among the rows that a filter leaves: about a hundredth, a tenth and half of all."""
    corpus, queries = _vectors(spark, d)
    path, out = _vector_index(spark, corpus), []
    for part in (100, 10, 2):
        good = corpus.where(F.col("id") % part == 0).select("id")
        found = frozen(ann.search(queries, path, 10, scan=0.8, rescore=50, only=good))
        out.append(_judged(found, search.vector_search(queries, corpus.join(good, "id", "left_semi"), 10), one_in=part))
    versions.drop(spark, path)
    return reduce(lambda a, b: a.union(b), out)


def _order_sets(spark, d):
    """For each order: its parts by brand as expected tables and columns; what was found are parts bought at a discount."""
    lines = _table(spark, d, "lineitem").join(_table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    # An order's lines are dealt to one place once: brands, orders and the join with orders need no shuffle of their own.
    lines = lines.select("l_orderkey", "p_brand", "l_partkey", "l_discount", "l_tax").repartition("l_orderkey")
    one = lines.groupBy("l_orderkey", "p_brand").agg(
        F.array_sort(F.collect_set(F.col("l_partkey").cast("string"))).alias("e"),
        F.array_sort(F.collect_set(F.when(F.col("l_discount") > 0.04, (F.col("l_partkey") + F.when(F.col("l_tax") > 0.06, 1).otherwise(0)).cast("string")))).alias("f"),
    )
    pair = lambda c: F.struct(F.col("p_brand").alias("table"), F.col(c).alias("columns"))
    found = F.when(F.size("f") > 0, pair("f"))
    return one.groupBy(F.col("l_orderkey").alias("question_id")).agg(F.array_sort(F.collect_list(pair("e"))).alias("expected"), F.array_sort(F.collect_list(found)).alias("found"))


def _results(spark, d):
    """Orders as questions: brands and parts are tables and columns, prices stand for times, orders in progress for failures."""
    orders = _table(spark, d, "orders").select(
        F.col("o_orderkey").alias("question_id"), F.col("o_orderpriority").alias("db_id"), F.concat(F.lit("order "), "o_orderkey").alias("question"),
        F.col("o_totalprice").alias("execution_time_ms"), F.when(F.col("o_orderstatus") == "P", "in progress").alias("error"),
    )
    return evaluate.result_rows(_order_sets(spark, d).join(orders, "question_id"))


def result_fields(spark, d):
    """The fields of a result file; lists as it writes them."""
    rows = _results(spark, d)
    return rows.select(*[F.array_join(c, "|").alias(c) if kind.startswith("array") else F.col(c) for c, kind in rows.dtypes])


def summary_fields(spark, d):
    """The fields of a summary file."""
    return evaluate.summary_rows(_results(spark, d))


def _column_metrics(*names):
    def query(spark, d):
        return evaluate.column_metrics(_order_sets(spark, d)).select("question_id", *names)

    return query


JOINT = ["joint_precision", "joint_recall", "joint_f1"]
MACRO = ["column_precision", "column_recall", "column_f1", "column_precision_at_1", "column_recall_at_3", "column_f1_at_5"]
TABLE = ["precision", "recall", "f1", "hit_at_1", "hit_at_3", "hit_at_5", "top_n_accuracy"]
AT_K = ["recall_at_3", "recall_at_5", "recall_at_10", "recall_at_15", "precision_at_1", "precision_at_5", "f1_at_3", "prefix_recall_at_5", "f1_at_k"]

QUERIES = {
    "discover_unified": discover_unified,
    "discover_sequential": discover_sequential,
    "discover_parallel": discover_parallel,
    "vector_topk": vector_topk,
    "vector_topk_dot": vector_topk_dot,
    "vector_topk_l2": vector_topk_l2,
    "filtered_search": filtered_search,
    "keyword_score": keyword_score,
    "keyword_bm25": keyword_bm25,
    **{f"fuse_rsf_{f.lower()}": _fused("RSF", f) for f in ("UNION", "INTERSECT", "RERANK")},
    "fuse_rrf": _fused("RRF", "UNION"),
    "fuse_wrrf": _fused("WRRF", "UNION"),
    "chunk_aggregate_max": chunk_aggregate_max,
    "chunk_aggregate_avg": chunk_aggregate_avg,
    "metrics_table": _metrics(*TABLE),
    "metrics_at_k": _metrics(*AT_K),
    "metrics_mrr": _metrics("mrr"),
    "metrics_jaccard": _metrics("jaccard"),
    "metrics_exact": _metrics("exact_match"),
    "metrics_joint": _column_metrics(*JOINT),
    "metrics_topn": _column_metrics("column_top_n_accuracy"),
    "metrics_column_macro": _column_metrics(*MACRO),
    "result_fields": result_fields,
    "summary_fields": summary_fields,
    "summary_by_db": summary_by_db,
    "overall_weighted": overall_weighted,
    "evaluation_run": evaluation_run,
    "evaluation_summary": evaluation_summary,
    "sweep_runs": sweep_runs,
    "indexed_bm25": indexed_bm25,
    "indexed_overlap": indexed_overlap,
    "index_refresh": index_refresh,
    "ann_search": ann_search,
    "ann_recall": ann_recall,
    "filtered_ann": filtered_ann,
}

# ---- the same in DuckDB SQL ----

SIM = """q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0),
sim AS (SELECT query_id, e.vec_id AS id, e.label, round(list_cosine_similarity(qv, e.embedding::DOUBLE[]), 6) AS score FROM q JOIN embeddings e ON e.vec_id <> q.query_id)"""
CENTROID = """x AS (SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding)::DOUBLE AS v FROM embeddings),
m AS (SELECT label, pos, avg(v) AS v FROM x GROUP BY label, pos),
cent AS (SELECT label, list(v ORDER BY pos) AS cv FROM m GROUP BY label),
obj AS (SELECT query_id, label, round(list_cosine_similarity(qv, cv), 6) AS score FROM q, cent)"""


def _norm(c: str) -> str:
    w = "OVER (PARTITION BY query_id)"
    return f"CASE WHEN max({c}) {w} = min({c}) {w} THEN 1.0::DOUBLE ELSE ({c} - min({c}) {w}) / (max({c}) {w} - min({c}) {w}) END"


def _top(metric: str, score: str) -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT query_id, e.vec_id AS id, round({score}, 6) AS score FROM q JOIN embeddings e ON e.vec_id <> q.query_id)
SELECT query_id, id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10"""


STOP = ", ".join(f"'{w}'" for w in T.QUESTION_STOPWORDS + T.INDEX_STOPWORDS)


def terms_sql(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '' AND NOT list_contains([{STOP}], w) AND NOT regexp_matches(w, '^[0-9]+$'))"


KEYWORD = f"""asked AS (SELECT DISTINCT item_id AS query_id, unnest({terms_sql('text')}) AS term FROM benchmark WHERE item_id % 20 = 0),
has AS (SELECT DISTINCT doc_id AS id, unnest({terms_sql('text')}) AS term FROM documents),
ks AS (SELECT query_id, id, count(*)::DOUBLE AS score FROM asked JOIN has USING (term) GROUP BY query_id, id),
kt AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM ks QUALIFY rank <= 50)"""


def _fuse_sql(scorer: str, fusion: str) -> str:
    join = {"UNION": "FULL", "INTERSECT": "INNER", "RERANK": "LEFT"}[fusion]
    if fusion == "RERANK":
        score = "coalesce(v, 0)"
    elif scorer == "RSF":
        score = "(1.0::DOUBLE * coalesce(v, 0) + 10.0::DOUBLE * coalesce(k, 0)) / 11.0::DOUBLE"
    else:
        a, b = (1, 10) if scorer == "WRRF" else (1, 1)
        score = f"coalesce({a}::DOUBLE / (5 + vr), 0) + coalesce({b}::DOUBLE / (1 + kr), 0)"
    return f"""WITH {KEYWORD},
q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark WHERE item_id % 20 = 0)),
sim AS (SELECT query_id, e.vec_id AS id, round(list_cosine_similarity(qv, e.embedding::DOUBLE[]), 6) AS score FROM q JOIN embeddings e ON e.vec_id <> q.query_id),
vt AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS vr FROM sim QUALIFY vr <= 50),
vn AS (SELECT query_id, id, vr, {_norm('score')} AS v FROM vt),
kn AS (SELECT query_id, id, rank AS kr, {_norm('score')} AS k FROM kt)
SELECT query_id, id, round({score}, 6) AS score FROM kn {join} JOIN vn USING (query_id, id)"""


CHUNKS = r"""w AS (SELECT doc_id, regexp_split_to_array(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ') AS w FROM documents WHERE trim(text) <> ''),
c AS (SELECT doc_id, unnest(list_transform(range(0, greatest(len(w) - 10, 1), 90), lambda i: w[i + 1:i + 100])) AS words FROM w),
s AS (SELECT doc_id, len(list_filter(words, lambda x: length(x) >= 8)) / len(words)::DOUBLE AS share FROM c)"""

QUESTIONS = f"""{SIM},
top AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM sim QUALIFY rn <= 20),
f AS (SELECT query_id, list(id::VARCHAR ORDER BY rn) AS found FROM top GROUP BY query_id),
ex AS (SELECT a.vec_id AS query_id, list(b.vec_id::VARCHAR) AS expected FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 GROUP BY 1),
qs AS (SELECT e.vec_id AS question_id, 'DB' || e.label AS db_id, coalesce(expected, []) AS e, coalesce(found, []) AS f FROM embeddings e LEFT JOIN f ON f.query_id = e.vec_id LEFT JOIN ex ON ex.query_id = e.vec_id WHERE e.vec_id % 20 = 0)"""


def _prf(k: str | None = None) -> tuple[str, str, str]:
    f = f"f[1:{k}]" if k else "f"
    n = f"len(list_intersect(e, {f}))"
    p = f"(CASE WHEN len(list_distinct({f})) = 0 THEN 0 ELSE {n} / len(list_distinct({f}))::DOUBLE END)"
    r = f"(CASE WHEN len(list_distinct(e)) = 0 THEN 0 ELSE {n} / len(list_distinct(e))::DOUBLE END)"
    return p, r, f"(CASE WHEN {p} + {r} = 0 THEN 0 ELSE 2 * {p} * {r} / ({p} + {r}) END)"


def _recall(k: int) -> str:
    return f"(CASE WHEN len(e) = 0 THEN 1 ELSE len(list_intersect(e, f[1:{k}])) / len(list_distinct(e))::DOUBLE END)"


METRIC_SQL = {"precision": _prf()[0], "recall": _prf()[1], "f1": _prf()[2]}
METRIC_SQL |= {f"hit_at_{k}": f"len(list_intersect(e, f[1:{k}])) > 0" for k in (1, 3, 5)} | {f"recall_at_{k}": _recall(k) for k in (3, 5, 10, 15)}
for _k, _n in (("1", "1"), ("3", "3"), ("5", "5"), ("k", "10")):
    METRIC_SQL |= {f"precision_at_{_k}": _prf(_n)[0], f"prefix_recall_at_{_k}": _prf(_n)[1], f"f1_at_{_k}": _prf(_n)[2]}
METRIC_SQL |= {
    "mrr": "coalesce(1.0::DOUBLE / list_min(list_filter(list_transform(f, lambda x, i: CASE WHEN list_contains(e, x) THEN i END), lambda i: i IS NOT NULL)), 0)",
    "jaccard": "(CASE WHEN len(list_distinct(list_concat(e, f))) = 0 THEN 1 ELSE len(list_intersect(e, f)) / len(list_distinct(list_concat(e, f)))::DOUBLE END)",
    "exact_match": "list_sort(list_distinct(e)) = list_sort(list_distinct(f))",
    "top_n_accuracy": "(CASE WHEN len(list_distinct(e)) = 0 THEN 0 ELSE len(list_intersect(e, f[1:len(list_distinct(e))])) / len(list_distinct(e))::DOUBLE END)",
}


def _metric_sql(*names: str) -> str:
    cols = ", ".join(f"{METRIC_SQL[n]} AS {n}" if n == "exact_match" or n.startswith("hit") else f"round({METRIC_SQL[n]}, 6)::DOUBLE AS {n}" for n in names)
    return f"WITH {QUESTIONS} SELECT question_id, {cols} FROM qs"


_rows = ", ".join(f"{METRIC_SQL[m]} AS {m}" if m.startswith("hit") else f"round({METRIC_SQL[m]}, 6)::DOUBLE AS {m}" for m in SUMMARY_METRICS)
_avg = ", ".join(f"round(avg({m}::INT::DOUBLE) FILTER (error IS NULL), 6) AS avg_{m}" if m.startswith("hit") else f"round(avg({m}) FILTER (error IS NULL), 6) AS avg_{m}" for m in SUMMARY_METRICS)
SUMMARY = f"""{QUESTIONS}, r AS (SELECT *, CASE WHEN mrr = 0 THEN 'nothing found' END AS error FROM (SELECT db_id, {_rows} FROM qs)),
sm AS (SELECT lower(db_id) AS db_id, count(*) AS questions, count(*) FILTER (error IS NULL) AS successful, count(*) FILTER (error IS NOT NULL) AS failed, {_avg} FROM r GROUP BY lower(db_id))"""
_over = ", ".join(f"round(sum(avg_{m} * successful) / nullif(sum(successful) FILTER (avg_{m} IS NOT NULL), 0), 6) AS overall_{m}" for m in SUMMARY_METRICS)

ORDER_SETS = """lines AS (SELECT l_orderkey AS question_id, p_brand AS t, l_partkey, l_discount, l_tax FROM lineitem JOIN part ON p_partkey = l_partkey),
one AS (SELECT question_id, lower(t) AS t, list_sort(list_distinct(list(l_partkey::VARCHAR))) AS e,
  list_sort(list_distinct(coalesce(list((l_partkey + CASE WHEN l_tax > 0.06::DOUBLE THEN 1 ELSE 0 END)::VARCHAR) FILTER (l_discount > 0.04::DOUBLE), []))) AS f FROM lines GROUP BY question_id, t)"""
_R = {n: (_prf(k)[0], _prf(k)[1]) for n, k in (("", None), ("_at_1", "1"), ("_at_3", "3"), ("_at_5", "5"))}


def _f1(p: str, r: str) -> str:
    return f"round(CASE WHEN {p} + {r} = 0 THEN 0 ELSE 2 * {p} * {r} / ({p} + {r}) END, 6)::DOUBLE"


JOINT_SQL = f"""WITH {ORDER_SETS}, s AS (SELECT question_id, sum(len(list_intersect(e, f)))::DOUBLE AS h, sum(len(e)) AS e, sum(len(f)) AS f FROM one GROUP BY question_id),
pr AS (SELECT question_id, CASE WHEN f = 0 THEN 0 ELSE h / f END AS p, CASE WHEN e = 0 THEN 0 ELSE h / e END AS r FROM s)
SELECT question_id, round(p, 6)::DOUBLE AS joint_precision, round(r, 6)::DOUBLE AS joint_recall, {_f1('p', 'r')} AS joint_f1 FROM pr"""
TOPN_SQL = f"""WITH {ORDER_SETS} SELECT question_id, round(avg({METRIC_SQL['top_n_accuracy']}), 6)::DOUBLE AS column_top_n_accuracy FROM one GROUP BY question_id"""
_means = ", ".join(f"avg({p}) AS p{n}, avg({r}) AS r{n}" for n, (p, r) in _R.items())
MACRO_SQL = f"""WITH {ORDER_SETS}, a AS (SELECT question_id, {_means} FROM one GROUP BY question_id)
SELECT question_id, round(p, 6)::DOUBLE AS column_precision, round(r, 6)::DOUBLE AS column_recall, {_f1('p', 'r')} AS column_f1, round(p_at_1, 6)::DOUBLE AS column_precision_at_1,
round(r_at_3, 6)::DOUBLE AS column_recall_at_3, {_f1('p_at_5', 'r_at_5')} AS column_f1_at_5 FROM a"""

ORACLES = {
    "discover_unified": f"""WITH {SIM},
hit AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM sim QUALIFY rn <= 100),
nm AS (SELECT *, {_norm('score')} AS norm FROM hit),
kept AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY norm DESC, rn, id) AS nth FROM nm WHERE norm >= 0.3::DOUBLE QUALIFY nth <= 3),
s AS (SELECT query_id, label, round(avg(norm), 6) AS score, string_agg(id::VARCHAR, ',' ORDER BY nth) AS columns FROM kept GROUP BY query_id, label)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label))::INT AS rank, label, score, columns FROM s QUALIFY rank <= 5""",
    "discover_sequential": f"""WITH {SIM}, {CENTROID},
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS orank FROM obj QUALIFY orank <= 5),
o2 AS (SELECT * FROM o WHERE score >= 0.05::DOUBLE),
c AS (SELECT sim.*, row_number() OVER (PARTITION BY query_id ORDER BY sim.score DESC, id) AS rn FROM sim SEMI JOIN o2 USING (query_id, label) QUALIFY rn <= 60),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, rn) AS nth FROM c WHERE score >= 0.05::DOUBLE QUALIFY nth <= 3),
s AS (SELECT query_id, label, avg(score) AS support, string_agg(id::VARCHAR, ',' ORDER BY nth) AS columns FROM b GROUP BY query_id, label),
j AS (SELECT query_id, label, round(greatest(0, least(1, 0.65::DOUBLE * score + 0.35::DOUBLE * coalesce(support, 0))), 6) AS score, orank, columns FROM o2 LEFT JOIN s USING (query_id, label))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, orank))::INT AS rank, label, score, columns FROM j QUALIFY rank <= 4""",
    "discover_parallel": f"""WITH {SIM}, {CENTROID},
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS orank FROM obj QUALIFY orank <= 3),
c AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM sim QUALIFY rn <= 40),
n AS (SELECT query_id, label, {_norm('score')} AS norm, orank FROM o),
lv AS (SELECT query_id, CASE WHEN max(score) = min(score) THEN 1.0 ELSE 0.0 END AS lvl FROM o GROUP BY query_id),
p AS (SELECT c.query_id, c.label, coalesce(any_value(lvl), 1.0)::DOUBLE AS norm, min(rn) + 1000000 AS orank FROM c LEFT JOIN lv ON lv.query_id = c.query_id ANTI JOIN o ON o.query_id = c.query_id AND o.label = c.label GROUP BY c.query_id, c.label),
al AS (SELECT * FROM n UNION ALL SELECT * FROM p),
cn AS (SELECT *, {_norm('score')} AS cnorm FROM c),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY cnorm DESC, rn) AS nth FROM cn QUALIFY nth <= 3),
s AS (SELECT query_id, label, avg(cnorm) AS support, string_agg(id::VARCHAR, ',' ORDER BY nth) AS columns FROM b GROUP BY query_id, label),
j AS (SELECT query_id, label, round(greatest(0, least(1, 0.6::DOUBLE * norm + 0.4::DOUBLE * coalesce(support, 0))), 6) AS score, orank, columns FROM al LEFT JOIN s USING (query_id, label))
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, orank))::INT AS rank, label, score, columns FROM j QUALIFY rank <= 3""",
    "vector_topk": _top("cosine", "list_cosine_similarity(qv, e.embedding::DOUBLE[])"),
    "vector_topk_dot": _top("dot", "list_dot_product(qv, e.embedding::DOUBLE[])"),
    "vector_topk_l2": _top("l2", "-list_distance(qv, e.embedding::DOUBLE[])"),
    "filtered_search": _top("cosine", "list_cosine_similarity(qv, e.embedding::DOUBLE[])").replace("JOIN embeddings e ON", "JOIN (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1)) e ON"),
    "keyword_score": f"WITH {KEYWORD} SELECT query_id, id, score, rank::INT AS rank FROM kt",
    "keyword_bm25": f"""WITH asked AS (SELECT DISTINCT item_id AS query_id, unnest({terms_sql('text')}) AS term FROM benchmark WHERE item_id % 20 = 0),
d AS (SELECT doc_id AS id, {terms_sql('text')} AS w FROM documents), n AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM d),
c AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY id, len, term),
f AS (SELECT term, count(*) AS df FROM c GROUP BY term),
s AS (SELECT query_id, id, round(sum(ln(1 + (n_docs - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg_len))), 6) AS score
  FROM c JOIN f USING (term) JOIN asked USING (term), n GROUP BY query_id, id)
SELECT query_id, id, score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 50""",
    **{f"fuse_rsf_{f.lower()}": _fuse_sql("RSF", f) for f in ("UNION", "INTERSECT", "RERANK")},
    "fuse_rrf": _fuse_sql("RRF", "UNION"),
    "fuse_wrrf": _fuse_sql("WRRF", "UNION"),
    "chunk_aggregate_max": f"WITH {CHUNKS} SELECT doc_id, round(max(share), 6) AS score FROM s GROUP BY doc_id",
    "chunk_aggregate_avg": f"WITH {CHUNKS} SELECT doc_id, round(avg(share), 6) AS score FROM s GROUP BY doc_id",
    "metrics_table": _metric_sql(*TABLE),
    "metrics_at_k": _metric_sql(*AT_K),
    "metrics_mrr": _metric_sql("mrr"),
    "metrics_jaccard": _metric_sql("jaccard"),
    "metrics_exact": _metric_sql("exact_match"),
    "metrics_joint": JOINT_SQL,
    "metrics_topn": TOPN_SQL,
    "metrics_column_macro": MACRO_SQL,
    "summary_by_db": f"WITH {SUMMARY} SELECT * FROM sm",
    "overall_weighted": f"WITH {SUMMARY} SELECT count(*) AS databases, sum(questions)::BIGINT AS questions, sum(successful)::BIGINT AS successful, {_over} FROM sm",
}
_of_runs = " UNION ALL ".join(f"SELECT {i} AS run_id, '{m}' AS mode, query_id, rank, label FROM ({ORACLES[f'discover_{m}']})" for i, m in ((1, "unified"), (2, "parallel")))
_run_rows = ", ".join(f"{METRIC_SQL[m]} AS {m}" if m.startswith("hit") else f"round({METRIC_SQL[m]}, 6)::DOUBLE AS {m}" for m in RUN_METRICS)
_run_sql = f"""WITH r AS ({_of_runs}), fs AS (SELECT run_id, query_id, list(label::VARCHAR ORDER BY rank) AS f FROM r GROUP BY run_id, query_id),
qs AS (SELECT m.run_id, m.mode, vec_id AS question_id, [label::VARCHAR] AS e, coalesce(fs.f, []) AS f FROM embeddings CROSS JOIN (VALUES (1, 'unified'), (2, 'parallel')) m(run_id, mode)
  LEFT JOIN fs ON fs.run_id = m.run_id AND fs.query_id = vec_id WHERE vec_id % 20 = 0)
SELECT run_id, mode, question_id, {_run_rows} FROM qs"""
ORACLES["evaluation_run"] = _run_sql
ORACLES["evaluation_summary"] = f"SELECT run_id, mode, count(*) AS questions, {', '.join(f'round(avg({m}::INT::DOUBLE), 6) AS avg_{m}' if m.startswith('hit') else f'round(avg({m}), 6) AS avg_{m}' for m in RUN_METRICS)} FROM ({_run_sql}) GROUP BY run_id, mode"


def _sweep_sql(matrix: dict) -> str:
    """All runs of the sweep beside each other: run is part of every key."""
    names = ("vector_score_weight", "text_score_weight", "vector_rank_penalty", "text_rank_penalty")
    runs = [(i, sweep.resolved(r)) for i, r in enumerate(sweep.expand(matrix), 1)]
    values = ", ".join(f"({i}, '{s['mode']}', '{s['search_type']}', {repr(s['scorer']) if s['search_type'] == 'hybrid' else 'NULL'}, {', '.join(f'{s[n]}::DOUBLE' for n in names)})" for i, s in runs)
    score = "CASE WHEN search_type = 'vector' THEN s WHEN scorer = 'RSF' THEN (vw * coalesce(v, 0) + tw * coalesce(k, 0)) / (vw + tw) ELSE coalesce(1 / (vp + vr), 0) + coalesce(1 / (tp + kr), 0) END"
    norm = lambda c: _norm(c).replace("PARTITION BY query_id", "PARTITION BY run_id, query_id")
    by = "PARTITION BY run_id, query_id"
    return f"""WITH {KEYWORD}, runs AS (SELECT * FROM (VALUES {values}) r(run_id, mode, search_type, scorer, vw, tw, vp, tp)),
q AS (SELECT vec_id AS query_id, label AS own, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark WHERE item_id % 20 = 0)),
sim AS (SELECT query_id, e.vec_id AS id, round(list_cosine_similarity(qv, e.embedding::DOUBLE[]), 6) AS score FROM q JOIN embeddings e ON e.vec_id <> q.query_id),
vt AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS vr FROM sim QUALIFY vr <= 50),
vn AS (SELECT query_id, id, score AS s, vr, {_norm('score')} AS v FROM vt),
kn AS (SELECT query_id, id, rank AS kr, {_norm('score')} AS k FROM kt),
hits AS (SELECT query_id, id, label, s, v, vr, k, kr FROM vn FULL JOIN kn USING (query_id, id) JOIN embeddings ON vec_id = id),
{CENTROID},
ov AS (SELECT query_id, label AS id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS vr, {_norm('score')} AS v FROM obj),
kl AS (SELECT query_id, label AS id, max(score) AS score FROM ks JOIN embeddings ON vec_id = ks.id GROUP BY query_id, label),
ok AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS kr, {_norm('score')} AS k FROM kl),
objs AS (SELECT query_id, id AS label, ov.score AS s, v, vr, k, kr FROM ov FULL JOIN ok USING (query_id, id)),
h AS (SELECT run_id, mode, query_id, id, label, round({score}, 6) AS score FROM hits JOIN runs ON search_type = 'hybrid' OR vr IS NOT NULL),
hit AS (SELECT *, row_number() OVER ({by} ORDER BY score DESC, id) AS rn FROM h QUALIFY rn <= 40),
nm AS (SELECT *, {norm('score')} AS norm FROM hit),
ukept AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id, label ORDER BY norm DESC, rn) AS nth FROM nm WHERE mode = 'unified' AND norm >= 0.6::DOUBLE QUALIFY nth <= 3),
us AS (SELECT run_id, query_id, label, round(avg(norm), 6) AS score FROM ukept GROUP BY ALL),
u AS (SELECT run_id, query_id, label, row_number() OVER ({by} ORDER BY score DESC, label) AS rank FROM us QUALIFY rank <= 4),
o0 AS (SELECT run_id, query_id, label, round({score}, 6) AS score FROM objs JOIN runs ON mode = 'parallel' AND (search_type = 'hybrid' OR vr IS NOT NULL)),
o AS (SELECT *, row_number() OVER ({by} ORDER BY score DESC, label) AS orank FROM o0 QUALIFY orank <= 4),
n AS (SELECT run_id, query_id, label, {norm('score')} AS norm, orank FROM o),
lv AS (SELECT run_id, query_id, CASE WHEN max(score) = min(score) THEN 1.0 ELSE 0.0 END AS lvl FROM o GROUP BY ALL),
p AS (SELECT c.run_id, c.query_id, c.label, coalesce(any_value(lvl), 1.0)::DOUBLE AS norm, min(rn) + 1000000 AS orank FROM nm c LEFT JOIN lv USING (run_id, query_id)
  ANTI JOIN o ON o.run_id = c.run_id AND o.query_id = c.query_id AND o.label = c.label WHERE c.mode = 'parallel' GROUP BY ALL),
al AS (SELECT * FROM n UNION ALL SELECT * FROM p),
b AS (SELECT *, row_number() OVER (PARTITION BY run_id, query_id, label ORDER BY norm DESC, rn) AS nth FROM nm WHERE mode = 'parallel' QUALIFY nth <= 3),
sp AS (SELECT run_id, query_id, label, avg(norm) AS support FROM b GROUP BY ALL),
j AS (SELECT run_id, query_id, label, round(greatest(0, least(1, 0.6::DOUBLE * norm + 0.4::DOUBLE * coalesce(support, 0))), 6) AS score, orank FROM al LEFT JOIN sp USING (run_id, query_id, label)),
pr AS (SELECT run_id, query_id, label, row_number() OVER ({by} ORDER BY score DESC, orank) AS rank FROM j QUALIFY rank <= 4),
r AS (SELECT * FROM u UNION ALL SELECT * FROM pr), fs AS (SELECT run_id, query_id, list(label::VARCHAR ORDER BY rank) AS f FROM r GROUP BY ALL),
qs AS (SELECT run_id, mode, search_type, scorer, query_id AS question_id, [own::VARCHAR] AS e, coalesce(f, []) AS f FROM q CROSS JOIN runs LEFT JOIN fs USING (run_id, query_id))
SELECT run_id, mode, search_type, scorer, question_id, {_run_rows} FROM qs"""


ORACLES["sweep_runs"] = _sweep_sql(SWEEP)
ORACLES["indexed_bm25"] = ORACLES["keyword_bm25"]
ORACLES["indexed_overlap"] = ORACLES["keyword_score"]
_changed = "(SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN concat_ws(' ', text, 'replaced', text) ELSE text END AS text FROM documents WHERE doc_id % 10 <> 7)"
ORACLES["index_refresh"] = ORACLES["keyword_bm25"].replace("FROM documents", f"FROM {_changed}")
_wanted = lambda where: f"(SELECT sum(least(10, (SELECT count(*) FROM embeddings e WHERE e.vec_id <> q.vec_id AND {where})))::BIGINT FROM embeddings q WHERE q.vec_id % 20 = 0)"
ORACLES["ann_recall"] = f"SELECT metric, {_wanted('true')} AS wanted, true AS enough FROM (VALUES ('cosine'), ('dot'), ('l2')) v(metric)"
ORACLES["filtered_ann"] = " UNION ALL ".join(f"SELECT {part}::INT AS one_in, {_wanted(f'e.vec_id % {part} = 0')} AS wanted, true AS enough" for part in (100, 10, 2))


def _results_sql() -> str:
    """All metrics of the orders' lists of brands (tables) and of their parts (columns)."""
    columns = {}
    for name, k in (("", None), ("_at_1", "1"), ("_at_3", "3"), ("_at_5", "5"), ("_at_k", "10")):
        columns[name] = _prf(k)[:2]
    means = ", ".join(f"avg({p}) AS p{n}, avg({r}) AS r{n}" for n, (p, r) in columns.items())
    own = {f"column_{m}{n}": f"round({c}{n}, 6)::DOUBLE" for n in columns for m, c in (("precision", "p"), ("recall", "r"))} | {f"column_f1{n}": _f1(f"p{n}", f"r{n}") for n in columns}
    own |= {"joint_column_precision": "round(jp, 6)::DOUBLE", "joint_column_recall": "round(jr, 6)::DOUBLE", "joint_column_f1": _f1("jp", "jr"), "topn_column_accuracy": "round(topn, 6)::DOUBLE"}
    table = METRIC_SQL | {"recall_at_k": _recall(10)}
    cols = []
    for field in evaluate.RESULT_METRICS:
        c = table.get(field.removeprefix("table_")) or table.get({"topn_table_accuracy": "top_n_accuracy"}.get(field, ""))
        c = own.get(field) or (c if "_hit_at_" in field or field == "table_exact_match" else f"round({c}, 6)::DOUBLE")
        cols.append(f"{c} AS {field}")
    dots = lambda c: f"flatten(list(list_transform({c}, lambda x: brand || '.' || x) ORDER BY brand) FILTER (len({c}) > 0))"
    one = ORDER_SETS.replace("lower(t) AS t", "t AS brand, lower(t) AS t")
    return f"""{one}, m AS (SELECT question_id, {means}, avg({METRIC_SQL['top_n_accuracy']}) AS topn,
  CASE WHEN sum(len(f)) = 0 THEN 0 ELSE sum(len(list_intersect(e, f))) / sum(len(f))::DOUBLE END AS jp, sum(len(list_intersect(e, f))) / sum(len(e))::DOUBLE AS jr,
  list(t ORDER BY t) AS te, coalesce(list(t ORDER BY t) FILTER (len(f) > 0), []) AS tf, list(brand ORDER BY brand) AS eb, coalesce(list(brand ORDER BY brand) FILTER (len(f) > 0), []) AS fb,
  {dots('e')} AS ec, coalesce({dots('f')}, []) AS fc FROM one GROUP BY question_id),
res AS (SELECT question_id, o_orderpriority AS db_id, 'order ' || question_id AS question, o_totalprice AS execution_time_ms, len(eb)::INT AS num_expected_tables, len(ec)::INT AS num_expected_columns,
  array_to_string(eb, '|') AS expected_tables, array_to_string(list_sort(ec), '|') AS expected_columns, array_to_string(fb, '|') AS discovered_tables, array_to_string(fc, '|') AS discovered_columns,
  {', '.join(cols)}, CASE WHEN o_orderstatus = 'P' THEN 'in progress' END AS error FROM (SELECT * EXCLUDE (te, tf), te AS e, tf AS f FROM m) JOIN orders ON o_orderkey = question_id)"""


def _summary_field(c: str) -> str:
    value = f"{c}::INT" if "_hit_at_" in c or c == "table_exact_match" else c
    return f"round(coalesce(avg({value}::DOUBLE) FILTER (error IS NULL), 0), 6)::DOUBLE AS {evaluate.average_name(c)}"


ORACLES["result_fields"] = f"WITH {_results_sql()} SELECT * FROM res"
ORACLES["summary_fields"] = f"""WITH {_results_sql()} SELECT lower(db_id) AS db_id, count(*) AS total_questions, count(*) FILTER (error IS NULL) AS successful_queries,
count(*) FILTER (error IS NOT NULL) AS failed_queries, {', '.join(map(_summary_field, ('execution_time_ms', *evaluate.RESULT_METRICS)))} FROM res GROUP BY 1"""

"""Vector and keyword search for many queries at once, and fusion of their rankings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.frozen import frozen
from lodestone.operators.ranking import normalised

#: Rows of a block: queries and corpus meet block against block, so no side is broadcast or collected.
QUERY_BLOCK, CORPUS_BLOCK = 1024, 16_384
#: Queries of a block that are scored at a time.
QUERY_SLICE = 64


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, vector): element-wise mean of each group's vectors; partial sums combine before the shuffle."""
    parts = df.select(group, F.posexplode(vector).alias("_pos", "_x")).groupBy(group, "_pos").agg(F.avg(F.col("_x").cast("double")).alias("_x"))
    return parts.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_x"))), lambda s: s["_x"]).alias(vector))


def _blocks(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def best_rows(top: int, metric: str, group: str | None = None, skip_self: bool = True):
    """A function of one block of queries and one of targets (column `asks` tells which): each query's best rows of the block."""

    def best(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy()
        ids = table.column("id").to_numpy()
        x = table.column("vector").combine_chunks()
        x = np.asarray(x.flatten()).reshape(len(ids), -1) if len(ids) else np.empty((0, 0))
        query, target = np.flatnonzero(asks), np.flatnonzero(~asks)
        target = target[np.argsort(ids[target], kind="stable")]
        labels = np.asarray(table.column(group).to_pandas(), object)[target] if group else np.zeros(len(target), int)
        parts = [np.flatnonzero(labels == g) for g in dict.fromkeys(labels.tolist())] if group else [np.arange(len(target))]
        rows: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        b = x[target]
        for begin in range(0, len(query) if len(target) else 0, QUERY_SLICE):  # so that scores of a few queries only are in memory
            some = query[begin : begin + QUERY_SLICE]
            a = x[some]
            if metric == "l2":
                step = max(1, 1_000_000 // max(1, a.size))  # targets at a time: differences are exact, products would cancel
                score = -np.sqrt(np.concatenate([((a[:, None, :] - b[None, k : k + step, :]) ** 2).sum(-1) for k in range(0, len(b), step)], axis=1))
            else:
                score = a @ b.T
                if metric == "cosine":
                    size = np.sqrt((a**2).sum(1))[:, None] * np.sqrt((b**2).sum(1))[None]
                    score = np.divide(score, size, out=np.full(score.shape, np.nan), where=size > 0)
            score = np.round(score, 6) + 0.0
            for i, qi in enumerate(some):
                for own in parts:
                    s = score[i, own]
                    ok = ~np.isnan(s)
                    if skip_self:
                        ok &= ids[target[own]] != ids[qi]
                    at = own[ok]
                    if len(at) > top:  # all that reach the last wanted score; ties are cut by id below
                        at = at[score[i, at] >= np.partition(score[i, at], -top)[-top]]
                    first = np.argsort(-score[i, at], kind="stable")[:top]
                    at = at[first]
                    rows.append((np.full(len(at), ids[qi]), ids[target[at]], score[i, at], labels[at]))
        columns = [np.concatenate([r[k] for r in rows]) if rows else np.empty(0) for k in range(4)]
        out = {"query_id": pa.array(columns[0].astype(np.int64)), "id": pa.array(columns[1].astype(np.int64)), "score": pa.array(columns[2].astype(float))}
        if group:
            out[group] = pa.array(columns[3].tolist(), table.schema.field(group).type)
        return pa.table(out)

    return best


def vector_search(queries: DataFrame, corpus: DataFrame, top: int, metric: str = "cosine", group: str | None = None, skip_self: bool = True) -> DataFrame:
    """Exact nearest rows of the corpus for each query.

    queries: query_id, vector. corpus: id, vector and, if given, the column `group`. Result: query_id, id, score (rounded to
    six digits, larger is better) and the group: the best `top` of each query, or of each query and group. Ties: smaller id.
    metric: cosine, dot or l2 (negative distance). Zero vectors and null vectors score nothing under cosine.
    """
    n_query, n_corpus = queries.count(), corpus.count()
    qb, cb = _blocks(n_query, QUERY_BLOCK), _blocks(n_corpus, CORPUS_BLOCK)
    extra = [group] if group else []
    kinds = dict(corpus.dtypes)
    vectors = lambda df, key: df.where(F.col("vector").isNotNull()).select(F.col(key).cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    q = vectors(queries, "query_id").withColumn("q", F.pmod(F.xxhash64("id"), F.lit(qb)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(cb - 1)))).withColumn("asks", F.lit(True))
    c = corpus.where(F.col("vector").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), *extra)
    c = c.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(cb)).cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))).withColumn("asks", F.lit(False))
    if group:
        q = q.withColumn(group, F.lit(None).cast(kinds[group]))
    both = q.select("q", "c", "asks", "id", "vector", *extra).unionByName(c.select("q", "c", "asks", "id", "vector", *extra))
    schema = "query_id long, id long, score double" + (f", `{group}` {kinds[group]}" if group else "")

    found = both.groupBy("q", "c").applyInArrow(best_rows(top, metric, group, skip_self), schema)
    ranked = W.partitionBy("query_id", *extra).orderBy(F.desc("score"), "id")
    return found.withColumn("_nth", F.row_number().over(ranked)).where(F.col("_nth") <= top).drop("_nth")


def term_counts(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, term, tf) of index terms."""
    return df.select(key, F.explode(T.index_terms(text)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def query_terms(queries: DataFrame, text: Column) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(T.index_terms(text))).alias("term"))


#: Distinct query terms up to which documents are cut down to them row by row; beyond it, all their terms are joined.
ROW_WISE_TERMS = 20_000


def few_terms(asked: DataFrame) -> list[str] | None:
    """The distinct asked terms, if they are few enough to stand in an expression."""
    terms = [r["term"] for r in asked.select("term").distinct().limit(ROW_WISE_TERMS + 1).collect()]
    return terms if len(terms) <= ROW_WISE_TERMS else None


def keyword_overlap(queries: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(query_id, id, score): how many of a query's terms a document has."""
    asked = query_terms(queries, F.col("text"))
    few = few_terms(asked)
    # Asked terms hold no stop words and no numbers, so a document's words need no other test.
    terms = T.index_terms(F.col(text)) if few is None else F.filter(F.split(F.lower(F.col(text)), T.LEXER), lambda w: w.isin(few))
    has = docs.select(F.col(key).alias("id"), F.explode(F.array_distinct(terms)).alias("term"))
    return has.join(asked, "term").groupBy("query_id", "id").agg(F.count("*").cast("double").alias("score"))


def term_hits(docs: DataFrame, asked: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, len, term): each occurrence of an asked term, with the document's number of index terms."""
    few = few_terms(asked)
    chosen = (lambda t: t) if few is None else (lambda t: F.filter(t, lambda w: w.isin(few)))
    with_len = T.let(T.index_terms(F.col(text)), lambda t: F.transform(chosen(t), lambda w: F.struct(F.size(t).alias("len"), w.alias("term"))))
    hits = docs.select(F.col(key).alias("id"), F.explode(with_len).alias("t")).select("id", "t.*")
    return hits if few is not None else hits.join(asked.select("term").distinct(), "term", "left_semi")


def bm25(queries: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, id, score): Okapi BM25 over all documents; statistics cover the whole table."""
    asked = query_terms(queries, F.col("text"))
    few = few_terms(asked)
    if few is None:
        rows, hits = docs.select(F.size(T.index_terms(F.col(text))).alias("len")), term_hits(docs, asked, key, text)
    else:  # lengths and asked terms are a small part of the texts: texts are made and split into terms once, not for each use
        terms = docs.select(F.col(key).alias("id"), T.index_terms(F.col(text)).alias("_terms"))
        rows = frozen(terms.select("id", F.size("_terms").alias("len"), F.filter("_terms", lambda w: w.isin(few)).alias("hits")))
        hits = rows.select("id", "len", F.explode("hits").alias("term"))
    total = rows.agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))  # one row
    counts = hits.groupBy("id", "len", "term").agg(F.count("*").alias("tf"))
    freq = counts.groupBy("term").agg(F.count("*").alias("df"))
    part = counts.join(freq, "term").crossJoin(F.broadcast(total))
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    return part.select("id", "term", weight.alias("_w")).join(asked, "term").groupBy("query_id", "id").agg(F.round(F.sum("_w"), 6).alias("score"))


#: What a run's list holds: rows that the vector list has, that either list has, that both have, that the keyword list has.
LISTS = ("VECTOR", "UNION", "INTERSECT", "RERANK")


def both_lists(vector: DataFrame, keyword: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, v, vr, k, kr) of what either ranked list (query_id, id, score) has: score and place in the vector list, both
    scores scaled to [0, 1] within their query, and the place in the keyword list. Each list is ranked once, whatever is made of it."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    v = vector.select("query_id", "id", "score", normalised(F.col("score"), ["query_id"]).alias("v"), rank.alias("vr"))
    if keyword is None:
        return v.select("*", F.lit(None).cast("double").alias("k"), F.lit(None).cast("int").alias("kr"))
    k = keyword.select("query_id", "id", normalised(F.col("score"), ["query_id"]).alias("k"), rank.alias("kr"))
    return v.join(k, ["query_id", "id"], "full")


def in_lists() -> Column:
    """The LISTS that a row of both_lists() stands in."""
    v, k = F.col("vr").isNotNull(), F.col("kr").isNotNull()
    return F.filter(F.array(F.when(v, "VECTOR"), F.lit("UNION"), F.when(v & k, "INTERSECT"), F.when(k, "RERANK")), lambda x: x.isNotNull())


def fused_score(scorer: Column, fusion: Column, vector_weight: Column, text_weight: Column, vector_penalty: Column, text_penalty: Column) -> Column:
    """The score of a row of both_lists() by settings that may come with the row."""
    zero = F.lit(0.0)
    v, k = F.coalesce("v", zero), F.coalesce("k", zero)
    rsf = (vector_weight * v + text_weight * k) / (vector_weight + text_weight)
    a, b = (F.when(scorer == "WRRF", w).otherwise(1.0) for w in (vector_weight, text_weight))
    rrf = F.coalesce(a / (vector_penalty + F.col("vr")), zero) + F.coalesce(b / (text_penalty + F.col("kr")), zero)
    return F.round(F.when(fusion == "VECTOR", F.col("score")).when(fusion == "RERANK", v).when(scorer == "RSF", rsf).otherwise(rrf), 6)


def fuse(
    vector: DataFrame, keyword: DataFrame, scorer: str = "RSF", fusion: str = "UNION", vector_weight: float = 1.0, text_weight: float = 10.0, vector_penalty: float = 5.0, text_penalty: float = 1.0
) -> DataFrame:
    """(query_id, id, score) of two ranked lists (query_id, id, score).

    RSF: weighted mean of min-max scores, a missing side is 0. RRF: sum of 1 / (penalty + rank); WRRF weighs the terms.
    UNION keeps what either list has, INTERSECT what both have, RERANK the keyword list ordered by the vector score.
    """
    if scorer not in ("RSF", "RRF", "WRRF") or fusion not in LISTS[1:]:
        raise ValueError("unknown scorer or fusion")
    rows = both_lists(vector, keyword).where(F.array_contains(in_lists(), fusion))
    return rows.select("query_id", "id", fused_score(*map(F.lit, (scorer, fusion, vector_weight, text_weight, vector_penalty, text_penalty))).alias("score"))


def chunked(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 100, overlap: int = 10) -> DataFrame:
    """(id: struct<doc, chunk>, text) of each chunk of recursive_chunks(), numbered from 0."""
    parts = docs.select(F.col(key).alias("doc"), F.posexplode(T.recursive_chunks(F.col(text), size, overlap)).alias("chunk", "words"))
    return parts.select(F.struct("doc", "chunk").alias("id"), F.array_join("words", " ").alias("text"))


def chunk_search(queries: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text", aggregator: str = "MAX", best: int = 3, size: int = 100, overlap: int = 10) -> DataFrame:
    """Search in chunks: (query_id, id, score, n_chunks, chunks) for each document with a chunk that BM25 over all chunks finds.

    score: the largest or the mean score of the document's found chunks; chunks: its `best` chunks (chunk, score) in order.
    """
    if aggregator not in ("MAX", "AVG"):
        raise ValueError("aggregator is MAX or AVG")
    found = bm25(queries, chunked(docs, key, text, size, overlap), "id", "text").select("query_id", F.col("id.doc").alias("id"), F.col("id.chunk").alias("chunk"), "score")
    order = W.partitionBy("query_id", "id").orderBy(F.desc("score"), "chunk")
    ranked = found.withColumn("_nth", F.row_number().over(order))
    first = F.array_sort(F.collect_list(F.when(F.col("_nth") <= best, F.struct("_nth", "chunk", "score"))))
    score = F.max("score") if aggregator == "MAX" else F.round(F.avg("score"), 6)
    rolled = ranked.groupBy("query_id", "id").agg(score.alias("score"), F.count("*").alias("n_chunks"), first.alias("_best"))
    return rolled.select("query_id", "id", "score", "n_chunks", F.transform("_best", lambda x: F.struct(x["chunk"].alias("chunk"), x["score"].alias("score"))).alias("chunks"))


def chunk_scores(chunks: DataFrame, key: str, score: str, aggregator: str = "MAX") -> DataFrame:
    """A document's score from those of its chunks."""
    agg = {"MAX": F.max, "AVG": F.avg}[aggregator]
    return chunks.groupBy(key).agg(F.round(agg(score), 6).alias("score"))


def within_fields(queries: DataFrame, docs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(query_id, id, score): how many of a query's terms a document has in the field that the query names.

    queries: query_id, field, text. Fields stay columns; only terms that some query asks for are joined.
    """
    asked = queries.select("query_id", "field", F.explode(F.array_distinct(T.index_terms(F.col("text")))).alias("term"))
    parts = F.array(*[F.struct(F.lit(f).alias("field"), F.array_distinct(T.index_terms(F.col(f))).alias("terms")) for f in fields])
    terms = docs.select(F.col(key).alias("id"), F.explode(parts).alias("p")).select("id", "p.field", F.explode("p.terms").alias("term"))
    return terms.join(asked, ["field", "term"]).groupBy("query_id", "id").agg(F.count("*").cast("double").alias("score"))


def text_asked(queries: DataFrame, contains: str = "text_contains", send_contains: bool = False) -> DataFrame:
    """The queries (query_id, text) of a hybrid search's keyword side.

    A query without `contains` searches by vector alone. Its presence switches the text search on, which looks for the
    query's own text; with send_contains, for what it holds.
    """
    return queries.where(F.col(contains).isNotNull()).select("query_id", F.col(contains if send_contains else "text").alias("text"))

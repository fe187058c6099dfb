"""Scoring of rankings per question, per database and overall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions import metrics as M
from lodestone.functions.text import let

KS = (1, 3, 5)


def _counts(e: Column, f: Column, cuts: dict[str, int], h: Column, n_e: Column, n_f: Column) -> dict[str, Column]:
    """Hits and different names among the first found names, by cut; h_n: hits among as many as are expected.

    e: different expected names; f: found names; h: hits in all of them; n_e, n_f: different names of both. Lists that end before a cut are not looked at again.
    """
    n = F.size(f)
    hits = lambda k: F.when((h == 0) | (n <= k), h).otherwise(F.size(F.array_intersect(e, M.at(f, k))))
    names = lambda k: F.when(n <= k, n_f).when(n_f == n, F.lit(k)).otherwise(F.size(F.array_distinct(M.at(f, k))))
    return {f"h_{c}": hits(F.lit(k)) for c, k in cuts.items()} | {f"f_{c}": names(k) for c, k in cuts.items()} | {"h_n": hits(n_e)}


def table_metrics(df: DataFrame, expected: str = "expected", found: str = "found", k: int = 10) -> DataFrame:
    """Set, prefix and rank metrics of each row's ranked list against its expected names; adds columns to the frame."""
    named = df.withColumn("_e", F.array_distinct(M.folded(F.col(expected)))).withColumn("_f", M.folded(F.col(found)))
    # Lists are compared once; all metrics come from these counts.
    whole = named.select("*", F.size("_e").alias("_n_e"), F.size(F.array_distinct("_f")).alias("_n_f"), F.size(F.array_intersect("_e", "_f")).alias("_h"))
    e, f, h, n_e, n_f = (F.col(c) for c in ("_e", "_f", "_h", "_n_e", "_n_f"))
    cuts = {**{str(n): n for n in (*KS, 10, 15)}, "k": k}
    counted = whole.select("*", *[c.alias(f"_{n}") for n, c in _counts(e, f, cuts, h, n_e, n_f).items()])
    hits_at, names_at, union = (lambda n: F.col(f"_h_{n}")), (lambda n: F.col(f"_f_{n}")), n_e + n_f - h
    cols = {
        "precision": M.ratio(h, n_f), "recall": M.ratio(h, n_e), "f1": M.f1_of(M.ratio(h, n_f), M.ratio(h, n_e)), "mrr": F.when(h == 0, F.lit(0.0)).otherwise(M.reciprocal_rank(e, f)),
        "jaccard": F.when(union == 0, F.lit(1.0)).otherwise(M.ratio(h, union)), "exact_match": (h == n_e) & (n_f == n_e), "top_n_accuracy": M.ratio(hits_at("n"), n_e),
    }
    cols |= {f"hit_at_{n}": hits_at(n) > 0 for n in KS}
    cols |= {f"recall_at_{n}": F.when(n_e == 0, F.lit(1.0)).otherwise(M.ratio(hits_at(n), n_e)) for n in ("3", "5", "10", "15", "k")}
    for n in [*map(str, KS), "k"]:
        p, r = M.ratio(hits_at(n), names_at(n)), M.ratio(hits_at(n), n_e)
        cols |= {f"precision_at_{n}": p, f"prefix_recall_at_{n}": r, f"f1_at_{n}": M.f1_of(p, r)}
    rounded = {n: F.round(c, 6) if n != "exact_match" and not n.startswith("hit") else c for n, c in cols.items()}
    return counted.select(*df.columns, *[c.alias(n) for n, c in rounded.items()])


def counted_metrics(questions: DataFrame, found: DataFrame, key: str = "question_id", k: int = 10) -> DataFrame:
    """The metrics of table_metrics() from counts: no list of expected or found names is made, so what is expected may be of any number.

    questions: key and n_expected (distinct names) beside other columns; found: key, rank from 1, name, hit (the name is expected), as
    an equality join of the found names gives it. Everything comes from sums over ranks, in one aggregation by question.
    """
    first = F.row_number().over(W.partitionBy(key, F.lower("name")).orderBy("rank")) == 1
    rows = found.select(key, "rank", "hit", first.alias("_new")).join(questions.select(key, F.col("n_expected").alias("_n")), key)
    ks = {**{str(n): F.lit(n) for n in (1, 3, 5, 10, 15)}, "k": F.lit(k), "n": F.col("_n"), "all": F.lit(None)}
    within = lambda n: F.col("_new") if n == "all" else F.col("_new") & (F.col("rank") <= ks[n])
    count = lambda c, name: F.sum(c.cast("long")).alias(name)
    sums = [count(within(n) & F.col("hit"), f"_h_{n}") for n in ks] + [count(within(n), f"_f_{n}") for n in ("1", "3", "5", "k", "all")]
    counted = rows.groupBy(key).agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("_place"), *sums)
    both = questions.join(counted, key, "left")
    e = F.coalesce("n_expected", F.lit(0))
    h, f = (lambda n: F.coalesce(f"_h_{n}", F.lit(0))), (lambda n: F.coalesce(f"_f_{n}", F.lit(0)))
    union = e + f("all") - h("all")
    cols = {
        "precision": M.ratio(h("all"), f("all")), "recall": M.ratio(h("all"), e), "mrr": F.coalesce(1.0 / F.col("_place"), F.lit(0.0)),
        "jaccard": F.when(union == 0, F.lit(1.0)).otherwise(M.ratio(h("all"), union)), "exact_match": (h("all") == e) & (f("all") == e), "top_n_accuracy": M.ratio(h("n"), e),
    }
    cols["f1"] = M.f1_of(cols["precision"], cols["recall"])
    cols |= {f"hit_at_{n}": h(str(n)) > 0 for n in KS}
    cols |= {f"recall_at_{n}": F.when(e == 0, F.lit(1.0)).otherwise(M.ratio(h(n), e)) for n in ("3", "5", "10", "15", "k")}
    for n in [*map(str, KS), "k"]:
        p, r = M.ratio(h(n), f(n)), M.ratio(h(n), e)
        cols |= {f"precision_at_{n}": p, f"prefix_recall_at_{n}": r, f"f1_at_{n}": M.f1_of(p, r)}
    rounded = {n: F.round(c, 6) if n != "exact_match" and not n.startswith("hit") else c for n, c in cols.items()}
    return both.select(*[c for c in questions.columns if c != "n_expected"], *[c.alias(n) for n, c in rounded.items()])


def _with_columns(df: DataFrame, expected: str, found: str, k: int) -> DataFrame:
    """The frame with _m: the sums that column metrics come from, one struct a row; there is no shuffle and no join."""
    named = lambda c: F.transform(F.coalesce(F.col(c), F.array()), lambda x: F.struct(F.lower(x["table"]).alias("t"), M.folded(x["columns"]).alias("c")))
    none = F.array().cast("array<string>")
    lists = df.select("*", named(expected).alias("_want"), named(found).alias("_have"))
    # Names that are null are one table; no found table has it.
    names = F.transform("_want", lambda x: F.coalesce(x["t"], F.lit("\0")))
    lists = lists.select("*", F.transform("_have", lambda x: x["t"]).alias("_found"), F.reverse(names).alias("_back"))
    cuts = {str(n): n for n in KS} | {"k": k}

    def pair(x: Column, i: Column) -> Column:
        own = F.get("_have", F.array_position("_found", x["t"]).cast("int") - 1)["c"]
        last = F.size("_back") - F.array_position("_back", F.coalesce(x["t"], F.lit("\0"))) == i
        return F.struct(F.array_distinct(F.coalesce(x["c"], none)).alias("e"), F.coalesce(own, none).alias("f"), last.alias("last"))

    def count(x: Column) -> Column:
        whole = F.struct(F.size(x["e"]).alias("n_e"), F.size(F.array_distinct(x["f"])).alias("n_f"), F.size(F.array_intersect(x["e"], x["f"])).alias("h"))
        each = lambda w: _counts(x["e"], x["f"], cuts, w["h"], w["n_e"], w["n_f"])
        return let(whole, lambda w: F.struct(x["last"].alias("last"), *[w[c].alias(c) for c in ("n_e", "n_f", "h")], *[c.alias(n) for n, c in each(w).items()]))

    counted = lists.select(*df.columns, F.transform(F.transform("_want", pair), count).alias("_tables"))
    ends = {"": ("h", "n_f")} | {f"_at_{n}": (f"h_{n}", f"f_{n}") for n in cuts}
    mean = {"n": lambda x: F.lit(1), "n_top": lambda x: (x["n_e"] > 0).cast("int"), "top": lambda x: M.ratio(x["h_n"], x["n_e"])}
    for name, (h, f) in ends.items():
        mean |= {f"p{name}": lambda x, h=h, f=f: M.ratio(x[h], x[f]), f"r{name}": lambda x, h=h: M.ratio(x[h], x["n_e"])}
    totals = {"hits": "h", "es": "n_e", "fs": "n_f"}
    zero = F.struct(*[F.lit(0).cast("long").alias(c) for c in totals], *[F.lit(0.0).alias(c) for c in mean])
    add = lambda a, x: F.struct(*[(a[c] + x[own]).alias(c) for c, own in totals.items()], *[(a[c] + F.when(x["last"], of(x).cast("double")).otherwise(F.lit(0.0))).alias(c) for c, of in mean.items()])
    return counted.select(*df.columns, F.aggregate("_tables", zero, add).alias("_m"))


def _column_metrics(m: Column) -> dict[str, Column]:
    """Column metrics of the sums of _with_columns()."""
    p, r = M.ratio(m["hits"], m["fs"]), M.ratio(m["hits"], m["es"])
    out = {"joint_precision": p, "joint_recall": r, "joint_f1": M.f1_of(p, r), "column_top_n_accuracy": M.ratio(m["top"], m["n_top"])}
    for name in ("", *[f"_at_{n}" for n in KS], "_at_k"):
        p, r = M.ratio(m[f"p{name}"], m["n"]), M.ratio(m[f"r{name}"], m["n"])
        out |= {f"column_precision{name}": p, f"column_recall{name}": r, f"column_f1{name}": M.f1_of(p, r)}
    return {n: F.round(c, 6) for n, c in out.items()}


def column_metrics(df: DataFrame, key: str = "question_id", expected: str = "expected", found: str = "found", k: int = 10) -> DataFrame:
    """Joint (micro), macro and top-N column metrics. expected, found: arrays of struct<table: string, columns: array<string>>; one row a question.

    A column counts only where its table was found. Joint metrics count a repeated expected table twice; macro metrics once,
    with its last column list; of a repeated found table the first list counts.
    """
    rows = _with_columns(df.select(key, F.col(expected).alias("_expected"), F.col(found).alias("_given")), "_expected", "_given", k)
    return rows.select(key, *[c.alias(n) for n, c in _column_metrics(F.col("_m")).items()])


#: The metric fields of a result file, in their order.
RESULT_METRICS = """
table_precision table_recall table_f1 column_precision column_recall column_f1 table_hit_at_1 table_hit_at_3 table_hit_at_5
table_recall_at_3 table_recall_at_5 table_recall_at_10 table_recall_at_15 table_recall_at_k column_recall_at_3 column_recall_at_5 column_recall_at_k
table_precision_at_1 table_precision_at_3 table_precision_at_5 table_precision_at_k table_f1_at_1 table_f1_at_3 table_f1_at_5 table_f1_at_k
column_precision_at_1 column_precision_at_3 column_precision_at_5 column_precision_at_k column_f1_at_1 column_f1_at_3 column_f1_at_5 column_f1_at_k
table_mrr table_jaccard table_exact_match joint_column_precision joint_column_recall joint_column_f1 topn_table_accuracy topn_column_accuracy
""".split()
#: The fields before them.
RESULT_HEAD = "question_id db_id question execution_time_ms num_expected_tables num_expected_columns expected_tables expected_columns discovered_tables discovered_columns".split()


def _own_name(field: str) -> str:
    """The name that table_metrics() and column_metrics() have for a metric field."""
    named = {"topn_table_accuracy": "top_n_accuracy", "topn_column_accuracy": "column_top_n_accuracy"}
    return named.get(field) or field.removeprefix("table_").replace("joint_column_", "joint_")


def result_rows(df: DataFrame, k: int = 10) -> DataFrame:
    """The 52 fields of a result file for each question.

    df: question_id, db_id, question, execution_time_ms, error and expected and found, arrays of struct<table, columns>, the found ones in their order.
    """
    flat = lambda c: F.coalesce(F.flatten(F.transform(c, lambda x: F.transform(F.coalesce(x["columns"], F.array()), lambda y: F.concat(x["table"], F.lit("."), y)))), F.array().cast("array<string>"))
    tables = lambda c: F.coalesce(F.transform(c, lambda x: x["table"]), F.array().cast("array<string>"))
    named = df.withColumn("_wanted", tables("expected")).withColumn("_given", tables("found"))
    measured = _with_columns(table_metrics(named, "_wanted", "_given", k), "expected", "found", k)
    measured = measured.select("*", *[c.alias(n) for n, c in _column_metrics(F.col("_m")).items()])
    head = {
        "num_expected_tables": F.size(F.array_distinct("_wanted")), "num_expected_columns": F.size(F.array_distinct(flat("expected"))),
        "expected_tables": F.array_sort(F.array_distinct("_wanted")), "expected_columns": F.array_sort(F.array_distinct(flat("expected"))),
        "discovered_tables": F.col("_given"), "discovered_columns": flat("found"),
    }
    return measured.select(*[head.get(c, F.col(c)).alias(c) for c in RESULT_HEAD], *[F.col(_own_name(c)).alias(c) for c in RESULT_METRICS], "error")


def average_name(field: str) -> str:
    return f"{field}_rate" if "_hit_at_" in field or field == "table_exact_match" else f"avg_{field}"


def summary_rows(results: DataFrame) -> DataFrame:
    """The 46 fields of a summary file for each database: counts, and means over the questions without an error."""
    good = F.col("error").isNull()
    means = [F.round(F.coalesce(F.avg(F.when(good, F.col(c).cast("double"))), F.lit(0.0)), 6).alias(average_name(c)) for c in ("execution_time_ms", *RESULT_METRICS)]
    count = lambda c, name: F.sum(c.cast("long")).alias(name)
    return results.groupBy(F.lower("db_id").alias("db_id")).agg(F.count("*").alias("total_questions"), count(good, "successful_queries"), count(~good, "failed_queries"), *means)


def summary(results: DataFrame, by: str, metrics: list[str], error: str = "error") -> DataFrame:
    """Averages over the successful questions of each database, and counts."""
    good = F.col(error).isNull()
    means = [F.round(F.avg(F.when(good, F.col(m).cast("double"))), 6).alias(f"avg_{m}") for m in metrics]
    return results.groupBy(F.lower(by).alias(by)).agg(F.count("*").alias("questions"), F.sum(good.cast("long")).alias("successful"), F.sum((~good).cast("long")).alias("failed"), *means)


def overall(summaries: DataFrame, metrics: list[str]) -> DataFrame:
    """Averages of databases weighted by their successful questions."""
    w = F.col("successful")
    means = [F.round(F.sum(F.col(f"avg_{m}") * w) / F.nullif(F.sum(F.when(F.col(f"avg_{m}").isNotNull(), w)), F.lit(0)), 6).alias(f"overall_{m}") for m in metrics]
    return summaries.agg(F.count("*").alias("databases"), F.sum("questions").alias("questions"), F.sum(w).alias("successful"), *means)


def question_stats(df: DataFrame, tables: str = "tables") -> DataFrame:
    """One row: questions, tables and columns that they refer to, and both for each question. tables: array of struct<name, columns>."""
    t = F.coalesce(F.col(tables), F.array())
    n = df.select(F.size(t).alias("t"), F.aggregate(t, F.lit(0), lambda a, x: a + F.coalesce(F.size(F.coalesce(x["columns"], F.array())), F.lit(0))).alias("c"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    mean = lambda c: F.round(F.sum(c) / F.nullif(F.count("*"), F.lit(0)), 2)
    return n.agg(F.count("*").alias("questions"), total("t").alias("tables"), total("c").alias("columns"), mean("t").alias("tables_each"), mean("c").alias("columns_each"))


def result_json(expected: Column, found: Column) -> tuple[Column, Column]:
    """JSON of the expected tables (array of struct<table, columns>) and of the found ones (struct<table, score, columns>), scores with four decimals."""
    want = F.transform(expected, lambda x: F.struct(x["table"].alias("table"), x["columns"].alias("columns")))
    have = F.transform(found, lambda x: F.struct(x["table"].alias("table"), F.round(x["score"].cast("double"), 4).alias("score"), x["columns"].alias("columns")))
    return F.to_json(want), F.to_json(have)


#: The cuts of a retrieval report.
REPORT_KS = (3, 5, 10)


def retrieval_metrics(df: DataFrame, expected: str = "expected", found: str = "found") -> DataFrame:
    """Adds precision, recall and F1 at 3, 5 and 10 (p_at_3 and so on) of a row's list of names."""
    e, f = M.folded(F.col(expected)), M.folded(F.col(found))
    named = df.withColumn("_e", e).withColumn("_f", f)
    cols = [F.round(c, 6).alias(f"{m}_at_{k}") for k in REPORT_KS for m, c in zip(("p", "r", "f1"), M.precision_recall_f1(F.col("_e"), M.at(F.col("_f"), k)), strict=True)]
    return named.select(*df.columns, *cols)


def retrieval_averages(results: DataFrame, error: str = "error") -> DataFrame:
    """One row: questions, failures, and the means of retrieval_metrics over the questions without an error (0 where there is none)."""
    good = F.col(error).isNull()
    means = [F.round(F.coalesce(F.avg(F.when(good, F.col(c))), F.lit(0.0)), 6).alias(c) for k in REPORT_KS for c in (f"p_at_{k}", f"r_at_{k}", f"f1_at_{k}")]
    return results.agg(F.count("*").alias("questions"), F.coalesce(F.sum((~good).cast("long")), F.lit(0)).alias("failures"), *means)

"""Experiment sweeps: configuration precedence, matrix expansion, validation, batch reports, result paths."""

from __future__ import annotations

import itertools
import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import discover, evaluate, search
from lodestone.operators.frozen import frozen
from lodestone.operators.ranking import Varying


#: What holds where no layer of settings says otherwise.
DEFAULTS = {
    "dataset_form": "single-user", "k": 10, "k0": 50, "m": None, "n": None, "cols_per_obj": 3, "alpha": 0.65, "parallel_alpha": 0.60, "score_threshold": 0.5, "mode": "unified", "search_type": "vector", "scorer": "RSF",
    "fusion": "UNION", "search_mode": "DOCUMENT", "aggregator": "MAX", "vector_score_weight": 1.0, "text_score_weight": 10.0, "vector_rank_penalty": 5.0, "text_rank_penalty": 1.0,
}
CHOICES = {"mode": ("sequential", "parallel", "unified"), "search_type": ("vector", "hybrid"), "scorer": ("RSF", "RRF", "WRRF"), "fusion": ("UNION", "INTERSECT", "RERANK")}


def resolved(*layers: dict) -> dict:
    """Settings of a run: later layers win over earlier ones and over DEFAULTS; keys with a null value change nothing."""
    out = dict(DEFAULTS)
    for layer in layers:
        if unknown := set(layer) - set(DEFAULTS):
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        out |= {k: v for k, v in layer.items() if v is not None}
    for key, known in CHOICES.items():
        if out[key] not in known:
            raise ValueError(f"{key} is one of {', '.join(known)}")
    if not 0 <= out["score_threshold"] <= 1:
        raise ValueError("score_threshold is in [0, 1]")
    if out["k"] < 1 or out["cols_per_obj"] < 1:
        raise ValueError("k and cols_per_obj are 1 or more")
    return out


#: What decides a run's rankings, as columns of the run table.
RUN = (
    "run_id int, mode string, scorer string, list string, k int, k0 int, m int, n int, cols_per_obj int, alpha double, score_threshold double,"
    " vector_score_weight double, text_score_weight double, vector_rank_penalty double, text_rank_penalty double"
)
#: Runs of one plan; their table goes to every task.
MOST_RUNS = 10_000


def run_table(spark: SparkSession, runs: dict[int, dict]) -> DataFrame:
    """The runs as rows: a column `run`, a struct of RUN, by the names of resolved(); m and n hold what follows from k and k0 where not set."""
    if len(runs) > MOST_RUNS:
        raise ValueError(f"a plan has {MOST_RUNS} runs at most")
    rows = []
    for run_id, given in sorted(runs.items()):
        s = resolved(given)
        unified, parallel = s["mode"] == "unified", s["mode"] == "parallel"
        m = s["m"] or (10 if unified else 5 * s["k"])
        own = s | {
            "run_id": run_id, "list": "VECTOR" if s["search_type"] == "vector" else s["fusion"], "m": max(s["k"] + 1, m) if parallel else m,
            "n": s["n"] or 5 * s["k0"], "alpha": s["parallel_alpha"] if parallel else s["alpha"],
        }
        rows.append(tuple(float(own[c]) if t == "double" else own[c] for c, t in (x.split() for x in RUN.split(", "))))
    return spark.createDataFrame(rows, RUN).select(F.struct("*").alias("run"))


def lists_of_runs(lists: DataFrame, runs: DataFrame, *carry: str) -> DataFrame:
    """(run, query_id, id, score and the columns to carry): what each run's list holds of search.both_lists(), scored by its own weights.

    A row meets the runs of the lists that it stands in, by an equality join to the small run table.
    """
    s = lambda c: F.col(f"run.{c}")
    rows = lists.withColumn("list", F.explode(search.in_lists())).join(F.broadcast(runs.withColumn("list", s("list"))), "list")
    score = search.fused_score(s("scorer"), F.col("list"), s("vector_score_weight"), s("text_score_weight"), s("vector_rank_penalty"), s("text_rank_penalty"))
    return rows.select("run", "query_id", "id", score.alias("score"), *carry)


def ranked_runs(runs: dict[int, dict], hits: DataFrame, obj: str, objects: DataFrame | None = None) -> DataFrame:
    """(run, query_id, rank, obj, score, columns) of every run, in one plan whatever their number.

    hits: search.both_lists() of columns, with their object; objects: the same of objects, by id, where a mode needs it. Both are
    ranked once, so stage them if they come from searches. Settings are columns beside the rows.
    """
    spark = hits.sparkSession
    table = run_table(spark, runs)
    settings = [resolved(r) for r in runs.values()]
    modes = {s["mode"] for s in settings}
    rows = table.select("run.*").collect()  # MOST_RUNS at most
    most = {c: max(r[c] for r in rows) for c in ("k", "k0", "m", "n", "cols_per_obj", "alpha", "score_threshold")} if rows else {}
    by, parts = ["run", "query_id"], []
    for mode in sorted(modes):
        own = table.where(F.col("run.mode") == mode)
        s = {c: Varying(f"run.{c}", x) for c, x in most.items()}
        near = lists_of_runs(hits, own, obj)
        if mode == "unified":
            parts.append(discover.unified(near, obj, s["k"], s["m"], s["cols_per_obj"], s["score_threshold"], by=by))
            continue
        if objects is None:
            raise ValueError("this mode needs scored objects")
        first = lists_of_runs(objects, own).withColumnRenamed("id", obj)
        if mode == "parallel":
            parts.append(discover.parallel(first, near, obj, s["k"], s["m"], s["cols_per_obj"], s["alpha"], by=by))
        else:
            parts.append(discover.sequential(first, near, obj, s["k"], s["k0"], s["n"], s["cols_per_obj"], s["alpha"], s["score_threshold"], by=by))
    return reduce(lambda a, b: a.unionByName(b), parts)


def evaluated(runs: dict[int, dict], questions: DataFrame, hits: DataFrame, obj: str, objects: DataFrame | None = None) -> DataFrame:
    """Every run over every question in one plan: run_id, mode, search_type, scorer, the question's columns and its metrics.

    questions: query_id, expected (array of names). A question for which nothing is found has an empty list. hits, objects: see ranked_runs().
    """
    empty = F.array().cast("array<string>")
    listed = F.array_sort(F.collect_list(F.struct("rank", F.col(obj).cast("string").alias("name"))))
    ranked = ranked_runs(runs, hits, obj, objects).groupBy(F.col("run.run_id").alias("run_id"), "query_id").agg(F.transform(listed, lambda x: x["name"]).alias("found"))
    each = []
    for run_id, given in sorted(runs.items()):
        s = resolved(given)
        each.append(F.struct(F.lit(run_id).alias("run_id"), F.lit(s["mode"]).alias("mode"), F.lit(s["search_type"]).alias("search_type"), F.lit(s["scorer"] if s["search_type"] == "hybrid" else None).alias("scorer")))
    asked = questions.select("*", F.inline(F.array(*each)))  # every run asks every question
    return evaluate.table_metrics(asked.join(ranked, ["run_id", "query_id"], "left").withColumn("found", F.coalesce("found", empty)))


def parse_config(text: str) -> dict:
    """JSON with comment lines."""
    return json.loads("\n".join(line for line in text.splitlines() if not line.lstrip().startswith("#")))


def variants(overrides: dict | list | None) -> list[dict]:
    """A scorer's settings: a list of sets is taken as it is; a set with lists stands for every combination of their values."""
    if not overrides:
        return [{}]
    if isinstance(overrides, list):
        if not all(isinstance(x, dict) for x in overrides):
            raise ValueError("a list of overrides holds sets of settings")
        return overrides
    lists = {k: v if isinstance(v, list) else [v] for k, v in overrides.items()}
    return [dict(zip(lists, values, strict=True)) for values in itertools.product(*lists.values())]


def expand(matrix: dict) -> list[dict]:
    """One dict a run: modes x search types x dataset forms x scorers x variants(); `common` holds for all. Names may start with `discover_`."""
    modes = matrix.get("modes", ["unified"])
    if "sequential" in modes:
        raise ValueError("sweeps run the unified and the parallel mode")
    plain = lambda settings: {k.removeprefix("discover_"): v for k, v in settings.items()}
    runs = []
    for mode, kind, form in itertools.product(modes, matrix.get("search_types", ["vector"]), matrix.get("dataset_forms", ["single-user"])):
        for scorer in matrix.get("hybrid_scorers", ["RSF"]) if kind == "hybrid" else [None]:
            for own in variants(matrix.get("scorer_overrides", {}).get(scorer) if scorer else None):
                runs.append(plain(matrix.get("common", {})) | {"mode": mode, "search_type": kind, "dataset_form": form, "scorer": scorer} | plain(own))
    return runs


def sweep_frame(spark: SparkSession, matrix: dict) -> DataFrame:
    """The runs as rows, each with an id of its own."""
    runs = expand(matrix)
    keys = sorted({k for r in runs for k in r} - {"mode", "search_type", "dataset_form", "scorer"})
    rows = [(i, r["mode"], r["search_type"], r["dataset_form"], r["scorer"], *[None if r.get(k) is None else float(r[k]) for k in keys]) for i, r in enumerate(runs, 1)]
    return spark.createDataFrame(rows, "run_id long, mode string, search_type string, dataset_form string, scorer string" + "".join(f", `{k}` double" for k in keys))


def result_path(root: str, kind: str, run: dict) -> str:
    """{root}/{kind}/{mode}/{vector or hybrid/SCORER}/{scope}/{name from weights or penalties}."""
    search = "vector" if run["search_type"] == "vector" else f"hybrid/{run['scorer']}"
    knobs = [f"{k}={run[k]:g}" for k in sorted(run) if k.endswith(("weight", "penalty")) and run[k] is not None]
    return "/".join([root, kind, run["mode"], search, run["dataset_form"], "_".join(knobs) or "default"])


def batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """Adds `batch`: rows in blocks of `size` in the given order. Positions come from range partitions, not from one task."""
    at = F.monotonically_increasing_id()
    placed = frozen(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_at", at))
    part, local = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    joined = placed.withColumn("_part", part).join(starts, "_part")
    return joined.withColumn("batch", F.floor((F.col("_start") + local) / size)).drop("_at", "_part", "_start")

"""Models behind interfaces: chat clients for lineage extraction, embedders. No network here; clients are passed in."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import lineage
from lodestone.shipping import ship

#: prompts -> (answer, tokens used) of each
Client = Callable[[list[str]], list[tuple[str, int]]]
PROMPT = 'List the tables and columns that this statement reads, as JSON {{"tables": [{{"name": ..., "columns": [...]}}]}}:\n{sql}'


def salvage(answer: str) -> list[dict] | None:
    """Tables of an answer that holds a JSON object somewhere; names lose quotes, qualifiers and keywords."""
    found = re.search(r"\{.*\}", answer or "", re.S)
    try:
        tables = json.loads(found[0])["tables"] if found else None
    except (ValueError, KeyError, TypeError):
        return None
    clean = lambda x: str(x).strip("`\"[] ").rpartition(".")[2].strip("`\"[]")
    if not isinstance(tables, list):
        return None
    out = []
    for t in tables:
        if isinstance(t, dict) and t.get("name"):
            names = [clean(c["name"] if isinstance(c, dict) else c) for c in t.get("columns", [])]
            out.append({"name": clean(t["name"]), "columns": [{"name": c} for c in sorted(set(names)) if c and c.lower() not in lineage.KEYWORDS]})
    return out or None


def extract_lineage(df: DataFrame, client: Client, sql: str = "SQL", batch: int = 16) -> DataFrame:
    """Adds tables (JSON), method (llm, retry or rule) and tokens. A batch whose answer fails is asked again one by one, then rules decide."""
    ship(df.sparkSession)
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + ", tables string, method string, tokens long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for start in range(0, len(frame), batch):
                statements = frame[sql].iloc[start : start + batch].fillna("").tolist()
                answers = client([PROMPT.format(sql=s) for s in statements])
                for s, (answer, used) in zip(statements, answers, strict=True):
                    tables, method = salvage(answer), "llm"
                    if tables is None:
                        again, more = client([PROMPT.format(sql=s)])[0]
                        tables, method, used = salvage(again), "retry", used + more
                    if tables is None:
                        tables, method = lineage.ground_truth(s), "rule"
                    rows.append((json.dumps(tables), method, used))
            yield frame.assign(tables=[r[0] for r in rows], method=[r[1] for r in rows], tokens=[r[2] for r in rows])

    return df.mapInPandas(run, schema)


def hashed_embedding(text: Column, size: int = 64) -> Column:
    """A deterministic stand-in for a model: signed term counts by hash, in the JVM."""
    terms = T.index_terms(text)
    at = lambda t: F.pmod(F.xxhash64(t), F.lit(size))
    sign = lambda t: F.when(F.pmod(F.shiftright(F.xxhash64(t), 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)
    placed = F.transform(terms, lambda t: F.struct(at(t).alias("at"), sign(t).alias("sign")))
    total = lambda rows, i: F.aggregate(rows, F.lit(0.0), lambda acc, r: acc + F.when(r["at"] == i, r["sign"]).otherwise(0.0))
    return F.get(F.transform(F.array(placed), lambda rows: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: total(rows, i))), F.lit(0))


def embedded(df: DataFrame, model: Callable[[pd.Series], pd.Series], text: str = "text", out: str = "vector") -> DataFrame:
    """Adds a vector column by a model over Arrow batches (for example an ONNX session that the caller loads)."""
    return df.withColumn(out, F.pandas_udf(model, "array<float>")(F.col(text)))

"""Writers: result and summary tables, question files, scripts, and a page that shows a run."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import evaluate, sweep

#: Text of a question in a report, and expected columns listed there.
QUESTION_CHARS, LISTED_COLUMNS = 200, 10


def formatted(df: DataFrame) -> DataFrame:
    """Values as reports print them: four decimals (two for milliseconds), lists joined by |, questions cut."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(name)
        if kind == "double":
            c = F.format_string("%.2f" if name.endswith("_ms") else "%.4f", c)
        elif kind.startswith("array"):
            c = F.array_join(F.slice(c.cast("array<string>"), 1, LISTED_COLUMNS) if name == "expected_columns" else c.cast("array<string>"), "|")
        elif name == "question":
            c = F.substring(c, 1, QUESTION_CHARS)
        out.append(c.alias(name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    formatted(df).write.mode("overwrite").option("header", True).csv(path)


def write_questions(df: DataFrame, path: str) -> None:
    df.drop("difficulty").write.mode("overwrite").json(path)


def write_scripts(df: DataFrame, path: str, statement: str = "statement") -> None:
    df.select(F.concat(F.regexp_replace(statement, r";\s*$", ""), F.lit(";"))).write.mode("overwrite").text(path)


def grade(value: float | None) -> str:
    return "poor" if value is None or value < 0.5 else "fair" if value < 0.8 else "good"


PAGE = """<!doctype html><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif;margin:2em}}td,th{{padding:.2em .7em;border-bottom:1px solid #ccc;text-align:left}}th{{cursor:pointer}}
.good{{background:#e4f5e4}}.fair{{background:#fff6dc}}.poor{{background:#fbe4e4}}.card{{display:inline-block;margin:0 2em 1em 0}}.card b{{display:block;font-size:1.6em}}</style>
<h1>{title}</h1><div id="cards"></div><p><input id="text" placeholder="find"> <select id="db"><option value="">all</option></select></p><table id="rows"></table>
<script>const rows={rows},overall={overall},grade={grade},key={key};let by=null,down=false;
for(const k in overall)cards.insertAdjacentHTML("beforeend",`<span class=card>${{k}}<b>${{overall[k]}}</b></span>`);
for(const d of [...new Set(rows.map(r=>r[key]))].sort())db.add(new Option(d));
function show(){{const names=Object.keys(rows[0]||{{}}),want=text.value.toLowerCase();
const kept=rows.filter(r=>(!db.value||r[key]==db.value)&&JSON.stringify(Object.values(r)).toLowerCase().includes(want));
if(by)kept.sort((a,b)=>(a[by]>b[by]?1:-1)*(down?-1:1));
document.getElementById("rows").innerHTML="<tr>"+names.map(n=>`<th data-n="${{n}}">${{n}}</th>`).join("")+"</tr>"+kept.map(r=>{{
const g=r[grade]>=.8?"good":r[grade]>=.5?"fair":"poor";return `<tr class=${{g}}>`+names.map(n=>`<td>${{String(r[n]??"").replace(/</g,"&lt;")}}</td>`).join("")+"</tr>"}}).join("");
document.querySelectorAll("th").forEach(t=>t.onclick=()=>{{down=by==t.dataset.n&&!down;by=t.dataset.n;show()}})}}
text.oninput=db.onchange=show;show()</script>"""


def dashboard(summary: DataFrame, overall: dict, title: str, key: str = "db_id", grade_by: str = "avg_f1", most: int = 10_000) -> str:
    """A page for a run's summary: one row for each database, so at most `most` rows come to the driver; more is an error."""
    rows = [r.asDict(recursive=True) for r in summary.limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError("a dashboard is for summaries: too many rows")
    safe = lambda x: json.dumps(x, default=str).replace("<", "\\u003c")
    return PAGE.format(title=html.escape(title), rows=safe(rows), overall=safe(overall), grade=safe(grade_by), key=safe(key))


def escaped(c: Column) -> Column:
    """Text that is safe in a page."""
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(sign), F.lit(entity))
    return c


def retrieval_rows(results: DataFrame) -> Column:
    """A table row for each question: names, lists, the values at 3, 5 and 10, the error."""
    shown = []
    for name, kind in results.dtypes:
        c = F.format_string("%.4f", F.col(name)) if kind == "double" else F.array_join(name, ", ") if kind.startswith("array") else F.col(name).cast("string")
        shown.append(F.concat(F.lit("<td>"), F.coalesce(escaped(c), F.lit("")), F.lit("</td>")))
    return F.concat(F.lit("<tr>"), *shown, F.lit("</tr>"))


def write_retrieval_pages(results: DataFrame, path: str, title: str, order: str = "question_id", size: int = 50) -> None:
    """Pages of a retrieval run: path/batches/batch=N has one page for each block of questions, path/full one with the averages.

    results: retrieval_metrics with question_id, error and whatever else is shown. Rows become HTML in Spark; no task holds
    more than a block, and the page with the averages has a link to each block instead of its rows.
    """
    head = lambda t: f'<!doctype html><meta charset="utf-8"><title>{html.escape(t)}</title><h1>{html.escape(t)}</h1>'
    names = "".join(f"<th>{html.escape(c)}</th>" for c in results.columns)
    row = retrieval_rows(results)
    blocks = sweep.batches(results.select(order, row.alias("_row")), order, size).groupBy("batch").agg(F.array_sort(F.collect_list(F.struct(order, "_row"))).alias("_rows"))
    table = F.array_join(F.transform("_rows", lambda r: r["_row"]), "\n")
    page = F.concat(F.lit(head(title)), F.lit(f"<table><tr>{names}</tr>\n"), table, F.lit("</table>"))
    blocks.select("batch", page.alias("value")).write.mode("overwrite").partitionBy("batch").text(f"{path}/batches")
    mean = evaluate.retrieval_averages(results).first()
    cells = "".join(f"<tr><td>{m}</td>" + "".join(f"<td>{mean[f'{c}_at_{k}']:.4f}</td>" for k in evaluate.REPORT_KS) + "</tr>" for m, c in (("precision", "p"), ("recall", "r"), ("F1", "f1")))
    count = -(-mean["questions"] // size)
    top = head(title) + f"<p>{mean['questions']} questions, {mean['failures']} failed</p><table><tr><th></th>" + "".join(f"<th>@{k}</th>" for k in evaluate.REPORT_KS) + f"</tr>{cells}</table>"
    spark = results.sparkSession
    links = spark.range(count).select(F.concat(F.lit('<p><a href="../batches/batch='), F.col("id"), F.lit('">questions of block '), F.col("id"), F.lit("</a></p>")).alias("value"))
    spark.createDataFrame([(top,)], "value string").union(links).coalesce(1).write.mode("overwrite").text(f"{path}/full")

"""Readers that give DataFrames in the engine's shapes."""

from __future__ import annotations

import csv
import io
import re
import sqlite3
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators.dialect import tokenise
from lodestone.shipping import ship

TABLES = "array<struct<name:string,columns:array<struct<name:string>>>>"
QUESTION = f"question_id long, db_id string, question string, evidence string, SQL string, query string, database_name string, tables {TABLES}"


def questions(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Question files, as one JSON list or one object a line, in one shape; missing ids count up within a database from 0."""
    raw = spark.read.schema(QUESTION).option("multiLine", not lines).json(path)
    named = raw.select("question_id", F.coalesce("db_id", "database_name").alias("db_id"), "question", F.coalesce("evidence", F.lit("")).alias("evidence"), F.coalesce("SQL", "query").alias("SQL"), "tables")
    place = F.row_number().over(W.partitionBy("db_id").orderBy(F.monotonically_increasing_id())) - 1
    return named.withColumn("question_id", F.coalesce("question_id", place.cast("long")))


def description_rows(text: str) -> list[tuple]:
    """(column, description, value_description) of one file's text; rows without a name go."""
    clean = lambda row, c: (row.get(c) or "").strip() or None
    csv.field_size_limit(1 << 31)  # cells may be of any length
    rows = csv.DictReader(io.StringIO(text, newline=""))
    return [(name, clean(r, "column_description"), clean(r, "value_description")) for r in rows if (name := clean(r, "original_column_name") or clean(r, "column_name"))]


def descriptions(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Description CSVs: table (from the file's name), column, description, value_description; rows without a name go.

    Without an encoding each file is UTF-8 if it is valid as such, with or without a mark at its start, and Latin-1 otherwise.
    """
    ship(spark)
    raw = F.col("content").cast("string")
    text = F.decode("content", encoding) if encoding else F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode("content", "ISO-8859-1"))
    table = F.regexp_extract("path", r"([^/]+)\.csv$", 1)
    parse = F.udf(description_rows, "array<struct<column_name:string,description:string,value_description:string>>")  # a whole file is one row: no hot path
    files = spark.read.format("binaryFile").load(path).select(table.alias("table_name"), F.regexp_replace(text, "^\ufeff", "").alias("text"))
    return files.select("table_name", F.inline(parse("text")))


def sqlite_schema(spark: SparkSession, path: str) -> DataFrame:
    """(table_name, statement) of a SQLite file's tables, in name order; read by the driver."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        rows = db.execute("SELECT name, sql FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name").fetchall()
    return spark.createDataFrame(rows, "table_name string, statement string")


BODIES = re.compile(r"(CREATE (OR REPLACE )?(PACKAGE|PROCEDURE|FUNCTION|TRIGGER|TYPE)|DECLARE|BEGIN)\b")
SLASH = re.compile(r"\n\s*/\s*$")


def split_script(text: str) -> list[str]:
    """Statements of a script: `;` outside quotes and comments ends one; a line with `/` alone ends a block with a body.

    A statement's first five words tell whether it has a body; what is kept of it besides its tokens is these words and its last tokens.
    """
    out, now, head, block, open_head = [], [], "", False, True

    def close(body: str) -> None:
        nonlocal now, head, block, open_head
        if body.strip():
            out.append(body.strip())
        now, head, block, open_head = [], "", False, True

    for t in tokenise(text):
        if not now and (t.isspace() or t.startswith(("--", "/*"))):
            continue
        now.append(t)
        if open_head:
            head += t
            words = head.split()
            block = bool(BODIES.match(" ".join(words[:5]).upper()))
            open_head = len(words) <= 5
        if t == ";" and not block:
            close("".join(now[:-1]))
        elif block and t.isspace() and "\n" in t and SLASH.search("".join(now[-6:])):
            close(SLASH.sub("", "".join(now)))
    close(SLASH.sub("", "".join(now)))
    return out


def scripts(spark: SparkSession, path: str) -> DataFrame:
    """(path, position, statement) of all scripts under a path."""
    ship(spark)
    split = F.udf(split_script, "array<string>")  # a whole script is one row: no hot path
    files = spark.read.text(path, wholetext=True).withColumn("path", F.input_file_name())
    return files.select("path", F.posexplode(split("value")).alias("position", "statement"))


def json_rows(document: Column, path_type: str, field: str) -> Column:
    """Elements of an array in a JSON document, for posexplode (position + 1 is the ordinality)."""
    return F.from_json(document, path_type)[field]


@dataclass(frozen=True)
class Nested:
    """An array in a JSON document, or in an element of another one: where it is, the columns of its elements, its ordinality, arrays within.

    path: names joined by dots. columns: output name to (path, type); an element that is no object is its own value under the path ``.
    """

    path: str
    columns: dict[str, tuple[str, str]]
    ordinality: str | None = None
    nested: Nested | None = None

    def type(self) -> str:
        """The type of the array, holding what the columns and the arrays within ask for."""
        return f"array<{_json_type(self.columns, self.nested)}>"


def _json_type(columns: dict[str, tuple[str, str]], nested: Nested | None) -> str:
    own = [(p, t) for p, t in columns.values()]
    if any(p == "" for p, _ in own):
        return own[0][1]
    tree: dict = {}
    for path, kind in [*own, *([(nested.path, nested.type())] if nested else [])]:
        at = tree
        *way, last = path.split(".")
        for name in way:
            at = at.setdefault(name, {})
        at[last] = kind
    text = lambda t: t if isinstance(t, str) else "struct<" + ",".join(f"`{k}`:{text(v)}" for k, v in t.items()) + ">"
    return text(tree)


def json_table(df: DataFrame, document: str, columns: dict[str, tuple[str, str]], nested: Nested | None = None) -> DataFrame:
    """Rows of a JSON document beside the frame's other columns: its own values, and a row for each element of nested arrays.

    Elements are numbered from 1 where an ordinality is named. As with an outer join, a document without elements, or that is no JSON,
    gives one row with nulls. The document is parsed once, to the fields that are asked for.
    """
    at = lambda c, path: c.getField(path) if "." not in path else at(c.getField(path.split(".")[0]), path.split(".", 1)[1])
    carried = [c for c in df.columns if c != document]
    rows = df.select(*carried, F.from_json(document, _json_type(columns, nested)).alias("_json"))
    rows = rows.select(*carried, *[at(F.col("_json"), p).alias(n) for n, (p, _) in columns.items()], "_json")
    carried += list(columns)
    while nested is not None:
        rows = rows.select(*carried, F.posexplode_outer(at(F.col("_json"), nested.path)).alias("_at", "_each"))
        own = [(at(F.col("_each"), p) if p else F.col("_each")).alias(n) for n, (p, _) in nested.columns.items()]
        place = [(F.col("_at") + 1).alias(nested.ordinality)] if nested.ordinality else []
        rows = rows.select(*carried, *place, *own, F.col("_each").alias("_json"))
        carried += [*([nested.ordinality] if nested.ordinality else []), *nested.columns]
        nested = nested.nested
    return rows.select(*carried)


MESSAGES = "array<struct<role:string,content:array<struct<type:string,text:string>>>>"
CREATED_NAME = r'(?i)create\s+table\s+(?:(?:"[^"]+"|[\w$]+)\.)?(?:"([^"]+)"|([\w$]+))'


def prompt_dumps(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds `tables`: the name in each text part that creates a table, from the system messages between the first message and the user's.

    A payload is a JSON array of messages, each with a role and an array of typed parts. Names count once, whatever their case; a
    payload that is null or no such array gives none.
    """
    messages = F.slice(F.from_json(payload, MESSAGES), 2, 1_000_000_000)
    asked = F.filter(F.transform(messages, lambda m, i: F.when(F.upper(m["role"]) == "USER", i)), lambda i: i.isNotNull())
    system = F.filter(F.slice(messages, 1, F.coalesce(F.array_min(asked), F.size(messages))), lambda m: F.upper(m["role"]) == "SYSTEM")
    parts = F.filter(F.flatten(F.transform(system, lambda m: F.coalesce(m["content"], F.array()))), lambda p: F.upper(p["type"]) == "TEXT")
    name = lambda p, k: F.regexp_extract(F.coalesce(p["text"], F.lit("")), CREATED_NAME, k)
    names = F.filter(F.transform(parts, lambda p: F.concat(name(p, 1), name(p, 2))), lambda n: n != "")
    once = F.filter(names, lambda n, i: F.array_position(F.transform(names, lambda x: F.lower(x)), F.lower(n)) == i + 1)
    return df.withColumn("tables", F.coalesce(once, F.array().cast("array<string>")))

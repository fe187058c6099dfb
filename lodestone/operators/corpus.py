"""Searchable corpora: catalog introspection, comments, annotations, upserts and denormalised text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as T

SCHEMA = "owner string, object_name string, object_type string, pos int, column_name string, data_type string, comment_text string, annotation string"


def catalog_columns(spark: SparkSession, tables: dict[str, DataFrame], owner: str = "main") -> DataFrame:
    """One row for each column of the given tables, from their schemas alone; comments and annotations from field metadata."""
    rows = [
        (owner, name, "TABLE", i + 1, f.name, f.dataType.simpleString(), f.metadata.get("comment"), f.metadata.get("annotation"))
        for name, df in sorted(tables.items())
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(rows, SCHEMA)


def catalog_tables(spark: SparkSession, hidden: tuple[str, ...] = ("all_%_search_text", "dm$%", "bin$%")) -> DataFrame:
    """Tables and views of the session's catalog, without the engine's own."""
    rows = [(t.name, t.tableType, t.description) for t in spark.catalog.listTables()]
    found = spark.createDataFrame(rows, "object_name string, object_type string, comment_text string")
    for pattern in hidden:
        found = found.where(~F.lower("object_name").like(pattern))
    return found


def object_corpus(columns: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """One row an object, with its column names in order and the text that is searched.

    tables: object_name, comment_text, annotation, one row each, whose texts are searched too.
    """
    names = F.transform(F.array_sort(F.collect_list(F.struct("pos", "column_name"))), lambda x: x["column_name"])
    rows = columns.groupBy("owner", "object_name", "object_type").agg(F.array_join(names, " ").alias("column_summary"))
    fields = ["object_name", "owner", "object_type"]
    if tables is not None:
        rows, fields = rows.join(tables.select("object_name", "comment_text", "annotation"), "object_name", "left"), [*fields, "comment_text", "annotation"]
    return rows.withColumn("search_text", F.concat_ws(" ", *fields, "column_summary"))


def column_corpus(columns: DataFrame) -> DataFrame:
    return columns.where("column_name IS NOT NULL").withColumn("search_text", F.concat_ws(" ", "object_name", "column_name", "data_type", "comment_text", "annotation"))


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of changes replace those of base with the same key; others are added."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes.select(*base.columns))


def replace_group(base: DataFrame, fresh: DataFrame, group: str) -> DataFrame:
    """All rows of the groups that occur in fresh give way to its rows."""
    return base.join(fresh.select(group).distinct(), group, "left_anti").unionByName(fresh.select(*base.columns))


def foreign_key_orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def annotated(df: DataFrame, pairs: str, raw: str, out: str = "annotation") -> DataFrame:
    return df.withColumn(out, T.annotation_text(F.col(pairs), F.col(raw)))


def unified_corpus(columns: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """One row a column with nine fields: its own comment and annotation and those of its table, and the text that is searched.

    tables: object_name, comment_text, annotation, one row each; a table without a row has nulls.
    """
    if tables is None:
        found = columns.withColumns({"table_comment": F.lit(None).cast("string"), "table_annotation": F.lit(None).cast("string")})
    else:
        found = columns.join(tables.select("object_name", F.col("comment_text").alias("table_comment"), F.col("annotation").alias("table_annotation")), "object_name", "left")
    fields = {"owner": "owner", "table_name": "object_name", "column_name": "column_name", "object_type": "object_type", "data_type": "data_type", "column_comment": "comment_text", "column_annotation": "annotation"}
    rows = found.where("column_name IS NOT NULL").select(*[F.col(c).alias(n) for n, c in fields.items()], "table_comment", "table_annotation")
    return rows.withColumn("search_text", F.concat_ws(" ", *rows.columns))


def single_schema(df: DataFrame, db: str, name: str, out: str = "table_name", most: int = 100) -> DataFrame:
    """Tables of many databases in one schema: adds the name with its database before it, cut as identifiers are."""
    return df.withColumn(out, F.upper(T.short_identifier(F.concat_ws("_", db, name), most)))


def own_name(table: Column, db: Column) -> Column:
    """The name without its database; other names stay."""
    return F.when(F.startswith(F.upper(table), F.concat(F.upper(db), F.lit("_"))), F.substring(table, F.length(db) + 2, F.length(table))).otherwise(table)

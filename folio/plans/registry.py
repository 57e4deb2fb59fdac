"""Registry of queries and their SQL, and the base views that both sides start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The base views in the oracle's dialect.
VIEWS = {
    "paras": "select doc_id, i - 1 as para_idx, p[i] as text from (select doc_id, string_split(coalesce(text, ''), chr(10)) as p from documents), unnest(range(1, len(p) + 1)) as t(i)",
    "heads": "select conv_id as doc_id, turn as ord, 1 + length(text) % 3 as level, role, text from conversations",
    "lines": "select l_orderkey as table_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) - 1 as row_idx, l_partkey, l_suppkey from lineitem",
    "cells": """select table_id, row_idx, col_idx, 1 as row_span, case when col_idx = 0 then 1 + l_partkey % 3 else 1 end as col_span,
        case when col_idx = 0 then cast(l_partkey as varchar) when l_suppkey % 10 = col_idx then '' else concat('s', l_suppkey, '|', col_idx) end as text
        from lines, unnest(range(0, 4)) as t(col_idx) where col_idx = 0 or col_idx >= 1 + l_partkey % 3""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(name: str, oracle: str | None = None, views: tuple[str, ...] = ()):
    """Register a query with its oracle, which may use the named base views."""

    def add(f):
        QUERIES[name] = f
        if oracle:
            need = list(dict.fromkeys([*(("lines",) if "cells" in views else ()), *views]))
            body = oracle.strip()
            if need:
                ctes = ", ".join(f"{v} as ({VIEWS[v]})" for v in need)
                body = f"with {ctes}, " + body[5:] if body.lower().startswith("with ") else f"with {ctes} {body}"
            ORACLE_SQL[name] = body
        return f

    return add


def paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, para_idx, text: a document's lines as paragraphs, one empty one where text is null; one scan, no exchange."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("para_idx", "text")).withColumn("para_idx", F.col("para_idx").cast("long"))


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents of paragraphs with a list level."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), (1 + F.length("text") % 3).cast("long").alias("level"), "role", "text")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tables of four columns: the first cell of a row spans one to three."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("table_id"), (F.row_number().over(order) - 1).cast("long").alias("row_idx"), "l_partkey", "l_suppkey")
    span = 1 + F.col("l_partkey") % 3
    each = lines.withColumn("col_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).where((F.col("col_idx") == 0) | (F.col("col_idx") >= span))
    text = F.when(F.col("col_idx") == 0, F.col("l_partkey").cast("string")).when(F.col("l_suppkey") % 10 == F.col("col_idx"), "").otherwise(F.concat(F.lit("s"), "l_suppkey", F.lit("|"), "col_idx"))
    return each.select("table_id", "row_idx", "col_idx", F.lit(1).alias("row_span"), F.when(F.col("col_idx") == 0, span).otherwise(1).cast("long").alias("col_span"), text.alias("text"))

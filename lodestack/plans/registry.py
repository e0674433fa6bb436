"""All queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.common import table, with_language
from lodestack.plans import file_queries, graph_queries, model_queries, more_queries, snapshot_queries

MODULES = (snapshot_queries, file_queries, graph_queries, model_queries, more_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, lines and estimated tokens of the text entries by language."""
    entries = table(spark, sf_dir, "file_entries").where("content is not null").select("entry_id", "language", "path", "line_count", F.length("content").alias("chars")).distinct()
    known = with_language(entries, table(spark, sf_dir, "languages"))
    totals = known.groupBy(F.coalesce("lang", F.lit("unknown")).alias("language")).agg(
        F.count_distinct("entry_id").alias("n_files"), F.sum("line_count").alias("line_count"), F.sum(F.expr("(chars + 3) div 4")).alias("estimated_tokens")
    )
    return totals.orderBy(F.desc("n_files"), "language")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def sql() -> dict[str, str]:
    return {name: text for module in MODULES for name, text in module.SQL.items()}

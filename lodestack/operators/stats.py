"""Statistics over tables of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.common import suffix
from lodestack.functions import languages, paths

NO_SUFFIX = "[no extension]"


def totals(files: DataFrame, by: str) -> DataFrame:
    """Lines and tokens of the exportable files; a null counts as 0."""
    return files.where(exportable()).groupBy(by).agg(F.sum(F.coalesce("line_count", F.lit(0))).alias("total_lines"), F.sum(F.coalesce("estimated_tokens", F.lit(0))).alias("total_tokens"))


def exportable() -> Column:
    return (F.col("text_status") == "text") & F.col("content").isNotNull() & (F.coalesce("status", F.lit("")) != "error")


def counts(files: DataFrame, by: str) -> DataFrame:
    """Tracked, exported, binary and faulty files in one pass."""
    return files.groupBy(by).agg(
        F.count("*").alias("tracked"), F.count_if(exportable()).alias("exported"), F.count_if(F.col("text_status") == "binary").alias("binary"), F.count_if(F.col("status") == "error").alias("faulty")
    )


def file_types(files: DataFrame) -> DataFrame:
    """Files by lower-cased suffix."""
    dotted = F.concat(F.lit("."), suffix(F.col("path")))
    return files.groupBy(F.coalesce(dotted, F.lit(NO_SUFFIX)).alias("file_type")).agg(F.count("*").alias("n_files"))


def model_summary(files: DataFrame, by: str) -> DataFrame:
    """Included, skipped (or binary) files and the number of types, where a file without suffix is a type by its name."""
    kind = F.coalesce(F.concat(F.lit("."), suffix(F.col("path"))), paths.name(F.col("path")))
    return files.groupBy(by).agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("status") == "included").alias("exported_files"),
        F.count_if((F.col("status") == "skipped") | (F.col("text_status") == "binary")).alias("skipped_files"),
        F.count_distinct(kind).alias("n_types"),
    )


def primary_language(files: DataFrame, by: str, language: str = "lang") -> DataFrame:
    """The commonest language of each group; ties go to the least name."""
    per = files.where(F.col(language).isNotNull()).groupBy(by, language).agg(F.count("*").alias("n"))
    return per.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("minus"), F.col(language).alias("name"))).alias("m")).select(by, F.col("m.name").alias("primary_language"), (-F.col("m.minus")).alias("n_files"))


def language_summary(files: DataFrame, language: str = "lang") -> DataFrame:
    """Files, lines and tokens by display name."""
    return files.groupBy(languages.display_name(F.col(language)).alias("display_name")).agg(
        F.count("*").alias("n_files"), F.sum(F.coalesce("line_count", F.lit(0))).alias("total_lines"), F.min("path").alias("first_path"), F.max("path").alias("last_path")
    )


def documentation_counts(files: DataFrame, by: str) -> DataFrame:
    """Documentation files by category, with zeros, in the fixed order of the categories."""
    spark = files.sparkSession
    order = spark.createDataFrame([(i, c) for i, c in enumerate(paths.CATEGORIES)], "position int, category string")
    docs = files.where(paths.is_documentation(F.col("path"))).select(by, paths.documentation_category(F.col("path")).alias("category"))
    groups = docs.groupBy(by, "category").agg(F.count("*").alias("n"))
    every = files.select(by).distinct().crossJoin(F.broadcast(order))  # seven categories
    return every.join(groups, [by, "category"], "left").select(by, "position", "category", F.coalesce("n", F.lit(0)).alias("n_files"))


def warning_counts(files: DataFrame) -> DataFrame:
    """Rows with a reason by status and reason, without one under 'uncategorized'."""
    return files.where("status <> 'included'").groupBy("status", F.coalesce("reason", F.lit("uncategorized")).alias("code")).agg(F.count("*").alias("n_warnings"), F.count_distinct("path").alias("n_paths"))


def grouping_sets(files: DataFrame, language: str = "lang") -> DataFrame:
    """Files by language and status, by each alone, and in all (an extension: grouping sets)."""
    return files.cube(language, "status").agg(F.count("*").alias("n_files"), F.grouping_id().cast("int").alias("level"))


def disambiguated(names: DataFrame, name: str, order: str) -> DataFrame:
    """Unique ids ``base``, ``base-2``, ... in the order of ``order``; the base is the name in lower case with dashes."""
    base = F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "-")
    n = F.row_number().over(Window.partitionBy("base").orderBy(order))
    return names.withColumn("base", base).withColumn("n", n).withColumn("unique_id", F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string"))))

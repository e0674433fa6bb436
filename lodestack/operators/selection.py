"""Selection of files, limits on them, and the texts that replace what a limit cuts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import paths, text

LINE_NOTICE = "[... {n} more lines are left out ...]"
SIZE_NOTICE = "[content left out: larger than the limit]"
BYTE_NOTICE = "\n[cut at the size limit]\n"


def within_size(size: Column, limit: Column | int | None) -> Column:
    """A null size or no limit passes."""
    if limit is None:
        return F.lit(True)
    limit = limit if isinstance(limit, Column) else F.lit(limit)
    return size.isNull() | limit.isNull() | (size <= limit)


def first_files(files: DataFrame, by: str, most: int, order: str = "path") -> DataFrame:
    """The first ``most`` files of each group, with the number of all and of those left out; see ``capped``."""
    return capped(files, [by], [order, "entry_id"], most, "omitted")


def select_and_limit(files: DataFrame, by: str, most: int, rule: Column) -> DataFrame:
    """How many files a selection takes, leaves out, and drops for the limit, per group."""
    chosen = files.withColumn("chosen", rule)
    per = chosen.groupBy(by).agg(F.count("*").alias("scanned"), F.count_if("chosen").alias("selected"))
    return per.select(by, "scanned", (F.col("scanned") - F.col("selected")).alias("filtered"), F.least(F.col("selected"), F.lit(most)).alias("kept"), F.greatest(F.col("selected") - most, F.lit(0)).alias("over_limit"))


def limited_content(content: Column, size: Column, most_bytes: int, most_lines: int) -> Column:
    """The content, its first lines and a notice, or only a notice."""
    more = text.omitted_lines(content, most_lines)
    first, last = LINE_NOTICE.split("{n}")
    cut = F.concat(text.head_lines(content, most_lines), F.lit(first), more.cast("string"), F.lit(last))
    return F.when(~within_size(size, most_bytes), F.lit(SIZE_NOTICE)).when(more > 0, cut).otherwise(content)


def status_group(status: Column, text_status: Column) -> Column:
    """Truncated, omitted (skipped, faulty or binary) or included."""
    return F.when(status == "truncated", "truncated").when(status.isin("skipped", "error") | (text_status == "binary"), "omitted").otherwise("included")


def entry_status(text_status: Column, error: Column, content: Column) -> Column:
    """Error before binary before unreadable before included."""
    return F.when(error.isNotNull(), "error").when(text_status == "binary", "skipped").when(content.isNull(), "skipped").otherwise("included")


def documentation_only(files: DataFrame) -> DataFrame:
    return files.where(paths.is_documentation(F.col("path")))


def capped(rows: DataFrame, by: list[str], order: list[str], most: int, more: str = "more") -> DataFrame:
    """The first ``most`` rows of each group with ``place`` and, on each, how many more there are (a display cap).

    Ranks have a limit per group before the shuffle, and numbers of rows are aggregated, so that no hot group is sorted whole.
    """
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= most)
    key = [F.col(c).alias(f"__{c}") for c in by]
    counts = rows.groupBy(*key).agg(F.greatest(F.count("*") - most, F.lit(0)).alias(more))
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    return first.join(counts, same).drop(*[f"__{c}" for c in by])

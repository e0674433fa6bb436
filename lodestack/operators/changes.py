"""Changed files: status lines, selections, counts; sets of paths; merges of warnings and settings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.common import few


def porcelain(line: Column) -> Column:
    """A status line as a struct: path, status, whether untracked or deleted; null for blank and too short lines.

    Deleted before renamed before added before modified; a renamed file has its new path.
    """
    letters, rest = F.substring(line, 1, 2), F.substring(line, 4, 100_000)
    path = F.element_at(F.split(rest, " -> "), -1)
    untracked = letters == "??"
    status = F.when(untracked, "untracked").when(letters.contains("D"), "deleted").when(letters.contains("R"), "renamed").when(letters.contains("A"), "added").otherwise("modified")
    made = F.struct(path.alias("path"), status.alias("status"), untracked.alias("is_untracked"), (~untracked & letters.contains("D")).alias("is_deleted"))
    return F.when((F.length(line) >= 4) & (F.trim(line) != ""), made)


def name_status(line: Column) -> Column:
    """A tab-separated line of names and statuses as a struct: path (the last field) and status by the first letter."""
    fields = F.split(line, "\t")
    letter = F.substring(F.get(fields, F.lit(0)), 1, 1)
    status = F.when(letter == "D", "deleted").when(letter == "A", "added").when(letter == "R", "renamed").otherwise("modified")
    return F.when(F.size(fields) >= 2, F.struct(F.element_at(fields, -1).alias("path"), status.alias("status"), (letter == "D").alias("is_deleted")))


def last_of_each(changes: DataFrame, order: str, key: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in changes.columns if c not in (*key, order)]
    last = changes.groupBy(*key).agg(F.max(F.struct(order, *rest)).alias("last"))
    return last.select(*key, *[F.col("last")[c].alias(c) for c in rest])


def with_scans(changes: DataFrame, files: DataFrame, key: list[str]) -> DataFrame:
    """Changes with the columns of their file; all null for deleted and vanished ones."""
    own = [c for c in files.columns if c not in key]
    joined = changes.join(files, key, "left")
    return joined.select(*changes.columns, *[F.when(~F.col("is_deleted"), F.col(c)).alias(c) for c in own])


def status_counts(changes: DataFrame) -> DataFrame:
    """One row: all changes and those of each status."""
    counts = [F.count_if(F.col("status") == s).alias(s) for s in ("modified", "added", "deleted", "renamed", "untracked")]
    return changes.agg(F.count("*").alias("total"), *counts)


def selections(scans: DataFrame, has_file: Column) -> DataFrame:
    """Changed files with the sections of a report that show them: ``diffable, text, deleted, skipped``.

    Scans need ``is_deleted`` and ``is_binary``; ``has_file`` tells whether the file could be read.
    """
    gone, binary = F.col("is_deleted"), F.coalesce("is_binary", F.lit(False))
    return scans.withColumns({"diffable": ~gone & ~binary, "text": ~gone & ~binary & has_file, "deleted": gone, "skipped": binary | (~gone & ~has_file)})


def path_sets(old: DataFrame, new: DataFrame) -> DataFrame:
    """``path, side``: 'added', 'removed' or 'kept', from one aggregation over both sides."""
    sides = old.select("path", F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select("path", F.lit(0).alias("o"), F.lit(1).alias("n")))
    seen = sides.groupBy("path").agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return seen.select("path", F.when(F.col("o") == 0, "added").when(F.col("n") == 0, "removed").otherwise("kept").alias("side"))


def consecutive_path_sets(rows: DataFrame, group: str, seq: str, key: str) -> DataFrame:
    """``group, seq, key, side`` of the keys of each snapshot and the one before it in its group; the first has none to compare with.

    Every key is told to its own comparison and to that of the next snapshot; one aggregation gives the side.
    """
    order = Window.partitionBy(group).orderBy(seq)
    steps = few(rows.select(group, seq).distinct().withColumn("earlier", F.lag(seq).over(order)).withColumn("next", F.lead(seq).over(order)))
    told = rows.join(steps, [group, seq]).select(group, key, F.inline(F.array(F.struct(F.when(F.col("earlier").isNotNull(), F.col(seq)).alias("at"), F.lit(0).alias("o"), F.lit(1).alias("n")), F.struct(F.col("next").alias("at"), F.lit(1).alias("o"), F.lit(0).alias("n")))))
    seen = told.where("at is not null").groupBy(group, "at", key).agg(F.max("o").alias("o"), F.max("n").alias("n"))
    return seen.select(group, F.col("at").alias(seq), key, F.when(F.col("o") == 0, "added").when(F.col("n") == 0, "removed").otherwise("kept").alias("side"))


def known_files(groups: list[DataFrame], key: list[str]) -> DataFrame:
    """One row for each key of several groups; of several the one of the earlier group."""
    columns = [c for c in groups[0].columns if c not in key]
    united = None
    for priority, group in enumerate(groups):
        one = group.withColumn("priority", F.lit(priority))
        united = one if united is None else united.unionByName(one)
    best = united.groupBy(*key).agg(F.min(F.struct("priority", *columns)).alias("b"))
    return best.select(*key, F.col("b.priority").alias("priority"), *[F.col("b")[c].alias(c) for c in columns])


def merged_warnings(warnings: DataFrame, order: str) -> DataFrame:
    """Warnings once per path, code and message; the last one's other columns stay."""
    return last_of_each(warnings, order, ["path", "code", "message"])


def merged_settings(first: Column, second: Column) -> Column:
    """Two arrays of rules as one, sorted and without repeats."""
    return F.array_sort(F.array_union(F.coalesce(first, F.array().cast("array<string>")), F.coalesce(second, F.array().cast("array<string>"))))

"""``python -m lodestack MODE FOLDER OUT``: the report of one folder or Git repository."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestack.common import ship
from lodestack.functions import paths
from lodestack.operators import rendering, sinks
from lodestack.sources import folder, git, settings


def files_of(spark: SparkSession, root: str):
    """The files of a folder in the form that reports need, chosen by its settings."""
    chosen = settings.load(root)
    listed = git.tracked_files(spark, root) if git.repository_root(root) else None
    scanned = folder.scan(spark, root, listed).where(paths.selected(F.col("path"), chosen.include.paths, chosen.include.globs, chosen.exclude.paths, chosen.exclude.globs))
    if chosen.max_total_files:
        scanned = scanned.orderBy("position" if "position" in scanned.columns else "path").limit(chosen.max_total_files)
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("is_binary"), "skipped").otherwise("included")
    return scanned.select(F.lit(root).alias("repository"), "path", "language", "content", "line_count", "size_bytes", F.when(F.col("is_text"), "text").otherwise("binary").alias("text_status"), status.alias("status")), chosen


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lodestack", description="Reports of a folder of files.")
    parser.add_argument("mode", choices=rendering.MODES)
    parser.add_argument("folder")
    parser.add_argument("out")
    parser.add_argument("--against", help="the branch that the changed report compares with")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("lodestack").getOrCreate()
    ship(spark)
    files, chosen = files_of(spark, given.folder)
    changes = git.changed_files(spark, given.folder, given.against).withColumn("repository", F.lit(given.folder)) if given.mode == "changed" else None
    row = rendering.render(files, "repository", given.mode, chosen.max_export_bytes, changes).first()
    body = row.text if row else ""
    if chosen.split:
        sinks.write_parts(given.out, body, chosen.split_max_chars)
    else:
        sinks.write_text(given.out, body)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())

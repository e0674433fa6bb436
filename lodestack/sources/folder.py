"""Folders of files as tables of metadata rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import languages, paths, text

PROBE = 1024


def scan(spark: SparkSession, root: str, listed: DataFrame | Sequence[str] | None = None, probe: int | None = None) -> DataFrame:
    """One row per file below ``root``: path, size, kind, language, lines, tokens, content, error.

    ``listed`` (a table with ``path``, or paths) limits the scan to those that exist and keeps their order in ``position``.
    ``probe`` tells text by its first bytes only, as a quick scan does; by default whole files are looked at. Faults are
    values of ``error``, never exceptions.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # Spark's reader passes over files without bytes; its listing, which is on the driver anyway, has them
    listing = spark.createDataFrame([(p,) for p in raw.inputFiles()], "url string")
    base = F.lit(root.rstrip("/") + "/")

    def plain(url: str) -> Column:
        return F.regexp_replace(F.url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")

    read = raw.select(plain("path").alias("full"), F.col("length").alias("size_bytes"), "content")
    found = listing.select(plain("url").alias("full")).join(read, "full", "left")
    empty = F.unhex(F.lit(""))
    rows = found.select(F.substr("full", F.length(base) + 1).alias("path"), F.coalesce("size_bytes", F.lit(0)).alias("size_bytes"), F.coalesce("content", empty).alias("content"))
    rows = rows.where(~F.col("path").startswith(".git/"))
    if listed is not None:
        wanted = listed.select("path") if isinstance(listed, DataFrame) else spark.createDataFrame([(i, p) for i, p in enumerate(listed)], "position int, path string")
        rows = rows.join(wanted.dropDuplicates(["path"]), "path")
    readable = text.is_utf8_text(F.col("content"), probe)
    nul = text.has_nul(F.col("content"), PROBE)
    body = F.when(readable & ~nul, text.universal(F.decode(F.make_valid_utf8(F.col("content").cast("string")).cast("binary"), "UTF-8")))
    made = rows.withColumn("is_text", readable & ~nul).withColumn("is_binary", nul | ~readable).withColumn("text", body)
    language = F.when(F.col("is_text"), languages.detected(F.col("path"), F.col("text"))).otherwise(F.coalesce(languages.by_suffix(F.col("path")), languages.by_name(F.col("path"))))
    kept = [c for c in ("position",) if c in made.columns]
    return made.select(
        *kept, "path", "size_bytes", "is_text", "is_binary", language.alias("language"), text.line_count(F.col("text")).alias("line_count"), text.empty_line_count(F.col("text")).alias("empty_line_count"),
        text.tokens_up(F.col("text")).alias("estimated_tokens"), F.col("text").alias("content"), F.when(~readable, "unable to decode").alias("error"),
    )


def schema_files(files: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Files that may hold a database schema: SQL by suffix or folder, SQLite by suffix (and its magic header, where bytes are given)."""
    low = F.lower("path")
    sql = low.rlike(r"\.(?:sql|ddl)$") | low.rlike(r"(?:^|/)(?:migrations|schema|sql)/")
    sqlite = low.rlike(r"\.(?:db|sqlite|sqlite3|db3)$")
    kinds = files.withColumn("schema_kind", F.when(sqlite, "sqlite").when(sql, "sql")).where("schema_kind is not null")
    if raw is None:
        return kinds
    magic = raw.select("path", (F.substring("content", 1, 16) == F.unhex(F.lit("53514C69746520666F726D6174203300"))).alias("has_magic"))
    return kinds.join(magic, "path", "left").withColumn("warning", F.when((F.col("schema_kind") == "sqlite") & ~F.coalesce("has_magic", F.lit(False)), "not a SQLite database"))


def dependency_files(files: DataFrame) -> DataFrame:
    """Project and requirement files by name."""
    name = F.lower(paths.name(F.col("path")))
    project = name == "pyproject.toml"
    requirement = name.isin("requirements.txt", "requirements-dev.txt", "dev-requirements.txt", "test-requirements.txt") | name.rlike(r"^requirements[-_].*\.txt$") | name.rlike(r"-requirements\.txt$") | F.lower("path").rlike(r"(?:^|/)requirements/[^/]*\.txt$")
    return files.withColumn("dependency_kind", F.when(project, "pyproject").when(requirement, "requirements")).where("dependency_kind is not null")

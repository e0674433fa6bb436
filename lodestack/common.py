"""Session, storage and schema helpers shared by every operator."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of ``spark`` (once per application)."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
        for path in sorted(ROOT.rglob("*.py")):
            archive.write(path, str(Path(ROOT.name) / path.relative_to(ROOT)))
    target = os.path.join(tempfile.mkdtemp(prefix="lodestack-"), f"{ROOT.name}.zip")
    Path(target).write_bytes(buffer.getvalue())
    spark.sparkContext.addPyFile(target)  # served by the driver to every executor
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or, in local mode only, one of our own where that is unset."""
    context = spark.sparkContext
    jdir = context._jsc.sc().getCheckpointDir()
    if jdir.isDefined():
        return jdir.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="lodestack-checkpoint-")
    context.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared folder, so that a lost executor costs nothing before this point."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Up to so many rows of some numbers are broadcast (about 1 MB).
FEW_ROWS = 20_000


def few(df: DataFrame) -> DataFrame:
    """``df``, which holds some numbers a row, computed once, and broadcast if it has at most ``FEW_ROWS`` rows."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def default_parallelism(spark: SparkSession) -> int:
    return max(2, spark.sparkContext.defaultParallelism)


def suffix(path: Column) -> Column:
    """Lower-cased text after the last dot of the last path part; null if there is none (a leading dot is no suffix)."""
    name = F.regexp_extract(path, r"([^/\\]*)$", 1)
    found = F.regexp_extract(name, r"[^.]\.([^.]+)$", 1)
    return F.when(found != "", F.lower(found))


def with_language(df: DataFrame, languages: DataFrame, out: str = "lang", language: str = "language", path: str = "path") -> DataFrame:
    """Adds ``out``, the language that ``languages`` gives for the trimmed, lower-cased ``language``, or, where that is
    null, for the suffix of ``path``; null if neither is known.

    ``languages`` is the small alias table; repeated aliases count once (least language). Spark broadcasts it by its size.
    """
    alias = languages.where("alias is not null").groupBy(F.lower(F.trim("alias")).alias("__alias")).agg(F.min("language").alias(out))
    key = F.coalesce(F.lower(F.trim(F.col(language))), suffix(F.col(path)))
    return df.withColumn("__key", key).join(alias, F.col("__key") == F.col("__alias"), "left").drop("__key", "__alias")

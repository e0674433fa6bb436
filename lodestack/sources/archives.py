"""Archives, databases and models that lie in files."""

from __future__ import annotations

import io
import sqlite3
import zipfile
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 8192


def safe_name(name: str) -> str | None:
    """The name of an archive's member, or None if it would leave the archive's folder."""
    parts = PurePosixPath(name.replace("\\", "/"))
    return None if parts.is_absolute() or ".." in parts.parts or not parts.parts or name.endswith("/") else str(parts)


def zip_members(archives: DataFrame, key: str = "path") -> DataFrame:
    """``key, member, size_bytes, sample, error`` of every file in ZIP archives given as bytes in ``content``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k, content in zip(batch[key], batch["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as archive:
                        for info in archive.infolist():
                            if (name := safe_name(info.filename)) is not None:
                                with archive.open(info) as member:
                                    rows.append((k, name, info.file_size, member.read(SAMPLE), None))
                            elif not info.is_dir():
                                rows.append((k, info.filename, None, None, "leaves the archive"))
                except (zipfile.BadZipFile, OSError, RuntimeError) as error:
                    rows.append((k, None, None, None, str(error)))
            out = pd.DataFrame(rows, columns=[key, "member", "size_bytes", "sample", "error"])
            out["size_bytes"] = out["size_bytes"].astype("Int64")
            yield out

    return archives.where("content is not null").select(key, "content").mapInPandas(run, f"{key} string, member string, size_bytes long, sample binary, error string")


COLUMNS = "table_name string, table_type string, position int, column_name string, data_type string, nullable boolean, default_value string, pk_position int, error string"


def _columns_of(content: bytes) -> list[tuple]:
    out: list[tuple] = []
    base = sqlite3.connect(":memory:")
    try:
        base.deserialize(bytes(content))  # nothing is written to a disk
        tables = base.execute("select name, type, sql from sqlite_master where type in ('table', 'view') and name not like 'sqlite\\_%' escape '\\' order by name").fetchall()
        for table, kind, sql in tables:
            label = "virtual" if (sql or "").lower().startswith("create virtual") else kind
            quoted = '"' + table.replace('"', '""') + '"'
            for cid, column, data_type, notnull, default, pk in base.execute(f"pragma table_info({quoted})"):
                out.append((table, label, cid, column, data_type or None, not notnull, default, pk, None))
    except sqlite3.DatabaseError as error:
        out = [(None, None, None, None, None, None, None, None, str(error))]
    finally:
        base.close()
    return out


def sqlite_columns(files: DataFrame, key: str = "path") -> DataFrame:
    """Tables, views and their columns of SQLite databases given as bytes in ``content``; never any of their rows."""
    names = [key, *(c.split()[0] for c in COLUMNS.split(", "))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *row) for k, content in zip(batch[key], batch["content"], strict=True) for row in _columns_of(content)]
            out = pd.DataFrame(rows, columns=names)
            for column in ("position", "pk_position"):
                out[column] = out[column].astype("Int32")
            yield out

    return files.where("content is not null").select(key, "content").mapInPandas(run, f"{key} string, {COLUMNS}")


def entries_from_json(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of a model given as JSON, one a line; a row without a path is an error of the query."""
    parsed = lines.select(F.from_json(column, schema, {"mode": "FAILFAST"}).alias("e")).select("e.*")
    return parsed.withColumn("path", F.when(F.col("path").isNull(), F.raise_error(F.lit("an entry without a path"))).otherwise(F.col("path")))

"""Reports written as files. Texts that are one report are joined on the driver; tables are written by Spark."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions import text
from lodestack.operators import masking, report


def write_text(path: str, body: str) -> None:
    """Replaces the file at once: a hidden sibling is written and renamed."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(prefix=f".{target.name}.", dir=target.parent)
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as file:
            file.write(body)
        os.replace(name, target)
    except BaseException:
        os.unlink(name)
        raise


def write_ordered(path: str, rows: DataFrame, text_column: str = "section", separator: str = "\n\n") -> int:
    """Writes the rows of one report in the order of ``place``, partition by partition; returns their number. The text is never held whole."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(prefix=f".{target.name}.", dir=target.parent)
    n = 0
    try:
        with os.fdopen(handle, "w", encoding="utf-8", newline="\n") as file:
            for row in rows.select(text_column, "place").orderBy("place").toLocalIterator():
                file.write((separator if n else "") + (row[0] or ""))
                n += 1
        os.replace(name, target)
    except BaseException:
        os.unlink(name)
        raise
    return n


def write_parts(path: str, body: str, most: int) -> list[str]:
    """The file and, if it is longer than ``most`` characters, its parts; parts of an earlier, longer text are removed."""
    target = Path(path)
    chunks = [body[i : i + most] for i in range(0, len(body), most)] or [""]
    width = max(2, len(str(len(chunks))))
    names = [str(target.with_name(f"{target.stem}.part{k:0{width}d}{target.suffix}")) for k in range(1, len(chunks) + 1)] if len(chunks) > 1 else []
    for old in target.parent.glob(f"{target.stem}.part*{target.suffix}"):
        if str(old) not in names:
            old.unlink()
    write_text(path, body)
    for k, name in enumerate(names):
        write_text(name, f"[part {k + 1} of {len(names)} of {target.name}]\n{chunks[k]}")
    return [path, *names]


def full_report(files: DataFrame, by: str, limit_bytes: int | None = None) -> DataFrame:
    """One text per group: an overview, then every file in a fence; masks and the byte limit come last, over the whole text."""
    body = F.concat(F.lit("## "), F.col("path"), F.lit("\n\n"), text.fence(F.col("content")), F.coalesce("language", F.lit("text")), F.lit("\n"), "content", F.lit("\n"), text.fence(F.col("content")))
    rows = files.where("content is not null").withColumn("section", body)
    counts = files.groupBy(by).agg(F.lit("").alias("path"), F.concat(F.lit("# Repository\n\n- files: "), F.count("*").cast("string")).alias("section"))
    texts = report.assembled(rows.select(by, "path", "section").unionByName(counts), by, ["path"], "section")
    masked = masking.masked_text(F.col("text"))
    out = texts.select(by, masked.alias("text"))
    return out.select(by, text.limited(F.col("text"), limit_bytes, "\n[cut at the size limit]\n").alias("text")) if limit_bytes else out


def write_json(entries: DataFrame, path: str) -> None:
    """Rows as JSON lines with their keys in alphabetical order and nulls kept."""
    entries.select(F.to_json(F.struct(*sorted(entries.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)


def write_dossier(path: str, members: dict[str, str]) -> None:
    """A ZIP of texts with a manifest; an existing file is never overwritten."""
    if os.path.exists(path):
        raise FileExistsError(path)
    handle, name = tempfile.mkstemp(prefix=".dossier-", dir=os.path.dirname(os.path.abspath(path)))
    os.close(handle)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as archive:
        archive.writestr("MANIFEST.txt", "\n".join(f"{n}\t{len(b.encode())}" for n, b in sorted(members.items())) + "\n")
        for member, body in sorted(members.items()):
            archive.writestr(member, body)
    os.replace(name, path)


def missing_ignores(existing: str, required: list[str]) -> list[str]:
    """The required lines of an ignore file that it doesn't have."""
    have = {line.strip() for line in existing.splitlines()}
    return [r for r in required if r not in have]


def write_ignores(path: str, required: list[str]) -> bool:
    """Adds what is missing; false if nothing was."""
    file = Path(path)
    existing = file.read_text("utf-8") if file.exists() else ""
    if not (more := missing_ignores(existing, required)):
        return False
    write_text(path, existing + ("" if not existing or existing.endswith("\n") else "\n") + "\n".join(more) + "\n")
    return True


def write_model(text: str, target) -> None:
    """A rendered report to a path or to an open stream."""
    if hasattr(target, "write"):
        target.write(text)
    else:
        write_text(str(target), text)


def summary_lines(title: str, counts: DataFrame) -> list[str]:
    """A one-row table of counts as lines for the console."""
    row = counts.first()
    return [f"{title}:", *(f"  {name.replace('_', ' ')}: {value:,}" if isinstance(value, int) else f"  {name.replace('_', ' ')}: {value}" for name, value in (row.asDict() if row else {}).items())]

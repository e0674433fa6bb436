"""The life of an export model: rows are made, finalized, checked for readiness, and tried out on a built-in export."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.text import tokens_up
from lodestack.operators import changes, graph, model, selection, stats

# Titles of modes, whether a report of the mode holds texts, whether it is for reviews.
MODES = {"full": ("Full Repository Export", True, False), "ai": ("AI Repository Export", False, False), "docs": ("Documentation Export", True, False), "changed": ("Changed Files Export", True, True)}
# The files that a section shows.
SECTION_FILES = {
    **dict.fromkeys(("source_export", "document_export", "important_files", "documentation_files", "changed_file_contents"), "included"),
    **dict.fromkeys(("file_summary", "changed_files_summary"), "known"),
    "truncated_files": "truncated",
    **dict.fromkeys(("omitted_files", "deleted_files"), "omitted"),
}
ENTRY = "entry_id long, export_id long, path string, language string, size_bytes long, line_count long, estimated_tokens long, text_status string, status string, content string, masked_content string, reason string"


def normalized_section(name: Column) -> Column:
    """Lower case with single underscores; null for an empty name."""
    return F.nullif(F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[-\s_]+", "_"), "^_|_$", ""), F.lit(""))


def section_title(name: Column) -> Column:
    return F.initcap(F.replace(normalized_section(name), F.lit("_"), F.lit(" ")))


def mode_flags(mode: Column) -> Column:
    """``mode, title, holds_texts, for_review`` of a mode in any spelling; null for an unknown one."""
    normal = F.replace(F.lower(F.trim(mode)), F.lit("-"), F.lit("_"))
    out = F.lit(None)
    for name, (title, texts, review) in MODES.items():
        out = F.when(normal == name, F.struct(F.lit(name).alias("mode"), F.lit(title).alias("title"), F.lit(texts).alias("holds_texts"), F.lit(review).alias("for_review"))).otherwise(out)
    return out


def files_for_section(entries: DataFrame, section: str, scope: str = "export_id") -> DataFrame:
    """The entries that a section shows: included ones, truncated ones, omitted ones, or all known paths once; none for other sections."""
    shown = SECTION_FILES.get("_".join(section.strip().lower().replace("-", " ").replace("_", " ").split()))
    group = selection.status_group(F.col("status"), F.col("text_status"))
    if shown == "known":
        groups = [entries.where(group == g) for g in ("included", "truncated", "omitted")]
        return changes.known_files(groups, [scope, "path"]).drop("priority").select(*entries.columns)
    return entries.where(group == shown) if shown else entries.where("false")


class Finalized(NamedTuple):
    summary: DataFrame
    tree: DataFrame
    issues: DataFrame


def finalized(entries: DataFrame, scope: str = "export_id") -> Finalized:
    """Summary, tree and issues derived anew from the entries. Entries without a path are issues and have no place in the tree."""
    return Finalized(stats.model_summary(entries, scope), graph.tree_rows(entries.where("path is not null and trim(path) <> ''"), scope), model.issues(entries, scope=scope))


def fingerprint(entries: DataFrame, scope: str = "export_id") -> DataFrame:
    """``scope, fingerprint``: a digest of the digests of all entries in the order of their paths; texts stay where they are."""
    row = F.sha2(F.concat_ws("\x1f", "path", *[F.coalesce(c, F.lit("")) for c in ("language", "status", "content")]), 256)
    ordered = F.array_sort(F.collect_list(F.struct("path", "entry_id", row.alias("row"))))
    return entries.groupBy(scope).agg(F.sha2(F.array_join(F.transform(ordered, lambda r: r["row"]), ""), 256).alias("fingerprint"))


def readiness(entries: DataFrame, exports: DataFrame, tokens: Column | None = None) -> DataFrame:
    """``export_id, ready, n_contract, n_audit``: ready is an export whose entries break no rule and whose summary agrees with them.

    ``tokens`` counts an entry's tokens where its text isn't among the columns.
    """
    broken = model.issues(entries).join(entries.select("entry_id", "export_id").distinct(), "entry_id").groupBy("export_id").agg(F.count("*").alias("n_contract"))
    audited = model.audit(entries.withColumn("tokens", tokens if tokens is not None else tokens_up(F.col("content"))), exports)
    n_audit = F.when(F.col("tracked_agrees"), 0).otherwise(1) + F.when(F.col("tokens_agree"), 0).otherwise(1)
    joined = audited.join(broken, "export_id", "left").select("export_id", F.coalesce("n_contract", F.lit(0)).alias("n_contract"), n_audit.cast("long").alias("n_audit"))
    return joined.withColumn("ready", (F.col("n_contract") == 0) & (F.col("n_audit") == 0))


def entry_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Entries from dictionaries; what a row leaves out is derived from its content."""
    made = []
    for place, row in enumerate(rows, 1):
        text = row.get("content")
        derived = {
            "entry_id": place, "export_id": 1, "text_status": "binary" if text is None else "text", "status": "skipped" if text is None else "included",
            "size_bytes": None if text is None else len(text.encode()), "line_count": None if text is None else len(text.splitlines()), "estimated_tokens": None if text is None else -(-len(text) // 4),
        }
        made.append({**derived, **row})
    names = [field.split()[0] for field in ENTRY.split(", ")]
    return spark.createDataFrame([tuple(row.get(name) for name in names) for row in made], ENTRY)


def export_row(spark: SparkSession, entries: DataFrame, export_id: int = 1, **fields) -> DataFrame:
    """The row of ``exports`` that agrees with ``entries``."""
    real = entries.agg(F.count("*").alias("total_tracked_files"), F.coalesce(F.sum(tokens_up(F.col("content"))), F.lit(0)).alias("estimated_tokens"))
    return real.select(F.lit(export_id).cast("long").alias("export_id"), "total_tracked_files", "estimated_tokens", *[F.lit(v).alias(k) for k, v in fields.items()])


def self_test(spark: SparkSession) -> DataFrame:
    """``check, passed`` over a built-in export of four files: it is finalized, ready, stable, and comes back from JSON."""
    entries = entry_rows(
        spark,
        [
            {"path": "README.md", "language": "markdown", "content": "# Demo\n"},
            {"path": "src/demo/app.py", "language": "python", "content": "def f():\n    return 1\n"},
            {"path": "src/demo/big.py", "language": "python", "content": "x = 1\n", "status": "truncated", "reason": "too long"},
            {"path": "logo.png", "language": "binary"},
        ],
    )
    whole = finalized(entries)
    schema = ", ".join(f for f in ENTRY.split(", ") if f.split()[0] in model.ENTRY_FIELDS)
    checks = {
        "no issues": whole.issues.isEmpty(),
        "summary": tuple(whole.summary.select("total_files", "exported_files", "skipped_files").first()) == (4, 2, 1),
        "tree": whole.tree.count() == 6,
        "ready": readiness(entries, export_row(spark, entries)).first().ready,
        "not ready with other totals": not readiness(entries, export_row(spark, entries).withColumn("total_tracked_files", F.lit(9).cast("long"))).first().ready,
        "fingerprint": fingerprint(entries).first().fingerprint == fingerprint(entries.orderBy(F.desc("path"))).first().fingerprint,
        "round trip": model.round_trip(entries, ", ".join(sorted(schema.split(", ")))).isEmpty(),
    }
    return spark.createDataFrame(list(checks.items()), "check string, passed boolean")

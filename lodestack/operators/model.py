"""The export model: validation, audit, canonical JSON, fingerprints, manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATUSES = ("included", "truncated", "skipped", "error")
TEXT_STATUSES = ("text", "binary")
ENTRY_FIELDS = ("content", "estimated_tokens", "language", "line_count", "masked_content", "path", "reason", "size_bytes", "status", "text_status")


def issues(entries: DataFrame, key: str = "entry_id", scope: str = "export_id") -> DataFrame:
    """``entry_id, rule`` of every rule that an entry breaks; one pass, and one aggregation for the paths given twice."""
    def broken(rule: str, when: Column) -> Column:
        return F.when(when, F.lit(rule))

    checks = F.array_compact(
        F.array(
            broken("status", F.col("status").isNull() | ~F.col("status").isin(*STATUSES)),
            broken("text_status", F.col("text_status").isNull() | ~F.col("text_status").isin(*TEXT_STATUSES)),
            broken("path", F.col("path").isNull() | (F.trim("path") == "")),
            broken("language", F.col("language").isNull() | (F.trim("language") == "")),
            *[broken(c, F.col(c) < 0) for c in ("size_bytes", "line_count", "estimated_tokens")],
            broken("content", (F.col("status") == "included") & (F.col("text_status") == "text") & F.col("content").isNull()),
        )
    )
    single = entries.select(key, F.explode(checks).alias("rule"))
    twice = entries.groupBy(scope, "path").agg(F.count("*").alias("n"), F.min(key).alias(key)).where("n > 1").select(key, F.lit("duplicate_path").alias("rule"))
    return single.unionByName(twice)


def audit(entries: DataFrame, exports: DataFrame) -> DataFrame:
    """Stored against recomputed: per export what its summary says and what its entries, with the ``tokens`` of their texts, give."""
    real = entries.groupBy("export_id").agg(
        F.count("*").alias("tracked"),
        F.count_if((F.col("text_status") == "text") & (F.col("status") == "included")).alias("exported"),
        F.sum("tokens").alias("tokens"),
    )
    joined = exports.select("export_id", "total_tracked_files", "estimated_tokens").join(real, "export_id", "left")
    return joined.select(
        "export_id",
        F.coalesce("tracked", F.lit(0)).alias("tracked"),
        (F.coalesce("total_tracked_files", F.lit(-1)) == F.coalesce("tracked", F.lit(0))).alias("tracked_agrees"),
        F.coalesce(F.col("estimated_tokens") == F.coalesce("tokens", F.lit(0)), F.lit(False)).alias("tokens_agree"),
    )


def canonical_json(columns: dict[str, Column] | None = None, fields: tuple[str, ...] = ENTRY_FIELDS) -> Column:
    """A row as JSON with its keys in alphabetical order and nulls kept."""
    return F.to_json(F.struct(*[(columns[f] if columns else F.col(f)).alias(f) for f in sorted(fields)]), {"ignoreNullFields": "false"})


def parsed_json(text: Column, schema: str) -> Column:
    return F.from_json(text, schema, {"mode": "FAILFAST"})


def round_trip(entries: DataFrame, schema: str, key: str = "entry_id") -> DataFrame:
    """Entries whose JSON, parsed and written again, isn't the same: none, if the model is sound."""
    first = canonical_json()
    again = F.to_json(parsed_json(F.col("first"), schema), {"ignoreNullFields": "false"})
    return entries.select(key, first.alias("first")).select(key, "first", again.alias("again")).where("first <> again")


def missing(required: DataFrame, present: DataFrame, name: str) -> DataFrame:
    """Required names that aren't present."""
    return required.join(present.select(name).distinct(), name, "left_anti")


def inventory(entries: DataFrame, group: Column, scope: str = "export_id") -> DataFrame:
    """Entries and bytes of each group of each export."""
    return entries.groupBy(scope, group.alias("grp")).agg(F.count("*").alias("n_entries"), F.sum(F.coalesce("size_bytes", F.lit(0))).alias("n_bytes"))


def adapted(rows: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """Columns under their names from whichever of several aliases a row fills first."""
    have = set(rows.columns)
    out = []
    for name, options in aliases.items():
        there = [F.col(o) for o in (name, *options) if o in have]
        out.append((F.coalesce(*there) if there else F.lit(None)).alias(name))
    return rows.select(*out)

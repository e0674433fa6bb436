"""What changed between consecutive full snapshots of a table.

Every row of a snapshot is unpivoted into signed cells ``(key, field, value)`` plus a presence marker of its key: ``+1``
in the comparison of its own snapshot, ``-1`` in that of the group's next snapshot. The sums of the signs per cell that
aren't zero tell which keys came, went or changed, and in which fields.

Cells of rows that are equal to those of the key in the snapshot before cancel out wholly, so they aren't made: rows are
compared as a whole first, and only those that differ are unpivoted.

The plan shuffles the rows once, by ``(group, key)``; the choice of the latest delivery, the comparison and all sums work on
that partitioning and its order. A hot group spreads over all partitions, as its keys do. Long texts travel as 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.common import few

#: The compared fields of a file entry, in their order.
ENTRY_FIELDS = ("language", "size_bytes", "line_count", "estimated_tokens", "text_status", "status", "content", "masked_content", "reason")
LONG_TEXTS = ("content", "masked_content")


def normal_path(path: Column) -> Column:
    """``path`` with single forward slashes and without leading ``./`` or ``/``; its case is kept."""
    slashed = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"/(?:\./)*/*(?:\./)*", "/")
    return F.regexp_replace(slashed, r"^(?:\./|/)+", "")


def snapshot_changes(
    snapshots: DataFrame,
    group: str = "repo_id",
    seq: str = "snapshot_no",
    key: str = "path",
    version: str = "delivered_at",
    fields: Sequence[str] = ENTRY_FIELDS,
    long_texts: Sequence[str] = LONG_TEXTS,
    normalize: bool = True,
) -> DataFrame:
    """One row per added or removed key and per differing field of a kept key, for each snapshot and the last earlier one.

    Result: ``group, seq (the later snapshot), key, change_kind ('added', 'removed', 'changed'), field_name ('' unless
    changed)``. Of several rows of one key in a snapshot the one with the latest ``version`` counts (null is earliest; of
    equal ones that with the greatest values). Null differs from every value and equals null. A group's first snapshot
    gives no row; rows without group, seq or key are no records and are left out. An empty table gives no rows; other
    columns are ignored.
    """
    path = normal_path(F.col(key)) if normalize else F.col(key).cast("string")
    value = {f: F.unhex(F.md5(F.col(f).cast("string"))) if f in long_texts else F.col(f) for f in fields}
    rows = snapshots.select(
        F.col(group).alias("g"), F.col(seq).alias("s"), path.alias("k"), F.col(version).alias("v"), F.struct(*[value[f].alias(f"f{i}") for i, f in enumerate(fields)]).alias("r")
    ).where("g is not null and s is not null and k is not null")

    order = Window.partitionBy("g").orderBy("s")
    there = snapshots.where(F.col(key).isNotNull()).select(F.col(group).alias("g"), F.col(seq).alias("s")).where("g is not null and s is not null").distinct()
    steps = few(there.select("g", "s", F.lag("s").over(order).alias("earlier"), F.lead("s").over(order).alias("next")))
    keyed = rows.join(steps, ["g", "s"]).repartition("g", "k")
    newest = Window.partitionBy("g", "k", "s").orderBy(F.col("v").desc_nulls_last(), F.col("r").desc())
    latest = keyed.withColumn("n", F.row_number().over(newest)).where("n = 1")

    near = Window.partitionBy("g", "k").orderBy("s")
    same = lambda other, at: F.coalesce((other("s").over(near) == F.col(at)) & other("r").over(near).eqNullSafe(F.col("r")), F.lit(False))
    compared = latest.select("g", "k", "s", "r", "earlier", "next", same(F.lag, "earlier").alias("as_before"), same(F.lead, "next").alias("as_after"))
    sides = F.array(
        F.when(F.col("earlier").isNotNull() & ~F.col("as_before"), F.struct(F.col("s").alias("at"), F.lit(1).alias("sign"))),
        F.when(F.col("next").isNotNull() & ~F.col("as_after"), F.struct(F.col("next").alias("at"), F.lit(-1).alias("sign"))),
    )
    cell = lambda i, f: F.col(f"r.f{i}") if f in long_texts else F.encode(F.col(f"r.f{i}").cast("string"), "UTF-8")
    cells = F.array(
        F.struct(F.lit(-1).alias("field"), F.lit(None).cast("binary").alias("value")),
        *[F.struct(F.lit(i).alias("field"), cell(i, f).alias("value")) for i, f in enumerate(fields)],
    )
    signed = compared.select("g", "k", "r", F.explode(F.array_compact(sides)).alias("side")).select("g", "k", "side.at", "side.sign", F.inline(cells))
    sums = signed.groupBy("g", "k", "at", "field", "value").agg(F.sum("sign").alias("n")).where("n <> 0")
    changed = sums.groupBy("g", "k", "at").agg(
        F.coalesce(F.sum(F.when(F.col("field") == -1, F.col("n"))), F.lit(0)).alias("presence"),
        F.bit_or(F.when(F.col("field") >= 0, F.expr("shiftleft(1L, field)"))).alias("differing"),
    )
    names = F.array(*[F.lit(f) for f in fields])
    kind = F.when(F.col("presence") > 0, "added").when(F.col("presence") < 0, "removed").otherwise("changed")
    named = F.when(F.col("presence") == 0, F.filter(names, lambda f, i: F.expr("differing").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0)).otherwise(F.array(F.lit("")))
    return changed.select(F.col("g").alias(group), F.col("at").alias(seq), F.col("k").alias(key), kind.alias("change_kind"), F.explode(named).alias("field_name"))

"""Ordered text: sections of reports, headings, pieces and their names."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from lodestack.functions import paths, text

HEADING = r"^ {0,3}#{1,6}\s+\S"


def assembled(rows: DataFrame, by: str, order: list[str], body: str, separator: str = "\n\n") -> DataFrame:
    """The texts of each group, joined in order. A group's whole text becomes one value; for texts without bound see ``ordered``."""
    ordered = F.array_sort(F.collect_list(F.struct(*order, body)))
    return rows.groupBy(by).agg(F.array_join(F.transform(ordered, lambda x: x[body]), separator).alias("text"))


def ordered(rows: DataFrame, by: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, their place in the text of their group, which stays in rows until it is written (``sinks.write_ordered``)."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def heading_sections(documents: DataFrame, key: str, content: str = "text") -> DataFrame:
    """``key, section, first_line, n_lines, heading``: a section begins at every heading; what comes before is section 0."""
    rows = documents.where(F.col(content).isNotNull()).select(key, F.posexplode(F.split(content, "\n", -1)).alias("pos", "line"))
    begins = F.when(F.col("line").rlike(HEADING), 1).otherwise(0)
    numbered = rows.withColumn("section", F.sum(begins).over(Window.partitionBy(key).orderBy("pos")))
    first = F.min(F.struct("pos", "line")).alias("first")
    grouped = numbered.groupBy(key, "section").agg(first, F.count("*").alias("n_lines"))
    return grouped.select(key, "section", F.col("first.pos").alias("first_line"), "n_lines", F.when(F.col("section") > 0, F.trim(F.regexp_replace("first.line", r"^\s*#+\s*", ""))).alias("heading"))


def plain_parts(rows: DataFrame, key: str, content: str, most: Column) -> DataFrame:
    """``key, part, n_parts, n_chars``: consecutive chunks of at most ``most`` characters."""
    chunks = text.plain_chunks(F.col(content), most)
    return rows.where(F.col(content).isNotNull()).select(key, F.posexplode(chunks).alias("pos", "chunk"), F.size(chunks).alias("n_parts")).select(key, (F.col("pos") + 1).alias("part"), "n_parts", F.length("chunk").alias("n_chars"), F.md5("chunk").alias("digest"))


@F.pandas_udf(ArrayType(IntegerType()))
def _greedy(sizes: pd.Series, most: pd.Series) -> pd.Series:
    out = []
    for own, limit in zip(sizes, most, strict=True):
        used, part, parts = 0, 0, []
        for n in own:
            if not used or used + n > limit:
                used, part = 0, part + 1
            used += n
            parts.append(part)
        out.append(parts)
    return pd.Series(out)


def packed_sections(sections: DataFrame, key: str, size: str, order: str, most: int) -> DataFrame:
    """``key, order, piece, size, part``: sections put into parts greedily: a part takes the next section while it fits, else a new one begins.

    A section above ``most`` is cut into pieces of ``most`` and a rest, so that no part is too large. The fold of a document
    holds sizes only, one number a piece, and takes time in proportion to them. Sections without a size are of size 0.
    """
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    pieces = F.greatest(F.ceil(n / most), F.lit(1)).cast("int")
    cut = sections.select(key, F.col(order).alias("o"), n.alias("n"), F.explode(F.sequence(F.lit(1), pieces)).alias("piece"))
    sized = cut.select(key, F.struct("o", "piece", F.greatest(F.least(F.lit(most).cast("long"), F.col("n") - (F.col("piece") - 1) * most), F.lit(0).cast("long")).alias("n")).alias("s"))
    listed = sized.groupBy(key).agg(F.array_sort(F.collect_list("s")).alias("s"))
    packed = listed.select(key, "s", _greedy(F.transform("s", lambda x: x["n"]), F.lit(most).cast("long")).alias("parts"))
    return packed.select(key, F.inline(F.arrays_zip("s", "parts"))).select(key, F.col("s.o").alias(order), F.col("s.piece").alias("piece"), F.col("s.n").alias(size), F.col("parts").alias("part"))


def merged_reports(reports: list[DataFrame], once: tuple[str, ...]) -> DataFrame:
    """Rows ``kind, value`` of several reports in one; of the kinds ``once`` equal values count once."""
    united = reduce(DataFrame.unionByName, [r.select("kind", "value") for r in reports])
    return united.where(~F.col("kind").isin(*once)).unionByName(united.where(F.col("kind").isin(*once)).distinct())


def _plain(value, top: bool = True):
    if isinstance(value, dict):
        return {str(k): _plain(v, False) for k, v in sorted(value.items(), key=lambda x: str(x[0]))}
    if isinstance(value, list):
        own = [_plain(v, False) for v in value]
        return sorted(own, key=lambda v: json.dumps(v, sort_keys=True, ensure_ascii=False) if isinstance(v, (dict, list)) else str(v))
    return value


@F.pandas_udf(StringType())
def normal_payload(payload: pd.Series) -> pd.Series:
    """A report's payload as JSON with sorted keys and sorted lists at every depth; null for null and for what is no JSON."""

    def one(text):
        try:
            return None if text is None else json.dumps(_plain(json.loads(text)), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return payload.map(one)


def part_name(path: Column, part: Column, n_parts: Column) -> Column:
    """``stem.partNN.suffix`` with at least two digits; the path itself if there is one part only."""
    width = F.greatest(F.lit(2), F.length(n_parts.cast("string")))
    number = F.lpad(part.cast("string"), width, F.lit("0"))
    name = F.concat(paths.stem(path), F.lit(".part"), number, F.regexp_extract(path, r"[^./](\.[^./]*)$", 1))
    folder = F.regexp_extract(path, r"^(.*/)[^/]*$", 1)
    return F.when(n_parts <= 1, path).otherwise(F.concat(folder, name))


def group_breaks(rows: DataFrame, by: str, order: list[str], heading: str) -> DataFrame:
    """Rows with ``starts``, true where the heading differs from that of the row before."""
    window = Window.partitionBy(by).orderBy(*order)
    return rows.withColumn("starts", ~F.col(heading).eqNullSafe(F.lag(heading).over(window)) | (F.row_number().over(window) == 1))


def symbol_index(symbols: DataFrame, by: str) -> DataFrame:
    """One text per group: a line for each symbol, by file, line and name."""
    line = F.concat_ws(" ", "file_path", F.concat(F.lit("L"), F.coalesce(F.col("line_start").cast("string"), F.lit("?"))), "kind", F.concat_ws(".", "parent", "name"))
    rows = symbols.select(by, "file_path", F.coalesce("line_start", F.lit(-1)).alias("at"), "name", line.alias("line")).distinct()
    return assembled(rows, by, ["file_path", "at", "name"], "line", "\n")

"""Secrets by the name of a variable, and masks for their values (the engine's own four types, and private key blocks).

One masker serves findings, reports and files: assignments anywhere in a line, with or without quotes, and whole key blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REDACTED = "***REDACTED***"
LEAST_LENGTH = 8
#: Types by name, the first that matches counts.
TYPES = (("API_KEY", r"(?i)api_?key"), ("TOKEN", r"(?i)token"), ("SECRET", r"(?i)secret"), ("PASSWORD", r"(?i)(?:password|passwd|pwd)"))
# Fixed values that are no secrets.
PLACEHOLDERS = ("changeme", "change-me", "example", "example-token", "your-api-key", "your_api_key", "insert-key-here", "todo", "none", "null", "dummy", "test", "password", "secret", "true", "false")
_KEYWORD = r"(?i)(?:api_?key|token|secret|password|passwd|pwd)"
#: ``name = value``, ``name: value`` and ``os.environ["name"] = value`` anywhere in a line, the value with or without quotes.
ASSIGNMENT = r"(?i)([a-z_][a-z0-9_]*?(?:api_?key|token|secret|password|passwd|pwd)[a-z0-9_]*|(?:api_?key|token|secret|password|passwd|pwd)[a-z0-9_]*)(?:&quot;|[\"'])?\]?\s*[:=]\s*(?:&quot;|[\"'])?([^\"'\s,;&<>]+)"
_KEY_BLOCK = r"(-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)[\s\S]*?(-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)"
_COMMENT = r"^\s*#"


def masked_value(value: Column) -> Column:
    """Four characters stay at each end of a value of sixteen or more, three from twelve on; shorter ones go wholly."""
    kept = lambda n: F.concat(F.left(value, F.lit(n)), F.lit(REDACTED), F.right(value, F.lit(n)))
    return F.when(value == "", value).when(F.length(value) >= 16, kept(4)).when(F.length(value) >= 12, kept(3)).otherwise(F.lit(REDACTED))


def is_real(value: Column) -> Column:
    """No placeholder, number, call, short or masked value."""
    return (F.length(value) >= LEAST_LENGTH) & ~F.lower(value).isin(*PLACEHOLDERS) & ~value.rlike(r"^[0-9.]+$") & ~value.contains(REDACTED) & ~value.rlike(r"[()\[\]{}]")


def secret_type(name: Column) -> Column:
    kind = F.lit(None).cast("string")
    for label, pattern in reversed(TYPES):
        kind = F.when(name.rlike(pattern), label).otherwise(kind)
    return kind


def _assigned(line: Column) -> Column:
    """``name, value`` of every real assignment of a line; a line that is a comment has none."""
    pairs = F.arrays_zip(F.regexp_extract_all(line, F.lit(ASSIGNMENT), F.lit(1)).alias("name"), F.regexp_extract_all(line, F.lit(ASSIGNMENT), F.lit(2)).alias("value"))
    return F.filter(pairs, lambda p: is_real(p["value"]))


def masked_line(line: Column) -> Column:
    masked = F.aggregate(_assigned(line), line, lambda acc, p: F.replace(acc, p["value"], masked_value(p["value"])))
    return F.when(line.rlike(_KEYWORD) & ~line.rlike(_COMMENT), masked).otherwise(line)


def masked_text(text: Column) -> Column:
    """``text`` with every assigned secret and the body of every private key masked; all else is unchanged."""
    lines = F.array_join(F.transform(F.split(text, "\n", -1), masked_line), "\n")
    whole = F.regexp_replace(lines, _KEY_BLOCK, "$1\n" + REDACTED.replace("$", r"\$") + "\n$2")
    return F.when(text.rlike(_KEYWORD) | text.contains("PRIVATE KEY"), whole).otherwise(text)


def line_findings(files: DataFrame, key: str = "entry_id", content: str = "content") -> DataFrame:
    """``key, line_number, secret_type, variable_name, matched_text, masked_text, confidence`` of the lines that assign a secret.

    Of several secrets in a line the first one gives type and name, all are masked. ``matched_text`` is the value itself, for
    callers that check it; a quoted value has confidence 'high', another 'medium'. Null contents have none.
    """
    rows = files.where(F.col(content).isNotNull()).select(key, F.posexplode(F.split(content, r"\r?\n")).alias("pos", "line"))
    likely = rows.where(F.col("line").rlike(_KEYWORD) & ~F.col("line").rlike(_COMMENT))
    found = likely.select(key, (F.col("pos") + 1).alias("line_number"), "line", F.get(_assigned(F.col("line")), F.lit(0)).alias("a")).where("a is not null")
    quoted = F.substr("line", F.instr("line", F.col("a.value")) - 1, F.lit(1)).isin('"', "'")
    return found.select(
        key, "line_number", secret_type(F.col("a.name")).alias("secret_type"), F.col("a.name").alias("variable_name"), F.col("a.value").alias("matched_text"),
        F.trim(masked_line(F.col("line"))).alias("masked_text"), F.when(quoted, "high").otherwise("medium").alias("confidence"),
    )


def counts_by_type(findings: DataFrame) -> DataFrame:
    return findings.groupBy("secret_type").agg(F.count("*").alias("n_findings"))

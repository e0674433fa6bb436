"""Facts about a repository from its files: type, tools, tests, packages, and who mentions whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import paths

PACKAGING = ("pyproject.toml", "requirements.txt", "setup.py", "package.json")


def facts(files: DataFrame, by: str, language: str = "lang") -> DataFrame:
    """One row per repository: its type, packaging files and test framework, from flags of one aggregation.

    Exportable files are those with content. The primary language is the commonest, ties by name.
    """
    low, body = F.lower("path"), F.lower(F.coalesce("content", F.lit("")))
    there = F.col("content").isNotNull()
    flags = files.groupBy(by).agg(
        *[F.bool_or(low == p).alias(f"has_{i}") for i, p in enumerate(PACKAGING)],
        F.bool_or((low == "cli.py") | low.endswith("/cli.py")).alias("has_cli"),
        F.bool_or((low == "tests") | low.startswith("tests/")).alias("has_tests"),
        F.bool_or(there & body.contains("pytest")).alias("says_pytest"),
        F.bool_or(there & body.contains("unittest")).alias("says_unittest"),
        F.coalesce(F.bool_and(F.when(there, F.coalesce(F.col(language).isin("markdown", "text"), F.lit(False)))), F.lit(False)).alias("only_texts"),
    )
    per = files.where(there & F.col(language).isNotNull()).groupBy(by, language).agg(F.count("*").alias("n"))
    primary = per.groupBy(by).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(language).alias("name"))).alias("p")).select(by, F.col("p.name").alias("primary_language"))
    joined = flags.join(primary, by, "left")
    kind = (
        F.when(F.col("has_0") & F.col("has_cli"), "Python CLI project")
        .when(F.col("has_0") | F.col("has_2"), "Python package")
        .when(F.col("primary_language") == "python", "Python project")
        .when(F.col("primary_language") == "bash", "Bash project")
        .when(F.col("only_texts"), "Documentation project")
        .otherwise("Unknown Git repository")
    )
    packaging = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"has_{i}"), p) for i, p in enumerate(PACKAGING)])), ", ")
    tests = F.when(F.col("says_pytest") | F.col("has_tests"), "pytest").when(F.col("says_unittest"), "unittest").otherwise("Unknown")
    return joined.select(by, kind.alias("project_type"), F.when(packaging == "", "Unknown").otherwise(packaging).alias("packaging"), tests.alias("test_framework"))


def layout(files: DataFrame, by: str, most: int = 10) -> DataFrame:
    """``by, fact, value``: top-level folders, Python package roots and test files of each repository, the first of each, and how many more."""
    path = F.col("path")
    top = F.when(path.contains("/"), F.regexp_extract(path, "^([^/]+)/", 1))
    root = F.when(paths.name(path) == "__init__.py", F.nullif(F.regexp_replace(path, "/?__init__\\.py$", ""), F.lit("")))
    test = F.when(F.lower(paths.name(path)).rlike(r"^test_.*\.py$"), path)
    rows = files.select(by, F.inline(F.array(F.struct(F.lit("folder").alias("fact"), top.alias("value")), F.struct(F.lit("package").alias("fact"), root.alias("value")), F.struct(F.lit("test").alias("fact"), test.alias("value")))))
    found = rows.where("value is not null").distinct()
    from lodestack.operators.selection import capped

    return capped(found, [by, "fact"], ["value"], most).select(by, "fact", "value", "place", "more")


def mentions(files: DataFrame, by: str) -> DataFrame:
    """``by, path, n_mentions``: how many other files seem to import each Python file.

    A file mentions a module that stands after ``import`` (as the beginning of a longer name, too), between ``from`` and
    ``import``, or, by its last part, after ``from .``. What stands there becomes rows, the beginnings of a name included, so
    that the lookup is a join by equality instead of a search of every name in every file.
    """
    module = paths.module_name(F.col("path"))
    own = files.where(F.col("path").endswith(".py")).select(by, "path", module.alias("module")).where("module is not null and module <> ''")
    needles = own.select(by, "path", F.explode(F.array(F.concat(F.lit("i:"), "module"), F.concat(F.lit("f:"), "module"), F.concat(F.lit("f:."), F.element_at(F.split("module", r"\."), -1)))).alias("needle"))
    texts = files.where("content is not null").select(by, F.col("path").alias("other"), "content")
    runs = F.array_distinct(F.regexp_extract_all("content", F.lit(r"import ([A-Za-z0-9_.]+)"), F.lit(1)))
    heads = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r)), lambda i: F.concat(F.lit("i:"), F.substr(r, F.lit(1), i)))))
    froms = F.transform(F.regexp_extract_all("content", F.lit(r"from ([A-Za-z0-9_.]+) import"), F.lit(1)), lambda r: F.concat(F.lit("f:"), r))
    said = texts.select(by, "other", F.explode(F.array_distinct(F.concat(heads, froms))).alias("needle"))
    hits = needles.join(said, [by, "needle"]).where("path <> other").groupBy(by, "path").agg(F.count_distinct("other").alias("n"))
    return own.select(by, "path").distinct().join(hits, [by, "path"], "left").select(by, "path", F.coalesce("n", F.lit(0)).alias("n_mentions"))


def ambiguous(symbols: DataFrame, key: list[str]) -> DataFrame:
    """Keys that more than one symbol has, and how many have it."""
    return symbols.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def call_class(confidence: Column) -> Column:
    """Internal, external, ambiguous, unresolved or other."""
    return (
        F.when(confidence.isin("local", "local_method", "imported_local"), "internal")
        .when(confidence == "external", "external")
        .when(confidence == "ambiguous", "ambiguous")
        .when(confidence.startswith("unresolved"), "unresolved")
        .otherwise("other")
    )


def is_documentation_entry(path: Column, language: Column) -> Column:
    """The model's own rule for documentation: folders, names, suffixes, or a text language at the top."""
    low = F.lower(path)
    base = F.regexp_extract(low, r"([^/]*)$", 1)
    stem = F.regexp_replace(base, r"\.[^.]*$", "")
    names = stem.isin("readme", "license", "changelog", "contributing", "code_of_conduct", "security", "authors", "notice")
    by_path = low.rlike("(?:^|/)docs?/") | names | base.rlike(r"\.(?:md|markdown|rst|txt|adoc)$")
    return by_path | (F.coalesce(language.isin("markdown", "rst", "text"), F.lit(False)) & ~path.contains("/"))


def merged_counts(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of ``first``, and those of ``second`` for keys that ``first`` lacks."""
    a, b = first.withColumnRenamed("n", "a"), second.withColumnRenamed("n", "b")
    return a.join(b, keys, "full").select(*keys, F.coalesce("a", "b").alias("n"))


def filtered_sections(texts: DataFrame, key: str, kept: Column) -> DataFrame:
    """``key, text`` without the sections ``## path`` whose path isn't ``kept`` (an expression over ``path``)."""
    from pyspark.sql import Window

    rows = texts.select(key, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    heading = F.regexp_extract("line", r"^## (.+)$", 1)
    numbered = rows.withColumn("section", F.sum(F.when(heading != "", 1).otherwise(0)).over(Window.partitionBy(key).orderBy("pos"))).withColumn("heading", F.nullif(heading, F.lit("")))
    named = numbered.withColumn("path", F.max("heading").over(Window.partitionBy(key, "section")))
    left = named.where(F.col("path").isNull() | kept)
    return left.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("text"))

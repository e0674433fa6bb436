"""Reports of repositories: every section is a table (scope, position, title, body), and a report is their ordered text.

All sections of all repositories are made by the same plans, whether a folder holds one repository or a table holds many.
Masks and limits come last, over the whole text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import languages, paths, text
from lodestack.operators import extract, graph, masking, project, ranking, report, selection, stats

MODES = ("full", "ai", "docs", "changed")
TOP_FILES, SYMBOLS_PER_FILE, GRAPH_LINES = 20, 50, 200


def _section(rows: DataFrame, scope: str, position: int, title: str, line: Column, order: list[str]) -> DataFrame:
    body = report.assembled(rows.withColumn("line", line), scope, order, "line", "\n")
    return body.select(scope, F.lit(position).alias("position"), F.lit(title).alias("title"), F.col("text").alias("body"))


def overview(files: DataFrame, scope: str) -> DataFrame:
    counted = stats.counts(files, scope)
    line = F.concat_ws("\n", *[F.concat(F.lit(f"- {name}: "), F.col(name).cast("string")) for name in ("tracked", "exported", "binary", "faulty")])
    return counted.select(scope, F.lit(0).alias("position"), F.lit("Repository").alias("title"), line.alias("body"))


def language_table(files: DataFrame, scope: str) -> DataFrame:
    per = files.groupBy(scope, languages.display_name(F.col("language")).alias("name")).agg(F.count("*").alias("n"), F.sum(F.coalesce("line_count", F.lit(0))).alias("lines")).withColumn("minus", -F.col("n"))
    line = F.concat(F.lit("| "), text.table_cell(F.col("name")), F.lit(" | "), text.thousands(F.col("n")), F.lit(" | "), text.thousands(F.col("lines")), F.lit(" |"))
    return _section(per, scope, 2, "Languages", line, ["minus", "name"])


def tree_text(files: DataFrame, scope: str) -> DataFrame:
    drawn = graph.preorder(graph.drawn(graph.tree_rows(files, scope), scope), scope)
    return _section(drawn.withColumn("own", F.col("line")), scope, 3, "Tree", F.col("own"), ["place"])


def facts_text(files: DataFrame, scope: str) -> DataFrame:
    found = project.facts(files.withColumn("lang", F.col("language")), scope)
    line = F.concat_ws("\n", *[F.concat(F.lit(f"- {label}: "), name) for label, name in (("type", "project_type"), ("packaging", "packaging"), ("tests", "test_framework"))])
    return found.select(scope, F.lit(2).alias("position"), F.lit("Project").alias("title"), line.alias("body"))


def symbols_text(files: DataFrame, scope: str) -> DataFrame:
    source = files.where("language = 'python' and content is not null").withColumn("key", F.concat_ws("\x1f", F.col(scope).cast("string"), "path"))
    found = extract.python_symbols(source, "key").where("kind <> 'error'").join(source.select("key", scope, "path"), "key")
    kept = selection.capped(found, ["key"], ["line_start", "name"], SYMBOLS_PER_FILE)
    line = F.concat_ws(" ", "path", F.concat(F.lit("L"), F.col("line_start").cast("string")), "kind", F.concat_ws(".", "parent", "name"))
    return _section(kept, scope, 4, "Symbols", line, ["path", "line_start", "name"])


def imports_text(files: DataFrame, scope: str) -> DataFrame:
    own = files.where(F.col("path").endswith(".py")).withColumn("module", paths.module_name(F.col("path"))).where("module is not null")
    source = own.where("content is not null").withColumn("key", F.concat_ws("\x1f", F.col(scope).cast("string"), "path"))
    found = extract.python_imports(source, "key").where("import_type <> 'error'").join(source.select("key", scope, F.col("module").alias("source_module")), "key")
    references = found.withColumn("reference_id", F.concat_ws("\x1f", "key", F.col("visit_ord").cast("string")))
    resolved = graph.resolve_imports(references, own.select(scope, "module", "path"), scope)
    edges = resolved.where("resolution = 'local'").select(scope, "source_module", "target_module").distinct()
    kept = selection.capped(edges, [scope], ["source_module", "target_module"], GRAPH_LINES)
    return _section(kept, scope, 5, "Imports", F.concat_ws(" -> ", "source_module", "target_module"), ["source_module", "target_module"])


def dependencies_text(files: DataFrame, scope: str) -> DataFrame:
    base = files.where("content is not null").withColumn("key", F.concat_ws("\x1f", F.col(scope).cast("string"), "path"))
    toml = extract.toml_dependencies(base.where(paths.name(F.col("path")) == "pyproject.toml"), "key").where("name is not null").select("key", "normalized_name", "version_constraint", "dependency_type")
    lines = extract.requirement_lines(base.where(F.lower(paths.name(F.col("path"))).rlike(r"requirements.*\.txt$")), "key").where("name is not null").select("key", "normalized_name", "version_constraint", "dependency_type")
    rows = toml.unionByName(lines).join(base.select("key", scope, "path"), "key").distinct()
    line = F.concat(F.lit("- "), "normalized_name", F.coalesce("version_constraint", F.lit("")), F.lit(" ("), "dependency_type", F.lit(", "), "path", F.lit(")"))
    return _section(rows, scope, 6, "Dependencies", line, ["dependency_type", "normalized_name", "path"])


def schema_text(files: DataFrame, scope: str) -> DataFrame:
    base = files.where("content is not null").where(F.lower("path").rlike(r"\.(?:sql|ddl)$|(?:^|/)(?:migrations|schema|sql)/")).withColumn("key", F.concat_ws("\x1f", F.col(scope).cast("string"), "path"))
    rows = extract.sql_tables(base, "key").join(base.select("key", scope, "path"), "key")
    line = F.concat(F.lit("- "), "table_name", F.coalesce(F.concat(F.lit("."), "column_name", F.lit(" "), F.coalesce("data_type", F.lit("?"))), F.lit("")))
    return _section(rows.withColumn("at", F.coalesce("position", F.lit(-1))), scope, 7, "Database", line, ["path", "table_name", "at"])


def secrets_text(files: DataFrame, scope: str) -> DataFrame:
    keyed = files.withColumn("key", F.concat_ws("\x1f", F.col(scope).cast("string"), "path"))
    found = masking.line_findings(keyed, "key").join(keyed.select("key", scope, "path"), "key")
    line = F.concat(F.lit("- "), "path", F.lit(":"), F.col("line_number").cast("string"), F.lit(" "), "secret_type")
    return _section(found, scope, 8, "Possible secrets", line, ["path", "line_number"])


def important_text(files: DataFrame, scope: str) -> DataFrame:
    """The first files by points for entry points and scripts, imports, calls, documentation and structure."""
    keyed = files.withColumn("key", F.concat_ws("\x1f", F.col(scope).cast("string"), "path"))
    facts = extract.PythonFacts(keyed.where("language = 'python'"), "key")
    scripts = extract.console_scripts(keyed.where(paths.name(F.col("path")) == "pyproject.toml"), "key").join(keyed.select("key", scope), "key")
    ranked = ranking.rank_repository(facts, keyed, scope, scripts).where(F.col("place") <= TOP_FILES)
    line = F.concat(F.col("place").cast("string"), F.lit(". "), "path", F.lit(" ("), F.col("score").cast("string"), F.lit("): "), "reasons")
    return _section(ranked, scope, 3, "Important files", line, ["place"])


def documentation_text(files: DataFrame, scope: str) -> DataFrame:
    docs = selection.documentation_only(files.where("content is not null")).withColumn("category", paths.documentation_category(F.col("path")))
    order = F.array_position(F.array(*[F.lit(c) for c in paths.CATEGORIES]), F.col("category"))
    return _section(docs.withColumn("at", order), scope, 2, "Documentation", F.concat(F.lit("### "), "path", F.lit("\n\n"), "content", F.lit("\n")), ["at", "path"])


def sources_text(files: DataFrame, scope: str, position: int = 9) -> DataFrame:
    mark = text.fence(F.col("content"))
    line = F.concat(F.lit("### "), "path", F.lit("\n\n"), mark, languages.fence_label(F.col("language")), F.lit("\n"), "content", F.lit("\n"), mark, F.lit("\n"))
    return _section(files.where("content is not null"), scope, position, "Sources", line, ["path"])


def changes_text(changes: DataFrame, scope: str) -> DataFrame:
    return _section(changes, scope, 2, "Changes", F.concat(F.lit("- "), "status", F.lit(" "), "path"), ["path"])


def settings_text(files: DataFrame, scope: str, settings: dict[str, object]) -> DataFrame:
    """The settings that a report was made with, one line each; an empty list and no limit are 'none'."""
    shown = lambda v: "none" if v is None or v == () or v == [] else ", ".join(map(str, v)) if isinstance(v, (list, tuple)) else "yes" if v is True else "no" if v is False else str(v)
    body = "\n".join(f"- {name}: {shown(value)}" for name, value in settings.items())
    return files.select(scope).distinct().select(scope, F.lit(1).alias("position"), F.lit("Configuration").alias("title"), F.lit(body).alias("body"))


def shell_calls_text(files: DataFrame, scope: str) -> DataFrame:
    """Calls between the functions of shell scripts, within one script and across the scripts of a repository."""
    keyed = files.where("language = 'bash' and content is not null").withColumn("key", F.concat_ws("\x1f", F.col(scope).cast("string"), "path"))
    found = extract.bash_call_edges(keyed, "key", F.col(scope)).join(keyed.select("key", scope, "path"), "key")
    kept = selection.capped(found, [scope], ["path", "call_line", "callee"], GRAPH_LINES)
    line = F.concat(F.lit("- "), "path", F.lit(":"), F.col("call_line").cast("string"), F.lit(" "), "caller", F.lit(" -> "), "callee")
    return _section(kept, scope, 4, "Shell calls", line, ["path", "call_line", "callee"])


def render(files: DataFrame, scope: str, mode: str = "full", limit_bytes: int | None = None, changes: DataFrame | None = None, settings: dict[str, object] | None = None) -> DataFrame:
    """``scope, text`` of the report of every repository in ``files``.

    Files need ``path, language, content, line_count, text_status, status`` besides the scope. The changed report needs
    ``changes`` (scope, path, status); it shows the texts of changed files that are still there, and the calls of its scripts.
    ``settings`` are shown after the overview.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}; one of {', '.join(MODES)}")
    if mode == "full":
        parts = [overview(files, scope), language_table(files, scope), tree_text(files, scope), symbols_text(files, scope), imports_text(files, scope), dependencies_text(files, scope), schema_text(files, scope), secrets_text(files, scope), sources_text(files, scope)]
    elif mode == "ai":
        parts = [overview(files, scope), facts_text(files, scope), important_text(files, scope), symbols_text(files, scope), imports_text(files, scope), dependencies_text(files, scope)]
    elif mode == "docs":
        parts = [overview(files, scope), documentation_text(files, scope)]
    else:
        if changes is None:
            raise ValueError("the changed report needs changes")
        there = files.join(changes.where("status <> 'deleted'").select(scope, "path").distinct(), [scope, "path"], "left_semi")
        parts = [overview(files, scope), changes_text(changes, scope), sources_text(there, scope, 3), shell_calls_text(there, scope)]
    if settings is not None:
        parts.append(settings_text(files, scope, settings))
    sections = reduce(DataFrame.unionByName, parts).withColumn("section", F.concat(F.lit("## "), "title", F.lit("\n\n"), "body"))
    whole = report.assembled(sections, scope, ["position", "title"], "section")
    masked = whole.select(scope, masking.masked_text(F.col("text")).alias("text"))
    return masked.select(scope, text.limited(F.col("text"), limit_bytes, selection.BYTE_NOTICE).alias("text")) if limit_bytes else masked

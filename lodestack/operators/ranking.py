"""Which files matter most: entry points, neighbours in the import and call graphs, documentation and structure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.common import cut, suffix
from lodestack.functions import paths
from lodestack.operators import repository
from lodestack.operators.extract import script_paths
from lodestack.operators.graph import centrality

# Points.
SCRIPT_TARGET = 100
ENTRYPOINTS = {"__main__": 85, "main": 80, "cli": 75, "app": 70, "server": 70, "manage": 70, "wsgi": 65, "asgi": 65}
IMPORT_POINTS = (35, 120), (8, 32)
CALL_POINTS = (35, 120), (6, 24)
STRUCTURE = {"pyproject.toml": 70, "setup.py": 65, "setup.cfg": 60, "package.json": 45, "dockerfile": 40, "makefile": 40}


def bounded(n: Column, weight: int, most: int) -> Column:
    return F.least(F.lit(most), n * weight)


def entrypoint_score(path: Column) -> Column:
    return _entrypoint(F.lower(paths.stem(path)), suffix(path))


def _entrypoint(stem: Column, kind: Column) -> Column:
    out = F.lit(0)
    for known, points in ENTRYPOINTS.items():
        out = F.when(stem == known, points).otherwise(out)
    return F.when(kind == "py", out).otherwise(0)


def documentation_score(path: Column) -> Column:
    """The first rule that matches; only for text formats and bare standard names."""
    return _documentation(F.lower(path), F.lower(paths.name(path)), F.lower(paths.stem(path)), suffix(path))


def _documentation(low: Column, name: Column, stem: Column, kind: Column) -> Column:
    eligible = F.coalesce(kind, F.lit("")).isin("md", "markdown", "rst", "txt") | name.isin("readme", "license", "changelog", "contributing")
    score = (
        F.when(stem.isin("license", "licence"), 35)
        .when(name.startswith("readme"), 90)
        .when(low.contains("architecture"), 80)
        .when(stem.contains("spec"), 75)
        .when(stem.contains("tasks") | stem.contains("roadmap") | stem.contains("milestone"), 55)
        .when(stem == "changelog", 45)
        .when(stem == "contributing", 40)
        .when(low.startswith("docs/"), 25)
        .when(low.startswith("planning/"), 20)
        .otherwise(0)
    )
    return F.when(eligible, score).otherwise(0)


def structure_score(path: Column, content: Column) -> Column:
    return _structure(F.lower(paths.name(path)), content)


def _structure(name: Column, content: Column) -> Column:
    out = F.lit(0)
    for known, points in STRUCTURE.items():
        out = F.when(name == known, points).otherwise(out)
    meaning = F.size(F.filter(F.split(F.coalesce(content, F.lit("")), "\n"), lambda x: x.rlike(r"^\s*[^#\s]")))
    public = F.coalesce(content, F.lit("")).contains("__all__") | (meaning > 2)
    return F.when(name.rlike(r"^requirements.*\.txt$"), 50).when(name == "__init__.py", F.when(public, 20).otherwise(5)).otherwise(out)


# Points and reasons of the simple score, by what a name is or holds.
SIMPLE = (
    ("pyproject.toml", 1000 + 100, "Python project configuration"), ("setup.py", 1000 + 95, "Python packaging entry point"), ("requirements.txt", 1000 + 90, "Python dependency list"), ("requirements-dev.txt", 1000 + 90, "Python dependency list"),
    ("readme.md", 950 + 85, "Primary project documentation"), ("readme.txt", 950 + 85, "Primary project documentation"), ("cli.py", 800 + 80, "CLI entry point"), ("__main__.py", 780 + 70, "Python module execution entry point"),
)
SIMPLE_PARTS = (("architecture", 940, 80, "Architecture documentation"), ("spec", 930, 75, "Project specification"), ("tasks", 850, 60, "Planning or roadmap documentation"), ("roadmap", 850, 60, "Planning or roadmap documentation"), ("milestone", 90, 60, "Planning or roadmap documentation"))


def simple_score(path: Column, definitions: Column, mentions: Column, lines: Column) -> Column:
    """``score, reasons`` from names, definitions, imports by other files and length alone, without graphs; null without a reason.

    The first rule for the order counts, and each kind of reason once. Rules for the modules of one certain project are left out.
    """
    low, name = F.lower(path), F.lower(paths.name(path))
    test = low.startswith("tests/") & name.startswith("test_")
    order, found = F.when(test, 100).otherwise(0), []
    for part, first, points, reason in reversed(SIMPLE_PARTS):
        order = F.when(name.contains(part), first).otherwise(order)
    for whole, points, _ in SIMPLE:
        order = F.when(name == whole, points).otherwise(order)
    for whole, _, reason in SIMPLE:
        found.append((name == whole, 0, reason))
    for part, _, points, reason in SIMPLE_PARTS[:2]:
        found.append((name.contains(part), points, reason))
    planning = reduce(Column.__or__, [name.contains(part) for part, *_ in SIMPLE_PARTS[2:]])
    found.append((planning, 60, SIMPLE_PARTS[2][3]))
    found += [(test, 35, "Automated test coverage"), (definitions > 0, F.least(definitions, F.lit(20)), F.concat(F.lit("Contains "), definitions.cast("string"), F.lit(" Python symbol-like definitions")))]
    found += [(mentions > 0, F.least(mentions * 4, F.lit(40)), F.concat(F.lit("Imported by "), mentions.cast("string"), F.lit(" scanned file(s)"))), ((lines >= 300) & low.endswith(".py"), 10, "Large Python implementation file")]
    score = reduce(Column.__add__, [F.when(F.coalesce(when, F.lit(False)), points).otherwise(0) for when, points, _ in found], order)
    why = F.array_join(F.array_compact(F.array(*[F.when(when, reason) for when, _, reason in found])), "; ")
    return F.when(why != "", F.struct(score.cast("long").alias("score"), why.alias("reasons")))


def reasons(entry: Column, n_in: Column, n_out: Column, calls_in: Column, calls_out: Column, docs: Column, structure: Column) -> Column:
    """Why a file ranks, in the order entry point, imports, calls, documentation, structure."""
    parts = [
        F.when(entry > 0, "entry point"),
        F.when(n_in > 0, F.concat(F.lit("imported by "), n_in.cast("string"))),
        F.when(n_out > 0, F.concat(F.lit("imports "), n_out.cast("string"))),
        F.when(calls_in > 0, F.concat(F.lit("called from "), calls_in.cast("string"))),
        F.when(calls_out > 0, F.concat(F.lit("calls into "), calls_out.cast("string"))),
        F.when(docs > 0, "documentation"),
        F.when(structure > 0, "project structure"),
    ]
    return F.array_join(F.array_compact(F.array(*parts)), "; ")


def rank(files: DataFrame, import_edges: DataFrame, call_edges: DataFrame, scope: str, scripts: DataFrame | None = None) -> DataFrame:
    """Every file with points and reasons, ranked within ``scope``: points descending, then depth, then path.

    Edges are (scope, source, target) between paths of the scope; edges to unknown paths are left out. ``scripts`` are
    (scope, path) of console-script targets. Texts are only needed where there is no column ``structure``, their points.
    """
    node = F.concat_ws("\x1f", F.col(scope).cast("string"), "path")
    structural = F.col("structure") if "structure" in files.columns else structure_score(F.col("path"), F.col("content"))
    base = files.select(scope, "path", structural.alias("structure"), node.alias("node"))
    known = base.select("node")

    def neighbours(edges: DataFrame, points, prefix: str) -> DataFrame:
        keyed = edges.select(F.concat_ws("\x1f", F.col(scope).cast("string"), "source").alias("s"), F.concat_ws("\x1f", F.col(scope).cast("string"), "target").alias("t"))
        inside = keyed.join(known, keyed["s"] == known["node"], "left_semi").join(known, keyed["t"] == known["node"], "left_semi")
        return centrality(inside, "s", "t", *points).select("node", *[F.col(c).alias(f"{prefix}_{c}") for c in ("n_in", "n_out", "score")])

    joined = base.join(neighbours(import_edges, IMPORT_POINTS, "i"), "node", "left").join(neighbours(call_edges, CALL_POINTS, "c"), "node", "left")
    return _placed(joined, scope, scripts)


def _placed(joined: DataFrame, scope: str, scripts: DataFrame | None) -> DataFrame:
    """Files with the numbers and points of their neighbours, scored and ranked."""
    target = F.lit(0)
    if scripts is not None:
        joined = joined.join(scripts.select(scope, "path", F.lit(SCRIPT_TARGET).alias("script")).distinct(), [scope, "path"], "left")
        target = F.coalesce("script", F.lit(0))
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("i_n_in", "i_n_out", "i_score", "c_n_in", "c_n_out", "c_score")}
    by_path = {"entry": entrypoint_score, "docs": documentation_score}
    entry, docs = (F.col(c) if c in joined.columns else score(F.col("path")) for c, score in by_path.items())
    entry, structure = target + entry, F.col("structure")
    score = entry + zero["i_score"] + zero["c_score"] + docs + structure
    scored = joined.select(scope, "path", score.cast("long").alias("score"), reasons(entry, zero["i_n_in"], zero["i_n_out"], zero["c_n_in"], zero["c_n_out"], docs, structure).alias("reasons")).where("score > 0 and reasons <> ''")
    return scored.withColumn("place", F.row_number().over(Window.partitionBy(scope).orderBy(F.desc("score"), paths.depth(F.col("path")), "path")))


def rank_repository(facts, files: DataFrame, scope: str, scripts: DataFrame | None = None) -> DataFrame:
    """``rank`` over the edges that ``facts`` (see ``extract.PythonFacts``) gives for ``files``, and console scripts (scope, target)."""
    paths_of = files.select(facts.key, F.col("path").alias("source"))
    found = cut(facts.resolved_imports(files, scope))
    imports = found.where("resolution = 'local'").select(scope, F.col("source_path").alias("source"), F.col("target_path").alias("target")).distinct()
    calls = facts.resolved_calls(files, scope, found).where("target_path is not null").join(files.select(facts.key, scope), facts.key).join(paths_of, facts.key).select(scope, "source", F.col("target_path").alias("target")).distinct()
    return rank(files, imports, calls, scope, script_paths(scripts, files, scope) if scripts is not None else None)


def rank_repositories(files: DataFrame, scope: str, scripts: DataFrame | None = None) -> DataFrame:
    """``rank_repository`` of Python files (scope, path, content), one row a path, all of one repository read by one task (see ``repository``)."""
    # A name's parts are columns before their points are, and the points before the counts: a filter above would have Spark take them apart once for each rule.
    named = files.select(scope, "path", "content", F.lower("path").alias("low"), F.lower(paths.name(F.col("path"))).alias("name"), F.lower(paths.stem(F.col("path"))).alias("stem"), suffix(F.col("path")).alias("kind"))
    points = {"entry": _entrypoint(F.col("stem"), F.col("kind")), "docs": _documentation(*map(F.col, ("low", "name", "stem", "kind"))), "structure": _structure(F.col("name"), F.col("content"))}
    counted = repository.neighbours(named.select(scope, "path", "content", *[p.alias(c) for c, p in points.items()]), scope, tuple(points))
    points = {f"{p}_score": bounded(F.col(f"{p}_n_in"), weights[0][0], weights[0][1]) + bounded(F.col(f"{p}_n_out"), weights[1][0], weights[1][1]) for p, weights in (("i", IMPORT_POINTS), ("c", CALL_POINTS))}
    return _placed(counted.withColumns(points), scope, script_paths(scripts, files, scope) if scripts is not None else None)

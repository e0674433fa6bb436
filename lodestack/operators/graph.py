"""Graphs and trees as edge and path tables: resolution, adjacency, roots, centrality, folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import paths


def first_seen(edges: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the given order. Map-side combining keeps one row a key and partition."""
    rest = [c for c in edges.columns if c not in keys]
    ranked = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order])
    first = edges.groupBy(*keys).agg(F.min(ranked).alias("first"))
    return first.select(*keys, *[F.col("first")[c].alias(c) for c in rest])


def adjacency(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """``module, depends_on, used_by``: sorted neighbours of every module, isolated ones too."""
    down = edges.groupBy(F.col("source_module").alias("module")).agg(F.array_sort(F.collect_set("target_module")).alias("depends_on"))
    up = edges.groupBy(F.col("target_module").alias("module")).agg(F.array_sort(F.collect_set("source_module")).alias("used_by"))
    none = F.array().cast("array<string>")
    return modules.select("module").distinct().join(down, "module", "left").join(up, "module", "left").select("module", F.coalesce("depends_on", none).alias("depends_on"), F.coalesce("used_by", none).alias("used_by"))


def callers_and_callees(edges: DataFrame, source: str, target: str, shown: int) -> DataFrame:
    """``symbol, n_callers, n_callees, callers, callees``: every end of an edge with the number of its neighbours and the first ``shown`` names.

    Names are ranked with a limit per group, so that the neighbours of a hot symbol are never gathered in one row.
    """
    pairs = edges.select(source, target).distinct()
    both = pairs.select(F.inline(F.array(F.struct(F.col(target).alias("symbol"), F.lit(True).alias("calls_it"), F.col(source).alias("other")), F.struct(F.col(source).alias("symbol"), F.lit(False).alias("calls_it"), F.col(target).alias("other")))))
    counts = both.groupBy("symbol").agg(F.count_if("calls_it").alias("n_callers"), F.count_if(~F.col("calls_it")).alias("n_callees"))
    first = both.withColumn("place", F.row_number().over(Window.partitionBy("symbol", "calls_it").orderBy("other"))).where(F.col("place") <= shown)
    names = lambda which: F.nullif(F.array_join(F.array_sort(F.collect_list(F.when(which, F.col("other")))), ","), F.lit(""))
    listed = first.groupBy("symbol").agg(names(F.col("calls_it")).alias("callers"), names(~F.col("calls_it")).alias("callees"))
    return counts.join(listed, "symbol")


def roots(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules that nothing imports."""
    return modules.select("module").distinct().join(edges, F.col("module") == F.col("target_module"), "left_anti")


def leaves(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """Modules that import nothing."""
    return modules.select("module").distinct().join(edges, F.col("module") == F.col("source_module"), "left_anti")


def metrics(modules: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: modules, edges, roots and leaves."""
    one = modules.agg(F.count_distinct("module").alias("n_modules"))
    e = edges.agg(F.count("*").alias("n_edges"))
    r = roots(modules, edges).agg(F.count("*").alias("n_roots"))
    leaf = leaves(modules, edges).agg(F.count("*").alias("n_leaves"))
    return one.crossJoin(e).crossJoin(r).crossJoin(leaf)  # four rows of one


def centrality(edges: DataFrame, source: str, target: str, incoming: tuple[int, int], outgoing: tuple[int, int]) -> DataFrame:
    """``node, n_in, n_out, score``: distinct neighbours without the node itself; each side's points are ``weight * n`` up to a bound.

    One aggregation over both directions of every edge.
    """
    pairs = edges.where(F.col(source) != F.col(target)).select(source, target).distinct()
    both = pairs.select(F.explode(F.array(F.struct(F.col(source).alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col(target).alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    sums = both.groupBy(F.col("x.node").alias("node")).agg(F.sum("x.i").alias("n_in"), F.sum("x.o").alias("n_out"))
    score = F.least(F.lit(incoming[1]), F.col("n_in") * incoming[0]) + F.least(F.lit(outgoing[1]), F.col("n_out") * outgoing[0])
    return sums.withColumn("score", score.cast("long"))


def import_candidates(module: Column, imported: Column, name: Column, kind: Column, level: Column, is_package: Column) -> Column:
    """Ordered modules that an import can mean; none for a relative one that leaves the package."""
    parts = F.split(module, r"\.")
    package = F.when(is_package, parts).otherwise(F.slice(parts, 1, F.size(parts) - 1))
    hops = F.size(package) - (level - 1)
    base = F.array_join(F.slice(package, 1, F.greatest(hops, F.lit(0))), ".")
    part = F.coalesce(imported, F.lit(""))
    relative = F.when(part == "", base).otherwise(F.concat_ws(".", F.nullif(base, F.lit("")), part))
    prefix = F.when(level > 0, relative).otherwise(part)
    named = F.when(name.isNotNull() & (name != "*"), F.concat_ws(".", F.nullif(prefix, F.lit("")), name))
    bare = F.when(~((level > 0) & (part == "")) & (prefix != ""), prefix)
    of_from = F.array_compact(F.array(named, bare))
    none = F.array().cast("array<string>")
    return F.when((level > 0) & (hops < 0), none).when(kind == "import", F.array(part)).otherwise(of_from)


def resolve_imports(references: DataFrame, modules: DataFrame, scope: str = "export_id") -> DataFrame:
    """References with ``target_module`` and ``resolution`` ('local', 'external', 'unresolved'): the first candidate that is a module.

    Candidates are exploded with their place and joined by equality, so that a lookup never compares names otherwise.
    ``references`` need ``reference_id`` besides the fields of an import; ``modules`` are (scope, module, path).
    """
    own = modules.groupBy(scope, "module").agg(F.min("path").alias("path"))
    packages = own.select(scope, F.col("module").alias("source_module"), F.col("path").endswith("__init__.py").alias("is_package"))
    known = references.join(packages, [scope, "source_module"], "left").withColumn("is_package", F.coalesce("is_package", F.lit(False)))
    candidates = import_candidates(F.col("source_module"), F.col("imported_module"), F.col("imported_name"), F.col("import_type"), F.col("level"), F.col("is_package"))
    tried = known.select(scope, "reference_id", F.posexplode(candidates).alias("place", "module"))
    hits = tried.join(own, [scope, "module"]).groupBy(scope, "reference_id").agg(F.min(F.struct("place", "module", "path")).alias("hit"))
    joined = references.join(hits, [scope, "reference_id"], "left")
    resolution = F.when(F.col("hit").isNotNull(), "local").when(F.col("level") > 0, "unresolved").otherwise("external")
    return joined.withColumn("target_module", F.col("hit.module")).withColumn("target_path", F.col("hit.path")).withColumn("resolution", resolution).drop("hit")


def resolve_by_suffix(calls: DataFrame, symbols: DataFrame, call: str = "callee", key: str = "qualified_name") -> DataFrame:
    """``call`` resolved to a path: the exact key, else the one path of all keys that end in ``.call``; ambiguous or unknown is null.

    Every dotted suffix of a key becomes a row, so that the lookup of suffixes is a join by equality.
    """
    parts = F.split(key, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    ends = symbols.select("path", F.posexplode(suffixes).alias("cut", "ending"))
    exact = ends.where("cut = 0").groupBy("ending").agg(F.min("path").alias("exact_path"))
    loose = ends.groupBy("ending").agg(F.min("path").alias("loose_path"), F.count_distinct("path").alias("n_paths")).where("n_paths = 1")
    joined = calls.join(exact, calls[call] == exact["ending"], "left").drop("ending").join(loose.select("ending", "loose_path"), F.col(call) == F.col("ending"), "left").drop("ending")
    return joined.withColumn("resolved_path", F.coalesce("exact_path", "loose_path")).drop("exact_path", "loose_path")


def _suffixes(name: Column) -> Column:
    parts = F.split(name, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def resolve_aliases(aliases: DataFrame, edges: DataFrame, source: str, order: str) -> DataFrame:
    """``aliases`` with the target of the first edge of their source that they can mean, and whether there is one.

    Modules match if one is the other or ends in it after a dot; a name imported from a module must be the edge's name, too.
    Aliases are (source, alias_id, import_type, imported_module, imported_name), edges (source, target_module, edge_name,
    order). Both ways of ending are joins by equality on exploded suffixes.
    """
    own = edges.select(source, "target_module", "edge_name", order)
    longer = aliases.withColumn("ending", F.explode(_suffixes(F.col("imported_module")))).join(own.withColumn("ending", F.col("target_module")), [source, "ending"])
    shorter = aliases.withColumn("ending", F.col("imported_module")).join(own.withColumn("ending", F.explode(_suffixes(F.col("target_module")))), [source, "ending"])
    fits = (F.col("import_type") == "import") | F.col("imported_name").eqNullSafe(F.col("edge_name"))
    hits = longer.unionByName(shorter).where(fits).groupBy(source, "alias_id").agg(F.min(F.struct(order, "target_module")).alias("hit"))
    joined = aliases.join(hits, [source, "alias_id"], "left")
    return joined.withColumn("target_module", F.col("hit.target_module")).withColumn("is_local", F.col("hit").isNotNull()).drop("hit")


def single_definitions(aliases: DataFrame, symbols: DataFrame, module: str = "target_module") -> DataFrame:
    """Aliases whose target module defines exactly one top-level function of the imported name."""
    once = symbols.where("kind = 'function'").groupBy(F.col("module").alias(module), F.col("name").alias("imported_name")).agg(F.count("*").alias("n")).where("n = 1").drop("n")
    return aliases.join(once, [module, "imported_name"], "left_semi")


# trees


def tree_rows(files: DataFrame, scope: str) -> DataFrame:
    """``scope, path, parent, depth, entry_type`` of every file and every folder above one."""
    rows = files.select(scope, F.explode(F.concat(F.array(F.struct(F.col("path"), F.lit("file").alias("entry_type"))), F.transform(paths.ancestors(F.col("path")), lambda a: F.struct(a.alias("path"), F.lit("directory").alias("entry_type"))))).alias("x"))
    found = rows.select(scope, "x.path", "x.entry_type").distinct()
    above = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    return found.select(scope, "path", above.alias("parent"), paths.depth(F.col("path")).alias("depth"), "entry_type")


def preorder(tree: DataFrame, scope: str) -> DataFrame:
    """The place of each row when parents come before children and children are sorted by name."""
    return tree.withColumn("place", F.row_number().over(Window.partitionBy(scope).orderBy(F.split("path", "/"), "entry_type")))


def drawn(tree: DataFrame, scope: str) -> DataFrame:
    """Rows with ``line``: the name behind guides that show whether each ancestor is the last of its siblings."""
    siblings = Window.partitionBy(scope, "parent").orderBy(paths.name(F.col("path")), "entry_type")
    marked = tree.withColumn("last", F.lead("path").over(siblings).isNull())
    above = marked.select(scope, "path", F.explode(F.concat(paths.ancestors(F.col("path")), F.array("path"))).alias("at"))
    flags = marked.where("entry_type = 'directory'").select(scope, F.col("path").alias("at"), F.col("last").alias("at_last"))
    guides = above.where("at <> path").join(flags, [scope, "at"]).groupBy(scope, "path").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(F.length("at").alias("n"), F.when(F.col("at_last"), "    ").otherwise("|   ").alias("guide")))), lambda x: x["guide"]), "").alias("guide"))
    joined = marked.join(guides, [scope, "path"], "left")
    return joined.withColumn("line", F.concat(F.coalesce("guide", F.lit("")), F.when(F.col("last"), "`-- ").otherwise("|-- "), paths.name(F.col("path"))))


def deepest_folder(files: DataFrame, folders: DataFrame, scope: str) -> DataFrame:
    """The deepest of ``folders`` (scope, folder) that contains each file; null if none does.

    The folders above a file become rows, so that containment is a join by equality.
    """
    above = files.select(scope, "entry_id", F.posexplode(paths.ancestors(F.col("path"))).alias("level", "folder"))
    hits = above.join(folders.select(scope, "folder").distinct(), [scope, "folder"]).groupBy(scope, "entry_id").agg(F.max(F.struct("level", "folder")).alias("hit"))
    return files.join(hits, [scope, "entry_id"], "left").withColumn("folder", F.col("hit.folder")).drop("hit")


def conflicts(files: DataFrame, scope: str) -> DataFrame:
    """Paths that are a file and a folder at once."""
    return tree_rows(files, scope).groupBy(scope, "path").agg(F.count_distinct("entry_type").alias("n")).where("n > 1").select(scope, "path")


def strip_src(path: Column) -> Column:
    return F.regexp_replace(path, "^src/", "")


def duplicate_siblings(files: DataFrame, scope: str) -> DataFrame:
    """Paths of a scope that differ in case only: ``scope, low_path, n``."""
    return files.groupBy(scope, F.lower("path").alias("low_path")).agg(F.count("*").alias("n")).where("n > 1")

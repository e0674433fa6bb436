"""Queries over graphs, trees and what source files define, each with its SQL where SQL can say it.

The edges come from ``lineitem``: suppliers import parts. Sources that are rendered from rows and read again by the table
functions give those functions a SQL counterpart; the same functions also run over the files themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.common import table, with_language
from lodestack.operators import extract, graph, project, ranking, repository
from lodestack.plans.file_queries import SQL_FILES, files, texts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SQL_EDGES = "edges as (select 's' || l_suppkey as source_module, 'p' || l_partkey as target_module, l_orderkey, l_linenumber from lineitem)"
SQL_MODULES = "modules as (select 's' || s_suppkey as module from supplier union select 'p' || p_partkey from part)"


#: The file that a row of ``part`` is written to: their number grows with the table.
FILE = "p_partkey div 25"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source_module"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target_module"), "l_orderkey", "l_linenumber"
    )


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("module"))
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("module"))
    return s.union(p).distinct()


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


@query("ref_g2_first_edges", f"with {SQL_EDGES} select source_module, target_module, l_orderkey, l_linenumber from edges qualify row_number() over (partition by source_module, target_module order by l_orderkey, l_linenumber) = 1")
def g2(spark, sf_dir):
    return graph.first_seen(edges(spark, sf_dir), ["source_module", "target_module"], ["l_orderkey", "l_linenumber"])


@query(
    "ref_g3_adjacency",
    f"""with {SQL_EDGES}, {SQL_MODULES} select module, array_to_string(coalesce((select list(distinct target_module order by target_module) from edges e where e.source_module = module), []), ',') as depends_on,
    array_to_string(coalesce((select list(distinct source_module order by source_module) from edges e where e.target_module = module), []), ',') as used_by from modules""",
)
def g3(spark, sf_dir):
    found = graph.adjacency(modules(spark, sf_dir), edges(spark, sf_dir))
    return found.select("module", F.array_join("depends_on", ",").alias("depends_on"), F.array_join("used_by", ",").alias("used_by"))


@query("ref_g4_roots", f"with {SQL_EDGES}, {SQL_MODULES} select module from modules where module not in (select target_module from edges)")
def g4(spark, sf_dir):
    return graph.roots(modules(spark, sf_dir), edges(spark, sf_dir))


@query("ref_g5_leaves", f"with {SQL_EDGES}, {SQL_MODULES} select module from modules where module not in (select source_module from edges)")
def g5(spark, sf_dir):
    return graph.leaves(modules(spark, sf_dir), edges(spark, sf_dir))


@query(
    "ref_a14_graph_metrics",
    f"with {SQL_EDGES}, {SQL_MODULES}, e as (select distinct source_module, target_module from edges) select (select count(*) from modules) as n_modules, (select count(*) from e) as n_edges, (select count(*) from modules where module not in (select target_module from e)) as n_roots, (select count(*) from modules where module not in (select source_module from e)) as n_leaves",
)
def a14(spark, sf_dir):
    return graph.metrics(modules(spark, sf_dir), edges(spark, sf_dir).select("source_module", "target_module").distinct())


_CENTRALITY = "pairs as (select distinct source_module as s, target_module as t from edges where source_module <> target_module), ends as (select s as node, 0 as i, 1 as o from pairs union all select t, 1, 0 from pairs), c as (select node, sum(i)::bigint as n_in, sum(o)::bigint as n_out from ends group by all), scored as (select *, (least(120, 35 * n_in) + least(32, 8 * n_out))::bigint as score from c)"


@query("ref_g10_import_centrality", f"with {SQL_EDGES}, {_CENTRALITY} select node, n_in, n_out, score from scored")
def g10(spark, sf_dir):
    return graph.centrality(edges(spark, sf_dir), "source_module", "target_module", *ranking.IMPORT_POINTS)


@query("ref_l3_top_ranked", f"with {SQL_EDGES}, {_CENTRALITY} select node, n_in, n_out, score from scored order by n_in desc, node limit 20")
def l3(spark, sf_dir):
    return graph.centrality(edges(spark, sf_dir), "source_module", "target_module", *ranking.IMPORT_POINTS).orderBy(F.desc("n_in"), "node").limit(20)


@query(
    "ref_j3_resolved_references",
    """with own as (select distinct export_id, case when file_path like '%/__init__.py' then file_path else file_path end as path from symbols where file_path like '%.py'),
    m as (select export_id, path, string_split(regexp_replace(regexp_replace(path, '\\.py$', ''), '^src/', ''), '/') as parts from own),
    mods as (select export_id, min(path) as path, array_to_string(parts, '.') as module from m where parts[-1] <> '__init__' and len(list_filter(parts, lambda x: not regexp_full_match(x, '[A-Za-z_][A-Za-z0-9_]*'))) = 0 group by all),
    refs as (select distinct s.export_id, s.file_path, s.name, m.module as source_module from symbols s join mods m on m.export_id = s.export_id and m.path = s.file_path),
    r as (select export_id, source_module, name, array_to_string(string_split(source_module, '.')[:-2], '.') as base from refs)
    select r.export_id, r.source_module, r.name, coalesce(a.module, b.module) as target_module, case when coalesce(a.module, b.module) is null then 'unresolved' else 'local' end as resolution
    from r left join mods a on a.export_id = r.export_id and a.module = case when base = '' then '' else base || '.' end || string_split(r.source_module, '.')[-1] || '.' || r.name
      left join mods b on b.export_id = r.export_id and b.module = case when base = '' then '' else base || '.' end || string_split(r.source_module, '.')[-1]""",
)
def j3(spark, sf_dir):
    """Every symbol as if its own module were imported from a sibling: ``from .module import symbol``."""
    from lodestack.functions.paths import module_name

    symbols = table(spark, sf_dir, "symbols").where("file_path like '%.py'").select("export_id", F.col("file_path").alias("path"), "name", module_name(F.col("file_path")).alias("module"))
    symbols = symbols.where("module is not null and path not like '%/__init__.py' and path <> '__init__.py'").distinct()
    own = symbols.select("export_id", "module", "path").distinct()
    least = own.groupBy("export_id", "module").agg(F.min("path").alias("path"))
    references = (
        symbols.join(least, ["export_id", "module", "path"], "left_semi")
        .select("export_id", F.xxhash64("module", "name").alias("reference_id"), F.col("module").alias("source_module"), F.element_at(F.split("module", r"\."), -1).alias("imported_module"), F.col("name").alias("imported_name"), F.lit("from").alias("import_type"), F.lit(1).alias("level"))
    )
    found = graph.resolve_imports(references, own)
    return found.select("export_id", "source_module", F.col("imported_name").alias("name"), "target_module", "resolution")


@query(
    "ref_j8_suffix_resolution",
    """with keys as (select distinct file_path as path, case when parent is null then replace(regexp_replace(file_path, '\\.[a-z]+$', ''), '/', '.') || '.' || name else replace(regexp_replace(file_path, '\\.[a-z]+$', ''), '/', '.') || '.' || parent || '.' || name end as key from symbols),
    calls as (select distinct case when parent is null then name else parent || '.' || name end as callee from symbols),
    ends as (select path, array_to_string(string_split(key, '.')[i:], '.') as ending, i from (select path, key, unnest(range(1, len(string_split(key, '.')) + 1)) as i from keys)),
    loose as (select ending, min(path) as path from ends group by ending having count(distinct path) = 1), exact as (select ending, min(path) as path from ends where i = 1 group by all)
    select callee, coalesce(exact.path, loose.path) as resolved_path from calls left join exact on exact.ending = callee left join loose on loose.ending = callee""",
)
def j8(spark, sf_dir):
    symbols = table(spark, sf_dir, "symbols")
    base = F.replace(F.regexp_replace("file_path", r"\.[a-z]+$", ""), F.lit("/"), F.lit("."))
    keys = symbols.select(F.col("file_path").alias("path"), F.concat_ws(".", base, "parent", "name").alias("qualified_name")).distinct()
    calls = symbols.select(F.concat_ws(".", "parent", "name").alias("callee")).distinct()
    return graph.resolve_by_suffix(calls, keys).select("callee", "resolved_path")


_TREE = f"""{SQL_FILES}, up as (select export_id, path, 'file' as entry_type from files union select export_id, array_to_string(string_split(path, '/')[:i], '/'), 'directory' from (select export_id, path, unnest(range(1, len(string_split(path, '/')))) as i from files)),
    tree as (select export_id, path, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '' end as parent, len(string_split(path, '/'))::int as depth, entry_type from up)"""


@query("ref_g12_tree", f"with {_TREE} select export_id, path, parent, depth, entry_type from tree")
def g12(spark, sf_dir):
    return graph.tree_rows(files(spark, sf_dir, "export_id", "path"), "export_id")


@query("ref_g13_preorder", f"with {_TREE} select export_id, path, row_number() over (partition by export_id order by string_split(path, '/'), entry_type)::int as place from tree")
def g13(spark, sf_dir):
    return graph.preorder(graph.tree_rows(files(spark, sf_dir, "export_id", "path"), "export_id"), "export_id").select("export_id", "path", "place")


@query(
    "ref_g14_drawn_tree",
    f"""with {_TREE}, marked as (select *, lead(path) over (partition by export_id, parent order by regexp_extract(path, '([^/]*)$', 1), entry_type) is null as last from tree),
    above as (select m.export_id, m.path, m.entry_type, string_agg(case when a.last then '    ' else '|   ' end, '' order by length(a.path)) as guide from marked m join marked a on a.export_id = m.export_id and a.entry_type = 'directory' and starts_with(m.path, a.path || '/') group by all)
    select m.export_id, m.path, coalesce(a.guide, '') || case when m.last then '`-- ' else '|-- ' end || regexp_extract(m.path, '([^/]*)$', 1) as line from marked m left join above a on a.export_id = m.export_id and a.path = m.path and a.entry_type = m.entry_type""",
)
def g14(spark, sf_dir):
    return graph.drawn(graph.tree_rows(files(spark, sf_dir, "export_id", "path"), "export_id"), "export_id").select("export_id", "path", "line")


@query(
    "ref_j14_deepest_folder",
    f"with {SQL_FILES}, folders as (select distinct export_id, regexp_replace(path, '/[^/]*$', '') as folder from files where path like '%__init__.py' or path like '%.md'), h as (select f.export_id, f.entry_id, max(struct_pack(n := length(d.folder), folder := d.folder)) as hit from files f left join folders d on d.export_id = f.export_id and starts_with(f.path, d.folder || '/') group by all) select export_id, entry_id, hit.folder as folder from h",
)
def j14(spark, sf_dir):
    own = files(spark, sf_dir, "export_id", "path")
    folders = own.where("path like '%__init__.py' or path like '%.md'").select("export_id", F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
    return graph.deepest_folder(own, folders, "export_id").select("export_id", "entry_id", "folder")


@query(
    "ref_j15_path_conflicts",
    """with p as (select distinct o_orderstatus, 'c' || o_custkey || case when o_totalprice < 150000 then '' else '/' || o_orderkey end as path from orders),
    up as (select o_orderstatus, path, 'file' as t from p union select o_orderstatus, regexp_replace(path, '/[^/]*$', ''), 'directory' from p where contains(path, '/'))
    select o_orderstatus, path from up group by all having count(distinct t) > 1""",
)
def j15(spark, sf_dir):
    """Customers as files by their cheap orders and as folders by the others."""
    path = F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.when(F.col("o_totalprice") < 150_000, "").otherwise(F.concat(F.lit("/"), F.col("o_orderkey").cast("string"))))
    return graph.conflicts(table(spark, sf_dir, "orders").select("o_orderstatus", path.alias("path")).distinct(), "o_orderstatus")


# sources rendered from rows and read again


def _rendered(rows: DataFrame, key: str, order: str, line: str, separator: str = "\n") -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.expr(line).alias("line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), separator).alias("content"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("k")).distinct()


_PARTS = "parts as (select distinct l_suppkey, l_partkey as k from lineitem)"


@query("ref_x3_imports_read_again", f"with {_PARTS} select l_suppkey, 'p' || k as imported_module, row_number() over (partition by l_suppkey order by k)::int as line_number from parts")
def x3(spark, sf_dir):
    texts = _rendered(_parts(spark, sf_dir), "l_suppkey", "k", "concat('import p', k)")
    return extract.python_imports(texts, "l_suppkey").select("l_suppkey", "imported_module", "line_number")


@query(
    "ref_x1_symbols_read_again",
    f"with {_PARTS} select l_suppkey, 'f' || k as name, 'function' as kind, null::varchar as parent from parts where k % 2 = 0 union all select l_suppkey, 'C' || k, 'class', null from parts where k % 2 = 1 union all select l_suppkey, 'm' || k, 'method', 'C' || k from parts where k % 2 = 1",
)
def x1(spark, sf_dir):
    line = "if(k % 2 = 0, concat('def f', k, '():\\n    return ', k), concat('class C', k, ':\\n    def m', k, '(self):\\n        def inner():\\n            pass'))"
    return extract.python_symbols(_rendered(_parts(spark, sf_dir), "l_suppkey", "k", line), "l_suppkey").select("l_suppkey", "name", "kind", "parent")


_CHAIN = "parts as (select distinct l_suppkey, l_partkey as k from lineitem), chain as (select *, lead(k) over (partition by l_suppkey order by k) as n, lag(k) over (partition by l_suppkey order by k) as b from parts)"


def _chain(spark: SparkSession, sf_dir: str, content: str, path: str) -> DataFrame:
    """One file for each part of a supplier, which knows the next part, ``n``."""
    parts = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("k")).repartition("l_suppkey").distinct()  # shuffled once for both
    rows = parts.withColumn("n", F.lead("k").over(Window.partitionBy("l_suppkey").orderBy("k")))
    return rows.select(F.concat_ws("/", "l_suppkey", "k").alias("entry_id"), "l_suppkey", F.expr(path).alias("path"), F.expr(content).alias("content"))


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = "concat(if(n is null, '', concat('from m', n, ' import f', n, ' as later\\n')), 'import os\\n\\ndef f', k, '():\\n    return later(os.stat(g()))\\n')"
    return _chain(spark, sf_dir, content, "concat('m', k, '.py')")


@query(
    "ref_j7_calls_read_again",
    f"""with {_CHAIN} select l_suppkey, 'f' || k as caller, 'later' as callee, case when n is null then 'unresolved' else 'imported_local' end as confidence, 'm' || n || '.f' || n as callee_qualified_name, 'm' || n || '.py' as target_path from chain
    union all select l_suppkey, 'f' || k, 'stat', 'external', 'os.stat', null from chain union all select l_suppkey, 'f' || k, 'g', 'unresolved', null, null from chain""",
)
def j7_again(spark, sf_dir):
    """Every supplier is a repository, every part of it a module that imports the next one's function."""
    return repository.resolved_calls(_modules(spark, sf_dir), "l_suppkey", ("l_suppkey", "caller", "callee", "confidence", "callee_qualified_name", "target_path"))


@query("ref_a15_confidence_read_again", f"with {_CHAIN} select case when n is null then 'unresolved' else 'imported_local' end as confidence, count(*) as n_calls from chain group by 1 having confidence = 'imported_local' union all select 'unresolved', count(*) + count(*) filter (n is null) from chain union all select 'external', count(*) from chain")
def a15_again(spark, sf_dir):
    return repository.resolved_calls(_modules(spark, sf_dir), "l_suppkey", ("confidence",)).groupBy("confidence").agg(F.count("*").alias("n_calls"))


@query("ref_p15_classes_read_again", f"with {_CHAIN} select 'internal' as call_class, count(n) as n_calls from chain union all select 'unresolved', count(*) + count(*) filter (n is null) from chain union all select 'external', count(*) from chain")
def p15_again(spark, sf_dir):
    return j7_again(spark, sf_dir).groupBy(project.call_class(F.col("confidence")).alias("call_class")).agg(F.count("*").alias("n_calls"))


@query(
    "ref_g6_imports_read_again",
    f"with {_CHAIN} select l_suppkey, 'm' || k as source_module, 'm' || n as imported_module, 'f' || n as imported_name, 'm' || n as target_module, 'local' as resolution from chain where n is not null union all select l_suppkey, 'm' || k, 'os', null, null, 'external' from chain",
)
def g6_again(spark, sf_dir):
    own = _modules(spark, sf_dir)
    return extract.PythonFacts(own, calls=False).resolved_imports(own, "l_suppkey").select("l_suppkey", "source_module", "imported_module", "imported_name", "target_module", "resolution")


@query(
    "ref_j10_ranked_read_again",
    f"""with {_CHAIN}, p as (select l_suppkey, 'm' || k || '.py' as path, (case when b is null then 0 else 35 + 35 end + case when n is null then 0 else 8 + 6 end)::bigint as score,
      concat_ws('; ', case when b is not null then 'imported by 1' end, case when n is not null then 'imports 1' end, case when b is not null then 'called from 1' end, case when n is not null then 'calls into 1' end) as reasons from chain)
    select l_suppkey, path, score, reasons, row_number() over (partition by l_suppkey order by score desc, path)::int as place from p where score > 0""",
)
def j10_again(spark, sf_dir):
    return ranking.rank_repositories(_modules(spark, sf_dir), "l_suppkey")


@query(
    "ref_j9_script_paths",
    f"with {_CHAIN} select l_suppkey, 'src/m' || k || '.py' as path from chain where b is not null",
)
def j9(spark, sf_dir):
    """Every supplier's project file starts the module of each part but the first, and one that isn't there."""
    own = _chain(spark, sf_dir, "''", "concat('src/m', k, '.py')")
    line = F.concat(F.lit("run"), F.col("k").cast("string"), F.lit(' = "m'), F.coalesce(F.col("n").cast("string"), F.lit("issing")), F.lit(':main"'))
    rows = _parts(spark, sf_dir).withColumn("n", F.lead("k").over(Window.partitionBy("l_suppkey").orderBy("k"))).select("l_suppkey", "k", line.alias("line"))
    listed = rows.groupBy("l_suppkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    scripts = extract.console_scripts(listed.select("l_suppkey", F.concat(F.lit("[project.scripts]\n"), "lines", F.lit('\n[tool.other]\nx = "m1:main"\n')).alias("content")), "l_suppkey")
    return extract.script_paths(scripts, own, "l_suppkey")


@query(
    "ref_j16_shell_calls_read_again",
    f"with {_CHAIN} select l_suppkey, 'f' || k as caller, 'f' || n as callee, l_suppkey || '/' || n as callee_file from chain where n is not null",
)
def j16_again(spark, sf_dir):
    """One script for each part of a supplier, which calls the function of the next one's script."""
    own = _chain(spark, sf_dir, "concat('f', k, '() {\\n  ', if(n is null, ':', concat('f', n, ' --all | sort')), '\\n}\\n')", "concat('f', k, '.sh')")
    return extract.bash_call_edges(own, scope=F.col("l_suppkey")).join(own.select("entry_id", "l_suppkey"), "entry_id").select("l_suppkey", "caller", "callee", "callee_file")


@query("ref_x4_calls_read_again", f"with {_PARTS} select l_suppkey, 'f' || k as caller, 'g' || (k + 1) as callee from parts union all select l_suppkey, 'f' || k, 'h' from parts")
def x4(spark, sf_dir):
    line = "concat('def f', k, '():\\n    return g', k + 1, '(h(', k, '))')"
    return extract.python_calls(_rendered(_parts(spark, sf_dir), "l_suppkey", "k", line), "l_suppkey").select("l_suppkey", "caller", "callee")


@query(
    "ref_x5_shell_calls_read_again",
    f"with {_PARTS} select distinct a.l_suppkey, 'f' || a.k as caller, 'f' || (a.k + 1) as callee from parts a join parts b on b.l_suppkey = a.l_suppkey and b.k = a.k + 1",
)
def x5(spark, sf_dir):
    line = "concat('f', k, '() {\\n  # f', k + 1, '\\n  if true; then f', k + 1, ' \"f', k + 2, '\"; fi\\n}')"
    return extract.bash_call_edges(_rendered(_parts(spark, sf_dir), "l_suppkey", "k", line), "l_suppkey").select("l_suppkey", "caller", "callee")


@query(
    "ref_x6_tables_read_again",
    "with p as (select p_partkey, p_size, unnest(range(0, 3)) as position from part) select 't' || p_partkey as table_name, position::int as position, case position when 0 then 'id' when 1 then 'label' else 'size ' || p_size end as column_name, case position when 0 then 'BIGINT' when 1 then 'VARCHAR(20)' else 'NUMERIC(10, 2)' end as data_type, case position when 0 then false when 2 then true end as nullable, case position when 1 then '''a;b''' end as default_value, position = 0 as is_primary_key from p",
)
def x6(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.expr(FILE).alias("file"), "p_partkey", "p_size")
    line = "concat('-- part ', p_partkey, '; not a statement\\nCREATE TABLE IF NOT EXISTS t', p_partkey, ' (id BIGINT NOT NULL PRIMARY KEY, label VARCHAR(20) DEFAULT ''a;b'', \"size ', p_size, '\" NUMERIC(10, 2) NULL, CHECK (id > 0));')"
    line = line.replace("''a;b''", "\\'a;b\\'")
    return extract.sql_tables(_rendered(rows, "file", "p_partkey", line), "file").drop("file")


@query("ref_x7_dependencies_read_again", "select 'lib-' || p_partkey as normalized_name, '>=' || p_size as version_constraint, case when p_partkey % 3 = 0 then 'optional' else 'runtime' end as dependency_type, case when p_partkey % 3 = 0 then 'extra' end as group_name from part")
def x7(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.expr(FILE).alias("file"), "p_partkey", "p_size")
    item = F.concat(F.lit('"Lib_'), F.col("p_partkey").cast("string"), F.lit(">="), F.col("p_size").cast("string"), F.lit('"'))
    grouped = rows.groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(F.when(F.col("p_partkey") % 3 > 0, item))), ", ").alias("runtime"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("p_partkey") % 3 == 0, item))), ", ").alias("extra"))
    texts = grouped.select("file", F.concat(F.lit('[project]\nname = "x"\ndependencies = ['), "runtime", F.lit("]\n[project.optional-dependencies]\nextra = ["), "extra", F.lit("]\n")).alias("content"))
    return extract.toml_dependencies(texts, "file").select("normalized_name", "version_constraint", "dependency_type", "group_name")


@query(
    "ref_x8_requirements",
    "select p_partkey // 25 as file, 'lib-' || p_partkey as normalized_name, case when p_partkey % 7 = 0 then null else '==' || p_size end as version_constraint, 'runtime' as dependency_type from part union all select distinct p_partkey // 25, null, null, 'warning' from part",
)
def x8(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.expr(FILE).alias("file"), "p_partkey", "p_size")
    texts = _rendered(rows, "file", "p_partkey", "concat('Lib.', p_partkey, if(p_partkey % 7 = 0, '', concat('==', p_size)), if(p_partkey % 5 = 0, '  # pinned', ''))")
    whole = texts.select("file", F.concat(F.lit("# generated rows\n--index-url here\n\n"), "content").alias("content"), F.lit("requirements.txt").alias("path"))
    return extract.requirement_lines(whole, "file").select("file", "normalized_name", "version_constraint", "dependency_type")


@query("ref_a11_dependency_counts", "with d as (select case when p_partkey % 3 = 0 then 'optional' else 'runtime' end as t from part), o(position, dependency_type) as (values (0, 'runtime'), (1, 'development'), (2, 'optional'), (3, 'unknown')) select position, dependency_type, count(d.t) as n_dependencies from o left join d on d.t = o.dependency_type group by all")
def a11(spark, sf_dir):
    return extract.dependency_counts(x7(spark, sf_dir))


# over the files themselves


def _of_language(spark: SparkSession, sf_dir: str, language: str, *columns: str) -> DataFrame:
    """Texts of one language as they are read; what is found in equal rows is made one afterwards."""
    rows = table(spark, sf_dir, "file_entries").where("content is not null")
    return with_language(rows, table(spark, sf_dir, "languages")).where(F.col("lang") == language).select("entry_id", *columns, "content")


def _facts(spark: SparkSession, sf_dir: str, calls: bool = True) -> extract.PythonFacts:
    return extract.PythonFacts(_of_language(spark, sf_dir, "python"), calls=calls)


@query("ref_x1_python_symbols")
def x1_files(spark, sf_dir):
    return extract.python_symbols(_of_language(spark, sf_dir, "python")).distinct()


@query("ref_x3_python_imports")
def x3_files(spark, sf_dir):
    return extract.python_imports(_of_language(spark, sf_dir, "python")).distinct()


@query("ref_g6_import_graph")
def g6(spark, sf_dir):
    """Imports of every Python file, resolved within its export."""
    found = _facts(spark, sf_dir, calls=False).resolved_imports(files(spark, sf_dir, "export_id", "path"), "export_id")
    return found.select("export_id", "source_module", "import_type", "imported_module", "imported_name", "line_number", "target_module", "resolution")


@query("ref_j7_resolved_calls")
def j7(spark, sf_dir):
    found = _facts(spark, sf_dir).resolved_calls(files(spark, sf_dir, "export_id", "path"), "export_id")
    return found.select("entry_id", "caller", "callee", "line_number", "visit_ord", "confidence", "callee_qualified_name", "target_path")


@query("ref_a15_call_confidence")
def a15(spark, sf_dir):
    return j7(spark, sf_dir).groupBy("confidence").agg(F.count("*").alias("n_calls"))


@query("ref_j16_shell_call_graph")
def j16(spark, sf_dir):
    return extract.bash_call_edges(_of_language(spark, sf_dir, "bash", "export_id"), scope=F.col("export_id"))


@query("ref_x7_toml_dependencies")
def x7_files(spark, sf_dir):
    return extract.toml_dependencies(_of_language(spark, sf_dir, "toml")).distinct()


@query("ref_j10_ranked_files")
def j10(spark, sf_dir):
    """Files of every export by importance: imports, calls of imported functions, console scripts, documentation and structure."""
    own = files(spark, sf_dir, "export_id", "path", ranking.structure_score(F.col("path"), F.col("content")).alias("structure"))
    scripts = extract.console_scripts(table(spark, sf_dir, "file_entries").where("path = 'pyproject.toml' or path like '%/pyproject.toml'")).distinct().join(own.select("entry_id", "export_id"), "entry_id")
    return ranking.rank_repository(_facts(spark, sf_dir), own, "export_id", scripts)


@query(
    "ref_x10_purpose",
    "with l as (select doc_id, list_filter(list_transform(string_split_regex(text, '\\r?\\n'), lambda x: trim(x)), lambda x: x <> '') as lines from documents where text is not null) select doc_id, coalesce(list_filter(lines, lambda x: not starts_with(x, '#'))[1], trim(regexp_replace(lines[1], '^#+', ''))) as purpose from l",
)
def x10(spark, sf_dir):
    return extract.purpose(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content")), "doc_id")


@query("ref_x13_definition_lines", f"with {SQL_FILES} select entry_id, len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^\\s*(?:def|class|async def)\\s')))::int as n_definitions from files where content is not null")
def x13(spark, sf_dir):
    return texts(spark, sf_dir, extract.definition_lines(F.col("content")).alias("n_definitions"))

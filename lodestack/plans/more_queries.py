"""Further queries over projects, calls, merges and report parts, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.common import table
from lodestack.functions import paths, text
from lodestack.operators import changes, extract, graph, project, ranking, report, selection, stats
from lodestack.plans.file_queries import SQL_FILES, SQL_LANG, files, known, sql_lines, sql_suffix, texts
from lodestack.plans.graph_queries import SQL_EDGES, edges

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


_NAME = r"regexp_extract({p}, '([^/]*)$', 1)"
_SYMBOLS = "s as (select distinct export_id, file_path, name, kind, parent, line_start from symbols)"


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "symbols").select("export_id", "file_path", "name", "kind", "parent", "line_start").distinct()


@query(
    "ref_a4_builder_summary",
    f"with {SQL_FILES} select export_id, coalesce(nullif(regexp_extract({_NAME.format(p='path')}, '[^.](\\.[^.]+)$', 1), ''), '[no extension]') as file_type, count(*) as n_files, count(*) filter (status = 'skipped' and text_status = 'binary') as n_skipped from files group by all",
)
def a4(spark, sf_dir):
    kept = F.coalesce(F.nullif(F.regexp_extract(paths.name(F.col("path")), r"[^.](\.[^.]+)$", 1), F.lit("")), F.lit(stats.NO_SUFFIX))
    return files(spark, sf_dir, "export_id", "path", "status", "text_status").groupBy("export_id", kept.alias("file_type")).agg(F.count("*").alias("n_files"), F.count_if((F.col("status") == "skipped") & (F.col("text_status") == "binary")).alias("n_skipped"))


@query("ref_a16_ambiguous_symbols", f"with {_SYMBOLS} select export_id, name, count(*) as n from s group by all having count(*) > 1")
def a16(spark, sf_dir):
    return project.ambiguous(_symbols(spark, sf_dir), ["export_id", "name"])


@query(
    "ref_a17_merged_counts",
    f"with {_SYMBOLS}, a as (select export_id, name, count(*) as n from s where kind = 'function' group by all), b as (select export_id, name, count(*) as n from s where kind <> 'function' group by all) select coalesce(a.export_id, b.export_id) as export_id, coalesce(a.name, b.name) as name, coalesce(a.n, b.n) as n from a full join b on a.export_id = b.export_id and a.name = b.name",
)
def a17(spark, sf_dir):
    s = _symbols(spark, sf_dir)
    count = lambda df: df.groupBy("export_id", "name").agg(F.count("*").alias("n"))
    return project.merged_counts(count(s.where("kind = 'function'")), count(s.where("kind <> 'function'")), ["export_id", "name"])


@query("ref_a18_imported_names", f"with {SQL_EDGES}, d as (select distinct source_module, target_module from edges), r as (select *, row_number() over (partition by source_module order by target_module) as place, count(*) over (partition by source_module) as n from d) select source_module, string_agg(target_module, ',' order by target_module) as first_names, greatest(max(n) - 20, 0)::bigint as more from r where place <= 20 group by source_module")
def a18(spark, sf_dir):
    names = selection.capped(edges(spark, sf_dir).select("source_module", "target_module").distinct(), ["source_module"], ["target_module"], 20)
    return names.groupBy("source_module").agg(F.array_join(F.array_sort(F.collect_list("target_module")), ",").alias("first_names"), F.max("more").alias("more"))


@query(
    "ref_p13_documentation_entries",
    f"""with {SQL_FILES}, {SQL_LANG} select entry_id from known where regexp_matches(lower(path), '(?:^|/)docs?/') or regexp_replace({_NAME.format(p='lower(path)')}, '\\.[^.]*$', '') in ('readme', 'license', 'changelog', 'contributing', 'code_of_conduct', 'security', 'authors', 'notice')
    or regexp_matches({_NAME.format(p='lower(path)')}, '\\.(?:md|markdown|rst|txt|adoc)$') or (coalesce(lang in ('markdown', 'rst', 'text'), false) and not contains(path, '/'))""",
)
def p13(spark, sf_dir):
    return known(spark, sf_dir).where(project.is_documentation_entry(F.col("path"), F.col("lang"))).select("entry_id")


@query("ref_p10_ranking_candidates", f"with {SQL_FILES} select entry_id from files where text_status = 'text' and coalesce(status, '') <> 'error' and lower({_NAME.format(p='path')}) not in ('full.txt', 'ai.txt', 'docs.txt', 'changed.txt')")
def p10(spark, sf_dir):
    generated = F.lower(paths.name(F.col("path"))).isin("full.txt", "ai.txt", "docs.txt", "changed.txt")
    return files(spark, sf_dir, "path", "text_status", "status").where((F.col("text_status") == "text") & (F.coalesce("status", F.lit("")) != "error") & ~generated).select("entry_id")


@query("ref_p15_call_classes")
def p15(spark, sf_dir):
    from lodestack.plans.graph_queries import j7

    return j7(spark, sf_dir).groupBy(project.call_class(F.col("confidence")).alias("call_class")).agg(F.count("*").alias("n_calls"))


@query("ref_p20_filtered_known_files", f"with {SQL_FILES}, {SQL_LANG} select entry_id, path from known where status in ('included', 'truncated') and lang in ('python', 'bash')")
def p20(spark, sf_dir):
    return known(spark, sf_dir, "status").where(F.col("status").isin("included", "truncated") & F.col("lang").isin("python", "bash")).select("entry_id", "path")


@query(
    "ref_p21_kept_sections",
    f"""with {SQL_FILES}, r as (select export_id, '## ' || path || chr(10) || chr(10) || status || chr(10) as section, path, entry_id from files), t as (select export_id, '# Changes' || chr(10) || string_agg(section, chr(10) order by path, entry_id) filter (not (path = 'src' or starts_with(path, 'src/'))) as text from r group by all)
    select export_id, md5(coalesce(text, '# Changes')) as digest from t""",
)
def p21(spark, sf_dir):
    rows = files(spark, sf_dir, "export_id", "path", "status").withColumn("section", F.concat(F.lit("## "), "path", F.lit("\n\n"), "status", F.lit("\n")))
    whole = report.assembled(rows, "export_id", ["path", "entry_id"], "section", "\n").withColumn("text", F.concat(F.lit("# Changes\n"), "text"))
    return project.filtered_sections(whole, "export_id", ~paths.matches(F.col("path"), ["src"])).select("export_id", F.md5("text").alias("digest"))


@query("ref_p22_symbol_inputs", f"with {SQL_FILES} select entry_id from files where content is not null and path like '%.py' and (size_bytes is null or size_bytes <= 4000) and len({sql_lines('content')}) <= 100")
def p22(spark, sf_dir):
    own = files(spark, sf_dir, "size_bytes", text.line_count(F.col("content")).alias("lines"), where="content is not null and path like '%.py'")
    return own.where(selection.within_size(F.col("size_bytes"), 4000) & (F.col("lines") <= 100)).select("entry_id")


@query("ref_g7_call_edges", f"with {_SYMBOLS}, e as (select distinct export_id, file_path as caller_file, coalesce(parent, '<module>') as caller, name as callee, coalesce(line_start, -1) as line from s) select export_id, caller_file, caller, callee, line, row_number() over (partition by export_id order by caller_file, caller, line, callee)::int as place from e")
def g7(spark, sf_dir):
    from pyspark.sql import Window

    e = table(spark, sf_dir, "symbols").select("export_id", F.col("file_path").alias("caller_file"), F.coalesce("parent", F.lit("<module>")).alias("caller"), F.col("name").alias("callee"), F.coalesce("line_start", F.lit(-1)).alias("line")).distinct()
    return e.withColumn("place", F.row_number().over(Window.partitionBy("export_id").orderBy("caller_file", "caller", "line", "callee")))


@query(
    "ref_g8_callers_and_callees",
    f"""with {SQL_EDGES}, e as (select distinct source_module as caller, target_module as callee from edges)
    select coalesce(o.caller, i.callee) as symbol, coalesce(n_callers, 0)::bigint as n_callers, coalesce(n_callees, 0)::bigint as n_callees, callers, callees
    from (select callee, count(*) as n_callers, array_to_string(list_sort(list(caller))[:25], ',') as callers from e group by callee) i full join (select caller, count(*) as n_callees, array_to_string(list_sort(list(callee))[:25], ',') as callees from e group by caller) o on o.caller = i.callee""",
)
def g8(spark, sf_dir):
    """Callers and callees of every symbol: how many, and the first 25 of each by name."""
    return graph.callers_and_callees(edges(spark, sf_dir), "source_module", "target_module", 25)


@query("ref_g15_duplicate_siblings", "with p as (select distinct c_nationkey, case when c_acctbal < 1000 then lower(c_mktsegment) else c_mktsegment end as path from customer) select c_nationkey, lower(path) as low_path, count(*) as n from p group by all having count(*) > 1")
def g15(spark, sf_dir):
    """Segments of each nation as folders, spelled in two ways."""
    own = table(spark, sf_dir, "customer").select("c_nationkey", F.when(F.col("c_acctbal") < 1000, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("path")).distinct()
    return graph.duplicate_siblings(own, "c_nationkey")


@query("ref_w2_last_deliveries", "select entry_id, max(loaded_at) as loaded_at, count(*) as n_deliveries from file_entries group by all")
def w2(spark, sf_dir):
    rows = table(spark, sf_dir, "file_entries").select("entry_id", "loaded_at")
    return rows.groupBy("entry_id").agg(F.max("loaded_at").alias("loaded_at"), F.count("*").alias("n_deliveries"))


@query("ref_w7_column_positions", "select p_partkey // 25 as file, 't' || p_partkey as table_name, 3::bigint as n_columns from part")
def w7(spark, sf_dir):
    from lodestack.plans.graph_queries import FILE, _rendered

    rows = table(spark, sf_dir, "part").select(F.expr(FILE).alias("file"), "p_partkey")
    line = "concat('create table t', p_partkey, ' (a int, primary key (a), b int, constraint c check (a > 0), d int);')"
    found = extract.sql_tables(_rendered(rows, "file", "p_partkey", line), "file")
    return found.where("position between 0 and 2").groupBy("file", "table_name").agg(F.count_distinct("position").alias("n_columns"))


@query("ref_l7_would_exceed", f"with {SQL_FILES}, n as (select export_id, sum(strlen(content))::bigint as n_bytes from files where content is not null group by all) select n.export_id, n_bytes, coalesce(n_bytes > max_export_bytes, false) as exceeds from n join exports using (export_id)")
def l7(spark, sf_dir):
    n = texts(spark, sf_dir, "export_id", F.octet_length("content").alias("size")).groupBy("export_id").agg(F.sum("size").alias("n_bytes"))
    return n.join(table(spark, sf_dir, "exports").select("export_id", "max_export_bytes"), "export_id").select("export_id", "n_bytes", F.coalesce(F.col("n_bytes") > F.col("max_export_bytes"), F.lit(False)).alias("exceeds"))


@query("ref_u1_all_paths", "select path from (select path from file_entries union select file_path from symbols union select source_path from import_errors)")
def u1(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.col(c).alias("path")) for t, c in (("file_entries", "path"), ("symbols", "file_path"), ("import_errors", "source_path"))]
    return parts[0].union(parts[1]).union(parts[2]).distinct()


@query("ref_u3_common_paths", "select path from (select path from file_entries intersect select file_path from symbols)")
def u3(spark, sf_dir):
    return table(spark, sf_dir, "file_entries").select("path").intersect(table(spark, sf_dir, "symbols").select(F.col("file_path").alias("path")))


@query("ref_u4_merged_rules", "with s as (select repo_id, list(distinct split_strategy) filter (split_strategy is not null) as a, list(distinct mode) filter (mode is not null) as b from exports group by all) select repo_id, array_to_string(list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))), ',') as rules from s")
def u4(spark, sf_dir):
    s = table(spark, sf_dir, "exports").groupBy("repo_id").agg(F.collect_set("split_strategy").alias("a"), F.collect_set("mode").alias("b"))
    return s.select("repo_id", F.array_join(changes.merged_settings(F.col("a"), F.col("b")), ",").alias("rules"))


@query("ref_u6_concatenated_reports", "select kind, count(*) as n from (select 'symbol' as kind from symbols union all select 'finding' from secret_findings union all select 'error' from import_errors) group by all")
def u6(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.lit(k).alias("kind")) for t, k in (("symbols", "symbol"), ("secret_findings", "finding"), ("import_errors", "error"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("kind").agg(F.count("*").alias("n"))


@query("ref_u7_bundles", "select repo_id, md5(string_agg(root_name || ' ' || coalesce(git_commit, '-'), chr(10) order by export_id)) as digest from exports group by repo_id")
def u7(spark, sf_dir):
    rows = table(spark, sf_dir, "exports").withColumn("line", F.concat_ws(" ", "root_name", F.coalesce("git_commit", F.lit("-"))))
    return report.assembled(rows, "repo_id", ["export_id"], "line", "\n").select("repo_id", F.md5("text").alias("digest"))


@query("ref_f12_normal_names", "select p_partkey, lower(regexp_replace(p_name || '__.' || p_partkey, '[-_.]+', '-', 'g')) as normalized from part")
def f12(spark, sf_dir):
    name = F.concat(F.col("p_name"), F.lit("__."), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", extract.normalized_name(name).alias("normalized"))


@query(
    "ref_f24_simple_scores",
    f"""with {SQL_FILES}, b as (select entry_id, lower(path) as low, {_NAME.format(p='lower(path)')} as name, len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^\\s*(?:def|class|async def)\\s'))) as d, coalesce(line_count, 0) as l from files where content is not null),
    c as (select entry_id, (case when name in ('pyproject.toml', 'setup.py', 'requirements.txt', 'requirements-dev.txt') then 1000 when name in ('readme.md', 'readme.txt') then 950 when contains(name, 'architecture') then 940 when contains(name, 'spec') then 930 when contains(name, 'tasks') or contains(name, 'roadmap') then 850
      when name = 'cli.py' then 800 when name = '__main__.py' then 780 when starts_with(low, 'tests/') and starts_with(name, 'test_') then 100 when contains(name, 'milestone') then 90 else 0 end
      + case name when 'pyproject.toml' then 100 when 'setup.py' then 95 when 'requirements.txt' then 90 when 'requirements-dev.txt' then 90 when 'readme.md' then 85 when 'readme.txt' then 85 when 'cli.py' then 80 when '__main__.py' then 70 else 0 end
      + case when contains(name, 'architecture') then 80 else 0 end + case when contains(name, 'spec') then 75 else 0 end + case when contains(name, 'tasks') or contains(name, 'roadmap') or contains(name, 'milestone') then 60 else 0 end
      + case when starts_with(low, 'tests/') and starts_with(name, 'test_') then 35 else 0 end + least(d, 20) + case when l >= 300 and low like '%.py' then 10 else 0 end)::bigint as score from b) select entry_id, score from c where score > 0""",
)
def f24(spark, sf_dir):
    """The simple score of every file, without imports by others."""
    struct = ranking.simple_score(F.col("path"), extract.definition_lines(F.col("content")), F.lit(0), F.coalesce("line_count", F.lit(0)))
    return texts(spark, sf_dir, struct.alias("s")).where("s is not null").select("entry_id", "s.score")


_STEM = "regexp_replace(lower(" + _NAME.format(p="path") + "), '([^.])\\.[^.]*$', '\\1')"


@query(
    "ref_f20_entrypoint_scores",
    f"with {SQL_FILES} select entry_id, case when {sql_suffix('path')} = 'py' then case {_STEM} when '__main__' then 85 when 'main' then 80 when 'cli' then 75 when 'app' then 70 when 'server' then 70 when 'manage' then 70 when 'wsgi' then 65 when 'asgi' then 65 else 0 end else 0 end::int as score from files",
)
def f20(spark, sf_dir):
    return files(spark, sf_dir, "path").select("entry_id", F.coalesce(ranking.entrypoint_score(F.col("path")), F.lit(0)).alias("score"))


@query(
    "ref_f21_documentation_scores",
    f"""with d as (select doc_id, path, lower(path) as low, {_NAME.format(p='lower(path)')} as name, {_STEM} as stem, coalesce({sql_suffix('path')}, '') as suffix from documents where path is not null)
    select doc_id, (case when suffix in ('md', 'markdown', 'rst', 'txt') or name in ('readme', 'license', 'changelog', 'contributing') then case when stem in ('license', 'licence') then 35 when starts_with(name, 'readme') then 90 when contains(low, 'architecture') then 80 when contains(stem, 'spec') then 75
      when contains(stem, 'tasks') or contains(stem, 'roadmap') or contains(stem, 'milestone') then 55 when stem = 'changelog' then 45 when stem = 'contributing' then 40 when starts_with(low, 'docs/') then 25 when starts_with(low, 'planning/') then 20 else 0 end else 0 end)::int as score from d""",
)
def f21(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("path is not null").select("doc_id", ranking.documentation_score(F.col("path")).alias("score"))


@query("ref_f28_qualified_names", "select distinct l_suppkey, repeat('.', (l_linenumber % 3)::int) || 'm' || l_partkey % 200 || '.n' || l_linenumber as qualified from lineitem")
def f28(spark, sf_dir):
    name = "concat(repeat('.', cast(l_linenumber % 3 as int)), 'm', l_partkey % 200, '.n', l_linenumber)"
    return table(spark, sf_dir, "lineitem").select("l_suppkey", F.expr(name).alias("qualified")).distinct()


@query(
    "ref_j18_import_mentions",
    f"""with {SQL_FILES}, p as (select export_id, path, string_split(regexp_replace(regexp_replace(path, '\\.py$', ''), '^src/', ''), '/') as parts from files where path like '%.py'), m as (select distinct export_id, path, case when parts[-1] = '__init__' then parts[:-2] else parts end as own from p),
    n as (select export_id, path, array_to_string(own, '.') as module, own[-1] as last from m where len(own) > 0 and len(list_filter(own, lambda x: not regexp_full_match(x, '[A-Za-z_][A-Za-z0-9_]*'))) = 0)
    select n.export_id, n.path, count(distinct f.path) as n_mentions from n left join files f on f.export_id = n.export_id and f.path <> n.path and f.content is not null and (contains(f.content, 'import ' || module) or contains(f.content, 'from ' || module || ' import') or contains(f.content, 'from .' || last || ' import')) group by all""",
)
def j18(spark, sf_dir):
    said = F.concat_ws("\n", F.array_distinct(F.regexp_extract_all("content", F.lit(r"import [A-Za-z0-9_.]+"), F.lit(0))), F.array_distinct(F.regexp_extract_all("content", F.lit(r"from [A-Za-z0-9_.]+ import"), F.lit(0))))
    return project.mentions(files(spark, sf_dir, "export_id", "path", F.when(F.col("content").isNotNull(), said).alias("content")), "export_id")


@query(
    "ref_x11_project_facts",
    f"""with {SQL_FILES}, {SQL_LANG}, l as (select *, lower(path) as low, lower(coalesce(content, '')) as body from known),
    f as (select export_id, bool_or(low = 'pyproject.toml') as h0, bool_or(low = 'requirements.txt') as h1, bool_or(low = 'setup.py') as h2, bool_or(low = 'package.json') as h3, bool_or(low = 'cli.py' or low like '%/cli.py') as cli, bool_or(low = 'tests' or starts_with(low, 'tests/')) as tests,
      bool_or(content is not null and contains(body, 'pytest')) as p, bool_or(content is not null and contains(body, 'unittest')) as u, coalesce(bool_and(case when content is not null then coalesce(lang in ('markdown', 'text'), false) end), false) as only_texts from l group by all),
    n as (select export_id, lang from known where content is not null and lang is not null group by export_id, lang qualify row_number() over (partition by export_id order by count(*) desc, lang) = 1)
    select f.export_id, case when h0 and cli then 'Python CLI project' when h0 or h2 then 'Python package' when lang = 'python' then 'Python project' when lang = 'bash' then 'Bash project' when only_texts then 'Documentation project' else 'Unknown Git repository' end as project_type,
      coalesce(nullif(array_to_string(list_filter([case when h0 then 'pyproject.toml' end, case when h1 then 'requirements.txt' end, case when h2 then 'setup.py' end, case when h3 then 'package.json' end], lambda x: x is not null), ', '), ''), 'Unknown') as packaging,
      case when p or tests then 'pytest' when u then 'unittest' else 'Unknown' end as test_framework from f left join n using (export_id)""",
)
def x11(spark, sf_dir):
    low = F.lower("content")
    words = F.when(F.col("content").isNotNull(), F.concat_ws(" ", *[F.when(low.contains(word), F.lit(word)) for word in ("pytest", "unittest")]))
    return project.facts(known(spark, sf_dir, "export_id", words.alias("content")), "export_id")


@query(
    "ref_x12_layout",
    f"""with {SQL_FILES}, v as (select export_id, 'folder' as fact, regexp_extract(path, '^([^/]+)/', 1) as value from files where contains(path, '/') union select export_id, 'package', regexp_replace(path, '/?__init__\\.py$', '') from files where {_NAME.format(p='path')} = '__init__.py' and path <> '__init__.py'
      union select export_id, 'test', path from files where regexp_matches(lower({_NAME.format(p='path')}), '^test_.*\\.py$'))
    select export_id, fact, value, row_number() over (partition by export_id, fact order by value)::int as place, greatest(count(*) over (partition by export_id, fact) - 10, 0)::bigint as more from v qualify place <= 10""",
)
def x12(spark, sf_dir):
    return project.layout(files(spark, sf_dir, "export_id", "path"), "export_id")


@query("ref_r13_manifest_lines", f"with {SQL_FILES} select export_id, md5(string_agg(concat_ws(' | ', path, coalesce(status, '-'), coalesce(size_bytes::varchar, '?')), chr(10) order by path, entry_id)) as digest from files group by export_id")
def r13(spark, sf_dir):
    rows = files(spark, sf_dir, "export_id", "path", "status", "size_bytes").withColumn("line", F.concat_ws(" | ", "path", F.coalesce("status", F.lit("-")), F.coalesce(F.col("size_bytes").cast("string"), F.lit("?"))))
    return report.assembled(rows, "export_id", ["path", "entry_id"], "line", "\n").select("export_id", F.md5("text").alias("digest"))


@query("ref_a21_relationship_lines", "select distinct n_name || ' -> ' || r_name as line from nation join region on n_regionkey = r_regionkey")
def a21(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.concat_ws(" -> ", "n_name", "r_name").alias("line")).distinct()


@query("ref_g1_resolved_edges", f"with {SQL_EDGES} select source_module, target_module, count(*) as n_references, min(l_orderkey) as first_order from edges where source_module <> target_module group by all")
def g1(spark, sf_dir):
    return edges(spark, sf_dir).where("source_module <> target_module").groupBy("source_module", "target_module").agg(F.count("*").alias("n_references"), F.min("l_orderkey").alias("first_order"))


@query("ref_j4_module_paths", f"with {SQL_FILES}, p as (select path, string_split(regexp_replace(regexp_replace(path, '\\.py$', ''), '^src/', ''), '/') as parts from files where path like '%.py'), m as (select path, case when parts[-1] = '__init__' then parts[:-2] else parts end as own from p) select array_to_string(own, '.') as module, min(path) as path from m where len(own) > 0 and len(list_filter(own, lambda x: not regexp_full_match(x, '[A-Za-z_][A-Za-z0-9_]*'))) = 0 group by all")
def j4(spark, sf_dir):
    own = files(spark, sf_dir, "path").where("path like '%.py'").select(paths.module_name(F.col("path")).alias("module"), "path").where("module is not null")
    return graph.first_seen(own, ["module"], ["path"])


_ALIASES = """p as (select distinct l_suppkey, l_partkey as k from lineitem), a as (select l_suppkey, k, case when k % 2 = 0 then 'import' else 'from' end as import_type, case when k % 3 = 0 then 'a.m' || k else 'm' || k end as m, 'n' || (k % 5) as name from p),
    e as (select l_suppkey, k, case when k % 2 = 0 then 'x.a.m' || (k - k % 10) else 'm' || k end as t, case when k % 4 = 1 then 'other' else 'n' || (k % 5) end as name from p)"""


def _aliases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_partkey").alias("k")).distinct()
    a = p.selectExpr("l_suppkey", "k as alias_id", "if(k % 2 = 0, 'import', 'from') as import_type", "if(k % 3 = 0, concat('a.m', k), concat('m', k)) as imported_module", "concat('n', k % 5) as imported_name")
    e = p.selectExpr("l_suppkey", "if(k % 2 = 0, concat('x.a.m', k - k % 10), concat('m', k)) as target_module", "if(k % 4 = 1, 'other', concat('n', k % 5)) as edge_name", "k as edge_order")
    return a, e


@query(
    "ref_j5_alias_edges",
    f"with {_ALIASES}, h as (select a.l_suppkey, a.k, min_by(t, e.k) as target_module from a join e on e.l_suppkey = a.l_suppkey and (t = m or ends_with(t, '.' || m) or ends_with(m, '.' || t)) and (import_type = 'import' or a.name = e.name) group by all) select a.l_suppkey, a.k as alias_id, target_module, target_module is not null as is_local from a left join h using (l_suppkey, k)",
)
def j5(spark, sf_dir):
    a, e = _aliases(spark, sf_dir)
    return graph.resolve_aliases(a, e, "l_suppkey", "edge_order").select("l_suppkey", "alias_id", "target_module", "is_local")


@query(
    "ref_j6_single_definitions",
    f"with {_SYMBOLS}, f as (select file_path as module, name from s where kind = 'function' group by all having count(*) = 1), a as (select distinct file_path as target_module, name as imported_name from s) select target_module, imported_name from a join f on f.module = a.target_module and f.name = a.imported_name",
)
def j6(spark, sf_dir):
    s = _symbols(spark, sf_dir)
    aliases = s.select(F.col("file_path").alias("target_module"), F.col("name").alias("imported_name")).distinct()
    return graph.single_definitions(aliases, s.withColumn("module", F.col("file_path")))

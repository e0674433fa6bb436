"""Queries over files: functions, selection, statistics and limits, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.common import suffix, table, with_language
from lodestack.functions import languages, paths, text
from lodestack.operators import selection, stats

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SQL_FILES = "files as (select * from file_entries qualify row_number() over (partition by entry_id order by loaded_at desc) = 1)"
_NAME = r"regexp_extract({p}, '([^/]*)$', 1)"
_SUFFIX = r"nullif(lower(regexp_extract(regexp_extract({p}, '([^/\\]*)$', 1), '[^.]\.([^.]+)$', 1)), '')"
SQL_LANG = f"known as (select f.*, l.language as lang from files f left join languages l on l.alias = coalesce(lower(trim(f.language)), {_SUFFIX.format(p='f.path')}))"
_UNIVERSAL = r"regexp_replace({c}, '\r\n?', '\n', 'g')"
_SPLIT = f"string_split({_UNIVERSAL}, chr(10))".replace(r"'\n'", "chr(10)")
_LINES = f"(case when {{c}} = '' then []::varchar[] when {_SPLIT}[-1] = '' then {_SPLIT}[:-2] else {_SPLIT} end)"


def sql_lines(column: str) -> str:
    return _LINES.format(c=column)


def sql_suffix(column: str) -> str:
    return _SUFFIX.format(p=column)


def there() -> Column:
    """Whether there is content, in its place: the shuffle that makes repeated rows one needn't carry texts for that."""
    return F.when(F.col("content").isNotNull(), F.lit("")).alias("content")


def files(spark: SparkSession, sf_dir: str, *columns: str | Column, where: str = "true", language: bool = False) -> DataFrame:
    """One row per entry; repeated deliveries differ in their time only.

    ``columns`` are computed where the rows are read, with ``lang`` if ``language``; only they are shuffled.
    """
    rows = table(spark, sf_dir, "file_entries").where(where)
    if language:
        rows = with_language(rows, table(spark, sf_dir, "languages"))
    return rows.select("entry_id", *columns).dropDuplicates(["entry_id"])


def texts(spark: SparkSession, sf_dir: str, *columns: str | Column, language: bool = False) -> DataFrame:
    """``files`` with content."""
    return files(spark, sf_dir, *columns, where="content is not null", language=language)


def known(spark: SparkSession, sf_dir: str, *columns: str | Column) -> DataFrame:
    return with_language(files(spark, sf_dir, "path", "language", *columns), table(spark, sf_dir, "languages"))


def query(name: str, sql: str):
    def register(function):
        QUERIES[name] = function
        SQL[name] = sql
        return function

    return register


def _map(values: dict[str, str], key: str) -> str:
    return "case " + key + " " + " ".join(f"when '{k}' then '{v}'" for k, v in values.items()) + " end"


# The expected values, written out.
_SUFFIXES = {"python": "py", "bash": "sh bash", "markdown": "md markdown", "text": "txt", "json": "json", "yaml": "yaml yml", "toml": "toml", "ini": "ini cfg", "typescript": "ts", "tsx": "tsx", "javascript": "js mjs cjs", "jsx": "jsx", "html": "html htm", "css": "css", "java": "java", "c": "c", "cpp": "cpp cc cxx hpp hh hxx", "csharp": "cs"}
_NAMES = {"markdown": "readme changelog", "text": "license licence copying todo", "makefile": "makefile", "dockerfile": "dockerfile"}
_LABELS = {"javascript": "JavaScript", "typescript": "TypeScript", "json": "JSON", "yaml": "YAML", "toml": "TOML", "ini": "INI", "html": "HTML", "css": "CSS", "tsx": "TSX", "jsx": "JSX", "cpp": "C++", "csharp": "C#"}
_turned = lambda values: {word: name for name, words in values.items() for word in words.split()}
_BY_SUFFIX = _map(_turned(_SUFFIXES), sql_suffix("path"))
_BY_NAME = f"case when {sql_suffix('path')} is null then {_map(_turned(_NAMES), 'lower(' + _NAME.format(p='path') + ')')} end"
_WORDS = r"list_transform(string_split_regex(trim(regexp_extract(content, '\A#!([^\r\n]*)', 1)), '\s+'), lambda w: regexp_extract(w, '([^/]*)$', 1))"
_PROGRAM = f"case when ({_WORDS})[1] = 'env' then list_filter(({_WORDS})[2:], lambda w: not starts_with(w, '-'))[1] else ({_WORDS})[1] end"
_BY_SHEBANG = f"case when {_PROGRAM} in ('python', 'python3') or starts_with({_PROGRAM}, 'python3.') then 'python' when {_PROGRAM} in ('bash', 'sh') then 'bash' when {_PROGRAM} = 'node' then 'javascript' end"


@query("ref_f1_suffix_language", f"with {SQL_FILES} select {_BY_SUFFIX} as by_suffix, {_BY_NAME} as by_name, count(*) as n_files from files group by all")
def f1(spark, sf_dir):
    path = F.col("path")
    return files(spark, sf_dir, "path").groupBy(languages.by_suffix(path).alias("by_suffix"), languages.by_name(path).alias("by_name")).agg(F.count("*").alias("n_files"))


@query("ref_f3_shebang_language", f"with {SQL_FILES} select entry_id, {_BY_SHEBANG} as shebang_language from files where content is not null and regexp_matches(content, '\\A#!')")
def f3(spark, sf_dir):
    return files(spark, sf_dir, languages.by_shebang(F.col("content")).alias("shebang_language"), where="content rlike '^#!'")


# What the rules look for, written out for SQL: (language, points, condition on the sample ``t``).
_RULES = [
    ("python", 30, r"regexp_matches(t, '(?m)^[ \t]*(async[ \t]+def|def|class)[ \t]+[A-Za-z_]')"),
    ("python", 12, r"regexp_matches(t, '(?m)^[ \t]*(from[ \t]+[A-Za-z0-9_.]+[ \t]+import[ \t]+[A-Za-z0-9_]|import[ \t]+[A-Za-z0-9_.])')"),
    ("python", 25, """contains(t, '__name__ == "__main__"') or contains(t, '__name__ == ' || chr(39) || '__main__' || chr(39))"""),
    ("bash", 25, r"contains(t, 'set -euo pipefail') or regexp_matches(t, '(?m)^[ \t]*set[ \t]+-eu\b')"),
    ("bash", 25, r"regexp_matches(t, '(?m)^[ \t]*(function[ \t]+)?[A-Za-z_][A-Za-z0-9_-]*[ \t]*\([ \t]*\)[ \t]*\{')"),
    ("markdown", 12, r"regexp_matches(t, '(?m)^#{1,6}[ \t]+\S')"),
    ("markdown", 12, "contains(t, '```')"),
    ("json", 35, r"""regexp_matches(t, '^\s*[{\[]') and regexp_matches(t, '"[^"]+"\s*:')"""),
    ("yaml", 22, r"len(regexp_extract_all(t, '(?m)^[A-Za-z_][A-Za-z0-9_.-]*:[ \t]+\S')) >= 2"),
    ("yaml", 8, r"len(regexp_extract_all(t, '(?m)^[A-Za-z_][A-Za-z0-9_.-]*:[ \t]+\S')) >= 1 and regexp_matches(t, '(?m)^[ \t]*-[ \t]+\S')"),
    ("toml", 35, r"regexp_matches(t, '(?m)^[ \t]*\[(project|tool\.[^\]\n]+)\][ \t]*$')"),
    ("toml", 10, r"""regexp_matches(t, '(?m)^[A-Za-z_][A-Za-z0-9_.-]*[ \t]*=[ \t]*"[^"\n]*"[ \t]*$')"""),
    ("ini", 18, r"regexp_matches(t, '(?m)^[ \t]*\[[A-Za-z_][A-Za-z0-9_.-]*\][ \t]*$')"),
    ("ini", 8, r"regexp_matches(t, '(?m)^[A-Za-z_][A-Za-z0-9_.-]*[ \t]*=[ \t]*[^#;\n]+$')"),
    ("typescript", 30, r"regexp_matches(t, '(?m)^[ \t]*(export[ \t]+)?interface[ \t]+[A-Za-z_][^\n{]*\{')"),
    ("typescript", 25, r"regexp_matches(t, '(?m)^[ \t]*(export[ \t]+)?type[ \t]+[A-Za-z_][^\n=]*=')"),
    ("typescript", 20, r"regexp_matches(t, '(?m)^[ \t]*(export[ \t]+)?enum[ \t]+[A-Za-z_]')"),
    ("typescript", 30, r"regexp_matches(t, '(?m)^[ \t]*(export[ \t]+)?(let|const|var)[ \t]+[A-Za-z_][A-Za-z0-9_]*[ \t]*:[ \t]*[^=\n]+=')"),
    ("typescript", 15, r"regexp_matches(t, '[A-Za-z0-9_]\??[ \t]*:[ \t]*(any|unknown|boolean|number|string)\b')"),
    ("javascript", 25, "contains(t, 'module.exports') or contains(t, 'require(')"),
    ("javascript", 25, "contains(t, 'export default')"),
    ("javascript", 15, r"""regexp_matches(t, '(?m)^[ \t]*import[ \t][^\n]*[ \t]from[ \t]*["'']')"""),
    ("javascript", 15, r"regexp_matches(t, '\bfunction[ \t]+[A-Za-z_][A-Za-z0-9_]*[ \t]*\(')"),
    ("javascript", 20, r"regexp_matches(t, '\bconst[ \t]+[A-Za-z_][A-Za-z0-9_]*[ \t]*=[ \t]*(async[ \t]*)?(\([^)\n]*\)|[A-Za-z_][A-Za-z0-9_]*)[ \t]*=>')"),
    ("html", 50, "contains(lower(t), '<!doctype html')"),
    ("html", 40, r"regexp_matches(lower(t), '^\s*<html') or (contains(lower(t), '<html') and contains(lower(t), '</html>'))"),
    ("html", 25, "contains(lower(t), '<head') and contains(lower(t), '<body')"),
    ("css", 30, r"regexp_matches(t, '(?m)^[ \t]*@(keyframes|import|media)\b')"),
    ("css", 35, r"regexp_matches(t, '[^\n{}]\{\s*(background|border|color|display|font-size|margin|padding)[A-Za-z0-9_-]*\s*:')"),
    ("java", 20, r"regexp_matches(t, '(?m)^[ \t]*package[ \t]+[A-Za-z0-9_.]+[ \t]*;')"),
    ("java", 20, r"regexp_matches(t, '(?m)^[ \t]*import[ \t]+java[^\n;]*;')"),
    ("java", 30, r"regexp_matches(t, '\bpublic[ \t]+(final[ \t]+)?class[ \t]+[A-Za-z_]')"),
    ("java", 25, "contains(t, 'public static void main')"),
    ("c", 30, r"regexp_matches(t, '#include[ \t]*<stdio\.h>')"),
    ("c", 10, r"""regexp_matches(t, '(?m)^[ \t]*#include[ \t]*[<"]')"""),
    ("c", 30, r"regexp_matches(t, '\bint[ \t]+main[ \t]*\(')"),
    ("c", 30, r"regexp_matches(t, '\btypedef[ \t]+struct\b')"),
    ("c", 12, r"regexp_matches(t, '\bstruct[ \t]+[A-Za-z_]')"),
    ("cpp", 30, r"regexp_matches(t, '#include[ \t]*<(iostream|map|memory|string|vector)>')"),
    ("cpp", 30, r"regexp_matches(t, '\bnamespace[ \t]+[A-Za-z_]')"),
    ("cpp", 30, r"regexp_matches(t, '\btemplate[ \t]*<')"),
    ("cpp", 30, "contains(t, 'std::')"),
    ("cpp", 25, r"regexp_matches(t, '\busing[ \t]+namespace[ \t]+[A-Za-z_]')"),
    ("cpp", 15, r"regexp_matches(t, '(?m)^[ \t]*class[ \t]+[A-Za-z_]')"),
    ("csharp", 30, r"regexp_matches(t, '(?m)^[ \t]*using[ \t]+System[A-Za-z0-9_.]*[ \t]*;')"),
    ("csharp", 20, r"regexp_matches(t, '(?m)^[ \t]*namespace[ \t]+[A-Za-z0-9_.]+\s*\{')"),
    ("csharp", 15, r"regexp_matches(t, '\bpublic[ \t]+class[ \t]+[A-Za-z_]')"),
    ("csharp", 25, r"regexp_matches(t, '\basync[ \t]+Task\b')"),
    ("csharp", 20, r"regexp_matches(t, '(?m)^[ \t]*\[(Fact|Serializable|Test)\]')"),
]
_MARKED = r"regexp_matches(t, '(?m)^#{1,6}[ \t]+\S') and (contains(t, '```') or regexp_matches(t, '(?m)^[ \t]*[-*][ \t]+\S') or contains(t, chr(10) || chr(10)))"


def _scores_sql() -> str:
    """The rules as SQL, with the guards in their order."""
    names = sorted({name for name, _, _ in _RULES})
    raw = {n: " + ".join(f"(case when {p} then {k} else 0 end)" for m, k, p in _RULES if m == n) for n in names}
    less = lambda name, when, by: f"greatest({name} - case when {when} then {by} else 0 end, 0)"
    g1 = {n: less(f"r_{n}", "marked", 80) if n in ("python", "javascript", "typescript", "html", "css") else f"r_{n} + case when marked then 60 else 0 end" if n == "markdown" else f"r_{n}" for n in names}
    g2 = {n: less(f"a_{n}", "a_json >= 35", 25) if n in ("javascript", "typescript", "css") else f"a_{n}" for n in names}
    g3 = {n: less(f"b_{n}", "b_yaml >= 20", {"typescript": 25, "css": 15}[n]) if n in ("typescript", "css") else less("b_ini", "b_toml >= 35", 15) if n == "ini" else f"b_{n}" for n in names}
    columns = lambda exprs, prefix: ", ".join(f"{e} as {prefix}_{n}" for n, e in exprs.items())
    return f"""sample as (select entry_id, path, content, substr(regexp_replace(content, '\\r\\n?', chr(10), 'g'), 1, 8192) as t from files where content is not null),
    s0 as (select entry_id, ({_MARKED}) as marked, {columns(raw, "r")} from sample), s1 as (select entry_id, {columns(g1, "a")} from s0),
    s2 as (select entry_id, {columns(g2, "b")} from s1), s3 as (select entry_id, {columns(g3, "s")} from s2),
    long as ({" union all ".join(f"select entry_id, '{n}' as name, s_{n} as score from s3 where s_{n} > 0" for n in names)}),
    places as (select *, row_number() over (partition by entry_id order by score desc, name) as place, lead(score, 1, 0) over (partition by entry_id order by score desc, name) as second from long),
    scored as (select entry_id, name as by_content from places where place = 1 and score >= 20 and score - second >= 10)"""


@query("ref_f4_content_language", f"with {SQL_FILES}, {_scores_sql()} select by_content, count(*) as n_files from sample left join scored using (entry_id) group by all")
def f4(spark, sf_dir):
    return texts(spark, sf_dir, languages.by_content(F.col("content")).alias("by_content")).groupBy("by_content").agg(F.count("*").alias("n_files"))


@query(
    "ref_f5_detected_language",
    f"with {SQL_FILES}, {_scores_sql()}, found as (select coalesce({_BY_SHEBANG}, {_BY_SUFFIX}, {_BY_NAME}, by_content) as detected from sample left join scored using (entry_id)) select detected, count(*) as n_files from found group by all",
)
def f5(spark, sf_dir):
    return texts(spark, sf_dir, languages.detected(F.col("path"), F.col("content")).alias("detected")).groupBy("detected").agg(F.count("*").alias("n_files"))


_DISPLAY = f"case when lang is null then 'Unknown' else coalesce({_map(_LABELS, 'lang')}, upper(lang[1]) || lang[2:]) end"


@query("ref_a8_language_summary", f"with {SQL_FILES}, {SQL_LANG} select {_DISPLAY} as display_name, count(*) as n_files, sum(coalesce(line_count, 0))::bigint as total_lines, min(path) as first_path, max(path) as last_path from known group by all")
def a8(spark, sf_dir):
    return stats.language_summary(known(spark, sf_dir, "line_count"))


@query("ref_f7_text_probe", f"with {SQL_FILES} select content is not null as readable, contains(coalesce(content, '')[:1024], chr(0)) as has_nul, count(*) as n_files from files group by all")
def f7(spark, sf_dir):
    raw = F.encode(F.coalesce("content", F.lit("")), "UTF-8")
    readable = F.col("content").isNotNull() & text.is_utf8_text(raw)
    return files(spark, sf_dir, readable.alias("readable"), text.has_nul(raw).alias("has_nul")).groupBy("readable", "has_nul").agg(F.count("*").alias("n_files"))


@query("ref_f8_token_estimates", f"with {SQL_FILES} select export_id, sum((length(content) + 3) // 4)::bigint as rounded_up, sum(length(content) // 4)::bigint as rounded_down, sum(greatest((length(content) + 3) // 4, 1))::bigint as at_least_one from files where content is not null group by all")
def f8(spark, sf_dir):
    c = F.col("content")
    counted = texts(spark, sf_dir, "export_id", text.tokens_up(c).alias("up"), text.tokens_down(c).alias("down"), text.tokens_at_least_one(c).alias("one"))
    return counted.groupBy("export_id").agg(F.sum("up").alias("rounded_up"), F.sum("down").alias("rounded_down"), F.sum("one").alias("at_least_one"))


_L = sql_lines("content")


@query(
    "ref_f9_line_counts",
    f"""with {SQL_FILES}, {SQL_LANG}, l as (select entry_id, lang, content, {_L} as lines from known where content is not null)
    select entry_id, len(lines)::int as n_lines, len(list_filter(lines, lambda x: regexp_full_match(x, '\\s*')))::int as n_empty,
      (case when lang = 'python' then len(list_filter(lines, lambda x: regexp_matches(x, '^\\s*#'))) when lang = 'bash' then len(list_filter(lines, lambda x: regexp_matches(x, '^\\s*#'))) - case when starts_with(content, '#!') then 1 else 0 end end)::int as n_comments from l""",
)
def f9(spark, sf_dir):
    c = F.col("content")
    return texts(spark, sf_dir, text.line_count(c).alias("n_lines"), text.empty_line_count(c).alias("n_empty"), text.comment_line_count(c, F.col("lang")).alias("n_comments"), language=True)


@query("ref_f10_normalized_text", f"with {SQL_FILES} select entry_id, md5({_UNIVERSAL.format(c='content').replace(chr(39) + chr(92) + 'n' + chr(39), 'chr(10)')}) as digest from files where content is not null")
def f10(spark, sf_dir):
    return texts(spark, sf_dir, F.md5(text.universal(F.col("content"))).alias("digest"))


@query(
    "ref_f11_module_names",
    f"""with {SQL_FILES}, p as (select entry_id, string_split(regexp_replace(regexp_replace(path, '\\.py$', ''), '^src/', ''), '/') as parts from files where path like '%.py'),
    m as (select entry_id, case when parts[-1] = '__init__' then parts[:-2] else parts end as own from p)
    select entry_id, case when len(own) > 0 and len(list_filter(own, lambda x: not regexp_full_match(x, '[A-Za-z_][A-Za-z0-9_]*'))) = 0 then array_to_string(own, '.') end as module from m""",
)
def f11(spark, sf_dir):
    return files(spark, sf_dir, "path").where("path like '%.py'").select("entry_id", paths.module_name(F.col("path")).alias("module"))


@query("ref_f17_code_fences", f"with {SQL_FILES} select entry_id, repeat('`', greatest(3, 1 + coalesce(list_max(list_transform(regexp_extract_all(content, '`+'), lambda r: length(r))), 0))::int) as fence from files where content is not null")
def f17(spark, sf_dir):
    return texts(spark, sf_dir, text.fence(F.col("content")).alias("fence"))


@query("ref_f18_formats", f"with {SQL_FILES} select entry_id, format('{{:,}}', size_bytes) as size_text, replace(replace(path || '|' || coalesce(reason, ''), '|', '\\|'), chr(10), ' ') as cell from files where size_bytes is not null")
def f18(spark, sf_dir):
    label = F.concat_ws("|", "path", F.coalesce("reason", F.lit("")))
    return files(spark, sf_dir, "path", "reason", "size_bytes").where("size_bytes is not null").select("entry_id", text.thousands(F.col("size_bytes")).alias("size_text"), text.table_cell(label).alias("cell"))


@query(
    "ref_f29_fingerprints",
    f"with {SQL_FILES} select export_id, sha256(string_agg(sha256(path || chr(31) || coalesce(language, '') || chr(31) || coalesce(status, '') || chr(31) || coalesce(content, '')), '' order by path, entry_id)) as fingerprint from files group by export_id",
)
def f29(spark, sf_dir):
    row = F.sha2(F.concat_ws("\x1f", "path", *[F.coalesce(c, F.lit("")) for c in ("language", "status", "content")]), 256)  # only digests are gathered
    ordered = F.array_sort(F.collect_list(F.struct("path", "entry_id", "row")))
    return files(spark, sf_dir, "export_id", "path", row.alias("row")).groupBy("export_id").agg(F.sha2(F.array_join(F.transform(ordered, lambda r: r["row"]), ""), 256).alias("fingerprint"))


@query("ref_f31_xml_text", f"with {SQL_FILES} select entry_id, md5(replace(replace(replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) as digest from files where content is not null")
def f31(spark, sf_dir):
    return texts(spark, sf_dir, F.md5(text.xml_escaped(F.col("content"))).alias("digest"))


@query("ref_f33_content_stats", f"with {SQL_FILES} select entry_id, strlen(content)::bigint as n_bytes, length(content)::bigint as n_chars, greatest((length(content) + 3) // 4, 1)::bigint as n_tokens from files where content is not null")
def f33(spark, sf_dir):
    c = F.col("content")
    return texts(spark, sf_dir, F.octet_length(c).cast("long").alias("n_bytes"), F.length(c).cast("long").alias("n_chars"), text.tokens_at_least_one(c).cast("long").alias("n_tokens"))


@query("ref_f34_repository_names", r"select export_id, case when trim(coalesce(root_name, '')) = '' then 'repository' else regexp_extract(regexp_replace(trim(root_name), '/+$', ''), '([^/]*)$', 1) end as display_name, coalesce(nullif(trim(git_branch), ''), 'detached') as branch, left(git_commit, 7) as short_commit from exports")
def f34(spark, sf_dir):
    root = F.trim(F.coalesce("root_name", F.lit("")))
    return table(spark, sf_dir, "exports").select(
        "export_id",
        F.when(root == "", "repository").otherwise(paths.name(F.regexp_replace(root, "/+$", ""))).alias("display_name"),
        F.coalesce(F.nullif(F.trim("git_branch"), F.lit("")), F.lit("detached")).alias("branch"),
        F.left("git_commit", F.lit(7)).alias("short_commit"),
    )


# selection


@query(
    "ref_p1_selected_files",
    f"""with {SQL_FILES}, c as (select entry_id, regexp_replace(regexp_replace(replace(path, '\\', '/'), '^(\\./)+', ''), '^/+|/+$', '', 'g') as p from files)
    select entry_id from c where (p = 'src' or starts_with(p, 'src/') or p = 'lib' or starts_with(p, 'lib/') or p like '%.py' or p like '%.md') and not (p = 'src/api' or starts_with(p, 'src/api/') or regexp_matches(p, '(?s)^.*test.*$') or regexp_matches(p, '(?s)^.*_[abc].*\\.p.$'))""",
)
def p1(spark, sf_dir):
    rule = paths.selected(F.col("path"), ["src", "lib"], ["*.py", "*.md"], ["src/api"], ["*test*", "*_[abc]*.p?"])
    return files(spark, sf_dir, "path").where(rule).select("entry_id")


@query("ref_p4_clean_paths", r"select clean, count(*) as n_rows from (select regexp_replace(regexp_replace(replace(path, '\', '/'), '^(\./)+', ''), '^/+|/+$', '', 'g') as clean from entry_snapshots) group by all")
def p4(spark, sf_dir):
    return table(spark, sf_dir, "entry_snapshots").groupBy(paths.cleaned(F.col("path")).alias("clean")).agg(F.count("*").alias("n_rows"))


@query(
    "ref_p6_selection_counters",
    f"with {SQL_FILES}, n as (select export_id, count(*) as scanned, count(*) filter (path like '%.py') as selected from files group by all) select export_id, scanned, scanned - selected as filtered, least(selected, 5) as kept, greatest(selected - 5, 0) as over_limit from n",
)
def p6(spark, sf_dir):
    return selection.select_and_limit(files(spark, sf_dir, "export_id", "path"), "export_id", 5, paths.selected(F.col("path"), include_globs=["*.py"]))


@query("ref_p7_size_limit", f"with {SQL_FILES} select export_id, count(*) as n_files, count(*) filter (size_bytes is null or size_bytes <= 2000) as n_within from files group by all")
def p7(spark, sf_dir):
    return files(spark, sf_dir, "export_id", "size_bytes").groupBy("export_id").agg(F.count("*").alias("n_files"), F.count_if(selection.within_size(F.col("size_bytes"), 2000)).alias("n_within"))


_DOC_WORDS = f"string_split(regexp_replace(regexp_replace(lower({_NAME.format(p='path')}), '([^.])\\.[^.]*$', '\\1'), '[-.]', '_', 'g'), '_')"
_STEM = f"regexp_replace(lower({_NAME.format(p='path')}), '([^.])\\.[^.]*$', '\\1')"
_IS_DOC = f"""(coalesce({sql_suffix('path')}, '') in ('', 'md', 'markdown', 'rst', 'txt') and (len(list_intersect({_DOC_WORDS}, ['readme','architecture','spec','specification','tasks','task','roadmap','milestone','changelog','changes','contributing','contribution','contributors','license','licence','copying'])) > 0
    or starts_with(lower({_NAME.format(p='path')}), 'readme') or regexp_matches(lower(path), '(^|/)docs/') or starts_with(lower(path), 'planning/')))"""
_CATEGORY = f"""case when starts_with({_STEM}, 'readme') then 'Primary documentation' when list_contains({_DOC_WORDS}, 'architecture') then 'Architecture'
    when len(list_intersect({_DOC_WORDS}, ['spec','specification'])) > 0 then 'Specification' when len(list_intersect({_DOC_WORDS}, ['tasks','task','roadmap','milestone'])) > 0 or starts_with(lower(path), 'planning/') then 'Tasks and roadmap'
    when {_STEM} in ('changelog','changes','contributing','contribution','contributors') then 'Changelog and contribution' when len(list_intersect({_DOC_WORDS}, ['license','licence','copying'])) > 0 then 'License' else 'Other documentation' end"""


@query("ref_p12_documentation", f"select doc_id, {_CATEGORY} as category from documents where path is not null and {_IS_DOC}")
def p12(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("path is not null").select("doc_id", "path")
    return selection.documentation_only(docs).select("doc_id", paths.documentation_category(F.col("path")).alias("category"))


@query(
    "ref_a9_documentation_counts",
    "with d as (select source, " + _CATEGORY + " as category from documents where path is not null and " + _IS_DOC + "), c(position, category) as (values " + ", ".join(f"({i}, '{c}')" for i, c in enumerate(paths.CATEGORIES)) + "), n as (select source, category, count(*) as n from d group by all)\n"
    "select s.source, c.position, c.category, coalesce(n.n, 0)::bigint as n_files from (select distinct source from documents where path is not null) s cross join c left join n on n.source = s.source and n.category = c.category",
)
def a9(spark, sf_dir):
    return stats.documentation_counts(table(spark, sf_dir, "documents").where("path is not null").select("source", "path"), "source")


@query("ref_p16_source_code", f"with {SQL_FILES}, {SQL_LANG} select coalesce(lang in ('bash', 'c', 'cpp', 'csharp', 'css', 'html', 'java', 'javascript', 'jsx', 'python', 'tsx', 'typescript'), false) as is_source, count(*) as n_files from known group by all")
def p16(spark, sf_dir):
    return known(spark, sf_dir).groupBy(languages.is_source_code(F.col("lang")).alias("is_source")).agg(F.count("*").alias("n_files"))


@query(
    "ref_p17_ancestors",
    f"with {SQL_FILES}, p as (select export_id, string_split(path, '/') as parts from files), a as (select export_id, unnest(list_transform(range(1, len(parts)), lambda i: array_to_string(parts[:i], '/'))) as folder from p) select export_id, folder, count(*) as n_files from a group by all",
)
def p17(spark, sf_dir):
    return files(spark, sf_dir, "export_id", "path").select("export_id", F.explode(paths.ancestors(F.col("path"))).alias("folder")).groupBy("export_id", "folder").agg(F.count("*").alias("n_files"))


@query("ref_p18_status_groups", f"with {SQL_FILES} select case when status = 'truncated' then 'truncated' when status in ('skipped', 'error') or text_status = 'binary' then 'omitted' else 'included' end as grp, count(*) as n_files from files group by all")
def p18(spark, sf_dir):
    return files(spark, sf_dir, "status", "text_status").groupBy(selection.status_group(F.col("status"), F.col("text_status")).alias("grp")).agg(F.count("*").alias("n_files"))


@query(
    "ref_p19_entry_status",
    f"with {SQL_FILES} select case when status = 'error' and reason is not null then 'error' when text_status = 'binary' then 'skipped' when content is null then 'skipped' else 'included' end as derived, status, count(*) as n_files from files group by all",
)
def p19(spark, sf_dir):
    error = F.when(F.col("status") == "error", F.col("reason"))
    return files(spark, sf_dir, "status", "text_status", "reason", there()).groupBy(selection.entry_status(F.col("text_status"), error, F.col("content")).alias("derived"), "status").agg(F.count("*").alias("n_files"))


# statistics

_EXPORTABLE = "(text_status = 'text' and content is not null and coalesce(status, '') <> 'error')"


@query("ref_a1_totals", f"with {SQL_FILES} select export_id, sum(coalesce(line_count, 0))::bigint as total_lines, sum(coalesce(estimated_tokens, 0))::bigint as total_tokens from files where {_EXPORTABLE} group by all")
def a1(spark, sf_dir):
    return stats.totals(files(spark, sf_dir, "export_id", "text_status", there(), "status", "line_count", "estimated_tokens"), "export_id")


@query("ref_a2_file_counts", f"with {SQL_FILES} select export_id, count(*) as tracked, count(*) filter ({_EXPORTABLE}) as exported, count(*) filter (text_status = 'binary') as \"binary\", count(*) filter (status = 'error') as faulty from files group by all")
def a2(spark, sf_dir):
    return stats.counts(files(spark, sf_dir, "export_id", "text_status", there(), "status"), "export_id")


@query("ref_a3_file_types", f"with {SQL_FILES} select coalesce('.' || {sql_suffix('path')}, '[no extension]') as file_type, count(*) as n_files from files group by all")
def a3(spark, sf_dir):
    return stats.file_types(files(spark, sf_dir, "path"))


@query(
    "ref_a5_model_summary",
    f"with {SQL_FILES} select export_id, count(*) as total_files, count(*) filter (status = 'included') as exported_files, count(*) filter (status = 'skipped' or text_status = 'binary') as skipped_files, count(distinct coalesce('.' || {sql_suffix('path')}, {_NAME.format(p='path')})) as n_types from files group by all",
)
def a5(spark, sf_dir):
    return stats.model_summary(files(spark, sf_dir, "export_id", "path", "status", "text_status"), "export_id")


@query("ref_a6_language_status", f"with {SQL_FILES}, {SQL_LANG} select lang, status, count(*) as n_files, grouping_id(lang, status)::int as level from known group by cube (lang, status)")
def a6(spark, sf_dir):
    return stats.grouping_sets(known(spark, sf_dir, "status"))


@query(
    "ref_a7_primary_language",
    f"with {SQL_FILES}, {SQL_LANG}, n as (select export_id, lang, count(*) as n from known where lang is not null group by all) select export_id, lang as primary_language, n as n_files from n qualify row_number() over (partition by export_id order by n desc, lang) = 1",
)
def a7(spark, sf_dir):
    return stats.primary_language(known(spark, sf_dir, "export_id"), "export_id")


@query("ref_a13_warning_counts", f"with {SQL_FILES} select status, coalesce(reason, 'uncategorized') as code, count(*) as n_warnings, count(distinct path) as n_paths from files where status <> 'included' group by all")
def a13(spark, sf_dir):
    return stats.warning_counts(files(spark, sf_dir, "path", "status", "reason"))


@query(
    "ref_w6_repository_ids",
    "with b as (select export_id, regexp_replace(lower(trim(root_name)), '[^a-z0-9]+', '-', 'g') as base from exports), n as (select *, row_number() over (partition by base order by export_id) as n from b) select export_id, case when n = 1 then base else base || '-' || n end as unique_id from n",
)
def w6(spark, sf_dir):
    return stats.disambiguated(table(spark, sf_dir, "exports").select("export_id", "root_name"), "root_name", "export_id").select("export_id", "unique_id")


# limits


@query(
    "ref_l2_first_files",
    f"with {SQL_FILES} select export_id, path, row_number() over (partition by export_id order by path, entry_id)::int as place, greatest(count(*) over (partition by export_id) - 5, 0)::bigint as omitted from files qualify place <= 5",
)
def l2(spark, sf_dir):
    return selection.first_files(files(spark, sf_dir, "export_id", "path"), "export_id", 5).select("export_id", "path", "place", "omitted")


@query(
    "ref_l4_display_caps",
    "with s as (select distinct export_id, file_path, name, kind, line_start from symbols), n as (select *, row_number() over (partition by export_id, file_path order by line_start, name, kind)::int as place, greatest(count(*) over (partition by export_id, file_path) - 3, 0)::bigint as more from s) select export_id, file_path, name, kind, line_start, place, more from n where place <= 3",
)
def l4(spark, sf_dir):
    rows = table(spark, sf_dir, "symbols").select("export_id", "file_path", "name", "kind", "line_start").distinct()
    return selection.capped(rows, ["export_id", "file_path"], [F.col("line_start").asc_nulls_last(), "name", "kind"], 3)


@query(
    "ref_l5_first_lines",
    f"with {SQL_FILES}, l as (select entry_id, {_L} as lines, regexp_replace(content, '\\r\\n?', chr(10), 'g') as u from files where content is not null) select entry_id, greatest(len(lines) - 20, 0)::int as omitted, case when len(lines) > 20 then md5(array_to_string(lines[:20], chr(10)) || chr(10)) else md5(u) end as digest from l",
)
def l5(spark, sf_dir):
    c = F.col("content")
    return texts(spark, sf_dir, text.omitted_lines(c, 20).alias("omitted"), F.md5(text.head_lines(c, 20)).alias("digest"))


@query(
    "ref_l6_byte_limit",
    f"with {SQL_FILES}, t as (select entry_id, content, strlen(content) as b from files where content is not null), k as (select entry_id, content, b, case when b <= 500 then content else regexp_replace(left(content, (select max(i) from range(0, {500 - len(selection.BYTE_NOTICE.encode()) + 1}) r(i) where strlen(left(content, i::int)) <= {500 - len(selection.BYTE_NOTICE.encode())})::int), '\\s+$', '') || chr(10) || '[cut at the size limit]' || chr(10) end as kept from t) select entry_id, md5(kept) as digest, strlen(kept)::bigint as n_bytes from k",
)
def l6(spark, sf_dir):
    kept = text.limited(F.col("content"), 500, selection.BYTE_NOTICE)
    return texts(spark, sf_dir, F.md5(kept).alias("digest"), F.octet_length(kept).cast("long").alias("n_bytes"))


@query(
    "ref_l8_content_notices",
    f"with {SQL_FILES}, l as (select entry_id, size_bytes, content, {_L} as lines from files where content is not null) select entry_id, case when size_bytes > 5000 then 'size' when len(lines) > 60 then 'lines' else 'whole' end as kind, md5(case when size_bytes > 5000 then '{selection.SIZE_NOTICE}' when len(lines) > 60 then array_to_string(lines[:60], chr(10)) || chr(10) || '[... ' || (len(lines) - 60) || ' more lines are left out ...]' else content end) as digest from l",
)
def l8(spark, sf_dir):
    c = F.col("content")
    kind = F.when(~selection.within_size(F.col("size_bytes"), 5000), "size").when(text.omitted_lines(c, 60) > 0, "lines").otherwise("whole")
    return texts(spark, sf_dir, kind.alias("kind"), F.md5(selection.limited_content(c, F.col("size_bytes"), 5000, 60)).alias("digest"))

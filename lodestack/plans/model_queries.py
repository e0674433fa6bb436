"""Queries over the export model, changes, reports and masks, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.common import table
from lodestack.functions.text import tokens_up
from lodestack.operators import changes, lifecycle, masking, model, report, selection
from lodestack.plans.file_queries import SQL_FILES, files, texts, there
from lodestack.streaming import events as event_windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql:
            SQL[name] = sql
        return function

    return register


# changes

_LETTERS = "case o_orderkey % 7 when 0 then '??' when 1 then ' M' when 2 then 'A ' when 3 then 'AD' when 4 then ' D' when 5 then 'R ' else 'MM' end"
_LINE = f"{_LETTERS} || ' ' || case when o_orderkey % 7 = 5 then 'old/' || o_custkey || ' -> ' else '' end || 'src/' || (o_orderkey % 5000) || '.py'"
_PORCELAIN = f"""lines as (select o_orderkey, {_LINE} as line from orders), parsed as (select o_orderkey, line[1:2] as letters, string_split(line[4:], ' -> ')[-1] as path from lines),
    changed as (select o_orderkey, path, case when letters = '??' then 'untracked' when contains(letters, 'D') then 'deleted' when contains(letters, 'R') then 'renamed' when contains(letters, 'A') then 'added' else 'modified' end as status, letters = '??' as is_untracked, letters <> '??' and contains(letters, 'D') as is_deleted from parsed),
    last as (select path, status, is_untracked, is_deleted from changed qualify row_number() over (partition by path order by o_orderkey desc) = 1)"""


def _porcelain(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_LINE.replace("case o_orderkey % 7", "case o_orderkey % 7")).alias("line"))
    parsed = lines.select("o_orderkey", changes.porcelain(F.col("line")).alias("c")).where("c is not null").select("o_orderkey", "c.*")
    return changes.last_of_each(parsed, "o_orderkey", ["path"])


@query("ref_s7_status_lines", f"with {_PORCELAIN} select * from last")
def s7(spark, sf_dir):
    return _porcelain(spark, sf_dir)


@query("ref_a10_change_counts", f"with {_PORCELAIN} select count(*) as total, " + ", ".join(f"count(*) filter (status = '{s}') as {s}" for s in ("modified", "added", "deleted", "renamed", "untracked")) + " from last")
def a10(spark, sf_dir):
    return changes.status_counts(_porcelain(spark, sf_dir))


@query(
    "ref_s8_name_status",
    "with l as (select o_orderkey, case o_orderkey % 4 when 0 then 'D' when 1 then 'A' when 2 then 'R100' else 'M' end || chr(9) || case when o_orderkey % 4 = 2 then 'old' || chr(9) else '' end || 'src/' || o_orderkey as line from orders) select string_split(line, chr(9))[-1] as path, case line[1] when 'D' then 'deleted' when 'A' then 'added' when 'R' then 'renamed' else 'modified' end as status, line[1] = 'D' as is_deleted from l",
)
def s8(spark, sf_dir):
    line = "concat(case o_orderkey % 4 when 0 then 'D' when 1 then 'A' when 2 then 'R100' else 'M' end, '\\t', case when o_orderkey % 4 = 2 then 'old\\t' else '' end, 'src/', o_orderkey)"
    return table(spark, sf_dir, "orders").select(changes.name_status(F.expr(line)).alias("c")).where("c is not null").select("c.*")


@query(
    "ref_s10_changed_scans",
    f"with {_PORCELAIN}, scans as (select 'src/' || o_orderkey || '.py' as path, o_custkey as size_bytes from orders) select l.*, case when not is_deleted then size_bytes end as size_bytes from last l left join scans using (path)",
)
def s10(spark, sf_dir):
    scans = table(spark, sf_dir, "orders").select(F.concat(F.lit("src/"), F.col("o_orderkey").cast("string"), F.lit(".py")).alias("path"), F.col("o_custkey").alias("size_bytes"))
    return changes.with_scans(_porcelain(spark, sf_dir), scans, ["path"])


@query(
    "ref_u2_path_sets",
    """with p as (select distinct repo_id, snapshot_no, path from entry_snapshots where path is not null), n as (select repo_id, snapshot_no, lag(snapshot_no) over (partition by repo_id order by snapshot_no) as earlier from (select distinct repo_id, snapshot_no from p)),
    o as (select n.repo_id, n.snapshot_no, p.path from n join p on p.repo_id = n.repo_id and p.snapshot_no = n.earlier), w as (select n.repo_id, n.snapshot_no, p.path from n join p on p.repo_id = n.repo_id and p.snapshot_no = n.snapshot_no where n.earlier is not null)
    select coalesce(o.repo_id, w.repo_id) as repo_id, coalesce(o.snapshot_no, w.snapshot_no) as snapshot_no, coalesce(o.path, w.path) as path, case when o.path is null then 'added' when w.path is null then 'removed' else 'kept' end as side from o full join w on o.repo_id = w.repo_id and o.snapshot_no = w.snapshot_no and o.path = w.path""",
)
def u2(spark, sf_dir):
    """Paths of every snapshot of every repository against those of the one before."""
    rows = table(spark, sf_dir, "entry_snapshots").where("path is not null").select("repo_id", "snapshot_no", "path").distinct()
    return changes.consecutive_path_sets(rows, "repo_id", "snapshot_no", "path")


@query(
    "ref_j12_known_files",
    f"""with {SQL_FILES}, g as (select repo_id, path, status, case when status = 'included' then 0 when status = 'truncated' then 1 else 2 end as priority from files)
    select repo_id, path, min(priority)::int as priority, count(distinct status) as n_statuses from g group by all""",
)
def j12(spark, sf_dir):
    own = files(spark, sf_dir, "repo_id", "path", "status").select("repo_id", "path", "status")
    groups = [own.where("status = 'included'"), own.where("status = 'truncated'"), own.where("status not in ('included', 'truncated') or status is null")]
    best = changes.known_files(groups, ["repo_id", "path"]).select("repo_id", "path", "priority")
    statuses = own.groupBy("repo_id", "path").agg(F.count_distinct("status").alias("n_statuses"))
    return best.join(statuses, ["repo_id", "path"])


@query(
    "ref_u5_merged_warnings",
    f"with {SQL_FILES} select path, status as code, coalesce(reason, '') as message, max(entry_id) as last_entry from files where status <> 'included' group by all",
)
def u5(spark, sf_dir):
    rows = files(spark, sf_dir, "path", "status", "reason").where("status <> 'included'").select("path", F.col("status").alias("code"), F.coalesce("reason", F.lit("")).alias("message"), F.col("entry_id").alias("last_entry"), F.col("entry_id").alias("at"))
    return changes.merged_warnings(rows, "at")


# model


@query(
    "ref_v1_issues",
    f"""with {SQL_FILES} select entry_id, unnest(list_filter([case when status is null or status not in ('included', 'truncated', 'skipped', 'error') then 'status' end, case when text_status is null or text_status not in ('text', 'binary') then 'text_status' end,
      case when path is null or trim(path) = '' then 'path' end, case when language is null or trim(language) = '' then 'language' end, case when size_bytes < 0 then 'size_bytes' end, case when line_count < 0 then 'line_count' end, case when estimated_tokens < 0 then 'estimated_tokens' end,
      case when status = 'included' and text_status = 'text' and content is null then 'content' end], lambda x: x is not null)) as rule from files
    union all select min(entry_id), 'duplicate_path' from files group by export_id, path having count(*) > 1""",
)
def v1(spark, sf_dir):
    return model.issues(files(spark, sf_dir, "export_id", "path", "language", "status", "text_status", there(), "size_bytes", "line_count", "estimated_tokens"))


@query(
    "ref_v3_audit",
    f"""with {SQL_FILES}, r as (select export_id, count(*) as tracked, sum((length(content) + 3) // 4) as tokens from files group by all)
    select e.export_id, coalesce(r.tracked, 0)::bigint as tracked, coalesce(total_tracked_files, -1) = coalesce(r.tracked, 0) as tracked_agrees, coalesce(estimated_tokens = coalesce(r.tokens, 0), false) as tokens_agree from exports e left join r using (export_id)""",
)
def v3(spark, sf_dir):
    return model.audit(files(spark, sf_dir, "export_id", "text_status", "status", tokens_up(F.col("content")).alias("tokens")), table(spark, sf_dir, "exports"))


@query("ref_v4_missing_sections", "with required(name) as (values ('python'), ('java'), ('cobol'), ('fortran')), present as (select distinct lower(trim(language)) as name from file_entries) select name from required where name not in (select name from present where name is not null)")
def v4(spark, sf_dir):
    required = spark.createDataFrame([("python",), ("java",), ("cobol",), ("fortran",)], "name string")
    return model.missing(required, table(spark, sf_dir, "file_entries").select(F.lower(F.trim("language")).alias("name")), "name")


@query("ref_v6_round_trip", f"with {SQL_FILES} select 0::bigint as n_broken, count(*) as n_entries from files")
def v6(spark, sf_dir):
    schema = "content string, estimated_tokens bigint, language string, line_count bigint, masked_content string, path string, reason string, size_bytes bigint, status string, text_status string"
    own = files(spark, sf_dir, *model.ENTRY_FIELDS)
    broken = model.round_trip(own, schema).agg(F.count("*").alias("n_broken"))
    return broken.crossJoin(own.agg(F.count("*").alias("n_entries")))  # one row each


@query("ref_a20_inventory", f"with {SQL_FILES} select export_id, case when status = 'truncated' then 'truncated' when status in ('skipped', 'error') or text_status = 'binary' then 'omitted' else 'included' end as grp, count(*) as n_entries, sum(coalesce(size_bytes, 0))::bigint as n_bytes from files group by all")
def a20(spark, sf_dir):
    return model.inventory(files(spark, sf_dir, "export_id", "status", "text_status", "size_bytes"), selection.status_group(F.col("status"), F.col("text_status")))


@query("ref_s18_adapted_entries", "select path as path, language as language, n_chars as size_bytes from (select coalesce(path, 'doc/' || doc_id) as path, lang as language, n_chars from documents)")
def s18(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("path").alias("relative_path"), F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("name"), "lang", "n_chars")
    return model.adapted(rows, {"path": ("relative_path", "file_path", "name"), "language": ("lang",), "size_bytes": ("size", "n_chars")})


_COUNTED = f"""{SQL_FILES}, sums as (select export_id, count(*) as total_files, count(*) filter (status = 'included') as exported_files, count(*) filter (status = 'skipped' or text_status = 'binary') as skipped_files from files group by all),
    tree as (select export_id, count(*) as n_tree from (select export_id, path, 'file' as t from files union select export_id, array_to_string(string_split(path, '/')[:i], '/'), 'directory' from (select export_id, path, unnest(range(1, len(string_split(path, '/')))) as i from files)) group by all),
    broken as (select export_id, (case when status is null or status not in ('included', 'truncated', 'skipped', 'error') then 1 else 0 end + case when text_status is null or text_status not in ('text', 'binary') then 1 else 0 end + case when path is null or trim(path) = '' then 1 else 0 end
      + case when language is null or trim(language) = '' then 1 else 0 end + case when size_bytes < 0 then 1 else 0 end + case when line_count < 0 then 1 else 0 end + case when estimated_tokens < 0 then 1 else 0 end + case when status = 'included' and text_status = 'text' and content is null then 1 else 0 end) as n from files
      union all select export_id, 1 from files group by export_id, path having count(*) > 1),
    issues as (select export_id, sum(n)::bigint as n_issues from broken group by all)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir, "export_id", "path", "language", "status", "text_status", there(), "size_bytes", "line_count", "estimated_tokens", tokens_up(F.col("content")).alias("text_tokens"))


@query("ref_v2_finalized", f"with {_COUNTED} select s.*, n_tree, coalesce(n_issues, 0)::bigint as n_issues from sums s join tree using (export_id) left join issues using (export_id)")
def v2(spark, sf_dir):
    """Every export finalized: its summary, the size of its tree, and how many rules its entries break."""
    entries = _entries(spark, sf_dir)
    whole = lifecycle.finalized(entries)
    n_tree = whole.tree.groupBy("export_id").agg(F.count("*").alias("n_tree"))
    n_issues = whole.issues.join(entries.select("entry_id", "export_id"), "entry_id").groupBy("export_id").agg(F.count("*").alias("n_issues"))
    return whole.summary.drop("n_types").join(n_tree, "export_id").join(n_issues, "export_id", "left").withColumn("n_issues", F.coalesce("n_issues", F.lit(0)))


@query(
    "ref_v5_readiness",
    f"""with {_COUNTED}, r as (select export_id, count(*) as tracked, sum((length(content) + 3) // 4) as tokens from files group by all),
    c as (select e.export_id, coalesce(n_issues, 0)::bigint as n_contract, (case when coalesce(total_tracked_files, -1) = coalesce(tracked, 0) then 0 else 1 end + case when coalesce(estimated_tokens = coalesce(tokens, 0), false) then 0 else 1 end)::bigint as n_audit from exports e left join r using (export_id) left join issues using (export_id))
    select *, n_contract = 0 and n_audit = 0 as ready from c""",
)
def v5(spark, sf_dir):
    return lifecycle.readiness(_entries(spark, sf_dir), table(spark, sf_dir, "exports"), F.col("text_tokens"))


@query("ref_v7_self_test", "select * from (values ('no issues', true), ('summary', true), ('tree', true), ('ready', true), ('not ready with other totals', true), ('fingerprint', true), ('round trip', true)) t(\"check\", passed)")
def v7(spark, sf_dir):
    return lifecycle.self_test(spark)


@query(
    "ref_p14_change_selections",
    f"""with {_PORCELAIN}, scans as (select 'src/' || o_orderkey || '.py' as path, o_custkey as size_bytes, o_orderpriority = '1-URGENT' as is_binary from orders), s as (select l.*, size_bytes, coalesce(is_binary, false) as is_binary from last l left join scans using (path))
    select status, count(*) filter (not is_deleted and not is_binary) as diffable, count(*) filter (not is_deleted and not is_binary and size_bytes is not null) as text, count(*) filter (is_deleted) as deleted, count(*) filter (is_binary or (not is_deleted and size_bytes is null)) as skipped from s group by all""",
)
def p14(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    scans = orders.select(F.concat(F.lit("src/"), F.col("o_orderkey").cast("string"), F.lit(".py")).alias("path"), F.col("o_custkey").alias("size_bytes"), (F.col("o_orderpriority") == "1-URGENT").alias("is_binary"))
    joined = _porcelain(spark, sf_dir).join(scans, "path", "left")
    shown = changes.selections(joined, F.col("size_bytes").isNotNull())
    return shown.groupBy("status").agg(*[F.count_if(c).alias(c) for c in ("diffable", "text", "deleted", "skipped")])


_GROUP = "case when status = 'truncated' then 'truncated' when status in ('skipped', 'error') or text_status = 'binary' then 'omitted' else 'included' end"


@query(
    "ref_p23_section_files",
    f"""with {SQL_FILES}, g as (select export_id, path, {_GROUP} as grp from files) select 'Source-Export' as section, export_id, count(*) as n_files from g where grp = 'included' group by all union all select 'truncated_files', export_id, count(*) from g where grp = 'truncated' group by all
    union all select 'omitted  files', export_id, count(*) from g where grp = 'omitted' group by all union all select 'file summary', export_id, count(distinct path) from g group by all""",
)
def p23(spark, sf_dir):
    """How many files each section of each export shows; the last name is of no section."""
    entries = files(spark, sf_dir, "export_id", "path", "status", "text_status")
    shown = [lifecycle.files_for_section(entries, name).select(F.lit(name).alias("section"), "export_id") for name in ("Source-Export", "truncated_files", "omitted  files", "file summary", "other")]
    return reduce(DataFrame.unionByName, shown).groupBy("section", "export_id").agg(F.count("*").alias("n_files"))


@query(
    "ref_p24_modes",
    """with m as (select case o_orderstatus when 'F' then ' Full' when 'O' then 'changed' else o_orderpriority end as mode from orders), n as (select mode, lower(trim(mode)) as x, count(*) as n from m group by all)
    select mode, x as name, case x when 'full' then 'Full Repository Export' when 'changed' then 'Changed Files Export' end as title, case when x in ('full', 'changed') then true end as holds_texts, case x when 'changed' then true when 'full' then false end as for_review, n from n""".replace("select mode, x as name", "select mode, case when x in ('full', 'changed') then x end as name"),
)
def p24(spark, sf_dir):
    mode = F.when(F.col("o_orderstatus") == "F", " Full").when(F.col("o_orderstatus") == "O", "changed").otherwise(F.col("o_orderpriority"))
    counted = table(spark, sf_dir, "orders").groupBy(mode.alias("mode")).agg(F.count("*").alias("n")).withColumn("f", lifecycle.mode_flags(F.col("mode")))
    return counted.select("mode", F.col("f.mode").alias("name"), "f.title", "f.holds_texts", "f.for_review", "n")


@query(
    "ref_a22_merged_schema_reports",
    "select kind, value, n from (select 'table' as kind, p_type as value, count(*) as n from part group by all union all select 'table', 's' || s_nationkey, count(*) from supplier group by all union all select 'warning', w, 1 from (select p_brand as w from part union select 'nation ' || s_nationkey from supplier))",
)
def a22(spark, sf_dir):
    """Tables of several reports one after the other, warnings once."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    nation = F.col("s_nationkey").cast("string")
    reports = [part.select(F.lit("table").alias("kind"), F.col("p_type").alias("value")), part.select(F.lit("warning").alias("kind"), F.col("p_brand").alias("value")), supplier.select(F.lit("table").alias("kind"), F.concat(F.lit("s"), nation).alias("value")), supplier.select(F.lit("warning").alias("kind"), F.concat(F.lit("nation "), nation).alias("value"))]
    return report.merged_reports(reports, ("warning",)).groupBy("kind", "value").agg(F.count("*").alias("n"))


@query("ref_f35_normal_payloads", """select p_partkey, '{"a":{"x":' || p_size || ',"y":null},"b":["' || least(p_brand, p_type) || '","' || greatest(p_brand, p_type) || '"]}' as payload from part""")
def f35(spark, sf_dir):
    payload = F.concat(F.lit('{"b": ["'), "p_type", F.lit('", "'), "p_brand", F.lit('"], "a": {"y": null, "x": '), F.col("p_size").cast("string"), F.lit("}}"))
    return table(spark, sf_dir, "part").select("p_partkey", report.normal_payload(payload).alias("payload"))


# reports


@query(
    "ref_r1_assembled_report",
    f"with {SQL_FILES} select export_id, row_number() over (partition by export_id order by path, entry_id)::int as place, md5('## ' || path || chr(10) || chr(10) || content) as digest, length(content)::int as n_chars from files where content is not null",
)
def r1(spark, sf_dir):
    """The sections of every report in their order; their texts are digested where they are read."""
    section = F.concat(F.lit("## "), "path", F.lit("\n\n"), "content")
    rows = texts(spark, sf_dir, "export_id", "path", F.md5(section).alias("digest"), F.length("content").alias("n_chars"))
    return report.ordered(rows, "export_id", ["path", "entry_id"]).select("export_id", "place", "digest", "n_chars")


_SECTIONS = r"""rows as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents where text is not null),
    n as (select *, sum(case when regexp_matches(line, '^ {0,3}#{1,6}\s+\S') then 1 else 0 end) over (partition by doc_id order by pos) as section from rows)"""


@query(
    "ref_r4_heading_sections",
    f"with {_SECTIONS} select doc_id, section::bigint as section, min(pos)::int as first_line, count(*) as n_lines, case when section > 0 then trim(regexp_replace(min_by(line, pos), '^\\s*#+\\s*', '')) end as heading from n group by doc_id, section",
)
def r4(spark, sf_dir):
    return report.heading_sections(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query(
    "ref_r5_plain_parts",
    f"""with {SQL_FILES}, t as (select entry_id, content, greatest(ceil(length(content) / 1000.0), 1)::int as n from files where content is not null), p as (select *, unnest(range(0, n)) as k from t)
    select entry_id, (k + 1)::int as part, n as n_parts, length(content[k * 1000 + 1 : (k + 1) * 1000])::int as n_chars, md5(content[k * 1000 + 1 : (k + 1) * 1000]) as digest from p""",
)
def r5(spark, sf_dir):
    pieces = report.plain_parts(table(spark, sf_dir, "file_entries"), "entry_id", "content", F.lit(1000))
    return pieces.dropDuplicates(["entry_id", "part"])  # of digests


@query(
    "ref_r5_packed_sections",
    f"""with recursive {_SECTIONS}, z as (select doc_id, section::bigint as section, count(*) as n from n group by all), c as (select doc_id, section, unnest(range(1, greatest(ceil(n / 60.0), 1)::bigint + 1)) as piece, n from z),
    e as (select doc_id, section, piece, least(60, n - (piece - 1) * 60) as n_lines, row_number() over (partition by doc_id order by section, piece) as place from c),
    fold as (select doc_id, place, section, piece, n_lines, n_lines as used, 1 as part from e where place = 1
      union all select e.doc_id, e.place, e.section, e.piece, e.n_lines, case when f.used = 0 or f.used + e.n_lines > 60 then e.n_lines else f.used + e.n_lines end, case when f.used = 0 or f.used + e.n_lines > 60 then f.part + 1 else f.part end from fold f join e on e.doc_id = f.doc_id and e.place = f.place + 1)
    select doc_id, section, piece::int as piece, n_lines::bigint as n_lines, part::int as part from fold""",
)
def r5_packed(spark, sf_dir):
    """Sections of the documents in parts of at most 60 lines, a greedy fold over every document's sections; longer ones are cut."""
    sections = report.heading_sections(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return report.packed_sections(sections, "doc_id", "n_lines", "section", 60)


@query(
    "ref_k3_part_names",
    f"with {SQL_FILES}, p as (select entry_id, path, unnest(range(1, n + 1))::int as part, n from (select entry_id, path, greatest(ceil(length(content) / 1000.0), 1)::int as n from files where content is not null)) select entry_id, part, case when n <= 1 then path else regexp_extract(path, '^(.*/)[^/]*$', 1) || regexp_replace(regexp_extract(path, '([^/]*)$', 1), '([^.])\\.[^.]*$', '\\1') || '.part' || lpad(part::varchar, greatest(2, length(n::varchar))::int, '0') || regexp_extract(path, '[^./](\\.[^./]*)$', 1) end as name from p",
)
def k3(spark, sf_dir):
    n = F.greatest(F.ceil(F.length("content") / 1000), F.lit(1)).cast("int")
    parts = texts(spark, sf_dir, "path", n.alias("n")).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return parts.select("entry_id", "part", report.part_name(F.col("path"), F.col("part"), F.col("n")).alias("name"))


@query(
    "ref_w3_group_breaks",
    "with s as (select distinct export_id, file_path, name, kind, line_start from symbols) select export_id, file_path, name, kind, line_start, coalesce(file_path is distinct from lag(file_path) over w, true) or row_number() over w = 1 as starts from s window w as (partition by export_id order by file_path, line_start nulls first, name, kind)",
)
def w3(spark, sf_dir):
    rows = table(spark, sf_dir, "symbols").select("export_id", "file_path", "name", "kind", "line_start").distinct()
    return report.group_breaks(rows, "export_id", ["file_path", "line_start", "name", "kind"], "file_path")


@query(
    "ref_r12_symbol_index",
    "with s as (select distinct export_id, file_path, coalesce(line_start, -1) as at_line, name, file_path || ' L' || coalesce(line_start::varchar, '?') || ' ' || kind || ' ' || case when parent is null then name else parent || '.' || name end as line from symbols) select export_id, md5(string_agg(line, chr(10) order by file_path, at_line, name, line)) as digest from s group by export_id",
)
def r12(spark, sf_dir):
    return report.symbol_index(table(spark, sf_dir, "symbols"), "export_id").select("export_id", F.md5("text").alias("digest"))


# masks

# The SQL has its own expression: a name with one of the words in it, a sign, a value.
_WORDS = "(api_?key|token|secret|password|passwd|pwd)"
_PAIR = "(?i)(([a-z_][a-z0-9_]*?)?" + _WORDS + "[a-z0-9_]*)(?:&quot;|[\"''])?\\]?\\s*[:=]\\s*(?:&quot;|[\"''])?([^\"''\\s,;&<>]+)"
_HIDE = "case when length({v}) >= 16 then left({v}, 4) || '***REDACTED***' || right({v}, 4) when length({v}) >= 12 then left({v}, 3) || '***REDACTED***' || right({v}, 3) else '***REDACTED***' end"
_REAL = "length(v) >= 8 and not list_contains(['changeme', 'change-me', 'example', 'example-token', 'your-api-key', 'your_api_key', 'insert-key-here', 'todo', 'none', 'null', 'dummy', 'test', 'password', 'secret', 'true', 'false'], lower(v)) and not regexp_matches(v, '^[0-9.]+$') and not contains(v, '***REDACTED***') and not regexp_matches(v, '[()\\[\\]{}]')"
_FINDINGS = f"""l as (select entry_id, unnest(string_split_regex(content, '\\r?\\n')) as line, generate_subscripts(string_split_regex(content, '\\r?\\n'), 1)::int as line_number from files where content is not null),
    p as (select *, regexp_extract_all(line, '{_PAIR}', 1) as names, regexp_extract_all(line, '{_PAIR}', 4) as vals from l where regexp_matches(line, '(?i){_WORDS}') and not regexp_matches(line, '^\\s*#')),
    q as (select *, list_filter(range(1, len(vals) + 1), lambda i: list_aggregate(list_transform([vals[i]], lambda v: {_REAL}), 'bool_or')) as real from p),
    r as (select entry_id, line_number, line, names[real[1]] as variable_name, vals[real[1]] as matched_text, list_transform(real, lambda i: vals[i]) as v from q where len(real) > 0),
    found as (select entry_id, line_number, variable_name, matched_text, trim(list_reduce(list_prepend(line, v), lambda acc, x: replace(acc, x, {_HIDE.format(v='x')}))) as masked_text,
      case when regexp_matches(variable_name, '(?i)api_?key') then 'API_KEY' when contains(lower(variable_name), 'token') then 'TOKEN' when contains(lower(variable_name), 'secret') then 'SECRET' else 'PASSWORD' end as secret_type,
      case when line[instr(line, matched_text) - 1] in ('"', chr(39)) then 'high' else 'medium' end as confidence from r)"""


@query("ref_m2_masked_lines", f"with {SQL_FILES}, {_FINDINGS} select * from found")
def m2(spark, sf_dir):
    return masking.line_findings(table(spark, sf_dir, "file_entries")).distinct()


@query("ref_a12_secret_counts", f"with {SQL_FILES}, {_FINDINGS} select secret_type, count(*) as n_findings from found group by all")
def a12(spark, sf_dir):
    return masking.counts_by_type(m2(spark, sf_dir))


# events (an extension: the reference has no streams)


@query(
    "ext_tumbling_windows",
    "select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n_events from events group by all",
)
def tumbling(spark, sf_dir):
    return event_windows.tumbling(table(spark, sf_dir, "events"), "1 hour")


@query(
    "ext_sessions",
    """with o as (select user_id, ts, coalesce(ts - lag(ts) over (partition by user_id order by ts) >= interval '30 minutes', true) as starts from events), n as (select *, sum(starts::int) over (partition by user_id order by ts rows unbounded preceding) as s from o)
    select user_id, min(ts) as session_start, count(*) as n_events from n group by user_id, s""",
)
def sessions(spark, sf_dir):
    return event_windows.sessions(table(spark, sf_dir, "events"), "30 minutes")

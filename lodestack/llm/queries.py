"""Queries of the problems on training text and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.common import table
from lodestack.llm import contamination, functions, handwritten, packing, secrets, split, subjects, syntax, tokens


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_lines(table(spark, sf_dir, "file_entries"))


def p1_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masked content of every entry with a secret."""
    return secrets.mask_secrets(table(spark, sf_dir, "file_entries"))


def p1_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings and entries by type of secret."""
    found = secrets.find_secrets(table(spark, sf_dir, "file_entries"))
    return found.groupBy("secret_type").agg(F.count("*").alias("n_findings"), F.count_distinct("entry_id").alias("n_entries"))


def p1_masked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every entry after masking, which leaves their number as it is."""
    entries = table(spark, sf_dir, "file_entries").where("content <> ''")
    lines = lambda text: F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1
    masked = secrets.mask_secrets(entries).select("entry_id", lines(F.col("masked_content")).alias("masked_lines"))
    plain = entries.select("entry_id", lines(F.col("content")).alias("n")).distinct()
    return plain.join(masked, "entry_id", "left").select("entry_id", F.coalesce("masked_lines", "n").alias("n_lines"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, sf_dir, "file_entries")).select("entry_id")


def p2_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that were not written by hand, by kind and by what decided: a cluster or the file alone."""
    return handwritten.not_handwritten(table(spark, sf_dir, "file_entries")).groupBy("kind", "decided_by").agg(F.count("*").alias("n_entries"), F.count_distinct("cluster").alias("n_clusters"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_budget(table(spark, sf_dir, "file_entries"), table(spark, sf_dir, "languages"))


def p3_budget_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The totals of p3_found by source, domain and language."""
    return tokens.budget_by_slice(p3_found(spark, sf_dir), table(spark, sf_dir, "exports"))


def p3_tokenizer_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact tokens of a public byte-level BPE vocabulary by source, domain and language."""
    budget = tokens.token_budget(table(spark, sf_dir, "file_entries"), table(spark, sf_dir, "languages"), tokens.bpe_tokens)
    return tokens.budget_by_slice(budget, table(spark, sf_dir, "exports")).withColumnRenamed("estimated_tokens", "tokens")


def p3_unigram_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-path pieces under a public vocabulary of scored pieces by source, domain and language."""
    budget = tokens.token_budget(table(spark, sf_dir, "file_entries"), table(spark, sf_dir, "languages"), tokens.piece_tokens)
    return tokens.budget_by_slice(budget, table(spark, sf_dir, "exports")).withColumnRenamed("estimated_tokens", "pieces")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syntax.invalid_entries(table(spark, sf_dir, "file_entries"), table(spark, sf_dir, "languages")).select("entry_id").distinct()


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of unreadable entries by repository and language."""
    return syntax.invalid_rates(table(spark, sf_dir, "file_entries"), table(spark, sf_dir, "languages"))


def p5_json_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The unreadable entries among those in JSON."""
    return syntax.invalid_entries(table(spark, sf_dir, "file_entries"), table(spark, sf_dir, "languages")).where("lang = 'json'").select("entry_id")


def p6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every oversized entry."""
    return split.split_oversized(table(spark, sf_dir, "file_entries"), table(spark, sf_dir, "exports"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_pieces(spark, sf_dir).select("entry_id").distinct()


def p6_given_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each oversized entry put together again from its pieces, and how many pieces exceed a limit or miss their overlap."""
    limits = table(spark, sf_dir, "exports").select("export_id", "split_max_chars", "max_export_bytes", "split_overlap_chars").distinct()
    pieces = p6_pieces(spark, sf_dir).join(limits, "export_id")
    over = (F.col("n_chars") > F.col("split_max_chars")) | (F.col("n_bytes") > F.col("max_export_bytes"))
    short = (F.col("piece_no") > 1) & (F.col("overlap_chars") > F.col("split_overlap_chars"))
    new = F.struct("piece_no", F.substr("piece", F.col("overlap_chars") + 1).alias("text"))
    whole = pieces.groupBy("entry_id").agg(F.array_sort(F.collect_list(new)).alias("own"), F.count_if(F.coalesce(over, F.lit(False)) | F.coalesce(short, F.lit(False))).alias("n_faults"))
    return whole.select("entry_id", F.md5(F.array_join(F.transform("own", lambda x: x["text"]), "")).alias("digest"), "n_faults")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return functions.documented_functions(table(spark, sf_dir, "file_entries"), table(spark, sf_dir, "languages"))


def p7_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every documented function with its code and documentation."""
    return functions.function_pairs(table(spark, sf_dir, "file_entries"), table(spark, sf_dir, "languages"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one container of each kind."""
    return packing.pack(table(spark, sf_dir, "documents"), table(spark, sf_dir, "containers"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and unused share of each kind."""
    return packing.fill(p8_containers(spark, sf_dir), table(spark, sf_dir, "containers"))


def p8_placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in containers of each kind, and how many containers are too full or documents are placed more than once."""
    packed, containers = p8_containers(spark, sf_dir), table(spark, sf_dir, "containers").distinct()
    per = packed.groupBy("container_kind", "container_no").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("tokens")).join(containers, "container_kind")
    full = per.groupBy("container_kind").agg(F.count_if(F.col("tokens") + (F.col("items") - 1) * F.col("separator_tokens") > F.col("capacity_tokens")).alias("n_too_full"))
    pieces = packed.groupBy("container_kind", "doc_id", "piece_no").agg(F.count("*").alias("n"))
    placed = pieces.groupBy("container_kind").agg(F.count_distinct("doc_id").alias("n_documents"), F.count_if(F.col("n") > 1).alias("n_twice"))
    return placed.join(full, "container_kind")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_leaked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each test item that leaked, in how many documents and distinct sources."""
    sources = table(spark, sf_dir, "documents").select("doc_id", "source").distinct()
    return p9_found(spark, sf_dir).join(sources, "doc_id").groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_documents"), F.count_distinct("source").alias("n_sources"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subjects.assign_subjects(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_labels"), table(spark, sf_dir, "subjects")).select("doc_id", "subject")


def p10_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The make-up of the corpus: documents by source and subject."""
    return subjects.composition(p10_found(spark, sf_dir), table(spark, sf_dir, "documents"))


QUERIES = {
    "p1_found": p1_found,
    "p1_masked": p1_masked,
    "p1_types": p1_types,
    "p1_masked_lines": p1_masked_lines,
    "p2_found": p2_found,
    "p2_kinds": p2_kinds,
    "p3_found": p3_found,
    "p3_budget_by_source": p3_budget_by_source,
    "p3_tokenizer_budget": p3_tokenizer_budget,
    "p3_unigram_budget": p3_unigram_budget,
    "p5_found": p5_found,
    "p5_rates": p5_rates,
    "p5_json_faults": p5_json_faults,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p6_given_back": p6_given_back,
    "p7_found": p7_found,
    "p7_pairs": p7_pairs,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p8_placed": p8_placed,
    "p9_found": p9_found,
    "p9_leaked_items": p9_leaked_items,
    "p10_found": p10_found,
    "p10_composition": p10_composition,
}

_ENTRIES = r"""
with entry as (
  select entry_id, export_id, any_value(content) as content,
    any_value(coalesce(lower(trim(language)), nullif(lower(regexp_extract(regexp_extract(path, '[^/\\]*$'), '[^.]\.([^.]+)$', 1)), ''))) as alias
  from file_entries where content is not null group by all),
known as (select entry.*, l.language from entry left join languages l on l.alias = entry.alias),
budget as (select export_id, language, sum((length(content) + 3) // 4)::bigint as estimated_tokens from known group by all)
"""
_LEAKED = r"""
with doc as (select doc_id, source, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents where text is not null),
item as (select item_id, regexp_extract_all(lower(passage), '[\p{L}\p{N}]+') as w from eval_items where passage is not null),
doc_gram as (select distinct doc_id, array_to_string(w[i:i+11], ' ') as gram from (select doc_id, w, unnest(range(1, len(w) - 10)) as i from doc)),
item_gram as (select distinct item_id, array_to_string(w[i:i+11], ' ') as gram from (select item_id, w, unnest(range(1, len(w) - 10)) as i from item)),
cases as (select distinct doc_id, item_id from doc_gram join item_gram using (gram))
"""
SQL = {
    "p1_masked_lines": "select distinct entry_id, (length(content) - length(replace(content, chr(10), '')) + 1)::int as n_lines from file_entries where content <> ''",
    "p5_json_faults": _ENTRIES + "select distinct entry_id from known where language = 'json' and not json_valid(content)",
    "p6_given_back": "select distinct entry_id, md5(content) as digest, 0::bigint as n_faults from file_entries join exports using (export_id) where length(content) > split_max_chars or strlen(content) > max_export_bytes",
    "p8_placed": "select container_kind, n_documents, 0::bigint as n_too_full, 0::bigint as n_twice from containers, (select count(distinct doc_id) as n_documents from documents where text is not null)",
    "p3_found": _ENTRIES + "select export_id, language, estimated_tokens from budget",
    "p3_budget_by_source": _ENTRIES + "select source, domain_label, language, count(distinct export_id) as n_exports, sum(budget.estimated_tokens)::bigint as estimated_tokens from budget join exports using (export_id) group by all",
    "p6_found": """select distinct entry_id from file_entries join exports using (export_id)
        where length(content) > split_max_chars or strlen(content) > max_export_bytes""",
    "p9_found": _LEAKED + "select doc_id, item_id from cases",
    "p9_leaked_items": _LEAKED + "select item_id, count(distinct doc_id) as n_documents, count(distinct source) as n_sources from cases join doc using (doc_id) group by item_id",
}

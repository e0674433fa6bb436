"""Results don't depend on how rows lie or how many partitions a shuffle has; hot groups included."""

from __future__ import annotations

import pytest

from lodestack.llm import contamination, functions, handwritten, packing, secrets, split, syntax

CODE = (
    'import os\nPASSWORD = "S03PE5u6!D%"\n\n\ndef load_{k}(a):\n    """Reads one of the {k} files here."""\n    return os.open(a, {k})\n' + "".join(f"\n\ndef f{n}(b, c):\n    return [b + {n} for b in c if b]\n" for n in range(4)).replace("{", "{{").replace("}", "}}")
)


@pytest.fixture(scope="module")
def tables(spark):
    entries = [(k, 1 if k % 3 == 0 else k, k % 7, f"src/a{k}.py", "python", CODE.format(k=1 if k % 3 == 0 else k) + ("x = (\n" if k % 11 == 0 else "")) for k in range(240)]
    e = spark.createDataFrame(entries, "entry_id long, export_id long, repo_id long, path string, language string, content string")
    x = spark.createDataFrame([(k, 60, None, 5) for k in range(240)], "export_id long, split_max_chars int, max_export_bytes long, split_overlap_chars int")
    d = spark.createDataFrame([(k, "the same hot text of ten words in every third document" if k % 3 == 0 else "word " * (k % 50)) for k in range(300)], "doc_id long, text string")
    lang = spark.createDataFrame([("python", "python")], "alias string, language string")
    c = spark.createDataFrame([("a", 40, 1)], "container_kind string, capacity_tokens int, separator_tokens int")
    i = spark.createDataFrame([(1, "text of ten words in every third document"), (2, "word word word word word word")], "item_id long, passage string")
    return {
        "secrets": (e, secrets.find_secrets), "handwritten": (e, handwritten.not_handwritten), "syntax": (e, lambda t: syntax.invalid_rates(t, lang)), "split": (e, lambda t: split.split_oversized(t, x)),
        "functions": (e, lambda t: functions.function_pairs(t, lang)), "packing": (d, lambda t: packing.pack(t, c)), "contamination": (d, lambda t: contamination.leaked(t, i, 6)),
    }


@pytest.mark.parametrize("name", ["secrets", "handwritten", "syntax", "split", "functions", "packing", "contamination"])
def test_same_rows(spark, tables, name):
    table, operator = tables[name]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    try:
        for partitions, spread, adaptive in (("1", 1, "true"), ("7", 5, "true"), ("3", 9, "false")):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            found.append(sorted(map(str, operator(table.repartition(spread)).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert found[0] and found[0] == found[1] == found[2]

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.operators import changes, extract, graph, masking, model, ranking, report, selection, stats


def rows(df):
    return {tuple(r) for r in df.collect()}


def test_import_resolution_order(spark):
    modules = spark.createDataFrame([(1, m, m.replace(".", "/") + ("/__init__.py" if m in ("pkg", "pkg.sub") else ".py")) for m in ("pkg", "pkg.a", "pkg.b", "pkg.sub", "pkg.sub.c")], "export_id int, module string, path string")
    cases = [
        ("pkg.a", "import", "pkg.b", None, 0, "pkg.b", "local"), ("pkg.a", "import", "os.path", None, 0, None, "external"),
        ("pkg.a", "from", "pkg", "b", 0, "pkg.b", "local"), ("pkg.a", "from", "pkg.b", "name", 0, "pkg.b", "local"), ("pkg.a", "from", "pkg", "*", 0, "pkg", "local"),
        ("pkg.a", "from", None, "b", 1, "pkg.b", "local"), ("pkg.sub.c", "from", "b", "x", 2, "pkg.b", "local"), ("pkg.a", "from", "x", "y", 4, None, "unresolved"),
        ("pkg.sub", "from", "c", "x", 1, "pkg.sub.c", "local"), ("pkg.a", "from", None, "nothing", 1, None, "unresolved"),
    ]
    references = spark.createDataFrame([(1, i, *c[:5]) for i, c in enumerate(cases)], "export_id int, reference_id int, source_module string, import_type string, imported_module string, imported_name string, level int")
    got = {r.reference_id: (r.target_module, r.resolution) for r in graph.resolve_imports(references, modules).collect()}
    assert got == {i: c[5:] for i, c in enumerate(cases)}


def test_first_edges_and_centrality(spark):
    edges = spark.createDataFrame([("a", "b", 2), ("a", "b", 1), ("b", "b", 3), ("c", "b", 4)], "s string, t string, line int")
    assert rows(graph.first_seen(edges, ["s", "t"], ["line"])) == {("a", "b", 1), ("b", "b", 3), ("c", "b", 4)}
    assert rows(graph.centrality(edges, "s", "t", (35, 120), (8, 32))) == {("a", 0, 1, 8), ("b", 2, 0, 70), ("c", 0, 1, 8)}


def test_suffix_resolution(spark):
    symbols = spark.createDataFrame([("a.py", "pkg.a.f"), ("b.py", "pkg.b.f"), ("c.py", "pkg.c.K.m")], "path string, qualified_name string")
    calls = spark.createDataFrame([("pkg.a.f",), ("f",), ("K.m",), ("m",), ("x",)], "callee string")
    assert rows(graph.resolve_by_suffix(calls, symbols)) == {("pkg.a.f", "a.py"), ("f", None), ("K.m", "c.py"), ("m", "c.py"), ("x", None)}


def test_tree(spark):
    files = spark.createDataFrame([(1, "a/b.py"), (1, "a/c/d.py"), (1, "e")], "r int, path string")
    tree = graph.tree_rows(files, "r")
    lines = [r.line for r in graph.preorder(graph.drawn(tree, "r"), "r").orderBy("place").collect()]
    assert lines == ["|-- a", "|   |-- b.py", "|   `-- c", "|       `-- d.py", "`-- e"]
    assert graph.conflicts(spark.createDataFrame([(1, "a"), (1, "a/b")], "r int, path string"), "r").collect()[0].path == "a"


def test_python_extraction(spark):
    source = "import a.b as c\nfrom . import d\nclass K:\n    async def m(self):\n        self.n()\n        c.x()\n        foo().bar()\n    def n(self): pass\ndef f():\n    def g(): f()\n    g()\n"
    files = spark.createDataFrame([(1, source), (2, "def (:\n"), (3, None)], "entry_id int, content string")
    symbols, imports, calls = extract.python_symbols(files), extract.python_imports(files), extract.python_calls(files)
    assert {(r.kind, r.name, r.parent) for r in symbols.where("entry_id = 1").collect()} == {("class", "K", None), ("method", "m", "K"), ("method", "n", "K"), ("function", "f", None)}
    assert symbols.where("kind = 'error'").count() == 1 and imports.where("import_type = 'error'").count() == 1
    got = {(r.caller, r.callee): r.confidence for r in extract.resolve_calls(calls, symbols, imports).collect()}
    assert got == {("K.m", "n"): "local_method", ("K.m", "x"): "external", ("K.m", "foo"): "unresolved", ("K.m", "bar"): "unresolved_method", ("f.g", "f"): "local", ("f", "g"): "unresolved"}


def test_repository_calls_and_ranking(spark):
    sources = {
        "pyproject.toml": '[project]\nname = "x"\n[project.scripts]\nrun = "demo.cli:main"\n',
        "src/demo/__init__.py": "",
        "src/demo/cli.py": "from demo.core import load as read, twice\nfrom . import util\nimport json\n\ndef main():\n    read(json.loads(x))\n    twice()\n    util.go()\n",
        "src/demo/core.py": "def load(x):\n    return x\n\ndef twice(): pass\ndef twice(): pass\n",
        "src/demo/util.py": "def go():\n    go()\n",
        "bad.py": "def (:\n",
    }
    files = spark.createDataFrame([(i, 1, p, t) for i, (p, t) in enumerate(sources.items())], "entry_id long, r int, path string, content string")
    facts = extract.PythonFacts(files.where("path like '%.py'").unionAll(files.where("path like '%cli.py'")))
    got = {(r.caller, r.callee): (r.confidence, r.callee_qualified_name, r.target_path) for r in facts.resolved_calls(files, "r").collect()}
    assert got == {
        ("main", "read"): ("imported_local", "demo.core.load", "src/demo/core.py"), ("main", "loads"): ("external", "json.loads", None), ("main", "twice"): ("unresolved", None, None),
        ("main", "go"): ("unresolved", None, None), ("go", "go"): ("local", None, None),
    }
    assert [(r.line_number, bool(r.message)) for r in facts.errors().collect()] == [(1, True)]
    scripts = extract.console_scripts(files.where("path = 'pyproject.toml'")).join(files.select("entry_id", "r"), "entry_id")
    ranked = {r.path: (r.score, r.reasons) for r in ranking.rank_repository(facts, files, "r", scripts).collect()}
    assert ranked["src/demo/cli.py"] == (100 + 75 + 16 + 6, "entry point; imports 2; calls into 1")
    assert ranked["src/demo/core.py"] == (70, "imported by 1; called from 1") and ranked["src/demo/util.py"] == (35, "imported by 1") and ranked["pyproject.toml"][0] == 70


def test_callers_and_callees(spark):
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("a", "b")], "s string, t string")
    assert rows(graph.callers_and_callees(edges, "s", "t", 1)) == {("a", 0, 2, None, "b"), ("b", 1, 1, "a", "c"), ("c", 2, 0, "a", None)}
    assert rows(graph.duplicate_siblings(spark.createDataFrame([(1, "A/b"), (1, "a/b"), (1, "c")], "r int, path string"), "r")) == {(1, "a/b", 2)}


def test_consecutive_path_sets(spark):
    seen = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 3, "b"), (1, 3, "c"), (2, 2, "x")], "g int, s int, path string")
    assert rows(changes.consecutive_path_sets(seen, "g", "s", "path")) == {(1, 3, "a", "removed"), (1, 3, "b", "kept"), (1, 3, "c", "added")}


def test_deep_python_has_facts():
    deep = "def f():\n    return " + "+".join(["g(1)"] * 1500) + "\n"
    assert [r[0] for r in extract.facts_of(deep)].count("call") == 1500


def test_shell_extraction(spark):
    source = "main() {\n  one && two | three; echo four\n  # five\n  \"six\"\n}\nfunction one {\n  one\n}\ntwo() { :; }\ncat <<EOT\nthree() {\nEOT\nopen() {\n  x\n"
    assert extract.bash_functions_of(source) == [("main", 1, 5), ("one", 6, 8), ("two", 9, 9), ("open", 13, 13)]
    files = spark.createDataFrame([(1, source)], "entry_id int, content string")
    assert {(r.caller, r.callee, r.call_line) for r in extract.bash_call_edges(files).collect()} == {("main", "one", 2), ("main", "two", 2), ("one", "one", 7)}


def test_definitions_and_dependencies():
    ddl = "-- c;\nCREATE TEMP TABLE IF NOT EXISTS s.\"t x\" (a INT PRIMARY KEY, [b c] VARCHAR(10) NOT NULL DEFAULT 'x;y', d TEXT DEFAULT NULL, PRIMARY KEY (a), FOREIGN KEY (a) REFERENCES u (v) ON DELETE CASCADE); CREATE INDEX i ON t (a); create table broken;"
    assert extract.tables_of(ddl) == [("t x", 0, "a", "INT", None, None, True), ("t x", 1, "b c", "VARCHAR(10)", False, "'x;y'", False), ("t x", 2, "d", "TEXT", True, "NULL", False), ("broken", None, None, None, None, None, None)]
    assert extract.foreign_keys_of(ddl) == [("t x", "a", "u", "v", "CASCADE", None)]
    toml = '[project]\ndependencies = ["A_b[x]>=1; python_version>\'3\'"]\n[tool.poetry.dependencies]\npython = "^3"\nc = {version = "1"}\n[tool.poetry.group.dev.dependencies]\nd = "*"\n'
    assert [(r[1], r[2], r[3]) for r in extract.toml_dependencies_of(toml)] == [("a-b", ">=1", "runtime"), ("c", "1", "runtime"), ("d", "*", "development")]
    assert extract.toml_dependencies_of("x = [")[0][3] == "error"


def test_requirements_and_scripts(spark):
    files = spark.createDataFrame([(1, "requirements-dev.txt", "# c\nFoo.Bar[x]==1 # why\n-r other\ngit+https://x\n\nbaz")], "entry_id int, path string, content string")
    got = [(r.normalized_name, r.version_constraint, r.dependency_type) for r in extract.requirement_lines(files).orderBy("line_number").collect()]
    assert got == [("foo-bar", "==1", "development"), (None, None, "warning"), (None, None, "warning"), ("baz", None, "development")]
    toml = spark.createDataFrame([(1, '[project]\nname = "x"\n[project.scripts]\nrun = "a.b:main"\n[tool.x]\nrun = "no"\n')], "entry_id int, content string")
    assert rows(extract.console_scripts(toml)) == {(1, "run", "a.b:main")}


def test_status_lines(spark):
    lines = spark.createDataFrame([(i, x) for i, x in enumerate([" M a", "?? b", "AD c", "R  old -> d", "A  a", "", "M"])], "pos int, line string")
    parsed = lines.select("pos", changes.porcelain(F.col("line")).alias("c")).where("c is not null").select("pos", "c.*")
    assert {(r.path, r.status) for r in changes.last_of_each(parsed, "pos", ["path"]).collect()} == {("a", "added"), ("b", "untracked"), ("c", "deleted"), ("d", "renamed")}


def test_sets_and_groups(spark):
    old, new = spark.createDataFrame([("a",), ("b",), ("b",)], "path string"), spark.createDataFrame([("b",), ("c",)], "path string")
    assert rows(changes.path_sets(old, new)) == {("a", "removed"), ("b", "kept"), ("c", "added")}
    one, two = spark.createDataFrame([("a", 1)], "path string, x int"), spark.createDataFrame([("a", 2), ("b", 3)], "path string, x int")
    assert rows(changes.known_files([one, two], ["path"])) == {("a", 0, 1), ("b", 1, 3)}


def test_ranking(spark):
    files = spark.createDataFrame([(1, "pyproject.toml", ""), (1, "src/demo/cli.py", ""), (1, "src/demo/core.py", "x"), (1, "z/main.py", ""), (1, "a/b/main.py", "")], "r int, path string, content string")
    edges = spark.createDataFrame([(1, p, "src/demo/core.py") for p in ("src/demo/cli.py", "z/main.py", "z/main.py", "gone.py")], "r int, source string, target string")
    scripts = spark.createDataFrame([(1, "src/demo/cli.py")], "r int, path string")
    got = [(r.path, r.score, r.reasons) for r in ranking.rank(files, edges, edges.where("false"), "r", scripts).orderBy("place").collect()]
    assert got == [("src/demo/cli.py", 183, "entry point; imports 1"), ("z/main.py", 88, "entry point; imports 1"), ("a/b/main.py", 80, "entry point"), ("pyproject.toml", 70, "project structure"), ("src/demo/core.py", 70, "imported by 2")]


def test_model(spark):
    entries = spark.createDataFrame(
        [(1, 1, "a", "py", "included", "text", "x", 1, 1, 1), (2, 1, "a", None, "odd", "text", None, -1, 1, 1)],
        "entry_id int, export_id int, path string, language string, status string, text_status string, content string, size_bytes long, line_count long, estimated_tokens long",
    )
    assert rows(model.issues(entries)) == {(2, "status"), (2, "language"), (2, "size_bytes"), (1, "duplicate_path")}


def test_sections_and_parts(spark):
    docs = spark.createDataFrame([(1, "pre\n# A\nx\n## B\ny\nz"), (2, ""), (3, None)], "d int, text string")
    got = [(r.d, r.section, r.n_lines, r.heading) for r in report.heading_sections(docs, "d").orderBy("d", "section").collect()]
    assert got == [(1, 0, 1, None), (1, 1, 2, "A"), (1, 2, 3, "B"), (2, 0, 1, None)]
    sizes = spark.createDataFrame([(1, i, n) for i, n in enumerate([3, 3, 9, 1, 1])], "d int, section long, n long")
    assert [(r.section, r.piece, r.n, r.part) for r in report.packed_sections(sizes, "d", "n", "section", 6).orderBy("section", "piece").collect()] == [(0, 1, 3, 1), (1, 1, 3, 1), (2, 1, 6, 2), (2, 2, 3, 3), (3, 1, 1, 3), (4, 1, 1, 3)]
    name = spark.range(1).select(report.part_name(F.lit("out/full.txt"), F.lit(3), F.lit(120)).alias("a"), report.part_name(F.lit("full.txt"), F.lit(1), F.lit(1)).alias("b")).first()
    assert tuple(name) == ("out/full.part003.txt", "full.txt")


def test_life_cycle(spark):
    from lodestack.operators import lifecycle

    assert all(r.passed for r in lifecycle.self_test(spark).collect())
    entries = lifecycle.entry_rows(spark, [{"path": "a", "language": "x", "content": "1"}, {"path": "b", "status": "truncated", "content": ""}, {"path": "c"}])
    names = lambda section: {r.path for r in lifecycle.files_for_section(entries, section).collect()}
    assert names("Source Export") == {"a"} and names("truncated_files") == {"b"} and names("omitted-files") == {"c"} and names("file_summary") == {"a", "b", "c"} and not names("else")
    words = spark.createDataFrame([(" File--Summary ", "Full"), ("", "x")], "a string, m string").select(lifecycle.normalized_section(F.col("a")).alias("a"), lifecycle.section_title(F.col("a")).alias("t"), lifecycle.mode_flags(F.col("m")).alias("m")).collect()
    assert (words[0].a, words[0].t, words[0].m.for_review, words[1].a, words[1].m) == ("file_summary", "File Summary", False, None, None)
    empty = entries.where("false")
    assert lifecycle.finalized(empty).summary.isEmpty() and lifecycle.readiness(empty, lifecycle.export_row(spark, empty)).first().ready


def test_payloads_and_merges(spark):
    texts = ['{"b": [3, 1, {"y": 1, "x": [2, 1]}], "a": null}', "no", None]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").select(report.normal_payload(F.col("t")).alias("t")).collect()]
    assert got == ['{"a":null,"b":[1,3,{"x":[1,2],"y":1}]}', None, None]
    one = spark.createDataFrame([("t", "a"), ("w", "x")], "kind string, value string")
    assert sorted(tuple(r) for r in report.merged_reports([one, one], ("w",)).collect()) == [("t", "a"), ("t", "a"), ("w", "x")]


def test_simple_score(spark):
    cases = [("pyproject.toml", 0, 0, 10, 1100), ("docs/architecture_spec.md", 0, 0, 10, 940 + 80 + 75), ("tests/test_a.py", 25, 3, 400, 100 + 35 + 20 + 12 + 10), ("a.txt", 0, 0, 900, None)]
    df = spark.createDataFrame(cases, "path string, d int, m int, n int, expected int").select("expected", ranking.simple_score(F.col("path"), F.col("d"), F.col("m"), F.col("n")).alias("s"))
    assert all((r.s.score if r.s else None) == r.expected for r in df.collect())


def test_model_writers(spark, tmp_path):
    import io

    from lodestack.operators import sinks

    stream = io.StringIO()
    sinks.write_model("text", stream)
    sinks.write_model("text", tmp_path / "out.md")
    assert stream.getvalue() == (tmp_path / "out.md").read_text() == "text"
    rows = report.ordered(spark.createDataFrame([(1, "b", "two"), (1, "a", "one"), (1, "c", None)], "r int, path string, section string"), "r", ["path"])
    assert sinks.write_ordered(str(tmp_path / "r.md"), rows) == 3 and (tmp_path / "r.md").read_text() == "one\n\ntwo\n\n"
    assert sinks.summary_lines("Files", spark.sql("select 12345 as n_files, 'main' as branch")) == ["Files:", "  n files: 12,345", "  branch: main"]


def test_masking(spark):
    source = 'API_KEY = "abcdefghijkl"\nexport DB_PASSWORD=hunter2hunter\nos.environ["AUTH_TOKEN"] = "zzzzyyyyxxxxwwww"\npassword = "changeme"\n# token = "abcdefghijkl"\nsecret = 12345678\ntoken = "***REDACTED***"\nx = 1\nrun(1, token="abcdefghi", pwd=\'qqqqwwwweeeerrrr\')'
    got = [(r.line_number, r.secret_type, r.masked_text, r.confidence) for r in masking.line_findings(spark.createDataFrame([(1, source)], "entry_id int, content string")).orderBy("line_number").collect()]
    assert got == [
        (1, "API_KEY", 'API_KEY = "abc***REDACTED***jkl"', "high"), (2, "PASSWORD", "export DB_PASSWORD=hun***REDACTED***ter", "medium"),
        (3, "TOKEN", 'os.environ["AUTH_TOKEN"] = "zzzz***REDACTED***wwww"', "high"), (9, "TOKEN", 'run(1, token="***REDACTED***", pwd=\'qqqq***REDACTED***rrrr\')', "high"),
    ]
    key = "a\n-----BEGIN RSA PRIVATE KEY-----\nMIIE\nabcd\n-----END RSA PRIVATE KEY-----\nz\n"
    texts = [r.t for r in spark.createDataFrame([(source,), (key,), ("plain\n",)], "t string").select(masking.masked_text(F.col("t")).alias("t")).collect()]
    assert "hunter2" not in texts[0] and texts[0].count("\n") == source.count("\n") and "# token" in texts[0]
    assert "MIIE" not in texts[1] and texts[1].startswith("a\n-----BEGIN") and texts[1].endswith("-----\nz\n") and texts[2] == "plain\n"


def test_selection_and_stats(spark):
    files = spark.createDataFrame([(1, 1, "b"), (2, 1, "a"), (3, 1, "c"), (4, 2, "a")], "entry_id int, r int, path string")
    assert {(x.r, x.path, x.omitted) for x in selection.first_files(files, "r", 2).collect()} == {(1, "a", 1), (1, "b", 1), (2, "a", 0)}
    langs = spark.createDataFrame([(1, "b"), (1, "a"), (1, None)], "r int, lang string")
    assert rows(stats.primary_language(langs, "r")) == {(1, "a", 1)}
    names = spark.createDataFrame([(1, "My Repo"), (2, "my-repo"), (3, "x")], "i int, n string")
    assert {(r.i, r.unique_id) for r in stats.disambiguated(names, "n", "i").collect()} == {(1, "my-repo"), (2, "my-repo-2"), (3, "x")}

from __future__ import annotations

import io
import sqlite3
import subprocess
import zipfile

import pytest
from pyspark.sql import functions as F

from lodestack.operators import sinks
from lodestack.sources import archives, folder, git, settings
from lodestack.streaming import events


@pytest.fixture
def repository(tmp_path):
    root = tmp_path / "repo"
    (root / "src").mkdir(parents=True)
    (root / "README.md").write_text("# Demo\n\nA sentence.\n")
    (root / "src" / "app.py").write_text("def f():\n    return 1\n")
    (root / "src" / "a+b c.py").write_text("x = 1\n")
    (root / "assets.bin").write_bytes(b"\0\1\2text")
    (root / "latin.txt").write_bytes(b"caf\xe9")
    (root / "empty.txt").write_bytes(b"")
    run = lambda *a: subprocess.run(["git", "-c", "user.name=n", "-c", "user.email=e@x", "-C", str(root), *a], check=True, capture_output=True)
    run("init", "-q", "-b", "main")
    run("add", ".")
    run("commit", "-qm", "first")
    return root, run


def test_scan(spark, repository):
    root, _ = repository
    got = {r.path: r for r in folder.scan(spark, str(root), git.tracked_files(spark, str(root))).collect()}
    assert set(got) == {"README.md", "src/app.py", "src/a+b c.py", "assets.bin", "latin.txt", "empty.txt"}
    assert (got["src/app.py"].language, got["src/app.py"].line_count, got["src/app.py"].is_text) == ("python", 2, True)
    assert got["assets.bin"].is_binary and got["assets.bin"].content is None
    assert got["latin.txt"].error == "unable to decode" and got["empty.txt"].line_count == 0


def test_git(spark, repository):
    root, run = repository
    info = git.repository_info(spark, str(root)).first()
    assert (info.branch, info.subject, info.is_dirty, info.author_email) == ("main", "first", False, "e@x")
    (root / "README.md").write_text("changed\n")
    (root / "new.txt").write_text("n")
    assert {(r.path, r.status) for r in git.changed_files(spark, str(root)).collect()} == {("README.md", "modified"), ("new.txt", "untracked")}
    assert "+changed" in git.diff_text(str(root))
    run("checkout", "-qb", "side")
    run("add", ".")
    run("commit", "-qm", "second")
    assert {(r.path, r.status) for r in git.changed_files(spark, str(root), "main").collect()} == {("README.md", "modified"), ("new.txt", "added")}
    with pytest.raises(ValueError):
        git.changed_files(spark, str(root), "nowhere")
    assert git.repository_root(str(root / "src")) == str(root.resolve())


def test_archives_and_databases(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("a/b.txt", "hello")
        archive.writestr("../evil.txt", "x")
    base = tmp_path / "x.db"
    with sqlite3.connect(base) as connection:
        connection.execute("create table t (id integer primary key, name text not null default 'x')")
        connection.execute("create view v as select name from t")
    data = spark.createDataFrame([("z", bytearray(buffer.getvalue())), ("broken", bytearray(b"no"))], "path string, content binary")
    members = {(r.path, r.member, r.error is None) for r in archives.zip_members(data).collect()}
    assert members == {("z", "a/b.txt", True), ("z", "../evil.txt", False), ("broken", None, False)}
    files = spark.createDataFrame([("x.db", bytearray(base.read_bytes())), ("fake.db", bytearray(b"SQLite format 3\0garbage"))], "path string, content binary")
    rows = archives.sqlite_columns(files).collect()
    assert {(r.table_name, r.table_type, r.column_name, r.nullable, r.pk_position) for r in rows if r.path == "x.db"} == {("t", "table", "id", True, 1), ("t", "table", "name", False, 0), ("v", "view", "name", True, 0)}
    assert all(r.error for r in rows if r.path == "fake.db")
    kinds = folder.schema_files(files.select("path"), files)
    assert {(r.path, r.warning) for r in kinds.collect()} == {("x.db", None), ("fake.db", None)}


def test_settings(tmp_path):
    (tmp_path / settings.CONFIG_NAME).write_text("include: {globs: ['*.py']}\nlimits: {max_total_files: 3}\nsplit: {enabled: true, strategy: plain}\n")
    got = settings.load(str(tmp_path))
    assert got.include.globs == ("*.py",) and got.max_total_files == 3 and got.split and got.split_strategy == "plain"
    for bad in ({"other": 1}, {"limits": {"max_total_files": 0}}, {"include": {"globs": "x"}}, {"split": {"strategy": "x"}}, []):
        with pytest.raises(ValueError):
            settings.parse(bad)


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "full.txt")
    assert len(sinks.write_parts(path, "x" * 25, 10)) == 4
    assert sinks.write_parts(path, "y", 10) == [path] and not list(tmp_path.glob("full.part*"))
    files = spark.createDataFrame([(1, "a.py", "python", 'password = "hunter2hunter"\n```'), (1, "b.bin", None, None)], "r int, path string, language string, content string")
    body = sinks.full_report(files, "r").first().text
    assert "- files: 2" in body and "## a.py" in body and "````python" in body and "hunter2" not in body
    assert len(sinks.full_report(files, "r", 60).first().text.encode()) <= 60
    sinks.write_dossier(str(tmp_path / "d.zip"), {"full.txt": body})
    with pytest.raises(FileExistsError):
        sinks.write_dossier(str(tmp_path / "d.zip"), {})
    ignore = str(tmp_path / ".gitignore")
    assert sinks.write_ignores(ignore, ["full.txt"]) and not sinks.write_ignores(ignore, ["full.txt"])
    sinks.write_json(files, str(tmp_path / "json"))
    assert archives.entries_from_json(spark.read.text(str(tmp_path / "json")), "content string, language string, path string, r int").count() == 2


def test_event_stream(spark, tmp_path):
    rows = spark.sql("select timestamp_ntz'2026-01-01 00:00:00' + make_dt_interval(0, 0, cast(id as int)) as ts, 'a' as event_type, 1L as user_id from range(120)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = events.tumbling(events.stream(spark, str(tmp_path / "in"), rows.schema), "1 hour")
    query = stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert {(str(r.window_start), r.n_events) for r in spark.table("windows").collect()} == {(str(r.window_start), r.n_events) for r in events.tumbling(rows, "1 hour").collect()}
    assert events.sessions(rows.withColumn("x", F.lit(1)), "30 minutes").first().n_events == 120


def test_registry_is_whole():
    from lodestack.plans import registry

    queries, sql = registry.queries(), registry.sql()
    assert set(sql) <= set(queries) and len(queries) > 80


def test_reports(spark, repository):
    from lodestack.__main__ import files_of, main

    root, _ = repository
    (root / "src" / "util.py").write_text("from src import app\nimport app\npassword = 'hunter2hunter2'\n")
    (root / "pyproject.toml").write_text('[project]\nname = "demo"\ndependencies = ["Lib_a>=1"]\n')
    (root / "schema.sql").write_text("create table t (id int primary key, name text);\n")
    subprocess.run(["git", "-C", str(root), "add", "."], check=True)
    files, _ = files_of(spark, str(root))
    from lodestack.operators import rendering

    full = rendering.render(files, "repository").first().text
    for part in ("## Repository", "- tracked: 9", "| Python | 3 |", "`-- ", "src/app.py L1 function f", "- lib-a>=1 (runtime, pyproject.toml)", "- t.id int", "- src/util.py:3 PASSWORD", "### src/app.py\n\n```python\n"):
        assert part in full, part
    assert "hunter2" not in full
    ai = rendering.render(files, "repository", "ai").first().text
    assert "1. src/app.py (105): entry point; imported by 1" in ai and "2. README.md (90): documentation" in ai and "- type: Python package" in ai
    assert "A sentence." in rendering.render(files, "repository", "docs").first().text
    shown = rendering.render(files, "repository", "docs", settings={"Include paths": (), "Limit max_file_bytes": None, "Config active": True}).first().text
    assert "## Configuration\n\n- Include paths: none\n- Limit max_file_bytes: none\n- Config active: yes" in shown
    scripts = spark.createDataFrame([(1, "a.sh", "bash", "one() {\n  two\n}\n", 3, "text", "included"), (1, "b.sh", "bash", "two() {\n  :\n}\n", 3, "text", "included")], "r int, path string, language string, content string, line_count int, text_status string, status string")
    changed = scripts.select("r", "path", F.lit("modified").alias("status"))
    assert "## Shell calls\n\n- a.sh:2 one -> two" in rendering.render(scripts, "r", "changed", changes=changed).first().text
    out = root.parent / "changed.txt"
    assert main(["changed", str(root), str(out)]) == 0
    assert "- added schema.sql" in out.read_text() and "hunter2" not in out.read_text()
    assert len(rendering.render(files, "repository", "full", 200).first().text.encode()) <= 200
    with pytest.raises(ValueError):
        rendering.render(files, "repository", "other")

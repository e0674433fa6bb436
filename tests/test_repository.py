from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestack.operators import extract, ranking, repository
from lodestack.plans import graph_queries

SOURCES = {
    "pyproject.toml": None,
    "src/demo/__init__.py": "from .core import load\nload()\n",
    "src/demo/cli.py": "from demo.core import load as read, twice\nfrom . import util\nimport json, a.b\nfrom json import *\n\ndef main():\n    read(json.loads(x))\n    twice()\n    util.go()\n    a.b.c()\n    foo()()\n",
    "src/demo/core.py": "def load(x):\n    return x\n\ndef twice(): pass\ndef twice(): pass\n",
    "demo/core.py": "def load(x):\n    return twice(x)\n",
    "demo/sub/__init__.py": "from ..core import load\nfrom .... import gone\nfrom .deep import one as two, missing\nfrom demo import core\ntwo(load(missing(gone(core.load()))))\n",
    "demo/sub/deep.py": "import demo.sub\nfrom demo import sub, core as c\nclass K:\n    def one(self):\n        self.one(); cls.two(); K.one(); sub.x(); c.load()\n        def inner(): one()\n    def twice(self): pass\n    def twice(self): self.twice()\ndef one(): one()\n",
    "demo/sub.py": "from .core import load\nfrom . import core\nload(core.load())\n",
    "demo/main.py": "import demo.core as demo\nfrom demo.core import load\ndef load(): load()\nload()\ndemo.load.x()\n",
    "9x/bad.py": "from demo.core import load\nload()\n",
    "bad.py": "def (:\n",
    "none.py": None,
    "README.md": None,
    "b/long.py": "".join(f"def f{i}(): pass\n" for i in range(12)) + "def f3(): pass\n",
    "b/use.py": "from b.long import f1, f3, f99\nf1(f3(f99()))\n",
}


def odd(spark):
    rows = [(i, r, p, t) for i, (r, p, t) in enumerate((r, p, t) for r in (1, 2) for p, t in SOURCES.items() if r == 1 or "core" not in p)]
    return spark.createDataFrame(rows, "entry_id long, r int, path string, content string")


@pytest.fixture(params=[False, True])
def held(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(repository, "MOST_HELD", 10)  # nearly every file waits in the temporary file
    return request.param


def test_calls_and_ranks_are_those_of_joined_facts(spark):
    files = odd(spark)
    names = ["r", *repository.CALL]
    joined = extract.PythonFacts(files).resolved_calls(files, "r").join(files.select("entry_id", "r", F.col("path").alias("path")), "entry_id").select(*names)
    got = sorted(map(repr, repository.resolved_calls(files, "r").select(*names).collect()))
    assert got == sorted(map(repr, joined.collect())) and len(got) > 50
    assert {"local", "local_method", "ambiguous", "imported_local", "external", "unresolved", "unresolved_method"} <= {r.confidence for r in joined.collect()}
    want = sorted(map(repr, ranking.rank_repository(extract.PythonFacts(files), files, "r").collect()))
    assert sorted(map(repr, ranking.rank_repositories(files, "r").collect())) == want and len(want) > 15


def test_waiting_files_are_read_again(held):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"r": [1] * len(SOURCES), "path": list(SOURCES), "content": list(SOURCES.values())})
    own = repository._Repository(repository.Reader(), iter([batch.slice(0, 4), batch.slice(4)]), True)
    assert bool(own.kept) == held
    for _ in range(2):
        assert [x[0] for x in own.files()] == list(SOURCES)


def test_texts_of_one_shape():
    def told(found):
        if found is None:
            return None
        plan, values = found
        at = lambda *places: tuple(values[i] for i in places)
        return at(*plan.defined), [(w, *at(m, n), level) for w, m, n, level in plan.imports], [(*at(a, b), *rest) for a, b, *rest in plan.calls]

    texts = [x for x in SOURCES.values() if x]
    text = "from {0}.x import {1} as {2}\nimport os.path\nclass {3}:\n    def {1}({5}):\n        {5}.{1}({6})\n        {3}.{4}()\n        match({2}(1, {0}.{4}()))\n"
    for names in ("abcdefg", "gfedcba", ["a", "a", "b", "c", "d", "e", "f"], ["a", "b", "c", "d", "e", "self", "g"], ["a", "b", "c", "d", "e", "x", "g"], ["if", *"bcdefg"], ["os", "x", "os", "path", "x", "cls", "g"], ["é", *"bcdefg"], ["a1", "b_", "_", "type", "match", "f", "print"], ["a", "b", "c", "d", "e", "f", "1"], ["a", "b", "c", "d", "e", "f", "2"], ["_0_", "_57_", "c", "d", "e", "f", "0"], ["a", "b", "c", "d", "e", "f", "08"]):
        texts.append(text.format(*names))
    texts += ["x = 1.e5\n", "x = 1.e6\n", "x = 1.f5\n", "x = 0xab\n", "x = 1if y else z\n", "f(1.real)\n", "g(2)\n", "g(3)\n", "print x\n", "h(i) # j\n", "h(k) # l\n", "h('i')\n", "h('k')\n", "a.b.c(d)\n", "a.b.a(d)\n", "", "\n", "a.b.c(a)\n", "match x:\n    case y: z()\n", "mitch x:\n    case y: z()\n", "async def f(): g()\n", "def f(): g()\n", "x\0y", "from __future__ import barry_as_FLUFL\na <> b\n", "from __future__ import something_else\na <> b\n"]
    reader = repository.Reader()
    for _ in range(3):
        for t in texts + texts[::-1]:
            assert told(reader.read(t)) == told(repository.plan_of(t)), t
    assert len(reader.recent) == repository._RECENT and any(reader.shapes.values())


@pytest.mark.parametrize("name", ["ref_a15_confidence_read_again", "ref_j7_calls_read_again", "ref_j10_ranked_read_again"])
def test_files_of_a_repository_are_shuffled_once(spark, tmp_path, name):
    """Facts are neither stored nor joined: pairs are shuffled once by supplier, and then only the result."""
    rows = [(s, p) for s in range(7) for p in range(s * 3)] * 2 + [(9, 9)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    df = graph_queries.QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") <= 2 and "Join" not in plan and "Scan ExistingRDD" not in plan
    lineitem = duckdb.sql(f"select * from '{tmp_path}/lineitem.parquet/*.parquet'")  # noqa: F841
    want = duckdb.sql(graph_queries.SQL[name]).fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want)) and want

from __future__ import annotations

import datetime as dt
import random

from lodestack.operators.snapshot_diff import ENTRY_FIELDS, snapshot_changes

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "repo_id long, snapshot_no int, path string, language string, size_bytes long, line_count long, estimated_tokens long, text_status string, status string, content string, masked_content string, reason string, delivered_at timestamp"


def row(repo, no, path, at=0, **fields):
    own = {f: None for f in ENTRY_FIELDS} | fields
    return (repo, no, path, *[own[f] for f in ENTRY_FIELDS], T0 + dt.timedelta(minutes=at))


def brute(rows):
    latest = {}
    clean = lambda p: "/".join(x for x in p.replace("\\", "/").split("/") if x not in ("", "."))
    for r in rows:
        key = r[0], r[1], clean(r[2])
        if key not in latest or r[-1] >= latest[key][-1]:
            latest[key] = r
    out = set()
    for repo in {r[0] for r in rows}:
        numbers = sorted({r[1] for r in rows if r[0] == repo})
        for before, after in zip(numbers, numbers[1:], strict=False):
            a = {k[2]: v for k, v in latest.items() if k[:2] == (repo, before)}
            b = {k[2]: v for k, v in latest.items() if k[:2] == (repo, after)}
            out |= {(repo, after, p, "added", "") for p in b.keys() - a.keys()} | {(repo, after, p, "removed", "") for p in a.keys() - b.keys()}
            out |= {(repo, after, p, "changed", f) for p in a.keys() & b.keys() for i, f in enumerate(ENTRY_FIELDS) if a[p][3 + i] != b[p][3 + i]}
    return out


def test_small_cases(spark):
    rows = [
        row(1, 1, "a.py", content="x"), row(1, 1, "b.py", content=""), row(1, 3, "./a.py", content="y", size_bytes=1),
        row(1, 3, "src//c.py"), row(1, 3, "b.py", content=None), row(2, 1, "a.py"), row(1, 3, "a.py", at=5, content="z"),
        row(1, 3, "a.py", at=5, content="z"), row(1, 5, ".\\A.py"),
    ]
    got = {tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
    assert (1, 3, "b.py", "changed", "content") in got and (1, 3, "src/c.py", "added", "") in got


def test_random_against_brute_force(spark):
    rng = random.Random(5)
    rows = [row(rng.randint(1, 3), rng.choice([1, 2, 4]), rng.choice(["a", "./a", "b/c", "b\\c", "d"]), at=k, content=rng.choice([None, "", "x"]), status=rng.choice([None, "s"])) for k in range(150)]
    got = [tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_empty_null_keys_and_extra_columns(spark):
    assert snapshot_changes(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [row(None, 1, "a"), row(1, None, "a"), row(1, 1, None), row(1, 1, "a"), row(1, 2, "a")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as g", "2 as k", "3 as sign", "4 as next", "5 as v")
    assert snapshot_changes(df).count() == 0

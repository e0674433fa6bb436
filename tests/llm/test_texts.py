"""Token counts, splitting, packing and leaks against brute force."""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import contamination, packing, split, tokens, unigram

PIECES = [("a", -1.0), ("b", -1.5), ("ab", -1.8), ("abc", -2.0), ("bc", -2.2), ("cc", -1.0), ("c", -3.0), ("aab", -2.4)]


def best_by_brute_force(text, pieces, unknown):
    scores = dict(pieces)
    best = {0: [(0.0, 0)]}
    for end in range(1, len(text) + 1):
        options = [(s + scores[text[start:end]], n + 1) for start in range(end) if text[start:end] in scores for s, n in best[start]]
        if text[end - 1] not in scores:
            options += [(s + unknown, n + 1) for s, n in best[end - 1]]
        best[end] = options
    return max((round(s, 9), -n) for s, n in best[len(text)])


@given(st.text("abcx", max_size=9))
@settings(max_examples=200, deadline=None)
def test_viterbi_counts(text):
    counter = unigram.UnigramCounter(PIECES)
    assert counter.count(text) == -best_by_brute_force(text, PIECES, counter.unknown)[1]


def test_viterbi_agrees_with_a_library():
    from tokenizers import Tokenizer, models

    vocabulary = [("<unk>", -20.0), *PIECES]
    library = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    counter, rng = unigram.UnigramCounter(PIECES), random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("abc") for _ in range(rng.randint(1, 30)))
        assert counter.count(text) == len(library.encode(text).ids)


def test_trie_holds_exactly_its_keys():
    rng = random.Random(4)
    keys = {"".join(rng.choice("abcdé字") for _ in range(rng.randint(1, 5))): -float(k) for k in range(300)}
    trie = unigram.DoubleArrayTrie(keys.items())
    for text in itertools.islice(itertools.product("abcdé字z", repeat=4), 0, None, 7):
        text = "".join(text)
        codes = [trie.code.get(c, 0) for c in text]
        assert {text[:end]: s for end, s in trie.matches(codes, 0)} == {text[:e]: keys[text[:e]] for e in range(1, 5) if text[:e] in keys}


def test_estimate_is_a_quarter_rounded_up(spark):
    texts = ["", "a", "abcd", "abcde", "é😀字x\n", "x" * 100_001, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens.estimated_tokens(F.col("t")).alias("n"))
    assert [r.n for r in df.collect()] == [None if t is None else -(-len(t) // 4) for t in texts]
    counter = unigram.estimate_counter()
    assert [counter.count(t) for t in texts[:5]] == [-(-len(t) // 4) for t in texts[:5]]


@pytest.mark.parametrize("pieces", [unigram.ESTIMATE_PIECES, [("xx", -1.3), ("xxxxx", -2.9)], [("x", -1.0), ("xxx", -2.0), ("xxxx", -3.0)], [("y", -1.0)], [("x" * n, -(n**0.37)) for n in (1, 3, 7, 11)], [("x" * 9, -1.0)]])
def test_runs_of_any_length(pieces):
    counter = unigram.UnigramCounter(pieces)
    runs = unigram.RunCounter(counter, "x")
    counts = counter.best_counts("x" * 9000)
    assert runs.count(np.array([0, 1, 2, 5, 8999, 8999, 137, 4099])).tolist() == [counts[n] for n in (0, 1, 2, 5, 8999, 8999, 137, 4099)]
    assert len(runs.first) <= runs.REMEMBERED + 1 and runs.count(np.zeros(0, np.int64)).size == 0


@given(st.lists(st.text("abcxé😀", max_size=40), max_size=60))
@settings(max_examples=60, deadline=None)
def test_texts_in_step(texts):
    counter = unigram.UnigramCounter(PIECES)
    batch = unigram.BatchCounter(counter)
    want = [counter.count(t) for t in texts]
    assert batch.longest == 3 and batch.count([*texts, None]) == [*want, None]
    batch.NARROW, batch.SLICE, batch.STRETCH = 2, 50, 7
    assert batch.count(texts) == want


def test_the_estimate_passes_over_every_text():
    seen = []
    counter = unigram.estimate_counter()
    counter.normalize = lambda text: seen.append(text) or "x" * len(text)
    batch = unigram.BatchCounter(counter)
    texts = ["é" * n for n in (0, 1, 4, 5, 30_001)] * 30
    assert batch.count(texts) == [-(-len(t) // 4) for t in texts] and sorted(seen) == sorted(t for t in texts if t)


def test_a_run_of_a_billion():
    runs = unigram.RunCounter(unigram.estimate_counter(), unigram.ESTIMATE_SYMBOL)
    assert runs.period and runs.count(np.array([10**9 + 1, 10**9])).tolist() == [250_000_001, 250_000_000]


def test_public_pieces(spark):
    texts = ["hello world", "", None, "the theory of everything"]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tokens.piece_tokens(F.col("t")).alias("n")).collect()]
    assert got[1:3] == [0, None]
    scores = dict(tokens.piece_scores(tokens.DEFAULT_PIECES))
    for text, n in zip(texts, got, strict=True):
        if text:
            assert n == sum(-best_by_brute_force("▁" + w, list(scores.items()), min(scores.values()) - 10)[1] for w in text.split())


def test_budgets(spark):
    entries = spark.createDataFrame([(1, 1, "py", "a.py", "x" * 5), (1, 1, "py", "a.py", "x" * 5), (2, 1, None, "b.PY", ""), (3, 2, "?", "c", "abc"), (4, 2, "py", "d.py", None)], "entry_id long, export_id long, language string, path string, content string")
    languages = spark.createDataFrame([("py", "python")], "alias string, language string")
    budget = tokens.token_budget(entries, languages)
    assert {tuple(r) for r in budget.collect()} == {(1, "python", 2), (2, None, 1)}
    exports = spark.createDataFrame([(1, "s", None), (2, "s", "d")], "export_id long, source string, domain_label string")
    assert {tuple(r) for r in tokens.budget_by_slice(budget, exports).collect()} == {("s", None, "python", 1, 2), ("s", "d", None, 1, 1)}
    pieces = tokens.unigram_tokens(F.col("content"), [("▁", -1.0), ("x", -1.0), ("xx", -1.5)])
    assert [r.n for r in entries.where("entry_id = 1").select(pieces.alias("n")).collect()] == [4, 4]


def test_bpe_counts(spark):
    texts = ["Hello world, it's 2026!", "", "  naïve  \n\n", None]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "t string").select(tokens.bpe_tokens(F.col("t")).alias("n")).collect()]
    assert got == [None if t is None else len(tokens.encoding(tokens.DEFAULT_RANKS).encode_ordinary(t)) for t in texts]
    from tokenizers import Tokenizer

    other = Tokenizer.from_file(f"{tokens.TOKENIZER_DIR}/byte_bpe_50k.json")
    assert got[:3] == [len(other.encode(t, add_special_tokens=False).ids) for t in texts[:3]]


PART = st.sampled_from(["a", "bc ", "\n", "\n\n", "# h\n", "é", "😀", "def x():\n", "word word ", "x" * 30, "\r\n", "}\n"])


@given(st.lists(PART, max_size=120).map("".join), st.sampled_from([None, 1, 5, 20, 80]), st.sampled_from([None, 1, 4, 9, 40, 200]), st.sampled_from([None, 0, 3, 10, 19, 500]))
@settings(max_examples=300, deadline=None)
def test_pieces(text, max_chars, max_bytes, overlap):
    cuts = split.split_text(text, max_chars, max_bytes, overlap)
    assert "".join(text[s:e] for s, e, _ in cuts) == text
    widest = max((len(c.encode()) for c in text), default=1)
    fits = lambda t: (max_chars is None or len(t) <= max_chars) and (max_bytes is None or len(t.encode()) <= max(widest, max_bytes))
    if fits(text):
        assert cuts == [(0, len(text), 0)]
    for i, (s, e, r) in enumerate(cuts):
        assert fits(text[s - r : e]) and (e > s or not text)
        assert r == 0 if not i else r <= (overlap or 0)
        if i and max_bytes is None:  # the whole overlap, if a piece has room for it, or all of a shorter piece
            assert r == min(overlap or 0, max_chars - 1, s - (cuts[i - 1][0] - cuts[i - 1][2]))
    # a cut that stays is one that couldn't be undone
    for (a, _, r), (_, e, _) in itertools.pairwise(cuts):
        assert not fits(text[a - r : e])


def test_overlap_and_boundaries():
    text = "".join(f"# part {k}\n" + "line of text\n" * 20 for k in range(8))
    cuts = split.split_text(text, 600, None, 40)
    assert all(r == 40 for _, _, r in cuts[1:]) and all(text[s:].startswith("# part") for s, _, _ in cuts)


def test_an_overlap_near_the_limit_is_kept():
    cuts = split.split_text("word " * 100, 100, None, 90)
    assert [r for _, _, r in cuts[1:]] == [90] * (len(cuts) - 1) and all(e - s + r <= 100 for s, e, r in cuts)
    assert all(r == 99 for _, _, r in split.split_text("x" * 300, 100, None, 500)[1:]) and len(split.split_text("é" * 3, None, 1, 1)) == 3


def best_bins(sizes, room):
    """The least number of bins, by search."""
    best = [len(sizes)]

    def go(k, bins):
        if len(bins) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(bins)
            return
        seen = set()
        for i, b in enumerate(bins):
            if b + sizes[k] <= room and b not in seen:
                seen.add(b)
                bins[i] += sizes[k]
                go(k + 1, bins)
                bins[i] -= sizes[k]
        bins.append(sizes[k])
        go(k + 1, bins)
        bins.pop()

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_configurations(seed):
    rng = random.Random(seed)
    capacity, separator = rng.choice([10, 17, 30]), rng.choice([0, 1, 2])
    lengths = [rng.randint(0, capacity) for _ in range(10)]
    values, counts = np.unique(lengths, return_counts=True)
    found = packing.configurations(values, counts, capacity, separator)
    packed = [x for times, c in found for x, n in c.items() for _ in range(times * n)]
    assert sorted(packed) == sorted(lengths)
    assert all(sum(x * n for x, n in c.items()) + (sum(c.values()) - 1) * separator <= capacity for _, c in found)
    least = best_bins(sorted((max(x + separator, 1) for x in lengths), reverse=True), capacity + separator)
    assert least <= sum(t for t, _ in found) <= least + 1


@pytest.mark.parametrize("seed", range(6))
def test_the_covering_program_is_nearly_solved(seed):
    rng = np.random.default_rng(seed)
    sizes = np.sort(rng.choice(np.arange(10, 300), 25, replace=False))
    demand = rng.integers(1, 400, 25)
    found, amount, bound = packing.fractional(sizes, demand, 400)
    cover = sum(a * x for a, x in zip(found, amount, strict=True))
    assert (cover >= demand * (1 - 1e-9)).all() and all(a @ sizes <= 400 and (a <= demand).all() for a in found)
    assert bound <= amount.sum() + 1e-9 and amount.sum() <= (1 + packing.CLOSE) * bound and bound >= (sizes @ demand) / 400 * 0.99
    whole = packing.rounded(amount)
    assert abs(whole.sum() - amount.sum()) < 1 and (whole >= 0).all() and (np.abs(whole - amount) < 1 + 1e-6).all()


def test_groups_are_neighbours():
    sizes, demand = np.arange(1, 1001), np.full(1000, 3)
    group = packing.grouped(sizes, demand)
    assert (np.diff(group) <= 0).all() or (np.diff(group) >= 0).all()
    assert len(np.unique(group)) <= packing.GROUPS and group.min() == 0 and (packing.grouped(sizes[:5], demand[:5]) == np.arange(5)).all()


@pytest.mark.parametrize("shape", ["even", "long", "short", "one", "halves"])
def test_lengths_of_any_kind(shape):
    rng = np.random.default_rng(8)
    values = {"even": rng.integers(0, 513, 30_000), "long": rng.integers(300, 513, 20_000), "short": rng.integers(1, 20, 40_000), "one": np.full(5000, 171), "halves": rng.choice([256, 255, 257], 9000)}[shape]
    lengths, counts = np.unique(values, return_counts=True)
    found = packing.configurations(lengths, counts, 512, 1)
    plain = packing.best_fit(lengths.astype(np.int64), lengths + 1, counts.astype(np.int64), 513)
    assert sum(t for t, _ in found) <= 1.004 * sum(t for t, _ in plain) + 1


def test_many_items_leave_little_space():
    rng = np.random.default_rng(1)
    lengths, counts = np.unique(np.minimum(rng.lognormal(4.5, 1, 50_000).astype(int), 512), return_counts=True)
    found = packing.configurations(lengths, counts, 512, 1)
    used = sum(t * (sum(x * n for x, n in c.items()) + sum(c.values()) - 1) for t, c in found)
    assert sum(x * n * t for t, c in found for x, n in c.items()) == lengths @ counts
    assert 1 - used / (512 * sum(t for t, _ in found)) < 0.01


def test_pack(spark):
    rng = random.Random(2)
    rows = [(k, "word " * rng.randint(0, 60)) for k in range(300)] + [(1000 + k, "same text here") for k in range(200)]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    containers = spark.createDataFrame([("a", 32, 1), ("b", 100, 2)], "container_kind string, capacity_tokens int, separator_tokens int")
    packed = packing.pack(documents, containers).toPandas()
    for kind, capacity, separator in (("a", 32, 1), ("b", 100, 2)):
        own = packed[packed.container_kind == kind]
        assert set(own.doc_id) == {r[0] for r in rows} and not own.duplicated(["doc_id", "piece_no"]).any()
        sums = own.groupby("container_no").n_tokens.agg(["sum", "count"])
        assert (sums["sum"] + (sums["count"] - 1) * separator <= capacity).all()
        whole = own[own.n_pieces == 1]
        assert (whole.n_tokens <= capacity).all() and (own[own.n_pieces > 1].groupby("doc_id").n_tokens.sum() > capacity).all()
        assert sorted(set(own.container_no)) == list(range(own.container_no.max() + 1))


def leaked_by_brute_force(documents, items, window):
    clean = lambda t: re.findall(r"[^\W_]+", t.casefold())
    grams = lambda w: {tuple(w[i : i + window]) for i in range(len(w) - window + 1)}
    return {(d, i) for d, t in documents if t for i, p in items if p and grams(clean(t)) & grams(clean(p))}


@pytest.mark.parametrize(("seed", "hot_rows"), [(0, 100_000), (1, 100_000), (2, 3)])
def test_leaks(spark, seed, hot_rows):
    rng = random.Random(seed)
    words = ["a", "b", "c", "Dd", "éé", "x1"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ", ", "_", "\n-", " -- "]) for _ in range(n))
    items = [(i, text(rng.randint(3, 14))) for i in range(8)]
    documents = [(d, text(rng.randint(0, 60)) + (items[d % 8][1].upper() if d % 3 == 0 else "")) for d in range(60)]
    got = contamination.leaked(spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"), window=5, hot_rows=hot_rows)
    assert {tuple(r) for r in got.collect()} == leaked_by_brute_force(documents, items, 5)


def test_bitmap_holds_its_hashes(spark):
    rng = np.random.default_rng(5)
    values = rng.integers(-(1 << 62), 1 << 62, 3000)
    slots = contamination._slots(spark.createDataFrame([(int(v),) for v in values], "hash long"), 1 << 17)
    bitmap = contamination.Bitmap(1 << 17, slots)
    assert len(bitmap.may_hold(values)) == len(values) and all(int(v) in bitmap for v in values[:50])
    assert len(bitmap.may_hold(rng.integers(-(1 << 62), 1 << 62, 10_000))) < 400
    assert contamination.bit_count(0) == contamination.LEAST_BITS and contamination.bit_count(1 << 40) == contamination.MOST_BITS


def test_many_items_and_a_hot_passage(spark):
    shared = "one two three four five six seven eight nine ten eleven twelve"
    items = [(k, f"{shared} item{k}") for k in range(50)] + [(99, shared), (None, shared), (100, None)]
    documents = [(d, f"start {d} {shared.upper()} end") for d in range(300)] + [(1000, "one two three"), (1001, None), (None, shared)]
    got = contamination.leaked(spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"), hot_rows=10)
    assert {tuple(r) for r in got.collect()} == {(d, i) for d in range(300) for i in [*range(50), 99]}

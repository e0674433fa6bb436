from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from lodestack.llm import subjects

TERMS = {
    "farming": "wheat barley plough harvest cattle meadow tractor orchard seedling manure".split(),
    "music": "violin chord melody tempo sonata drummer quartet refrain soprano cadenza".split(),
    "law": "court statute verdict plaintiff lease tribunal clause affidavit warrant notary".split(),
}
FRAMES = ["The {} and the {} belong to one {} here", "Nobody should enter a {} before the {} has seen the {}", "Every {} carries a {} so that the {} can be read", "We compare one {} with another {} and list the {}"]
PLAIN = ["Install the package and run the checks once", "Pull requests need one approval and a green run", "Nothing else changed in this version of it"]


def document(rng, areas, n=12):
    out = []
    for k in range(n):
        area = areas[k % len(areas)] if areas else None
        out.append(rng.choice(FRAMES).format(*rng.sample(TERMS[area], 3)) if area else rng.choice(PLAIN))
    return "# Title\n\n" + ". ".join(out) + ".\n\n```\nviolin court wheat\n```\n"


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    kinds = [[a] for a in TERMS] + [["farming", "law"], ["music", "law"], [], [None, None, None, None, None, "music"]]
    truth = {d: [a for a in kinds[d % len(kinds)] if a] if d % len(kinds) != 6 else [] for d in range(420)}
    rows = [(d, document(rng, kinds[d % len(kinds)])) for d in truth]
    labels = [(d, s.upper() if d % 10 == 0 else s) for d in truth if d < 120 for s in truth[d] or ["none"]]
    labels += [(3, "music"), (5, "law")]  # wrong ones
    got = subjects.assign_subjects(
        spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, subject string"), spark.createDataFrame([(s, "About " + " ".join(t[:3])) for s, t in TERMS.items()], "subject string, description string")
    )
    found = {(r.doc_id, r.subject) for r in got.collect() if r.doc_id >= 120}
    want = {(d, s) for d, own in truth.items() if d >= 120 for s in own}
    assert len(found & want) / len(found | want) > 0.97


def test_decomposition_spans_the_leading_directions(spark):
    rng = random.Random(2)
    rows = [(d, document(rng, [list(TERMS)[d % 3]])) for d in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    encoded = df.mapInArrow(subjects._encode, "doc_id long, ids binary, language int")
    weights = subjects.Weights(dict(encoded.mapInArrow(subjects._count, "place int, n long").groupBy("place").sum("n").collect()))
    texts = [np.frombuffer(r.ids, np.uint16) for r in encoded.orderBy("doc_id").collect()]
    doc, row, weight = weights.documents(texts)
    matrix = np.zeros((len(texts), len(weights.places)))
    matrix[doc, row] = weight
    start = np.random.default_rng(0).standard_normal((len(weights.places), 12))
    basis = subjects.decompose(encoded, weights, start)
    leading = np.linalg.svd(matrix, full_matrices=False)[2][:3]
    assert np.linalg.norm(leading @ basis, axis=1).min() > 0.98
    counts = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=subjects.PLACES)
    assert weights.n == 150 and np.array_equal(weights.places, np.flatnonzero((counts >= 2) & (counts < 150) & (np.arange(subjects.PLACES) > 0)))


def test_slices_stay_in_the_cache_and_change_nothing(monkeypatch):
    assert subjects.SLICE_TOKENS * subjects.DIMENSIONS * 4 <= 4 << 20
    rng = random.Random(3)
    texts = [subjects.encode(document(rng, [list(TERMS)[d % 3]])) for d in range(40)]
    counts = np.bincount(np.concatenate([np.unique(t) for t in texts]), minlength=subjects.PLACES)
    counts[0] = len(texts)
    weights = subjects.Weights(dict(enumerate(counts.tolist())))
    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((len(weights.places), 8)))[0].astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array([t.tobytes() for t in texts], pa.binary()), pa.array([0] * 40, pa.int32())], names=["doc_id", "ids", "language"])
    sums = []
    for size in (1, 300, 10**6):
        monkeypatch.setattr(subjects, "SLICE_TOKENS", size)
        out = next(subjects._step(weights, basis)(iter([batch])))
        sums.append(np.stack([np.frombuffer(v, np.float32) for v in out.column("vector").to_pylist()]))
    assert np.allclose(sums[0], sums[1], atol=1e-4) and np.allclose(sums[0], sums[2], atol=1e-4)

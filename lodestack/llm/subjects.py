"""Subject areas of documents (problem 10).

Documents are embedded by term weighting (tf-idf) and a truncated singular value decomposition, found by subspace iteration
over the whole corpus. Seed centroids of every subject and language come from labelled documents and are refined on their
sentences; then every sentence of every document goes to the subject whose centroid is nearest by cosine, if it is near
enough, and a document has the subjects that at least a quarter of its sentences deal with.

Terms are hashed into a fixed number of places, so that whatever is sent around is bounded whatever the corpus holds. The
statistics (document frequencies, the decomposition) cover all documents; only seeds and their refinement use a bounded
sample of the labelled rows, of at most ``MAX_LABELLED`` documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.common import cut

PLACES = 1 << 16
DIMENSIONS, STEPS = 64, 2
MAX_LABELLED = 8000
SHARE, NEAR = 0.25, 0.2
#: Refinement: rounds, least cosine and lead over the second subject of a sentence that counts, weight of the seed.
ROUNDS, SURE, LEAD, SEED_WEIGHT = 2, 0.6, 0.2, 0.5
NO_SUBJECT = "none"
LEAST_WORDS = 3
#: The vectors of a slice (4 MB) stay in the cache.
SLICE_TOKENS = 16_000

#: Frequent short words that tell the language of a text.
FUNCTION_WORDS = {
    "en": "the and that with which from for was are each".split(),
    "de": "der die das und werden wird nicht mit ist für von den eine ein auf".split(),
    "es": "los las del que una para por con más".split(),
}
LANGUAGES = tuple(FUNCTION_WORDS)

_OUT = re.compile(r"^```[^\n]*\n[\s\S]*?^```[^\n]*$|^(?:#{1,6} |--- |\+\+\+ |@@)[^\n]*$", re.MULTILINE)
#: A word of at least three letters, or a boundary of sentences: full stop or exclamation mark before white space, or a line end.
#: A question goes on with the sentence after it.
_TOKEN = re.compile(r"[^\W\d_]{3,}|[.!](?=\s|\Z)|\n")


class _Places(dict):
    """Places of tokens, remembered up to a bound; 0 is a boundary."""

    def __missing__(self, token: str) -> int:
        place = 0 if not token[0].isalpha() else 1 + zlib.crc32(token.encode("utf-8", "surrogatepass")) % (PLACES - 1)
        if len(self) < 500_000:
            self[token] = place
        return place


_PLACES = _Places()
_LANGUAGE_AT = np.zeros(PLACES, dtype=np.uint8)  # 1 + language of the places of function words
for _k, _words in enumerate(FUNCTION_WORDS.values()):
    _LANGUAGE_AT[[_PLACES[w] for w in _words]] = _k + 1


def encode(text: str) -> np.ndarray:
    """The places of the words of ``text``, with 0 between sentences."""
    body = _OUT.sub("", text.replace("\r", "")) if "```" in text or "#" in text or "--- " in text or "@@" in text else text.replace("\r", "")
    return np.fromiter(map(_PLACES.__getitem__, _TOKEN.findall(body.lower())), np.uint16)


def language_of(ids: np.ndarray) -> int:
    return int(np.bincount(_LANGUAGE_AT[ids], minlength=len(LANGUAGES) + 1)[1:].argmax())


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        encoded = [encode(text) for text in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([e.tobytes() for e in encoded], pa.binary()), pa.array([language_of(e) for e in encoded], pa.int32())], names=["doc_id", "ids", "language"])


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[list[int], list[np.ndarray], np.ndarray]]:
    """``(ids of documents, their places, their languages)`` in parts of about ``SLICE_TOKENS`` tokens."""
    docs, texts, size = batch.column("doc_id").to_pylist(), [np.frombuffer(b, np.uint16) for b in batch.column("ids").to_pylist()], 0
    languages, start = np.array(batch.column("language").to_pylist(), dtype=np.int64), 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= SLICE_TOKENS or k == len(texts) - 1:
            yield docs[start : k + 1], texts[start : k + 1], languages[start : k + 1]
            start, size = k + 1, 0


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(PLACES, dtype=np.int64)
    for batch in batches:
        for docs, texts, _ in _slices(batch):
            number = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in texts])
            pairs = np.unique(number << 16 | np.concatenate(texts)) if len(number) else np.zeros(0, np.int64)
            total += np.bincount(pairs & 0xFFFF, minlength=PLACES)
            total[0] += len(docs) - np.count_nonzero((pairs & 0xFFFF) == 0)  # place 0 counts the documents
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(total[there], pa.int64())], names=["place", "n"])


class Weights:
    """Inverse document frequencies; terms of one document or of all of them weigh nothing."""

    def __init__(self, counts: dict[int, int]):
        self.n = counts.get(0, 0)
        frequency = np.zeros(PLACES)
        frequency[list(counts)] = list(counts.values())
        frequency[0] = 0
        self.idf = np.where(frequency >= 2, np.log(max(self.n, 1) / np.maximum(frequency, 1)), 0).astype(np.float32)
        self.places = np.flatnonzero(self.idf > 0)
        self.row = np.full(PLACES, -1, dtype=np.int32)
        self.row[self.places] = np.arange(len(self.places))

    def documents(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(document, row, weight)`` of every term of every document, by document; each document has length one."""
        number = np.repeat(np.arange(len(texts), dtype=np.int64), [len(t) for t in texts])
        pairs, n = np.unique(number << 16 | np.concatenate(texts).astype(np.int64), return_counts=True) if len(number) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        row = self.row[pairs & 0xFFFF]
        keep = row >= 0
        doc, row, n = (pairs >> 16)[keep], row[keep], n[keep]
        weight = (1 + np.log(n)) * self.idf[self.places[row]]
        length = np.sqrt(np.bincount(doc, weight * weight, minlength=len(texts)))
        return doc, row, (weight / np.maximum(length[doc], 1e-9)).astype(np.float32)


def _segments(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def _step(weights: Weights, basis: np.ndarray):
    """One product of the terms' Gram matrix with ``basis`` over a partition, as sums by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(basis)
        for batch in batches:
            for _, texts, _ in _slices(batch):
                doc, row, weight = weights.documents(texts)
                if not len(doc):
                    continue
                starts = _segments(doc)
                embedded = np.add.reduceat(weight[:, None] * basis[row], starts, axis=0)
                order = np.argsort(row, kind="stable")
                place = np.cumsum(np.concatenate([[0], doc[1:] != doc[:-1]]))
                begins = _segments(row[order])
                total[row[order][begins]] += np.add.reduceat(weight[order][:, None] * embedded[place[order]], begins, axis=0)
        there = np.flatnonzero(total.any(axis=1))
        part = pa.array(np.full(len(there), zlib.crc32(total[there[:1]].tobytes()) % 16), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(there % 8, pa.int32()), part, pa.array(there, pa.int32()), pa.array([v.tobytes() for v in total[there]], pa.binary())], names=["bucket", "part", "row", "vector"])

    return run


def _sum_vectors(group: pd.DataFrame) -> pd.DataFrame:
    vectors = np.frombuffer(b"".join(group["vector"]), np.float32).reshape(len(group), -1)
    rows, inverse = np.unique(group["row"].to_numpy(), return_inverse=True)
    order = np.argsort(inverse, kind="stable")
    sums = np.add.reduceat(vectors[order], _segments(inverse[order]), axis=0)
    return pd.DataFrame({"bucket": group["bucket"].iloc[0], "part": group["part"].iloc[0], "row": rows, "vector": [v.tobytes() for v in sums]})


def decompose(encoded: DataFrame, weights: Weights, start: np.ndarray) -> np.ndarray:
    """A basis of the leading right singular vectors of the document-term matrix: ``STEPS`` subspace iterations.

    Partial sums are added in two levels, of which each group has a bounded number of partitions' vectors.
    """
    basis, _ = np.linalg.qr(start)
    spark = encoded.sparkSession
    schema = "bucket int, part int, row int, vector binary"
    for _ in range(STEPS):
        shared = spark.sparkContext.broadcast((weights, basis.astype(np.float32)))
        partial = encoded.mapInArrow(lambda batches, shared=shared: _step(*shared.value)(batches), schema)
        first = partial.groupBy("bucket", "part").applyInPandas(_sum_vectors, schema)
        product = np.zeros_like(basis)
        for row, vector in first.groupBy("bucket").applyInPandas(_sum_vectors, schema).select("row", "vector").collect():  # one row a term
            product[row] = np.frombuffer(vector, np.float32)
        basis, _ = np.linalg.qr(product)
        shared.unpersist()
    return basis.astype(np.float32)


def sentences(weights: Weights, texts: list[np.ndarray], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(document of each sentence, its embedding of length one)``; sentences without weighty terms have an embedding of 0."""
    flat = np.concatenate([np.concatenate([t, np.zeros(1, np.uint16)]) for t in texts]) if texts else np.zeros(0, np.uint16)
    number = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    sentence = np.cumsum(flat == 0)
    word = flat > 0
    sentence, number, flat = sentence[word], number[word], flat[word]
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros((0, vectors.shape[1]), np.float32)
    starts = _segments(sentence)
    length = np.diff(np.concatenate([starts, [len(flat)]]))
    row = weights.row[flat]
    weight = np.where(row >= 0, weights.idf[flat], 0).astype(np.float32)
    embedded = np.add.reduceat(weight[:, None] * vectors[np.maximum(row, 0)], starts, axis=0)
    long = length >= LEAST_WORDS
    embedded = embedded[long]
    return number[starts][long], embedded / np.maximum(np.linalg.norm(embedded, axis=1, keepdims=True), 1e-9)


class Model:
    """Weights, term vectors and the centroids by language and subject."""

    def __init__(self, weights: Weights, vectors: np.ndarray, centroids: np.ndarray, subjects: list[str]):
        self.weights, self.vectors, self.centroids, self.subjects = weights, vectors, centroids, subjects

    def cosines(self, texts: list[np.ndarray], languages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        doc, unit = sentences(self.weights, texts, self.vectors)
        out = np.zeros((len(doc), len(self.subjects)), np.float32)
        for language in range(len(LANGUAGES)):
            own = languages[doc] == language
            out[own] = unit[own] @ self.centroids[language].T
        return doc, out

    def shares(self, texts: list[np.ndarray], languages: np.ndarray) -> np.ndarray:
        """The share of each document's sentences that deal with each subject."""
        doc, cosine = self.cosines(texts, languages)
        if not len(doc):
            return np.zeros((len(texts), len(self.subjects)))
        best = cosine.argmax(axis=1)
        near = cosine.max(axis=1) > NEAR
        size = len(self.subjects)
        deals = np.bincount(doc[near] * size + best[near], minlength=len(texts) * size).reshape(len(texts), size)
        return deals / np.maximum(np.bincount(doc, minlength=len(texts)), 1)[:, None]


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=-1, keepdims=True), 1e-9)


def fit(encoded: DataFrame, labels: DataFrame, subjects: DataFrame) -> Model | None:
    """The model, or None if there is no document or no subject."""
    names = sorted({s.strip().lower() for s, _ in subjects.where("subject is not null").select("subject", "description").collect()} - {NO_SUBJECT})
    counts = dict(encoded.mapInArrow(_count, "place int, n long").groupBy("place").agg(F.sum("n")).collect())  # one row a place
    weights = Weights(counts)
    if not names or not len(weights.places):
        return None
    names.append(NO_SUBJECT)
    number = {s: k for k, s in enumerate(names)}
    clean = labels.where("doc_id is not null").select("doc_id", F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isin(names)).groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("subjects"))
    sample = clean.join(encoded.dropDuplicates(["doc_id"]), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED).collect()
    described = [(encode(d), [s.strip().lower()]) for s, d in subjects.where("subject is not null and description is not null").select("subject", "description").collect()]

    texts = [np.frombuffer(r.ids, np.uint16) for r in sample] + [e for e, _ in described]
    tags = [list(r.subjects) for r in sample] + [s for _, s in described]
    languages = np.array([r.language for r in sample] + [0] * len(described), dtype=np.int64)
    doc, row, weight = weights.documents(texts)
    # one column for each language and subject, by the number of its documents; the rest is random
    columns: dict[tuple[int, int], np.ndarray] = {}
    for k, own in enumerate(tags):
        for s in own:
            if s in number:
                columns.setdefault((languages[k], number[s]), np.zeros(len(texts), np.float32))[k] = 1 / len(own)
    width = min(DIMENSIONS, len(weights.places))
    start = np.random.default_rng(7).standard_normal((len(weights.places), width))
    start /= np.linalg.norm(start, axis=0)
    for k, (_, members) in enumerate(sorted(columns.items(), key=lambda c: (-np.count_nonzero(c[1]), c[0]))[: width * 2 // 3]):
        column = np.bincount(row, weight * members[doc], minlength=len(weights.places))
        if (norm := np.linalg.norm(column)) > 0:
            start[:, k] = column / norm
    vectors = decompose(encoded, weights, start)

    embedded = np.zeros((len(texts), vectors.shape[1]), np.float32)
    for part in np.array_split(np.arange(len(doc)), len(doc) // SLICE_TOKENS + 1):
        np.add.at(embedded, doc[part], weight[part, None] * vectors[row[part]])
    embedded = _unit(embedded)
    seeds = np.zeros((len(LANGUAGES), len(names), vectors.shape[1]), np.float32)
    for (language, subject), members in columns.items():
        seeds[language, subject] = _unit(members @ embedded)
    model = Model(weights, vectors, seeds.copy(), names)
    ends = np.cumsum([len(t) for t in texts]) // SLICE_TOKENS
    parts = [np.flatnonzero(ends == k) for k in np.unique(ends)]
    found = [(own[doc], unit) for own in parts for doc, unit in [sentences(weights, [texts[k] for k in own], vectors)]]
    sentence_doc, unit = np.concatenate([d for d, _ in found]), np.concatenate([u for _, u in found])
    spoken = languages[sentence_doc]
    for _ in range(ROUNDS):
        cosine = np.einsum("ik,ijk->ij", unit, model.centroids[spoken]) if len(unit) else np.zeros((0, len(names)))
        order = np.sort(cosine, axis=1)
        best, sure = cosine.argmax(axis=1), (order[:, -1] > SURE) & (order[:, -1] - order[:, -2] > LEAD)
        for language in range(len(LANGUAGES)):
            for subject in range(len(names)):
                own = sure & (best == subject) & (spoken == language)
                if own.any():
                    model.centroids[language, subject] = _unit(SEED_WEIGHT * seeds[language, subject] + (1 - SEED_WEIGHT) * _unit(unit[own].sum(axis=0)))
    return model


ASSIGNED = "doc_id long, subject string, share double"


def assign_subjects(documents: DataFrame, labels: DataFrame, subjects: DataFrame) -> DataFrame:
    """``doc_id, subject, share`` of the subjects that at least a quarter of a document's sentences deal with.

    Null, empty and wordless texts have no subject; repeated rows of a document give its rows once; labels may be wrong,
    repeated, missing or in capitals; without labels the descriptions of the subjects are the seeds. Headings, code and
    diff heads are no sentences, nor are parts of under three words.
    """
    encoded = cut(documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(_encode, "doc_id long, ids binary, language int"))
    model = fit(encoded, labels, subjects)
    spark = documents.sparkSession
    if model is None:
        return spark.createDataFrame([], ASSIGNED)
    shared = spark.sparkContext.broadcast(model)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for batch in batches:
            for docs, texts, languages in _slices(batch):
                shares = held.shares(texts, languages)[:, :-1]
                doc, subject = np.nonzero(shares >= SHARE)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([docs[d] for d in doc], pa.int64()), pa.array([held.subjects[s] for s in subject], pa.string()), pa.array(shares[doc, subject], pa.float64())], names=["doc_id", "subject", "share"]
                )

    return encoded.mapInArrow(assign, ASSIGNED).dropDuplicates(["doc_id", "subject"])


def composition(assigned: DataFrame, documents: DataFrame) -> DataFrame:
    """``source, subject, n_documents``; documents without a subject count under 'none'."""
    sources = documents.select("doc_id", "source").dropDuplicates(["doc_id"])
    joined = sources.join(assigned.select("doc_id", "subject"), "doc_id", "left")
    return joined.groupBy("source", F.coalesce("subject", F.lit(NO_SUBJECT)).alias("subject")).agg(F.count_distinct("doc_id").alias("n_documents"))

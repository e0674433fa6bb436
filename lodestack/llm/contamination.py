"""Evaluation passages inside a training corpus (problem 9).

A prefix-filtered set join. The sets to be contained are the windows of ``window`` consecutive words of every passage; their
elements are shingles of ``SHINGLE`` words. A document that holds a window holds all of its shingles, so with the shingles
ordered by their rarity in the whole corpus the necessary prefix of a window is its rarest shingle. Documents are joined with
the windows on that shingle. The length bound leaves out documents of fewer words than a window, the positional bound takes of
a document only the words that a window around the shingle could cover, and the window must stand among them word by word.

Which hashes occur among the items' shingles is told to the tasks by a bitmap of bounded size, whatever the number of items;
it may only let too much through, which the join then drops. Frequent prefixes are salted on both sides.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.common import cut

WORD = re.compile(r"[^\W_]+")
SHINGLE = 4
#: Bits of a bitmap: so many for each hash, within these bounds (16 MB at most).
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 16, 1 << 27
#: A prefix that occurs more often is spread over so many salts.
HOT_ROWS, SALTS = 100_000, 16
#: Spellings that a table of word numbers remembers.
REMEMBER = 500_000
_MIX = [np.uint64(x) for x in np.random.default_rng(9).integers(1, 1 << 62, 16, dtype=np.uint64) | np.uint64(1)]


def words(text: str) -> list[str]:
    """Runs of letters and digits, without regard to case."""
    return WORD.findall(text.casefold())


class Numbers(dict):
    """A number for each word, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        n = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= REMEMBER:
            self.clear()
        self[word] = n
        return n


def shingles(known: Numbers, found: list[str], size: int) -> np.ndarray:
    """A hash for each run of ``size`` words."""
    total = len(found) - size + 1
    if total < 1:
        return np.zeros(0, np.int64)
    numbers = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
    mixed = sum(numbers[i : i + total] * _MIX[i % 16] for i in range(size))
    mixed = (mixed ^ mixed >> np.uint64(31)) * _MIX[0]
    return (mixed ^ mixed >> np.uint64(29)).view(np.int64)


class Bitmap:
    """Which hashes may be among a set: always true for those that are."""

    def __init__(self, bits: int, slots: list[tuple[int, int]]):
        held = np.zeros(bits // 64, np.int64)
        if slots:
            held[[s for s, _ in slots]] = [b for _, b in slots]
        self.mask, self.bytes = np.int64(bits - 1), held.view(np.uint8)

    def __contains__(self, value: int) -> bool:
        at = int(value) & int(self.mask)
        return bool(self.bytes[at >> 3] >> (at & 7) & 1)

    def may_hold(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & self.mask
        return np.flatnonzero(self.bytes[at >> 3] >> (at & 7).astype(np.uint8) & 1)


def bit_count(n: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, n) * BITS_EACH - 1).bit_length()))


def _slots(hashes: DataFrame, bits: int) -> list[tuple[int, int]]:
    """The bitmap of the column ``hash`` in words of 64 bits: at most ``bits / 64`` rows come to the driver."""
    at = F.col("hash").bitwiseAND(F.lit(bits - 1))
    slots = hashes.select(F.shiftright(at, 6).alias("slot"), F.expr("shiftleft(1L, cast(hash & 63 as int))").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits"))
    return [tuple(row) for row in slots.collect()]


def _windows(batches: Iterator[pa.RecordBatch], window: int, size: int) -> Iterator[pa.RecordBatch]:
    known = Numbers()
    for batch in batches:
        for item, passage in zip(batch.column("item_id").to_pylist(), batch.column("passage").to_pylist(), strict=True):
            found = words(passage)
            if len(found) < window:
                continue
            hashes, last = shingles(known, found, size), len(found) - window
            texts = [" " + " ".join(found[i : i + window]) + " " if i <= last else None for i in range(len(hashes))]
            n = len(hashes)
            copy = xxhash.xxh3_64_intdigest(" ".join(found).encode("utf-8", "surrogatepass")) - (1 << 63)
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * n, pa.int64()), pa.array([copy] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(hashes, pa.int64()), pa.array(texts, pa.string())], names=["item_id", "copy", "place", "hash", "words"]
            )


def _count(batches: Iterator[pa.RecordBatch], bitmap: Bitmap, window: int, size: int) -> Iterator[pa.RecordBatch]:
    known = Numbers()
    for batch in batches:
        hits = [np.zeros(0, np.int64)]
        for text in batch.column("text").to_pylist():
            found = words(text)
            if len(found) >= window:
                hashes = shingles(known, found, size)
                hits.append(hashes[bitmap.may_hold(hashes)])
        values, n = np.unique(np.concatenate(hits), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()), pa.array(n, pa.int64())], names=["hash", "n"])


def _contexts(batches: Iterator[pa.RecordBatch], bitmap: Bitmap, hot: Bitmap, window: int, size: int) -> Iterator[pa.RecordBatch]:
    """Each place of a document at which a prefix may stand, with the words that a window around it can cover."""
    known = Numbers()
    for batch in batches:
        docs: list[int] = []
        values: list[int] = []
        salts: list[int] = []
        texts: list[str] = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = words(text)
            if len(found) < window:
                continue
            hashes = shingles(known, found, size)
            seen: set[tuple[int, str]] = set()
            for at in bitmap.may_hold(hashes).tolist():
                context = " " + " ".join(found[max(0, at - window + size) : at + window]) + " "
                value = int(hashes[at])
                if (value, context) not in seen:  # a text may repeat itself without end
                    seen.add((value, context))
                    docs.append(doc)
                    values.append(value)
                    salts.append(xxhash.xxh32_intdigest(doc.to_bytes(8, "little", signed=True)) % SALTS if value in hot else 0)
                    texts.append(context)
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(values, pa.int64()), pa.array(salts, pa.int32()), pa.array(texts, pa.string())], names=["doc_id", "hash", "salt", "context"])


def leaked(documents: DataFrame, items: DataFrame, window: int = 12, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``doc_id, item_id`` of every document that holds ``window`` or more consecutive words of the item's passage.

    Null texts and passages hold no words, rows without id give no pair; repeated rows give a pair once; empty tables give no
    rows. Neither items nor documents are gathered: two bitmaps of bounded size go to the tasks, counts and places of prefixes
    are shuffled by their hash.
    """
    spark = documents.sparkSession
    size = min(SHINGLE, window)
    held = items.where("item_id is not null and passage is not null").select("item_id", "passage").distinct()
    places = cut(held.mapInArrow(lambda batches: _windows(batches, window, size), "item_id long, copy long, place int, hash long, words string"))
    texts = documents.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text")

    bits = bit_count(places.count())
    wanted = spark.sparkContext.broadcast(Bitmap(bits, _slots(places, bits)))
    counts = texts.select("text").mapInArrow(lambda batches: _count(batches, wanted.value, window, size), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    ranked = places.join(counts, "hash").withColumn("rank", F.struct("n", "hash"))
    # a window that has a shingle which no document holds is in none; the others have all of theirs in the frame
    frame = Window.partitionBy("item_id", "copy").orderBy("place").rangeBetween(0, window - size)
    rarest = ranked.select("item_id", "words", F.min("rank").over(frame).alias("rarest"), F.count("*").over(frame).alias("there"))
    prefixes = cut(rarest.where((F.col("there") == window - size + 1) & F.col("words").isNotNull()).select("item_id", "words", F.col("rarest.hash").alias("hash"), F.col("rarest.n").alias("n")).distinct())

    bits = bit_count(prefixes.count())
    chosen = _slots(prefixes, bits)
    frequent = _slots(prefixes.where(F.col("n") > hot_rows), bits)
    shared = spark.sparkContext.broadcast((Bitmap(bits, chosen), Bitmap(bits, frequent)))
    near = texts.mapInArrow(lambda batches: _contexts(batches, *shared.value, window, size), "doc_id long, hash long, salt int, context string")
    slots = spark.createDataFrame(frequent, "slot long, bits long")
    at = F.col("hash").bitwiseAND(F.lit(bits - 1))
    spread = prefixes.withColumn("slot", F.shiftright(at, 6)).join(slots, "slot", "left") if frequent else prefixes.withColumn("bits", F.lit(0).cast("long"))
    is_hot = F.coalesce(F.expr("(bits & shiftleft(1L, cast(hash & 63 as int))) <> 0"), F.lit(False))  # as the documents' tasks see it
    salted = spread.select("item_id", "words", "hash", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt"))
    return near.join(salted, ["hash", "salt"]).where(F.col("context").contains(F.col("words"))).select("doc_id", "item_id").distinct()

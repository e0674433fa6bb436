"""Token budgets: how many tokens each text holds, summed by slice (problem 3)."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from lodestack.common import with_language
from lodestack.llm.unigram import BatchCounter, UnigramCounter, estimate_counter

TOKENIZER_DIR = os.environ.get("LODESTACK_TOKENIZERS", "/opt/tokenizers")
DEFAULT_RANKS = f"{TOKENIZER_DIR}/byte_bpe_50k.tiktoken"
DEFAULT_PIECES = f"{TOKENIZER_DIR}/piece_bpe_32k.model"
#: How byte-level BPE of this family cuts a text before merging (a fixed value of the vocabulary).
PRETOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoding(ranks_path: str):
    """The byte-level BPE tokenizer whose ranks lie in ``ranks_path``; one per worker."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(ranks_path), pat_str=PRETOKENS, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _estimate_counter() -> BatchCounter:
    return BatchCounter(estimate_counter())


@pandas_udf(LongType())
def _estimates(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    counter = _estimate_counter()
    for batch in batches:
        yield pd.Series(counter.count(batch.where(batch.notna(), None).tolist()), dtype="Int64")


def estimated_tokens(text: Column) -> Column:
    """The project's own estimate: best-path pieces of ``text`` under ``ESTIMATE_PIECES``; null for null, 0 for ''.

    Every text is normalized, matched by the trie and passed through by Viterbi.
    """
    return _estimates(text)


def unigram_tokens(text: Column, pieces: Sequence[tuple[str, float]], space: str = "▁") -> Column:
    """Pieces on the best path of ``text`` under any unigram vocabulary (``piece, score``); white space starts a segment.

    Null for null, 0 for an empty or blank text. The vocabulary travels with the task; it is bounded by its own size.
    """
    vocabulary = tuple(pieces)

    @pandas_udf(LongType())
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = UnigramCounter(vocabulary, segments=lambda text: (space + word for word in text.split()))
        for batch in batches:
            yield pd.Series([counter.count(text) for text in batch], dtype="Int64")

    return counts(text)


@lru_cache(maxsize=2)
def piece_scores(model_path: str) -> tuple[tuple[str, float], ...]:
    """``(piece, score)`` of a vocabulary file of pieces; control and unknown symbols are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_path)
    return tuple((model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))


@lru_cache(maxsize=2)
def _piece_counter(model_path: str) -> UnigramCounter:
    return UnigramCounter(piece_scores(model_path), segments=lambda text: ("▁" + word for word in text.split()))


def piece_tokens(text: Column, model_path: str = DEFAULT_PIECES) -> Column:
    """Pieces on the best path of ``text`` under the pieces and scores in the file ``model_path``; null for null.

    Each worker builds the trie of the vocabulary once. Scores of a file made for merging are ranks, for which the best path
    is the one of the least ranks in sum and not the merged tokens.
    """

    @pandas_udf(LongType())
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _piece_counter(model_path)
        for batch in batches:
            yield pd.Series([counter.count(text) for text in batch], dtype="Int64")

    return counts(text)


def bpe_tokens(text: Column, ranks_path: str = DEFAULT_RANKS) -> Column:
    """Exact tokens of ``text`` under the byte-level BPE vocabulary in ``ranks_path``; null for null, 0 for ''."""

    @pandas_udf(LongType())
    def counts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoding(ranks_path).encode_ordinary
        for batch in batches:
            yield pd.Series([None if text is None else len(encode(text)) for text in batch], dtype="Int64")

    return counts(text)


def entry_tokens(entries: DataFrame, languages: DataFrame, counter=estimated_tokens) -> DataFrame:
    """``entry_id, export_id, language, tokens`` of every entry whose content isn't null.

    Texts are counted where they are read; only the counts are shuffled, to make repeated rows of one entry_id one entry
    (with the greatest count, should they differ). Unknown languages stay null.
    """
    counted = entries.where("entry_id is not null and content is not null").select("entry_id", "export_id", "language", "path", counter(F.col("content")).alias("tokens"))
    known = with_language(counted, languages, out="lang")
    return known.groupBy("entry_id", "export_id").agg(F.max(F.struct("tokens", "lang")).alias("m")).select("entry_id", "export_id", F.col("m.lang").alias("language"), F.col("m.tokens").alias("tokens"))


def token_budget(entries: DataFrame, languages: DataFrame, counter=estimated_tokens) -> DataFrame:
    """Token totals per export and language: ``export_id, language, estimated_tokens``. An empty table gives no rows."""
    return entry_tokens(entries, languages, counter).groupBy("export_id", "language").agg(F.sum("tokens").alias("estimated_tokens"))


def budget_by_slice(budget: DataFrame, exports: DataFrame, by: Sequence[str] = ("source", "domain_label")) -> DataFrame:
    """The totals of ``budget`` summed by columns of the export and language, with the number of exports behind each."""
    slices = exports.select("export_id", *by).dropDuplicates(["export_id"])
    joined = budget.join(slices, "export_id")
    return joined.groupBy(*by, "language").agg(F.count_distinct("export_id").alias("n_exports"), F.sum("estimated_tokens").alias("estimated_tokens"))

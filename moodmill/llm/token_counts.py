"""Operator 1: token counts of whole texts, encoded in batches inside Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from moodmill.llm.bpe import part_encoder
from moodmill.llm.common import bounded_batches, byte_steps, text_buffer


def _piece_counts(path: str):
    """Counts by sentencepiece, whose normalization allows no cuts."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        return np.fromiter((len(x) for x in model.encode(texts, num_threads=1)), dtype=np.int64, count=len(texts))

    return counts


def token_counts(
    docs: DataFrame,
    *,
    tokenizer: str = "byte_bpe_50k.json",
    limit: int = 1024,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each row.

    Only lengths come back from Python. Texts are taken in steps of about equal
    bytes, long ones cut at safe boundaries, and parts that occur again are
    encoded once per worker. A null text counts as empty: 0 bytes, 0 tokens.
    Repeated rows give a row each, a null id stays null, other columns of the
    input are ignored, and an empty table gives no rows. No shuffle.
    """
    bounded_batches(docs.sparkSession)
    path = public_tokenizers.path(tokenizer)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _piece_counts(path) if path.endswith(".model") else part_encoder(path).counts
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            found = [
                counter(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for lo, hi in byte_steps(offsets)
            ]
            tokens = np.concatenate(found) if found else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(tokens), pa.array(tokens > limit)],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text")
    ).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

"""Token counts of whole texts; huge texts are encoded in overlapping chunks and spliced where that is proven right.

A chunk's encoding can differ from the whole text's only near its ends. Two neighbouring characters that no piece
of the vocabulary contains side by side can never be merged, whatever stands around them; between such a pair
every encoding has a boundary, and what stands left and right of it is encoded independently. Chunks overlap, and
are joined at a boundary that is of this kind and that both encodings show. Where an overlap has none, overlap and
chunk are widened, in the end to the whole text.
"""

from __future__ import annotations

from functools import cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal_exposure.llm.common import ready, whole_text

#: Sentencepiece writes a blank so.
BLANK = "▁"


class Spliced:
    """Counts the pieces of one text by overlapping chunks."""

    def __init__(self, model_file: str, chunk: int, overlap: int):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.chunk, self.overlap = chunk, overlap
        self.joined = self._joined()
        self.widened = 0

    def _joined(self) -> set[str]:
        """All pairs of characters that stand side by side in some piece."""
        ids = range(self.model.get_piece_size())
        plain = (self.model.id_to_piece(i) for i in ids if not (self.model.is_byte(i) or self.model.is_control(i)))
        return {a + b for piece in plain for a, b in pairwise(piece)}

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) <= self.chunk]
        for i, ids in zip(short, self.model.encode([texts[i] for i in short], num_threads=1), strict=True):
            out[i] = len(ids)
        for i, t in enumerate(texts):
            if len(t) > self.chunk:
                out[i] = self.long(t)
        return out

    def long(self, text: str) -> int:
        """Pieces of ``text``, with memory bounded by the chunk unless no boundary is found."""
        counted, left, chunk, overlap = 0, 0, self.chunk, self.overlap
        while True:
            begin, end = max(0, left - overlap), min(len(text), left + chunk)
            starts = self._starts(text, begin, end)
            right = len(text) if end == len(text) else self._last_stable(text, starts, max(left, end - overlap))
            if starts is None or right is None or (left and not _has(starts, left)):
                if begin == 0 and end == len(text):
                    return len(self.model.encode(text))
                self.widened += 1
                chunk, overlap = 2 * chunk, 2 * overlap
                continue
            counted += int(np.searchsorted(starts, right) - (np.searchsorted(starts, left) if left else 0))
            if right == len(text):
                return counted
            left, chunk, overlap = right, self.chunk, self.overlap

    def _starts(self, text: str, begin: int, end: int) -> np.ndarray | None:
        """Where in ``text`` each piece of the chunk starts; None if the model's normaliser changes the chunk."""
        chunk = text[begin:end]
        if self.model.normalize(chunk) != BLANK + chunk.replace(" ", BLANK):
            return None
        spans = self.model.encode(chunk, return_type="offset_mapping")["offsets"]
        return begin + np.fromiter((a for a, _ in spans), dtype=np.int64, count=len(spans))

    def _last_stable(self, text: str, starts: np.ndarray | None, least: int) -> int | None:
        for p in starts[::-1] if starts is not None else ():
            if p <= least:
                break
            if text[p - 1 : p + 1].replace(" ", BLANK) not in self.joined:
                return int(p)
        return None


def _has(starts: np.ndarray, p: int) -> bool:
    k = int(np.searchsorted(starts, p))
    return k < len(starts) and starts[k] == p


@cache
def _counter(model_file: str, chunk: int, overlap: int) -> Spliced:
    return Spliced(model_file, chunk, overlap)


def n_tokens(text: Column, model_file: str, chunk: int = 1 << 15, overlap: int = 256) -> Column:
    """Number of pieces of a text by a sentencepiece model, without begin or end pieces; null counts as empty."""

    @F.arrow_udf("long")
    def count(texts: pa.Array) -> pa.Array:
        return pa.array(_counter(model_file, chunk, overlap).counts(texts.to_pylist()), pa.int64())

    return count(F.coalesce(text, F.lit("")))


def token_counts(
    docs: DataFrame, model_file: str, limit: int = 4096, chunk: int = 1 << 15, overlap: int = 256
) -> DataFrame:
    """Per row of ``docs``: doc_id, UTF-8 bytes, pieces, and whether there are more than ``limit``.

    One row out for each row in, repeated rows too. A null or empty text has 0 bytes and 0 pieces; a null doc_id
    stays null. Other columns of ``docs`` are ignored. ``model_file`` must exist on every executor. The rows don't
    move: a text is encoded where it is read, in chunks of ``chunk`` characters if it is longer than that.
    """
    ready(docs.sparkSession)
    return docs.select(
        F.col("doc_id"),
        F.octet_length(whole_text()).cast("long").alias("n_bytes"),
        n_tokens(F.col("text"), model_file, chunk, overlap).alias("n_tokens"),
    ).withColumn("over_limit", F.col("n_tokens") > limit)

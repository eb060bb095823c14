"""Language identification by prediction by partial matching over bytes.

Each language has a tree of the byte contexts of up to three bytes that its training texts show, with how often
each next byte followed. A byte's probability is its share in the longest context the language knows, with as much
weight set aside for new bytes as the context has distinct ones (escape method C); an escape goes on to the context
shorter by one byte, in the end to all 256 bytes alike. The counts are frozen after training, so that the code
length of a byte depends on it and its context only: all of them are worked out once and looked up when scoring.
The predicted language is the one under which the whole text has the least code length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal_exposure.llm.common import ready, utf8

ORDER = 3
UNKNOWN = "und"
_START = 10  # a text begins as if after line breaks
_SLICE = 1 << 20


@dataclass
class Model:
    """``cost[node, byte class, language]`` in bits; ``node`` of the last three byte classes."""

    languages: list[str]
    byte_class: np.ndarray
    node: np.ndarray
    cost: np.ndarray

    @property
    def classes(self) -> int:
        return self.cost.shape[1]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


def training_sample(docs: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` labelled rows of each language, chosen by a hash of doc_id; lang and text."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    shares = known.groupBy("lang").agg((F.lit(float(per_language)) / F.count("*")).alias("share")).collect()
    chance = F.pmod(F.xxhash64(F.lit(8), "doc_id"), F.lit(1_000_000)) / 1_000_000
    chosen = F.lit(False)
    for r in shares:
        chosen = chosen | ((F.col("lang") == r["lang"]) & (chance < r["share"]))
    return known.where(chosen).select("lang", "text")


def context_counts(sample: DataFrame) -> DataFrame:
    """lang, order, gram, n: how often each byte followed each context; gram has the context's bytes above the byte."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages = batch["lang"].to_pylist()
            for lang in sorted(set(languages)):
                texts = batch["text"].filter(pa.array([x == lang for x in languages]))
                data, at = utf8(texts)
                grams = np.zeros(len(data), np.uint32)
                for order, before in enumerate([data, *_before(data, at)]):
                    grams = grams | before.astype(np.uint32) << np.uint32(8 * order)
                    gram, n = np.unique(grams, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang] * len(gram), pa.string()),
                            pa.array(np.full(len(gram), order, np.int32)),
                            pa.array(gram.astype(np.int64)),
                            pa.array(n.astype(np.int64)),
                        ],
                        names=["lang", "ord", "gram", "n"],
                    )

    found = sample.mapInArrow(count, "lang string, ord int, gram long, n long")
    return found.groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n"))


def _before(data: np.ndarray, at: np.ndarray, start: int = _START) -> list[np.ndarray]:
    """For each byte the byte one, two and three places before it in its text."""
    firsts = at[:-1][at[:-1] < at[1:]]
    out, last = [], data
    for _ in range(ORDER):
        now = np.empty_like(last)
        now[1:] = last[:-1]
        now[firsts] = start
        out.append(now)
        last = now
    return out


def train(docs: DataFrame, per_language: int = 1500, least: int = 2) -> Model:
    """Fit on about ``per_language`` rows of each language of ``docs``, which has doc_id, text and lang.

    Contexts of two and three bytes need ``least`` occurrences of a following byte for it to be remembered. What is
    read to the driver are these counts; the sample bounds them. Rows with a null text or lang are left out. With
    no labelled row at all the model has no language, and every prediction is ``und``.
    """
    ready(docs.sparkSession)
    counts = context_counts(training_sample(docs, per_language)).where((F.col("ord") < 2) | (F.col("n") >= least))
    found = counts.toPandas()
    languages = sorted(found["lang"].unique())
    data = found["gram"].to_numpy(np.int64)
    order, n = found["ord"].to_numpy(), found["n"].to_numpy(np.float64)
    lang = np.searchsorted(np.array(languages, dtype=object), found["lang"].to_numpy(object)) if languages else order
    seen = np.union1d(np.unique(data & 255), [_START])
    byte_class = np.full(256, len(seen), np.int32)  # the last class is any byte that training never saw
    byte_class[seen] = np.arange(len(seen))
    c, many = len(seen) + 1, max(1, len(languages))
    grams = np.zeros(len(data), np.int64)
    for k in range(ORDER + 1):
        grams += np.where(order >= k, byte_class[data >> 8 * k & 255].astype(np.int64) * c**k, 0)
    node = np.zeros(1, np.int32)
    cost = np.full((1, c, many), 8.0, np.float32)
    for k in range(ORDER + 1):
        mine = order == k
        contexts, at = np.unique(grams[mine] // c, return_inverse=True)
        follow = np.zeros((len(contexts), c, many), np.float32)
        np.add.at(follow, (at, grams[mine] % c, lang[mine]), n[mine])
        longer = node[np.arange(c**k) % len(node)].copy()  # a context without a node has that of its shorter one
        for i in range(0, len(contexts), 1024):  # in place and in pieces: the driver is small
            cut = slice(i, i + 1024)
            follow[cut] = _bits(follow[cut], cost[longer[contexts[cut]]])
        longer[contexts] = len(cost) + np.arange(len(contexts))
        cost, node = np.concatenate([cost, follow]), longer
    return Model(languages, byte_class, node, cost)


def _bits(follow: np.ndarray, shorter: np.ndarray) -> np.ndarray:
    """Code lengths in contexts from counts of the bytes that follow, and from the code lengths in shorter contexts."""
    follow = follow.astype(np.float64)
    total, kinds = follow.sum(1, keepdims=True), (follow > 0).sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        hit = -np.log2(follow / (total + kinds))
        escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
    return np.where(follow > 0, hit, escape + shorter)


def code_lengths(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each whole text under each language, and its bytes; a null text has none."""
    data, at = utf8(texts.fill_null(""))
    out = np.zeros((len(texts), max(1, len(model.languages))))
    c, flat = model.classes, model.cost.reshape(-1, model.cost.shape[2])
    classes = model.byte_class[data]
    firsts = np.flatnonzero(at[:-1] < at[1:])
    one, two, three = _before(classes, at, model.byte_class[_START])
    for a in range(0, len(data), _SLICE):
        cut = slice(a, a + _SLICE)
        row = model.node[(three[cut] * c + two[cut]) * c + one[cut]] * c + classes[cut]
        i = max(0, int(np.searchsorted(at[firsts], a, "right")) - 1)
        mine = firsts[i : int(np.searchsorted(at[firsts], a + _SLICE))]
        out[mine] += np.add.reduceat(flat[row], np.maximum(at[mine] - a, 0), axis=0, dtype=np.float64)
    return out, np.diff(at)


def languages_of(model: Model, texts: pa.Array) -> pa.Array:
    """Struct of lang_pred, score and bits (least code length per byte) of each text."""
    letter = regex.compile(r"\p{L}")
    ok = [t is not None and letter.search(t) is not None for t in texts.to_pylist()]
    bits, size = code_lengths(model, texts)
    ok = np.array(ok, dtype=bool) & bool(model.languages)
    best = bits.argmin(1)
    # How much shorter than under the others; long texts are weighed as 64 bytes, as their bytes aren't independent.
    behind = (bits - bits.min(1, keepdims=True)) * np.minimum(1, 64 / np.maximum(size, 1))[:, None]
    score = np.where(ok, 1 / np.exp2(-behind).sum(1), 0.0)
    names = [model.languages[b] if o else UNKNOWN for b, o in zip(best, ok, strict=True)]
    rate = np.where(size > 0, bits.min(1) / np.maximum(size, 1), 0.0)
    return pa.StructArray.from_arrays(
        [pa.array(names, pa.string()), pa.array(score), pa.array(rate)], ["lang_pred", "score", "bits"]
    )


def language(spark, model: Model, text: Column) -> Column:
    """Column of structs (lang_pred, score, bits) for a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double, bits double")
    def predict(texts: pa.Array) -> pa.Array:
        return languages_of(shared.value, texts)

    return predict.asNondeterministic()(text)  # so that it is worked out once a row, not once a use


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, lang_pred, score (0 to 1) and bits, the least code length per byte.

    A null text, an empty one or one without a letter gets ``und`` with score 0. Equal texts get equal answers, of
    two languages with the same code length the first by name. Other columns are ignored; texts are read whole.
    """
    ready(docs.sparkSession)
    found = docs.select("doc_id", language(docs.sparkSession, model, F.col("text")).alias("_found"))
    return found.select("doc_id", "_found.*")


def accepted(docs: DataFrame, model: Model, worst_bits: float = 8.0) -> DataFrame:
    """The rows of ``docs`` in some language, with all their columns.

    Rejected are ``und`` and texts that the best language's model codes with more than ``worst_bits`` per byte: no
    shorter than bytes as they are, so no language that was learned.
    """
    ready(docs.sparkSession)
    name = "_language_found"
    found = docs.withColumn(name, language(docs.sparkSession, model, F.col("text")))
    kept = (F.col(f"{name}.lang_pred") != UNKNOWN) & (F.col(f"{name}.bits") <= worst_bits)
    return found.where(kept).drop(name)

"""Text quality by co-training two classifiers with different views of a document.

One sees the content (letters, words, marks, repeats), the other the page's metadata (source, language, size,
layout of lines). Each is fitted to the labelled rows; then, round by round, each labels those of all other rows that
it is surest of, for the other to learn from. Each is calibrated on labelled rows kept apart, and the calibrated views
are combined to score all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from areal_exposure.llm.common import ready, whole_text
from areal_exposure.sources.scratch import written

CONTENT, METADATA = 12 + 64, 7 + 16 + 8
_FOLD = np.arange(256) % 64  # of bytes into 64 bins
_KINDS = {
    "upper": np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8),
    "digit": np.frombuffer(b"0123456789", np.uint8),
    "blank": np.frombuffer(b" \t\r\n", np.uint8),
    "stop": np.frombuffer(b".,;:?", np.uint8),
    "shout": np.frombuffer(b"!", np.uint8),
    "mark": np.frombuffer(b"#$%&*@^~|<>{}[]\\", np.uint8),
}


def content(text: str) -> np.ndarray:
    """What the content view sees of a text."""
    held = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    bytes_, words = np.bincount(held, minlength=256), text.split()
    n, many = max(1, len(held)), max(1, len(words))
    shares = [bytes_[k].sum() / n for k in _KINDS.values()]
    same = sum(a == b for a, b in zip(words, words[1:], strict=False))
    distinct = len(set(words))
    letters = (bytes_[65:91].sum() + bytes_[97:123].sum() + bytes_[128:].sum()) / n
    numbers = [np.log1p(many), distinct / many, len(text) / many, same / many, letters, min(len(words), 1)]
    return np.concatenate([shares, numbers, np.sqrt(np.bincount(_FOLD, bytes_, 64) / n)])


def metadata(text: str, source: str | None, lang: str | None) -> np.ndarray:
    """What the metadata view sees of a document."""
    lines = [x for x in text.split("\n") if x.strip()]
    many = max(1, len(lines))
    sizes = np.array([len(x) for x in lines] or [0])
    ended = sum(x.rstrip()[-1] in ".!?" for x in lines)
    layout = [np.log1p(len(text)), np.log1p(many), np.log1p(sizes.mean()), np.log1p(sizes.max())]
    layout += [len(set(lines)) / many, ended / many, (sizes < 40).sum() / many]
    out = np.zeros(METADATA)
    out[:7] = layout
    out[7 + zlib.crc32(str(source).encode()) % 16] = 1
    out[23 + zlib.crc32(str(lang).encode()) % 8] = 1
    return out


@dataclass
class View:
    """Logistic regression on standardised numbers, and the line that calibrates its log-odds."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    line: tuple[float, float] = (1.0, 0.0)

    def odds(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[1:] + self.weights[0]

    def calibrated(self, x: np.ndarray) -> np.ndarray:
        return self.line[0] * self.odds(x) + self.line[1]


#: Fitted views, how many good and how many bad rows each may label, to what each labels: the other's view of the rows,
#: and the labels.
Surest = Callable[[list[View], int, int], list[tuple[np.ndarray, np.ndarray]]]


@dataclass
class Judge:
    """Both views, and the weights of their calibrated log-odds."""

    content: View
    metadata: View
    mix: np.ndarray


def probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Intercept and weights, by Newton's method with a squared penalty on the weights."""
    x = np.hstack([np.ones((len(x), 1)), x])
    held = np.full(x.shape[1], penalty)
    held[0] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = probability(x @ w)
        slope = x.T @ (p - y) + held * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(held)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit_view(x: np.ndarray, y: np.ndarray) -> View:
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    return View(mean, scale, logistic((x - mean) / scale, y))


def co_train(views: tuple[np.ndarray, np.ndarray], labels: np.ndarray, surest: Surest, rounds: int, each: int) -> Judge | None:
    """Co-train on labelled rows, given by both views, and on what ``surest`` finds; None without labels of both kinds."""
    apart = np.arange(len(labels)) % 5 == 0  # for calibration
    y = labels[~apart]
    if len(set(y)) < 2 or len(set(labels[apart])) < 2:
        return None
    seen = [(v[~apart], y) for v in views]
    good = max(1, round(each * y.mean()))
    for _ in range(rounds):
        found = surest([fit_view(*s) for s in seen], good, max(1, each - good))
        for teacher, pupil in ((0, 1), (1, 0)):
            rows, told = found[teacher]
            if len(told):
                seen[pupil] = (np.vstack([seen[pupil][0], rows]), np.concatenate([seen[pupil][1], told]))
    fitted, known = [fit_view(*s) for s in seen], labels[apart]
    for view, x in zip(fitted, views, strict=True):
        b, a = logistic(view.odds(x[apart])[:, None], known)
        view.line = (float(a), float(b))
    odds = np.column_stack([v.calibrated(x[apart]) for v, x in zip(fitted, views, strict=True)])
    return Judge(*fitted, logistic(odds, known))


_VIEWS = "content array<float>, metadata array<float>"


def view_columns(spark: SparkSession, *columns: Column) -> Column:
    """Both views of a document from its text, source and lang."""

    @F.arrow_udf(_VIEWS)
    def make(texts: pa.Array, sources: pa.Array, langs: pa.Array) -> pa.Array:
        rows = list(zip(texts.to_pylist(), sources.to_pylist(), langs.to_pylist(), strict=True))
        kind = pa.list_(pa.float32())
        return pa.StructArray.from_arrays(
            [
                pa.array([content(t).astype(np.float32) for t, _, _ in rows], kind),
                pa.array([metadata(*r).astype(np.float32) for r in rows], kind),
            ],
            ["content", "metadata"],
        )

    return make.asNondeterministic()(*columns)


def _inputs() -> tuple[Column, Column, Column]:
    return whole_text(), F.col("source").cast("string"), F.col("lang").cast("string")


def _stacked(found: list) -> tuple[np.ndarray, np.ndarray]:
    empty = (np.zeros((0, CONTENT)), np.zeros((0, METADATA)))
    return tuple(np.array([r[k] for r in found], dtype=float) for k in ("content", "metadata")) if found else empty


def unlabelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """What both views see of all rows whose doc_id is not in ``known``, written: key, content, metadata.

    Rows that look alike to both views are one row, so that copies don't take all places of a round.
    """
    seen = docs.select("doc_id", view_columns(docs.sparkSession, *_inputs()).alias("v")).join(known, "doc_id", "left_anti")
    return written(seen.select(F.xxhash64("v").alias("key"), "v.*").dropDuplicates(["key"]), "views")


def _odds(view: View, column: str) -> Column:
    @F.arrow_udf("double")
    def tell(rows: pa.Array) -> pa.Array:
        held = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), len(view.mean))
        return pa.array(view.odds(held.astype(float)))

    return tell(column)


def surest_of(pool: DataFrame) -> Surest:
    """What views are surest of among all rows of ``pool`` that no earlier call gave, by ordered limits.

    Rows between a tenth and nine tenths are not sure. Ties go by ``key``. Only keys and odds take part in the ordering;
    the rows found, at most twice ``good`` and ``bad``, are read by key.
    """
    names, taken = ("content", "metadata"), set()
    sure = float(np.log(9.0))

    def find(fitted: list[View], good: int, bad: int) -> list[tuple[np.ndarray, np.ndarray]]:
        free = pool.where(~F.col("key").isin(sorted(taken))) if taken else pool
        lists = []
        for k, (view, name) in enumerate(zip(fitted, names, strict=True)):
            odds = free.select("key", _odds(view, name).alias("odds"))
            high = odds.where(F.col("odds") >= sure).orderBy(F.desc("odds"), "key").limit(good)
            low = odds.where(F.col("odds") <= -sure).orderBy("odds", "key").limit(bad)
            lists += [high.select("key", F.lit(k).alias("teacher"), F.lit(1.0).alias("told"))]
            lists += [low.select("key", F.lit(k).alias("teacher"), F.lit(0.0).alias("told"))]
        first, *rest = lists
        for more in rest:
            first = first.unionAll(more)
        found = first.collect()
        keys = sorted({r["key"] for r in found})
        rows = {r["key"]: r for r in pool.where(F.col("key").isin(keys)).collect()} if keys else {}
        taken.update(keys)
        out = []
        for teacher, pupil in ((0, 1), (1, 0)):
            own = sorted((r["key"], r["told"]) for r in found if r["teacher"] == teacher)
            out.append((_stacked([rows[key] for key, _ in own])[pupil], np.array([told for _, told in own])))
        return out

    return find


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 10_000, rounds: int = 5, each: int = 500) -> Judge | None:
    """Fit to about ``most_labelled`` rows of ``labels`` (doc_id, quality), and to the surest of all other rows.

    The labelled sample goes by a hash of doc_id. All rows without a label are scored in every round, and ``each`` of them
    are taken per view: only the numbers of those reach the driver. Rows with a null quality or doc_id aren't labelled.
    """
    spark = docs.sparkSession
    ready(spark)
    chance = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_000)) / 1_000_000
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("quality").cast("double").alias("quality"))
    chosen = known.where(chance < most_labelled / max(1, known.count()))
    rows = docs.select("doc_id", "text", "source", "lang")
    labelled = rows.join(F.broadcast(chosen), "doc_id")  # about most_labelled rows by construction
    views = labelled.select("doc_id", view_columns(spark, *_inputs()).alias("v"), "quality")
    first = sorted(views.select("doc_id", "v.*", "quality").collect())
    told = np.array([r["quality"] for r in first])
    if len(set(told)) < 2:
        return None
    return co_train(_stacked(first), told, surest_of(unlabelled(rows, known.select("doc_id"))), rounds, each)


def score(docs: DataFrame, judge: Judge | None) -> DataFrame:
    """Per row of ``docs``: doc_id, by_content, by_metadata and quality, calibrated probabilities of good quality.

    A null text counts as empty, null source and lang are values of their own; repeated rows score alike. Without a
    ``judge`` (no labels of both kinds) every probability is 0.5.
    """
    spark = docs.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(judge)

    @F.arrow_udf("by_content double, by_metadata double, quality double")
    def tell(texts: pa.Array, sources: pa.Array, langs: pa.Array) -> pa.Array:
        j, rows = shared.value, list(zip(texts.to_pylist(), sources.to_pylist(), langs.to_pylist(), strict=True))
        out = np.full((3, len(rows)), 0.5)
        if j and rows:
            odds = np.column_stack(
                [
                    j.content.calibrated(np.array([content(t) for t, _, _ in rows])),
                    j.metadata.calibrated(np.array([metadata(*r) for r in rows])),
                ]
            )
            out[:2], out[2] = probability(odds.T), probability(odds @ j.mix[1:] + j.mix[0])
        return pa.StructArray.from_arrays([pa.array(x) for x in out], ["by_content", "by_metadata", "quality"])

    return docs.select("doc_id", tell.asNondeterministic()(*_inputs()).alias("_found")).select("doc_id", "_found.*")

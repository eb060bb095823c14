"""Secrets in texts: fixed patterns, and values in credential contexts that are costly to guess.

The guess cost of a value is the least sum of bits over all ways to cut it into dictionary words (by rank of
frequency among all words of the corpus, with case and look-alike characters), dates, repeats, keyboard walks and brute-force
characters, found by dynamic programming over its positions. Words and walks are cheap, random keys aren't.

The corpus' words stay a Spark table (``word_ranks``): the substrings of the values are joined with it, so each value
is priced with the ranks of just the words that it holds. Words inside such values don't count as met, else a key's
own letters would be a word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areal_exposure.llm.common import ready, utf8, whole_text
from areal_exposure.sources.scratch import written

BASE = ("assign", "access", "hex")
KINDS = (*BASE, "guess")
#: A value of at least so many bits (ten thousand million guesses) is taken for a secret.
LEAST_BITS = 10 * math.log2(10)
SPANS = "array<struct<kind: string, start: int, end: int>>"

ASSIGN = re.compile(
    r"""(?ai:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: A run of the letters is found whole from its first AKIA, so the length may stand in the pattern; likewise for hex.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
CONTEXTS = (
    re.compile(
        r"""(?ai:pass(?:word|wd|phrase|code)?|pwd|secret|token|(?:api|access|private)[ _-]?key|auth|credentials?)"""
        r"""["']?\s{0,3}(?::=|=>|[:=])\s{0,3}["'`]?([^\s"'`<>]{8,})"""
    ),
    re.compile(r"""(?ai:bearer)\x20+([^\s"'`<>]{8,})"""),
    re.compile(r"""://[^\s:/@]{1,64}:([^\s@/]{8,})@"""),
)
#: One of these stands in every match of ASSIGN and CONTEXTS.
_HINTS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "bearer", "://")
_HINTED = "|".join(_HINTS)
_VALUES = "array<struct<start: int, end: int, value: string>>"
_PIECES = 100_000
_IS_HEX = np.zeros(256, dtype=bool)
_IS_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True

_YEAR = r"(?:19|20)\d\d"
_DATES = (
    (re.compile(rf"(?={_YEAR})\d{{4}}"), math.log2(200)),
    (re.compile(rf"\d{{1,2}}[-/.]?\d{{1,2}}[-/.]?{_YEAR}"), math.log2(365 * 200) + 2),
    (re.compile(rf"{_YEAR}[-/.]?\d{{1,2}}[-/.]?\d{{1,2}}"), math.log2(365 * 200) + 2),
)
_REPEAT = re.compile(r"(.{1,8}?)\1{2,}")
_LOOK_ALIKE = str.maketrans("40315$7@", "aoeissta")
_ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_LONGEST_WORD = 24


def _neighbours() -> set[str]:
    """Pairs of keys side by side: in a row, or one row down with the rows shifted by half a key."""
    pairs = {r[i : i + 2] for r in _ROWS for i in range(len(r) - 1)}
    for upper, lower in zip(_ROWS, _ROWS[1:], strict=False):
        pairs |= {upper[i] + lower[j] for i in range(len(upper)) for j in (i - 1, i) if 0 <= j < len(lower)}
    return pairs | {p[::-1] for p in pairs}


_BESIDE = _neighbours()


def _char_bits(c: str) -> float:
    if c.isdigit():
        return math.log2(10)
    return math.log2(26) if c.isascii() and c.isalpha() else math.log2(33)


def _case_bits(word: str) -> float:
    """Bits for which letters are capital: none, the first or all are common."""
    upper = sum(c.isupper() for c in word)
    if not upper:
        return 0.0
    if word.istitle() or word.isupper():
        return 1.0
    return math.log2(math.comb(len(word), upper)) + 1


@dataclass
class Guesser:
    """Guess costs in bits, with the rank (from 1) of each dictionary word."""

    ranks: dict[str, int] = field(default_factory=dict)

    def bits(self, value: str) -> float:
        segments: dict[int, list[tuple[int, float]]] = {}
        for i, j, cost in self._segments(value):
            segments.setdefault(j, []).append((i, cost))
        best = [0.0] * (len(value) + 1)
        for j in range(1, len(value) + 1):
            best[j] = best[j - 1] + _char_bits(value[j - 1])
            for i, cost in segments.get(j, ()):
                best[j] = min(best[j], best[i] + cost + 1)  # a bit for the cut
        return best[-1]

    def _segments(self, value: str):
        lower = value.lower() if len(value.lower()) == len(value) else value
        plain = lower.translate(_LOOK_ALIKE)
        for i in range(len(value)):
            for j in range(i + 3, min(len(value), i + _LONGEST_WORD) + 1):
                rank = self.ranks.get(lower[i:j])
                if rank is not None:
                    yield i, j, math.log2(rank) + _case_bits(value[i:j])
                elif plain[i:j] != lower[i:j] and (rank := self.ranks.get(plain[i:j])) is not None:
                    yield i, j, math.log2(rank) + _case_bits(value[i:j]) + 2
        for pattern, cost in _DATES:
            yield from ((m.start(), m.end(), cost) for m in pattern.finditer(value))
        for m in _REPEAT.finditer(value):
            once = sum(map(_char_bits, m[1]))
            yield m.start(), m.end(), once + math.log2(len(m[0]) // len(m[1]))
        start = 0
        for k in range(1, len(lower) + 1):
            if k == len(lower) or lower[k - 1 : k + 1] not in _BESIDE:
                if k - start >= 4:  # a start key, a length, and some of six ways on at each turn
                    turns = sum(
                        ord(lower[i + 1]) - ord(lower[i]) != ord(lower[i + 2]) - ord(lower[i + 1])
                        for i in range(start, k - 2)
                    )
                    yield start, k, math.log2(47 * (k - start)) + math.log2(6) * min(turns, 3) + _case_bits(value[start:k])
                start = k


def pieces(value: str) -> Iterator[str]:
    """The substrings of letters that ``Guesser`` looks up for a value, plain and look-alike."""
    lower = value.lower() if len(value.lower()) == len(value) else value
    plain = lower.translate(_LOOK_ALIKE)
    for text in (lower, plain) if plain != lower else (lower,):
        for run in re.finditer(r"[^\W\d_]+", text):
            for i in range(run.start(), run.end() - 2):
                yield from (text[i:j] for j in range(i + 3, min(run.end(), i + _LONGEST_WORD) + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, leftmost and not overlapping within a kind."""
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def context_values(text: str) -> list[tuple[int, int]]:
    """Where the values of credential contexts are, by start."""
    return sorted({m.span(1) for pattern in CONTEXTS for m in pattern.finditer(text)})


def _uncovered(found: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    return [(a, b) for a, b in found if not any(i <= a and b <= j for _, i, j in base)]


def guess_spans(text: str, guesser: Guesser, base: list[tuple[str, int, int]], least: float) -> list:
    """Costly values in credential contexts that no span of ``base`` holds already."""
    new = _uncovered(context_values(text), base)
    return [("guess", a, b) for a, b in new if guesser.bits(text[a:b]) >= least]


def _order(span: tuple[str, int, int]) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def scan(texts: pa.Array, guesser: Guesser | None, least: float = LEAST_BITS) -> list[list[tuple[str, int, int]]]:
    """Spans of each text by start, then kind as listed; without a guesser those of the fixed patterns."""
    data, at = utf8(texts.fill_null(""))
    blocks = np.flatnonzero(_IS_HEX[data[: len(data) // 8 * 8]].reshape(-1, 8).all(1)) * 8
    long_hex = set((np.searchsorted(at, blocks, "right") - 1).tolist())  # 16 in a row fill one of the blocks of 8
    out = []
    for k, text in enumerate(texts.to_pylist()):
        spans: list[tuple[str, int, int]] = []
        if text:
            lower = text.lower()
            hinted = any(h in lower for h in _HINTS)
            if hinted or k in long_hex or "AKIA" in text:
                spans = base_spans(text)
                if hinted and guesser is not None:
                    spans += guess_spans(text, guesser, spans, least)
                spans.sort(key=_order)
        out.append(spans)
    return out


def dictionary(docs: DataFrame, size: int = 20_000) -> Guesser:
    """The commonest words of three letters or more in all texts, ranked, ties by spelling: at most ``size``.

    Words as rare as the first one beyond ``size`` are all left out. The limit is found from how many words have
    each count, so no more than the dictionary itself reaches the driver.
    """
    words = docs.select(F.explode(F.split(F.lower(whole_text()), r"[^\p{L}]+")).alias("word"))
    usual = words.where(F.length("word").between(3, _LONGEST_WORD)).groupBy("word").count()
    usual = written(usual, "words")
    many = usual.groupBy("count").agg(F.count("*").alias("words"))
    upto = many.select("count", F.sum("words").over(Window.orderBy(F.desc("count"))).alias("upto"))
    beyond = upto.where(F.col("upto") > size).agg(F.max("count")).first()[0] or 0
    top = usual.where(F.col("count") > beyond).collect()
    ranked = sorted(top, key=lambda r: (-r["count"], r["word"]))
    return Guesser({r["word"]: k for k, r in enumerate(ranked, 1)})


def _words(text: Column) -> Column:
    return F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word")


def _hinted(docs: DataFrame) -> DataFrame:
    return docs.where(F.lower("text").rlike(_HINTED))


def _covered(texts: pa.Array) -> pa.Array:
    """The stretches that values of credential contexts cover, each once."""
    out = []
    for text in texts.to_pylist():
        stretches: list[list[int]] = []
        for a, b in context_values(text):
            if stretches and a < stretches[-1][1]:
                stretches[-1][1] = max(b, stretches[-1][1])
            else:
                stretches.append([a, b])
        out.append([text[a:b] for a, b in stretches])
    return pa.array(out, pa.list_(pa.string()))


def _valued(texts: pa.Array) -> pa.Array:
    """The values of credential contexts that no span of the fixed patterns holds."""
    out = []
    for text in texts.to_pylist():
        new = _uncovered(context_values(text), base_spans(text))
        out.append([{"start": a, "end": b, "value": text[a:b]} for a, b in new])
    kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])
    return pa.array(out, pa.list_(kind))


def word_ranks(docs: DataFrame) -> DataFrame:
    """word, rank: every word of 3 to 24 letters that is met outside the values of credential contexts.

    The rank is the number of words at least as common, so equally common ones share it. It comes from how many words
    have each count.
    """
    ready(docs.sparkSession)
    all_words = docs.select(_words(whole_text())).withColumn("met", F.lit(1))
    values = _hinted(docs).select(F.explode(F.arrow_udf(_covered, "array<string>").asNondeterministic()("text")).alias("value"))
    met = all_words.unionAll(values.select(_words(F.col("value"))).withColumn("met", F.lit(-1)))
    usual = met.where(F.length("word").between(3, _LONGEST_WORD)).groupBy("word").agg(F.sum("met").alias("count"))
    usual = written(usual.where("count > 0"), "words")
    many = usual.groupBy("count").agg(F.count("*").alias("words"))
    ranks = many.select("count", F.sum("words").over(Window.orderBy(F.desc("count"))).alias("rank"))
    return usual.join(written(ranks, "ranks"), "count").select("word", "rank")


def _text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("_k"), F.xxhash64(F.lit(9), text).alias("_l")]


def _piece_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (v, w, value) to v, w and each of the value's distinct pieces."""
    for batch in batches:
        for v, w, value in zip(*(batch[c].to_pylist() for c in ("v", "w", "value")), strict=True):
            found = list(set(pieces(value)))
            for i in range(0, len(found), _PIECES):
                some = found[i : i + _PIECES]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v] * len(some), pa.int64()), pa.array([w] * len(some), pa.int64()), pa.array(some, pa.string())],
                    names=["v", "w", "word"],
                )


def guessed(docs: DataFrame, ranks: DataFrame, least: float) -> DataFrame:
    """_k, _l, _guessed: where each text (by its two hashes) has values that take at least ``least`` bits to guess."""
    found = _hinted(docs).select(*_text_key(F.col("text")), F.explode(F.arrow_udf(_valued, _VALUES).asNondeterministic()("text")).alias("s"))
    key = [F.xxhash64("s.value").alias("v"), F.xxhash64(F.lit(9), "s.value").alias("w")]
    found = written(found.select("_k", "_l", "s.start", "s.end", "s.value", *key), "values")
    values = found.groupBy("v", "w").agg(F.first("value").alias("value"))
    held = values.mapInArrow(_piece_rows, "v long, w long, word string").join(ranks, "word")
    held = held.groupBy("v", "w").agg(F.collect_list(F.struct("word", "rank")).alias("words"))

    @F.arrow_udf("boolean")
    def costly(values: pa.Array, words: pa.Array) -> pa.Array:
        both = zip(values.to_pylist(), words.to_pylist(), strict=True)
        return pa.array([Guesser({r["word"]: r["rank"] for r in w or ()}).bits(v) >= least for v, w in both], pa.bool_())

    priced = values.join(held, ["v", "w"], "left").select("v", "w", costly.asNondeterministic()("value", "words").alias("costly"))
    places = found.select("_k", "_l", "start", "end", "v", "w").distinct()
    places = places.join(priced.where("costly").select("v", "w"), ["v", "w"], "left_semi")
    span = F.struct(F.lit("guess").alias("kind"), "start", "end")
    return written(places.groupBy("_k", "_l").agg(F.collect_list(span).alias("_guessed")), "guessed")


def _joined(rows: DataFrame, costly: DataFrame) -> DataFrame:
    """``rows`` (with _k, _l of their texts) with the spans of ``guessed``, or null."""
    return rows.join(costly, ["_k", "_l"], "left")


def _merged(base: list[tuple[str, int, int]], found: list[dict] | None) -> list[tuple[str, int, int]]:
    return sorted([*base, *((s["kind"], s["start"], s["end"]) for s in found or ())], key=_order)


def spans(spark: SparkSession, guesser: Guesser | None, text: Column, least: float = LEAST_BITS) -> Column:
    """Column of the spans of a text: kind, start and end in code points, end exclusive."""
    shared = spark.sparkContext.broadcast(guesser)

    @F.arrow_udf(SPANS)
    def find(texts: pa.Array) -> pa.Array:
        found = scan(texts, shared.value, least)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in f] for f in found], kind)

    return find.asNondeterministic()(text)


def find_secrets(docs: DataFrame, guesser: Guesser | DataFrame, least: float = LEAST_BITS) -> DataFrame:
    """Per row of ``docs``: doc_id and spans (kind, start, end) by start, then kind as in ``KINDS``.

    Kinds ``assign``, ``access`` and ``hex`` are the fixed patterns; ``guess`` is a value of a credential context
    that takes ``least`` bits to guess and lies in no other span. A null or empty text has no spans; repeated rows
    give repeated rows; other columns are ignored. A text is read whole, in the task that reads its row. The words
    are those of ``guesser``: a small dictionary, or a table of word and rank (``word_ranks``) of any size.
    """
    ready(docs.sparkSession)
    if isinstance(guesser, DataFrame):
        base = spans(docs.sparkSession, None, F.col("text")).alias("_base")
        rows = _joined(docs.select("doc_id", *_text_key(F.col("text")), base), guessed(docs, guesser, least))
        kind = F.when(F.col("_guessed").isNull(), F.col("_base")).otherwise(F.array_sort(F.concat("_base", F.col("_guessed").cast(SPANS)), _by_order))
        return rows.select("doc_id", kind.alias("spans"))
    return docs.select("doc_id", spans(docs.sparkSession, guesser, F.col("text"), least).alias("spans"))


def _by_order(a: Column, b: Column) -> Column:
    """Compares spans by start, kind as in ``KINDS`` and end."""
    one, two = (F.struct(s["start"], F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]), s["end"]) for s in (a, b))
    return F.when(one < two, -1).when(one > two, 1).otherwise(0)


def redacted(docs: DataFrame, guesser: Guesser | DataFrame, mark: str = "[secret]", least: float = LEAST_BITS) -> DataFrame:
    """``docs`` with ``mark`` in place of every secret in text, and n_chars to match; other texts stay as they are.

    ``guesser`` is as in ``find_secrets``.
    """
    ready(docs.sparkSession)
    table = isinstance(guesser, DataFrame)
    shared = docs.sparkSession.sparkContext.broadcast(None if table else guesser)

    @F.arrow_udf("string")
    def mask(texts: pa.Array, costly: pa.Array) -> pa.Array:
        found = map(_merged, scan(texts, shared.value, least), costly.to_pylist())
        return pa.array([t and masked(t, f, mark) for t, f in zip(texts.to_pylist(), found, strict=True)], pa.string())

    name = "_masked_text"
    if table:
        rows = _joined(docs.select("*", *_text_key(F.col("text"))), guessed(docs, guesser, least))
    else:
        rows = docs.withColumn("_guessed", F.lit(None).cast(SPANS))
    out = rows.withColumn(name, mask.asNondeterministic()(F.col("text"), F.col("_guessed")))
    changed = ~F.col(name).eqNullSafe(F.col("text"))
    replaced = {"text": F.col(name)}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        replaced["n_chars"] = F.when(changed, F.length(name).cast(kind)).otherwise(F.col("n_chars"))
    return out.select(*(replaced[c].alias(c) if c in replaced else F.col(f"`{c}`") for c in docs.columns))


def masked(text: str, found: list[tuple[str, int, int]], mark: str) -> str:
    """``mark`` once for each stretch that spans cover."""
    out, at = [], 0
    for _, a, b in sorted(found, key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def span_text(found: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    parts = F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")

"""Collocations from a weighted de Bruijn graph of the corpus.

Edges are the longest grams, of five words, between the overlapping nodes of their first and last four; equal edges are
added up before and after one shuffle. A text piece's last words make shorter grams that no edge starts with: its end
corrections. The count of a shorter phrase is the flow out of its node, the sum over edges that start with it, plus
its end corrections, level by level down to pairs. A node through which all flow goes on by one edge (or came by one)
is compacted into that edge: the phrase is met only inside the longer one.

A phrase met ``least`` times has only words and pairs met as often. So words are counted first, then pairs by hash, and
pieces are cut where a rarer word or pair stands; the graph holds the rest. Which words and pairs are common is sent to
tasks as bitmaps of fixed size, in which a wrong bit only leaves more in the graph. Grams are dealt out by their first three words, so the counts of three to
five words need no further shuffle. The flow out of pairs is added up in the tasks that read the texts, then between them.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import batched, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areal_exposure.llm.common import ready, whole_text
from areal_exposure.sources.scratch import written

#: Words of the longest grams.
LONGEST = 5
#: Ends a piece; takes the place of all characters that do.
_END = b","
_BYTES = bytes(44 if b in b".,;:!?" or 10 <= b <= 13 else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Bits of a bitmap.
_BITS = 25
#: What a task holds before it hands counts on: distinct words, grams or pairs, and known words of all languages.
_HELD, _HELD_GRAMS, _KNOWN = 500_000, 2_000_000, 200_000
#: A spelled gram takes the room of so many others.
_SPELLED = 4
#: Texts are taken apart up to so many characters at a time, and counts handed on up to so many rows at a time.
_READ, _ROWS = 1_000_000, 50_000
#: Pairs and grams are added up in so many parts, so that what sorting takes is a share of what is held.
_PARTS = 8
#: A task that counts grams reads up to so many splits of the input, where that leaves two tasks for each core.
_SPLITS = 4
#: So many of the commonest words, up to so many bytes long, stand in grams as one character; others are spelled.
_CODED, _CODED_BYTES = 200_000, 64
_SEED = 42
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(texts: list[bytes]) -> list[bytes]:
    """The words of texts with only A-Z lower-cased, and an end mark wherever a piece ends."""
    return b",".join(texts).translate(_BYTES).replace(_END, b" , ").split()


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """Languages with some of their texts, ``_READ`` characters or a single text beyond them at a time."""
    found, size = defaultdict(list), 0
    for lang, text in zip(batch.column(0), batch.column(1), strict=True):
        found[lang.as_py()].append(text.as_py().encode())
        size += len(text.as_py())
        if size > _READ:
            yield from found.items()
            found, size = defaultdict(list), 0
    yield from found.items()


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, word, n, and with a null word the number of all words."""

    def rows(held: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            counts.pop(_END, None)
            yield batch_of(lang, [None], [sum(counts.values())])
            for part in batched(counts.items(), _ROWS):
                yield batch_of(lang, [w.decode() for w, _ in part], [n for _, n in part])

    def batch_of(lang: str, words: list[str | None], n: list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    held = defaultdict(Counter)
    for batch in batches:
        for lang, texts in _by_language(batch):
            held[lang].update(tokens(texts))
            if sum(map(len, held.values())) > _HELD:
                yield from rows(held)
                held = defaultdict(Counter)
    yield from rows(held)


def codes(words: list[str]) -> dict[bytes, int]:
    """A character for each word, the commonest first; none is a blank or a comma."""
    points = (c for c in count(0x30) if not 0xD800 <= c < 0xE000)
    return {w.encode(): c for w, c in zip(words, points)}


class _Words(dict):
    """Numbers for the common words of a language, with their codes; 0 is the end of a piece, and 1 any other word."""

    def __init__(self, lang: str, common: np.ndarray, code: dict[bytes, int]):
        super().__init__()
        self.lead, self.common, self.code = lang.encode() + b"\t", common, code
        self.codes, self.hashes = array("I", [0, 0]), array("Q", [0, 0])
        self[_END] = 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(self.lead + word, _SEED)
        number = self[word] = len(self.codes) if _has(self.common, h) else 1
        if number > 1:
            self.codes.append(self.code.get(word, 0))
            self.hashes.append(h)
        return number

    def pairs(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words' numbers, where two common words stand side by side in a piece, and the hashes of these pairs."""
        numbers = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        allowed = numbers > 1
        hashes = np.array(self.hashes, np.uint64)[numbers]
        at = np.flatnonzero(allowed[:-1] & allowed[1:])
        first, second = hashes[at], hashes[at + 1]
        mixed = (first ^ (first >> np.uint64(29))) * _M1 + (second ^ (second >> np.uint64(32))) * _M2
        return numbers, at, mixed ^ (mixed >> np.uint64(31))

    def grams(self, found: list[bytes], common_pairs: np.ndarray) -> tuple[np.ndarray, list[str]]:
        """The longest gram at every place where a common pair starts, in a run of such: as rows of codes, or spelled."""
        numbers, at, pairs = self.pairs(found)
        at = at[_have(common_pairs, pairs)]
        joined = np.zeros(len(found) + LONGEST, np.bool_)  # whether a word and the next are a common pair
        joined[at] = True
        code = np.zeros(len(found) + LONGEST, np.uint32)
        code[: len(found)] = np.array(self.codes, np.uint32)[numbers]
        rows = np.zeros((len(at), LONGEST), np.uint32)
        rows[:, 0] = code[at]
        going, spelled = np.ones(len(at), np.bool_), code[at] == 0
        for k in range(1, LONGEST):
            going &= joined[at + k - 1]
            rows[:, k] = np.where(going, code[at + k], 0)
            spelled |= going & (code[at + k] == 0)
        written_out = []
        for i in at[spelled].tolist():
            n = next((k for k in range(1, LONGEST) if not joined[i + k - 1]), LONGEST)
            written_out.append(" ".join(chr(c) if (c := int(code[i + k])) else "," + found[i + k].decode() for k in range(n)))
        return rows[~spelled], written_out


def _known(held: dict[str, _Words], lang: str, common: np.ndarray, code: dict[bytes, int]) -> _Words:
    if sum(map(len, held.values())) > _KNOWN:
        held.clear()
    if lang not in held:
        held[lang] = _Words(lang, common, code)
    return held[lang]


def _has(bitmap: np.ndarray, h: int) -> int:
    bit = h & ((1 << _BITS) - 1)
    return int(bitmap[bit >> 6]) >> (bit & 63) & 1


def _have(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    bit = h & np.uint64((1 << _BITS) - 1)
    return (bitmap[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _counted_pairs(batches: Iterator[pa.RecordBatch], common: np.ndarray) -> Iterator[pa.RecordBatch]:
    """pair (hash) and n."""

    def rows(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for k in range(_PARTS):
            pairs, n = np.unique(np.concatenate([p[p % np.uint64(_PARTS) == k] for p in parts]), return_counts=True)
            for i in range(0, len(pairs), _ROWS):
                part = slice(i, i + _ROWS)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[part].view(np.int64)), pa.array(n[part].astype(np.int64))], names=["pair", "n"])

    words, parts, size = {}, [], 0
    for batch in batches:
        for lang, texts in _by_language(batch):
            parts.append(_known(words, lang, common, {}).pairs(tokens(texts))[2])
            size += len(parts[-1])
            if size > _HELD_GRAMS:
                yield from rows(parts)
                parts, size = [], 0
    if size:
        yield from rows(parts)


#: Grams in two numbers, of their first three codes and of the others, and how often each is there.
_Grams = tuple[np.ndarray, np.ndarray, np.ndarray]


def _packed(rows: np.ndarray) -> _Grams:
    wide = rows.astype(np.uint64)
    first = wide[:, 0] << np.uint64(42) | wide[:, 1] << np.uint64(21) | wide[:, 2]
    return first, wide[:, 3] << np.uint64(21) | wide[:, 4], np.ones(len(rows), np.int64)


def _unpacked(*packed: tuple[np.ndarray, int]) -> np.ndarray:
    """Rows of codes, from numbers with how many codes each holds."""
    return np.stack([numbers >> np.uint64(21 * k) & np.uint64((1 << 21) - 1) for numbers, codes in packed for k in reversed(range(codes))], axis=1).astype(np.uint32)


def _added_up(parts: list[_Grams]) -> _Grams:
    """Distinct grams, in order, and the sums of their counts."""
    first, second, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((second, first))
    first, second = first[order], second[order]
    new = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1]))))
    return first[new], second[new], np.add.reduceat(n[order], new)


def _spaced(rows: np.ndarray) -> pa.Array:
    """Rows of codes as strings with blanks between the characters; zeros at the end are left out."""
    n, k = rows.shape
    points = np.zeros((n, 2 * k - 1), np.uint32)
    points[:, ::2] = rows
    points[:, 1::2] = np.where(rows[:, 1:] > 0, 32, 0)
    return pa.array(points.view(f"<U{2 * k - 1}").ravel(), pa.string())


def _counted_grams(batches: Iterator[pa.RecordBatch], common: np.ndarray, common_pairs: np.ndarray, code: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """lang, lead (first three words), tail (the rest) and n of the longest grams; under a null tail, the flow out of pairs.

    Grams come in order, so the flow out of their pairs is a sum over neighbours. A gram of two words is only in that.
    What is held is added up first, apart by its first words, and handed on only where the distinct grams are too many.
    """

    def batch_of(lang: str, lead: pa.Array, tail: pa.Array, n: np.ndarray | list[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(lead), pa.string()), lead, tail, pa.array(n, pa.int64())], names=["lang", "lead", "tail", "n"])

    def rows(held: dict[tuple[str, int], list[_Grams]], spelled: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for (lang, _), parts in held.items():
            first, second, n = _added_up(parts)
            pair = first >> np.uint64(21)
            new = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
            flow = np.add.reduceat(n, new)
            for i in range(0, len(new), _ROWS):
                lead = _spaced(_unpacked((pair[new[i : i + _ROWS]], 2)))
                yield batch_of(lang, lead, pa.nulls(len(lead), pa.string()), flow[i : i + _ROWS])
            longer = np.flatnonzero(first & np.uint64((1 << 21) - 1))
            for i in range(0, len(longer), _ROWS):
                part = longer[i : i + _ROWS]
                yield batch_of(lang, _spaced(_unpacked((first[part], 3))), _spaced(_unpacked((second[part], 2))), n[part])
        for lang, counts in spelled.items():
            pairs = Counter()
            for gram, n in counts.items():
                pairs[" ".join(gram.split(" ", 2)[:2])] += n
            for part in batched(pairs.items(), _ROWS):
                yield batch_of(lang, pa.array([p for p, _ in part], pa.string()), pa.nulls(len(part), pa.string()), [n for _, n in part])
            for part in batched(((g.split(" "), n) for g, n in counts.items() if g.count(" ") > 1), _ROWS):
                lead, tail = (pa.array([" ".join(w) for w in words], pa.string()) for words in ([g[:3] for g, _ in part], [g[3:] for g, _ in part]))
                yield batch_of(lang, lead, tail, [n for _, n in part])

    words, held, spelled, size = {}, defaultdict(list), defaultdict(Counter), 0
    for batch in batches:
        for lang, texts in _by_language(batch):
            coded, written_out = _known(words, lang, common, code).grams(tokens(texts), common_pairs)
            for k in range(_PARTS):
                if len(part := coded[coded[:, 0] % _PARTS == k]):
                    held[lang, k].append(_packed(part))
            spelled[lang].update(written_out)
            size += len(coded) + _SPELLED * len(written_out)
            if size > _HELD_GRAMS // 4:
                for key, parts in held.items():
                    held[key] = [_added_up(parts)]
                size = 0
                if sum(len(parts[0][2]) for parts in held.values()) + _SPELLED * sum(map(len, spelled.values())) > _HELD_GRAMS // 2:
                    yield from rows(held, spelled)
                    held, spelled = defaultdict(list), defaultdict(Counter)
    yield from rows(held, spelled)


def _bitmap(hashes: DataFrame, h: str) -> np.ndarray:
    """A bitmap of the low bits of hashes, put together in Spark; at most 2^25 / 64 rows reach the driver."""
    bit = F.col(h).bitwiseAND(F.lit((1 << _BITS) - 1))
    slots = hashes.select(F.shiftright(bit, 6).alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    found = slots.groupBy("slot").agg(F.bit_or("bit").alias("bits")).toPandas()
    bitmap = np.zeros(1 << (_BITS - 6), np.uint64)
    bitmap[found["slot"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return bitmap


def graph(docs: DataFrame, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """Words (lang, word, n; all words of a language under a null word) and the graph's phrases (lang, phrase, k, n).

    Both are written tables, and hold what is met ``least`` times in its language.
    """
    spark = docs.sparkSession
    ready(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), whole_text().alias("text"))
    total = F.sum("n").cast("long").alias("n")
    words = texts.mapInArrow(_counted_words, "lang string, word string, n long").groupBy("lang", "word").agg(total)
    words = written(words.where(F.col("word").isNull() | (F.col("n") >= least)), "words")
    listed = words.where("word is not null")
    common = spark.sparkContext.broadcast(_bitmap(listed.select(F.xxhash64(F.concat_ws("\t", "lang", "word")).alias("h")), "h"))
    commonest = listed.where(F.octet_length("word") <= _CODED_BYTES).groupBy("word").agg(total).orderBy(F.desc("n"), "word")
    code = spark.sparkContext.broadcast(codes([r["word"] for r in commonest.limit(_CODED).collect()]))

    pairs = texts.mapInArrow(lambda batches: _counted_pairs(batches, common.value), "pair long, n long").groupBy("pair").agg(total)
    common_pairs = spark.sparkContext.broadcast(_bitmap(pairs.where(F.col("n") >= least), "pair"))

    # the more text a task reads, the more of its grams are equal
    tasks = max(2 * spark.sparkContext.defaultParallelism, texts.rdd.getNumPartitions() // _SPLITS)
    grams = texts.coalesce(tasks).mapInArrow(lambda batches: _counted_grams(batches, common.value, common_pairs.value, code.value), "lang string, lead string, tail string, n long")
    return words, written(_spelled(_flows(grams, least), code), "phrases")


def _flows(grams: DataFrame, least: int) -> DataFrame:
    """lang, phrase, k, n of all phrases of two to five words that are met often, from grams as (lang, lead, tail, n)."""
    total = F.sum("n").cast("long").alias("n")
    often = F.col("n") >= least
    edges = grams.repartition("lang", "lead").groupBy("lang", "lead", "tail").agg(total)
    # no phrase is met more often than its first three words, whose count is all flow that leaves them
    flow = F.sum("n").over(Window.partitionBy("lang", "lead"))
    held = written(edges.withColumn("flow", flow).where(F.col("flow") >= least).drop("flow"), "edges")

    pair = held.where("tail is null").select("lang", F.col("lead").alias("phrase"), F.lit(2).alias("k"), "n")
    edges = held.where("tail is not null")
    whole = F.concat_ws(" ", "lead", "tail")
    flow = edges.where("tail != ''").withColumn("tail", F.substring_index("tail", " ", 1)).groupBy("lang", "lead", "tail").agg(total)
    five = edges.where(F.instr("tail", " ") > 0).select("lang", whole.alias("phrase"), F.lit(5).alias("k"), "n")
    four = flow.select("lang", whole.alias("phrase"), F.lit(4).alias("k"), "n")
    three = edges.groupBy("lang", F.col("lead").alias("phrase")).agg(total).select("lang", "phrase", F.lit(3).alias("k"), "n")
    return pair.unionByName(three).unionByName(four).unionByName(five).where(often)


def _spelled(phrases: DataFrame, code: Broadcast) -> DataFrame:
    """The same phrases with their words instead of codes."""

    @F.arrow_udf("string")
    def spelled(coded: pa.Array) -> pa.Array:
        word = {chr(c): w.decode() for w, c in code.value.items()}
        return pa.array([" ".join(x[1:] if x[0] == "," else word[x] for x in p.split(" ")) for p in coded.to_pylist()], pa.string())

    return phrases.withColumn("phrase", spelled("phrase"))


def _part(phrase: str, k: Column) -> Column:
    """The first ``k`` words of a phrase, or the last ``-k``."""
    return F.call_function("substring_index", F.col(phrase), F.lit(" "), k)


def compacted(phrases: DataFrame) -> DataFrame:
    """Phrases without those all of whose flow goes through one edge to a longer phrase, before or after it."""
    edge = phrases.where("k > 2")
    before, after = _part("phrase", F.col("k") - 1), _part("phrase", 1 - F.col("k"))
    nodes = edge.select("lang", F.explode(F.array(before, after)).alias("phrase"), "n").distinct()
    return phrases.join(nodes, ["lang", "phrase", "n"], "left_anti")


def _score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 a n / (l r)), in decimals of 38 digits; the quotient is at most 1000 n / l."""
    wide = F.lit(1000).cast("decimal(4,0)") * a.cast("decimal(15,0)") * n.cast("decimal(19,0)")
    return F.call_function("div", wide, l.cast("decimal(19,0)") * r.cast("decimal(18,0)"))


def collocations(docs: DataFrame, least: int = 100, first: int = 2000) -> DataFrame:
    """The ``first`` highest-scoring phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Whole texts, cut into pieces at ``.,;:!?`` and line ends and into words at blanks and tabs, count; null and empty
    ones have no words, and a null lang is ``und``. Repeated rows count each time. A phrase is scored by its weakest cut
    into two; ties of score go to the more frequent, then the lower in byte order. No rows in, no rows out. Only lang and text are read.
    """
    words, found = graph(docs, least)
    totals = words.where("word is null").select("lang", F.col("n").alias("all_words"))
    counts = found.select("lang", "phrase", "n").unionByName(words.where("word is not null").select("lang", F.col("word").alias("phrase"), "n"))
    left, right = (counts.select("lang", F.col("phrase").alias(f"{s}_part"), F.col("n").alias(s)) for s in ("l", "r"))

    cut = compacted(found).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cut = cut.withColumn("l_part", _part("phrase", F.col("cut"))).withColumn("r_part", _part("phrase", F.col("cut") - F.col("k")))
    scored = cut.join(left, ["lang", "l_part"]).join(right, ["lang", "r_part"]).join(totals, "lang")
    lowest = F.min(F.struct(_score(F.col("n"), F.col("all_words"), F.col("l"), F.col("r")).alias("score"), "cut", "l", "r"))
    best = scored.groupBy("lang", "phrase", F.col("n").alias("a"), F.col("all_words").alias("n")).agg(lowest.alias("low"))
    best = best.select("lang", "phrase", "a", "low.l", "low.r", "n", "low.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")

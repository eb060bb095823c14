"""Benchmark items inside documents, found by SimHash windows and a multi-index over their bits.

Words' 64-bit hashes vote on the bits of a window's fingerprint. A window is sized to an item: 16 words for items
long enough that a copy of four fifths of it must hold 19 words in a row, else 8 if it must hold 11. Items have a
fingerprint at every word, documents at every fourth, so a stretch of 19 (11) copied words has a whole document window
that some item window equals. Items too short for that (5 to 12 words) are a class of their own: all their five-word
shingles are looked up at every word of the documents, as a copy shares at least one. Fingerprints are cut into four blocks of 16 bits: two that differ in at most three bits agree in a
block, so a join on blocks finds all within that radius. Each candidate gives a place in the document, where as
many words as the item has are compared with it by counted five-word shingles. All of it is column arithmetic: the
words' votes are added for all 64 bits at once by carry-save adders on bitwise operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal_exposure.llm.common import whole_text
from areal_exposure.sources.scratch import written

SIZES = (8, 16)
STRIDE = 4
RADIUS = 3
_BLOCKS, _BITS = 4, 16
WORDS = 5
#: Broadcast the benchmark's index up to so many rows (some 40 bytes each), else join by shuffle.
_SENT_ROWS = 500_000


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words (runs of letters and digits, case aside) of a text."""
    found = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(found, lambda w: F.xxhash64(w))


def window_size(words: Column) -> Column:
    """The largest window that a copy of four fifths of an item of so many words must hold whole, wherever it starts.

    ``WORDS`` where that is no fingerprint's, and null below five words.
    """
    intact = F.floor((words - WORDS + 1) * 0.8) + WORDS - 1
    fits = F.when(intact >= SIZES[1] + STRIDE - 1, SIZES[1]).when(intact >= SIZES[0] + STRIDE - 1, SIZES[0])
    return fits.otherwise(F.when(words >= WORDS, WORDS))


def with_votes(df: DataFrame, votes: list[str], out: str) -> DataFrame:
    """Add ``out``: each bit is one if more than half of the 64-bit columns ``votes`` have it (their number a power of two)."""
    planes: dict[int, list[str]] = {0: list(votes)}
    made = 0
    while any(len(p) > 1 for p in planes.values()):
        new, columns = {}, []
        for weight, held in planes.items():
            while len(held) > 1:
                cut, held = held[:3], held[3:]
                a, b = F.col(cut[0]), F.col(cut[1])
                either = a.bitwiseXOR(b)
                carry = a.bitwiseAND(b)
                if len(cut) == 3:
                    c = F.col(cut[2])
                    carry = carry.bitwiseOR(c.bitwiseAND(either))
                    either = either.bitwiseXOR(c)
                columns += [either.alias(f"_{out}{made}"), carry.alias(f"_{out}{made + 1}")]
                new.setdefault(weight, []).append(f"_{out}{made}")
                new.setdefault(weight + 1, []).append(f"_{out}{made + 1}")
                made += 2
            new.setdefault(weight, []).extend(held)
        df, planes = df.select("*", *columns), new
    half = len(votes).bit_length() - 2  # more than half: a higher bit of the count, or this one and a lower
    nothing = F.lit(0).cast("long")
    higher, middle, lower = nothing, nothing, nothing
    for weight, held in planes.items():
        for p in held:
            if weight > half:
                higher = higher.bitwiseOR(F.col(p))
            elif weight == half:
                middle = middle.bitwiseOR(F.col(p))
            else:
                lower = lower.bitwiseOR(F.col(p))
    majority = higher.bitwiseOR(middle.bitwiseAND(lower))
    helpers = [c for c in df.columns if c.startswith(f"_{out}")]
    return df.withColumn(out, majority).drop(*helpers)


def fingerprints(df: DataFrame, stride: int) -> DataFrame:
    """``df`` (with ``hashes``) once per window start ``at``, with fingerprints f8 and f16.

    Where fewer words follow than a fingerprint takes, it is of no use.
    """
    n = F.size("hashes")
    starts = F.sequence(F.lit(0), n - SIZES[0], F.lit(stride))
    df = df.where(n >= SIZES[0]).select("*", F.explode(starts).alias("at"))
    votes = [f"_v{k}" for k in range(SIZES[1])]
    nothing = F.lit(0).cast("long")  # never null, so that no null check multiplies the code below
    df = df.select("*", *(F.coalesce(F.get("hashes", F.col("at") + k), nothing).alias(v) for k, v in enumerate(votes)))
    for size in SIZES:
        df = with_votes(df, votes[:size], f"f{size}")
    return df.drop(*votes)


def block_keys(windows: DataFrame) -> DataFrame:
    """Each whole window's fingerprints in ``print``, once for each block, with ``key``: size, block and its bits.

    The fingerprints are laid out in rows first and cut afterwards, so that each is worked out once.
    """
    prints = F.posexplode(F.array(*(f"f{s}" for s in SIZES))).alias("which", "print")
    others = [c for c in windows.columns if c not in {f"f{s}" for s in SIZES}]
    rows = windows.select(*others, prints).withColumn("size", F.get(F.array(*map(F.lit, SIZES)), F.col("which")))
    rows = rows.where(F.col("at") + F.col("size") <= F.size("hashes"))
    rows = rows.withColumn("block", F.explode(F.array(*map(F.lit, range(_BLOCKS)))))
    bits = F.expr(f"shiftrightunsigned(print, {_BITS} * block) & {(1 << _BITS) - 1}L")
    head = (F.col("size") * 256 + F.col("block")).cast("long") * (1 << _BITS)
    return rows.select(*others, "size", "print", (head + bits).alias("key"))


def item_index(items: DataFrame) -> DataFrame:
    """key, print, item_id, offset, item: the blocks of every window of the items' own size, at every word."""
    rows = block_keys(fingerprints(items, 1)).where(F.col("size") == window_size(F.size("hashes")))
    return rows.select("key", "print", "item_id", F.col("at").alias("offset"), F.col("hashes").alias("item"))


def shingle_keys(df: DataFrame) -> DataFrame:
    """``df`` (with ``hashes``) once per five-word shingle, at every word ``at``, with its hash as ``print`` and ``key``."""
    df = df.where(F.size("hashes") >= WORDS).select("*", F.posexplode(_rolled("hashes")).alias("at", "print"))
    return df.withColumn("key", F.col("print"))


def short_index(items: DataFrame) -> DataFrame:
    """As ``item_index``, of the items too short for fingerprints, by five-word shingles."""
    rows = shingle_keys(items.where(window_size(F.size("hashes")) == WORDS))
    return rows.select("key", "print", "item_id", F.col("at").alias("offset"), F.col("hashes").alias("item"))


def _rolled(hashes: str) -> Column:
    """The five-word shingles of a stretch of words."""
    places = F.sequence(F.lit(0), F.size(hashes) - WORDS)
    made = F.transform(places, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(WORDS))))
    return F.when(F.size(hashes) >= WORDS, made).otherwise(F.array().cast("array<bigint>"))


def similarities(candidates: DataFrame) -> DataFrame:
    """doc_id, item_id, start and similarity of candidates (with the words' hashes of ``stretch`` and ``item``)."""
    key = ["doc_id", "item_id", "start", "print"]
    each = candidates.select("doc_id", "item_id", "start", F.xxhash64("stretch").alias("print"), "stretch", "item")
    each = each.dropDuplicates(key)  # the grouping below needs no other exchange
    sides = F.arrays_zip(F.array(_rolled("stretch"), _rolled("item")).alias("shingles"), F.array(F.lit(1), F.lit(0)).alias("is_doc"))
    each = each.select(*key, F.explode(sides).alias("side"))
    each = each.select(*key, "side.is_doc", F.explode("side.shingles").alias("shingle"))
    counts = each.groupBy(*key, "shingle").agg(F.sum("is_doc").alias("one"), F.sum(1 - F.col("is_doc")).alias("two"))
    share = F.sum(F.least("one", "two")) / F.sum(F.greatest("one", "two"))
    return counts.groupBy(*key).agg(share.alias("similarity")).drop("print")


def _looked_up(probes: DataFrame, index: DataFrame) -> DataFrame:
    """doc_id, hashes, at, item_id, item, offset of the documents' keys that an index has, with prints in the radius."""
    if index.count() <= _SENT_ROWS:
        index = F.broadcast(index)
    probes = probes.withColumnRenamed("print", "p")
    near = F.bit_count(F.col("p").bitwiseXOR(F.col("print"))) <= RADIUS
    met = probes.join(index, (probes["key"] == index["key"]) & near)
    return met.select("doc_id", "hashes", "at", "item_id", "item", "offset")


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, similarity and start: each document and benchmark item (item_id, text) that it holds.

    The similarity is that of counted five-word shingles (common over all) between the item and the stretch of
    as many words at ``start`` (in words from 0), at its best place, the first of equals; rows have ``least`` or
    more. An item of fewer than five words is held by nothing; nor does a null or empty text hold anything. Rows
    with the same doc_id count as one document. Other columns are ignored.

    The documents don't move: fingerprints are made, looked up and verified where a text is read. Only the pairs
    found are shuffled, to keep each once.
    """
    items = benchmark.select("item_id", word_hashes(whole_text()).alias("hashes"))
    windows = docs.select("doc_id", word_hashes(whole_text()).alias("hashes"))
    windows = windows.where(F.size("hashes") >= WORDS)
    met = _looked_up(block_keys(fingerprints(windows, STRIDE)), written(item_index(items), "index"))
    short = written(short_index(items), "short_index")
    if not short.isEmpty():
        met = met.unionAll(_looked_up(shingle_keys(windows), short))
    start = F.greatest(F.lit(0), F.col("at") - F.col("offset"))
    length = F.size("item") + F.least(F.lit(0), F.col("at") - F.col("offset"))
    met = met.select("doc_id", "item_id", "item", start.alias("start"), F.slice("hashes", start + 1, length).alias("stretch"))
    met = similarities(met).where(F.col("similarity") >= least)
    best = F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("best")
    met = met.groupBy("doc_id", "item_id").agg(best)
    return met.select("doc_id", "item_id", "best.similarity", (-F.col("best.s")).alias("start"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns; rows of one doc_id go together."""
    held = leaks(docs, benchmark, least).select(F.col("doc_id").alias("_held")).distinct()
    return docs.join(held, docs["doc_id"].eqNullSafe(held["_held"]), "left_anti")

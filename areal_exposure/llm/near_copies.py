"""Classes of near copies by ProbMinHash, banding and exact verification.

A text's weighted shingles (weight 1 + ln count) throw points at the registers of its signature, each at the times
of a Poisson process with its weight as rate; a register keeps the earliest. Elements whose next point comes later
than every register's are finished, which ends the process early. Two signatures agree in a register with the
probability Jaccard similarity of the texts. Bands of registers make buckets; pairs from buckets are verified by
the exact share of common shingles, and linked texts make classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal_exposure.llm.common import ready, whole_text
from areal_exposure.llm.shingles import jaccard, mixed, sets, shingles
from areal_exposure.sources.scratch import written

#: At similarity 0.8 a pair shares a bucket with probability 0.99995.
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: A pair of similarity 0.8 has so few registers in common with probability 2e-7.
_LEAST_EQUAL = 75
#: Shingles in a block of a bucket, 4 MB; a member counts as ``_OWN`` more for its registers.
_BLOCK, _OWN = 1 << 19, 40
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def signatures(home: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """The element kept by each register of each text, from texts' elements (by text) and weights."""
    kept = np.zeros((texts, REGISTERS), np.uint64)
    many = np.bincount(home, minlength=texts)[home] if len(home) else home
    for low, high, points in ((0, 8, 128), (8, 64, 16), (64, 1 << 62, 2)):
        mine = (many >= low) & (many < high)
        if mine.any():
            present, at = np.unique(home[mine], return_inverse=True)
            kept[present] = _thrown(at, element[mine], weight[mine], len(present), points)
    return kept


def _thrown(home: np.ndarray, element: np.ndarray, weight: np.ndarray, texts: int, points: int) -> np.ndarray:
    earliest = np.full(texts * REGISTERS, np.inf)
    kept = np.zeros(texts * REGISTERS, np.uint64)
    time, rate, turn = np.zeros(len(home)), weight, 0
    while len(home):
        for _ in range(points):
            turn += 1
            chance = mixed(element + np.uint64(turn * int(_GOLDEN) % 2**64))
            time = time - np.log(((chance >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / rate
            register = home * REGISTERS + (mixed(chance) % np.uint64(REGISTERS)).astype(np.int64)
            early = time < earliest[register]
            where, when, who = register[early], time[early], element[early]
            np.minimum.at(earliest, where, when)
            won = when == earliest[where]
            kept[where[won]] = who[won]
        latest = earliest.reshape(texts, REGISTERS).max(1)
        on = time < latest[home]
        home, element, rate, time = home[on], element[on], rate[on], time[on]
    return kept.reshape(texts, REGISTERS)


def signature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text) to doc_id, the bands' keys, 16 bits of each register and the number of distinct shingles.

    A text without words has no row.
    """
    for batch in batches:
        for first, home, shingle, count in shingles(batch["text"]):
            if not len(home):
                continue
            present, at = np.unique(home, return_inverse=True)
            kept = mixed(signatures(at, shingle, 1 + np.log(count), len(present)))
            turns = np.arange(1, ROWS + 1, dtype=np.uint64) * _GOLDEN
            keys = mixed((kept.reshape(-1, BANDS, ROWS) ^ turns).sum(2, dtype=np.uint64) * _GOLDEN)
            bits = (kept & np.uint64(0xFFFF)).astype("<u2")
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"].take(pa.array(first + present)),
                    pa.array(list(keys.view(np.int64)), pa.list_(pa.int64())),
                    pa.array([b.tobytes() for b in bits], pa.binary()),
                    pa.array(np.bincount(at, minlength=len(present)), pa.int64()),
                ],
                names=["doc_id", "bands", "bits", "size"],
            )


def _similarity(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array(jaccard(left, right))


def _of(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is among ``ids``. These are written: their size tells Spark whether to broadcast them, so
    that the other rows, most of all texts, need not be dealt out."""
    return rows.join(written(ids.select("doc_id").distinct(), "needed"), "doc_id", "left_semi")


def verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts have at least ``least`` of their shingles in common."""
    pairs = written(pairs, "pairs")
    texts = _of(texts, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    one, two = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), texts
    held = pairs.join(one, "a").join(two.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return held.withColumn("s", F.arrow_udf(_similarity, "double").asNondeterministic()("text_a", "text_b")).where(F.col("s") >= least).select("a", "b")


def _tangled(edges: DataFrame) -> bool:
    """Whether distinct edges (a, b), ``b`` the less, are more than stars: a node has two lesser neighbours, or one and a larger."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg((F.sum("up") + F.max("down")).alias("ties")).where("ties > 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that edges (a, b) connect each node with.

    Alternating stars: every node's larger neighbours, then its smaller ones, are tied to the least neighbour, until
    all are stars, which that leaves as they are; each step is written, so that a lost executor costs one step at most.
    """
    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    while _tangled(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        near = large.join(least, "a")
        small = near.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = written(small.where("a <> b").distinct())
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` of components after more ``edges`` (a, b): only the components that these connect are gone through."""
    for end in ("a", "b"):
        known = labels.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
        edges = edges.join(known, F.col(end) == F.col("_node"), "left").withColumn(end, F.coalesce("_label", end)).drop("_node", "_label")
    joined = components(edges)
    moved = joined.select(F.col("node").alias("_node"), F.col("label").alias("_label"))
    old = labels.join(moved, F.col("label") == F.col("_node"), "left").select("node", F.coalesce("_label", "label").alias("label"))
    return written(old.union(joined), "labels")


def _pair(one: str, two: str) -> list[Column]:
    return [F.least(one, two).alias("a"), F.greatest(one, two).alias("b")]


def centred(members: DataFrame) -> DataFrame:
    """``members`` of buckets (band, key, doc_id, n) with ``centre``: of each bucket the one with most company."""
    company = members.groupBy("doc_id").agg(F.sum("n").alias("company"))
    rank = F.struct("company", (-F.col("doc_id")).alias("before"))
    centres = members.join(company, "doc_id").groupBy("band", "key").agg(F.max_by("doc_id", rank).alias("centre"), F.max(rank).alias("rank"))
    return members.join(centres, ["band", "key"])


def first_pairs(members: DataFrame) -> DataFrame:
    """One pair for each member: with that centre of its buckets which has most company."""
    best = centred(members).groupBy("doc_id").agg(F.max_by("centre", "rank").alias("centre"))
    return best.where("doc_id <> centre").select(*_pair("doc_id", "centre")).distinct()


def mixed_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members with their labels, of the buckets that still have several components.

    ``main`` is the commonest component of a bucket, ``load`` and ``load_main`` tell how many shingles there are.
    """
    own = members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    own = own.select("band", "key", "doc_id", "n", "size", F.coalesce("label", "doc_id").alias("label"))
    loads = own.groupBy("band", "key", "label").agg(F.count("*").alias("many"), F.sum(F.col("size") + _OWN).alias("part"))
    rank = F.struct("many", "label")
    main = [F.max_by("label", rank).alias("main"), F.max_by("part", rank).alias("load_main")]
    several = loads.groupBy("band", "key").agg(*main, F.sum("part").alias("load"), F.count("*").alias("kinds"))
    return own.join(several.where("kinds > 1").drop("kinds"), ["band", "key"])


def centre_pairs(mixed_ones: DataFrame) -> DataFrame:
    """Pairs of members of mixed buckets with the centre of each, where their components differ."""
    found = centred(mixed_ones)
    known = mixed_ones.select(F.col("doc_id").alias("centre"), F.col("label").alias("its")).distinct()
    apart = found.join(known, "centre").where("label <> its")
    return apart.select(*_pair("doc_id", "centre")).distinct()


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (doc_id, text) to doc_id and the text's distinct shingles, ascending."""
    for batch in batches:
        held = pa.array([s.astype("<u8").tobytes() for s in sets(batch["text"])], pa.binary())
        yield pa.RecordBatch.from_arrays([batch["doc_id"], held], names=["doc_id", "held"])


def _meetings(one: list[dict], two: list[dict], band: int) -> Iterator[tuple[int, list[int]]]:
    """Members of a block, and those of the other in other components whose signatures make a link likely, by number."""
    registers = np.frombuffer(b"".join(m["bits"] for m in two), "<u2").reshape(-1, REGISTERS)
    label = np.array([m["label"] for m in two], np.int64)
    itself = [m["doc_id"] for m in one] == [m["doc_id"] for m in two]
    for k, m in enumerate(one):
        first = k + 1 if itself else 0
        apart = first + np.flatnonzero(label[first:] != m["label"])
        equal = registers[apart] == np.frombuffer(m["bits"], "<u2")
        likely = equal.sum(1) >= _LEAST_EQUAL
        # A pair is tried in the first band that it shares only.
        likely[likely] = equal[likely].reshape(-1, BANDS, ROWS).all(2).argmax(1) == band
        if likely.any():
            yield k, apart[likely].tolist()


def _meeting(one: list[dict], two: list[dict], band: int) -> list[int]:
    """The doc_ids of all members of two blocks that have a pair to try."""
    found = set()
    for k, others in _meetings(one, two, band):
        found.add(one[k]["doc_id"])
        found.update(two[j]["doc_id"] for j in others)
    return sorted(found)


def _forest(one: list[dict], two: list[dict], band: int, least: float) -> list[dict]:
    """Links that connect the components of two blocks' members as all their links would, each found to hold."""
    above: dict[int, int] = {}

    def head(label: int) -> int:
        while (up := above.get(label, label)) != label:
            above[label] = above.get(up, up)
            label = up
        return label

    shingled = [np.frombuffer(m["held"], "<u8") for m in two]
    out = []
    for k, others in _meetings(one, two, band):
        m = one[k]
        own = np.frombuffer(m["held"], "<u8")
        for j in others:
            x, y = head(m["label"]), head(two[j]["label"])
            other = shingled[j]
            if x == y or min(len(own), len(other)) < least * max(len(own), len(other)):
                continue
            common = len(np.intersect1d(own, other, assume_unique=True))
            if common / max(1, len(own) + len(other) - common) >= least:
                above[max(x, y)] = min(x, y)
                out.append({"a": min(m["doc_id"], two[j]["doc_id"]), "b": max(m["doc_id"], two[j]["doc_id"])})
    return out


def _met(left: pa.Array, right: pa.Array, band: pa.Array) -> pa.Array:
    rows = zip(left, right, band, strict=True)
    return pa.array([_meeting(a.as_py(), b.as_py(), k.as_py()) for a, b, k in rows], pa.list_(pa.int64()))


def _linked(left: pa.Array, right: pa.Array, band: pa.Array, least: pa.Array) -> pa.Array:
    rows = zip(left, right, band, least, strict=True)
    found = [_forest(a.as_py(), b.as_py(), k.as_py(), s.as_py()) for a, b, k, s in rows]
    return pa.array(found, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))


def _block_pairs(own: DataFrame, *carried: str) -> DataFrame:
    """band, key, and the members of two blocks of a bucket that must meet, ``one`` and ``two``, with what they carry."""
    dealt = own.groupBy("band", "key", "is_main", "block", "n_main", "n_rest").agg(F.collect_list(F.struct(*carried)).alias("members"))
    dealt = written(dealt, "blocks")
    place = ["band", "key", "is_main", "i", "j"]

    def to(last: Column, first: Column | None = None) -> Column:
        return F.sequence(F.lit(0) if first is None else first, last)

    partners = F.concat(
        F.transform(to(F.col("n_rest") - 1, F.col("block")), lambda j: F.struct(F.lit(False).alias("is_main"), j.alias("j"))),
        F.transform(to(F.col("n_main") - 1), lambda j: F.struct(F.lit(True).alias("is_main"), j.alias("j"))),
    )
    left = dealt.where("not is_main").select("band", "key", F.col("block").alias("i"), F.col("members").alias("one"), F.explode(partners).alias("with"))
    left = left.select("band", "key", "with.is_main", "i", "with.j", "one")
    lefts = to(F.when(F.col("is_main"), F.col("n_rest") - 1).otherwise(F.col("block")))
    right = dealt.select("band", "key", "is_main", F.col("block").alias("j"), F.explode(lefts).alias("i"), F.col("members").alias("two"))
    return left.join(right, place)


def rest_links(mixed_ones: DataFrame, signs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (a, b) that connect what is still apart in a bucket, each verified; not all links, but all they connect.

    The members of a bucket are dealt to blocks by a hash, its commonest component apart from the others. Blocks
    hold some 4 MB of shingles, so that their number follows from the texts' lengths, and each pair of blocks is a
    row of its own, so that a large bucket is spread over tasks; blocks of the commonest component don't meet each
    other. A pair of blocks gives fewer links than it has members.

    Blocks meet twice: first with signatures only, a tenth of the bytes, which tell the members that have a pair to
    try; then these alone, with their shingles.
    """
    own = mixed_ones.withColumn("is_main", F.col("label") == F.col("main")).join(_of(signs.select("doc_id", "bits"), mixed_ones), "doc_id")
    n_main = F.greatest(F.ceil(F.col("load_main") / _BLOCK), F.lit(1)).cast("int")
    n_rest = F.greatest(F.ceil((F.col("load") - F.col("load_main")) / _BLOCK), F.lit(1)).cast("int")
    own = own.withColumns({"n_main": n_main, "n_rest": n_rest})
    own = own.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.when(F.col("is_main"), F.col("n_main")).otherwise(F.col("n_rest"))).cast("int"))
    own = written(own, "dealt")

    met = F.arrow_udf(_met, "array<bigint>").asNondeterministic()
    tried = _block_pairs(own, "doc_id", "label", "bits").select("band", "key", F.explode(met("one", "two", "band")).alias("doc_id"))
    tried = written(tried.distinct(), "tried")
    held = _of(texts, tried).mapInArrow(digest_rows, "doc_id long, held binary").dropDuplicates(["doc_id"])
    own = own.join(tried, ["band", "key", "doc_id"], "left_semi").join(held, "doc_id")
    linked = F.arrow_udf(_linked, "array<struct<a: bigint, b: bigint>>").asNondeterministic()
    links = _block_pairs(own, "doc_id", "label", "bits", "held").select(F.explode(linked("one", "two", "band", F.lit(float(least)))).alias("p"))
    return links.select("p.a", "p.b").distinct()


def representatives(keys: DataFrame) -> DataFrame:
    """Distinct doc_id, rep: the least doc_id with a text's key (k, l), for each text of a doc_id.

    Only texts that are there more than once are joined, with one row for each; written, their size tells Spark whether
    to broadcast them, and otherwise it can split the rows of a large group of copies.
    """
    copied = keys.groupBy("k", "l").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    return keys.join(written(copied, "copied"), ["k", "l"], "left").select("doc_id", F.coalesce("rep", "doc_id").alias("rep")).distinct()


def near_copies(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Per row of ``docs``: doc_id and class_id, the least doc_id of its class.

    Equal texts are in one class, and so are texts with at least ``least`` of their distinct five-word shingles in
    common, directly or by a chain. Words are runs of letters and digits, case aside; a text of fewer than five
    words is one shingle, one without words is like equal texts only. A null text is an empty one. Rows that share
    a doc_id share a class; a null doc_id gets a null class. Other columns are ignored.

    Copies are put aside before signatures meet. Each text is first tried with one centre of its buckets only, then
    with the other centres it isn't connected with; what is then still apart is tried in blocks (``rest_links``), which
    give verified links only, and no more than connect what they hold. No link between texts of a bucket that would
    join two classes is lost, and no group's pairs are listed.
    """
    spark = docs.sparkSession
    ready(spark)
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.lower(whole_text()).alias("text"))
    raw = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    keys = written(raw.select("doc_id", F.xxhash64("text").alias("k"), F.xxhash64(F.lit(6), "text").alias("l")), "keys")
    reps = written(representatives(keys), "reps")

    signs = texts.mapInArrow(signature_rows, "doc_id long, bands array<long>, bits binary, size long")
    alone = reps.where("doc_id = rep").select("doc_id").distinct()
    signs = written(signs.join(alone, "doc_id", "left_semi").dropDuplicates(["doc_id"]), "signatures")
    rows = signs.select("doc_id", "size", F.posexplode("bands").alias("band", "key"))
    buckets = rows.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(rows.join(buckets, ["band", "key"]), "members")

    same_id = reps.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
    edges = written(verified(first_pairs(members), texts, least).union(same_id), "links")
    labels = components(edges)
    steps = (
        lambda apart: verified(centre_pairs(apart), texts, least),
        lambda apart: rest_links(apart, signs, texts, least),
    )
    for step in steps:
        more = written(step(written(mixed_buckets(members, labels), "mixed")), "links")
        if not more.isEmpty():
            labels = merged(labels, more)
    found = reps.groupBy("doc_id").agg(F.min("rep").alias("rep")).join(labels.withColumnRenamed("node", "rep"), "rep", "left")
    found = found.select("doc_id", F.coalesce("label", "rep").alias("class_id"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id")).join(found, "doc_id", "left")


def one_of_each(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of its class, and those with a null doc_id, with all columns.

    The rows to leave out are far fewer than those kept; written, their size tells Spark whether to broadcast them.
    """
    copies = near_copies(docs, least).where("doc_id <> class_id").select(F.col("doc_id").alias("_copy")).distinct()
    return docs.join(written(copies, "copies"), F.col("doc_id").cast("long") == F.col("_copy"), "left_anti")

"""Best-fit packing of documents into bins of fixed size, with conflicts.

Items are dealt to groups by a hash, and each group is packed on its own: longest items first, each into the bin
with the least room that still holds it. Bins are kept in order of their room; the search starts at the first bin
with room enough and goes on through its successors until one has neither the item's source nor its duplicate
cluster, which bitmaps tell. So the bin found is the tightest compatible one.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal_exposure.llm.common import ready, whole_text

PLACED = "doc_id long, piece int, pieces int, bin_id long, start int, length int, source string"


def n_words(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))


def same_words(text: Column) -> Column:
    """A key that texts share which differ in case, marks and white space only."""
    return F.xxhash64(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def best_fit(lengths: list[int], sources: list[int], clusters: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, start) of each item; ``sources`` and ``clusters`` number what may be in a bin only once (-1: no matter)."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    rooms: list[tuple[int, int]] = []  # (room, bin), ascending
    held_sources: list[int] = []
    held_clusters: list[int] = []
    placed = [(0, 0)] * len(lengths)
    for i in order:
        source = 1 << sources[i] if sources[i] >= 0 else 0
        cluster = 1 << clusters[i] if clusters[i] >= 0 else 0
        for at in range(bisect_left(rooms, (lengths[i], -1)), len(rooms)):
            room, b = rooms[at]
            if not (held_sources[b] & source or held_clusters[b] & cluster):
                del rooms[at]
                break
        else:
            room, b = capacity, len(held_sources)
            held_sources.append(0)
            held_clusters.append(0)
        held_sources[b] |= source
        held_clusters[b] |= cluster
        placed[i] = (b, capacity - room)
        insort(rooms, (room - lengths[i], b))
    return placed


def pack(docs: DataFrame, length: Column, cluster: Column, capacity: int = 1024, group_items: int = 2048) -> DataFrame:
    """Place every row of ``docs`` (doc_id, source) into bins of ``capacity``.

    ``length`` is an item's size and ``cluster`` its duplicate cluster, both over the columns of ``docs``. A row
    longer than a bin is cut into pieces: full ones, which fill a bin each, and the rest, which is packed. One row
    out per piece: doc_id, piece (from 0), pieces, bin_id, start in the bin, length, source. No bin has two items of
    one source or of one cluster; a null source is a source of its own, a null cluster is no conflict. Items of no
    length take a place but no room. A repeated row is placed each time; an empty table gives no bin. Groups have
    ``group_items`` items on average, by a hash of doc_id and piece, so no source or cluster makes a group large.
    """
    ready(docs.sparkSession)
    groups = max(1, math.ceil(docs.select("doc_id").count() / group_items))
    items = docs.select("doc_id", F.col("source").cast("string").alias("source"), length.alias("n"), cluster.alias("cluster"))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("int")
    items = items.withColumn("pieces", pieces).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    items = items.withColumn("length", F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int"))
    group = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int")
    items = items.select(group.alias("grp"), "doc_id", "piece", "pieces", "length", "source", "cluster")

    def place(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "length", "cluster"], ignore_index=True)
        sources = pd.factorize(rows["source"], use_na_sentinel=False)[0]
        clusters = pd.factorize(rows["cluster"])[0]
        found = best_fit(rows["length"].tolist(), sources.tolist(), clusters.tolist(), capacity)
        bins = [(int(key[0]) << 32) + b for b, _ in found]
        return rows.assign(bin_id=bins, start=[s for _, s in found])[[c.split()[0] for c in PLACED.split(", ")]]

    return items.groupBy("grp").applyInPandas(place, PLACED)


def pack_texts(docs: DataFrame, capacity: int = 1024, group_items: int = 2048) -> DataFrame:
    """``pack`` by words, with texts that differ in case and marks only as duplicates."""
    rows = docs.select("doc_id", "source", whole_text().alias("text"))
    return pack(rows, n_words(F.col("text")), same_words(F.col("text")), capacity, group_items)

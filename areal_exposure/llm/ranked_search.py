"""Ranked search by pipelined term partitioning: bundles of items carry accumulators from one owner of terms to the next.

Each task turns the documents that it reads into blocks, with postings per block and term. Terms are dealt to owners
by how many documents hold them, the rarest first. In one stage per owner, a cogroup by block and bundle brings the
owner's postings to the bundles' accumulators (positions in the block and integer scores), adds what the owner's terms
give, and hands them on. An accumulator goes on only while its score and the most that later owners can give reach the
item's k-th best score so far, so the common terms near the end add to few documents; no result is lost by that.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from areal_exposure.llm.common import ready, whole_text
from areal_exposure.sources.scratch import written

#: Letters beyond ASCII, ASCII letters and digits; what lies between such runs separates them.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))

#: A block ends at so many documents, or words.
BLOCK_DOCS, BLOCK_WORDS = 8192, 4_000_000
#: Items of a bundle, about.
BUNDLE = 256
#: An owner's terms are in at most this share of documents; a last owner has the rest.
OWNERS = (0.001, 0.01, 0.1)
#: Above so many terms of items, or their bytes, tasks aren't sent them and keep postings of all terms.
_SENT_TERMS, _SENT_BYTES = 500_000, 16_000_000


def _postings(batches: Iterator[pa.RecordBatch], wanted: frozenset[bytes] | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    blocks = 0

    def block() -> pa.RecordBatch:
        terms = list(held)
        pairs = [np.array(held[t], "<u4").reshape(-1, 2) for t in terms]
        columns = [
            [(task << 24) + blocks] * (len(terms) + 1),
            [None, *(t.decode() for t in terms)],
            [len(sizes), *map(len, pairs)],
            [np.array(sizes, "<u4").tobytes(), *(np.ascontiguousarray(p[:, 0]).tobytes() for p in pairs)],
            [None, *(np.ascontiguousarray(p[:, 1]).tobytes() for p in pairs)],
            [int(np.count_nonzero(sizes)), *[None] * len(terms)],
            [sum(sizes), *[None] * len(terms)],
            [0, *(int(p[:, 1].max()) for p in pairs)],
            [ids, *[None] * len(terms)],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    held: dict[bytes, list[int]] = defaultdict(list)
    ids, sizes, words = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            found = text.as_py().encode().translate(_BYTES).split()
            counts = Counter(found)
            for t in counts if wanted is None else wanted.intersection(counts):
                held[t] += (len(ids), counts[t])
            ids.append(doc_id.as_py())
            sizes.append(len(found))
            words += len(found)
            if len(ids) >= BLOCK_DOCS or words >= BLOCK_WORDS:
                yield block()
                held, ids, sizes, words, blocks = defaultdict(list), [], [], 0, blocks + 1
    if ids:
        yield block()


def postings(docs: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """Inverted blocks of documents, of the given terms only if they are few enough to be sent to tasks.

    Columns block, term, n_docs, at (positions in the block) and tf (both little-endian 32-bit integers), most (the
    highest tf). A row without term describes the block: at has the number of words of each document, ids their doc_ids,
    n_held and n_words count documents with a word and all words. Block numbers follow the
    tasks, so write the table before reading it twice.
    """
    spark = docs.sparkSession
    ready(spark)
    sent = None
    if terms is not None:
        size = terms.agg(F.count("*").alias("n"), F.sum(F.octet_length("term")).alias("bytes")).first()
        if size["n"] <= _SENT_TERMS and (size["bytes"] or 0) <= _SENT_BYTES:
            sent = spark.sparkContext.broadcast(frozenset(r["term"].encode() for r in terms.toLocalIterator()))
    schema = T.StructType.fromDDL("block long, term string, n_docs long, at binary, tf binary, n_held long, n_words long, most long")
    schema.add("ids", T.ArrayType(docs.schema["doc_id"].dataType))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        return _postings(batches, sent.value if sent else None, to_arrow_schema(schema))

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(build, schema)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and its terms, once each; rows of one item_id make one item, and a null item_id is an item too."""
    found = F.regexp_extract_all(F.translate(whole_text(), _UPPER, _LOWER), F.lit(TERM), F.lit(0))
    return items.select("item_id", F.explode(found).alias("term")).distinct()


_STATE = "block long, bundle long, item long, at binary, score binary, best array<long>"


def _visit(documents: int, words: int, k: int, last: bool):
    """The function of one stage: an owner's postings of a block meet a bundle's accumulators for it."""

    def visit(carried: pd.DataFrame, owned: pd.DataFrame) -> pd.DataFrame:
        block = owned[owned["term"].isna()]
        posted = owned[owned["term"].notna()]
        scores, rest = {}, {}
        if len(posted):
            sizes = np.frombuffer(block["at"].iloc[0], "<u4").astype(np.int64)
            m = 10 + (90 * sizes * documents) // words
            for at, tf, weight, asked in zip(posted["at"], posted["tf"], posted["weight"], posted["asked"], strict=True):
                at, tf = np.frombuffer(at, "<u4"), np.frombuffer(tf, "<u4").astype(np.int64)
                given = int(weight) * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[at]))
                for one in asked:
                    item = one["item"]
                    if item not in scores:
                        scores[item], rest[item] = np.zeros(len(m), np.int64), (one["later"], one["least"])
                    scores[item][at] += given
        rows = []
        for item, at, score in zip(carried["item"], carried["at"], carried["score"], strict=True):
            if item in scores:
                scores[item][np.frombuffer(at, "<u4")] += np.frombuffer(score, "<i8")
            else:
                rows.append((item, np.frombuffer(at, "<u4"), np.frombuffer(score, "<i8")))
        for item, dense in scores.items():
            later, least = rest[item]
            at = np.flatnonzero(dense > 0)
            score = dense[at]
            if len(score) >= k:
                least = max(least, int(np.partition(score, len(score) - k)[len(score) - k]))
            kept = score + later >= least
            rows.append((item, at[kept].astype("<u4"), score[kept]))
        if last:
            rows = [(item, at, score, np.sort(score)[::-1][:k]) for item, at, score in rows]
            rows = [(item, at[score >= best[-1]], score[score >= best[-1]], best) for item, at, score, best in rows if len(best)]
        else:
            rows = [(item, at, score, np.sort(score)[::-1][:k]) for item, at, score in rows if len(at)]
        where = owned if len(owned) else carried
        out = [(where["block"].iloc[0], where["bundle"].iloc[0], item, at.tobytes(), score.tobytes(), best) for item, at, score, best in rows]
        return pd.DataFrame(out, columns=["block", "bundle", "item", "at", "score", "best"])

    return visit


def _opened(documents: int, words: int, k: int):
    """The first stage: bundles start here, without accumulators."""
    visit = _visit(documents, words, k, False)
    empty = pd.DataFrame({c: [] for c in ("block", "bundle", "item", "at", "score", "best")})
    return lambda owned: visit(empty, owned)


def _least(carried: DataFrame, k: int) -> DataFrame:
    """Each item's k-th best score so far, where there are k."""
    ranked = carried.select("item", F.explode("best").alias("score"))
    order = Window.partitionBy("item").orderBy(F.desc("score"))
    first = ranked.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return first.groupBy("item").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).drop("n")


def top_documents(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` documents with the highest scores for each item: item_id, rank from 1, doc_id, score.

    Every row of ``docs`` is a document, so a repeated row takes a rank of its own; rows of equal scores are ranked by
    doc_id (null first). A null or empty text has no term and is never found; an item without known terms has no rows.
    Only doc_id, text and item_id are read. With N documents that have a term, L terms in all, n in the document and df
    documents with the term, a term adds ``w * (10^9 tf div (1000 tf + 8 m))``, where w is
    ``floor(1000 ln((2 N + 2) / (2 df + 1)))`` and m is ``10 + 90 n N div L``. Memory of a task is bounded by a block's
    postings and the accumulators of a bundle for it.
    """
    spark = docs.sparkSession
    result = T.StructType([T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("rank", T.IntegerType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("score", T.LongType())])
    asked = written(item_terms(items), "item-terms")
    inverted = written(postings(docs, asked.select("term").distinct()), "postings")
    blocks = inverted.where(F.col("term").isNull())
    totals = blocks.agg(F.sum("n_held").alias("documents"), F.sum("n_words").alias("words")).first()
    documents, words = totals["documents"] or 0, totals["words"] or 0
    if not words:
        return spark.createDataFrame([], result)

    route, bundles = _routes(asked, inverted, documents)
    states = None
    for owner in range(len(OWNERS) + 1):
        here = route.where(F.col("owner") == owner)
        least = F.lit(1).cast("long")
        if states is not None:
            here = here.join(_least(states, k), "item", "left")
            least = F.greatest(F.coalesce("least", F.lit(1)), F.lit(1)).cast("long")
        one = F.struct("item", "later", least.alias("least"))
        here = here.groupBy("term", "bundle", "weight").agg(F.collect_list(one).alias("asked"))
        owned = inverted.where(F.col("term").isNotNull()).join(here, "term").select("block", "bundle", "term", "at", "tf", "weight", "asked")
        all_bundles = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bundles - 1).cast("long")))
        each = blocks.select("block", all_bundles.alias("bundle"), "term", "at")
        owned = owned.unionByName(each, allowMissingColumns=True)
        if states is None:
            grouped = owned.groupBy("block", "bundle").applyInPandas(_opened(documents, words, k), _STATE)
        else:
            function = _visit(documents, words, k, owner == len(OWNERS))
            grouped = states.groupBy("block", "bundle").cogroup(owned.groupBy("block", "bundle")).applyInPandas(function, _STATE)
        states = written(grouped, f"owner-{owner}")
    return _selected(spark, states, blocks, route, k).select(*result.names)


def _routes(asked: DataFrame, inverted: DataFrame, documents: int) -> tuple[DataFrame, int]:
    """Per item and term: bundle, owner, weight, and the most that later owners can add; and how many bundles there are."""
    known = inverted.where(F.col("term").isNotNull()).groupBy("term").agg(F.sum("n_docs").alias("df"), F.max("most").alias("most"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1)))
    owner = sum((F.col("df") > share * documents).cast("int") for share in OWNERS)
    # a document's m is 10 at least
    highest = F.expr("weight * ((1000000000 * most) div (1000 * most + 80))")
    weighed = known.select("term", weight.cast("long").alias("weight"), owner.alias("owner"), "most").withColumn("highest", highest)
    numbered = written(asked.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    bundles = max(1, -(-numbered.count() // BUNDLE))
    number = F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("long")
    terms = asked.join(numbered, asked["item_id"].eqNullSafe(numbered["item_id"])).select(asked["item_id"], "item", number.alias("bundle"), "term")
    later = Window.partitionBy("item").orderBy(F.desc("owner")).rangeBetween(Window.unboundedPreceding, -1)
    route = terms.join(weighed.where("weight > 0"), "term").withColumn("later", F.coalesce(F.sum("highest").over(later), F.lit(0)).cast("long"))
    return written(route.drop("most", "highest"), "routes"), bundles


def _selected(spark: SparkSession, states: DataFrame, blocks: DataFrame, route: DataFrame, k: int) -> DataFrame:
    """The best of all blocks, with their doc_ids."""
    schema = "block long, item long, position int, score long"

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            n = [len(x) // 4 for x in rows["at"]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array(rows["block"], np.int64), n)),
                    pa.array(np.repeat(np.array(rows["item"], np.int64), n)),
                    pa.array(np.frombuffer(b"".join(rows["at"]), "<u4").astype(np.int32)),
                    pa.array(np.frombuffer(b"".join(rows["score"]), "<i8")),
                ],
                names=["block", "item", "position", "score"],
            )

    best = states.select("block", "item", "at", "score").mapInArrow(unpacked, schema)
    best = best.join(_least(states, k), "item", "left").where(F.col("score") >= F.coalesce("least", F.lit(1)))
    named = best.join(blocks.select("block", "ids"), "block").select("item", "score", F.get("ids", F.col("position")).alias("doc_id"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(route.select("item", "item_id").distinct(), "item")

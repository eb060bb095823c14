"""Token ids in blocks of byte-aligned variable-length codes, and back.

File format: Parquet files in one folder, one row per block of whole documents in ascending doc_id order. Ids are
replaced by their rank of frequency over the whole corpus, so that common ids take one byte. A rank takes one to
four little-endian bytes; its length less one is two bits of the block's control bytes (four ranks to a byte, the
first in the lowest bits), which stand apart from the data bytes. The table ``ranks`` beside the blocks has the
id of each rank. A block also has the doc_ids, the number of tokens of each document, the range partition it was
written from and the number of tokens before it in that partition.
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from areal_exposure.llm.common import ready, whole_text

_HEAD = "part long, block long, before long, doc_ids array<long>, counts array<long>"
DRAFT, BLOCK = f"{_HEAD}, ids binary", f"{_HEAD}, control binary, data binary"
BLOCK_NAMES = ["part", "block", "before", "doc_ids", "counts", "control", "data"]
#: White space to str and Arrow that is none to the tokenizer.
_ODD_SPACE = "[\x1c-\x1f]"
#: Marks that end words in prose: a run of them is a token of its own to the tokenizer's splitting rule.
_TAIL = ",.!%#$&*?;:"


class Encoder:
    """Whole texts to ids by the tokenizers library, each word once for as long as it is remembered.

    The tokenizer drops white space and merges nothing across it, so a text's ids are those of its words in turn.
    The distinct words of a batch are found by Arrow; the ids of a new word come from the library.
    """

    def __init__(self, file: str, remembered: int = 700_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.known: dict[str, bytes] = {}
        self.remembered = remembered
        self.by_word = self._drops_space()

    def _drops_space(self) -> bool:
        """Whether the tokenizer's own file has the rules that words rely on; else texts are encoded whole."""
        rules = json.loads(self.tokenizer.to_str())
        steps = (rules["normalizer"] or {}).get("normalizers", ())
        cuts = [c for c in (rules["pre_tokenizer"] or {}).get("pretokenizers", ()) if c["type"] == "Split"]
        return (
            [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and steps[1]["pattern"] == {"Regex": "\\s+"}
            and [(c["behavior"], c["invert"]) for c in cuts] == [("Removed", True)]
            and cuts[0]["pattern"]["Regex"].endswith("[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+")
            and not any(" " in t["content"] for t in rules["added_tokens"])
        )

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        if not len(texts):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if not self.by_word or pc.any(pc.match_substring_regex(texts, _ODD_SPACE)).as_py():
            whole = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            counts = np.array([len(e.ids) for e in whole], dtype=np.int64)
            return np.fromiter(chain.from_iterable(e.ids for e in whole), "<u4", counts.sum()), counts
        cut = pc.utf8_split_whitespace(texts)
        words = cut.flatten().dictionary_encode()
        pool, sizes = self._pool(words.dictionary)
        word = words.indices.to_numpy()
        each = sizes[word]
        ids = _taken(pool, (np.cumsum(sizes) - sizes)[word], each)
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(each)])
        upto = ends[np.cumsum([0, *pc.list_value_length(cut).to_pylist()])]
        return ids, np.diff(upto)

    def _pool(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct ``words`` in a row, and how many each has.

        Words of ASCII letters that differ in case or in the marks at their end only are looked up once, and the marks
        apart; all other words as they are.
        """
        core = pc.utf8_rtrim(words, characters=_TAIL)
        alike = pc.match_substring_regex(core, "^[A-Za-z]+$")
        tail = pc.if_else(alike, pc.replace_substring_regex(words, "^[A-Za-z]+", ""), "")
        parts = pa.concat_arrays([pc.if_else(alike, pc.ascii_lower(core), words), tail]).dictionary_encode()
        known, sizes = self._looked_up(parts.dictionary.to_pylist())
        both = parts.indices.to_numpy().reshape(2, -1).T.ravel()  # each word's letters, then its marks
        each = sizes[both]
        return _taken(known, (np.cumsum(sizes) - sizes)[both], each), each.reshape(-1, 2).sum(1)

    def _looked_up(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct ``parts`` of words in a row, and how many each has."""
        found = list(map(self.known.get, parts))
        if len(self.known) > self.remembered:  # what this batch doesn't need is forgotten
            self.known = {w: x for w, x in zip(parts, found, strict=True) if x is not None}
        if None in found:
            new = [w for w, x in zip(parts, found, strict=True) if x is None]
            for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                self.known[w] = array("I", e.ids).tobytes()
            found = list(map(self.known.__getitem__, parts))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        return np.frombuffer(b"".join(found), dtype="<u4"), sizes


def _taken(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The stretches of ``pool`` from ``starts`` on, one after the other."""
    ends = np.cumsum(sizes)
    return pool[np.repeat(starts - (ends - sizes), sizes) + np.arange(len(ends) and ends[-1])]


@cache
def _encoder(file: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(file)


def with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """``end_id`` after the ids of each text."""
    return np.insert(ids, np.cumsum(counts), end_id), counts + 1


def id_counts(drafts: DataFrame) -> DataFrame:
    """How often each id occurs in ``drafts``; at most one row per id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for ids in batch["ids"]:
                found = np.bincount(_narrow(ids.as_buffer()))
                total = np.pad(total, (0, max(0, len(found) - len(total))))
                total[: len(found)] += found
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])

    return drafts.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _narrow(held: pa.Buffer) -> np.ndarray:
    """A draft's ids: the first byte is the width of the rest."""
    kind = {2: "<u2", 4: "<u4"}[held[0]]
    return np.frombuffer(held, dtype=kind, offset=held[0])


def coded(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of ``ranks``."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    four = np.zeros(-(-len(ranks) // 4) * 4, dtype=np.uint8)
    four[: len(ranks)] = size - 1
    control = four[0::4] | four[1::4] << 2 | four[2::4] << 4 | four[3::4] << 6
    kept = np.arange(4, dtype=np.uint8) < size[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[kept].tobytes()


#: The lengths of four codes for each control byte.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + 1


def decoded(control: bytes, data: bytes, count: int) -> np.ndarray:
    """The ``count`` ranks of control and data bytes, by table lookup."""
    size = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:count]
    at = np.cumsum(size, dtype=np.int64) - size
    held = np.concatenate([np.frombuffer(data, dtype=np.uint8), np.zeros(3, np.uint8)])
    ranks = held[at].astype(np.uint32)
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        if len(longer):
            ranks[longer] |= held[at[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def write_ids(docs: DataFrame, folder: str, file: str, end_id: int, block_tokens: int = 1 << 20) -> None:
    """Encode all texts of ``docs`` and write them to ``folder`` in the format above, in ascending doc_id order.

    A null or empty text is only its end id. Rows with the same doc_id stand side by side, by their text; a null
    doc_id comes first. No document is cut: a block is closed once it has ``block_tokens`` tokens. Texts are
    encoded once, into draft blocks below ``folder``; the ids of the whole corpus are counted there, and the
    drafts then rewritten by rank. Only the ranks, at most one number for each id of the vocabulary, pass
    through the driver.
    """
    spark = docs.sparkSession
    ready(spark)
    texts = docs.select("doc_id", whole_text().alias("text"))
    ordered = texts.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    drafts = ordered.mapInArrow(_drafts(file, end_id, block_tokens), DRAFT)
    drafts.write.option("compression", "zstd").parquet(f"{folder}/drafts")
    drafts = spark.read.parquet(f"{folder}/drafts")
    ranked = id_counts(drafts).orderBy(F.desc("n"), "id").select("id")
    by_rank = [r["id"] for r in ranked.toLocalIterator()]
    spark.createDataFrame(list(enumerate(by_rank)), "rank long, id long").coalesce(1).write.parquet(f"{folder}/ranks")
    table = np.zeros(max(by_rank, default=0) + 1, dtype=np.uint32)
    table[by_rank] = np.arange(len(by_rank))
    rank_of = spark.sparkContext.broadcast(table)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                control, data = coded(rank_of.value[_narrow(row["ids"][0].as_buffer())])
                kept = [row[c] for c in ("part", "block", "before", "doc_ids", "counts")]
                made = [pa.array([v], pa.binary()) for v in (control, data)]
                yield pa.RecordBatch.from_arrays(kept + made, names=BLOCK_NAMES)

    drafts.mapInArrow(finish, BLOCK).write.parquet(f"{folder}/blocks")


def _drafts(file: str, end_id: int, block_tokens: int):
    """From sorted (doc_id, text) to blocks of ids, each with the tokens before it in its partition."""

    def drafts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, counts, held, size = [], [], [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                ids, each = with_end(*_encoder(file).ids(batch["text"]), end_id)
                doc_ids.append(batch["doc_id"])
                counts.append(each)
                held.append(ids)
                size += len(ids)
            if size and (batch is None or size >= block_tokens):
                ids = np.concatenate(held)
                width = 2 if ids.max() < 1 << 16 else 4
                packed = bytes([width] * width) + ids.astype(f"<u{width}").tobytes()
                row = [part, block, before, pa.concat_arrays(doc_ids).to_pylist(), np.concatenate(counts).tolist(), packed]
                kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.binary()]
                columns = [pa.array([v], k) for v, k in zip(row, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=[*BLOCK_NAMES[:5], "ids"])
                block, before, doc_ids, counts, held, size = block + 1, before + size, [], [], [], 0

    return drafts


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Per document written to ``folder``: doc_id, start (ids of all documents before it) and its ids as binary.

    ``ids`` are little-endian unsigned 32-bit integers, the end id included.
    """
    ready(spark)
    by_rank = [r["id"] for r in spark.read.parquet(f"{folder}/ranks").orderBy("rank").toLocalIterator()]
    id_of = spark.sparkContext.broadcast(np.array(by_rank, dtype="<u4"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["counts"], dtype=np.int64)
                ids = id_of.value[decoded(row["control"], row["data"], int(counts.sum()))].tobytes()
                ends = np.cumsum(counts)
                starts = ends - counts
                for k in range(0, len(counts), 4096):
                    cut = slice(k, k + 4096)
                    spans = zip(starts[cut], ends[cut], strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["part"]] * len(counts[cut]), pa.int64()),
                            pa.array(row["doc_ids"][cut], pa.int64()),
                            pa.array(row["before"] + starts[cut]),
                            pa.array([ids[4 * a : 4 * b] for a, b in spans], pa.binary()),
                        ],
                        names=["part", "doc_id", "start_in_part", "ids"],
                    )

    blocks = spark.read.parquet(f"{folder}/blocks")
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, n: a + n)).alias("size"))
    # One row per range partition of the writer, so the running sum is short and may be sent to all.
    bases = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("base"))
    rows = blocks.mapInArrow(decode, "part long, doc_id long, start_in_part long, ids binary")
    return rows.join(F.broadcast(bases), "part").select(
        "doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "ids"
    )


def id_digests(ids: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of each document's ids, from ``read_ids``."""
    return ids.select(
        "doc_id",
        "start",
        F.expr("cast(octet_length(ids) div 4 as long)").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def crc32_of(ids: np.ndarray) -> int:
    """What ``id_digests`` gives, of one document's ids."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())

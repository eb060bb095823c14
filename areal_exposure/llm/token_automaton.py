"""Byte-pair encoding by a finite automaton over tokens, and decoding by its arcs' labels.

At first one state accepts every sequence of byte tokens. Each merge ``u v`` is then put in as a gadget, in order
of rank: the state that arcs ``u`` lead to is replaced by a copy of it without its arc ``v``, and every state with an
arc ``u`` gets an arc ``uv`` to where ``v`` led. In the end the automaton accepts each text by exactly one path,
the one that applying the merges in order would give. All arcs of one token lead to one state, so a state
is named by the token before it, and a copy keeps only what it lost and when: an arc is there unless it, or an arc
that it was built upon, was lost before that. Looked-up arcs are kept in a table.

A word is encoded by transitions alone: the longest token that fits and has an arc, going back where none has.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from areal_exposure.llm.common import ready, whole_text

#: Characters of which any version of Unicode says the same class, for splitting by ``regex``; others go to the library.
_SETTLED = regex.compile(r"[\x00-\u052f\u2000-\u206f\u20a0-\ua6ff]*+")
#: How byte-level tokenizers split a text into words (a published pattern that must match).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept encoded per Python process, and the longest of them.
_KEPT, _KEPT_CHARS = 400_000, 64
#: Arcs kept in the table.
_ARCS = 2_000_000


class Automaton:
    """States and arcs from merges (left, right, merged), lowest rank first, over byte tokens."""

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self.width = max(labels, default=0) + 1
        parts = {merged: (u, v) for u, v, merged in merges}
        self.token = {label: t for t, label in labels.items() if t not in parts}
        self.left = {t: -1 for t in self.token.values()}
        self.right, self.rank = dict(self.left), {t: -1 for t in self.left}
        self.lost: dict[int, int] = {}
        self.table: dict[int, bool] = {}
        for rank, (u, v, merged) in enumerate(merges):
            self._gadget(rank, u, v, merged)
        self.table.clear()
        self.longest = max(map(len, self.token), default=0)
        self.shorter = {t: self._before(label) for label, t in self.token.items()}

    def _gadget(self, rank: int, u: int, v: int, merged: int) -> None:
        if u not in self.left or v not in self.left or not self._built(u, v):
            return  # no path u v is left, so the merged token is never used
        if merged in self.left:
            raise ValueError("two merges make the same token")
        self.lost[u * self.width + v] = rank
        self.left[merged], self.right[merged], self.rank[merged] = u, v, rank
        self.token[self.labels[merged]] = merged

    def _before(self, label: bytes) -> int:
        """The longest token that a label starts with, other than itself."""
        return next((t for k in range(len(label) - 1, 0, -1) if (t := self.token.get(label[:k])) is not None), -1)

    def _built(self, u: int, t: int) -> bool:
        """Whether the state after ``u`` has an arc ``t``, from what it and the states it was copied from lost."""
        copied = 1 << 62  # when the state was copied from that after u
        while u >= 0:
            added, x = 1 << 62, t  # when the arc was built upon arc x
            while x >= 0:
                gone = self.lost.get(u * self.width + x)
                if gone is not None and gone < copied and gone <= added:
                    return False
                added, x = self.rank[x], self.left[x]
            copied, u = self.rank[u], self.right[u]
        return True

    def arc(self, u: int, t: int) -> bool:
        key = u * self.width + t
        found = self.table.get(key)
        if found is None:
            if len(self.table) >= _ARCS:
                self.table.clear()
            found = self.table[key] = self._built(u, t)
        return found

    def path(self, word: bytes) -> list[int]:
        """The tokens of the one accepting path that spells ``word``."""
        whole = self.token.get(word)
        if whole is not None:
            return [whole]
        out: list[int] = []
        labels, dead = self.labels, set()
        at, state, t = 0, -1, self._longest(word, 0)
        while at < len(word):
            while t >= 0 and ((dead and at + len(labels[t]) in dead) or (state >= 0 and not self.arc(state, t))):
                t = self.shorter[t]
            if t >= 0:
                out.append(t)
                at, state = at + len(labels[t]), t
                t = self._longest(word, at)
            else:
                if not out:
                    raise ValueError("the tokens don't cover all bytes")
                dead.add(at)
                t = out.pop()
                at, state, t = at - len(labels[t]), out[-1] if out else -1, self.shorter[t]
        return out

    def _longest(self, word: bytes, at: int) -> int:
        token = self.token
        for end in range(min(len(word), at + self.longest), at, -1):
            if (piece := word[at:end]) in token:
                return token[piece]
        return -1


class _Kept(dict):
    """What ``find`` gives for a piece of text, worked out when first asked for and kept if the piece is short."""

    def __init__(self, find: Callable[[str], bytes]):
        super().__init__()
        self.find = find

    def __missing__(self, piece: str) -> bytes:
        found = self.find(piece)
        if len(piece) <= _KEPT_CHARS:
            if len(self) >= _KEPT:
                self.clear()
            self[piece] = found
        return found


class Tokenizer:
    """Encodes and decodes texts as a byte-level tokenizer file says."""

    def __init__(self, file: str):
        import tokenizers

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        split, model, added = spec["pre_tokenizer"], spec["model"], spec["added_tokens"]
        plain = split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not spec["normalizer"]
        if not plain or model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
            raise ValueError("only plain byte-level pair encodings are known")
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] for a in added):
            raise ValueError("added tokens must be plain strings")
        byte = byte_of_sign()
        specials = {a["id"]: a["content"].encode() for a in added}
        spelled = {t: bytes(byte[c] for c in sign) for sign, t in model["vocab"].items() if t not in specials}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids = model["vocab"]
        self.automaton = Automaton(spelled, [(ids[a], ids[b], ids[a + b]) for a, b in pairs])
        self.labels = spelled | specials
        self.special = {a["content"]: np.array([a["id"]], "<u4").tobytes() for a in added}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if added else None
        self.splitter = tokenizers.Tokenizer.from_file(file).pre_tokenizer
        self.pattern, self.words = regex.compile(WORDS), _Kept(self._word)
        self.first, self.spaced = _Kept(self._stretch), _Kept(lambda stretch: self._stretch(" " + stretch))

    def split(self, text: str) -> list[str]:
        if _SETTLED.fullmatch(text):
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def _word(self, word: str) -> bytes:
        return np.array(self.automaton.path(word.encode()), "<u4").tobytes()

    def _stretch(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.split(text)))

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian 32-bit integers; the strings of added tokens become their ids."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        return b"".join(self.special[part] if part in self.special else self._plain(part) for part in self.cut.split(text) if part)

    def _plain(self, text: str) -> bytes:
        """A word always starts at a blank before a character that isn't white space, so the text is cut there.

        A stretch that is empty or starts with white space belongs to the one before it.
        """
        first, *rest = text.split(" ")
        if not rest:
            return self.first[first]
        if "" in rest or not all(map(str.isprintable, rest)):
            joined = [first]
            for part in rest:
                if part and not part[0].isspace():
                    joined.append(part)
                else:
                    joined[-1] += " " + part
            first, *rest = joined
        return self.first[first] + b"".join(map(self.spaced.__getitem__, rest))

    def decode(self, ids: bytes) -> str:
        labels = self.labels
        return b"".join([labels[t] for t in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def byte_of_sign() -> dict[str, int]:
    """Byte-level vocabularies write printable Latin-1 bytes as themselves and the others, in order, from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + k): b for k, b in enumerate(hidden)}


@cache
def _tokenizer(file: str) -> Tokenizer:
    return Tokenizer(file)


def encoded(docs: DataFrame, file: str) -> DataFrame:
    """Per row of ``docs``: doc_id, and ``ids``, a binary of little-endian 32-bit ids of the whole text.

    Null and empty texts have no ids. Every row gives one row, repeated ones too; other columns are ignored.
    ``file`` is a byte-level tokenizer file that every executor has. Rows stay where they are read.
    """
    ready(docs.sparkSession)

    @F.arrow_udf("binary")
    def ids(texts: pa.Array) -> pa.Array:
        encode = _tokenizer(file).encode
        return pa.array([encode(t) for t in texts.to_pylist()], pa.binary())

    return docs.select("doc_id", ids(whole_text()).alias("ids"))


def decoded(ids: DataFrame, file: str) -> DataFrame:
    """Per row of ``ids`` (doc_id, ids): doc_id, and the text that the arcs' labels spell; null ids give null."""
    ready(ids.sparkSession)

    @F.arrow_udf("string")
    def text(held: pa.Array) -> pa.Array:
        decode = _tokenizer(file).decode
        return pa.array([None if x is None else decode(x) for x in held.to_pylist()], pa.string())

    return ids.select("doc_id", text(F.col("ids")).alias("text"))


def round_trip_digests(docs: DataFrame, file: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, and SHA-256 of the ids and of the text decoded from them.

    A null text counts as empty: no tokens, and digests of nothing. Repeated rows are each returned; a null doc_id
    stays null; other columns are ignored. A text is encoded and decoded in one task, without a shuffle.
    """
    ready(docs.sparkSession)
    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(file)
        for batch in batches:
            counts, ids_digests, text_digests = [], [], []
            for text in batch.column(1):
                ids = tokenizer.encode(text.as_py())
                counts.append(len(ids) // 4)
                ids_digests.append(hashlib.sha256(ids).hexdigest())
                text_digests.append(hashlib.sha256(tokenizer.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(digests, schema)

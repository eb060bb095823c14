from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from areal_exposure.llm import token_automaton

FILE = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(FILE)


def library_ids(text: str) -> list[int]:
    return LIBRARY.encode(text, add_special_tokens=False).ids


def own_ids(text: str) -> list[int]:
    return np.frombuffer(token_automaton._tokenizer(FILE).encode(text), "<u4").tolist()


def merged_in_order(word: bytes, merges: list[tuple[int, int, int]], token: dict[bytes, int]) -> list[int]:
    out = [token[bytes([b])] for b in word]
    for u, v, uv in merges:
        k = 0
        while k < len(out) - 1:
            if (out[k], out[k + 1]) == (u, v):
                out[k : k + 2] = [uv]
            k += 1
    return out


@pytest.mark.parametrize("seed", range(30))
def test_paths_are_what_merging_in_order_gives(seed):
    rng = random.Random(seed)
    labels, merges = {0: b"a", 1: b"b", 2: b"c"}, []
    while len(merges) < 25:
        u, v = rng.choice(list(labels)), rng.choice(list(labels))
        if len(both := labels[u] + labels[v]) <= 8 and both not in labels.values():
            merges.append((u, v, len(labels)))
            labels[len(labels)] = both
    automaton = token_automaton.Automaton(labels, merges)
    token = {label: t for t, label in labels.items()}
    for _ in range(200):
        word = bytes(rng.choices(b"abc", weights=(5, 3, 1), k=rng.randint(1, 24)))
        assert automaton.path(word) == merged_in_order(word, merges, token)


@given(st.lists(st.sampled_from([*"ab '.,!1\n\t", "  ", "the", "ing", "'s", "<|endoftext|>", "<|endoftext", "é", "日", "😀", "́", "\xa0", "\x85", "\x1c", " ", "Ⅷ", "՘", "꟒", "　"]), max_size=30).map("".join))
@settings(deadline=None, max_examples=400)
def test_ids_equal_the_library(text):
    assert own_ids(text) == library_ids(text)


def test_every_settled_character_is_split_as_by_the_library():
    tokenizer, splitter = token_automaton._tokenizer(FILE), LIBRARY.pre_tokenizer
    for c in map(chr, range(0xA700)):
        text = f"a{c}1{c}! {c} {c}{c}\n{c} x"
        if token_automaton._SETTLED.fullmatch(text):
            assert tokenizer.pattern.findall(text) == [text[a:b] for _, (a, b) in splitter.pre_tokenize_str(text)], hex(ord(c))


def test_long_words():
    text = "a" * 100_000 + "b" * 999 + "the" * 5000
    assert own_ids(text) == library_ids(text)


def test_digests_and_tables_of_odd_texts(make, odd_texts):
    texts = [*odd_texts, "x <|endoftext|><|endoftext|> y ", " \n lead", "tail  "]
    docs = make(texts)
    rows = {r["doc_id"]: r for r in token_automaton.round_trip_digests(docs, FILE).collect()}
    ids = token_automaton.encoded(docs, FILE)
    back = {r["doc_id"]: r["text"] for r in token_automaton.decoded(ids, FILE).collect()}
    assert len(rows) == len(texts)
    for k, text in enumerate(texts):
        want = library_ids(text or "")
        assert rows[k]["n_tokens"] == len(want)
        assert rows[k]["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        whole = LIBRARY.decode(want, skip_special_tokens=False)
        assert rows[k]["decoded_sha256"] == hashlib.sha256(whole.encode()).hexdigest()
        assert back[k] == whole == (text or "")


def test_no_rows(make):
    assert token_automaton.round_trip_digests(make([]), FILE).count() == 0


def test_bytes_that_are_no_text_decode_as_by_the_library():
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(50_257) for _ in range(6)]
        assert token_automaton._tokenizer(FILE).decode(np.array(ids, "<u4").tobytes()) == LIBRARY.decode(ids, skip_special_tokens=False)

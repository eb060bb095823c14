from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from areal_exposure.llm import token_counts, token_files

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_spliced_counts_equal_whole_ones():
    rng = random.Random(1)
    spliced = token_counts.Spliced(PIECES, 300, 16)
    texts = ["".join(rng.choice("ab éñ\n日\U0001f600<>/the ing ") for _ in range(4000)), "a" * 3000, " " * 2500, "x \n" * 900]
    texts += ["the" * 900 + " end " + "ing" * 900, "ﬁ Ⅳ " * 500]
    assert spliced.counts(texts) == [len(x) for x in spliced.model.encode(texts)]
    assert spliced.widened  # the long runs have no proven boundary within the first overlap


def test_token_counts_of_odd_texts(make, odd_texts):
    rows = {r["doc_id"]: r for r in token_counts.token_counts(make(odd_texts), PIECES, chunk=500, overlap=16).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert len(rows) == len(odd_texts)
    for k, text in enumerate(odd_texts):
        n = len(model.encode(text or ""))
        assert (rows[k]["n_bytes"], rows[k]["n_tokens"], rows[k]["over_limit"]) == (len((text or "").encode()), n, n > 4096)


def test_token_counts_of_no_rows(make):
    assert token_counts.token_counts(make([]), PIECES).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert token_counts.token_counts(make([]), PIECES).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), max_size=60))
@settings(deadline=None, max_examples=60)
def test_codes_round_trip(ranks):
    control, data = token_files.coded(np.array(ranks, dtype=np.uint32))
    assert len(control) == -(-len(ranks) // 4)
    assert token_files.decoded(control, data, len(ranks)).tolist() == ranks


MARKED = st.lists(st.sampled_from([*"aZİıßΣςéÉ '.,!12", "ANKARAYİ", "İ,", "\u0301", "\u0307", "'S", "<|endoftext|>", "\xa0", "ǅ"]), max_size=25).map("".join)


@given(st.lists(st.text(max_size=40) | MARKED, min_size=1, max_size=8))
@settings(deadline=None, max_examples=2500)
def test_ids_by_word_equal_the_library(texts):
    import pyarrow as pa

    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    encoder = token_files._encoder(WORDS)
    assert encoder.by_word
    ids, counts = encoder.ids(pa.array(texts, pa.string()))
    want = [e.ids for e in encoder.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


@pytest.mark.parametrize("block", [1, 1 << 20])
def test_token_files_round_trip(spark, make, odd_texts, tmp_path, block):
    texts = [*odd_texts, "It's DON'T <|endoftext|> 12,5!!", "a\x1cb c", "İstanbul ΣΑΣ. Straße,."]
    ids = [3 * k - 4 for k in range(len(texts))]
    folder = str(tmp_path / "ids")
    token_files.write_ids(make(texts, ids), folder, WORDS, end_id=1, block_tokens=block)
    found = token_files.id_digests(token_files.read_ids(spark, folder)).orderBy("doc_id").collect()
    tokenizer, start = Tokenizer.from_file(WORDS), 0
    assert [r["doc_id"] for r in found] == ids
    for r, text in zip(found, texts, strict=True):
        want = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(want), zlib.crc32(want.tobytes()))
        start += len(want)


def test_token_files_of_no_rows(spark, make, tmp_path):
    token_files.write_ids(make([]), str(tmp_path / "ids"), WORDS, end_id=1)
    assert token_files.read_ids(spark, str(tmp_path / "ids")).count() == 0


def test_words_are_looked_up_without_case_and_marks():
    encoder = token_files.Encoder(WORDS)
    texts = pa.array(["Horse, horse HORSE! horse?! 12, İstanbul. Ärger, ärger a.b, .,. x", "", "horse. Horse;"])
    ids, counts = encoder.ids(texts)
    whole = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts.to_pylist()]
    assert [ids[a - n : a].tolist() for a, n in zip(counts.cumsum(), counts, strict=True)] == whole
    assert sum(w.lower().startswith("horse") for w in encoder.known) == 1

"""Tokenizer operators against the libraries that define them."""

import numpy as np
import public_tokenizers as P
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tessella.llm.byte_bpe import byte_bpe
from tessella.llm.packing import lengths
from tessella.llm.piece_bpe import piece_bpe

HF = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
SP = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
WORDS = st.sampled_from(["the", " ", "  ", "\n", "\t", "In", "internationalization", "▁", "é", "ß", "日本", "😀", "<s>", "<|endoftext|>", "1234", "'s", "'ll", " ", "　", "\x1c", "\x85", "aaaa", "!!", "<0x0A>", "\x00", "ſ", "é", "xyzzy", "ingthe", "ation"])
TEXTS = st.one_of(st.text(max_size=60), st.lists(WORDS, max_size=25).map("".join), st.text(alphabet="aeinrst ▁", max_size=80), st.text(alphabet="abcdefghijklmnopqrstuvwxyz ", max_size=120))


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_byte_bpe_equals_library(text):
    assert byte_bpe().encode(text).tolist() == HF.encode(text, add_special_tokens=False).ids


@settings(max_examples=800, deadline=None)
@given(TEXTS)
def test_piece_bpe_equals_library(text):
    ids = np.frombuffer(piece_bpe().encode_bytes(text), "<u4").tolist()
    assert ids == SP.encode(text)
    assert piece_bpe().decode([1, *ids, 2]) == SP.decode([1, *ids, 2])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 31999) | st.integers(0, 300), max_size=30))
def test_decode_of_any_ids_equals_library(ids):
    assert piece_bpe().decode(ids) == SP.decode(ids)


def test_pair_test_equals_merging():
    b = piece_bpe()
    rng = np.random.default_rng(5)
    made = [i for i in range(259, 32000) if not b.atom[i] or len(b.names[i]) == 1]
    for i, j in rng.choice(made, (1500, 2)).tolist():
        assert b.compatible(i, j) == (b.merge(list(b.names[i] + b.names[j]))[0] == [b.names[i], b.names[j]]), (b.names[i], b.names[j])


def test_long_run_is_linear_and_equal():
    text = "abcdefgh" * 4000
    assert np.frombuffer(piece_bpe().encode_bytes(text), "<u4").tolist() == SP.encode(text)


@given(st.integers(1, 100_000))
def test_lengths_are_powers_that_add_up(n):
    got = lengths(n)
    assert sum(got) == n and all(x & (x - 1) == 0 and x <= 1024 for x in got) and got == sorted(got, reverse=True)


def test_byte_bpe_on_very_long_runs():
    for text in (" " * 100_000 + "a", "a" * 60_000, "\n" * 9000, "!" * 49_999, "1 " * 50_000):
        assert byte_bpe().encode(text).tolist() == HF.encode(text, add_special_tokens=False).ids

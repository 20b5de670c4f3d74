import functools
import sys
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from barflow.llm import simple8b
from barflow.llm.packing import pack_documents
from barflow.llm.pretoken import encoder, word_normal
from barflow.llm.token_counts import count_tokens
from barflow.llm.token_store import read_tokens, stored_tokens, write_tokens

SCHEMA = "text string, doc_id long, lang string, key string, pre string, n_tokens string"
TEXTS = ["it's 's ''s !'s \n's don't've'll", "  x \n\n y  ", "", None, "<|endoftext|>a <|startoftext|>b", "ΣΑΣ İx H̱ ñandú 123 4", "the the the", "the the the", "word " * 30000, "  a'S 'LL", "a\x1cb\x85c"]
ROWS = [(t, i, "en", "k", "p", "z") for i, t in enumerate(TEXTS)] + [("the the the", 7, "en", "k", "p", "z"), ("no id", None, None, None, None, None)]


@functools.cache
def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "kind"), [("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word")])
@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(list(" \n\t'streamlvd1a!Σé"))), max_size=40))
def test_ids_are_the_librarys(name, kind, text):
    assert np.frombuffer(encoder(public_tokenizers.path(name), kind).ids(text), "<u4").tolist() == library(name)(text)


def test_normalizing_costs_little_more_than_lower_case():
    text = "ñandú über Straße œuvre " * 100_000

    def cost(f):
        def once():
            began = time.process_time()
            f(text)
            return time.process_time() - began

        return min(once() for _ in range(5))

    word_normal(text)  # its tables are made once a worker
    assert cost(word_normal) < 15 * cost(str.lower)


def test_every_character_is_normalized_as_by_the_library():
    text = " ".join(f"a{chr(c)}É" for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    want = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).normalizer.normalize_str(text)
    assert "".join(word_normal(text).split()) == "".join(want.split())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70000), st.integers(0, 2**64 - 1)), max_size=90), max_size=6))
def test_simple8b_round_trip(lists):
    sizes = simple8b.blocks_of(np.array([len(x) for x in lists]))
    values = np.array([v for x in lists for v in x], np.uint64)
    words, starts = simple8b.encode(values, sizes)
    assert simple8b.decode(words, sizes, starts).tolist() == values.tolist()


def test_long_documents_have_several_blocks():
    v = np.arange(10_000)
    sizes = simple8b.blocks_of(np.array([0, 10_000]))
    words, starts = simple8b.encode(v, sizes)
    assert sizes.tolist() == [4096, 4096, 1808]
    assert simple8b.decode(words[starts[1] : starts[2]], sizes[1:2]).tolist() == v[4096:8192].tolist()


def test_counts(spark):
    ids = library("byte_bpe_50k.json")
    got = sorted((r.doc_id is None, r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in count_tokens(spark.createDataFrame(ROWS, SCHEMA), public_tokenizers.path("byte_bpe_50k.json")).collect())
    assert got == sorted((d is None, d, len((t or "").encode()), len(ids(t)), len(ids(t)) > 512) for t, d, *_ in ROWS)
    assert count_tokens(spark.createDataFrame([], SCHEMA), public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_counts_without_frequent_table(spark, monkeypatch):
    monkeypatch.setattr("barflow.llm.token_counts.frequent_from", lambda pieces: 1 << 40)
    ids = library("byte_bpe_50k.json")
    got = sorted((r.doc_id is None, r.doc_id, r.n_tokens) for r in count_tokens(spark.createDataFrame(ROWS, SCHEMA), public_tokenizers.path("byte_bpe_50k.json")).collect())
    assert got == sorted((d is None, d, len(ids(t))) for t, d, *_ in ROWS)


def test_store(spark):
    ids = library("word_bpe_49k.json")
    rows = sorted(((d is not None, d), [*ids(t), 1]) for t, d, *_ in ROWS)
    got = sorted(stored_tokens(spark.createDataFrame(ROWS, SCHEMA), public_tokenizers.path("word_bpe_49k.json")).collect(), key=lambda r: r.start)
    at = 0
    assert len(got) == len(rows)
    for r, ((_, d), x) in zip(got, rows):
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        at += len(x)
    assert stored_tokens(spark.createDataFrame([], SCHEMA), public_tokenizers.path("word_bpe_49k.json")).count() == 0


def test_store_gives_ids(spark, tmp_path):
    write_tokens(spark.createDataFrame(ROWS[:3], SCHEMA), f"file://{tmp_path}/t", public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r.ids for r in read_tokens(spark, f"file://{tmp_path}/t").collect()}
    ids = library("word_bpe_49k.json")
    assert got == {d: [*ids(t), 1] for t, d, *_ in ROWS[:3]}


def test_packing(spark):
    ids = library("byte_bpe_50k.json")
    docs = [(f"w{i} " * (i * 7 % 900 + 1), i, "en", "k", "p", "z") for i in range(60)] + ROWS
    got = pack_documents(spark.createDataFrame(docs, SCHEMA), public_tokenizers.path("byte_bpe_50k.json")).collect()
    want = sorted((d is None, d, [*ids(t), 0]) for t, d, *_ in docs)
    pieces = []
    for none, d, x in want:
        first = len(x) % 2048 or 2048 if len(x) > 2048 else len(x)
        cuts = [0, *range(first, len(x) + 1, 2048)]
        pieces += [(none, d, k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((r.doc_id is None, r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(pieces)
    filled = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048
    assert len(filled) <= -(-sum(p[4] for p in pieces) // 2048) + 2
    assert pack_documents(spark.createDataFrame([], SCHEMA), public_tokenizers.path("byte_bpe_50k.json")).count() == 0

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

import public_tokenizers
from plantloom.llm.pack import OpenBins, WordIds, best_fit, op9_best_fit_packing, pack_documents
from tokenizers import Tokenizer

from .brute import ODD_SCHEMA, odd_rows


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


ANY = st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from(" \n\t　 'sé1.<|>")),
              max_size=60)


@settings(max_examples=400, deadline=None,
          suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ANY)
def test_word_ids_are_the_tokenizers(tokenizer, text):
    ids = np.frombuffer(WordIds(None).document(text), "<u4").tolist()
    assert ids == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 37), max_size=80))
def test_best_fit_against_scanning(lengths):
    rooms = []
    bins, offsets = best_fit(lengths, 37)
    for n, b, o in zip(lengths, bins, offsets, strict=True):
        fit = [(r, i) for i, r in enumerate(rooms) if r >= n]
        if not fit:
            rooms.append(37)
            fit = [(37, len(rooms) - 1)]
        assert rooms[b] == min(fit)[0] and o == 37 - rooms[b]
        rooms[b] -= n


def test_tightest_of_none():
    assert OpenBins(8).tightest(3) is None


def check(docs, got, tokenizer, size=2048):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= size
    total = 0
    for i, text in docs.items():
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // size)))
        at = 0
        for r in own:
            assert r.start == at and (r.length == size or r.piece == 0)
            raw = np.array(ids[at: at + r.length], "<u4").tobytes()
            assert zlib.crc32(raw) == r.ids_crc32
            at += r.length
        assert at == len(ids)
    return total, len(sequences)


def test_documents(spark, sf, tokenizer):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    total, used = check(docs, op9_best_fit_packing(spark, sf).collect(), tokenizer)
    assert used <= -(-total // 2048) + 2


def test_odd_rows(spark, tokenizer):
    df = spark.createDataFrame(odd_rows(), ODD_SCHEMA)
    got = pack_documents(df).collect()
    count = Counter((r.doc_id, r.piece) for r in got)
    assert count[1, 0] == 2 and count[None, 0] == 1 and count[2, 0] == 1
    assert sum(r.length for r in got if r.doc_id == 3) == 1
    assert pack_documents(df.limit(0)).count() == 0


def test_added_token(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|>", "x  <|endoftext|> y <|endoftext|><|endoftext|>\n",
             "<|endoftext|", "<|endof<|endoftext|>text|>"]
    for t in texts:
        ids = np.frombuffer(WordIds(None).document(t), "<u4").tolist()
        assert ids == [*plain.encode(t, add_special_tokens=False).ids, 0], t
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check(dict(enumerate(texts)), pack_documents(df, size=4).collect(), plain, 4)

"""Byte-level BPE by transducer against the tiktoken library, and streaming UTF-8 against Python's decoder."""

import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tests.llm.conftest import ROWS
from textlake.llm import bpe_transducer as T


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def vocabulary(request):
    with open(P.path(request.param), "rb") as lines:
        ranks = T.read_ranks(lines)
    return ranks, T.Rules(ranks), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def awkward_texts(rng, reference):
    yield from ("", " ", "a", "\n\n\t x  ", "'s'S'll", "<|endoftext|> and <|endoftext|>", "z" * 30_000, "é" * 3000, " " * 999 + "x")
    for k in range(3000):
        alphabet = rng.choice(["ab", "aeinrst ", "abcdefghijklmnopqrstuvwxyz", " \n\t'sre", "0123456789ABCDEF", "añö日本語é😀é "])
        yield "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40)))
        yield "".join(reference.decode_single_token_bytes(rng.randrange(50_256)).decode("utf-8", "replace") for _ in range(6))


def test_encoding_equals_the_library(vocabulary):
    ranks, rules, reference = vocabulary
    encoder, decoder = T.Encoder(rules, P.PATTERN), T.Decoder(ranks)
    for text in awkward_texts(random.Random(3), reference):
        got = encoder.encode(text)
        assert ids(got) == reference.encode_ordinary(text), text
        assert decoder.decode(got) == text


def test_every_character_is_split_like_the_library(vocabulary):
    ranks, rules, reference = vocabulary
    encoder = T.Encoder(rules, P.PATTERN)
    for cp in [*range(0x3100), *range(0xFE00, 0x10000), *range(0x1D400, 0x1D800), *range(0x1F600, 0x1F650)]:
        text = f"a {chr(cp)}1{chr(cp)}{chr(cp)} x"
        assert ids(encoder.encode(text)) == reference.encode_ordinary(text), hex(cp)


def test_states_may_be_dropped(vocabulary, monkeypatch):
    monkeypatch.setattr(T, "STATES", 5)
    monkeypatch.setattr(T, "PIECES", 3)
    monkeypatch.setattr(T, "LONG_TEXT", 20)
    _, rules, reference = vocabulary
    encoder = T.Encoder(rules, P.PATTERN)
    for text in ("the quick brown fox jumps over the lazy dog", "unbelievably", "internationalisation of tokens " * 3):
        assert ids(encoder.encode(text)) == reference.encode_ordinary(text)
    assert len(encoder.machine.states) <= 6 and len(encoder) <= 3


def test_ids_are_emitted_after_bounded_lookahead(vocabulary):
    _, rules, reference = vocabulary
    rng = random.Random(5)
    piece = bytes(rng.choice(b"abcdefgh") for _ in range(5000))
    machine, got, read = T.Transducer(rules), [], 0
    want = reference._encode_single_piece(piece)
    for part in machine.stream(piece[i:i + 7] for i in range(0, len(piece), 7)):
        got += part
        read += 7
        known = sum(len(reference.decode_single_token_bytes(t)) for t in got)
        assert known <= len(piece)
    assert got == want
    first = next(machine.stream([piece[:2 * rules.longest + 1]]))
    covered = sum(len(reference.decode_single_token_bytes(t)) for t in first)
    assert first == want[:len(first)] and covered >= rules.longest


def test_tokens_that_no_merge_forms():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"xyz": 258, b"abc": 259}
    reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    encoder = T.Encoder(T.Rules(ranks), P.PATTERN)
    for text in ("xyz", "xyzxyz", "abc", "abcbcab", "aabbcc", "xyz abc xyz"):
        assert ids(encoder.encode(text)) == reference.encode_ordinary(text), text
    with pytest.raises(ValueError):
        T.Rules({b"a": 0})


def test_decoding_in_any_steps_equals_pythons_decoder(vocabulary, monkeypatch):
    ranks, _, _ = vocabulary
    decoder, rng = T.Decoder(ranks), random.Random(9)
    leads = [ranks[bytes([b])] for b in (0x41, 0x80, 0xBF, 0xC0, 0xC3, 0xE0, 0xA0, 0xE3, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xF5, 0xFF)]
    for _ in range(1500):
        sent = [rng.choice(leads) if rng.random() < 0.8 else rng.randrange(50_256) for _ in range(rng.randrange(1, 12))]
        data = b"".join(decoder.bytes_of[i] for i in sent)
        steps, out = rng.randrange(1, 4), []
        for i in range(0, len(sent), steps):
            out.append(decoder.feed(sent[i:i + steps]))
            assert len(decoder.held) <= 3
        assert "".join([*out, decoder.finish()]) == data.decode("utf-8", "replace")


def test_documents(spark, edge_docs, no_docs, vocabulary):
    ranks, _, reference = vocabulary
    rules, tokens = T.broadcast_rules(spark, ranks, P.PATTERN), T.broadcast_tokens(spark, ranks)
    encoded = T.encode_texts(edge_docs, rules, keep=("doc_id", "n"))
    rows = T.decode_ids(encoded, tokens, keep=("doc_id", "n", "ids")).collect()
    want = sorted((repr(i), reference.encode_ordinary(t or ""), t or "") for i, t, _, _ in ROWS)
    assert sorted((repr(r.doc_id), ids(r.ids), r.decoded) for r in rows) == want and {r.n for r in rows} == {"other"}
    both = T.round_trip(edge_docs, rules, tokens, keep=("doc_id", "n")).collect()
    assert sorted((repr(r.doc_id), ids(r.ids), r.decoded) for r in both) == want
    assert T.round_trip(no_docs, rules, tokens).count() == 0
    assert T.decode_ids(T.encode_texts(no_docs, rules), tokens).count() == 0
    nothing = spark.createDataFrame([(1, None)], "doc_id long, ids binary")
    assert T.decode_ids(nothing, tokens).collect()[0].decoded == ""


def test_query(spark):
    import __spark_entry__ as E

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        reference = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=T.read_ranks(lines), special_tokens={})
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in E.queries()["op12_bpe_transducer"](spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(docs) == len(got)
    for d in docs:
        want = np.array(reference.encode_ordinary(d.text or ""), "<u4")
        assert got[d.doc_id] == (len(want), hashlib.sha256(want.tobytes()).hexdigest(), hashlib.sha256((d.text or "").encode()).hexdigest())

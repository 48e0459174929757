"""Token files: ids as the library gives them, the public frame format, random access."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import zstandard

from textlake.llm.common import text_buffer
from textlake.llm.token_frames import PIECE, Encoder, FrameReader, FrameWriter, tokens_round_trip

PATH = public_tokenizers.path("byte_bpe_50k.json")


def ids_of(encoder, texts):
    ids, edge = encoder.encode(*text_buffer(pa.array(texts)))
    return [ids[edge[i]:edge[i + 1]].tolist() for i in range(len(texts))]


def test_ids_equal_those_of_the_library():
    rng = random.Random(1)
    parts = [*" \n\t  ab'sé1,.\x1c　\xa0!日​\x85_<|", "'re", "<|endoftext|>", "  ", "\r\n", "word", "I'll", " ", " 　 ", " "]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(8000)] + ["", "\0 a  b", " a", "a ", " ", "x" * 3000, " \n" * 200]
    encoder = Encoder(PATH)
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(encoder, texts) == want
    assert ids_of(encoder, texts[::-1]) == want[::-1]  # from the table


def test_added_tokens_in_the_text():
    from tokenizers import AddedToken, Tokenizer

    rng = random.Random(2)
    mark = "<|endoftext|>"
    texts = [f"a{mark}b", mark, mark * 3, f"  {mark}  x {mark}", "<|endof", "text|>", f"{mark}\n", "", "plain words", f"é {mark}日"]
    parts = [mark, mark, "<|endof", "text|>", " ", "  ", "\n", "word", "é", "I'll", "\xa0", "1"]
    texts += ["".join(rng.choices(parts, k=rng.randrange(12))) for _ in range(3000)]
    fresh = Tokenizer.from_file(PATH)
    assert fresh.encode(f"a{mark}b", add_special_tokens=False).ids == [64, 50256, 65]
    want = [e.ids for e in fresh.encode_batch(texts, add_special_tokens=False)]
    encoder = Encoder(PATH)
    assert ids_of(encoder, texts) == want
    assert ids_of(encoder, texts[::-1]) == want[::-1]
    # A token that takes the blanks before it: texts that hold it go to the library whole.
    odd = Encoder(PATH)
    odd.tokenizer.add_special_tokens([AddedToken("<sep>", lstrip=True)])
    fresh.add_special_tokens([AddedToken("<sep>", lstrip=True)])
    odd._find_added()
    texts = ["a  <sep> b", f"{mark} <sep>", "none", "", f"x{mark}"]
    assert ids_of(odd, texts) == [e.ids for e in fresh.encode_batch(texts, add_special_tokens=False)]


def test_frames_are_plain_zstandard(tmp_path):
    path = str(tmp_path / "a" / "x.zst")
    docs = [(None, np.array([5], np.uint32)), (3, np.arange(1000, dtype=np.uint32)), (3, np.zeros(0, np.uint32)), (9, np.arange(PIECE + 7, dtype=np.uint32) % 50_000)]
    writer = FrameWriter(path, 2)
    for d in docs:
        writer.add(*d)
    writer.close()
    with open(path, "rb") as f:
        raw = zstandard.ZstdDecompressor().stream_reader(f, read_across_frames=True).read()
    assert raw == b"".join(x.astype("<u2").tobytes() for _, x in docs)
    reader = FrameReader(path)
    assert len(reader) == 4 and [x.tolist() for x in reader.find(3)] == [list(range(1000)), []]
    assert reader.find(0) == [] and (reader.ids(3) == docs[3][1]).all() and reader.index["n_frames"][3] == 2
    body = bytearray(open(path, "rb").read())
    body[30] ^= 1
    open(path, "wb").write(body)
    with pytest.raises(Exception):
        for i in range(4):
            FrameReader(path).ids(i)
    open(path, "wb").write(body[:-3])
    with pytest.raises(Exception):
        FrameReader(path)


def test_round_trip_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = tokens_round_trip(docs.repartition(6), PATH).orderBy("doc_id").collect()
    encoder, start = Encoder(PATH).tokenizer, 0
    for d, r in zip(docs.orderBy("doc_id").collect(), rows, strict=True):
        ids = [*encoder.encode(d.text, add_special_tokens=False).ids, 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)

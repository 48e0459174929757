"""Text encoders for the semantic engine.

``encode_batches`` runs any encoder over a text column in one pass: the encoder
is set up once in each Python worker, gets fixed batches of texts, and a batch
that fails is halved and repeated (the smaller size is kept for the rest of the
task). An encoder is a picklable object with

* ``inputs(text_col)``: the Column that it reads (the text, or tokens made in the JVM),
* ``setup()``: loads what it needs, once in a worker,
* ``encode(list of str)``: a (rows, dimension) array.

The reference encodes texts with a transformer (weights not available here). The
built-in encoder is signed feature hashing: every token adds +1 or -1 to one of
``dim`` buckets chosen from its md5 digest, and the vector is L2-normalized.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlake.operators import text as TX

DIM = 256
BATCH = 512


class HashEncoder:
    """Signed feature hashing of word tokens; blank and null texts give zero vectors."""

    #: Tokens whose buckets a worker remembers.
    KNOWN = 200_000

    def __init__(self, dim: int = DIM, stop_words: tuple[str, ...] | None = None):
        self.dim, self.stop_words = dim, TX.english_stop_words() if stop_words is None else tuple(stop_words)

    def inputs(self, text_col) -> Column:
        return F.array_join(TX.word_tokens(text_col, self.stop_words), " ")

    def setup(self) -> None:
        self.places: dict[str, tuple[int, float]] = {}

    def place(self, token: str) -> tuple[int, float]:
        """Bucket and sign of a token: the first eight hex digits, and the ninth."""
        found = self.places.get(token)
        if found is None:
            digest = hashlib.md5(token.encode()).hexdigest()
            found = int(digest[:8], 16) % self.dim, 1.0 if int(digest[8], 16) % 2 == 0 else -1.0
            if len(self.places) >= self.KNOWN:
                self.places.clear()
            self.places[token] = found
        return found

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for row, text in zip(out, texts):
            if text:
                bucket, sign = zip(*map(self.place, text.split(" ")))
                row += np.bincount(bucket, weights=sign, minlength=self.dim)
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return out / np.where(norm == 0, 1.0, norm)


class Batches:
    """Texts to vectors in batches; the size is halved for good when a batch fails."""

    def __init__(self, encoder, size: int):
        self.encoder, self.size = encoder, size

    def run(self, texts: list[str]) -> np.ndarray:
        parts, at = [], 0
        while at < len(texts):
            batch = texts[at:at + self.size]
            try:
                parts.append(np.asarray(self.encoder.encode(batch), dtype=np.float64))
                at += len(batch)
            except Exception:
                if len(batch) == 1:
                    raise
                self.size = max(1, len(batch) // 2)
        return np.concatenate(parts)


def encode_batches(df: DataFrame, encoder, text_col: str = "text", out_col: str = "embedding", batch: int = BATCH) -> DataFrame:
    """``df`` and ``out_col`` (array<double>): the vector of each row's text, null
    and empty texts too. All columns are carried along, no row is moved."""
    rows = df.select(*(F.col(f"`{c}`") for c in df.columns if c != out_col), F.coalesce(encoder.inputs(text_col), F.lit("")).alias(out_col))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(out_col, T.ArrayType(T.DoubleType()))])
    sent = df.sparkSession.sparkContext.broadcast(encoder)

    def run(batches):
        own = sent.value
        if not getattr(own, "is_set_up", False):  # the broadcast object lives as long as the worker
            own.setup()
            own.is_set_up = True
        work = Batches(own, batch)
        for part in batches:
            for a in range(0, part.num_rows, batch):
                piece = part.slice(a, batch)
                vectors = work.run(piece.column(piece.num_columns - 1).to_pylist())
                offsets = np.arange(len(vectors) + 1, dtype=np.int32) * vectors.shape[1]
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(vectors.ravel()))
                yield pa.RecordBatch.from_arrays([*piece.columns[:-1], column], names=piece.schema.names)

    return rows.mapInArrow(run, schema)


def hash_embed(df: DataFrame, id_col: str, text_col: str, dim: int = DIM, stop_words=None) -> DataFrame:
    """(id, embedding array<double>) with unit (or zero) vectors of the built-in encoder."""
    encoded = encode_batches(df.select(id_col, text_col), HashEncoder(dim, stop_words), text_col)
    return encoded.select(id_col, "embedding")

"""Token ids of documents in files of independent zstandard frames.

A file holds, in ascending document id: one frame per document piece of at
most PIECE ids (little-endian, 2 bytes each if every id fits, else 4), then a
skippable frame with the document index, then the seek table of the seekable
zstandard format: compressed size, decompressed size and XXH64 checksum (low
32 bits) of every frame. A reader fetches the two tables from the end of the
file, and decompresses only the frames of the documents it wants.

The documents are dealt out by ranges of their id, so a file is written by the
task that encodes its documents; a retried task writes the same bytes and the
rename at the end is atomic.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import row_blocks, shared_path, stage, text_buffer
from textlake.llm.words import Words

PIECE = 1 << 20
#: Bytes of text encoded at a time.
BLOCK = 4 << 20
LEVEL = 3
END_ID = 0
# Fixed values of the seekable format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1

_INDEX = np.dtype([("doc_id", "<i8"), ("null_id", "<u1"), ("first_frame", "<u4"), ("n_frames", "<u4"), ("n_ids", "<u8")])
_SEEK = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])


# ---- files ---------------------------------------------------------------

def _filesystem(uri: str):
    """(Arrow file system, path): local paths, file:, and any store Arrow knows."""
    import pyarrow.fs as fs

    scheme = urlparse(uri).scheme
    if scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path if scheme else uri
    return fs.FileSystem.from_uri(uri)


class FrameWriter:
    """Writes one file; nothing appears under its name before ``close``."""

    def __init__(self, uri: str, width: int = 4):
        self.fs, self.path = _filesystem(uri)
        self.fs.create_dir(os.path.dirname(self.path), recursive=True)
        task = TaskContext.get()
        self.temp = f"{self.path}.{task.taskAttemptId() if task else os.getpid()}.tmp"
        self.out = self.fs.open_output_stream(self.temp)
        self.kind = "<u2" if width == 2 else "<u4"
        self.width = width
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.seek: list[tuple] = []
        self.index: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        first = len(self.seek)
        for i in range(0, max(len(ids), 1), PIECE):
            raw = ids[i:i + PIECE].astype(self.kind).tobytes()
            packed = self.packer.compress(raw)
            self.out.write(packed)
            self.seek.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.index.append((doc_id or 0, doc_id is None, first, len(self.seek) - first, len(ids)))

    def close(self) -> None:
        index = struct.pack("<B", self.width) + np.array(self.index, _INDEX).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index)
        # The seek table covers every frame of the file, the index frame included.
        seek = np.array([*self.seek, (len(index) + 8, 0, 0)], _SEEK).tobytes()
        self.out.write(struct.pack("<II", SKIPPABLE_SEEK, len(seek) + 9) + seek)
        self.out.write(struct.pack("<IBI", len(self.seek) + 1, 0x80, SEEKABLE_MAGIC))
        self.out.close()
        self.fs.move(self.temp, self.path)


class FrameReader:
    """Random access to the documents of one file, checksums verified."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        n, flags, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE_MAGIC or not flags & 0x80:
            raise ValueError(f"{uri} has no seek table with checksums")
        table = end - 9 - n * _SEEK.itemsize
        if struct.unpack("<II", self.file.read_at(8, table - 8)) != (SKIPPABLE_SEEK, n * _SEEK.itemsize + 9):
            raise ValueError(f"{uri}: seek table damaged")
        self.seek = np.frombuffer(self.file.read_at(n * _SEEK.itemsize, table), _SEEK)
        self.at = np.concatenate(([0], np.cumsum(self.seek["packed"], dtype=np.int64)))
        index = self.file.read_at(int(self.seek["packed"][-1]), int(self.at[-2]))
        if struct.unpack("<II", index[:8]) != (SKIPPABLE_INDEX, len(index) - 8):
            raise ValueError(f"{uri}: document index damaged")
        self.kind = "<u2" if index[8] == 2 else "<u4"
        self.index = np.frombuffer(index[9:], _INDEX)
        self.unpacker = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.index)

    def ids(self, row: int) -> np.ndarray:
        """All ids of the document at this place in the file."""
        doc, out = self.index[row], []
        for k in range(int(doc["first_frame"]), int(doc["first_frame"]) + int(doc["n_frames"])):
            packed = self.file.read_at(int(self.seek["packed"][k]), int(self.at[k]))
            raw = self.unpacker.decompress(packed, max_output_size=int(self.seek["size"][k]))
            if len(raw) != self.seek["size"][k] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.seek["check"][k]:
                raise ValueError(f"frame {k} is damaged")
            out.append(np.frombuffer(raw, self.kind))
        return np.concatenate(out).astype("<u4")

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The ids of every document with this id."""
        known = self.index["null_id"] == 0
        return [self.ids(int(i)) for i in np.flatnonzero(known & (self.index["doc_id"] == doc_id))]


# ---- tokens --------------------------------------------------------------

#: White space of the pre-tokenizer, in UTF-8.
_WS = rb"(?:[\t-\r ]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80)"
#: A space inside a run of white space, or one that ends the text after white space.
_INNER_SPACE = re.compile(_WS + b" (?:" + _WS + rb"|\Z)")
#: Pieces kept for lookup, about 30 bytes each, after which the table starts anew.
KEPT = 3_000_000


class Encoder:
    """Ids of texts, by the tokenizers library. A byte-level BPE joins nothing
    over certain borders: before a blank that follows other text, and between
    ASCII letters and ASCII marks. Texts are cut there, each distinct piece is
    encoded once, and its ids are looked up after that by a 64-bit hash. Texts
    with a blank inside a run of white space, where that border moves, are one piece.
    Added tokens (such as <|endoftext|>) are found first, as the library does, and
    what stands between them is encoded as texts of its own."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._find_added()
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.line_feed = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.hasher = Words(b"", fold_case=False)
        code = np.arange(256)
        self.space = (code == 32) | (code >= 9) & (code <= 13)
        self.letter = (code >= 65) & (code <= 90) | (code >= 97) & (code <= 122)
        self.mark = (code < 128) & ~self.letter & ~self.space & (code != 39)
        self._clear()

    @classmethod
    def load(cls, path: str) -> Encoder:
        """One per Python worker, kept between tasks."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _find_added(self):
        added = self.tokenizer.get_added_tokens_decoder()
        self.added = {t.content.encode(): i for i, t in added.items()}
        self.added_pattern = re.compile(b"|".join(re.escape(c) for c in sorted(self.added, key=len, reverse=True))) if added else None
        #: Whether added tokens are plain strings in the text; else the texts that hold one go to the library whole.
        self.plain_added = self.tokenizer.normalizer is None and len({t.normalized for t in added.values()}) < 2 and not any(t.lstrip or t.rstrip or t.single_word for t in added.values())

    def _clear(self):
        self.keys, self.place = np.empty(0, np.uint64), np.empty(0, np.int32)
        self.flat, self.bounds = np.empty(0, np.uint32), np.zeros(1, np.int64)

    def _cuts(self, b: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Starts of the pieces of the rows that begin at ``rows`` in ``b``."""
        cut = np.zeros(len(b), bool)
        space, letter, mark = self.space[b], self.letter[b], self.mark[b]
        blank = b == 32
        cut[1:] = blank[1:] | letter[:-1] & (mark | space)[1:] | mark[:-1] & letter[1:]
        cut[2:] |= letter[2:] & space[1:-1] & ~blank[1:-1] & (letter | mark)[:-2]
        # Blanks after white space, or after what may end a longer white space, with such a thing behind them.
        next_, prev = np.append(b[1:], 32), np.concatenate(([0], b[:-1]))
        ends = np.zeros(len(b) + 1, bool)
        ends[rows] = True
        odd = np.flatnonzero(blank & (self.space[prev] | (prev >= 128) & (prev < 192)) & (self.space[next_] | (next_ == 0xC2) | (next_ >= 0xE1) & (next_ <= 0xE3) | ends[1:]))
        bounds = np.append(rows, len(b))
        for i in odd:
            r = int(np.searchsorted(bounds, i, "right")) - 1
            lo, hi = int(bounds[r]), int(bounds[r + 1])
            if _INNER_SPACE.search(b[max(lo, i - 3):min(hi, i + 4)].tobytes()):  # an end of the slice counts as one of the text
                cut[lo:hi] = False
        cut[rows[rows < len(b)]] = True
        return np.flatnonzero(cut)

    def _learn(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids end to end, number of ids of each piece). Pieces without inner
        white space are encoded in one text, a line feed between them."""
        plain = np.array([len(p.split()) == 1 and not p[-1].isspace() and not p[1:2].isspace() and "\n" not in p for p in pieces], bool)
        if not plain.any():
            got = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
            return np.array([t for x in got for t in x], np.uint32), np.array([len(x) for x in got], np.int64)
        one = self.tokenizer.encode_batch_fast(["\n".join(p for p, k in zip(pieces, plain) if k)], add_special_tokens=False)[0].ids
        one = np.array(one, np.uint32)
        cuts = np.flatnonzero(one == self.line_feed)
        rest = [e.ids for e in self.tokenizer.encode_batch_fast([p for p, k in zip(pieces, plain) if not k], add_special_tokens=False)]
        size = np.zeros(len(pieces), np.int64)
        size[plain] = np.diff(np.concatenate(([-1], cuts, [len(one)]))) - 1
        size[~plain] = [len(x) for x in rest]
        out = np.empty(int(size.sum()), np.uint32)
        which = np.repeat(plain, size)
        out[which], out[~which] = np.delete(one, cuts), [t for x in rest for t in x]
        return out, size

    def _added_spans(self, b: np.ndarray, rows: np.ndarray) -> list[tuple[int, int, list[int]]]:
        """(start, end, ids) of the added tokens, or of the texts to encode whole, in order."""
        raw = b.tobytes()
        if self.added_pattern is None or not self.added_pattern.search(raw):
            return []
        near = set()
        for m in self.added_pattern.finditer(raw):  # a match over a border leaves its texts to be looked at alone
            near.update(range(int(np.searchsorted(rows, m.start(), "right")) - 1, int(np.searchsorted(rows, m.end(), "left"))))
        out = []
        for r in sorted(near):
            lo, hi = int(rows[r]), int(rows[r + 1])
            found = [(lo + m.start(), lo + m.end(), [self.added[m[0]]]) for m in self.added_pattern.finditer(raw[lo:hi])]
            if found and not self.plain_added:
                found = [(lo, hi, self.tokenizer.encode(raw[lo:hi].decode("utf-8", "replace"), add_special_tokens=False).ids)]
            out += found
        return out

    def encode(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts buf[offs[i]:offs[i+1]] end to end, and their bounds; no end ids."""
        base = int(offs[0])
        b, rows = buf[base:int(offs[-1])], offs - base
        spans = self._added_spans(b, rows)
        if not spans:
            return self._encode(b, rows)
        starts, sizes = np.array([x[0] for x in spans]), np.array([len(x[2]) for x in spans])
        bounds = np.sort(np.concatenate((rows, starts, [x[1] for x in spans])))
        length = np.diff(bounds)
        is_span = np.isin(bounds[:-1], starts) & (length > 0)
        ids, edge = self._encode(b[np.repeat(~is_span, length)], np.concatenate(([0], np.cumsum(np.where(is_span, 0, length)))))
        ids = np.insert(ids, np.repeat(edge[:-1][is_span], sizes), np.array([t for x in spans for t in x[2]], np.uint32))
        count = np.diff(edge)
        count[is_span] = sizes
        return ids, np.concatenate(([0], np.cumsum(count)))[np.searchsorted(bounds, rows)]

    def _encode(self, b: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for the texts b[rows[i]:rows[i+1]], which hold no added token."""
        if not len(b):
            return np.empty(0, np.uint32), np.zeros(len(rows), np.int64)
        if len(self.keys) > KEPT:
            self._clear()
        starts = self._cuts(b, rows[:-1])
        h = self.hasher.hash_spans(b, starts, np.append(starts[1:], len(b)))
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, u), max(len(self.keys) - 1, 0))
        new = np.flatnonzero(self.keys[at] != u) if len(self.keys) else np.arange(len(u))
        if len(new):
            ends = np.append(starts[1:], len(b))
            raw = b.tobytes()
            ids, size = self._learn([raw[starts[i]:ends[i]].decode("utf-8", "replace") for i in first[new]])
            slot = np.searchsorted(self.keys, u[new])
            number = np.arange(len(self.keys), len(self.keys) + len(new), dtype=np.int32)
            self.keys, self.place = np.insert(self.keys, slot, u[new]), np.insert(self.place, slot, number)
            self.bounds = np.concatenate((self.bounds, self.bounds[-1] + np.cumsum(size)))
            self.flat = np.concatenate((self.flat, ids))
            at = np.searchsorted(self.keys, u)
        k = self.place[at][back]
        lo, size = self.bounds[k], self.bounds[k + 1] - self.bounds[k]
        total = np.concatenate(([0], np.cumsum(size)))
        out = self.flat[np.repeat(lo - total[:-1], size) + np.arange(total[-1])]
        return out, total[np.searchsorted(starts, rows)]


# ---- operators -----------------------------------------------------------

def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text (null: empty), append END_ID, and write the
    files. Returns the manifest: (shard, path, n_docs, n_ids) by file.

    Documents are in ascending id; null ids come first. Rows that share an id
    stay apart and follow each other. Other columns are not read.
    """
    def write(batches):
        pid = TaskContext.get().partitionId()
        path, writer, n_docs, n_ids = f"{folder}/ids-{pid:07d}.zst", None, 0, 0
        encoder = Encoder.load(tokenizer_path)
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            keys = batch.column(0).to_pylist()
            writer = writer or FrameWriter(path, encoder.width)
            for i, j in row_blocks(offs, BLOCK):
                ids, edge = encoder.encode(buf, offs[i:j + 1])
                for r in range(j - i):
                    own = np.append(ids[edge[r]:edge[r + 1]], np.uint32(END_ID))
                    writer.add(keys[i + r], own)
                    n_docs, n_ids = n_docs + 1, n_ids + len(own)
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"shard": [pid], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("row"))
    rows = rows.repartitionByRange("id", "row").sortWithinPartitions("id", "row")
    return stage(rows.select("id", "text").mapInArrow(write, "shard long, path string, n_docs long, n_ids long"), "manifest")


def read_token_files(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of every document, from the files.
    ``start`` counts the ids of all documents before it, in file order."""
    spark = manifest.sparkSession
    files, start = [], 0
    for shard, path, n in manifest.orderBy("shard").select("shard", "path", "n_ids").collect():  # a row per file
        files.append((shard, path, start))
        start += n

    def read(batches):
        for batch in batches:
            for path, at in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                reader, out = FrameReader(path), []
                for i, doc in enumerate(reader.index):
                    ids = reader.ids(i)
                    out.append((None if doc["null_id"] else int(doc["doc_id"]), at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["id", "start", "n_tokens", "ids_crc32"])

    table = spark.createDataFrame(files, "shard long, path string, start long")
    table = table.repartitionByRange(max(len(files), 1), "shard")
    return table.mapInArrow(read, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)


def tokens_round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Write the token files under the shared folder and read them back."""
    return read_token_files(write_token_files(docs, tokenizer_path, shared_path(docs.sparkSession, "tokens")))

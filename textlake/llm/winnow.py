"""Benchmark decontamination by winnowing.

Texts are words (A-Z lower-cased). Of every 6 consecutive word 5-grams the one
of smallest hash is a fingerprint, so any shared span of 10 words shares one.
Items of fewer than 10 words have their whole sequence as fingerprint, and
documents give all k-grams of the lengths that such items have.

1. One pass over the documents keeps the fingerprints that a fixed-size bitmap
   of the benchmark's fingerprints lets through; only such documents keep
   their text.
2. A join on the fingerprints gives candidate (document, item) pairs.
3. Each document meets its candidate items in one sorted stream, where hits
   are extended to whole windows and the words they cover are marked.

The bitmap has 2**21 bits whatever the benchmark's size: a larger benchmark
lets more fingerprints through to the join, with the same result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import row_blocks, stage, text_buffer
from textlake.llm.words import NON_ALNUM, U, Words, kgrams, mix

WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
MAP_BITS = 21


def _short(g: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of whole sequences of k words, apart from those of 5-grams."""
    return mix(g ^ mix(np.array([k], U)))


def _winnowed(g: np.ndarray) -> np.ndarray:
    """Distinct minima of SPAN consecutive 5-gram hashes of one text."""
    n = len(g) - SPAN + 1
    low = g[:n].copy()
    for j in range(1, SPAN):
        np.minimum(low, g[j:j + n], out=low)
    return np.unique(low)


def _fingerprints(h: np.ndarray, lengths: list[int], whole: bool) -> np.ndarray:
    """Of one text with word hashes h. ``whole``: an item, else a document."""
    row = np.zeros(len(h), np.int64)
    out = []
    if len(h) >= WINDOW:
        out.append(_winnowed(kgrams(h, row, GRAM)[0]))
    if whole:
        if 0 < len(h) < WINDOW:
            out.append(_short(kgrams(h, row, len(h))[0], len(h)))
    else:
        out += [np.unique(_short(kgrams(h, row, k)[0], k)) for k in lengths if len(h) >= k]
    return np.concatenate(out) if out else np.empty(0, U)


def _rows(lengths: list[int], whole: bool, bitmap=None):
    schema = pa.schema([("rid", pa.int64()), ("id", pa.string()), ("n_words", pa.int64()), ("marks", pa.list_(pa.int64())), ("text", pa.string())])

    def rows(batches):
        hasher = Words(NON_ALNUM)
        known = None if bitmap is None else np.unpackbits(np.frombuffer(bitmap.value, np.uint8))
        for batch in batches:
            buf, offs = text_buffer(batch.column(2))
            for i, j in row_blocks(offs, 4 << 20):
                _, _, h, row = hasher.find(buf, offs[i:j + 1])
                edge = np.searchsorted(row, np.arange(j - i + 1))
                marks = [_fingerprints(h[edge[r]:edge[r + 1]], lengths, whole) for r in range(j - i)]
                if known is not None:
                    marks = [m[known[m & U((1 << MAP_BITS) - 1)] == 1] for m in marks]
                kept = pa.array([i + r if len(m) else None for r, m in enumerate(marks)], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(edge)),
                     pa.array([m.view(np.int64) for m in marks], pa.list_(pa.int64())),
                     batch.column(2).take(kept)], schema=schema)
    return rows


_ROWS = "rid long, id string, n_words long, marks array<long>, text string"


def _bitmap(items: DataFrame) -> bytes:
    """Packed bits of the low MAP_BITS of all fingerprints: at most 2**MAP_BITS rows reach the driver."""
    low = items.select(F.explode("marks").alias("m")).select(F.col("m").bitwiseAND(F.lit((1 << MAP_BITS) - 1)).cast("int").alias("m"))
    bits = np.zeros(1 << MAP_BITS, np.uint8)
    bits[low.distinct().toPandas()["m"].to_numpy(dtype=np.int64)] = 1
    return np.packbits(bits).tobytes()


def _extend(batches):
    """Rows come by rid: the document first, then its candidate items."""
    schema = pa.schema([("rid", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("item_ids", pa.list_(pa.string()))])
    hasher = Words(NON_ALNUM)
    doc: dict = {}

    def done():
        ids = sorted(doc["ids"])
        hit = int(np.count_nonzero(np.cumsum(doc["edge"])))
        return [doc["rid"], hit, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), ids]

    def grams(k):
        if k not in doc["grams"]:
            g = kgrams(doc["h"], np.zeros(len(doc["h"]), np.int64), k)[0]
            order = np.argsort(g, kind="stable")
            doc["grams"][k] = g[order], order
        return doc["grams"][k]

    for batch in batches:
        out = []
        buf, offs = text_buffer(batch.column("text"))
        rids, ids, first = batch.column("rid").to_pylist(), batch.column("id").to_pylist(), batch.column("is_item").to_pylist()
        for i in range(len(rids)):
            h = hasher.find(buf, offs[i:i + 2])[2]
            if not first[i]:
                if doc:
                    out.append(done())
                doc = {"rid": rids[i], "h": h, "ids": set(), "edge": np.zeros(len(h) + 1, np.int64), "grams": {}}
                continue
            k = min(len(h), WINDOW)
            own, order = grams(k)
            want = np.unique(kgrams(h, np.zeros(len(h), np.int64), k)[0])
            lo, hi = np.searchsorted(own, want), np.searchsorted(own, want, "right")
            at = np.concatenate([order[a:b] for a, b in zip(lo, hi) if b > a] or [np.empty(0, np.int64)])
            if len(at):
                np.add.at(doc["edge"], at, 1)
                np.add.at(doc["edge"], at + k, -1)
                if ids[i] is not None:
                    doc["ids"].add(ids[i])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if doc:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*[done()]), schema)], schema=schema)


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items_sha256, contaminated, item_ids), a row per row of ``docs``.

    A window is 10 consecutive words of an item, or all words of a shorter
    one; ``n_hit`` counts the document's words inside any occurrence of any
    window, ``item_ids`` are the items (as strings) with an occurring window.
    Null texts have no words, wordless items no window; items without an id
    count for ``n_hit`` alone, items that share an id count once. Repeated
    documents are looked at row by row.
    """
    source = docs.schema[id_col].dataType.simpleString()
    items = benchmark.select(F.monotonically_increasing_id().alias("rid"), F.col(item_col).cast("string").alias("id"), F.col(item_text).alias("text"))
    items = stage(items.mapInArrow(_rows([], True), _ROWS).where("n_words > 0"), "items")
    lengths = [r[0] for r in items.where(F.col("n_words") < WINDOW).select("n_words").distinct().collect()]
    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(items))

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    rows = stage(rows.mapInArrow(_rows(lengths, False, bitmap), _ROWS), "scanned")
    left = rows.where("text IS NOT NULL").select("rid", F.explode("marks").alias("mark"))
    right = items.select(F.col("rid").alias("item"), F.explode("marks").alias("mark"))
    pairs = stage(left.join(right.hint("merge"), "mark").select("rid", "item").distinct(), "pairs")
    asked = pairs.join(items.select(F.col("rid").alias("item"), "id", "text").hint("merge"), "item")
    asked = asked.select("rid", F.lit(True).alias("is_item"), "id", "text")
    found = rows.join(pairs.select("rid").distinct().hint("merge"), "rid", "left_semi").select("rid", F.lit(False).alias("is_item"), "id", "text")
    both = found.union(asked).repartition("rid").sortWithinPartitions("rid", "is_item")
    hits = stage(both.mapInArrow(_extend, "rid long, n_hit long, n_items long, items_sha256 string, item_ids array<string>"), "hits")
    out = rows.select("rid", "id", "n_words").join(hits.hint("merge"), "rid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(F.col("id").cast(source).alias(id_col), "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                      F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"),
                      (n_hit > 0).alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


#: The contract's columns on ``documents`` and ``benchmark``, by joining all windows.
SQL = r"""
WITH low AS (
  SELECT 'd' AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT side, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
items AS (
  SELECT DISTINCT id AS item, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM words WHERE side = 'b' AND len(w) > 0)),
grams AS (
  SELECT id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT DISTINCT k FROM items) WHERE side = 'd' AND len(w) >= k)),
hits AS (SELECT id, i, k, item FROM grams JOIN items USING (k, g)),
per_word AS (SELECT id, count(DISTINCT j) AS n_hit FROM (SELECT id, unnest(range(i, i + k)) AS j FROM hits) GROUP BY id),
per_item AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT id, item::VARCHAR AS item FROM hits) GROUP BY id)
SELECT d.id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM (SELECT * FROM words WHERE side = 'd') d LEFT JOIN per_word USING (id) LEFT JOIN per_item USING (id)
"""

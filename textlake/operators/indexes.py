"""Search indexes that are written once and reused.

An index is a folder named by its kind and the fingerprint of its input. The
data files come first, the manifest (one JSON row: fingerprint, sizes, build
time, where the data is) last, so a folder with a manifest is complete and an
interrupted build is only repeated. Opening an index reads the input once for
the fingerprint (a hash aggregate, no tokens or vectors are made); only if no
index of that fingerprint exists is it built.

Lexical index. ``blocks`` holds the postings by term and block of documents,
one row each: (term, block, max_weight, postings). Written are counts, the norm of
the document and the idf, each of few values in a file and so a few bits; weights are
made of them by who reads. It is made block by block:
documents are dealt out by CHUNK_BLOCKS blocks, each such chunk gets the idf of
the terms that it has, and its postings are complete in one task. All terms share the blocks (a hash of the id,
about BLOCK_DOCS documents each), so the largest weights of a query's terms in a
block bound the score of every document there. ``vocab`` holds (term, df, idf).

Vector index. Unit vectors in blocks of about BLOCK_ROWS rows (a hash of the row).
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlake.functions import vectors as VF
from textlake.operators import text as TX
from textlake.session import checkpoint_root, discard, release, staged

BLOCK_DOCS, BLOCK_ROWS = 512, 16_384
#: Blocks of documents that one task makes the postings of at a time.
CHUNK_BLOCKS = 16


def fingerprint(df: DataFrame) -> str:
    """Number of rows, sum and xor of the row hashes: equal for equal rows in any order."""
    row = F.xxhash64(*df.columns)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).alias("s"), F.coalesce(F.bit_xor(row), F.lit(0)).alias("x")).first()
    return f"{r['n']}-{int(r['s']) % (1 << 64):016x}-{r['x'] % (1 << 64):016x}"


def index_root(spark: SparkSession) -> str:
    return f"{checkpoint_root(spark)}/textlake-index"


def read_manifest(spark: SparkSession, path: str) -> dict | None:
    try:
        rows = spark.read.text(f"{path}/manifest").collect()  # one row
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    return json.loads(rows[0]["value"]) if rows else None


def open_or_build(df: DataFrame, kind: str, root: str | None, build: Callable[[str, int], dict]) -> dict:
    """The manifest of the index of ``df``. ``build(folder, rows)`` writes the data and returns its figures."""
    spark = df.sparkSession
    mark = fingerprint(df)
    path = f"{(root or index_root(spark)).rstrip('/')}/{kind}-{mark}"
    found = read_manifest(spark, path)
    if found is None:
        data = f"{path}/data-{uuid.uuid4().hex[:12]}"
        found = {"kind": kind, "fingerprint": mark, "data": data, **build(data, int(mark.split("-")[0])), "built_at": dt.datetime.now(dt.timezone.utc).isoformat(timespec="seconds")}
        spark.createDataFrame([(json.dumps(found),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/manifest")
    return found


# ------------------------------------------------------------- lexical ----
@dataclass
class LexicalIndex:
    vocab: DataFrame      # term, df, idf
    blocks: DataFrame     # term, block, max_weight, postings array<struct<id, weight>>
    manifest: dict
    ngram_range: tuple[int, int]
    stop_words: tuple[str, ...] | None


def open_lexical_index(corpus: DataFrame, id_col: str = "review_id", text_col: str = "text", stop_words=None, root: str | None = None) -> LexicalIndex:
    """The inverted table of the corpus, TF-IDF weights of unigrams with unit rows."""
    spark, words = corpus.sparkSession, TX.english_stop_words() if stop_words is None else tuple(stop_words)
    rows = corpus.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"term string, block int, idf double, postings array<struct<id:{rows.schema['id'].dataType.simpleString()},tf:int,norm:double>>"

    def build(data: str, n: int) -> dict:
        n_blocks = max(1, -(-n // BLOCK_DOCS))
        packed = TX.term_counts(rows, "id", "text", (1, 1), words, packed=True)
        docs = packed.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int"))
        docs = staged(docs.withColumn("chunk", F.expr(f"block DIV {CHUNK_BLOCKS}").cast("int")).repartition("chunk").sortWithinPartitions("chunk"))
        discard(packed)
        idf = F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1
        TX.term_stats(docs, "tokens").select("term", "df", idf.alias("idf")).write.parquet(f"{data}/vocab")
        release(spark)
        vocab = spark.read.schema("term string, df long, idf double").parquet(f"{data}/vocab")
        asked = docs.select("chunk", "tokens").mapInArrow(_terms_of_chunks, "chunk int, term string")
        known = staged(asked.join(vocab.select("term", "idf"), "term").select("chunk", "term", "idf"))
        release(spark)
        made = docs.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(_postings, schema)
        made.write.parquet(f"{data}/blocks")
        discard(docs), discard(known)
        written = spark.read.parquet(f"{data}/blocks").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("postings")).alias("postings")).first()
        return {"n_docs": n, "n_blocks": n_blocks, "terms": vocab.count(), "block_rows": written["rows"], "postings": written["postings"] or 0}

    kind = f"lexical2-{zlib.crc32(chr(10).join(words).encode()):08x}"  # other stop words make another index
    found = open_or_build(rows, kind, root, build)
    vocab = spark.read.schema("term string, df long, idf double").parquet(f"{found['data']}/vocab")
    blocks = spark.read.schema(schema).parquet(f"{found['data']}/blocks")
    weighted = F.transform("postings", lambda p: F.struct(p["id"].alias("id"), (p["tf"] * F.col("idf") / p["norm"]).alias("weight")))
    most = F.array_max(F.transform("postings", lambda p: p["tf"] * F.col("idf") / p["norm"]))
    blocks = blocks.select("term", "block", most.alias("max_weight"), weighted.alias("postings"))
    return LexicalIndex(vocab, blocks, found, (1, 1), words)


def _terms_of_chunks(batches):
    """The distinct terms of each chunk's texts in a batch."""
    for batch in batches:
        chunks = batch["chunk"].to_numpy(zero_copy_only=False)
        for c in np.unique(chunks):
            part = TX.token_lists(batch["tokens"].take(pa.array(np.flatnonzero(chunks == c))))
            terms = pc.drop_null(pc.unique(part.flatten()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(terms), c, np.int32)), terms], names=["chunk", "term"])


def _postings(docs: pa.Table, known: pa.Table) -> pa.Table:
    """The rows of the index of one chunk's documents: unit rows of tf * idf, by block and term, ids in order."""
    docs = docs.sort_by([("id", "ascending")]).combine_chunks()
    ids, lists = pa.concat_arrays(docs["id"].chunks) if docs.num_rows else pa.array([], docs["id"].type), TX.token_lists(docs["tokens"].combine_chunks())
    if not isinstance(lists, pa.Array):
        lists = lists.combine_chunks()
    nulls = docs["id"].null_count  # sorted last there, first here
    blocks = docs["block"].to_numpy()
    rank = (np.arange(docs.num_rows) + nulls) % max(1, docs.num_rows)
    names, at = np.unique(known["term"].to_numpy(zero_copy_only=False).astype(object), return_index=True) if known.num_rows else (np.zeros(0, object), np.zeros(0, int))
    idf, n = known["idf"].to_numpy()[at], max(1, len(names))
    names = pa.array(names, pa.string())
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    code = pc.index_in(lists.flatten(), value_set=names).to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, tf = np.unique(np.repeat(np.arange(docs.num_rows), lengths) * n + code, return_counts=True)
    row, code = pairs // n, pairs % n
    norm = np.sqrt(np.bincount(row, (tf * idf[code]) ** 2, docs.num_rows))
    order = np.lexsort((rank[row], code, blocks[row]))
    row, code, tf = row[order], code[order], tf[order]
    block = blocks[row]
    first = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (code[1:] != code[:-1])][:len(row)])
    postings = pa.StructArray.from_arrays([ids.take(pa.array(row)), pa.array(tf.astype(np.int32)), pa.array(norm[row])], names=["id", "tf", "norm"])
    return pa.table({"term": names.take(pa.array(code[first])), "block": pa.array(block[first].astype(np.int32)), "idf": pa.array(idf[code[first]]),
                     "postings": pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)].astype(np.int32)), postings)})


# -------------------------------------------------------------- vectors ---
@dataclass
class VectorIndex:
    rows: DataFrame       # block, id column, vec, kept columns
    manifest: dict


def row_checksum(id_col: str, vec_col: str) -> Column:
    """60 bits of the MD5 of id and components in millionths; engines that have MD5
    compute the same, so a copy can be compared elsewhere by the sum over its rows."""
    parts = F.array_join(F.transform(vec_col, lambda x: F.round(x.cast("double") * 1e6).cast("long").cast("string")), ",")
    digest = F.md5(F.concat(F.col(id_col).cast("string"), F.lit(":"), parts).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("decimal(38,0)")


def open_vector_index(vectors: DataFrame, id_col: str = "review_id", vec_col: str = "embedding", keep: list[str] | None = None, root: str | None = None) -> VectorIndex:
    """Unit vectors and the columns to return, in blocks. R7: the manifest has
    the number of rows, dimension, bytes of the vectors, build time and checksum."""
    spark, kept = vectors.sparkSession, list(keep or [])
    rows = vectors.select(id_col, vec_col, *kept)

    def build(data: str, n: int) -> dict:
        n_blocks = max(1, -(-n // BLOCK_ROWS))
        out = rows.select(F.pmod(F.xxhash64(id_col, vec_col), F.lit(n_blocks)).cast("int").alias("block"), id_col, VF.l2_normalize(vec_col).alias("vec"), *kept)
        out.repartition("block").sortWithinPartitions("block", id_col).write.parquet(data)
        size = F.when(F.col(vec_col).isNotNull(), F.size(vec_col))
        r = rows.agg(F.max(size).alias("d"), F.sum(size).alias("cells"), F.sum(row_checksum(id_col, vec_col)).alias("s")).first()
        return {"n": n, "n_blocks": n_blocks, "dimension": r["d"] or 0, "bytes": 8 * (r["cells"] or 0), "checksum": str(int(r["s"] or 0))}

    found = open_or_build(rows, "vectors-" + "-".join([id_col, vec_col, *kept]), root, build)
    return VectorIndex(spark.read.parquet(found["data"]), found)


def search_texts(index: VectorIndex, texts: DataFrame, encode: Callable[[DataFrame], DataFrame], k: int = 10, qid_col: str = "query_id", id_col: str = "review_id",
                 threshold: float | None = None) -> DataFrame:
    """R2 from text: ``encode`` is any job (query_id, query) -> (query_id, embedding), the one that made the index's vectors."""
    from textlake.operators.search import semantic_search

    queries = encode(texts).select(F.col(qid_col).alias("query_id"), VF.l2_normalize("embedding").alias("vec"))
    return semantic_search(index, queries, k, id_col, threshold)


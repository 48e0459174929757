"""Vector and lexical search.

Exact vector search
-------------------
Corpus and queries are cut into blocks by a hash, and every block of the one
meets every block of the other by a join key, once (BLOCK_ROWS x QUERY_BLOCK
rows at most a group): numpy multiplies the two and keeps the k best rows of
each query, so a group gives at most ``queries * k`` rows. A final
``row_number() <= k`` per query (WindowGroupLimit) merges them. Neither side
passes the driver. The corpus may be a written index or any (id, vec) table.

Ties are broken the same way everywhere: score rounded to 6 digits,
descending, then id ascending.

Lexical search
--------------
The sum of query weight * largest weight of a block bounds the score of all
documents of the block. The SEED_BLOCKS blocks of largest bound are scored
first; their k-th score leaves only the blocks whose bound reaches it, and only
the postings of these are read further. All postings of a block are in one row a
term, so the terms asked for meet by block, numpy multiplies them with the queries
and only the best documents of every block go on. Query weights are sent to the
tasks up to SENT_ROWS of them; more are joined.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from textlake.functions import vectors as VF
from textlake.operators import indexes as IX
from textlake.operators import text as TX
from textlake.session import release, staged

BLOCK_CELLS = 1 << 21
QUERY_BLOCK = 1024
SEED_BLOCKS = 4
#: Rows of query weights that are sent to all tasks; cells of a piece of a block's scores.
SENT_ROWS, PIECE = 200_000, 1024
DIGITS = 6
#: Bounds and scores are sums of doubles in any order, and scores are rounded.
SLACK = 2e-6


def build_vector_index(vectors: DataFrame, id_col: str = "review_id", vec_col: str = "embedding",
                       keep: list[str] | None = None) -> DataFrame:
    """R1 without a written index: L2-normalized vectors plus the document columns to return."""
    return vectors.select(id_col, VF.l2_normalize(vec_col).alias("vec"), *(keep or []))


def index_stats(index: DataFrame, label_col: str = "label") -> DataFrame:
    """Documents, dimension, share of each label (long form)."""
    total = index.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()
    return total.select(label_col, "n",
                        F.round(F.col("n") * 100.0 / F.sum("n").over(w), 6).alias("share"),
                        F.sum("n").over(w).alias("total_docs"))


def _topk_merge(cols: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int):
    """Keep the top-k entries of every query column by (score desc, id asc).
    Flat (column, score, id) arrays in, flat arrays out; fully vectorized."""
    order = np.lexsort((ids, -scores, cols))
    cols, scores, ids = cols[order], scores[order], ids[order]
    first = np.r_[0, np.flatnonzero(np.diff(cols)) + 1]
    start = np.repeat(first, np.diff(np.r_[first, len(cols)]))
    keep = (np.arange(len(cols)) - start) < k
    return cols[keep], scores[keep], ids[keep]


def _block_candidates(block: np.ndarray, ids: np.ndarray, k: int):
    """Per query column of a (rows x queries) score block: every entry at or
    above the column's k-th largest score (ties kept, so the exact tie-break
    by id happens in ``_topk_merge``)."""
    n = block.shape[0]
    if n > k:
        kth = np.partition(block, n - k, axis=0)[n - k]
        mask = block >= kth[None, :]
    else:
        mask = np.ones_like(block, dtype=bool)
    mask &= np.isfinite(block)
    r, c = np.nonzero(mask)
    return c, block[r, c], ids[r]


def _scorer(bq, k: int, id_col: str, threshold: float | None):
    """``bq.value``: (query ids, query matrix). Corpus batches are scored in
    blocks of at most BLOCK_CELLS scores, so task memory does not grow with
    the batch size times the number of queries."""
    def run(batches):
        qids, qmat = bq.value
        step = max(1, BLOCK_CELLS // max(1, len(qids)))
        bc = np.empty(0, dtype=np.int64)
        bs = np.empty(0)
        bi = np.empty(0, dtype=np.int64)
        for pdf in batches:
            if pdf.empty:
                continue
            all_ids = pdf[id_col].to_numpy(dtype=np.int64)
            vecs = pdf["vec"].to_numpy()
            for lo in range(0, len(all_ids), step):
                ids = all_ids[lo:lo + step]
                mat = np.stack(vecs[lo:lo + step]).astype(np.float64)
                block = np.round(mat @ qmat.T, DIGITS) + 0.0  # no negative zero
                if threshold is not None:
                    block[block < threshold] = -np.inf
                c, sc, i = _block_candidates(block, ids, k)
                bc, bs, bi = _topk_merge(np.r_[bc, c], np.r_[bs, sc], np.r_[bi, i], k)
        yield pd.DataFrame({"query_id": qids[bc].astype(np.int64) if len(bc) else np.empty(0, dtype=np.int64),
                            id_col: bi, "score": bs})
    return run


@dataclass
class QueryBlock:
    value: tuple[np.ndarray, np.ndarray]  # ids, matrix


def semantic_search(index, queries: DataFrame, k: int = 10, id_col: str = "review_id",
                    threshold: float | None = None) -> DataFrame:
    """R2 (+R3): exact inner-product top-k of each query over the index.

    ``queries``: (query_id bigint, vec array<double>), normalized by the caller
    or not (inner product is what is ranked, as in a flat IP index).
    ``index``: a ``VectorIndex`` or (id, vec) with unit vectors. Returns
    (query_id, id, score, rank).
    """
    q = staged(queries.select(F.col("query_id").cast("long"), F.col("vec")).where("query_id IS NOT NULL AND vec IS NOT NULL"))
    q_blocks = max(1, -(-q.count() // QUERY_BLOCK))
    if isinstance(index, IX.VectorIndex):
        n_blocks, corpus = index.manifest["n_blocks"], index.rows
    else:
        n_blocks = max(1, -(-index.count() // IX.BLOCK_ROWS))
        corpus = index.withColumn("block", F.pmod(F.xxhash64(id_col, "vec"), F.lit(n_blocks)).cast("int"))
    corpus = corpus.select("block", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q_block"), F.col(id_col).cast("long"), "vec").where(F.col("vec").isNotNull())
    q = q.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int").alias("q_block"), "query_id", "vec")

    def score(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or asked.empty:
            return pd.DataFrame({"query_id": np.empty(0, np.int64), id_col: np.empty(0, np.int64), "score": np.empty(0)})
        block = QueryBlock((asked["query_id"].to_numpy(dtype=np.int64), np.stack(asked["vec"].to_numpy()).astype(np.float64)))
        return next(_scorer(block, k, id_col, threshold)(iter([rows])))

    key = ["block", "q_block"]
    cand = corpus.groupBy(*key).cogroup(q.groupBy(*key)).applyInPandas(score, f"query_id long, {id_col} long, score double")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col(id_col))
    return cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hits_to_docs(hits: DataFrame, docs: DataFrame, id_col: str = "review_id") -> DataFrame:
    """Attach document columns to the (small, k per query) hit list."""
    return hits.join(docs, id_col, "inner")


def build_lexical_index(corpus: DataFrame, id_col: str = "review_id", text_col: str = "text",
                        stop_words=None, root: str | None = None) -> IX.LexicalIndex:
    """The written index of the corpus (unigrams, English stop words), reused if there is one."""
    return IX.open_lexical_index(corpus, id_col, text_col, stop_words, root)


@dataclass
class LexicalPlan:
    """What a search reads: query weights, the bound of every (query, block), the
    scores of the first blocks, and the (query, block) that are scored after them."""
    weights: DataFrame
    bounds: DataFrame
    seeds: DataFrame
    rest: DataFrame


def _block_scores(index: IX.LexicalIndex, weights: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score) of the documents of the (query, block) pairs that share a term with
    their query: those that are among the best ``k`` of their block, or all."""
    if weights.count() <= SENT_ROWS:
        return _sent_scores(index, weights, pairs, k)
    asked = pairs.select("query_id", "block").join(weights, "query_id")
    hits = asked.join(index.blocks.select("term", "block", "postings"), ["term", "block"]).select("query_id", "qw", F.explode("postings").alias("p"))
    scores = hits.groupBy("query_id", F.col("p.id").alias("id")).agg(F.round(F.sum(F.col("qw") * F.col("p.weight")), DIGITS).alias("score"))
    return scores.where("score > 0")


def _sent_scores(index: IX.LexicalIndex, weights: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    qid, iid = weights.schema["query_id"].dataType, index.blocks.schema["postings"].dataType.elementType["id"].dataType
    asked = weights.toArrow()  # SENT_ROWS rows
    terms = pc.unique(asked["term"])
    queries = pc.unique(asked["query_id"])
    sent = weights.sparkSession.sparkContext.broadcast((terms, queries, pc.index_in(asked["query_id"], value_set=queries).to_numpy(), pc.index_in(asked["term"], value_set=terms).to_numpy(), asked["qw"].to_numpy()))

    def score(rows: pa.Table, of: pa.Table) -> pa.Table:
        terms, queries, wq, wt, qw = sent.value
        mine = pc.index_in(pc.unique(of["query_id"].combine_chunks()), value_set=queries).to_numpy(zero_copy_only=False)
        lists = rows["ids"].combine_chunks()
        lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
        found = lists.flatten().dictionary_encode(null_encoding="encode")
        doc, n = found.indices.to_numpy(zero_copy_only=False), len(found.dictionary)
        code = np.repeat(pc.index_in(rows["term"].combine_chunks(), value_set=terms).to_numpy(zero_copy_only=False), lengths)
        weight = rows["ws"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        used = np.unique(code)
        out = [[], [], []]
        for a in range(0, len(mine), PIECE):
            some = mine[a:a + PIECE]
            at = np.full(len(queries), -1)
            at[some] = np.arange(len(some))
            s = np.zeros((len(some), n))
            for b in range(0, len(used), 4 * PIECE):
                part = used[b:b + 4 * PIECE]
                place = np.full(len(terms), -1)
                place[part] = np.arange(len(part))
                x, y = np.zeros((len(some), len(part))), np.zeros((len(part), n))
                own = (at[wq] >= 0) & (place[wt] >= 0)
                x[at[wq[own]], place[wt[own]]] = qw[own]
                own = place[code] >= 0
                y[place[code[own]], doc[own]] = weight[own]
                s += x @ y
            least = np.partition(s, n - k, axis=1)[:, n - k] - SLACK if n > k else np.zeros(len(some))
            q, d = np.nonzero((s >= least[:, None]) & (s > 0))
            for to, x in zip(out, (some[q], d, s[q, d])):
                to.append(x)
        q, d, s = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)
        return pa.table({"query_id": queries.take(pa.array(q.astype(np.int64))), "id": found.dictionary.take(pa.array(d.astype(np.int64))), "score": pa.array(s.astype(np.float64))})

    rows = index.blocks.join(F.broadcast(weights.select("term").distinct()), "term", "left_semi").select("term", "block", F.col("postings.id").alias("ids"), F.col("postings.weight").alias("ws"))
    rows = rows.join(pairs.select("block").distinct(), "block", "left_semi")
    scores = rows.groupBy("block").cogroup(pairs.select("block", "query_id").groupBy("block")).applyInArrow(score, f"query_id {qid.simpleString()}, id {iid.simpleString()}, score double")
    return scores.select("query_id", "id", F.round("score", DIGITS).alias("score")).where("score > 0")


def lexical_plan(index: IX.LexicalIndex, queries: DataFrame, k: int, qid_col: str = "query_id", text_col: str = "query") -> LexicalPlan:
    q = queries.where(F.trim(F.col(text_col)) != "").select(F.col(qid_col).alias("query_id"), F.col(text_col).alias("query"))
    model = TX.TfidfModel(index.vocab, None, None, "query_id", index.ngram_range, index.stop_words)
    weights = staged(TX.transform_tfidf(model, q, "query_id", "query").withColumnRenamed("weight", "qw"))
    release(weights.sparkSession)
    heads = index.blocks.select("term", "block", "max_weight").join(F.broadcast(weights) if weights.count() <= SENT_ROWS else weights, "term")
    bounds = staged(heads.groupBy("query_id", "block").agg(F.sum(F.col("qw") * F.col("max_weight")).alias("bound")))
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    first = bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SEED_BLOCKS).drop("r")
    first = staged(first)
    seeds = staged(_block_scores(index, weights, first, k))
    release(weights.sparkSession)
    kth = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    least = seeds.withColumn("r", F.row_number().over(kth)).where(F.col("r") == k).select("query_id", F.col("score").alias("least"))
    rest = bounds.join(first, ["query_id", "block"], "left_anti").join(least, "query_id", "left")
    return LexicalPlan(weights, bounds, seeds, staged(rest.where(F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least")))))


def lexical_search(index: IX.LexicalIndex, queries: DataFrame, k: int = 10, id_col: str = "review_id",
                   qid_col: str = "query_id", text_col: str = "query") -> DataFrame:
    """Cosine of each query against the corpus; zero scores dropped;
    at most ``k`` hits per query; blank queries give no rows."""
    plan = lexical_plan(index, queries, k, qid_col, text_col)
    scores = plan.seeds.unionByName(_block_scores(index, plan.weights, plan.rest, k))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    top = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return top.select(F.col("query_id").alias(qid_col), F.col("id").alias(id_col), "score", "rank")

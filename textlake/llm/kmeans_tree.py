"""Approximate nearest neighbours by cosine: a hierarchical k-means tree.

1. A tree of unit centroids is fitted on a bounded sample and broadcast. It has
   about sqrt(rows) leaves, MAX_LEAVES at most.
2. Every row goes to the leaf that it reaches by the nearest centroids.
3. A query walks the tree best bin first, with a priority queue over the
   cosine of the centroids, and visits the first leaves it pops. The number of
   visits is widened until sample queries, whose true neighbours come from one
   exact pass over all rows, find TARGET of them.
4. Visits and rows meet by leaf, in blocks of bounded size on either side; each
   block gives its best rows per query, and the best of all are kept.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import stage

#: Rows the tree is fitted on, and queries the visits are calibrated on.
SAMPLE, CALIBRATION = 20_000, 256
BRANCH, MAX_LEAVES = 8, 4096
TARGET = 0.97
#: Rows, and queries, of one block of a leaf.
BLOCK = 4096


class Tree:
    """Unit centroids of a k-means tree and its leaves."""

    def __init__(self, x: np.ndarray, leaves: int, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.center, self.children = [x.mean(axis=0) if len(x) else np.zeros(0)], [[]]
        heap, count = [(-len(x), 0, np.arange(len(x)))], 1
        while heap and count < leaves:
            size, node, rows = heapq.heappop(heap)
            parts = self._split(x[rows], min(BRANCH, leaves - count + 1), rng)
            if len(parts) < 2:
                continue
            count += len(parts) - 1
            for center, own in parts:
                self.children[node].append(len(self.center))
                heapq.heappush(heap, (-len(own), len(self.center), rows[own]))
                self.center.append(center), self.children.append([])
        self.center = np.array(self.center)
        self.leaf = np.full(len(self.children), -1)
        ends = [i for i, c in enumerate(self.children) if not c]
        self.leaf[ends] = np.arange(len(ends))
        self.n_leaves = len(ends)

    @staticmethod
    def _split(x: np.ndarray, k: int, rng) -> list[tuple[np.ndarray, np.ndarray]]:
        """Spherical k-means: (unit centroid, rows) of the parts that are not empty."""
        start = np.unique(x, axis=0) if len(x) <= 4 * k else x
        if len(start) < 2 or k < 2:
            return []
        c = start[rng.choice(len(start), min(k, len(start)), replace=False)]
        for _ in range(8):
            near = (x @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, x)
            norm = np.linalg.norm(sums, axis=1, keepdims=True)
            c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
        near = (x @ c.T).argmax(axis=1)
        return [(c[j], np.flatnonzero(near == j)) for j in range(len(c)) if (near == j).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each unit row."""
        out, todo = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not kids:
                out[rows] = self.leaf[node]
                continue
            near = (x[rows] @ self.center[kids].T).argmax(axis=1)
            todo += [(k, rows[near == j]) for j, k in enumerate(kids) if (near == j).any()]
        return out

    def walk(self, q: np.ndarray):
        """The leaves, best bin first."""
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            kids = self.children[node]
            if not kids:
                yield int(self.leaf[node])
                continue
            for far, kid in zip(-(self.center[kids] @ q), kids):
                heapq.heappush(heap, (far, kid))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as float64."""
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def best(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int):
    """Per query, the k rows of largest cosine (ties: smaller id), without rows
    of its own id: (query row, row, score). A block product finds the rows near
    the k-th score; these are scored again one by one, so equal vectors tie."""
    lengths, q_lengths = (np.sqrt(np.einsum("ij,ij->i", m, m)) for m in (x, q))
    rough = (q / q_lengths[:, None]) @ (x / lengths[:, None]).T
    rough[q_ids[:, None] == ids[None, :]] = -np.inf
    n = min(k, len(ids))
    for i, row in enumerate(rough):
        near = np.flatnonzero((row >= np.partition(row, len(ids) - n)[len(ids) - n] - 1e-9) & (row > -np.inf))
        score = np.einsum("ij,j->i", x[near], q[i]) / (lengths[near] * q_lengths[i])
        top = np.lexsort((ids[near], -score))[:k]
        for j in top:
            yield i, near[j], float(score[j])


def valid_vectors(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, v) of the rows that take part, and their dimension: id and vector
    not null, all components finite, not all zero, of the commonest length
    (ties: the longer)."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = sizes["d"] if sizes else 0
    return rows.where(F.size("v") == dim), dim


def _calibrate(rows: DataFrame, tree: Tree, dim: int, k: int) -> int:
    """Leaf visits at which the sample queries find TARGET of their k nearest rows."""
    sample = rows.orderBy(F.xxhash64("id", F.lit(1)), "id").limit(CALIBRATION).toPandas()
    sent = rows.sparkSession.sparkContext.broadcast((sample.id.to_numpy(), np.stack(sample.v.to_numpy())))

    def exact(batches):
        q_ids, q = sent.value
        for batch in batches:
            ids, x, leaf = batch.column(0).to_numpy(), _matrix(batch.column(1), dim), batch.column(2).to_numpy()
            for a in range(0, len(ids), 8192):
                found = list(best(q_ids, q, ids[a:a + 8192], x[a:a + 8192], k))
                if found:
                    i, j, s = (np.array(c) for c in zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(ids[a + j]), pa.array(leaf[a + j]), pa.array(s)], names=["q", "id", "leaf", "score"])

    near = rows.select("id", "v", "leaf").mapInArrow(exact, "q long, id long, leaf long, score double")
    first = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
    near = near.withColumn("r", first).where(F.col("r") <= k).select("q", "leaf").toPandas()  # CALIBRATION * k rows
    place = {}
    for i, v in enumerate(_unit(sent.value[1])):
        place[i] = {leaf: at for at, leaf in enumerate(tree.walk(v))}
    at = np.array([place[q][leaf] for q, leaf in near.itertuples(index=False, name=None)])
    visits = 1
    while len(at) and (at < visits).mean() < TARGET and visits < tree.n_leaves:
        visits = max(visits + 1, int(visits * 1.1))
    return min(visits, tree.n_leaves)


def nearest(vectors: DataFrame, is_query, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, id_col, score): the ``k`` rows of largest cosine found
    for each row where ``is_query`` holds, nearest first, ties to the smaller
    id; all candidates if there are fewer. Rows that share the query's id are
    no candidates of it; a query id that repeats is asked once, with the
    smallest of its vectors. Invalid vectors (see ``valid_vectors``) take no part.
    """
    spark = vectors.sparkSession
    rows, dim = valid_vectors(vectors, id_col, vector_col)
    rows = stage(rows, "vectors")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score double")
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toPandas()
    x = _unit(np.stack(sample.v.to_numpy())) if len(sample) else np.zeros((0, max(dim, 1)))
    tree = Tree(x, int(min(MAX_LEAVES, max(1, total ** 0.5))))
    sent = spark.sparkContext.broadcast(tree)

    def place(batches):
        for batch in batches:
            leaf = sent.value.assign(_unit(_matrix(batch.column(1), dim))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf, pa.int64())], names=["id", "v", "leaf"])

    indexed = stage(rows.mapInArrow(place, "id long, v array<double>, leaf long"), "leaves")
    visits = _calibrate(indexed, tree, dim, k)
    sizes = dict(indexed.groupBy("leaf").count().collect())  # MAX_LEAVES rows at most

    def walk(batches):
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for i, q in enumerate(_unit(_matrix(batch.column(1), dim)) if batch.num_rows else []):
                seen = 0
                for n, leaf in enumerate(sent.value.walk(q)):
                    if n >= visits and seen > k:
                        break
                    seen += sizes.get(leaf, 0)
                    out[0].append(i), out[1].append(leaf)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int64())], names=["query_id", "leaf"])

    asked = indexed.where(is_query(F.col("id"))).groupBy("id").agg(F.min("v").alias("v"))
    visit = stage(asked.mapInArrow(walk, "query_id long, leaf long"), "visits")
    parts = visit.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("q_parts"))
    parts = parts.join(indexed.groupBy("leaf").agg(F.ceil(F.count("*") / BLOCK).alias("parts")), "leaf")
    parts = stage(parts, "parts")
    left = indexed.join(parts.hint("merge"), "leaf")
    left = left.select("leaf", F.expr("pmod(xxhash64(id), parts)").alias("part"), F.explode(F.expr("sequence(0L, q_parts - 1)")).alias("q_part"), "id", "v")
    right = visit.join(parts.hint("merge"), "leaf")
    right = right.select("leaf", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"), F.expr("pmod(xxhash64(query_id), q_parts)").alias("q_part"), "query_id")
    right = right.join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("q")).hint("merge"), "query_id")

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            ids, x = a.id.to_numpy(), np.stack(a.v.to_numpy())
            for i in range(0, len(b), 256):
                q_ids, q = b.query_id.to_numpy()[i:i + 256], np.stack(b.q.to_numpy()[i:i + 256])
                out += [(q_ids[r], ids[j], s) for r, j, s in best(q_ids, q, ids, x, k)]
        return pd.DataFrame(out, columns=["query_id", "id", "score"])

    key = ["leaf", "part", "q_part"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, "query_id long, id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return found.select("query_id", "rank", F.col("id").alias(id_col), "score")

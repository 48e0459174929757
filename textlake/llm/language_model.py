"""Whole-document log-probabilities by a gated recurrent language model.

Tokens are white-space words (A-Z lower-cased) and an end after each document.

1. Every training token is counted: pre-aggregated in the tasks, then summed.
   The count table stays distributed.
2. The HEAD most frequent tokens travel to the tasks with their counts. The
   first IDS of them, and one id for all other words, are the ids of the
   recurrent model (module ``gru``).
3. Rounds of local training: replicas of one million ids each, whose weights
   are averaged by ids seen. Every training row is dealt to one round, by a
   hash of the row, so all rounds together are one pass over all of them.
4. Each document is scored whole, the state carried from window to window.
   A word without an id gets the probability of the "other" id times its
   smoothed share among such words; words outside HEAD get their counts by a
   join, everything else is known in the task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm import gru
from textlake.llm.common import row_blocks, shared_path, stage, text_buffer
from textlake.llm.words import SPACE, U, Words

#: Tokens whose counts are broadcast (16 bytes each), and those that the model predicts one by one.
HEAD, IDS = 1 << 17, 2046
#: One training document in SHARE is trained on in each of ROUNDS rounds, in replicas of REPLICA ids.
SHARE, REPLICA, RATE = 16, 1_000_000, 0.02
ROUNDS = SHARE
#: Replicas are summed in so many parts at most, and then the parts.
PARTS = 64
#: Bytes of text (and rows) whose ids a task holds to score them side by side.
HELD = 24 << 20
#: Distinct tokens that a task holds before it passes their counts on.
FLUSH = 1 << 20
END = 0x656E64


def _tokens(hasher: Words, buf, offs):
    """Token hashes row after row, each row closed by END, and the row bounds."""
    _, _, h, row = hasher.find(buf, offs)
    n = len(offs) - 1
    edge = np.searchsorted(row, np.arange(n + 1))
    out = np.full(len(h) + n, END, U)
    out[np.arange(len(h)) + row] = h
    return out, edge + np.arange(n + 1)


def _count(batches):
    hasher = Words(SPACE)
    keys, counts = np.empty(0, U), np.empty(0, np.int64)

    def emit():
        return pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], names=["h", "n"])

    for batch in batches:
        buf, offs = text_buffer(batch.column(0))
        for i, j in row_blocks(offs, 8 << 20):
            h, n = np.unique(_tokens(hasher, buf, offs[i:j + 1])[0], return_counts=True)
            keys, back = np.unique(np.concatenate((keys, h)), return_inverse=True)
            counts = np.bincount(back, weights=np.concatenate((counts, n)), minlength=len(keys)).astype(np.int64)
            if len(keys) >= FLUSH:
                yield emit()
                keys, counts = np.empty(0, U), np.empty(0, np.int64)
    if len(keys):
        yield emit()


class _Head:
    """Lookup of the broadcast tokens: their count and, for the first IDS, their id."""

    def __init__(self, head: dict):
        self.keys, self.counts, self.ids = head["keys"], head["counts"], head["ids"]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table or -1, model id) of each token."""
        at = np.minimum(np.searchsorted(self.keys, h), max(len(self.keys) - 1, 0))
        if not len(self.keys):
            return np.full(len(h), -1), np.zeros(len(h), np.int64)
        hit = self.keys[at] == h
        return np.where(hit, at, -1), np.where(hit, self.ids[at], 0)


def _head(counts: DataFrame) -> dict:
    """The HEAD most frequent tokens, sorted by hash. Model id 0 is "other"; the rest by falling frequency."""
    rows = counts.orderBy(F.desc("c"), "h").limit(HEAD).toPandas()
    h, c = rows["h"].to_numpy(np.int64).view(U), rows["c"].to_numpy(np.int64)
    is_end = h == U(END)
    chosen = np.flatnonzero(is_end | (np.arange(len(h)) < IDS))
    ids = np.zeros(len(h), np.int64)
    ids[chosen] = np.arange(1, len(chosen) + 1)
    order = np.argsort(h)
    return {"keys": h[order], "counts": c[order], "ids": ids[order], "n_ids": len(chosen) + 1, "named": int(c[chosen].sum()),
            "freq": c[chosen], "end": int(ids[is_end][0]) if is_end.any() else 0}


def _sequences(sent):
    def run(batches):
        hasher, head = Words(SPACE), _Head(sent.value)
        for batch in batches:
            buf, offs = text_buffer(batch.column(1))
            for i, j in row_blocks(offs, 4 << 20):
                h, edge = _tokens(hasher, buf, offs[i:j + 1])
                ids = head.find(h)[1].astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(ids))], names=["turn", "ids"])
    return run


def _replica(sent, weights):
    """Trains on a partition; returns its weights in blocks, as they are, and the ids it has seen."""
    def run(batches):
        seqs = [np.asarray(x.values, dtype=np.int64) for b in batches for x in b.column(0)]
        if not seqs:
            return
        p, seen = gru.train(weights.value, seqs, sent.value["end"], rate=RATE)
        for k in sorted(p):
            flat = p[k].ravel()
            parts = [flat[i:i + 8192] for i in range(0, len(flat), 8192)]
            yield pa.RecordBatch.from_pydict({"name": [k] * len(parts), "block": list(range(len(parts))),
                                              "part": [(len(seqs[0]) * 31 + seen) % PARTS] * len(parts), "seen": [seen] * len(parts), "w": parts})
    return run


def _sum(key: tuple, seen: pd.Series, w: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"name": [key[0]], "block": [key[1]], "seen": [int(seen.sum())], "w": [w.sum(axis=0)]})


def _sum_within(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
    """The replicas' weights, as doubles, times the ids seen."""
    return _sum(key, t.seen, np.stack(t.w.to_numpy()).astype(np.float64) * t.seen.to_numpy()[:, None])


def _sum_all(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
    return _sum(key, t.seen, np.stack(t.w.to_numpy()))


def _summed(rows: DataFrame, replicas: int) -> DataFrame:
    """(name, block, seen, w): sums over the replicas, in two steps if there are more than PARTS, so no task sees them all."""
    shape = "name string, block long, seen long, w array<double>"
    if replicas <= PARTS:
        return rows.groupBy("name", "block").applyInPandas(_sum_within, shape)
    rows = rows.groupBy("name", "block", "part").applyInPandas(_sum_within, shape)
    return rows.groupBy("name", "block").applyInPandas(_sum_all, shape)


def _train(docs: DataFrame, id_col: str, sent, head: dict) -> dict:
    """Averaged weights after ROUNDS rounds."""
    total = max(head["total"], 1)
    counts = np.concatenate(([max(total - head["named"], 0)], head["freq"]))
    params = gru.init(counts)
    sc = docs.sparkSession.sparkContext
    # Null and repeated ids, and repeated rows, are spread over the turns too.
    turn_of = F.pmod(F.xxhash64(id_col, "text", F.monotonically_increasing_id()), F.lit(SHARE))
    path = shared_path(docs.sparkSession, "sequences")
    docs.select(turn_of.alias("turn"), "text").mapInArrow(_sequences(sent), "turn long, ids array<int>").write.partitionBy("turn").parquet(path)
    share = docs.sparkSession.read.schema("ids array<int>, turn long").parquet(path)
    size = {r.turn: r.n for r in share.groupBy("turn").agg(F.sum(F.size("ids")).alias("n")).collect()}  # SHARE rows
    shape = "name string, block long, part long, seen long, w array<float>"
    for turn in range(ROUNDS):
        n = size.get(turn, 0)
        if not n:
            continue
        weights = sc.broadcast(params)
        ids = share.where(F.col("turn") == turn).select("ids")
        replicas = max(1, round(n / REPLICA))
        done = _summed(ids.repartition(replicas).mapInArrow(_replica(sent, weights), shape), replicas).toPandas()
        flat = {k: np.concatenate([w / s for w, s in zip(t.w, t.seen)]) for k, t in done.sort_values("block").groupby("name")}
        params = {k: flat[k].reshape(v.shape).astype(np.float32) for k, v in params.items()}
    return params


def _rare(h: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """Per row the distinct tokens and their numbers."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(len(h), 1), bool), (h[1:] != h[:-1]) | (row[1:] != row[:-1]))))
    pairs = pa.StructArray.from_arrays([pa.array(h[first].view(np.int64)), pa.array(np.diff(np.append(first, len(h))))], names=["h", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row[first], np.arange(n + 1)).astype(np.int32)), pairs)


def _scorer(sent, weights, carried: list[str]):
    names = [*carried, "n_tokens", "n_known", "base_score", "score", "rare"]

    def scored(held):
        """The held blocks with their scores: sequences of like length of all of them go side by side."""
        seqs = [ids[i:j] for _, ids, edge, _, _ in held for i, j in zip(edge, edge[1:])]
        model, at = gru.score(weights.value, seqs, sent.value["end"]) / np.log(10), 0
        for known, _, edge, tail, rare in held:
            n = len(edge) - 1
            yield pa.RecordBatch.from_arrays([*known, pa.array(model[at:at + n] + tail), rare], names=names)
            at += n

    def run(batches):
        hasher, head = Words(SPACE), _Head(sent.value)
        v, held, size_held = sent.value, [], 0
        log = np.log10
        base_low = log(v["total"] + 0.5 * (v["types"] + 1))
        tail_low = log(v["total"] - v["named"] + 0.5 * (v["types"] - v["n_ids"] + 2))
        for batch in batches:
            buf, offs = text_buffer(batch.column("text"))
            for i, j in row_blocks(offs, 8 << 20):
                h, edge = _tokens(hasher, buf, offs[i:j + 1])
                at, ids = head.find(h)
                row = np.repeat(np.arange(j - i), np.diff(edge))
                count = head.counts[at] if len(head.counts) else np.zeros(len(h))
                own = np.where(at >= 0, log(count + 0.5), 0.0)
                add = lambda x: np.bincount(row, weights=x, minlength=j - i)
                # Words without an id: their smoothed share among such words; those outside HEAD lack their count as yet.
                tail = add(np.where((ids == 0) & (at >= 0), own - tail_low, 0.0))
                size = np.diff(edge)
                known = [*(batch.column(c).slice(i, j - i) for c in carried), pa.array(size), pa.array(add(at >= 0).astype(np.int64)), pa.array(add(own) - size * base_low)]
                held.append((known, ids.astype(np.int32), edge, tail, _rare(h[at < 0], row[at < 0], j - i)))
                size_held += int(offs[j] - offs[i]) + j - i
                if size_held >= HELD:
                    yield from scored(held)
                    held, size_held = [], 0
        if held:
            yield from scored(held)
    return run


def score_documents(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, keep, n_tokens, n_known, train_tokens, base_score, score), a row per row of ``docs``.

    ``base_score`` is the add-half unigram log10 probability of the tokens and
    the end, ``score`` that of the recurrent model. Null and empty texts are an
    end alone. Without training rows every token is unknown. Null and repeated
    ids are kept; columns other than those named are not read.
    """
    spark = docs.sparkSession
    counts = train.select(F.col(text_col).alias("text")).mapInArrow(_count, "h long, n long")
    counts = stage(counts.groupBy("h").agg(F.sum("n").alias("c")), "counts")
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = _head(counts) | {"total": int(total), "types": int(types)}
    sent = spark.sparkContext.broadcast(head)
    weights = spark.sparkContext.broadcast(_train(train.select(id_col, F.col(text_col).alias("text")), id_col, sent, head))

    own = [F.col(c).alias(f"_{i}") for i, c in enumerate((id_col, *keep))]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), *own, F.col(text_col).alias("text"))
    carried = [f for f in rows.schema if f.name != "text"]
    shape = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in carried)
    shape += "n_tokens long, n_known long, base_score double, score double, rare array<struct<h:long,n:long>>"
    rows = stage(rows.mapInArrow(_scorer(sent, weights, [f.name for f in carried]), shape), "scored")
    rare = rows.select("rid", F.explode("rare").alias("w")).select("rid", "w.h", "w.n")
    rare = rare.join(counts.hint("merge"), "h", "left")
    c = F.coalesce("c", F.lit(0))
    tail_low = float(np.log10(head["total"] - head["named"] + 0.5 * (head["types"] - head["n_ids"] + 2)))
    rare = rare.groupBy("rid").agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("own"), F.sum("n").alias("words"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("seen"))
    out = rows.drop("rare").join(rare.hint("merge"), "rid", "left")
    zero = F.lit(0)
    own = [F.col(f"_{i}").alias(c) for i, c in enumerate((id_col, *keep))]
    return out.select(*own, "n_tokens", (F.col("n_known") + F.coalesce("seen", zero)).cast("long").alias("n_known"),
                      F.lit(head["total"]).cast("long").alias("train_tokens"),
                      (F.col("base_score") + F.coalesce("own", zero)).alias("base_score"),
                      (F.col("score") + F.coalesce("own", zero) - F.coalesce("words", zero) * tail_low).alias("score"))

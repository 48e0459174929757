"""Deterministic sampling and splitting.

Every sampler orders rows by ``md5(id || ':' || seed)``. That order is
independent of partitioning and the same in any SQL engine, so samples are
reproducible and checkable.

Exact per-class ranks without a per-class window
------------------------------------------------
``row_number() over (partition by class order by key)`` puts a whole class
into one task; with 3-5 classes (and one class holding two thirds of the
corpus) that does not scale. Instead the key's first hex digits define
ordered buckets (4096 by default):

1. count rows per (class, bucket) -- a partial+final aggregate, tiny output;
2. prefix-sum the bucket counts per class (window over <= 4096 rows/class);
3. a bucket whose rank range contains no cut is assigned wholesale;
4. only buckets that straddle a cut are ranked exactly, by a window
   partitioned by (class, bucket) -- about n_class/4096 rows each.

The result is identical to the plain window (same ties: key, then id).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

SEED = 42
HEX_DIGITS = 3  # 16**3 = 4096 buckets


def hash_key(id_col: str, seed: int = SEED) -> Column:
    """md5 of ``id:seed`` as 32 lowercase hex characters."""
    return F.md5(F.concat(F.col(id_col).cast("string"), F.lit(f":{seed}")))


def hash_fraction_below(id_col: str, p: float, seed: int = SEED) -> Column:
    """True for a pseudo-random fraction ``p`` of ids (M9).

    Compares the first 8 hex digits with a threshold: lexicographic order of
    fixed-width lowercase hex equals numeric order, so no parsing is needed.
    """
    threshold = format(min(int(round(p * 2 ** 32)), 2 ** 32), "08x") if p < 1 else "g"
    return F.substring(hash_key(id_col, seed), 1, 8) < F.lit(threshold)


def rank_segments(df: DataFrame, part: list[str], id_col: str,
                  cuts: Callable[[Column, Column], list[Column]],
                  seed: int = SEED, hex_digits: int = HEX_DIGITS,
                  key: Column | None = None) -> DataFrame:
    """Add ``_seg``: how many cuts lie below the row's 1-based rank in its group.

    ``cuts(group_total, global_min_group_total)`` returns cut positions as
    Columns evaluated on the per-group statistics (e.g. ``least(q, n)``).
    Order is (key, id); key defaults to ``md5(id:seed)``.
    """
    k = key if key is not None else hash_key(id_col, seed)
    d = df.withColumn("_k", k).withColumn("_b", F.substring("_k", 1, hex_digits))
    stats = d.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    wpart = Window.partitionBy(*part)
    wcum = wpart.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    stats = (stats
             .withColumn("_start", F.coalesce(F.sum("_cnt").over(wcum), F.lit(0)))
             .withColumn("_n", F.sum("_cnt").over(wpart))
             .withColumn("_nmin", F.min("_n").over(Window.partitionBy())))
    cut_cols = cuts(F.col("_n"), F.col("_nmin"))
    stats = stats.select(*part, "_b", "_start", "_cnt",
                         F.array(*[c.cast("long") for c in cut_cols]).alias("_cuts"))
    straddle = F.exists("_cuts", lambda c: (c > F.col("_start")) & (c < F.col("_start") + F.col("_cnt")))
    below = F.size(F.filter("_cuts", lambda c: c <= F.col("_start")))
    stats = stats.select(*part, "_b", "_start", "_cuts",
                         straddle.alias("_straddle"), below.alias("_seg0"))
    joined = d.join(stats, [*part, "_b"], "inner")
    whole = joined.where(~F.col("_straddle")).withColumn("_seg", F.col("_seg0"))
    w = Window.partitionBy(*part, "_b").orderBy("_k", id_col)
    ranked = (joined.where(F.col("_straddle"))
              .withColumn("_rank", F.col("_start") + F.row_number().over(w))
              .withColumn("_seg", F.size(F.filter("_cuts", lambda c: c < F.col("_rank")))))
    cols = df.columns + ["_seg"]
    return whole.select(*cols).unionByName(ranked.select(*cols))


def exact_rank(df: DataFrame, part: list[str], id_col: str, seed: int = SEED,
               hex_digits: int = 4, key: Column | None = None, name: str = "position") -> DataFrame:
    """Exact 1-based rank of every row in (key, id) order within ``part``,
    computed bucket by bucket (no single-task global sort)."""
    k = key if key is not None else hash_key(id_col, seed)
    d = df.withColumn("_k", k).withColumn("_b", F.substring("_k", 1, hex_digits))
    stats = d.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    wcum = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_start", F.coalesce(F.sum("_cnt").over(wcum), F.lit(0))).drop("_cnt")
    w = Window.partitionBy(*part, "_b").orderBy("_k", id_col)
    out = d.join(stats, [*part, "_b"], "inner").withColumn(name, F.col("_start") + F.row_number().over(w))
    return out.select(*df.columns, name)


def top_q_per_group(df: DataFrame, part: list[str], id_col: str, q: Callable[[Column, Column], Column],
                    seed: int = SEED) -> DataFrame:
    """First ``q`` rows per group in md5 order."""
    seg = rank_segments(df, part, id_col, lambda n, nmin: [q(n, nmin)], seed)
    return seg.where(F.col("_seg") == 0).drop("_seg")


def balance_classes(df: DataFrame, cls: str = "rating", id_col: str = "review_id",
                    cap: int = 500_000, seed: int = SEED) -> DataFrame:
    """M1: min(cap, smallest class) rows per class, without replacement."""
    return top_q_per_group(df, [cls], id_col, lambda n, nmin: F.least(F.lit(cap), nmin), seed)


def equal_per_class(df: DataFrame, cls: str, n: int, k: int, id_col: str = "review_id",
                    seed: int = SEED) -> DataFrame:
    """M8: ``n // k`` rows per class."""
    return top_q_per_group(df, [cls], id_col, lambda nn, nmin: F.lit(n // k), seed)


def sample_n(df: DataFrame, n: int, id_col: str = "review_id", seed: int = SEED) -> DataFrame:
    """M2: ``n`` rows, seeded; no single-task global sort."""
    return top_q_per_group(df, [], id_col, lambda nn, nmin: F.lit(n), seed)


def sample_per_chunk(df: DataFrame, ordinal: str, chunk: int, per_chunk: int,
                     seed: int = SEED) -> DataFrame:
    """M3: at most ``per_chunk`` rows from each ``chunk``-row ingest chunk.

    A chunk is bounded by ``chunk`` rows, so a plain window per chunk is fine.
    """
    w = Window.partitionBy("_chunk").orderBy(hash_key(ordinal, seed), F.col(ordinal))
    return (df.withColumn("_chunk", F.floor(F.col(ordinal) / chunk))
            .withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") <= per_chunk).drop("_chunk", "_rn"))


def quota_head(df: DataFrame, cls: str, ordinal: str, q) -> DataFrame:
    """M4: the first ``q`` rows per class in arrival (ordinal) order; ``q`` is
    a number or the name of a column that is constant in a class.

    A sketch per class gives edges at shares 1e-5, 2e-5, 4e-5, ... of its rows;
    only rows up to the first edge that surely has ``q`` rows below it are
    ranked, about 2 * q of them, whatever the ordinals' size, sign or gaps."""
    from textlake.session import staged
    want = F.max(F.col(q)) if isinstance(q, str) else F.lit(q)
    accuracy, shares = 100_000, [min(1.0, 1e-5 * 2 ** k) for k in range(18)]
    edges = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"), want.alias("_q"), F.percentile_approx(ordinal, shares, accuracy).alias("_e"))
    enough = F.filter(F.arrays_zip(F.col("_e").alias("e"), F.array(*[F.lit(s) for s in shares]).alias("s")),
                      lambda x: (x["s"] - 1.0 / accuracy) * F.col("_n") - 1 >= F.col("_q"))
    edges = staged(edges.select(cls, "_q", F.get(enough, 0)["e"].alias("_bound")))
    near = df.join(edges, cls).where(F.col("_bound").isNull() | (F.col(ordinal) <= F.col("_bound")))
    rank = F.row_number().over(Window.partitionBy(cls).orderBy(ordinal))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= F.col("_q")).select(*df.columns)


def stratified_subsample(df: DataFrame, cls: str, n: int, id_col: str = "review_id",
                         seed: int = SEED) -> DataFrame:
    """M5: ``n`` rows with class proportions kept (largest remainder).

    quota_c = floor(n*n_c/N) (+1 for the classes with the largest remainders).
    """
    counts = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_nc"))
    w = Window.partitionBy()
    counts = (counts.withColumn("_N", F.sum("_nc").over(w))
              .withColumn("_fl", F.when(F.col("_N") <= n, F.col("_nc"))
                          .otherwise(F.floor(F.col("_nc") * n / F.col("_N"))))
              .withColumn("_rem", F.when(F.col("_N") <= n, F.lit(0))
                          .otherwise((F.col("_nc") * n) % F.col("_N")))
              .withColumn("_left", F.lit(n) - F.sum("_fl").over(w))
              .withColumn("_r", F.row_number().over(w.orderBy(F.col("_rem").desc(), F.col(cls))))
              .select(cls, (F.col("_fl") + F.when((F.col("_r") <= F.col("_left")) & (F.col("_N") > n), 1)
                            .otherwise(0)).alias("_q")))
    # class domain is tiny: attach the quota by a join AQE turns into a broadcast
    tagged = df.join(counts, cls, "inner")
    seg = rank_segments(tagged, [cls, "_q"], id_col, lambda nn, nmin: [F.col("_q")], seed)
    return seg.where(F.col("_seg") == 0).drop("_seg", "_q")


def split_by_fractions(df: DataFrame, cls: str, id_col: str, cuts_pct: list[tuple[int, int]],
                       names: list[str], seed: int = SEED) -> DataFrame:
    """Stratified split by md5 rank; ``cuts_pct`` are (numerator, denominator)
    fractions applied one after the other to what is left, rounded up."""

    def cuts(n: Column, nmin: Column) -> list[Column]:
        out, used, left = [], F.lit(0), n
        for num, den in cuts_pct:
            size = F.floor((left * num + (den - 1)) / den)
            used = used + size
            out.append(used)
            left = n - used
        return out

    seg = rank_segments(df, [cls], id_col, cuts, seed)
    label = F.element_at(F.array(*[F.lit(x) for x in names]), F.col("_seg") + 1)
    return seg.withColumn("split", label).drop("_seg")


def train_test_split(df: DataFrame, cls: str, id_col: str = "review_id", seed: int = SEED) -> DataFrame:
    """M6: stratified 80/20; the test share is rounded up per class."""
    return split_by_fractions(df, cls, id_col, [(20, 100)], ["test", "train"], seed)


def train_val_test_split(df: DataFrame, cls: str, id_col: str = "review_id", seed: int = SEED) -> DataFrame:
    """M7: 15 % test, then 0.176 of the rest as validation, the rest train."""
    return split_by_fractions(df, cls, id_col, [(15, 100), (176, 1000)], ["test", "val", "train"], seed)


def bernoulli(df: DataFrame, p: float, id_col: str = "review_id", seed: int = SEED) -> DataFrame:
    """M9: keep each row with probability ``p`` (hash coin, stream-safe)."""
    return df.where(hash_fraction_below(id_col, p, seed))


def shuffle_rows(df: DataFrame, id_col: str = "review_id", seed: int = SEED) -> DataFrame:
    """Seeded permutation, as an explicit ``position`` column."""
    return exact_rank(df, [], id_col, seed)


def head_n(df: DataFrame, n: int, order: str = "review_id") -> DataFrame:
    """First ``n`` rows by id (TakeOrderedAndProject: per-task top-n)."""
    return df.orderBy(order).limit(n)

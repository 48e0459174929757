"""Exploratory aggregates, windows and top-n.

Aggregates use Spark's partial (map-side) + final hash aggregation, so hot
groups are combined before the shuffle. Percentiles are exact by default,
computed by ``exact_percentiles`` (sketch bracket + counts by value inside it,
so no task holds a whole group); ``approx=True`` switches to
``percentile_approx`` alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

Q = [0.25, 0.5, 0.75]


def value_counts(df: DataFrame, col: str, name: str = "count") -> DataFrame:
    """A1"""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias(name))


def minority_count(df: DataFrame, col: str, cap: int) -> DataFrame:
    """A2: min(cap, smallest class count), one row."""
    counts = value_counts(df, col, "n")
    return counts.agg(F.least(F.lit(cap).cast("bigint"), F.min("n")).alias("per_class"))


def count_by_two_keys(df: DataFrame, a: str, b: str, counted: str = "text", name: str = "conteo") -> DataFrame:
    """A3: non-null count of ``counted`` per (a, b)."""
    return df.groupBy(a, b).agg(F.count(counted).alias(name))


def _pct(c: Column, p, approx: bool) -> Column:
    return F.percentile_approx(c, p, 10000) if approx else F.percentile(c, F.lit(p))


def describe_aggs(col: str, approx: bool = False, digits: int = 6) -> list[Column]:
    """A4/A5: pandas ``describe`` statistics of one column (plus null count)."""
    c = F.col(col).cast("double")
    return [
        F.count(c).alias(f"{col}_count"),
        F.count_if(F.col(col).isNull()).cast("bigint").alias(f"{col}_nulls"),
        F.round(F.avg(c), digits).alias(f"{col}_mean"),
        F.round(F.stddev_samp(c), digits).alias(f"{col}_std"),
        F.min(c).alias(f"{col}_min"),
        F.round(_pct(c, 0.25, approx), digits).alias(f"{col}_p25"),
        F.round(_pct(c, 0.5, approx), digits).alias(f"{col}_p50"),
        F.round(_pct(c, 0.75, approx), digits).alias(f"{col}_p75"),
        F.max(c).alias(f"{col}_max"),
    ]


_DESCRIBE_P = [("p25", 0.25), ("p50", 0.5), ("p75", 0.75)]


def _describe_order(col: str) -> list[str]:
    return [f"{col}_{s}" for s in ("count", "nulls", "mean", "std", "min", "p25", "p50", "p75", "max")]


def _moment_aggs(col: str, digits: int = 6) -> list[Column]:
    """The describe statistics other than the quartiles."""
    c = F.col(col).cast("double")
    return [
        F.count(c).alias(f"{col}_count"),
        F.count_if(F.col(col).isNull()).cast("bigint").alias(f"{col}_nulls"),
        F.round(F.avg(c), digits).alias(f"{col}_mean"),
        F.round(F.stddev_samp(c), digits).alias(f"{col}_std"),
        F.min(c).alias(f"{col}_min"),
        F.max(c).alias(f"{col}_max"),
    ]


def _long(df: DataFrame, cols: list[str]) -> DataFrame:
    """(_c, _x): one row per row and column, so several columns share one aggregate."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(c).cast("double").alias("_x")) for c in cols])).alias("_s")).select("_s.*")


def percentiles_of_columns(df: DataFrame, wanted: dict[str, tuple[str, float]], digits: int = 6) -> DataFrame:
    """One row with an exact percentile per entry ``name -> (column, p)``."""
    ps = sorted({p for _, p in wanted.values()})
    q = exact_percentiles(_long(df, sorted({c for c, _ in wanted.values()})), ["_c"], "_x", ps, [f"_q{i}" for i in range(len(ps))])
    return q.agg(*[F.round(F.max(F.when(F.col("_c") == c, F.col(f"_q{ps.index(p)}"))), digits).alias(n) for n, (c, p) in wanted.items()])


def describe_cols(df: DataFrame, cols: list[str], approx: bool = False, digits: int = 6) -> DataFrame:
    """A4: one row with describe statistics for every column. The columns are
    laid out as rows, so all moments are one aggregate by column name, and all
    quartiles one run of ``exact_percentiles``."""
    if approx:
        return df.agg(*[a for c in cols for a in describe_aggs(c, True, digits)])
    from textlake.session import materialize
    x = materialize(_long(df, cols))
    base = x.groupBy("_c").agg(*_moment_aggs("_x", digits))
    names = [f"_x_{n}" for n, _ in _DESCRIBE_P]
    q = exact_percentiles(x, ["_c"], "_x", [p for _, p in _DESCRIBE_P], names)
    per = base.join(q.select("_c", *[F.round(n, digits).alias(n) for n in names]), "_c", "left")
    return per.agg(*[F.max(F.when(F.col("_c") == c, F.col("_x" + name[len(c):]))).alias(name) for c in cols for name in _describe_order(c)])


def describe_by_group(df: DataFrame, group: str, col: str, approx: bool = False, digits: int = 6) -> DataFrame:
    """A5: describe statistics per group; exact quartiles without funnelling
    a hot group into one task (``exact_percentiles``)."""
    if approx:
        return df.groupBy(group).agg(*describe_aggs(col, True, digits))
    from textlake.session import materialize
    x = materialize(df.select(group, col))
    base = x.groupBy(group).agg(*_moment_aggs(col, digits))
    names = [f"{col}_{n}" for n, _ in _DESCRIBE_P]
    q = exact_percentiles(x, [group], col, [p for _, p in _DESCRIBE_P], names)
    q = q.select(F.col(group).alias("_of"), *[F.round(n, digits).alias(n) for n in names])
    return base.join(q, F.col(group).eqNullSafe(F.col("_of")), "left").select(group, *_describe_order(col))


def pivot_matrix(df: DataFrame, row: str, col: str, value: str, row_domain: DataFrame,
                 col_values: list) -> DataFrame:
    """Pivot with a fixed column list; missing cells and rows -> 0."""
    p = df.groupBy(row).pivot(col, col_values).agg(F.sum(value))
    out = row_domain.join(p, row, "left")
    return out.na.fill(0, [str(v) for v in col_values])


def profile_columns(df: DataFrame) -> DataFrame:
    """(position, column, type, non_null, nulls) of every column, in one pass."""
    total = F.count(F.lit(1))
    parts = [F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"),
                      F.count(F.col(f"`{f.name}`")).alias("non_null"), (total - F.count(F.col(f"`{f.name}`"))).alias("nulls")) for i, f in enumerate(df.schema.fields)]
    return df.agg(F.array(*parts).alias("c")).select(F.inline("c"))


def class_share(df: DataFrame, cls: str, value) -> Column:
    """Percentage of rows with ``cls == value``; 0 on empty input."""
    return F.coalesce(F.try_divide(F.count_if(F.col(cls) == value) * 100.0, F.count(F.lit(1))), F.lit(0.0))


def corr_long(df: DataFrame, cols: list[str], digits: int = 6) -> DataFrame:
    """Pearson matrix as (a, b, r) rows, computed in one aggregate."""
    pairs = [(a, b) for a in cols for b in cols]
    name = {p: "|".join(sorted(p)) for p in pairs}  # (a, b) and (b, a) are computed once
    once = {n: p for p, n in name.items()}
    row = df.agg(*[F.round(F.corr(F.col(a).cast("double"), F.col(b).cast("double")), digits).alias(n) for n, (a, b) in once.items()])
    stack = ", ".join(f"'{a}', '{b}', `{name[a, b]}`" for a, b in pairs)
    return row.selectExpr(f"stack({len(pairs)}, {stack}) AS (col_a, col_b, r)")


def box_stats(df: DataFrame, group: str, col: str, approx: bool = False, digits: int = 6) -> DataFrame:
    """Quartiles and whiskers (1.5 IQR clipped to the data) per group.

    Two passes: quartiles per group, then in-range min/max after a join to
    the (small) per-group fence table.
    """
    c = F.col(col).cast("double")
    if approx:
        q = df.groupBy(group).agg(_pct(c, 0.25, approx).alias("q1"), _pct(c, 0.5, approx).alias("median"),
                                  _pct(c, 0.75, approx).alias("q3"))
    else:
        from textlake.session import materialize
        df = materialize(df.select(group, col))
        q = exact_percentiles(df, [group], col, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    q = q.withColumn("lo_fence", F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))) \
         .withColumn("hi_fence", F.col("q3") + 1.5 * (F.col("q3") - F.col("q1")))
    fences = q.select(F.col(group).alias("_of"), "lo_fence", "hi_fence")
    inner = (df.select(group, c.alias("_v")).join(fences, F.col(group).eqNullSafe(F.col("_of")))
             .where((F.col("_v") >= F.col("lo_fence")) & (F.col("_v") <= F.col("hi_fence")))
             .groupBy("_of").agg(F.min("_v").alias("whisker_lo"), F.max("_v").alias("whisker_hi")))
    out = q.join(inner, F.col(group).eqNullSafe(F.col("_of")), "left")
    return out.select(group, *[F.round(x, digits).alias(x) for x in
                               ["q1", "median", "q3", "whisker_lo", "whisker_hi"]])


def histogram_by_group(df: DataFrame, group: str, col: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Equal-width bins over [lo, hi); values outside are clipped to the edge bins."""
    width = (hi - lo) / bins
    b = F.least(F.greatest(F.floor((F.col(col) - lo) / width), F.lit(0)), F.lit(bins - 1)).cast("int")
    return df.groupBy(group, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def mean_ci95(df: DataFrame, group: str, col: str, digits: int = 6) -> DataFrame:
    """Mean with a normal 95 % interval."""
    c = F.col(col).cast("double")
    half = 1.96 * F.stddev_samp(c) / F.sqrt(F.count(c))
    return df.groupBy(group).agg(F.round(F.avg(c), digits).alias("mean"),
                                 F.round(F.avg(c) - half, digits).alias("ci_lo"),
                                 F.round(F.avg(c) + half, digits).alias("ci_hi"),
                                 F.count(c).alias("n"))


def poisson_limits(most: int = 12) -> list[int]:
    """A Poisson(1) draw is the number of these limits that a 32-bit hash reaches."""
    total, term, out = 0.0, math.exp(-1.0), []
    for k in range(most):
        total += term
        out.append(round(total * 2 ** 32))
        term /= k + 1
    return out


def bootstrap_ci(df: DataFrame, group: str, col: str, id_col: str, replicates: int = 200, level: float = 0.95, digits: int = 6) -> DataFrame:
    """Mean and percentile interval of a Poisson bootstrap. In replicate 4j + c
    a row counts as often as a Poisson(1) draw from hex digits 8c + 1 to 8c + 8 of
    md5(id:j), so replicates are the same on every engine and partitioning. Sums by
    (group, replicate) are merged map-side; ``replicates`` is a multiple of 4."""
    x = df.select(group, F.col(col).cast("double").alias("_x"), F.col(id_col).cast("string").alias("_id")).where("_x IS NOT NULL AND _id IS NOT NULL")
    x = x.withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(replicates // 4 - 1))))
    x = x.withColumn("_h", F.md5(F.concat_ws(":", "_id", F.col("_j").cast("string")).cast("binary")))
    u = [F.conv(F.substring("_h", 8 * c + 1, 8), 16, 10).cast("long") for c in range(4)]
    draws = F.explode(F.array(*[F.struct((F.col("_j") * 4 + c).alias("r"), u[c].alias("u")) for c in range(4)]))
    x = x.select(group, "_x", draws.alias("d")).select(group, "_x", "d.r", sum((F.col("d.u") >= limit).cast("int") for limit in poisson_limits()).alias("_k"))
    sums = x.where("_k > 0").groupBy(group, "r").agg((F.sum(F.col("_k") * F.col("_x")) / F.sum("_k")).alias("_m"))
    tail = (1 - level) / 2
    return sums.groupBy(group).agg(F.count(F.lit(1)).alias("replicates"), F.round(F.avg("_m"), digits).alias("mean"), F.round(F.percentile("_m", F.lit(tail)), digits).alias("ci_lo"),
                                   F.round(F.percentile("_m", F.lit(1 - tail)), digits).alias("ci_hi"))


def share_within_group(df: DataFrame, group: str, count_col: str, name: str = "porcentaje",
                       digits: int = 6) -> DataFrame:
    """Count / sum(count) over the group * 100."""
    w = Window.partitionBy(group)
    return df.withColumn(name, F.round(F.col(count_col) / F.sum(count_col).over(w) * 100, digits))


def top_n_values(df: DataFrame, col: str, n: int) -> DataFrame:
    """``n`` most frequent values (ties by value). TakeOrderedAndProject
    keeps ``n`` rows per task and merges them; the output is bounded by n."""
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), F.col(col)).limit(n))


def top_n_per_group(df: DataFrame, group: str, order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per group (Spark plans a WindowGroupLimit)."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def class_weights(df: DataFrame, cls: str) -> DataFrame:
    """Balanced weight n / (k * n_c) per class."""
    counts = value_counts(df, cls, "n_c")
    w = Window.partitionBy()
    return counts.select(cls, "n_c", F.round(F.sum("n_c").over(w) / (F.count(F.lit(1)).over(w) * F.col("n_c")),
                                            6).alias("weight"))


# Exact percentiles without funnelling a group into one task.
#
# ``percentile`` keeps a counter per distinct value of a group in the task
# that finalizes the group. Instead (per group and target p, same definition:
# linear interpolation between ranks floor and ceil of p * (n - 1)):
#   1. one aggregate: n and a bounded sketch (``percentile_approx``) giving a
#      value bracket [a, b] around each target rank;
#   2. one aggregate by value over the rows up to b: all values below a are
#      one entry, each distinct value in [a, b] another, with its count;
#   3. counts are cumulated over those entries, and the entries that hold the
#      two ranks give the result.
# A value that fills a third of a group is a single entry in step 3, merged
# map-side in step 2. Should a bracket miss its ranks (the sketch's error
# bound exceeded), steps 2 and 3 are repeated for it without limits.
SKETCH_ACCURACY = 100_000
MARGIN = 4.0 / SKETCH_ACCURACY


def bracket_counts(x: DataFrame, brackets: DataFrame) -> DataFrame:
    """(_k, i, lo, hi, f, _v, _c): rows of ``x`` (_k, _v) counted by value
    inside each bracket (_k, i, lo, hi, f, a, b); the entry of the rows below it has a null value."""
    per = brackets.groupBy("_k").agg(F.collect_list(F.struct("i", "lo", "hi", "f", "a", "b")).alias("_br"))
    near = x.where(F.col("_v").isNotNull()).join(per, "_k").select(
        "_k", "_v", F.explode(F.filter("_br", lambda s: F.col("_v") <= s["b"])).alias("s"))
    value = F.when(F.col("_v") >= F.col("s.a"), F.col("_v"))
    return near.groupBy("_k", "s.i", "s.lo", "s.hi", "s.f", value.alias("_v")).agg(F.count(F.lit(1)).alias("_c"))


def _ranked(counts: DataFrame) -> DataFrame:
    """(_k, i, f, _vlo, _vhi): the values at the two ranks, null where the bracket misses one."""
    w = Window.partitionBy("_k", "i").orderBy(F.col("_v").asc_nulls_first())
    c = counts.withColumn("_upto", F.sum("_c").over(w))

    def at(rank):
        return F.max(F.when((F.col("_upto") > F.col(rank)) & (F.col("_upto") - F.col("_c") <= F.col(rank)), F.col("_v")))
    return c.groupBy("_k", "i").agg(F.first("f").alias("f"), F.first("lo").alias("lo"), F.first("hi").alias("hi"),
                                    at("lo").alias("_vlo"), at("hi").alias("_vhi"))


def exact_percentiles(df: DataFrame, keys: list[str], col: str, ps: list[float], names: list[str]) -> DataFrame:
    """keys + one column per p (named by ``names``); null values are ignored,
    a group with no values gives nulls."""
    from textlake.session import staged
    m = len(ps)
    x = df.select(F.struct(*([F.col(k) for k in keys] or [F.lit(0).alias("_g")])).alias("_k"), F.col(col).cast("double").alias("_v"))
    pcts = [min(1.0, max(0.0, p + d)) for d in (-MARGIN, MARGIN) for p in ps]
    sketch = staged(x.groupBy("_k").agg(F.count("_v").alias("_n"), F.percentile_approx("_v", pcts, SKETCH_ACCURACY).alias("_ap")))
    specs = []
    for i, p in enumerate(ps):
        pos = F.lit(p) * (F.col("_n") - 1)
        lo = F.floor(pos).cast("long")
        specs.append(F.struct(F.lit(i).alias("i"), lo.alias("lo"), F.ceil(pos).cast("long").alias("hi"), (pos - lo).alias("f"),
                              F.col("_ap")[i].alias("a"), F.col("_ap")[m + i].alias("b")))
    brackets = sketch.where("_n > 0").select("_k", F.inline(F.array(*specs)))
    first = staged(_ranked(bracket_counts(x, brackets)))
    found = F.col("_vlo").isNotNull() & F.col("_vhi").isNotNull()
    missed = brackets.drop("a", "b").join(first.where(found).select("_k", "i"), ["_k", "i"], "left_anti")
    wide = staged(missed.withColumn("a", F.lit(float("-inf"))).withColumn("b", F.lit(float("inf"))))
    vals = first.where(found).unionByName(_ranked(bracket_counts(x, wide)))
    vals = vals.select("_k", "i", (F.col("_vlo") + F.col("f") * (F.col("_vhi") - F.col("_vlo"))).alias("_q"))
    out = vals.groupBy("_k").agg(*[F.max(F.when(F.col("i") == i, F.col("_q"))).alias(nm) for i, nm in enumerate(names)])
    return sketch.select("_k").join(out, "_k", "left").select(*[F.col(f"_k.{k}").alias(k) for k in keys], *names)

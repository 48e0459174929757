"""Mixing of sources to temperature weights.

A source's weight is its share of all tokens to the power a, normalised: a = 1
keeps the shares, a = 0 makes sources equal. The exponent is the largest in
[0, 1] at which the weights' entropy reaches a target, raised if need be until
no source is repeated more often than a limit. It is found by sections: each
pass over the table of sources gives the sums for a grid of exponents.

Weights become whole token quotas under a budget, and quotas become passes over
a source. Its documents lie in blocks of about BLOCK tokens by a hash; every
pass (epoch) has its own permutation of the blocks. A pass that is not whole
takes blocks in that order while they fit, and of the block where the quota
ends the documents, in the epoch's order, while they fit.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import stage

#: Target entropy as a share of that of equal weights, limit of passes over a source.
ENTROPY, REPEATS = 0.92, 4.0
BLOCK = 1 << 18
GRID, SECTIONS = 32, 8
SEED = "mix"


def count_tokens(text):
    """Words between white space; 0 for null."""
    return F.coalesce(F.size(F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")).cast("long"), F.lit(0).cast("long"))


def _sums(shares: DataFrame, exponents: list[float]):
    """(sum of p**a, sum of p**a * ln p) at each exponent a."""
    p = F.col("p")
    row = shares.agg(*[x for i, a in enumerate(exponents) for x in (F.sum(F.pow(p, F.lit(a))).alias(f"z{i}"), F.sum(F.pow(p, F.lit(a)) * F.log(p)).alias(f"s{i}"))]).first()
    return [(row[f"z{i}"], row[f"s{i}"]) for i in range(len(exponents))]


def _last_true(shares: DataFrame, holds, lo: float = 0.0, hi: float = 1.0) -> float:
    """Largest a in [lo, hi] for which ``holds`` is true, if it is true below some a; ``hi`` if it always is."""
    (z, s), = _sums(shares, [hi])
    if holds(hi, z, s):
        return hi
    for _ in range(SECTIONS):
        grid = [lo + (hi - lo) * i / GRID for i in range(1, GRID)]
        for a, (z, s) in zip(grid, _sums(shares, grid)):
            if not holds(a, z, s):
                hi = a
                break
            lo = a
    return lo


def solve_exponent(shares: DataFrame, n: int, entropy: float, repeats: float, least: float, budget_ratio: float | None) -> float:
    """Exponent for source shares ``p`` (n rows, the smallest is ``least``), to
    nine decimals. ``budget_ratio``: budget over all tokens; None for the least
    budget that uses every document once."""
    target = entropy * math.log(n) if n > 1 else 0.0
    a = _last_true(shares, lambda a, z, s: math.log(z) - a * s / z >= target - 1e-12)
    most = shares.agg(F.max("p")).first()[0]

    def passes(x: float, z: float) -> float:
        ratio = z * most ** (1 - x) if budget_ratio is None else budget_ratio
        return ratio * least ** (x - 1) / z

    (z, _), = _sums(shares, [a])
    if passes(a, z) > repeats:
        a = max(a, _last_true(shares, lambda x, z, s: passes(x, z) > repeats))
    return round(a, 9)


def _order(*cols):
    return F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]).cast("binary"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", budget: int | None = None,
                entropy: float = ENTROPY, repeats: float = REPEATS, block: int = BLOCK) -> DataFrame:
    """(id_col, source_col, n_tokens, weight, epoch, block_place), one row per
    use of a document; rows of one source, epoch and ``block_place`` make up a block.

    Without a ``budget`` (in tokens) the least is taken that uses every document
    once. A null source counts as the source ''. Documents of sources without
    tokens come once, with weight 0. A row's block follows from its id, and from
    the row's place where the id is null or repeated, so that no id fills a
    block. Other columns are not read; an empty table gives no rows.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
                       count_tokens(F.col(text_col)).alias("tokens"))
    rows = stage(rows, "token-counts")
    sources = stage(rows.groupBy("source").agg(F.sum("tokens").alias("total")), "sources")
    total, n, least = sources.where("total > 0").agg(F.sum("total"), F.count("*"), F.min("total")).first()
    if n:
        shares = stage(sources.where("total > 0").select((F.col("total") / F.lit(total)).alias("p")), "shares")
        a = solve_exponent(shares, n, entropy, repeats, least / total, budget and budget / total)
        (z, _), = _sums(shares, [a])
        p = F.col("total") / F.lit(total)
        weight = F.pow(p, F.lit(a)) / F.lit(z)
        if budget is None:
            budget = math.ceil(z * shares.agg(F.max(F.pow(F.col("p"), F.lit(1 - a)))).first()[0] * total - 1e-6)
        quota = sources.withColumn("weight", F.when(F.col("total") > 0, weight).otherwise(0.0))
        # Rounded up at the last decimals, so that a quota of a whole pass is one.
        quota = quota.withColumn("quota", F.floor(F.col("weight") * F.lit(budget) + 1e-6))
    else:
        quota = sources.withColumn("weight", F.lit(0.0)).withColumn("quota", F.lit(0).cast("long"))
    quota = quota.withColumn("whole", F.when(F.col("total") > 0, F.floor(F.col("quota") / F.greatest("total", F.lit(1)))).otherwise(1).cast("long"))
    quota = quota.withColumn("rest", F.when(F.col("total") > 0, F.col("quota") - F.col("whole") * F.col("total")).otherwise(0))
    quota = stage(quota.withColumn("blocks", F.greatest(F.ceil(F.col("total") / block), F.lit(1))), "quotas")

    repeated = rows.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("repeated"))
    rows = rows.join(stage(repeated, "repeated-ids").hint("merge"), "id", "left")
    place = F.when(F.col("id").isNull() | F.col("repeated"), F.concat(F.lit("#"), F.col("rid").cast("string"))).otherwise(F.lit(""))
    number = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), place).cast("binary")), 1, 8), 16, 10).cast("long")
    dealt = rows.withColumn("number", number).drop("repeated").join(quota.select("source", "blocks", "whole", "rest", "weight").hint("merge"), "source")
    dealt = stage(dealt.withColumn("block", F.col("number") % F.col("blocks")).drop("blocks", "number"), "dealt")
    blocks = dealt.groupBy("source", "block").agg(F.sum("tokens").alias("size"), F.first("whole").alias("whole"), F.first("rest").alias("rest"))
    blocks = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "whole"))).withColumn("key", _order("source", "epoch", "block"))
    line = Window.partitionBy("source", "epoch").orderBy("key", "block")
    blocks = blocks.withColumn("place", F.row_number().over(line).cast("long")).withColumn("upto", F.sum("size").over(line))
    blocks = blocks.withColumn("left", F.when(F.col("epoch") == F.col("whole"), F.col("rest") - F.col("upto") + F.col("size")).otherwise(F.col("size")))
    # A last, partial pass needs tokens left at the block's start.
    blocks = stage(blocks.where("epoch < whole OR left > 0").select("source", "block", "epoch", "place", "size", "left"), "blocks")

    own = dealt.select("rid", "id", "source", "tokens", "weight", "block").join(blocks.hint("merge"), ["source", "block"])
    whole = own.where(F.col("left") >= F.col("size"))
    part = own.where(F.col("left") < F.col("size")).withColumn("key", _order("source", "epoch", "id"))
    part = part.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source", "epoch", "block").orderBy("key", "id", "rid")))
    part = part.where(F.col("upto") <= F.col("left"))
    cols = [F.col("id").alias(id_col), F.col("source").alias(source_col), F.col("tokens").alias("n_tokens"), "weight", "epoch", F.col("place").alias("block_place")]
    return whole.select("rid", *cols).union(part.select("rid", *cols)).drop("rid")


def SQL(entropy: float = ENTROPY, repeats: float = REPEATS, block: int = BLOCK) -> str:
    """The same on ``documents`` with distinct ids, for whole bisection steps instead of sections."""
    h = "(ln(list_sum(list_transform(ps, lambda p: pow(p, {a})))) - {a} * list_sum(list_transform(ps, lambda p: pow(p, {a}) * ln(p))) / list_sum(list_transform(ps, lambda p: pow(p, {a}))))"
    mid = "((lo + hi) / 2)"
    key = lambda *c: f"md5('{SEED}' || " + " || ".join(f"'|' || coalesce({x}::VARCHAR, '')" for x in c) + ")"
    return f"""
WITH RECURSIVE counted AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::BIGINT AS n_tokens FROM documents),
sources AS (SELECT source, sum(n_tokens)::BIGINT AS total FROM counted GROUP BY source),
whole_table AS (SELECT list(p ORDER BY p) AS ps, max(p) AS most, min(p) AS least, max(t) AS t FROM (
  SELECT total / sum(total) OVER () AS p, sum(total) OVER ()::BIGINT AS t FROM sources WHERE total > 0)),
bisect AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, ps FROM whole_table
  UNION ALL
  SELECT i + 1, CASE WHEN {h.format(a=mid)} >= {entropy} * ln(len(ps)) THEN {mid} ELSE lo END,
    CASE WHEN {h.format(a=mid)} >= {entropy} * ln(len(ps)) THEN hi ELSE {mid} END, ps FROM bisect WHERE i < 50),
solved AS (
  SELECT round(greatest(CASE WHEN {h.format(a='1.0')} >= {entropy} * ln(len(ps)) - 1e-12 THEN 1.0 ELSE lo END,
    CASE WHEN most > least THEN 1 - ln({repeats}) / ln(most / least) ELSE 0 END), 9) AS a FROM bisect JOIN whole_table USING (ps) WHERE i = 50),
norm AS (SELECT a, t, most, list_sum(list_transform(ps, lambda p: pow(p, a))) AS z FROM solved, whole_table),
budget AS (SELECT *, ceil(z * pow(most, 1 - a) * t - 1e-6) AS b FROM norm),
quota AS (
  SELECT source, total, CASE WHEN total > 0 THEN pow(total / t, a) / z ELSE 0 END AS weight,
    floor(pow(total / t, a) / z * b + 1e-6)::BIGINT AS q, greatest(ceil(total / {block}), 1)::BIGINT AS blocks FROM sources, budget),
passes AS (
  SELECT *, CASE WHEN total > 0 THEN q // total ELSE 1 END AS whole, CASE WHEN total > 0 THEN q - q // total * total ELSE 0 END AS rest FROM quota),
dealt AS (
  SELECT c.*, weight, whole, rest, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % blocks AS block
  FROM counted c JOIN passes USING (source)),
sized AS (SELECT source, block, sum(n_tokens)::BIGINT AS size, first(whole) AS whole, first(rest) AS rest FROM dealt GROUP BY source, block),
placed AS (
  SELECT *, row_number() OVER w AS place, sum(size) OVER w AS upto
  FROM (SELECT *, unnest(range(0, whole + 1)) AS epoch FROM sized) WINDOW w AS (PARTITION BY source, epoch ORDER BY {key('source', 'epoch', 'block')}, block)),
cut AS (SELECT *, CASE WHEN epoch = whole THEN rest - upto + size ELSE size END AS room FROM placed),
used AS (
  SELECT d.*, c.epoch, c.place, c.size, c.room,
    sum(n_tokens) OVER (PARTITION BY d.source, c.epoch, d.block ORDER BY {key('d.source', 'c.epoch', 'd.doc_id')}, doc_id) AS upto
  FROM dealt d JOIN cut c ON d.source = c.source AND d.block = c.block WHERE c.epoch < c.whole OR c.room > 0)
SELECT doc_id, source, n_tokens, weight, epoch::BIGINT AS epoch, place AS block_place FROM used WHERE room >= size OR upto <= room
"""

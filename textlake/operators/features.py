"""Engineered text features and the canonical dataset.

All features are column expressions evaluated in one projection; the token
array used for TTR is a transient column, dropped before anything is
shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.functions import labels as L
from textlake.functions import text as T

# Fixed order of the nine engineered features.
FEATURES = ["mayusculas_count", "char_total", "exclamacion_count", "interrogacion_count",
            "porcentaje_mayusculas", "puntuacion_emocional", "total_tokens", "unique_types", "ttr"]
CANONICAL = ["review_id", "rating", "text", "parent_asin", "main_category", *FEATURES, "target_class"]


def text_features(df: DataFrame, text: str = "text") -> DataFrame:
    out = df.withColumns({
        "mayusculas_count": T.upper_count(text),
        "char_total": T.char_total(text),
        "exclamacion_count": T.char_count(text, "!"),
        "interrogacion_count": T.char_count(text, "?"),
        "_tok": T.tokens(text),
    })
    out = out.withColumns({
        "porcentaje_mayusculas": T.uppercase_pct("mayusculas_count", "char_total"),
        "puntuacion_emocional": T.emotional_punct("exclamacion_count", "interrogacion_count"),
        "total_tokens": T.total_tokens("_tok"),
        "unique_types": T.unique_types("_tok"),
    })
    return out.withColumn("ttr", T.ttr("unique_types", "total_tokens")).drop("_tok")


def canonical(df: DataFrame) -> DataFrame:
    """The 14-column balanced dataset (+ review_id)."""
    return df.withColumn("target_class", L.target_class("rating")).select(*CANONICAL)


def standard_scale(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None,
                   digits: int = 6) -> DataFrame:
    """V3: (x - mean) / population std, fitted on ``fit_on`` (the train split);
    zero std divides by 1. The statistics are one aggregate row, read through
    scalar subqueries (Spark merges them into a single aggregate)."""
    src = fit_on if fit_on is not None else df
    stats = src.agg(*[F.avg(F.col(c).cast("double")).alias(f"_m_{c}") for c in cols],
                    *[F.stddev_pop(F.col(c).cast("double")).alias(f"_s_{c}") for c in cols])
    scaled = {}
    for c in cols:
        m = stats.select(f"_m_{c}").scalar()  # scalar subqueries over one aggregate row
        s = stats.select(f"_s_{c}").scalar()
        scaled[c] = F.round((F.col(c).cast("double") - m) / F.when(s == 0, F.lit(1.0)).otherwise(s), digits)
    return df.withColumns(scaled)


def impute_median(df: DataFrame, col: str) -> DataFrame:
    """Fill nulls of ``col`` with its exact median.

    The median is a scalar subquery, evaluated once, computed by the
    distributed exact percentile (no single task holds all values)."""
    from textlake.operators.explore import exact_percentiles
    med = exact_percentiles(df, [], col, [0.5], ["_median"]).select("_median").scalar()
    return df.withColumn(col, F.coalesce(F.col(col), med))

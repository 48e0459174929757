"""Queries: aggregates, windows, top-n."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import labels as L
from textlake.operators import clean as C
from textlake.operators import explore as X
from textlake.operators import features as FE
from textlake.operators import joins as J
from textlake.plans.registry import register
from textlake.plans.sqlviews import with_ctes
from textlake.session import staged
from textlake.sources import views as V


def _clean(spark, sf):
    return C.clean_reviews(V.reviews(spark, sf), V.products(spark, sf))


def _features(spark, sf):
    return FE.text_features(_clean(spark, sf))


_ENRICHED = r"""
    SELECT c.*, coalesce(nullif(regexp_extract(m.categories, '^\["[^"]+",\s*"([^"]+)"', 1), ''),
                         'Categoría General') AS sub_categoria
    FROM clean c LEFT JOIN (SELECT parent_asin, min(categories) AS categories FROM products
                            GROUP BY parent_asin) m ON m.parent_asin = c.parent_asin"""


@register("subcategory_rating_share", "agg", with_ctes("""
    SELECT sub_categoria, rating, conteo,
           round(conteo / sum(conteo) OVER (PARTITION BY sub_categoria) * 100, 6) AS porcentaje
    FROM (SELECT sub_categoria, rating, CAST(count(text) AS BIGINT) AS conteo FROM enriched
          WHERE sub_categoria IN (SELECT sub_categoria FROM enriched GROUP BY sub_categoria
                                  ORDER BY count(*) DESC, sub_categoria LIMIT 10)
          GROUP BY sub_categoria, rating)""", "clean", "products", extra=[("enriched", _ENRICHED)]))
def subcategory_rating_share(spark, sf):
    """Flagship: S4 -> P10 -> J3/X15 -> T1 -> A3 -> W1."""
    enriched = J.enrich_category(_clean(spark, sf), V.products(spark, sf))
    # one pass over the corpus: cells of (sub-category, rating) first; the ten
    # largest sub-categories (ties by name) are taken from that small table
    cells = staged(enriched.groupBy("sub_categoria", "rating").agg(F.count("text").alias("conteo"), F.count(F.lit(1)).alias("_rows")))
    top = cells.groupBy("sub_categoria").agg(F.sum("_rows").alias("n")).orderBy(F.col("n").desc(), "sub_categoria").limit(10)
    counts = C.keep_in(cells, top, "sub_categoria").select("sub_categoria", "rating", "conteo")
    return X.share_within_group(counts, "sub_categoria", "conteo")


@register("rating_counts", "agg", with_ctes(
    "SELECT rating, count(*) AS count FROM clean GROUP BY rating", "clean"))
def rating_counts(spark, sf):
    return X.value_counts(_clean(spark, sf), "rating")


@register("minority_count", "agg", with_ctes(
    "SELECT least(CAST(500000 AS BIGINT), min(n)) AS per_class FROM "
    "(SELECT rating, count(*) AS n FROM clean GROUP BY rating)", "clean"))
def minority_count(spark, sf):
    return X.minority_count(_clean(spark, sf), "rating", 500_000)


def _describe_sql(col: str, src: str) -> str:
    c = f"CAST({col} AS DOUBLE)"
    return (f"count({c}) AS {col}_count, CAST(count(*) FILTER (WHERE {col} IS NULL) AS BIGINT) AS {col}_nulls, "
            f"round(avg({c}), 6) AS {col}_mean, round(stddev_samp({c}), 6) AS {col}_std, "
            f"min({c}) AS {col}_min, round(quantile_cont({c}, 0.25), 6) AS {col}_p25, "
            f"round(quantile_cont({c}, 0.5), 6) AS {col}_p50, round(quantile_cont({c}, 0.75), 6) AS {col}_p75, "
            f"max({c}) AS {col}_max")


_DESCRIBE_COLS = ["rating", "char_total", "mayusculas_count", "ttr"]


@register("describe_cols", "agg", with_ctes(
    "SELECT " + ", ".join(_describe_sql(c, "features") for c in _DESCRIBE_COLS) + " FROM features", "features"))
def describe_cols(spark, sf):
    return X.describe_cols(_features(spark, sf), _DESCRIBE_COLS)


@register("describe_ttr_by_rating", "agg", with_ctes(
    "SELECT rating, " + _describe_sql("ttr", "features") + " FROM features GROUP BY rating", "features"))
def describe_ttr_by_rating(spark, sf):
    return X.describe_by_group(_features(spark, sf), "rating", "ttr")


@register("class_share", "agg", with_ctes("""
    SELECT t.target_class, round(coalesce(100.0 * n / nullif(sum(n) OVER (), 0), 0), 6) AS share
    FROM (VALUES ('Negativo'), ('Neutro'), ('Positivo')) t(target_class) LEFT JOIN (SELECT CASE WHEN rating IN (1, 2) THEN 'Negativo' WHEN rating = 3 THEN 'Neutro' ELSE 'Positivo' END
                 AS target_class, count(*) AS n FROM clean GROUP BY 1) c USING (target_class)""", "clean"))
def class_share(spark, sf):
    c = _clean(spark, sf).withColumn("target_class", L.target_class("rating"))
    return c.agg(*[F.round(X.class_share(c, "target_class", lab), 6).alias(lab) for lab in L.CLASS_LABELS]) \
        .selectExpr("stack(3, 'Negativo', Negativo, 'Neutro', Neutro, 'Positivo', Positivo) AS (target_class, share)")


_CORR_COLS = ["rating", "char_total", "mayusculas_count", "exclamacion_count", "total_tokens", "ttr"]


@register("corr_matrix", "agg", with_ctes(
    "SELECT col_a, col_b, r FROM (" + " UNION ALL ".join(
        f"SELECT '{a}' AS col_a, '{b}' AS col_b, round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6) AS r "
        f"FROM features" for a in _CORR_COLS for b in _CORR_COLS) + ")", "features"))
def corr_matrix(spark, sf):
    return X.corr_long(_features(spark, sf), _CORR_COLS)


@register("p95", "agg", with_ctes(
    "SELECT round(quantile_cont(CAST(char_total AS DOUBLE), 0.95), 6) AS p95_chars, "
    "round(quantile_cont(ttr, 0.95), 6) AS p95_ttr FROM features", "features"))
def p95(spark, sf):
    from textlake.session import materialize
    f = materialize(_features(spark, sf).select("char_total", "ttr"))
    return X.percentiles_of_columns(f, {"p95_chars": ("char_total", 0.95), "p95_ttr": ("ttr", 0.95)})


@register("box_stats", "agg", with_ctes("""
    SELECT q.rating, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
           round(min(f.ttr) FILTER (WHERE f.ttr >= q1 - 1.5 * (q3 - q1)), 6) AS whisker_lo,
           round(max(f.ttr) FILTER (WHERE f.ttr <= q3 + 1.5 * (q3 - q1)), 6) AS whisker_hi
    FROM (SELECT rating, quantile_cont(ttr, 0.25) AS q1, quantile_cont(ttr, 0.5) AS median,
                 quantile_cont(ttr, 0.75) AS q3 FROM features GROUP BY rating) q
    JOIN features f ON f.rating = q.rating
    WHERE f.ttr BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)
    GROUP BY q.rating, q1, median, q3""", "features"))
def box_stats(spark, sf):
    return X.box_stats(_features(spark, sf), "rating", "ttr")


@register("histogram_by_rating", "agg", with_ctes("""
    SELECT rating, CAST(least(greatest(floor((porcentaje_mayusculas - 0) / 2.5), 0), 19) AS INTEGER) AS bin,
           count(*) AS n FROM features GROUP BY ALL""", "features"))
def histogram_by_rating(spark, sf):
    return X.histogram_by_group(_features(spark, sf), "rating", "porcentaje_mayusculas", 0.0, 50.0, 20)


@register("ttr_mean_ci", "agg", with_ctes("""
    SELECT rating, round(avg(ttr), 6) AS mean,
           round(avg(ttr) - 1.96 * stddev_samp(ttr) / sqrt(count(ttr)), 6) AS ci_lo,
           round(avg(ttr) + 1.96 * stddev_samp(ttr) / sqrt(count(ttr)), 6) AS ci_hi,
           count(ttr) AS n FROM features GROUP BY rating""", "features"))
def ttr_mean_ci(spark, sf):
    return X.mean_ci95(_features(spark, sf), "rating", "ttr")


@register("profile", "agg", with_ctes(
    "SELECT count(*) AS n_rows, count(text) AS text_non_null, count(rating) AS rating_non_null, "
    "count(parent_asin) AS parent_asin_non_null, count(\"timestamp\") AS timestamp_non_null, "
    "count(DISTINCT parent_asin) AS n_asins FROM reviews", "reviews"))
def profile(spark, sf):
    r = V.reviews(spark, sf)
    return r.agg(F.count(F.lit(1)).alias("n_rows"), F.count("text").alias("text_non_null"),
                 F.count("rating").alias("rating_non_null"), F.count("parent_asin").alias("parent_asin_non_null"),
                 F.count("timestamp").alias("timestamp_non_null"),
                 F.count_distinct("parent_asin").alias("n_asins"))


@register("distinct_keys", "agg", with_ctes("SELECT DISTINCT parent_asin FROM reviews", "reviews"))
def distinct_keys(spark, sf):
    return V.reviews(spark, sf).select("parent_asin").distinct()


@register("class_weights", "agg", with_ctes("""
    SELECT target_class, n_c, round(sum(n_c) OVER () / (count(*) OVER () * n_c), 6) AS weight
    FROM (SELECT CASE WHEN rating IN (1, 2) THEN 'Negativo' WHEN rating = 3 THEN 'Neutro' ELSE 'Positivo' END
                 AS target_class, count(*) AS n_c FROM clean GROUP BY 1)""", "clean"))
def class_weights(spark, sf):
    return X.class_weights(_clean(spark, sf).withColumn("target_class", L.target_class("rating")), "target_class")


_CAL = """
    SELECT *, month(make_timestamp("timestamp" * 1000)) AS mes,
           isodow(make_timestamp("timestamp" * 1000)) AS dia_semana FROM clean"""


@register("complaints_weekday_month", "agg", with_ctes("""
    SELECT d.dia, """ + ", ".join(
    f"CAST(coalesce(sum(conteo) FILTER (WHERE mes = {m}), 0) AS BIGINT) AS \"{m}\"" for m in range(1, 13)) + """
    FROM (SELECT unnest(range(1, 8)) AS dia) d
    LEFT JOIN (SELECT dia_semana, mes, count(text) AS conteo FROM cal WHERE rating = 1.0 GROUP BY ALL) c
      ON c.dia_semana = d.dia
    GROUP BY d.dia""", "clean", extra=[("cal", _CAL)]))
def complaints_weekday_month(spark, sf):
    c = _clean(spark, sf).withColumn("fecha", L.epoch_ms_to_ts("timestamp"))
    c = c.withColumn("mes", L.month_of("fecha")).withColumn("dia_semana", L.iso_weekday("fecha"))
    counts = X.count_by_two_keys(c.where(F.col("rating") == 1.0), "dia_semana", "mes")
    days = spark.range(1, 8).select(F.col("id").cast("int").alias("dia_semana"))
    m = X.pivot_matrix(counts, "dia_semana", "mes", "conteo", days, list(range(1, 13)))
    return m.withColumnRenamed("dia_semana", "dia").select(
        "dia", *[F.col(str(i)).cast("bigint").alias(str(i)) for i in range(1, 13)])


@register("saturation_rating_month", "agg", with_ctes("""
    SELECT d.rating, """ + ", ".join(
    f"CAST(coalesce(sum(conteo) FILTER (WHERE mes = {m}), 0) AS BIGINT) AS \"{m}\"" for m in range(1, 13)) + """
    FROM (SELECT CAST(unnest([5, 4, 3, 2, 1]) AS DOUBLE) AS rating) d
    LEFT JOIN (SELECT rating, mes, count(text) AS conteo FROM cal GROUP BY ALL) c ON c.rating = d.rating
    GROUP BY d.rating""", "clean", extra=[("cal", _CAL)]))
def saturation_rating_month(spark, sf):
    c = _clean(spark, sf).withColumn("mes", L.month_of(L.epoch_ms_to_ts("timestamp")))
    counts = X.count_by_two_keys(c, "rating", "mes")
    dom = spark.createDataFrame([(r,) for r in [5.0, 4.0, 3.0, 2.0, 1.0]], "rating double")
    m = X.pivot_matrix(counts, "rating", "mes", "conteo", dom, list(range(1, 13)))
    return m.select("rating", *[F.col(str(i)).cast("bigint").alias(str(i)) for i in range(1, 13)])


@register("dataset_report", "agg", with_ctes("""
    SELECT (SELECT count(*) FROM features) AS total_rows,
           (SELECT map(list(CAST(rating AS VARCHAR) ORDER BY rating), list(n ORDER BY rating))
              FROM (SELECT rating, count(*) AS n FROM features GROUP BY rating)) AS rating_distribution,
           (SELECT map(list(tc ORDER BY tc), list(n ORDER BY tc))
              FROM (SELECT CASE WHEN rating IN (1, 2) THEN 'Negativo' WHEN rating = 3 THEN 'Neutro'
                                ELSE 'Positivo' END AS tc, count(*) AS n FROM features GROUP BY 1))
              AS target_class_distribution, """ + f"{FE.CANONICAL} AS columns, {FE.FEATURES} AS features", "features"))
def dataset_report(spark, sf):
    from textlake.operators.reports import dataset_report as rep
    return rep(FE.canonical(_features(spark, sf)))


@register("top_products_reviews", "agg", with_ctes("""
    SELECT review_id, parent_asin FROM clean WHERE parent_asin IN
      (SELECT parent_asin FROM clean GROUP BY parent_asin ORDER BY count(*) DESC, parent_asin LIMIT 10)""", "clean"))
def top_products_reviews(spark, sf):
    """P7 + T1: the reviews of the ten products with most reviews."""
    c = staged(_clean(spark, sf).select("review_id", "parent_asin"))
    return C.keep_in(c, X.top_n_values(c, "parent_asin", 10), "parent_asin").select("review_id", "parent_asin")


@register("histogram_punctuation", "agg", with_ctes("""
    SELECT rating, CAST(least(greatest(floor(puntuacion_emocional / 1.0), 0), 19) AS INTEGER) AS bin, count(*) AS n
    FROM features GROUP BY ALL""", "features"))
def histogram_punctuation(spark, sf):
    """A12 for emotional punctuation, 0 to 20."""
    return X.histogram_by_group(_features(spark, sf), "rating", "puntuacion_emocional", 0.0, 20.0, 20)


@register("rating_star_names", "agg", with_ctes(
    "SELECT CASE rating " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in L.STAR_NAMES.items()) + " END AS stars, count(*) AS n "
    "FROM reviews GROUP BY ALL", "reviews"))
def rating_star_names(spark, sf):
    """Reviews per star name."""
    return V.reviews(spark, sf).groupBy(L.star_name("rating").alias("stars")).agg(F.count(F.lit(1)).alias("n"))


_LIMITS = X.poisson_limits()


@register("ttr_bootstrap_ci", "agg", with_ctes(f"""
    SELECT rating, count(*) AS replicates, round(avg(m), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS ci_lo, round(quantile_cont(m, 0.975), 6) AS ci_hi
    FROM (SELECT rating, r, sum(k * ttr) / sum(k) AS m FROM (
            SELECT rating, ttr, j * 4 + c AS r, len(list_filter({_LIMITS}, lambda x: CAST('0x' || substr(h, CAST(8 * c + 1 AS BIGINT), 8) AS BIGINT) >= x)) AS k
            FROM (SELECT rating, ttr, j, md5(CAST(review_id AS VARCHAR) || ':' || CAST(j AS VARCHAR)) AS h FROM features, range(0, 50) a(j)), range(0, 4) b(c)
            WHERE ttr IS NOT NULL)
          WHERE k > 0 GROUP BY rating, r)
    GROUP BY rating""", "features"))
def ttr_bootstrap_ci(spark, sf):
    """Percentile interval of 200 Poisson bootstrap replicates."""
    return X.bootstrap_ci(_features(spark, sf), "rating", "ttr", "review_id")


_REVIEW_TYPES = {"review_id": "bigint", "title": "string", "text": "string", "rating": "double", "parent_asin": "string", "verified_purchase": "boolean",
                 "helpful_vote": "bigint", "timestamp": "bigint", "ts": "timestamp"}


@register("profile_schema", "agg", with_ctes(" UNION ALL ".join(
    f"SELECT {i}::INTEGER AS position, '{c}' AS \"column\", '{t}' AS type, count(\"{c}\") AS non_null, count(*) - count(\"{c}\") AS nulls FROM reviews"
    for i, (c, t) in enumerate(_REVIEW_TYPES.items())), "reviews"))
def profile_schema(spark, sf):
    """Schema and null counts of every column."""
    return X.profile_columns(V.reviews(spark, sf))

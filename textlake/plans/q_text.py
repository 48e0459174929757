"""Queries: text vectorization, vectors and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from textlake.functions import labels as L
from textlake.functions import vectors as VF
from textlake.operators import clean as C
from textlake.operators import features as FE
from textlake.operators import indexes as IX
from textlake.operators import sampling as S
from textlake.operators import search as R
from textlake.operators import text as TX
from textlake.operators import vectors as VO
from textlake.plans.registry import register
from textlake.plans.sqlviews import with_ctes
from textlake.session import staged
from textlake.sources import views as V
from textlake.sources.tables import read_table


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


_STOP = _sql_list(TX.english_stop_words())
_TOKS = (r"list_filter(regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]{{2,}}'), "
         r"lambda x: NOT list_contains(" + _STOP.replace("{", "{{").replace("}", "}}") + ", x))")
_BIGRAMS = "list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])"


def _clean(spark, sf):
    return C.clean_reviews(V.reviews(spark, sf), V.products(spark, sf))


def _tfidf_sql(select: str) -> str:
    toks = _TOKS.format(t="text")
    return with_ctes(select, "clean", extra=[
        ("toks", f"SELECT review_id, {toks} AS t FROM clean"),
        ("tf", f"SELECT review_id, term, count(*) AS tf FROM "
               f"(SELECT review_id, unnest(t || {_BIGRAMS}) AS term FROM toks) GROUP BY ALL"),
        ("vocab", "SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM "
                  "(SELECT term, count(*) AS df, sum(tf) AS freq FROM tf GROUP BY term HAVING count(*) >= 5 "
                  " ORDER BY freq DESC, term LIMIT 10000), (SELECT count(*) AS n FROM clean)"),
        ("w", "SELECT review_id, term, tf * idf AS w FROM tf JOIN vocab USING (term)"),
    ])


def _tfidf(spark, sf):
    return TX.fit_tfidf(_clean(spark, sf), "review_id", "text", (1, 2), TX.english_stop_words(),
                        min_df=5, max_features=10_000)


@register("tfidf_vocab", "text", _tfidf_sql("SELECT term, df, round(idf, 6) AS idf FROM vocab"))
def tfidf_vocab(spark, sf):
    return _tfidf(spark, sf).vocab.select("term", "df", F.round("idf", 6).alias("idf"))


@register("tfidf_weights", "text", _tfidf_sql(
    "SELECT review_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY review_id)), 6) AS weight FROM w"))
def tfidf_weights(spark, sf):
    return _tfidf(spark, sf).weights


_BAL = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY rating
          ORDER BY md5(CAST(review_id AS VARCHAR) || ':42'), review_id) AS rn_b FROM clean)
          WHERE rn_b <= (SELECT least(500000, min(n)) FROM (SELECT count(*) AS n FROM clean GROUP BY rating))"""


@register("top_bigrams", "text", with_ctes(f"""
    SELECT rating, term, conteo, rank FROM (
      SELECT rating, term, count(*) AS conteo,
             row_number() OVER (PARTITION BY rating ORDER BY count(*) DESC, term) AS rank
      FROM (SELECT rating, unnest({_BIGRAMS}) AS term FROM (SELECT rating, {_TOKS.format(t='text')} AS t FROM bal))
      GROUP BY rating, term) WHERE rank <= 15""", "clean", extra=[("bal", _BAL)]))
def top_bigrams(spark, sf):
    bal = S.balance_classes(_clean(spark, sf), "rating", "review_id", 500_000)
    return TX.top_terms_per_group(bal, "rating", "text", 15, (2, 2), TX.english_stop_words())


@register("top_words", "text", with_ctes(f"""
    SELECT target_class, term, conteo, rank FROM (
      SELECT target_class, term, count(*) AS conteo,
             row_number() OVER (PARTITION BY target_class ORDER BY count(*) DESC, term) AS rank
      FROM (SELECT target_class, unnest({_TOKS.format(t='text')}) AS term FROM (
              SELECT * FROM (SELECT *, row_number() OVER (ORDER BY md5(CAST(review_id AS VARCHAR) || ':42'),
                                                          review_id) AS rn_s FROM neg) WHERE rn_s <= 10000))
      GROUP BY target_class, term) WHERE rank <= 50""", "clean", extra=[
    ("neg", "SELECT *, 'Negativo' AS target_class FROM clean WHERE rating IN (1, 2)")]))
def top_words(spark, sf):
    neg = _clean(spark, sf).withColumn("target_class", L.target_class("rating")) \
        .where(F.col("target_class") == "Negativo")
    sample = S.sample_n(neg, 10_000)
    return TX.top_terms_per_group(sample, "target_class", "text", 50, (1, 1), TX.english_stop_words())


_FEATS = FE.FEATURES
_TC = "CASE WHEN rating IN (1, 2) THEN 'Negativo' WHEN rating = 3 THEN 'Neutro' ELSE 'Positivo' END"


def _split_sql_cte():
    return ("sp", f"""
    SELECT f.*, CASE WHEN rn <= (n * 20 + 99) // 100 THEN 'test' ELSE 'train' END AS split FROM (
      SELECT *, row_number() OVER (PARTITION BY {_TC} ORDER BY md5(CAST(review_id AS VARCHAR) || ':42'), review_id) AS rn,
             count(*) OVER (PARTITION BY {_TC}) AS n FROM features) f""")


@register("scaled_features", "text", with_ctes(
    "SELECT review_id, split, " + ", ".join(
        f"round((CAST({c} AS DOUBLE) - (SELECT avg(CAST({c} AS DOUBLE)) FROM sp WHERE split = 'train')) / "
        f"coalesce(nullif((SELECT stddev_pop(CAST({c} AS DOUBLE)) FROM sp WHERE split = 'train'), 0), 1.0), 6) AS {c}"
        for c in _FEATS) + " FROM sp", "features", extra=[_split_sql_cte()]))
def scaled_features(spark, sf):
    f = S.train_test_split(_clean(spark, sf).withColumn("target_class", L.target_class("rating")), "target_class")
    f = staged(FE.text_features(f).select("review_id", "split", *_FEATS))  # read by the statistics and the result
    scaled = FE.standard_scale(f, _FEATS, fit_on=f.where(F.col("split") == "train"))
    return scaled.select("review_id", "split", *_FEATS)


@register("l2_normalized", "text", with_ctes(
    "SELECT review_id, list_transform(embedding, lambda x: round(x, 6)) AS embedding FROM unit_vectors",
    "unit_vectors"))
def l2_normalized(spark, sf):
    idx = R.build_vector_index(V.vectors(spark, sf))
    return idx.select("review_id", F.transform("vec", lambda x: F.round(x, 6)).alias("embedding"))


@register("pairwise_cosine", "text", with_ctes("""
    SELECT a.label AS label_a, b.label AS label_b,
           round(avg(list_dot_product(a.embedding, b.embedding)), 6) AS mean_cosine,
           count(*) AS n_pairs
    FROM unit_vectors a JOIN unit_vectors b ON true GROUP BY a.label, b.label""", "unit_vectors"))
def pairwise_cosine(spark, sf):
    idx = R.build_vector_index(V.vectors(spark, sf), keep=["label"])
    return VO.mean_cosine_between_groups(idx, "label", "vec")


_PROTO = ("proto", """
    SELECT label AS query_id, list(v ORDER BY i) AS vec FROM (
      SELECT label, i, avg(embedding[i]) AS v FROM unit_vectors, range(1, 65) r(i) GROUP BY label, i)
    GROUP BY label""")


def _semantic_sql() -> str:
    return with_ctes("""
    SELECT query_id, review_id, score, rank FROM (
      SELECT query_id, review_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, review_id) AS rank
      FROM (SELECT p.query_id, u.review_id, round(list_dot_product(u.embedding, p.vec), 6) AS score
            FROM proto p JOIN unit_vectors u ON true))
    WHERE rank <= 10""", "unit_vectors", extra=[_PROTO])


def _prototypes(idx):
    return VO.group_means(idx, "label", "vec").withColumnRenamed("label", "query_id")


@register("semantic_topk", "text", _semantic_sql())
def semantic_topk(spark, sf):
    idx = IX.open_vector_index(V.vectors(spark, sf), keep=["label"])
    return R.semantic_search(idx, _prototypes(idx.rows), k=10)


@register("semantic_topk_threshold", "text", with_ctes("""
    SELECT query_id, review_id, score, rank FROM (
      SELECT query_id, review_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, review_id) AS rank
      FROM (SELECT a.review_id AS query_id, b.review_id, round(list_dot_product(a.embedding, b.embedding), 6) AS score
            FROM unit_vectors a JOIN unit_vectors b ON a.review_id % 10 = 0) WHERE score >= 0.6)
    WHERE rank <= 10""", "unit_vectors"))
def semantic_topk_threshold(spark, sf):
    """The ten rows nearest to each tenth row (itself among them) at 0.60 or more."""
    idx = IX.open_vector_index(V.vectors(spark, sf), keep=["label"])
    asked = idx.rows.where("review_id % 10 = 0").select(F.col("review_id").alias("query_id"), "vec")
    return R.semantic_search(idx, asked, k=10, threshold=0.6)


_LEX_CTES = [
    ("ctoks", f"SELECT review_id, {_TOKS.format(t='text')} AS t FROM reviews"),
    ("ctf", "SELECT review_id, term, count(*) AS tf FROM (SELECT review_id, unnest(t) AS term FROM ctoks) GROUP BY ALL"),
    ("lvocab", "SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM ctf, (SELECT count(*) AS n FROM reviews) "
               "GROUP BY term, n"),
    ("cw", "SELECT review_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY review_id)) AS dw "
           "FROM ctf JOIN lvocab USING (term)"),
    ("qtoks", f"SELECT item_id AS query_id, {_TOKS.format(t='text')} AS t FROM benchmark WHERE trim(text) <> ''"),
    ("qtf", "SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest(t) AS term FROM qtoks) GROUP BY ALL"),
    ("qw", "SELECT query_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY query_id)) AS qw "
           "FROM qtf JOIN lvocab USING (term)"),
]


@register("lexical_topk", "text", with_ctes("""
    SELECT query_id, review_id, score, rank FROM (
      SELECT query_id, review_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, review_id) AS rank
      FROM (SELECT query_id, review_id, round(sum(qw * dw), 6) AS score FROM qw JOIN cw USING (term)
            GROUP BY query_id, review_id) WHERE score > 0)
    WHERE rank <= 10""", "reviews", extra=_LEX_CTES))
def lexical_topk(spark, sf):
    corpus = V.reviews(spark, sf).select("review_id", "text")
    model = R.build_lexical_index(corpus)
    queries = read_table(spark, sf, "benchmark", ["item_id", "text"]).select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return R.lexical_search(model, queries, k=10)


@register("index_stats", "text", with_ctes("""
    SELECT label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS share,
           sum(count(*)) OVER () AS total_docs, (SELECT max(len(embedding)) FROM vectors) AS dimension,
           (SELECT CAST(8 * sum(len(embedding)) AS BIGINT) FROM vectors) AS bytes, true AS dated,
           (SELECT CAST(sum(CAST(('0x' || substr(md5(CAST(review_id AS VARCHAR) || ':' || array_to_string(
                list_transform(embedding, lambda x: CAST(round(x * 1e6) AS BIGINT)), ',')), 1, 15)) AS BIGINT)) AS VARCHAR) FROM vectors) AS checksum
    FROM unit_vectors GROUP BY label""", "unit_vectors"))
def index_stats(spark, sf):
    """Documents and labels of the written index, and its manifest."""
    idx = IX.open_vector_index(V.vectors(spark, sf), keep=["label"])
    return R.index_stats(idx.rows, "label").select("*", *(F.lit(idx.manifest[c]).alias(c) for c in ("dimension", "bytes", "checksum")),
                                                   (F.to_date(F.lit(idx.manifest["built_at"])) <= F.current_date()).alias("dated"))


# ---------------------------------------------------------- V5 / R6 -------
def _enc_sql(src: str, id_expr: str, where: str = "") -> str:
    return f"""
    SELECT id, b, v / sqrt(sum(v * v) OVER (PARTITION BY id)) AS v FROM (
      SELECT id, CAST(('0x' || substr(md5(term), 1, 8))::BIGINT % 256 AS INTEGER) AS b,
             sum(CASE WHEN ('0x' || substr(md5(term), 9, 1))::INTEGER % 2 = 0 THEN 1.0 ELSE -1.0 END) AS v
      FROM (SELECT {id_expr} AS id, unnest({_TOKS.format(t='text')}) AS term FROM {src} {where})
      GROUP BY ALL)
    WHERE v <> 0"""


_ENGINE_CTES = [
    ("hd", _enc_sql("reviews", "review_id")),
    ("hq", _enc_sql("benchmark", "item_id", "WHERE trim(text) <> ''")),
    ("sem", """SELECT query_id, review_id, score, rank FROM (
                 SELECT query_id, review_id, score,
                        row_number() OVER (PARTITION BY query_id ORDER BY score DESC, review_id) AS rank
                 FROM (SELECT q.query_id, r.review_id, coalesce(s.score, 0.0) AS score
                       FROM (SELECT item_id AS query_id FROM benchmark WHERE trim(text) <> '') q JOIN reviews r ON true
                       LEFT JOIN (SELECT q.id AS query_id, d.id AS review_id, round(sum(q.v * d.v), 6) + 0.0 AS score
                                  FROM hq q JOIN hd d USING (b) GROUP BY ALL) s
                       ON s.query_id = q.query_id AND s.review_id = r.review_id))
               WHERE rank <= 3"""),
]


@register("embed_texts", "text", with_ctes(
    "SELECT review_id, count(id) AS nnz, coalesce(round(sum(v * v), 6), 0.0) AS sq_norm FROM reviews LEFT JOIN hd ON id = review_id "
    "GROUP BY review_id",
    "reviews", extra=_ENGINE_CTES[:1]))
def embed_texts(spark, sf):
    from textlake.operators.encode import hash_embed
    e = hash_embed(V.reviews(spark, sf).select("review_id", "text"), "review_id", "text")
    nnz = F.size(F.filter("embedding", lambda x: x != 0))
    sq = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x)
    return e.select("review_id", nnz.cast("bigint").alias("nnz"), F.round(sq, 6).alias("sq_norm"))


def _engines(spark, sf):
    from textlake.operators.encode import hash_embed
    reviews = V.reviews(spark, sf).select("review_id", "text")
    bench = read_table(spark, sf, "benchmark", ["item_id", "text"]).where(F.trim("text") != "")
    idx = R.build_vector_index(hash_embed(reviews, "review_id", "text"))
    q = hash_embed(bench, "item_id", "text").select(F.col("item_id").alias("query_id"), F.col("embedding").alias("vec"))
    sem = R.semantic_search(staged(idx), q, k=3)
    model = R.build_lexical_index(reviews)
    lex = R.lexical_search(model, bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), k=3)
    return sem, lex


@register("compare_engines", "text", with_ctes("""
    SELECT e.*, left(r.text, 120) || '...' AS snippet FROM (
      SELECT 'semantic' AS engine, query_id, rank, review_id, round(score, 4) AS score FROM sem
      UNION ALL
      SELECT 'lexical' AS engine, query_id, rank, review_id, round(score, 4) AS score FROM lex) e
    JOIN reviews r USING (review_id)""",
    "reviews", extra=_ENGINE_CTES + _LEX_CTES + [("lex", """
    SELECT query_id, review_id, score, rank FROM (
      SELECT query_id, review_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, review_id) AS rank
      FROM (SELECT query_id, review_id, round(sum(qw * dw), 6) AS score FROM qw JOIN cw USING (term)
            GROUP BY query_id, review_id) WHERE score > 0)
    WHERE rank <= 3""")]))
def compare_engines(spark, sf):
    """Top-3 of both engines side by side for the same text queries, with snippets."""
    from textlake.functions.text import snippet
    sem, lex = _engines(spark, sf)
    cols = ["query_id", "rank", "review_id", F.round("score", 4).alias("score")]
    hits = sem.select(F.lit("semantic").alias("engine"), *cols).unionByName(lex.select(F.lit("lexical").alias("engine"), *cols))
    return R.hits_to_docs(hits, V.reviews(spark, sf).select("review_id", snippet("text", 120).alias("snippet")))


@register("search_hits_docs", "text", with_ctes("""
    SELECT s.query_id, s.rank, s.score, s.review_id,
           CASE WHEN r.rating IN (1, 2) THEN 'Negativo' WHEN r.rating = 3 THEN 'Neutro' ELSE 'Positivo' END AS sentiment,
           left(r.text, 120) || '...' AS snippet
    FROM sem s JOIN reviews r ON r.review_id = s.review_id""", "reviews", extra=_ENGINE_CTES))
def search_hits_docs(spark, sf):
    """J9 + X25: hits joined to the document table (the hit list is k rows
    per query, so the join broadcasts it)."""
    from textlake.functions.text import snippet
    sem, _ = _engines(spark, sf)
    docs = V.reviews(spark, sf).select("review_id", L.target_class("rating").alias("sentiment"),
                                       snippet("text", 120).alias("snippet"))
    return R.hits_to_docs(sem, docs).select("query_id", "rank", "score", "review_id", "sentiment", "snippet")


@register("sql_ngrams", "text", r"""
    SELECT item_id, gram, count(*) AS n FROM (
      SELECT item_id, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]) AS grams
      FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t FROM benchmark)),
      unnest(grams) AS u(gram)
    GROUP BY item_id, gram""")
def sql_ngrams(spark, sf):
    """2.17: the n-gram UDTF used from Spark SQL with LATERAL."""
    import uuid
    from textlake.functions.udtf import register as register_udtf
    register_udtf(spark)
    view = f"benchmark_{uuid.uuid4().hex[:8]}"
    read_table(spark, sf, "benchmark", ["item_id", "text"]).createOrReplaceTempView(view)
    return spark.sql(f"SELECT b.item_id, g.gram, count(*) AS n FROM {view} b, LATERAL ngrams(b.text, 2) g "
                     f"GROUP BY b.item_id, g.gram")

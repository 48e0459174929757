"""ANSI SQL (DuckDB dialect) twins of ``sources.views`` and shared CTEs.

The oracle queries are written independently of the Spark code: the Spark
side uses the DataFrame API (bucketed ranks, struct-min dedupe, ...), the
SQL side the textbook form (plain windows, joins). Matching results are the
correctness check.
"""

from __future__ import annotations

# name -> (dependencies, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "reviews": ((), r"""
    SELECT d.doc_id AS review_id,
           split_part(d.text, chr(10), 1) AS title,
           d.text,
           CAST(CASE WHEN d.doc_id % 10 < 4 THEN 5 WHEN d.doc_id % 10 < 6 THEN 4
                     WHEN d.doc_id % 10 = 6 THEN 3 WHEN d.doc_id % 10 = 7 THEN 2
                     ELSE 1 END AS DOUBLE) AS rating,
           CASE WHEN d.doc_id % 13 = 0 THEN 'x' ELSE '' END || CAST(d.doc_id // 4 AS VARCHAR) AS parent_asin,
           d.doc_id % 11 <> 0 AS verified_purchase,
           d.doc_id % 7 AS helpful_vote,
           epoch_us(e.ts) // 1000 AS "timestamp",
           e.ts AS ts
    FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id"""),
    "products": ((), r"""
    SELECT CAST(p_partkey AS VARCHAR) AS parent_asin, p_name AS title, p_brand AS main_category,
           CASE WHEN p_partkey % 17 = 0 THEN 'n/a'
                WHEN p_partkey % 19 = 0 THEN 'from $' || CAST(p_retailprice AS VARCHAR)
                ELSE '$' || CAST(p_retailprice AS VARCHAR) END AS price,
           '["Office Products", "' || p_type || '"]' AS categories
    FROM part"""),
    "clean": (("reviews", "products"), r"""
    SELECT r.parent_asin, r.review_id, r.text, r.rating, r."timestamp", m.main_category
    FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY review_id) AS rn_
          FROM reviews
          WHERE text IS NOT NULL AND rating IS NOT NULL AND verified_purchase) r
    JOIN (SELECT parent_asin, main_category FROM products WHERE main_category IS NOT NULL) m
      ON m.parent_asin = r.parent_asin
    WHERE r.rn_ = 1 AND length(r.text) > 20 AND len(string_split(r.text, ' ')) >= 5"""),
    "features": (("clean",), r"""
    SELECT *, coalesce(mayusculas_count / nullif(char_total, 0) * 100, 0.0) AS porcentaje_mayusculas,
           exclamacion_count + interrogacion_count AS puntuacion_emocional,
           coalesce(CAST(unique_types AS DOUBLE) / nullif(total_tokens, 0), 0.0) AS ttr
    FROM (SELECT *,
                 CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT) AS mayusculas_count,
                 CAST(length(text) AS BIGINT) AS char_total,
                 CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS exclamacion_count,
                 CAST(length(text) - length(replace(text, '?', '')) AS BIGINT) AS interrogacion_count,
                 CAST(len(regexp_extract_all(lower(text), '[a-z0-9]+')) AS BIGINT) AS total_tokens,
                 CAST(len(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS BIGINT) AS unique_types
          FROM clean)"""),
    "vectors": ((), r"""
    SELECT vec_id AS review_id,
           list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(vec_id % 3 + 1 AS DOUBLE)) AS embedding,
           label
    FROM embeddings"""),
    "unit_vectors": (("vectors",), r"""
    SELECT review_id, label,
           list_transform(embedding, lambda x: x / (CASE WHEN nrm = 0 THEN 1.0 ELSE nrm END)) AS embedding
    FROM (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: x * x))) AS nrm FROM vectors)"""),
    "probs": ((), r"""
    SELECT model, review_id, label,
           list_transform(ex, lambda x: x / list_sum(ex)) AS proba
    FROM (SELECT m.model, e.vec_id AS review_id, CAST(e.label % 3 AS INTEGER) AS label,
                 list_transform(e.embedding[m.lo:m.lo + 2],
                                lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(e.embedding[m.lo:m.lo + 2]) AS DOUBLE))) AS ex
          FROM embeddings e,
               (VALUES ('m_a', 1), ('m_b', 4), ('m_c', 7)) AS m(model, lo))"""),
}


def with_ctes(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix ``body`` with the named CTEs (and their dependencies) in order."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in CTES[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][1]}\n)" for n in order]
    parts += [f"{n} AS ({b}\n)" for n, b in (extra or [])]
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body

"""Tokens, n-grams, term counts and TF-IDF as DataFrame jobs (SURVEY V1, V2,
A14, A15, R4).

TF-IDF is computed in long form -- one row per (document, term) -- which is
what a shuffle handles well:

    count terms    -> (doc, term) counts      in each row; repeated ids summed
    per term       -> df, corpus frequency    partial+final aggregate
    vocabulary     -> min_df, top max_features (TakeOrderedAndProject); the
                      join with the counts is left to adaptive execution
    weights        -> tf * idf, L2 norm per document (window per document,
                      bounded by the document's distinct terms)

idf follows the smooth formula ln((1 + n) / (1 + df)) + 1 with raw term
counts and L2-normalized rows (MLlib's ``IDF`` has no ``+ 1``, so it is not
used here).
"""

from __future__ import annotations

import functools
import glob
import os
import zipfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from textlake.functions.text import WORD_PATTERN
from textlake.session import release, staged


#: Terms that are counted at a time.
PIECE_TERMS = 1 << 21


@functools.lru_cache(maxsize=None)
def english_stop_words() -> tuple[str, ...]:
    """Spark MLlib's English stop-word list (``StopWordsRemover`` default),
    read from the Spark distribution so no second copy has to be kept."""
    import pyspark
    jars = glob.glob(os.path.join(os.path.dirname(pyspark.__file__), "jars", "spark-mllib_*.jar"))
    for jar in jars:
        with zipfile.ZipFile(jar) as z:
            name = "org/apache/spark/ml/feature/stopwords/english.txt"
            if name in z.namelist():
                return tuple(w.strip() for w in z.read(name).decode("utf-8").split("\n") if w.strip())
    from pyspark.ml.feature import StopWordsRemover
    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def word_tokens(text, stop_words: tuple[str, ...] | None = None) -> Column:
    """Lower-cased runs of two or more word characters, stop words removed."""
    c = F.col(text) if isinstance(text, str) else text
    toks = F.regexp_extract_all(F.lower(c), F.lit(WORD_PATTERN), 0)
    if stop_words:
        stop = list(stop_words)
        toks = F.filter(toks, lambda x: ~x.isin(stop))
    return toks


def bigrams(toks: Column) -> Column:
    """Adjacent pairs of the (already filtered) token sequence."""
    pairs = F.transform(toks, lambda x, i: F.concat(x, F.lit(" "), F.get(toks, i + 1)))
    return F.filter(pairs, lambda x: x.isNotNull())


def with_terms(df: DataFrame, text_col: str, ngram_range=(1, 1), stop_words=None,
               name: str = "_terms") -> DataFrame:
    """Add an array column of the text's terms (unigrams and/or bigrams).

    The token array is projected once as its own column; bigrams are then
    built from that column. (Referencing the token *expression* inside the
    bigram lambda would re-tokenize the whole text for every token.)"""
    lo, hi = ngram_range
    if hi > 2:
        raise ValueError("n-grams above 2 are not used by any query")
    keep = [c for c in df.columns if c != text_col]
    d = df.select(*keep, word_tokens(text_col, stop_words).alias("_tok"))
    toks = F.col("_tok")
    parts = []
    if lo <= 1 <= hi:
        parts.append(toks)
    if lo <= 2 <= hi:
        parts.append(bigrams(toks))
    out = parts[0] if len(parts) == 1 else F.concat(*parts)
    return d.select(*keep, out.alias(name))


def explode_terms(df: DataFrame, keep: list[str], text_col: str, ngram_range=(1, 1), stop_words=None) -> DataFrame:
    """(keep..., term): one row per term occurrence.

    ``explode_outer`` + a null filter instead of ``explode``: for ``explode``
    the optimizer infers a ``size(terms) > 0`` filter and pushes it below the
    projection with the term expression inlined, which evaluates the bigram
    lambda -- and the tokenizer inside it -- once per token."""
    t = with_terms(df.select(*keep, text_col), text_col, ngram_range, stop_words)
    return t.select(*keep, F.explode_outer("_terms").alias("term")).where(F.col("term").isNotNull())


def counted(df: DataFrame, keep: list[str], terms: str) -> DataFrame:
    """(keep..., term, tf): one row per distinct term of each row's array. Equal
    terms are neighbours once sorted, so a row is counted without a shuffle; the
    arrays are columns of their own for the reasons given at ``with_terms``."""
    d = df.select(*keep, F.sort_array(terms).alias("_s"))
    first = F.transform("_s", lambda x, i: F.when((i == 0) | (F.get("_s", i - 1) != x), i))
    d = d.select(*keep, "_s", F.filter(first, lambda i: i.isNotNull()).alias("_i"))
    after = F.concat(F.slice("_i", F.lit(2), F.size("_i")), F.array(F.size("_s")))
    d = d.select(*keep, F.zip_with("_i", after, lambda a, b: F.struct(F.get("_s", a).alias("term"), (b - a).cast("long").alias("tf"))).alias("_c"))
    return d.select(*keep, F.explode_outer("_c").alias("_c")).select(*keep, "_c.term", "_c.tf").where(F.col("term").isNotNull())


def term_counts(df: DataFrame, id_col: str, text_col: str, ngram_range=(1, 1), stop_words=None, packed: bool = False) -> DataFrame:
    """(id, term, tf): raw counts. Rows are counted one by one; only the counts of
    ids that several rows have are summed by a shuffle. ``packed`` leaves the counting
    to the reader: (id, tokens), one row an id, the tokens with a space between them."""
    if packed:
        if tuple(ngram_range) != (1, 1):
            raise ValueError("packed counts are those of single tokens")
        tokens = F.coalesce(F.array_join(word_tokens(text_col, stop_words), " "), F.lit(""))
        return _packed(staged(df.select(id_col, tokens.alias("tokens"))), id_col)
    return _term_counts(staged(df.select(id_col, text_col)), id_col, text_col, ngram_range, stop_words)


def _packed(rows: DataFrame, id_col: str) -> DataFrame:
    several = staged(rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(id_col).alias("_of")))
    release(rows.sparkSession)
    if several.isEmpty():
        return rows
    same = F.col(id_col).eqNullSafe(F.col("_of"))
    texts = F.filter(F.collect_list("tokens"), lambda t: t != "")
    merged = rows.join(several, same, "left_semi").groupBy(id_col).agg(F.array_join(texts, " ").alias("tokens"))
    out = rows.join(several, same, "left_anti").unionByName(merged)
    out._staged_at = rows._staged_at  # what ``discard`` deletes
    return out


def _term_counts(rows: DataFrame, id_col: str, text_col: str, ngram_range, stop_words) -> DataFrame:
    several = staged(rows.groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col(id_col).alias("_of")))
    one_row = lambda d: counted(with_terms(d, text_col, ngram_range, stop_words), [id_col], "_terms")
    if several.isEmpty():
        return one_row(rows)
    same = F.col(id_col).eqNullSafe(F.col("_of"))
    ex = explode_terms(rows.join(several, same, "left_semi"), [id_col], text_col, ngram_range, stop_words)
    return one_row(rows.join(several, same, "left_anti")).unionByName(ex.groupBy(id_col, "term").agg(F.count(F.lit(1)).alias("tf")))


def fit_counts(df: DataFrame, vocab_size: int, min_df: int = 1, terms: str = "terms", output: str = "tf") -> CountVectorizerModel:
    """V4: ``CountVectorizer`` whose vocabulary (the most frequent terms, ties by
    term) comes from an aggregate that spills; MLlib's own fit keeps the distinct
    terms of a partition, which grow with it, in a map of the task."""
    vocab = [r["term"] for r in top_terms(df, vocab_size, min_df, terms)]
    return CountVectorizerModel.from_vocabulary(vocab, inputCol=terms, outputCol=output)


def top_terms(df: DataFrame, vocab_size: int, min_df: int = 1, terms: str = "terms") -> list:
    """(term, df, freq) of the ``vocab_size`` most frequent terms of at least ``min_df`` rows, ties by term."""
    stats = term_stats(df, terms).where(F.col("df") >= min_df)
    return stats.orderBy(F.col("freq").desc(), "term").limit(vocab_size).collect()  # vocab_size rows


def _pieces(column):
    """Slices of an Arrow column of lists, of about PIECE_TERMS terms, with the row of each term."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, at = np.cumsum(lengths), 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE_TERMS, "right")))
        yield column.slice(at, to - at).flatten(), np.repeat(np.arange(to - at), lengths[at:to]), to - at
        at = to


def _sums(codes: np.ndarray, rows: np.ndarray, n_rows: int):
    """(codes, rows that have them, occurrences) of numbered terms."""
    pairs = np.sort(codes * n_rows + rows)
    new = np.r_[True, pairs[1:] != pairs[:-1]][:len(pairs)]
    own = pairs // n_rows
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]][:len(own)])
    return own[first], np.add.reduceat(new.astype(np.int64), first) if len(first) else first, np.diff(np.r_[first, len(own)])


def term_stats(df: DataFrame, terms: str = "terms") -> DataFrame:
    """(term, df, freq) of an array of terms, or of a text of terms with a space between
    them: rows and occurrences. Terms become numbers for a piece of the rows, which
    are sorted in place of their strings."""
    def run(batches):
        for batch in batches:
            for flat, rows, n in _pieces(token_lists(batch.column(0))):
                found = flat.dictionary_encode()
                known = found.indices.is_valid().to_numpy(zero_copy_only=False)
                codes, own, times = _sums(found.indices.fill_null(0).to_numpy(zero_copy_only=False)[known].astype(np.int64), rows[known], n)
                yield pa.RecordBatch.from_arrays([found.dictionary.take(pa.array(codes)), pa.array(own), pa.array(times)], names=["term", "df", "freq"])

    return df.select(terms).mapInArrow(run, "term string, df long, freq long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("freq").alias("freq"))


def token_lists(column) -> pa.Array:
    """Lists of tokens of texts that have a space between them; lists stay as they are."""
    if not pa.types.is_string(column.type):
        return column
    return pc.split_pattern(pc.if_else(pc.equal(column, ""), None, column), " ")


def top_ngrams(df: DataFrame, tokens: str, vocab_size: int, min_df: int = 1) -> list:
    """``top_terms`` of the tokens and their adjacent pairs, from texts of tokens. A pair
    is at most as frequent as either of its tokens, so only pairs of tokens that are as
    frequent as the last that the vocabulary has room for can enter it."""
    stats = term_stats(df, tokens).where(F.col("df") >= min_df)
    top = stats.orderBy(F.col("freq").desc(), "term").limit(4 * vocab_size + 1).collect()  # 4 * vocab_size + 1 rows
    least = top[vocab_size - 1]["freq"] if len(top) >= vocab_size else 1
    if len(top) > 4 * vocab_size and top[-1]["freq"] >= least:  # so many are as frequent as the last that all pairs are counted
        toks = F.when(F.col(tokens) != "", F.split(tokens, " "))
        pairs = term_stats(df.select(toks.alias("_t")).select(bigrams(F.col("_t")).alias("_p")), "_p")
    else:
        words = [r["term"] for r in top if r["freq"] >= least]
        pairs = _pair_stats(df, tokens, words, least, min_df)
    pairs = pairs.where((F.col("df") >= min_df) & (F.col("freq") >= least)).orderBy(F.col("freq").desc(), "term").limit(vocab_size).collect()
    return sorted([*top, *pairs], key=lambda r: (-r["freq"], r["term"].encode()))[:vocab_size]


def _pair_stats(df: DataFrame, tokens: str, words: list[str], least: int, min_df: int) -> DataFrame:
    """(term, df, freq) of the adjacent pairs of ``words`` that occur ``least`` times, in ``min_df`` rows."""
    sent = df.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        known = pa.array(sent.value, pa.string())
        for batch in batches:
            for flat, rows, n in _pieces(token_lists(batch.column(0))):
                code = pc.index_in(flat, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                a, b = code[:-1], code[1:]
                kept = (a >= 0) & (b >= 0) & (rows[:-1] == rows[1:])
                codes, own, times = _sums(a[kept] * len(known) + b[kept], rows[:-1][kept], n)
                yield pa.RecordBatch.from_arrays([pa.array(codes), pa.array(own), pa.array(times)], names=["c", "df", "freq"])

    def named(batches):
        known = pa.array(sent.value, pa.string())
        for batch in batches:
            c = batch.column(0).to_numpy()
            term = pc.binary_join_element_wise(known.take(pa.array(c // max(1, len(known)))), known.take(pa.array(c % max(1, len(known)))), " ")
            yield pa.RecordBatch.from_arrays([term, *batch.columns[1:]], names=["term", "df", "freq"])

    sums = df.select(tokens).mapInArrow(run, "c long, df long, freq long").groupBy("c").agg(F.sum("df").alias("df"), F.sum("freq").alias("freq"))
    return sums.where((F.col("df") >= min_df) & (F.col("freq") >= least)).mapInArrow(named, "term string, df long, freq long")


def fit_frequent(df: DataFrame, vocab_size: int, terms: str = "terms", output: str = "tf") -> CountVectorizerModel:
    """``CountVectorizer`` of all terms, whose vocabulary is MLlib's: occurrences are
    summed by an aggregate. Only if terms beyond the vocabulary are as frequent as its
    last one, MLlib's own fit chooses between them."""
    each = df.select(F.explode_outer(terms).alias("term")).where(F.col("term").isNotNull())
    top = each.groupBy("term").agg(F.count(F.lit(1)).alias("freq")).orderBy(F.col("freq").desc(), "term").limit(vocab_size + 1).collect()
    if not top or (len(top) > vocab_size and top[-1]["freq"] == top[-2]["freq"]):
        return CountVectorizer(inputCol=terms, outputCol=output, vocabSize=vocab_size).fit(df)
    return CountVectorizerModel.from_vocabulary([r["term"] for r in top[:vocab_size]], inputCol=terms, outputCol=output)


@dataclass
class TfidfModel:
    vocab: DataFrame      # term, df, idf
    weights: DataFrame    # id, term, weight (L2-normalized per document)
    n_docs: DataFrame     # one row: n
    id_col: str
    ngram_range: tuple[int, int]
    stop_words: tuple[str, ...] | None


def fit_tfidf(corpus: DataFrame, id_col: str = "review_id", text_col: str = "text",
              ngram_range=(1, 1), stop_words=None, min_df: int = 1,
              max_features: int | None = None, digits: int | None = 6, vocab_path: str | None = None) -> TfidfModel:
    """V1. The vocabulary is written to ``vocab_path``, or else staged."""
    rows = staged(corpus.select(id_col, text_col))
    tf = staged(_term_counts(rows, id_col, text_col, ngram_range, stop_words))  # read by vocabulary and weights
    n_docs = rows.agg(F.count(F.lit(1)).alias("n"))
    stats = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("freq"))
    stats = stats.where(F.col("df") >= min_df)
    if max_features:
        stats = stats.orderBy(F.col("freq").desc(), F.col("term")).limit(max_features)
    n = n_docs.scalar()  # scalar subquery: corpus size, evaluated once
    vocab = stats.select("term", "df", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf"))
    if vocab_path:
        vocab.write.parquet(vocab_path)
        vocab = corpus.sparkSession.read.schema(vocab.schema).parquet(vocab_path)
    else:
        vocab = staged(vocab)
    weights = _weights(tf, vocab, id_col, digits)
    return TfidfModel(vocab, weights, n_docs, id_col, tuple(ngram_range), stop_words)


def _weights(tf: DataFrame, vocab: DataFrame, id_col: str, digits: int | None) -> DataFrame:
    w = tf.join(vocab.select("term", "idf"), "term", "inner").withColumn("w", F.col("tf") * F.col("idf"))
    norms = w.groupBy(F.col(id_col).alias("_of")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    weight = F.col("w") / F.col("_norm")
    if digits is not None:
        weight = F.round(weight, digits)
    return w.join(norms, F.col(id_col).eqNullSafe(F.col("_of"))).select(id_col, "term", weight.alias("weight"))


def transform_tfidf(model: TfidfModel, df: DataFrame, id_col: str, text_col: str,
                    digits: int | None = None) -> DataFrame:
    """Weights of new texts (queries) under a fitted vocabulary; unknown terms
    are ignored before normalization."""
    tf = term_counts(df, id_col, text_col, model.ngram_range, model.stop_words)
    return _weights(tf, model.vocab, id_col, digits)


def top_terms_per_group(df: DataFrame, group: str, text_col: str, n: int, ngram_range=(2, 2),
                        stop_words=None) -> DataFrame:
    """The ``n`` most frequent terms per group (ties by term)."""
    ex = explode_terms(df, [group], text_col, ngram_range, stop_words)
    counts = ex.groupBy(group, "term").agg(F.count(F.lit(1)).alias("conteo"))
    w = Window.partitionBy(group).orderBy(F.col("conteo").desc(), F.col("term"))
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)

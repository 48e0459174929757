"""Scalar text functions as Column expressions.

Every function returns a JVM-side Column, so it stays inside whole-stage
codegen and Catalyst can collapse chains of them into one projection.
Regex patterns use explicit character classes: ``\\w``/``\\s``/``\\b`` mean
different things in Java and in other regex engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlake.functions._util import col

# Fixed values (must match the reference's feature definitions).
UPPER_PATTERN = "[A-Z]"          # ASCII capitals only
TOKEN_PATTERN = "[a-z0-9]+"      # tokens of the lower-cased text, for TTR
WORD_PATTERN = "[\\p{L}\\p{N}_]{2,}"  # word tokens of two or more word chars
WHITESPACE = "[ \\t\\n\\r\\f\\x0B]"  # Python str.split() separators (ASCII part)
SUBCATEGORY_PATTERN = '^\\["[^"]+",\\s*"([^"]+)"'
DEFAULT_SUBCATEGORY = "Categoría General"
SNIPPET_SUFFIX = "..."


def char_total(text) -> Column:
    """Length in code points."""
    return F.length(col(text)).cast("bigint")


def upper_count(text) -> Column:
    """Number of ASCII capital letters."""
    return F.regexp_count(col(text), F.lit(UPPER_PATTERN)).cast("bigint")


def char_count(text, ch: str) -> Column:
    """Occurrences of one literal character (``!``, ``?``)."""
    c = col(text)
    return (F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))).cast("bigint")


def uppercase_pct(upper, chars) -> Column:
    """Upper / chars * 100; null (and 0/0) becomes 0."""
    return F.coalesce(F.try_divide(col(upper), col(chars)) * F.lit(100.0), F.lit(0.0))


def emotional_punct(excl, quest) -> Column:
    """``!`` count + ``?`` count."""
    return (col(excl) + col(quest)).cast("bigint")


def tokens(text) -> Column:
    """All ``[a-z0-9]+`` runs of the lower-cased text."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(TOKEN_PATTERN), 0)


def total_tokens(toks) -> Column:
    """Token count, null -> 0."""
    c = col(toks)
    return F.when(c.isNull(), F.lit(0)).otherwise(F.size(c)).cast("bigint")


def unique_types(toks) -> Column:
    """Distinct token count, null -> 0."""
    c = col(toks)
    return F.when(c.isNull(), F.lit(0)).otherwise(F.size(F.array_distinct(c))).cast("bigint")


def ttr(unique, total) -> Column:
    """Unique / total; 0/0 and null -> 0."""
    return F.coalesce(F.try_divide(col(unique).cast("double"), col(total)), F.lit(0.0))


def words_space(text) -> Column:
    """Pieces of a split on single spaces (double spaces count empties)."""
    return F.size(F.split(col(text), " ", -1)).cast("bigint")


def words_ws(text) -> Column:
    """Whitespace-separated words (``str.split()`` semantics)."""
    parts = F.split(col(text), WHITESPACE + "+", -1)
    return F.size(F.filter(parts, lambda x: x != F.lit(""))).cast("bigint")


def text_cleaned(text) -> Column:
    """X11: lower, keep ``[a-z]`` and whitespace, collapse whitespace, trim;
    null -> ''."""
    c = F.lower(col(text))
    c = F.regexp_replace(c, "[^a-z \\t\\n\\r\\f\\x0B]", "")
    c = F.regexp_replace(c, WHITESPACE + "+", " ")
    return F.coalesce(F.trim(c), F.lit(""))


def text_length(text) -> Column:
    """Words of the cleaned text."""
    return words_ws(text_cleaned(text))


def price_num_zero(price) -> Column:
    """Strip ``$`` and ``,``; unparsable -> 0."""
    stripped = F.regexp_replace(col(price).cast("string"), "[$,]", "")
    return F.coalesce(stripped.try_cast("double"), F.lit(0.0))


def price_digits(price) -> Column:
    """X14 first step: keep digits and dots, parse; unparsable -> null."""
    stripped = F.regexp_replace(col(price).cast("string"), "[^0-9.]", "")
    return stripped.try_cast("double")


def sub_category(categories) -> Column:
    """Second element of a JSON string array, else the default label."""
    second = F.regexp_extract(col(categories), SUBCATEGORY_PATTERN, 1)
    return F.coalesce(F.nullif(second, F.lit("")), F.lit(DEFAULT_SUBCATEGORY))


def snippet(text, n: int = 200) -> Column:
    """First ``n`` characters followed by ``...``."""
    return F.concat(F.substring(col(text), 1, n), F.lit(SNIPPET_SUFFIX))


def slug(name) -> Column:
    """Lower-case, spaces to underscores."""
    return F.replace(F.lower(col(name)), F.lit(" "), F.lit("_"))


def to_json_text(value) -> Column:
    """Nested value -> JSON text."""
    return F.to_json(col(value))


def title_of(text) -> Column:
    """First line of a text (review title stand-in)."""
    return F.substring_index(col(text), "\n", 1)

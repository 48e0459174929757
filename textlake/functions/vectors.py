"""Array-vector functions.

Vectors are ``array<float>``/``array<double>`` columns; all arithmetic is in
double. Higher-order functions run in the JVM; for the hot path of search
(many queries x many vectors) see ``operators.search`` which batches in numpy.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlake.functions._util import col


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def _divide_each(c: Column, scalar: Column) -> Column:
    """c[i] / scalar with the scalar evaluated once per row: it is passed in
    as a repeated array instead of being referenced inside the lambda (an
    outer expression inside a lambda is re-evaluated for every element)."""
    return F.zip_with(c, F.array_repeat(scalar, F.size(c)), lambda x, d: x.cast("double") / d)


def l2_normalize(v) -> Column:
    """V / ||v||; a zero vector is divided by 1 (stays zero)."""
    c = col(v)
    n = l2_norm(c)
    return _divide_each(c, F.when(n == 0, F.lit(1.0)).otherwise(n))


def dot(a, b) -> Column:
    """Inner product in double."""
    prods = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, x: acc + x)


def scale(v, factor) -> Column:
    return F.transform(col(v), lambda x: x.cast("double") * col(factor))


def softmax(v) -> Column:
    """exp(x - max) / sum."""
    c = col(v)
    m = F.array_max(c).cast("double")
    e = F.zip_with(c, F.array_repeat(m, F.size(c)), lambda x, mx: F.exp(x.cast("double") - mx))
    s = F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x)
    return _divide_each(e, s)


def argmax(v) -> Column:
    """T5: 0-based index of the largest value, first index on ties."""
    c = col(v)
    return (F.array_position(c, F.array_max(c)) - 1).cast("int")


def confidence(p, digits: int = 4) -> Column:
    """Highest probability, rounded."""
    return F.round(F.array_max(col(p)), digits)


def prob_map(p, labels: list[str], digits: int = 4) -> Column:
    """Label -> rounded probability."""
    return F.map_from_arrays(F.array(*[F.lit(x) for x in labels]),
                             F.transform(col(p), lambda x: F.round(x, digits)))

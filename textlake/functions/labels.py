"""Rating/class mappings and calendar parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textlake.functions._util import col

# Class labels in code order, and display names.
CLASS_LABELS = ["Negativo", "Neutro", "Positivo"]
QUOTA_LABELS = ["negativo", "neutro", "positivo"]
MONTH_NAMES = ["Ene", "Feb", "Mar", "Abr", "May", "Jun", "Jul", "Ago", "Sep", "Oct", "Nov", "Dic"]
WEEKDAY_NAMES = ["Lun", "Mar", "Mie", "Jue", "Vie", "Sab", "Dom"]
STAR_NAMES = {5.0: "5 Estrellas", 4.0: "4 Estrellas", 3.0: "3 Estrellas", 2.0: "2 Estrellas", 1.0: "1 Estrella"}
RATINGS = [1.0, 2.0, 3.0, 4.0, 5.0]


def target_class(rating) -> Column:
    """{1,2} -> Negativo, 3 -> Neutro, anything else -> Positivo."""
    r = col(rating)
    return (F.when(r.isin(1.0, 2.0), F.lit(CLASS_LABELS[0]))
            .when(r == 3.0, F.lit(CLASS_LABELS[1]))
            .otherwise(F.lit(CLASS_LABELS[2])))


def sentiment_class(rating) -> Column:
    """<=2 -> 0, 3 -> 1, else 2."""
    r = col(rating)
    return F.when(r <= 2, F.lit(0)).when(r == 3, F.lit(1)).otherwise(F.lit(2)).cast("int")


def quota_class(rating) -> Column:
    """Missing rating counts as 0; values between classes get null."""
    r = F.coalesce(col(rating).cast("double"), F.lit(0.0))
    return (F.when(r <= 2, F.lit(QUOTA_LABELS[0]))
            .when(r == 3.0, F.lit(QUOTA_LABELS[1]))
            .when(r >= 4.0, F.lit(QUOTA_LABELS[2])))


def label_to_code(label) -> Column:
    """X19 strict: unknown label raises instead of mapping to null."""
    c = col(label)
    code = F.array_position(F.array(*[F.lit(x) for x in CLASS_LABELS]), c).cast("int") - 1
    return F.when(code >= 0, code).otherwise(
        F.raise_error(F.concat(F.lit("unknown class label: "), F.coalesce(c, F.lit("NULL")))).cast("int"))


def code_to_label(code) -> Column:
    """0/1/2 -> label; out of range -> null."""
    return F.try_element_at(F.array(*[F.lit(x) for x in CLASS_LABELS]), col(code).cast("int") + 1)


def epoch_ms_to_ts(ms) -> Column:
    """Epoch milliseconds -> timestamp (session time zone is UTC)."""
    return F.timestamp_millis(col(ms))


def month_of(ts) -> Column:
    return F.month(col(ts)).cast("int")


def iso_weekday(ts) -> Column:
    """Monday = 1 ... Sunday = 7."""
    return (F.weekday(col(ts)) + 1).cast("int")


def month_name(month) -> Column:
    """1..12 -> short Spanish month name."""
    return F.element_at(F.array(*[F.lit(x) for x in MONTH_NAMES]), col(month).cast("int"))


def weekday_name(day) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in WEEKDAY_NAMES]), col(day).cast("int"))


def star_name(rating) -> Column:
    m = F.create_map(*[x for k, v in STAR_NAMES.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, col(rating).cast("double"))

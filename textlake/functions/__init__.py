"""Column-expression library: text features, labels, calendar, vectors."""

from textlake.functions import labels, text, vectors  # noqa: F401

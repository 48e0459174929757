"""SQL-facing table function: ``ngrams(text, n)``.

For SQL users who want token n-grams in a ``LATERAL`` clause. The DataFrame
operators use the built-in array functions instead (``operators.text``); this
Python UDTF is a small per-row helper on the Arrow path.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf



@udtf(returnType="pos int, gram string", useArrow=True)
class NGrams:
    def __init__(self):
        import re
        self.words = re.compile(r"\w{2,}")  # letters, digits and underscore, as functions.text.WORD_PATTERN

    def eval(self, text, n):
        if text is None or n is None or n < 1:
            return
        toks = self.words.findall(text.lower())
        for i in range(len(toks) - n + 1):
            yield i, " ".join(toks[i:i + n])


def register(spark: SparkSession) -> None:
    spark.udtf.register("ngrams", NGrams)

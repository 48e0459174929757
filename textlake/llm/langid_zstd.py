"""Language by compression: one zstandard raw-content dictionary per language.

The letters of a text (lower-cased, other characters as single spaces) are cut
into blocks of 4,096 bytes, each compressed once per language; the language of
the smallest total wins. A narrow margin is reported as a rejection.
"""

from __future__ import annotations

import math
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textlake.llm.common import held_out, stage

#: Bounds of the fitted sample: documents per language, and bytes of a dictionary.
SAMPLE_DOCS, DICT_BYTES = 128, 1 << 15
BLOCK = 4096
LEVEL = 6
#: Least advantage over the second language, as a share of the best size, that is not rejected.
MARGIN = 0.02

_LETTERS = re.compile(r"[^\W\d_]+")


def letters(text: str | None) -> bytes:
    return " ".join(_LETTERS.findall(text.lower())).encode() if text else b""


def _compressors(dictionaries: dict[str, bytes], level: int):
    out = []
    for lang, content in dictionaries.items():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out.append((lang, zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)))
    return out


def _sizes(body: bytes, compressors) -> list[int]:
    cuts = range(0, len(body), BLOCK)
    return [sum(len(c.compress(body[i:i + BLOCK])) for i in cuts) for _, c in compressors]


def learn_dictionaries(train: DataFrame, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> dict[str, bytes]:
    """One dictionary per language of up to SAMPLE_DOCS rows, those of smallest id
    hash. Each of them gives an even share of the DICT_BYTES, a piece from a place
    in its whole text that a hash of id and text chooses (a text no longer than
    the share gives all of it), cut in the tasks. Languages come by their number of
    rows, the most first."""
    keyed = train.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    order = F.xxhash64(key_col)
    share = F.shiftrightunsigned(F.xxhash64("_k"), 11) / float(1 << 53)  # even in [0, 1)
    ids = keyed.select(F.col(lang_col).alias("_l"), F.col(key_col).alias("_k")).distinct().withColumn("_s", share)
    # Four times as many as needed are ranked, so a common language is no large window.
    most = stage(ids.groupBy("_l").agg((4.0 * SAMPLE_DOCS / F.count("*")).alias("_most")), "languages")
    ids = ids.join(most, "_l").where("_s <= _most")
    ids = ids.withColumn("_r", F.row_number().over(Window.partitionBy("_l").orderBy("_s", "_k"))).where(f"_r <= {SAMPLE_DOCS}")
    ids = stage(ids, "sample")  # so small a table is joined without a shuffle of the texts
    rows = keyed.join(ids, (keyed[lang_col] == ids["_l"]) & keyed[key_col].eqNullSafe(ids["_k"]), "left_semi")
    rows = rows.select(F.col(lang_col).alias("lang"), order.alias("o"), F.col(text_col).alias("text"), F.xxhash64(key_col, text_col).alias("place"))
    used = stage(ids.groupBy(F.col("_l").alias("lang")).agg(F.ceil(F.lit(float(DICT_BYTES)) / F.count("*")).cast("int").alias("share")), "shares")
    start = F.pmod(F.col("place"), F.greatest(F.length("text") - F.col("share"), F.lit(0)) + 1).cast("int")
    rows = rows.join(used, "lang").select("lang", "o", F.substr("text", start + 1, F.col("share")).alias("text")).collect()  # pieces alone
    parts: dict[str, list[bytes]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.o, r.text)):
        parts.setdefault(r.lang, []).append(letters(r.text))
    count = dict(keyed.groupBy(F.col(lang_col).alias("l")).count().where(F.col("l").isin(list(parts))).collect())
    return {lang: b" ".join(parts[lang])[:DICT_BYTES] for lang in sorted(parts, key=lambda x: (-count[x], x)) if any(parts[lang])}


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score, margin, rejected), one row per row of ``docs``.

    ``lang_pred`` is the language of the smallest size (ties: the one
    with more rows to learn from), ``und`` with score 0 if the text is null or has no letter, or if
    nothing was learned. ``margin`` is (second - best) / best, ``rejected``
    tells that it is under MARGIN; ``score`` grows with the saved bytes.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def predict(batches):
        compressors = _compressors(sent.value, LEVEL)
        for batch in batches:
            out = []
            for t in batch.column(1):
                body = letters(t.as_py())
                if not body or not compressors:
                    out.append(("und", 0.0, 0.0, True))
                    continue
                sizes = _sizes(body, compressors)
                best = min(sizes)
                i = sizes.index(best)
                second = min((s for j, s in enumerate(sizes) if j != i), default=2 * best)
                margin = (second - best) / best
                total = sum(math.exp(-min(0.7 * (s - best), 700.0)) for s in sizes)
                out.append((compressors[i][0], 1 / total, margin, margin < MARGIN))
            cols = zip(*out) if out else [[]] * 4
            types = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, types))],
                                             names=["id", "lang_pred", "score", "margin", "rejected"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        predict, f"id {kind}, lang_pred string, score double, margin double, rejected boolean")
    return out.withColumnRenamed("id", id_col)


def train_and_identify(docs: DataFrame) -> DataFrame:
    """Learn from the four fifths that are not held out, predict every row."""
    learned = learn_dictionaries(docs.where(~held_out(F.col("doc_id"), 0)))
    return identify_language(docs, learned)

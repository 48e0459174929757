"""Removal of repeated runs of lines, by content-defined chunks. Built-in
functions only.

A line's value is the first 28 bits of its MD5, and the rolling hash at a line
is its value plus FACTOR times the value of the line before. A chunk ends where
that hash is a multiple of DIVISOR, so an inserted line moves borders only near
itself. Of every chunk of two lines or more that occurs more than once in the
corpus, one occurrence stays: that of the smallest document id, then place.

Only 8-byte hashes of all chunks are shuffled at first; the bytes of those that
repeat follow, and are compared. The documents' text moves once, to meet the
places of the chunks to remove.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import stage

FACTOR, DIVISOR = 31, 3

#: A line feed begins every line but the first of a chunk, and two end a chunk:
#: a mark before each line keeps empty lines from looking like the latter.
_MARK = "x"


def _lines_and_values(text):
    lines = F.split(text, "\n")
    return lines, F.transform(lines, lambda l: F.conv(F.substring(F.md5(l.cast("binary")), 1, 7), 16, 10).cast("long"))


def chunk_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with ``chunks``: array of (text, n_lines, hash); null for null texts."""
    lines, values = _lines_and_values(F.col(text_col))
    rows = docs.withColumn("_lines", lines).withColumn("_values", values)
    before = F.concat(F.array(F.lit(0).cast("long")), F.col("_values"))
    ends = F.zip_with("_values", before, lambda a, b: (a + FACTOR * b) % DIVISOR == 0)
    rows = rows.withColumn("_starts", F.concat(F.array(F.lit(False)), ends))
    marked = F.zip_with("_lines", F.slice("_starts", 1, F.size("_lines")), lambda l, s: F.concat(F.when(s, F.lit("\n")).otherwise(F.lit("")), F.lit(_MARK), l))
    parts = F.split(F.array_join(marked, "\n"), "\n\n")
    chunks = F.transform(parts, lambda c: F.struct(
        F.substr(F.replace(c, F.lit("\n" + _MARK), F.lit("\n")), F.lit(2)).alias("text"),
        F.size(F.split(c, "\n")).cast("long").alias("n_lines"), F.xxhash64(c).alias("hash")))
    return rows.withColumn("chunks", chunks).drop("_lines", "_values", "_starts")


def remove_repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_lines, n_chunks, removed_chunks, removed_lines, text), a row
    per row of ``docs``; ``text`` is what remains, lines joined by line feeds.

    Chunks of one line, and chunks of blank lines alone, always stay. A null
    text has no lines and stays null, an empty one is a single empty line. Null
    ids come first in the order of occurrences, rows that share an id follow
    each other, and repeated rows lose the chunks of all but the first. Other
    columns are not read.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = stage(chunk_texts(rows, "text").drop("text"), "chunked")
    chunk = rows.select("rid", "id", F.posexplode("chunks").alias("pos", "c")).where("c.n_lines > 1 AND trim(BOTH ' \t\r\n' FROM c.text) <> ''")
    chunk = chunk.select("rid", "id", "pos", "c.n_lines", "c.hash", "c.text")
    again = chunk.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    again = stage(chunk.join(stage(again, "repeated").hint("merge"), "hash", "left_semi"), "candidates")
    place = F.struct("id", "rid", "pos")
    first = stage(again.groupBy("hash", "text").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    gone = again.join(first.hint("merge"), ["hash", "text"]).where((F.col("rid") != F.col("first.rid")) | (F.col("pos") != F.col("first.pos")))
    gone = stage(gone.groupBy("rid").agg(F.sort_array(F.collect_list("pos")).alias("gone"), F.sum("n_lines").alias("removed_lines")), "gone")
    out = rows.join(gone.hint("merge"), "rid", "left")
    kept = F.zip_with("chunks", _flags(), lambda c, g: F.when(~g, c["text"]))
    text = F.when(F.col("gone").isNull(), F.array_join(F.col("chunks.text"), "\n")).otherwise(F.array_join(kept, "\n"))
    zero = F.lit(0).cast("long")
    n_lines = F.aggregate("chunks", F.lit(0).cast("long"), lambda n, c: n + c["n_lines"])
    return out.select(F.col("id").alias(id_col), F.coalesce(n_lines, zero).alias("n_lines"),
                      F.when(F.col("chunks").isNull(), zero).otherwise(F.size("chunks").cast("long")).alias("n_chunks"),
                      F.when(F.col("gone").isNull(), zero).otherwise(F.size("gone").cast("long")).alias("removed_chunks"),
                      F.coalesce("removed_lines", zero).alias("removed_lines"), text.alias(text_col))


def _flags():
    """Whether each chunk of a row is removed: the removed places cut the row
    into stretches, each told by its length."""
    ends = F.concat(F.col("gone"), F.array(F.size("chunks")))
    starts = F.concat(F.array(F.lit(-1)), F.col("gone"))
    stretch = F.zip_with(starts, ends, lambda a, b: F.concat(F.array_repeat(F.lit(False), b - a - 1), F.array(F.lit(True))))
    return F.slice(F.flatten(stretch), 1, F.size("chunks"))


SQL = f"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS v FROM lines),
rolled AS (
  SELECT *, (v + {FACTOR} * coalesce(lag(v) OVER (PARTITION BY doc_id ORDER BY i), 0)) % {DIVISOR} = 0 AS ends FROM hashed),
numbered AS (
  SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM rolled),
chunks AS (
  SELECT doc_id, pos, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n_lines FROM numbered GROUP BY doc_id, pos),
flagged AS (
  SELECT *, n_lines > 1 AND trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''
    AND row_number() OVER (PARTITION BY text ORDER BY doc_id, pos) > 1 AS gone FROM chunks)
SELECT doc_id, sum(n_lines)::BIGINT AS n_lines, count(*) AS n_chunks,
  count(*) FILTER (gone) AS removed_chunks, coalesce(sum(n_lines) FILTER (gone), 0)::BIGINT AS removed_lines,
  coalesce(string_agg(text, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS text
FROM flagged GROUP BY doc_id
"""

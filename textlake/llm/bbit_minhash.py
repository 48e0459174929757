"""Near-duplicate documents by b-bit MinHash.

1. Every document becomes the set of its distinct word 5-grams (the whole
   sequence if it has fewer words). Documents of equal sets are one class;
   classes are numbered, and links and components are those of classes.
2. 128 minima per class: 32 bands of 4 full minima give candidate buckets;
   the low 4 bits of all minima are packed into 8 longs.
3. In each bucket the member with the smallest number is paired with the
   others. A pair goes on if the sizes of its sets allow the threshold, and its
   similarity estimate, corrected for chance matches of the low bits, is not 5
   standard deviations below it. Sets of fewer than SMALL shingles go on
   without an estimate, as their minima are not spread well enough for one.
4. Pairs are confirmed on the full sets, in groups of bounded size.
5. Links give components. In buckets that still hold several components, the
   pairs of different components are estimated and confirmed block by block
   inside tasks, so no link between components is lost, and no pair becomes a
   row before it is confirmed.

A pair of similarity 0.75 shares no band with probability 5e-6.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import row_blocks, stage, text_buffer
from textlake.llm.components import connected_components
from textlake.llm.words import SPACE, U, Words, kgrams, mix, sequence_hash

SHINGLE = 5
PERMS, ROWS, BITS = 128, 4, 4
BANDS, LANES = PERMS // ROWS, PERMS * BITS // 64
#: Rows that one task confirms against one document at a time, and shingles of a block of a bucket.
GROUP = 256
BLOCK = 1 << 21
#: Pairs with a smaller set than this are confirmed whatever their estimate.
SMALL = 64
_SIG = [f"s{i}" for i in range(LANES)]


def _sets(hasher: Words, buf, offs):
    """Sorted distinct shingle hashes of each row."""
    _, _, h, row = hasher.find(buf, offs)
    g, whole = kgrams(h, row, SHINGLE)
    edge = np.searchsorted(row, np.arange(len(offs)))
    for i in range(len(offs) - 1):
        a, b = int(edge[i]), int(edge[i + 1])
        if b - a >= SHINGLE:
            yield np.unique(g[a:b - SHINGLE + 1])
        elif b > a:
            yield np.array([sequence_hash(h[a:b])], U)
        else:
            yield np.empty(0, U)


def _minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low = np.full(PERMS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 4096):
        np.minimum(low, (a[:, None] * x[None, i:i + 4096] + b[:, None]).min(axis=1), out=low)
    return low


def _class_key(s: np.ndarray):
    """128 bits that tell sets apart, together with their size."""
    return mix(s + U(7)).sum(dtype=U), np.bitwise_xor.reduce(mix(s * U(3)))


def _signer(carried: list[str]):
    names = [*carried, "n_shingles", "k1", "k2", *_SIG, "bands"]

    def sign(batches):
        hasher, rng = Words(SPACE), np.random.default_rng(128)
        a = (rng.integers(0, 1 << 31, PERMS, dtype=np.int64) * 2 + 1).astype(np.uint32)
        b = rng.integers(0, 1 << 32, PERMS, dtype=np.int64).astype(np.uint32)
        lane = (np.arange(PERMS) % (64 // BITS) * BITS).astype(U)
        mult = mix(np.arange(1, ROWS + 1, dtype=U))
        salt = mix(np.arange(1000, 1000 + BANDS, dtype=U))
        for batch in batches:
            buf, offs = text_buffer(batch.column("text"))
            for i, j in row_blocks(offs, 4 << 20):
                n = np.zeros(j - i, np.int64)
                keys, sig, bands = np.zeros((j - i, 2), U), np.zeros((j - i, LANES), U), []
                for r, s in enumerate(_sets(hasher, buf, offs[i:j + 1])):
                    n[r] = len(s)
                    if not len(s):
                        bands.append(None)
                        continue
                    keys[r] = _class_key(s)
                    m = _minima((s >> U(32)).astype(np.uint32), a, b).astype(U)
                    sig[r] = np.bitwise_or.reduce(((m & U((1 << BITS) - 1)) << lane).reshape(LANES, -1), axis=1)
                    bands.append(mix((m.reshape(BANDS, ROWS) * mult).sum(axis=1, dtype=U) + salt).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in carried), pa.array(n), *(pa.array(keys[:, c].copy().view(np.int64)) for c in (0, 1)),
                     *(pa.array(sig[:, c].copy().view(np.int64)) for c in range(LANES)),
                     pa.array(bands, pa.list_(pa.int64()))], names=names)
    return sign


def _estimate(x: str, y: str):
    """Similarity from the share of equal low-bit groups, less those equal by chance (2**-BITS)."""
    same = F.lit(0)
    for c in _SIG:
        d = F.col(f"{x}.{c}").bitwiseXOR(F.col(f"{y}.{c}"))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 1))
        d = d.bitwiseOR(F.shiftrightunsigned(d, 2))
        same = same + F.lit(64 // BITS) - F.bit_count(d.bitwiseAND(F.lit(0x1111111111111111)))
    chance = 2.0 ** -BITS
    return (same / float(PERMS) - chance) / (1 - chance)


def _cut(threshold: float) -> float:
    chance = 2.0 ** -BITS
    p = chance + (1 - chance) * threshold
    return threshold - 5 * (p * (1 - p) / PERMS) ** 0.5 / (1 - chance)


def _set_rows():
    schema = pa.schema([("id", pa.int64()), ("shingles", pa.binary())])

    def rows(batches):
        """Repeated rows come one after the other, since the rows were joined by what they have in common; one is enough."""
        hasher, last = Words(SPACE), -1
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy()
            batch = batch.filter(pa.array(np.diff(ids, prepend=last) != 0))
            last = ids[-1]
            buf, offs = text_buffer(batch.column("text"))
            ids, k1, k2 = (batch.column(c).to_numpy().view(U) for c in ("id", "k1", "k2"))
            for i, j in row_blocks(offs, 4 << 20):
                out, sets = [], []
                for r, s in enumerate(_sets(hasher, buf, offs[i:j + 1]), i):
                    if len(s) and _class_key(s) == (k1[r], k2[r]):  # not another text of the same hash
                        out.append(ids[r]), sets.append(s.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(np.array(out, U).view(np.int64)), pa.array(sets, pa.binary())], schema=schema)
    return rows


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    z = np.sort(np.concatenate((x, y)), kind="stable")
    both = int(np.count_nonzero(z[1:] == z[:-1]))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _confirmer(percent: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def confirm(batches):
        """Rows come by (u, part), the row of u itself first."""
        own = None
        for batch in batches:
            us, vs, sets = batch.column("u"), batch.column("v"), batch.column("shingles")
            left, right = [], []
            for u, v, s in zip(us, vs, sets):
                s = np.frombuffer(s.as_buffer(), U)
                if u == v:
                    own = s
                    continue
                if _linked(own, s, percent):
                    left.append(u.as_py()), right.append(v.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], schema=schema)
    return confirm


def _shingle_sets(ids: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, shingles) of the classes with these numbers, from a text of each."""
    wanted = reps.select("id", "doc", "text_hash", "k1", "k2").join(ids.hint("merge"), "id", "left_semi")
    used = docs.select(F.col("id").alias("doc"), "text_hash", "text").join(wanted.hint("merge"), ["doc", "text_hash"])
    return used.select("id", "k1", "k2", "text").mapInArrow(_set_rows(), "id long, shingles binary")


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (u, v) whose full shingle sets meet the threshold.
    The larger number ``v`` travels with its set; ``u`` comes once per GROUP pairs."""
    size = stage(pairs.groupBy("u").agg(F.ceil(F.count("*") / GROUP).alias("parts")), "pair-counts")
    pairs = pairs.join(size.hint("merge"), "u").withColumn("part", F.expr("pmod(xxhash64(v), parts)"))
    need = stage(pairs.select("u", "v", "part").union(
        size.select("u", F.col("u").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))), "confirm")
    sets = _shingle_sets(need.select(F.col("v").alias("id")).distinct(), reps, docs)
    rows = need.join(sets.withColumnRenamed("id", "v").hint("merge"), "v")
    rows = rows.repartition("u", "part").sortWithinPartitions("u", "part", F.expr("u <> v"))
    return rows.select("u", "v", "shingles").mapInArrow(_confirmer(percent), "u long, v long")


def _block_task(cut: float, percent: int, confirm: bool):
    """For each (bucket, two blocks) whose rows come together: the rows that
    may be linked with a row of another component, or with ``confirm`` the
    links themselves, one for each two components that they join."""
    import pandas as pd

    chance = 2.0 ** -BITS
    ones = U(0x1111111111111111)

    def run(key: tuple, t: pd.DataFrame) -> pd.DataFrame:
        first, second = (np.flatnonzero((t.block == k).to_numpy()) for k in key[1:])
        ids, comp = t.id.to_numpy(), t.component.to_numpy().copy()
        size = t.n_shingles.to_numpy()
        sig = np.stack([t[c].to_numpy() for c in _SIG]).view(U)
        if confirm:
            bands, sets = np.stack(t.bands.to_numpy()), [np.frombuffer(x, U) for x in t.shingles]
        likely, left, right = np.zeros(len(t), bool), [], []
        for r in first:
            same = np.full(len(second), PERMS, np.int64)
            for lane in sig:
                d = lane[second] ^ lane[r]
                d |= d >> U(1)
                d |= d >> U(2)
                same -= np.bitwise_count(d & ones)
            other = size[second]
            ok = ((same / PERMS - chance) / (1 - chance) >= cut) | (np.minimum(other, size[r]) < SMALL)
            ok &= (comp[second] != comp[r]) & (100 * np.minimum(other, size[r]) >= percent * np.maximum(other, size[r]))
            hit = second[ok & (second > r)] if key[1] == key[2] else second[ok]
            if not confirm:
                likely[hit], likely[r] = True, likely[r] or len(hit) > 0
                continue
            # Each pair is looked at in the first band that it shares.
            hit = hit[bands[r][(bands[hit] == bands[r]).argmax(axis=1)] == key[0]]
            for i in hit:
                if comp[i] != comp[r] and _linked(sets[r], sets[i], percent):
                    left.append(ids[r]), right.append(ids[i])
                    comp[comp == comp[i]] = comp[r]
        if confirm:
            return pd.DataFrame({"u": np.array(left, np.int64), "v": np.array(right, np.int64)})
        return pd.DataFrame({"band": key[0], "lo": key[1], "hi": key[2], "id": ids[likely], "component": comp[likely], "block": t.block.to_numpy()[likely]})
    return run


def _components(signed: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """(k1, k2, n_shingles, component, first_id) of every class in ``signed``;
    ``first_id`` is the smallest id in the component."""
    key = ["k1", "k2", "n_shingles"]
    one = signed.groupBy(*key).agg(F.min(F.struct(F.col("id").alias("doc"), "text_hash")).alias("first")).select(*key, "first.*")
    classes = stage(one.withColumn("cid", F.monotonically_increasing_id()), "classes")
    reps = signed.withColumnRenamed("id", "doc").join(classes.hint("merge"), [*key, "doc", "text_hash"])
    reps = reps.select(F.col("cid").alias("id"), "doc", "text_hash", *key, *_SIG, "bands")
    reps = stage(reps.dropDuplicates(["id"]), "representatives")  # of repeated rows, whose sets are equal
    members = reps.select("id", "n_shingles", F.explode("bands").alias("band"))
    buckets = stage(members.groupBy("band").agg(F.min("id").alias("pivot"), F.count("*").alias("n")).where("n > 1"), "buckets")
    shared = stage(members.join(buckets.hint("merge"), "band"), "shared")

    lanes = reps.select("id", "n_shingles", *_SIG)
    star = shared.where("id <> pivot").select(F.col("pivot").alias("u"), F.col("id").alias("v")).distinct()
    cut = _cut(percent / 100)

    def likely(pairs):
        p = pairs.join(lanes.select(F.col("id").alias("u"), F.struct("n_shingles", *_SIG).alias("x")).hint("merge"), "u")
        p = p.join(lanes.select(F.col("id").alias("v"), F.struct("n_shingles", *_SIG).alias("y")).hint("merge"), "v")
        small, large = F.least("x.n_shingles", "y.n_shingles"), F.greatest("x.n_shingles", "y.n_shingles")
        return p.where((100 * small >= percent * large) & ((small < SMALL) | (_estimate("x", "y") >= cut))).select("u", "v")

    links = stage(_confirmed(stage(likely(star), "likely"), reps, docs, percent), "confirmed")
    found = stage(connected_components(links), "components")

    # Buckets that hold members of several components besides the pivot.
    rest = shared.where("n > 2 AND id <> pivot").join(found.withColumnRenamed("node", "id").hint("merge"), "id", "left")
    rest = stage(rest.select("band", "id", "n_shingles", F.coalesce("component", "id").alias("component")), "labelled")
    open_ = rest.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.sum("n_shingles").alias("size"))
    open_ = stage(open_.where("lo <> hi").select("band", F.ceil(F.col("size") / BLOCK).alias("blocks")), "open")
    rest = rest.join(open_.hint("merge"), "band").withColumn("block", F.expr("pmod(xxhash64(id), blocks)"))
    rest = rest.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
    rest = rest.select("band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "id", "component", "block")
    rest = rest.join(lanes.hint("merge"), "id").groupBy("band", "lo", "hi")
    rest = stage(rest.applyInPandas(_block_task(cut, percent, False), "band long, lo long, hi long, id long, component long, block long"), "rest-likely")
    sets = _shingle_sets(rest.select("id").distinct(), reps, docs)
    rest = rest.join(sets.hint("merge"), "id").join(reps.select("id", "n_shingles", *_SIG, "bands").hint("merge"), "id")
    more = stage(rest.groupBy("band", "lo", "hi").applyInPandas(_block_task(cut, percent, True), "u long, v long"), "rest-confirmed")
    found = stage(connected_components(found.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)), "all-components")

    named = classes.join(found.withColumnRenamed("node", "cid").hint("merge"), "cid", "left")
    named = stage(named.select("k1", "k2", "n_shingles", F.coalesce("component", "cid").alias("component"), "doc"), "named")
    first = named.groupBy("component").agg(F.min("doc").alias("first_id"))
    return named.drop("doc").join(first.hint("merge"), "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75, key_col: str | None = None) -> DataFrame:
    """(id_col, n_shingles, component_id, kept), one row per input row.

    Rows are linked if 100 * intersection >= percent * union of their sets;
    ``component_id`` is the smallest id reachable, ``kept`` tells that it is
    the row's own. The ids must be integers. Null and wordless texts have no
    shingles and are linked with nothing. A row without an id is in no
    component: its ``component_id`` is null and ``kept`` is true. Rows of one
    id are looked at one by one: different texts of an id are linked only if
    they are alike. Other columns of ``docs`` are not read.

    With ``key_col`` two columns follow: that column of the row as ``row_key``,
    and ``component``, a number of the row's component (null where it has none).
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       *([] if key_col is None else [F.col(key_col).alias("row_key")])).withColumn("text_hash", F.xxhash64("text"))
    carried = [f for f in docs.schema if f.name != "text"]
    shape = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in carried) + "n_shingles long, k1 long, k2 long, "
    shape += "".join(f"{c} long, " for c in _SIG) + "bands array<long>"
    signed = stage(docs.mapInArrow(_signer([f.name for f in carried]), shape), "signatures")

    named = _components(signed.where("n_shingles > 0 AND id IS NOT NULL"), docs.where("id IS NOT NULL"), percent)
    own = signed.select("id", "n_shingles", "k1", "k2", *([] if key_col is None else ["row_key"]))
    out = own.join(named.hint("merge"), ["k1", "k2", "n_shingles"], "left")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("first_id", "id"))
    more = [] if key_col is None else ["row_key", F.when(F.col("id").isNotNull(), F.col("component")).alias("component")]
    return out.select(F.col("id").alias(id_col), "n_shingles", comp.alias("component_id"),
                      F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"), *more)


#: The same on ``documents``, by a join on all shingles and closure of the links.
SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN sizes s ON s.doc_id = a JOIN sizes t ON t.doc_id = b WHERE 100 * common >= 75 * (s.n + t.n - common)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
named AS (SELECT a AS doc_id, min(b) AS low FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id,
  d.doc_id <= coalesce(low, d.doc_id) AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id
"""

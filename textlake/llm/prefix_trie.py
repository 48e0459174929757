"""Conversation prefix trie by splitter-skeleton.

1. Turns are sorted by (conversation, turn) over range partitions and numbered;
   a conversation may cross partitions, whose totals (one row each) carry on. A
   prefix has a 128-bit hash that is a running sum, so a rebuilt conversation's
   prefixes follow from those of its two sources by a shift.
2. A node is (depth, prefix hash); its name is its smallest member. Nodes of one
   member are the ends of paths and need no more than the path's lengths. The
   others name the nodes of each path; equal paths are counted together.
3. The distinct paths are sorted over range partitions (shards). The trie of the
   paths at the shard borders is the skeleton: only its nodes can have members in
   two shards. It is broadcast; every shard finishes all other nodes with a stack,
   and gives a part of each of its skeleton nodes, which a last aggregate adds up.

Broadcast and driver hold two paths a shard. A path, as far as other
conversations share it, is one array; the turns of a conversation never are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import stage

#: A conversation takes its first turns, HEADS - 1 at most, from the first of its family of FAMILY ids.
FAMILY, HEADS = 5, 9
#: Ids of 2**ID_BITS neighbours are written as one text before they are hashed.
ID_BITS = 8
#: Tail nodes generated by one row.
RUN = 4096
U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
NO_ENDS = hashlib.sha256(b"").hexdigest()
NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def power(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponent modulo 2**64; a negative exponent means the inverse."""
    out = np.ones(len(exponents), U)
    for sign, step in ((1, base), (-1, pow(base, -1, 1 << 64))):
        left = np.maximum(exponents * sign, 0)
        while left.any():
            out = np.where(left & 1, out * U(step), out)
            step, left = step * step % (1 << 64), left >> 1
    return out


def borrowed(conv: Column) -> Column:
    """How many first turns conversation ``conv`` takes from the first of its family."""
    return F.crc32(conv.cast("string").cast("binary")) % HEADS


def _turns(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(c, turn, digest, bytes, tie) of every row that has a conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), F.sha2(both.cast("binary"), 256).alias("digest"),
                                F.octet_length(text).cast("long").alias("bytes")).where("c IS NOT NULL")
    return rows.withColumn("digest", F.unhex("digest")).withColumn("tie", F.monotonically_increasing_id())


SEQUENCE = "c long, part int, pos long, ha long, hb long, bytes long, last boolean"


def _number(batches):
    """Position and prefix hash of sorted turns within this partition; the partition's last row is marked."""
    part, held, before, carry = TaskContext.get().partitionId(), None, None, (0, U(0), U(0))
    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield held
        c = batch.column(0).to_numpy(zero_copy_only=False)
        digest = np.frombuffer(b"".join(x[:16] for x in batch.column(1).to_pylist()), "<u8").reshape(-1, 2)
        first = np.r_[c[0] != before, c[1:] != c[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(len(c)), 0))
        goes_on = start == 0 if not first[0] else np.zeros(len(c), bool)
        pos = np.arange(len(c)) - start + np.where(goes_on, carry[0], 0)
        hashes = []
        for lane, base in enumerate(BASES):
            term = digest[:, lane] * power(base, pos + 1)
            total = np.cumsum(term, dtype=U)
            hashes.append(total - (total - term)[start] + np.where(goes_on, carry[1 + lane], U(0)))
        before, carry = c[-1], (int(pos[-1]) + 1, hashes[0][-1], hashes[1][-1])
        held = pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(c), part, np.int32)), pa.array(pos.astype(np.int64)), *(pa.array(h.view(np.int64)) for h in hashes),
                                           batch.column(2), pa.array(np.zeros(len(c), bool))], names=["c", "part", "pos", "ha", "hb", "bytes", "last"])
    if held is not None:
        marks = np.zeros(held.num_rows, bool)
        marks[-1] = True
        yield held.set_column(6, "last", pa.array(marks))


def _carries(sequence: DataFrame) -> dict[int, tuple[int, int, int, int]]:
    """By partition: the conversation of the partition before, its turns so far and their hash."""
    out, now = {}, None
    for r in sequence.where("last").orderBy("part").select("part", "c", "pos", "ha", "hb").collect():  # a row a partition
        own = (r.c, r.pos + 1, r.ha % (1 << 64), r.hb % (1 << 64))
        if now:
            out[r.part] = now
            if now[0] == r.c:
                own = (r.c, now[1] + own[1], *((h + pow(b, now[1], 1 << 64) * x) % (1 << 64) for h, x, b in zip(now[2:], own[2:], BASES)))
        now = own
    return out


def _settled(sequence: DataFrame) -> DataFrame:
    """(c, pos, ha, hb, bytes) with positions and hashes of whole conversations."""
    sent = sequence.sparkSession.sparkContext.broadcast(_carries(sequence))

    def settle(batches):
        for batch in batches:
            c, part, pos, *hashes = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
            pos, hashes = pos.copy(), [h.view(U).copy() for h in hashes]
            for p in np.unique(part):
                if int(p) in sent.value:
                    conv, turns, *before = sent.value[int(p)]
                    on = np.flatnonzero((part == p) & (c == conv))
                    pos[on] += turns
                    for h, x, base in zip(hashes, before, BASES):
                        h[on] = U(x) + h[on] * U(pow(base, turns, 1 << 64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pos), *(pa.array(h.view(np.int64)) for h in hashes), batch.column(5)], names=["c", "pos", "ha", "hb", "bytes"])

    return sequence.mapInArrow(settle, "c long, pos long, ha long, hb long, bytes long")


def _conversations(turns: DataFrame) -> DataFrame:
    """One row for each conversation: h, k (turns really borrowed), length when
    rebuilt, the borrowed turns, and the prefix hashes that end where the own ones begin."""
    few = F.when(F.col("pos") < HEADS - 1, F.struct("pos", "ha", "hb", "bytes"))
    own = turns.groupBy("c").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(few)).alias("own"))  # HEADS - 1 turns at most
    lead = own.where(F.col("c") % FAMILY == 0).select(F.col("c").alias("family"), F.col("own").alias("lead"), F.col("n").alias("n_lead"))
    rows = own.withColumn("family", F.col("c") - F.col("c") % FAMILY).join(lead, "family", "left").withColumn("h", borrowed(F.col("c")))
    rows = rows.withColumn("k", F.least("h", F.coalesce("n_lead", F.lit(0)))).withColumn("length", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    at = lambda turn, lane: F.coalesce(turn[lane], F.lit(0))
    left, gone = F.get("lead", (F.col("k") - 1).cast("int")), F.get("own", (F.col("h") - 1).cast("int"))
    return rows.select("c", "h", "k", "length", F.slice(F.coalesce("lead", F.array().cast("array<struct<pos:bigint,ha:bigint,hb:bigint,bytes:bigint>>")), F.lit(1), F.col("k").cast("int")).alias("taken"),
                       at(left, "ha").alias("la"), at(left, "hb").alias("lb"), at(gone, "ha").alias("ga"), at(gone, "hb").alias("gb"))


def _rebuilt(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(c, d, ha, hb, bytes): every prefix but the empty one of every rebuilt conversation."""
    taken = convs.select("c", F.explode("taken").alias("t")).select("c", (F.col("t.pos") + 1).alias("d"), "t.ha", "t.hb", "t.bytes")
    own = turns.where(F.col("pos") >= borrowed(F.col("c"))).join(convs.drop("taken", "length"), "c")

    def shift(batches):
        for batch in batches:
            pos, h, k = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 5, 6))
            lanes = [batch.column(i).to_numpy(zero_copy_only=False).view(U) for i in (2, 3, 7, 8, 9, 10)]
            out = [left + (now - gone) * power(base, k - h) for base, now, left, gone in zip(BASES, lanes[:2], lanes[2:4], lanes[4:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((k + pos - h + 1).astype(np.int64)), *(pa.array(x.view(np.int64)) for x in out), batch.column(4)], names=["c", "d", "ha", "hb", "bytes"])

    own = own.select("c", "pos", "ha", "hb", "bytes", "h", "k", "la", "lb", "ga", "gb").mapInArrow(shift, "c long, d long, ha long, hb long, bytes long")
    return taken.unionByName(own)


def _common(a: list, b: list) -> int:
    """Length of the common start of two paths."""
    n = 0
    while n < len(a) and n < len(b) and a[n][0] == b[n][0]:
        n += 1
    return n


def skeleton(borders: list[tuple[int, list, list]]) -> dict[tuple[int, int], int]:
    """(node, depth) -> its first shard, for the nodes with members in several
    shards: the starts that the last path of a shard and the first of the next
    share. ``borders``: (shard, first path, last path) in order."""
    out: dict[tuple[int, int], int] = {}
    for (before, _, last), (_, first, _) in zip(borders, borders[1:]):
        for d in range(_common(last, first)):
            out.setdefault((first[d][0], d + 1), before)
    return out


PARTIAL = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, split boolean"


class Shard:
    """The open nodes of the path at hand, root first, while a shard's paths come in order."""

    def __init__(self, shard: int, shared: dict, root: int):
        self.shard, self.shared, self.out = shard, shared, []
        self.nodes = [[root, 0, 0, 0, 0, 0]]  # name, bytes, members, children, leaves, saved

    def add(self, path: list[tuple[int, int]], members: int, tails: int) -> None:
        """A path, its conversations, and how many of them go on alone."""
        nodes, same = self.nodes, 0
        while same < len(path) and same + 1 < len(nodes) and nodes[same + 1][0] == path[same][0]:
            same += 1
        self.close(same)
        nodes += [[name, size, 0, 0, 0, 0] for name, size in path[same:]]
        end = nodes[-1]
        end[2] += members
        end[3] += tails
        end[4] += tails

    def close(self, depth: int) -> None:
        """Finish the open nodes below ``depth``."""
        while len(self.nodes) > depth + 1:
            name, size, members, children, leaves, saved = self.nodes.pop()
            at, up = len(self.nodes), self.nodes[-1]
            first = self.shared.get((name, at))  # of a split node, only the first shard counts the node itself
            owner = first is None or first == self.shard
            leaves += first is None and not children
            saved += members * size - (size if owner else 0)
            self.out.append((name, at, up[0], members, children, leaves, saved, first is not None))
            up[2] += members
            up[3] += owner
            up[4] += leaves
            up[5] += saved

    def finish(self) -> None:
        self.close(0)
        name, _, members, children, leaves, saved = self.nodes[0]
        self.out.append((name, 0, None, members, children, leaves, saved, True))


def _shards(paths: DataFrame, root: int) -> DataFrame:
    """Nodes of several members, and the root, from distinct paths (path, members, tails)."""
    ranged = paths.repartitionByRange("path").withColumn("shard", F.spark_partition_id())
    ranged = stage(ranged, "path-shards")
    borders = [(r.shard, r.first, r.last) for r in ranged.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last")).orderBy("shard").collect()]
    sent = ranged.sparkSession.sparkContext.broadcast(skeleton(borders))

    def walk(batches):
        now = None
        for batch in batches:
            for shard, path, members, tails in zip(*(col.to_pylist() for col in batch.columns)):
                if now is None or now.shard != shard:
                    if now is not None:
                        now.finish()
                        yield _partial(now.out)
                    now = Shard(shard, sent.value, root)
                now.add([(p["lo"], p["bytes"]) for p in path], members, tails)
                if len(now.out) >= 20_000:
                    yield _partial(now.out)
                    now.out = []
        if now is not None:
            now.finish()
            yield _partial(now.out)

    found = stage(ranged.select("shard", "path", "members", "tails").repartition("shard").sortWithinPartitions("shard", "path").mapInArrow(walk, PARTIAL), "shard-nodes")
    counts = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    split = found.where("split").groupBy("conv_id", "depth", "parent_conv_id").agg(*counts)
    alone = F.when((F.col("depth") == 0) & (F.col("n_children") == 0), 1).otherwise(F.col("n_leaves"))
    return found.where("NOT split").drop("split").unionByName(split.withColumn("n_leaves", alone))


def _partial(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 7 + [pa.bool_()]
    names = [x.split()[0] for x in PARTIAL.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)


def _ends(paths: DataFrame, root: int) -> DataFrame:
    """(conv_id, depth, ends_sha256) of the nodes at which conversations end. Ids
    become texts of up to 2**ID_BITS ids, which are hashed in order, a batch at a time."""
    k = F.size("path")
    ended = paths.where(F.col("length") == k).select(F.coalesce(F.get("path", k - 1)["lo"], F.lit(root)).alias("conv_id"), k.cast("long").alias("depth"), "c")
    chunks = ended.groupBy("conv_id", "depth", F.shiftright("c", ID_BITS).alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(batches):
        now, state = None, None
        for batch in batches:
            out = []
            for conv, depth, _, ids in zip(*(col.to_pylist() for col in batch.columns)):
                if now != (conv, depth):
                    if now is not None:
                        out.append((*now, state.hexdigest()))
                    now, state = (conv, depth), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _digests(out)
        if now is not None:
            yield _digests([(*now, state.hexdigest())])

    return chunks.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "block").mapInArrow(digest, "conv_id long, depth long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    conv, depth, ends = zip(*rows) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(depth, pa.int64()), pa.array(ends, pa.string())], names=["conv_id", "depth", "ends_sha256"])


def _tails(paths: DataFrame, root: int) -> DataFrame:
    """The nodes of one member: conversation ``c`` beyond its shared path."""
    k = F.size("path").cast("long")
    rows = paths.where(F.col("length") > k).select("c", "length", k.alias("k"), F.coalesce(F.get("path", F.size("path") - 1)["lo"], F.lit(root)).alias("above"))
    rows = rows.withColumn("run", F.explode(F.expr(f"sequence(0L, (length - k - 1) div {RUN})"))).repartition("c", "run")
    rows = rows.withColumn("depth", F.explode(F.expr(f"sequence(k + 1 + run * {RUN}, least(length, k + (run + 1) * {RUN}))")))
    last = F.col("depth") == F.col("length")
    return rows.select(F.col("c").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("k") + 1, F.col("above")).otherwise(F.col("c")).alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"),
                       F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
                       F.when(last, F.sha2(F.col("c").cast("string").cast("binary"), 256)).otherwise(NO_ENDS).alias("ends_sha256"))


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """NODE columns of every node of the trie of rebuilt conversations.

    A conversation's turns are ordered by turn, null first; turns of equal number
    by the SHA-256 of role and text, and repeated rows are turns of their own. Null
    role or text is empty. Conversation c takes its first h turns (``borrowed``)
    from conversation c - c % FAMILY (the remainder of SQL, of the sign of c), and
    drops its own first h. Rows without a conversation id take no part; without
    any other row there are no nodes. Other columns are not looked at.
    """
    turns = stage(_turns(conversations, conv_col, turn_col, role_col, text_col), "turns")
    order = ["c", "turn", "digest", "tie"]
    sequence = stage(turns.repartitionByRange(*order).sortWithinPartitions(*order).select("c", "digest", "bytes").mapInArrow(_number, SEQUENCE), "turn-order")
    turns = _settled(sequence)
    convs = stage(_conversations(turns), "rebuilt-conversations")
    root = convs.agg(F.min("c")).first()[0]
    if root is None:
        return convs.sparkSession.createDataFrame([], ", ".join(f"{c} {'string' if c == NODE[-1] else 'long'}" for c in NODE))
    prefixes = stage(_rebuilt(turns, convs), "prefixes")
    key = ["d", "ha", "hb"]
    nodes = stage(prefixes.groupBy(*key).agg(F.count("*").alias("n"), F.min("c").alias("lo")).where("n > 1").drop("n"), "shared-prefixes")
    named = stage(prefixes.join(nodes, key).select("c", "d", "lo", "bytes"), "named-prefixes")
    path = F.transform(F.array_sort(F.collect_list(F.struct("d", "lo", "bytes"))), lambda t: F.struct(t["lo"].alias("lo"), t["bytes"].alias("bytes")))
    paths = convs.select("c", "length").join(named.groupBy("c").agg(path.alias("path")), "c", "left")
    paths = stage(paths.withColumn("path", F.coalesce("path", F.array().cast("array<struct<lo:bigint,bytes:bigint>>"))), "paths")
    distinct = paths.groupBy("path").agg(F.count("*").alias("members"), F.count_if(F.col("length") > F.size("path")).alias("tails"))
    shared = _shards(stage(distinct, "distinct-paths"), root)
    shared = shared.join(_ends(paths, root), ["conv_id", "depth"], "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    return shared.select(*NODE).unionByName(_tails(paths, root))


#: The same nodes in DuckDB SQL: a prefix is the list of its turns' digests.
SQL = f"""
WITH turns AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS pos, digest, bytes FROM (
    SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS bytes,
           sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
    FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (SELECT c, xor(list_reduce(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, i: xor(v >> 1, 3988292384 * (v & 1))), CAST(4294967295 AS BIGINT)), 4294967295) % {HEADS} AS h
  FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, pos) AS d, digest, bytes FROM (
    SELECT v.c, 0 AS own, t.pos, t.digest, t.bytes FROM convs v JOIN turns t ON t.c = v.c - v.c % {FAMILY} AND t.pos < v.h
    UNION ALL SELECT v.c, 1, t.pos, t.digest, t.bytes FROM convs v JOIN turns t ON t.c = v.c AND t.pos >= v.h)),
members AS MATERIALIZED (SELECT c, d, list(digest) OVER (PARTITION BY c ORDER BY d) AS prefix, bytes FROM rebuilt
    UNION ALL SELECT c, 0, [], 0 FROM convs),
lengths AS (SELECT c, max(d) AS length FROM members GROUP BY c),
nodes AS MATERIALIZED (SELECT prefix, m.d, min(m.c) AS conv_id, count(*) AS n, any_value(bytes) AS bytes,
    sha256(coalesce(string_agg(CAST(m.c AS VARCHAR), ',' ORDER BY m.c) FILTER (WHERE m.d = length), '')) AS ends_sha256
  FROM members m JOIN lengths USING (c) GROUP BY prefix, m.d),
children AS (SELECT prefix[1:d - 1] AS prefix, count(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
above AS (SELECT n.prefix[1:g.i] AS prefix, sum((n.n - 1) * n.bytes) AS saved, count(*) FILTER (WHERE k.n IS NULL) AS leaves
  FROM nodes n LEFT JOIN children k ON k.prefix = n.prefix, LATERAL (SELECT unnest(range(0, n.d + 1)) AS i) g GROUP BY ALL)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(n.n AS BIGINT) AS n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
       CAST(a.leaves AS BIGINT) AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN above a ON a.prefix = n.prefix LEFT JOIN children k ON k.prefix = n.prefix LEFT JOIN nodes p ON n.d > 0 AND p.prefix = n.prefix[1:n.d - 1]
"""

"""Vector code compression: product codes by integer k-means with norm-of-sum bounds.

Vectors become integers and are cut into equal parts; each part position has a
codebook, refined in rounds. All arithmetic is on integers, so results do not
depend on the order of the rows.

Bounds. A row keeps, for each part, its entry, an upper bound of the distance to
it, a lower bound of the distance to every other entry, and the round of each
bound. All codebooks of the past are retained, so a bound of round s is moved to
round t by the true net displacement |C_t - C_s| of the entries, which is no more
than the sum of the drifts of the rounds between. Only where the two bounds meet
is the distance to the own entry taken again, and only where they still meet are
all entries scanned.

A round is one pass that writes the rows with their bounds to the shared folder,
and one aggregate of sums by part and entry; the driver holds codebooks only.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textlake.llm.common import stage

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components are held to this magnitude after scaling, and errors to the largest long.
LIMIT, LONG = 1 << 60, (1 << 63) - 1
#: Rows worked on together.
BLOCK = 2048


def integer_vectors(vectors: DataFrame, vector_col: str, keep: tuple[str, ...]) -> tuple[DataFrame, int]:
    """(k0.., v): floor(SCALE * x) of the vectors that take part, and their
    dimension: not null, without null or non-finite components, of the commonest
    length above 0 (ties: the longer)."""
    rows = vectors.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(keep)), F.col(vector_col).cast("array<double>").alias("v")).where("size(v) > 0")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = sizes["d"] if sizes else 0
    whole = F.transform("v", lambda x: F.floor(F.greatest(F.least(x * SCALE, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))))
    return rows.where(F.size("v") == dim).withColumn("v", whole.cast("array<long>")), dim


def in_parts(values: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as integers by part: (rows, PARTS, width), zeros at the end if PARTS does not divide the dimension."""
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
    width = -(-dim // PARTS)
    if width * PARTS != dim:
        x = np.pad(x, ((0, 0), (0, width * PARTS - dim)))
    return x.reshape(len(x), PARTS, width)


def _fits(width: int, *values: np.ndarray) -> bool:
    """Whether squared distances between these integers are exact in doubles."""
    most = max((int(max(abs(int(v.min())), abs(int(v.max())))) for v in values if v.size), default=0)
    return 4 * width * most * most < 1 << 52


def squared(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows to the entries of a codebook (n, entries)."""
    if _fits(x.shape[1], x, book):
        a, b = x.astype(np.float64), book.astype(np.float64)
        return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]
    gap = x.astype(object)[:, None, :] - book.astype(object)[None, :, :]
    return (gap * gap).sum(axis=2)


def to_own(x: np.ndarray, book: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Exact squared distance of each row to its entry."""
    own = book[code]
    if _fits(x.shape[1], x, book):
        gap = x - own
        return (gap * gap).sum(axis=1)
    gap = x.astype(object) - own.astype(object)
    return (gap * gap).sum(axis=1)


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter(np.sqrt(x.astype(np.float64)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(np.sqrt(x.astype(np.float64)).astype(np.float32), np.float32(-np.inf)), 0)


class History:
    """The codebooks so far, (entries, width) for each round and part, and their net displacements."""

    def __init__(self, books: list[list[np.ndarray]]):
        self.books, now = books, books[-1]
        #: moved[s][part]: distance of each entry between round s and now, rounded up.
        self.moved = [[np.sqrt(((b.astype(np.float64) - a.astype(np.float64)) ** 2).sum(axis=1)) * (1 + 1e-12) for a, b in zip(then, now)] for then in books]
        self.first, self.most, self.second = [], [], []
        for parts in self.moved:
            order = [np.argsort(-m, kind="stable") for m in parts]
            self.first.append(np.array([o[0] for o in order]))
            self.most.append(np.array([m[o[0]] for m, o in zip(parts, order)]))
            self.second.append(np.array([m[o[1]] if len(o) > 1 else 0.0 for m, o in zip(parts, order)]))

    def others(self, part: int, since: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The farthest that any entry but ``code`` has moved since round ``since``."""
        first, most, second = (np.array([x[s][part] for s in range(len(self.books))]) for x in (self.first, self.most, self.second))
        return np.where(first[since] == code, second[since], most[since])

    def own(self, part: int, since: np.ndarray, code: np.ndarray) -> np.ndarray:
        return np.array([self.moved[s][part] for s in range(len(self.books))])[since, code]


def assign(x: np.ndarray, state: np.ndarray | None, history: History) -> tuple[np.ndarray, int, int]:
    """State of rows (n, parts, width) after assigning them to the newest
    codebooks, and how many parts were measured again and scanned. A state row
    holds per part: entry, rounds of the upper and the lower bound, the bounds."""
    now = len(history.books) - 1
    out = np.zeros((len(x), PARTS), STATE) if state is None else state.copy()
    measured = scanned = 0
    for p in range(PARTS):
        book, s = history.books[-1][p], out[:, p]
        if state is None:
            todo = np.arange(len(x))
        else:
            lower = s["low"] - history.others(p, s["low_at"], s["code"])
            upper = s["up"] + history.own(p, s["up_at"], s["code"])
            todo = np.flatnonzero(upper * (1 + 1e-6) >= lower)
            measured += len(todo)
            if len(todo):
                s["up"][todo], s["up_at"][todo] = _up(to_own(x[todo, p], book, s["code"][todo])), now
                todo = todo[s["up"][todo] * (1 + 1e-6) >= lower[todo]]
        scanned += len(todo)
        for at in range(0, len(todo), BLOCK):
            rows = todo[at:at + BLOCK]
            far = squared(x[rows, p], book)
            code = far.argmin(axis=1)  # the first of equals
            near = far[np.arange(len(rows)), code]
            s["code"][rows], s["up"][rows], s["up_at"][rows], s["low_at"][rows] = code, _up(near), now, now
            if len(book) > 1:
                far[np.arange(len(rows)), code] = np.inf if far.dtype != object else 1 << 200
                s["low"][rows] = _down(far.min(axis=1))
            else:
                s["low"][rows] = np.inf
        out[:, p] = s
    return out, measured, scanned


STATE = np.dtype([("code", "u1"), ("up_at", "u1"), ("low_at", "u1"), ("up", "<f4"), ("low", "<f4")])


def _sums(rows: DataFrame, dim: int, books: list[np.ndarray]) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) -> (rows, sums of the components): at most PARTS * ENTRIES rows of a task and of the driver."""
    width = -(-dim // PARTS)

    def partial(batches):
        count = np.zeros((PARTS, max(map(len, books))), np.int64)
        total = np.zeros((*count.shape, width), object)
        for batch in batches:
            x, code = in_parts(batch.column(0), dim), _states(batch.column(1))["code"]
            small = _fits(width, x) and len(x) < 1 << 20
            for p in range(PARTS):
                count[p] += np.bincount(code[:, p], minlength=count.shape[1])
                for w in range(width):
                    if small:
                        total[p, :, w] += np.bincount(code[:, p], weights=x[:, p, w].astype(np.float64), minlength=count.shape[1]).astype(np.int64)
                    else:
                        np.add.at(total[p, :, w], code[:, p], x[:, p, w].astype(object))
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]),
                                          pa.array([[Decimal(int(t)) for t in total[i, j]] for i, j in zip(p, e)], pa.list_(pa.decimal128(38)))], names=["part", "entry", "n", "total"])

    parts = rows.select("v", "state").mapInArrow(partial, "part int, entry int, n long, total array<decimal(38,0)>")
    sums = parts.select("part", "entry", "n", F.posexplode("total").alias("w", "t")).groupBy("part", "entry", "w").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    out: dict = {}
    for r in sums.collect():
        out.setdefault((r.part, r.entry), (r.n, [0] * width))[1][r.w] = int(r.t)
    return out


def _states(col: pa.Array) -> np.ndarray:
    """State records of a binary column, (rows, PARTS)."""
    return np.frombuffer(b"".join(col.to_pylist()), STATE).reshape(-1, PARTS)


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", keep: tuple[str, ...] = ()) -> tuple[DataFrame, list[list[list[int]]]]:
    """(id_col, keep columns, code array<int>, error long) of every vector that
    takes part (see ``integer_vectors``), and the final codebooks by part and entry.

    A codebook starts as that part of the ENTRIES smallest ids (ties of repeated
    ids: the smaller vector; null ids come last; fewer rows give fewer entries). In
    ROUNDS rounds every part goes to its nearest entry, ties to the lower index,
    and an entry becomes the floor of its parts' mean; an entry without parts
    stays. Then parts are assigned once more. ``error`` is the sum of the squared
    distances over the parts. Components beyond 2**60 after scaling count as 2**60,
    errors beyond the largest long as that. An empty table gives no rows and
    empty codebooks.
    """
    names = (id_col, *keep)
    rows, dim = integer_vectors(vectors, vector_col, names)
    kept = rows.schema.fields[:-1]
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept)
    if not dim:
        return rows.select(*(f.name for f in kept), F.lit(None).cast("array<int>"), F.lit(None).cast("long")).where("false").toDF(*names, "code", "error"), [[] for _ in range(PARTS)]
    rows = stage(rows, "integer-vectors")
    first = rows.orderBy(F.col("k0").asc_nulls_last(), "v").select("v").limit(ENTRIES).toArrow()
    start = in_parts(first.column(0).combine_chunks(), dim)
    books = [[start[:, p] for p in range(PARTS)]]
    spark, n_kept = rows.sparkSession, len(kept)

    def assigning(sent, known: bool):
        def run(batches):
            history = sent.value
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(at, BLOCK)
                    old = _states(part.column(n_kept + 1)) if known else None
                    state = assign(in_parts(part.column(n_kept), dim), old, history)[0]
                    packed = pa.array([r.tobytes() for r in state], pa.binary())
                    yield pa.RecordBatch.from_arrays([*part.columns[:n_kept + 1], packed], names=[*part.schema.names[:n_kept + 1], "state"])
        return run

    for turn in range(ROUNDS + 1):
        sent = spark.sparkContext.broadcast(History(books))
        rows = stage(rows.mapInArrow(assigning(sent, turn > 0), f"{ddl}, v array<long>, state binary"), f"codes-{turn}")
        if turn == ROUNDS:
            break
        found, last = _sums(rows, dim, [b for b in books[-1]]), books[-1]
        books.append([np.array([[t // found[p, e][0] for t in found[p, e][1]] if (p, e) in found else list(map(int, last[p][e])) for e in range(len(last[p]))], np.int64).reshape(last[p].shape)
                      for p in range(PARTS)])
    final = spark.sparkContext.broadcast(books[-1])

    def measure(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x, code = in_parts(part.column(n_kept), dim), _states(part.column(n_kept + 1))["code"]
                error = sum(to_own(x[:, p], final.value[p], code[:, p]).astype(object) for p in range(PARTS))
                yield pa.RecordBatch.from_arrays([*part.columns[:n_kept], pa.array(code.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array([min(int(e), LONG) for e in error], pa.int64())],
                                                 names=[*part.schema.names[:n_kept], "code", "error"])

    out = rows.mapInArrow(measure, f"{ddl}, code array<int>, error long").toDF(*names, "code", "error")
    return out, [b.tolist() for b in books[-1]]


def _sql(rounds: int = ROUNDS) -> str:
    """The same codes in DuckDB SQL, all distances computed: integers as HUGEINT."""
    steps = []
    for t in range(rounds + 1):
        steps.append(f"""
dist{t} AS MATERIALIZED (SELECT r, p.part, b.entry,
    list_sum(list_transform(list_zip(p.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM parts p JOIN book{t} b ON p.part = b.part),
code{t} AS MATERIALIZED (SELECT r, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM dist{t} GROUP BY r, part)""")
        if t < rounds:
            steps.append(f"""
mean{t} AS (SELECT part, entry, list(m ORDER BY w) AS x FROM (
    SELECT c.part, c.entry, w, CAST(floor_div AS HUGEINT) AS m FROM (
      SELECT c.part, c.entry, w, count(*) AS n, sum(p.x[w]) AS s,
             (sum(p.x[w]) - ((sum(p.x[w]) % count(*)) + count(*)) % count(*)) // count(*) AS floor_div
      FROM code{t} c JOIN parts p ON c.r = p.r AND c.part = p.part, range(1, 5) AS g(w) GROUP BY c.part, c.entry, w) c) GROUP BY part, entry),
book{t + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM book{t} b LEFT JOIN mean{t} m ON b.part = m.part AND b.entry = m.entry)""")
    return f"""
WITH kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS r, vec_id, label,
    list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS HUGEINT)) AS v
  FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT r, part, v[part * 4 + 1 : part * 4 + 4] AS x FROM kept, range({PARTS}) AS g(part)),
book0 AS MATERIALIZED (SELECT part, CAST(r AS BIGINT) AS entry, x FROM parts WHERE r < {ENTRIES}),{",".join(steps)},
sums AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM code{rounds} GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM sums JOIN kept USING (r), books
"""


#: For the given table, whose vectors have 64 components.
SQL = _sql()

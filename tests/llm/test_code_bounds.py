"""Product codes by bounded integer k-means against a plain version that measures everything."""

import math
import random

import numpy as np
import pytest

from textlake.llm import code_bounds as C

SCHEMA = "vec_id long, embedding array<double>, label int, code string, error int, v int, k0 int, state int"


def plain(rows, dim):
    """code and error of each row, and the codebooks, by Python integers."""
    rows = sorted((r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1]) and len(r[1]) == dim),
                  key=lambda r: (r[0] is None, r[0] or 0, [math.floor(x * C.SCALE) for x in r[1]]))
    width = -(-dim // C.PARTS)
    cut = [[[max(-C.LIMIT, min(C.LIMIT, math.floor(x * C.SCALE))) for x in r[1]] + [0] * (width * C.PARTS - dim) for r in rows]]
    parts = [[v[p * width:(p + 1) * width] for p in range(C.PARTS)] for v in cut[0]]
    books = [[v[p] for v in parts[:C.ENTRIES]] for p in range(C.PARTS)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(C.ROUNDS):
        fresh = []
        for p in range(C.PARTS):
            own = [[] for _ in books[p]]
            for v in parts:
                own[nearest(p, v[p])[1]].append(v[p])
            fresh.append([[sum(c) // len(o) for c in zip(*o)] if o else e for o, e in zip(own, books[p])])
        books = fresh
    found = [[nearest(p, v[p]) for p in range(C.PARTS)] for v in parts]
    return sorted(((r[0] is None, r[0] or 0, [i for _, i in f], min(sum(d for d, _ in f), C.LONG)) for r, f in zip(rows, found))), books


def table(spark, rows):
    return spark.createDataFrame([(*r, "other", 1, 1, 1, 1) for r in rows], SCHEMA)


def compared(spark, rows, dim):
    out, books = C.compress(table(spark, rows), keep=("label",))
    assert out.columns == ["vec_id", "label", "code", "error"]
    got = sorted((r.vec_id is None, r.vec_id or 0, list(r.code), r.error) for r in out.collect())
    want, want_books = plain(rows, dim)
    assert got == want and books == want_books


def vectors(n, dim, seed, spread=0.2, step=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, spread, (n, dim)) + rng.integers(-2, 3, (n, 1))
    return [(int(i) - n // 2, [float(c) for c in (np.round(v / step) * step if step else v)], int(i) % 3 or None) for i, v in enumerate(x)]


@pytest.mark.parametrize("n,dim,step", [(700, 32, None), (500, 64, 0.25), (90, 20, None), (40, 16, None), (1, 7, None)])
def test_equals_plain(spark, n, dim, step):
    """Also with many ties, dimensions that 16 does not divide, and fewer rows than entries."""
    compared(spark, vectors(n, dim, n, step=step), dim)


def test_awkward_rows(spark):
    rows = vectors(80, 32, 5, step=0.5)
    rows += [(None, rows[0][1], 1), (None, rows[3][1], None), rows[7], rows[7], (7, rows[9][1], None)]
    rows += [(900, None, 1), (901, [], 1), (902, [1.0] * 31 + [None], 1), (903, [math.nan] * 32, 1), (904, [math.inf] * 32, None), (905, [0.5] * 31, 1), (906, [0.0] * 32, 1), (907, [-0.0] * 32, 1)]
    random.Random(2).shuffle(rows)
    compared(spark, rows, 32)


def test_huge_components_stay_exact(spark):
    rows = [(i, [x * 1e9 for x in v], k) for i, v, k in vectors(70, 16, 8)]
    compared(spark, rows, 16)
    rows[3] = (rows[3][0], [1e300, -1e300] * 8, None)
    compared(spark, rows, 16)


def test_no_rows(spark):
    out, books = C.compress(table(spark, []), keep=("label",))
    assert out.collect() == [] and books == [[] for _ in range(C.PARTS)]
    out, _ = C.compress(table(spark, [(1, None, 1), (2, [], None)]))
    assert out.collect() == [] and out.columns == ["vec_id", "code", "error"]


def test_bounds_hold_and_save_scans():
    """Every bound of every round holds for the true distances, the net
    displacement is within the sum of drifts, and most parts are not scanned again."""
    rng = np.random.default_rng(4)
    centers = rng.integers(-4000, 4000, (C.ENTRIES, 4))
    x = (centers[rng.integers(0, C.ENTRIES, (3000, C.PARTS))] + rng.integers(-60, 60, (3000, C.PARTS, 4))).astype(np.int64)
    books = [[x[:C.ENTRIES, p].copy() for p in range(C.PARTS)]]
    state, scanned = None, []
    for turn in range(6):
        history = C.History(books)
        state, _, n = C.assign(x, state, history)
        scanned.append(n)
        for p in range(C.PARTS):
            far = C.squared(x[:, p], books[-1][p])
            code = state["code"][:, p]
            assert (far.argmin(axis=1) == code).all()
            near = np.sqrt(far[np.arange(len(x)), code])
            far[np.arange(len(x)), code] = np.inf
            assert (state["up"][:, p] + history.own(p, state["up_at"][:, p], code) >= near).all()
            assert (state["low"][:, p] - history.others(p, state["low_at"][:, p], code) <= np.sqrt(far.min(axis=1))).all()
            drifts = sum(np.sqrt(((b[p] - a[p]) ** 2).sum(axis=1)) for a, b in zip(books, books[1:])) if turn else np.zeros(C.ENTRIES)
            assert (history.moved[0][p] <= drifts * (1 + 1e-9) + 1e-9).all()
        books.append([np.array([x[state["code"][:, p] == e, p].sum(axis=0) // max(1, (state["code"][:, p] == e).sum()) if (state["code"][:, p] == e).any() else books[-1][p][e] for e in range(C.ENTRIES)])
                      for p in range(C.PARTS)])
    assert scanned[0] == 3000 * C.PARTS and scanned[-1] < scanned[0] / 4

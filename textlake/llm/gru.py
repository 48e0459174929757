"""A gated recurrent unit with a class-factored softmax, in numpy.

Input ids go straight to the three gates (one row of 3 * HIDDEN per id); the
next id is predicted as its class, then as itself within the class. Ids are in
order of falling frequency and a class is WIDTH consecutive ids.
"""

from __future__ import annotations

import numpy as np

HIDDEN, WIDTH = 24, 48
#: Weights that are updated, and states whose next ids are scored, at a time, so that they stay in the cache.
BLOCK, STATES = 1 << 14, 1 << 12
f4 = np.float32


def init(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Small random weights; the biases give the ids' frequencies."""
    n = len(counts)
    classes = -(-n // WIDTH)
    rng = np.random.default_rng(11)
    full = np.zeros(classes * WIDTH)
    full[:n] = counts + 0.5
    full = full.reshape(classes, WIDTH)
    with np.errstate(divide="ignore"):
        inner = np.where(full > 0, np.log(full) - np.log(full.sum(axis=1, keepdims=True)), -1e9)
    return {
        "x": (rng.standard_normal((n, 3 * HIDDEN)) * 0.1).astype(f4),
        "u": (rng.standard_normal((HIDDEN, 3 * HIDDEN)) / HIDDEN ** 0.5).astype(f4),
        "b": np.zeros(3 * HIDDEN, f4),
        "c": (rng.standard_normal((HIDDEN, classes)) * 0.05).astype(f4),
        "cb": np.log(full.sum(axis=1) / full.sum()).astype(f4),
        "w": (rng.standard_normal((classes, HIDDEN, WIDTH)) * 0.05).astype(f4),
        "wb": inner.astype(f4),
    }


def cell(p: dict, h: np.ndarray, x: np.ndarray):
    """One step from state ``h`` with gate inputs ``x``: the new state and what backpropagation needs."""
    a = h @ p["u"][:, :2 * HIDDEN]
    a += x[:, :2 * HIDDEN]
    gates = np.tanh(a * f4(0.5))
    gates *= f4(0.5)
    gates += f4(0.5)
    z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
    v = h @ p["u"][:, 2 * HIDDEN:]
    new = np.tanh(x[:, 2 * HIDDEN:] + r * v)
    return new + z * (h - new), (z, r, v, new)


def _halved(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """What ``_advance`` takes: u, a row a unit of the gates, and the gate inputs of
    each id. Those of the two logistic gates are halved, which is exact."""
    u, table = p["u"].T.copy(), p["x"] + p["b"]
    u[:2 * HIDDEN] *= f4(0.5)
    table[:, :2 * HIDDEN] *= f4(0.5)
    return u, table


def _advance(u: np.ndarray, x: np.ndarray, h: np.ndarray, a: np.ndarray, new: np.ndarray, out: np.ndarray) -> None:
    """``cell`` with a row a unit, so that every gate is one block: fills ``a`` (z, r, v), ``new`` and the state ``out``."""
    np.matmul(u, h, out=a)
    g = a[:2 * HIDDEN]
    g += x[:2 * HIDDEN]
    np.tanh(g, out=g)
    g *= f4(0.5)
    g += f4(0.5)
    np.multiply(a[HIDDEN:2 * HIDDEN], a[2 * HIDDEN:], out=new)
    new += x[2 * HIDDEN:]
    np.tanh(new, out=new)
    np.subtract(h, new, out=out)
    out *= a[:HIDDEN]
    out += new


def _order(ids: np.ndarray, most: int) -> np.ndarray:
    """Stable order of ids of at most ``most``; short integers are sorted by their digits."""
    return np.argsort(ids.astype(np.int16 if most < 1 << 15 else np.int64), kind="stable")


def _by_class(p: dict, ids: np.ndarray):
    """Order of the ids by class, their classes in that order, and (class, from, to) of each class that occurs."""
    k = ids // WIDTH
    order = _order(k, len(p["cb"]))
    k = k[order]
    edge = np.searchsorted(k, np.arange(len(p["cb"]) + 1)).tolist()
    return order, k, [(c, i, j) for c, (i, j) in enumerate(zip(edge, edge[1:])) if i < j]


def _exp(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What is taken off the rows of ``a``, which becomes exp(a - that) in place, and the sums of its rows."""
    top = a.max(initial=-np.inf, keepdims=True)
    # One maximum for all rows, unless a row may lie so far below it that its sum is lost.
    if (a[:, 0] < top[0] - f4(40)).any():
        top = a.max(axis=1, keepdims=True)
    a -= top
    np.exp(a, out=a)
    return top[:, 0], a @ np.ones(a.shape[1], a.dtype)


def _with_one(hs: np.ndarray) -> np.ndarray:
    """States with a last unit of one, which carries the biases."""
    out = np.ones((len(hs), HIDDEN + 1), hs.dtype)
    out[:, :HIDDEN] = hs
    return out


def _outputs(p: dict) -> tuple[np.ndarray, np.ndarray]:
    """Weights of the classes, and of the ids within each, with their biases as a last row."""
    return np.concatenate((p["c"], p["cb"][None])), np.concatenate((p["w"], p["wb"][:, None]), axis=1)


def _inner(w: np.ndarray, hs: np.ndarray, parts: list, a: np.ndarray) -> np.ndarray:
    """Scores (in ``a``) of the ids within the class of each state; the states come by class."""
    for c, i, j in parts:
        np.dot(hs[i:j], w[c], out=a[i:j])
    return a


def log_prob(p: dict, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Natural log-probability of each next id after each state."""
    weights, out = _outputs(p), np.empty(len(ids), h.dtype)
    for i in range(0, len(ids), STATES):
        out[i:i + STATES] = _log_prob(p, weights, _with_one(h[i:i + STATES]), ids[i:i + STATES])
    return out


def _log_prob(p: dict, weights: tuple, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
    order, k, parts = _by_class(p, ids)
    (c, w), h, row, out = weights, h[order], np.arange(len(ids)), np.empty(len(ids), h.dtype)
    a = h @ c
    own = a.ravel()[row * len(p["cb"]) + k]
    top, total = _exp(a)
    got = own - top - np.log(total)
    a = _inner(w, h, parts, np.empty((len(h), WIDTH), h.dtype))
    own = a.ravel()[row * WIDTH + ids[order] - k * WIDTH]
    top, total = _exp(a)
    out[order] = got + own - top - np.log(total)
    return out


class Trainer:
    """Truncated backpropagation through time with Adam steps."""

    def __init__(self, params: dict[str, np.ndarray], rate: float = 0.01):
        self.p = {k: v.copy() for k, v in params.items()}
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}
        self.rate, self.t, self.kept = rate, 0, {}

    def _room(self, name: str, *shape: int) -> np.ndarray:
        """An array of any content, the same memory for every window."""
        size = int(np.prod(shape))
        if name not in self.kept or self.kept[name].size < size:
            self.kept[name] = np.empty(size, f4)
        return self.kept[name][:size].reshape(shape)

    def window(self, h: np.ndarray, before: np.ndarray, after: np.ndarray, live: np.ndarray, start: int) -> np.ndarray:
        """One update from a window: ``before`` and ``after`` are (steps, rows)
        of ids, ``live`` masks padding, a state is zero before ``start`` is read.
        Returns the last state, to carry on."""
        p, n, rows = self.p, len(before), before.shape[1]
        # Within a window states and gates lie as (step, unit, row), so that every gate is one block.
        u, table = _halved(p)
        xs, room = self._room("xs", n, 3 * HIDDEN, rows), self._room
        xs[:] = table[before].transpose(0, 2, 1)
        keep = (before != start).astype(f4)
        prev, hs, new = (room(k, n, HIDDEN, rows) for k in ("prev", "hs", "new"))
        gates, state = room("gates", n, 3 * HIDDEN, rows), np.ascontiguousarray(h.T, f4)
        for h, x, on, a, m, out in zip(prev, xs, keep, gates, new, hs):
            np.multiply(state, on, out=h)
            _advance(u, x, h, a, m, out)
            state = out
        flat = room("states", n * rows, HIDDEN + 1)
        flat[:, HIDDEN] = 1
        flat[:, :HIDDEN].reshape(n, rows, HIDDEN)[:] = hs.transpose(0, 2, 1)
        g, back = self._outputs(flat, after.ravel(), live.ravel())
        dh = room("dh", n, HIDDEN, rows)
        dh[:] = back.reshape(n, rows, HIDDEN).transpose(0, 2, 1)
        # What reaches the gates: of the update gate, the reset gate, and the new state after (du) and before (dn) the reset gate.
        du, dn = xs, room("dn", n, HIDDEN, rows)
        carry, kept, part = (np.zeros((HIDDEN, rows), f4) for _ in range(3))
        for t in range(n - 1, -1, -1):
            d, a, x, m, q = dh[t], gates[t], du[t], new[t], dn[t]
            z, r, v, reset, late = a[:HIDDEN], a[HIDDEN:2 * HIDDEN], a[2 * HIDDEN:], x[HIDDEN:2 * HIDDEN], x[2 * HIDDEN:]
            d += carry
            np.multiply(d, z, out=kept)
            d -= kept
            np.subtract(hs[t], m, out=part)
            np.multiply(d, part, out=x[:HIDDEN])
            np.multiply(m, m, out=part)
            part *= d
            np.subtract(d, part, out=q)
            np.multiply(q, r, out=late)
            np.multiply(late, v, out=reset)
            np.multiply(reset, r, out=part)
            reset -= part
            np.matmul(p["u"], x, out=carry)
            carry += kept
            carry *= keep[t]
        g["u"] = np.matmul(prev, du.transpose(0, 2, 1)).sum(axis=0)
        flat, idx = room("dx", n * rows, 3 * HIDDEN), before.ravel()
        flat[:, :2 * HIDDEN].reshape(n, rows, 2 * HIDDEN)[:] = du[:, :2 * HIDDEN].transpose(0, 2, 1)
        flat[:, 2 * HIDDEN:].reshape(n, rows, HIDDEN)[:] = dn.transpose(0, 2, 1)
        g["b"] = np.ones(len(flat), flat.dtype) @ flat
        order = _order(idx, len(p["x"]))
        first = np.flatnonzero(np.diff(idx[order], prepend=-1))
        g["x"] = room("x", *p["x"].shape)
        g["x"].fill(0)
        g["x"][idx[order][first]] = np.add.reduceat(flat[order], first, axis=0)
        self._step(g)
        return state.T.copy()

    def _outputs(self, hs: np.ndarray, ids: np.ndarray, on: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the output weights and of the states ``hs`` (a last
        unit of one apart), for the mean loss over the ids that are ``on``."""
        p, at, room = self.p, np.flatnonzero(on), self._room
        order, k, parts = _by_class(p, ids[at])
        at, n = at[order], len(at)
        (c, w), row, scale = _outputs(p), np.arange(n), f4(1 / max(n, 1))
        hs, dh = np.take(hs, at, axis=0, out=room("by class", n, HIDDEN + 1), mode="clip"), room("back", len(hs), HIDDEN)
        d = np.matmul(hs, c, out=room("classes", n, len(p["cb"])))
        d *= (scale / _exp(d)[1])[:, None]
        d.reshape(-1)[row * len(p["cb"]) + k] -= scale
        by_c, by_w = hs.T @ d, room("w", *w.shape)
        back, within = d @ p["c"].T, room("within", n, HIDDEN)
        by_w.fill(0)
        d = _inner(w, hs, parts, room("inner", n, WIDTH))
        d *= (scale / _exp(d)[1])[:, None]
        d.reshape(-1)[row * WIDTH + ids[at] - k * WIDTH] -= scale
        for m, i, j in parts:
            part = d[i:j]
            np.dot(hs[i:j].T, part, out=by_w[m])
            np.dot(part, p["w"][m].T, out=within[i:j])
        back += within
        if n < len(dh):
            dh.fill(0)
        dh[at] = back
        return {"c": by_c[:-1], "cb": by_c[-1], "w": by_w[:, :-1].copy(), "wb": by_w[:, -1].copy()}, dh

    def _step(self, g: dict) -> None:
        self.t += 1
        norm = sum(float(np.dot(v, v)) for v in (x.reshape(-1) for x in g.values())) ** 0.5
        clip = f4(min(1.0, 1.0 / max(norm, 1e-12)))
        a = f4(self.rate * (1 - 0.999 ** self.t) ** 0.5 / (1 - 0.9 ** self.t))
        for k in g:
            whole = [x.reshape(-1) for x in (g[k], self.m[k], self.v[k], self.p[k])]
            for i in range(0, len(whole[0]), BLOCK):
                d, m, v, p = (x[i:i + BLOCK] for x in whole)
                if clip < 1:
                    d *= clip
                s = d * d
                s -= v
                s *= f4(0.001)
                v += s
                d -= m
                d *= f4(0.1)
                m += d
                np.sqrt(v, out=s)
                s += f4(1e-8)
                np.multiply(m, a, out=d)
                d /= s
                p -= d
            if self.t % 64 == 0:  # before they become denormal numbers, which are slow
                self.m[k][np.abs(self.m[k]) < 1e-20] = 0
                self.v[k][self.v[k] < 1e-30] = 0


def score(p: dict, seqs: list[np.ndarray], start: int, rows: int = 512, steps: int = 32) -> np.ndarray:
    """Natural log-probability of each whole id sequence. Sequences of like
    length go side by side; the state is carried from window to window."""
    out = np.zeros(len(seqs))
    size = np.array([len(s) for s in seqs], np.int64)
    order = np.argsort(-size, kind="stable")
    weights, (u, table), everyone = _outputs(p), _halved(p), np.arange(rows)
    # States with a last unit of one, the ids that follow them and their rows, until no further step may fit.
    most = max(STATES, rows)
    hs, ids, who, filled = np.ones((most, HIDDEN + 1), f4), np.empty(most, np.int64), np.empty(most, np.int64), 0
    for i in range(0, len(order), rows):
        part = order[i:i + rows]
        n = size[part]
        longest, width = int(n[0]), -1
        reach = np.searchsorted(-n, -np.arange(longest)).tolist()  # so many sequences have a step
        h, last, got = np.zeros((HIDDEN, len(part)), f4), np.full(len(part), start, np.int64), np.zeros(len(part))
        for t0 in range(0, longest, steps):
            block = np.zeros((steps, reach[t0]), np.int64)
            for r in range(reach[t0]):
                piece = seqs[part[r]][t0:t0 + steps]
                block[:len(piece), r] = piece
            for t, live in enumerate(reach[t0:t0 + steps]):
                if live != width:
                    h, width = h[:, :live], live
                    a, x, new, state = (np.empty((k * HIDDEN, live), f4) for k in (3, 3, 1, 1))
                if filled + live > most:
                    got += np.bincount(who[:filled], weights=_log_prob(p, weights, hs[:filled], ids[:filled]), minlength=len(part))
                    filled = 0
                x[:] = table[last[:live]].T
                _advance(u, x, h, a, new, state)
                h, state = state, h
                last, end = block[t, :live], filled + live
                hs[filled:end, :HIDDEN], ids[filled:end], who[filled:end] = h.T, last, everyone[:live]
                filled = end
        out[part] = got + np.bincount(who[:filled], weights=_log_prob(p, weights, hs[:filled], ids[:filled]), minlength=len(part))
        filled = 0
    return out


def train(params: dict, seqs: list[np.ndarray], start: int, rows: int = 64, steps: int = 32, rate: float = 0.01) -> tuple[dict, int]:
    """One pass over sequences that end in ``start``, laid end to end in
    ``rows`` streams. State is carried over windows and starts anew with each
    sequence; the rate falls to zero. Returns (weights, ids seen)."""
    ids = np.concatenate([np.empty(0, np.int64), *seqs])
    if not len(ids):
        return params, 0
    rows = min(rows, len(ids))
    span = -(-len(ids) // rows)
    live = np.arange(rows * span).reshape(rows, span) < len(ids)
    after = np.full(rows * span, start, np.int64)
    after[:len(ids)] = ids
    before = np.concatenate(([start], after[:-1])).reshape(rows, span).T
    after, live = after.reshape(rows, span).T, live.T
    trainer, h = Trainer(params, rate), np.zeros((rows, HIDDEN), f4)
    for t in range(0, span, steps):
        trainer.rate = rate * (1 - t / span)
        h = trainer.window(h, before[t:t + steps], after[t:t + steps], live[t:t + steps], start)
    return trainer.p, len(ids)

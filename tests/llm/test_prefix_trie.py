"""The prefix trie of conversations against a plain trie of Python tuples."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from textlake.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, c long, pos int, path string, shard int, depth int, lo int, members int"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns.setdefault(conv, []).append(((turn is not None, turn or 0, sha(f"{len(role.encode())}:{role}{text}")), role, text))
    own = {c: [(r, t) for _, r, t in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(own.get(c - int(np.fmod(c, 5)), [])[:h] + v[h:])
    members = {}
    for c, path in rebuilt.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    kids = {}
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node, who in members.items():
        gain = (len(who) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += gain
            leaves[node[:d]] += node not in kids
    return sorted((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), len(kids.get(node, ())), leaves[node], saved[node],
                   sha(",".join(str(c) for c in sorted(who) if len(rebuilt[c]) == len(node)))) for node, who in members.items())


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 1, "p", 1, 1, 1, 1) for r in rows], SCHEMA)


def compared(spark, rows):
    got = T.prefix_trie(table(spark, rows))
    assert got.columns == list(T.NODE)
    assert sorted(map(tuple, got.collect())) == plain(rows)


def random_rows(rng, convs, words, most):
    return [(c, t, rng.choice(["user", "assistant"]), rng.choice(words)) for c in convs for t in range(rng.randrange(1, most))]


def test_random_tries(spark):
    rng = random.Random(1)
    compared(spark, random_rows(rng, range(300), ["a", "b"], 9))
    compared(spark, random_rows(rng, rng.sample(range(-400, 400), 150), ["x", "yé", ""], 14))


def test_copies_and_long_conversations_cross_partitions(spark):
    """A third of the conversations are copies, one conversation holds a third of
    all turns, and two long ones share all but their last turn."""
    rng = random.Random(2)
    rows = random_rows(rng, range(120), ["p", "q", "r"], 8)
    rows += [(c, t, "user", f"same {t}") for c in range(1000, 1600, 5) for t in range(5)]
    rows += [(5000, t, "user", f"long {t % 7}") for t in range(900)]
    rows += [(c, t, "user", f"twin {t}" if t < 299 else f"end {c}") for c in (6000, 6005) for t in range(300)]
    rng.shuffle(rows)
    compared(spark, rows)


def test_one_row_many_times(spark):
    """Identical rows cannot be told apart by their keys, yet are spread and counted."""
    compared(spark, [(10, 3, "user", "again")] * 400 + [(11, None, None, None)] * 30 + [(12, 1, "a", "b")])


def test_awkward_rows(spark):
    rows = [(None, 0, "user", "lost"), (1, None, "user", "first"), (1, 0, None, "x"), (1, 0, None, "x"), (1, 0, "", "y"), (2, 5, "user", None), (3, 5, "u", "ser"), (3, 5, "us", "er"),
            (4, 1, "user", "z" * 300_000), (9, 2, "", ""), (-3, 1, "user", "minus"), (-5, 0, "user", "minus"), (2 ** 62, 1, "user", "far"), (7, -1, "ä", "日本"), (7, None, "ä", "日本")]
    compared(spark, rows)
    compared(spark, [(c, 0, "user", "only") for c in range(1, 40) if c % 5])  # many end without a turn


def test_no_conversations(spark):
    assert T.prefix_trie(table(spark, [])).collect() == []
    assert T.prefix_trie(table(spark, [(None, 1, "user", "x")])).count() == 0


def test_small_runs_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "RUN", 3)
    monkeypatch.setattr(T, "ID_BITS", 1)
    compared(spark, random_rows(random.Random(5), range(60), ["a", "b"], 12))


@pytest.mark.parametrize("shards", [1, 2, 7])
def test_shards_meet_at_the_skeleton(shards):
    """Sorted paths cut anywhere give the same nodes as one shard, after their split nodes are added up."""
    rng = random.Random(shards)
    paths = sorted({tuple((rng.randrange(2) + 2 * d, d + 1) for d in range(rng.randrange(7))) for _ in range(60)})
    paths = [[(name, size) for name, size in p] for p in paths]
    # names must tell nodes apart: number the prefixes
    number = {p: i + 1 for i, p in enumerate(sorted({tuple(q[:d]) for q in paths for d in range(len(q) + 1)}))}
    paths = [[(number[tuple(q[:d + 1])], q[d][1]) for d in range(len(q))] for q in paths]

    def run(cuts):
        parts = [paths[a:b] for a, b in zip([0, *cuts], [*cuts, len(paths)]) if a < b]
        shared = T.skeleton([(i, p[0], p[-1]) for i, p in enumerate(parts)])
        total = {}
        for i, part in enumerate(parts):
            shard = T.Shard(i, shared, 0)
            for path in part:
                shard.add(path, 2, len(path) % 2)
            shard.finish()
            for name, depth, up, *counts, split in shard.out:
                assert split or (name, depth) not in total
                total[name, depth, up] = [x + y for x, y in zip(total.get((name, depth, up), [0] * 4), counts)]
        return total

    whole = run([])
    cuts = sorted(rng.sample(range(1, len(paths)), shards - 1))
    assert run(cuts) == whole

"""Near duplicates, decontamination, neighbours, line chunks and mixing against plain versions."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlake.llm import bbit_minhash, temperature_mix
from textlake.llm.bbit_minhash import near_duplicates
from textlake.llm.kmeans_tree import Tree, nearest
from textlake.llm.line_chunks import DIVISOR, FACTOR, remove_repeated_chunks
from textlake.llm.winnow import WINDOW, contamination
from textlake.llm.words import NON_ALNUM, SPACE, Words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def plain_components(texts: dict):
    sets = {i: shingles(t) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng, words, share):
    return [w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in words]


def test_near_duplicates_of_spread_groups(spark, monkeypatch):
    """Groups whose members are near some, but not all, of the others, so that
    links outside a bucket's pivot matter; small blocks and groups."""
    monkeypatch.setattr(bbit_minhash, "BLOCK", 600)
    monkeypatch.setattr(bbit_minhash, "GROUP", 7)
    rng, texts = random.Random(4), {}
    for _ in range(6):
        origin = [f"w{rng.randrange(5000)}" for _ in range(90)]
        chain = origin
        for _ in range(25):
            chain = edited(rng, chain, 0.02) if rng.random() < 0.5 else chain
            for _ in range(2):
                texts[rng.randrange(1, 10**9)] = " ".join(edited(rng, chain if rng.random() < 0.6 else origin, rng.choice((0.0, 0.01, 0.03, 0.06))))
    texts[5], texts[6], texts[7], texts[8] = "One  two", "one TWO\n", "", None
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()}
    assert got == plain_components(texts)
    assert len({c for _, c in got.values()}) > 10


def test_contamination_against_all_windows(spark):
    rng = random.Random(9)
    word = lambda: rng.choice(["a", "b", "c", "Dd", "é", "7"])
    items = [(i, rng.choice([" ", "-", "\n"]).join(word() for _ in range(rng.choice([0, 1, 2, 4, 9, 10, 11, 14, 30])))) for i in range(25)]
    items = [(i, t) for i, t in items if len(t) != 1]
    docs = []
    for i in range(60):
        t = [f"{rng.randrange(99)}x" if rng.random() < 0.3 else word() for _ in range(rng.choice([0, 3, 40, 120]))]
        if rng.random() < 0.6:
            own = rng.choice(items)[1].split()
            t[5:5] = own[rng.randrange(3):]
        docs.append((i, " ".join(t)))
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
    got = {r.doc_id: r for r in contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i, t in docs:
        w, hit, ids = words(t), set(), set()
        for item, body in items:
            x = words(body)
            k = min(len(x), WINDOW)
            for a in range(len(x) - k + 1 if x else 0):
                for b in range(len(w) - k + 1):
                    if w[b:b + k] == x[a:a + k]:
                        hit.update(range(b, b + k)), ids.add(str(item))
        r = got[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(w), len(hit), len(ids), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
    assert sum(r.contaminated for r in got.values()) > 10


@pytest.mark.parametrize("separators, pattern", [(SPACE, r"[^\x20\x09-\x0D]+"), (NON_ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_of_buffers(separators, pattern, monkeypatch):
    import pyarrow as pa

    from textlake.llm import words as W
    from textlake.llm.common import text_buffer

    monkeypatch.setattr(W, "BLOCK", 64)  # many pieces
    rng = random.Random(2)
    texts = ["".join(rng.choices("aAbZ9 \t\n\x0b.é日\x00-", k=rng.randrange(120))) for _ in range(80)] + ["", "x" * 500, "É" * 200 + " " + "q" * 90]
    buf, offs = text_buffer(pa.array(texts))
    s, e, h, row = Words(separators).find(buf, offs)
    raw = buf.tobytes()
    got = [(int(r), raw[a:b].decode().translate(LOWER)) for r, a, b in zip(row, s, e)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in re.findall(pattern, t.translate(LOWER))]
    seen = {}
    for (_, w), x in zip(got, h.tolist()):
        assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_neighbours_on_clusters(spark):
    """Clustered vectors with a third of the rows equal: recall, exact scores, ties by id."""
    rng = np.random.default_rng(0)
    centers = rng.standard_normal((30, 16))
    x = centers[rng.integers(0, 30, 3000)] + 0.3 * rng.standard_normal((3000, 16))
    x[::3] = x[0]
    x = x.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(6)
    got = defaultdict(list)
    for r in nearest(df, lambda i: i % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for q in range(0, 3000, 50):
        score = np.einsum("ij,j->i", x, x[q]) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("i,i->", x[q], x[q])))
        score[q] = -9
        want = np.lexsort((np.arange(3000), -score))[:5]
        assert len(got[q]) == 5 and all(abs(score[i] - s) < 1e-14 for i, s in got[q])
        assert got[q] == sorted(got[q], key=lambda t: (-t[1], t[0]))
        hits, total = hits + len({i for i, _ in got[q]} & set(want.tolist())), total + 5
        if q % 3 == 0:
            assert [i for i, _ in got[q]] == [i for i in range(0, 18, 3) if i != q][:5]
    assert hits / total >= 0.9


def test_tree_visits_every_leaf_once():
    x = np.random.default_rng(1).standard_normal((500, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = Tree(x, 40)
    assert sorted(tree.walk(x[0])) == list(range(tree.n_leaves)) and tree.n_leaves == 40
    leaf = tree.assign(x)
    first = np.array([next(tree.walk(v)) for v in x])
    assert (leaf == first).mean() > 0.5


def test_line_chunks_against_plain(spark):
    rng = random.Random(6)
    passages = [[f"p{i} line {j}" for j in range(rng.randrange(2, 12))] for i in range(6)]
    docs = []
    for i in range(80):
        lines = []
        for _ in range(rng.randrange(1, 5)):
            lines += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(["", "same", f"own {rng.random()}"]) for _ in range(rng.randrange(1, 6))]
        docs.append((i, "\n".join(lines)))
    chunks = {}
    for i, t in docs:
        value = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in t.split("\n")]
        parts, own = [], []
        for j, x in enumerate(t.split("\n")):
            own.append(x)
            if (value[j] + FACTOR * (value[j - 1] if j else 0)) % DIVISOR == 0:
                parts, own = parts + [own], []
        chunks[i] = parts + [own] if own else parts
    seen, want = set(), {}
    for i, _ in docs:
        kept = []
        for c in chunks[i]:
            body = "\n".join(c)
            if len(c) > 1 and body.strip(" \t\r\n") and body in seen:
                continue
            if len(c) > 1:
                seen.add(body)
            kept.append(body)
        want[i] = "\n".join(kept)
    rows = remove_repeated_chunks(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id: r.text for r in rows} == want
    assert sum(r.removed_chunks for r in rows) > 20


def test_mixture_meets_its_targets(spark):
    rng = random.Random(8)
    rows = [(i, s, " ".join("w" * rng.randrange(1, 40))) for i, s in enumerate(rng.choices("abcde", (60, 20, 12, 6, 2), k=1500))]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    tokens = Counter()
    for _, s, t in rows:
        tokens[s] += len(t.split())
    for budget, entropy, repeats in ((None, 0.8, 50.0), (None, 1.0, 3.0), (9000, 0.9, 100.0)):
        got = temperature_mix.mix_sources(df, budget=budget, entropy=entropy, repeats=repeats, block=500).collect()
        used, weight = Counter(), {}
        for r in got:
            used[r.source] += r.n_tokens
            weight[r.source] = r.weight
        w = np.array([weight[s] for s in "abcde"])
        h = -(w * np.log(w)).sum() / np.log(5)
        total = budget or max(tokens[s] / weight[s] for s in "abcde")
        assert abs(w.sum() - 1) < 1e-9
        assert max(weight[s] * total / tokens[s] for s in "abcde") <= repeats * (1 + 1e-6)
        assert abs(h - entropy) < 1e-6 or h < entropy and repeats == 3.0
        for s in "abcde":
            assert weight[s] * total - 40 <= used[s] <= weight[s] * total + 1
        per = Counter((r.doc_id, r.epoch) for r in got)
        assert max(per.values()) == 1
        if budget is None:
            assert {r.doc_id for r in got} == {i for i, _, _ in rows}

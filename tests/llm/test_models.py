"""Quality votes, language by compression, secrets and the language model."""

import math
import re
import zlib

import numpy as np
import pytest

from textlake.llm import gru, langid_zstd, quality_knn, secret_scan
from textlake.llm.language_model import score_documents
from textlake.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_votes_against_loops():
    rows = [(f"good words in this text number {i} and more of them", 1) for i in range(40)] + [(f"BAD!! BAD!! {i}!! ###", 0) for i in range(15)]
    model = quality_knn.fit(rows)
    import pyarrow as pa

    from textlake.llm.common import text_buffer
    x = quality_knn.Features().rows(*text_buffer(pa.array(["some good words here", "WORSE!! BAD!! ###", ""])))
    got = quality_knn.vote(model, x)
    for r, g in zip(x[:2], got):
        z = r @ model["space"]
        cos = model["vectors"] @ (z / np.linalg.norm(z))
        near = np.argsort(-cos, kind="stable")[:quality_knn.K]
        w = np.maximum(cos[near], 0).astype(float) ** quality_knn.POWER
        assert abs((w * model["labels"][near]).sum() / w.sum() - g) < 1e-4
    assert got[0] > 0.9 and got[1] < 0.3 and got[2] == model["prior"]


def test_quality_and_language_on_held_out_rows(spark):
    read = lambda t: spark.read.parquet(f"{SF}/{t}.parquet")
    scored = QUERIES["op1_quality_votes"][0](spark, SF).join(read("labels"), "doc_id").where("held_out").toPandas()
    assert (scored.predicted == scored.quality).mean() >= 0.97
    lang = QUERIES["op3_language_zstd"][0](spark, SF).join(read("documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (lang.lang == lang.lang_pred).mean() >= 0.95


def test_ties_between_languages_go_to_the_larger():
    assert langid_zstd.letters("Ab1c, É!") == "ab c é".encode()
    body = b"x"
    found = langid_zstd._compressors({"bb": b"hello there", "aa": b"hello where"}, 3)
    sizes = langid_zstd._sizes(body, found)
    assert sizes[0] == sizes[1] and found[sizes.index(min(sizes))][0] == "bb"


BASE = {"assign": re.compile(secret_scan.ASSIGN), "access": re.compile(secret_scan.ACCESS), "hex": re.compile(secret_scan.HEX)}


def test_base_patterns_against_plain_regex():
    rng = np.random.default_rng(3)
    bits = ["token", "API_KEY", "apikey", "Secret", "passwd=", "password", "'", '"', " ", "  ", ":", "=", ":=", "AKIA", "AKIAAKIA1234567890", "0123456789abcdef" * 2,
            "deadbeef", "é", "\n", "ſecret", "toKen", "A1b2C3d4", "xyz/+_.-", "=====", "f" * 31, "Q" * 9]
    for _ in range(3000):
        t = "".join(rng.choice(bits, rng.integers(1, 9)))
        want = []
        for kind, p in BASE.items():
            want += [(kind, *m.span()) for m in p.finditer(t) if len(m[2] if kind == "assign" else m[0]) >= secret_scan.LEAST[kind]]
        want.sort(key=lambda x: (x[1], secret_scan.KINDS.index(x[0])))
        assert [x[:3] for x in secret_scan.find_spans(t) if x[0] != "random"] == want


def test_randomness_tests_tell_noise_from_names():
    rng = np.random.default_rng(5)
    for alphabet in ("0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789abcdefghijklmnopqrstuvwxyz"):
        ps = []
        for _ in range(400):
            s = "".join(rng.choice(list(alphabet), 40))
            name, x, m = secret_scan.infer_encoding(s)
            ps.append(secret_scan.randomness_p(x, m))
        assert 0.35 < np.mean(ps) < 0.65 and np.mean(np.array(ps) < 0.05) < 0.12
    for s in ("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "abababababababababababab12121212", "00000000000000000000ffffffffffff", "0123456789abcdef0123456789abcdef"):
        name, x, m = secret_scan.infer_encoding(s)
        assert secret_scan.randomness_p(x, m) < 0.01, s


def test_thresholds_control_false_discoveries():
    rng = np.random.default_rng(6)
    hist = lambda p: np.bincount((p * secret_scan.BINS).astype(int).clip(0, secret_scan.BINS - 1), minlength=secret_scan.BINS).tolist()
    noise, names = rng.random(500), rng.beta(0.1, 8, 4000)
    cut = secret_scan.thresholds({"s": hist(np.concatenate((noise, names)))})["s"]
    kept_names, kept_noise = (names >= cut).sum(), (noise >= cut).sum()
    assert kept_names / (kept_names + kept_noise) < 0.12 and kept_noise > 250
    assert secret_scan.thresholds({"s": hist(noise)})["s"] <= 0.1


def test_random_strings_are_found(spark):
    rng = np.random.default_rng(7)
    alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
    keys = ["".join(rng.choice(alphabet, 40)) for _ in range(60)]
    names = [f"item_number_{i}_of_the_long_list_{i + 1}_items_items" for i in range(200)]
    rows = [(i, f"see {k} here") for i, k in enumerate(keys + names)]
    got = {r.doc_id: r.spans for r in secret_scan.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [i for i in range(60) if got[i] and (got[i][0].start, got[i][0].end) == (4, 44)]
    assert len(found) >= 54 and sum(bool(got[i]) for i in range(60, 260)) <= 6


def test_lone_and_copied_keys(spark):
    """One key is found, alone or in many copies, and its copies do not change what else is kept."""
    rng = np.random.default_rng(8)

    def keys(n, low, high):
        out = []
        while len(out) < n:
            s = "".join(rng.choice(list("0123456789ABCDEF"), 40))
            if low <= secret_scan.randomness_p(*secret_scan.infer_encoding(s)[1:]) < high:
                out.append(s)
        return out

    def kept(texts):
        rows = secret_scan.scan_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
        return [bool(r.spans) for r in sorted(rows, key=lambda r: r.doc_id)]

    lone, (high,), names = keys(1, 0.2, 0.3), keys(1, 0.9, 1), ["0A" * 20, "0123456789ABCDEF" * 2 + "01234567"]
    assert kept(lone) == [True]
    assert kept(lone * 300 + names) == [True] * 300 + [False] * 2
    others = keys(30, 0, 1)
    assert kept(others + names + lone * 300)[:32] == kept(others + names + lone)[:32]
    assert kept([high] * 300 + names) == [True] * 300 + [False] * 2
    assert kept(names[:1] * 300) == [False] * 300


def test_gru_gradients_and_probabilities(monkeypatch):
    monkeypatch.setattr(gru, "f4", np.float64)
    rng, n = np.random.default_rng(0), 60
    p = {k: v.astype(np.float64) for k, v in gru.init(np.sort(rng.integers(1, 50, n))[::-1]).items()}
    ids = rng.integers(0, n, (6, 4))
    ids[2, 1], live, start = 7, np.ones((5, 4), bool), 7
    live[4, 2] = False
    h0 = rng.standard_normal((4, gru.HIDDEN)) * 0.3

    def loss(q):
        h, total = h0, 0.0
        for t in range(5):
            h = gru.cell(q, np.where((ids[t] == start)[:, None], 0, h), q["x"][ids[t]] + q["b"])[0]
            total -= gru.log_prob(q, h.copy(), ids[t + 1])[live[t]].sum()
        return total / live.sum()

    trainer, got = gru.Trainer(p), {}
    trainer._step = got.update
    trainer.window(h0, ids[:-1], ids[1:], live, start)
    for k in p:
        for _ in range(5):
            i = tuple(rng.integers(0, s) for s in p[k].shape)
            if p[k][i] < -1e8:
                continue
            up, down = ({a: b.copy() for a, b in p.items()} for _ in range(2))
            up[k][i] += 1e-5
            down[k][i] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - got[k][i]) < 1e-6, k
    every = gru.log_prob(p, np.repeat(h0[:1], n, axis=0), np.arange(n))
    assert abs(np.exp(every).sum() - 1) < 1e-9


def test_state_is_carried_over_windows():
    rng = np.random.default_rng(1)
    p = gru.init(np.arange(100, 0, -1))
    seqs = [rng.integers(0, 100, n) for n in (1, 33, 150, 64, 7, 0)]
    got = gru.score(p, seqs, 3, rows=4, steps=32)
    for s, g in zip(seqs, got):
        h, last, want = np.zeros((1, gru.HIDDEN), np.float32), 3, 0.0
        for i in s:
            h = gru.cell(p, h, p["x"][[last]] + p["b"])[0]
            want += gru.log_prob(p, h.copy(), np.array([i]))[0]
            last = i
        assert abs(want - g) < 1e-2
    better, seen = gru.train(p, [np.append(np.tile([5, 6, 7, 8], 20), 3) for _ in range(60)], 3, rows=8)
    tests = [np.tile([5, 6, 7, 8], 8)]
    assert seen == 60 * 81 and gru.score(better, tests, 3)[0] > gru.score(p, tests, 3)[0] + 20


def test_base_scores_against_counts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op8_recurrent_lm"][0](spark, "/root/testdata/sf0.001").collect()}
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = {r.doc_id: [*re.findall(r"[^\x20\x09-\x0D]+", r.text.translate(lower)), None] for r in docs.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    count = {}
    for i, w in words.items():
        if not held[i]:
            for t in w:
                count[t] = count.get(t, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, w in words.items():
        r = rows[i]
        base = sum(math.log10((count.get(t, 0) + 0.5) / (n + 0.5 * (v + 1))) for t in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w), sum(t in count for t in w), n)
        assert abs(base - r.base_score) < 1e-6 * abs(base)


def test_every_training_row_reaches_the_network(spark, monkeypatch):
    """Rows of null ids and of one id as well: each is trained on once, over several rounds."""
    from textlake.llm import language_model

    paths, seen = [], language_model.shared_path
    rows = [(None if i < 30 else 7 if i < 60 else i, f"a w{i} " * (1 + i % 3)) for i in range(90)] + [(5, "same")] * 10
    train = spark.createDataFrame(rows, "doc_id long, text string")

    def path(spark, name):
        paths.append(seen(spark, name))
        return paths[-1]

    monkeypatch.setattr(language_model, "shared_path", path)
    score_documents(train.limit(1), train).collect()
    dealt = spark.read.schema("ids array<int>, turn long").parquet(*[p for p in paths if "sequences" in p]).groupBy("turn").count().collect()
    assert sum(r["count"] for r in dealt) == 100 and max(r["count"] for r in dealt) < 25
    assert {r.turn for r in dealt} <= set(range(language_model.ROUNDS))


def test_model_probabilities_sum_to_one(spark):
    """All one-word texts over the training words, and any unknown word: with
    the end's share left out, first-token probabilities add up to one."""
    train = spark.createDataFrame([(i, "a b c a d " * 3) for i in range(40)], "doc_id long, text string")
    texts = [(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "")]
    two = {r.doc_id: r.score for r in score_documents(spark.createDataFrame(texts, "doc_id long, text string"), train).collect()}
    assert all(s < 0 for s in two.values()) and sum(10 ** s for s in two.values()) < 1
    assert two[0] > two[1] - 0.7


@pytest.mark.parametrize("name", ["op4_line_chunks", "op10_temperature_mix"])
def test_against_sql(spark, name):
    import duckdb

    from tools.check import digest
    build, sql = QUERIES[name]
    df = build(spark, "/root/testdata/sf0.001")
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM read_parquet('/root/testdata/sf0.001/documents.parquet')")
    cur = con.execute(sql)
    assert digest(df.columns, df.collect())[:2] == digest([c[0] for c in cur.description], cur.fetchall())[:2]


def test_replicas_travel_as_they_are_and_once(spark):
    """op8: sums of replicas' weights by ids seen. Fails before: weights went through two shuffles as doubles."""
    import numpy as np

    from textlake.llm import language_model as LM

    rng = np.random.default_rng(5)
    w = rng.standard_normal((70, 3)).astype(np.float32)
    rows = [("u", 0, i % LM.PARTS, i + 1, [float(x) for x in w[i]]) for i in range(70)]
    shape = "name string, block long, part long, seen long, w array<float>"
    for n, steps in ((1, 1), (LM.PARTS, 1), (70, 2)):
        out = LM._summed(spark.createDataFrame(rows[:n], shape), n)
        assert out._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsInPandas") == steps
        (got,) = out.collect()
        assert got.seen == n * (n + 1) // 2
        assert np.allclose(got.w, (w[:n].astype(np.float64) * np.arange(1, n + 1)[:, None]).sum(axis=0), rtol=1e-14, atol=1e-12)


def test_steps_and_sums_of_the_network_are_cheap_and_whole(monkeypatch):
    """op8: the step by gates equals ``cell``, rows far below the others keep their sums, windows share their
    memory. Fails before: every window took new memory, every row its own maximum."""
    rng = np.random.default_rng(9)
    p = gru.init(np.arange(120, 0, -1))
    h, ids = np.tanh(rng.standard_normal((5, gru.HIDDEN))).astype(np.float32), rng.integers(0, 120, 5)
    u, table = gru._halved(p)
    a, new, out = (np.empty((k * gru.HIDDEN, 5), np.float32) for k in (3, 1, 1))
    gru._advance(u, table[ids].T, h.T, a, new, out)
    assert np.allclose(out.T, gru.cell(p, h, p["x"][ids] + p["b"])[0], atol=1e-6)
    for low in (0, -10, -300):
        x = (rng.standard_normal((4, 6)) + np.array([0, low, 0, low / 2])[:, None]).astype(np.float32)
        top, total = gru._exp(x.copy())
        assert np.allclose(top + np.log(total), np.log(np.exp(x.astype(np.float64)).sum(axis=1)), rtol=1e-5)
    trainer, before = gru.Trainer(p), rng.integers(0, 120, (6, 4))
    memory = []
    for n in (6, 6, 3):
        state = trainer.window(np.zeros((4, gru.HIDDEN), np.float32), before[:n], before[:n], np.ones((n, 4), bool), 3)
        memory.append({k: v.ctypes.data for k, v in trainer.kept.items()})
    assert memory[0] and memory[0] == memory[1] == memory[2] and not any(np.shares_memory(state, v) for v in trainer.kept.values())


def test_texts_of_a_task_are_scored_side_by_side(monkeypatch):
    """op8: blocks are held and scored together, in the order of their rows. Fails before: one call a block."""
    import pyarrow as pa

    from textlake.llm import language_model as LM

    class Sent:
        def __init__(self, value):
            self.value = value

    p, calls, plain = gru.init(np.arange(9, 0, -1)), [], gru.score
    words = LM._tokens(LM.Words(LM.SPACE), np.frombuffer(b"a b c", np.uint8), np.array([0, 5]))[0]
    keys = np.sort(words)
    head = Sent({"keys": keys, "counts": np.arange(1, 5), "ids": np.arange(1, 5), "n_ids": 5, "named": 10, "end": 1, "total": 12, "types": 6})
    texts = ["a b", None, "c c c a", "zz a", "", "b " * 70]
    batches = [pa.record_batch([pa.array([i]), pa.array([t], pa.string())], names=["rid", "text"]) for i, t in enumerate(texts)]
    monkeypatch.setattr(gru, "score", lambda p, seqs, start: (calls.append(len(seqs)), plain(p, seqs, start))[1])
    run = LM._scorer(head, Sent(p), ["rid"])
    got = pa.Table.from_batches(run(batches)).to_pydict()
    assert calls == [6] and got["rid"] == list(range(6))
    alone = [next(iter(run([b]))).to_pydict() for b in batches]
    assert np.allclose(got["score"], [x["score"][0] for x in alone], rtol=1e-5)
    assert [got[k] for k in ("n_tokens", "n_known", "rare")] == [[x[k][0] for x in alone] for k in ("n_tokens", "n_known", "rare")]
    calls.clear()
    monkeypatch.setattr(LM, "HELD", 5)
    assert pa.Table.from_batches(run(batches)).to_pydict()["rid"] == list(range(6)) and len(calls) > 2

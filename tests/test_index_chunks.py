"""The lexical index made chunk by chunk, and blocks scored by numpy, against plain sums."""

import collections
import math

import pytest

from textlake.operators import indexes as IX
from textlake.operators import search as R
from textlake.operators import text as TX

ROWS = [(1, "bb aa bb"), (2, "aa cc"), (2, "aa dd dd"), (None, "ee ff"), (None, "ee aa"), (3, None), (4, ""), (5, "solo"), (6, "bb aa bb"), *((i, f"aa w{i % 4} w{i % 5}") for i in range(10, 60))]
ASKED = [(1, "aa bb"), (2, "ee w3"), (3, "unknown"), (4, " "), (5, "solo w1 w1")]


def _plain(k):
    docs = collections.defaultdict(collections.Counter)
    for i, t in ROWS:
        docs[i].update((t or "").split())
    df = collections.Counter(t for d in docs.values() for t in d)
    idf = {t: math.log((1 + len(ROWS)) / (1 + n)) + 1 for t, n in df.items()}
    unit = lambda c: {t: n * idf[t] / math.sqrt(sum((m * idf[s]) ** 2 for s, m in c.items() if s in idf)) for t, n in c.items() if t in idf}
    weights, out = {i: unit(d) for i, d in docs.items()}, []
    for q, text in ASKED:
        asked = unit(collections.Counter(text.split()))
        scores = [(-round(sum(w * d.get(t, 0) for t, w in asked.items()), 6), i is not None, i) for i, d in weights.items()]
        out += [(q, i, -s, rank + 1) for rank, (s, _, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return weights, out


@pytest.mark.parametrize("sent", [R.SENT_ROWS, 0])
def test_hits_of_repeated_and_null_ids(spark, tmp_path, monkeypatch, sent):
    """Fails before: postings were made in the long form, which was shuffled five times."""
    monkeypatch.setattr(TX, "fit_tfidf", lambda *a, **b: (_ for _ in ()).throw(AssertionError("postings in the long form")))
    monkeypatch.setattr(IX, "BLOCK_DOCS", 4)
    monkeypatch.setattr(IX, "CHUNK_BLOCKS", 3)
    monkeypatch.setattr(R, "SENT_ROWS", sent)
    monkeypatch.setattr(R, "PIECE", 2)
    index = R.build_lexical_index(spark.createDataFrame(ROWS, "review_id long, text string"), root=str(tmp_path))
    weights, want = _plain(4)
    got = {(p["id"], r["term"]): p["weight"] for r in index.blocks.collect() for p in r["postings"]}
    assert got == pytest.approx({(i, t): w for i, d in weights.items() for t, w in d.items()})
    assert all(r["max_weight"] == max(p["weight"] for p in r["postings"]) for r in index.blocks.collect())
    assert index.manifest["postings"] == len(got) and index.manifest["terms"] == len({t for _, t in got})
    hits = R.lexical_search(index, spark.createDataFrame(ASKED, "query_id long, query string"), 4).collect()
    assert sorted((r["query_id"], r["rank"], r["review_id"]) for r in hits) == sorted((q, rank, i) for q, i, _, rank in want)
    assert {(r["query_id"], r["rank"]): r["score"] for r in hits} == pytest.approx({(q, rank): s for q, _, s, rank in want}, abs=2e-6)

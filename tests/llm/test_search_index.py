"""A shard's row of the index: small, and what was stored comes back."""

import random

import numpy as np
import pandas as pd

from talweg.llm import search


def test_rows_of_the_index_are_small():
    rng = random.Random(3)
    docs = [sorted({rng.getrandbits(62) for _ in range(20)} | {rng.randrange(500) for _ in range(60)}) for _ in range(1500)]
    counts = [[rng.choice([1, 1, 1, 2, 9]) for _ in d] for d in docs]
    pdf = pd.DataFrame({"shard": 4, "doc_id": range(1500), "text_hash": 0, "terms": [np.array(d) for d in docs], "counts": [np.array(c, np.int32) for c in counts], "size": [sum(c) for c in counts]})
    row = search._deflated(pdf).iloc[0]
    ids, rank, sizes, names, first, doc, tf = search.unpacked(row["blob"])
    back = {(ids[rank[p]], int(names[t])): int(f) for t in range(len(names)) for p, f in zip(doc[first[t] : first[t + 1]], tf[first[t] : first[t + 1]], strict=True)}
    assert back == {(i, t): f for i, (d, c) in enumerate(zip(docs, counts, strict=True)) for t, f in zip(d, c, strict=True)}
    assert [int(x) for x in sizes] == [sum(counts[ids[r]]) for r in rank]
    assert len(row["blob"]) < 0.7 * len(search._store(pdf)["blob"][0])


def test_alike_queries_are_scored_together(monkeypatch):
    """A batch of queries takes a few steps over all its postings, not some for each query, and finds what plain scoring finds."""
    rng = np.random.default_rng(5)
    words = [[f"{'abc'[lang]}{int(w)}" for w in rng.zipf(1.3, 80) % 4000] for lang in rng.integers(0, 3, 2000)]
    docs = [search.terms(" ".join(w).encode()) for w in words]
    pdf = pd.DataFrame({"shard": 0, "doc_id": range(2000), "text_hash": 0, "terms": [t for t, _ in docs], "counts": [c for _, c in docs], "size": [80] * 2000})
    _, rank, sizes, names, first, doc, tf = search.unpacked(search._deflated(pdf)["blob"][0])
    shard = search.Shard(rank, sizes, names, first, doc, tf, 80.0)
    idf = np.log(1 + (2000 - np.diff(first) + 0.5) / (np.diff(first) + 0.5))
    asked = search.Asked.of([(q, t, c * idf[np.searchsorted(names, t)]) for q, (t, c) in enumerate(docs[:512])])
    calls, plain = [], search.ranges
    monkeypatch.setattr(search, "ranges", lambda lo, hi: calls.append(1) or plain(lo, hi))
    found = shard.search(asked, np.zeros(512), 10)
    assert len(calls) < 50
    impact = np.zeros((len(names), 2000))
    impact[np.repeat(np.arange(len(names)), np.diff(first)), rank[doc]] = tf * 2.2 / (tf + 1.2)
    for q, (t, c) in enumerate(docs[:512]):
        at = np.searchsorted(names, t)
        score = np.round((c * idf[at]) @ impact[at], 6)
        best = np.lexsort((np.arange(2000), -score))[:10]
        assert shard.rank[found[q][0]].tolist() == best.tolist()
        np.testing.assert_allclose(found[q][1], score[best], atol=2e-6)


def test_scores_that_single_precision_cannot_tell():
    """Common terms pass through a matrix of single precision; ranks and scores keep double precision."""
    n, rng = 4000, np.random.default_rng(6)
    sizes = 30_000_000 + rng.permutation(n)
    shard = search.Shard(np.arange(n), sizes, np.array([7]), np.array([0, n]), np.arange(n), np.ones(n, np.uint8), float(sizes.mean()))
    (place, found), = shard.search(search.Asked.of([(0, np.array([7]), np.array([1000.0]))]), np.zeros(1), 10)
    score = np.round(1000 * 2.2 / (1 + 1.2 * (0.25 + 0.75 * sizes / sizes.mean())), 6)
    assert len(np.unique(score.astype(np.float32))) < n / 2 < len(np.unique(score))
    best = np.lexsort((np.arange(n), -score))[:10]
    assert place.tolist() == best.tolist() and found.tolist() == score[best].tolist()

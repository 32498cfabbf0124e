"""Ranked search against a plain version: ties, repeats, nulls, slices, blocks."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tipoff.llm import ranking as R

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in WORD.findall(text or "")]


def plain(docs, items, k=10):
    held = [(d, Counter(words(t)), len(words(t))) for d, t in docs if words(t)]
    n_docs, total = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    rows = []
    for name, text in items:
        scored = []
        for d, c, n in held:
            m = 25 + 75 * n * n_docs // total
            s = sum(
                q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, q in Counter(words(text)).items() if c[t]
            )
            if s > 0:
                scored.append((s, d))
        scored.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        rows += [(name, i + 1, d, s) for i, (s, d) in enumerate(scored[:k])]
    return sorted(map(str, rows))


def test_odd_rows_ties_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    some = [(int(i), " ".join(rng.choice(["Ab", "é", "x1", "rare", "the", "THE", "zz,top", "ñÑ"], int(n)))) for i, n in enumerate(rng.integers(0, 30, 120))]
    docs = some + some[:20] + [(None, "rare rare"), (None, "rare rare"), (500, None), (501, ""), (502, " .,; "), (503, "the " * 50_000 + "unique")]
    items = [("a", "the rare x1 rare"), ("a", "É ñÑ"), ("b", None), (None, "top unique nowhere"), ("c", "--"), ("d", "ab the zz")]
    frame = spark.createDataFrame([(*r, "q") for r in docs], "doc_id long, text string, score string").repartition(3)
    asked = spark.createDataFrame([(*r, 1) for r in items], "item_id string, text string, rank int")
    monkeypatch.setattr(R, "_SLICE", 16)
    want = plain(docs, items)
    for block_bytes in (1, 1 << 20):
        got = R.rank_documents(frame, asked, block_bytes=block_bytes)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert sorted(str(tuple(r)) for r in R.rank_documents(frame, asked, k=3).collect()) == plain(docs, items, 3)
    assert R.rank_documents(frame.limit(0), asked).count() == 0 and R.rank_documents(frame, asked.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_accumulator_limit_is_exact(seed):
    rng = np.random.default_rng(seed)
    n_docs, n_terms = 300, 12
    tf = rng.integers(1, 5, (n_docs, n_terms)) * (rng.random((n_docs, n_terms)) < np.linspace(0.01, 0.9, n_terms))
    doc, term = np.nonzero(tf)
    m = rng.integers(25, 200, n_docs)
    postings = R.Postings(term.astype("i4"), tf[doc, term], doc, m, n_terms)
    asked = [(t, int(2000 / (t + 1))) for t in range(n_terms)]
    gains = np.where(tf > 0, 10**9 * tf // (1000 * np.maximum(tf, 1) + 8 * m[:, None]), 0)
    scores = gains @ np.array([w for _, w in asked])
    k = int(rng.integers(1, 15))
    kth = max(np.sort(scores)[-k], 1)
    found, got = R.best_documents(postings, asked, k)
    assert dict(zip(found.tolist(), got.tolist())) == {d: s for d, s in enumerate(scores.tolist()) if s >= kth}

"""Removal of repeated strings against a plain version."""

import hashlib
from collections import Counter

import numpy as np
import pytest

from tipoff.llm import suffixes as SX
from tipoff.llm.queries import QUERIES


def plain(texts, length):
    """(n_bytes, spans, kept) of each text: every string of `length` bytes is looked up in a table of all."""
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    rows = []
    for r in raws:
        gone = np.zeros(len(r) + 2, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        edges = np.flatnonzero(gone[1:] != gone[:-1]).tolist()
        kept = bytes(b for b, g in zip(r, gone[1:]) if not g)
        rows.append((len(r), list(zip(edges[::2], edges[1::2])), kept))
    return rows


def some_texts(seed, length):
    """Random texts with passages, copies, near copies and repeats within a text."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("abc dé\x00"))
    word = lambda n: "".join(rng.choice(letters, n))
    passages = [word(int(length * f)) for f in (0.9, 1.0, 1.3, 2.5, 4)]
    out = [None, "", "a" * (length * 3), "a" * (length + 1), "ab" * length]
    for _ in range(60):
        parts = [word(int(rng.integers(0, length * 2)))]
        for _ in range(int(rng.integers(0, 3))):
            parts += [passages[int(rng.integers(len(passages)))], word(int(rng.integers(0, length)))]
        out.append("".join(parts))
    for i in rng.integers(5, len(out), 12).tolist():
        t = out[i]
        out.append(t)
        if len(t) > 3:
            at = int(rng.integers(len(t)))
            out.append(t[:at] + "X" + t[at + 1 :])
    return out


@pytest.mark.parametrize(("length", "cell", "crowd"), [(40, 13, 1000), (40, 13, 2), (40, 13, 0), (60, 60, 1000), (33, 1, 4)])
def test_equals_plain(spark, length, cell, crowd, monkeypatch):
    monkeypatch.setattr(SX, "_RUN", 4000)
    monkeypatch.setattr(SX, "_SLICE", 700)
    texts = some_texts(length + crowd, length)
    rows = [(i if i % 9 else None, t, "c", 5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, text_1 int").repartition(5)
    got = SX.without_repeats(docs, length=length, cell=cell, crowd=crowd)
    assert got.columns == ["doc_id", "text", "text_1", "n_bytes", "spans", "kept"]
    have = sorted(str((r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"]))) for r in got.collect())
    assert have == sorted(str((r[0], *p)) for r, p in zip(rows, plain(texts, length)))
    assert sum(len(p[1]) for p in plain(texts, length)) > 40


def test_empty_table(spark):
    assert SX.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query_equals_plain(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = [
        (d, n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest())
        for (d, _), (n, spans, kept) in zip(docs, plain([t for _, t in docs], 400))
    ]
    got = QUERIES["op13_suffix_dedup"](spark, sf)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("seed", range(20))
def test_merge_of_runs(seed):
    rng = np.random.default_rng(seed)
    runs = [sorted("".join(rng.choice(["a", "b"], int(rng.integers(0, 9)))).encode() for _ in range(int(rng.integers(0, 30)))) for _ in range(1 + seed % 7)]
    order, common = SX.merge_runs([SX.decoded(*SX.front_coded(r)) for r in runs], [SX.front_coded(r)[0] for r in runs])
    flat = [s for r in runs for s in r]
    merged = [flat[i] for i in order]
    assert merged == sorted(flat) and sorted(order) == list(range(len(flat)))
    assert common.tolist() == [0] * bool(flat) + [SX.common_prefix(a, b) for a, b in zip(merged, merged[1:])]


def test_runs_leave_part_by_part():
    """A run is sent in batches of one part each, made of nothing but the cells, and what it was made of is let go."""
    rng = np.random.default_rng(3)
    length, raws = 40, [bytes(rng.integers(97, 100, 3000).astype("u1")) for _ in range(4)]
    held, size = [], 0
    for i, raw in enumerate(raws):
        for at, first, last, core, key in zip(*SX.cells(np.frombuffer(raw, "u1"), np.array([len(raw)]), length, 13)):
            sides = SX._cell(raw, int(first), int(last), int(core), length)
            assert sides[1][::-1] + sides[0] == raw[first : last + length]
            held.append((sides, i, i, int(first), int(last), int(core), int(key), i == 3))
            size += 1
    got = list(SX._sorted_run(held, length, 7))
    assert not held and all(b.num_rows == 1 for b in got)
    assert {b.column(0)[0].as_py() for b in got} == set(range(7))
    sent = [r for b in got for r in b.to_pylist()]
    assert 0 < sum(len(r["core"]) for r in sent) < size
    assert sum(len(r["window_at"]) for r in sent) > 0

"""Token alignment against a plain version: merge paths, groups, links and counts."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tipoff.llm import alignment as AL
from tipoff.llm.queries import QUERIES

FILES = [str(public_tokenizers.path(f)) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model", "byte_bpe_50k.tiktoken")]


def byte_alphabet():
    """The usual byte-level mapping, written out anew."""
    shown = list(range(ord("!"), ord("~") + 1)) + list(range(ord("¡"), ord("¬") + 1)) + list(range(ord("®"), ord("ÿ") + 1))
    out, extra = {}, 0
    for b in range(256):
        if b in shown:
            out[chr(b)] = b
        else:
            out[chr(256 + extra)] = b
            extra += 1
    return out


def plain(texts):
    """Rows by the definition, a pair at a time."""
    a_side, b_side = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a_side.encode_special_tokens = True
    byte, held = byte_alphabet(), []
    for text in texts:
        want = b" " + (text or "").encode()
        enc = a_side.encode(" " + (text or ""), add_special_tokens=False)
        a = [(i, bytes(byte[c] for c in t)) for i, t in zip(enc.ids, enc.tokens)]
        b = []
        for i in b_side.encode(text or ""):
            p = b_side.id_to_piece(i)
            b.append((i, bytes.fromhex(p[3:5]) if p.startswith("<0x") else p.replace("▁", " ").encode()))
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            held.append(([], []))
            continue
        groups, ga, gb, ea, eb = [], [], [], 0, 0
        a, b = a[::-1], b[::-1]
        while a or b:
            if ea <= eb:
                i, x = a.pop()
                ga, ea = [*ga, i], ea + len(x)
            else:
                i, x = b.pop()
                gb, eb = [*gb, i], eb + len(x)
            if ea == eb:
                groups.append((ga, gb))
                ga, gb = [], []
        held.append(groups)
    links = [Counter((i, j) for g in gs if g for i in g[0] for j in g[1]) for gs in held]
    count = Counter(p for c in links for p in c)
    most = {}
    for (i, _), n in count.items():
        most[i] = max(most.get(i, 0), n)
    rows = []
    for gs, c in zip(held, links):
        gs = [g for g in gs if g]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        rows.append((
            sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), sum(c.values()),
            sum(n for p, n in c.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in c.items()),
            hashlib.sha256(said.encode()).hexdigest() if gs else "",
        ))
    return rows


ODD = [
    None, "", " ", "  two  blanks ", "plain words here", "plain words here", "<|endoftext|> <s> </s> <unk> <0x41>", "▁under▁bars", "naïve café 東京タワー 🎉🎉 \n\n\t x",
    "a" * 5000, "Ð" * 700, "\x00\x01 odd \x7f", "tab\tand\r\nlines", " ".join(f"Wort{i} thndstreth" for i in range(9000)), "ﬁ ligature ½", "12345678901234567890",
]


def test_odd_texts_and_light_pairs(spark, monkeypatch):
    rows = [(i if i != 3 else None, t, "x", 7) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a string, pairs int").repartition(3)
    want = sorted(str((d, *r)) for (d, *_), r in zip(rows, plain(ODD)))
    for heavy in (1 << 19, 4, 0):
        got = AL.align_documents(docs, FILES[0], FILES[1], a_ranks=FILES[2], heavy_pairs=heavy)
        assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
        assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert AL.align_documents(docs.limit(0), *FILES[:2]).count() == 0


def test_query_equals_plain(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(str((d[0], *r)) for d, r in zip(texts, plain([t[1] for t in texts])))
    assert sorted(str(tuple(r)) for r in QUERIES["op12_token_alignment"](spark, sf).collect()) == want


@pytest.mark.parametrize("seed", range(20))
def test_merge_paths(seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(1, 400, rng.integers(1, 200)))
    b = np.unique(rng.integers(1, 400, rng.integers(1, 200)))
    b[-1] = a[-1] = 400
    shared = np.intersect1d(a, b)
    for piece in (1, 2, 7, 64, 1000):
        ga, gb, n = AL.group_numbers(a, b, piece)
        assert n == len(shared) and (ga == np.searchsorted(shared, a)).all() and (gb == np.searchsorted(shared, b)).all()
        at = np.arange(len(a) + len(b) + 1)
        merged = np.argsort(np.concatenate([a * 2, b * 2 + 1]))
        assert (AL.diagonals(a, b, at) == np.concatenate([[0], np.cumsum(merged < len(a))])).all()

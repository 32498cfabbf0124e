"""The training-data operators against brute-force versions, and on null, empty, repeated and odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from check import compare, duck
from tipoff.llm import fingerprints as FP
from tipoff.llm import language_id as LI
from tipoff.llm import line_dedup
from tipoff.llm import packing as PK
from tipoff.llm import quality as QU
from tipoff.llm import sharding as SH
from tipoff.llm.decontamination import decontaminated, find_benchmark, is_contaminated, n_hit
from tipoff.llm.graph import components
from tipoff.llm.licenses import scan_licenses
from tipoff.llm.line_dedup import line_classes, without_repeated_lines
from tipoff.llm.queries import ORACLES, QUERIES
from tipoff.llm.simhash_dedup import near_duplicates, one_of_each_group, within
from tipoff.llm.warc import archive, loser_tree
from tipoff.llm.wumanber import Searcher

# every odd row: nulls, an empty text, blanks, repeats, a very long text, and columns that clash with results
DDL = "doc_id long, text string, lang string, score double, spans string, n_words string, shard string, Fingerprint string"
LONG = " ".join(f"word{i % 977} Tail{i}" for i in range(30_000))
ROWS = [
    (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Same text here\nand a line"), (6, "Same text here\nand a line"),
    (6, "Same text here\nand a line"), (7, LONG), (None, "Released under the MIT License."), (8, "é x   naïve 12 🎉 <|endoftext|>"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "en", 0.5, "s", "n", "h", "f") for r in ROWS], DDL)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    verdict, _ = compare(spark, duck(sf), name, sf)
    assert verdict.startswith("ok"), verdict


def test_wu_manber_finds_all():
    rng = np.random.default_rng(1)
    text = rng.choice(list(b"ab "), 5000).astype("u1").tobytes()
    patterns = sorted({text[a : a + n] for a, n in zip(rng.integers(0, 4900, 60), rng.integers(1, 60, 60))} | {b"zzz", b"a" * 40})
    at, which = Searcher(patterns).search(text)
    got = sorted(zip(at.tolist(), which.tolist()))
    want = sorted((m.start(), i) for i, p in enumerate(patterns) for m in re.finditer(b"(?=" + re.escape(p) + b")", text))
    assert got == want


def test_decontamination_blocks_and_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([("a", "same text here"), ("b", None), ("c", "!!"), (None, "one"), ("d", "AND a, line")], "item_id string, text string")
    one = find_benchmark(odd, bench).select("doc_id", "n_words", n_hit().alias("n"), "items", is_contaminated().alias("bad"))
    many = find_benchmark(odd, bench, block_bytes=1).select(*one.columns[:2], n_hit().alias("n"), "items", is_contaminated().alias("bad"))
    rows = sorted(map(str, one.collect()))
    assert rows == sorted(map(str, many.collect())) and len(rows) == len(ROWS)
    by = {(r["doc_id"]): r for r in one.collect()}
    assert (by[6]["n"], by[6]["items"], by[4]["n"], by[4]["items"], by[1]["n_words"]) == (6, ["a", "d"], 1, [], 0)
    assert decontaminated(odd, bench).columns == odd.columns and decontaminated(odd, bench).count() == len(ROWS) - 4
    assert find_benchmark(nothing, bench).count() == 0 and decontaminated(odd, bench.limit(0)).count() == len(ROWS)


def test_quality(spark, sf, odd, nothing):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = QUERIES["op2_quality"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in scored]) > 0.9
    model = QU.fit_quality(docs, labels)
    rows = QU.quality_scores(odd, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
    assert QU.fit_quality(docs, labels.limit(0)).scores(np.zeros((1, len(QU.STATISTICS)))) == [0.5]
    assert QU.good_documents(nothing, model).columns == nothing.columns and QU.quality_scores(nothing, model).count() == 0


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 5))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.3)).astype(float)
    assert np.mean((QU.grow(x, y).scores(x) > 0.5) == y) > 0.98


def _simhash(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    parts = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))] if w else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def test_near_duplicates(spark, sf, documents, odd, nothing):
    got = {r["doc_id"]: r for r in near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    prints = {i: _simhash(t) for i, t in documents.items()}
    root = {i: i for i in prints}
    for _ in range(len(prints)):
        new = {i: min(root[j] for j in prints if (prints[i] ^ prints[j]).bit_count() <= 2) for i in prints}
        if new == root:
            break
        root = new
    assert all((got[i]["fingerprint"] % (1 << 64), got[i]["component_id"]) == (prints[i], root[i]) for i in prints)
    rows = near_duplicates(odd).collect()
    assert len(rows) == len(ROWS) and {r["component_id"] for r in rows if r["doc_id"] in (1, 2, 3)} == {1}
    kept = one_of_each_group(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "4", "5", "7", "8", "None"]
    assert near_duplicates(nothing).count() == 0


def test_one_of_each_group_by_jaccard(spark):
    """Edited copies at 0.8 and more go, those below stay, against brute force on five-word shingles."""
    rng = np.random.default_rng(5)
    rows, sets = [], []
    for g in range(60):
        base = [f"w{k}" for k in rng.integers(0, 5000, int(rng.integers(60, 400)))]
        for v in range(2):
            words = list(base)
            for at in rng.choice(len(words), v * int(rng.integers(1, 1 + len(words) // 25)), False):
                words[at] = f"new{at}"
            rows.append((2 * g + v, " ".join(words)))
            sets.append({tuple(words[i : i + 5]) for i in range(len(words) - 4)})
    like = [100 * len(sets[2 * g] & sets[2 * g + 1]) >= 80 * len(sets[2 * g] | sets[2 * g + 1]) for g in range(60)]
    assert 15 < sum(like) < 55
    kept = one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted([2 * g for g in range(60)] + [2 * g + 1 for g in range(60) if not like[g]])


def test_one_of_each_group_by_fingerprint(spark):
    """Texts whose fingerprints differ in two bits at most are one group, whatever their shingle sets."""
    tails = [" ".join(f"t{i}w{k}" for k in range(12)) for i in range(3)]
    rows = [(i, "a b c " * 100 + t) for i, t in enumerate(tails)] + [(9, "quite another text of some words")]
    assert len({_simhash(t) for _, t in rows}) == 2
    kept = one_of_each_group(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 9]


def test_bit_planes_find_all_pairs():
    rng = np.random.default_rng(2)
    values = rng.integers(0, 8, 300).astype("u8") | (rng.integers(0, 4, 300).astype("u8") << np.uint64(60))
    left = np.array([99 - i % 100 for i in range(300)])
    got = {(a, b) for i, j in within(values, left, 2) for a, b in zip(i.tolist(), j.tolist())}
    assert got == {(i, j) for i in range(300) for j in range(i + 1, i + left[i] + 1) if int(values[i] ^ values[j]).bit_count() <= 2}


def test_tiles_of_crowded_buckets(spark):
    from tipoff.llm.simhash_dedup import links

    prints = spark.range(200).select(F.col("id").alias("fingerprint"))
    roots = components(links(prints, tile=8))
    assert roots.count() == 199 and roots.select("root").distinct().count() == 1


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(70, 60), (60, 60), (None, 3), (70, 60)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 51)}, 70: 60}


def test_shards(spark, odd, nothing):
    rows = SH.uniform_shards(odd, 4).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert sorted(sizes.values()) == [2, 3, 3, 3] and Counter(r["text"] for r in rows) == Counter(t for _, t in ROWS)
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(n))
    assert SH.uniform_shards(nothing, 4).count() == 0
    matrix = SH.communication_matrix([5, 0, 7, 100], [38, 37, 37], 3)
    assert [sum(r) for r in matrix] == [5, 0, 7, 100] and [sum(c) for c in zip(*matrix)] == [38, 37, 37]


def test_hypergeometric_law():
    import random

    rng, n = random.Random(1), 20_000
    seen = Counter(SH.hypergeometric(rng, 6, 9, 5) for _ in range(n))
    for k in range(6):
        p = math.comb(6, k) * math.comb(9, 5 - k) / math.comb(15, 5)
        assert abs(seen[k] / n - p) < 4 * math.sqrt(p / n) + 1e-3


def test_languages(spark, sf, odd, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES["op5_language_id"](spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in got]) > 0.95
    model = LI.fit_languages(docs)
    rows = {r["doc_id"]: r for r in LI.predict_languages(odd, model).collect()}
    assert [rows[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(0 <= r["score"] <= 1 for r in rows.values())
    assert LI.predict_languages(odd, LI.fit_languages(nothing)).where("lang_pred = 'und'").count() == len(ROWS)
    assert LI.predict_languages(nothing, model).count() == 0


def test_licenses_on_odd_rows(spark, odd, nothing):
    rows = scan_licenses(odd).collect()
    assert len(rows) == len(ROWS)
    hit = [r for r in rows if r["labels"]]
    assert [(r["labels"], r["places"][0]["start"], r["score"]) for r in hit] == [(["mit"], 3, 1.0)]
    assert {r["n_words"] for r in rows if not (r["text"] or "").strip()} == {0} and scan_licenses(nothing).count() == 0


def test_wrapped_licenses(spark):
    texts = {
        "mit": "/* Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation\n * files (the Software)",
        "bsd": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following\r\n# conditions are met:",
        "mpl": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy",
        "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General\n\nPublic License as published",
    }
    rows = [(k, pre + t + post) for k, t in texts.items() for pre in ("", "word " * 250, "a b\n" * 700) for post in ("", "\nand more" * 200)]
    got = scan_licenses(spark.createDataFrame(rows, "name string, text string")).collect()
    assert [r["name"] for r in got if r["labels"] != [r["name"]]] == [] and len(got) == len(rows)
    far = [("far", "Released the notes.\n" + "word " * 60 + "under the table\n" + "word " * 60 + "license of mit")]
    assert scan_licenses(spark.createDataFrame(far, "name string, text string")).first()["labels"] == []


def test_other_licenses_have_no_label(spark):
    texts = ["Licensed under CC BY 4.0.", "Licensed under CC BY-SA 4.0.", "Released under the Apache License.", "Released under the BSD License.",
             "We released it under the old name. The license of 1990 is gone", "Released notes of mit" + " of the house" * 20 + " under license"]
    right = {"Licensed under CC BY-NC 4.0": ["cc-by-nc"], "Licensed under the Apache License": ["apache"], "Released by us under the\nMIT license": ["mit"]}
    rows = [(t, []) for t in texts if "Apache" not in t] + [(texts[2], ["apache"]), *right.items()]
    got = scan_licenses(spark.createDataFrame(rows, "text string, want array<string>")).collect()
    assert [(r["text"], r["labels"]) for r in got if r["labels"] != r["want"]] == [] and len(got) == len(rows)


def test_fingerprints_on_odd_rows(spark, odd, nothing):
    rows = FP.fingerprint_documents(odd).collect()
    assert len(rows) == len(set(ROWS)) and FP.fingerprint_documents(nothing).count() == 0
    same = {r["fingerprint"] for r in rows if r["doc_id"] in (5, 6)}
    assert len(same) == 1 and all(0 <= r["near_next"] <= 1 for r in rows)


def test_search_within_radius(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(-(1 << 62), 1 << 62, 30)
    values = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, m, False)) for b in base for m in range(6)]
    prints = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    got = {tuple(r) for r in FP.within_radius(prints.limit(60), prints).collect()}
    asked = [r[0] for r in prints.limit(60).collect()]
    assert got == {(q, v) for q in asked for v in values if ((q ^ v) % (1 << 64)).bit_count() <= 3}


def test_archives(spark, nothing, tmp_path):
    pages = spark.createDataFrame(
        [(3, "http://b.org/x", "hé"), (1, "http://a.org/y z", "hé"), (2, None, None), (5, "", ""), (None, "http://c.d/", "q"), (9, "no url", "x\r\n\r\ny" * 9000)],
        "page_id long, url string, html string",
    )
    rows = archive(pages, str(tmp_path / "w")).orderBy("part", "position").collect()
    kinds = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in rows}
    assert kinds == {1: ("response", None, 3), 3: ("revisit", 1, 3), 2: ("response", None, 0), 5: ("revisit", 2, 0), None: ("response", None, 1), 9: ("response", None, 54000)}
    order = [(r["url_key"], r["captured"]) for r in rows]
    assert order == sorted(order) and rows[-1]["length"] > 0
    assert archive(pages.limit(0), str(tmp_path / "e")).count() == 0


def test_loser_tree_merges():
    rng = np.random.default_rng(5)
    for k in range(6):
        runs = [sorted(rng.integers(0, 20, rng.integers(0, 9)).tolist()) for _ in range(k)]
        walks = [iter(r) for r in runs]
        assert [next(walks[i]) for i in loser_tree(runs)] == sorted(x for r in runs for x in r)


def test_line_classes(spark, sf, documents, odd, nothing):
    got = {(r["doc_id"], r["line_no"]): (r["keeper_doc_id"], r["keeper_line_no"]) for r in QUERIES["op9_line_dedup"](spark, sf).collect()}
    places, sets = defaultdict(list), {}
    for i, t in documents.items():
        for k, line in enumerate(t.split("\n")):
            if re.search(r"\S", line):
                places[line].append((i, k))
                sets[line] = {line[n : n + 12] for n in range(max(1, len(line) - 11))}
    lines, root = list(sets), list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(lines)):
        for j in range(i):
            both = len(sets[lines[i]] & sets[lines[j]])
            if 100 * both >= 80 * (len(sets[lines[i]]) + len(sets[lines[j]]) - both):
                root[find(i)] = find(j)
    first = {}
    for i, line in enumerate(lines):
        first[find(i)] = min(first.get(find(i), (1 << 60, 0)), min(places[line]))
    want = {p: first[find(i)] for i, line in enumerate(lines) for p in places[line]}
    assert set(got) == set(want) and sum(got[p] == want[p] for p in want) >= 0.995 * len(want)
    assert line_classes(nothing).count() == 0
    clean = {(r["doc_id"], i): r for i, r in enumerate(without_repeated_lines(odd).orderBy("doc_id").collect())}
    texts = [r["text"] for r in clean.values() if r["doc_id"] in (5, 6)]
    assert len(clean) == len(ROWS) and sorted(texts) == ["", "", ROWS[5][1]]
    assert without_repeated_lines(nothing).columns == nothing.columns


def test_crowded_buckets_of_lines(spark):
    """Lines of many groups meet in the same buckets; each group is one class whichever lines are the ends of a bucket."""
    common = [f"commonword{i:02d}" for i in range(50)]
    rows = [
        (10 * g + v, " ".join(common + [f"g{g:04d}word{i:03d}" for i in range(8)] + [f"g{g:04d}rest{v:03d}"]))
        for g in range(200)
        for v in range(2)
    ]
    got = line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["keeper_doc_id"]) for r in got} == {(i, i - i % 10) for i, _ in rows}


def test_variants_of_a_line_meet_in_few_pairs(spark, monkeypatch):
    """Lines like one line, not like each other, are one class with it; without it they are apart. Neither takes all pairs."""
    rng, letters, rows, pairs = np.random.default_rng(9), list("abcdefghijklmnopqrstuvwxyz "), [], []
    for group, with_base in ((0, True), (10_000, False)):
        base = "".join(rng.choice(letters, 133))
        variants = [base[:at] + c + base[at + 1 :] for at in range(14, 119, 13) for c in "0123456789"]
        variants += [base[:at] + "!" + base[at + 1 :] for at in range(14, 119)]
        rows += [(group + i, line) for i, line in enumerate([base] * with_base + variants)]
    sets = {i: {line[n : n + 12] for n in range(122)} for i, line in rows}
    apart = line_dedup._apart

    def counted(*args):
        met = apart(*args)
        pairs.append(met.count())
        return met

    monkeypatch.setattr(line_dedup, "_apart", counted)
    got = line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    first = [r for r in got if r["doc_id"] < 10_000]
    assert sum(r["keeper_doc_id"] == 0 for r in first) >= 0.98 * len(first)
    assert all(len(sets[0] & sets[r["doc_id"]]) >= 0.8 * len(sets[0] | sets[r["doc_id"]]) for r in first)
    assert all(r["keeper_doc_id"] >= 10_000 for r in got if r["doc_id"] >= 10_000)
    assert sum(pairs) < 10 * len(rows)


def test_lines_of_long_words(spark):
    """URLs, text without blanks and long tokens, against brute force on the shingles at all positions."""
    han = "\u6771\u4eac\u3067\u4eca\u65e5\u306f\u96e8\u304c\u964d\u308a\u307e\u3057\u305f"
    lines = [
        "https://www.example.com/alpha", "https://www.example.com/omega/entirely/other", "https://www.example.com/omega/entirely/other1",
        han + "\u5098\u3092\u6301\u3063\u3066\u51fa\u304b\u3051\u305f", han + "\u8a66\u5408\u306f\u4e2d\u6b62\u306b\u306a\u3063\u305f\u3068\u805e\u3044\u305f",
        "commit_" + "0123456789abcdef" * 2, "commit_" + "0123456789abfedc" * 2, "x" * 12 + "y", "x" * 12 + "z", "exactly12abc", "exactly12abcd",
    ]
    sets = [{x[i : i + 12] for i in range(len(x) - 11)} for x in lines]
    root = list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    got = line_classes(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["keeper_doc_id"] for r in got} == {i: root.index(root[i]) for i in range(len(lines))}
    assert len(set(root)) == len(lines) - 1


def test_recall_of_line_pairs(spark):
    """Pairs of random lines with some letters changed: nine of ten at 0.8 or more are linked at each length, none below."""
    rng, letters = np.random.default_rng(4), "abcdefghijklmnopqrstuvwxyz"

    def sets(line):
        return {line[n : n + 12] for n in range(max(1, len(line) - 11))}

    rows, like = [], defaultdict(list)
    for words in (5, 8, 15, 40):
        while len(like[words]) < 100:
            line = " ".join("".join(rng.choice(list(letters), rng.integers(2, 10))) for _ in range(words))
            other = list(line)
            for at in rng.integers(0, len(line), 1 + words // 15) if rng.random() < 0.7 else [len(line) - 1]:
                other[at] = letters[rng.integers(26)]
            a, b = sets(line), sets("".join(other))
            if line == "".join(other) or len(a & b) / len(a | b) < 0.6:
                continue
            like[words].append((len(rows), 100 * len(a & b) >= 80 * len(a | b)))
            rows += [(len(rows), line), (len(rows) + 1, "".join(other))]
    keeper = {r["doc_id"]: r["keeper_doc_id"] for r in line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for words, pairs in like.items():
        near = [keeper[i + 1] == i for i, alike in pairs if alike]
        assert len(near) > 20 and sum(near) >= 0.9 * len(near), (words, sum(near), len(near))
        assert not any(keeper[i + 1] == i for i, alike in pairs if not alike)
        print("recall", words, sum(near), len(near))


def test_packing(spark, sf, documents, odd, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    rows = QUERIES["op10_packing"](spark, sf).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for i, text in documents.items():
        ids, at = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [0], "<u4"), 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for held in sequences.values():
        ends = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == ends
            ends += r["length"]
        assert ends <= 1024
    assert sum(r["length"] for r in rows) > 0.95 * 1024 * len(sequences)
    path = str(public_tokenizers.path("byte_bpe_50k.json"))
    packed = PK.pack(odd, path, ranks_path=str(public_tokenizers.path("byte_bpe_50k.tiktoken"))).collect()
    assert sum(len(r["ids"]) // 4 for r in packed) == sum(len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in ROWS)
    assert PK.pack(nothing, path).count() == 0


def test_packed_ids_of_special_and_plain_strings(spark):
    """The ids of both libraries agree, and the string of a special token is that token, also in a text of plain letters."""
    from tokenizers import Tokenizer

    path, ranks = str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(4)
    letters = "aAbeéñſ z019 \n.,-'<|>_" + "".join(map(chr, range(0xA1, 0x250, 7)))
    cases = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext|", "漢 <|endoftext|>"]
    cases += ["".join(rng.choices(letters, k=rng.randint(1, 60))) for _ in range(3000)]
    encode = PK.encoder(path, ranks, special=True).ids
    for text in cases:
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids, text
    packed = PK.pack(spark.createDataFrame([(1, cases[0])], "doc_id long, text string"), path, ranks_path=ranks).first()
    assert np.frombuffer(packed["ids"], "<u4").tolist() == [64, 220, 50256, 275, 0]
    assert PK.encoder(path, ranks).ids(cases[0]) == [64, 1279, 91, 437, 1659, 5239, 91, 29, 275]


def test_differencing():
    groups = PK.difference([8, 7, 6, 5, 4], 2)
    assert sorted(i for g in groups for i in g) == list(range(5)) and {sum([8, 7, 6, 5, 4][i] for i in g) for g in groups} == {14, 16}
    sizes = np.random.default_rng(3).integers(1, 257, 500).tolist()
    made = PK.windows(sizes, 1024)
    assert sorted(i for g in made for i in g) == list(range(500)) and max(sum(sizes[i] for i in g) for g in made) <= 1024
    assert len(made) <= sum(sizes) // 1024 + 2 and PK.windows([], 10) == []


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {name: None for name, _ in corpus_pipeline.STAGES}
    for name, stage in corpus_pipeline.STAGES:
        docs_out = stage(spark, docs, sf)
        kept[name] = docs_out.count()
        if name != "packing":
            assert docs_out.columns == docs.columns
            docs = docs_out
    assert kept["quality"] >= kept["near_duplicates"] >= kept["decontamination"] > 0
    assert corpus_pipeline.run(spark, sf).agg(F.countDistinct("doc_id")).first()[0] == kept["decontamination"]

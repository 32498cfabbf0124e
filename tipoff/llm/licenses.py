"""License scan: exact set-similarity join of windows of words with license templates, with DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tipoff.llm.common import named

# Phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# License notices, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
)

# Words without which a text is no notice of the label, whatever else it shares with a template.
REQUIRED = {
    "mit": ({"mit"}, {"associated"}), "apache": ({"apache"},), "gpl": ({"general", "public"},), "bsd": ({"redistribution", "binary"},),
    "cc-by-nc": ({"cc", "nc"},), "cc-by": ({"creative", "commons", "attribution"},), "mpl": ({"mozilla"},),
}

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Window starts of one block of words.
_STEP = 256


def _needed(size: int, percent: int) -> int:
    return max(1, -(-size * percent // 100))


def _text(docs: DataFrame, text_col: str) -> Column:
    # Lower-casing beyond A-Z leaves word boundaries and the ASCII words of phrases and templates as they are.
    return F.lower(F.coalesce(named(text_col).cast("string"), F.lit("")))


def _words(docs: DataFrame, text_col: str) -> DataFrame:
    """The words of each text in order, with the hashes that name the text."""
    text = named(text_col).cast("string")
    return docs.select(F.xxhash64(text).alias("h"), F.crc32(text.cast("binary")).alias("c"), F.split(_text(docs, text_col), _GAP).alias("words"))


def _required(label: str, words: list[str]) -> list[str]:
    """The first set of the label's required words that the template holds itself; none for other labels."""
    return sorted(next((r for r in REQUIRED.get(label, ()) if r <= set(words)), ()))


def _window(text: str) -> int:
    """Words of a text in which a template is looked for: its own number and a quarter more."""
    n = len(re.findall(_WORD, text.lower()))
    return n + 2 + n // 4


def template_matches(
    docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, *, percent: int = 80, text_col: str = "text"
) -> DataFrame:
    """(`h`, `c`, `label`, `share`): texts, by two hashes, with a window that holds `percent` of a template's words or more.

    A window is a run of words little longer than the template; it slides word by word over line ends. The words of
    `REQUIRED` that tell the template from other notices must be among those it holds. Texts are cut
    into blocks of `_STEP` window starts that overlap by a window, so each window lies whole in one block, and a block is
    held against a template before its windows are.

    Words are ordered by their count over all documents, rarest first. A block with such a window shares
    one of the first |T| - needed + 1 words of the template (prefix filter); it holds at least `needed` template
    words (length filter); and where its first shared word stands, enough words follow on both sides (positional
    filter). Words of no template cannot count, so they stand before all others and blocks are compared without
    them. The join is on the prefix words only, a table bounded by the templates; what passes is counted exactly,
    window by window.
    """
    spark = docs.sparkSession
    sets = [(label, sorted(set(re.findall(_WORD, text.lower()))), _window(text)) for label, text in templates]
    vocabulary = sorted({w for _, words, _ in sets for w in words})
    texts = _words(docs, text_col)
    # one number for each template word: bounded by the templates
    seen = texts.select(F.explode("words").alias("word")).where(F.col("word").isin(vocabulary)).groupBy("word").count()
    counts = dict(map(tuple, seen.collect()))
    order = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    rank, prefixes = {w: i for i, w in enumerate(order)}, []
    for number, (label, words, window) in enumerate(sets):
        words, need = sorted(words, key=rank.__getitem__), _needed(len(words), percent)
        prefixes += [(w, number, label, words, need, i, window, _required(label, words)) for i, w in enumerate(words[: len(words) - need + 1])]
    ddl = "word string, template int, label string, holds array<string>, need int, at int, window int, must array<string>"
    prefix = spark.createDataFrame(prefixes, ddl)
    reach = max(window for _, _, window in sets) - 1
    starts = F.sequence(F.lit(1), F.greatest(F.size("words"), F.lit(1)), F.lit(_STEP))
    blocks = texts.select("h", "c", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.lit(_STEP + reach)))).alias("words"))
    first_words = F.array([F.lit(w) for w in sorted({p[0] for p in prefixes})])
    met = blocks.select("h", "c", "words", F.explode(F.array_intersect(first_words, "words")).alias("word"))
    met = met.join(F.broadcast(prefix), "word")
    met = met.withColumn("own", F.array_intersect(F.array([F.lit(w) for w in order]), "words"))
    after = F.least(F.size("holds") - F.col("at"), F.size("own") - F.array_position("own", F.col("word")).cast("int") + 1)
    both = F.size(F.array_intersect("holds", "own"))
    kept = met.where(F.size("own") >= F.col("need")).where(after >= F.col("need")).where(both >= F.col("need"))
    kept = kept.where(F.size(F.array_intersect("must", "own")) == F.size("must"))
    one = kept.select("h", "c", "template", "label", "holds", "need", "must", "window", "words").distinct()
    places = F.sequence(F.lit(1), F.greatest(F.size("words") - F.col("window") + 1, F.lit(1)))
    windows = F.transform(places, lambda i: F.array_intersect("holds", F.slice("words", i, F.col("window"))))
    meant = F.filter(windows, lambda w: F.size(F.array_intersect("must", w)) == F.size("must"))
    found = F.array_max(F.transform(meant, lambda w: F.size(w)))
    held = one.withColumn("found", found).where(F.col("found") >= F.col("need"))
    return held.groupBy("h", "c", "label").agg(F.max(F.col("found") / F.size("holds")).alias("share"))


def scan_licenses(docs: DataFrame, *, text_col: str = "text", **options) -> DataFrame:
    """`docs` with `n_words`, `places` (array of phrase, start word), `base_labels`, `labels` (arrays) and `score`.

    `places` are all runs of a phrase's words; `labels` adds those of the templates that a window of words meets. The score
    is 1 where a phrase stands, else the greatest share of a met template's words, else 0. Texts are named by two hashes to
    join what the templates met; copies share one row there, whatever their number.

    A null text is an empty one: no words, no labels, score 0. Rows that repeat are each scanned. An empty table
    gives no rows. Input columns called like a result are replaced.
    """
    made = ("n_words", "places", "base_labels", "labels", "score")
    own = [c for c in docs.columns if c.lower() not in made]
    text = f"c{own.index(text_col)}"
    inner = docs.select([named(c).alias(f"c{i}") for i, c in enumerate(own)])
    met = template_matches(inner, text_col=text, **options).groupBy("h", "c").agg(
        F.collect_set("label").alias("met"), F.max("share").alias("share")
    )
    low, raw = _text(inner, text), F.col(text).cast("string")
    pieces = F.split(low, _GAP)  # empty pieces stand at the ends only
    empty_ends = F.when(F.get(pieces, 0) == "", 1).otherwise(0) + F.when((F.size(pieces) > 1) & (F.element_at(pieces, -1) == ""), 1).otherwise(0)
    words = F.filter(pieces, lambda w: w != "")

    def runs(phrase: str) -> Column:
        parts = phrase.split(" ")
        all_words = F.col("words")
        at = F.filter(
            F.sequence(F.lit(0), F.greatest(F.size(all_words) - 1, F.lit(0))),
            lambda i: F.forall(
                F.array([F.struct(F.lit(k).alias("k"), F.lit(p).alias("p")) for k, p in enumerate(parts)]),
                lambda x: F.coalesce(F.get(all_words, i + x["k"]) == x["p"], F.lit(False)),
            ),
        )
        return F.transform(at, lambda i: F.struct(F.lit(phrase).alias("phrase"), i.cast("long").alias("start")))

    none = F.array().cast("array<struct<phrase:string,start:bigint>>")
    lasts = {p.split(" ")[-1] for p in PHRASES}
    may = F.greatest(*[F.contains(low, F.lit(w)) for w in lasts]) if len(lasts) > 1 else F.contains(low, F.lit(next(iter(lasts))))
    scanned = (
        inner.withColumns({
            "h": F.xxhash64(raw), "c": F.crc32(raw.cast("binary")), "n_words": (F.size(pieces) - empty_ends).cast("long"),
            "words": F.when(may, words),
        })
        .withColumn("places", F.when(F.col("words").isNull(), none).otherwise(F.concat(*[runs(p) for p in PHRASES])))
        .drop("words")
    )
    label = F.create_map([F.lit(x) for pair in PHRASES.items() for x in pair])
    base = F.array_sort(F.array_distinct(F.transform("places", lambda p: label[p["phrase"]])))
    joined = scanned.join(met, (scanned["h"] == met["h"]) & (scanned["c"] == met["c"]), "left")
    empty = F.array().cast("array<string>")
    return joined.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(own)],
        "n_words",
        "places",
        base.alias("base_labels"),
        F.array_sort(F.array_union(base, F.coalesce("met", empty))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )

"""Benchmark decontamination: Wu-Manber search for benchmark windows in whole documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipoff.llm.common import named, texts, with_arrow
from tipoff.llm.wumanber import Searcher

# Fixed values of the word rule: A-Z are lower-cased; a word is a run of digits, letters a-z and bytes from 0x80.
_WORD = b"0123456789abcdefghijklmnopqrstuvwxyz"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TO = bytes(c + 32 if c in _UPPER else c if c in _WORD or c >= 0x80 else 32 for c in range(256))

FIELDS = (
    T.StructType()
    .add("n_words", T.LongType())
    .add("spans", T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType())))
    .add("items", T.ArrayType(T.StringType()))
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_TO).split()


def windows(items: list[tuple[str | None, bytes]], size: int) -> tuple[list[bytes], list[int], list[list[str]]]:
    """Distinct windows as bytes with a blank at each end, their numbers of words, and the items that hold them."""
    owners: dict[bytes, set[str]] = {}
    for item, text in items:
        found = words(text)
        for i in range(max(1, len(found) - size + 1) if found else 0):
            held = owners.setdefault(b" %b " % b" ".join(found[i : i + size]), set())
            if item is not None:
                held.add(item)
    return list(owners), [p.count(b" ") - 1 for p in owners], [sorted(o) for o in owners.values()]


def blocks(benchmark: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """The benchmark in blocks of at most `most` bytes of text (or one longer text), fetched one after the other."""
    block, size = [], 0
    rows = benchmark.select(named(id_col).cast("string").alias("i"), named(text_col).cast("string").alias("t"))
    for row in rows.where(F.col("t").isNotNull()).toLocalIterator():
        text = row["t"].encode("utf-8", "surrogatepass")
        if block and size + len(text) > most:
            yield block
            block, size = [], 0
        block.append((row["i"], text))
        size += len(text)
    if block:
        yield block


def _mark(docs: list[bytes], before: list, searcher: Searcher, lengths: np.ndarray, owners: list[list[str]]):
    """Number of words, hit spans and items of each text; `before`: (spans, items) found by earlier blocks."""
    parts = [b" %b \n" % b" ".join(w) if (w := words(d)) else b"\n" for d in docs]
    text = b"".join(parts)
    blanks = np.flatnonzero(np.frombuffer(text, "u1") == 32)
    starts = np.cumsum([0, *map(len, parts)])
    first = np.searchsorted(blanks, starts)  # number of blanks before each text; word j lies behind blank first + j
    at, which = searcher.search(text)
    from_blank, steps = np.searchsorted(blanks, at), np.zeros(len(blanks) + 1, "i8")
    np.add.at(steps, from_blank, 1)
    np.add.at(steps, from_blank + lengths[which], -1)
    items: list[set[str]] = [set() for _ in docs]
    for d, w in set(zip((np.searchsorted(starts, at, "right") - 1).tolist(), which.tolist())):
        items[d].update(owners[w])
    for d, (spans, held) in enumerate(before):
        items[d].update(held or ())
        for s in spans or ():
            steps[first[d] + s["start"]] += 1
            steps[first[d] + s["end"]] -= 1
    hit = np.concatenate([[0], (np.cumsum(steps) > 0).astype("i1")])
    edges = np.diff(hit)
    on, off = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)  # a text's last blank is never hit
    cut = np.searchsorted(on, first)
    spans = [
        [{"start": a, "end": b} for a, b in zip((on[i:j] - f).tolist(), (off[i:j] - f).tolist())]
        for i, j, f in zip(cut, cut[1:], first)
    ]
    n_words = np.maximum(np.diff(first) - 1, 0)
    return n_words, spans, [sorted(x) for x in items]


def find_benchmark(
    docs: DataFrame, benchmark: DataFrame, *, window: int = 13, text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", block_bytes: int = 1 << 20,
) -> DataFrame:
    """`docs` with `n_words`, `spans` (word ranges, end excluded, inside any benchmark window) and `items`.

    A window is `window` words in a row of an item, or all words of a shorter item. The benchmark is broadcast
    in blocks of at most `block_bytes` of text; each block is one pass in the same task, without a shuffle,
    and adds to what the blocks before it found. No rows leave their partition and no text is cut.

    A null or empty text has 0 words, no spans and no items. Items with null text or no words have no window;
    the windows of an item with a null id count as hits but name no item. Rows that repeat are each marked. An
    empty benchmark marks nothing. Input columns called `n_words`, `spans` or `items` are replaced.
    """
    context = docs.sparkSession.sparkContext

    def marked(df: DataFrame, block: list[tuple[str | None, bytes]], again: bool) -> DataFrame:
        shared = context.broadcast(windows(block, window))
        built: list = []

        def mark(batch: pa.RecordBatch) -> list[pa.Array]:
            if not built:
                patterns, lengths, owners = shared.value
                built.append((Searcher(patterns), np.array(lengths, "i8"), owners))
            column = lambda n: batch.column(batch.schema.get_field_index(n)).to_pylist()
            before = list(zip(column(earlier[0]), column(earlier[1]))) if again else []
            n_words, spans, items = _mark(texts(batch, text_col), before, *built[0])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            return [pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array(items, pa.list_(pa.string()))]

        earlier = ("_spans_before", "_items_before")
        if again:
            df = df.withColumnsRenamed({"spans": earlier[0], "items": earlier[1]})
        out = with_arrow(df, FIELDS, mark, text_col)
        return out.drop(*earlier) if again else out

    out, again = docs, False
    for block in blocks(benchmark, item_id, item_text, block_bytes):
        out, again = marked(out, block, again), True
    return out if again else marked(out, [], False)


def n_hit() -> Column:
    """Number of words inside the spans."""
    return F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def is_contaminated() -> Column:
    """The contamination rule: some words are hit, and at least a twentieth of all."""
    return (n_hit() > 0) & (20 * n_hit() >= F.col("n_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of `docs`, with their own columns, that the contamination rule leaves.

    Nulls, ties, repeats and empty tables are treated as in `find_benchmark`.
    """
    own = docs.columns
    inner = docs.select([named(c).alias(f"c{i}") for i, c in enumerate(own)])
    text = f"c{own.index(options.pop('text_col', 'text'))}"
    kept = find_benchmark(inner, benchmark, text_col=text, **options).where(~is_contaminated())
    return kept.select([F.col(f"c{i}").alias(c) for i, c in enumerate(own)])

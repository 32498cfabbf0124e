"""Near-duplicates: SimHash fingerprints compared bit plane by bit plane, and texts linked by the exact Jaccard index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipoff.llm.common import named, texts, with_arrow
from tipoff.llm.graph import components
from tipoff.llm.line_dedup import linked_keys
from tipoff.session import pinned

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# Rows of one comparison; a block never splits a unit.
_BLOCK = 1 << 15
# Planes between two looks at which words still hold a pair within the radius.
_PLANES = 8


def shingle_hashes(raw: bytes, shingle: int) -> np.ndarray:
    """Hashes of the word shingles of a text in order; one of all words if there are no more; none without words."""
    words = raw.translate(_LOWER).split()
    if not words:
        return np.empty(0, "<u8")
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], "<u8")
    text, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-shingle]]).tolist()
    h = xxhash.xxh64_intdigest
    return np.array([h(text[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist())], "<u8")


def fingerprint(raw: bytes, shingle: int) -> int:
    """Bits set in over half the hashes of the word shingles of a text; zero without words."""
    hashes = shingle_hashes(raw, shingle)
    votes = np.zeros(64, "i8")
    for i in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[i : i + (1 << 16)].view("u1").reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(0, dtype="u4")
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, shingle: int = 3, name: str = "fingerprint", text_col: str = "text") -> DataFrame:
    """`docs` with the 64-bit fingerprint of each whole text as a signed long.

    Null and empty texts have fingerprint 0. An input column called `name` is replaced.
    """

    def hashed(batch: pa.RecordBatch) -> list[pa.Array]:
        made = np.array([fingerprint(t, shingle) for t in texts(batch, text_col)], "u8")
        return [pa.array(made.view("i8"), pa.int64())]

    return with_arrow(docs, T.StructType().add(name, T.LongType()), hashed, text_col)


def planes(values: np.ndarray) -> np.ndarray:
    """Bit b of value i is bit i % 64 of word i // 64 in row b; zero words follow the last."""
    n = len(values)
    bits = np.unpackbits(values.view("u1").reshape(n, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    words = np.zeros((64, (n // 64 + 2) * 8), "u1")
    words[:, : packed.shape[1]] = packed
    return words.view("<u8")


def within(values: np.ndarray, left: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of rows of one unit with at most `radius` differing bits, for one distance j - i at a time.

    `left[i]` is the number of rows after i in its unit. The planes are held against themselves shifted by the
    distance, 64 pairs a word: a carry-save counter adds the differences, and words drop out once all their
    pairs exceed the radius.
    """
    n = len(values)
    if not n or not left.max():
        return
    vertical, digits = planes(values), (radius + 1).bit_length()
    n_words = n // 64 + 1
    padded = np.zeros(n_words * 64, "i8")
    padded[:n] = left
    by_word = padded.reshape(n_words, 64)
    most = by_word.max(1)
    for d in range(1, int(left.max()) + 1):
        live = np.flatnonzero(most >= d)
        pairs = np.packbits(by_word[live] >= d, axis=1, bitorder="little").view("<u8")[:, 0]
        q, r = divmod(d, 64)
        counts, beyond = [np.zeros(len(live), "u8") for _ in range(digits)], np.zeros(len(live), "u8")
        # words past the end read the zero words there; no pair reaches them
        last = vertical.shape[1] - 1
        for p in range(64):
            row = vertical[p]
            other = row[np.minimum(live + q, last)]
            if r:
                other = (other >> np.uint64(r)) | (row[np.minimum(live + q + 1, last)] << np.uint64(64 - r))
            carry = row[live] ^ other
            for k in range(digits):
                counts[k], carry = counts[k] ^ carry, counts[k] & carry
            beyond |= carry
            if p % _PLANES == _PLANES - 1:
                over, equal = beyond, ~np.zeros(len(live), "u8")
                for k in reversed(range(digits)):
                    if radius >> k & 1:
                        equal = equal & counts[k]
                    else:
                        over, equal = over | (equal & counts[k]), equal & ~counts[k]
                pairs = pairs & ~over
                keep = pairs != 0
                if not keep.all():
                    live, pairs, beyond, counts = live[keep], pairs[keep], beyond[keep], [c[keep] for c in counts]
                    if not len(live):
                        break
        if len(live):
            bits = np.unpackbits(pairs.view("u1").reshape(-1, 8), axis=1, bitorder="little")
            word, bit = np.nonzero(bits)
            i = live[word] * 64 + bit
            yield i, i + d


def forest(values: np.ndarray, left: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Of the pairs within the radius, those that first join two groups of rows."""
    parent, label = list(range(len(values))), np.arange(len(values))
    a, b = [], []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in within(values, left, radius):
        new = label[i] != label[j]
        if not new.any():
            continue
        for x, y in zip(i[new].tolist(), j[new].tolist()):
            rx, ry = find(x), find(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                a.append(x)
                b.append(y)
        label = np.array(parent)
        while (label[label] != label).any():
            label = label[label]
    return a, b


def _unit_edges(radius: int):
    """Edges within each unit (`t`, `key`, `lo`, `hi`), whose rows come one after the other."""

    def edges(held: list[np.ndarray], stop: int) -> pa.RecordBatch:
        unit, values = held[0][:stop], held[1][:stop]
        changes = np.flatnonzero((unit[1:] != unit[:-1]).any(1)) + 1
        ends = np.concatenate([changes, [stop]])
        left = np.repeat(ends, np.diff(np.concatenate([[0], ends]))) - 1 - np.arange(stop)
        a, b = forest(values, left, radius)
        signed = values.view("i8")
        return pa.RecordBatch.from_arrays([pa.array(signed[a]), pa.array(signed[b])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, values = np.empty((0, 4), "i8"), np.empty(0, "u8")
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]
            unit = np.concatenate([unit, np.column_stack(cols[:4])])
            values = np.concatenate([values, cols[4].view("u8")])
            if len(values) >= _BLOCK:  # the last unit may go on in the next batch
                other = np.flatnonzero((unit != unit[-1]).any(1))
                stop = int(other[-1]) + 1 if len(other) else 0
                if stop:
                    yield edges([unit, values], stop)
                    unit, values = unit[stop:], values[stop:]
        if len(values):
            yield edges([unit, values], len(values))

    return run


def links(prints: DataFrame, *, name: str = "fingerprint", radius: int = 2, tile: int = 2048) -> DataFrame:
    """Edges (`a`, `b`) between distinct fingerprints that connect all pairs within `radius` bits, and no others.

    The 64 bits fall into radius + 3 blocks; two fingerprints within the radius agree on three of them, so each
    choice of three is a table whose buckets hold every pair at least once. A bucket of more than `tile`
    fingerprints is dealt over tiles by a hash, and each pair of tiles is a unit of its own; no task holds a
    whole bucket, and no bucket is cut. Each unit gives at most one edge fewer than it has rows.
    """
    n_blocks = radius + 3
    cuts = [64 * i // n_blocks for i in range(n_blocks + 1)]
    masks = []
    for chosen in combinations(range(n_blocks), 3):
        bits = sum(((1 << (cuts[c + 1] - cuts[c])) - 1) << cuts[c] for c in chosen)
        masks.append(bits - (1 << 64) if bits >> 63 else bits)
    distinct = prints.select(F.col(name).alias("fp")).distinct()
    keyed = distinct.select(
        "fp",
        F.posexplode(F.array([F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in masks])).alias("t", "key"),
    )
    crowded = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / tile).cast("long")
    own = F.pmod(F.xxhash64("fp"), F.col("g"))
    units = (
        keyed.join(crowded, ["t", "key"])
        .withColumn("g", tiles)
        .withColumn("i", own)
        .withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
        .where("g = 1 or i <> j")
        .select(F.col("t").cast("long"), "key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "fp")
        .repartition("t", "key", "lo", "hi")
        .sortWithinPartitions("t", "key", "lo", "hi", "fp")
    )
    return units.mapInArrow(_unit_edges(radius), "a long, b long").distinct()


def near_duplicates(
    docs: DataFrame, *, shingle: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(`doc_id`, `fingerprint`, `component_id`) for each row: the least id reachable over links within the radius.

    Null and empty texts share fingerprint 0 and link like any other. Null ids take part in links but name no
    component; a component of null ids only has a null id. Rows that repeat are returned as often as they come.
    Only distinct fingerprints are compared; documents are never paired.
    """
    mine = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))
    prints = pinned(fingerprints(mine, shingle=shingle).select("doc_id", "fingerprint"))
    least = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    roots = components(links(prints, radius=radius)).withColumnRenamed("node", "fingerprint")
    placed = least.join(roots, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named_roots = placed.select("fingerprint", "root").join(smallest, "root").select("fingerprint", "component_id")
    return prints.join(named_roots, "fingerprint").select("doc_id", "fingerprint", "component_id")


def _shingle_set(raw: bytes, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of a text, ascending; all texts without words share one set."""
    hashes = np.unique(shingle_hashes(raw, shingle))
    return hashes if len(hashes) else np.zeros(1, "<u8")


def minhash_bands(hashes: np.ndarray, count: int, rows: int) -> list[int]:
    """`count` signed hashes of `rows` independent minima each; sets of similarity s share one with 1 - (1 - s ** rows) ** count."""
    rng = np.random.default_rng(64)
    flips, factors = rng.integers(0, 1 << 64, (2, count * rows, 1), "u8")
    factors |= np.uint64(1)
    least = np.full(count * rows, (1 << 64) - 1, "u8")
    for i in range(0, len(hashes), 1 << 12):
        mixed = (hashes[i : i + (1 << 12)] ^ flips) * factors
        mixed ^= mixed >> np.uint64(32)
        least = np.minimum(least, (mixed * factors).min(1))
    held = least.astype("<u8").reshape(count, rows)
    made = np.array([xxhash.xxh64_intdigest(r.tobytes(), j) for j, r in enumerate(held)], "u8")
    return made.view("i8").tolist()


def similar_texts(texts_of: DataFrame, *, shingle: int = 5, count: int = 20, rows: int = 5, percent: int = 80) -> DataFrame:
    """(`node`, `root`) for the keys of texts (`key`, `text`) linked with a smaller key, the root of their component.

    Links join texts whose sets of word shingles have a Jaccard index of `percent` or more, exact from the whole
    sets. Candidates share one of `count` bands of minima: 99.96 % of the pairs at 0.8, and more above.
    """
    names = [f"b{j}" for j in range(count)]

    def signed(batch: pa.RecordBatch) -> list[pa.Array]:
        made = [minhash_bands(_shingle_set(t, shingle), count, rows) for t in texts(batch)]
        return [pa.array([m[j] for m in made], pa.int64()) for j in range(count)]

    def whole(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([_shingle_set(t, shingle).view("i8") for t in texts(batch)], pa.list_(pa.int64()))]

    def sets(keys: DataFrame) -> DataFrame:
        chosen = texts_of.join(keys, "key", "left_semi").dropDuplicates(["key"])
        return with_arrow(chosen, T.StructType().add("item", T.ArrayType(T.LongType())), whole).select("key", "item")

    fields = T.StructType([T.StructField(n, T.LongType()) for n in names])
    return linked_keys(with_arrow(texts_of, fields, signed).select("key", *names), count, sets, percent)


def one_of_each_group(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, **options
) -> DataFrame:
    """The rows of `docs`, with their own columns, of which each component of like texts keeps its least id.

    Texts are linked by `near_duplicates`, whose fingerprints of `words`-word shingles differ in at most `radius`
    bits, and by `similar_texts` (its `options`), which adds the exact Jaccard links that lie further apart in bits.
    Rows with a null id are kept only where no row of their component has an id. Rows that repeat the kept id
    within a component are one document and stay together, and so do the nulls of a component without ids.
    """
    own = docs.columns
    inner = docs.select([named(c).alias(f"c{i}") for i, c in enumerate(own)])
    key, text = f"c{own.index(id_col)}", f"c{own.index(text_col)}"
    whole = F.col(text).cast("string")
    versions = inner.select(F.xxhash64(whole).alias("key"), whole.alias("text"))
    bits = near_duplicates(versions, shingle=words, radius=radius, id_col="key")
    like = similar_texts(versions, **options)
    roots = components(bits.select(F.col("doc_id").alias("a"), F.col("component_id").alias("b")).union(like.select("node", "root")))
    mine = inner.select(F.col(key).alias("doc_id"), F.xxhash64(whole).alias("version")).distinct()
    placed = mine.join(roots.withColumnRenamed("node", "version"), "version", "left")
    placed = pinned(placed.select("doc_id", "version", F.coalesce("root", "version").alias("root")))
    smallest = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    kept = placed.join(smallest, "root").where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "version")
    same = F.col(key).eqNullSafe(F.col("doc_id")) & (F.xxhash64(whole) == F.col("version"))
    joined = inner.join(kept, same, "left_semi")
    return joined.select([F.col(f"c{i}").alias(c) for i, c in enumerate(own)])


def as_hex(c: str | Column) -> Column:
    """A signed 64-bit fingerprint as 16 lower-case hex digits."""
    return F.lpad(F.lower(F.hex(c)), 16, "0")

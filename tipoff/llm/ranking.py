"""Ranked lexical search: term-at-a-time with a limited number of accumulators."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipoff.llm.common import named, texts, written
from tipoff.llm.decontamination import blocks

# ASCII capitals become small letters; ASCII that is neither letter nor digit becomes a blank.
_FOLD = bytes(b if b > 127 or chr(b).isalnum() else 32 for b in range(256)).lower()

# Documents whose postings an inverted slice holds at a time.
_SLICE = 1 << 14


def terms(raw: bytes) -> list[bytes]:
    """The maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return raw.translate(_FOLD).split()


def term_weight(n_docs: int, df: int) -> int:
    """floor(1000 ln((2N + 2) / (2 df + 1)))."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def counted_terms(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(`doc_id`, `n`, `ids`, `tfs`): the length of each document with a term, and its terms of the vocabulary."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n", T.LongType())])
    schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("tfs", T.ArrayType(T.LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(shared.value)}
        for batch in batches:
            n, ids, tfs = [], [], []
            for raw in texts(batch):
                found = terms(raw)
                held = {place[t]: c for t, c in Counter(found).items() if t in place}
                n.append(len(found))
                ids.append(np.fromiter(held, "i4", len(held)))
                tfs.append(np.fromiter(held.values(), "i8", len(held)))
            made = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))]
            out = pa.RecordBatch.from_arrays(made, schema.names)
            yield out.filter(pa.array(np.array(n, "i8") > 0))

    return docs.select("doc_id", "text").mapInArrow(run, schema)


class Postings:
    """The inverted lists of a slice of documents: for each term its documents, ascending, and their exact gains."""

    def __init__(self, ids: np.ndarray, tfs: np.ndarray, doc: np.ndarray, m: np.ndarray, n_terms: int):
        order = np.argsort(ids, kind="stable")
        self.doc, tf = doc[order], tfs[order]
        self.gain = (1_000_000_000 * tf) // (1000 * tf + 8 * m[self.doc])
        self.starts = np.searchsorted(ids[order], np.arange(n_terms + 1))
        self.n_docs = len(m)

    def of(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.starts[term], self.starts[term + 1]
        return self.doc[a:b], self.gain[a:b]


def best_documents(postings: Postings, asked: list[tuple[int, int]], k: int, floor: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a slice that can be among the k best of a query: all with a score of at least its k-th.

    `asked` has (term, weight), the rarest term first; `floor` is a score that k documents seen before reach.
    Each list is read once, whole. A document gets an accumulator at its first term; none are made any more once
    the terms that remain cannot lift a new document to the k-th partial score. Survivors take all later terms in
    full, so their scores are exact; those that can no longer reach the k-th score are given up.
    """
    lists = [(*postings.of(t), w) for t, w in asked]
    rest = [0]
    for _, gain, weight in reversed(lists):
        rest.append(rest[-1] + (weight * int(gain.max()) if len(gain) else 0))
    rest.reverse()
    sums, live, kth = np.zeros(postings.n_docs, "i8"), None, floor
    for i, (doc, gain, weight) in enumerate(lists):
        if live is None and rest[i] < kth:
            live = np.flatnonzero(sums)
        if live is None:
            sums[doc] += weight * gain
        else:
            live = live[sums[live] + rest[i] >= kth]
            if not len(live):
                break
            at = np.minimum(np.searchsorted(doc, live), max(len(doc) - 1, 0))
            met = doc[at] == live if len(doc) else np.zeros(len(live), bool)
            sums[live[met]] += weight * gain[at[met]]
        held = sums[sums > 0] if live is None else sums[live]
        if len(held) >= k:
            kth = max(kth, int(np.partition(held, len(held) - k)[len(held) - k]))
    live = np.flatnonzero(sums) if live is None else live
    live = live[(sums[live] >= kth) & (sums[live] > 0)]
    return live, sums[live]


def _rank_in_tasks(counted: DataFrame, block, weights, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """The k best documents of each item within each task (`item`, `item_id`, `doc_id`, `score`)."""
    asked = [[(t, weights[t] * c) for t, c in sorted(item[1].items(), key=lambda x: (-weights[x[0]], x[0]))] for item in block]
    shared = counted.sparkSession.sparkContext.broadcast((asked, [item[0] for item in block]))
    schema = T.StructType().add("item", T.LongType()).add("item_id", T.StringType())
    schema = T.StructType(schema.fields + [counted.schema["doc_id"], T.StructField("score", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, names = shared.value
        best: list[list] = [[] for _ in queries]  # (-score, id is null, id)
        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for part in (batch.slice(i, _SLICE) for i in range(0, batch.num_rows, _SLICE)):
                ids, tfs = part.column(2), part.column(3)
                doc = np.repeat(np.arange(len(ids)), ids.value_lengths().to_numpy(zero_copy_only=False))
                m = np.array([25 + 75 * n * n_docs // n_terms for n in part.column(1).to_pylist()], "i8")
                flat = ids.flatten().to_numpy(zero_copy_only=False), tfs.flatten().to_numpy(zero_copy_only=False)
                postings, keys = Postings(*flat, doc, m, len(weights)), part.column(0).to_pylist()
                for q, query in enumerate(queries):
                    floor = -best[q][-1][0] if len(best[q]) == k else 0
                    found, scores = best_documents(postings, query, k, floor)
                    new = [(-s, keys[d] is None, keys[d]) for d, s in zip(found.tolist(), scores.tolist())]
                    if new:
                        best[q] = sorted(best[q] + new, key=lambda r: r if not r[1] else (r[0], True, 0))[:k]
        rows = [(q, names[q], r[2], -r[0]) for q, held in enumerate(best) for r in held]
        if rows:
            types = [pa.int64(), pa.string(), kind, pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema.names)

    return counted.mapInArrow(run, schema)


def rank_documents(
    docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_bytes: int = 4 << 20,
) -> DataFrame:
    """(`item_id`, `rank`, `doc_id`, `score`): the `k` documents with the highest scores above 0 for each item.

    Items pass through the driver in blocks of at most `block_bytes` of text; documents are counted once a block
    and kept as a table of term numbers in the shared folder. Each task inverts its own documents slice by slice
    and carries its k-th score from slice to slice, so postings are never shuffled; k rows an item and task are
    merged in two steps. N, L and df come from all documents.

    Null, empty and term-less texts are no documents, and such items have no rows. Equal scores go by ascending
    id, a null id last. Rows that repeat count and rank each on their own; items that repeat are answered each.
    Other input columns are not returned. Empty tables give no rows.
    """
    mine = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))
    found = []
    for start, texts_of in enumerate(blocks(items, item_id, item_text, block_bytes)):
        wanted = [(name, Counter(terms(raw))) for name, raw in texts_of]
        vocabulary = sorted(set().union(*(c for _, c in wanted)))
        place = {t: i for i, t in enumerate(vocabulary)}
        block = [(name, {place[t]: c for t, c in held.items()}) for name, held in wanted]
        counted = written(counted_terms(mine, vocabulary))
        n_docs, n_terms = counted.agg(F.count("*"), F.sum("n")).first()
        if not n_docs:
            continue
        held = counted.select(F.explode("ids").alias("t")).groupBy("t").count().collect()  # at most the vocabulary
        weights = [0] * len(vocabulary)
        for t, df in held:
            weights[t] = term_weight(n_docs, df)
        best = _rank_in_tasks(counted, block, weights, n_docs, n_terms, k)
        found.append(best.withColumn("block", F.lit(start)))
    if not found:
        types = {"item_id": "string", "rank": "int", "doc_id": mine.schema["doc_id"].dataType.simpleString(), "score": "long"}
        return docs.sparkSession.createDataFrame([], ", ".join(f"{n} {t}" for n, t in types.items()))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    part = out.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    for keys in (["block", "item", "part"], ["block", "item"]):
        part = part.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return part.select("item_id", F.col("rank").cast("int"), "doc_id", "score")

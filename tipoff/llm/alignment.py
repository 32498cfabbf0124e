"""Cross-tokenizer alignment: the token ends of two tokenizers are merged along merge paths."""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipoff.llm.common import named, texts, with_arrow, written
from tipoff.llm.packing import encoder

# Ends that one piece of a merge takes from both sides together.
_PIECE = 64

# Bytes of text that are aligned at a time.
_SLICE = 1 << 20

# A pair is a 31-bit number: id of A times this, plus id of B.
_B_IDS = 1 << 15  # see the shift in align_documents

# Links of a group that are written out one by one; larger groups are folded to distinct ids first.
_WIDE = 256

_sides: dict[tuple[str, str, str | None], Sides] = {}


class Sides:
    """Both tokenizers with the bytes of every id."""

    def __init__(self, a_path: str, b_path: str, a_ranks: str | None):
        import sentencepiece

        self.a = encoder(a_path, a_ranks)
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # the byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ... in order
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(own)]
        byte = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}
        vocabulary = self.a.slow.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.a_bytes[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()
        if self.b.get_piece_size() > _B_IDS:
            raise ValueError(f"tokenizer B has more than {_B_IDS} ids")
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            hexed = re.fullmatch("<0x([0-9A-F]{2})>", piece)
            self.b_bytes.append(bytes([int(hexed[1], 16)]) if hexed else piece.replace("▁", " ").encode())
        self.a_sizes = np.array([len(x) for x in self.a_bytes], "i8")
        self.b_sizes = np.array([len(x) for x in self.b_bytes], "i8")
        digits = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]
        self.marks = [d + end for end in ",|;" for d in digits]
        self.n_marks = len(digits)

    def ids(self, raws: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of A and B of each text; none where a side does not give the text's bytes back."""
        plain = [r.decode("utf-8", "replace") for r in raws]
        b_ids = self.b.encode(plain, num_threads=1) if plain else []
        none = np.empty(0, "i8")
        out = []
        for raw, text, b in zip(raws, plain, b_ids):
            want = b" " + raw
            if not raw or b"".join(map(self.b_bytes.__getitem__, b)) != want:
                out.append((none, none))
                continue
            a = self.a.ids(" " + text)
            same = b"".join(map(self.a_bytes.__getitem__, a)) == want
            out.append((np.array(a, "i8"), np.array(b, "i8")) if same else (none, none))
        return out


def sides(a_path: str, b_path: str, a_ranks: str | None) -> Sides:
    """One pair of tokenizers for each worker process."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (a_path, b_path, a_ranks)
    if key not in _sides:
        _sides[key] = Sides(*key)
    return _sides[key]


def diagonals(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many of the first `at` ends of the merge of `a` and `b` come from `a` (equal ends: `a` first).

    All diagonals are searched at once; each search halves its own range.
    """
    low, high = np.maximum(at - len(b), 0), np.minimum(at, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        before = np.zeros(len(at), bool)
        before[open_] = a[mid[open_]] <= b[at[open_] - mid[open_] - 1]
        low = np.where(open_ & before, mid + 1, low)
        high = np.where(open_ & ~before, mid, high)
    return low


def group_numbers(a: np.ndarray, b: np.ndarray, piece: int = _PIECE) -> tuple[np.ndarray, np.ndarray, int]:
    """Group of each token of both sides, given their ascending ends: a group stops where both sides end.

    Diagonals cut the merge into pieces of `piece` ends each. The pieces step through their own ends side by
    side, independently: each counts the shared ends it meets and numbers its tokens within itself. A shared end
    may fall on a cut, A's copy last in one piece and B's first in the next; the stitching step sees that from
    the ends on both sides of the cut. A running total over the pieces then makes the numbers global.
    """
    total = len(a) + len(b)
    cuts = np.minimum(np.arange(-(-total // piece) + 1) * piece, total)
    i_cut = diagonals(a, b, cuts)
    j_cut = cuts - i_cut
    i, j = i_cut[:-1].copy(), j_cut[:-1].copy()
    i_end, j_end = i_cut[1:], j_cut[1:]
    far = max(int(a[-1]) if len(a) else 0, int(b[-1]) if len(b) else 0) + 1
    a_far, b_far = np.append(a, far), np.append(b, far)
    met = np.zeros(len(i), "i8")
    # a cut between the two copies of a shared end: its B copy opens the piece and closes a group there
    before = np.where(i > 0, a_far[i - 1], -1)
    group_a, group_b = np.empty(len(a), "i8"), np.empty(len(b), "i8")
    piece_a, piece_b = np.empty(len(a), "i8"), np.empty(len(b), "i8")
    last = before  # the last end taken from A
    for _ in range(min(piece, total)):
        left = (i < i_end) | (j < j_end)
        take_a = left & (i < i_end) & ((j >= j_end) | (a_far[np.minimum(i, len(a))] <= b_far[np.minimum(j, len(b))]))
        take_b = left & ~take_a
        k = np.flatnonzero(take_a)
        group_a[i[k]], piece_a[i[k]] = met[k], k
        last[k] = a_far[i[k]]
        i[k] += 1
        k = np.flatnonzero(take_b)
        group_b[j[k]], piece_b[j[k]] = met[k], k
        met[k] += b_far[j[k]] == last[k]
        j[k] += 1
    offset = np.concatenate([[0], np.cumsum(met)])
    return group_a + offset[piece_a], group_b + offset[piece_b], int(offset[-1])


def _spread(counts: np.ndarray) -> np.ndarray:
    """0 .. n - 1 for each n of `counts`, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)


def _folded(group: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (group, id) and how often each comes."""
    keys, n = np.unique(group << 17 | ids, return_counts=True)
    return keys >> 17, keys & ((1 << 17) - 1), n


def _product(ga: np.ndarray, a: np.ndarray, na: np.ndarray, gb: np.ndarray, b: np.ndarray, nb: np.ndarray):
    """(group, pair, occurrences) of all A-B pairs of each group; both sides are sorted by group."""
    lo, hi = np.searchsorted(gb, ga, "left"), np.searchsorted(gb, ga, "right")
    width = hi - lo
    at = np.repeat(lo, width) + _spread(width)
    return np.repeat(ga, width), np.repeat(a * _B_IDS, width) + b[at], np.repeat(na, width) * nb[at]


def linked_pairs(group_a: np.ndarray, a: np.ndarray, group_b: np.ndarray, b: np.ndarray, doc_of: np.ndarray):
    """(document, pair, occurrences): the distinct linked pairs of each document, ascending. `doc_of`: document of a group.

    Groups with many links are folded to distinct ids on each side first, so work follows the distinct pairs.
    """
    n = len(doc_of)
    many = np.bincount(group_a, minlength=n) * np.bincount(group_b, minlength=n) > _WIDE
    parts = []
    for chosen, fold in ((~many, False), (many, True)):
        ka, kb = chosen[group_a], chosen[group_b]
        if not ka.any():
            continue
        if fold:
            left, right = _folded(group_a[ka], a[ka]), _folded(group_b[kb], b[kb])
        else:
            left = group_a[ka], a[ka], np.ones(int(ka.sum()), "i8")
            right = group_b[kb], b[kb], np.ones(int(kb.sum()), "i8")
        group, pair, times = _product(*left, *right)
        parts.append((doc_of[group] << 31 | pair, times))
    if not parts:
        none = np.empty(0, "i8")
        return none, none, none
    key, times = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(key)
    key, times = key[order], times[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[first] >> 31, key[first] & ((1 << 31) - 1), np.add.reduceat(times, first)


FIELDS = (
    T.StructType()
    .add("n_a", T.LongType()).add("n_b", T.LongType()).add("n_groups", T.LongType()).add("n_links", T.LongType())
    .add("groups_sha256", T.StringType()).add("pairs", T.ArrayType(T.IntegerType())).add("times", T.ArrayType(T.LongType()))
)


def _align(raws: list[bytes], both: Sides) -> list[pa.Array]:
    """The columns FIELDS of some texts."""
    ids = both.ids(raws)
    n_a, n_b = (np.array([len(x[s]) for x in ids], "i8") for s in (0, 1))
    a, b = (np.concatenate([x[s] for x in ids] or [np.empty(0, "i8")]) for s in (0, 1))
    group_a, group_b, n_all = group_numbers(np.cumsum(both.a_sizes[a]), np.cumsum(both.b_sizes[b]))
    # texts follow each other without a gap and both sides end with each text, so no group spans two
    stop = np.cumsum(n_a)
    upto = np.where(stop > 0, group_a[np.maximum(stop - 1, 0)] + 1, 0) if len(a) else np.zeros(len(ids), "i8")
    n_groups = np.diff(np.concatenate([[0], upto]))
    doc_of = np.repeat(np.arange(len(ids)), n_groups)
    doc, pair, times = linked_pairs(group_a, a, group_b, b, doc_of)
    in_a, in_b = np.bincount(group_a, minlength=n_all), np.bincount(group_b, minlength=n_all)
    n_links = np.zeros(len(ids), "i8")
    np.add.at(n_links, doc_of, in_a * in_b)
    # one list of marks: the ids of a group's A tokens, then of its B tokens, each with what follows it
    a_before, b_before = np.cumsum(in_a), np.cumsum(in_b) - in_b
    marks = np.empty(len(a) + len(b), "i8")
    a_last = np.append(group_a[1:] != group_a[:-1], True)[: len(a)]
    b_last = np.append(group_b[1:] != group_b[:-1], True)[: len(b)]
    marks[np.arange(len(a)) + b_before[group_a]] = a + both.n_marks * a_last
    marks[np.arange(len(b)) + a_before[group_b]] = b + 2 * both.n_marks * b_last
    hashed, at = [], 0
    for n in (n_a + n_b).tolist():
        said = "".join(map(both.marks.__getitem__, marks[at : at + n].tolist()))[:-1]
        hashed.append(hashlib.sha256(said.encode()).hexdigest() if n else "")
        at += n
    offsets = pa.array(np.searchsorted(doc, np.arange(len(ids) + 1)).astype("i4"))
    return [
        pa.array(n_a), pa.array(n_b), pa.array(n_groups, pa.int64()), pa.array(n_links, pa.int64()), pa.array(hashed, pa.string()),
        pa.ListArray.from_arrays(offsets, pa.array(pair.astype("i4"))), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64())),
    ]


def _with_sums(kept: DataFrame, heavy: tuple[np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """`kept` with the sums over heavy pairs (`n_best`, `count_sum`) and the pairs that are left (`pairs`, `times`)."""
    shared = kept.sparkSession.sparkContext.broadcast(heavy)
    fields = (
        T.StructType().add("n_best", T.LongType()).add("count_sum", T.LongType())
        .add("pairs", T.ArrayType(T.IntegerType())).add("times", T.ArrayType(T.LongType()))
    )
    column = {c: i for i, c in enumerate(kept.columns)}
    own = [c for c in kept.columns if c not in fields.names]
    schema = T.StructType([kept.schema[c] for c in own] + fields.fields)

    def run(batches):
        keys, counts, best = shared.value
        for batch in batches:
            lists = batch.column(column["pairs"])
            n = lists.value_lengths().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(n)), n)
            pair = lists.flatten().to_numpy(zero_copy_only=False).astype("i8")
            times = batch.column(column["times"]).flatten().to_numpy(zero_copy_only=False)
            at = np.minimum(np.searchsorted(keys, pair), max(len(keys) - 1, 0))
            met = keys[at] == pair if len(keys) else np.zeros(len(pair), bool)
            sums = [np.zeros(len(n), "i8"), np.zeros(len(n), "i8")]
            np.add.at(sums[0], doc[met], times[met] * best[at[met]])
            np.add.at(sums[1], doc[met], times[met] * counts[at[met]])
            offsets = pa.array(np.searchsorted(doc[~met], np.arange(len(n) + 1)).astype("i4"))
            made = [pa.array(s) for s in sums]
            made += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pair[~met].astype("i4"), times[~met])]
            yield pa.RecordBatch.from_arrays([batch.column(column[c]) for c in own] + made, schema.names)

    return kept.mapInArrow(run, schema)


def align_documents(
    docs: DataFrame, a_path: str, b_path: str, *, a_ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    heavy_pairs: int = 1 << 19,
) -> DataFrame:
    """How the tokens of two tokenizers line up in each text: id, `n_a`, `n_b`, `n_groups`, `n_links`, `n_best`, `count_sum`, `groups_sha256`.

    A encodes a space and the text (`a_path`, and the same vocabulary as ranks in `a_ranks`, faster for plain
    letters), B the text, before which it sets a space itself. Texts are encoded once; their distinct linked pairs
    are kept as a table in the shared folder. The number of documents of each pair is counted over all of them.
    Pairs that hold at least a `heavy_pairs`-th of all entries, of which there are at most `heavy_pairs`, are
    broadcast; all other pairs meet their counts in a join in which no key is hot.

    Null and empty texts and those that a side does not give back have zeros and an empty hash. Rows that repeat
    or have a null id are documents of their own. An empty table gives no rows. Other input columns are not returned.
    """
    mine = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))
    aligned = with_arrow(mine, FIELDS, lambda batch: _align(texts(batch), sides(a_path, b_path, a_ranks)), slice_bytes=_SLICE)
    kept = written(aligned.drop("text").withColumn("row", F.monotonically_increasing_id()))
    counts = kept.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    best = counts.groupBy(F.shiftright("pair", 15).alias("a")).agg(F.max("n").alias("most"))  # at most the ids of A
    counts = counts.withColumn("a", F.shiftright("pair", 15)).join(best, "a")
    counts = written(counts.select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")))
    entries = counts.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * heavy_pairs >= entries
    top = counts.where(hot).toPandas().sort_values("pair")
    summed = _with_sums(kept, (top["pair"].to_numpy("i8"), top["n"].to_numpy("i8"), top["best"].to_numpy("i8")))
    rest = summed.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", "x.pairs", "x.times")
    light = rest.join(counts.where(~hot), rest["pairs"] == counts["pair"])
    light = light.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("b"), F.sum(F.col("times") * F.col("n")).alias("c"))
    return summed.drop("pairs", "times").join(light, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("b", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("c", F.lit(0))).alias("count_sum"), "groups_sha256",
    )

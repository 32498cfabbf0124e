"""Removal of long repeated byte strings: sparse suffixes, sorted in runs and merged by their common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tipoff.llm.common import named, slices, texts
from tipoff.session import shuffle_width

# Rolling hashes: a random 64-bit value for each byte and an odd base, two independent times.
_BYTES = np.random.default_rng(400).integers(0, 1 << 64, (2, 256), "u8")
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

_GRAM = 24  # bytes that choose the anchors
_SLICE = 1 << 18  # bytes of text that a task works on at a time
_RUN = 12 << 20  # bytes of cells that a task sorts at a time
_LOW = np.uint64((1 << 32) - 1)

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, modulo 2 ** 64."""
    held = _powers.get(which)
    if held is None or len(held[0]) < n:
        size = max(n, _SLICE * 2)
        made = []
        for base in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            factors = np.full(size, base, "u8")
            factors[0] = 1
            made.append(np.cumprod(factors, dtype="u8"))
        held = _powers[which] = (made[0], made[1])
    return held


def prefix_sums(data: np.ndarray, which: int = 0) -> np.ndarray:
    sums = np.zeros(len(data) + 1, "u8")
    np.cumsum(_BYTES[which][data] * powers(len(data) + 1, which)[1][: len(data)], out=sums[1:])
    return sums


def span_hashes(sums: np.ndarray, start: np.ndarray | slice, n: int, which: int = 0) -> np.ndarray:
    """Hashes of the `n` bytes from each start."""
    if isinstance(start, slice):
        got = (sums[n:] - sums[: len(sums) - n]) * powers(len(sums), which)[0][: len(sums) - n]
    else:
        got = (sums[start + n] - sums[start]) * powers(len(sums), which)[0][start]
    got ^= got >> np.uint64(32)
    got *= np.uint64(0xD6E8FEB86659FD93)
    return got ^ (got >> np.uint64(32))


def cells(data: np.ndarray, sizes: np.ndarray, length: int, cell: int):
    """Cells of the texts that `data` holds one after the other: (text, first window, last window, core, key).

    A window is `length` bytes of one text. Its anchor is its gram with the least hash, the leftmost if equal, so
    equal windows have theirs at the same offset. Offsets are counted off in steps of `cell`; the windows in a row
    with one anchor and one step are a cell. All windows that could be in it share `length - cell + 1` bytes from
    `core` on: equal windows lie in cells with equal cores, and `key` is the hash of the core.
    """
    n, none = len(data) - length + 1, np.empty(0, "i8")
    if n < 1:
        return none, none, none, none, none
    gram = min(_GRAM, length)
    sums = prefix_sums(data)
    least = span_hashes(sums, slice(None), gram)
    least = (least & ~_LOW) | np.arange(len(least), dtype="u8")
    width, reach = length - gram + 1, 1
    while reach * 2 <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    anchor = (np.minimum(least[:n], least[width - reach : width - reach + n]) & _LOW).astype("i8")
    text = np.repeat(np.arange(len(sizes)), sizes)
    whole = text[:n] == text[length - 1 :]
    step = (anchor - np.arange(n)) // cell
    new = np.ones(n + 1, bool)
    new[1:n] = (anchor[1:] != anchor[:-1]) | (step[1:] != step[:-1]) | (whole[1:] != whole[:-1])
    first, last = np.flatnonzero(whole & new[:-1]), np.flatnonzero(whole & new[1:])
    core = anchor[first] - step[first] * cell
    key = span_hashes(sums, core, length - cell + 1).view("i8")
    at = text[first]
    start = (np.cumsum(sizes) - sizes)[at]
    return at, first - start, last - start, core - start, key


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which the first `known` bytes are not looked at."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8


def front_coded(strings: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of a sorted run, the prefix that each string shares with the one before, and the rest of it."""
    shared = [0] * len(strings)
    for i in range(1, len(strings)):
        shared[i] = common_prefix(strings[i - 1], strings[i])
    return shared, [s[k:] for s, k in zip(strings, shared)]


def decoded(shared: list[int], rest: list[bytes]) -> list[bytes]:
    out, before = [], b""
    for k, tail in zip(shared, rest):
        before = before[:k] + tail
        out.append(before)
    return out


def merge_runs(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the strings of all runs (numbered run by run) and what each shares with the one before.

    A loser tree in which every head knows its common prefix with the last string taken. Of two heads the one that
    shares more is smaller; only heads that share equally are compared, from that place on.
    """
    size = 1 << max(len(runs) - 1, 0).bit_length()
    lead = [r[0] if r else None for r in runs] + [None] * (size - len(runs))
    known, place = [0] * size, [0] * size
    base = np.concatenate([[0], np.cumsum([len(r) for r in runs])]).astype("i8").tolist()
    total = base[-1]

    def duel(r: int, s: int) -> tuple[int, int]:
        """(winner, loser); the loser learns what it shares with the winner."""
        a, b = lead[r], lead[s]
        if b is None:
            return r, s
        if a is None:
            return s, r
        if known[r] != known[s]:
            return (r, s) if known[r] > known[s] else (s, r)
        k = common_prefix(a, b, known[r])
        if k == len(a) or (k < len(b) and a[k] < b[k]):
            known[s] = k
            return r, s
        known[r] = k
        return s, r

    losers = [0] * size
    row = list(range(size))
    while len(row) > 1:
        nxt = []
        for i in range(0, len(row), 2):
            won, lost = duel(row[i], row[i + 1])
            losers[(len(row) + i) // 2] = lost
            nxt.append(won)
        row = nxt
    top, order, common = row[0], [], []
    for _ in range(total):
        run, at = runs[top], place[top]
        order.append(base[top] + at)
        common.append(known[top])
        place[top] = at = at + 1
        if at < len(run):
            lead[top], known[top] = run[at], shared[top][at]
        else:
            lead[top] = None
        node = (size + top) >> 1
        while node:
            top, losers[node] = duel(top, losers[node])
            node >>= 1
    return np.array(order, "i8"), np.array(common, "i8")


def repeated_windows(right, left, low: np.ndarray, high: np.ndarray, length: int, cell: int) -> np.ndarray:
    """For each cell (row), whether its window that starts `u` bytes before the core (column) comes twice.

    `right` and `left` are (order, common prefixes) of the bytes from the core on and of those before it, read
    backwards; `low` and `high` are the least and greatest `u` of each cell. Two windows are equal if `u` is and
    if they agree on `length - u` bytes to the right and on `u` to the left: at each `u` the classes of both
    orders are numbered by counting the places where neighbours share less.
    """
    n = len(low)
    twice = np.zeros((n, cell), bool)
    at_right, at_left = np.empty(n, "i8"), np.empty(n, "i8")
    for u in range(cell):
        live = np.flatnonzero((low <= u) & (u <= high))
        if len(live) < 2:
            continue
        at_right[right[0]] = np.cumsum(right[1] < length - u)
        at_left[left[0]] = np.cumsum(left[1] < u)
        key = at_right[live] * (n + 1) + at_left[live]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        hit = np.zeros(len(live), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        twice[live[hit], u] = True
    return twice


_LONGS, _INTS, _BINARIES = (T.ArrayType(t) for t in (T.LongType(), T.IntegerType(), T.BinaryType()))
# A run for one part: cells in the order of their right sides, both sides front-coded; windows of crowded
# cells by hash; and spans that the task has already found.
_RUNS = T.StructType().add("part", T.IntegerType())
for _name, _type in [
    ("text_1", _LONGS), ("text_2", _LONGS), ("first", _INTS), ("last", _INTS), ("core", _INTS), ("right_shared", _INTS),
    ("right", _BINARIES), ("left_order", _INTS), ("left_shared", _INTS), ("left", _BINARIES), ("window_1", _LONGS), ("window_2", _LONGS),
    ("window_text_1", _LONGS), ("window_text_2", _LONGS), ("window_at", _INTS), ("span_text_1", _LONGS), ("span_text_2", _LONGS),
    ("span_start", _INTS), ("span_end", _INTS),
]:
    _RUNS = _RUNS.add(_name, _type)
_SPANS = T.StructType().add("text_1", T.LongType()).add("text_2", T.LongType()).add("start", T.IntegerType()).add("end", T.IntegerType())


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _cell(raw: bytes, first: int, last: int, core: int, length: int) -> tuple[bytes, bytes]:
    """The bytes of a cell from its core on, and those before it, read backwards; nothing else of the text is kept."""
    return raw[core : last + length], raw[first:core][::-1]


def _sorted_run(held: list, length: int, n_parts: int) -> Iterator[pa.RecordBatch]:
    """The rows `_RUNS` of some cells (sides, text_1, text_2, first, last, core, key, crowded), each as soon as it is made.

    A part has one row, and one more if it has crowded cells. Equal cells are repeats at once: all their windows
    become a span, and one of them goes on. So are equal windows of crowded cells. What a task sends of a group of
    copies is therefore one cell, whatever its size. `held` is emptied.
    """
    out: dict[int, dict[str, list]] = {}

    def of(part: int) -> dict[str, list]:
        return out.setdefault(part, {n: [] for n in _RUNS.names[1:]})

    def span(part: int, c: tuple, start: int, end: int) -> None:
        row = of(part)
        for name, value in zip(("span_text_1", "span_text_2", "span_start", "span_end"), (c[1], c[2], start, end)):
            row[name].append(value)

    def made() -> Iterator[pa.RecordBatch]:
        while out:
            part, row = out.popitem()
            yield pa.RecordBatch.from_pylist([{"part": part, **row}], _arrow(_RUNS))

    by_part: dict[int, list] = {}
    crowded = []
    while held:
        c = held.pop()
        if c[7]:
            crowded.append(c)
        else:
            by_part.setdefault(c[6] % n_parts, []).append(c)
    while by_part:
        part, group = by_part.popitem()
        group.sort(key=lambda c: c[0])
        kept, repeated = [], False
        for c in group:
            same = bool(kept) and c[0] == kept[-1][0]
            if same:
                if not repeated:
                    span(part, kept[-1], kept[-1][3], kept[-1][4] + length)
                span(part, c, c[3], c[4] + length)
            else:
                kept.append(c)
            repeated = same
        row = of(part)
        row["right_shared"], row["right"] = front_coded([c[0][0] for c in kept])
        order = sorted(range(len(kept)), key=lambda i: kept[i][0][1])
        row["left_order"] = order
        row["left_shared"], row["left"] = front_coded([kept[i][0][1] for i in order])
        for name, at in (("text_1", 1), ("text_2", 2), ("first", 3), ("last", 4), ("core", 5)):
            row[name] = [c[at] for c in kept]
        yield from made()
    if crowded:
        strings = [c[0][1][::-1] + c[0][0] for c in crowded]
        data = np.frombuffer(b"".join(strings), "u1")
        counts = np.array([c[4] - c[3] + 1 for c in crowded])
        owner = np.repeat(np.arange(len(crowded)), counts)
        offset = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
        start = np.repeat(np.cumsum([0, *map(len, strings)])[:-1], counts) + offset
        h = [span_hashes(prefix_sums(data, w), start, length, w).view("i8") for w in (0, 1)]
        order = np.lexsort((h[1], h[0]))
        new = np.ones(len(order) + 1, bool)
        new[1:-1] = (h[0][order][1:] != h[0][order][:-1]) | (h[1][order][1:] != h[1][order][:-1])
        repeated = np.empty(len(order), bool)
        repeated[order] = ~(new[:-1] & new[1:])
        for i, a, b in _stretches(owner, offset, repeated):
            c = crowded[i]
            span(c[6] % n_parts, c, c[3] + a, c[3] + b - 1 + length)
        for w in order[new[:-1]].tolist():
            c = crowded[owner[w]]
            row = of(int(h[0][w]) % n_parts)
            values = (int(h[0][w]), int(h[1][w]), c[1], c[2], c[3] + int(offset[w]))
            for name, value in zip(("window_1", "window_2", "window_text_1", "window_text_2", "window_at"), values):
                row[name].append(value)
    yield from made()


def _stretches(owner: np.ndarray, offset: np.ndarray, flag: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(owner, from, to) of the stretches of flagged offsets that follow each other."""
    at = np.flatnonzero(flag)
    if not len(at):
        return
    cut = np.flatnonzero((owner[at][1:] != owner[at][:-1]) | (offset[at][1:] != offset[at][:-1] + 1)) + 1
    a, b = at[np.concatenate([[0], cut])], at[np.concatenate([cut, [len(at)]]) - 1]
    yield from zip(owner[a].tolist(), offset[a].tolist(), (offset[b] + 1).tolist())


def _merged_part(rows: list[pa.RecordBatch], length: int, cell: int) -> pa.RecordBatch:
    """The spans of one part, from the runs that tasks sent to it, each a batch of one row."""
    lists = lambda name: [r.column(_RUNS.names.index(name))[0].values for r in rows]
    joined = lambda name: np.concatenate([v.to_numpy(zero_copy_only=False).astype("i8") for v in lists(name)])

    def merged(side: str) -> tuple[np.ndarray, np.ndarray]:
        shared = [v.to_pylist() for v in lists(f"{side}_shared")]
        return merge_runs([decoded(k, v.to_pylist()) for k, v in zip(shared, lists(side))], shared)

    out = [[joined(f"span_{n}") for n in _SPANS.names]]
    sizes = [len(v) for v in lists("core")]
    if n := sum(sizes):
        right, left = merged("right"), merged("left")
        before = np.cumsum([0, *sizes])
        place = np.concatenate([v.to_numpy(zero_copy_only=False).astype("i8") + b for v, b in zip(lists("left_order"), before)])
        core, first, last = joined("core"), joined("first"), joined("last")
        twice = repeated_windows(right, (place[left[0]], left[1]), core - last, core - first, length, cell)
        owner, u = np.repeat(np.arange(n), cell), np.tile(np.arange(cell), n)
        found = np.array(list(_stretches(owner, u, twice.ravel())), "i8").reshape(-1, 3)
        i = found[:, 0]
        out.append([joined("text_1")[i], joined("text_2")[i], core[i] - found[:, 2] + 1, core[i] - found[:, 1] + length])
    h = joined("window_1"), joined("window_2")
    if len(h[0]):
        order = np.lexsort((h[1], h[0]))
        same = (h[0][order][1:] == h[0][order][:-1]) & (h[1][order][1:] == h[1][order][:-1])
        hit = np.zeros(len(order), bool)
        hit[order[1:][same]] = hit[order[:-1][same]] = True
        at = joined("window_at")[hit]
        out.append([joined("window_text_1")[hit], joined("window_text_2")[hit], at, at + length])
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out), kinds)], _SPANS.names)


def union_of(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The maximal runs of bytes that the spans cover."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def text_keys(text: Column) -> list[Column]:
    """128 bits that tell texts apart, from two seeds."""
    return [F.xxhash64(text).alias("text_1"), F.xxhash64(F.lit("second"), text).alias("text_2")]


def distinct_without_repeats(
    docs: DataFrame, *, length: int = 400, cell: int = 128, crowd: int = 1024, text_col: str = "text"
) -> DataFrame:
    """For each distinct text (`text_1`, `text_2`, see `text_keys`): `n_bytes`, `spans` and `kept`.

    `spans` are the maximal runs of bytes that a string of `length` bytes covers which also starts anywhere else in
    the texts, counting texts that come twice twice; `kept` are the other bytes. All strings are judged on the input.

    Texts meet once, by hash. Windows fall into cells by content (see `cells`); cores are counted with sums made
    before the shuffle, and cells whose core comes once are gone. Each task sorts its cells by the bytes on both
    sides of the core and sends front-coded runs, one for each part; a part merges them by loser trees and numbers
    classes of equal windows. Equal cells of a task become one. Cores of more than `crowd` cells, where texts differ
    only around a common passage, are spread window by window: equal windows by 128 bits, one a task and string.
    A null text is empty; texts shorter than `length` have no spans.
    """
    cell = min(cell, length)
    whole = F.coalesce(named(text_col).cast("string"), F.lit(""))
    rows = docs.select(*text_keys(whole), whole.alias("text"))
    distinct = rows.groupBy("text_1", "text_2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    schema = T.StructType().add("text_1", T.LongType()).add("text_2", T.LongType())
    for name in ("first", "last", "core"):
        schema = schema.add(name, T.IntegerType())
    cut_schema = schema.add("key", T.LongType())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                raws = texts(part)
                at, first, last, core, key = cells(np.frombuffer(b"".join(raws), "u1"), np.array([len(r) for r in raws]), length, cell)
                made = [part.column(i).take(pa.array(at)) for i in (0, 1)]
                made += [pa.array(x, pa.int32()) for x in (first, last, core)]
                yield pa.RecordBatch.from_arrays([*made, pa.array(key)], cut_schema.names)

    found = distinct.mapInArrow(cut, cut_schema)
    cores = found.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # joined by another form of the key: both sides are then plain shuffles, whose hot keys adaptive execution splits
    cores = cores.select(F.bitwise_not("key").alias("flipped"), (F.col("n") > crowd).alias("crowded"))
    met = found.join(cores, F.bitwise_not("key") == F.col("flipped"))
    met = met.groupBy("text_1", "text_2").agg(F.collect_list(F.struct("first", "last", "core", "key", "crowded")).alias("cells"))
    n_parts = shuffle_width(docs)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                one, two, lists = part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(4)
                for i, raw in enumerate(texts(part)):
                    for c in lists[i].as_py():
                        sides = _cell(raw, c["first"], c["last"], c["core"], length)
                        held.append((sides, one[i], two[i], c["first"], c["last"], c["core"], c["key"], c["crowded"]))
                        size += c["last"] - c["first"] + length
                    if size > _RUN:
                        yield from _sorted_run(held, length, n_parts)
                        size = 0
        yield from _sorted_run(held, length, n_parts)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for i, part in enumerate(batch.column(0).to_pylist()):
                if part != now and rows:
                    yield _merged_part(rows, length, cell)
                    rows = []
                now = part
                rows.append(batch.slice(i, 1))
        if rows:
            yield _merged_part(rows, length, cell)

    runs = distinct.join(met, ["text_1", "text_2"]).mapInArrow(sort, _RUNS)
    spans = runs.repartition(n_parts, "part").sortWithinPartitions("part").mapInArrow(merge, _SPANS)
    spans = spans.groupBy("text_1", "text_2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    schema = T.StructType().add("text_1", T.LongType()).add("text_2", T.LongType()).add("n_bytes", T.LongType())
    pairs = T.StructType().add("start", T.IntegerType()).add("end", T.IntegerType())
    out_schema = schema.add("spans", T.ArrayType(pairs)).add("kept", T.BinaryType())

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                n_bytes, gone, kept = [], [], []
                for raw, copies, found in zip(texts(part), part.column(3).to_pylist(), part.column(4).to_pylist()):
                    again = copies > 1 and len(raw) >= length
                    u = [(0, len(raw))] if again else union_of([(s["start"], s["end"]) for s in found or []])
                    n_bytes.append(len(raw))
                    gone.append([{"start": a, "end": b} for a, b in u])
                    edges = [0, *(x for s in u for x in s), len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2])) if u else raw)
                made = [part.column(0), part.column(1), pa.array(n_bytes, pa.int64())]
                made += [pa.array(gone, _arrow(out_schema).field("spans").type), pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(made, out_schema.names)

    return distinct.join(spans, ["text_1", "text_2"], "left").mapInArrow(keep, out_schema)


def without_repeats(docs: DataFrame, *, text_col: str = "text", results: DataFrame | None = None, **options) -> DataFrame:
    """The rows of `docs` with the columns of `results`, by default `n_bytes`, `spans` and `kept`.

    `results` has rows of `distinct_without_repeats`, or columns made from them. Rows that repeat, have a null id
    or a null or empty text are each returned; columns of `docs` that are called like one of the results are
    replaced. An empty table gives no rows.
    """
    results = distinct_without_repeats(docs, text_col=text_col, **options) if results is None else results
    added = [c for c in results.columns if c not in ("text_1", "text_2")]
    own = [c for c in docs.columns if c.lower() not in {a.lower() for a in added}]
    one, two = text_keys(F.coalesce(named(text_col).cast("string"), F.lit("")))
    inner = docs.select([one.alias("k1"), two.alias("k2")] + [named(c).alias(f"c{i}") for i, c in enumerate(own)])
    both = inner.join(results, (F.col("k1") == F.col("text_1")) & (F.col("k2") == F.col("text_2")))
    return both.select([F.col(f"c{i}").alias(c) for i, c in enumerate(own)] + added)

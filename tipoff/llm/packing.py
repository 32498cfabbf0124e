"""Sequence packing by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tipoff.llm.common import named, slices, texts

# Texts of these characters alone get the same ids from both tokenizer libraries.
_PLAIN = re.compile("[\n -~¡-ɏ]*")

_encoders: dict[tuple[str, str | None, bool], object] = {}


class Encoder:
    """Token ids of texts. With `ranks_path`, the same vocabulary as ranks, texts of plain letters take a faster path.

    The string of a special token inside a text is plain text, or with `special` that token.
    """

    def __init__(self, path: str, ranks_path: str | None, special: bool):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = not special
        self.whole = [t.content for t in self.slow.get_added_tokens_decoder().values()] if special else []
        self.fast = None
        if ranks_path:
            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast and _PLAIN.fullmatch(text) and not any(w in text for w in self.whole):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def encoder(path: str, ranks_path: str | None, special: bool = False) -> Encoder:
    """One encoder for each worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = (path, ranks_path, special)
    if key not in _encoders:
        _encoders[key] = Encoder(path, ranks_path, special)
    return _encoders[key]


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Karmarkar-Karp: `ways` near-equal groups of the numbers of `sizes`.

    A partial partition is the list of its filled slots, largest first. The two with the greatest spread are
    merged so that the largest slots of one meet the smallest (or empty) slots of the other.
    """
    slots: list[tuple[int, int]] = [(s, i) for i, s in enumerate(sizes)]  # sum, node
    kids: dict[int, tuple[int, int]] = {}
    node, order = len(sizes), 0
    heap = []
    for slot in slots:
        spread = slot[0] if ways > 1 else 0
        heap.append((-spread, order, [slot]))
        order += 1
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        shared = len(a) + len(b) - ways
        if shared > 0:
            # slot i of a meets slot ways - 1 - i of b
            low = len(a) - shared
            merged = a[:low]
            for (sa, na), (sb, nb) in zip(a[low:], reversed(b[len(b) - shared :])):
                kids[node] = (na, nb)
                merged.append((sa + sb, node))
                node += 1
            merged += b[: len(b) - shared]
        else:
            merged = a + b
        merged.sort(reverse=True)
        least = merged[-1][0] if len(merged) == ways else 0
        heapq.heappush(heap, (least - merged[0][0], order, merged))
        order += 1
    groups = []
    for _, top in heap[0][2] if heap else []:
        items, stack = [], [top]
        while stack:
            n = stack.pop()
            if n in kids:
                stack.extend(kids[n])
            else:
                items.append(n)
        groups.append(sorted(items))
    return groups


def windows(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of at most `capacity`: the fewest that the sum allows, and more as long as one is too full."""
    ways = -(-sum(sizes) // capacity)
    while True:
        groups = difference(sizes, ways)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return groups
        ways += 1


FIELDS = (
    T.StructType()
    .add("start", T.LongType())
    .add("length", T.LongType())
    .add("ids", T.BinaryType())
    .add("doc_tokens", T.LongType())
    .add("sequence_id", T.LongType())
    .add("offset", T.LongType())
)


def pack(
    docs: DataFrame, tokenizer_path: str, *, ranks_path: str | None = None, capacity: int = 1024, piece: int = 256,
    group: int = 512, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Pieces of documents with their place in sequences of at most `capacity` tokens.

    A document is its ids and `end_id`. Each full run of `capacity` ids is a sequence of its own; the rest is
    cut into pieces of at most `piece` ids. Each task deals its own rests: groups of about `group` pieces are
    split into near-equal windows, so a task holds one group, no rows are shuffled and no group is global.
    Returns the id column, `start`, `length`, `ids` (little-endian unsigned 32-bit), `doc_tokens`,
    `sequence_id` (unique, with the task's number in its upper bits) and `offset` in the sequence.

    A null or empty text is one piece with `end_id`. The string of a special token in a text is that token. Rows that repeat or have a null id are packed each on
    their own. An empty table gives no rows. Other input columns are not returned.
    """
    kept = docs.select(named(id_col).alias("doc_id"), named(text_col).cast("string").alias("text"))
    schema = T.StructType([kept.schema["doc_id"], *FIELDS.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path, ranks_path, special=True).ids
        sequence, rows, waiting = TaskContext.get().partitionId() << 33, [], []
        kind = None

        def placed(groups: list[list[int]]) -> None:
            nonlocal sequence
            for g in groups:
                offset = 0
                for i in g:
                    doc, start, ids, total = waiting[i]
                    rows.append((doc, start, len(ids), ids.tobytes(), total, sequence, offset))
                    offset += len(ids)
                sequence += 1
            waiting.clear()

        def out() -> pa.RecordBatch:
            types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            made = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            rows.clear()
            return pa.RecordBatch.from_arrays(made, schema.names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for part in slices(batch, "text"):
                for doc, text in zip(part.column(0).to_pylist(), texts(part)):
                    ids = np.array(encode(text.decode("utf-8", "replace")) + [end_id], "<u4")
                    full = len(ids) // capacity * capacity
                    for s in range(0, full, capacity):
                        rows.append((doc, s, capacity, ids[s : s + capacity].tobytes(), len(ids), sequence, 0))
                        sequence += 1
                    for s in range(full, len(ids), piece):
                        waiting.append((doc, s, ids[s : s + piece], len(ids)))
                    if len(waiting) >= group:
                        placed(windows([len(w[2]) for w in waiting], capacity))
                if rows:
                    yield out()
        if waiting:
            placed(windows([len(w[2]) for w in waiting], capacity))
            yield out()

    return kept.mapInArrow(run, schema)

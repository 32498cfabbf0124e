"""Wu-Manber search for many patterns at once, many cursors in step."""

from __future__ import annotations

import numpy as np

# Text bytes that one cursor covers.
STEP = 2048
# Zero bytes that must follow the text, so that a load of 8 bytes never leaves it.
PAD = 16

_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _words(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position as one number."""
    return np.ndarray((len(text) - 7,), "<u8", text, strides=(1,))


class Group:
    """Patterns of about one length: a shift table over blocks and buckets by the hash of the last block.

    The first `least` bytes of each pattern take part in the shifts (`least` is the shortest length). A block
    that no pattern holds lets a cursor jump `least - block + 1` bytes; otherwise it jumps to where the
    pattern could end. A jump of zero means that the block ends the first `least` bytes of the patterns in
    its bucket.
    """

    def __init__(self, patterns: list[bytes], ids: np.ndarray):
        self.least = min(map(len, patterns))
        self.block = min(16, (self.least + 1) // 2)
        flat = np.frombuffer(b"".join(p[: self.least] for p in patterns) + bytes(PAD), "u1")
        loads, starts = _words(flat), np.arange(len(patterns)) * self.least
        far = self.least - self.block
        self.bits = int(np.clip(np.ceil(np.log2(8 * len(patterns) * (far + 1))), 10, 24))
        self.shift = np.full(1 << self.bits, far + 1, "i4")
        for j in range(far + 1):
            np.minimum.at(self.shift, self._hash(loads, starts + j), far - j)
        ends = self._hash(loads, starts + far)
        order = np.argsort(ends, kind="stable")
        self.ends, self.ids = ends[order], ids[order]
        self.patterns = [patterns[i] for i in order]
        self.mask = np.uint64((1 << 8 * min(8, self.least)) - 1)
        self.first = loads[starts[order]] & self.mask

    def _hash(self, loads: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.block < 8:
            mixed = (loads[at] & np.uint64((1 << 8 * self.block) - 1)) * _K1
        else:
            mixed = (loads[at] * _K1) ^ (loads[at + self.block - 8] * _K2)
            mixed ^= mixed >> np.uint64(29)
            mixed *= _K2
        return (mixed >> np.uint64(64 - self.bits)).astype("i8")

    def search(self, text: bytes, loads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and pattern id of every occurrence in `text`, which ends in PAD zero bytes."""
        limit, far = len(text) - PAD - self.least + 1, self.least - self.block
        pos = np.arange(0, max(limit, 0), STEP)
        end, found = np.minimum(pos + STEP, limit), []
        while len(pos):
            jump = self.shift[self._hash(loads, pos + far)]
            if not jump.all():
                found.append(pos[jump == 0])
            pos = pos + np.maximum(jump, 1)
            alive = pos < end
            if not alive.all():
                pos, end = pos[alive], end[alive]
        if not found:
            return np.empty(0, "i8"), np.empty(0, "i8")
        at = np.concatenate(found)
        ends = self._hash(loads, at + far)
        low, high = np.searchsorted(self.ends, ends, "left"), np.searchsorted(self.ends, ends, "right")
        count = high - low
        at = np.repeat(at, count)
        which = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        same = (loads[at] & self.mask) == self.first[which]
        at, which = at[same], which[same]
        kept = [text.startswith(self.patterns[w], a) for a, w in zip(at.tolist(), which.tolist())]
        return at[kept], self.ids[which[kept]]


class Searcher:
    """All patterns, in groups whose lengths differ by a factor under two (one group from 32 bytes on)."""

    def __init__(self, patterns: list[bytes]):
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(patterns):
            classes.setdefault(min(len(p).bit_length(), 6), []).append(i)
        self.groups = [Group([patterns[i] for i in ids], np.array(ids)) for ids in classes.values()]

    def search(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and pattern number of every occurrence, in no order."""
        text += bytes(PAD)
        loads = _words(np.frombuffer(text, "u1"))
        both = [g.search(text, loads) for g in self.groups] or [(np.empty(0, "i8"),) * 2]
        return np.concatenate([b[0] for b in both]), np.concatenate([b[1] for b in both])

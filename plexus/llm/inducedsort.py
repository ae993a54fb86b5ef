"""External induced suffix sorting with bucket priority queues that spill to disk.

Suffixes are induced batch by batch: a monotone priority queue, keyed by a
suffix's first character and first-in-first-out within a key, hands out all
tuples of its smallest key at once, and each batch induces the suffixes one
place to the left. Queue blocks beyond a memory budget go to files in the folder
given. Sorted LMS substrings get names; the reduced string of names is sorted by
the same induction while its alphabet is small, and by rank doubling where a
bucket would hold a suffix or two. Order is decided on the first ``depth``
characters only: suffixes that share them may come in any order.

Common-prefix values are carried beside the suffixes as the one bit that is
asked of them: whether a suffix shares ``depth`` bytes with its predecessor.
"""

from __future__ import annotations

import os
import uuid

import numpy as np

from .common import filesystem

SMALL_ALPHABET = 2048
MEMORY = 256 << 20


class BucketQueue:
    """Monotone priority queue of positions; blocks beyond ``memory`` bytes spill to ``folder``."""

    def __init__(self, folder: str | None, memory: int = MEMORY):
        self.folder, self.memory, self.held = folder, memory, 0
        self.blocks: dict[int, list] = {}
        self.files: list[str] = []

    def push(self, keys: np.ndarray, positions: np.ndarray) -> None:
        """Append positions to their keys' queues, in order."""
        if not len(keys):
            return
        order = np.argsort(keys, kind="stable")
        keys, positions = keys[order], positions[order]
        cuts = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            self.blocks.setdefault(int(keys[a]), []).append(positions[a:b].copy())
        self.held += positions.nbytes
        if self.folder and self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        system, root = filesystem(self.folder)
        system.create_dir(root, recursive=True)
        for key, blocks in self.blocks.items():
            fresh = [b for b in blocks if not isinstance(b, str)]
            if not fresh:
                continue
            name = f"{root}/{uuid.uuid4().hex}"
            with system.open_output_stream(name) as out:
                for b in fresh:
                    out.write(b.astype(np.int64).tobytes())
            self.files.append(name)
            # Only the newest blocks are in memory, so their order follows the files'.
            self.blocks[key] = [b for b in blocks if isinstance(b, str)] + [name]
        self.held = 0

    def pop(self, key: int) -> np.ndarray:
        """All positions queued under ``key`` so far."""
        out = []
        for block in self.blocks.pop(key, ()):
            if isinstance(block, str):
                system, _ = filesystem(self.folder)
                with system.open_input_stream(block) as source:
                    out.append(np.frombuffer(source.read(), np.int64))
            else:
                out.append(block)
                self.held -= block.nbytes
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def close(self) -> None:
        if self.files:
            system, _ = filesystem(self.folder)
            for name in self.files:
                system.delete_file(name)
            self.files = []


def suffix_types(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last one is."""
    n = len(text)
    change = np.flatnonzero(text[1:] != text[:-1])
    ends = np.append(change, n - 1)
    rising = np.append(text[change] < text[change + 1], True)
    return np.repeat(rising, np.diff(np.concatenate([[-1], ends])))


def _induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray, folder: str | None, memory: int) -> np.ndarray:
    """Suffix order induced from LMS suffixes in the order ``seeds``."""
    keys = np.unique(text)
    seed_keys = text[seeds]
    order = np.argsort(seed_keys, kind="stable")
    seeds, seed_keys = seeds[order], seed_keys[order]
    first, last = np.searchsorted(seed_keys, keys, "left"), np.searchsorted(seed_keys, keys, "right")
    larges: list[np.ndarray] = []
    queue = BucketQueue(folder, memory)
    try:
        for i, key in enumerate(keys.tolist()):
            got = []
            while len(batch := queue.pop(key)):
                got.append(batch)
                left = batch[batch > 0] - 1
                left = left[~small[left]]
                queue.push(text[left], left)
            larges.append(np.concatenate(got) if got else np.zeros(0, np.int64))
            left = seeds[first[i] : last[i]]
            left = left[left > 0] - 1
            left = left[~small[left]]
            queue.push(text[left], left)
    finally:
        queue.close()
    queue = BucketQueue(folder, memory)
    out: list[np.ndarray] = []
    try:
        for i in range(len(keys) - 1, -1, -1):
            key, got = int(keys[i]), []
            if i == 0:
                queue.push(np.array([key]), np.array([len(text) - 1]))  # the sentinel
            while len(batch := queue.pop(key)):
                got.append(batch)
                left = batch[batch > 0] - 1
                left = left[small[left]]
                queue.push(text[left], left)
            if got:
                out.append(np.concatenate(got))
            batch = larges[i][::-1]
            out.append(batch)
            left = batch[batch > 0] - 1
            left = left[small[left]]
            queue.push(text[left], left)
    finally:
        queue.close()
    return np.concatenate(out)[::-1]


def _same_as_previous(text: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether substring i equals substring i - 1 (False for the first)."""
    same = np.zeros(len(start), bool)
    live = np.flatnonzero(length[1:] == length[:-1]) + 1
    at = 0
    while len(live):
        done = length[live] <= at
        same[live[done]] = True
        live = live[~done]
        live = live[text[start[live] + at] == text[start[live - 1] + at]]
        at += 1
    return same


def _double(names: np.ndarray, rounds: int) -> np.ndarray:
    """Order of the suffixes of ``names`` by their first 2 ** rounds names."""
    rank = names.astype(np.int64)
    n, step = len(rank), 1
    order = np.argsort(rank, kind="stable")
    for _ in range(rounds):
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] + 1 if step < n else 0
        both = rank * (n + 2) + after
        order = np.argsort(both, kind="stable")
        sorted_ = both[order]
        fresh = np.cumsum(np.append([0], sorted_[1:] != sorted_[:-1]))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        step *= 2
        if step >= n:
            break
    return order


def suffix_array(text: np.ndarray, depth: int, folder: str | None = None, memory: int = MEMORY, covered: int = 1) -> np.ndarray:
    """Positions of ``text`` in the order of their first ``depth`` characters.

    ``text`` ends in a sentinel that is smaller than all else. ``covered`` is how
    many characters of the outermost text each of these stands for at least.
    """
    n = len(text)
    if n == 1:
        return np.zeros(1, np.int64)
    small = suffix_types(text)
    marks = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(marks) or marks[-1] != n - 1:
        marks = np.append(marks, n - 1)
    is_mark = np.zeros(n, bool)
    is_mark[marks] = True
    induced = _induce(text, small, marks, folder, memory)
    ordered = induced[is_mark[induced]]
    ends = np.append(marks[1:], n - 1)
    number = np.zeros(n, np.int64)
    number[marks] = np.arange(len(marks))
    which = number[ordered]
    same = _same_as_previous(text, ordered, ends[which] - marks[which] + 1)
    fresh = np.cumsum(~same) - 1
    if fresh[-1] + 1 < len(marks):
        names = np.empty(len(marks), np.int64)
        names[which] = fresh
        covered = 2 * covered
        if covered >= depth:
            order = np.argsort(names, kind="stable")
        elif fresh[-1] < SMALL_ALPHABET:
            order = suffix_array(names, depth, folder, memory, covered)
        else:
            order = _double(names, int(np.ceil(np.log2(max(2, depth / covered)))))
        ordered = marks[order]
    return _induce(text, small, ordered, folder, memory)


def repeated_windows(data: np.ndarray, offsets: np.ndarray, rank: np.ndarray, window: int, folder: str | None = None, memory: int = MEMORY) -> np.ndarray:
    """Positions in ``data`` where a window starts that also starts at a lower rank.

    ``data`` holds pieces cut at ``offsets`` (n + 1 of them); windows stay inside
    a piece. ``rank`` gives, for each byte, its place in the order that decides
    which occurrence is the first.
    """
    lengths = np.diff(offsets)
    keep = lengths >= window
    if not keep.any():
        return np.zeros(0, np.int64)
    # One separator after each piece, a sentinel at the end.
    total = int(offsets[-1]) + len(lengths) + 1
    text = np.ones(total, np.uint16)
    text[-1] = 0
    shift = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(int(offsets[-1])) + shift
    text[at] = data.astype(np.uint16) + 2
    back = np.full(total, -1, np.int64)
    ends = np.repeat(offsets[1:], lengths)
    starts_here = np.arange(int(offsets[-1])) + window <= ends
    back[at[starts_here]] = np.flatnonzero(starts_here)
    order = suffix_array(text, window, folder, memory)
    sorted_ = back[order]
    sorted_ = sorted_[sorted_ >= 0]
    views = np.lib.stride_tricks.sliding_window_view(data, window)
    shares = np.zeros(len(sorted_), bool)  # the carried bit: a common prefix of ``window`` with the predecessor
    for a in range(1, len(sorted_), 100_000):
        b = min(len(sorted_), a + 100_000)
        block = views[sorted_[a - 1 : b]]
        shares[a:b] = (block[1:] == block[:-1]).all(axis=1)
    heads = np.flatnonzero(~shares)
    ranks = rank[sorted_]
    lowest = np.minimum.reduceat(ranks, heads)
    return sorted_[ranks != np.repeat(lowest, np.diff(np.append(heads, len(sorted_))))]


def spill_folder(root: str) -> str:
    """A fresh folder below the shared folder for one task's spilled queue blocks."""
    return os.path.join(root, f"queues-{uuid.uuid4().hex}")

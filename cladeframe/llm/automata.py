"""Weighted acyclic automata over words that count n-grams.

An n-gram is a path from the start; the arc that ends it weighs its count. Arcs of a state are
sorted by word. States are made from sorted n-grams, the deepest first: once the sorted input
has left a prefix its state is closed, and closed states with equal arcs are one.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa


# N-grams that a union holds before equal ones are added up.
UNION_ROWS = 1 << 20


def order_of(grams: np.ndarray) -> np.ndarray:
    """The lexicographic order of n-grams, rows of word numbers (0: no word)."""
    packed = packed_of(grams)
    return np.lexsort(grams.T[::-1]) if packed is None else np.argsort(packed, kind="stable")


def packed_of(grams: np.ndarray) -> np.ndarray | None:
    """N-grams as numbers in the same order, if 63 bits hold them."""
    bits = int(grams.max(initial=0)).bit_length()
    if bits * grams.shape[1] > 63:
        return None
    packed = np.zeros(len(grams), np.int64)
    for column in grams.T:
        packed = (packed << bits) | column
    return packed


def summed(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order, with their counts added up."""
    if not len(grams):
        return grams, counts
    order = order_of(grams)
    grams, counts = grams[order], counts[order]
    first = np.concatenate(([True], (grams[1:] != grams[:-1]).any(1)))
    return grams[first], np.add.reduceat(counts, np.flatnonzero(first))


@dataclass
class Automaton:
    """`words` in byte order; arcs by depth: for each state the arcs from starts[s] to starts[s + 1].

    An arc has a word number (from 1), a weight (0: no n-gram ends here) and the state it leads
    to at the next depth (-1: none).
    """

    words: list[bytes]
    starts: list[np.ndarray]
    labels: list[np.ndarray]
    weights: list[np.ndarray]
    targets: list[np.ndarray]

    def to_bytes(self) -> bytes:
        small = [
            [_least_type(a) for a in level]
            for level in zip(self.starts, self.labels, self.weights, self.targets, strict=True)
        ]
        raw = pickle.dumps((b"\n".join(self.words), len(self.words), small), protocol=5)
        return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    @staticmethod
    def from_bytes(data: bytes) -> Automaton:
        raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
        words, n, small = pickle.loads(raw)
        levels = [[a.astype(np.int64) for a in level] for level in small]
        return Automaton(words.split(b"\n") if n else [], *(list(part) for part in zip(*levels, strict=True)))

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams in order, as rows of word numbers, with their counts."""
        depth = len(self.starts)
        states, prefix = np.zeros(1, np.int64), np.zeros((1, depth), np.int64)
        grams, counts = [], []
        for d in range(depth):
            sizes = self.starts[d][states + 1] - self.starts[d][states]
            from_ = np.repeat(np.arange(len(states)), sizes)
            inner = np.arange(len(from_)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            arcs = self.starts[d][states][from_] + inner
            prefix = prefix[from_]
            prefix[:, d] = self.labels[d][arcs]
            weight, states = self.weights[d][arcs], self.targets[d][arcs]
            ends = weight > 0
            grams.append(prefix[ends])
            counts.append(weight[ends])
            on = states >= 0
            prefix, states = prefix[on], states[on]
        grams, counts = np.concatenate(grams), np.concatenate(counts)
        order = order_of(grams)
        return grams[order], counts[order]


def _least_type(a: np.ndarray) -> np.ndarray:
    low, high = (int(a.min()), int(a.max())) if len(a) else (0, 0)
    for kind in (np.uint8, np.int16, np.int32):
        info = np.iinfo(kind)
        if info.min <= low and high <= info.max:
            return a.astype(kind)
    return a


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _registered(starts: np.ndarray, arcs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For every state the first state with equal arcs, and which states are such firsts.

    States are grouped by a hash of their arcs and compared arc by arc with the first of the group;
    the rare one that differs stays by itself.
    """
    n = len(starts) - 1
    sizes = np.diff(starts)
    hashed = np.zeros(len(arcs[0]), np.uint64)
    for part in arcs:
        hashed = _scramble(hashed + part.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    inner = np.arange(len(hashed)) - np.repeat(starts[:-1], sizes)
    hashed = _scramble(hashed + inner.astype(np.uint64))
    total = np.add.reduceat(hashed, starts[:-1]) if n else hashed
    _, first, group = np.unique(total, return_index=True, return_inverse=True)
    leader = first[group]
    fits = sizes[leader] == sizes
    own = np.repeat(np.arange(n), sizes)
    other = np.minimum(starts[leader][own] + inner, max(0, len(hashed) - 1))
    for part in arcs:
        fits &= np.logical_and.reduceat(part == part[other], starts[:-1]) if n else fits
    leader = np.where(fits, leader, np.arange(n))
    return leader, leader == np.arange(n)


def build(words: list[bytes], grams: np.ndarray, counts: np.ndarray) -> Automaton:
    """The automaton of distinct sorted n-grams; only words that occur are kept."""
    depth = grams.shape[1]
    used = np.unique(grams)
    used = used[used > 0]
    number = np.zeros(len(words) + 1, np.int64)
    number[used] = np.arange(1, len(used) + 1)
    grams = number[grams]
    lengths = (grams > 0).sum(1)
    starts, labels, weights, targets = [], [], [], []
    # Prefixes of each depth, in order: where the sorted n-grams change within their first d words.
    change = np.zeros(len(grams), bool)
    if len(grams):
        change[0] = True
    prefixes = []
    for d in range(depth):
        change = change.copy()
        change[1:] |= grams[1:, d] != grams[:-1, d]
        prefixes.append(np.flatnonzero(change & (grams[:, d] > 0)))
    state_of = np.full(len(prefixes[-1]), -1, np.int64)
    for d in range(depth - 1, -1, -1):
        rows = prefixes[d]
        label = grams[rows, d]
        # An n-gram sorts before all that go on from it, so it is the first of its prefix.
        weight = np.where(lengths[rows] == d + 1, counts[rows], 0)
        if d == 0:
            begin = np.array([0, len(rows)], np.int64)
        else:
            parent = np.searchsorted(prefixes[d - 1], rows, "right") - 1
            begin = np.searchsorted(parent, np.arange(len(prefixes[d - 1]) + 1))
        full = np.flatnonzero(np.diff(begin) > 0)
        spans = np.concatenate((begin[:-1][full], begin[-1:]))
        arcs = [label, weight, state_of]
        if d == 0:
            leader, firsts, spans = np.zeros(1, np.int64), np.ones(1, bool), begin
        else:
            leader, firsts = _registered(spans, arcs)
        sizes = np.diff(spans)
        keep = np.repeat(firsts, sizes)
        starts.insert(0, np.concatenate(([0], np.cumsum(sizes[firsts]))))
        labels.insert(0, label[keep])
        weights.insert(0, weight[keep])
        targets.insert(0, state_of[keep])
        if d:
            place = np.cumsum(firsts) - 1
            state_of = np.full(len(prefixes[d - 1]), -1, np.int64)
            state_of[full] = place[leader]
    return Automaton([words[i - 1] for i in used], starts, labels, weights, targets)


def union(parts: Iterable[Automaton], depth: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, n-grams and added weights of several automata together.

    Parts are opened one at a time. Their n-grams are held as one number each where 63 bits do, and
    equal ones are added up whenever what is held has doubled, so that memory follows the distinct n-grams
    and the largest part and not all parts together.
    """
    number: dict[bytes, int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, limit, bits = 0, UNION_ROWS, 63 // depth
    for part in parts:
        own, weight = part.grams()
        # Words are numbered as they come; their order is known when all have come.
        names = np.array([0, *(number.setdefault(w, len(number) + 1) for w in part.words)], np.int64)
        if len(number) >> bits and held and held[0][0].ndim == 1:
            held = [(unpacked(keys, bits, depth), counts) for keys, counts in held]
        own = names[own]
        held.append((own if len(number) >> bits else packed_by(own, bits), weight))
        size += len(weight)
        if size > limit:
            held = [added(held)]
            size = len(held[0][1])
            limit = max(UNION_ROWS, 2 * size)
    words = sorted(number)
    place = np.zeros(len(words) + 1, np.int64)
    place[[number[w] for w in words]] = np.arange(1, len(words) + 1)
    if not held:
        return words, np.zeros((0, depth), np.int64), np.zeros(0, np.int64)
    keys, counts = added(held)
    held.clear()
    if keys.ndim == 1:
        ordered = np.zeros(len(keys), np.int64)
        for d in range(depth):
            ordered = (ordered << bits) | place[(keys >> (bits * (depth - 1 - d))) & ((1 << bits) - 1)]
        order = np.argsort(ordered)
        return words, unpacked(ordered[order], bits, depth), counts[order]
    return words, *summed(place[keys], counts)


def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, packed or as rows, with their counts added up; empties `held`."""
    keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
    held.clear()
    if keys.ndim > 1:
        return summed(keys, counts)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))[: len(keys)]
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def packed_by(grams: np.ndarray, bits: int) -> np.ndarray:
    """N-grams as one number each, `bits` to a word."""
    packed = np.zeros(len(grams), np.int64)
    for column in grams.T:
        packed = (packed << bits) | column
    return packed


def unpacked(packed: np.ndarray, bits: int, depth: int) -> np.ndarray:
    """Rows of word numbers again."""
    grams = np.empty((len(packed), depth), np.int64)
    for d in range(depth):
        grams[:, d] = (packed >> (bits * (depth - 1 - d))) & ((1 << bits) - 1)
    return grams


def place_of(gram: tuple[bytes, ...], words: np.ndarray, grams: np.ndarray) -> int:
    """How many of the sorted n-grams come before `gram`; `words` is an object array in byte order."""
    low, high = 0, len(grams)
    for d in range(grams.shape[1]):
        if d == len(gram):
            return low
        at = int(np.searchsorted(words, gram[d]))
        column = grams[low:high, d]
        left = low + int(np.searchsorted(column, at + 1))
        if at == len(words) or words[at] != gram[d]:
            return left
        high = low + int(np.searchsorted(column, at + 1, "right"))
        low = left
    return low


def rows_of(wanted: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Where each wanted n-gram stands among the sorted distinct ones; -1 if it is not there."""
    if not len(grams) or not len(wanted):
        return np.full(len(wanted), -1, np.int64)
    both = packed_of(np.concatenate((grams, wanted)))
    if both is not None:
        have, ask = both[: len(grams)], both[len(grams) :]
        at = np.minimum(np.searchsorted(have, ask), len(have) - 1)
        return np.where(have[at] == ask, at, -1)
    table = {g.tobytes(): i for i, g in enumerate(np.ascontiguousarray(grams))}
    return np.array([table.get(g.tobytes(), -1) for g in np.ascontiguousarray(wanted)], np.int64)

"""Suffix order and common prefixes of one shard by external induced sorting.

Suffixes are smaller (L) or not (S) than their successor by type; the S suffixes behind an L suffix are the seeds. Their
substrings are named in order, and if two names are equal, the text of names is sorted the same way, recursively. Then
the queue starts with the seeds: whoever leaves it in order sends the suffix one place to its left back into it, if that
is of type L, under its own first symbol. So all L suffixes leave in order; a second pass, from the largest, gives the S
suffixes. With every suffix goes the length of its common prefix with the one before it under the same symbol: one more
than the least among those that left in between.

The queue keeps its tuples (place, common prefix) by ranges of first symbols, in order of arrival, and writes them to disk
when it holds many. One range is in memory at a time, and its suffixes move as whole arrays: those that the range sends
to itself are found first, generation by generation, and ranked by the rank of their senders. Large texts and orders
are memory-mapped. Common prefixes count up to ``depth`` symbols.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np

from auditframe.session import ship_with_tasks

ship_with_tasks(__name__)

#: Suffixes of a range of first symbols, unless one symbol has more.
RANGE_SUFFIXES = 1 << 15
#: Tuples that a queue holds before it writes them out.
HELD_TUPLES = 1 << 21
#: Bytes of an array that is kept in memory.
HELD_BYTES = 1 << 27
#: Generations within a range that are ranked together; a range with more is halved, down to one symbol.
GENERATIONS = 6


class Shelf:
    """Arrays on disk below one folder; small ones stay in memory."""

    def __init__(self, folder: str):
        self.folder, self.files = folder, 0

    def name(self) -> str:
        self.files += 1
        return os.path.join(self.folder, str(self.files))

    def put(self, values: np.ndarray) -> np.ndarray:
        if values.nbytes <= HELD_BYTES:
            return values
        mapped = np.memmap(self.name(), values.dtype, "w+", shape=values.shape)
        mapped[:] = values
        return mapped


class TupleQueue:
    """Tuples (place, common prefix) by range of first symbols, first in, first out within a range."""

    def __init__(self, shelf: Shelf, ranges: int):
        self.shelf, self.held, self.count = shelf, [[] for _ in range(ranges)], 0
        self.paths: list[str | None] = [None] * ranges

    def push(self, at: int, places: np.ndarray, common: np.ndarray) -> None:
        self.held[at].append((places, common))
        self.count += len(places)
        if self.count > HELD_TUPLES:
            for at, some in enumerate(self.held):
                if some:
                    self.paths[at] = self.paths[at] or self.shelf.name()
                    with open(self.paths[at], "ab") as file:
                        for pair in some:
                            np.stack(pair, axis=1).astype(np.int64).tofile(file)
                    some.clear()
            self.count = 0

    def pop(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        parts = self.held[at]
        self.count -= sum(len(x) for x, _ in parts)
        self.held[at] = []
        if self.paths[at]:
            written = np.fromfile(self.paths[at], np.int64).reshape(-1, 2)
            os.remove(self.paths[at])
            self.paths[at] = None
            parts = [(written[:, 0], written[:, 1].astype(np.int32)), *parts]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        return np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts])


def least_between(values: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least of values[left] .. values[right], for arrays of bounds."""
    if not len(left):
        return np.zeros(0, np.int32)
    width = right - left + 1
    level = np.frexp(width)[1] - 1
    top = int(level.max())
    if not top:
        return values[left]
    table = np.empty((top + 1, len(values)), values.dtype)
    table[0] = values
    for k in range(top):
        np.minimum(table[k, : -(1 << k)], table[k, 1 << k :], out=table[k + 1, : -(1 << k)])
        table[k + 1, len(values) - (1 << k) :] = table[k, len(values) - (1 << k) :]
    return np.minimum(table[level, left], table[level, right - (1 << level) + 1])


def symbol_ranges(counts: np.ndarray, in_runs: np.ndarray) -> np.ndarray:
    """Borders of ranges of consecutive symbols with about ``RANGE_SUFFIXES`` suffixes.

    Frequent symbols stand alone, and so do those that occur in runs, as they send long chains to themselves.
    """
    large = np.flatnonzero((counts > RANGE_SUFFIXES // 2) | in_runs)
    group = np.cumsum(counts) // RANGE_SUFFIXES
    steps = np.flatnonzero(group[1:] != group[:-1]) + 1
    wide = np.arange(0, len(counts), 1 << 15)
    return np.unique(np.concatenate([[0], steps, large, large + 1, wide, [len(counts)]]))


class _Pass:
    """One induction: ``key`` ascends, ``kind`` marks the suffixes to induce."""

    def __init__(self, key: np.ndarray, kind: np.ndarray, run: np.ndarray, edges: np.ndarray, shelf: Shelf, depth: int):
        self.key, self.kind, self.run, self.edges, self.depth = key, kind, run, edges, depth
        self.queue, self.done = TupleQueue(shelf, len(edges) - 1), TupleQueue(shelf, len(edges) - 1)

    def induce(self, seeds: Callable[[int], tuple[np.ndarray, np.ndarray]]) -> None:
        for at in range(len(self.edges) - 1):
            arrived, seeded = self.queue.pop(at), seeds(at)
            places, common, sent, sent_common = self._range(int(self.edges[at]), int(self.edges[at + 1]), *arrived, *seeded)
            if len(places):
                self.done.push(at, places, common)
            self._send(sent, sent_common)

    def _send(self, places: np.ndarray, common: np.ndarray) -> None:
        cuts = np.searchsorted(self.key[places], self.edges)
        for at in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            self.queue.push(at, places[cuts[at] : cuts[at + 1]], common[cuts[at] : cuts[at + 1]])

    def _children(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The members that have a suffix to induce on their left, and those suffixes."""
        members = np.flatnonzero(places > 0)
        members = members[self.kind[places[members] - 1]]
        return members, places[members] - 1

    def _range(self, low: int, high: int, arrived: np.ndarray, arrived_common: np.ndarray, seeds: np.ndarray, seed_common: np.ndarray):
        """The induced suffixes of symbols low .. high - 1 in order, and what they and the seeds send to higher symbols."""
        if not len(arrived) and not len(seeds):
            return arrived, arrived_common, arrived, arrived_common
        if high - low == 1:
            return self._leave(high, *self._one_symbol(arrived, arrived_common, seeds, seed_common))
        places, rank_class = np.concatenate([arrived, seeds]), np.repeat([0, 2], [len(arrived), len(seeds)])
        given, sender = np.concatenate([arrived_common, seed_common]), np.arange(len(places))
        last = np.arange(len(places))
        for generation in range(GENERATIONS + 1):
            members, found = self._children(places[last])
            inside = self.key[found] < high
            if not inside.any():
                break
            if generation == GENERATIONS:
                return self._halves(low, high, arrived, arrived_common, seeds, seed_common)
            members, found = members[inside], found[inside]
            start = len(places)
            sender = np.concatenate([sender, last[members]])
            places, last = np.concatenate([places, found]), np.arange(start, start + len(found))
            rank_class, given = np.concatenate([rank_class, np.ones(len(found), np.int64)]), np.concatenate([given, np.zeros(len(found), np.int32)])
        symbol = (self.key[places] - low).astype(np.uint16)
        own = rank_class == 1
        if own.any():
            rank, order = None, np.lexsort((rank_class, symbol))
            while True:
                new = np.empty(len(order), np.int64)
                new[order] = np.arange(len(order))
                if rank is not None and np.array_equal(new, rank):
                    break
                rank = new
                order = np.lexsort((np.where(own, rank[sender], np.arange(len(places))), rank_class, symbol))
        else:
            order = np.argsort(symbol, kind="stable")
        common = self._common(places[order], symbol[order], rank_class[order], given[order])
        own_pairs = np.flatnonzero((rank_class[order][1:] == 1) & (rank_class[order][:-1] == 1) & (symbol[order][1:] == symbol[order][:-1])) + 1
        if len(own_pairs):
            at = rank[sender[order]]
            while True:
                value = np.minimum(1 + least_between(common, at[own_pairs - 1] + 1, at[own_pairs]), self.depth)
                if np.array_equal(value, common[own_pairs]):
                    break
                common[own_pairs] = value
        return self._leave(high, places[order], rank_class[order] == 2, common)

    def _common(self, places: np.ndarray, symbol: np.ndarray, rank_class: np.ndarray, given: np.ndarray) -> np.ndarray:
        """Common prefixes as far as they are given: within what arrived, within the seeds, and where the kinds meet."""
        common = np.zeros(len(places), np.int32)
        same = symbol[1:] == symbol[:-1]
        before, after = rank_class[:-1], rank_class[1:]
        runs = np.minimum(self.run[places[:-1]], self.run[places[1:]])
        pairs = np.where(before == after, given[1:], np.where(after == 2, runs, 1))
        pairs = np.where((before == 1) & (after == 1), self.depth, pairs)
        common[1:] = np.where(same, pairs, 0)
        return common

    def _one_symbol(self, arrived: np.ndarray, arrived_common: np.ndarray, seeds: np.ndarray, seed_common: np.ndarray):
        """One symbol sends to itself only along its runs: generations follow each other, with runs one longer each."""
        symbol, parts, commons = self.key[arrived[0] if len(arrived) else seeds[0]], [arrived], [arrived_common]
        while len(parts[-1]):
            members, found = self._children(parts[-1])
            inside = self.key[found] == symbol
            members, found = members[inside], found[inside]
            common = np.zeros(len(found), np.int32)
            if len(found) > 1:
                common[1:] = np.minimum(1 + least_between(commons[-1], members[:-1] + 1, members[1:]), self.depth)
            if len(found):
                common[0] = min(self.run[parts[-1][-1]], self.run[found[0]])
            parts.append(found)
            commons.append(common)
        places, common = np.concatenate([*parts, seeds]), np.concatenate([*commons, seed_common])
        first = len(places) - len(seeds)
        if len(seeds) and first:
            common[first] = min(self.run[places[first - 1]], self.run[places[first]])
        common[:1] = 0
        return places, np.arange(len(places)) >= first, common

    def _halves(self, low: int, high: int, arrived: np.ndarray, arrived_common: np.ndarray, seeds: np.ndarray, seed_common: np.ndarray):
        middle = (low + high) // 2
        one, two = self.key[arrived] < middle, self.key[seeds] < middle
        left = self._range(low, middle, arrived[one], arrived_common[one], seeds[two], seed_common[two])
        near = self.key[left[2]] < high
        arrived, arrived_common = np.concatenate([arrived[~one], left[2][near]]), np.concatenate([arrived_common[~one], left[3][near]])
        right = self._range(middle, high, arrived, arrived_common, seeds[~two], seed_common[~two])
        sent, sent_common = np.concatenate([left[2][~near], right[2]]), np.concatenate([left[3][~near], right[3]])
        order = np.argsort(self.key[sent], kind="stable")
        return np.concatenate([left[0], right[0]]), np.concatenate([left[1], right[1]]), sent[order], sent_common[order]

    def _leave(self, high: int, places: np.ndarray, seeded: np.ndarray, common: np.ndarray):
        members, found = self._children(places)
        outside = self.key[found] >= high
        members, found = members[outside], found[outside]
        order = np.argsort(self.key[found], kind="stable")
        members, found = members[order], found[order]
        sent_common = np.ones(len(found), np.int32)
        same = np.flatnonzero(self.key[found[1:]] == self.key[found[:-1]]) + 1
        sent_common[same] = np.minimum(1 + least_between(common, members[same - 1] + 1, members[same]), self.depth)
        return places[~seeded], common[~seeded], found, sent_common


def _backwards(places: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    turned = np.zeros(len(common), np.int32)
    turned[1:] = common[:0:-1]
    return places[::-1], turned


def _only(keep: np.ndarray, places: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some of the suffixes in order; their common prefixes are the least on the way from the one before."""
    at = np.flatnonzero(keep)
    least = np.zeros(len(at), np.int32)
    least[1:] = least_between(common, at[:-1] + 1, at[1:])
    return places[at], least


def substring_names(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each start to the next one, both included; equal substrings have equal ranks."""
    lengths = np.append(np.diff(starts) + 1, 1)
    bits = int(symbols.max()).bit_length()
    step = max(1, 63 // bits)
    rank, active, offset = np.zeros(len(starts), np.int64), np.arange(len(starts)), 0
    while len(active):
        key = np.zeros(len(active), np.int64)
        for i in range(step):
            inside = offset + i < lengths[active]
            key = (key << bits) | np.where(inside, symbols[np.minimum(starts[active] + offset + i, len(symbols) - 1)], 0)
        order = np.lexsort((key, rank[active]))
        active, key = active[order], key[order]
        group = rank[active]
        place = np.arange(len(active))
        new_group = np.append(True, group[1:] != group[:-1])
        new = new_group | np.append(True, key[1:] != key[:-1])
        first = np.maximum.accumulate(np.where(new, place, 0))
        rank[active] = group + first - np.maximum.accumulate(np.where(new_group, place, 0))
        offset += step
        alone = new & np.append(new[1:], True)
        active = active[~alone & (lengths[active] > offset)]
    present = np.zeros(len(starts) + 1, np.int64)
    present[rank] = 1
    return (np.cumsum(present) - 1)[rank]


def _further(symbols: np.ndarray, one: np.ndarray, two: np.ndarray, common: np.ndarray, depth: int) -> np.ndarray:
    """``common`` plus what the suffixes at ``one`` and ``two`` have in common, symbol by symbol."""
    common, active, last = common.copy(), np.flatnonzero(common < depth), len(symbols) - 1
    step = 0
    while len(active):
        a, b = one[active] + step, two[active] + step
        active = active[(a < last) & (b < last) & (symbols[np.minimum(a, last)] == symbols[np.minimum(b, last)])]
        common[active] += 1
        active = active[common[active] < depth]
        step += 1
    return common


def suffix_order(symbols: np.ndarray, shelf: Shelf, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes of ``symbols`` in order, with common prefixes; range by range of first symbols.

    The last symbol must be 0 and the only one. Common prefixes are right within a first symbol, else 0.
    """
    n = len(symbols)
    turns = np.flatnonzero(symbols[:-1] != symbols[1:])
    lengths = np.diff(turns, prepend=-1)
    rising = np.append(np.repeat(symbols[turns] < symbols[turns + 1], lengths), True)
    run = np.append(np.minimum(np.repeat(turns, lengths) - np.arange(n - 1) + 1, depth), 1).astype(np.int32)
    seeds = np.flatnonzero(rising[1:] & ~rising[:-1]) + 1
    if n == 1:
        yield np.zeros(1, np.int64), np.zeros(1, np.int32)
        return
    names = substring_names(2 * symbols.astype(np.int64) + rising, seeds)
    if names.max() + 1 == len(seeds):
        order, common = np.argsort(names), np.zeros(len(seeds), np.int32)
    else:
        parts = list(suffix_order(shelf.put(names.astype(np.int32)), shelf, depth))
        order, common = (np.concatenate(x) for x in zip(*parts))
    before = np.append(order[:1], order[:-1])
    shared = seeds[np.minimum(order + common, len(seeds) - 1)] - seeds[order]
    common = _further(symbols, seeds[before] + shared, seeds[order] + shared, np.minimum(shared, depth).astype(np.int32), depth)
    common[:1] = 0
    order = seeds[order]
    top = int(symbols.max()) + 1
    in_runs = np.zeros(top, bool)
    in_runs[symbols[turns[lengths > 1]]] = True
    edges = symbol_ranges(np.bincount(symbols, minlength=top), in_runs)
    cuts = np.searchsorted(symbols[order], edges)
    small = _Pass(symbols, ~rising, run, edges, shelf, depth)
    small.induce(lambda at: (order[cuts[at] : cuts[at + 1]], common[cuts[at] : cuts[at + 1]]))
    del names
    ranges = len(edges) - 1
    rows = TupleQueue(shelf, ranges)

    def from_the_top(at: int) -> tuple[np.ndarray, np.ndarray]:
        places, common = small.done.pop(ranges - 1 - at)
        if len(places):
            rows.push(ranges - 1 - at, places, common)
        places, common = _backwards(places, common)
        keep = np.zeros(len(places), bool)
        keep[places > 0] = rising[places[places > 0] - 1]
        return _only(keep, places, common)

    large = _Pass(top - 1 - symbols.astype(np.int64), rising, run, top - edges[::-1], shelf, depth)
    large.induce(from_the_top)
    for at in range(ranges):
        falling_places, falling_common = rows.pop(at)
        rising_places, rising_common = _backwards(*large.done.pop(ranges - 1 - at))
        if at == 0:
            rising_places, rising_common = np.append(n - 1, rising_places), np.append(0, rising_common)
        places, common = np.concatenate([falling_places, rising_places]), np.concatenate([falling_common, rising_common])
        if not len(places):
            continue
        kind = np.repeat([0, 1], [len(falling_places), len(rising_places)])
        first = symbols[places]
        order = np.argsort(first, kind="stable")
        places, common, kind, first = places[order], common[order], kind[order], first[order]
        same = first[1:] == first[:-1]
        meet = same & (kind[1:] != kind[:-1])
        common[1:] = np.where(meet, np.minimum(run[places[1:]], run[places[:-1]]), np.where(same, common[1:], 0))
        common[0] = 0
        yield places, common

"""A radix trie over byte strings whose leaves hold counters, mergeable, and traversed in byte (UTF-8) order.

An inner node is a dict from the first byte of an edge to [label, child]; a child is another dict, and the key -1 of a node
holds the number of the leaf that ends there. Counters are not kept in the leaves but beside them, as columns
(leaf, counter, amount) that are summed when they have doubled, which takes a few bytes an entry.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

END = -1


class Trie:
    """Byte strings with numbered leaves."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.size = 0

    def leaf(self, key: bytes) -> int:
        """The number of the leaf of ``key``, which is added if it is new."""
        node, at = self.root, 0
        while at < len(key):
            edge = node.get(key[at])
            if edge is None:
                node[key[at]] = [key[at:], {END: self.size}]
                self.size += 1
                return self.size - 1
            label = edge[0]
            if key.startswith(label, at):
                node, at = edge[1], at + len(label)
                continue
            same = 1
            most = min(len(label), len(key) - at)
            while same < most and label[same] == key[at + same]:
                same += 1
            # the edge is cut where the strings part
            edge[0], edge[1] = label[:same], {label[same]: [label[same:], edge[1]]}
            node, at = edge[1], at + same
        if END not in node:
            node[END] = self.size
            self.size += 1
        return node[END]

    def leaves(self) -> Iterator[tuple[bytes, int]]:
        """(key, leaf) in byte order."""
        stack: list[tuple[bytes, dict]] = [(b"", self.root)]
        while stack:
            key, node = stack.pop()
            if END in node:
                yield key, node[END]
            for first in sorted((b for b in node if b != END), reverse=True):
                label, child = node[first]
                stack.append((key + label, child))


class Counters:
    """Amounts by (leaf, counter), summed now and then."""

    def __init__(self) -> None:
        self.keys, self.amounts = np.empty(0, np.int64), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = 0

    def add(self, leaf: np.ndarray, counter: np.ndarray, amount: np.ndarray) -> None:
        """Counters are below 2^24."""
        self.waiting.append((leaf.astype(np.int64) << 24 | counter, amount.astype(np.int64)))
        self.n_waiting += len(leaf)
        if self.n_waiting > max(1 << 20, len(self.keys)):
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(leaf, counter, amount), each pair once, in order."""
        if self.waiting:
            keys = np.concatenate([self.keys, *(k for k, _ in self.waiting)])
            amounts = np.concatenate([self.amounts, *(a for _, a in self.waiting)])
            order = np.argsort(keys, kind="stable")
            keys, amounts = keys[order], amounts[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
            self.keys, self.amounts = keys[first], np.add.reduceat(amounts, first) if len(first) else amounts
            self.waiting, self.n_waiting = [], 0
        return self.keys >> 24, self.keys & (1 << 24) - 1, self.amounts


class CountedTrie:
    """A trie of terms: for each, the documents that hold it, and its occurrences by source."""

    def __init__(self) -> None:
        self.trie, self.docs, self.by_source = Trie(), Counters(), Counters()

    def leaves_of(self, terms: Iterable[bytes]) -> np.ndarray:
        return np.fromiter(map(self.trie.leaf, terms), np.int64)

    def rows(self) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Terms in byte order, documents of each, then where each one's counters begin, sources and amounts."""
        keys, order = [], np.empty(self.trie.size, np.int64)
        for k, (key, leaf) in enumerate(self.trie.leaves()):
            keys.append(key)
            order[leaf] = k
        docs = np.zeros(len(keys), np.int64)
        leaf, _, amount = self.docs.settle()
        docs[order[leaf]] = amount
        leaf, source, amount = self.by_source.settle()
        place = order[leaf]
        by = np.argsort(place, kind="stable")
        return keys, docs, np.searchsorted(place[by], np.arange(len(keys) + 1)), source[by], amount[by]

"""Byte-pair merging with a segment tree over adjacent pair ranks, and the pre-tokens it runs on.

Each leaf of the tree holds ``rank * width + position`` of the pair that starts there, each inner node the
smaller of its children, so the root is the leftmost of the lowest-ranked pairs. A merge changes three
leaves (the pair itself, its left and its right neighbour), each a logarithmic point update, and merging
ends when no leaf holds a rank. Short pre-tokens go through many trees at once, one row of a numpy array
each; long ones through a tree of their own.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from collections.abc import Iterable, Sequence

import numpy as np
from tokenizers import Tokenizer

_NONE = np.iinfo(np.int64).max
#: Pre-tokens of at most so many bytes are merged side by side.
SHORT = 64


@functools.cache
def _byte_chars() -> list[str]:
    """Byte -> the character that byte-level vocabularies write for it: printable bytes stand for themselves, the others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256))
    return [chr(b) if b in plain else chr(256 + next(rest)) for b in range(256)]


def _class(wanted: str, top: int) -> str:
    return "".join(re.escape(chr(c)) for c in range(top) if unicodedata.category(chr(c))[0] in wanted)


class Engine:
    """One vocabulary. ``ids_of`` encodes pre-tokens, ``pre_tokens`` cuts a text into them."""

    #: Texts of these characters only are cut here; others by the normaliser and pre-tokeniser of the file.
    _TOP = 0x180

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, chars = spec["model"], _byte_chars()
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.tokens = [""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.tokens[i] = token
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for token, i in self.special.items():
            self.tokens[i] = token
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        n = self.n = len(self.tokens)
        pairs = [(x, y) if isinstance(x, str) else x for x, y in model["merges"]] if model["merges"] and not isinstance(model["merges"][0], str) else [m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] * n + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        self.rank_of = {int(k): int(r) for k, r in zip(self.keys, self.rank, strict=True)}
        self.library = Tokenizer.from_file(path)
        self._special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        letters, numbers = _class("L", self._TOP), _class("N", self._TOP)
        blank = "\t\n\x0b\x0c\r \x85\xa0"
        self._words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{blank}{letters}{numbers}]+")
        self._plain = re.compile("[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ž]*")
        self._own_words = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+" and [x["type"] for x in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        self._bytes = {c: b for b, c in enumerate(chars)}

    # -- cutting ---------------------------------------------------------------------------------------

    def pieces(self, text: str) -> list[str | int]:
        """The pre-tokens of a text in order; a special token inside it is given as its id."""
        if self._own_words and "<|" not in text and self._plain.fullmatch(text):
            return self._words.findall(text.lower())  # type: ignore[return-value]
        out: list[str | int] = []
        for part in self._special.split(text) if self._special else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                for word, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part)):
                    out.append(bytes(self._bytes[c] for c in word).decode("utf-8", "surrogateescape"))
        return out

    # -- merging ---------------------------------------------------------------------------------------

    def ids_of(self, words: Sequence[str]) -> list[np.ndarray]:
        """Token ids of each pre-token."""
        raw = [w.encode("utf-8", "surrogateescape") for w in words]
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(raw)
        groups: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            if len(b) > SHORT:
                out[i] = self._one(b)
            elif b:
                groups.setdefault(max(2, 1 << (len(b) - 1).bit_length()), []).append(i)
        for width, members in groups.items():
            for k in range(0, len(members), 8192):
                part = members[k : k + 8192]
                for i, ids in zip(part, self._many([raw[i] for i in part], width), strict=True):
                    out[i] = ids
        return out

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 if they don't merge."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.rank[at], -1)

    def _many(self, words: list[bytes], width: int) -> list[np.ndarray]:
        """Merge words of at most ``width`` bytes (a power of two), a row of the arrays each."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
        at = np.arange(width)
        ids = np.where(at < lengths[:, None], self.inner[raw], -1)
        ids[np.arange(n), lengths - 1] = self.last[raw[np.arange(n), lengths - 1]]
        after = np.where(at + 1 < lengths[:, None], at + 1, -1)
        before = np.broadcast_to(at - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), _NONE)
        rank = self._ranks(ids[:, :-1], ids[:, 1:])
        tree[:, width : 2 * width - 1] = np.where(rank >= 0, rank * width + at[:-1], _NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2

        def update(rows: np.ndarray, pos: np.ndarray, value: np.ndarray) -> None:
            node = pos + width
            tree[rows, node] = value
            while node[0] > 1:
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        live = np.flatnonzero(tree[:, 1] != _NONE)
        while len(live):
            root = tree[live, 1]
            pos, made = root % width, self.made[root // width]
            right = after[live, pos]
            beyond = after[live, right]
            ids[live, pos], ids[live, right] = made, -1
            after[live, pos] = beyond
            has = beyond >= 0
            before[live[has], beyond[has]] = pos[has]
            update(live, right, np.full(len(live), _NONE))
            new = self._ranks(made, np.where(has, ids[live, beyond], -1))
            update(live, pos, np.where(new >= 0, new * width + pos, _NONE))
            back = before[live, pos]
            some = np.flatnonzero(back >= 0)
            if len(some):
                rows, back = live[some], back[some]
                new = self._ranks(ids[rows, back], made[some])
                update(rows, back, np.where(new >= 0, new * width + back, _NONE))
            live = live[tree[live, 1] != _NONE]
        keep = ids >= 0
        return np.split(ids[keep], np.cumsum(keep.sum(1))[:-1])

    def _one(self, word: bytes) -> np.ndarray:
        """Merge one long word with a tree of its own."""
        n = len(word)
        width = 1 << (n - 1).bit_length()
        ids = self.inner[np.frombuffer(word, np.uint8)].tolist()
        ids[-1] = int(self.last[word[-1]])
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        none, get, size = 1 << 62, self.rank_of.get, self.n
        tree = [none] * (2 * width)

        def value(p: int) -> int:
            q = after[p]
            r = get(ids[p] * size + ids[q], -1) if q >= 0 else -1
            return none if r < 0 else r * width + p

        for p in range(n):
            tree[width + p] = value(p)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def update(p: int, to: int) -> None:
            node = p + width
            tree[node] = to
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    return
                tree[node] = low

        while (root := tree[1]) != none:
            p = root % width
            q = after[p]
            ids[p], ids[q] = int(self.made[root // width]), -1
            after[p] = after[q]
            if after[p] >= 0:
                before[after[p]] = p
            update(q, none)
            update(p, value(p))
            if before[p] >= 0:
                update(before[p], value(before[p]))
        return np.array([i for i in ids if i >= 0], np.int64)

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens of the ids joined by one space, as the library does for a file without a decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def engine(path: str) -> Engine:
    """One engine per worker and file."""
    return Engine(path)

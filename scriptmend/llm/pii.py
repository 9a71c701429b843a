"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

Base spans come from four patterns. The method adds what they miss (numbers without a country code,
addresses with the sign spelled out): a field with the tags below is trained on a small labelled table and
decoded by Viterbi over whole lines, many at a time in numpy; lines without a digit, an "at" and a "dot" hold no span and
are passed over. A word's features depend on its shape and on
whether it is a cue ("call", "at", "dot"); emissions are sums over the word and its two neighbours.

Defined results: a null text is empty and has no spans; repeated rows give repeated rows; an empty table gives an
empty result; extra columns are not read; texts, lines, words, numbers and addresses may have any length; of the
field's spans one that touches a base span, or an earlier one, goes (of two that begin together the shorter).
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spans as S
from .common import texts

KINDS = ("email", "ip", "card", "phone", "id")

_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Begins where a run of digits does: from inside it would meet the same dot. So each run is read once.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _byte(digits: str) -> bool:
    """Whether a number of any length is at most 255."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, found from each ``@`` outwards."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (host := _HOST.match(text, at + 1)):
            free = host.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[S.Span]:
    """The four fixed kinds, leftmost and non-overlapping per kind; matches that fail their check go."""
    found: list[S.Span] = []
    if "@" in text:
        found += [("email", *s) for s in emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= sum(map(m[0].count, "0123456789")) <= 15]
    return found


# --- features -----------------------------------------------------------------------------------------

TAGS = ("O", "B-phone", "I-phone", "B-email", "I-email", "B-id", "I-id")
_ALLOWED = np.array([[not b.startswith("I-") or a[2:] == b[2:] and a != "O" for b in TAGS] for a in TAGS])
_OUTSIDE = np.array([-1e4 if t.startswith("I-") else 0.0 for t in TAGS], np.float32)
_CUES = {"call": "call", "phone": "call", "tel": "call", "mobile": "call", "fax": "call", "dial": "call", "at": "at", "dot": "dot", "mail": "mail", "email": "mail", "write": "mail", "ssn": "id", "id": "id", "passport": "id"}
_TLD = {"com", "org", "net", "edu", "gov", "io"}


def shape(word: str) -> str:
    """What the field sees of a word: its cue class, or its characters as classes, digits kept one by one up to 5, other runs collapsed."""
    core = word.rstrip(".,;:!?")
    if core.isalpha():
        low = core.lower() if len(core) <= 8 else ""
        if low in _TLD:
            return "tld" + word[len(core) :][:1]
        if low in _CUES:
            return f"cue-{_CUES[low]}"
        return ("X" if core[0].isupper() else "x") + word[len(core) :][:1]
    low = core.lower()
    if low in ("(at)", "[at]", "{at}"):
        return "marked-at"
    if low in ("(dot)", "[dot]", "{dot}"):
        return "marked-dot"
    out = _RUN_OF_LETTERS.sub("x", word)
    out = _RUN_OF_DIGITS.sub("9+", _ONE_DIGIT.sub("9", out))
    return _RUN.sub(r"\1", _FOREIGN.sub("~", out))


_RUN_OF_LETTERS, _ONE_DIGIT, _RUN_OF_DIGITS, _FOREIGN, _RUN = map(re.compile, (r"[^\W\d_]+", r"\d", r"9{5,}", r"[^\x00-\x7f]", r"([^9])\1+"))


def features(s: str) -> tuple[str, ...]:
    """A shape, and the coarser facts that stand in for shapes that training did not hold."""
    if s.startswith(("cue", "marked", "tld")):
        return ("=" + s,)
    if s[0] in "xX" and len(s) <= 2 and s[1:] not in ("9", "@"):
        return ("word", "=" + s)
    core = s.rstrip(".,;:!?").strip("()[]\"'")
    n = core.count("9")
    return ("=" + s, "core=" + core, "digits" if n else "no-digits", "only-digits" if core and not core.replace("9", "").strip("+") else "mixed", "@" if "@" in s else "no-@", f"n{min(n, 12)}" if n else "n0", "dashed" if re.fullmatch(r"\(?9+\)?(?:[-./)]\(?9+\)?)+", core) else "undashed", "ends" if s[-1:] in ".,;:!?" else "goes-on")


# --- the labelled table and training ------------------------------------------------------------------


def labelled_rows(n: int = 240, seed: int = 7) -> list[tuple[list[str], list[str]]]:
    """The small labelled table: ``n`` lines of words with their tags, from templates."""
    rng = random.Random(seed)
    syllables = "the an er on re ti ver en ich le qu eau de la os ción mente ta ka lo mi su ra".split()
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def word() -> str:
        w = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
        w = w.capitalize() if rng.random() < 0.12 else w
        return w + rng.choice(["", "", "", "", "", ",", ".", "!", ":"])

    def noise() -> list[str]:
        return rng.choice(
            [
                lambda: [digits(rng.randint(1, 4)) + rng.choice(["", ".", ",", "%", "."])],
                lambda: [f"{digits(1)}.{digits(1)}."],
                lambda: [digits(rng.randint(5, 18))],
                lambda: [f"{digits(4)}-{digits(2)}-{digits(2)}"],
                lambda: [f"{digits(2)}:{digits(2)}"],
                lambda: [f"{digits(1)},{digits(3)}"],
                lambda: [f"${digits(3)}.{digits(2)}"],
                lambda: [f"v{digits(1)}.{digits(1)}.{digits(1)}"],
                lambda: [f"({digits(4)})"],
                lambda: [f"{digits(2)}/{digits(2)}/{digits(4)}"],
                lambda: ["at", word()],
                lambda: [word(), "dot", word()],
                lambda: ["call", word()],
                lambda: [f"{word().strip('.,!:')}=a{digits(2)}b{digits(9)}"],
                lambda: ["".join(rng.choice("0123456789abcdef") for _ in range(40))],
                lambda: ["AKIA" + "".join(rng.choice("ABCDEFGHIJ234567") for _ in range(16))],
                lambda: [rng.choice("#*$%&|<>") * rng.randint(1, 6)],
                lambda: [f"{digits(2)}.{digits(3)}.{digits(2)}.{digits(3)}"],
                lambda: [f"{word().strip('.,!:')}.{digits(2)}@mail{digits(1)}.example.com"],
                lambda: ["+" + digits(1), f"({digits(3)})", f"{digits(3)}-{digits(4)}"],
                lambda: [digits(4), digits(4), digits(4), digits(4)],
                lambda: [rng.choice(["at", "At", "at.", "dot", "call", word()])] * rng.randint(3, 9),
                lambda: [word().strip(".,!:") + "." + word()] * rng.randint(1, 5),
                lambda: ["it", "at", word(), "at", "at", word()],
            ]
        )()

    def private() -> tuple[list[str], str]:
        end = rng.choice(["", "", "", ".", ","])
        name, host = "".join(rng.choice(syllables) for _ in range(2)), "".join(rng.choice(syllables) for _ in range(2))
        tld = rng.choice(sorted(_TLD))
        return rng.choice(
            [
                lambda: ([f"({digits(3)})", f"{digits(3)}-{digits(4)}{end}"], "phone"),
                lambda: ([f"({digits(3)}){digits(3)}-{digits(4)}{end}"], "phone"),
                lambda: ([f"{digits(3)}-{digits(3)}-{digits(4)}{end}"], "phone"),
                lambda: ([f"{digits(3)}.{digits(3)}.{digits(4)}{end}"], "phone"),
                lambda: ([name, "(at)", host, "(dot)", tld + end], "email"),
                lambda: ([name, "[at]", host, "[dot]", tld + end], "email"),
                lambda: ([name, "at", host, "dot", tld + end], "email"),
                lambda: ([name, "(at)", f"{host}.{tld}{end}"], "email"),
                lambda: ([f"{digits(3)}-{digits(2)}-{digits(4)}{end}"], "id"),
                lambda: (["0" + digits(2), digits(4), digits(4) + end], "phone"),
                lambda: ([f"0{digits(3)}-{digits(3)}-{digits(4)}{end}"], "phone"),
                lambda: ([f"0{digits(3)}", digits(rng.choice([6, 7])) + end], "phone"),
                lambda: ([f"{name}.{host}", "at", f"{host}{name}", "dot", tld + end], "email"),
                lambda: ([f"{name}{digits(2)}", "at", f"{host}.{tld}{end}"], "email"),
                lambda: ([digits(9) + end], "cued id"),
                lambda: ([digits(3), digits(2), digits(4) + end], "cued id"),
            ]
        )()

    rows = []
    for _ in range(n):
        words: list[str] = []
        tags: list[str] = []
        for _ in range(rng.randint(1, 4)):
            plain = [word() for _ in range(rng.randint(1, 6))] + (noise() if rng.random() < 0.6 else [])
            words += plain
            tags += ["O"] * len(plain)
            if rng.random() < 0.5:
                span, kind = private()
                if kind.startswith("cued"):
                    words.append(rng.choice(["ssn", "SSN", "id", "ID", "passport"]) + rng.choice(["", ":"]))
                    tags.append("O")
                    kind = kind[5:]
                words += span
                tags += ["B-" + kind] + ["I-" + kind] * (len(span) - 1)
        rows.append((words, tags))
    return rows


class Field:
    """Weights of a linear-chain field: feature x place x tag, and tag x tag."""

    PLACES = (0, -1, 1)

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray) -> None:
        self.index, self.weights, self.moves = index, weights, moves
        self._rows: dict[str, np.ndarray] = {}
        self._chars = 0

    def row(self, s: str) -> np.ndarray:
        """(place x tag) weights of a shape."""
        if s not in self._rows:
            if len(self._rows) > 50_000 or self._chars > 8_000_000:
                self._rows.clear()
                self._chars = 0
            known = [self.index[f] for f in features(s) if f in self.index]
            self._chars += len(s)
            self._rows[s] = self.weights[known].sum(0) if known else np.zeros(self.weights.shape[1:])
        return self._rows[s]


def train(rows: Sequence[tuple[list[str], list[str]]], rounds: int = 150, rate: float = 0.4, decay: float = 3e-5) -> Field:
    """Maximum likelihood by forward-backward and adaptive gradient steps; ``rows`` is bounded by its maker."""
    index: dict[str, int] = {}
    lines = []
    for words, tags in rows:
        feats = [[index.setdefault(f, len(index)) for f in features(shape(w))] for w in words]
        lines.append((feats, [TAGS.index(t) for t in tags]))
    k, n, longest = len(TAGS), len(lines), max(len(t) for _, t in lines)
    seen = np.zeros((n, longest, len(index)), np.float32)
    gold, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
    for i, (feats, tags) in enumerate(lines):
        for t, own in enumerate(feats):
            seen[i, t, own] = 1
        gold[i, : len(tags)], mask[i, : len(tags)] = tags, True
    around = np.stack([seen, np.pad(seen, ((0, 0), (1, 0), (0, 0)))[:, :-1], np.pad(seen, ((0, 0), (0, 1), (0, 0)))[:, 1:]])
    flat = around.reshape(3, -1, len(index))
    weights, moves = np.zeros((len(index), 3, k)), np.where(_ALLOWED, 0.0, -30.0)
    sums = [np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)]
    onehot = np.eye(k)[gold] * mask[..., None]
    pairs = (onehot[:, :-1, :, None] * onehot[:, 1:, None, :]).sum((0, 1))
    start = np.where([t.startswith("I-") for t in TAGS], -30.0, 0.0)
    ends = mask.sum(1) - 1
    for _ in range(rounds):
        score = sum(around[p] @ weights[:, p].astype(np.float32) for p in range(3)).astype(float)
        score[:, 0] += start
        local, jump = np.exp(score - score.max(2, keepdims=True)), np.exp(moves)
        ahead, back, scale = np.zeros_like(local), np.ones_like(local), np.ones((n, longest, 1))
        for t in range(longest):
            step = local[:, t] if t == 0 else (ahead[:, t - 1] @ jump) * local[:, t]
            scale[:, t] = step.sum(1, keepdims=True)
            ahead[:, t] = step / scale[:, t]
        for t in range(longest - 2, -1, -1):
            step = (local[:, t + 1] * back[:, t + 1]) @ jump.T / scale[:, t + 1]
            back[:, t] = np.where(mask[:, t + 1, None], step, 1)
        belief = ahead * back * mask[..., None]
        onward = local[:, 1:] * back[:, 1:] / scale[:, 1:] * mask[:, 1:, None]
        joint = np.einsum("nti,ntj->ij", ahead[:, :-1], onward, optimize=True) * jump
        grads = [np.stack([flat[p].T @ (onehot - belief).reshape(-1, k).astype(np.float32) for p in range(3)], 1) / n - decay * weights, np.where(_ALLOWED, (pairs - joint) / n - decay * moves, 0)]
        for at, g, s in zip((weights, moves), grads, sums, strict=True):
            s += g * g
            at += rate * g / np.sqrt(s)
    return Field(index, weights, np.where(_ALLOWED, moves, -1e4))


@functools.lru_cache(maxsize=2)
def trained(n: int = 240, seed: int = 7) -> Field:
    return train(labelled_rows(n, seed))


# --- decoding -----------------------------------------------------------------------------------------


_SOURCES = [[int(i) for i in np.flatnonzero(_ALLOWED[:, j])] for j in range(len(TAGS))]


def exact(x: np.ndarray) -> np.ndarray:
    """Scores as multiples of 2^-20, whose sums over up to 10^8 words have no rounding: however a chain is cut, its scores are the same."""
    return np.round(np.asarray(x, np.float64) * 2**20) / 2**20


def viterbi(emissions: np.ndarray, lengths: np.ndarray, moves: np.ndarray, first: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
    """Best tags of a batch (step x tag x chain, padded at the end) as chain x step; steps beyond a chain's length give 0. ``first`` (tag x chain) is what leads to the first step, ``ends`` the last tags, if known."""
    steps, k, n = emissions.shape
    best = emissions[0] + (_OUTSIDE[:, None] if first is None else first)
    back = np.zeros((steps, k, n), np.int8)
    for t in range(1, steps):
        new, came = np.empty_like(best), back[t]
        for j, from_tags in enumerate(_SOURCES):
            top = best[from_tags[0]] + moves[from_tags[0], j]
            came[j] = from_tags[0]
            for i in from_tags[1:]:
                other = best[i] + moves[i, j]
                came[j][other > top] = i
                np.maximum(top, other, out=top)
            new[j] = top
        new += emissions[t]
        over = t >= lengths
        if over.any():
            new[:, over] = best[:, over]
            came[:, over] = np.arange(k, dtype=np.int8)[:, None]
        best = new
    out = np.zeros((n, steps), np.int8)
    tag = best.argmax(0) if ends is None else ends
    rows = np.arange(n)
    for t in range(steps - 1, -1, -1):
        out[:, t] = np.where(t < lengths, tag, 0)
        tag = back[t][tag, rows]
    return out


def through(emissions: np.ndarray, first: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best scores (tag before x last tag x chain) of chains that begin with what leads to each first tag from each tag before."""
    best = first + emissions[0]
    for t in range(1, len(emissions)):
        new = np.empty_like(best)
        for j, from_tags in enumerate(_SOURCES):
            top = best[:, from_tags[0]] + moves[from_tags[0], j]
            for i in from_tags[1:]:
                np.maximum(top, best[:, i] + moves[i, j], out=top)
            new[:, j] = top + emissions[t][j]
        over = t >= lengths
        if over.any():
            new[:, :, over] = best[:, :, over]
        best = new
    return best


def viterbi_blocks(emissions_of: Callable[[int, int], np.ndarray], size: int, moves: np.ndarray, block: int = 256, at_once: int = 1024) -> np.ndarray:
    """Best tags of one long chain of ``size`` steps, ``emissions_of(a, b)`` (step x tag) giving those of some.

    All blocks are stepped through side by side, each from every tag that may stand before it; the blocks' tag by tag scores are then joined in
    order, which settles the tags at their borders, and each block is decoded between those.
    """
    k, n = len(moves), -(-size // block)

    def lots() -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        for a in range(0, n, at_once):
            b = min(n, a + at_once)
            rows = np.zeros(((b - a) * block, k))
            own = emissions_of(a * block, min(size, b * block))
            rows[: len(own)] = own
            yield a, b, rows.reshape(b - a, block, k).transpose(1, 2, 0).copy(), np.minimum(block, size - np.arange(a, b) * block)

    came, total = np.zeros((n, k), np.int8), None
    for a, b, emissions, lengths in lots():
        first = np.repeat(moves[:, :, None], b - a, 2)
        if a == 0:
            first[:, :, 0] = _OUTSIDE
        scores = through(emissions, first, lengths, moves)
        for t in range(b - a):
            if total is None:
                total = scores[0, :, t]
                continue
            to = total[:, None] + scores[:, :, t]
            came[a + t], total = to.argmax(0), to.max(0)
    ends = np.zeros(n, np.int64)
    ends[-1] = total.argmax()
    for t in range(n - 1, 0, -1):
        ends[t - 1] = came[t, ends[t]]
    out = np.zeros(n * block, np.int8)
    for a, b, emissions, lengths in lots():
        first = moves[ends[np.arange(a, b) - 1]].T.copy()
        if a == 0:
            first[:, 0] = _OUTSIDE
        out[a * block : b * block] = viterbi(emissions, lengths, moves, first, ends[a:b]).reshape(-1)
    return out[:size]


class Decoder:
    """A field, with tables of its emissions by word code, bounded and emptied when full.

    The chains are whole lines, those of more than ``LONG`` words decoded in blocks. A line without a word that can belong to a span at all (one with a digit, or an
    "at" or a "dot" in any spelling) has none and is passed over.
    """

    CELLS, WORDS, CHARS, LONG = 60_000, 400_000, 16_000_000, 1024

    def __init__(self, field: Field) -> None:
        self.field, self.moves = field, exact(field.moves)
        self._clear()

    def _clear(self) -> None:
        self.codes: dict[str, int] = {}
        self.shapes: dict[str, int] = {"": 0}
        self.chars = 0
        self.table = np.zeros((64, 3, len(TAGS)))
        self.worth = np.zeros(64, bool)

    def _code(self, word: str) -> int:
        s = shape(word)
        at = self.shapes.get(s)
        if at is None:
            at = self.shapes[s] = len(self.shapes)
            if at == len(self.table):
                self.table, self.worth = (np.concatenate([x, np.zeros_like(x)]) for x in (self.table, self.worth))
            self.table[at] = exact(self.field.row(s))
            self.worth[at] = "9" in s or s in ("cue-at", "marked-at", "cue-dot", "marked-dot")
            self.chars += len(s)
        self.codes[word] = at
        self.chars += len(word)
        return at

    def _long(self, codes: np.ndarray) -> np.ndarray:
        """Tags of one long line."""

        def emissions(a: int, b: int) -> np.ndarray:
            some = self.table[codes[a:b], 0].copy()
            some[max(0, 1 - a) :] += self.table[codes[max(0, a - 1) : b - 1], 1]
            after = codes[a + 1 : b + 1]
            some[: len(after)] += self.table[after, 2]
            return some

        return viterbi_blocks(emissions, len(codes), self.moves)

    def lines(self, lines: list[list[str]]) -> dict[int, np.ndarray]:
        """Line -> tags, for the lines that hold any tag but O."""
        if len(self.codes) > self.WORDS or self.chars > self.CHARS:
            self._clear()
        codes, code = self.codes, self._code
        coded = [codes[w] if w in codes else code(w) for words in lines for w in words]
        flat = np.array(coded, np.int64)
        hits = np.flatnonzero(self.worth[flat]) if len(flat) else flat
        out: dict[int, np.ndarray] = {}
        if not len(hits):
            return out
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        stops = np.cumsum(sizes)
        line_of = np.searchsorted(stops, hits, side="right")
        owner = np.unique(line_of)
        begins, lengths_all = stops[owner] - sizes[owner], sizes[owner]
        for k in np.flatnonzero(lengths_all > self.LONG).tolist():
            tags = self._long(flat[begins[k] : begins[k] + lengths_all[k]])
            if tags.any():
                out[int(owner[k])] = tags
        order = np.argsort(lengths_all, kind="stable")
        order = order[lengths_all[order] <= self.LONG]
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * lengths_all[order[end]] <= self.CELLS:
                end += 1
            part = order[at:end]
            at = end
            lengths, steps = lengths_all[part], int(lengths_all[part[-1]])
            rows = begins[part] + np.arange(steps)[:, None]
            inside = np.arange(steps)[:, None] < lengths
            here = np.where(inside, flat[np.minimum(rows, len(flat) - 1)], 0)
            line_end = stops[owner[part]]
            left = np.where(inside & (rows > line_end - sizes[owner[part]]), flat[np.clip(rows - 1, 0, len(flat) - 1)], 0)
            right = np.where(inside & (rows + 1 < line_end), flat[np.minimum(rows + 1, len(flat) - 1)], 0)
            emissions = self.table[here, 0] + self.table[left, 1] + self.table[right, 2]
            tags = viterbi(np.ascontiguousarray(emissions.transpose(0, 2, 1)), lengths, self.moves)
            for row in np.flatnonzero(tags.any(1)):
                line = int(owner[part[row]])
                own = out.setdefault(line, np.zeros(sizes[line], np.int8))
                k = int(begins[part[row]] - stops[line] + sizes[line])
                own[k : k + lengths[row]] = tags[row, : lengths[row]]
        return out


_WORD = re.compile(r"\S+")


def crf_spans(text: str, lines: list[str], starts: list[int], tagged: list[tuple[int, np.ndarray]]) -> list[S.Span]:
    found = []
    for line, tags in tagged:
        words = [m.span() for m in _WORD.finditer(lines[line])]
        t = 0
        while t < len(tags):
            name = TAGS[tags[t]]
            if name == "O":
                t += 1
                continue
            end = t + 1
            while end < len(tags) and TAGS[tags[end]] == "I-" + name[2:]:
                end += 1
            a, b = starts[line] + words[t][0], starts[line] + words[end - 1][1]
            while b > a and text[b - 1] in ".,;:!?\"'":
                b -= 1
            if _whole(name[2:], [shape(lines[line][x:y]) for x, y in words[t:end]], len(_DIGIT.findall(text, a, b))):
                found.append((name[2:], a, b))
            t = end
    return found


def _whole(kind: str, shapes: list[str], digits: int) -> bool:
    """Whether a tagged run has the parts of its kind: an address has a sign and ends in a domain, a number enough digits."""
    if kind == "email":
        return len(shapes) >= 3 and any(s in ("marked-at", "cue-at") for s in shapes[1:-1]) and (shapes[-1].startswith("tld") or "." in shapes[-1][:-1])
    return digits == 9 if kind == "id" else 7 <= digits <= 15


_OUT = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(f"n_{k}", T.LongType()) for k in KINDS[:4]), T.StructField("n_field", T.LongType()), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def all_spans(rows: list[str], decoder: Decoder) -> Iterator[tuple[list[S.Span], list[S.Span]]]:
    """Base spans and all spans of each text; the field decodes the lines of many texts at once."""
    at = 0
    while at < len(rows):
        end, size = at, 0
        while end < len(rows) and (end == at or size < 1_500_000):
            size += len(rows[end])
            end += 1
        part = rows[at:end]
        at = end
        lines, owner = [], []
        for i, text in enumerate(part):
            own = text.split("\n")
            lines += own
            owner += [i] * len(own)
        firsts = np.searchsorted(owner, range(len(part)))
        tagged: dict[int, list[tuple[int, np.ndarray]]] = {}
        for line, tags in decoder.lines([x.split() for x in lines]).items():
            tagged.setdefault(owner[line], []).append((line, tags))
        for i, text in enumerate(part):
            base = base_spans(text)
            if i in tagged:
                first = int(firsts[i])
                own = text.split("\n")
                starts = np.concatenate([[0], np.cumsum([len(x) + 1 for x in own])]).tolist()
                new = crf_spans(text, own, starts, [(line - first, tags) for line, tags in tagged[i]])
                yield base, S.by_kind([*base, *S.outside(new, base)], KINDS)
            else:
                yield base, S.by_kind(base, KINDS)


def _scan(batches: Iterator[pa.RecordBatch], field: Field) -> Iterator[pa.RecordBatch]:
    decoder = Decoder(field)
    for batch in batches:
        rows: list[list] = [[] for _ in range(7)]
        for base, spans in all_spans(batch.column(1).to_pylist(), decoder):
            for row, kind in zip(rows, KINDS[:4], strict=False):
                row.append(sum(s[0] == kind for s in base))
            rows[4].append(len(spans) - len(base))
            rows[-2].append(S.digest(S.by_kind(base, KINDS)))
            rows[-1].append(S.written(spans))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, pa.int64()) for r in rows[:-2]), *(pa.array(r, pa.string()) for r in rows[-2:])], names=_OUT.names)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_rows: int = 240, seed: int = 7) -> DataFrame:
    """One row per document: base spans by kind, spans that the field adds, digest of the base spans, all spans. A map over the scan, without a shuffle."""
    field = docs.sparkSession.sparkContext.broadcast(trained(table_rows, seed))
    return texts(docs, id_col, text_col).mapInArrow(lambda it: _scan(it, field.value), _OUT)


def masked(text: str, spans: list[S.Span]) -> str:
    """The text with every span replaced by ``<KIND>``; of spans that touch, the first stands for them."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
            at = b
        else:
            at = max(at, b)
    return "".join([*out, text[at:]])


def _mask(batches: Iterator[pa.RecordBatch], field: Field, text_col: str) -> Iterator[pa.RecordBatch]:
    decoder = Decoder(field)
    for batch in batches:
        rows = batch.column(text_col).to_pylist()
        out = [masked(t, spans) for t, (_, spans) in zip((r or "" for r in rows), all_spans([r or "" for r in rows], decoder), strict=True)]
        out = [None if r is None else t for r, t in zip(rows, out, strict=True)]
        k = batch.schema.get_field_index(text_col)
        yield batch.set_column(k, text_col, pa.array(out, pa.string()))


def mask_pii(docs: DataFrame, text_col: str = "text", table_rows: int = 240, seed: int = 7) -> DataFrame:
    """The documents with personal data in ``text_col`` replaced by ``<KIND>``; n_chars, where there is one, follows the new text; a null text stays null."""
    field = docs.sparkSession.sparkContext.broadcast(trained(table_rows, seed))
    out = docs.mapInArrow(lambda it: _mask(it, field.value, text_col), docs.schema)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return out

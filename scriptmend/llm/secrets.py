"""Secret scans by assignment-aware lexing.

Base spans come from three fixed patterns. The method adds more: source and configuration text is parsed
into (target name, literal) pairs, names bound to a literal are propagated as constants into later
assignments, and each literal is scored by how sensitive its target name is and by how random it looks.

Defined results: a null text is empty; an empty text has no spans; repeated rows give repeated rows; an empty table
gives an empty result; extra columns of the input are not read; a text, name or literal of any length is scanned
whole, in time in proportion to it; of new spans one that touches a base span, or an earlier one, goes (of two that
begin together the shorter).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import spans as S
from .common import texts

KINDS = ("assign", "access", "hex", "literal")

_ASSIGN = re.compile(
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: A word of the base pattern, to skip texts without one.
_CUE = re.compile(r"[Pp][Aa][Ss][Ss][Ww]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]")


def base_spans(text: str) -> list[S.Span]:
    """Whole matches of the three fixed patterns, leftmost and non-overlapping per kind."""
    found: list[S.Span] = []
    if _CUE.search(text):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return S.by_start(found, KINDS)


# --- lexing -------------------------------------------------------------------------------------------

_OPERATOR = re.compile(r":=|=>|==|!=|<=|>=|[:=]")
_NAME_BEFORE = re.compile(r"""(?:(["'])([A-Za-z_][\w.\- ]*)\1|\[\s*["']([A-Za-z_][\w.\-]*)["']\s*\]|([A-Za-z_][\w.\-]*))(?:\s*:\s*[A-Za-z_][\w\[\]]{0,31})?[ \t]*\Z""")
#: The same, read backwards from the operator, for names that begin before ``_REACH``.
_NAME_BACKWARDS = re.compile(r"""[ \t]*(?:[\w\[\]]{0,31}[A-Za-z_]\s*:\s*)?(?:(["'])([\w.\- ]*[A-Za-z_])\1|\]\s*["']([\w.\-]*[A-Za-z_])["']\s*\[|([\w.\-]*[A-Za-z_]))""")
_LITERAL = re.compile(r"""[ \t]*(?:[rbuf]?"((?:[^"\\\n]|\\.)*)"|[rbuf]?'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`)""", re.I)
_PLUS = re.compile(r"[ \t]*(?:\+|\.(?!\w))[ \t]*")
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]<>]+")
_INDENT = re.compile(r"[ \t]*")
_IDENTIFIER = re.compile(r"[A-Za-z_][\w.]*")
_REACH = 140


def assignments(text: str) -> Iterator[tuple[str, list[tuple[int, int]], bool]]:
    """(target name, literal spans, quoted) of each ``name op value`` in the text, in order.

    The name may be quoted (JSON), subscripted, annotated or bare; the value is a run of quoted literals
    joined by ``+``, or one bare word (.env, YAML, INI). Operators inside a bare word have what follows them in it
    as their value, so that the end of a word is looked for once.
    """
    before = last = word_end = 0
    for op in _OPERATOR.finditer(text):
        # a name holds no operator, its annotation one: what could be a name begins after the last but one
        since, before, last = before, last, op.end()
        if len(op[0]) == 2 and op[0] not in (":=", "=>"):
            continue
        far = _NAME_BACKWARDS.match(text[since : op.start()][::-1]) if op.start() - since > _REACH else None
        if far and far.end() > _REACH:
            name = (far[2] or far[3] or far[4])[::-1]
        elif named := _NAME_BEFORE.search(text[max(since, op.start() - _REACH) : op.start()]):
            name = named[2] or named[3] or named[4]
        else:
            continue
        at = op.end()
        parts: list[tuple[int, int]] = []
        while m := _LITERAL.match(text, at):
            group = next(g for g in (1, 2, 3) if m[g] is not None)
            parts.append(m.span(group))
            at = m.end()
            if not (plus := _PLUS.match(text, at)) or not plus[0].strip():
                break
            at = plus.end()
        if parts:
            yield name, parts, True
            continue
        at = _INDENT.match(text, at).end()
        if at >= word_end:
            word = _BARE.match(text, at)
            word_end = word.end() if word else at
        if at < word_end and text[at] not in ":=/":
            yield name, [(at, word_end)], False


#: Weight of a part of a target name.
_SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "bearer": 0.8, "signature": 0.5, "salt": 0.5, "private": 0.5, "key": 0.5, "access": 0.3, "api": 0.3, "client": 0.2, "encryption": 0.4, "signing": 0.4, "db": 0.1, "conn": 0.2, "connection": 0.2}
_DAMPING = {"public": -0.6, "id": -0.3, "name": -0.5, "url": -0.4, "path": -0.6, "file": -0.6, "count": -0.8, "limit": -0.8, "length": -0.8, "type": -0.6, "field": -0.6, "label": -0.6, "max": -0.6, "min": -0.6, "primary": -0.5, "foreign": -0.5, "sort": -0.5}
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Forms of a whole value, and words that stand alone in it, that mark a value which is to be filled in.
_SHAPED = re.compile(r"(?i)\A(?:x+|\*+|\.+|<.*>|\$\{?.*|%.*%)\Z")
_MARKED = re.compile(r"(?i)(?<![a-z0-9])(?:example|changeme|placeholder|your|dummy|redacted|none|null|true|false|undefined)(?![a-z0-9])")


def name_score(name: str) -> float:
    parts = [p.lower() for p in _PART.findall(name)]
    joined = "".join(parts)
    score = sum(_SENSITIVE.get(p, 0.0) + _DAMPING.get(p, 0.0) for p in parts)
    return max(score, 1.0) if joined.endswith(("apikey", "accesskey", "privatekey", "secretkey")) else score


def entropy(counts: Iterable[int], n: int) -> float:
    return -sum(c / n * math.log2(c / n) for c in counts if c) if n else 0.0


def _worth(counts: dict[str, int], n: int) -> float:
    """0 to 1: how much a literal of these characters looks like key material rather than a word or a path."""
    kinds = sum(any(f(c) for c in counts) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in counts)
    return min(1.0, entropy(counts.values(), n) / 4.0) * (0.4 + 0.2 * kinds) if kinds >= 2 or any(c.isdigit() for c in counts) else 0.2


def value_score(value: str) -> float:
    """0 to 1: how much a literal looks like key material rather than a word, a path or a placeholder."""
    if len(value) < 8 or _SHAPED.match(value) or _MARKED.search(value) or any(c.isspace() for c in value):
        return 0.0
    return _worth(Counter(value), len(value))


class _Scores:
    """Scores of literals of one text. Those of a bare word's tails are made together, from its end: characters are counted once."""

    def __init__(self, text: str) -> None:
        self.text, self.of, self.tails = text, {}, {}

    def score(self, parts: list[tuple[int, int]], quoted: bool) -> float:
        key = tuple(parts)
        if key not in self.of:
            a, b = parts[0]
            if quoted or b - a < 256:
                self.of[key] = value_score("".join(self.text[a:b] for a, b in parts))
            else:
                if b not in self.tails:
                    self.tails[b] = self._tails(a, b)
                self.of[key] = self.tails[b][a]
        return self.of[key]

    def _tails(self, a: int, b: int) -> dict[int, float]:
        """Scores of text[k:b] for k = a and every k after an operator in text[a:b]."""
        text = self.text
        starts = sorted({a, *(_INDENT.match(text, op.end()).end() for op in _OPERATOR.finditer(text, a, b))}, reverse=True)
        named = [m.start() for m in _MARKED.finditer(text, a, b)]
        out, counts, end = {}, Counter(), b
        for k in starts:
            counts.update(text[k:end])
            end = k
            held = bool(named) and named[-1] >= k
            same = len(counts) == 1 and next(iter(counts)) in "xX*."
            out[k] = 0.0 if b - k < 8 or held or same or text[k] == "$" or text[k] == text[b - 1] == "%" else _worth(counts, b - k)
        return out


def lexed_spans(text: str, threshold: float = 1.2) -> list[S.Span]:
    """Literals whose target name and value score ``threshold`` or more together."""
    if ":" not in text and "=" not in text:
        return []
    constants: dict[str, tuple[list[tuple[int, int]], bool]] = {}
    found: dict[tuple[int, int], S.Span] = {}
    scores = _Scores(text)
    taken = 0
    for name, parts, quoted in assignments(text):
        if not quoted:
            a, b = parts[0]
            word = _IDENTIFIER.match(text, a, b)
            if word and word.end() == b and (known := constants.get(text[a:b])):
                parts, quoted = known
        constants[name] = (parts, quoted)
        worth = name_score(name)
        # inside a bare word that is taken already nothing can be added
        if worth >= 0.7 and (quoted or parts[0][0] >= taken) and (looks := scores.score(parts, quoted)) > 0.3 and worth + looks >= threshold:
            for a, b in parts:
                if b > a:
                    found[a, b] = ("literal", a, b)
            if not quoted:
                taken = max(taken, parts[0][1])
    return sorted(found.values(), key=lambda s: s[1])


def scan_text(text: str) -> tuple[list[S.Span], list[S.Span]]:
    """Base spans, and all spans: a lexed literal counts where no base span touches it."""
    base = base_spans(text)
    new = lexed_spans(text)
    return base, S.by_start([*base, *S.outside(new, base)], KINDS) if new else base


_OUT = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("n_assign", "n_access", "n_hex", "n_literal")), T.StructField("base_sha256", T.StringType()), T.StructField("spans", T.StringType())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    nothing = S.digest([])
    for batch in batches:
        rows: list[list] = [[] for _ in range(6)]
        for text in batch.column(1):
            base, spans = scan_text(text.as_py())
            for row, kind in zip(rows, KINDS, strict=False):
                row.append(sum(s[0] == kind for s in spans))
            rows[4].append(S.digest(base) if base else nothing)
            rows[5].append(S.written(spans))
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, pa.int64()) for r in rows[:4]), *(pa.array(r, pa.string()) for r in rows[4:])], names=_OUT.names)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts by kind, digest of the base spans, all spans. A map over the scan, without a shuffle."""
    return texts(docs, id_col, text_col).mapInArrow(_scan, _OUT)

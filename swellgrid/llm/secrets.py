"""Secret scans by assignment-aware lexing.

Besides fixed patterns, each text is read as source or configuration: assignments give
name-literal pairs, constants are propagated to the names they flow into, and a literal is
reported when the most sensitive of its target names and its own shape score high enough.
Work per text is linear but for a sort of its names: no character is lexed as a value twice, and each name
takes the best target that it reaches from one walk over all constants.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Order of the kinds of spans that start together.
KINDS = ("assign", "access", "hex", "literal")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")

_OPERATOR = re.compile(r"(?<![=!<>:])(?::=|=>|=(?!=)|:(?!:))")
_NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_.-")
#: A quoted literal, or a bare one: it ends before ``=`` and ``&``, but for the padding at its end.
_VALUE = re.compile(
    r"""[ \t]*+(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)'|`([^`\n]*+)`|([A-Za-z0-9_./$~@%^*!?-]++(?:\+[A-Za-z0-9_./$~@%^*!?-]++)*+(?:={1,2}(?![A-Za-z0-9_./$~@%^*!?=&"'`-]))?))"""
)
_PLUS = re.compile(r"[ \t]*\+")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")

#: Sensitivity of the words of a target name, and of neighbours that mean something else.
NAME_WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "pass": 0.8, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9,
    "credentials": 0.9, "privatekey": 1.0, "bearer": 0.9, "authorization": 0.8, "auth": 0.7, "key": 0.6, "signature": 0.5, "pin": 0.5,
}
PAIR_WEIGHTS = {("api", "key"): 1.0, ("private", "key"): 1.0, ("access", "key"): 1.0, ("encryption", "key"): 1.0, ("signing", "key"): 1.0, ("connection", "string"): 0.8}
HARMLESS = frozenset(["count", "length", "size", "max", "min", "limit", "type", "field", "label", "name", "path", "file", "url", "public", "hint", "column", "index", "id"])
PLACEHOLDERS = frozenset(["changeme", "password", "secret", "example", "placeholder", "undefined", "required", "optional", "redacted", "default"])
#: Words of a message about a secret rather than of a secret.
PROSE = PLACEHOLDERS | frozenset(["enter", "please", "your", "the", "a", "is", "not", "must", "invalid", "wrong", "missing", "for", "of", "to", "and", "or", "in", "no", "this"])
SCORE = 0.5
MIN_LITERAL, MOST_WORDS = 6, 8


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    name: str | None
    score: float | None


class _Pair(NamedTuple):
    name: str
    start: int
    end: int
    quoted: bool
    whole: str | None = None  # what is scored, where the literal is written in several pieces


def base_spans(text: str) -> Iterator[Span]:
    """Spans of the fixed patterns: leftmost matches that don't overlap, the too short ones dropped."""
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 6:
            yield Span("assign", m.start(), m.end(), m[1], None)
    for m in _ACCESS.finditer(text):
        if m.end() - m.start() >= 20:
            yield Span("access", m.start(), m.end(), None, None)
    for m in _HEX.finditer(text):
        yield Span("hex", m.start(), m.end(), None, None)


def _target(text: str, at: int) -> str:
    """The name that ends before the operator at ``at``, past blanks and closing quotes or brackets."""
    while at and text[at - 1] in " \t":
        at -= 1
    while at and text[at - 1] in "\"'])":
        at -= 1
    end = at
    while at and text[at - 1] in _NAME_CHARS:
        at -= 1
    return text[at:end].strip(".-")


def assignments(text: str) -> Iterator[_Pair]:
    """Name and literal of each assignment, one pair for each operand of a sum."""
    done = 0
    for op in _OPERATOR.finditer(text):
        if op.start() < done:  # inside the last literal, or its padding
            continue
        name = _target(text, op.start())
        if not name or name[0].isdigit():
            continue
        at = op.end()
        while value := _VALUE.match(text, at):
            group = value.lastindex
            if not group:
                break
            yield _Pair(name, value.start(group), value.end(group), group < 4)
            at = done = value.end()
            plus = _PLUS.match(text, at)
            if not plus:
                break
            at = plus.end()


_TRIPLE = re.compile(r'"""|\'\'\'')
_BEFORE_VALUE = re.compile(r"(?::=|=>|=|:)[ \t]*\Z")
_QUOTED = r"""(?:"((?:[^"\\\n]|\\.)*+)"|'((?:[^'\\\n]|\\.)*+)')"""
_BRACKET = re.compile(r"(?<![=!<>:])(?::=|=|:)[ \t]*+\((?=\s*+[\"'])")
_PIECE = re.compile(rf"[\s+]*+{_QUOTED}")
_BLOCK = re.compile(r"""^([ \t]*+)(?:-[ \t]++)?["']?([A-Za-z_][A-Za-z0-9_.-]*+)["']?[ \t]*+:[ \t]*+[|>][+-]?[0-9]?[ \t]*+$""", re.MULTILINE)
_LINE = re.compile(r"\n([ \t]*+)([^\n]*+)")
_ELEMENT = re.compile(r"<([A-Za-z_][A-Za-z0-9_.:-]*+)(?:\s[^<>]*+)?>([^<>]++)</\1\s*+>")
_ATTRIBUTES = re.compile(r"""\b(?:name|key)\s*+=\s*+["']([^"'<>]*+)["']\s++value\s*+=\s*+["']([^"'<>]*+)["']""")
_CALL = re.compile(rf"(?<![A-Za-z0-9_])([A-Za-z_][A-Za-z0-9_]*+)\(\s*+{_QUOTED}\s*+\)")
_NAMED_ARGUMENT = re.compile(rf"""\(\s*+["']([A-Za-z_][A-Za-z0-9_.-]*+)["']\s*+,\s*+{_QUOTED}\s*+[,)]""")
_FLAG = re.compile(rf"""(?<![A-Za-z0-9-])--([A-Za-z][A-Za-z0-9-]*+)[ \t]++(?:{_QUOTED}|([^\s"'`-][^\s"'`]*+))""")


def _stripped(name: str, text: str, start: int, end: int, quoted: bool = True) -> Iterator[_Pair]:
    """The pair of a stretch of text without the blanks at its ends."""
    literal = text[start:end]
    start += len(literal) - len(literal.lstrip())
    if literal.strip():
        yield _Pair(name, start, start + len(literal.strip()), quoted)


def syntax_pairs(text: str) -> Iterator[_Pair]:
    """Name and literal in syntax that ``assignments`` doesn't read: triple quotes, adjacent literals in brackets, indented blocks,
    elements, name and value attributes, setter calls, named arguments, command-line flags.

    Each form is one pass: a search goes on behind what it found, and what a failed match has read is not read again by the next.
    """
    if '"""' in text or "'''" in text:
        opened = None
        for m in _TRIPLE.finditer(text):
            if opened is None:
                opened = m
            elif m[0] == opened[0]:
                operator = _BEFORE_VALUE.search(text, max(0, opened.start() - 16), opened.start())
                name = _target(text, operator.start()) if operator else ""
                if name and not name[0].isdigit():
                    yield from _stripped(name, text, opened.end(), m.start())
                opened = None
    done = 0
    for m in _BRACKET.finditer(text) if "(" in text else ():
        name, at, pieces = _target(text, m.start()), m.end(), []
        if m.start() < done or not name or name[0].isdigit():
            continue
        while piece := _PIECE.match(text, at):
            pieces.append((piece.start(piece.lastindex), piece.end(piece.lastindex)))
            at = done = piece.end()
        whole = "".join(text[a:b] for a, b in pieces)
        yield from (_Pair(name, a, b, True, whole) for a, b in pieces if a < b)
    done = 0
    for m in _BLOCK.finditer(text) if "|" in text or ">" in text else ():
        if m.start() < done:
            continue
        lines, at = [], m.end()
        while (line := _LINE.match(text, at)) and (not line[2] or len(line[1]) > len(m[1])):
            if line[2].strip():
                lines.append((line.start(2), line.start(2) + len(line[2].rstrip())))
            at = done = line.end()
        whole = "".join(text[a:b] for a, b in lines)
        yield from (_Pair(m[2], a, b, True, whole) for a, b in lines)
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            yield from _stripped(m[1], text, m.start(2), m.end(2))
    if "value" in text:
        yield from (_Pair(m[1], m.start(2), m.end(2), True) for m in _ATTRIBUTES.finditer(text))
    if "(" in text:
        for pattern in (_CALL, _NAMED_ARGUMENT):
            yield from (_Pair(m[1], m.start(m.lastindex), m.end(m.lastindex), True) for m in pattern.finditer(text))
    if "--" in text:
        yield from (_Pair(m[1], m.start(m.lastindex), m.end(m.lastindex), m.lastindex < 4) for m in _FLAG.finditer(text))


def name_score(name: str) -> float:
    """How likely something of this name is a secret, from 0 to 1."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    score = max((NAME_WEIGHTS.get(p, 0.0) for p in parts), default=0.0)
    score = max([score, *(PAIR_WEIGHTS.get(p, 0.0) for p in zip(parts, parts[1:], strict=False))])
    return score * (0.3 if HARMLESS.intersection(parts) else 1.0)


def literal_score(literal: str, quoted: bool) -> float:
    """How much a literal looks like a secret, from 0 to 1: length, variety and kinds of characters."""
    low = literal.lower()
    if len(literal) < MIN_LITERAL or low in PLACEHOLDERS or low.startswith(("$", "<", "{", "%")):
        return 0.0
    if len(words := low.split()) > 1:  # a phrase: of few words, none of which asks for or describes a secret
        if not quoted or len(words) > MOST_WORDS or not {w.strip(".,:;!?") for w in words}.isdisjoint(PROSE):
            return 0.0
    kinds = sum(any(f(c) for c in literal) for f in (str.islower, str.isupper, str.isdigit)) + any(not c.isalnum() for c in literal)
    n = len(literal)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(literal).values())
    score = min(1.0, 0.35 + 0.2 * (kinds - 1) + 0.1 * entropy)
    return score if quoted or any(c.isdigit() for c in literal) else score * 0.5


def best_targets(names: set[str], flows: dict[str, set[str]]) -> dict[str, tuple[float, str]]:
    """The most sensitive (score, name) that each name reaches along ``flows``, itself included.

    Names take it from the best down, each to all that reach it and have none yet, so every flow is followed once.
    """
    back: dict[str, list[str]] = {}
    for source, targets in flows.items():
        for target in targets:
            back.setdefault(target, []).append(source)
    reach: dict[str, tuple[float, str]] = {}
    for best in sorted(((name_score(n), n) for n in names), reverse=True):
        stack = [best[1]]
        while stack:
            name = stack.pop()
            if name not in reach:
                reach[name] = best
                stack += back.get(name, ())
    return reach


def method_spans(text: str) -> Iterator[Span]:
    """Literals whose sensitive target names, own or reached through constants, score ``SCORE`` or more."""
    pairs = list(assignments(text)) if "=" in text or ":" in text else []
    pairs += syntax_pairs(text)
    flows: dict[str, set[str]] = {}  # from a constant to the names it flows into
    defined = {p.name for p in pairs}
    for p in pairs:  # target = CONSTANT: what the constant holds flows into the target
        source = text[p.start : p.end]
        if not p.quoted and source in defined and source != p.name and _IDENTIFIER.match(source):
            flows.setdefault(source, set()).add(p.name)
    reach = best_targets(defined, flows)
    found: dict[tuple[int, int], Span] = {}
    for p in pairs:
        strength, target = reach[p.name]
        literal = text[p.start : p.end] if p.whole is None else p.whole
        if strength and not (literal in flows and not p.quoted):
            score = strength * literal_score(literal, p.quoted)
            if score >= SCORE and ((p.start, p.end) not in found or found[p.start, p.end].score < round(score, 4)):
                found[p.start, p.end] = Span("literal", p.start, p.end, target, round(score, 4))
    yield from found.values()


def find_secrets(text: str | None) -> list[Span]:
    text = text or ""
    return sorted([*base_spans(text), *method_spans(text)], key=lambda s: (s.start, KINDS.index(s.kind), s.end))


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name", pa.string()), ("score", pa.float64())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            spans = [[s._asdict() for s in find_secrets(t.as_py())] for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(spans, pa.list_(_SPAN))], names=["id", "spans"])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col`` and ``spans`` (kind, start, end in code points with the end exclusive, name, score) of every row.

    Spans are ordered by start and kind.  Null and empty texts have none; rows that repeat
    an id, or have a null one, each give a row; an empty table gives no rows; other columns
    are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, spans array<struct<kind:string,start:int,end:int,name:string,score:double>>"
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_scan, schema)
    return out.withColumnRenamed("id", id_col)


def joined(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of the spans, of some kinds only, comma-joined in their order."""
    if kinds:
        spans = F.filter(spans, lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")

"""Secret scanning: fixed patterns, and an assignment-aware lexer over source and configuration text.

The lexer reads strings (triple-quoted, escaped and prefixed ones too), names, operators, calls and
markup, and turns them into (name, value) pairs: assignments with or without a type, keys of maps and
subscripts, YAML values on the next line and block scalars, flags of commands, elements and attributes
of markup, setters and calls that take a name and a value. Strings joined by + or by standing together
are one literal. A call, a subscript or a path of names is no literal, whatever it is assigned to.

Names are followed in order: a literal assigned to one name is carried by it to others until the name
is assigned anew. A name that is used before anything is known of it carries what is first assigned
to it later. A literal is a secret if a name that it reaches is sensitive enough for how much like a
credential it looks.

Only texts with a sensitive name anywhere are read, as no other can make a literal a secret. Texts of
a batch are searched as one buffer with line feeds between them. No fixed pattern matches across a
line feed, so no match crosses texts.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K
from .common import documents, id_array, ids, map_texts, texts

FINDINGS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long, top_score double"

KINDS = ("assign", "access", "hex", "lexed")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX_DIGITS = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))

NAME = re.compile(rb"[A-Za-z_][A-Za-z0-9_.-]*\Z")
PREFIX = rb"(?<![A-Za-z0-9_])[rbufRBUF]{0,2}"  # an apostrophe within a word opens no string
STRING = (
    rb'''(?:(?:''' + PREFIX + rb''')?(?:"""(?P<long>(?:[^\\]|\\.)*?)"""|"(?P<double>(?:[^"\\\n]|\\.)*)")'''
    rb"|" + PREFIX + rb"(?:'''(?P<long1>(?:[^\\]|\\.)*?)'''|'(?P<single>(?:[^'\\\n]|\\.)*)')"
    rb"|`(?P<back>[^`\n]*)`)"
)
STRING_GROUPS = ("long", "long1", "double", "single", "back")
ASSIGNS = rb"(?::=|=>|\+=|=(?![=>~])|:(?![:=/]))"
#: What may begin a pair: an element, a string (a key where an operator follows), a flag, a call or a name.
EVENT = re.compile(
    rb"""<(?P<tag>[A-Za-z_][A-Za-z0-9_.:-]*)(?P<attributes>(?:[^<>"']|"[^"]*"|'[^']*')*)>(?:(?P<body>[^<]*)</(?P=tag)[ \t]*>)?"""
    rb"|(?P<string>" + STRING + rb")(?P<keyed>[ \t]*\]?[ \t]*" + ASSIGNS + rb")?"
    rb"|(?<![A-Za-z0-9_-])--(?P<flag>[A-Za-z][A-Za-z0-9_-]*)[ \t]+(?=[^\s-])"
    rb"|(?P<name>[A-Za-z_][A-Za-z0-9_.-]*)(?:(?P<call>[ \t]*\()"
    rb"|(?P<typed>[ \t]+[A-Za-z_][A-Za-z0-9_.\[\]]{0,60}[ \t]*=(?![=>~])(?<=[ \t]=))"  # Go: name type =
    rb"|(?P<set>(?:[ \t]*:[ \t]*[A-Za-z_][A-Za-z0-9_.\[\], |?<>]{0,80}?)?[ \t]*" + ASSIGNS + rb"))?",
    re.S,
)
ONE_STRING = re.compile(STRING, re.S)
ATTRIBUTE = re.compile(rb"""([A-Za-z_][A-Za-z0-9_.:-]*)[ \t]*=[ \t]*(?:"([^"]*)"|'([^']*)')""")
#: Between strings that are one literal, and what may stand before the first of them.
JOIN = re.compile(rb"[ \t]*(?:\\?\n[ \t]*)?(?:\+|\.(?=[ \t]*[\"']))?[ \t]*(?:\\?\n[ \t]*)?")
OPEN = re.compile(rb"[ \t]*(?:\\\n[ \t]*)?\(?[ \t]*(?:(?<=\()\s*)?")
NEXT_LINE = re.compile(rb"[ \t]*\n[ \t]+")
BLOCK_SCALAR = re.compile(rb"[ \t]*[|>][+-]?[0-9]?[ \t]*\n((?:[ \t]+[^\n]*(?:\n|\Z))+)")
BARE = re.compile(rb"[^\s,;\"'(){}\[\]<>`]+")
#: A path of names, or a name without digits, is an expression and no literal.
PATH = re.compile(rb"[A-Za-z_]+\Z|[A-Za-z_]+[0-9]{0,2}(?:\.[A-Za-z_]+[0-9]{0,2})+\Z")
SCHEME = re.compile(rb"(?:Bearer|Basic|Token)[ \t]+(?=\S)", re.I)
SHELL_NAME = re.compile(rb"\$\{?([A-Za-z_][A-Za-z0-9_]*)\}?\Z")
PART = re.compile(rb"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: First parts of the names of calls that set what the rest names.
SETTERS = {b"set", b"with", b"put", b"use", b"add", b"assign", b"define", b"store"}

#: How strongly a part of a name says that its value is a credential.
SENSITIVE = {
    b"password": 1.0, b"passwd": 1.0, b"pwd": 1.0, b"passphrase": 1.0, b"pass": 0.7, b"secret": 1.0, b"token": 0.9,
    b"apikey": 1.0, b"credential": 0.9, b"credentials": 0.9, b"auth": 0.6, b"authorization": 0.8, b"bearer": 0.8, b"signature": 0.5, b"pin": 0.5,
}
#: Pairs of neighbouring parts of a name, likewise.
SENSITIVE_PAIRS = {(b"api", b"key"): 1.0, (b"access", b"key"): 1.0, (b"private", b"key"): 1.0, (b"encryption", b"key"): 0.9, (b"signing", b"key"): 0.9, (b"account", b"key"): 0.9, (b"connection", b"string"): 0.7}
#: What every sensitive name holds.
ROOTS = (b"pass", b"pwd", b"secret", b"token", b"apikey", b"key", b"credential", b"auth", b"bearer", b"signature", b"pin", b"connection")
#: Parts of a name that say its value describes a credential and is none.
HARMLESS = {b"count", b"length", b"len", b"type", b"name", b"url", b"file", b"path", b"field", b"regex", b"max", b"min", b"ttl", b"expiry", b"policy", b"hint", b"label"}
PLACEHOLDER = re.compile(rb"(?i)(?:none|null|nil|true|false|undefined|<[^>]*>)\Z|(?:.*[^A-Za-z0-9])?(?:change.?me|example|placeholder|your|dummy|todo)(?![A-Za-z0-9])|x{4,}|.*(?:\*{3,}|\$\{|\{\{|%\(|\.\.\.)")
THRESHOLD = 0.5


def parts_of(name: bytes) -> list[bytes]:
    return [p.lower() for p in PART.findall(name)]


def _parts_score(parts: list[bytes]) -> float:
    single = max((SENSITIVE.get(p, 0.0) for p in parts), default=0.0)
    return max([single, *(SENSITIVE_PAIRS.get(x, 0.0) for x in zip(parts, parts[1:]))])


@lru_cache(1 << 14)
def name_score(name: bytes) -> float:
    parts = parts_of(name)
    return 0.0 if not parts or HARMLESS & {parts[-1], parts[0]} else _parts_score(parts)


def literal_score(value: bytes) -> float:
    """0 to 1: how much a literal looks like a credential, by its length and entropy."""
    if len(value) < 6 or PLACEHOLDER.match(value) or b" " in value.strip():
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return min(1.0, n / 12) * min(1.0, entropy / 2.5)


@dataclass
class Pair:
    """Names that are given one value: a literal's text and range, the name of another, or neither. A
    bare word can be both; it is a name where the document has such a name."""

    names: list[bytes]
    literal: bytes | None = None
    start: int = 0
    end: int = 0
    alias: bytes | None = None
    more: bool = False  # adds to what the name has


def lex(raw: bytes, at: int = 0, stop: int | None = None, inner: bool = False) -> list[Pair]:
    """The pairs of raw[at:stop], in order. Strings that are no values are read inside, once."""
    stop = len(raw) if stop is None else stop
    out: list[Pair] = []
    while m := EVENT.search(raw, at, stop):
        at = m.end()
        if m["tag"] is not None:
            at = _element(m, out)
        elif m["string"] is not None:
            group = next(g for g in STRING_GROUPS if m[g] is not None)
            if m["keyed"]:
                at = _value(raw, m.end(), stop, [m[group]], m["keyed"], out)
            else:
                at = m.end("string")
                if not inner and any(x in m[group] for x in (b"=", b":")):
                    out += lex(raw, *m.span(group), True)
        elif m["flag"] is not None:
            at = _value(raw, m.end(), stop, [m["flag"]], b"", out)
        elif m["call"] is not None:
            _call(raw, m, stop, out)
        elif m["set"] is not None or m["typed"] is not None:
            at = _value(raw, m.end(), stop, [m["name"]], m["set"] or b"=", out)
    return out


def _element(m: re.Match, out: list[Pair]) -> int:
    """Pairs of an element: its text by its tag, attributes by their names, a value by a key or name."""
    base = m.start("attributes")
    found = {a[1].lower(): a for a in ATTRIBUTE.finditer(m["attributes"])}
    keyed = next((found[x] for x in (b"key", b"name", b"id") if x in found), None)
    for word, a in found.items():
        group = 2 if a[2] is not None else 3
        own = [a[1], keyed[2] or keyed[3] or b""] if keyed is not None and word in (b"value", b"content") else [a[1]]
        out.append(Pair(own, a[group], base + a.start(group), base + a.end(group)))
    if m["body"] is None:
        return m.end("attributes")
    body = m["body"].strip()
    if body:
        begin = m.start("body") + m["body"].index(body)
        own = [m["tag"].rpartition(b":")[2]]
        if keyed is not None:
            own.append(keyed[2] or keyed[3] or b"")
        out.append(Pair(own, body, begin, begin + len(body)))
    return m.end() if body and not any(x in body for x in b"=:") else m.start("body")


def _call(raw: bytes, m: re.Match, stop: int, out: list[Pair]) -> None:
    """Pairs of a call's first arguments: set_x("value") and f("name", "value")."""
    first = ONE_STRING.match(raw, _skip(raw, m.end(), stop), stop)
    if not first:
        return
    group = next(g for g in STRING_GROUPS if first[g] is not None)
    at = _skip(raw, first.end(), stop)
    if raw[at : at + 1] == b",":
        if NAME.match(first[group]) and (second := ONE_STRING.match(raw, _skip(raw, at + 1, stop), stop)):
            own = next(g for g in STRING_GROUPS if second[g] is not None)
            out.append(Pair([first[group]], second[own], *second.span(own)))
        return
    owner, dot, own = m["name"].rpartition(b".")
    parts = parts_of(own)
    if len(parts) > 1 and parts[0] in SETTERS or dot and name_score(own) and len(parts) < 3:
        target = own[len(parts[0]) :].lstrip(b"_") if parts[0] in SETTERS else own
        literal, begin, end, _ = _strings(raw, first, stop)
        out.append(Pair([target, target[:1].lower() + target[1:]], literal, begin, end))


def _skip(raw: bytes, at: int, stop: int) -> int:
    while at < stop and raw[at] in b" \t\n\r":
        at += 1
    return at


def _strings(raw: bytes, first: re.Match, stop: int) -> tuple[bytes, int, int, int]:
    """(text, start, end, where it ends with its quotes) of the strings that are joined to `first`."""
    m, text, begin, end = first, [], None, 0
    while True:
        group = next(g for g in STRING_GROUPS if m[g] is not None)
        text.append(m[group])
        begin, end = m.start(group) if begin is None else begin, m.end(group)
        after = m.end()
        joint = JOIN.match(raw, after, stop)
        # strings on lines of their own are joined by an operator alone
        if b"\n" in joint[0] and not any(x in joint[0] for x in b"+.\\"):
            break
        if not (m := ONE_STRING.match(raw, joint.end(), stop)):
            break
        if EVENT.match(raw, m.start(), stop)["keyed"]:
            break
    return b"".join(text), begin, end, after


def _value(raw: bytes, at: int, stop: int, names: list[bytes], sign: bytes, out: list[Pair]) -> int:
    """Read what is assigned to `names` from `at` on; returns where to go on."""
    sign = sign.strip().lstrip(b"]").strip()
    more = sign == b"+="
    yaml = sign == b":"
    if yaml and (m := BLOCK_SCALAR.match(raw, at, stop)):
        lines = [x for x in re.finditer(rb"[^\s][^\n]*", m[1])]
        if lines:
            text = b"".join(x[0].strip() for x in lines)
            out.append(Pair(names, text, m.start(1) + lines[0].start(), m.start(1) + lines[-1].end()))
        return m.end()
    p = OPEN.match(raw, at, stop).end()
    if yaml and (m := NEXT_LINE.match(raw, at, stop)):
        head = EVENT.match(raw, m.end(), stop)
        if head is None or head["keyed"] or head["set"] or head["tag"] or raw[m.end() : m.end() + 2] == b"- ":
            return m.end()
        p = m.end()
    if m := ONE_STRING.match(raw, p, stop):
        text, begin, end, after = _strings(raw, m, stop)
        out.append(Pair(names, text, begin, end, more=more))
        return after
    if m := SCHEME.match(raw, p, stop):
        p = m.end()
    if not (m := BARE.match(raw, p, stop)):
        if sign and not yaml:  # after a colon alone, a block or a nested map begins
            out.append(Pair(names, more=more))
        return p
    word, after = m[0], m.end()
    head = EVENT.match(raw, p, stop)
    if head and head["set"] and head.start() == p and sign != b":" and len(names) < 64:  # a = b = value
        return _value(raw, head.end(), stop, [*names, head["name"]], head["set"], out)
    follows = raw[after : after + 1]
    if shell := SHELL_NAME.match(word):
        out.append(Pair(names, alias=shell[1], more=more))
    elif follows in (b"(", b"[") or raw[after : after + 2] == b"<(":
        out.append(Pair(names, more=more))
        return p  # the call may have pairs of its own
    elif NAME.match(word):
        out.append(Pair(names, None if PATH.match(word) else word, m.start(), after, word, more))
    else:
        out.append(Pair(names, word, m.start(), after, more=more))
    return after


def secrets_of(pairs: list[Pair]) -> list[tuple[int, int, float]]:
    """(start, end, score) of the literals of one document that its names make secrets."""
    literals: list[Pair] = []
    top: list[float] = []
    holds: dict[bytes, list[int] | None] = {}  # what each name has now; None: what is not known yet
    early: dict[bytes, list[bytes]] = {}  # names that were given a name of which nothing was known
    first: dict[bytes, list[int]] = {}  # what each name was given first

    def give(name: bytes, found: list[int] | None, more: bool) -> None:
        for i in found or ():
            top[i] = max(top[i], name_score(name))
        holds[name] = [*(holds.get(name) or ()), *(found or ())] if more else found
        if found:
            first.setdefault(name, found)

    known = {name for pair in pairs for name in pair.names}
    for pair in pairs:
        found: list[int] | None = []
        if pair.literal is not None and pair.alias not in known:
            found = [len(literals)]
            literals.append(pair)
            top.append(0.0)
        elif pair.alias is not None:
            found = holds.get(pair.alias)
            if found is None:
                for name in pair.names:
                    early.setdefault(pair.alias, []).append(name)
        for name in pair.names:
            give(name, found, pair.more)
    # what names used early were given later, by the most sensitive name first
    best: dict[bytes, float] = {}
    back: dict[bytes, list[bytes]] = {}
    for source, names in early.items():
        for name in names:
            back.setdefault(name, []).append(source)
    for name in sorted(back, key=lambda x: (-name_score(x), x)):
        queue = [name]
        while queue:
            for source in back.get(queue.pop(), ()):
                if source not in best:
                    best[source] = name_score(name)
                    queue.append(source)
    for source, score in best.items():
        for i in first.get(source, ()):
            top[i] = max(top[i], score)
    return [(x.start, x.end, score) for x, t in zip(literals, top) if t and (score := t * literal_score(x.literal)) >= THRESHOLD]


_NAMES = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_.-", np.uint8))


def sensitive_texts(raw: bytes, begin: np.ndarray) -> list[int]:
    """Which texts of the buffer hold a sensitive name; they begin at `begin`."""
    low = raw.lower()
    out: set[int] = set()
    for root in ROOTS:
        at = low.find(root)
        while at >= 0:
            a, b = at, at + len(root)
            while a and _NAMES[raw[a - 1]]:
                a -= 1
            while b < len(raw) and _NAMES[raw[b]]:
                b += 1
            if _parts_score(parts_of(raw[a:b])):
                text = int(np.searchsorted(begin, at, side="right")) - 1
                out.add(text)
                b = max(b, int(begin[text + 1]) if text + 1 < len(begin) else len(raw))
            at = low.find(root, b)
    return sorted(out)


def scan_batch(column: pa.Array) -> tuple[list[list[tuple[int, int, int]]], list[float]]:
    """Of each text: (start, kind, end) in code points, sorted; the best lexed score."""
    data, offsets = K.text_buffer(column)
    n = len(offsets) - 1
    lengths = np.diff(offsets)
    begin = offsets[:-1] + np.arange(n)
    buffer = np.full(len(data) + n, 10, np.uint8)
    inside = np.ones(len(buffer), dtype=bool)
    inside[begin + lengths] = False
    buffer[inside] = data
    raw = buffer.tobytes()
    found: list[tuple[int, int, int]] = []
    for m in ASSIGN.finditer(raw):
        if m.end(2) - m.start(2) >= 8:
            found.append((m.start(), 0, m.end()))
    for m in ACCESS.finditer(raw):
        if m.end() - m.start() >= 16:
            found.append((m.start(), 1, m.end()))
    edges = np.flatnonzero(np.diff(HEX_DIGITS[buffer].view(np.int8), prepend=0, append=0))
    long = edges[1::2] - edges[::2] >= 32
    found += [(a, 2, b) for a, b in zip(edges[::2][long].tolist(), edges[1::2][long].tolist())]

    scores = [0.0] * n
    for i in sensitive_texts(raw, begin):
        a = int(begin[i])
        text = raw[a : a + int(lengths[i])]
        for x, y, score in secrets_of(lex(text)):
            found.append((a + x, 3, a + y))
            scores[i] = max(scores[i], score)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
    if found:
        points = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])
        start, kind, end = np.array(found, dtype=np.int64).T
        doc = np.searchsorted(begin, start, side="right") - 1
        for d, s, k, e in sorted(zip(doc.tolist(), (points[start] - points[begin[doc]]).tolist(), kind.tolist(), (points[end] - points[begin[doc]]).tolist())):
            out[d].append((s, k, e))
    return out, scores


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of FINDINGS for each document; a null or empty text has none.

    base_sha256 is over the spans of the fixed patterns (kind:start:end, comma-joined), spans lists
    those and the lexed literals, by start and then by kind.
    """

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            found, scores = scan_batch(texts(batch))
            say = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)
            counts = [Counter(k for _, k, _ in spans) for spans in found]
            base = [hashlib.sha256(say([x for x in spans if x[1] < 3]).encode()).hexdigest() for spans in found]
            return pa.RecordBatch.from_arrays(
                [
                    id_array(ids(batch)),
                    *[pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1, 2)],
                    pa.array(base, pa.string()),
                    pa.array([say(spans) for spans in found], pa.string()),
                    pa.array([c[3] for c in counts], pa.int64()),
                    pa.array(scores, pa.float64()),
                ],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed", "top_score"],
            )

        return each

    return map_texts(documents(docs, id_col, text_col), make, FINDINGS)

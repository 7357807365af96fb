"""Secret spans: base patterns, and literals that reach sensitive names by assignment.

Besides three fixed patterns, source and configuration syntax is read in three steps:

* a lexer cuts the text into strings (with escapes, prefixes and triple quotes), names, signs
  and other runs; comment marks are signs like others, since what is commented out leaks as well;
* a parser takes name-literal pairs from them: assignments of all common forms, with type notes,
  subscripts and string keys, values made of several strings, calls such as
  ``set("password", "...")``, options such as ``--token ...``, and elements ``<password>..``;
* sensitivity flows from the names to the literals, through constants named before or after
  their use and chains of them, until nothing changes.

A literal is scored by the most sensitive name that it reaches and by its own look; of a literal
in several pieces each piece is a span.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillstone.llm.bpe import each_text

KINDS = ("assign", "access", "hex", "literal")

# Fixed patterns of the base.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # of 16 characters or more
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8

PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

TOKEN = re.compile(
    r"(?P<space>[^\S\n]++|\\\n)|(?P<line>\n)|(?P<quote>\"{3}|'{3}|[\"'`])"
    r"|(?P<name>[A-Za-z_$][A-Za-z0-9_$]*+(?:(?:\.|->|::|-)[A-Za-z_$][A-Za-z0-9_$]*+)*+)"
    r"|(?P<sign>=>|:=|\?=|\+=|===?(?!=)|!==?|<=|>=|=|::|:(?!//)|\+|\.\.|[.&,;()\[\]{}<>])|(?P<rest>--?(?=[A-Za-z_])|[^\s\"'`=:+,;()\[\]{}<>&-]++|[:-]|[^\s])",
    re.A,
)
#: What ends a string, by its opening marks; a single quote within a word doesn't.
STRING = {
    '"': re.compile(r"((?:[^\"\\\n]++|\\.)*+)\"", re.S),
    "'": re.compile(r"((?:[^'\\\n]++|\\.|'(?=\w))*+)'", re.S),
    "`": re.compile(r"((?:[^`\\]++|\\.)*+)`", re.S),
    '\"""': re.compile(r'((?:[^\"\\]++|\\.|\"(?!\"\"))*+)\"{3}', re.S),
    "\'\'\'": re.compile(r"((?:[^'\\]++|\\.|'(?!''))*+)'{3}", re.S),
}
PREFIX = re.compile(r"[rbfuRBFU]{1,2}\Z")
ASSIGNING = frozenset(["=", ":=", "?=", "+=", "=>", ":"])
JOINING = frozenset(["+", ".", "..", "&"])
DELIMITERS = frozenset(",;(){}<>[]")
#: Calls that take a name and give a value; their first argument is no literal.
LOOKUP = re.compile(r"(?:get|env|environ|getenv|property|lookup|find|read|load|input|prompt|getpass|param|config)", re.I)
ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*+)(?:\s[^<>]*+)?>([^<>\n]++)</\1>", re.A)
OWNER = re.compile(r"^(?:self|this|cls)(?:\.|->)|^\$")
UPPER_NAME = re.compile(r"[A-Z][A-Z_]*\Z")

#: How sensitive a name is by one of its parts, or by two that follow each other.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 0.9, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "authorization": 0.7,
    "api key": 1.0, "access key": 1.0, "private key": 1.0, "signing key": 0.9, "encryption key": 0.9, "auth key": 0.9,
}
#: A text without any of these has no sensitive name, and no match of ASSIGN.
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "auth")


PLACEHOLDER = re.compile(r"example|changeme|placeholder|your[_-]?|dummy|redacted|xxxx|\*{3}|\$\{|\{\{|%\(|^(none|null|true|false)$", re.I)
THRESHOLD = 0.6


def name_score(name: str) -> float:
    parts = [p.lower() for p in PART.findall(name)]
    pairs = [f"{a} {b}" for a, b in zip(parts, parts[1:])]
    return max((SENSITIVE.get(p, 0.0) for p in parts + pairs), default=0.0)


def literal_score(value: str) -> float:
    """0 to 1: long, varied literals without the look of a placeholder or of a plain word."""
    if len(value) < 6 or PLACEHOLDER.search(value) or UPPER_NAME.match(value):
        return 0.0
    n = len(value)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    mixed = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, 0.2 + entropy / 5 + 0.1 * mixed - (0.5 if mixed < 2 and n < 20 else 0.0))


@dataclass(slots=True)
class Token:
    kind: str  # string, name, sign, line or rest
    text: str  # of a string its contents
    start: int
    end: int
    outer: int  # where the token ends, with a string's marks
    opens: int  # where it starts, with a string's marks and prefix


def lex(text: str) -> list[Token]:
    """The tokens of a text, without white space but line ends."""
    out: list[Token] = []
    unclosed: dict[str, int] = {}  # up to where a kind of quote is known to have no end
    at = 0
    while at < len(text):
        m = TOKEN.match(text, at)
        kind = m.lastgroup
        if kind == "quote":
            mark = m[0]
            opens = at
            prefixed = bool(out) and out[-1].outer == at and out[-1].kind == "name" and PREFIX.match(out[-1].text)
            word = at > 0 and (text[at - 1].isalnum() or text[at - 1] == "_") and not prefixed
            body = None
            if at >= unclosed.get(mark, 0) and not (word and mark == "'"):
                body = STRING[mark].match(text, m.end())
                if not body:
                    line = text.find("\n", at) if mark in "\"'" else -1
                    unclosed[mark] = line if line >= 0 else len(text)
            if body:
                if prefixed:
                    opens = out.pop().start
                out.append(Token("string", body[1], *body.span(1), body.end(), opens))
                at = body.end()
                continue
            at += 1
            out.append(Token("rest", text[at - 1], at - 1, at, at, at - 1))
            continue
        if kind != "space":
            out.append(Token(kind, m[0], *m.span(), m.end(), at))
        at = m.end()
    return out


@dataclass(slots=True)
class Pair:
    """A name and the pieces of its value: (start, end) of literals, or the names of constants."""

    name: str
    pieces: list[tuple[int, int] | str]
    bare: tuple[int, int] | None  # the span of a value that is one name alone
    stop: int  # the token after the value


def _key(tokens: list[Token], i: int) -> str | None:
    """The name that the sign at ``i`` assigns to."""
    if i < 1:
        return None
    left = tokens[i - 1]
    if left.kind == "sign" and left.text == "]":  # a subscript, or a type note in brackets
        inner, k = [], i - 2
        while k >= 0 and not (tokens[k].kind == "sign" and (tokens[k].text == "[" or tokens[k].text in ASSIGNING)) and tokens[k].kind != "line":
            inner.append(tokens[k])
            k -= 1
        if k < 1 or tokens[k].text != "[":
            return None
        if len(inner) == 1 and inner[0].kind == "string":
            return f"{tokens[k - 1].text}.{inner[0].text}"
        i, left = k, tokens[k - 1]
    if left.kind not in ("name", "string"):
        return None
    note = i > 2 and left.kind == "name" and tokens[i].text in ("=", "[") and tokens[i - 2].text == ":" and tokens[i - 2].kind == "sign"
    if note and tokens[i - 3].kind == "name":
        return tokens[i - 3].text
    return left.text


def _runs(tokens: list[Token]) -> list[int]:
    """For each token the end of the run of touching tokens from it on: without strings, delimiters, and signs that assign what touches them."""
    ends = [0] * len(tokens)
    for i in range(len(tokens) - 1, -1, -1):
        t = tokens[i]
        touches = i + 1 < len(tokens) and tokens[i + 1].opens == t.outer and tokens[i + 1].kind in ("name", "rest", "sign", "string")
        assigns = t.kind == "sign" and t.text in ASSIGNING and t.text != ":" and touches and not (tokens[i + 1].kind == "sign" and tokens[i + 1].text not in DELIMITERS and ends[i + 1] > i + 1)
        if t.kind not in ("name", "rest", "sign") or t.text in DELIMITERS or assigns:
            ends[i] = i
        else:
            ends[i] = ends[i + 1] if touches and tokens[i + 1].kind != "string" else i + 1
    return ends


def _value(tokens: list[Token], i: int, runs: list[int], known: set[str]) -> Pair | None:
    """The value that starts at token ``i``, under no name yet."""
    pieces: list[tuple[int, int] | str] = []
    depth, bare, line = 0, None, False
    while i < len(tokens):
        t = tokens[i]
        if t.kind == "line":
            line = True
            i += 1
            continue
        if line and not depth and t.kind != "string" and not pieces:
            break
        if t.kind == "string":
            pieces.append((t.start, t.end))
            i += 1
        elif t.kind == "sign" and t.text == "(" and not pieces:
            depth += 1
            i += 1
            continue
        else:
            end = runs[i]
            if end == i:
                break
            after = tokens[end] if end < len(tokens) else None
            if end == i + 1 and after and after.kind != "line" and (t.text in ("@", "$") and after.opens == t.outer or t.text.lower() in ("bearer", "basic")):
                i = end  # a mark of the literal that follows
                continue
            if end == i + 1 and t.kind == "name" and after and after.kind == "sign" and after.text == "(":
                strings, k = [], end + 1
                while k < len(tokens) and not (tokens[k].kind == "sign" and (tokens[k].text == ")" or tokens[k].text in ASSIGNING)):
                    if tokens[k].kind == "string":
                        strings.append((tokens[k].start, tokens[k].end))
                    k += 1
                lookup = LOOKUP.search(tokens[i].text)
                pieces += strings[1:] if lookup else strings
                i = k + 1
            else:
                if end == i + 1 and t.kind == "name":
                    pieces.append(t.text)
                    bare = (t.start, t.end)
                elif all(tokens[k].text == "+" or tokens[k].text in known for k in range(i, end)):
                    pieces += [x.text for x in tokens[i:end] if x.text != "+"]
                else:
                    pieces.append((t.start, tokens[end - 1].end))
                i = end
        # another piece follows after a joining sign, or a string right after a string
        k, broken = i, False
        while k < len(tokens) and (tokens[k].kind == "line" and (depth or k + 1 < len(tokens) and tokens[k + 1].text in JOINING)):
            k, broken = k + 1, True
        if k < len(tokens) and tokens[k].kind == "sign" and tokens[k].text in JOINING:
            i, line = k + 1, False
            while i < len(tokens) and tokens[i].kind == "line":
                i += 1
            continue
        if k < len(tokens) and k and tokens[k].kind == "string" and tokens[i - 1].kind == "string" and (depth or not broken):
            i, line = k, False
            continue
        break
    if not pieces:
        return None
    return Pair("", pieces, bare if len(pieces) == 1 and isinstance(pieces[0], str) else None, i)


def pairs(text: str) -> Iterator[Pair]:
    """Every name-literal pair of the text."""
    tokens = lex(text)
    known = {OWNER.sub("", tokens[i - 1].text) for i, t in enumerate(tokens) if i and t.kind == "sign" and t.text in ASSIGNING and tokens[i - 1].kind == "name"}
    runs, within = _runs(tokens), 0
    for i, t in enumerate(tokens):
        name, at = None, i + 1
        if i < within and t.text == ":":
            continue  # a colon within a value
        if t.kind == "sign" and t.text in ASSIGNING:
            name = _key(tokens, i)
            if name and t.text == ":" and i + 2 < len(tokens) and tokens[i + 1].kind == "name" and tokens[i + 2].text in ("=", "["):
                continue  # a type note; the pair comes at the sign after it
        elif t.kind == "sign" and t.text == "(" and i + 2 < len(tokens) and tokens[i + 1].kind == "string" and tokens[i + 2].text == ",":
            name, at = tokens[i + 1].text, i + 3
        elif t.kind == "rest" and t.text.endswith("--") and i + 2 < len(tokens) and tokens[i + 1].kind == "name" and tokens[i + 1].start == t.end:
            if tokens[i + 2].text not in ASSIGNING and tokens[i + 2].opens > tokens[i + 1].end:
                name, at = tokens[i + 1].text, i + 2
        if name and at < len(tokens):
            pair = _value(tokens, at, runs, known)
            if pair:
                within = pair.stop
                pair.name = OWNER.sub("", name)
                yield pair
    for m in ELEMENT.finditer(text):
        yield Pair(m[1], [m.span(2)], None, 0)


def literals(text: str) -> Iterator[tuple[int, int, float]]:
    """(start, end, score) of each piece of the literals that reach a sensitive name."""
    found = list(pairs(text))
    defined: dict[str, list[int]] = {}
    for i, p in enumerate(found):
        defined.setdefault(p.name, []).append(i)
    defines = lambda ref: ref if ref in defined else OWNER.sub("", ref)
    need = {name: name_score(name) for name in defined}
    todo = [name for name, n in need.items() if n]
    while todo:  # sensitivity flows to the constants that a value names; it only rises, in few steps
        name = todo.pop()
        for ref in {defines(x) for i in defined[name] for x in found[i].pieces if isinstance(x, str)}:
            if need.get(ref, 2.0) < need[name]:
                need[ref] = need[name]
                todo.append(ref)
    own = lambda p: "".join(text[slice(*x)] for x in p.pieces if not isinstance(x, str))
    best: dict[tuple[int, int], float] = {}
    for p in found:
        score = need[p.name]
        if not score:
            continue
        spans = [x for x in p.pieces if not isinstance(x, str)]
        if p.bare and defines(p.pieces[0]) not in defined:
            spans = [p.bare]  # names nothing: a value without marks
            whole = text[slice(*p.bare)]
        else:
            first = lambda ref: "".join(own(found[k]) for k in defined.get(defines(ref), [])[:1])
            whole = "".join(first(x) if isinstance(x, str) else text[slice(*x)] for x in p.pieces) if spans else ""
        score *= literal_score(whole)
        for span in spans:
            if score >= THRESHOLD and span[0] < span[1]:
                best[span] = max(best.get(span, 0.0), score)
    for (start, end), score in best.items():
        yield start, end, score


def scan(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind; offsets in code points."""
    if not text:
        return []
    low = text.lower()
    hinted = any(x in low for x in HINTS)
    found = [("assign", *m.span(), 1.0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST] if hinted else []
    found += [("access", *m.span(), 1.0) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span(), 1.0) for m in HEX.finditer(text)]
    if hinted:
        found += [("literal", *x) for x in literals(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


@F.arrow_udf(SPANS)
def _spans(texts: pa.Array) -> pa.Array:
    return pa.array([[dict(zip(("kind", "start", "end", "score"), x)) for x in scan(t)] for t in each_text(texts)], _ARROW)


@F.arrow_udf(T.StringType())
def _redacted(texts: pa.Array) -> pa.Array:
    return pa.array([redact_text(t) for t in each_text(texts)], pa.string())


MARK = "[SECRET]"


def redact_text(text: str | None) -> str | None:
    """The text with each union of overlapping spans replaced by one mark; null stays null."""
    out, at = [], 0
    for start, end in merged([(s, e) for _, s, e, _ in scan(text)]):
        out += [text[at:start], MARK]
        at = end
    return "".join([*out, text[at:]]) if out else text


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def find_secrets(text: Column) -> Column:
    """array<struct<kind, start, end, score>> of the whole text, by start, then kind, then end.

    Null and empty texts have none. The result depends on the text alone, so repeated rows have
    the same spans and an empty table gives none; time is in proportion to the text's length.
    """
    return _spans(text)


def redact(text: Column) -> Column:
    """The text with each run of overlapping secret spans replaced by ``MARK``; null stays null, and texts without secrets as they are."""
    return _redacted(text)

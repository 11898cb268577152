"""Secret scans: an assignment-aware lexer over source and configuration text.

Three base patterns (an assignment to a sensitive word, an access key id, a
long run of hex digits) are matched leftmost and without overlaps, each kind
by itself. Beside them, the lexer cuts the text into name-literal pairs
(``name = "literal"``, ``"name": "literal"``, ``name: literal``, ``export
NAME=literal``, triple-quoted strings, indented blocks after ``name: |``),
with escapes, string prefixes and names and blanks of any length, and joins
literals added with ``+``. Constants are propagated until nothing changes: a
name assigned from another name takes the literal of its last assignment
before, else of its first one after. Each literal is scored by how sensitive
the names are that it reaches and by its own randomness. Literals at or above
``threshold`` become spans of kind ``literal``. Base spans always stay. No
quantifier gives anything back, so the time is in proportion to the text.

Spans are counted in code points, the end exclusive. Defined results: a null
text is empty; no spans give an empty string and the digest of an empty
string; repeated rows each give a row; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, numbered, pick, table

KINDS = ("assign", "access", "hex", "literal")
# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # as AKIA[A-Z0-9]+ of 16 or more: a shorter run has no longer match inside
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST = 8

_DOUBLE = r'"(?:[^"\\\n]|\\.)*+"'
_SINGLE = _DOUBLE.replace('"', "'")
_LONG = r'"""(?:(?!""")[\s\S])*+"""'
_STRING = rf"[rRbBuUfF]{{0,2}}+(?:{_DOUBLE}|{_SINGLE})"
_BLOCK = r"[|>][+-]?[\x20\t]*+\n(?:[\x20\t]++[^\n]*+(?:\n|\Z))++"
_PAIR = re.compile(
    rf"(?:(?<![\w$.-])(?P<name>[A-Za-z_$][\w$.-]*+)|(?<!\\)(?P<quoted>{_DOUBLE}|{_SINGLE}))"
    rf"[\x20\t]*+(?:=>|:=|[=:])(?![=:/])[\x20\t]*+"
    rf"(?P<value>{_LONG}|{_LONG.replace(chr(34), chr(39))}|{_STRING}(?:[\x20\t]*+\+[\x20\t]*+{_STRING})*+|{_BLOCK}|" + r"""[^\s"',;(){}\[\]]++)"""
)
_QUOTED = re.compile(_STRING)
_NAME = re.compile(r"[A-Za-z_$][\w$.]*\Z")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: How sensitive the parts of a name make its literal.
SENSITIVE = {"password": 1.0, "passwd": 1.0, "pwd": 0.9, "pass": 0.6, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "private": 0.5, "auth": 0.5, "access": 0.4, "key": 0.5, "signing": 0.4, "bearer": 0.7, "salt": 0.4, "cookie": 0.3, "session": 0.3, "api": 0.3}
#: Values that stand for a secret but are none.
PLACEHOLDERS = frozenset("none null true false changeme example placeholder password secret token your undefined".split())


def sensitivity(name: str) -> float:
    """0 to 1 or more: the summed weights of the name's distinct parts."""
    parts = {p.lower() for p in _PARTS.findall(name)}
    return sum(SENSITIVE.get(p, 0.0) for p in parts)


def randomness(literal: str) -> float:
    """0 to 1: entropy in bits a character over 4, less for short or wordy literals."""
    n = len(literal)
    if n < 8 or literal.lower() in PLACEHOLDERS or " " in literal:
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    mixed = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(1.0, bits / 4) * (0.5 if mixed < 2 else 1.0)


def name_literal_pairs(text: str) -> list[tuple[str, str, int, int, bool]]:
    """(name, literal or name, start, end, bare) of every assignment; the span is the literal without its quotes."""
    found = []
    for m in _PAIR.finditer(text):
        name = m["name"] or m["quoted"][1:-1]
        value, start, end = m["value"], m.start("value"), m.end("value")
        bare = False
        if value[:3] in ('"' * 3, "'" * 3) and len(value) >= 6:
            literal, start, end = value[3:-3], start + 3, end - 3
        elif value[0] in "|>" and "\n" in value:  # an indented block
            lines = value.split("\n")[1:]
            literal = "".join(x.strip() for x in lines)
            body = value.index("\n") + 1
            start, end = start + body + len(value[body:]) - len(value[body:].lstrip()), start + len(value.rstrip())
        elif value[-1] in "\"'" and _QUOTED.match(value):
            parts = [p.lstrip("rRbBuUfF")[1:-1] for p in _QUOTED.findall(value)]
            literal, start, end = "".join(parts), start + len(value) - len(value.lstrip("rRbBuUfF")) + 1, end - 1
        else:
            literal, bare = value, True
        if end > start:
            found.append((name, literal, start, end, bare))
    return found


def origins(pairs: list[tuple[str, str, int, int, bool]]) -> list[int]:
    """For each pair the pair that its literal comes from, by way of names; a loop of names ends where it began."""
    places: dict[str, list[int]] = {}
    for i, pair in enumerate(pairs):
        places.setdefault(pair[0], []).append(i)
    out = [-1] * len(pairs)
    for i in range(len(pairs)):
        path, at = [], i
        on = set()
        while out[at] < 0 and at not in on:
            path.append(at)
            on.add(at)
            _, value, _, _, bare = pairs[at]
            known = places.get(value) if bare and _NAME.match(value) else None
            if known:
                k = bisect_left(known, at)
                at = known[k - 1] if k else next((j for j in known if j != at), at)
        end = out[at] if out[at] >= 0 else at
        for j in path:
            out[j] = end
    return out


def literals(text: str, threshold: float) -> list[tuple[int, int]]:
    """Spans of the literals that reach a sensitive name, by itself or through other names, and look random."""
    pairs = name_literal_pairs(text)
    score: dict[int, float] = {}
    for pair, end in zip(pairs, origins(pairs)):
        score[end] = max(score.get(end, 0.0), sensitivity(pair[0]))
    return sorted({(pairs[i][2], pairs[i][3]) for i, weight in score.items() if weight and weight * randomness(pairs[i][1]) >= threshold})


def scan(text: str | None, threshold: float = 0.45) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every span, by start, then kind."""
    text = text or ""
    found = [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
        found += [(a, b, "literal") for a, b in literals(text, threshold)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def columns(texts: list[str | None]) -> dict:
    out: dict[str, list] = {c: [] for c in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
    for text in texts:
        spans = scan(text)
        count = Counter(k for _, _, k in spans)
        for kind in KINDS[:3]:
            out[f"n_{kind}"].append(count[kind])
        out["base_sha256"].append(hashlib.sha256(_joined([s for s in spans if s[2] != "literal"]).encode()).hexdigest())
        out["spans"].append(_joined(spans))
    return out


def find_secrets(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans of every document."""
    return add_columns(pick(docs, doc_id="doc_id", text="text"), columns, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str | None, mask: str = "[SECRET]") -> str | None:
    """The text with every span replaced, overlapping spans by one mask."""
    if not text:
        return text
    out, at = [], 0
    for start, end, _ in scan(text):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redaction_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span is masked in ``text``, and ``n_chars`` follows where there is one; no row goes and the columns stay, whatever their names.

    Null texts stay null, empty ones empty; equal rows are masked alike.
    """
    own, columns = numbered(docs)
    masked = add_columns(own.withColumn("text", F.col(columns["text"])), lambda texts: {"new": [redact(t) for t in texts]}, "new string")
    fresh = {columns["text"]: F.col("new")}
    if "n_chars" in columns:
        fresh[columns["n_chars"]] = F.char_length("new").cast(docs.schema["n_chars"].dataType)
    return masked.select(*[fresh.get(c, F.col(c)).alias(c) for c in own.columns]).toDF(*docs.columns)


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and spans of all documents; nulls, repeats and empty tables as the module states."""
    return find_secrets(table(spark, sf_dir, "documents"))

"""Secret scans (operator 1): assignment-aware lexing.

Source and configuration lines are read as pairs of a name and a literal (``x = "..."``,
``"x": '...'``, ``x := ...``, ``x => ...``, ``export X=...``), literals joined by ``+``
count as one, and a name used as a value stands for the constant it was given earlier. Names may be
keys in brackets (``env["X"] = ...``) or elements (``<x>...</x>``). A literal may have a prefix
(``f"..."``), stand on the next line, go on over lines within brackets, or be a block in triple
quotes, an indented block after ``x: |``, or a here-document. What names stand for is kept as
a graph of literals, so sums of sums take no more time than the text they are written in.
A literal scores by the sensitive words in its target's name and by its own look;
those that score enough are spans of kind ``named``. The three fixed patterns
(``assign``, ``access``, ``hex``) are always reported beside them.

Null text is an empty text and has no spans. Repeated rows are scanned each on its own,
equal spans of one kind are reported once, and an empty table gives an empty result.
Whole texts are scanned; only the id and text columns are read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, sha256, spans_text, table

KINDS = ("assign", "access", "hex", "named")

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
# Runs are maximal either way, so the least length can be part of the pattern.
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_ASSIGN_STEMS = (b"passw", b"secret", b"token", b"apikey", b"api_key")

#: Words in a name that make its value sensitive, with their weight.
SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "secret": 3, "token": 3, "apikey": 3, "credential": 3,
    "credentials": 3, "privatekey": 3, "accesskey": 3, "secretkey": 3, "authkey": 3, "bearer": 2, "auth": 2, "key": 1,
    "private": 2, "api": 1, "access": 1, "signing": 2, "encryption": 2, "session": 1,
}
#: Literals that stand for a value and aren't one.
PLACEHOLDERS = re.compile(r"(?i)^(?:x{3,}|\*{3,}|<.*>|\$\{.*\}|\{\{.*\}\}|your[_-].*|example.*|changeme|none|null|true|false|todo|undefined)$")

_PAIR = re.compile(r"([\"']?)(?<![\w.$-])([A-Za-z_][A-Za-z0-9_.-]*+)\1(?:(?<=[\"'])\])?[ \t]*(?::=|=>|=(?![=~>])|:(?![:/=]))[ \t]*")
_VALUE = re.compile(r"(?:[rRbBfFuU]{1,2}(?=[\"']))?+(?:\"((?:[^\"\\\n]|\\.)*+)\"|'((?:[^'\\\n]|\\.)*+)'|([A-Za-z_][\w.]*)|([^\s,;)}\]\"'+]+))")
_ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*+)>([^<>\n]++)</\1>")
_BLOCK = re.compile(r"[|>][+-]?[ \t]*$")
_HERE = re.compile(r"(?:\$\(cat[ \t]+)?<<-?[ \t]*([\"']?)(\w+)\1[ \t]*$")
_KEY_BLOCK = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_PLUS = re.compile(r"[ \t]*\+[ \t]*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> int:
    """Sum of the weights of a name's sensitive words (``db_userPassword`` has ``password``)."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return sum(SENSITIVE.get(p, 0) for p in (*parts, *joined))


class Given:
    """What a name is given: one literal, or a sum of such values. ``bag`` has the characters, each with its count."""

    __slots__ = ("bag", "key", "blank", "parts", "size", "span", "text")
    MOST = 1 << 30  # counts of sums of sums are not told beyond this

    def __init__(self, span: tuple[int, int] | None, text: str, parts: tuple[Given, ...] = ()) -> None:
        self.span, self.text, self.parts = span, text, parts
        if parts:
            self.bag: dict[str, int] = {}
            for part in parts:
                for c, k in part.bag.items():
                    self.bag[c] = min(self.bag.get(c, 0) + k, self.MOST)
            self.blank, self.key = any(p.blank for p in parts), any(p.key for p in parts)
            # Short sums can spell a placeholder.
            self.text = "".join(p.text for p in parts) if sum(len(p.text) for p in parts) <= 64 and all(p.text or not p.size for p in parts) else ""
        else:
            lines = [line.strip() for line in text.split("\n")]
            self.key = bool(_KEY_BLOCK.search(text))
            self.blank = any(c.isspace() for line in lines for c in line)
            self.bag = dict(Counter("".join(lines)))
        self.size = sum(self.bag.values())


def literal_score(value: Given) -> int:
    """0 for what can't be a secret; more for long, mixed and disordered literals, and for blocks of private keys."""
    if value.key:
        return 3
    n = value.size
    if n < 8 or value.blank or PLACEHOLDERS.match(value.text):
        return 0
    entropy = -sum(k / n * math.log2(k / n) for k in value.bag.values())
    kinds = sum(any(map(f, value.bag)) for f in (str.isdigit, str.islower, str.isupper)) + any(not c.isalnum() for c in value.bag)
    return (n >= 12) + (entropy >= 3) + (kinds >= 2)


class _Lines:
    """A text's lines with their places, and where each stripped line stands."""

    def __init__(self, text: str) -> None:
        self.text, self.lines = text, text.split("\n")
        self.at = [0]
        for line in self.lines:
            self.at.append(self.at[-1] + len(line) + 1)
        self._said: dict[str, list[int]] | None = None

    def closing(self, word: str, after: int) -> int:
        """The first line after this one that says just this word; -1 if none does."""
        if self._said is None:
            self._said = {}
            for i, line in enumerate(self.lines):
                self._said.setdefault(line.strip(), []).append(i)
        own = self._said.get(word, [])
        k = bisect_right(own, after)
        return own[k] if k < len(own) else -1

    def block(self, first: int, end: int) -> list[Given]:
        """The lines from ``first`` up to ``end`` as one literal."""
        start, to = self.at[first], max(self.at[first], self.at[end] - 1)
        body = self.text[start:to]
        start += len(body) - len(body.lstrip())
        body = body.strip()
        return [Given((start, start + len(body)), body)] if body else []

    def indented(self, number: int) -> list[Given]:
        """The lines below that are indented further than this one."""
        indent = len(self.lines[number]) - len(self.lines[number].lstrip())
        end = number + 1
        while end < len(self.lines):
            own = self.lines[end]
            if own.strip() and len(own) - len(own.lstrip()) <= indent:
                break
            end += 1
        return self.block(number + 1, end)


def named_literals(text: str, least: int = 5) -> set[tuple[int, int]]:
    """Spans of the literals whose target's name and own look score ``least`` together."""
    constants: dict[str, Given] = {}
    hits: list[Given] = []

    def judge(name: str, value: Given) -> None:
        score = name_score(name)
        if score >= 2 and (own := literal_score(value)) and score + own >= least:
            hits.append(value)

    lines = _Lines(text)
    for number, line in enumerate(lines.lines):
        if "=" in line or ":" in line:
            for pair in _PAIR.finditer(line):
                pieces = _pieces(lines, number, pair, constants)
                if pieces:
                    value = pieces[0] if len(pieces) == 1 else Given(None, "", tuple(pieces))
                    constants[pair[2]] = value
                    judge(pair[2], value)
    if "</" in text:
        for m in _ELEMENT.finditer(text):
            judge(m[1], Given(m.span(2), m[2].strip()))
    found: set[tuple[int, int]] = set()
    seen: set[int] = set()
    while hits:
        value = hits.pop()
        if id(value) not in seen:
            seen.add(id(value))
            hits += value.parts
            if value.span and value.span[1] > value.span[0]:
                found.add(value.span)
    return found


def _pieces(lines: _Lines, number: int, pair: re.Match[str], constants: dict[str, Given]) -> list[Given]:
    """What a name is given: literals, constants, or their sum; a literal may stand on the next line, go
    on there within brackets, or be a block. A name in a sum that stands for nothing known is no literal."""
    line, to, pieces, bracket, plus = lines.lines[number], pair.end(), [], False, None
    if _BLOCK.match(line, to):
        return lines.indented(number)
    if here := _HERE.match(line, to):
        end = lines.closing(here[2], number)
        return lines.block(number + 1, end) if end >= 0 else []
    while True:
        at = lines.at[number]
        if (rest := line[to:].strip()) in ("", "(", "\\"):
            bracket |= rest == "("
            follows = lines.lines[number + 1].lstrip() if number + 1 < len(lines.lines) else ""
            if follows[:1] not in ("'", '"') or not follows or (pieces and not (bracket or plus)):
                return pieces
            number += 1
            line = lines.lines[number]
            at, to = lines.at[number], len(line) - len(follows)
        elif line.startswith("(", to):
            bracket, to = True, to + 1 + len(line[to + 1 :]) - len(line[to + 1 :].lstrip())
        mark = line[to : to + 3]
        if mark in ('"""', "'''"):
            end = lines.text.find(mark, at + to + 3)
            body = lines.text[at + to + 3 : max(end, 0)]
            start = at + to + 3 + len(body) - len(body.lstrip())
            return [*pieces, Given((start, start + len(body.strip())), body.strip())] if body.strip() else pieces
        value = _VALUE.match(line, to)
        if not value:
            return pieces
        kind = value.lastindex or 0
        follows_plus = _PLUS.match(line, value.end())
        if kind == 3 and (known := constants.get(value[3])):
            pieces.append(known)
        elif kind in (1, 2, 4) or not (plus or follows_plus) and (pair[1] == "" and not value[3].islower() or any(map(str.isdigit, value[3]))):
            s, e = value.span(kind)
            pieces.append(Given((at + s, at + e), value[kind]))
        to = value.end()
        if plus := follows_plus:
            to = plus.end()
        elif not (bracket and line[to:].strip() == ""):
            return pieces


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text, as (start, kind, end) in code points."""
    if not text:
        return [], []
    low = text.encode("utf-8", "surrogatepass").lower()
    base = []
    if any(s in low for s in _ASSIGN_STEMS):
        base += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if b"akia" in low:
        base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    more = []
    if b"=" in low or b":" in low:
        more = [(s, 3, e) for s, e in named_literals(text)]
    return base, base + more


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_named long"


def secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and spans of secrets for each document; one pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for text in part.column(1).to_pylist():
                    base, spans = scan(text)
                    n = [sum(k == i for _, k, _ in spans) for i in range(4)]
                    rows.append((n[0], n[1], n[2], sha256(spans_text(base, KINDS)), spans_text(spans, KINDS), n[3]))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_named"],
                )

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, SCHEMA)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))

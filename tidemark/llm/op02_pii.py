"""PII (operator 2): a linear-chain conditional random field over word shapes.

The model labels words as parts of an e-mail address, IP address, card or phone number
from their shape and their neighbours' shapes and cue words. It is trained on the driver
from the small labelled table below (maximum likelihood, forward-backward in numpy), and
its weights, some kilobytes, go to the tasks. Each task decodes batches of word sequences
with Viterbi in numpy, all sequences of similar length side by side. Decoding allows labels
only on words that have a digit or ``@`` (in the table all labelled words have one). All other
words are outside then, whatever their scores, so the best path falls apart there and a sequence
is just the words around those with a digit or ``@``: decoding it is decoding the text. The fixed patterns are always reported; what the model finds beside
them, without overlap, is added.

Null text is an empty text and has no spans. Whole texts are read, whatever their length.
Repeated rows are judged each on its own, ties in a path's score go to the earlier label,
and an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, sha256, spans_text, table

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Runs of digits are maximal at both ends, so a match can only begin where one does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", domain.end() if domain else at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns."""
    if not _MARK.search(text):
        return []
    found = [(s, 0, e) for s, e in emails(text)]
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return found


#: The labelled table; personal data stands in brackets after its kind.
LABELLED = """\
Please call [phone (415) 555-0134] before noon
or phone [phone 415-555-0199] and ask for the desk
tel [phone 020 7946 0018] daily
Tel: [phone 030 1234 5678] oder per Mail
my number is [phone 212 555 0147] at home
fax [phone (0211) 555 0134] bitte
mobile [phone 07700 900123] only in the evening
téléphone [phone 01 42 68 53 00] le matin
llame al [phone 91 555 0143] por la tarde
reach me on [phone +44 20 7946 0018] or by letter
dial [phone +1 (212) 555-0147] for help
call [phone 555-0123] today
mail [email jane.doe@example.org] for the list
write to [email info@mail.example.com] or come by
email: [email a_b+c@example.net] thanks
contact [email root@localhost] on the machine
send it to [email admin@intranet] please
ask [email jane@example] about it
server [ip 10.0.0.12] is down
ping [ip 192.168.1.254] twice
host [ip 172.16.4.9:8080] answers
the address [ip 8.8.8.8/32] was blocked
card [card 4111 1111 1111 1111] expires soon
Visa [card 5500-0000-0000-0004] on file
paid with card [card 4012888888881881] yesterday
carte [card 4970 1012 3456 7893] acceptée
in 2019 there were 12 of 340 left
the total of 1,250.75 was paid on 2021-03-04
version 2.0.1 of chapter 12 has 300 pages
from 1999 to 2004 and again in 2010
room 101 on floor 3 opens at 10:30
a score of 3-2 in the 90th minute
isbn 978-3-16-148410-0 is out of print
order 1234567890123456 was shipped on 12 May
section 4.2.1.7 of the manual says so
see pages 12-15 and 20-25 of part 2
the value 9000010000200003 is an id
on 12/05/2020 at 14:00 in hall 7
id 6000700080009001 and 3100410051006101 follow
token = "00aa11bb22cc33dd44ee55ff66aa77bb88cc99dd" here
costs 100 200 300 or 400 dollars
@home and @work are handles
meet @ noon or @ 12 o'clock
2024-01-01 00:00:00 log 17 started
words without any number at all stand here
item 555 has 0123 in stock
between 415 and 555 there are many
"""

_CUES = {
    "call": "tel", "phone": "tel", "tel": "tel", "telephone": "tel", "mobile": "tel", "fax": "tel", "dial": "tel", "number": "tel",
    "téléphone": "tel", "llame": "tel", "telefon": "tel", "teléfono": "tel", "mail": "mail", "email": "mail", "write": "mail", "contact": "mail",
    "card": "card", "visa": "card", "carte": "card", "mastercard": "card", "server": "host", "host": "host", "ping": "host", "address": "host",
}
_LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_WORD = re.compile(r"\S+")
_RUNS = re.compile(r"[0-9]+|[^\W\d_]+", re.UNICODE)


def shape(word: str) -> str:
    """A word's shape: letters are one x, digits a d and how many (5 stands for more)."""
    return _RUNS.sub(lambda m: f"d{min(len(m[0]), 5)}" if m[0][0].isdecimal() else "x", word)


_SHAPES: dict[str, str] = {}
_SHAPES_KEPT, _LONG_WORD = 50_000, 60


def known_shape(word: str) -> str:
    """The same; those of short words are kept, so memory is bounded."""
    if len(word) > _LONG_WORD:
        return shape(word)
    if word not in _SHAPES:
        if len(_SHAPES) >= _SHAPES_KEPT:
            _SHAPES.clear()
        _SHAPES[word] = shape(word)
    return _SHAPES[word]


def features(words: list[str]) -> list[list[str]]:
    """The names of each word's features."""
    core = [w.strip(".,;:!?\"'()[]{}|") for w in words]
    shapes = ["^", *map(known_shape, core), "$"]
    cues = ["", *(_CUES.get(c.lower(), "") for c in core)]
    valid = [""] * len(words)
    for i, c in enumerate(core):
        d = _digits(c)
        if 14 <= len(d) <= 19 and len(d) >= len(c) - 3:
            valid[i] = "luhn" if luhn(d) else "digits"
        elif len(d) == 4 == len(c) and i + 4 <= len(core) and all(x.isdecimal() and x.isascii() and len(x) == 4 for x in core[i : i + 4]):
            valid[i : i + 4] = ["luhn" if luhn("".join(core[i : i + 4])) else "digits"] * 4
    out = []
    for i, w in enumerate(words):
        own = ["bias", "s=" + shapes[i + 1], "p=" + shapes[i] + "_" + shapes[i + 1], "n=" + shapes[i + 1] + "_" + shapes[i + 2]]
        if cues[i]:
            own.append(f"c={cues[i]}_{shapes[i + 1]}")
            own.append(f"c={cues[i]}")
        if valid[i]:
            own.append("v=" + valid[i])
        if "@" in w[1:-1]:
            own.append("at")
        if not any(c.isdecimal() or c == "@" for c in w):
            own.append("word")
        out.append(own)
    return out


@dataclass(frozen=True)
class Model:
    """Weights of features by label, and of a label by the one before (the last row: the first word)."""

    names: dict[str, int]
    emit: np.ndarray
    move: np.ndarray

    def scores(self, words: list[str]) -> np.ndarray:
        found = np.array([self.emit[[self.names[f] for f in own if f in self.names]].sum(axis=0) for own in features(words)])
        found[[not _MARK.search(w) for w in words], 1:] = -1e6
        return found


def labelled() -> list[tuple[list[str], list[int]]]:
    out = []
    for line in LABELLED.splitlines():
        words, labels = [], []
        for part in re.split(r"(\[\w+ [^\]]+\])", line):
            marked = re.fullmatch(r"\[(\w+) ([^\]]+)\]", part)
            for i, w in enumerate((marked[2] if marked else part).split()):
                words.append(w)
                labels.append(_LABELS.index(f"{'I' if i else 'B'}-{marked[1]}") if marked else 0)
        out.append((words, labels))
    return out


@cache
def trained(rounds: int = 150, rate: float = 0.3, shrink: float = 0.02) -> Model:
    """Gradient ascent (Adagrad) on the table's log-likelihood; sequences padded side by side."""
    data = labelled()
    feats = [features(w) for w, _ in data]
    names = {f: i for i, f in enumerate(sorted({f for s in feats for own in s for f in own}))}
    n, t, k = len(data), max(len(w) for w, _ in data), len(_LABELS)
    x = np.zeros((n, t, len(names)))
    y, real = np.zeros((n, t), int), np.zeros((n, t), bool)
    for i, (s, (_, labels)) in enumerate(zip(feats, data, strict=True)):
        for j, own in enumerate(s):
            x[i, j, [names[f] for f in own]] = 1
        y[i, : len(labels)], real[i, : len(labels)] = labels, True
    gold = np.eye(k)[y] * real[:, :, None]
    gold_move = np.zeros((k + 1, k))
    np.add.at(gold_move, (np.full(n, k), y[:, 0]), 1)
    both = real[:, 1:]
    np.add.at(gold_move, (y[:, :-1][both], y[:, 1:][both]), 1)
    emit, move = np.zeros((len(names), k)), np.zeros((k + 1, k))
    seen = [np.full_like(emit, 1e-6), np.full_like(move, 1e-6)]

    def total(v: np.ndarray, axis: int) -> np.ndarray:
        top = v.max(axis=axis, keepdims=True)
        return np.squeeze(top, axis) + np.log(np.exp(v - top).sum(axis=axis))

    for _ in range(rounds):
        e = x @ emit
        forward, back = np.zeros((n, t, k)), np.zeros((n, t, k))
        forward[:, 0] = move[k] + e[:, 0]
        for j in range(1, t):
            forward[:, j] = np.where(real[:, j, None], total(forward[:, j - 1, :, None] + move[None, :k], 1) + e[:, j], forward[:, j - 1])
        for j in range(t - 2, -1, -1):
            step = total(move[None, :k] + (e[:, j + 1] + back[:, j + 1])[:, None, :], 2)
            back[:, j] = np.where(real[:, j + 1, None], step, 0)
        z = total(forward[:, -1], 1)
        belief = np.exp(forward + back - z[:, None, None]) * real[:, :, None]
        expected = np.zeros((k + 1, k))
        expected[k] = belief[:, 0].sum(axis=0)
        for j in range(1, t):
            pair = np.exp(forward[:, j - 1, :, None] + move[None, :k] + (e[:, j] + back[:, j])[:, None, :] - z[:, None, None])
            expected[:k] += pair[real[:, j]].sum(axis=0)
        for at, (weights, slope) in enumerate(((emit, np.einsum("ntf,ntk->fk", x, gold - belief)), (move, gold_move - expected))):
            slope = slope - shrink * weights
            seen[at] += slope**2
            weights += rate * slope / np.sqrt(seen[at])
    for i, a in enumerate(_LABELS):
        for j, b in enumerate((*_LABELS,)):
            if b[0] == "I" and a[1:] != b[1:]:
                move[i, j] = -1e6  # a name can't go on that has not begun
    move[k, [j for j, b in enumerate(_LABELS) if b[0] == "I"]] = -1e6
    return Model(names, emit, move)


def viterbi(scores: list[np.ndarray], move: np.ndarray) -> list[np.ndarray]:
    """The best labels of each sequence; sequences of similar length are decoded together."""
    k = move.shape[1]
    out: list[np.ndarray] = [np.zeros(0, int)] * len(scores)
    by_length: dict[int, list[int]] = {}
    for i, s in enumerate(scores):
        by_length.setdefault(len(s).bit_length(), []).append(i)
    for own in by_length.values():
        size = np.array([len(scores[i]) for i in own])
        t = size.max()
        e = np.zeros((len(own), t, k))
        for r, i in enumerate(own):
            e[r, : size[r]] = scores[i]
        best, come = move[k] + e[:, 0], np.zeros((len(own), t, k), np.int8)
        for j in range(1, t):
            ways = best[:, :, None] + move[None, :k]
            come[:, j] = ways.argmax(axis=1)
            best = np.where((j < size)[:, None], ways.max(axis=1) + e[:, j], best)
        label = best.argmax(axis=1)
        path = np.zeros((len(own), t), int)
        for j in range(t - 1, -1, -1):
            path[:, j] = label
            label = np.where((j < size) & (j > 0), come[np.arange(len(own)), j, label], label)
        for r, i in enumerate(own):
            out[i] = path[r, : size[r]]
    return out


def sequences(text: str, around: int = 2) -> Iterator[list[tuple[int, int]]]:
    """Spans of the words near words with a digit or @, near ones in one sequence."""
    words: list[tuple[int, int]] = []
    near = 0
    before: list[tuple[int, int]] = []
    for m in _WORD.finditer(text):
        if _MARK.search(m[0]):
            words += [*before, m.span()]
            before, near = [], around
        elif near:
            words.append(m.span())
            near -= 1
        else:
            if words and len(before) == around:
                yield words
                words = []
            before = [*before[1 - around :], m.span()] if around > 1 else [m.span()]
    if words:
        yield words


def _valid(kind: int, text: str) -> bool:
    d = len(_digits(text))
    return (kind == 0 and "@" in text[1:-1]) or (kind == 1 and text.count(".") == 3) or (kind == 2 and 13 <= d <= 19) or (kind == 3 and 7 <= d <= 15)


def model_spans(texts: list[str], model: Model) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) that the model finds in each text."""
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    owner, spans, scores = [], [], []
    for i, text in enumerate(texts):
        if _MARK.search(text):
            for own in sequences(text):
                owner.append(i)
                spans.append(own)
                scores.append(model.scores([text[s:e] for s, e in own]))
    for i, own, path in zip(owner, spans, viterbi(scores, model.move), strict=True):
        at = 0
        while at < len(own):
            if not path[at]:
                at += 1
                continue
            kind, start = (path[at] - 1) // 2, own[at][0]
            at += 1
            while at < len(own) and _LABELS[path[at]][0] == "I":
                at += 1
            end = own[at - 1][1]
            while start < end and not (texts[i][start].isalnum() or texts[i][start] in "(+"):
                start += 1
            while start < end and not texts[i][end - 1].isalnum():
                end -= 1
            if "\n" not in texts[i][start:end] and _valid(int(kind), texts[i][start:end]):
                found[i].append((start, int(kind), end))
    return found


def all_spans(texts: list[str], model: Model) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans and all spans of each text."""
    out = []
    for text, extra in zip(texts, model_spans(texts, model), strict=True):
        base = base_spans(text)
        out.append((base, base + [x for x in extra if all(x[2] <= s or e <= x[0] for s, _, e in base)]))
    return out


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_model long"


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts (of the fixed patterns) and all spans of each document; one pass, no shuffle."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = []
                for base, spans in all_spans(pc.fill_null(part.column(1), "").to_pylist(), model):
                    n = [sum(k == i for _, k, _ in base) for i in range(4)]
                    rows.append((*n, sha256(spans_text(base, KINDS)), spans_text(spans, KINDS), len(spans) - len(base)))
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_model"],
                )

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, SCHEMA)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span (overlapping ones as one) replaced by its kind in brackets."""
    out, done = [], 0
    for start, kind, end in sorted(spans):
        if start >= done:
            out += [text[done:start], f"[{KINDS[kind].upper()}]"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The documents with personal data replaced in their texts (and ``n_chars`` kept true); nulls stay null."""
    model, names = trained(), docs.columns
    at, size = names.index(text_col), names.index(length_col) if length_col in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = part.column(at).to_pylist()
                found = all_spans([t or "" for t in texts], model)
                new = [t if t is None or not spans else redacted(t, spans) for t, (_, spans) in zip(texts, found, strict=True)]
                columns = list(part.columns)
                columns[at] = pa.array(new, columns[at].type)
                if size is not None:
                    lengths = [len(n) if t != n else old for t, n, old in zip(texts, new, columns[size].to_pylist(), strict=True)]
                    columns[size] = pa.array(lengths, columns[size].type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return map_arrow(docs, run, docs.schema)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))

"""Quality rules (operator 5): line-first cleaning.

Every line of a document is judged by itself: navigation (table or menu bars, breadcrumbs),
symbols, shouting, one word over and over, boilerplate phrases in English, German, French
and Spanish, and lines that only repeat an earlier line. Two more rules are judged with a
line's neighbours, because prose is often wrapped: punctuation (a paragraph has a sentence's
end somewhere) and menus of capitalised words. A line is joined with the next one if it has no
end and the next begins in lower case or it is about as long as the lines around it. List
items and lines of code need no end, and a heading none if told prose comes next. Failing
lines are removed, and all others stay as they are, blank ones too; a document that loses
too much of its text is rejected. Over that stands the fixed base rule on word counts and
repeated five-word windows. ``cleaned`` returns the text that stays, ``quality`` its verdicts.

Null text is an empty text. Empty texts have no words and fail the base rule. Very long
texts are handled whole; memory is bounded by one document's words. Repeated rows are
judged each on its own, ties don't arise, and an empty table gives an empty result.
Only the id and text columns are read, so other columns can have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table
from .textbytes import SPACE_WORDS, chunks, gram_hashes, mix64, per_document, runs_within, word_hashes, words

_SYMBOLS = b"#*$%&|<>"
_BARS = frozenset((b"|", b">", b"/", b"->", "»".encode(), "•".encode(), "·".encode()))
_SPACES = b" \t\r\x0b\x0c"
_LOWER = bytes(range(0x61, 0x7B))
_NO_ALNUM = bytes(b for b in range(128) if not chr(b).isalnum())

#: Phrases of lines that carry no content of their own.
BOILERPLATE = tuple(
    phrase.encode()
    for phrase in (
        "all rights reserved", "terms of service", "terms and conditions", "privacy policy", "cookie policy", "accept cookies", "use of cookies",
        "click here", "read more", "sign up", "log in", "subscribe to our", "share this", "follow us", "skip to content", "back to top",
        "lorem ipsum", "enable javascript",
        "alle rechte vorbehalten", "nutzungsbedingungen", "datenschutzerklärung", "cookie-richtlinie", "cookies akzeptieren", "verwendung von cookies",
        "hier klicken", "mehr lesen", "weiterlesen", "jetzt registrieren", "folgen sie uns", "zum inhalt springen", "nach oben", "zum seitenanfang",
        "tous droits réservés", "conditions d'utilisation", "conditions générales", "politique de confidentialité", "accepter les cookies",
        "cliquez ici", "lire la suite", "en savoir plus", "inscrivez-vous", "suivez-nous", "aller au contenu", "haut de page",
        "todos los derechos reservados", "términos y condiciones", "términos de servicio", "política de privacidad", "aceptar cookies",
        "haga clic aquí", "leer más", "seguir leyendo", "regístrate", "síguenos", "saltar al contenido", "volver arriba",
    )
)
#: Marks that end a sentence, and marks that may follow them.
_ENDS = ".!?…:;。！？"
_CLOSERS = "\"'”’»›)]"


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the final decision."""

    most_symbols: float = 0.5  # symbols for each word of a line
    most_bars: float = 0.2  # words of a line that are only a bar or an arrow
    most_upper: float = 0.8  # upper-case letters among a line's letters
    least_letters: int = 12  # of a line to which the upper-case rule applies
    most_same: float = 0.4  # share of the line's words that equal the word before
    least_same: int = 8  # words of a line to which the same-word rule applies
    least_prose: int = 6  # words of a line to which the rule of sentence ends applies
    least_menu: int = 4  # words of a line without an end to which the menu rule applies
    most_capitals: float = 0.7  # words of a menu that begin with a capital
    boilerplate_words: int = 12  # a phrase only condemns lines of at most so many words
    full_line: float = 0.6  # of the longest line around, that a wrapped line has at least
    least_full: int = 30  # characters of a wrapped line
    heading_words: int = 14  # words of a heading at most
    most_lost: float = 0.5  # share of the document's word characters in failing lines


def ends(word: bytes) -> bool:
    """Whether a sentence or a clause ends with the word."""
    if word[-1] in b".!?:;)]":
        return True
    return word.decode("utf-8", "replace").rstrip(_CLOSERS).endswith(tuple(_ENDS))


def line_failure(line: bytes, words: list[bytes], rules: LineRules) -> str:
    """Name of the first rule that the line fails, or nothing."""
    n = len(words)
    symbols = len(line) - len(line.translate(None, _SYMBOLS))
    if symbols:
        if n >= 3 and sum(w in _BARS for w in words) > rules.most_bars * n:
            return "navigation"
        if symbols > rules.most_symbols * n:
            return "symbols"
    elif n >= 3 and sum(w in _BARS for w in words if len(w) < 3) > rules.most_bars * n:
        return "navigation"
    if len(line) - len(line.translate(None, _LOWER)) < 0.5 * len(line):
        text = line.decode("utf-8", "replace")
        upper = sum(map(str.isupper, text))
        if upper >= rules.least_letters and upper > rules.most_upper * sum(map(str.isalpha, text)):
            return "shouting"
        if not line.translate(None, _NO_ALNUM):
            return "punctuation"
    if n >= rules.least_same and sum(map(eq, words, words[1:])) > rules.most_same * n:
        return "repetition"
    if n <= rules.boilerplate_words:
        low = line.lower() if line.isascii() else line.decode("utf-8", "replace").lower().encode()
        if any(x in low for x in BOILERPLATE):
            return "boilerplate"
    return ""


#: Beginnings of list items, and what only code has.
_ITEM = re.compile(r"\s*(?:[-*+•–]|\d{1,3}[.)]|[A-Za-z][.)])\s+\S")
_CODE = re.compile(r"\t| {2}|.*(?:[{}]|\w\(|\s[=!<>+-]?=\s|=>|::)")
_LAST = tuple(".!?")


def open_line(line: bytes, words: list[bytes], rules: LineRules) -> bool:
    """Whether the line has no end, so that its neighbours must tell what it is."""
    return len(words) >= rules.least_menu and not ends(words[-1]) and not any(w[-1] in b".!?" for w in words)


def _continues(line: str, following: str, longest: int, rules: LineRules) -> bool:
    if ends(line.split()[-1].encode()) or _ITEM.match(following) or _CODE.match(following):
        return False
    return following.lstrip()[0].islower() or len(line) >= max(rules.least_full, rules.full_line * longest)


def _is_menu(words: list[str], rules: LineRules) -> bool:
    return len(words) >= rules.least_menu and sum(w[0].isupper() for w in words) > rules.most_capitals * len(words)


def paragraphs(lines: list[str | None], rules: LineRules) -> list[list[int]]:
    """Numbers of the lines of each paragraph; None stands for a blank or failing line."""
    out: list[list[int]] = []
    at = 0
    while at < len(lines):
        if lines[at] is None:
            at += 1
            continue
        to = at
        while to < len(lines) and lines[to] is not None:
            to += 1
        longest = max(len(lines[i]) for i in range(at, to))
        for i in range(at, to):
            if i > at and _continues(lines[i - 1], lines[i], longest, rules):
                out[-1].append(i)
            else:
                out.append([i])
        at = to
    return out


def failures_in_context(lines: list[str | None], rules: LineRules) -> set[int]:
    """Lines that fail by the rules of sentence ends and of menus, seen in their paragraphs."""
    found = paragraphs(lines, rules)
    told = []
    for own in found:
        words = [w for i in own for w in lines[i].split()]
        told.append(ends(words[-1].encode()) or any(w.endswith(_LAST) for w in words))
    failing: set[int] = set()
    for k, own in enumerate(found):
        menus = [i for i in own if _is_menu(lines[i].split(), rules) and open_line(lines[i].encode(), [w.encode() for w in lines[i].split()], rules)]
        if len(own) > 1:
            menus = [i for i in menus if i == own[-1] or not lines[i + 1].lstrip()[0].islower()]
            if 2 * len(menus) >= len(own) and menus:
                failing.update(menus)
            elif not told[k] and sum(len(lines[i].split()) for i in own) >= rules.least_prose:
                failing.update(own)
            continue
        line = lines[own[0]]
        words = line.split()
        if told[k] or len(words) < rules.least_menu:
            continue
        near = [i for i in (own[0] - 1, own[0] + 1) if 0 <= i < len(lines) and lines[i] is not None]
        if (_ITEM.match(line) or _CODE.match(line)) and not (menus and any(_is_menu(lines[i].split(), rules) for i in near)):
            continue
        heads = len(words) <= rules.heading_words and k + 1 < len(found) and told[k + 1]
        if heads and (not menus or any(w[0].islower() for w in words)):
            continue
        if menus or len(words) >= rules.least_prose:
            failing.add(own[0])
    return failing


def repeat_words(words: list[bytes]) -> int:
    """Words covered by five-word windows that occur twice or more in the text."""
    first: dict[tuple, int] = {}
    hit: set[int] = set()
    for i, w in enumerate(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False)):
        j = first.setdefault(w, i)
        if j != i:
            hit.update((i, j))
    total, to = 0, 0
    for i in sorted(hit):
        total += i + 5 - max(i, to)
        to = i + 5
    return total


def clean_lines(text: bytes, rules: LineRules) -> tuple[list[bytes], int, int, int, int]:
    """The lines that stay; lines equal to an earlier one, failing lines, word bytes lost and in all."""
    seen: set[bytes] = set()
    lines = text.split(b"\n")
    good = [True] * len(lines)
    dup = failed = lost = total = unsure = 0
    for i, line in enumerate(lines):
        own = line.split()  # bytes.split() splits on exactly 0x20 and 0x09-0x0D
        if not own:
            continue
        total += len(line.translate(None, _SPACES))
        again = line in seen
        if again:
            dup += 1
        else:
            seen.add(line)
        good[i] = not again and not line_failure(line, own, rules)
        unsure += good[i] and open_line(line, own, rules)
    if unsure:
        shown = [line.decode("utf-8", "replace") if good[i] and line.split() else None for i, line in enumerate(lines)]
        for i in failures_in_context(shown, rules):
            good[i] = False
    for i, line in enumerate(lines):
        if not good[i]:
            failed += 1
            lost += len(line.translate(None, _SPACES))
    return [line for line, stays in zip(lines, good, strict=True) if stays], dup, failed, lost, total


def judge(texts: pa.Array, rules: LineRules) -> pa.RecordBatch:
    """The columns of the result, but for the id, of each text."""
    out: list[tuple] = []
    for chunk in chunks(texts):
        w = words(chunk, SPACE_WORDS)
        grams = gram_hashes(word_hashes(chunk.buf, w.starts, w.ends), 5)
        inside = runs_within(w.first, 5, len(grams))
        doc = np.searchsorted(w.first, np.flatnonzero(inside), side="right") - 1
        own = mix64(grams[inside] + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ordered = np.sort(own)
        again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
        repeating = set(doc[np.isin(own, again)].tolist()) if len(again) else ()
        in_word = SPACE_WORDS[chunk.buf] & ((chunk.buf & 0xC0) != 0x80)
        in_word[chunk.offsets[1:] - 1] = False
        chars = per_document(in_word, chunk.offsets)
        symbols = per_document(_SYMBOL_BYTES[chunk.buf], chunk.offsets)
        for i in range(chunk.rows):
            text = chunk.text(i)
            n = int(w.first[i + 1] - w.first[i])
            repeats = repeat_words(text.split()) if i in repeating else 0
            stay, dup, failed, lost, total = clean_lines(text, rules)
            base_failed = n < 10 or 100 * repeats > 20 * n
            kept = not base_failed and lost <= rules.most_lost * total
            out.append((n, int(chars[i]), int(symbols[i]), dup, repeats, base_failed, kept, failed, b"\n".join(stay)))
    columns = list(zip(*out, strict=True)) if out else [[]] * len(_KINDS)
    arrays = [pa.array(c, k) for c, k in zip(columns, _KINDS.values(), strict=True)]
    return pa.RecordBatch.from_arrays([*arrays[:-1], arrays[-1].view(pa.string())], names=list(_KINDS))


_SYMBOL_BYTES = np.isin(np.arange(256), list(_SYMBOLS))
_KINDS = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(), "n_lines_failed": pa.int64(), "clean_text": pa.binary(),
}
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines_failed long, clean_text string"
)


def cleaned(docs: DataFrame, rules: LineRules = LineRules(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts and verdicts for each document, with the text that stays (``clean_text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = judge(batch.column(1), rules)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.columns], names=["doc_id", *_KINDS])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, SCHEMA)


def quality(docs: DataFrame, rules: LineRules = LineRules(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of counts and verdicts for each document."""
    return cleaned(docs, rules, id_col=id_col, text_col=text_col).drop("clean_text")


def keep_good(docs: DataFrame, rules: LineRules = LineRules(), *, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The documents that pass, with their failing lines removed and ``chars_col``, where there
    is one, counted anew; all other columns are unchanged. No shuffle."""
    at = docs.columns.index(text_col)
    chars = docs.columns.index(chars_col) if chars_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = judge(batch.column(at), rules)
            text, columns = found.column("clean_text"), list(batch.columns)
            columns[at] = text.cast(batch.schema.field(at).type)
            if chars is not None:
                columns[chars] = pc.utf8_length(text).cast(batch.schema.field(chars).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(found.column("kept"))

    return map_arrow(docs, run, docs.schema)


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cleaned(table(spark, sf_dir, "documents"))
    return found.withColumns({"n_clean_chars": F.length("clean_text").cast("long"), "clean_sha256": F.sha2("clean_text", 256)}).drop("clean_text")

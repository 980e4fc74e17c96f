"""Language identification, periodic runs and spelling variants against brute force and held-out rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import op11_language as language
from tidemark.llm import op12_periodic_runs as periodic
from tidemark.llm import op13_spelling as spelling

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, n long, word string, rest long, part int"


def frame(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, lang, 1, "x", 2, 3) for i, t, lang in rows], COLUMNS)


def rows_of(found) -> list[tuple]:
    return sorted((tuple(r) for r in found.collect()), key=str)


# ---- periodic runs


def runs_by_force(w: list, periods: int, least: int) -> list[tuple[int, int, int]]:
    out, n = [], len(w)
    for q in range(1, n // periods + 1):
        at = 0
        while at < n - q:
            to = at
            while to < n - q and w[to] == w[to + q]:
                to += 1
            size = to - at + q
            if to > at and size >= max(least, periods * q):
                own = w[at : at + size]
                if not any(all(own[x] == own[x + p] for x in range(size - p)) for p in range(1, q)):
                    out.append((at, size, q))
            at = to + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def replaced(i: int | None, w: list[str]) -> list[str]:
    n = len(w)
    h = zlib.crc32(str(i).encode())
    if i is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]


def digests_by_force(i, text) -> tuple:
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    w = replaced(i, WORD.findall(text or ""))
    runs = runs_by_force(w, 4, 6)
    gone = {x for s, size, q in runs for x in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (i, len(runs), *best, milli, sha(listed), sha(" ".join(x for k, x in enumerate(w) if k not in gone)), len(w))


def repetitive(dice: random.Random, vocabulary: list[str], most: int = 5) -> list[str]:
    words: list[str] = []
    for _ in range(dice.randint(0, most)):
        unit = [dice.choice(vocabulary) for _ in range(dice.randint(1, 7))]
        words += unit * dice.randint(1, 7) + unit[: dice.randint(0, len(unit))]
    return words


@pytest.mark.parametrize("periods", [2, 3, 4])
def test_runs_equal_brute_force(periods):
    dice = random.Random(periods)
    for _ in range(120):
        docs = [repetitive(dice, list("ab") if dice.random() < 0.5 else list("abcde")) for _ in range(dice.randint(1, 5))]
        first = np.cumsum([0, *map(len, docs)])
        found = periodic.find_runs(np.array([ord(x) for d in docs for x in d], np.int64), first, periods=periods, least=6)
        for d, w in enumerate(docs):
            own = found.doc == d
            assert list(zip(found.start[own], found.length[own], found.period[own], strict=True)) == runs_by_force(w, periods, 6)


def test_run_digests_equal_brute_force(spark):
    dice = random.Random(4)
    words = ["a", "b", "Ö", "ab", "x-y", "far"]
    texts = [dice.choice((" ", "\n", "\t ")).join(repetitive(dice, words)) for _ in range(150)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(None, "a " * 9), (None, None), (5000, None), (5001, ""), (5002, " \n"), (5003, "one"), (7, texts[7])]
    got = rows_of(periodic.run_digests(frame(spark, [(i, t, "x") for i, t in rows]).repartition(3)))
    assert got == sorted((digests_by_force(i, t) for i, t in rows), key=str)


def test_periodic_runs_and_collapse(spark):
    docs = frame(spark, [(1, "so it goes on and on and on and on and on", "x"), (2, "no  runs\nhere", "x"), (3, None, "x"), (None, "é é é é é é é", "x")])
    assert rows_of(periodic.periodic_runs(docs)) == sorted([(1, 3, 9, 2, "on and"), (None, 0, 7, 1, "é")], key=str)
    kept = {r["doc_id"]: r["text"] for r in periodic.collapse(docs).collect()}
    assert kept == {1: "so it goes on and", 2: "no  runs\nhere", 3: None, None: "é"}
    assert periodic.collapse(docs).columns == docs.columns


def test_long_repetitive_texts_end_soon():
    began = time.time()
    for flat in (np.zeros(40_000, np.int64), np.tile(np.arange(3000), 14)):
        assert len(periodic.find_runs(flat, np.array([0, len(flat)])).start) == 1
    assert time.time() - began < 60


# ---- spelling variants


def near(a: str, b: str) -> bool:
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = (a, b) if len(a) > len(b) else (b, a)
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def variants_by_force(rows, mutate, least_length=6, least_n=5, times=5) -> list[tuple]:
    counts: Counter[str] = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            if mutate and i is not None and (h := zlib.crc32(f"{i}:{low}".encode())) % mutate == 0:
                low = low[: h % len(low)] + low[h % len(low) + 1 :]
            counts[low] += 1
    words = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_n}
    around = {w: [x for x in words if near(w, x)] for w in words}
    form = {}
    for w, others in around.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= times * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(around[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=str)


def spelled(dice: random.Random, alphabet: str, count: int, longest: int) -> list[str]:
    stems = ["".join(dice.choice(alphabet) for _ in range(dice.randint(6, longest))) for _ in range(count)]
    out = []
    for stem in stems:
        out += [stem] * dice.choice((5, 30, 160))
        for _ in range(dice.randint(0, 5)):
            at = dice.randrange(len(stem))
            other = dice.choice((stem[:at] + stem[at + 1 :], stem[:at] + dice.choice(alphabet) + stem[at:], stem[:at] + dice.choice(alphabet) + stem[at + 1 :]))
            out += [other] * dice.choice((4, 5, 6, 31))
    dice.shuffle(out)
    return out


@pytest.mark.parametrize(("alphabet", "longest", "limits"), [("ab", 9, {}), ("abcéÿÀ×", 12, {}), ("ab", 9, {"rest_rows": 3, "part_rows": 40}), ("aé", 90, {"window": 4})])
def test_variants_equal_brute_force(spark, alphabet, longest, limits):
    dice = random.Random(len(alphabet) + longest)
    words = [w.upper() if w.isascii() and dice.random() < 0.2 else w for w in spelled(dice, alphabet, 40, longest)]
    rows = [(k % 50, " -1,".join(words[k :: 60])) for k in range(60)] + [(None, " ".join(words[:300])), (None, None), (70, ""), (71, "12 !"), (72, "Kaffee " * 9)]
    docs = frame(spark, [(i, t, "x") for i, t in rows]).repartition(4)
    for mutate in (0, 7):
        assert rows_of(spelling.spelling_variants(docs, mutate=mutate, **limits)) == variants_by_force(rows, mutate)


def test_variants_follow_forms_to_the_last(spark):
    words = ["abcdef"] * 700 + ["abcdeg"] * 100 + ["abcdegg"] * 20 + ["abcdeggg"] * 4 + ["xabcdegg"] * 0
    got = {r["word"]: (r["form"], r["root"]) for r in spelling.spelling_variants(frame(spark, [(1, " ".join(words), "x")]), least_n=4).collect()}
    assert got == {"abcdef": (None, "abcdef"), "abcdeg": ("abcdef", "abcdef"), "abcdegg": ("abcdeg", "abcdef"), "abcdeggg": ("abcdegg", "abcdef")}


def test_wavelet_tree_reports_rectangles():
    dice = np.random.default_rng(1)
    for n in (1, 2, 3, 17, 64, 100):
        values = dice.permutation(n)
        tree = spelling.WaveletTree(values)
        left, low = dice.integers(0, n + 1, 200), dice.integers(0, n + 1, 200)
        right, high = np.minimum(n, left + dice.integers(0, n + 1, 200)), np.minimum(n, low + dice.integers(0, n + 1, 200))
        got = sorted(zip(*(x.tolist() for x in tree.report(left, right, low, high)), strict=True))
        assert got == sorted((q, int(v)) for q in range(200) for v in values[left[q] : right[q]] if low[q] <= v < high[q])


# ---- language


def model_by_force(grams: Counter, order: int, alphabet: int):
    """Probability of the last letter of a gram, by the textbook recursion over counters."""
    levels = {order: grams}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter()
        for g in levels[k + 1]:
            levels[k][g[1:]] += 1

    def probability(g: str) -> float:
        if not g:
            return 1.0 / alphabet
        k = len(g)
        ones, twos = (sum(n == x for n in levels[k].values()) for x in (1, 2))
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        own = {x: n for x, n in levels[k].items() if x[:-1] == g[:-1]}
        if not own:
            return probability(g[1:])
        total = sum(own.values())
        return max(own.get(g, 0) - discount, 0) / total + discount * len(own) / total * probability(g[1:])

    return probability


def as_letters(grams: list[str]) -> np.ndarray:
    return np.array([[0 if c == " " else ord(c) + 1 for c in g] for g in grams], np.uint32)


def test_models_equal_the_recursion():
    dice = random.Random(6)
    stream = "".join(dice.choice("aab c") for _ in range(400))
    grams = Counter(stream[i : i + 3] for i in range(len(stream) - 2))
    model = language.CharModel.of(as_letters(list(grams)), np.array(list(grams.values())), 9)
    by_force = model_by_force(grams, 3, 9)
    asked = ["".join(dice.choice("abcz ") for _ in range(3)) for _ in range(200)]
    assert model.score(as_letters(asked)) == pytest.approx([math.log2(by_force(g)) for g in asked], abs=1e-4)
    for context in ("aa", "zz", " b"):  # all letters together have the whole mass
        seen = sum(by_force(context + c) for c in "abc ")
        assert seen + 5 * by_force(context + "z") == pytest.approx(1)


def test_streams_join_letters_and_slices(monkeypatch):
    text = "Ab,c  ÉÀ9x \n"
    out, first = language.streams([text, "", "12", "z"], 3)
    said = "".join(" " if c == 0 else chr(c - 1) for c in out)
    assert [said[a:b] for a, b in zip(first, first[1:])] == ["  ab c éà x ", "  ", "  ", "  z "]
    whole, _ = language.streams([text * 5], 3)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(language, "SLICE", size)
        parts = [o[2:] for o, _ in language.sliced(text * 5, 3)]
        assert np.concatenate([whole[:2], *parts]).tolist() == whole.tolist()


def test_counts_of_grams(spark):
    rows = [(k, "so it is, so it was " * (k % 4) + "é", "de" if k % 3 else "fr") for k in range(30)]
    got = {(r["lang"], r["gram"]): r["n"] for r in language.gram_counts(frame(spark, rows).repartition(3), 3).collect()}
    want: Counter = Counter()
    for _, text, lang in rows:
        stream = "  " + " ".join(re.findall("[a-zé]+", text)) + " "
        want.update((lang, stream[i : i + 3]) for i in range(len(stream) - 2))
    assert got == dict(want)


def test_held_out_documents(spark, sf):
    found = language.op11_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = found[found.held_out]
    assert len(held) > 20 and (held.lang_pred == held.lang).mean() >= 0.97
    assert found.score.between(0, 1).all() and found.rejected.mean() < 0.1


def test_languages_of_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    learned = language.train(docs)
    rows = [(None, "le même pareil", None), (1, None, "en"), (2, "", "en"), (3, "12 + 34", None), (4, "ქართული ენა", None), (5, "the end of it, and that is the other thing", None), (5, "the end of it, and that is the other thing", None)]
    got = language.identify(frame(spark, rows), learned).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert [by_id[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and [by_id[i]["score"] for i in (1, 2, 3)] == [0.0] * 3
    assert by_id[None]["lang_pred"] in learned.langs and by_id[5]["lang_pred"] == "en"
    assert by_id[4]["rejected"] and by_id[4]["lang_pred"] in learned.langs and not by_id[5]["rejected"]
    long = "the end of it, and that is the other thing " * 60_000
    assert language.identify(frame(spark, [(9, long, None)]), learned).first()["lang_pred"] == "en"


def test_fewer_grams_still_make_models(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    small = language.train(docs, most_grams=3000)
    assert sum(len(m.grams[-1][0]) for m in small.models) <= 3000
    found = language.identify(docs, small).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.9


def test_rare_grams_count_too(spark):
    """The bound says what is broadcast; the verdicts, and the bits of each text, stay those of all n-grams."""
    dice = random.Random(11)
    said = {lang: ["".join(dice.choice(letters) for _ in range(dice.randint(2, 7))) for _ in range(400)] for lang, letters in (("a", "abcdeé"), ("b", "bcdefü"), ("c", "cdefgß"))}
    rows = [(k, " ".join(dice.choices(said["abc"[k % 3]], k=dice.randint(1, 30))), "abc"[k % 3] if k % 7 else None) for k in range(600)]
    rows += [(600, None, "a"), (601, "", None), (602, "12", "b"), (None, "zoö abcd", None), (5, "abc zzzzzzzz", "a"), (5, "abc zzzzzzzz", "a"), (603, "ქართული", None)]
    docs = frame(spark, rows).repartition(5)
    whole = language.train(docs)
    assert whole.whole is None
    want = sorted((tuple(r) for r in language.identify(docs, whole).collect()), key=repr)
    for most in (0, 300):
        learned = language.train(docs, most_grams=most)
        assert learned.langs == whole.langs and sum(len(m.grams[-1][0]) for m in learned.models) <= most
        got = sorted((tuple(r) for r in language.identify(docs, learned).collect()), key=repr)
        assert [(g[0], g[1], g[4]) for g in got] == [(w[0], w[1], w[4]) for w in want]
        assert [g[2] for g in got] == pytest.approx([w[2] for w in want])
        assert [g[3] or 0 for g in got] == pytest.approx([w[3] or 0 for w in want], abs=1e-4)


# ---- tables without rows


def test_empty_tables(spark):
    none = frame(spark, [(1, "x", "en")]).where("doc_id = 0")
    assert periodic.run_digests(none).count() == 0
    assert periodic.periodic_runs(none).count() == 0
    assert spelling.spelling_variants(none).count() == 0
    learned = language.train(none)
    assert learned.langs == []
    assert language.identify(none, learned).count() == 0
    assert [tuple(r)[:3] for r in language.identify(frame(spark, [(1, "abc", "en")]), learned).collect()] == [(1, "und", 0.0)]

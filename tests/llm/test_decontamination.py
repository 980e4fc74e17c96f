"""Suffix array search against brute force: few different words, repeated items, very repetitive texts."""

from __future__ import annotations

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import op04_decontaminate as d
from tidemark.llm.textbytes import chunks


def one_chunk(texts):
    (chunk,) = chunks(pa.array(texts), 1 << 30)
    return chunk


def by_force(docs, items, window):
    hit, named, longest, places = [], [], [], set()
    for k, x in enumerate(docs):
        own_hit, own_items, best = set(), set(), 0
        for i, y in enumerate(items):
            for p in range(len(x)):
                for q in range(len(y)):
                    n = 0
                    while p + n < len(x) and q + n < len(y) and x[p + n] == y[q + n]:
                        n += 1
                    best = max(best, min(n, window) if n else 0)
                    if n >= window or (y and q == 0 and n == len(y)):
                        own_items.add(i)
                        own_hit.update(range(p, p + n))
                        if not (p and q and x[p - 1] == y[q - 1]):
                            places.add((k, i, p, n))
                            best = max(best, n)
        hit.append(own_hit)
        named.append(sorted(own_items))
        longest.append(best)
    return hit, named, longest, places


@pytest.mark.parametrize("alphabet", ["a", "ab", "abcd"])
def test_few_different_words(alphabet):
    dice = random.Random(len(alphabet))
    for _ in range(60):
        words = lambda most: [dice.choice(alphabet) for _ in range(dice.randint(0, most))]
        docs, items = [words(14) for _ in range(dice.randint(1, 4))], [words(9) for _ in range(dice.randint(1, 4))]
        found = d.find(one_chunk([" ".join(x) for x in docs]), d.Items.of(list(range(len(items))), [" ".join(x) for x in items]), 3)
        hit, named, longest, places = by_force(docs, items, 3)
        assert [set(np.flatnonzero(found.hit[a:b])) for a, b in zip(found.first, found.first[1:])] == hit
        assert found.items == named and found.longest.tolist() == longest
        assert {tuple(r) for r in found.locations.tolist()} == places


def test_one_word_over_and_over_ends_soon():
    began = time.time()
    for n, k in ((200_000, 1000), (100_000, 5000)):
        found = d.find(one_chunk(["no " * n]), d.Items.of([1], ["no " * k]), 10)
        assert found.hit.all() and found.longest.tolist() == [k] and found.items == [[0]]
    cycle = " ".join(f"w{i % 700}" for i in range(100_000))
    found = d.find(one_chunk([cycle]), d.Items.of([1, 2], [cycle[:20_000], "w5 w6 w7"]), 10)
    assert found.hit.all() and found.items == [[0, 1]]
    assert time.time() - began < 60


def test_repeated_and_missing_items(spark):
    passage, other = " ".join(f"p{i}" for i in range(12)), " ".join(f"q{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"x {passage} y", 5), (2, other, 6), (2, other, 6), (None, passage, 7), (3, None, 8), (4, "", 9)], "doc_id long, text string, n_hit int")
    items = spark.createDataFrame([(1, passage, "a"), (1, passage, "b"), (1, other, "c"), (None, passage, "d"), (9, None, "e"), (None, None, "f")], "item_id long, text string, hits string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = sorted([(1, 14, 12, 2, sha(",1"), True), (2, 12, 12, 1, sha("1"), True), (2, 12, 12, 1, sha("1"), True), (None, 12, 12, 2, sha(",1"), True), (3, 0, 0, 0, sha(""), False), (4, 0, 0, 0, sha(""), False)], key=str)
    for block in (2 << 20, 20):
        got = d.contamination(docs, items, block_bytes=block).drop("longest_match")
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
        assert {r["doc_id"] for r in d.keep_clean(docs, items, block_bytes=block).collect()} == {3, 4}
        assert {tuple(r) for r in d.locations(docs, items, block_bytes=block).collect()} == {(1, "1", 1, 12), (1, "", 1, 12), (2, "1", 0, 12), (None, "1", 0, 12), (None, "", 0, 12)}
    assert d.keep_clean(docs, items.limit(0)).columns == docs.columns and d.keep_clean(docs, items.limit(0)).count() == 6

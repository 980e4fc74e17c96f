"""Odd tables: no rows, ids that are null or repeated, columns with the names that operators use themselves."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import op03_substring, op05_quality, op08_simhash, op09_packing

CLASHING = "doc_id long, text string, fp long, key long, n long, component_id long, fingerprint string, node long, part int, piece int, place long, same long"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, 3, 4, "x", 5, 6, 7, 8, 9) for i, t in rows], CLASHING)


def print_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_of_odd_rows(spark):
    rows = [(None, "a b c d"), (7, "a b c d"), (3, "A B c d"), (3, "A B c d"), (9, None), (8, ""), (None, " "), (None, "one of a kind here"), (5, "another of its kind there"), (5, "wholly unlike text in this row")]
    rows += [(100 + i, "copies of one text") for i in range(300)]
    want = Counter()
    prints = [print_of(t) for _, t in rows]
    for (i, _), p in zip(rows, prints, strict=True):
        near, grown = {p}, True
        while grown:
            more = {q for q in prints for x in near if (q ^ x).bit_count() <= 2}
            grown, near = more != near, more
        ids = [j for (j, _), q in zip(rows, prints, strict=True) if q in near and j is not None]
        want[i, f"{p:016x}", min(ids, default=None)] += 1
    got = op08_simhash.components(clashing(spark, rows).repartition(4))
    assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got.collect()) == want


def test_tables_without_rows(spark):
    none = clashing(spark, [(1, "x")]).where("doc_id = 0")
    assert op03_substring.deduplicated(none).count() == 0
    assert op03_substring.substring_dedup(none).count() == 0
    assert op05_quality.cleaned(none).count() == 0
    assert op05_quality.keep_good(none).count() == 0
    assert op08_simhash.components(none).count() == 0
    assert op08_simhash.keep_one(none).count() == 0
    assert op09_packing.pack(none).count() == 0


@pytest.mark.parametrize("length", [2048, 64])
def test_packing_wastes_little(spark, sf, length):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = op09_packing.pack(docs.unionByName(docs), length=length).agg(F.countDistinct("sequence_id").alias("n"), F.sum("length").alias("tokens")).first()
    assert found["n"] <= math.ceil(1.01 * found["tokens"] / length) + 1


def test_last_stage_takes_odd_rows(spark, sf):
    rows = [(None, "no id", "en", "s", 5), (1, None, None, None, None), (2, "", "de", "s", 0), (3, "twice", "fr", "s", 5), (3, "twice", "fr", "s", 5), (4, "word " * 30_000, "en", "s", 150_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    name, stage = corpus_pipeline.STAGES[-1]
    found = stage(spark, docs, sf).collect()
    pieces = Counter(r["doc_id"] for r in found)
    assert name == "best_fit_packing" and pieces[None] == pieces[1] == pieces[2] == 1 and pieces[3] == 2 and pieces[4] == math.ceil(sum(r["length"] for r in found if r["doc_id"] == 4) / 2048)
    filled: dict[int, list[tuple[int, int]]] = {}
    for r in found:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in filled.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048

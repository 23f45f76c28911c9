"""Phrase collocations against brute force, and on awkward rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("tessera.llm")

from pyspark.sql import functions as F

from tessera.llm import phrases

DDL = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_force(rows, least, top):
    n, f = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        n[lang] += 0
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[ \t]", piece) if x]
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    found = [(lang, g, a) for (lang, g), a in f.items() if len(g) > 1 and a >= least]
    covered = Counter()
    for lang, g, a in found:
        for k in range(2, len(g)):
            for i in range(len(g) - k + 1):
                covered[lang, g[i : i + k]] = max(covered[lang, g[i : i + k]], a)
    out = {}
    for lang, g, a in found:
        if covered[lang, g] < a:
            cuts = [(1000 * a * n[lang] // (f[lang, g[:k]] * f[lang, g[k:]]), k) for k in range(1, len(g))]
            s, k = min(cuts)
            out.setdefault(lang, []).append((-s, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted((lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, x in out.items() for i, (s, a, p, l, r) in enumerate(sorted(x)[:top], 1))


def corpus():
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(9)] + ["Ünï", "é\xa0b", "W1", "w x"]
    texts = ["".join(r.choice(vocabulary) + r.choice([" ", " ", " ", "\t", ", ", ".\n", "  "]) for _ in range(r.randint(0, 80))) for _ in range(40)]
    rows = [(t, r.choice(["en", "de", None])) for t in texts]
    return [*rows, (None, "en"), ("", None), ("...", "fr"), *[("Hot Spot here again and again", "en")] * 30, ("go " * 60, "de"), ("x", "")]


@pytest.mark.parametrize("crowd_size", [phrases.CROWD, 7])
def test_collocations_are_brute_force(spark, crowd_size):
    rows = corpus()
    got = phrases.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(3), least=4, top=60, crowd_size=crowd_size)
    assert sorted(map(tuple, got.collect())) == by_force(rows, 4, 60)


def test_counts_pass_64_bits(spark):
    n = 3_000_000_000
    row = spark.sql(f"SELECT (CAST({n}L AS DECIMAL(19,0)) * CAST({n * 900}L AS DECIMAL(19,0)) * CAST(1000 AS DECIMAL(4,0))) div (CAST({n}L AS DECIMAL(19,0)) * CAST(7L AS DECIMAL(19,0))) s").first()
    assert row.s == 1000 * n * (n * 900) // (n * 7) and 1000 * n * n * 900 > 2**63


def test_each_phrase_has_one_pivot():
    r = np.random.default_rng(1)
    for _ in range(20):
        x = r.integers(-1, 5, 40).astype(np.int32)
        want = Counter(tuple(x[i : i + k].tolist()) for k in range(2, 6) for i in range(40 - k + 1) if (x[i : i + k] >= 0).all())
        got = Counter()
        at, frags = phrases.fragments(x)
        assert (frags[:, 4] == x[at]).all()
        for pivot in set(x.tolist()):
            own = frags[frags[:, 4] == pivot].astype(np.int64)
            for rows, counts in phrases.mine(own, np.ones(len(own), np.int32), 1):
                for g, c in zip(rows.tolist(), counts.tolist()):
                    assert min(g) == pivot and tuple(g) not in got
                    got[tuple(g)] = c
        assert got == want


def test_packed_fragments_come_back():
    rows = [[-1, -1, 2, 5, 1, 1, -1, -1, -1], [0, 3, 3, 3, 0, -1, -1, -1, -1]]
    frags = np.array([*rows, rows[0]], np.int32)
    hashes, weights = np.array([10, 11, -12, 13, 14, 2**62]), np.array([3, 1, 4], np.int32)
    import zstandard

    want = np.where(frags >= 0, hashes[frags], 0)
    for common in ([], [-12], [10, 13, 500], [-12, 10, 11, 13, 14, 2**62]):
        common = np.array(common, np.int64)
        h, f, w = phrases._unpack(phrases._pack(frags, weights, hashes, common, zstandard.ZstdCompressor()), common, zstandard.ZstdDecompressor())
        got = np.where(f >= 0, h[f], 0)
        assert sorted(zip(w.tolist(), got.tolist())) == [(1, want[1].tolist()), (7, want[0].tolist())]


def test_awkward_rows(spark):
    none = spark.createDataFrame([], DDL)
    assert phrases.collocations(none).count() == 0
    rows = [(None, "a b " * 3000, "en", None, None)] * 2 + [(1, None, None, None, None), (2, "", "en", None, None)]
    docs = spark.createDataFrame(rows, DDL)
    for c in ("words", "word", "n", "a", "rank", "total", "bucket", "hash", "phrase"):
        docs = docs.withColumn(c, F.lit("x"))
    got = {r.phrase: r for r in phrases.collocations(docs).collect()}
    assert got["a b a b a"].a == 2 * 2998 and got["a b"].n == 12000 and "a b" in got

"""Spelling variants against brute force, and on awkward rows."""

import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("tessera.llm")

from pyspark.sql import functions as F

from tessera.llm import variants

DDL = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def by_force(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(x, key=lambda v: (-n[v], v)) for w, x in near.items() if x}
    form = {w: v for w, v in best.items() if n[v] >= 10 * n[w]}
    root = lambda w: root(form[w]) if w in form else w
    return sorted(((w, form.get(w), root(w), k, len(near[w]), n.get(form.get(w))) for w, k in n.items()), key=str)


def spoiled(r, w):
    at, c = r.randrange(len(w)), r.choice("abcéÿ×")
    return r.choice([w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]])


def corpus():
    r = random.Random(11)
    texts, base = [], ["".join(r.choice(letters) for _ in range(r.randint(7, 12))) for letters in ("ab", "abcé", "aÀàb", "xyz÷") for _ in range(6)]
    for w in base:  # chains of words that come ever less often
        for times in (300, 24, 2):
            texts.append(f"{w} 1{w.upper() if w.isascii() else w}, " * (times // 2))
            w = spoiled(r, w)
        texts += [f"{spoiled(r, w)} {spoiled(r, w)} " * 2 for _ in range(4)]
    texts += [" ".join("".join(r.choice("ab") for _ in range(7)) for _ in range(600)), "Straße straše 中文abcdefg中abcdefg "]
    return list(enumerate(texts))


def test_variants_are_brute_force(spark):
    rows = [*corpus(), (None, "nullidsword nullidsword"), (3, None), (4, ""), (5, "y" * 3000 + " " + "y" * 3000), (6, "y" * 2999 + " " + "y" * 2999)]
    got = variants.grouped(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sorted(map(tuple, got.collect()), key=str) == by_force(rows)


def test_words_with_one_edit_share_a_key():
    r = random.Random(2)
    for _ in range(300):
        letters = r.choice(["ab", "aab", "abcdefgh"])
        words = [w := "".join(r.choice(letters) for _ in range(r.randint(7, 13))), spoiled(r, w)]
        words = [w.encode("latin-1") for w in words if len(w) >= 7]
        counts = {}
        for a in "abcdefghéÿ×":
            for b in "abcdefghéÿ×":
                counts[(a + b).encode("latin-1")] = r.randint(1, 4)
        if len(words) == 2:
            assert set(variants.keys_of(words[0], counts)) & set(variants.keys_of(words[1], counts))


def test_awkward_rows(spark):
    none = spark.createDataFrame([], DDL)
    assert variants.grouped(none).count() == 0 and variants.grouped(none).columns == ["word", "form", "root", "n", "n_near", "form_n"]
    docs = spark.createDataFrame([(1, "lonelyword", "en", "s", 1)] * 2 + [(None, None, None, None, None)], DDL)
    for c in ("word", "n", "key", "root", "id", "best"):
        docs = docs.withColumn(c, F.lit("x"))
    assert [tuple(r) for r in variants.grouped(docs).collect()] == [("lonelyword", None, "lonelyword", 2, 0, None)]

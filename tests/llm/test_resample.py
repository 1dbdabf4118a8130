import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tidemark.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, orders):
    w = WORD.findall((text or "").translate(UPPER))
    return len(w), [" ".join(w[k : k + n]) for n in range(1, orders + 1) for k in range(len(w) - n + 1)]


def brute(docs, items, orders=1, buckets=10_000, share=10, min_words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    given = [(i, *features(t, orders)) for i, t in docs]
    s, t = Counter(bucket(f) for _, _, x in given for f in x), Counter(bucket(f) for x in items for f in features(x, orders)[1])
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda f: math.floor(1000 * math.log((t[bucket(f)] + 1) * (n_s + buckets) / ((s[bucket(f)] + 1) * (n_t + buckets))))
    rows = []
    for i, n_words, x in given:
        weight = sum(map(gain, x)) // len(x) if x else 0
        h = None if i is None else int(hashlib.sha256(f"2024:{i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(x), weight, None if h is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n_words])
    able = sorted((r for r in rows if r[0] is not None and r[5] >= min_words), key=lambda r: (-r[3], r[0], r[1]))
    for k, r in enumerate(able[: share * len(able) // 100]):
        r[4] = k + 1
    return [tuple(r[:5]) for r in rows]


def check(spark, docs, items, **how):
    got = resample.draw(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(x,) for x in items], "text string"), **how)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, items, **how), key=key)


def some_docs(n, seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)] + ["Élan", "日本", "x" * 300]
    return [(3 * k, "; ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 19, 20, 21, 60, 200])))) for k in range(n)]


def test_draws_against_counting(spark):
    docs = some_docs(300, 1)
    check(spark, docs, [t for _, t in some_docs(20, 2)])
    check(spark, docs, [t for _, t in docs[:5]], share=37, buckets=50)


def test_runs_of_several_words(spark):
    check(spark, some_docs(80, 3), [t for _, t in some_docs(10, 4)], orders=3, buckets=97, min_words=1)


def test_defined_cases(spark, odd, empty):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    key = lambda r: tuple(map(repr, r))
    for items in (["one a word43 and41", None, ""], []):
        target = spark.createDataFrame([(x, 1) for x in items], "text string, n_words int")
        got = resample.draw(odd, target, min_words=1, share=50).collect()
        assert sorted(map(tuple, got), key=key) == sorted(brute(docs, items, min_words=1, share=50), key=key)
    assert resample.draw(empty, odd.select("text")).count() == 0


def test_blocks_hold_all_and_cut_nothing(spark, monkeypatch):
    """Blocks of a few rows, and ties of equal texts, give what one block gives."""
    docs = some_docs(60, 5) + [(1000 + k, "tied " * 30) for k in range(20)]
    monkeypatch.setattr(resample, "BLOCK_BYTES", 500)
    check(spark, docs, [t for _, t in docs[::7]], share=50)


def test_packed_widths():
    for most in (0, 255, 256, 65_535, 65_536, 2**32 - 1):
        x = np.array([0, most, 1])
        assert (resample._unpacked(resample._packed(x)) == x).all()
    assert len(resample._unpacked(resample._packed(np.zeros(0, np.int64)))) == 0

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import spelling

RUN = re.compile(r"[A-Za-zÀ-ÿ]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs, every=97, min_points=5, min_count=3):
    n = Counter()
    for i, text in docs:
        for run in RUN.findall(text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= min_points and k >= min_count}
    about = {w: [x for x in n if near(w, x)] for w in n}
    best = {w: min(x, key=lambda y: (-n[y], y)) if x else None for w, x in about.items()}
    form = {w: b if b and n[b] >= 2 * n[w] else None for w, b in best.items()}
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(about[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def check(spark, docs, **how):
    got = spelling.variants(spark.createDataFrame(docs, "doc_id long, text string"), **how)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted(map(tuple, got.collect()), key=repr)
    assert got == brute(docs, **how)
    return got


@pytest.mark.parametrize("every", [97, 2])
def test_variants_against_all_pairs(spark, every):
    rng = random.Random(every)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(4, 9))) for _ in range(60)]

    def edited(w):
        k = rng.randrange(len(w) + 1)
        return rng.choice([w, w, w, w[:k] + rng.choice("aéÿ") + w[k:], w[:k] + w[k + 1 :], w[:k] + rng.choice("abÀ") + w[k + 1 :]])

    docs = [(k, " ".join(edited(rng.choice(base)).upper() if k % 5 == 0 else edited(rng.choice(base)) for _ in range(120)) + ".") for k in range(60)]
    got = check(spark, docs, every=every)
    assert len(got) > 150 and sum(r[1] is not None for r in got) > 20 and sum(r[4] > 1 for r in got) > 50


def test_chains_of_forms(spark):
    """Each word is near to the next alone, which is there twice as often: the last is the root of all."""
    words = ["aaaaaaaa"]
    for k in range(7):
        words.append(words[-1][:k] + "z" + words[-1][k + 1 :])
    docs = [(k, " ".join([w] * (3 * 2**k))) for k, w in enumerate(words)]
    got = check(spark, docs, every=10**9)
    assert {r[2] for r in got} == {words[-1]} and got[0][1]


def test_edits_at_every_place_of_words_of_all_lengths(spark):
    """One edit at each place, and halves that are equal, so that pairs share several entries."""
    docs = []
    for n, w in ((5, "abcde"), (6, "aaaaaa"), (7, "abababa"), (8, "abcdefgh"), (9, "zzzyyyxxx"), (17, "abcabcabcabcabcab"), (40, "longword" * 5)):
        all_ = {w} | {w[:k] + w[k + 1 :] for k in range(n)} | {w[:k] + "q" + w[k:] for k in range(n + 1)} | {w[:k] + "q" + w[k + 1 :] for k in range(n)}
        docs += [(None, f"{x} {x} {x}") for x in sorted(all_)]
    check(spark, docs)


def test_ties_go_to_the_smallest(spark):
    check(spark, [(None, "abcde " * 3 + "abcdf " * 6 + "abcdg " * 6 + "abcdé " * 6 + "abcd " * 9)])


def test_defined_cases(spark, odd, empty):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    got = spelling.variants(odd, min_count=1, every=3).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, min_count=1, every=3) and got
    assert spelling.variants(empty).count() == 0
    assert spelling.variants(odd.where("text IS NULL OR text = ''")).count() == 0


def test_checksums_of_spans():
    rng = random.Random(2)
    text = bytes(rng.randrange(256) for _ in range(3000))
    spans = [(a, a + n) for a in range(0, 2000, 37) for n in (0, 1, 5, 63, 64, 65, 300)]
    starts, ends = (np.array(x) for x in zip(*spans, strict=True))
    before = np.array([zlib.crc32(b"%d:" % k) for k in range(len(spans))])
    got = spelling.crc32_after(before, np.frombuffer(text, np.uint8), starts, ends)
    assert got.tolist() == [zlib.crc32(b"%d:" % k + text[a:b]) for k, (a, b) in enumerate(spans)]

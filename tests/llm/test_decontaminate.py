import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NONE = hashlib.sha256(b"").hexdigest()


def words(text):
    return WORD.findall((text or "").translate(UPPER))


def brute(docs, items):
    """Rows of the query and their spans, window by window."""
    windows = []
    for item, text in items:
        w = words(text)
        windows += [("" if item is None else str(item), w[k : k + 10]) for k in range(max(1, len(w) - 9))] if w else []
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item, x in windows:
            for k in range(len(w) - len(x) + 1):
                if w[k : k + len(x)] == x:
                    hit |= set(range(k, k + len(x)))
                    ids.add(item)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)))
    return out


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def check(spark, docs, items):
    got = decontaminate.digest(*frames(spark, docs, items))
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, items), key=key)


def test_windows_of_all_lengths(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(12)] + ["Über", "日本", "O2"]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, some(n)) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 14, 30, 40, 40])]
    docs = [(k, some(rng.randrange(60))) for k in range(40)]
    for k in range(60):  # passages of items, longer and shorter than a window
        w = rng.choice(items)[1].split()
        a = rng.randrange(len(w))
        docs.append((100 + k, " ".join([some(5), "; ".join(w[a : a + rng.randrange(1, 25)]).upper(), some(5)])))
    check(spark, docs, items[3:])
    check(spark, docs, items[9:])
    check(spark, docs, items)


def test_passages_that_repeat_and_overlap(spark):
    line = " ".join(f"x{k % 3}" for k in range(40))
    other = " ".join(f"y{k}" for k in range(30))
    docs = [(k, f"{line} end {other}" if k % 3 else other) for k in range(50)] + [(90, line * 2), (91, f"{other} {other}"), (92, " ".join(other.split()[5:17])), (93, " ".join(other.split()[5:14]))]
    check(spark, docs, [(k, f"{other} {k}") for k in range(40)] + [(50, line), (51, other), (52, "x0 x1")])


def test_defined_cases(spark, odd, empty):
    long = " ".join(f"word{k % 977} and{k}" for k in range(500, 540))
    items = [(1, None), (2, ""), (3, " ,;\n"), (None, "a row without an id but with some words in it"), (5, "one"), (5, long), (6, long), (7, "x" * 20_000), (None, "12 34")]
    given = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_words int")
    got = sorted(map(repr, map(tuple, decontaminate.digest(odd, given).collect())))
    assert got == sorted(map(repr, brute([(r["doc_id"], r["text"]) for r in odd.collect()], items)))
    assert decontaminate.digest(empty, given).count() == 0
    clean = decontaminate.digest(odd, given.where("1 = 0")).collect()
    assert len(clean) == odd.count() and all((r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (0, 0, NONE, False) for r in clean)


def test_spans_and_items_as_they_are(spark):
    passage = " ".join(f"p{k}" for k in range(12))
    docs = [(1, f"one two {passage} three {passage}"), (2, "nothing of it"), (3, passage.replace("p6", "q"))]
    got = {r["doc_id"]: r for r in decontaminate.contaminated(*frames(spark, docs, [(10, passage), (9, f"{passage} more")])).collect()}
    assert [tuple(x) for x in got[1]["spans"]] == [(2, 14), (15, 27)] and got[1]["items"] == ["10", "9"] and got[1]["n_hit"] == 24
    assert all((got[k]["spans"], got[k]["items"], got[k]["n_hit"]) == ([], [], 0) for k in (2, 3))


def test_small_bitmaps_let_more_through_and_change_nothing(spark, monkeypatch):
    rng = random.Random(9)
    some = lambda n: " ".join(f"w{rng.randrange(30)}" for _ in range(n))
    items = [(k, some(60)) for k in range(60)]
    docs = [(k, f"{some(30)} {' '.join(items[k][1].split()[7 : 7 + k])} {some(30)}") for k in range(30)]
    monkeypatch.setattr(decontaminate, "BITMAP_BITS", (7, 7))
    check(spark, docs, items)


@pytest.mark.parametrize("words_left", [9, 10, 11, 37])
def test_every_shared_window_has_its_fingerprint_in_both(words_left):
    """The guarantee of winnowing: whatever surrounds a shared span, its windows have the same fingerprints at the same places of the span."""
    rng = np.random.default_rng(words_left)
    span = " ".join(f"s{x}" for x in rng.integers(0, 4, words_left))
    prints = []
    for before, after in (("", ""), ("a b c ", " d e"), ("s1 s2 s1 ", " s0 s3 s3 s1")):
        text = f"{before}{span}{after}".encode()
        w = decontaminate._Words(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        place, least = w.fingerprints(10)
        a = len(before.split())
        prints.append([(int(p) - a, int(h)) for p, h in zip(place[a : a + words_left - 9], least[a : a + words_left - 9], strict=True)])
    assert prints[0] == prints[1] == prints[2] and len(prints[0]) == max(0, words_left - 9)

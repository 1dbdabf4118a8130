"""Edit distances, longest blocks, warping paths and word repair, against plain forms of them."""

import random
import re
import resource
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import alignment, arrays, edit
from tidemark.functions.blocks import SuffixAutomaton
from tidemark.operators import commit, timing


def table_distance(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def changed(text, n, letters, rng):
    out = list(text)
    for _ in range(n):
        at = rng.randrange(len(out) + 1)
        kind = rng.randrange(3)
        out[at : at + (kind > 0)] = [rng.choice(letters)] if kind < 2 else []
    return "".join(out)


@pytest.mark.parametrize("band", [1, 2, 5, 64])
def test_distances_at_any_distance(monkeypatch, band):
    monkeypatch.setattr(edit, "BAND", band)
    rng = random.Random(band)
    for _ in range(500):
        letters = rng.choice(["ab", "abcdefgh", "aé日😀"])
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        b = changed(a, rng.randrange(12), letters, rng) if rng.random() < 0.7 else "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        assert edit.distance(a, b) == table_distance(a, b), (a, b)
        assert edit.distance(a.split("a"), b.split("a")) == table_distance(a.split("a"), b.split("a"))


def test_distances_of_long_texts():
    rng = random.Random(1)
    a = "".join(rng.choice("abcdefgh ") for _ in range(40_000))
    assert edit.distance(a, a[:20_000] + "XX" + a[20_001:] + "Y") == 3
    assert edit.distance(a, "z" * 40_001) == 40_001 and edit.distance(a, "") == 40_000


@pytest.mark.parametrize("near", [0, 1, 8, 100])
def test_distances_of_many_pairs(monkeypatch, near):
    """Along diagonals up to any number of edits, and by bit vectors beyond; a few pairs at a time."""
    monkeypatch.setattr(edit, "NEAR", near)
    monkeypatch.setattr(edit, "PAIRS", 37)
    rng = random.Random(near)
    pairs = [("", ""), ("", "abc"), ("abc", "")]
    for _ in range(300):
        letters = rng.choice(["a", "ab", "abcdefgh", "aé日😀"])
        a = "".join(rng.choice(letters) for _ in range(rng.randrange(60)))
        pairs.append((a, changed(a, rng.randrange(12), letters, rng) if rng.random() < 0.7 else "".join(rng.choice(letters) for _ in range(rng.randrange(60)))))
    assert edit.distances(*map(list, zip(*pairs))) == [table_distance(a, b) for a, b in pairs]
    assert edit.distances([a.split("a") for a, _ in pairs], [b.split("a") for _, b in pairs]) == [table_distance(a.split("a"), b.split("a")) for a, b in pairs]
    assert edit.distances([], []) == []


def test_pairs_of_few_edits_take_no_tables(monkeypatch):
    """Texts that differ little are told from their diagonals alone, however long they are, among others that are short."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (10, 3000, 100_000, 5000)] + ["ab" * 20_000]
    monkeypatch.setattr(edit, "distance", lambda *_: 1 / 0)
    assert edit.distances(texts, [t[2:] + "XYZ" for t in texts]) == [5, 5, 5, 5, 3]
    assert edit.distances(texts, texts) == [0] * 5


def test_edits_as_a_column(spark):
    rows = spark.createDataFrame([("kitten", "sitting"), ("", "x"), (None, "x"), ("日本", "日😀本")], "a string, b string")
    assert [r[0] for r in rows.select(edit.edits("a", "b")).collect()] == [3, 1, None, 1]
    assert [r[0] for r in rows.select(edit.edits(F.split("a", ""), F.split("b", ""))).collect()] == [3, 1, None, 1]


def test_longest_block_of_a_growing_text():
    rng = random.Random(2)
    for _ in range(500):
        letters = rng.choice(["ab", "abcd", "aé😀"])
        automaton, text = SuffixAutomaton(), ""
        for _ in range(3):
            more = "".join(rng.choice(letters) for _ in range(rng.randrange(12)))
            automaton.extend(more)
            text += more
            other = "".join(rng.choice(letters + "z") for _ in range(rng.randrange(20)))
            m = SequenceMatcher(None, text, other, autojunk=False).find_longest_match()
            got = automaton.longest_in(other)
            assert got == (m.a, m.b, m.size) or m.size == got[2] == 0
    assert len(SuffixAutomaton("ab" * 50_000).link) <= 2 * 100_000


def test_committed_text_of_any_length(spark):
    """What was committed isn't committed again, however long it is."""
    for n in (150, 400, 5000):
        rng = random.Random(n)
        said = "".join(rng.choice("abcdef ") for _ in range(n))
        assert commit.after_longest_match(said, said[5:] + "more") == "more"
        rows = spark.createDataFrame([("s", 0, said, True), ("s", 1, "X" + said[1:] + "more", True), ("s", 2, "Y" + said[1:] + "more and more", True)], "s string, k int, text string, is_last boolean")
        assert [r["delta"] for r in commit.local_agreement(rows, "s", "k", "text", "is_last").orderBy("k").collect()] == [said, "more", " and more"]


def test_paths_are_those_of_the_full_table():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, m = rng.integers(1, 25, 2)
        cost = rng.integers(0, 4, (n, m)).astype(float) if rng.random() < 0.5 else rng.random((n, m))
        full, little = arrays.dtw_path(cost), alignment.path(lambda i, j, c=cost: c[i, j], n, m)
        assert (full[0] == little[0]).all() and (full[1] == little[1]).all()


def test_long_series_in_little_memory():
    """20,000 by 20,000 cells would be 3.2 GB of costs."""
    rng = np.random.default_rng(3)
    x = np.cumsum(rng.normal(size=20_000))
    shift = np.arange(20_000) + 5 * np.sin(np.arange(20_000) / 300)
    y = np.interp(shift, np.arange(20_000), x)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    i, j = alignment.path(alignment.between(x, y), 20_000, 20_000)
    assert (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 400
    assert (i[0], j[0], i[-1], j[-1]) == (0, 0, 19_999, 19_999) and np.abs(i - shift[j]).max() < 60


def test_alignment_as_operators(spark):
    rows = spark.createDataFrame([("a", [1.0, 2.0, 3.0], [1.0, 1.0, 2.0, 3.5]), ("b", [], [1.0]), ("c", None, [1.0])], "k string, x array<double>, y array<double>")
    got = [(r["k"], r["step"], r["i"], r["j"], r["cost"]) for r in alignment.warped(rows, "k", "x", "y").orderBy("step").collect()]
    assert got == [("a", 0, 0, 0, 0.0), ("a", 1, 0, 1, 0.0), ("a", 2, 1, 2, 0.0), ("a", 3, 2, 3, 0.5)]
    vectors = spark.createDataFrame([("a", [[0.0, 0.0], [3.0, 4.0]], [[0.0, 0.0], [3.0, 3.0]])], "k string, x array<array<double>>, y array<array<double>>")
    assert [r["cost"] for r in alignment.warped(vectors, "k", "x", "y").orderBy("step").collect()] == [0.0, 1.0]
    a = np.full((2, 4, 40), -5.0)
    for t in range(4):
        a[:, t, t * 10 : t * 10 + 10] = 5.0
    heads = spark.createDataFrame([("f", a.tolist(), [2, 2], [0.5, 0.7, 1.0, 0.8]), ("g", None, [1], None)], "k string, a array<array<array<double>>>, w array<int>, p array<double>")
    got = [(r["word"], r["start"], r["end"], r["probability"]) for r in alignment.aligned(heads, "k", "a", "w", "p").orderBy("word").collect()]
    assert [tuple(map(float, x)) for x in got] == [(float(k), *map(float, x)) for k, x in enumerate(alignment.align_tokens(a, [2, 2], [0.5, 0.7, 1.0, 0.8]))]


def fold(rows):
    """A file's words segment after segment, by the functions for one segment."""
    rows = sorted(rows, key=lambda r: (r[0], r[3]))
    words = [timing.Word(t, s, e) for *_, t, s, e in rows]
    median, limit = timing.duration_limits(words)
    shortened, out, last, at = timing.shorten(words, limit), [], 0.0, 0
    for segment in sorted({r[0] for r in rows}):
        mine = [r for r in rows if r[0] == segment]
        merged = timing.merge_punctuation(shortened[at : at + len(mine)])
        at += len(mine)
        repaired, _, last = timing.reconcile(merged, mine[0][1], mine[0][2], last, median)
        out += [(segment, k, w.text, w.start, w.end) for k, w in enumerate(repaired)]
    return out


def test_repair_by_windows_equals_the_fold(spark):
    rng = random.Random(6)
    files = {}
    for f in range(60):
        rows, now = [], rng.choice([0.0, 3.0])
        for segment in range(rng.randrange(1, 14)):
            begin = now = now + rng.choice([0.0, 0.3, 2.0, 6.0])
            words = []
            for k in range(rng.choice([1, 1, 2, 2, 3, 8])):
                text = rng.choice([" word", " and", "ly", ".", ",", "!", ' "', " (", ")", "?", " "])
                size = rng.choice([0.0, 0.125, 0.25, 0.5, 1.0, 5.0])
                words.append((k, text, now, now + size))
                now += size + rng.choice([0, 0, 0.125])
            start, end = begin + rng.choice([-1, -0.25, 0, 0.25, 0.75]), now + rng.choice([-2, -0.75, 0, 0.5])
            rows += [(segment, start, end, *w) for w in words]
        files[f"f{f}"] = rows
    df = spark.createDataFrame([(f, *r) for f, rows in files.items() for r in rows], "f string, segment long, seg_start double, seg_end double, seq long, text string, start double, end double")
    got = {}
    for r in timing.repaired(df, "f", 6).collect():
        got.setdefault(r["f"], []).append((r["segment"], r["seq"], r["text"], r["start"], r["end"]))
    for f, rows in files.items():
        want = fold(rows)
        assert [x[:3] for x in sorted(got[f])] == [x[:3] for x in want]
        assert np.allclose([x[3:] for x in sorted(got[f])], [x[3:] for x in want]), (f, rows)


def test_repair_needs_no_python(spark):
    df = spark.createDataFrame([("f", 0, 0.0, 1.0, 0, " a", 0.0, 1.0)], "f string, segment long, seg_start double, seg_end double, seq long, text string, start double, end double")
    plan = timing.repaired(df, "f")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert [tuple(r) for r in timing.repaired(df, "f").collect()] == [("f", 0, 0, " a", 0.0, 1.0)]
    assert timing.repaired(df.where("1 = 0"), "f").count() == 0


def test_medians_by_rank(spark):
    rng = random.Random(4)
    rows = [(k, round(rng.random() * 3, 1)) for k in "abc" for _ in range(rng.randrange(1, 40))]
    got = {r["k"]: r["median"] for r in timing.medians(spark.createDataFrame(rows, "k string, v double"), "k", F.col("v")).collect()}
    assert got == {k: float(np.median([v for j, v in rows if j == k])) for k in "abc"}


def test_words_are_dealt_by_segment_alone(spark):
    """What is dealt by file holds segments; words are dealt by segment, with what they need of their file, and by nothing else."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df = spark.range(16).selectExpr("concat('f', id DIV 8) AS f", "id DIV 4 AS segment", "id DIV 4 * 4.0D AS seg_start", "id DIV 4 * 4.0D + 4 AS seg_end", "id % 4 AS seq", "concat(' w', id) AS text", "CAST(id AS double) AS start", "id + 1.0D AS end")
        plan = spark._jvm.PythonSQLUtils.explainString(timing.repaired(df.repartition(3), "f")._jdf.queryExecution(), "formatted")
        dealt = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning\((.*)\), ENSURE", plan)
        assert dealt and not [by for columns, by in dealt if "seq#" in columns and "segment#" not in by]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import line_dedup, near_dedup
from tidemark.llm.graph import components


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows, near=85):
    """rows: (doc_id, text) -> {doc_id: component}"""
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if 100 * both >= near * (len(sets[a]) + len(sets[b]) - both) and root(a) != root(b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return sets, {i: root(i) for i in sets}


def check_near(spark, rows, near=85):
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near).collect()
    sets, comp = brute_components(rows, near)
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), comp[r["doc_id"]], comp[r["doc_id"]] == r["doc_id"])


def edited(words, n, rng):
    out = list(words)
    for k in rng.sample(range(len(out)), n):
        out[k] = f"new{rng.random()}"
    return " ".join(out)


def test_near_copies_of_many_kinds(spark):
    rng = random.Random(5)
    base = [f"w{rng.randrange(500)}" for _ in range(200)]
    rows = [(10 * k, edited(base, n, rng)) for k, n in enumerate([0, 0, 1, 1, 2, 2, 3, 3, 3, 4, 4, 5, 6, 8, 12] * 6)]
    rows += [(1001 + k, " ".join(f"x{rng.randrange(500)}" for _ in range(rng.randrange(1, 40)))) for k in range(60)]
    check_near(spark, rows)
    check_near(spark, rows, 80)


def test_large_bucket_goes_through_hubs_and_blocks(spark):
    """A chain: each text is near the next alone, so no hub links them all."""
    rng = random.Random(6)
    now, rows = [f"w{k}" for k in range(120)], []
    for k in range(90):
        rows.append((rng.randrange(10**6) * 100 + k, " ".join(now)))
        now[rng.randrange(len(now))] = f"n{k}"
    check_near(spark, rows)


def test_thousands_of_exact_copies_and_given_documents(spark, documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    check_near(spark, rows)
    many = [(k, "the same text of some eight words here") for k in range(3000)]
    got = near_dedup.near_duplicates(spark.createDataFrame(many, "doc_id long, text string")).collect()
    assert Counter(r["component_id"] for r in got) == {0: 3000}


def test_near_dedup_of_odd_and_no_rows(odd, empty):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = defaultdict(list)
    for r in got:
        by[r["doc_id"]].append(r)
    assert by[None][0]["component_id"] is None and by[None][0]["kept"]
    assert by[1][0]["n_shingles"] == 0 and by[4][0]["n_shingles"] == 1 and len(by[8]) == 2
    assert near_dedup.near_duplicates(empty).count() == 0
    assert near_dedup.keep(odd).schema.names == odd.schema.names


def test_texts_of_one_id_are_one_document(spark):
    rng = random.Random(9)
    a, b, c, d = ([f"{x}{k}" for k in range(100)] for x in "abcd")
    rows = [(5, " ".join(a)), (5, " ".join(b)), (3, edited(a, 1, rng)), (9, edited(b, 1, rng)), (4, " ".join(c)), (4, " ".join(d)), (8, " ".join(d)), (7, ""), (7, "some other text of seven words here")]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(3, 3, True), (4, 4, True), (4, 4, True), (5, 3, False), (5, 3, False), (7, 7, True), (7, 7, True), (8, 4, False), (9, 3, False)]


def test_settling_in_blocks_finds_links_of_other_components():
    import pandas as pd

    a = np.arange(100, dtype=np.uint64)
    sets = [a, a[:95], np.arange(1000, 1100, dtype=np.uint64)]
    rows = pd.DataFrame({"doc_id": [1, 2, 3], "comp": [1, 2, 3], "todo": [False, True, True], "shingles": [x.tobytes() for x in sets]})
    assert near_dedup._settle(rows, 85).values.tolist() == [[2, 1]]


def test_odd_sketches_estimate(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**63, 2000, dtype=np.uint64)
    for shared in (1000, 920):
        x, y = np.sort(values[:1000]), np.sort(values[1000 - shared : 2000 - shared])
        _, sketches = near_dedup.signatures(np.concatenate((x, y)), np.array([0, 1000]))
        far = int(np.bitwise_count(sketches[0] ^ sketches[1]).sum())
        assert far == 0 if shared == 1000 else far <= near_dedup.max_different_bits(85)


@pytest.mark.parametrize("n", [2, 50])
def test_components_of_chains_and_stars(spark, n):
    chain = [(k, k + 1) for k in range(n)]
    star = [(1000, 1000 + k) for k in range(1, n)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain + star + [(5000, 5000)], "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(n + 1), 0), **dict.fromkeys(range(1000, 1000 + n), 1000)}


# --- lines ---
SPACE = " \t\n\v\f\r"


def brute_lines(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    holders = defaultdict(set)
    keyed = {}
    for i, t in rows:
        keyed[i] = [(x, x.strip(SPACE).translate(lower)) for x in (t or "").split("\n")]
        for _, k in keyed[i]:
            if len(k) >= 40:
                holders[k].add(i)
    out = {}
    for i, lines in keyed.items():
        stays = [x for x, k in lines if len(k) < 40 or len(holders[k]) < 5 or max(holders[k]) == i]
        out[i] = (len(lines), len(lines) - len(stays), hashlib.sha256("\n".join(stays).encode()).hexdigest())
    return out


def check_lines(spark, rows):
    got = line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in got} == brute_lines(rows)
    assert len(got) == len(rows)


def test_lines_against_brute_force(spark, documents):
    check_lines(spark, [(r["doc_id"], r["text"]) for r in documents.collect()])


def test_a_line_that_most_documents_hold(spark):
    """Runs over all partitions, next to short runs."""
    hot = "This line is held by nearly all documents of the table"
    rows = [(k, f"{hot}\nline {k} on its own that is long enough to count {k}\n  {hot.upper()}\t\nshared by {k // 7} documents and long enough to count\nx") for k in range(2000)]
    rows += [(5000 + k, hot + " é" * (k % 3)) for k in range(20)]
    check_lines(spark, rows)


def test_lines_of_odd_and_no_rows(spark, odd, empty):
    got = line_dedup.digest(odd).collect()
    assert len(got) == odd.count()
    assert {(r["doc_id"], r["n_lines"], r["n_dropped"]) for r in got} >= {(1, 1, 0), (2, 1, 0), (None, 1, 0)}
    assert line_dedup.digest(empty).count() == 0
    assert line_dedup.deduplicated(odd).schema.names == odd.schema.names
    assert line_dedup.deduplicated(empty).count() == 0


def test_bitmaps():
    packed = line_dedup.bitmap(11, [0, 3, 10])
    assert line_dedup.apply_bitmap("\n".join("abcdefghijk"), packed) == "\n".join("bcefghij")
    assert line_dedup.apply_bitmap(None, None) == ""


def test_rows_of_one_id_lose_their_own_lines(spark):
    """A doc_id with several texts counts once, and each of its rows keeps or loses what it holds itself."""
    shared = "a line that more than five documents hold, of some length"
    rows = [(k, f"{shared}\nown line {k}") for k in range(8)] + [(2, f"first own line of the other row\nand one more\n{shared}"), (7, shared), (2, "nothing shared")]
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_sha256"]) for r in line_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    kept = lambda i, t: "\n".join(x for x in t.split("\n") if x != shared or i == 7)
    assert got == sorted((i, t.count("\n") + 1, t.count("\n") - kept(i, t).count("\n") if kept(i, t) else 1, hashlib.sha256(kept(i, t).encode()).hexdigest()) for i, t in rows)
    few = [(k % 4, f"{shared}\n{k}") for k in range(40)]  # forty rows, but four documents
    assert all(r["n_dropped"] == 0 for r in line_dedup.digest(spark.createDataFrame(few, "doc_id long, text string")).collect())


def test_only_rows_that_lose_lines_have_bitmaps(spark, documents, monkeypatch):
    maps = line_dedup.keep_bitmaps(documents).collect()
    want = {r["doc_id"]: r["n_dropped"] for r in line_dedup.digest(documents).collect() if r["n_dropped"]}
    assert {r["doc_id"]: r["n_dropped"] for r in maps} == want and 0 < len(want) < documents.count()
    for r in maps:
        assert int((~line_dedup.kept_lines(r["n_lines"], r["keep_bitmap"])).sum()) == r["n_dropped"]
    monkeypatch.setattr(line_dedup, "FILTER_BITS", (6, 6))  # a filter that lets nearly all rows through
    assert {r["doc_id"]: r["n_dropped"] for r in line_dedup.digest(documents).collect() if r["n_dropped"]} == want


def test_texts_without_a_bitmap_are_not_shuffled(spark, documents):
    plan = line_dedup.digest(documents)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") <= 2


def test_the_shared_folder_is_an_error_on_a_cluster_without_one():
    from types import SimpleNamespace

    from tidemark.llm.common import shared_folder

    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://host:7077")))


def test_signatures_at_a_low_threshold():
    """More samples than 1000: every band of equal sets agrees, and none of sets without a common shingle."""
    width = near_dedup.n_bands(50)
    assert width * near_dedup.ROWS > 2000
    rng = np.random.default_rng(8)
    one, other = rng.integers(0, 2**63, (2, 30), dtype=np.uint64)
    for _ in range(3):
        bands, sketch = near_dedup.signatures(np.concatenate((one, other, one)), np.array([0, 30, 60]), 50)
        assert bands.shape == (3, width) and (bands[0] == bands[2]).all() and (sketch[0] == sketch[2]).all()
        assert (bands[0] != bands[1]).all()
    samples = np.array([(one * a).min() for a in near_dedup.multipliers(width * near_dedup.ROWS)])
    want = np.arange(width, dtype=np.uint64)
    for k in range(near_dedup.ROWS):
        want = near_dedup.mix(want + samples[k :: near_dedup.ROWS])
    assert (bands[0] == want).all()
    assert (near_dedup.multipliers(125) == near_dedup.multipliers(2305)[:125]).all()

import numpy as np
import pytest

from tidemark.llm import exact_search, packing


def brute(rows, k=20):
    fit = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            fit[i] = np.floor(64 * np.array(v, float)).astype(int)
    out = set()
    for q in (i for i in fit if i % 20 == 0):
        scored = sorted((-int(fit[q] @ v), i) for i, v in fit.items() if i != q and len(v) == len(fit[q]))[:k]
        out |= {(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)}
    return out


def rows_of(df):
    return {tuple(r) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, query_id string")


@pytest.mark.parametrize("cells", [1024, 1])
def test_against_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(exact_search, "TREE_ROWS", 200)
    monkeypatch.setattr(exact_search, "QUERY_ROWS", 40)
    monkeypatch.setattr(exact_search, "BLOCKS_PER_TREE", 2)
    monkeypatch.setattr(exact_search, "MOST_CELLS", cells)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(8, 12))
    rows = [(k, (centres[k % 8] + 0.2 * rng.normal(size=12)).astype(np.float32).tolist(), "x") for k in range(2500)]
    rows += [(3000 + k, rows[0][1], "x") for k in range(900)]  # one very common vector
    rows += [(5000 + k, rng.normal(size=3).astype(np.float32).tolist(), "x") for k in range(90)]  # a length without routes
    got = rows_of(exact_search.top_k(frame(spark, rows)))
    assert got == brute([(i, v) for i, v, _ in rows])


def test_cells_that_cannot_serve_a_query_are_left_out(spark):
    """Clustered rows: most pairs of a query and a cell are ruled out before any tree is read."""
    rng = np.random.default_rng(9)
    centres = 4 * rng.normal(size=(16, 24))
    vectors = np.floor(64 * (centres[np.arange(8000) % 16] + 0.1 * rng.normal(size=(8000, 24)))).astype(np.int64)
    cell, apart = exact_search.nearest(vectors, centres * 64)
    radius, n = np.zeros(16), np.bincount(cell, minlength=16)
    np.maximum.at(radius, cell, apart)
    plan = type("Shared", (), {"value": {24: exact_search.Cells(centres * 64, radius, n, np.ones(16, np.int64))}})
    tree = exact_search.build(np.flatnonzero(cell == 0), vectors[cell == 0])
    ids = np.arange(0, 800, 16)
    floor = exact_search.search(tree, ids, vectors[ids])[1][:, -1]
    import pickle

    blocks = spark.createDataFrame([(24, 0, pickle.dumps((ids, vectors[ids], floor)))], "dim int, block long, data binary")
    plan_value = plan.value
    shared = spark.sparkContext.broadcast(plan_value)
    sent = exact_search._sent(blocks, shared, None).collect()
    pairs = sum(len(pickle.loads(r["data"])[0]) for r in sent)
    assert pairs <= 0.3 * 16 * len(ids) and sum(r["cell"] == 0 for r in sent) == 1


def test_numbers_beyond_64_bits_and_repeated_ids(spark):
    rows = [(0, [3e37, 1.0], "x"), (20, [-3e37, 1.0], "x"), (1, [3e38, 0.0], "x"), (2, [1.0, 1.0], "x"), (3, [5.0], "x"), (3, [2.0, 2.0], "x"), (2, [9.0, 9.0], "x")]
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in exact_search.top_k(frame(spark, rows)).collect()}
    top = 2**63 - 1
    assert got[0, 1] == top and got[0, 20] == -(2**63) + 1 and got[20, 1] == -(2**63) + 1
    assert got[0, 2] == top and (0, 3) not in got  # of id 3 the one-component vector counts, of id 2 the smaller


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0], "x"), (20, [-1.0, 0.5], "x"), (1, None, "x"), (2, [], "x"), (3, [nan, 1.0], "x"), (4, [inf, 1.0], "x"), (5, [None, 1.0], "x"), (None, [1.0, 1.0], "x"), (6, [1.0, 2.0], "x"), (6, [1.0, 2.0], "x"), (40, [1.0, 2.0, 3.0], "x"), (7, [0.0, 0.0], "x")]
    assert rows_of(exact_search.top_k(frame(spark, rows))) == brute([(i, v) for i, v, _ in rows])
    assert exact_search.top_k(frame(spark, []).where("1 = 0")).count() == 0


def test_bounds_save_work():
    rng = np.random.default_rng(5)
    vectors = np.concatenate([np.round(60 * (c + 0.05 * rng.normal(size=(500, 8)))).astype(np.int64) for c in 5 * rng.normal(size=(8, 8))])
    tree = exact_search.build(np.arange(len(vectors)), vectors)
    opened = []
    real = exact_search._products
    exact_search._products = lambda q, x: opened.append(q.shape[0] * x.shape[0]) or real(q, x)
    try:
        exact_search.search(tree, np.arange(20), vectors[:20])
    finally:
        exact_search._products = real
    assert sum(opened) < 0.5 * 20 * len(vectors)


@pytest.mark.parametrize("seed", range(6))
def test_bins_hold_their_items(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 4097 if seed % 2 else 300, rng.integers(1, 900))
    bins, start, capacity = packing.pack(sizes)
    for b in np.unique(bins):
        mine = np.flatnonzero(bins == b)
        order = mine[np.argsort(start[mine])]
        assert (start[order] == np.concatenate(([0], np.cumsum(sizes[order])[:-1]))).all()
        total = sizes[mine].sum()
        assert len(set(capacity[mine])) == 1 and total <= capacity[mine][0]
        assert not [c for c in packing.CAPACITIES if total <= c < capacity[mine][0]]  # downsized
    filled = sizes.sum() / sum(capacity[bins == b][0] for b in np.unique(bins))
    assert filled > 0.85 or len(sizes) < 20
    again = packing.pack(sizes)
    assert all((x == y).all() for x, y in zip((bins, start, capacity), again))


def total(capacity, bins):
    return sum(packing.cost(int(capacity[bins == b][0])) for b in np.unique(bins))


def test_packing_against_the_best_of_all():
    """Small cases against every way to part the items into bins."""
    rng = np.random.default_rng(7)

    def cheapest(sizes, capacities):
        best = [float("inf")]

        def walk(k, loads):
            if k == len(sizes):
                best[0] = min(best[0], sum(packing.cost(next(c for c in capacities if c >= x)) for x in loads))
                return
            for b in range(len(loads) + 1):
                now = (loads + [0]) if b == len(loads) else list(loads)
                now[b] += int(sizes[k])
                if now[b] <= capacities[-1]:
                    walk(k + 1, now)

        walk(0, [])
        return best[0]

    ratios = []
    for _ in range(120):
        sizes = rng.integers(1, 4097, rng.integers(1, 8))
        bins, _, capacity = packing.pack(sizes)
        ratios.append(total(capacity, bins) / cheapest(sizes, packing.CAPACITIES))
    assert min(ratios) >= 1 - 1e-9 and max(ratios) <= 1.5 and np.mean(ratios) <= 1.05


@pytest.mark.parametrize("seed", range(5))
def test_several_lengths_cost_no_more_than_one(seed):
    """Plain best fit into bins of the largest length, also downsized, is never cheaper; bins that keep that length cost more."""
    rng = np.random.default_rng(seed)
    sizes = np.minimum(4096, (rng.lognormal(5.5, 1.2, 1500) + 1).astype(np.int64))
    bins, _, capacity = packing.pack(sizes)
    order = np.argsort(-sizes, kind="stable")
    _, _, fixed = packing.best_fit(sizes, order, packing.CAPACITIES, lambda *_: 4096)
    assert total(capacity, bins) <= sum(map(packing.cost, fixed.tolist())) <= len(fixed) * packing.cost(4096)


def test_shards_of_equal_rows(spark, monkeypatch):
    """Rows that are all alike, without ids or without items are dealt to many shards, or need none."""
    monkeypatch.setattr(packing, "SHARD_ITEMS", 50)
    rows = [(None, "the same words")] * 400 + [(7, "the same words")] * 400 + [(8, "")] * 300 + [(None, None)] * 3
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows) and sum(r["bin_id"] is None for r in got) == 303
    shards = {}
    for r in got:
        if r["bin_id"]:
            shards[r["bin_id"].split("-")[0]] = shards.get(r["bin_id"].split("-")[0], 0) + 1
    assert len(shards) == 16 and max(shards.values()) < 90


def test_packed_documents(spark, documents, odd, empty):
    rows = packing.packed(documents).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in documents.select("doc_id").collect()}
    from tidemark.llm.token_counts import count

    want = {r["doc_id"]: r["n_tokens"] for r in count(documents).collect()}
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["size"]
    assert got == want
    rows = packing.packed(odd).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in odd.collect()}
    assert all(r["bin_id"] is None for r in rows if r["doc_id"] in (1, 2))
    assert packing.packed(empty).count() == 0

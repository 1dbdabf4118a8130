"""Exact top-k search by inner product in M-trees (operator 7).

Rows go to the nearest of some routing vectors (k-means of a bounded sample; every row is indexed), and the rows of each such cell into trees of
bounded size. A tree is paged: each node holds routing vectors with covering radii and distances to the parent's routing vector, each leaf its
vectors by falling distance to the leaf's. For a query q and a ball with centre c and radius r, no inner product exceeds q.c + |q| r; with the stored
distance of c to its parent p it can't exceed q.p + |q| (d(c, p) + r) either, which often saves computing q.c. Search is best-first: every query
opens its most promising node until that can't reach its k-th best score.

Each query first meets one tree of the cell that looks best for it. The k-th best score found there is a floor: the query then goes only to cells
whose ball may reach it, and in them to every tree. A tree is sent to a task once for many blocks of queries. Each meeting gives up to k candidates a
query, and the best k of all are the answer.

Defined cases: vectors that are null, empty, or hold null or non-finite components take no part, nor do null ids; of rows that repeat an id the one
with the fewest components, then the smallest vector, counts; vectors meet those of their own length; ties go to the smaller id; components and
scores beyond 64 bits are taken as the largest or smallest such number; other columns play no part.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import written

K = 20
SCALE = 64
TREE_ROWS, QUERY_ROWS = 4096, 1024
LEAF, FANOUT = 256, 16
#: Routing vectors are fitted on about so many rows of a vector length, for at most so many lengths, those of most rows; vectors of other lengths
#: are in one cell. There are so many cells of a length and so many bytes of routing vectors in all at most, which all tasks get.
SAMPLE_ROWS, ROUTED_LENGTHS, MOST_CELLS, ROUTE_BYTES = 8192, 16, 1024, 32 << 20
ROUTE_ROUNDS = 5
#: Blocks of queries that a tree is sent with.
BLOCKS_PER_TREE = 64
#: So many steps each query takes alone before nodes are opened for all queries together.
OWN_STEPS = 4
LOWEST = np.iinfo(np.int64).min
#: Rounding errors of a bound, relative to the product of the norms.
ROUNDING = 1e-11


@dataclass
class Tree:
    """Nodes in breadth order. Node 0 is the root. Leaf nodes have rows lo..hi of ids and vectors, others children lo..hi."""

    ids: np.ndarray
    vectors: np.ndarray
    apart: np.ndarray  # of each row: distance to its leaf's centre
    leaf: list[bool] = field(default_factory=list)
    lo: list[int] = field(default_factory=list)
    hi: list[int] = field(default_factory=list)
    centre: np.ndarray | None = None
    radius: np.ndarray | None = None
    to_parent: np.ndarray | None = None


@dataclass
class Cells:
    """The cells of one vector length: routing vectors, covering radii, rows and trees."""

    centre: np.ndarray
    radius: np.ndarray
    rows: np.ndarray
    trees: np.ndarray


def _apart(vectors: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors.astype(np.float64) - centre) ** 2).sum(1))


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as hold them."""
    for kind in (np.int16, np.int32):
        if not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max):
            return x.astype(kind)
    return x


def build(ids: np.ndarray, vectors: np.ndarray) -> Tree:
    """Bulk loading: rows go to the nearest of some routing rows, chosen farthest first; equal rows are cut evenly."""
    order, apart = np.arange(len(ids)), np.zeros(len(ids))
    nodes = [(0, len(ids), vectors[0].astype(np.float64), 0.0)]
    out = Tree(ids, vectors, apart)
    centres, radii, parents, k = [], [], [], 0
    while k < len(nodes):
        lo, hi, centre, to_parent = nodes[k]
        far = _apart(vectors[order[lo:hi]], centre)
        centres.append(centre)
        radii.append(far.max())
        parents.append(to_parent)
        if hi - lo <= LEAF:
            by = np.argsort(-far, kind="stable")
            order[lo:hi], apart[lo:hi] = order[lo:hi][by], far[by]
            out.leaf.append(True)
            out.lo.append(lo)
            out.hi.append(hi)
            k += 1
            continue
        mine = vectors[order[lo:hi]].astype(np.float64)
        fanout = min(FANOUT, -(-(hi - lo) // LEAF) * 2)
        routes, gap = [int(far.argmin())], np.full(hi - lo, np.inf)
        nearest = np.zeros(hi - lo, np.int64)
        while True:
            d = _apart(mine, mine[routes[-1]])
            closer = d < gap
            nearest[closer], gap[closer] = len(routes) - 1, d[closer]
            if len(routes) == fanout or gap.max() == 0:
                break
            routes.append(int(gap.argmax()))
        if np.bincount(nearest).max() > 0.95 * (hi - lo):  # many equal rows: cut by position
            by = np.argsort(gap + nearest * (gap.max() + 1), kind="stable")
            cuts = np.linspace(0, hi - lo, fanout + 1).astype(int)
            groups = [by[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
            points = [mine[g[0]] for g in groups]
        else:
            groups = [np.flatnonzero(nearest == g) for g in range(len(routes))]
            points = [mine[r] for r in routes]
        order[lo:hi] = order[lo:hi][np.concatenate(groups)]
        out.leaf.append(False)
        out.lo.append(len(nodes))
        at = lo
        for group, point in zip(groups, points, strict=True):
            nodes.append((at, at + len(group), point, float(np.sqrt(((point - centre) ** 2).sum()))))
            at += len(group)
        out.hi.append(len(nodes))
        k += 1
    out.ids, out.vectors = ids[order], narrow(vectors[order])
    out.centre, out.radius, out.to_parent = np.array(centres), np.array(radii), np.array(parents)
    return out


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floating point where no sum can leave its 53 bits, and in Python's integers where one may leave 64."""
    size = lambda v: float(np.abs(v.astype(np.float64)).max(initial=0))
    most = size(q) * size(x) * q.shape[1]
    if most < 2**52:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    exact = q.astype(np.int64).astype(object) @ x.astype(np.int64).astype(object).T
    return np.minimum(np.maximum(exact, LOWEST + 1), np.iinfo(np.int64).max).astype(np.int64)


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, k: int = K, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids, scores), each (queries, k), best first; score LOWEST where there are fewer. Scores below a query's floor need not be found. All
    queries step together."""
    m = len(query_ids)
    q, norm = queries.astype(np.float64), np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    best_ids, best = np.full((m, k), np.iinfo(np.int64).max), np.full((m, k), LOWEST)
    floor = np.full(m, LOWEST) if floor is None else floor
    least = floor.copy()  # what a score must reach to count
    bound = np.full((m, len(tree.leaf)), -np.inf)
    dot = np.zeros((m, len(tree.leaf)))
    dot[:, 0] = q @ tree.centre[0]
    bound[:, 0] = dot[:, 0] + norm * tree.radius[0]
    error = ROUNDING * norm * (float(np.sqrt((tree.centre[0] ** 2).sum())) + tree.radius[0]) + 1e-6

    def absorb(who: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """Takes scores (who, ids) that count into a query's list."""
        score[ids[None, :] == query_ids[who][:, None]] = LOWEST
        row, column = np.nonzero((score >= least[who][:, None]) & (score > LOWEST))
        if not len(row):
            return
        touched = np.unique(who[row])
        rows = np.concatenate((np.repeat(touched, k), who[row]))
        found = np.concatenate((best[touched].ravel(), score[row, column]))
        names = np.concatenate((best_ids[touched].ravel(), ids[column]))
        order = np.lexsort((names, ~found, rows))
        rows, found, names = rows[order], found[order], names[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        top = place < k
        best[rows[top], place[top]], best_ids[rows[top], place[top]] = found[top], names[top]
        least[touched] = np.maximum(floor[touched], best[touched, -1])

    def open_node(n: int, who: np.ndarray) -> None:
        bound[who, n] = -np.inf
        lo, hi = tree.lo[n], tree.hi[n]
        if tree.leaf[n]:
            # Rows lie by falling distance: those nearer than a query needs can't reach what counts for any of these queries.
            slack = (least[who].astype(np.float64) - dot[who, n] - error[who]) / np.maximum(norm[who], 1e-12)
            many = int(np.searchsorted(-tree.apart[lo:hi], -(slack.min() - 1e-6), "right")) if (least[who] > LOWEST).all() else hi - lo
            if many:
                absorb(who, tree.ids[lo : lo + many], _products(queries[who], tree.vectors[lo : lo + many]))
        else:
            above = dot[who, n][:, None] + norm[who][:, None] * (tree.to_parent[lo:hi] + tree.radius[lo:hi])[None, :]
            far = (above + error[who][:, None] >= least[who][:, None]).any(0)
            children = lo + np.flatnonzero(far)
            dot[np.ix_(who, children)] = found = q[who] @ tree.centre[children].T
            bound[np.ix_(who, children)] = np.minimum(found + norm[who][:, None] * tree.radius[children][None, :], above[:, far])

    steps = 0
    while True:
        alive = (bound > -np.inf) & (bound + error[:, None] >= least[:, None])
        waiting = np.flatnonzero(alive.any(1))
        if not len(waiting):
            return best_ids, best
        if steps < OWN_STEPS:  # each query's own best node, until its first leaves have set a k-th best
            node = bound[waiting].argmax(1)
            for n in np.unique(node).tolist():
                open_node(n, waiting[node == n])
        else:  # the best node of all, for every query that it may still serve
            n = int(np.where(alive, bound, -np.inf).max(0).argmax())
            open_node(n, np.flatnonzero(alive[:, n]))
        steps += 1


def quantised(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part, one for each id."""
    fit = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = embeddings.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(fit)
    rows = rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long")).alias("v"), F.size("embedding").alias("dim"))
    again = written(rows.groupBy("vec_id").agg(F.count("*").alias("n")).where("n > 1").select("vec_id"))  # ids alone, and few if any
    if again.isEmpty():
        return rows
    first = rows.join(again, "vec_id", "left_semi").groupBy("vec_id").agg(F.min(F.struct("dim", "v")).alias("x")).select("vec_id", "x.v", "x.dim")
    return rows.join(again, "vec_id", "left_anti").unionByName(first)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(lists.flatten()).reshape(-1, dim)


def fit_routes(rows: DataFrame) -> dict[int, np.ndarray]:
    """Routing vectors of the vector lengths of most rows, by k-means of a sample."""
    large = rows.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > TREE_ROWS).orderBy(F.desc("n"), "dim").limit(ROUTED_LENGTHS).collect()
    out, left = {}, ROUTE_BYTES
    for dim, n in ((r["dim"], r["n"]) for r in large):
        share = F.pmod(F.xxhash64("vec_id", F.lit(23)), F.lit(1 << 30)) < int(min(1.0, SAMPLE_ROWS / n) * (1 << 30))
        drawn = rows.where((F.col("dim") == dim) & share).select("vec_id", "v").limit(2 * SAMPLE_ROWS).toPandas().sort_values("vec_id")
        cells = min(MOST_CELLS, -(-n // TREE_ROWS), left // (8 * dim), len(drawn))
        if cells < 2:
            continue
        sample = np.stack(drawn["v"].to_numpy()).astype(np.float64)
        centres = sample[np.random.default_rng(7).permutation(len(sample))[:cells]].copy()
        for _ in range(ROUTE_ROUNDS):
            near = nearest(sample, centres)[0]
            count = np.bincount(near, minlength=cells)
            total = np.zeros_like(centres)
            np.add.at(total, near, sample)
            centres[count > 0] = total[count > 0] / count[count > 0][:, None]
        out[dim] = centres
        left -= centres.nbytes
    return out


def nearest(vectors: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, distance to it) of each vector."""
    near, apart = np.zeros(len(vectors), np.int64), np.zeros(len(vectors))
    square = (centres**2).sum(1)
    for lo in range(0, len(vectors), 1024):
        part = vectors[lo : lo + 1024].astype(np.float64)
        near[lo : lo + 1024] = k = (square[None, :] - 2 * (part @ centres.T)).argmin(1)
        apart[lo : lo + 1024] = np.sqrt(((part - centres[k]) ** 2).sum(1))
    return near, apart


def _assigned(rows: DataFrame, routes: dict[int, np.ndarray]) -> DataFrame:
    """(vec_id, v, dim, cell, far): each row's cell and its distance to that's routing vector."""
    shared = rows.sparkSession.sparkContext.broadcast(routes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(2))
            cell, far = np.zeros(len(dims), np.int32), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                if dim in shared.value:
                    at = np.flatnonzero(dims == dim)
                    cell[at], far[at] = nearest(_matrix(batch.column(1).take(pa.array(at)), dim), shared.value[dim])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], names=["vec_id", "v", "dim", "cell", "far"])

    return rows.select("vec_id", "v", "dim").mapInArrow(work, "vec_id long, v array<long>, dim int, cell int, far double")


def _rows(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    pdf = pdf.sort_values("vec_id")
    return pdf["vec_id"].to_numpy(), narrow(np.stack(pdf["v"].to_numpy()).astype(np.int64))


def _blocks(queries: DataFrame, cells: DataFrame) -> DataFrame:
    """(dim, block, data): queries of one cell in blocks of bounded size. data: ids, vectors and floors."""

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, vectors = _rows(pdf)
        floors = pdf.sort_values("vec_id")["floor"].fillna(LOWEST).to_numpy(np.int64)
        return pd.DataFrame({"dim": [key[0]], "block": [key[1] * 1_000_003 + key[2]], "data": [pickle.dumps((ids, vectors, floors), 5)]})

    part = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).alias("part")
    dealt = queries.join(cells.select("dim", "cell", "blocks"), ["dim", "cell"]).select("dim", F.col("cell").cast("long").alias("cell"), part, "vec_id", "v", "floor")
    return dealt.groupBy("dim", "cell", "part").applyInPandas(pack, "dim int, block long, data binary")


def _sent(blocks: DataFrame, plan, least_rows: int | None) -> DataFrame:
    """(dim, cell, block, data): each block's queries to the cells that may serve them; with least_rows, each query to its best cell of more rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, block, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, vectors, floors = pickle.loads(data)
                cells: Cells | None = plan.value.get(dim)
                if cells is None:
                    wanted = np.ones((len(ids), 1), bool) if least_rows is None else np.zeros((len(ids), 1), bool)
                else:
                    q = vectors.astype(np.float64)
                    norm = np.sqrt((q**2).sum(1))
                    dot = q @ cells.centre.T
                    if least_rows is None:
                        reach = np.sqrt((cells.centre**2).sum(1)) + cells.radius
                        bound = dot + norm[:, None] * cells.radius[None, :]
                        wanted = (bound + ROUNDING * norm[:, None] * reach[None, :] + 1e-6 >= floors[:, None]) & (cells.rows > 0)
                    else:
                        best = np.where(cells.rows > least_rows, dot, -np.inf).argmax(1)
                        wanted = np.zeros(dot.shape, bool)
                        wanted[np.arange(len(ids)), best] = True
                for cell in np.flatnonzero(wanted.any(0)).tolist():
                    who = wanted[:, cell]
                    one = pickle.dumps((ids[who], vectors[who], floors[who]), 5)
                    yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([cell], pa.int32()), pa.array([block], pa.int64()), pa.array([one], pa.binary())], names=["dim", "cell", "block", "data"])

    return blocks.mapInArrow(work, "dim int, cell int, block long, data binary")


def _met(trees: DataFrame, sent: DataFrame, n_blocks: int, k: int, floors: bool) -> DataFrame:
    """(query_id, vec_id, score): each query's best of each tree that it was sent to (dim, cell, tree, block, data); with floors, only the k-th
    best score. A tree comes before its queries in a sorted partition, so it is read once for BLOCKS_PER_TREE blocks."""
    chunks = max(1, -(-n_blocks // BLOCKS_PER_TREE))
    chunk: Column = F.pmod(F.xxhash64("block"), F.lit(chunks)).cast("int")
    key = ["dim", "cell", "tree", "chunk"]
    one = trees.select("dim", "cell", "tree", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(0).alias("kind"), F.col("pages").alias("data"))
    both = one.unionByName(sent.select("dim", "cell", "tree", chunk.alias("chunk"), F.lit(1).alias("kind"), "data"))
    parts = int(trees.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = both.repartition(parts, *key).sortWithinPartitions(*key, "kind")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, tree = b"", None
        for batch in batches:
            for at in range(len(batch)):
                data = batch.column(1)[at].as_py()
                if batch.column(0)[at].as_py() == 0:
                    raw, tree = data, None  # unpacked if a block comes
                    continue
                tree = tree or pickle.loads(raw)
                query_ids, queries, floor = pickle.loads(data)
                ids, score = search(tree, query_ids, queries, k, floor)
                if floors:
                    ids, score = ids[:, -1:], score[:, -1:]
                real = (score != LOWEST).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, score.shape[1])[real]), pa.array(ids.ravel()[real]), pa.array(score.ravel()[real])], names=["query_id", "vec_id", "score"])

    return ordered.select("kind", "data").mapInArrow(work, "query_id long, vec_id long, score long")


def top_k(embeddings: DataFrame, every: int = 20, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id is divisible by every."""
    spark = embeddings.sparkSession
    rows = written(quantised(embeddings))
    routes = fit_routes(rows)
    assigned = written(_assigned(rows, routes))
    is_query = F.col("vec_id") % every == 0
    up = lambda c, size: F.greatest(F.ceil(F.col(c) / size), F.lit(1)).cast("int")
    counts = assigned.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.count_if(is_query).alias("nq"), F.max("far").alias("radius"))
    cells = written(counts.withColumn("trees", up("n", TREE_ROWS)).withColumn("blocks", up("nq", QUERY_ROWS)))
    known = {dim: Cells(c, *(np.zeros(len(c), t) for t in (float, np.int64, np.int64))) for dim, c in routes.items()}
    if known:  # at most MOST_CELLS rows for each of ROUTED_LENGTHS
        for r in cells.where(F.col("dim").isin(list(known))).collect():
            mine = known[r["dim"]]
            mine.radius[r["cell"]], mine.rows[r["cell"]], mine.trees[r["cell"]] = r["radius"], r["n"], r["trees"]
    plan = spark.sparkContext.broadcast(known)

    def plant(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "tree": [key[2]], "pages": [pickle.dumps(build(*_rows(pdf)), 5)]})

    sizes = cells.select("dim", "cell", "trees")
    dealt = assigned.join(sizes, ["dim", "cell"]).withColumn("tree", F.pmod(F.xxhash64("vec_id", F.lit(0)), F.col("trees")).cast("int"))
    trees = written(dealt.select("dim", "cell", "tree", "vec_id", "v").groupBy("dim", "cell", "tree").applyInPandas(plant, "dim int, cell int, tree int, pages binary"))
    queries = assigned.where(is_query).select("dim", "cell", "vec_id", "v")
    if known:
        blocks = _blocks(queries.withColumn("floor", F.lit(None).cast("long")), cells)
        aimed = written(_sent(blocks, plan, k)).join(sizes, ["dim", "cell"]).withColumn("tree", F.pmod("block", F.col("trees")).cast("int"))
        n_blocks = aimed.count()
        found = _met(trees, aimed, n_blocks, k, True).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
        queries = queries.join(found, "vec_id", "left")
    else:
        queries = queries.withColumn("floor", F.lit(None).cast("long"))
    blocks = written(_blocks(queries, cells))
    sent = written(_sent(blocks, plan, None)).join(sizes, ["dim", "cell"])
    sent = sent.withColumn("tree", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)))
    best = _met(trees, sent, blocks.count(), k, False)
    window = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

"""Approximate nearest neighbours: a forest of random-projection trees, one priority queue over all of them,
and exact reranking of the leaf candidates."""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corelev.llm.common import sliced, table, written


class Tree:
    """Split nodes as arrays: normal, threshold, children (a leaf's number as -1 - number)."""

    def __init__(self, points: np.ndarray, rng, leaf: int):
        self.w, self.t, self.kids, self.leaves = [], [], [], 0
        self.root = self._grow(points, np.arange(len(points)), rng, leaf)
        self.w = np.array(self.w, np.float64).reshape(-1, points.shape[1])
        self.t, self.kids = np.array(self.t, np.float64), np.array(self.kids, np.int64).reshape(-1, 2)

    def _grow(self, x, idx, rng, leaf) -> int:
        side = None
        if len(idx) > leaf:
            a, b = x[rng.choice(idx, 2, replace=False)]
            for _ in range(3):  # two means, begun from two random points
                side = x[idx] @ (a - b) > 0
                if side.all() or not side.any():
                    break
                a, b = x[idx[side]].mean(0), x[idx[~side]].mean(0)
            w = a - b
            proj = x[idx] @ w
            cut = float(np.median(proj))
            side = proj > cut
        if side is None or side.all() or not side.any():
            self.leaves += 1
            return -self.leaves
        node = len(self.w)
        self.w.append(w / (np.linalg.norm(w) or 1.0))
        self.t.append(cut / (np.linalg.norm(w) or 1.0))
        self.kids.append([0, 0])
        self.kids[node] = [self._grow(x, idx[~side], rng, leaf), self._grow(x, idx[side], rng, leaf)]
        return node

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.full(len(x), self.root, np.int64)
        while (on := np.flatnonzero(at >= 0)).size:
            n = at[on]
            at[on] = self.kids[n, (np.einsum("ij,ij->i", x[on], self.w[n]) > self.t[n]).astype(np.int64)]
        return -1 - at


class Forest:
    """Trees over unit vectors. ``fit`` takes the sample's distinct rows."""

    def __init__(self, sample: np.ndarray, trees: int, leaf: int, seed: int = 1):
        rng, points = np.random.default_rng(seed), np.unique(sample, axis=0)
        self.trees = [Tree(points, rng, leaf) for _ in range(trees)]
        self.width = max((t.leaves for t in self.trees), default=0)

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([t.leaf_of(x) for t in self.trees], 1)

    def visits(self, x: np.ndarray, sizes: np.ndarray, budget: float) -> np.ndarray:
        """(trees x leaves) flags: leaves taken from one queue of all trees, best margin first, until they hold ``budget`` rows."""
        out, got, tick = np.zeros(sizes.shape, bool), 0, len(self.trees)
        heap = [(-np.inf, k, k, t.root) for k, t in enumerate(self.trees)]
        margins = [t.w @ x - t.t for t in self.trees]
        while heap and got < budget:
            far, _, k, node = heapq.heappop(heap)
            while node >= 0:
                m = margins[k][node]
                kids = self.trees[k].kids[node]
                tick += 1
                heapq.heappush(heap, (max(far, abs(m)), tick, k, int(kids[int(m <= 0)])))
                node = int(kids[int(m > 0)])
            out[k, -1 - node] = True
            got += sizes[k, -1 - node]
        return out


def _vectors(column, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and vectors (double) of the usable values: no null, no null or non-finite component, not zero."""
    keep, rows = [], []
    for i, v in enumerate(column.to_pylist()):
        if v and (dim is None or len(v) == dim) and None not in v:
            keep.append(i)
            rows.append(v)
    x = np.array(rows, np.float64).reshape(len(rows), dim or (len(rows[0]) if rows else 0))
    with np.errstate(all="ignore"):
        ok = np.isfinite(x).all(1) & (np.abs(x).max(1, initial=0) > 0)
    return np.array(keep, np.int64)[ok], x[ok]


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double; the same rows give the same bits wherever they stand. Scaled, so that no square overflows."""
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def nearest(base: DataFrame, queries: DataFrame, k: int = 5, trees: int = 10, leaf: int = 48, sample: int = 20_000, visit: float = 1.0,
            query_block: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's ``k`` nearest rows of ``base`` by cosine, without the query's own id: query_id, rank, vec_id, score.

    The forest is fitted on the ``sample`` rows with the least id hash (a bounded part, on the
    driver); every row of ``base`` is indexed. A query's leaves come from one queue over all trees
    until they hold ``visit`` times the table's rows, rows in several trees' leaves counted as often.
    Vectors without structure need that many for a recall of 0.9 (measured: README). Candidates are
    the rows in any visited leaf; the score is the exact cosine in double, ties go to the smaller id.

    Rows stay where they are: a query block (``query_block`` vectors and their leaf flags, a bounded
    size) is sent to all tasks, each keeps its ``k`` best per query and batch, and only those move.
    Vectors that are null, zero, hold null or non-finite components, or differ in length from most,
    take no part; nor do null ids. Repeated rows are candidates of their own; an empty table gives no rows.
    """
    spark = base.sparkSession
    v, i = F.col(f"`{vector_col}`").cast("array<double>"), F.col(f"`{id_col}`").cast("long")
    src = base.select(i.alias("i"), v.alias("v")).where("i is not null and v is not null")
    asks = queries.select(i.alias("i"), v.alias("v")).where("i is not null and v is not null")
    out_schema = "query_id long, vec_id long, score double"
    dims = src.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not dims or not dims[0]["d"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dims[0]["d"]
    picked = src.where(F.size("v") == dim).orderBy(F.xxhash64("i"), "i").limit(sample).select("v").toArrow()
    _, points = _vectors(picked.column(0), dim)
    forest = spark.sparkContext.broadcast(Forest(_unit(points), trees, leaf))

    def sizes_of(batches):
        f = forest.value
        total = np.zeros((trees, f.width), np.int64)
        for b in sliced(batches, 20_000):
            _, x = _vectors(b.column(0), dim)
            if len(x):
                c = f.codes(_unit(x))
                for t in range(trees):
                    total[t] += np.bincount(c[:, t], minlength=f.width)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["leaf", "n"])

    sizes = np.zeros(trees * forest.value.width, np.int64)
    for r in src.select("v").mapInArrow(sizes_of, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).collect():  # at most trees x sample / leaf
        sizes[r["leaf"]] = r["n"]
    sizes = sizes.reshape(trees, -1)
    budget = visit * sizes[0].sum() if trees else 0

    def leaves(batches):
        f = forest.value
        for b in sliced(batches, 500):
            keep, x = _vectors(b.column(1), dim)
            flags = [np.packbits(f.visits(u, sizes, budget)).tobytes() for u in (_unit(x) if len(x) else [])]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array(flags, pa.binary())], ["i", "x", "flags"])

    asked = written(asks.mapInArrow(leaves, "i long, x binary, flags binary"), "queries")
    found, block = [], []
    for r in asked.toLocalIterator():
        block.append(r)
        if len(block) == query_block:
            found.append(_scan(src, block, forest, sizes.shape, dim, k, out_schema))
            block = []
    if block or not found:
        found.append(_scan(src, block, forest, sizes.shape, dim, k, out_schema))
    all_found = found[0]
    for x in found[1:]:
        all_found = all_found.unionByName(x)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return all_found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(src: DataFrame, block: list, forest, shape, dim: int, k: int, schema: str) -> DataFrame:
    """The block's queries against all rows: each batch's best candidates."""
    qi = np.array([r["i"] for r in block], np.int64)
    qx = np.array([np.frombuffer(r["x"], np.float64) for r in block]).reshape(len(block), dim)
    flags = np.array([np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=shape[0] * shape[1]) for r in block], np.uint8).reshape(len(block), *shape)
    sent = src.sparkSession.sparkContext.broadcast((qi, qx, np.ascontiguousarray(flags.transpose(1, 2, 0))))

    def best(batches):
        qi, qx, flags = sent.value
        qu = _unit(qx) if len(qx) else qx
        for b in sliced(batches, 2000):
            keep, x = _vectors(b.column(1), dim)
            if not len(x) or not len(qx):
                continue
            ids, u = b.column(0).to_numpy()[keep], _unit(x)
            c = forest.value.codes(u)
            cand = flags[0, c[:, 0]].copy()
            for t in range(1, c.shape[1]):
                cand |= flags[t, c[:, t]]
            cand = (cand > 0) & (ids[:, None] != qi[None, :])
            s = np.where(cand, u @ qu.T, -np.inf)
            least = np.partition(s, max(0, len(s) - k), axis=0)[max(0, len(s) - k)]
            row, q = np.nonzero(cand & (s >= least - 1e-9))
            exact = cosine(x[row], qx[q])
            o = np.lexsort((ids[row], -exact, q))
            row, q, exact = row[o], q[o], exact[o]
            first = np.searchsorted(q, q, side="left")
            top = np.arange(len(q)) - first < k
            yield pa.RecordBatch.from_arrays([pa.array(qi[q[top]]), pa.array(ids[row[top]]), pa.array(exact[top])], ["query_id", "vec_id", "score"])

    return src.mapInArrow(best, schema)


def op1_ann(spark, sf_dir: str) -> DataFrame:
    """All ``embeddings``: the 5 nearest found of every row whose vec_id is divisible by 50."""
    base = table(spark, sf_dir, "embeddings")
    return nearest(base, base.where(F.col("vec_id") % 50 == 0))

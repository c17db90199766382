"""Operator 5: nearest neighbours by inner product with a hierarchical k-means tree.

Vectors are extended by one component so that the largest inner product is the nearest
point.  A tree of k-means splits is fitted on a bounded sample; every vector is filed
under a leaf.  A query walks the tree best-bin-first: a priority queue holds the nodes
by their distance, the nearest is opened, and leaves come out in the order in which
they are visited.  The number of visits is widened until the neighbours of calibration
queries, known from a complete comparison, are reached at the wanted rate; a query whose
leaves then hold too few vectors goes on.

Neighbouring leaves share a bin of bounded size and a larger leaf has several bins, so a
leaf that holds much of the data is spread over tasks; so are the queries of a bin.  A
bin answers a query with its best vectors among the leaves that the query visits.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, ship, stored

#: Vectors on which the tree is fitted; all vectors are filed in it.
SAMPLE = 20_000
#: Queries that calibrate the number of visits.
CALIBRATION = 128
#: Vectors wanted in a leaf; the sample bounds the number of leaves by SAMPLE / 8.
LEAF_ROWS, BRANCHES = 128, 16
#: Vectors in a bin, and queries that are compared with a bin in one group.
BIN, QUERY_BLOCK = 4096, 1024


class Tree:
    """Centres of the children of each inner node; a child below 0 is leaf ~child."""

    def __init__(self, x: np.ndarray, leaf_rows: float, seed: int = 0):
        self.centres, self.children, self.leaves = [], [], 0
        rng = np.random.default_rng(seed)
        self.root = self.build(x, max(8.0, leaf_rows), rng)

    def leaf(self) -> int:
        self.leaves += 1
        return ~(self.leaves - 1)

    def build(self, x: np.ndarray, most: float, rng) -> int:
        if len(x) <= most:
            return self.leaf()
        k = int(min(BRANCHES, max(2, np.ceil(len(x) / most))))
        centres = x[rng.choice(len(x), k, replace=False)]
        for _ in range(12):
            near = nearest(x, centres)
            sizes = np.bincount(near, minlength=k)
            sums = np.zeros_like(centres)
            np.add.at(sums, near, x)
            new = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
            if np.allclose(new, centres):
                break
            centres = new
        near = nearest(x, centres)
        used = np.unique(near)
        if len(used) < 2:  # equal vectors: no split parts them
            return self.leaf()
        at = len(self.centres)
        self.centres.append(centres[used])
        self.children.append([])
        for c in used:
            self.children[at].append(self.build(x[near == c], most, rng))
        return at

    def file(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        node = np.full(len(x), self.root)
        while (open_ := np.flatnonzero(node >= 0)).size:
            for n in np.unique(node[open_]):
                own = open_[node[open_] == n]
                node[own] = np.array(self.children[n])[nearest(x[own], self.centres[n])]
        return ~node

    def visits(self, q: np.ndarray, most: int, sizes: dict[int, int] | None = None, rows: int = 0) -> list[int]:
        """The first ``most`` leaves for a query, best bin first, and more until they hold ``rows`` of the ``sizes`` filed."""
        queue, out, held = [(0.0, self.root)], [], 0
        while queue and (len(out) < most or held < rows):
            _, n = heapq.heappop(queue)
            if n < 0:
                out.append(~n)
                held += sizes.get(~n, 0) if sizes else 0
                continue
            gaps = ((self.centres[n] - q) ** 2).sum(axis=1)
            for g, c in zip(gaps.tolist(), self.children[n]):
                heapq.heappush(queue, (g, c))
        return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T).argmin(axis=1)


def extended(x: np.ndarray, top: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(0.0, top * top - (x * x).sum(axis=1)))]


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(len(col), dim)


def best(x: np.ndarray, ids: np.ndarray, q: np.ndarray, rough: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k largest inner products of q with rows of x; ties to the smaller id.

    ``rough`` has the products, minus infinity for rows that do not count.  It only narrows the choice; each
    score is then summed in the same order wherever the vector stands, so equal vectors have equal scores.
    """
    limit = np.partition(rough, len(x) - k)[len(x) - k] if len(x) > k else -np.inf
    slack = 1e-9 * (np.sqrt((q * q).sum()) * np.sqrt((x * x).sum(axis=1).max(initial=0)) + 1e-300)
    take = np.flatnonzero((rough >= limit - slack) & (rough > -np.inf))
    score = (x[take] * q).sum(axis=1)
    order = np.lexsort((ids[take], -score))[:k]
    return ids[take][order], score[order]


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null and size(v) > 0")
    return rows.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))


def neighbours(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, every: int = 20, recall: float = 0.97) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its ``k`` largest inner products.

    Rows with a null id, and vectors that are null, empty, zero, or hold a null or non-finite component,
    take no part; nor do vectors of another length than the commonest (the smaller on ties).  Of rows that
    repeat an id the least vector stays.  With fewer other vectors than ``k`` all are returned: a query
    goes on past the calibrated visits until its leaves hold k others.  Further columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ship(spark)
    sc, folder = spark.sparkContext, shared_dir(spark)
    schema = "query_id long, rank int, vec_id long, score double"
    rows = usable(vectors, id_col, vec_col)
    lengths = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if lengths is None:
        return spark.createDataFrame([], schema)
    dim = lengths.n
    rows = rows.filter(F.size("v") == dim).groupBy("vec_id").agg(F.min("v").alias("v"))

    def pack(batches):
        for b in batches:
            flat = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(b), dim)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([r.tobytes() for r in flat], pa.binary()), pa.array(np.sqrt((flat * flat).sum(axis=1)))], ["vec_id", "x", "norm"])

    packed = stored(rows.mapInArrow(pack, "vec_id long, x binary, norm double"), folder, "packed")
    total = packed.agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("top")).first()
    sample = packed.orderBy(F.xxhash64("vec_id")).limit(SAMPLE).select("x").toPandas()
    points = extended(np.frombuffer(b"".join(sample["x"]), np.float64).reshape(len(sample), dim), total.top)
    tree = sc.broadcast(Tree(points, LEAF_ROWS * len(points) / total.n))
    top, leaves = total.top, tree.value.leaves

    def file(batches):
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(tree.value.file(extended(matrix(b.column("x"), dim), top)).astype(np.int32))], ["vec_id", "x", "leaf"])

    index = stored(packed.mapInArrow(file, "vec_id long, x binary, leaf int"), folder, "index")
    queries = packed.filter(F.col("vec_id") % every == 0)

    # widen the visits until the calibration queries reach their neighbours
    test = queries.orderBy(F.xxhash64("vec_id", F.lit(1))).limit(CALIBRATION).select("vec_id", "x").toPandas()
    if not len(test):
        return spark.createDataFrame([], schema)
    asked = sc.broadcast((test["vec_id"].to_numpy(), np.frombuffer(b"".join(test["x"]), np.float64).reshape(len(test), dim)))

    def compare(batches):
        held: list[list] = [[] for _ in asked.value[0]]
        for b in batches:
            if len(b):
                x, ids, leaf = matrix(b.column("x"), dim), b.column("vec_id").to_numpy(), b.column("leaf").to_numpy()
                where = dict(zip(ids.tolist(), leaf.tolist()))
                for i, (own, q) in enumerate(zip(*asked.value)):
                    rough = np.where(ids == own, -np.inf, x @ q)
                    held[i] = sorted([*held[i], *((-s, v, where[v]) for v, s in zip(*(a.tolist() for a in best(x, ids, q, rough, k))))])[:k]
        flat = [(i, -s, v, leaf) for i, h in enumerate(held) for s, v, leaf in h]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*flat) if flat else ((),) * 4, (pa.int32(), pa.float64(), pa.int64(), pa.int32()))], ["i", "score", "vec_id", "leaf"])

    nearest_first = Window.partitionBy("i").orderBy(F.desc("score"), "vec_id")
    truth = index.mapInArrow(compare, "i int, score double, vec_id long, leaf int").withColumn("r", F.row_number().over(nearest_first)).filter(F.col("r") <= k).select("i", "leaf").toPandas()
    reached = np.zeros(leaves)
    zero = np.zeros((1, 1))
    for i, own in truth.groupby("i"):
        order = tree.value.visits(np.append(asked.value[1][i], zero), leaves)
        place = np.empty(leaves, np.int64)
        place[order] = np.arange(leaves)
        np.add.at(reached, place[own["leaf"].to_numpy()], 1)
    share = np.cumsum(reached) / max(1, reached.sum())
    visits = int(np.searchsorted(share, min(recall, share[-1]) - 1e-12) + 1) if len(truth) else leaves

    # bins: the number of leaves, and so of these rows, is bounded by the sample
    sizes = {r.leaf: r["count"] for r in index.groupBy("leaf").count().collect()}
    first, bins, room = {}, {}, 0
    number = -1
    for leaf in sorted(sizes):
        n = sizes[leaf]
        if n > BIN:
            first[leaf], bins[leaf] = number + 1, -(-n // BIN)
            number, room = number + bins[leaf], 0
            continue
        if n > room:
            number, room = number + 1, BIN
        first[leaf], bins[leaf], room = number, 1, room - n
    placed = spark.createDataFrame([(leaf, first[leaf], bins[leaf]) for leaf in sizes], "leaf int, first int, bins int")
    filed = index.join(F.broadcast(placed), "leaf").select("vec_id", "x", "leaf", (F.col("first") + F.pmod(F.xxhash64("vec_id"), "bins")).cast("int").alias("bin"))

    def walk(batches):
        for b in batches:
            out = []
            for own, raw in zip(b.column("vec_id").to_pylist(), b.column("x").to_pylist()):
                asks: dict[int, list[int]] = {}
                for leaf in tree.value.visits(np.append(np.frombuffer(raw), 0.0), visits, sizes, k + 1):  # one may be the query itself
                    for n in range(first.get(leaf, 0), first.get(leaf, 0) + bins.get(leaf, 0)):
                        asks.setdefault(n, []).append(leaf)
                out += [(n, own, raw, np.array(leaves, np.int32).tobytes()) for n, leaves in asks.items()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out) if out else ((),) * 4, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["bin", "query_id", "q", "leaves"])

    asks = stored(queries.select("vec_id", "x").mapInArrow(walk, "bin int, query_id long, q binary, leaves binary"), folder, "asks")
    shares = asks.groupBy("bin").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("shares"))
    shares = stored(shares, folder, "shares")
    left = filed.join(shares, "bin").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
    right = asks.join(shares, "bin").withColumn("share", F.pmod(F.xxhash64("query_id"), "shares").cast("int"))

    def score(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            x, ids = np.frombuffer(b"".join(a["x"]), np.float64).reshape(len(a), dim), a["vec_id"].to_numpy()
            here, leaf = np.unique(a["leaf"].to_numpy(), return_inverse=True)
            for at in range(0, len(b), 64):
                some = b.iloc[at: at + 64]
                q = np.frombuffer(b"".join(some["q"]), np.float64).reshape(len(some), dim)
                for own, v, rough, leaves in zip(some["query_id"], q, (x @ q.T).T, some["leaves"]):
                    counts = np.isin(here, np.frombuffer(leaves, np.int32))[leaf] & (ids != own)
                    near, value = best(x, ids, v, np.where(counts, rough, -np.inf), k)
                    out.append((np.full(len(near), own), near, value))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame({"query_id": cols[0].astype(np.int64), "vec_id": cols[1].astype(np.int64), "score": cols[2]})

    keys = ["bin", "share"]
    scored = left.select(*keys, "vec_id", "x", "leaf").groupBy(*keys).cogroup(right.select(*keys, "query_id", "q", "leaves").groupBy(*keys)).applyInPandas(score, "query_id long, vec_id long, score double")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

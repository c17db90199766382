"""Operator 13: product-quantisation codes of vectors, trained in whole numbers with norm-of-sum bounds.

Vectors become whole numbers and are cut into equal parts; each part position has its own codebook.  A
round gives every part its nearest entry and moves each entry to the floored mean of its parts.  Whole
numbers make sums exact in any order, so codes do not depend on partitions or lost executors.

Most parts keep their entry, and bounds show it without a scan of the entries.  Each part carries an upper
bound of the distance to its entry and a lower bound of the distance to every other one, each with the
round in which it was measured.  All codebooks since the start are kept.  An entry is at most its net
displacement since the stamped round away from where it was, the norm of the sum of its moves, which is
never more than the sum of their norms.  So a part keeps its entry if

    upper + |own entry's net move| < lower - (largest net move of another entry).

If that fails the distance to the own entry is measured and the test is repeated; if it fails again all
entries are scanned.  The test is strict and bounds are rounded outwards, so ties are always scanned.

The state of a round (whole-number vector, code, bounds, stamps) is a Parquet table in the shared folder;
the table before it is deleted when the new one is complete.  Per-entry changes of sums and counts leave a
task as one row, from the parts that changed entry only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, shared_dir, ship

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Larger whole numbers are held at this magnitude, so that squared distances fit 64 bits.
LARGEST = 1 << 27
#: Bytes of temporaries of one block of rows.
BLOCK_BYTES = 1 << 22
#: Parts into which the rows of one label are dealt when its total is joined.
SALTS = 16
STATE = "vec_id long, label string, vec binary, code binary, upper binary, lower binary, stamps binary, moved array<bigint>"


def whole(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), held within LARGEST."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * values.astype(np.float64)), -LARGEST, LARGEST).astype(np.int32)


def usable(df: DataFrame, vector_col: str) -> DataFrame:
    """Rows whose vector is not null and holds no null or non-finite component."""
    finite = F.forall(vector_col, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return df.filter(F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False)))


def net_moves(history: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[stamp, part, entry]: each entry's net move since the stamp, and the largest one of the other entries."""
    step = history[-1].astype(float) - history.astype(float)
    net = np.sqrt((step * step).sum(axis=-1)) * (1 + 1e-12)
    others = np.repeat(net[..., None, :], net.shape[-1], axis=-2)
    i = np.arange(net.shape[-1])
    others[..., i, i] = 0
    return net, others.max(axis=-1)


def up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + 1e-7)).astype(np.float32), np.float32(np.inf))


def down(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 - 1e-7)).astype(np.float32), np.float32(-np.inf))


class Bounds:
    """Code, bounds and stamps of some vectors: arrays [rows, PARTS]; stamps are numbers of codebooks in the history."""

    def __init__(self, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, stamps: np.ndarray):
        self.code, self.upper, self.lower, self.stamps = code, upper, lower, stamps

    @classmethod
    def fresh(cls, n: int) -> Bounds:
        """Bounds that say nothing: the first round scans every part."""
        return cls(np.zeros((n, PARTS), np.uint8), np.full((n, PARTS), np.inf, np.float32), np.full((n, PARTS), -np.inf, np.float32), np.zeros((n, PARTS, 2), np.uint8))

    def assign(self, x: np.ndarray, history: np.ndarray) -> tuple[int, int]:
        """Moves every part to its nearest entry of the last codebook; returns how many distances to own and how many scans were needed.

        ``x`` is [rows, PARTS, width], ``history`` [codebooks, PARTS, entries, width].
        """
        net, others = net_moves(history)
        now, books = len(history) - 1, history[-1].astype(np.int64)
        own_tests = scans = 0
        for p in range(PARTS):
            code, stamps = self.code[:, p], self.stamps[:, p]
            low = self.lower[:, p] - others[stamps[:, 1], p, code]
            open_ = np.flatnonzero(~(self.upper[:, p] + net[stamps[:, 0], p, code] < low))
            if not len(open_):
                continue
            d = x[open_, p].astype(np.int64) - books[p, code[open_]]
            self.upper[open_, p] = up(np.sqrt((d * d).sum(axis=1).astype(float)))
            stamps[open_, 0] = now
            own_tests += len(open_)
            open_ = open_[~(self.upper[open_, p] < low[open_])]
            scans += len(open_)
            rows = max(1, BLOCK_BYTES // (8 * max(1, books[p].size)))
            for k in range(0, len(open_), rows):
                some = open_[k: k + rows]
                d = x[some, p, None].astype(np.int64) - books[p]
                square = (d * d).sum(axis=2)
                best = square.argmin(axis=1)  # the first of equal ones
                i = np.arange(len(some))
                code[some] = best
                self.upper[some, p] = up(np.sqrt(square[i, best].astype(float)))
                square = np.sqrt(square.astype(float))
                square[i, best] = np.inf
                self.lower[some, p] = down(square.min(axis=1))
                stamps[some] = now
        return own_tests, scans


def changes(x: np.ndarray, before: np.ndarray | None, after: np.ndarray, entries: int) -> np.ndarray:
    """[PARTS, entries, width + 1]: what parts that changed entry add to each entry's sums and count."""
    out = np.zeros((PARTS, entries, x.shape[2] + 1), np.int64)
    for p in range(PARTS):
        some = np.arange(len(x)) if before is None else np.flatnonzero(before[:, p] != after[:, p])
        np.add.at(out[p, :, :-1], after[some, p], x[some, p])
        out[p, :, -1] += np.bincount(after[some, p], minlength=entries)
        if before is not None:
            np.subtract.at(out[p, :, :-1], before[some, p], x[some, p])
            out[p, :, -1] -= np.bincount(before[some, p], minlength=entries)
    return out


def _matrix(col: pa.Array, kind, *shape: int) -> np.ndarray:
    """A copy of equally long binary values as one array."""
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(len(col), *shape).copy()


def _binary(a: np.ndarray) -> pa.Array:
    size, n = (a[0].nbytes if len(a) else 0), len(a)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(size)), pa.py_buffer(np.ascontiguousarray(a).tobytes())])


def _state(ids: pa.Array, labels: pa.Array, x: np.ndarray, b: Bounds) -> pa.RecordBatch:
    none = pa.nulls(len(x), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([ids, labels, _binary(x), _binary(b.code), _binary(b.upper), _binary(b.lower), _binary(b.stamps), none], [f.split()[0] for f in STATE.split(", ")])


def _moved(total: np.ndarray) -> pa.RecordBatch:
    none = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), *[pa.binary()] * 5)]
    return pa.RecordBatch.from_arrays([*none, pa.array([total.ravel().tolist()], pa.list_(pa.int64()))], [f.split()[0] for f in STATE.split(", ")])


def prepared(rows: DataFrame, width: int) -> DataFrame:
    """(vec_id, label, vec) with whole-number vectors of PARTS * width components, zeros added at the end."""
    def run(batches):
        for b in batches:
            col = b.column("vector")
            sizes = np.diff(col.offsets.to_numpy())
            x = np.zeros((len(col), PARTS * width), np.int32)
            if len(col):
                x[:, : sizes[0]] = whole(col.flatten().to_numpy(zero_copy_only=False)).reshape(len(col), -1)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), _binary(x)], ["vec_id", "label", "vec"])

    ship(rows.sparkSession)
    return rows.mapInArrow(run, "vec_id long, label string, vec binary")


def one_round(state: DataFrame, history: np.ndarray, width: int) -> DataFrame:
    """The state after every part is assigned to the last codebook of the history, and each task's changes of sums.

    A state without codes is a first one.
    """
    first = "code" not in state.columns
    sent = state.sparkSession.sparkContext.broadcast(history)  # at most ROUNDS + 1 codebooks of PARTS * ENTRIES entries

    def run(batches):
        books = sent.value
        entries = books.shape[2]
        total = np.zeros((PARTS, entries, width + 1), np.int64)
        for b in batches:
            if not len(b):
                continue
            x = _matrix(b.column("vec"), np.int32, PARTS, width)
            if first:
                have, before = Bounds.fresh(len(x)), None
            else:
                have = Bounds(_matrix(b.column("code"), np.uint8, PARTS), _matrix(b.column("upper"), np.float32, PARTS), _matrix(b.column("lower"), np.float32, PARTS), _matrix(b.column("stamps"), np.uint8, PARTS, 2))
                before = have.code.copy()
            have.assign(x, books)
            total += changes(x, before, have.code, entries)
            yield _state(b.column("vec_id"), b.column("label"), x, have)
        if total.any():
            yield _moved(total)

    return state.mapInArrow(run, STATE)


def summed(state: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The changes of all tasks added up in Spark: one number for each component of the codebooks."""
    rows = state.filter(F.col("moved").isNotNull()).select(F.posexplode("moved").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
    out = np.zeros(int(np.prod(shape)), np.int64)
    for r in rows.collect():  # components of a codebook, whatever the number of vectors
        out[r["at"]] = r["x"]
    return out.reshape(shape)


def start(rows: DataFrame, width: int) -> np.ndarray:
    """[PARTS, entries, width]: the parts of the rows with the smallest ids, ascending; equal ids by their vectors."""
    least = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).select("vector").collect()
    x = np.zeros((len(least), PARTS * width), np.int32)
    for k, r in enumerate(least):
        x[k, : len(r["vector"])] = whole(np.array(r["vector"], np.float64))
    return x.reshape(len(least), PARTS, width).transpose(1, 0, 2)


def _delete(df: DataFrame, path: str) -> None:
    sc = df.sparkSession.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def fit(rows: DataFrame, width: int, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(state after the last assignment, all codebooks since the start) of (vec_id, label, vector) rows."""
    history = start(rows, width)[None]
    state, folder, older = prepared(rows, width), shared_dir(rows.sparkSession), None
    sums = np.zeros((*history.shape[1:3], width + 1), np.int64)
    for r in range(rounds + 1):
        path = f"{folder}/round-{r}"
        one_round(state, history, width).write.parquet(path)
        state = rows.sparkSession.read.schema(STATE).parquet(path)
        if older:
            _delete(rows, older)
        older = path
        if r < rounds:
            sums += summed(state, sums.shape)
            count = sums[..., -1:]
            history = np.concatenate([history, np.where(count > 0, sums[..., :-1] // np.maximum(count, 1), history[-1]).astype(np.int32)[None]])
        state = state.filter(F.col("vec").isNotNull()).drop("moved")
    release(rows.sparkSession)
    return state, history


def vector_codes(vectors: DataFrame, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every row with a usable vector.

    Rows whose vector is null or holds a null or non-finite component are left out.  Repeated ids each give a
    row; a null id sorts after all others.  With fewer rows than ENTRIES there are that many entries.  A
    length that PARTS does not divide is filled up with zeros, which changes no distance; rows whose vector
    has another length than the commonest (of equally common ones the longest) have no parts to compare and
    get a null code and error.  Whole numbers beyond LARGEST are held there.  Further columns are ignored;
    an empty table gives no rows.
    """
    rows = usable(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).alias("vector")), "vector")
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    size = sizes["size"] if sizes else 0
    width = -(-size // PARTS)
    coded, history = fit(rows.filter(F.size("vector") == size), width, rounds)
    sent = rows.sparkSession.sparkContext.broadcast(history[-1])

    def run(batches):
        books = sent.value
        for b in batches:
            x, code = _matrix(b.column("vec"), np.int32, PARTS, width), _matrix(b.column("code"), np.uint8, PARTS)
            d = x.astype(np.int64)
            for p in range(PARTS):
                d[:, p] -= books[p, code[:, p]]
            error = (d * d).sum(axis=(1, 2))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array([c.tobytes().hex() for c in code], pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    out = coded.select("vec_id", "label", "vec", "code").mapInArrow(run, "vec_id long, label string, code string, error long")
    others = rows.filter(F.size("vector") != size).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    out = out.unionByName(others)
    totals = out.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt_of"))
    out = out.withColumn("salt", F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    out = out.join(totals, F.col("label").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("salt_of")))
    digest = hashlib.sha256(",".join(map(str, history[-1].ravel().tolist())).encode()).hexdigest()
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

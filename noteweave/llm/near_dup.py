"""Operator 9: near-duplicate groups by a multi-index Hamming join of b-bit MinHash signatures.

A document's set holds its distinct word shingles as 64-bit hashes.  Its signature is
the lowest 16 bits of 32 min-hashes, split into 8 chunks of 4.  Two signatures that
differ in at most 15 values have, by pigeonhole, a chunk with at most one difference;
so each document is filed under every chunk with every one of its 4 values left out
(32 keys), and any such pair meets under a key.  At similarity 0.85 a pair differs in
4.8 values on average, and in more than 15 with a probability below 1e-5.  For a lower
similarity the signature gets as many more chunks as keep that probability.

Documents with equal sets form a class, and only classes are filed.  Classes that meet
are joined to one candidate group; all pairs in a group are confirmed on the full sets,
block by block, and each block passes on at most a forest of links, never all pairs.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import arrow_rows, id_text, shared_dir, ship, stored
from .graph import components

U64 = np.uint64
CHUNKS, IN_CHUNK = 8, 4
HASHES = CHUNKS * IN_CHUNK
#: Documents in a block; a pair of blocks is compared at once.
BLOCK = 256
#: Shingles of a pair of blocks that are counted at once.
SLAB = 4096
#: Values of all sets of a block that are compared at once.
VALUES = 1 << 20

#: Probability that a pair at the least similarity meets under no key, at most; chunks that can be had for it.
MISS, MOST_CHUNKS = 1e-5, 32

_SEEDS = K.mix(np.arange(1, MOST_CHUNKS * IN_CHUNK + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def hashes_for(percent: int) -> int:
    """Values of a signature, HASHES or more, that hold MISS at the similarity ``percent``."""
    q = 1 - percent / 100
    for chunks in range(CHUNKS, MOST_CHUNKS + 1):
        n = chunks * IN_CHUNK
        if sum(comb(n, k) * q**k * (1 - q) ** (n - k) for k in range(2 * chunks, n + 1)) <= MISS:
            return n
    raise ValueError(f"percent={percent}: no signature of up to {MOST_CHUNKS * IN_CHUNK} values finds such pairs surely enough")


def shingle_sets(data: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and their number by text."""
    data = K.LOWER[data]
    starts, stops, text = K.words(data, ends, K.NOT_SPACE)
    h = K.span_hashes(data, starts, stops)
    counts = K.count_by_text(text, len(ends))
    first = np.cumsum(counts) - counts
    runs = K.window_hashes(h, width)
    keep = np.flatnonzero(text[: len(runs)] == text[width - 1:]) if len(runs) else np.zeros(0, np.int64)
    owner, values = [text[keep]], [runs[keep]]
    for n in range(1, width):  # a shorter text is one shingle
        short = np.flatnonzero(counts == n)
        if len(short):
            owner.append(short)
            values.append(K.mix(K.window_hashes(h, n)[first[short]] + U64(n)))
    owner, values = np.concatenate(owner), np.concatenate(values)
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], K.count_by_text(owner[new], len(ends))


def signatures(sets: np.ndarray, counts: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """uint16 [texts with a set, hashes]."""
    at = (np.cumsum(counts) - counts)[counts > 0]
    out = np.empty((len(at), hashes), np.uint16)
    for i, s in enumerate(_SEEDS[:hashes]):
        out[:, i] = np.minimum.reduceat(K.mix(sets ^ s), at).astype(np.uint16) if len(at) else 0
    return out


def signature_keys(sig: np.ndarray) -> np.ndarray:
    """uint64 [texts, values]: each chunk with each of its values left out."""
    out = []
    for c in range(sig.shape[1] // IN_CHUNK):
        for skip in range(IN_CHUNK):
            key = np.full(len(sig), 1 + c * IN_CHUNK + skip, U64)
            for i in range(IN_CHUNK):
                if i != skip:
                    key = K.mix(key * U64(0x9E3779B97F4A7C15) + sig[:, c * IN_CHUNK + i].astype(U64))
            out.append(key)
    return np.stack(out, axis=1)


def profiles(docs: DataFrame, width: int, hashes: int = HASHES) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sig): the set's size, two sums that name the set, and its signature."""
    def run(batches):
        for b in batches:
            data, ends = K.texts(b.column("text"))
            n, k1, k2, sig = [], [], [], []
            for _, _, part, part_ends in K.pieces(data, ends):
                sets, counts = shingle_sets(part, part_ends, width)
                sums = [np.zeros(len(sets) + 1, U64) for _ in range(2)]
                for s, x in zip(sums, (K.mix(sets + U64(1)), K.mix(sets ^ U64(0x5851F42D4C957F2D)))):
                    np.cumsum(x, out=s[1:])
                stop = np.cumsum(counts)
                n.append(counts)
                k1.append(sums[0][stop] - sums[0][stop - counts])
                k2.append(sums[1][stop] - sums[1][stop - counts])
                full = np.zeros((len(counts), hashes), np.uint16)
                full[counts > 0] = signatures(sets, counts, hashes)
                sig.append(full)
            if n:
                flat = np.ascontiguousarray(np.concatenate(sig)).view(np.uint8).reshape(len(b), -1)
                binary = pa.FixedSizeBinaryArray.from_buffers(pa.binary(flat.shape[1]), len(b), [None, pa.py_buffer(flat)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.concatenate(n).astype(np.int64)), pa.array(np.concatenate(k1).view(np.int64)), pa.array(np.concatenate(k2).view(np.int64)), binary], ["doc_id", "n_shingles", "k1", "k2", "sig"])

    return docs.mapInArrow(run, "doc_id long, n_shingles long, k1 long, k2 long, sig binary")


def key_rows(classes: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            if len(b):
                keys = signature_keys(np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint16).reshape(len(b), -1))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(b.column("rep").to_numpy(), keys.shape[1]))], ["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(run, "key long, rep long")


def _shared(common: np.ndarray, sets: list[np.ndarray]) -> None:
    """Adds how many values each two sets share."""
    n = len(sets)
    values, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    same = np.zeros(len(values) + 1, bool)
    same[1:-1] = values[1:] == values[:-1]
    shared = same[1:] | same[:-1]
    code = np.cumsum(~same[:-1])[shared]
    owner = owner[shared]
    code = np.cumsum(np.r_[False, code[1:] != code[:-1]]) if len(code) else code
    cuts = np.searchsorted(code, np.arange(0, (code[-1] if len(code) else -1) + SLAB + 1, SLAB))
    for k in range(len(cuts) - 1):
        some, who = code[cuts[k]: cuts[k + 1]] - k * SLAB, owner[cuts[k]: cuts[k + 1]]
        if len(some):
            m = np.zeros((n, SLAB if some[-1] + 1 > 256 else 256), np.float32)
            m[who, some] = 1
            common += m @ m.T


def linked(sets: list[np.ndarray], side: np.ndarray | None, percent: int) -> np.ndarray:
    """For each set the first set that it reaches through links; with ``side``, only sets of different sides are compared."""
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    common = np.zeros((n, n), np.float64)
    # sets are ascending: some values at a time, so that memory stays near that of the sets themselves
    steps = max(1, -(-int(sizes.sum()) // VALUES))
    marks = [U64(k * ((1 << 64) // steps)) for k in range(1, steps)]
    cuts = np.array([np.r_[0, np.searchsorted(x, np.array(marks, U64)), len(x)] for x in sets])
    for k in range(steps):
        _shared(common, [x[c[k]: c[k + 1]] for x, c in zip(sets, cuts)])
    link = 100 * common >= percent * (sizes[:, None] + sizes[None, :] - common)
    if side is not None:
        link &= side[:, None] != side[None, :]
    np.fill_diagonal(link, True)
    label = np.arange(n)
    while True:
        new = np.where(link, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def confirm(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join what is linked, from rows (grp, i, j, side, rep, shingles) of pairs of blocks."""
    def run(batches):
        held, key = [], None

        def done():
            if key is None or len(held) < 2:
                return [], []
            side = None if key[1] == key[2] else np.array([x[0] for x in held])
            reps = np.array([x[1] for x in held])
            label = linked([np.frombuffer(x[2], U64) for x in held], side, percent)
            ties = np.flatnonzero(label != np.arange(len(label)))
            return reps[ties].tolist(), reps[label[ties]].tolist()

        for b in batches:
            out_a, out_b = [], []
            for row in zip(*(b.column(c).to_pylist() for c in ("grp", "i", "j", "side", "rep")), (x.as_py() for x in b.column("shingles"))):
                if row[:3] != key:
                    a, z = done()
                    out_a += a
                    out_b += z
                    held, key = [], row[:3]
                held.append(row[3:])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
        a, z = done()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row.

    Words are lower-cased (A-Z) runs without white space; a text of fewer than ``width`` words is one
    shingle; texts are linked if their sets have 100 * common >= ``percent`` * all.  component_id is the
    smallest id reached, kept is doc_id = component_id.  Null and empty texts have no shingles and no
    links.  Rows with one id count as linked; a row without an id is returned with a null component,
    kept and linked with nothing.  Further columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    ship(spark)
    folder = shared_dir(spark)
    rows = id_text(docs, id_col, text_col)
    known = stored(profiles(rows, width, hashes_for(percent)), folder, "profiles")
    classes = known.filter("n_shingles > 0 and doc_id is not null").groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min("sig").alias("sig"))
    classes = stored(classes, folder, "classes")

    keys = stored(key_rows(classes), folder, "keys")
    buckets = stored(keys.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("last")).filter("pivot <> last").drop("last"), folder, "buckets")
    meets = keys.join(buckets, "key").filter("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    groups = stored(components(meets, folder, "candidates"), folder, "groups")

    sizes = groups.groupBy(F.col("component").alias("grp")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    sizes = stored(sizes, folder, "sizes")
    placed = groups.select(F.col("node").alias("rep"), F.col("component").alias("grp")).join(sizes, "grp")
    placed = stored(placed.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int")), folder, "placed")
    # the members grow with the corpus: the same join at every size, never a broadcast
    sets = rows.hint("merge").join(placed, rows.doc_id == placed.rep).select("rep", "grp", "blocks", "own", "text")

    def run(batches):
        for b in batches:
            data, ends = K.texts(b.column("text"))
            out = []
            for _, _, part, part_ends in K.pieces(data, ends):
                values, counts = shingle_sets(part, part_ends, width)
                raw, stop = values.tobytes(), 8 * np.cumsum(counts)
                out += [raw[s:e] for s, e in zip(stop - 8 * counts, stop)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("rep", "grp", "blocks", "own")), pa.array(out, pa.binary())], ["rep", "grp", "blocks", "own", "shingles"])

    sets = sets.mapInArrow(run, "rep long, grp long, blocks int, own int, shingles binary")
    pairs = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.col("own").alias("side"), "rep", "shingles")
    # a block is compared with itself once; a pair of different blocks gets both of them
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with arrow_rows(spark, BLOCK):  # a row is a text or its whole set
        links = stored(confirm(pairs.repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j", "rep"), percent), folder, "links")

    found = stored(components(links, folder, "links"), folder, "components")
    ends = classes.select("k1", "k2", F.col("n_shingles").alias("n"), "rep").join(found, classes.rep == found.node, "left").select("k1", "k2", "n", F.coalesce("component", "rep").alias("smallest"))
    ends = stored(ends, folder, "ends")
    out = known.alias("d").join(ends.alias("e"), F.expr("d.k1 = e.k1 and d.k2 = e.k2 and d.n_shingles = e.n and d.doc_id is not null"), "left")
    out = out.select("d.doc_id", "d.n_shingles", F.expr("case when d.doc_id is not null then coalesce(e.smallest, d.doc_id) end").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))

"""Interval sweeps: C3 and V4 in time linear in their rows, on documents of any density.

Intervals of a document are dealt to bins of its characters, a long one to
every bin it reaches, so that one document spreads over many tasks.  A
partition holds whole bins in order; numpy sweeps a run of bins at once with
sorted searches, and no pair of rows is ever formed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BIN = 4096


def bin_of(pos: Column | str) -> Column:
    return F.floor((F.col(pos) if isinstance(pos, str) else pos) / BIN).cast("long")


def _whole_bins(rows: DataFrame, order: list[str], schema: str, work: Callable[[pa.Table, np.ndarray], pa.Table]) -> DataFrame:
    """``work(rows, bin number of each row)`` on runs of whole (doc_id, bin) groups, sorted by ``order`` inside them."""
    out_schema = T.StructType([rows.schema["doc_id"], *T._parse_datatype_string(schema).fields])

    def run(batches):
        left = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if left is None else pa.concat_tables([left, t]).combine_chunks()
            new = _starts(t)
            last = int(new[-1]) if len(new) else 0
            if last:
                yield from done(t.slice(0, last)).to_batches()
            left = t.slice(last)
        if left is not None and len(left):
            yield from done(left).to_batches()

    def done(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        mark = np.zeros(len(t), np.int64)
        mark[_starts(t)[1:]] = 1
        return work(t, np.cumsum(mark))

    return rows.repartition("doc_id", "bin").sortWithinPartitions("doc_id", "bin", *order).mapInArrow(run, out_schema)


def _starts(t: pa.Table) -> np.ndarray:
    """Rows at which a (doc_id, bin) group starts."""
    import pyarrow.compute as pc

    doc = pc.dictionary_encode(t["doc_id"], null_encoding="encode").combine_chunks()
    doc = (doc.chunk(0) if isinstance(doc, pa.ChunkedArray) else doc).indices.to_numpy(zero_copy_only=False)
    at = t["bin"].to_numpy()
    return np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])]) if len(t) else np.zeros(0, np.int64)


def _ints(t: pa.Table, name: str) -> np.ndarray:
    return t[name].to_numpy().astype(np.int64)


# ---------------------------------------------------------------- C3

def sentence_of(mentions: DataFrame, sentences: DataFrame) -> DataFrame:
    """``(doc_id, ann_no, sent_no)`` of the first sentence (by start, then number) that holds the
    mention's start or end (both ends inclusive); mentions in no sentence are left out, as are rows without places.

    Of the sentences sorted by start, the first whose end reaches a place is where the running maximum of the
    ends does; it holds the place if it starts early enough, and if not, no later one does.
    """
    s = sentences.where(F.col("start_pos") <= F.col("end_pos")).select("doc_id", F.lit(0).alias("kind"), F.col("start_pos").cast("long").alias("a"), F.col("end_pos").cast("long").alias("b"), F.col("sent_no").cast("long").alias("id"))
    s = s.withColumn("bin", F.explode(F.sequence(bin_of("a"), bin_of("b"))))
    m = mentions.select("doc_id", F.lit(1).alias("kind"), F.explode(F.array(F.col("start_pos").cast("long"), F.col("end_pos").cast("long"))).alias("a"), F.col("ann_no").cast("long").alias("id")).where(F.col("a").isNotNull())
    m = m.select("doc_id", "kind", "a", F.col("a").alias("b"), "id", bin_of("a").alias("bin"))

    def work(t: pa.Table, group: np.ndarray) -> pa.Table:
        kind, a, b, ident = (_ints(t, c) for c in ("kind", "a", "b", "id"))
        sent, place = kind == 0, kind == 1
        far = int(max(b.max(initial=0), 0)) + 2  # places of a group come after all of the group before
        ends = np.maximum.accumulate(b[sent] + 1 + group[sent] * far) if sent.any() else np.zeros(0, np.int64)
        first = np.searchsorted(ends, a[place] + 1 + group[place] * far)
        ok = first < len(ends)
        some = np.where(ok, first, 0)
        if sent.any():
            ok &= (group[sent][some] == group[place]) & (a[sent][some] <= a[place])
        rows = np.flatnonzero(place)[ok]
        got = some[ok]
        return pa.table([t["doc_id"].take(pa.array(rows)), pa.array(ident[rows]), pa.array(a[sent][got] if len(got) else np.zeros(0, np.int64)), pa.array(ident[sent][got] if len(got) else np.zeros(0, np.int64))],
                        names=["doc_id", "ann_no", "start", "sent_no"])

    found = _whole_bins(s.unionByName(m), ["kind", "a", "id"], "ann_no long, start long, sent_no long", work)
    first = found.groupBy("doc_id", "ann_no").agg(F.min(F.struct("start", "sent_no")).alias("f"))
    kinds = {"ann_no": mentions.schema["ann_no"].dataType, "sent_no": sentences.schema["sent_no"].dataType}
    return first.select("doc_id", F.col("ann_no").cast(kinds["ann_no"]).alias("ann_no"), F.col("f.sent_no").cast(kinds["sent_no"]).alias("sent_no"))


# ---------------------------------------------------------------- V4

def _largest(rank: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Largest value of each range [lo, hi) that is not empty, from maxima of runs of powers of two."""
    table, width = [rank], 1
    while width * 2 <= len(rank):
        x = table[-1]
        table.append(np.maximum(x[:-width], x[width:]))
        width *= 2
    level = np.frexp((hi - lo).astype(float))[1] - 1
    out = np.zeros(len(lo), np.int64)
    for k in np.unique(level):
        own = level == k
        out[own] = np.maximum(table[k][lo[own]], table[k][hi[own] - (1 << int(k))])
    return out


def covered(view: DataFrame) -> DataFrame:
    """V4: ids ``(doc_id, idx)`` removed by the overlap rule from ``(doc_id, idx, s, e)``.

    Sorted by start (then idx), each annotation and the run of later ones that start before it ends are a
    group; a group keeps its longest member (of equal ones the last).  An annotation goes if some group that
    holds it keeps another: if it is in more groups than keep it.  Both numbers are sums, so bins give their
    parts: of each group its longest member in the bin, and of each annotation the groups that reach it.
    """
    parts = _parts(view)
    groups = parts.where("reach = 0").groupBy("doc_id", "idx").agg(
        F.max(F.struct(F.col("b_len").alias("len"), F.col("b_s").alias("s"), F.col("b_idx").alias("idx"))).alias("other"),
        F.max(F.struct("len", "s", "idx")).alias("own"))
    groups = groups.select("doc_id", "idx", F.greatest("own", "other")["idx"].alias("keeps"))
    marks = (parts.where("reach > 0").select("doc_id", "idx", F.col("reach").alias("n"))
             .unionByName(groups.select("doc_id", "idx", F.lit(1).cast("long").alias("n")))
             .unionByName(groups.select("doc_id", F.col("keeps").alias("idx"), F.lit(-1).cast("long").alias("n"))))
    gone = marks.groupBy("doc_id", "idx").agg(F.sum("n").alias("n")).where("n > 0")
    return gone.select("doc_id", F.col("idx").cast(view.schema["idx"].dataType).alias("idx"))


def _parts(view: DataFrame) -> DataFrame:
    """The bins' parts of both sums: groups (``reach`` 0) with a longest member, and annotations with the groups that reach them.

    In a bin that no annotation enters or leaves (and that has no idx twice) both sums are whole, so it gives
    only the annotations that go, with their difference as ``reach``; few rows are grouped again.
    """
    a = view.select("doc_id", F.col("idx").cast("long").alias("idx"), F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e")).where(F.col("s").isNotNull() & F.col("e").isNotNull())
    rows = a.withColumn("bin", F.explode(F.sequence(bin_of("s"), bin_of(F.greatest(F.col("e") - 1, F.col("s"))))))

    def work(t: pa.Table, group: np.ndarray) -> pa.Table:
        idx, s, e, own_bin = _ints(t, "idx"), _ints(t, "s"), _ints(t, "e"), _ints(t, "bin")
        home = s // BIN == own_bin  # rows that start in the bin; the others reach it from before
        m = np.flatnonzero(home)
        far = BIN + 1
        key = group[m] * far + (s[m] - own_bin[m] * BIN)
        order = np.cumsum(home)  # members up to and including a row: those of home rows come in order of start
        first = np.searchsorted(group[m], group)
        lo = np.where(home, order, first)
        hi = np.searchsorted(key, group * far + np.clip(e - own_bin * BIN, 0, BIN))
        some = np.flatnonzero(hi > lo)
        rank = np.empty(len(m), np.int64)
        by = np.lexsort((idx[m], s[m], e[m] - s[m]))
        rank[by] = np.arange(len(m))
        top = _largest(rank, lo[some], hi[some]) if len(some) else some
        reach = np.zeros(len(m) + 1, np.int64)
        np.add.at(reach, lo[some], 1)
        np.add.at(reach, hi[some], -1)
        reach = np.cumsum(reach[:-1])
        # bins whose sums are whole
        whole = np.ones(int(group[-1]) + 1 if len(group) else 0, bool)
        whole[group[~home | (e > (own_bin + 1) * BIN)]] = False
        twice = np.lexsort((idx, group))
        twice = twice[1:][(group[twice][1:] == group[twice][:-1]) & (idx[twice][1:] == idx[twice][:-1])]
        whole[group[twice]] = False
        own = whole[group[some]]
        at = order[some[own]] - 1  # among the home rows
        reach[at] += 1
        reach -= np.bincount(by[np.maximum(rank[at], top[own])], minlength=len(m))
        some, best = some[~own], m[by[top[~own]]]
        held = np.flatnonzero(reach)
        rows = np.r_[some, m[held]]
        none = np.zeros(len(held), np.int64)
        cols = [np.r_[np.zeros(len(some), np.int64), reach[held]], idx[rows], s[rows], e[rows] - s[rows], np.r_[idx[best], none], np.r_[s[best], none], np.r_[(e - s)[best], none]]
        return pa.table([t["doc_id"].take(pa.array(rows)), *map(pa.array, cols)], names=["doc_id", "reach", "idx", "s", "len", "b_idx", "b_s", "b_len"])

    return _whole_bins(rows, ["s", "idx"], "reach long, idx long, s long, len long, b_idx long, b_s long, b_len long", work)

"""Operator 3: bytes of repeated 50-byte strings, by merged Burrows-Wheeler transforms.

A string of ``length`` bytes is filed by its minimizer, the 20-byte piece of least hash
in it, so equal strings meet wherever they stand.  Neighbouring strings with one
minimizer form a run, a little longer than one string; runs whose minimizer no other
document has cannot repeat and stay behind.  A partition of minimizers gets each
distinct run once (runs are combined in the shard first), with the least doc_id.

There each source shard's runs have their transform, from a suffix sort of that shard
alone.  The transforms are merged by iterative interleave refinement: starting from the
shards one after another, each round moves the interleave through the LF mapping and so
orders all suffixes by two more symbols, without sorting them anew.  Where neighbours
part is their common prefix; what is still together after ``length`` symbols is a
repeated interval, and its least doc_id goes back to every shard that has the run.

Minimizers with very many different runs are split: their strings are filed one by one
by their own hash, so no group grows with the corpus in one task.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import shared_dir
from .shards import SHARD_BYTES, Shards, pack, unpack

U64 = np.uint64
GRAM = 20
#: Text bytes that a partition of minimizers stands for, at most.
PARTITION_BYTES = 32 << 20


class Limits(NamedTuple):
    """Sizes that bound memory; the result does not depend on them."""

    #: Bytes of a shard, and bytes scanned at once.
    shard: int = SHARD_BYTES // 2
    segment: int = 1 << 17
    #: Symbols merged at once; runs of different minimizers need no common merge.
    merge: int = 1 << 16
    #: Different runs of a minimizer beyond which its strings are filed one by one.
    hot: int = 4096


END = 0xFF  # never a byte of UTF-8
KEY_BITS = U64(40)
KEY_MASK = U64((1 << 40) - 1)
NONE = np.iinfo(np.int64).max
#: The lower half of a number; a merge has far fewer symbols.
LOW = np.int64((1 << 32) - 1)


def coded(h: np.ndarray, parts: int) -> np.ndarray:
    """Partition and 40-bit key of a hash in one number; mixed anew, as minimizers are the low hashes."""
    h = K.mix(h + U64(0x9E3779B97F4A7C15))
    return ((((h >> U64(32)) * U64(parts)) >> U64(32)) << KEY_BITS) | (h & KEY_MASK)


def runs(data: np.ndarray, ends: np.ndarray, length: int, parts: int, segment: int) -> tuple[np.ndarray, ...]:
    """(code, hash, start, strings in it, text) of each run, in order."""
    found = []
    gram = min(GRAM, length)
    width = length - gram + 1
    for a in range(0, len(data) - length + 1, segment):
        part = data[a: a + segment + length - 1]
        n = len(part)
        up, down = K.powers(n + 1)
        sums = np.zeros(n + 1, U64)
        np.cumsum(K.byte_codes(3)[part] * up[:n], out=sums[1:])
        grams = n - gram + 1
        h = K.mix((sums[gram:] - sums[:grams]) * down[:grams])
        mask = U64((1 << 22) - 1)
        least = K.sliding_min((h & ~mask) | np.arange(grams, dtype=U64), width)
        where = (least & mask).astype(np.int64)
        across = np.zeros(len(where) + 1, np.int32)  # strings that would cross into the next text
        cuts = ends[(ends > a) & (ends < a + n)] - a
        np.add.at(across, np.clip(cuts - length + 1, 0, len(where)), 1)
        np.add.at(across, np.minimum(cuts, len(where)), -1)
        inside = np.cumsum(across[:-1]) == 0
        new = np.ones(len(where) + 1, bool)
        new[1:-1] = (where[1:] != where[:-1]) | ~inside[1:] | ~inside[:-1]
        edges = np.flatnonzero(new)
        start, stop = edges[:-1], edges[1:]
        ok = inside[start]
        start, stop = start[ok], stop[ok]
        whole = K.mix((sums[stop + length - 1] - sums[start]) * down[start] + (stop - start).astype(U64))
        found.append((coded(h[where[start]], parts), whole, start + a, stop - start, np.searchsorted(ends, start + a, "right")))
    if not found:
        return np.zeros(0, U64), np.zeros(0, U64), *(np.zeros(0, np.int64) for _ in range(3))
    return tuple(np.concatenate(x) for x in zip(*found))


def small(code: np.ndarray) -> np.ndarray:
    """The keys in 5 bytes each."""
    return np.ascontiguousarray((code & KEY_MASK)[:, None].view(np.uint8)[:, :5]).ravel()


def large(keys: np.ndarray) -> np.ndarray:
    out = np.zeros((len(keys) // 5, 8), np.uint8)
    out[:, :5] = keys.reshape(-1, 5)
    return out.view(U64).ravel()


def by_part(code: np.ndarray) -> list[tuple[int, int, int]]:
    """(partition, first, last + 1) of ascending codes."""
    part = (code >> KEY_BITS).astype(np.int64)
    first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else np.zeros(0, np.int64)
    return list(zip(part[first].tolist(), first.tolist(), [*first[1:].tolist(), len(part)]))


def grouped(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by ``keys`` (the first counts most) and the places in it where a group starts."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        x = k[order]
        new[1:] |= x[1:] != x[:-1]
    return order, np.flatnonzero(new)


class Shard:
    """Runs of the texts that have an id."""

    def __init__(self, rows: pa.RecordBatch, id_col: str, text_col: str, length: int, parts: int, segment: int):
        self.length, self.parts, self.segment = length, parts, segment
        self.data, self.ends = K.texts(rows.column(text_col))
        ids = rows.column(id_col).cast(pa.int64())
        self.named = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()

    def scan(self) -> None:
        code, whole, start, count, text = runs(self.data, self.ends, self.length, self.parts, self.segment)
        ok = self.named[text]
        self.code, self.whole, self.start, self.count, self.text = (x[ok] for x in (code, whole, start, count, text))

    def ask_shared(self):
        """Round 1: each distinct minimizer, and whether two documents here have it."""
        code, at = self.distinct_codes()
        order, first = at
        if not len(code):
            return
        own = self.ids[self.text[order]]
        many = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
        for p, a, z in by_part(code):
            yield p, pack(small(code[a:z]), many[a:z])

    def distinct_codes(self):
        order, first = grouped(self.code)
        return self.code[order][first], (order, first)

    def keep_shared(self, answers: dict) -> None:
        """After round 1: only runs whose minimizer several documents have."""
        code, (order, first) = self.distinct_codes()
        flags = np.concatenate([np.unpackbits(answers[p][0], count=z - a) for p, a, z in by_part(code)]).astype(bool) if len(code) else np.zeros(0, bool)
        ok = np.zeros(len(self.code), bool)
        ok[order] = np.repeat(flags, np.diff(np.r_[first, len(order)]))
        self.code, self.whole, self.start, self.count, self.text = (x[ok] for x in (self.code, self.whole, self.start, self.count, self.text))

    def use(self, kept: list[np.ndarray]) -> None:
        """The shared runs, as stored after round 1."""
        self.code, self.whole, self.start, self.count, self.text = kept
        # distinct runs: their codes, hashes, an occurrence, and the run of each occurrence
        order, first = grouped(self.code, self.whole)
        self.run_code, self.run_hash, self.run_at = self.code[order][first], self.whole[order][first], order[first]
        self.run_of = np.empty(len(order), np.int64)
        self.run_of[order] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(order)]))
        self.run_id = np.minimum.reduceat(self.ids[self.text[order]], first) if len(first) else np.zeros(0, np.int64)

    def ask_owners(self):
        """Round 2: each distinct run with the least id here."""
        for p, a, z in by_part(self.run_code):
            yield p, pack(small(self.run_code[a:z]), self.run_hash[a:z], self.run_id[a:z])

    def make_units(self, answers: dict) -> None:
        """After round 2: units are runs, or the single strings of runs with a hot minimizer."""
        got = [answers[p] for p, _, _ in by_part(self.run_code)]
        mark = np.concatenate([g[0] for g in got]) if got else np.zeros(0, np.uint8)
        self.run_id = np.concatenate([g[1] for g in got]) if got else np.zeros(0, np.int64)
        self.hot = (mark & 2) > 0
        own = (mark & 1) > 0
        cold, hot = np.flatnonzero(~self.hot), np.flatnonzero(self.hot)
        at, n = self.start[self.run_at], self.count[self.run_at]
        single = K.ranges(at[hot], n[hot])
        h = string_hashes(self.data, single, self.length, self.segment)
        code = np.concatenate([self.run_code[cold], coded(h, self.parts)])
        key = np.concatenate([self.run_hash[cold], h])
        start = np.concatenate([at[cold], single])
        count = np.concatenate([n[cold], np.ones(len(single), np.int64)])
        least = np.concatenate([self.run_id[cold], np.repeat(self.run_id[hot], n[hot])])
        owned = np.concatenate([own[cold], np.repeat(own[hot], n[hot])])
        order, first = grouped(code, key)
        size = np.diff(np.r_[first, len(order)])
        self.unit_code, self.unit_key, self.unit_at, self.unit_n = (x[order][first] for x in (code, key, start, count))
        self.unit_id = np.minimum.reduceat(least[order], first) if len(first) else least
        self.unit_own = np.maximum.reduceat(owned[order], first) if len(first) else owned
        place = np.empty(len(order), np.int64)
        place[order] = np.repeat(np.arange(len(first)), size)
        #: The first unit of each run; the units of a hot run's strings are listed in turn.
        self.hot_units = place[len(cold):]
        self.run_unit = np.empty(len(mark), np.int64)
        self.run_unit[cold] = place[: len(cold)]
        self.run_unit[hot] = np.cumsum(n[hot]) - n[hot]

    def ask_intervals(self):
        """Round 3: each unit with its least id, and its bytes from the shard that owns it."""
        for p, a, z in by_part(self.unit_code):
            own = self.unit_own[a:z]
            at, size = self.unit_at[a:z][own], self.unit_n[a:z][own] + self.length - 1
            yield p, pack(small(self.unit_code[a:z]), self.unit_key[a:z], self.unit_id[a:z], self.unit_n[a:z].astype(np.uint16), own, self.data[K.ranges(at, size)])

    def removed(self, answers: dict) -> np.ndarray:
        """Whether each byte is covered by a string of a document with a smaller id."""
        got = [answers[p] for p, _, _ in by_part(self.unit_code)]
        steps, spans, least = (np.concatenate([g[i].astype(np.int64) for g in got]) if got else np.zeros(0, np.int64) for i in range(3))
        first = np.cumsum(steps) - steps  # of each unit, in the lists of (strings, least id)
        begin = np.cumsum(spans) - spans
        begin = begin - np.repeat(begin[first], steps) if len(first) else begin  # first string of each step, within its unit
        hot = self.hot[self.run_of]
        edge = np.zeros(len(self.data) + 1, np.int32)

        def mark(unit, start, text):
            step = K.ranges(first[unit], steps[unit])
            where = np.repeat(start, steps[unit]) + begin[step]
            ok = least[step] < np.repeat(self.ids[text], steps[unit])
            np.add.at(edge, where[ok], 1)
            np.add.at(edge, where[ok] + spans[step][ok] + self.length - 1, -1)

        c = np.flatnonzero(~hot)
        mark(self.run_unit[self.run_of[c]], self.start[c], self.text[c])
        c = np.flatnonzero(hot)
        n = self.count[c]
        mark(self.hot_units[K.ranges(self.run_unit[self.run_of[c]], n)], K.ranges(self.start[c], n), np.repeat(self.text[c], n))
        return np.cumsum(edge[:-1]) > 0


def string_hashes(data: np.ndarray, starts: np.ndarray, length: int, segment: int) -> np.ndarray:
    out = np.empty(len(starts), U64)
    block = (starts // segment) if len(starts) else starts
    for k in np.unique(block):
        own = block == k
        a = int(k) * segment
        out[own] = K.span_hashes(data[a: a + segment + length], starts[own] - a, starts[own] - a + length, 4)
    return out


def answer_shared(messages: list[bytes]):
    got = [unpack(m) for m in messages]
    keys = np.concatenate([large(g[0]) for g in got])
    many = np.concatenate([g[1] for g in got])
    _, inverse, n = np.unique(keys, return_inverse=True, return_counts=True)
    shared = ((n > 1) | (np.bincount(inverse, many, len(n)) > 0))[inverse]
    at = 0
    for g in got:
        yield pack(np.packbits(shared[at: at + len(g[1])]))
        at += len(g[1])


def answer_owners(messages: list[bytes], hot: int):
    got = [unpack(m) for m in messages]
    size = [len(g[1]) for g in got]
    key, run, least = np.concatenate([large(g[0]) for g in got]), np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])
    source = np.repeat(np.arange(len(got)), size)
    order = np.lexsort((source, least, run, key))
    k, r = key[order], run[order]
    new_key = np.r_[True, k[1:] != k[:-1]]
    new_run = new_key | np.r_[True, r[1:] != r[:-1]]
    group = np.cumsum(new_run) - 1
    variety = np.bincount(np.cumsum(new_key)[new_run] - 1)
    mark = new_run.astype(np.uint8) | (2 * (variety > hot)[np.cumsum(new_key) - 1]).astype(np.uint8)
    out_mark, out_least = np.empty(len(order), np.uint8), np.empty(len(order), np.int64)
    out_mark[order], out_least[order] = mark, least[order][new_run][group]
    at = 0
    for n in size:
        yield pack(out_mark[at: at + n], out_least[at: at + n])
        at += n


def merged_intervals(text: np.ndarray, sizes: np.ndarray, source: np.ndarray, length: int, most: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the sources' transforms until suffixes are in order by ``length`` symbols.

    ``text`` holds strings of ``sizes`` bytes, each closed by END, grouped by ascending ``source``.  Returns
    the place of each suffix in the text in merged order, its interval (suffixes of one interval agree on
    ``length`` symbols) and the common prefix with the suffix before it: exact to the two symbols that a
    round adds, that is rounded down to an even number, and ``length`` within an interval.  With ``most`` of 4
    a round adds four symbols where their different strings can be numbered by 16 bits, which halves the rounds
    and rounds the prefixes down to multiples of four.
    """
    n = len(text)
    ends = np.cumsum(sizes + 1)
    begin = ends - sizes - 1
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    after[ends - 1], before[begin] = begin, ends - 1  # strings are read around

    # the transform of each source: its own rotations in order, by doubling among those not yet parted
    number = np.cumsum(np.r_[False, source[1:] != source[:-1]])
    owner = np.repeat(number.astype(np.uint16 if number[-1] < 1 << 16 else np.int64), sizes + 1)
    rank, ahead = text.astype(U64), after
    for bits in (8, 16, 32):
        rank = (rank << U64(bits)) | rank[ahead]
        ahead = ahead[ahead]
    order = np.argsort(rank)
    order = order[np.argsort(owner[order], kind="stable")]
    key, who = rank[order], owner[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (who[1:] != who[:-1])]
    rank = np.empty(n, np.int64)
    while True:
        first = np.flatnonzero(new)
        group = np.repeat(first, np.diff(np.r_[first, n]))  # a rank never changes once its rotation is alone
        rank[order] = group
        same = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(same):
            break
        place = order[same]
        pair = (group[same].astype(U64) << U64(32)) | rank[ahead[place]].astype(U64)
        move = np.argsort(pair)
        order[same], pair = place[move], pair[move]
        parted = np.r_[True, pair[1:] != pair[:-1]]
        if np.count_nonzero(parted) == np.count_nonzero(new[same]):
            break  # equal strings of one source: no symbol parts them
        new[same] = parted
        ahead = ahead[ahead]

    row = np.empty(n, np.int64)
    row[order] = np.arange(n)
    symbol = text[before[order]]  # the transforms, one source after another
    last = row[before[order]]  # LF mapping, within each source
    pair = (symbol[last].astype(np.uint16) << np.uint16(8)) | symbol
    twice = last[last]

    # what a row adds to its prefix and the row it comes from, together, so that a round reads them at once
    by_step = {2: (pair.astype(np.int64) << 32) | twice, 1: (symbol.astype(np.int64) << 32) | last}
    if most >= 4:
        four, fours = np.unique((pair[twice].astype(np.uint32) << np.uint32(16)) | pair, return_inverse=True)
        if len(four) <= 1 << 16:
            by_step[4] = (fours << 32) | twice[twice]

    rows = np.arange(n)  # the interleave: rows of all sources in merged order
    block = np.zeros(n, np.int64)
    prefix = np.full(n, length, np.int32)
    old = np.zeros(n, bool)
    depth = 0
    while depth < length:
        step = max(k for k in by_step if k <= length - depth)
        got = by_step[step].take(rows)
        move = np.argsort((got >> 32).astype(np.uint8 if step == 1 else np.uint16), kind="stable")
        block |= got & ~LOW
        block = block.take(move)
        rows = (got & LOW).take(move)
        new = np.zeros(n, bool)
        np.not_equal(block[1:], block[:-1], out=new[1:])
        prefix[new & ~old] = depth  # rows that have parted stay so
        old = new
        block = np.cumsum(new, dtype=np.int64)
        settled = depth and block[-1] == count
        count, depth = block[-1], depth + step
        if settled:
            break  # every prefix goes on in one way only
    return order[rows], block, prefix


def answer_intervals(messages: list[bytes], length: int, most: int):
    got = [unpack(m) for m in messages]
    size = [len(g[1]) for g in got]
    if not sum(size):
        yield from (pack(np.zeros(0, np.uint8), np.zeros(0, np.uint16), np.zeros(0, np.int64)) for _ in got)
        return
    key, unit, least, strings = (np.concatenate([large(g[0]) if i == 0 else g[i] for g in got]) for i in range(4))
    own, data = np.concatenate([g[4] for g in got]), np.concatenate([g[5] for g in got])
    source = np.repeat(np.arange(len(got)), size)
    held = np.where(own, strings.astype(np.int64) + length - 1, 0)
    at = np.cumsum(held) - held
    # each distinct unit once: the bytes from its first owner, the least id of all
    order = np.lexsort((~own, unit, key))
    new = np.r_[True, (key[order][1:] != key[order][:-1]) | (unit[order][1:] != unit[order][:-1])]
    first = np.flatnonzero(new)
    take = order[first]
    value = np.minimum.reduceat(least[order], first)
    unit_of = np.empty(len(order), np.int64)
    unit_of[order] = np.cumsum(new) - 1

    windows = strings[take].astype(np.int64)
    place = np.cumsum(windows) - windows
    lowest = np.empty(int(windows.sum()), np.int64)
    symbols = np.cumsum(windows + length)
    new_key = np.r_[True, key[take][1:] != key[take][:-1]]
    cuts = [0]
    for k in np.flatnonzero(new_key)[1:].tolist() + [len(take)]:  # whole minimizers, up to about ``most`` symbols
        if k == len(take) or symbols[k - 1] - (symbols[cuts[-1] - 1] if cuts[-1] else 0) >= most:
            cuts.append(k)
    for a, z in zip(cuts[:-1], cuts[1:]):
        some = np.arange(a, z)
        some = some[np.argsort(source[take[some]], kind="stable")]
        n = held[take[some]]
        text = np.full(int((n + 1).sum()), END, np.uint8)
        begin = np.cumsum(n + 1) - n - 1
        text[K.ranges(begin, n)] = data[K.ranges(at[take[some]], n)]
        where, block, _ = merged_intervals(text, n, source[take[some]], length, 4)
        string = np.repeat(np.arange(len(n)), n + 1)[where]
        offset = where - begin[string]
        full = offset <= n[string] - length
        worth = np.where(full, value[some][string], NONE)
        least_in = np.minimum.reduceat(worth, np.flatnonzero(np.r_[True, block[1:] != block[:-1]]))[block]
        lowest[place[some][string[full]] + offset[full]] = least_in[full]

    # steps of equal least ids along each unit
    step = np.zeros(len(lowest), bool)
    step[place] = True
    step[1:] |= lowest[1:] != lowest[:-1]
    starts = np.flatnonzero(step)
    spans = np.diff(np.r_[starts, len(lowest)])
    steps = np.add.reduceat(step, place).astype(np.int64)
    begin = np.cumsum(steps) - steps
    done = 0
    for n in size:
        mine = unit_of[done: done + n]
        done += n
        which = K.ranges(begin[mine], steps[mine])
        yield pack(steps[mine].astype(np.uint16), spans[which].astype(np.uint16), lowest[starts[which]])


def remove_repeats(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", names: dict[str, str] | None = None, as_text: bool = False, limits: Limits = Limits()) -> DataFrame:
    """All columns of ``docs`` and kept (the remaining bytes; with ``as_text`` the characters left whole) and spans (start and end of each removed run, in bytes).

    A byte goes if a ``length``-byte string over it also starts in a document with a smaller id; strings are
    judged on the input.  A null text is empty; a row without an id loses nothing and takes nothing from
    others, and rows of one id take nothing from each other.  ``names`` renames the two columns where
    ``docs`` has columns of these names.  An empty table gives an empty result.
    """
    spark = docs.sparkSession
    names = {"kept": "kept", "spans": "spans"} | (names or {})
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PARTITION_BYTES))
    shards = Shards(docs, text_col, shared_dir(spark), parts, limits.shard)

    def shard(rows, answers=()):
        s = Shard(rows, id_col, text_col, length, parts, limits.segment)
        if not answers:
            s.scan()
        for step, got in zip((lambda a: s.use(a[0]), s.make_units), answers):
            step(got)
        return s

    def shared_runs(rows, answers):
        s = shard(rows)
        s.keep_shared(answers[0])
        return pack(s.code, s.whole, s.start, s.count, s.text)

    one = shards.ask("shared", [], lambda rows, _: shard(rows).ask_shared(), answer_shared)
    kept = shards.derive("runs", [one], shared_runs)
    two = shards.ask("owners", [kept], lambda rows, a: shard(rows, a).ask_owners(), lambda m: answer_owners(m, limits.hot))
    three = shards.ask("intervals", [kept, two], lambda rows, a: shard(rows, a).ask_intervals(), lambda m: answer_intervals(m, length, limits.merge))
    schema = T.StructType([*docs.schema.fields, T.StructField(names["kept"], T.StringType() if as_text else T.BinaryType()), T.StructField(names["spans"], T._parse_datatype_string("array<struct<start:long,stop:long>>"))])

    def make(rows, answers):
        s = shard(rows, answers[:2])
        gone = s.removed(answers[2])
        left, spans = [], []
        for a, z in zip(np.r_[0, s.ends[:-1]].tolist(), s.ends.tolist()):
            own = gone[a:z]
            turn = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
            rest = s.data[a:z][~own].tobytes()
            left.append(rest.decode("utf-8", "ignore") if as_text else rest)
            spans.append([{"start": x, "stop": y} for x, y in zip(turn[::2].tolist(), turn[1::2].tolist())])
        return pa.RecordBatch.from_arrays([*rows.columns, pa.array(left, pa.string() if as_text else pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))], schema.names)

    return shards.finish([kept, two, three], make, schema)


def repeat_digest(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The contract's columns."""
    out = remove_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")), limits=limits)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return out.select("doc_id", size.alias("n_bytes"), (size - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

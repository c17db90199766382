"""Operator 4: benchmark decontamination by a prefix-filtered containment join.

A benchmark item gives windows of consecutive words.  Words are ordered by rarity in
the documents.  For full containment one prefix token is necessary: a text that holds a
window holds the window's rarest word.  So document words are joined with the windows
filed under them; the word's place fixes where the window would start, windows that
would not fit into the text there are dropped (length and positional bounds), and the
rest are compared word by word.

The windows are the stated query set: they are sent to all tasks in blocks of at most
BLOCK_WINDOWS, and the documents are scanned once for each block (one, for all usual
benchmarks).  No shuffle of documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .common import shared_dir, ship, stored

U64 = np.uint64
#: Windows sent to the tasks at once: 100,000 of 10 words take 8 MB.
BLOCK_WINDOWS = 100_000
#: Candidates compared at once in a task.
AT_ONCE = 1 << 18
SPAN = "array<struct<first:int,last:int>>"


def text_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of some texts, and their number by text."""
    data = K.LOWER[data]
    starts, stops, text = K.words(data, ends, K.ALNUM)
    return K.span_hashes(data, starts, stops), K.count_by_text(text, len(ends))


class Lookup:
    """Finds 64-bit values in a fixed sorted set; most others are turned away by a small table."""

    def __init__(self, values: np.ndarray):
        self.values = values
        bits = max(10, min(22, int(len(values) * 16).bit_length()))
        self.mask = U64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, bool)
        self.table[(values & self.mask).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in h, places in the set) of the values of h that the set has."""
        at = np.flatnonzero(self.table[(h & self.mask).astype(np.int64)])
        if not len(at) or not len(self.values):
            return at[:0], at[:0]
        where = np.minimum(np.searchsorted(self.values, h[at]), len(self.values) - 1)
        ok = self.values[where] == h[at]
        return at[ok], where[ok]


def windows_of(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(words binary, ids array<string>): each distinct window and the items that have it."""
    def run(batches):
        for b in batches:
            data, ends = K.texts(b.column("text"))
            ids = b.column("id").to_pylist()
            h, counts = text_words(data, ends)
            out_w, out_i = [], []
            for i, stop in enumerate(np.cumsum(counts)):
                own = h[stop - counts[i]: stop]
                for k in range(max(1, len(own) - size + 1) if len(own) else 0):
                    out_w.append(own[k: k + size].tobytes())
                    out_i.append(ids[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_w, pa.binary()), pa.array(out_i, pa.string())], ["words", "id"])

    rows = items.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "words binary, id string").groupBy("words").agg(F.collect_set("id").alias("ids"))


def rarity(docs: DataFrame, text: str, vocabulary: np.ndarray) -> np.ndarray:
    """How often each word of the block's vocabulary stands in the documents."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        known = Lookup(sent.value)
        total = np.zeros(len(known.values), np.int64)
        for b in batches:
            for _, _, data, ends in K.pieces(*K.texts(b.column(0))):
                total += np.bincount(known.find(text_words(data, ends)[0])[1], minlength=len(total))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["word", "n"])

    got = docs.select(text).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()  # at most a row per word of the block
    out = np.zeros(len(vocabulary), np.int64)
    for r in got:
        out[r.word] = r.n
    return out


class Block:
    """Windows filed under their rarest word."""

    def __init__(self, windows: list[np.ndarray], ids: list[list[str]], vocabulary: np.ndarray, counts: np.ndarray):
        order, filed = [], []
        for w in windows:
            place = np.searchsorted(vocabulary, w)
            first = min(range(len(w)), key=lambda k: (counts[place[k]], vocabulary[place[k]], k))
            order.append(vocabulary[place[first]])
            filed.append(first)
        order = np.array(order, U64)
        by = np.argsort(order, kind="stable")
        self.prefix, self.first = np.unique(order[by], return_index=True)
        self.first = np.r_[self.first, len(by)]
        self.sizes = np.array([len(windows[k]) for k in by], np.int64)
        self.offsets = np.array([filed[k] for k in by], np.int64)
        self.words = np.zeros((len(by), int(self.sizes.max(initial=1))), U64)
        for row, k in enumerate(by):
            self.words[row, : len(windows[k])] = windows[k]
        self.ids = [ids[k] for k in by]
        self.known = Lookup(self.prefix)

    def matches(self, h: np.ndarray, first_word: np.ndarray, last_word: np.ndarray):
        """(start, window) of every occurrence; the bounds give the range of words of each word's text."""
        at, where = self.known.find(h)
        for k in range(0, len(at), AT_ONCE // 16):
            a, p = at[k: k + AT_ONCE // 16], where[k: k + AT_ONCE // 16]
            many = self.first[p + 1] - self.first[p]
            cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(many) // AT_ONCE)) + 1, len(a)]
            for s, e in zip(cuts[:-1], cuts[1:]):
                window = K.ranges(self.first[p[s:e]], many[s:e])
                place = np.repeat(a[s:e], many[s:e])
                start = place - self.offsets[window]
                ok = (start >= first_word[place]) & (start + self.sizes[window] <= last_word[place])
                start, window = start[ok], window[ok]
                for i in range(self.words.shape[1]):
                    same = (self.sizes[window] <= i) | (self.words[window, i] == h[np.minimum(start + i, len(h) - 1)])
                    start, window = start[same], window[same]
                yield start, window


def scan(docs: DataFrame, text: str, names: dict[str, str], block: Block, last: bool) -> DataFrame:
    """Add the block's hits (a bit for each word) and found ids to each row; in the last scan, numbers and spans instead of bits."""
    sc = docs.sparkSession.sparkContext
    sent = sc.broadcast(block)
    again = names["bits"] in docs.columns
    plain = [c for c in docs.columns if c not in (names["bits"], names["items"])]
    added = [("n_words", T.LongType()), ("n_hit", T.LongType()), ("spans", T._parse_datatype_string(SPAN))] if last else [("bits", T.BinaryType())]
    schema = T.StructType([docs.schema[c] for c in plain] + [T.StructField(names[n], t) for n, t in added] + [T.StructField(names["items"], T.ArrayType(T.StringType()))])
    kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "spans": pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])), "bits": pa.binary()}

    def one(h, counts, old_bits, old_items, out):
        stop = np.cumsum(counts)
        begin = stop - counts
        edge = np.zeros(len(h) + 1, np.int32)
        found: dict[int, set] = {}
        for start, window in sent.value.matches(h, np.repeat(begin, counts), np.repeat(stop, counts)):
            np.add.at(edge, start, 1)
            np.add.at(edge, start + sent.value.sizes[window], -1)
            for d, w in set(zip(np.searchsorted(stop, start, "right").tolist(), window.tolist())):
                found.setdefault(d, set()).update(sent.value.ids[w])
        hit = np.cumsum(edge[:-1]) > 0
        for d in range(len(counts)):
            own = hit[begin[d]: stop[d]]
            if old_bits and old_bits[d] is not None:
                own = own | np.unpackbits(np.frombuffer(old_bits[d], np.uint8), count=len(own)).astype(bool)
            out["items"].append(sorted(found.get(d, set()) | set(old_items[d] if old_items else ())))
            if last:
                turn = np.flatnonzero(np.diff(np.r_[False, own, False].astype(np.int8)))
                out["n_words"].append(int(counts[d]))
                out["n_hit"].append(int(own.sum()))
                out["spans"].append([{"first": int(a), "last": int(z) - 1} for a, z in zip(turn[::2], turn[1::2])])
            else:
                out["bits"].append(np.packbits(own).tobytes())

    def run(batches):
        for b in batches:
            out = {n: [] for n, _ in added} | {"items": []}
            old_bits = b.column(names["bits"]).to_pylist() if again else None
            old_items = b.column(names["items"]).to_pylist() if again else None
            for i, j, data, ends in K.pieces(*K.texts(b.column(text))):
                one(*text_words(data, ends), old_bits and old_bits[i:j], old_items and old_items[i:j], out)
            cols = [b.column(c) for c in plain] + [pa.array(out[n], kinds[n]) for n, _ in added] + [pa.array(out["items"], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema])

    return docs.mapInArrow(run, schema)


def contamination(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, names: dict[str, str] | None = None) -> DataFrame:
    """All columns of ``docs`` and n_words, n_hit, spans (first and last word, from 0, of each hit run), items (sorted ids).

    Words are runs of digits, letters and non-ASCII characters, lower-cased (A-Z); a window is ``window``
    consecutive words of an item, or a shorter item as a whole; a word inside any occurrence of a window
    is hit.  Null and empty texts have no words, and items without words no windows.  Items that repeat an
    id are one; the windows of an item without id count for hits but are not listed.  ``names`` renames
    the added columns where ``docs`` has columns of these names.  Tables may be empty.
    """
    spark = docs.sparkSession
    ship(spark)
    names = {n: n for n in ("n_words", "n_hit", "spans", "items", "bits")} | (names or {})
    folder = shared_dir(spark)
    windows = stored(windows_of(items, item_id, item_text, window), folder, "windows")
    blocks = max(1, -(-windows.count() // BLOCK_WINDOWS))
    for k in range(blocks):
        own = windows.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k) if blocks > 1 else windows
        rows = own.collect()  # about BLOCK_WINDOWS, whatever the benchmark's size
        words = [np.frombuffer(r.words, U64) for r in rows]
        vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, U64)
        counts = rarity(docs, text_col, vocabulary) if words else np.zeros(0, np.int64)
        docs = scan(docs, text_col, names, Block(words, [list(r.ids) for r in rows], vocabulary, counts), k == blocks - 1)
        if k < blocks - 1:
            docs = stored(docs, folder, f"block-{k}")
    return docs


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: ids are listed by a digest."""
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))

"""Operator 1: exact token counts of a word-ending BPE vocabulary, without producing ids.

Each lower-cased word piece starts as one symbol per UTF-8 byte (the last one with
the word-end mark).  A heap holds the ranks of adjacent pairs over a linked list of
symbols; the lowest rank is popped and merged until none is left.  The piece's count
is its initial symbols minus its merges.

Counts are kept per worker for white-space separated chunks and for pieces, in two
tables of bounded size; a text is then a sum over its chunks.  No shuffle.
"""

from __future__ import annotations

import json
import re
import unicodedata
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from .common import id_text, ship

#: Entries a worker's table may hold before it starts anew; bounds memory, not results.
TABLE_ENTRIES = 300_000
#: White space of the tokenizer's \s; str.split() splits at U+001C-U+001F as well.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Below it, letters and cases are the same in every Unicode version; beyond it the tokenizer's own tables decide.
LATIN_END = "\u0250"
ODD_SPACE = re.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in names:
            names[b] = chr(256 + extra)
            extra += 1
    return [names[b] for b in range(256)]


def merged_length(symbols: list[int], ranks: dict[tuple[int, int], tuple[int, int]]) -> int:
    """Symbols left when the lowest-rank adjacent pair (leftmost on ties) is merged again and again."""
    n = left = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        pair = (symbols[i], symbols[i + 1])
        if pair in ranks:
            heap.append((ranks[pair][0], i, pair))
    heapify(heap)
    while heap:
        _, i, pair = heappop(heap)
        j = after[i]
        if j >= n or symbols[i] != pair[0] or symbols[j] != pair[1]:
            continue  # one of the two was merged meanwhile
        new = symbols[i] = ranks[pair][1]
        symbols[j] = -1
        k = after[i] = after[j]
        left -= 1
        p = before[i]
        if p >= 0 and (pair := (symbols[p], new)) in ranks:
            heappush(heap, (ranks[pair][0], p, pair))
        if k < n:
            before[k] = i
            if (pair := (new, symbols[k])) in ranks:
                heappush(heap, (ranks[pair][0], i, pair))
    return left


class WordBpe:
    """Token counts for a ``tokenizers`` file of the kind: NFC, lower case, split, byte-level BPE with word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if spec["model"]["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"{path}: not a lower-casing word BPE file")
        vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.ranks = {(vocab[a], vocab[b]): (i, vocab[a + b]) for i, (a, b) in enumerate(spec["model"]["merges"])}
        names = byte_symbols()
        self.inner, self.last = [vocab[c] for c in names], [vocab[c + end] for c in names]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.piece = regex.compile(pattern)
        self.normalizer = Tokenizer.from_file(path).normalizer
        self.splitter = Split(Regex(pattern), "removed", invert=True)
        self.special = re.compile("|".join(sorted((re.escape(x["content"]) for x in spec["added_tokens"]), key=len, reverse=True)))
        self.marks = tuple(x["content"] for x in spec["added_tokens"])
        self.chunks: dict[str, int] = {}
        self.pieces: dict[str, int] = {}

    def piece_tokens(self, piece: str) -> int:
        found = self.pieces.get(piece)
        if found is None:
            raw = piece.encode("utf-8")
            symbols = [self.inner[b] for b in raw]
            symbols[-1] = self.last[raw[-1]]
            found = merged_length(symbols, self.ranks)
            if len(raw) <= 256:  # longer ones hardly return, and would make the table large
                if len(self.pieces) >= TABLE_ENTRIES:
                    self.pieces.clear()
                self.pieces[piece] = found
        return found

    def plain_tokens(self, s: str) -> int:
        if not s.isascii() and max(s) >= LATIN_END:
            pieces = [p for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(s))]
        else:
            pieces = self.piece.findall(unicodedata.normalize("NFC", s).lower())
        return sum(map(self.piece_tokens, pieces))

    def chunk_tokens(self, chunk: str) -> int:
        if any(m in chunk for m in self.marks):
            parts = self.special.split(chunk)
            found = len(parts) - 1 + sum(map(self.plain_tokens, parts))
        else:
            found = self.plain_tokens(chunk)
        if len(chunk) <= 256:
            if len(self.chunks) >= TABLE_ENTRIES:
                self.chunks.clear()
            self.chunks[chunk] = found
        return found

    def count(self, text: str) -> int:
        known, total = self.chunks, 0
        for chunk in SPACE.split(text) if ODD_SPACE.search(text) else text.split():
            n = known.get(chunk)
            total += self.chunk_tokens(chunk) if n is None else n
        return total


_LOADED: dict[str, WordBpe] = {}


def counter(tokenizer: str) -> WordBpe:
    """The counter of a vocabulary of the installed ``public_tokenizers``, or of a file path."""
    if tokenizer not in _LOADED:
        import os

        import public_tokenizers

        _LOADED[tokenizer] = WordBpe(tokenizer if os.sep in tokenizer else public_tokenizers.path(tokenizer))
    return _LOADED[tokenizer]


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row.

    ``tokenizer`` is a name in ``public_tokenizers`` or a path that every executor has.  A null text
    counts as empty (0 bytes, 0 tokens); a null id stays null; equal rows each give a row; further
    columns are ignored; an empty table gives an empty result.  A text is never cut, and special
    strings in it count as the one token that they are to the tokenizer.
    """
    ship(docs.sparkSession)

    def run(batches):
        bpe = counter(tokenizer)
        for b in batches:
            counts = [bpe.count(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    rows = id_text(docs, id_col, text_col).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)

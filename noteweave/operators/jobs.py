"""Pipeline stand-ins (J5, J6) and hand-off lists.

The external NLP engine that produces mentions and sentences is not part of
this library; these operators give tables of the same shape from plain text
so that the rest of the pipeline can run.  Both are map-side per document;
the gazetteer is one keyed join against the label dictionary.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENTENCE_RE = r"[^.!?\n]+[.!?]*"
WORD_RE = r"\w+"
#: Places of the dictionary's start filter, and the number of words from which lengths share one bit of a place.
PLACES, MANY = 1 << 20, 63
#: Rows of an output batch.
ROWS = 1 << 14


def _rows(docs: DataFrame, text_col: str, fields: list[tuple[str, str]], make) -> DataFrame:
    """``doc_id`` and ``fields`` of the rows that ``make()(text)`` yields for each text; null texts yield none."""
    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in fields)).fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def run(batches):
        work, out = make(), []
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for row in () if text is None else work(text):
                    out.append((doc_id, *row))
                    if len(out) >= ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    return docs.select("doc_id", text_col).mapInArrow(run, schema)


def sentence_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``(doc_id, sent_no, start_pos, end_pos)``; a sentence runs to its end
    punctuation or line break."""
    pattern = SENTENCE_RE

    def make():
        finder = re.compile(pattern)
        return lambda text: ((i, *m.span()) for i, m in enumerate(finder.finditer(text), start=1))

    return _rows(docs, text_col, [("sent_no", "int"), ("start_pos", "int"), ("end_pos", "int")], make)


def label_starts(dic: DataFrame) -> tuple[np.ndarray, list[int]]:
    """How labels start, in a table of fixed size: PLACES bit sets of label lengths, and the lengths of MANY words or more.

    A label of one word sets bit 1 of its word's place, a longer one the bit of its length at the place of its
    first two words; places are shared by chance, which costs candidates and loses none.
    """
    words = F.split("key", " ")
    n = F.size(words)
    place = F.when(n == 1, F.crc32(words[0].cast("binary"))).otherwise(F.crc32(F.concat_ws(" ", F.slice(words, 1, 2)).cast("binary")))
    bits = dic.select((place % PLACES).cast("int").alias("place"), F.call_function("shiftleft", F.lit(1).cast("long"), F.least(n, F.lit(MANY))).alias("bit"))
    table = np.zeros(PLACES, np.uint64)
    for r in bits.groupBy("place").agg(F.bit_or("bit").alias("bits")).collect():  # PLACES rows at most, whatever the dictionary
        table[r["place"]] = r["bits"] & (1 << 64) - 1
    long = dic.select(n.alias("n")).where(F.col("n") >= MANY).distinct().collect()  # one row a length
    return table, sorted(r["n"] for r in long)


def _candidates(table: np.ndarray, long: list[int]):
    """Of a text: (start, end, string) of the runs of words that may be labels."""
    finder, bits = re.compile(WORD_RE, re.ASCII), table.tolist()

    def work(text: str):
        spans = [m.span() for m in finder.finditer(text)]
        words = [text[a:e] for a, e in spans]
        low = [w.lower().encode() for w in words]
        for i, w in enumerate(low):
            if bits[crc32(w) % PLACES] & 2:
                yield *spans[i], words[i]
            more = bits[crc32(w + b" " + low[i + 1]) % PLACES] & ~3 if i + 1 < len(low) else 0
            if more:
                for n in [k for k in range(2, MANY) if more >> k & 1] + (long if more >> MANY else []):
                    if i + n <= len(low):
                        yield spans[i][0], spans[i + n - 1][1], " ".join(words[i:i + n])

    return work


def gazetteer(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """Dictionary match of labels against runs of words (case-insensitive,
    words normalised to single spaces) -> mention rows ``(doc_id, start_pos,
    end_pos, str, cuis)``.

    The dictionary is folded to one row per normalised label with its CUIs in
    order, so a mention is one row however many CUIs share the label.  A filter
    of fixed size knows with which one or two words labels start and how long
    those are; one pass over a text gives only the runs that may be labels, so
    a long label costs nothing where its first two words do not stand.  A join
    on the run settles them, whatever the size of the dictionary.
    """
    norm = F.array_join(F.split(F.lower(F.trim(F.col("label"))), r"\s+"), " ")
    dic = (labels.select("cui", norm.alias("key")).where(F.col("key") != "")
           .groupBy("key").agg(F.array_sort(F.collect_set("cui")).alias("cuis")))
    sent = docs.sparkSession.sparkContext.broadcast(label_starts(dic))  # PLACES numbers
    found = _rows(docs, text_col, [("start_pos", "int"), ("end_pos", "int"), ("str", "string")], lambda: _candidates(*sent.value))
    return found.withColumn("key", F.lower("str")).join(dic, "key").select("doc_id", "start_pos", "end_pos", "str", "cuis")


def handoff_list(docs: DataFrame, todo: DataFrame | None) -> DataFrame:
    """Documents to process = the given id list, or all documents if none."""
    ids = docs.select("doc_id")
    return ids if todo is None else ids.join(todo.select("doc_id").distinct(), "doc_id", "left_semi")

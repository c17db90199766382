"""Rows packed into shards, and rounds in which shards ask and partitions answer.

A shard is about a megabyte of rows in one compressed Arrow message.  Shards are stored
in buckets by their number, and so are the answers, so that each round joins them
without moving the texts.  In a round every shard sends one message to each partition of
a key space; a partition sees all messages to it and returns an answer to each sender.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, release, ship

SHARD_BYTES = 1 << 20
#: Shards, or messages, of one Arrow batch.
BATCH = 32


def pack(*arrays: np.ndarray) -> bytes:
    """Some flat arrays in one message."""
    head = [len(arrays)]
    for a in arrays:
        head += [ord(a.dtype.char), len(a)]
    return b"".join([np.array(head, np.int64).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head, at, out = np.frombuffer(data, np.int64, 1 + 2 * n)[1:], 8 * (1 + 2 * n), []
    for kind, length in zip(head[::2].tolist(), head[1::2].tolist()):
        out.append(np.frombuffer(data, np.dtype(chr(kind)), length, at))
        at += out[-1].nbytes
    return out


def rows_to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def bytes_to_rows(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


class Shards:
    def __init__(self, docs: DataFrame, text_col: str, folder: str, parts: int, shard_bytes: int = SHARD_BYTES):
        """Pack ``docs`` (each row into one shard, however long it is) into ``parts`` buckets below ``folder``."""
        self.spark, self.folder, self.parts, self.schema = docs.sparkSession, folder, parts, docs.schema
        ship(self.spark)

        def run(batches):
            task, n = TaskContext.get().partitionId(), 0
            for b in batches:
                col = b.column(text_col)
                sizes = np.array([x or 0 for x in pa.compute.binary_length(col).to_pylist()], np.int64) if len(b) else np.zeros(0, np.int64)
                at, ends = 0, np.cumsum(sizes)
                while at < len(b):
                    stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + shard_bytes, "right")))
                    yield pa.RecordBatch.from_arrays([pa.array([(task << 24) + n], pa.int64()), pa.array([rows_to_bytes(b.slice(at, stop - at))], pa.binary())], ["shard", "rows"])
                    at, n = stop, n + 1

        import pyarrow.compute  # noqa: F401

        self.table = self.stored(docs.mapInArrow(run, "shard long, rows binary").repartition(parts, "shard").sortWithinPartitions("shard"), "shards", None)

    def stored(self, df: DataFrame, name: str, batch: int | None = BATCH) -> DataFrame:
        """``df`` in buckets by shard: joins of such tables on it need no shuffle.  Texts come in batches of any size, shards in small ones."""
        table = f"noteweave_{name}_{uuid.uuid4().hex}"
        with arrow_rows(self.spark, batch) if batch else nullcontext():
            df.write.format("parquet").bucketBy(self.parts, "shard").option("path", f"{self.folder}/{name}").saveAsTable(table)
        return self.spark.table(table)

    def joined(self, answers: list[DataFrame]) -> DataFrame:
        out = self.table
        for i, a in enumerate(answers):
            out = out.join(a.withColumnRenamed("answers", f"a{i}").hint("shuffle_hash"), "shard", "left")
        return out

    def ask(self, name: str, answers: list[DataFrame], send: Callable, answer: Callable) -> DataFrame:
        """A round: (shard, answers) in a bucketed table.

        ``send(rows, answers)`` gives (partition, message) pairs; ``answer(messages)`` gives a message for each
        of those it got, in order.  Messages of one partition are held in one task, so their keys must be spread
        over enough partitions.
        """
        rounds = len(answers)

        def out(batches):
            for b in batches:
                held = [b.column(f"a{i}").to_pylist() for i in range(rounds)]
                for k, (shard, data) in enumerate(zip(b.column("shard").to_pylist(), b.column("rows").to_pylist())):
                    msgs = list(send(bytes_to_rows(data), [of(h[k]) for h in held]))
                    if msgs:
                        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in msgs], pa.int32()), pa.array([shard] * len(msgs), pa.int64()), pa.array([m for _, m in msgs], pa.binary())], ["part", "shard", "message"])

        def back(batches):
            part, shards, held = None, [], []

            def done():
                got = list(answer(held))
                return pa.RecordBatch.from_arrays([pa.array([part] * len(shards), pa.int32()), pa.array(shards, pa.int64()), pa.array(got, pa.binary())], ["part", "shard", "message"])

            for b in batches:
                for p, s, m in zip(b.column("part").to_pylist(), b.column("shard").to_pylist(), b.column("message").to_pylist()):
                    if p != part and held:
                        yield done()
                        shards, held = [], []
                    part = p
                    shards.append(s)
                    held.append(m)
            if held:
                yield done()

        kind = "part int, shard long, message binary"
        msgs = self.joined(answers).mapInArrow(out, kind).repartition(self.parts, "part").sortWithinPartitions("part", "shard")
        got = msgs.mapInArrow(back, kind).repartition(self.parts, "shard").groupBy("shard").agg(F.collect_list(F.struct("part", "message")).alias("answers"))
        table = self.stored(got, name)
        release(self.spark)
        return table

    def derive(self, name: str, answers: list[DataFrame], make: Callable) -> DataFrame:
        """One message of each shard to itself, kept like answers (under partition 0)."""
        rounds = len(answers)

        def run(batches):
            for b in batches:
                held = [b.column(f"a{i}").to_pylist() for i in range(rounds)]
                for k, (shard, data) in enumerate(zip(b.column("shard").to_pylist(), b.column("rows").to_pylist())):
                    own = [{"part": 0, "message": make(bytes_to_rows(data), [of(h[k]) for h in held])}]
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([own], pa.list_(pa.struct([("part", pa.int32()), ("message", pa.binary())])))], ["shard", "answers"])

        return self.stored(self.joined(answers).mapInArrow(run, "shard long, answers array<struct<part:int,message:binary>>"), name)

    def finish(self, answers: list[DataFrame], make: Callable, schema) -> DataFrame:
        """Rows from each shard and all its answers."""
        rounds = len(answers)

        def run(batches):
            for b in batches:
                held = [b.column(f"a{i}").to_pylist() for i in range(rounds)]
                for k, data in enumerate(b.column("rows").to_pylist()):
                    yield make(bytes_to_rows(data), [of(h[k]) for h in held])

        return self.joined(answers).mapInArrow(run, schema)


def of(answers: Iterable | None) -> dict[int, list[np.ndarray]]:
    """Messages by partition."""
    return {a["part"]: unpack(a["message"]) for a in answers or ()}

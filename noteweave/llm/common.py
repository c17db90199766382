"""Shared helpers: input tables, the shared work folder, shipping code to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SHIPPED: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package's Python files to the executors, once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    root = os.path.dirname(package)
    path = os.path.join(tempfile.mkdtemp(prefix="noteweave-code-"), "noteweave_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(package):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the shared folder in ``spark.checkpoint.dir``.

    Only a purely local master may go without the setting (as in tests): there
    driver and executors are one process, so a scratch folder is shared.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="noteweave-llm-")
        sc.setCheckpointDir(base)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base) if sc.master.startswith("local") else base
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, and a lost
    executor costs a read, not a recomputation."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id long, text string) without nulls in the text; other columns stay behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def fold(id_col: str, mod: int):
    """crc32 of the id written as text, modulo ``mod``: the folds that fix which rows are held out."""
    return (F.crc32(F.col(id_col).cast("string").cast("binary")) % F.lit(mod)).cast("int")


def free(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has (names differ by more than case)."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name


def annotate(df: DataFrame, text_col: str, make, fields: list[tuple[str, str]], piece_bytes: int | None = None) -> DataFrame:
    """All columns of ``df`` and ``fields`` (name, type) computed from the text.

    ``make()`` is called once a task and gives a function of (bytes, ends) of some whole texts that returns
    an array for each field.  A null text counts as empty.  The names must be free in ``df``.
    """
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    from . import kernels as K

    added = [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields]
    schema = T.StructType([*df.schema.fields, *added])
    kinds = [to_arrow_type(f.dataType) for f in added]
    size = piece_bytes or K.PIECE_BYTES

    def run(batches):
        work = make()
        for b in batches:
            out = [[] for _ in fields]
            for _, _, data, ends in K.pieces(*K.texts(b.column(text_col)), size):
                for have, got in zip(out, work(data, ends)):
                    have.extend(got.tolist() if hasattr(got, "tolist") else got)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(o, k) for o, k in zip(out, kinds))], schema.names)

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def lowest_by_hash(rows: DataFrame, key: str, id_col: str, most: int, sizes: dict) -> DataFrame:
    """The ``most`` rows of each key whose ids hash lowest, given the number of rows of each (few) key.

    A key of very many rows is first cut to about twice as many by the hash itself, so the ranking never
    sees more, however large the key; the rows cut off could not have been among the lowest.
    """
    top = 1 << 40
    cut = F.lit(top)
    for k, n in sizes.items():
        if n > 2 * most + 100:
            cut = F.when(F.col(key) == k, F.lit(int(top * (2 * most + 100) / n))).otherwise(cut)
    low = rows.withColumn("_hash", F.pmod(F.xxhash64(id_col), F.lit(top))).filter(F.col("_hash") < cut)
    rank = F.row_number().over(Window.partitionBy(key).orderBy("_hash", id_col))
    return low.withColumn("_rank", rank).filter(F.col("_rank") <= most).drop("_hash", "_rank")


def labelled_ids(labels: DataFrame, label_col: str, mod: int, id_col: str = "doc_id") -> DataFrame:
    """(id, y) of the training rows: of conflicting labels of an id the larger counts; null labels and ids are ignored."""
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("y"))
    return rows.filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (fold("id", mod) != 0)).groupBy("id").agg(F.max("y").alias("y"))


def labelled_texts(docs: DataFrame, ids: DataFrame, parts: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, y, text) of all documents with labels, of rows that repeat an id the least text, dealt to ``parts`` tasks by id.

    Both sides are dealt before they are joined, so texts are shuffled once, and labels are broadcast at no size.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = texts.repartition(parts, "id").join(ids.repartition(parts, "id").hint("merge"), "id")
    return rows.groupBy("id", "y").agg(F.min("text").alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, mod: int, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(text, y) of at most ``per_class`` training documents of each label, and the number of labels of each.

    Rows whose fold is 0 are held out and never read here.  Of conflicting labels of an id the larger
    counts; null labels and ids are ignored.  The sample is the lowest by a hash of the id, so it does not
    depend on order or partitions, and of rows that repeat an id the least text stays; its bound makes the broadcast small.
    """
    rows = labelled_ids(labels, label_col, mod, id_col)
    sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    some = lowest_by_hash(rows, "y", "id", per_class, sizes)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.join(F.broadcast(some), "id").groupBy("id", "y").agg(F.min("text").alias("text")).select("id", "text", "y"), sizes


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """While jobs run inside, tasks get at most ``rows`` rows in an Arrow batch: rows here are large, and a batch is held
    by Spark and by Python at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of finished steps; otherwise they stay until the driver collects garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()

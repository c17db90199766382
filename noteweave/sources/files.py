"""File sources and sinks.

Readers use explicit schemas (no inference pass); writers are plain
DataFrame writers, partitioned where a folder per key is the format.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_text_folder(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Whole text files; ``doc_id`` = file name."""
    r = spark.read
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("doc_id"),
                                               F.col("value").alias("text"))


def attach_texts(docs: DataFrame, texts: DataFrame, key_pattern: str = "%s") -> tuple[DataFrame, DataFrame]:
    """Text lookup by key (``key_pattern % doc_id`` names the text); a missing
    text sends the document to the error side instead of failing the run."""
    k = docs.withColumn("_tkey", F.format_string(key_pattern, F.col("doc_id").cast("string")))
    t = texts.select(F.col("doc_id").alias("_tkey"), "text")
    j = k.join(t, "_tkey", "left")
    return j.where(F.col("text").isNotNull()).drop("_tkey"), j.where(F.col("text").isNull()).drop("_tkey", "text")


def write_texts(df: DataFrame, path: str, text_col: str = "deid_text") -> None:
    """One folder per document holding its (de-identified) text."""
    df.select("doc_id", text_col).write.mode("overwrite").partitionBy("doc_id").text(path)


def write_phi_json(phi: DataFrame, path: str) -> None:
    """PHI findings as JSON lines ``{doc, pos, start, type, sent, rule}``."""
    phi.select(F.col("doc_id").cast("string").alias("doc"), "pos", "start", "type", "sent", "rule") \
        .write.mode("overwrite").json(path)


def write_phi_grouped(lines: DataFrame, path: str) -> None:
    """Distinct ``doc<TAB>pos<TAB>sent`` lines, one folder per type."""
    lines.write.mode("overwrite").partitionBy("type").text(path)


# ---------------------------------------------------------------- S13 ontology release files

_MRCONSO = ["cui", "lat", "ts", "lui", "stt", "sui", "ispref", "aui", "saui", "scui", "sdui", "sab", "tty",
            "code", "str", "srl", "suppress", "cvf"]
_MRREL = ["cui1", "aui1", "stype1", "rel", "cui2", "aui2", "stype2", "rela", "rui", "srui", "sab", "sl", "rg",
          "dir", "suppress", "cvf"]
_MRSTY = ["cui", "tui", "stn", "sty", "atui", "cvf"]
_SEMGROUPS = ["tuigroup", "tuigrouplabel", "tui", "tuilabel"]


def _pipe(spark: SparkSession, path: str, names: Sequence[str], header: bool = False) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names] +
                          ([] if header else [T.StructField("_trail", T.StringType())]))
    df = (spark.read.option("sep", "|").option("quote", "\u0000").option("header", header)
          .schema(schema).csv(path))
    return df.drop("_trail") if not header else df


def line_place() -> Column:
    """A line's place among all lines read, for last-wins rules: (file, split's first byte, order in the split).

    Row ids alone follow the order in which Spark deals splits to tasks, which is by size where files are many.
    """
    return F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("line"))


def read_mrconso(spark: SparkSession, path: str) -> DataFrame:
    """MRCONSO.RRF with each line's place (``line_no``) for last-wins rules; several files count in order of their names."""
    return _pipe(spark, path, _MRCONSO).withColumn("line_no", line_place())


def read_mrrel(spark: SparkSession, path: str) -> DataFrame:
    return _pipe(spark, path, _MRREL).select("cui1", "rel", "cui2", "sab")


def read_mrsty(spark: SparkSession, path: str) -> DataFrame:
    return _pipe(spark, path, _MRSTY).select("cui", "tui", line_place().alias("line_no"))


def read_semgroups(spark: SparkSession, path: str) -> DataFrame:
    return _pipe(spark, path, _SEMGROUPS).select("tui", "tuigroup", "tuigrouplabel")


def read_lookup_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four prepared tables (header, pipe-separated, csv lists in cells); rel keeps only RN."""
    cui = _pipe(spark, f"{folder}/cui.csv", ["cui", "tui", "tuigroup", "cuilabel"], header=True) \
        .select("cui", F.split("tui", ",").alias("tuis"), F.split("tuigroup", ",").alias("tuigroups"), "cuilabel")
    rel = _pipe(spark, f"{folder}/rel.csv", ["cui1", "has", "cui2"], header=True).where(F.col("has") == "RN") \
        .select("cui1", F.explode(F.split("cui2", ",")).alias("cui2")).where(F.col("cui2") != "")
    snomed = _pipe(spark, f"{folder}/snomed.csv", ["snomed", "cui"], header=True)
    sty = _pipe(spark, f"{folder}/sty.csv", ["tui", "tuigroup", "tuigrouplabel"], header=True)
    return {"cui": cui, "rel": rel, "snomed": snomed, "sty": sty}


def write_lookup_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Persist prepared tables as parquet, sorted by key for range pruning."""
    for name, df in tables.items():
        key = df.columns[0]
        df.sortWithinPartitions(key).write.mode("overwrite").parquet(f"{folder}/{name}")


# ---------------------------------------------------------------- S15-S18

_MAPPING = T.MapType(T.StringType(), T.ArrayType(T.StringType()))


def read_mapping_files(spark: SparkSession, path: str) -> DataFrame:
    """Mapping JSON files (term -> list of CUI or ``CUI<TAB>PREF<TAB>STY``);
    name = file stem -> rows ``(map_name, line_no, term, entry)`` in file order."""
    raw = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
    m = raw.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("map_name"),
                   F.posexplode(F.from_json("value", _MAPPING)).alias("t_no", "term", "entries"))
    return m.select("map_name", "term", "t_no", F.posexplode("entries").alias("e_no", "entry")) \
        .select("map_name", (F.col("t_no").cast("long") * (1 << 31) + F.col("e_no")).alias("line_no"), "term", "entry")


def read_id_list(spark: SparkSession, paths: str | Sequence[str], sep: str = ",", header: bool = True,
                 column: int = 0, name: str = "id") -> DataFrame:
    """First (or given) column of one or more CSV/TSV files, merged and distinct."""
    df = spark.read.option("sep", sep).option("header", header).csv(paths)
    return df.select(F.col(df.columns[column]).alias(name)).where(F.col(name).isNotNull()).distinct()


def keep_listed(df: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """Keep rows whose ``col`` is in the uploaded id list (left-semi join)."""
    return df.join(ids.withColumnRenamed(ids.columns[0], col), col, "left_semi")


def write_id_csv(df: DataFrame, path: str, col: str) -> None:
    """Export result ids as a one-column CSV with header."""
    df.select(col).write.mode("overwrite").option("header", True).csv(path)

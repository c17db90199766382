"""Raw NLP annotation documents (M6 / A4) and processed documents.

* ``parse_lines`` (S4, S12): JSON lines -> typed rows with an explicit schema;
  lines that fail are repaired once (unescaped quotes inside string values)
  and what still fails goes to a quarantine frame.
* ``load_annotations`` (S5): one raw document row -> mention, phenotype and
  sentence rows; ids ``cui-n`` / ``phe-n`` / ``sent-n`` in encounter order,
  sentences ranked by start.  All per-row higher-order functions: the raw
  document is one row, so no shuffle is needed.
* ``processed_documents`` / ``read_processed`` (S7, S6): the serialised form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("offset", T.IntegerType())])
FEATURES = T.StructType([T.StructField(n, T.StringType()) for n in (
    "string_orig", "inst", "PREF", "STY", "TUI", "Negation", "Temporality", "Experiencer",
    "majorType", "minorType", "VOCABS", "language", "inst_full", "tui_full")])
RAW_ANN = T.StructType([T.StructField("type", T.StringType()), T.StructField("id", T.IntegerType()),
                        T.StructField("startNode", NODE), T.StructField("endNode", NODE),
                        T.StructField("features", FEATURES)])
RAW_DOC = T.StructType([T.StructField("docId", T.StringType()),
                        T.StructField("annotations", T.ArrayType(T.ArrayType(RAW_ANN))),
                        T.StructField("_corrupt_record", T.StringType())])

# Values that may hold unescaped quotes, and where such a value ends.
_REPAIR = (r'(?d)\G([\s\S]*?)(string_orig":"|pref": "|PREF":"|str": ")'
           r'((?:(?!","|"\}|", ").)*)(","|"\}|", ")')


def repair_json(s: Column) -> Column:
    """Inside ``string_orig``/``pref``/``PREF``/``str`` values that contain a
    quote, drop backslashes and escape the quotes; the rest is kept verbatim."""
    parts = F.arrays_zip(*[F.regexp_extract_all(s, F.lit(_REPAIR), i).alias(n)
                           for i, n in ((1, "gap"), (2, "pre"), (3, "val"), (4, "post"))])

    def fix(v):
        return F.when(F.instr(v, '"') > 0, F.replace(F.replace(v, F.lit("\\"), F.lit("")), F.lit('"'), F.lit('\\"'))) \
            .otherwise(v)
    rebuilt = F.array_join(F.transform(parts, lambda p: F.concat(p["gap"], p["pre"], fix(p["val"]), p["post"])), "")
    consumed = F.aggregate(parts, F.lit(0), lambda acc, p: acc + F.length(p["gap"]) + F.length(p["pre"])
                           + F.length(p["val"]) + F.length(p["post"]))
    tail = F.substring(s, consumed + 1, 2 ** 31 - 1)
    return F.concat(rebuilt, tail)


def parse_lines(lines: DataFrame, key_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """S4 + S12: ``(value)`` JSON lines -> (docs ``(doc_id, annotations)``, quarantine).

    ``doc_id`` is ``docId`` from the line, or ``key_col`` (e.g. a file stem, S3).
    """
    opts = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    # a generator keeps the filters on its output behind it: else each of them would parse the line again
    lines = lines.select(*[c for c in lines.columns if c != "value"], F.explode_outer(F.array("value")).alias("value"))
    first = lines.select("*", F.explode_outer(F.array(F.from_json("value", RAW_DOC, opts))).alias("_p"))
    bad = F.col("_p").isNull() | F.col("_p._corrupt_record").isNotNull()
    again = F.when(bad, F.from_json(repair_json(F.col("value")), RAW_DOC, opts)).otherwise(F.col("_p"))
    second = first.select(*lines.columns, F.explode_outer(F.array(again)).alias("_p"))
    still = F.col("_p").isNull() | F.col("_p._corrupt_record").isNotNull()
    doc_id = F.col(key_col) if key_col else F.col("_p.docId")
    ok = second.where(~still).select(doc_id.alias("doc_id"), F.col("_p.annotations").alias("annotations"))
    quarantine = second.where(still).select(*([key_col] if key_col else []), "value")
    return ok, quarantine


def read_nlp_files(spark: SparkSession, path: str, one_doc_per_file: bool) -> tuple[DataFrame, DataFrame]:
    """S3 (one JSON document per ``*.json`` file, key = file stem) or S4 (JSON lines)."""
    if one_doc_per_file:
        raw = (spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True)
               .withColumn("stem", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)))
        return parse_lines(raw, "stem")
    return parse_lines(spark.read.text(path))


def _typed(flat: Column, kind: str) -> Column:
    return F.filter(flat, lambda a: a["type"] == kind)


#: Columns of the mention, phenotype and sentence rows of S5.
_CONTEXT = ["start_pos", "end_pos", "str", "negation", "temporality", "experiencer"]
_OWN = {"Mention": ["doc_id", "ann_no", "id", *_CONTEXT, "cui", "sty", "pref"],
        "Phenotype": ["doc_id", "ann_no", "id", *_CONTEXT, "major_type", "minor_type"]}


def annotation_rows(docs: DataFrame) -> DataFrame:
    """S5 as one table, for which a document is read once: ``kind`` is Mention, Phenotype or Sentence.

    ``ann_no`` is the number in encounter order, of a sentence its rank by start (ties: by end, then encounter).
    """
    flat = F.flatten(F.col("annotations"))

    def rows(kind, prefix):
        def row(a, i):
            f = a["features"]
            return F.struct(F.lit(kind).alias("kind"), (i + 1).cast("int").alias("ann_no"), F.concat(F.lit(prefix), (i + 1).cast("string")).alias("id"),
                            a["startNode"]["offset"].alias("start_pos"), a["endNode"]["offset"].alias("end_pos"),
                            f["string_orig"].alias("str"), f["Negation"].alias("negation"), f["Temporality"].alias("temporality"),
                            f["Experiencer"].alias("experiencer"), f["inst"].alias("cui"), f["STY"].alias("sty"), f["PREF"].alias("pref"),
                            f["majorType"].alias("major_type"), f["minorType"].alias("minor_type"))
        return F.transform(_typed(flat, kind), row)

    none = F.lit(None).cast("string")
    # encounter number for the id, rank by start for sent_no
    spans = F.transform(_typed(flat, "Sentence"), lambda a, i: F.struct(
        a["startNode"]["offset"].alias("start_pos"), a["endNode"]["offset"].alias("end_pos"), (i + 1).alias("enc")))
    sentences = F.transform(F.array_sort(spans), lambda x, r: F.struct(
        F.lit("Sentence").alias("kind"), (r + 1).cast("int").alias("ann_no"), F.concat(F.lit("sent-"), x["enc"].cast("string")).alias("id"),
        x["start_pos"].alias("start_pos"), x["end_pos"].alias("end_pos"), *(none.alias(n) for n in
        ("str", "negation", "temporality", "experiencer", "cui", "sty", "pref", "major_type", "minor_type"))))
    every = F.concat(rows("Mention", "cui-"), rows("Phenotype", "phe-"), sentences)
    return docs.select("doc_id", F.explode_outer(every).alias("a")).where(F.col("a").isNotNull()).select("doc_id", "a.*")


def load_annotations(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mentions, phenotypes, sentences) from raw documents, as three frames (see ``annotation_rows``)."""
    rows = annotation_rows(docs)
    mentions, phenotypes = (rows.where(F.col("kind") == k).select(*cols) for k, cols in _OWN.items())
    sentences = rows.where(F.col("kind") == "Sentence").select("doc_id", F.col("ann_no").alias("sent_no"), "id", "start_pos", "end_pos")
    return mentions, phenotypes, sentences


def processed_documents(mentions: DataFrame, phenotypes: DataFrame, sentences: DataFrame) -> DataFrame:
    """One JSON document per doc ``{annotations, phenotypes, sentences}``.

    Each array is sorted by (start, id); a document is one output record, so
    its size is that of the document.
    """
    def arr(df, cols, name):
        return df.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(name))
    m = arr(mentions, ["start_pos", "end_pos", "str", "id", "negation", "temporality", "experiencer", "sty", "cui",
                       "pref", "study_concepts", "ruled_by"], "annotations")
    p = arr(phenotypes, ["start_pos", "end_pos", "str", "id", "negation", "temporality", "experiencer",
                         "major_type", "minor_type", "ruled_by"], "phenotypes")
    s = arr(sentences, ["start_pos", "end_pos", "id"], "sentences")
    j = m.join(p, "doc_id", "full").join(s, "doc_id", "full")
    return j.select("doc_id", F.to_json(F.struct(
        F.coalesce("annotations", F.array()).alias("annotations"),
        F.coalesce("phenotypes", F.array()).alias("phenotypes"),
        F.coalesce("sentences", F.array()).alias("sentences"))).alias("json"))


_PROCESSED = T.StructType([
    T.StructField("annotations", T.ArrayType(T.StructType([
        T.StructField(n, t) for n, t in (
            ("start_pos", T.IntegerType()), ("end_pos", T.IntegerType()), ("str", T.StringType()),
            ("id", T.StringType()), ("negation", T.StringType()), ("temporality", T.StringType()),
            ("experiencer", T.StringType()), ("sty", T.StringType()), ("cui", T.StringType()),
            ("pref", T.StringType()), ("study_concepts", T.ArrayType(T.StringType())),
            ("ruled_by", T.ArrayType(T.StringType())))]))),
    T.StructField("phenotypes", T.ArrayType(T.StructType([
        T.StructField(n, t) for n, t in (
            ("start_pos", T.IntegerType()), ("end_pos", T.IntegerType()), ("str", T.StringType()),
            ("id", T.StringType()), ("negation", T.StringType()), ("temporality", T.StringType()),
            ("experiencer", T.StringType()), ("major_type", T.StringType()), ("minor_type", T.StringType()),
            ("ruled_by", T.ArrayType(T.StringType())))]))),
    T.StructField("sentences", T.ArrayType(T.StructType([
        T.StructField("start_pos", T.IntegerType()), T.StructField("end_pos", T.IntegerType()),
        T.StructField("id", T.StringType())])))])


def read_processed(docs: DataFrame, json_col: str = "json") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Processed documents back to (mentions, phenotypes, sentences).

    A sentence keeps its own string (X1 fixed: no start offset in ``str``).
    """
    p = docs.select("doc_id", F.from_json(F.col(json_col), _PROCESSED).alias("p"))
    m = p.select("doc_id", F.explode("p.annotations").alias("a")).select("doc_id", "a.*")
    ph = p.select("doc_id", F.explode("p.phenotypes").alias("a")).select("doc_id", "a.*")
    s = p.select("doc_id", F.posexplode(F.array_sort("p.sentences")).alias("r", "a")).select(
        "doc_id", (F.col("r") + 1).cast("int").alias("sent_no"), "a.*")
    return m, ph, s


def index_documents(processed: DataFrame, doc2patient: DataFrame) -> DataFrame:
    """Processed documents with ``doc_id`` and ``patient_id`` for a search index
    (write partitioned by a hash of the doc id or as a table)."""
    return processed.join(doc2patient.select("doc_id", "patient_id"), "doc_id", "left")

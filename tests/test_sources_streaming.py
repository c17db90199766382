"""File sources/sinks and the incremental job window."""
import json
import os
import tempfile
from datetime import datetime

from pyspark.sql import functions as F

from conftest import SF
from noteweave.operators import search
from noteweave.sources import files, nlp_json
from noteweave.streaming.incremental import JobStatus, next_window, run_increment


def test_text_folder_and_lookup(spark):
    d = tempfile.mkdtemp(prefix="nw-text-")
    for k in (1, 2):
        with open(os.path.join(d, f"doc{k}.txt"), "w") as fh:
            fh.write(f"[[ContentSequence]]\nline one {k}\r\nline two\n")
    texts = files.read_text_folder(spark, d)
    assert sorted(r.doc_id for r in texts.collect()) == ["doc1.txt", "doc2.txt"]
    docs = spark.createDataFrame([("doc1",), ("doc3",)], "doc_id string")
    ok, missing = files.attach_texts(docs, texts, "%s.txt")
    assert [r.doc_id for r in ok.collect()] == ["doc1"] and [r.doc_id for r in missing.collect()] == ["doc3"]


def test_mapping_files_and_id_lists(spark):
    d = tempfile.mkdtemp(prefix="nw-map-")
    with open(os.path.join(d, "eye.json"), "w") as fh:
        json.dump({"blind": ["C0000001", "C0000002\tBLINDNESS\tT047"], "glaucoma": ["C0000002"]}, fh)
    rows = files.read_mapping_files(spark, d)
    m = {(r.cui, r.term) for r in search.mapping_table(rows).collect()}
    assert m == {("C0000001", "blind"), ("C0000002", "glaucoma")}  # later term wins
    c = tempfile.mkdtemp(prefix="nw-ids-")
    for i, ids in enumerate((["a", "b"], ["b", "c"])):
        with open(os.path.join(c, f"ids{i}.csv"), "w") as fh:
            fh.write("SOPInstanceUID\n" + "\n".join(ids) + "\n")
    ids = files.read_id_list(spark, [os.path.join(c, "ids0.csv"), os.path.join(c, "ids1.csv")])
    assert sorted(r.id for r in ids.collect()) == ["a", "b", "c"]


def test_rrf_readers(spark):
    d = tempfile.mkdtemp(prefix="nw-rrf-")
    with open(os.path.join(d, "MRREL.RRF"), "w") as fh:
        fh.write("C1|A|S|RN|C2|A|S||R|S|MTH||||N||\n")
    rel = files.read_mrrel(spark, os.path.join(d, "MRREL.RRF")).collect()
    assert [(r.cui1, r.rel, r.cui2, r.sab) for r in rel] == [("C1", "RN", "C2", "MTH")]


def test_json_repair_and_load(spark):
    good = '{"docId":"d1","annotations":[[{"type":"Sentence","id":1,"startNode":{"offset":5},"endNode":{"offset":9}},' \
           '{"type":"Mention","id":2,"startNode":{"offset":0},"endNode":{"offset":3},"features":{"string_orig":"a"b","inst":"C1"}},' \
           '{"type":"Sentence","id":3,"startNode":{"offset":0},"endNode":{"offset":4}}]]}'
    lines = spark.createDataFrame([(good,), ("not json",)], "value string")
    docs, bad = nlp_json.parse_lines(lines)
    m, _p, s = nlp_json.load_annotations(docs)
    assert [r.str for r in m.collect()] == ['a"b']
    assert [(r.sent_no, r.id, r.start_pos) for r in s.orderBy("sent_no").collect()] == [(1, "sent-2", 0), (2, "sent-1", 5)]
    assert bad.count() == 1


def test_job_window_rule():
    now = datetime(2024, 2, 1)
    assert next_window(JobStatus(), now) == (datetime(2000, 1, 1), now)
    ok = JobStatus("success", datetime(2024, 1, 1), datetime(2024, 1, 15))
    assert next_window(ok, now) == (datetime(2024, 1, 15), now)
    bad = JobStatus("failed", datetime(2024, 1, 1), datetime(2024, 1, 15))
    assert next_window(bad, now) == (datetime(2024, 1, 1), datetime(2024, 1, 15))


def test_incremental_exactly_once(spark):
    root = tempfile.mkdtemp(prefix="nw-stream-")
    src, sink, ck = (os.path.join(root, x) for x in ("src", "sink", "ck"))
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("day", F.to_date("ts"))
    days = sorted(r.day for r in ev.select("day").distinct().collect())
    schema = ev.drop("day").schema
    for dday in days[:3]:
        ev.where(F.col("day") == dday).drop("day").write.mode("append").parquet(src)
    n1 = run_increment(spark, src, schema, sink, ck)
    for dday in days[3:5]:
        ev.where(F.col("day") == dday).drop("day").write.mode("append").parquet(src)
    n2 = run_increment(spark, src, schema, sink, ck)
    expected_first = ev.where(F.col("day").isin(days[:3])).count()
    expected_second = ev.where(F.col("day").isin(days[3:5])).count()
    assert (n1, n2) == (expected_first, expected_second)
    assert spark.read.parquet(sink).count() == expected_first + expected_second
    # a run that dies after the write and before the commit: the batch comes again and replaces itself
    last = max((f for f in os.listdir(os.path.join(ck, "commits")) if f.isdigit()), key=int)
    for f in (last, f".{last}.crc"):
        os.remove(os.path.join(ck, "commits", f))
    assert run_increment(spark, src, schema, sink, ck) == expected_second
    assert spark.read.parquet(sink).count() == expected_first + expected_second
    assert run_increment(spark, src, schema, sink, ck) == 0


def test_processed_round_trip(spark):
    from noteweave.plans.inputs import view
    from noteweave.plans.q_jobs import raw_lines
    docs, _bad = nlp_json.parse_lines(raw_lines(view(spark, SF, "f_note")))
    m, p, s = nlp_json.load_annotations(docs)
    m = m.withColumn("study_concepts", F.array().cast("array<string>")).withColumn("ruled_by", F.array().cast("array<string>"))
    p = p.withColumn("ruled_by", F.array().cast("array<string>"))
    out = nlp_json.processed_documents(m, p, s)
    m2, p2, s2 = nlp_json.read_processed(out)
    key = ["doc_id", "id", "start_pos", "end_pos", "str"]
    assert sorted(map(tuple, m.select(*key).collect())) == sorted(map(tuple, m2.select(*key).collect()))
    assert sorted(map(tuple, s.select("doc_id", "sent_no", "start_pos").collect())) == \
        sorted(map(tuple, s2.select("doc_id", "sent_no", "start_pos").collect()))
    assert p.count() == p2.count()


def test_study_loaders(spark):
    from noteweave.operators import study
    d = tempfile.mkdtemp(prefix="nw-study-")
    tsv = os.path.join(d, "label2concept.tsv")
    with open(tsv, "w") as fh:
        fh.write("stroke\tC0038454\nbad line\nfever\tC0015967\n")
    rows = study.concepts_from_tsv(spark, tsv).orderBy("ord").collect()
    assert [(r.name, r.cui, r.ok) for r in rows] == [("stroke", "C0038454", True), ("bad line", None, False),
                                                     ("fever", "C0015967", True)]
    man = os.path.join(d, "manual_mapped_concepts.json")
    with open(man, "w") as fh:
        json.dump({"b_concept": {"concepts": ["C2", "C3"], "tc": {"closure": 2, "mapped": "x"}},
                   "a_concept": {"concepts": ["C1"]}}, fh)
    got = [(r.ord, r.name, r.cui) for r in study.concepts_from_manual_json(spark, man).collect()]
    assert sorted(got) == [(1, "b_concept", "C2"), (1, "b_concept", "C3"), (2, "a_concept", "C1")]


def test_lookup_tables(spark):
    d = tempfile.mkdtemp(prefix="nw-umls-")
    files_ = {"cui.csv": "cui|tui|tuigroup|cuilabel\nC1|T001,T002|G1,G2|Thing\n",
              "rel.csv": "cui1|has|cui2\nC1|RN|C2,C3\nC2|RB|C9\n",
              "snomed.csv": "snomed|cui\n1234567|C1\n",
              "sty.csv": "tui|tuigroup|tuigrouplabel\nT001|G1|Group one\n"}
    for n, t in files_.items():
        with open(os.path.join(d, n), "w") as fh:
            fh.write(t)
    t = files.read_lookup_tables(spark, d)
    assert [(r.cui, r.tuis, r.tuigroups, r.cuilabel) for r in t["cui"].collect()] == \
        [("C1", ["T001", "T002"], ["G1", "G2"], "Thing")]
    assert sorted((r.cui1, r.cui2) for r in t["rel"].collect()) == [("C1", "C2"), ("C1", "C3")]
    assert [tuple(r) for r in t["snomed"].collect()] == [("1234567", "C1")]


def test_sinks_and_file_readers(spark):
    from noteweave.functions.rules import WORKING_FIELDS, load_deid_rules
    from noteweave.operators import deid, exchange
    from noteweave.plans.inputs import view
    root = tempfile.mkdtemp(prefix="nw-sinks-")
    # S3: one JSON document per file, key = file stem
    jd = os.path.join(root, "json")
    os.makedirs(jd)
    with open(os.path.join(jd, "doc7.json"), "w") as fh:
        fh.write('{"annotations":[[{"type":"Mention","id":1,"startNode":{"offset":0},"endNode":{"offset":2},'
                 '"features":{"string_orig":"ab","inst":"C1"}}]]}')
    with open(os.path.join(jd, "notes.txt"), "w") as fh:
        fh.write("not a json document")
    docs, bad = nlp_json.read_nlp_files(spark, jd, one_doc_per_file=True)
    assert [r.doc_id for r in docs.collect()] == ["doc7"] and bad.count() == 0
    # de-id sinks on a few reports
    rep = view(spark, SF, "f_report").limit(20)
    d = deid.deidentify(rep, load_deid_rules(), WORKING_FIELDS, ["Patient ID", "Patient Name"]).cache()
    files.write_texts(d, os.path.join(root, "texts"))
    phi = deid.phi_table(d)
    files.write_phi_json(phi, os.path.join(root, "phi"))
    files.write_phi_grouped(deid.phi_grouped_lines(phi), os.path.join(root, "grouped"))
    assert spark.read.json(os.path.join(root, "phi")).count() == phi.count()
    assert spark.read.text(os.path.join(root, "texts")).count() > 0
    body, lines = deid.annotation_mode(d)
    assert body.count() == 20 and lines.count() > 0
    # eHOST folder per document, lines in order
    a = view(spark, SF, "f_ann").where(F.col("doc_id") < 40).withColumn("label", F.col("cui"))
    out = os.path.join(root, "ehost")
    exchange.write_ehost(exchange.ehost_lines(a), out, 4)
    back = spark.read.text(out)
    assert back.where(F.col("value").startswith("<?xml")).count() == a.select("doc_id").distinct().count()
    files.write_id_csv(d.select("doc_id"), os.path.join(root, "ids"), "doc_id")
    assert files.read_id_list(spark, os.path.join(root, "ids")).count() == 20
    d.unpersist()


def test_last_line_wins_over_several_files(spark, tmp_path):
    """Files of different sizes, split and dealt in any order: their names and lines decide."""
    from pyspark.sql import functions as F

    from noteweave.operators import study
    from noteweave.sources import files

    folder = tmp_path / "lines"
    folder.mkdir()
    sizes = {"a.txt": 3, "b.txt": 4000, "c.txt": 1, "d.txt": 700}
    want = []
    for name, n in sizes.items():
        lines = [f"{name}-{i}\tC{i % 5}" for i in range(n)]
        want += [line.split("\t") for line in lines]
        (folder / name).write_text("\n".join(lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = study.concepts_from_tsv(spark, str(folder)).orderBy("ord").collect()
        last = {r.cui: r.name for r in study.concepts_from_tsv(spark, str(folder)).groupBy("cui").agg(F.max_by("name", "ord").alias("name")).collect()}
        (folder / "x.rrf").write_text("C1|T1|a|b|c|d|\nC1|T2|a|b|c|d|\n")
        sty = files.read_mrsty(spark, str(folder / "x.rrf"))
        assert sty.groupBy("cui").agg(F.max_by("tui", "line_no").alias("t")).collect()[0].t == "T2"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [[r.name, r.cui] for r in rows] == want
    assert last == {c: n for n, c in want}


def test_sample_and_envelope_are_plans(spark):
    from noteweave.operators import search

    saved = spark.range(1000).selectExpr("'t' as transaction_id", "cast(id as string) as id")
    assert search.training_sample(saved).count() == 100 and search.training_sample(saved, max_n=20).count() == 20
    assert search.training_sample(saved.limit(9)).count() == 0
    header, rows = search.result_envelope(saved, "t")
    assert header.collect()[0].asDict() == {"success": True, "num_results": 1000, "transactionId": "t"} and rows is saved

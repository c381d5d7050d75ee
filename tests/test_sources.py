import gzip
import io
import json
import random
import tarfile

import pytest
from pyspark.sql import functions as F

from strandwise.operators import index, inventory, kmers
from strandwise.sinks import results
from strandwise.sources import metadata, sequences
from strandwise.streaming import ingest


def test_sequence_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.FA").write_text(">one\nacg\n t \nGG\n>empty\n> two x\nTT>three\nAC\n")
    (tmp_path / "sub" / "b.fastq.gz").write_bytes(gzip.compress(b"@r1\nacgt\n+\nIIII\n@r2\nGG\n+\nII\n@r3\n\n+\n\n@r4\nAA\n+\nII\n"))
    (tmp_path / "c.txt").write_text(">no\nACGT\n")
    got = {(r.defline, r.seq) for r in sequences.read(spark, str(tmp_path)).collect()}
    # a line that holds > is a defline, wherever it stands; an empty read ends its file
    assert got == {("one", "ACGTGG"), ("TT>three", "AC"), ("r1", "ACGT"), ("r2", "GG")}
    # the reader that splits files says the same of plain FASTA
    (tmp_path / "d.fa").write_text("AC\n>one\nacg\n t \r\nGG\n>empty\n> two x\nTT\n>three\nAC>x\nGT\nG")
    for name in ("a.FA", "d.fa"):
        path = str(tmp_path / name)
        assert {(r.defline, r.seq) for r in sequences.fasta_lines(spark, path).collect()} == {(r.defline, r.seq) for r in sequences.read(spark, path).collect()}


def test_read_ranges(spark):
    reads = spark.range(1, 12).withColumnRenamed("id", "read_index")
    parts = [sorted(r.read_index for r in sequences.read_range(reads, i, 3).collect()) for i in range(3)]
    assert parts == [[1, 2, 3], [4, 5, 6, 7], [8, 9, 10, 11]]


XML = {
    "e.xml": '<EXPERIMENT accession="E1">\n<TITLE>t &amp; u</TITLE>\n<LIBRARY_STRATEGY>WGS</LIBRARY_STRATEGY>\n</EXPERIMENT>\n<EXPERIMENT accession="E2">\n<EXTERNAL_ID namespace="dbGaP">x</EXTERNAL_ID>\n</EXPERIMENT>',
    "s.xml": '<SAMPLE accession="S1">\n<SCIENTIFIC_NAME>Homo</SCIENTIFIC_NAME>\n<SAMPLE_ATTRIBUTE><TAG>Center</TAG><VALUE>xml</VALUE></SAMPLE_ATTRIBUTE>\n<SAMPLE_ATTRIBUTE><TAG>BioSampleModel</TAG><VALUE>no</VALUE></SAMPLE_ATTRIBUTE>\n<SAMPLE_ATTRIBUTE><TAG>age</TAG><VALUE>1</VALUE></SAMPLE_ATTRIBUTE>\n<SAMPLE_ATTRIBUTE><TAG>age</TAG><VALUE>2</VALUE></SAMPLE_ATTRIBUTE>\n</SAMPLE>',
    "t.xml": '<STUDY accession="T1"><STUDY_TITLE>title</STUDY_TITLE><STUDY_ABSTRACT>abs</STUDY_ABSTRACT></STUDY>',
}


def test_inventory_from_archive(spark, tmp_path):
    with tarfile.open(tmp_path / "m.tar.gz", "w:gz") as tar:
        for name, text in XML.items():
            entry = tarfile.TarInfo(name)
            entry.size = len(text)
            tar.addfile(entry, io.BytesIO(text.encode()))
    head = "Accession\tStatus\tUpdated\tPublished\tType\tVisibility\tReceived\tCenter\tExperiment\tSample\tStudy\tSpots\tBases"
    rows = ["R1\tlive\tRUN\tpublic\t2010-03-24T03:10:22Z\tC1\tE1\tS1\tT1\t10\t1000", "R2\tlive\tRUN\tpublic\t-\t-\tE2\tMultiplex\tT1\t-\t-", "R3\tsuppressed\tRUN\tpublic\t-\t-\tE1\tS1\tT1\t1\t1", "R4\tlive\tRUN\tcontrolled_access\t-\t-\tE1\tS1\tT1\t1\t1", "X\tlive\tSTUDY\tpublic\t-\t-\t-\t-\t-\t-\t-", "R5\tlive\tRUN\tpublic\t2011-01-01\t-\tE9\tMultiplex\tT1\t-\t-"]
    rows = [r.replace("\tRUN\t", "\t-\t-\tRUN\t").replace("\tSTUDY\t", "\t-\t-\tSTUDY\t") for r in rows]
    (tmp_path / "runs.tsv").write_text("\n".join([head, *rows]) + "\n")
    (tmp_path / "ragged.tsv").write_text("\n".join([head, *rows, "R9\tlive"]) + "\n")
    with pytest.raises(Exception, match="13 fields"):
        metadata.runs_from_tsv(spark, str(tmp_path / "ragged.tsv")).collect()
    (tmp_path / "short.tsv").write_text(head.replace("Published\t", "") + "\n")
    with pytest.raises(ValueError, match="Published"):
        metadata.runs_from_tsv(spark, str(tmp_path / "short.tsv"))
    members = metadata.tar_members(spark, str(tmp_path / "m.tar.gz"))
    runs = metadata.runs_from_tsv(spark, str(tmp_path / "runs.tsv"))
    for c in [*inventory.EXPERIMENT, "sample_taxa", "study_title", "study_abstract"]:
        runs = runs.withColumn(c, F.lit(None).cast("string"))
    out = {r.run_accession: r for r in inventory.enriched(runs, metadata.experiments(members), metadata.samples(members), metadata.studies(members)).collect()}
    assert set(out) == {"R1", "R5"}
    r = out["R1"]
    assert (r.experiment_title, r.experiment_library_strategy, r.sample_taxa, r.study_title, str(r.date_received)) == ("t &amp; u", "WGS", "Homo", "title", "2010-03-24")
    assert r.sample_attributes == {"Center": "xml", "age": "2"}
    assert out["R5"].sample_accession is None and out["R5"].number_of_bases == 0


def test_results(spark, tmp_path):
    info = "struct<run_accession:string,study_title:string,sample_attributes:map<string,string>,number_of_bases:long,date_received:date>"
    rows = spark.sql(f"""select 'q "1"' as query, 3 as num_kmers, n as num_kmers_found, r as run_accession,
      cast(struct(r, '', map('b', '2', 'a', '1'), cast(0 as long), date'2010-03-24') as {info}) as info from values (1, 'R2'), (3, 'R1'), (1, 'R1b') t(n, r)""")
    [doc] = results.json_documents(rows, 0.3, ["run_accession", "study_title", "sample_attributes", "number_of_bases", "date_received"]).collect()
    got = json.loads(doc.json)
    assert got["query"] == 'q "1"' and [r["num_kmers_found"] for r in got["results"]] == [3, 1, 1] and got["results"][1]["percent_kmers_found"] == 33.3
    assert got["results"][0]["sample_metadata"] == {"run accession": "R1", "sample attributes": [{"tag": "a", "value": "1"}, {"tag": "b", "value": "2"}], "date received": "2010-3-24"}
    results.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').columns == results.CSV_COLUMNS
    results.write_json(rows, str(tmp_path / "json"), 0.3, ["run_accession"])
    assert spark.read.text(str(tmp_path / "json")).count() == 1
    hit = spark.createDataFrame([("A", 7, 2, 0.5, "ACGT", "d"), ("A", 7, 0, 1.0, "ACGT", "d")], "accession string, read_index long, read_subindex int, score float, seq string, defline string")
    assert [r.line for r in results.read_lines(hit).collect()] == ["A\t7.2\t0.5\tACGT\td", "A\t7\t1.0\tACGT\td"]
    labels = spark.range(2).select(results.query_label(F.col("id"), F.lit(4), F.lit("name")).alias("x"))
    assert [r.x for r in labels.collect()] == ["command line seq 4", "name"]


def test_ingest_goes_on_where_it_was(spark, tmp_path):
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")

    def add(rows):
        spark.createDataFrame(rows, ingest.READS).coalesce(1).write.mode("append").parquet(folder)

    def run():
        ingest.ingest(spark, folder, root, k=5, min_count=1, shortest=15, longest=20).awaitTermination()

    add([(1, "ACGTTGCAAC"), (1, "GGGTTTACG"), (2, "AC")])
    run()
    add([(3, "TTTTTGCA"), (1, "AAAAAAAAAA")])
    run()
    run()
    assert {(r.run_id, r.status) for r in ingest.states_of(spark, root).collect()} == {(1, 14), (2, 16), (3, 14)}
    # run 1 has the reads of both batches
    check_index(spark, root, [(1, "ACGTTGCAAC"), (1, "GGGTTTACG"), (3, "TTTTTGCA"), (1, "AAAAAAAAAA")], 1)
    assert ingest.files_of(spark, root).agg(F.count_distinct("file")).first()[0] == 1


def check_index(spark, root, reads, min_count):
    counted = kmers.abundant(spark.createDataFrame(reads, "id long, seq string"), 5, min_count)
    params = index.run_params(counted, 5, 15, 20)
    want = index.postings(index.merged(index.build(counted, params, 5)))
    blocks, got = ingest.index_of(spark, root)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(got) == rows(params) and rows(index.postings(blocks)) == rows(want.select(index.postings(blocks).columns))


@pytest.mark.parametrize("files_per_batch", [None, 1, 2])
def test_index_does_not_depend_on_batches(spark, tmp_path, files_per_batch):
    """Reads of the same runs in four files; windows reach their least count over batches only."""
    rng = random.Random(3)
    files = [[(rng.randint(1, 3), "".join(rng.choices("ACGT", k=rng.choice([3, 40, 90])))) for _ in range(8)] + [(9, "AC")] for _ in range(4)]
    for rows in files:
        spark.createDataFrame(rows, ingest.READS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), k=5, min_count=2, shortest=15, longest=20, files_per_batch=files_per_batch).awaitTermination()
    check_index(spark, str(tmp_path / "out"), [r for rows in files for r in rows], 2)
    assert {(r.run_id, r.status) for r in ingest.states_of(spark, str(tmp_path / "out")).collect()} == {(1, 14), (2, 14), (3, 14), (9, 16)}


def test_run_states_over_a_stream(spark, tmp_path):
    events = [(1, "download"), (1, "bloom"), (1, "database"), (2, "fail"), (2, "fail"), (2, "download"), (3, "fail"), (3, "fail"), (3, "fail"), (3, "bloom")]
    spark.createDataFrame(events, "run_id long, event string").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("run_id long, event string").parquet(str(tmp_path / "e"))
    q = ingest.run_events(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    want = {(1, "DATABASE_SUCCESS", 0), (2, "DOWNLOAD_SUCCESS", 2), (3, "FAILED", 3)}
    assert {tuple(r) for r in spark.table("states").collect()} == want
    table = spark.createDataFrame([(r, i, e) for i, (r, e) in enumerate(events)] + [(4, 99, "other")], "run_id long, at int, event string")
    assert {tuple(r) for r in ingest.final_states(table).collect()} == want | {(4, "INIT", 0)}

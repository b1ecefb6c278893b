"""A run's files, written and read again."""

import json

import pytest

from ampliform.sources import run_files, sequences


def variants(spark):
    rows = [(7, "a-1.v1", 1, 1, 30, 0.5, "ACGTACGT"), (7, "a-1.v2", 1, 2, 10, None, "ACGTACGA"), (7, "a-2.v1", 2, 1, 5, 1.2, "GGGG"), (9, "b-1.v1", 1, 1, 8, 0.9, "TTTTT")]
    return spark.createDataFrame(rows, "specimen int, cluster_id string, gid int, vid int, size int, err_factor double, seq string")


def test_metadata(spark, tmp_path):
    run_files.write_metadata(variants(spark), str(tmp_path / "m"), "1", "model")
    for i, line in enumerate(x for p in (tmp_path / "m").glob("part-*") for x in p.read_text().splitlines()):
        (tmp_path / f"s{i}-metadata.json").write_text(json.dumps(json.loads(line), indent=1))
    (tmp_path / "bad-metadata.json").write_text("{ no")
    m = run_files.read_metadata(spark, str(tmp_path / "*-metadata.json"))
    assert {(r.specimen, r.error_model, r.cluster_id, r.m, r.err_factor) for r in run_files.specimens(m).collect()} == {("7", "model", "a-1.v1", 30, 0.5), ("9", "model", "b-1.v1", 8, 0.9)}
    (tmp_path / "old-metadata.json").write_text(json.dumps({"schema_version": "1.4"}))
    with pytest.raises(Exception, match=r"schema 1\.4"):
        run_files.read_metadata(spark, str(tmp_path / "old-metadata.json")).collect()


def test_records(spark, tmp_path):
    v = variants(spark).selectExpr("specimen", "case when vid = 1 then 'pass' else 'ns' end as track", "cluster_id as name", "concat('size=', size, ' ric=', size, ' gid=', gid, ' vid=', vid) as head", "seq")
    run_files.write_records(v, str(tmp_path / "out"), ["track", "specimen"])
    got = run_files.read_records(spark, str(tmp_path / "out/*/*/*"), min_ric=6)
    assert {(r.name, r.size, r.gid, r.vid, r.seq) for r in got.collect()} == {("a-1.v1", 30, 1, 1, "ACGTACGT"), ("a-1.v2", 10, 1, 2, "ACGTACGA"), ("b-1.v1", 8, 1, 1, "TTTTT")}


def test_alignments_clusters_and_files(spark, tmp_path):
    (tmp_path / "s-1.v1-RiC3-msa.fasta").write_text(">r1\nAC-T\n>r2\nACGT\n>Consensus\nACGT\n")
    got = run_files.read_alignments(spark, str(tmp_path / "*-msa.fasta")).collect()
    assert {(r.ric, r.read_id, r.row_aln, r.consensus) for r in got} == {(3, "r1", "AC-T", "ACGT"), (3, "r2", "ACGT", "ACGT")}
    (tmp_path / "clusters.txt").write_text("a\tb\nc\n")
    assert {tuple(r) for r in run_files.read_clusters(spark, str(tmp_path / "clusters.txt")).collect()} == {("a", "a"), ("a", "b"), ("c", "c")}
    for name in ("x-1.v1-RiC3-reads.fastq", "x-1.v1-RiC3-untrimmed.fastq", "y-1.v1-RiC3-untrimmed.fastq"):
        (tmp_path / name).write_text("@r\nA\n+\nI\n")
    assert {(r.specimen, r.stage, len(r.files)) for r in run_files.read_files(spark, str(tmp_path / "*.fastq")).collect()} == {("x", "reads", 1), ("y", "untrimmed", 1)}


def test_summary(spark, tmp_path):
    rows = spark.createDataFrame([("a", "a-1.v1", 9, 5, 1), ("a", "a-1.v2", 8, 4, 2)], "specimen string, filename string, length int, ric int, multiple int")
    run_files.write_summary(rows, str(tmp_path / "s"))
    lines = [x for p in sorted((tmp_path / "s").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == ["a-1.v1\t9\t5\t1", "a-1.v2\t8\t4\t2", "Variants\t2", "Specimens\t1", "Reads\t9"]


def test_large_fastq_is_split(spark, tmp_path):
    want = [(f"r{i}", "ACGT" * (i % 9 + 1), "@+5I" * (i % 9 + 1)) for i in range(5000)]
    (tmp_path / "x.fastq").write_text("".join(f"@{n} more\n{s}\n+\n{q}\n" for n, s, q in want))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert spark.read.text(str(tmp_path / "x.fastq")).rdd.getNumPartitions() > 4
        got = [(r.read_id, r.seq, r.qual) for r in sequences.read_fastq(spark, str(tmp_path / "x.fastq")).orderBy("ord").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want


def test_cluster_files(spark, tmp_path):
    reads = spark.createDataFrame([(i, f"r{i} x", "ACGT", "IIII") for i in range(4)], "read_id long, title string, seq string, qual string")
    members = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2)], "cluster string, read_id long")
    rows = spark.createDataFrame([("a", 0, "AC-GT"), ("a", 1, "ACTGT"), ("b", 2, "ACGT")], "cluster string, read_id long, row_aln string")
    cons = spark.createDataFrame([("a", "AC-GT"), ("b", "ACGT")], "cluster string, consensus string")
    records = spark.createDataFrame([("a", "a.v1", "size=2", "ACGT"), ("b", "b.v1", "size=1", "ACGT")], "cluster string, name string, head string, seq string")
    run_files.write_clusters(records, reads, members, rows, cons, str(tmp_path), ["cluster"])
    fastq = sequences.read_fastq(spark, str(tmp_path / "reads/*/*")).collect()
    assert {("cluster=a" in r.path, r.read_id) for r in fastq} == {(True, "r0"), (True, "r1"), (False, "r2")}
    got = {(r.read_id, r.row_aln, r.consensus) for f in ("a", "b") for r in run_files.read_alignments(spark, str(tmp_path / f"alignments/cluster={f}")).collect() if r.read_id != "1"}
    assert {("0", "AC-GT"), ("2", "ACGT")} <= {(a, b) for a, b, _ in got}
    assert run_files.read_records(spark, str(tmp_path / "records/*/*")).count() == 2


def test_reports(spark, tmp_path):
    lines = lambda name: sorted(x for p in (tmp_path / name).rglob("part-*") for x in p.read_text().splitlines())
    leaves = spark.createDataFrame([(1, "A", 10), (1, "A", 11), (1, "G-C", 12), (2, "", 13)], "g long, path string, read long")
    late = spark.createDataFrame([(1, "", 14)], "g long, path string, read long")
    run_files.write_phasing(leaves, late, str(tmp_path / "phasing"), "g")
    one, two = map(json.loads, lines("phasing"))
    assert (one["split"], one["leaves"], one["deferred"]) == (True, [{"path": "A", "reads": 2}, {"path": "G-C", "reads": 1}], 1)
    assert (two["split"], two["leaves_n"], two["deferred"]) == (False, 1, 0)
    stats = spark.createDataFrame([("s", 1, 9, 1, 0, 0, 0.1111111, 8, 1, 0, 0, 0), ("s", 0, 9, 0, 0, 0, 0.0, 9, 0, 0, 0, 0)], "specimen string, pos int, coverage int, subs int, ins int, dels int, rate double, A int, C int, G int, T int, gap int")
    run_files.write_positions(stats, str(tmp_path / "pos"), "specimen")
    assert [x for x in lines("pos") if not x.startswith("specimen\t")] == ["s\t1\t9\t1\t0\t0\t0.111111\t8\t1\t0\t0\t0"]
    obs = spark.createDataFrame([("A", 3, 3, "clean"), ("A", 3, 3, "clean"), ("A", 3, 2, "clean"), ("A", 3, 1, "complex")], "run_base string, length int, called int, status string")
    run_files.write_run_lengths(obs, str(tmp_path / "runs"))
    assert [x for x in lines("runs") if x[0] == "A"] == ["A\t3\t2\t1\t0.333333", "A\t3\t3\t2\t0.666667"]
    tree = spark.createDataFrame([("s", 2, "└─ ", "v2"), ("s", 1, "", "v1")], "specimen string, place int, lead string, label string")
    run_files.write_trees(tree, str(tmp_path / "trees"), ["specimen"])
    assert [x for p in (tmp_path / "trees/specimen=s").glob("part-*") for x in p.read_text().splitlines()] == ["v1", "└─ v2"]
    merges = spark.createDataFrame([("s", [300, 170], 170, 0, 130, 300)], "specimen string, lengths array<int>, overlap int, prefix int, suffix int, length int")
    assert run_files.merge_report(merges).first().line == "2 variants (300+170 bp) share 170 bp, extend it by 0 and 130 bp: 300 bp"

import pytest

from ampliform.sources import sequences


def test_fastq_round_trip(spark, tmp_path):
    rows = [("r1 x=1", "ACGT", "@III"), ("r2", "AC", "+@")]
    df = spark.createDataFrame(rows, "title string, seq string, qual string")
    sequences.write_fastq(df, str(tmp_path / "q"))
    got = sequences.read_fastq(spark, str(tmp_path / "q/*.txt")).select("read_id", "title", "seq", "qual").collect()
    assert sorted(map(tuple, got)) == [("r1", "r1 x=1", "ACGT", "@III"), ("r2", "r2", "AC", "+@")]


def test_fastq_malformed(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r\nACGT\nIIII\n")
    with pytest.raises(Exception, match="cut off|malformed"):
        sequences.read_fastq(spark, str(tmp_path / "a.fastq")).collect()


def test_fasta_and_primers(spark, tmp_path):
    (tmp_path / "p.fasta").write_text(">f1 position=forward\nacgt\nAC\n>r1 position=reverse\nGG\n>b1\nTT\n")
    got = {tuple(r) for r in sequences.read_primers(spark, str(tmp_path / "p.fasta")).collect()}
    assert got == {("f1", "ACGTAC", "forward"), ("r1", "GG", "reverse"), ("b1", "TT", "forward"), ("b1", "TT", "reverse")}

"""FASTA and FASTQ files.

Both are read as text, so large files are split. FASTA has a record separator. A FASTQ file's records can't be told apart from
its middle, as quality lines may begin with the mark of a record: its lines are numbered, within the block of the file that a
task reads and over the counts of the blocks before, and four lines are a record.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(path, read_id, title, seq) of each record; lines of a sequence are joined."""
    raw = spark.read.option("lineSep", "\n>").text(path).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "^>", "").alias("value")).where("trim(value) <> ''")
    title = F.trim(F.substring_index("value", "\n", 1))
    seq = F.regexp_replace(F.when(F.contains("value", F.lit("\n")), F.expr("substring(value, instr(value, '\n') + 1)")).otherwise(""), r"\s", "")
    return raw.select("path", F.element_at(F.split(title, r"\s+"), 1).alias("read_id"), title.alias("title"), seq.alias("seq"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(path, ord, read_id, title, seq, qual) of each record; a malformed or cut off one is an error."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.regexp_replace("value", "\r$", "").alias("value"), F.monotonically_increasing_id().alias("k"))
    blocks = lines.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("k").alias("least"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = lines.join(blocks.withColumn("before", before).drop("n"), ["path", "block"]).withColumn("at", F.col("before") + F.col("k") - F.col("least"))
    line = lambda i: F.max(F.when(F.col("at") % 4 == i, F.col("value")))
    r = at.groupBy("path", F.floor(F.col("at") / 4).alias("ord")).agg(line(0).alias("head"), line(1).alias("seq"), line(2).alias("plus"), line(3).alias("qual"))
    r = r.where("trim(concat_ws('', head, seq, plus, qual)) <> ''")  # blank lines at the end
    ok = F.col("head").startswith("@") & F.col("plus").startswith("+") & (F.length("seq") == F.length("qual"))
    title = F.when(F.coalesce(ok, F.lit(False)), F.substring("head", 2, 1 << 30)).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(": record "), F.col("ord").cast("string"), F.lit(" is malformed"))))
    return r.select("path", "ord", title.alias("title"), "seq", "qual").select("path", "ord", F.element_at(F.split("title", r"\s+"), 1).alias("read_id"), "title", "seq", "qual")


def read_primers(spark: SparkSession, path: str) -> DataFrame:
    """(name, seq, position): position forward or reverse by the title; a record without one is given as both."""
    p = read_fasta(spark, path)
    low = F.lower("title")
    where = F.when(low.contains("position=forward"), F.array(F.lit("forward"))).when(low.contains("position=reverse"), F.array(F.lit("reverse"))).otherwise(F.array(F.lit("forward"), F.lit("reverse")))
    return p.select(F.col("read_id").alias("name"), F.upper("seq").alias("seq"), F.explode(where).alias("position"))


def write_fastq(reads: DataFrame, path: str, by: list[str] | None = None) -> None:
    """One record of four lines per row; a folder per value of ``by``."""
    text = reads.select(*(by or []), F.concat_ws("\n", F.concat(F.lit("@"), "title"), "seq", F.lit("+"), "qual").alias("value"))
    (text.write.partitionBy(*by) if by else text.write).text(path)


def write_fasta(records: DataFrame, path: str, by: list[str] | None = None) -> None:
    text = records.select(*(by or []), F.concat_ws("\n", F.concat(F.lit(">"), "title"), "seq").alias("value"))
    (text.write.partitionBy(*by) if by else text.write).text(path)


def write_table(rows: DataFrame, path: str) -> None:
    """Tab-separated with a header."""
    rows.write.option("sep", "\t").option("header", True).csv(path)

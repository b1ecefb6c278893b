"""The files of a run: consensus records, alignments, metadata, clusters and reports, read from folders and written to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import records
from .sequences import read_fasta

#: Which reads of a specimen to take, if there are several files.
STAGES = ("sampled", "reads", "untrimmed")
METADATA = """schema_version string, version string, sample_name string, parameters struct<error_model: string>, total_input_reads bigint,
    variants array<struct<cluster_id: string, group_rank: int, variant_rank: int, M: int, N: int, err_factor: double, err_factor_obs_sum: double, err_factor_exp_sum: double, err_factor_cols: bigint>>"""


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def reads_in_name(path: Column) -> Column:
    """The number of reads that a file's name states; null without one."""
    return F.nullif(F.regexp_extract(file_name(path), r"-RiC(\d+)", 1), F.lit("")).cast("int")


def read_records(spark: SparkSession, path: str, min_ric: int = 0, min_len: int = 0, max_len: int = 0) -> DataFrame:
    """(path, name, ..., seq) of consensus records, their headers parsed; bounds of 0 are off; summaries are left out."""
    r = read_fasta(spark, path).where(~F.col("path").endswith("summary.fasta"))
    x = r.select("path", records.parse(F.col("title")).alias("x"), F.upper("seq").alias("seq")).select("path", "x.*", "seq").where(F.col("ric") >= min_ric)
    x = x.where(F.length("seq") >= min_len) if min_len else x
    return x.where(F.length("seq") <= max_len) if max_len else x


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """(path, ric, read_id, row_aln, consensus) of the reads of alignment files; a file without a row named Consensus has consensus null."""
    r = read_fasta(spark, path).select("path", "read_id", F.upper("seq").alias("row_aln"))
    own = F.max(F.when(F.col("read_id").startswith("Consensus"), F.col("row_aln"))).over(Window.partitionBy("path"))
    return r.withColumn("consensus", own).where(~F.col("read_id").startswith("Consensus")).select("path", reads_in_name(F.col("path")).alias("ric"), "read_id", "row_aln", "consensus")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """One row per metadata file. Files that can't be parsed are left out; a schema other than 2 is an error."""
    m = spark.read.schema(METADATA).option("multiLine", True).option("mode", "PERMISSIVE").json(path).where("schema_version is not null")
    return m.withColumn("schema_version", F.when(F.col("schema_version").startswith("2."), F.col("schema_version")).otherwise(F.raise_error(F.concat(F.lit("schema "), "schema_version"))))


def specimens(metadata: DataFrame) -> DataFrame:
    """(specimen, error_model, cluster_id, m, err_factor): the largest variant of each specimen's first group."""
    first = F.filter("variants", lambda v: v["group_rank"] == 1)
    best = F.reduce(first, F.lit(None).cast("struct<cluster_id: string, M: int, err_factor: double>"), lambda a, v: F.when(a.isNull() | (v["M"] > a["M"]), F.struct(v["cluster_id"].alias("cluster_id"), v["M"].alias("M"), v["err_factor"].alias("err_factor"))).otherwise(a))
    return metadata.withColumn("best", best).select(F.col("sample_name").alias("specimen"), F.col("parameters.error_model").alias("error_model"), "best.cluster_id", F.col("best.M").alias("m"), "best.err_factor")


def with_sums(variants: DataFrame, metadata: DataFrame) -> DataFrame:
    """``variants`` (cluster_id) with the sums behind their error factors, where the metadata has them."""
    v = metadata.select(F.explode("variants").alias("v")).select("v.cluster_id", F.col("v.err_factor_obs_sum").alias("obs_sum"), F.col("v.err_factor_exp_sum").alias("exp_sum"), F.col("v.err_factor_cols").alias("cols"))
    return variants.join(v, "cluster_id", "left")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(specimen, stage, files): the FASTQ files of each specimen, of the first stage that has any."""
    f = spark.read.format("binaryFile").load(path).select("path")
    stage = F.regexp_extract(file_name(F.col("path")), rf"-({'|'.join(STAGES)})\.fastq$", 1)
    f = f.withColumn("stage", stage).where("stage <> ''").withColumn("rank", F.array_position(F.array(*map(F.lit, STAGES)), F.col("stage")))
    f = f.withColumn("specimen", records.specimen_of(F.regexp_replace(file_name(F.col("path")), r"-[a-z]+\.fastq$", "")))
    f = f.withColumn("least", F.min("rank").over(Window.partitionBy("specimen"))).where("rank = least")
    return f.groupBy("specimen", "stage").agg(F.array_sort(F.collect_list("path")).alias("files"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """(cluster, read_id) of lines of names with tabs between, one line a cluster, which its first name names."""
    line = spark.read.text(path).where("trim(value) <> ''").select(F.split("value", "\t").alias("names"))
    return line.select(F.col("names")[0].alias("cluster"), F.explode("names").alias("read_id"))


def write_edges(edges: DataFrame, path: str) -> None:
    """Both ways, with tabs between: name, name, weight of six decimals."""
    text = lambda a, b: F.concat_ws("\t", F.col(a).cast("string"), F.col(b).cast("string"), F.format_string("%.6f", "weight")).alias("value")
    edges.select(text("src", "dst")).union(edges.select(text("dst", "src"))).write.text(path)


def write_records(variants: DataFrame, path: str, by: list[str]) -> None:
    """FASTA in folders by ``by`` (specimen, track), from (name, head, seq): variants of each track come apart."""
    text = variants.select(*by, F.concat_ws("\n", F.concat(F.lit(">"), F.concat_ws(" ", "name", "head")), "seq").alias("value"))
    text.write.partitionBy(*by).text(path)


def write_metadata(variants: DataFrame, path: str, version: str, model: str) -> None:
    """One line of JSON per specimen: its variants by rank, and its identity groups with their members."""
    v = F.struct("cluster_id", F.col("gid").alias("group_rank"), F.col("vid").alias("variant_rank"), F.col("size").alias("M"), F.col("n").alias("N"), F.col("err_factor").cast("double").alias("err_factor"))
    with_n = variants.withColumn("n", F.sum("size").over(Window.partitionBy("specimen", "gid")))
    groups = with_n.groupBy("specimen", "gid").agg(F.first("n").alias("n"), F.array_sort(F.collect_list("cluster_id")).alias("members"))
    groups = groups.groupBy("specimen").agg(F.array_sort(F.collect_list(F.struct(F.col("gid").alias("group_id"), F.col("n").alias("group_N"), "members"))).alias("identity_groups"))
    rows = with_n.groupBy("specimen").agg(F.transform(F.array_sort(F.collect_list(F.struct("gid", "vid", v.alias("v")))), lambda x: x["v"]).alias("variants"), F.sum("size").alias("total_input_reads"))
    fields = F.struct(F.lit("2.0").alias("schema_version"), F.lit(version).alias("version"), F.col("specimen").cast("string").alias("sample_name"), F.struct(F.lit(model).alias("error_model")).alias("parameters"), "total_input_reads", "identity_groups", "variants")
    rows.join(groups, "specimen").select(F.to_json(fields).alias("value")).write.text(path)


def write_summary(rows: DataFrame, path: str) -> None:
    """Filename, Length, RiC and Multiple with tabs between, then the totals: variants, specimens, reads."""
    lines = rows.select(F.lit(0).alias("kind"), F.concat_ws("\t", "filename", "length", "ric", "multiple").alias("value"), "filename")
    total = rows.agg(F.count("*").alias("n"), F.countDistinct("specimen").alias("s"), F.coalesce(F.sum("ric"), F.lit(0)).alias("r"))
    total = total.select(F.lit(1), F.concat_ws("\n", F.concat(F.lit("Variants\t"), "n"), F.concat(F.lit("Specimens\t"), "s"), F.concat(F.lit("Reads\t"), "r")), F.lit(""))
    lines.union(total).orderBy("kind", "filename").select("value").write.text(path)


def write_discards(reads: DataFrame, discards: DataFrame, path: str) -> None:
    """FASTQ of the discarded reads, by name."""
    from .sequences import write_fastq

    write_fastq(reads.join(discards.select("read_id").distinct(), "read_id", "left_semi").orderBy("read_id"), path)


def write_cluster_reads(reads: DataFrame, members: DataFrame, path: str, by: list[str]) -> None:
    """FASTQ of the reads of each cluster, in folders by ``by`` (specimen, cluster): members has (by, read_id), reads (read_id, title, seq, qual)."""
    from .sequences import write_fastq

    write_fastq(reads.join(members.select(*by, "read_id").distinct(), "read_id"), path, by)


def write_alignments(rows: DataFrame, consensus: DataFrame, path: str, by: list[str]) -> None:
    """Aligned reads (by, read_id, row_aln) of each cluster as FASTA, in folders by ``by``, with the row of (by, consensus) named Consensus; what
    `read_alignments` reads."""
    text = lambda name, row: F.concat_ws("\n", F.concat(F.lit(">"), name), row).alias("value")
    both = rows.select(*by, text(F.col("read_id").cast("string"), F.col("row_aln"))).union(consensus.select(*by, text(F.lit("Consensus"), F.col("consensus"))))
    both.write.partitionBy(*by).text(path)


def write_clusters(variants: DataFrame, reads: DataFrame, members: DataFrame, rows: DataFrame, consensus: DataFrame, path: str, by: list[str]) -> None:
    """All that is kept of clusters, each in a folder of its own below ``path``: their records, reads and alignments."""
    write_records(variants, f"{path}/records", by)
    write_cluster_reads(reads, members, f"{path}/reads", by)
    write_alignments(rows, consensus, f"{path}/alignments", by)


def write_phasing(leaves: DataFrame, deferred: DataFrame, path: str, group: str) -> None:
    """One line of JSON per group: how often it split, its leaves with their paths and reads, and how many reads were deferred."""
    parts = leaves.groupBy(group, "path").agg(F.count("*").alias("reads"))
    own = parts.groupBy(group).agg(F.array_sort(F.collect_list(F.struct((-F.col("reads")).alias("order"), "path", "reads"))).alias("x"))
    late = deferred.groupBy(group).agg(F.count("*").alias("deferred"))
    leaf = F.transform("x", lambda p: F.struct(p["path"].alias("path"), p["reads"].alias("reads")))
    line = own.join(late, group, "left").select(F.col(group).cast("string").alias("group"), (F.size("x") > 1).alias("split"), F.size("x").alias("leaves_n"), leaf.alias("leaves"), F.coalesce("deferred", F.lit(0)).alias("deferred"))
    line.select(F.to_json(F.struct("*")).alias("value")).write.text(path)


def write_positions(statistics: DataFrame, path: str, group: str) -> None:
    """Columns that differ from the consensus, a tab between fields, sorted by group and place: counts of each base, errors by kind, rate."""
    s = statistics.where("subs + ins + dels > 0").select(group, "pos", "coverage", "subs", "ins", "dels", F.round("rate", 6).alias("rate"), "A", "C", "G", "T", "gap")
    s.repartitionByRange(group, "pos").sortWithinPartitions(group, "pos").write.option("sep", "\t").option("header", True).csv(path)


def write_run_lengths(observations: DataFrame, path: str) -> None:
    """How often runs of each base and length are called each length, with its share, as a table."""
    n = observations.where("status = 'clean'").groupBy("run_base", "length", "called").agg(F.count("*").alias("n"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy("run_base", "length")), 6)
    n.withColumn("share", share).orderBy("run_base", "length", "called").write.option("sep", "\t").option("header", True).csv(path)


def write_trees(lines: DataFrame, path: str, by: list[str]) -> None:
    """Variant trees as text, a folder per value of ``by``: (by, place, lead, label) of `tree.reading_order`, in order of place."""
    lines.repartition(*by).sortWithinPartitions(*by, "place").select(*by, F.concat("lead", "label").alias("value")).write.partitionBy(*by).text(path)


def merge_report(merges: DataFrame) -> DataFrame:
    """(specimen, line): what variants of different extent were joined: how many, their lengths, what they share, and what came out."""
    many = F.array_join(F.transform("lengths", lambda n: n.cast("string")), "+")
    return merges.select("specimen", F.concat_ws("", F.size("lengths").cast("string"), F.lit(" variants ("), many, F.lit(" bp) share "), F.col("overlap").cast("string"), F.lit(" bp, extend it by "), F.col("prefix").cast("string"), F.lit(" and "), F.col("suffix").cast("string"), F.lit(" bp: "), F.col("length").cast("string"), F.lit(" bp")).alias("line"))

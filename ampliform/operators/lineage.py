"""Merged records traced back to the reads of the clusters that they came from, and measured anew from these.

A record may be a merge of merges. Each round replaces the parts that are merges themselves by their parts' parts, so a lineage of any depth takes
rounds by its logarithm. What a merged record inherits of its largest part describes that part alone; pooled reads give what describes it whole.

Edge cases: a record without parts is its own and only one. A read that reaches a record on several ways counts once. Records whose reads aren't
there have no figures. Parts that lead in a circle raise an error.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .alignments import composition, expected_error
from .frames import common_columns, consensus_rows, run_context, scored
from .tables import cut, discard


def contributors(records: DataFrame, merges: DataFrame, record: str, part: str) -> DataFrame:
    """(record, part): the unmerged parts of each of ``records``; merges has (record, part), one row a part."""
    now = cut(merges.select(F.col(record).alias("r"), F.col(part).alias("p")).where("r <> p").distinct())
    rounds, many = 0, now.count()
    while (inner := now.join(now.select(F.col("r").alias("p")).distinct(), "p", "left_semi")).limit(1).count():
        if 1 << rounds > 2 * many:
            raise ValueError("parts lead in a circle")
        below = now.select(F.col("r").alias("p"), F.col("p").alias("q"))
        deeper = inner.join(below, "p").select("r", F.col("q").alias("p"))
        raw = now.join(now.select(F.col("r").alias("p")).distinct(), "p", "left_anti").select("r", "p")
        new = cut(raw.union(deeper).distinct())
        discard(now)
        now, rounds = new, rounds + 1
    known = records.select(F.col(record).alias("r")).distinct()
    return known.join(now, "r", "left").select(F.col("r").alias(record), F.coalesce("p", "r").alias(part))


def pooled(records: DataFrame, merges: DataFrame, reads: DataFrame, record: str, part: str, read: str) -> DataFrame:
    """(record, ...): the reads (part, read, ...) of all parts of each record, each once."""
    return contributors(records, merges, record, part).join(reads, part).drop(part).dropDuplicates([record, read])


def refreshed(records: DataFrame, merges: DataFrame, reads: DataFrame, record: str, part: str, read: str, seq: str, rates: dict[str, float], run: int = 6) -> DataFrame:
    """(record, n_reads, rid, rid_min, err_factor) of each record, from the reads of all that it was merged of, aligned together."""
    own = cut(pooled(records, merges, reads.select(part, read, seq), record, part, read))
    rows = cut(common_columns(own, record, read, seq))
    s = scored(rows, run_context(consensus_rows(rows, record), record, run), record)
    rid = s.groupBy(record).agg(F.count("*").alias("n_reads"), F.avg("rid").alias("rid"), F.min("rid").alias("rid_min"))
    err = expected_error(rows, composition(rows, record, read, "row_aln"), rates, record).select(record, "err_factor")
    return records.select(record).distinct().join(rid, record, "left").join(err, record, "left").select(record, F.coalesce("n_reads", F.lit(0)).alias("n_reads"), "rid", "rid_min", "err_factor")

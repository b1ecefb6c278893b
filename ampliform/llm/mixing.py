"""Mixing sources to target weights: a low-discrepancy source schedule, in DataFrame operations alone.

Each source's documents are laid on a line of words in an order shuffled by hash; the line is cut into blocks of
``BLOCK`` words. Slot i of the mix belongs to the source whose share of [0, 1), the cumulative numbers of blocks that
targets need, holds the fractional part of i times the golden ratio. Among n successive points no gap is wider than
2.62 / n, so within 3 times the blocks in all every source has its slots, the smallest too. A source's r-th slot takes its block r, beginning again at the
line's start after the last, and the slot that reaches the target takes only what is missing. A document's part is what
the slots take of its own stretch of the line.

Running sums and ranks are taken in two levels (within small buckets, then over the buckets' sums), so a hot source is
never in one task. Only the table of sources goes through a window without a key; it has a row per source.

Edge cases: a null text has size 0; documents of size 0 are never taken; a source of size 0 has target 0; the null
source is a source of its own, last in order; an empty table gives an empty result. Rows that repeat a doc_id are
documents of their own; `apply` deals what equal rows take evenly, and what is left over to one of them. Results depend on the rows alone, not on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh

#: Words of a block, and slots whose ranks are summed together.
BLOCK, CHUNK = 1024, 4096
#: Shares of [0, 1) are looked up by cells of this width.
_CELLS = 1024
_GOLDEN = 0.6180339887498949


def words(text: str) -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+``."""
    one = F.trim(F.regexp_replace(F.coalesce(F.col(text).cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", " "))
    return F.when(one == "", 0).otherwise(F.length(one) - F.length(F.replace(one, F.lit(" "), F.lit(""))) + 1).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size).

    Weights repeat over the sources by code point, null last. The targets share ``share`` times all sizes by weight,
    none above ``most`` times its source's size: sources fill up in the order of cap over weight, and what they can't
    hold is shared by the others.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("double"))
    ranked = ranked.withColumn("cap", F.lit(most) * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    everything = Window.partitionBy()
    below = F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    level = (F.sum("source_size").over(everything) * F.lit(share) - below) / left
    filled = ranked.withColumn("level", level)
    ratio = F.col("cap") / F.col("w")
    open_level = F.min(F.when(ratio >= F.col("level"), F.struct(ratio.alias("ratio"), "rank", "level"))).over(everything)["level"]
    return filled.select("source", "source_size", "rank", F.least("cap", F.coalesce(open_level * F.col("w"), F.col("cap"))).alias("target"))


def _sized(docs: DataFrame, text: str, doc_id: str, source: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), words(text).alias("size"), F.xxhash64(F.col(text).cast("string")).alias("th"))


def _slots(plan: DataFrame) -> DataFrame:
    """(rank, block, take): what each slot of the mix takes from a source's line."""
    spark = plan.sparkSession
    goal = plan.where("target >= 1").select("rank", "source_size", F.round("target").cast("long").alias("goal"))
    # whole rounds over the source's blocks, then those of what is left
    whole, rest = F.floor(F.col("goal") / F.col("source_size")), F.col("goal") % F.col("source_size")
    goal = goal.withColumn("need", whole * F.ceil(F.col("source_size") / BLOCK) + F.ceil(rest / BLOCK))
    upto = F.sum("need").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    share = goal.withColumn("high", upto / F.sum("need").over(Window.partitionBy())).withColumn("low", F.coalesce(F.lag("high").over(Window.orderBy("rank")), F.lit(0.0)))
    share = cut(share)
    blocks, sources = share.agg(F.coalesce(F.sum("need"), F.lit(0)), F.count("*")).first()
    cells = share.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * _CELLS), F.floor(F.col("high") * _CELLS))))
    for n in (min(int(1.05 * blocks) + 4 * sources, 3 * blocks), 3 * blocks):
        point = F.pmod((F.col("id") + 1) * F.lit(_GOLDEN), F.lit(1.0))
        slots = spark.range(n).select("id", point.alias("u")).withColumn("cell", F.floor(F.col("u") * _CELLS))
        own = slots.join(cells, "cell").where("u >= low and u < high").select("id", "rank", (F.col("id") / CHUNK).cast("long").alias("chunk"))
        counts = cut(own.groupBy("rank", "chunk").agg(F.count("*").alias("n")))
        got = share.join(counts.groupBy("rank").agg(F.sum("n").alias("got")), "rank", "left")
        if not got.where("coalesce(got, 0) < need").limit(1).count():
            break
    else:
        raise RuntimeError("a source has too few slots")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("rank").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("rank", "chunk").orderBy("id")) - 1
    ranked = own.withColumn("i", within).join(counts.withColumn("before", before).drop("n"), ["rank", "chunk"]).withColumn("r", F.col("i") + F.col("before"))
    ranked = ranked.join(share.select("rank", "source_size", "goal"), "rank")
    blocks = F.ceil(F.col("source_size") / BLOCK)
    ranked = ranked.withColumn("block", F.col("r") % blocks).withColumn("start", F.floor(F.col("r") / blocks) * F.col("source_size") + F.col("block") * BLOCK)
    take = F.least(F.lit(BLOCK), F.col("source_size") - F.col("block") * BLOCK, F.col("goal") - F.col("start"))
    return ranked.where(F.col("start") < F.col("goal")).select("rank", "block", take.alias("take"))


def _mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, source, th (a hash of the text), size, source_size, target and taken of each row."""
    sized = cut(_sized(docs, text, doc_id, source))
    plan = cut(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    buckets = max(16, sized.count() // 5000)
    some = sized.where("size > 0").withColumn("h", F.xxhash64("doc_id", F.lit(42))).withColumn("bucket", F.pmod("h", F.lit(buckets)))
    sums = some.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before")
    within = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "th").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    lines = some.withColumn("within", within).join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    # one row per source goes along by source, not by document
    lines = lines.withColumn("a", F.col("within") + F.col("before")).select("doc_id", "source", "th", "size", "a")
    own = plan.select(F.col("source").alias("s"), "source_size", "target", "rank")
    lines = lines.join(F.broadcast(own), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    spread = lines.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / BLOCK), F.floor((F.col("a") + F.col("size") - 1) / BLOCK))))
    begin = F.greatest(F.col("a") - F.col("block") * BLOCK, F.lit(0))
    end = F.least(F.col("a") + F.col("size") - F.col("block") * BLOCK, F.lit(BLOCK))
    taken = F.greatest(F.least(end, F.coalesce("take", F.lit(0))) - begin, F.lit(0))
    joined = spread.join(_slots(plan), ["rank", "block"], "left")
    some_taken = joined.groupBy("doc_id", "source", "th", "rank", "a", "size", "source_size", "target").agg(F.sum(taken).alias("taken"))
    none = sized.where("size = 0").join(F.broadcast(own), F.col("source").eqNullSafe(F.col("s")))
    out = ("doc_id", "source", "th", "size", "source_size", "target")
    return some_taken.select(*out, "taken").union(none.select(*out, F.lit(0).cast("long")))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """doc_id, size, source_size, target and taken of each row."""
    return _mixed(docs, weights, share, most, text, doc_id, source).select("doc_id", "size", "source_size", "target", "taken")


def apply(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0, text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """The mix itself: each row of ``docs`` as often as the mix takes it, to the nearest whole number; columns unchanged."""
    part = _mixed(docs, weights, share, most, text, doc_id, source).where("size > 0")
    names = [fresh(x, docs.columns) for x in ("k_id", "k_source", "k_th", "k_n", "k_rest", "k_own")]
    i, s, h, n, rest, own = names
    times = F.floor(F.col("taken") / F.col("size") + 0.5)
    alike = part.groupBy(F.col("doc_id").alias(i), F.col("source").alias(s), F.col("th").alias(h)).agg(F.sum(times).alias("all"), F.count("*").alias("rows"))
    copies = alike.select(i, s, h, F.floor(F.col("all") / F.col("rows")).cast("int").alias(n), (F.col("all") % F.col("rows")).cast("int").alias(rest)).where(F.col(n) + F.col(rest) > 0)
    rows = docs.withColumn(own, F.xxhash64(F.col(text).cast("string")))
    joined = rows.join(copies, F.col(doc_id).cast("long").eqNullSafe(F.col(i)) & F.col(source).cast("string").eqNullSafe(F.col(s)) & (F.col(own) == F.col(h)))
    even = joined.where(F.col(n) > 0).withColumn(own, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)
    over = joined.where(F.col(rest) > 0).dropDuplicates([i, s, h]).withColumn(own, F.explode(F.sequence(F.lit(1), F.col(rest)))).select(*docs.columns)
    return even.union(over)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))

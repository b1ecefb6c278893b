"""Columns of small alignments: indel events, consensus of rows of different extent, run contexts, statistics and splits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import CODES, base_mask, mask_code
from .alignments import allele_rank, composition, together, variant_columns


def _text(codes: Column) -> Column:
    """The codes of (pos, code) pairs in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(codes)), lambda x: x["code"]), "")


def column_counts(comp: DataFrame, group: str) -> DataFrame:
    """(group, pos, gaps, kinds, base) from a composition: kinds of bases, and the last of them."""
    base = F.when(F.col("base") != "-", F.col("base"))
    gaps = F.sum(F.when(F.col("base") == "-", F.col("n")).otherwise(0))
    return comp.groupBy(group, "pos").agg(gaps.alias("gaps"), F.count(base).alias("kinds"), F.max(base).alias("base"))


def aligned_run_length(row: Column, start: Column, stop: Column, base: Column) -> Column:
    """How many bases the run of ``base`` has that touches columns start to stop (from 0) of an aligned row; gaps don't end it."""
    of = F.concat(F.lit("[-"), base, F.lit("]*"))
    left = F.call_function("regexp_extract", F.substring(row, F.lit(1), start), F.concat(of, F.lit("$")), F.lit(0))
    right = F.call_function("regexp_extract", F.substring(row, stop + 2, F.length(row)), F.concat(F.lit("^"), of), F.lit(0))
    near = F.concat(left, F.substring(row, start + 1, stop - start + 1), right)
    return F.length(near) - F.length(F.replace(near, base, F.lit("")))


def indel_events(columns: DataFrame, group: str, rows: DataFrame | None = None, aligned: str = "row_aln", least: int = 1) -> DataFrame:
    """(group, start, stop, base, homopolymer): maximal stretches of columns with gaps and bases. One is a homopolymer's if it
    holds one base, which fills a column beside it, and with ``rows`` if each row's run there has ``least`` bases."""
    by = Window.partitionBy(group).orderBy("pos")
    solid = F.when((F.col("gaps") == 0) & (F.col("kinds") == 1), F.col("base"))
    c = columns.withColumn("left", F.lag(solid).over(by)).withColumn("right", F.lead(solid).over(by))
    c = c.where("gaps > 0 and kinds > 0").withColumn("isle", F.col("pos") - F.row_number().over(by))
    e = c.groupBy(group, "isle").agg(F.min("pos").alias("start"), F.max("pos").alias("stop"), F.max("kinds").alias("kinds"), F.countDistinct("base").alias("bases"), F.max("base").alias("base"), F.min_by("left", "pos").alias("left"), F.max_by("right", "pos").alias("right"))
    flank = F.coalesce(F.col("left") == F.col("base"), F.lit(False)) | F.coalesce(F.col("right") == F.col("base"), F.lit(False))
    e = e.select(group, "start", "stop", "base", ((F.col("kinds") == 1) & (F.col("bases") == 1) & flank).alias("homopolymer"))
    if rows is None or least <= 1:
        return e
    run = rows.select(group, F.upper(aligned).alias("row")).join(e.where("homopolymer"), group).groupBy(group, "start").agg(F.min(aligned_run_length(F.col("row"), F.col("start"), F.col("stop"), F.col("base"))).alias("run"))
    return e.join(run, [group, "start"], "left").select(group, "start", "stop", "base", (F.col("homopolymer") & (F.col("run") >= least)).alias("h")).withColumn("h", F.coalesce("h", F.lit(False))).withColumnRenamed("h", "homopolymer")


def column_summary(columns: DataFrame, events: DataFrame, group: str) -> DataFrame:
    """(group, snps, structural, structural_length, homopolymer, homopolymer_length): counts and longest of each kind of event."""
    snp = columns.groupBy(group).agg(F.count_if((F.col("kinds") > 1) & (F.col("gaps") == 0)).alias("snps"))
    size, h = F.col("stop") - F.col("start") + 1, F.col("homopolymer")
    e = events.groupBy(group).agg(F.count_if(~h).alias("structural"), F.max(F.when(~h, size)).alias("structural_length"), F.count_if(h).alias("homopolymer"), F.max(F.when(h, size)).alias("homopolymer_length"))
    names = ("structural", "structural_length", "homopolymer", "homopolymer_length")
    return snp.join(e, group, "left").select(group, "snps", *(F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names))


class _Extents:
    """Gapped rows as a matrix of code points, with the columns of each row's outer bases; rows of a group stand together and begin at ``start``."""

    def __init__(self, texts: list[str | None], start: np.ndarray):
        self.start, self.there = start, np.array([t is not None for t in texts])
        flat = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), np.uint32)
        self.size = np.array([len(t or "") for t in texts], np.int64)
        width = max(1, int(self.size.max(initial=1)))
        self.pos = np.arange(width)
        self.solid = self.pos < self.size[:, None]
        self.code = np.zeros((len(texts), width), np.uint32)
        self.code[self.solid] = flat
        base = self.solid & (self.code != ord("-"))
        any_ = base.any(axis=1)
        self.first = np.where(any_, base.argmax(axis=1), self.size)
        self.last = np.where(any_, width - 1 - base[:, ::-1].argmax(axis=1), -1)
        self.base = base

    def over(self, how: np.ufunc, v: np.ndarray, none) -> np.ndarray:
        """``how`` over the rows of each group; rows without a text have no part."""
        return how.reduceat(np.where(self.there if v.ndim == 1 else self.there[:, None], v, none), self.start, axis=0)


#: What stands for no first and no last column.
_FAR = 1 << 40


def _wider(v: np.ndarray, width: int, none) -> np.ndarray:
    """A matrix with more columns, which change nothing."""
    return np.concatenate([v, np.full((len(v), max(0, width - v.shape[1])), none, v.dtype)], axis=1)


def _joined(before: list[np.ndarray], values: list[np.ndarray], how: list[tuple[np.ufunc, object]]) -> list[np.ndarray]:
    """States of groups, the first of which goes on from ``before``."""
    out = []
    for h, v, (f, none) in zip(before, values, how, strict=True):
        if v.ndim > 1:
            width = max(h.shape[1], v.shape[1])
            h, v = _wider(h, width, none), _wider(v, width, none)
        out.append(np.concatenate([f(h, v[:1]), v[1:]]))
    return out


def _of_groups(rows: DataFrame, group: str, state, how: list[tuple[np.ufunc, object]], told, schema: str) -> DataFrame:
    """(group, what ``told`` makes of states): rows (group, row, more) are exchanged whole and sorted by group, and a group's state, a few numbers for each of its
    columns, grows row by row; ``how`` joins two states. No row becomes its cells, and what a task holds is one batch."""
    kind = rows.schema[group].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
        for whole in batches:
            k = 0
            while k < whole.num_rows:
                longest = max((len(t) for t in whole.column(1).slice(k, 64).to_pylist() if t), default=1)
                b = whole.slice(k, max(1, min(4096, 1_000_000 // longest)))
                k += b.num_rows
                at = b.column(0).dictionary_encode().indices.fill_null(-1).to_numpy()
                start = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
                yield b.column(0).take(pa.array(start)), state(_Extents(b.column(1).to_pylist(), start), b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for names, values in parts(batches):
            if last is not None:
                if last[0].equals(names[:1]):
                    values = _joined(last[1], values, how)
                else:
                    yield told(*last)
            last = names[-1:], [v[-1:] for v in values]
            if len(names) > 1:
                yield told(names[:-1], [v[:-1] for v in values])
        if last is not None:
            yield told(*last)

    return together(rows, group).sortWithinPartitions(group).mapInArrow(run, f"`{group}` {kind}, {schema}")


def overlap_summary(rows: DataFrame, group: str, aligned: str) -> DataFrame:
    """(group, overlap, prefix, suffix, snps): columns that all rows fill within what all span, what goes beyond it at either end,
    and columns of several bases in it."""
    how = [(np.maximum, -1), (np.minimum, _FAR), (np.minimum, _FAR), (np.maximum, -_FAR), (np.minimum, np.uint32(0xFFFFFFFF)), (np.maximum, np.uint32(0)), (np.logical_or, False)]

    def state(x: _Extents, b: pa.RecordBatch) -> list[np.ndarray]:
        low = np.where(x.solid, x.code, np.uint32(0xFFFFFFFF))
        values = (x.first, x.last, x.first, x.last, low, x.code, x.solid & ~x.base)
        return [x.over(f, v, none) for v, (f, none) in zip(values, how, strict=True)]

    def told(names: pa.Array, values: list[np.ndarray]) -> pa.RecordBatch:
        first, last, least, most, low, high, gap = values
        pos = np.arange(low.shape[1])
        full = (pos >= first[:, None]) & (pos <= last[:, None]) & ~gap & (high > 0)
        known, keyed = first >= 0, ~names.is_null().to_numpy(zero_copy_only=False)
        number = lambda v: pa.array(np.where(keyed, v, 0), pa.int64())
        place = lambda v: pa.array(v, pa.int32(), mask=~known)
        ends = [np.where(known, v, 0) for v in (first - least, most - last)]
        return pa.RecordBatch.from_arrays([names, number(full.sum(axis=1)), *map(place, ends), number((full & (low != high)).sum(axis=1))], names=[group, "overlap", "prefix", "suffix", "snps"])

    return _of_groups(rows.select(group, F.col(aligned).alias("row")), group, state, how, told, "overlap long, prefix int, suffix int, snps long")


def overlap_consensus(rows: DataFrame, group: str, aligned: str, weight: str, fraction: float = 0.5, floor: int = 3) -> DataFrame:
    """(group, consensus, snp_count): the union of rows of different extent. Within what all rows span, a column stays if its bases
    have ``fraction`` of the weight and ``floor`` at least; beyond, whatever bases there are stay."""
    how = [(np.maximum, -1), (np.minimum, _FAR), (np.add, 0.0), (np.add, 0.0), (np.bitwise_or, np.uint8(0))]
    codes = np.array(["-", *sorted(CODES, key=CODES.__getitem__)])
    masks = np.full(128, 15, np.uint8)
    masks[[ord("-"), *map(ord, CODES)]] = [0, *CODES.values()]

    def state(x: _Extents, b: pa.RecordBatch) -> list[np.ndarray]:
        w = b.column(2).to_numpy(zero_copy_only=False)[:, None]
        own = (x.pos >= x.first[:, None]) & (x.pos <= x.last[:, None])
        mask = masks[np.minimum(x.code, 127)]
        values = (x.first, x.last, np.where(own, w, 0.0), np.where(own & x.base, w, 0.0), np.where(own, mask, np.uint8(0)))
        return [x.over(f, v, none) for v, (f, none) in zip(values, how, strict=True)]

    def told(names: pa.Array, values: list[np.ndarray]) -> pa.RecordBatch:
        first, last, every, bases, mask = values
        pos = np.arange(mask.shape[1])
        shared = (pos >= first[:, None]) & (pos <= last[:, None])
        kept = (mask > 0) & (~shared | (bases >= every * fraction) & (bases >= floor))
        some = np.flatnonzero(kept.any(axis=1))
        texts = ["".join(codes[mask[r, kept[r]]]) for r in some]
        several = (kept & ((mask & (mask - 1)) > 0)).sum(axis=1)[some]
        return pa.RecordBatch.from_arrays([names.take(pa.array(some)), pa.array(texts, pa.string()), pa.array(several, pa.int64())], names=[group, "consensus", "snp_count"])

    return _of_groups(rows.select(group, F.upper(aligned).alias("row"), F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("w")), group, state, how, told, "consensus string, snp_count long")


def read_consensus(comp: DataFrame, group: str, frequency: float, fraction: float = 0.5, floor: int = 3) -> DataFrame:
    """(group, consensus, snp_count): one vote a read; a column stays as in `overlap_consensus`, with the bases that have ``frequency``
    of its bases, or the first if none has."""
    by = Window.partitionBy(group, "pos")
    base = F.col("base") != "-"
    c = comp.withColumn("total", F.sum("n").over(by)).withColumn("bases", F.sum(F.when(base, F.col("n")).otherwise(0)).over(by)).where(base)
    c = c.where((F.col("bases") >= F.col("total") * F.lit(fraction)) & (F.col("bases") >= floor)).withColumn("r", F.row_number().over(by.orderBy(F.desc("n"), allele_rank(F.col("base")))))
    good = F.col("n") >= F.col("bases") * F.lit(frequency)
    col = c.groupBy(group, "pos").agg(F.bit_or(F.when(good, base_mask(F.col("base"))).otherwise(0)).alias("mask"), F.max(F.when(F.col("r") == 1, base_mask(F.col("base")))).alias("one"))
    col = col.withColumn("code", mask_code(F.when(F.col("mask") == 0, F.col("one")).otherwise(F.col("mask"))))
    return col.groupBy(group).agg(_text(F.struct("pos", "code")).alias("consensus"), F.count_if(~F.col("code").isin("A", "C", "G", "T")).alias("snp_count"))


class _Runs:
    """The runs of a batch of gapped rows: matrices with a row for each and its columns, as far as it is long."""

    def __init__(self, texts: list[str]):
        self.size = np.array([len(t) for t in texts], np.int64)
        self.code = np.zeros((len(texts), max(1, int(self.size.max(initial=1)))), np.uint32)
        for r, t in enumerate(texts):
            self.code[r, : len(t)] = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        width = self.code.shape[1]
        pos, row = np.arange(width), np.arange(len(texts))[:, None]
        self.solid = (self.code != ord("-")) & (pos < self.size[:, None])
        last = np.maximum.accumulate(np.where(self.solid, pos, -1), axis=1)
        before = np.concatenate([np.full((len(texts), 1), -1), last[:, :-1]], axis=1)
        self.new = self.solid & ((before < 0) | (self.code[row, np.maximum(before, 0)] != self.code))
        self.start = np.maximum.accumulate(np.where(self.new, pos, -1), axis=1)
        ahead = lambda x: np.concatenate([np.minimum.accumulate(np.where(x, pos, width)[:, ::-1], axis=1)[:, ::-1][:, 1:], np.full((len(texts), 1), width)], axis=1)
        self.next_run, self.next_solid = ahead(self.new), ahead(self.solid)
        self.stop = np.where(self.start >= 0, last[row, self.next_run - 1], -1)
        self.count = np.cumsum(self.solid, axis=1)
        self.length = np.where(self.start >= 0, self.count[row, np.maximum(self.stop, 0)] - self.count[row, np.maximum(self.start, 0)] + 1, 0)
        self.base = np.where(self.start >= 0, self.code[row, np.maximum(self.start, 0)], 0)
        self.before, self.row, self.pos, self.width = before, row, pos, width

    def contexts(self, least: int) -> np.ndarray:
        """The base of the run that a column belongs to, as in `run_columns`; 0 for none."""
        tag = np.where(self.length >= least, self.base, 0)
        after = np.where(self.next_solid < self.width, tag[self.row, np.minimum(self.next_solid, self.width - 1)], 0)
        between = np.where((tag > 0) & (after > 0), np.where(self.next_solid > self.pos + 1, tag, 0), np.where(tag > 0, tag, after))
        return np.where(self.solid | (self.pos < self.stop), tag, between)


def _letters(codes: np.ndarray) -> pa.Array:
    """Code points as texts, 0 as null."""
    kinds, at = np.unique(codes, return_inverse=True)
    return pa.array([chr(k) if k else None for k in kinds.tolist()], pa.string()).take(pa.array(at))


def _of_rows(rows: DataFrame, name: str, aligned: str, made, schema: str) -> DataFrame:
    """(name, what ``made`` gives for the runs of a batch: which row, and columns) of rows, which stay where they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                b = whole.slice(k, 1024)
                texts = [t or "" for t in b.column(1).to_pylist()]
                row, columns = made(_Runs(texts))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *columns.values()], names=[name, *columns])

    kind = rows.schema[name].dataType.simpleString()
    return rows.select(name, F.upper(aligned).alias("row")).mapInArrow(run, f"`{name}` {kind}, {schema}")


def run_columns(rows: DataFrame, name: str, aligned: str, least: int, shown: int = 0) -> DataFrame:
    """(name, pos, base, place, run_base, run_start, run_stop, run_length, context) of each column of a gapped row: place counts its
    bases; context is the base of a run of ``least`` or more that the column belongs to. Gap columns inside a run belong to it;
    beside runs they take the base of the one run next to them, and between two runs that of the left one, but for the
    last of them, which has none. Of columns with a base, only those of runs of ``shown`` bases or more are given. A row's columns are told
    from the row alone, so nothing is exchanged."""

    def made(x: _Runs):
        keep = (x.pos < x.size[:, None]) & (~x.solid | (x.length >= shown))
        row, pos = np.nonzero(keep)
        at = lambda v: v[row, pos]
        known = at(x.start) >= 0
        ints = lambda v, ok, kind: pa.array(v, kind, mask=~ok)
        return row, {
            "pos": pa.array(pos, pa.int32()), "base": _letters(at(x.code)), "place": ints(at(x.count) - 1, at(x.solid), pa.int64()), "run_base": _letters(at(x.base)),
            "run_start": ints(at(x.start), known, pa.int32()), "run_stop": ints(at(x.stop), known, pa.int32()), "run_length": pa.array(at(x.length), pa.int64()), "context": _letters(at(x.contexts(least))),
        }

    return _of_rows(rows, name, aligned, made, "pos int, base string, place long, run_base string, run_start int, run_stop int, run_length long, context string")


def anchors_of_rows(rows: DataFrame, name: str, aligned: str, length: int, least: int = 1) -> DataFrame:
    """What `run_anchors` gives for the `run_columns` of rows, from each row alone."""

    def made(x: _Runs):
        row, pos = np.nonzero(x.new & (x.length >= least))
        after = x.next_run[row, pos]
        right = np.where(after < x.width, after, length)
        return row, {"run_base": _letters(x.code[row, pos]), "run_start": pa.array(pos, pa.int32()), "run_stop": pa.array(x.stop[row, pos], pa.int32()), "run_length": pa.array(x.length[row, pos], pa.int64()), "left": pa.array(x.before[row, pos], pa.int32()), "right": pa.array(right, pa.int32())}

    return _of_rows(rows, name, aligned, made, "run_base string, run_start int, run_stop int, run_length long, left int, right int")


def run_anchors(columns: DataFrame, name: str, length: int, least: int = 1) -> DataFrame:
    """(name, run_base, run_start, run_stop, run_length, left, right): runs with the columns of the bases beside them; -1 and
    ``length`` where there is none."""
    r = columns.where(F.col("base") != "-").select(name, "run_base", "run_start", "run_stop", "run_length").distinct()
    by = Window.partitionBy(name).orderBy("run_start")
    r = r.withColumn("left", F.coalesce(F.lag("run_stop").over(by), F.lit(-1))).withColumn("right", F.coalesce(F.lead("run_start").over(by), F.lit(length)))
    return r.where(F.col("run_length") >= least)


def column_statistics(comp: DataFrame, consensus: DataFrame, group: str, context: DataFrame | None = None) -> DataFrame:
    """(group, pos, coverage, subs, ins, dels, rate, A, C, G, T, gap): how the reads of each column differ from (group, pos, base) of
    the consensus. With a ``context`` (group, pos, context), gaps in a run's columns and its bases at gaps are the run's length alone
    and no errors; `effective` has the counts without them."""
    c = comp.join(consensus.select(group, "pos", F.col("base").alias("c")), [group, "pos"])
    c = c.join(context.select(group, "pos", "context"), [group, "pos"], "left") if context is not None else c.withColumn("context", F.lit(None).cast("string"))
    free = F.coalesce((F.col("base") == "-") & (F.col("c") == F.col("context")) | (F.col("c") == "-") & (F.col("base") == F.col("context")), F.lit(False))
    n = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    b, k = F.col("base"), F.col("c")
    kinds = [n((b != "-") & (k != "-") & (b != k) & ~free).alias("subs"), n((b != "-") & (k == "-") & ~free).alias("ins"), n((b == "-") & (k != "-") & ~free).alias("dels")]
    bases = [n(b == x).alias(x if x != "-" else "gap") for x in "ACGT-"] + [n((b == x) & free).alias(f"free_{x if x != '-' else 'gap'}") for x in "ACGT-"]
    s = c.groupBy(group, "pos").agg(F.sum("n").alias("coverage"), *kinds, *bases)
    return s.withColumn("rate", (F.col("subs") + F.col("ins") + F.col("dels")) / F.col("coverage"))


def effective(statistics: DataFrame, group: str) -> DataFrame:
    """A composition (group, pos, base, n) without what a run's length explains."""
    names = ("A", "C", "G", "T", "gap")
    each = F.explode(F.array(*(F.struct(F.lit(x if x != "gap" else "-").alias("base"), (F.col(x) - F.col(f"free_{x}")).alias("n")) for x in names))).alias("x")
    return statistics.select(group, "pos", each).select(group, "pos", "x.base", "x.n").where("n > 0")


def position_tuples(rows: DataFrame, positions: DataFrame, group: str, read: str, aligned: str) -> DataFrame:
    """(group, alleles, members): reads by their bases at the given (group, pos), in order."""
    p = positions.groupBy(group).agg(F.array_sort(F.collect_list("pos")).alias("at"))
    r = rows.select(group, F.upper(aligned).alias("row")).join(p, group)
    alleles = F.array_join(F.transform("at", lambda i: F.substring("row", i + 1, F.lit(1))), "")
    return r.groupBy(group, alleles.alias("alleles")).agg(F.count("*").alias("members"))


def best_split(errors: DataFrame, group: str) -> DataFrame:
    """(group, pos, error): the column at which a split leaves the least error, the first of equals."""
    return errors.groupBy(group).agg(F.min(F.struct("error", "pos")).alias("x")).select(group, "x.pos", "x.error")


def recursive_splits(rows: DataFrame, group: str, read: str, aligned: str, count: int, frequency: float) -> DataFrame:
    """(group, path, read, deferred): reads of one given alignment split at the best column again and again, until no part splits, all groups of a
    depth in one job. Reads with an allele that doesn't pass are deferred: they leave, with the path of the part they left. A part of
    fewer than twice ``count`` reads stays whole. `phasing.phased` aligns the parts anew.

    Equal rows of a group go the same way, so each is split once, with its number of reads. In a round, rows that have the same letters at all variant columns
    of their part are one kind; what is counted, scored and decided are kinds, and rows are neither sorted nor exchanged."""
    from .phasing import passing, split_errors
    from .tables import cut, discard

    row = F.regexp_replace(F.upper(aligned), "[^ACGT]", "-")
    every = cut(rows.select(group, read, row.alias("row")))
    now = cut(every.groupBy(group, "row").agg(F.count("*").alias("copies")).withColumn("path", F.lit("")))
    done = []
    part = F.concat(F.col(group).cast("string"), F.lit("/"), F.col("path")).alias("part")
    while now.limit(1).count():
        some = now.select(part, "row", "copies")
        comp = cut(composition(some, "part", "row", "row", "copies"))
        n = some.groupBy("part").agg(F.sum("copies").alias("reads")).where(F.col("reads") >= 2 * count).select("part")
        at = cut(variant_columns(comp, "part", frequency, count).join(n, "part").groupBy("part").agg(F.array_sort(F.collect_list("pos")).alias("at")))
        letters = F.array_join(F.transform("at", lambda i: F.substring("row", i + 1, F.lit(1))), "")
        split = now.withColumn("part", part).join(at, "part", "left").withColumn("kind", letters)
        kinds = cut(split.where("at is not null").groupBy("part", "at", "kind").agg(F.sum("copies").alias("copies")))
        cells = kinds.select("part", "kind", "copies", F.col("copies").alias("some"), F.posexplode("at").alias("i", "pos")).select("part", "kind", "copies", "some", "pos", F.substring("kind", F.col("i") + 1, F.lit(1)).alias("base"))
        cells = cut(cells)
        good = cut(passing(cells, "part", count, frequency))
        best = cut(split_errors(cells, good, "part", "kind").groupBy("part").agg(F.min(F.struct("error", "pos")).alias("x")).select("part", "x.pos"))
        own = cells.join(best, ["part", "pos"]).join(good.select("part", "pos", "base", F.lit(True).alias("ok")), ["part", "pos", "base"], "left").select("part", "kind", "pos", "base", F.coalesce("ok", F.lit(False)).alias("ok"))
        told = cut(split.join(cut(own), ["part", "kind"], "left").select(group, "path", "row", "copies", "pos", "base", "ok"))
        done.append(cut(told.where("not coalesce(ok, false)").select(group, "path", "row", F.col("ok").isNotNull().alias("deferred"))))
        step = F.concat(F.col("pos").cast("string"), "base")
        new = cut(told.where("ok").select(group, "row", "copies", F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), step).alias("path")))
        discard(now, comp, at, kinds, cells, good, best, told)
        now = new
    if not done:
        return every.select(group, F.lit("").alias("path"), read, F.lit(False).alias("deferred"))
    for more in done[1:]:
        done[0] = done[0].union(more)
    ends = done[0].withColumnRenamed(group, "of").withColumnRenamed("row", "end")
    same = every[group].eqNullSafe(ends["of"]) & every["row"].eqNullSafe(ends["end"])
    return every.join(ends, same).select(group, "path", read, "deferred")


def read_errors(rows: DataFrame, consensus: DataFrame, group: str, read: str, aligned: str) -> DataFrame:
    """(group, read, pos, kind, base): where a read differs from (group, pos, base) of the consensus; kind sub, ins or del. A group's
    consensus travels to its rows as one array, and only columns that differ become rows."""
    at = consensus.groupBy(group).agg(F.collect_list(F.struct("pos", F.col("base").alias("c"))).alias("at"))
    r = rows.select(group, read, F.regexp_replace(F.upper(aligned), "[^ACGT]", "-").alias("row")).join(at, group)
    # as a lambda's variable the row isn't computed again for each column
    seen = lambda row: F.filter(F.transform("at", lambda x: F.struct(x["pos"].alias("pos"), x["c"].alias("c"), F.substring(row, x["pos"] + 1, F.lit(1)).alias("base"))), lambda x: (x["base"] != "") & (x["base"] != x["c"]))
    c = r.select(group, read, F.explode(F.element_at(F.transform(F.array("row"), seen), 1)).alias("x")).select(group, read, "x.*")
    return c.select(group, read, "pos", F.when(F.col("c") == "-", "ins").when(F.col("base") == "-", "del").otherwise("sub").alias("kind"), "base")

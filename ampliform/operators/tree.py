"""Trees of variants in reading order: depth, place and what is drawn before a line, by pointer jumping.

Trees of at most ``WHOLE`` nodes are exchanged once, as names and parents alone, and walked whole, many to a task. What is drawn before a line
grows with its depth, so lines leave the walk as what stands before an ancestor at each ``BLOCK``-th depth, once, and the rest of each line;
they are put together last, a row at a time, and never exchanged, kept or held together.

In larger trees each node knows its place among its siblings and points to its parent; a round lets it point twice as far and puts the places
between in front of its own, so a tree of any depth takes rounds by its logarithm, all trees together. Reading order is the order of these
paths; no such tree is walked in one task.

Edge cases: a node whose parent isn't there is a root; roots come in order of size. Of equal sizes the smaller name comes first. Parents that
lead in a circle raise an error.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import cut, discard

#: Nodes of a tree that is walked whole at most, depths of a block, bytes of lines that leave a walk at a time.
WHOLE, BLOCK, BYTES = 1 << 18, 128, 1 << 22
_BAR, _BLANK, _FORK, _LAST = (x.encode() for x in ("│  ", "   ", "├─ ", "└─ "))


def paths(nodes: DataFrame, keys: list[str], name: str, parent: str, size: str) -> DataFrame:
    """(keys, name, path): 2 * place among the siblings + whether it's the last of them (1) of each ancestor, root first, and of the node itself.

    Paths pack well on disk, so the size of their files says nothing about them: they are never broadcast."""
    n = nodes.select(*keys, F.col(name).alias("node"), F.col(parent).alias("up"), F.col(size).alias("size"))
    known = n.select(*keys, F.col("node").alias("up"), F.lit(True).alias("there"))
    n = n.join(known.hint("merge"), [*keys, "up"], "left").withColumn("up", F.when(F.col("there"), F.col("up"))).drop("there")
    by = Window.partitionBy(*keys, "up")
    order = F.row_number().over(by.orderBy(F.desc("size"), "node"))
    step = order * 2 + (order == F.count("*").over(by)).cast("int")
    now = cut(n.select(*keys, "node", "up", F.array(step).alias("path")))
    many, rounds = now.count(), 0
    while now.where("up is not null").limit(1).count():
        if 1 << rounds > 2 * many:
            raise ValueError("parents lead in a circle")
        far = now.select(*keys, F.col("node").alias("up"), F.col("up").alias("further"), F.col("path").alias("before"))
        new = cut(now.join(far.hint("merge"), [*keys, "up"], "left").select(*keys, "node", F.col("further").alias("up"), F.when(F.col("up").isNull(), F.col("path")).otherwise(F.concat("before", "path")).alias("path")))
        discard(now)
        now, rounds = new, rounds + 1
    return now.select(*keys, F.col("node").alias(name), "path")


def lead(path: Column) -> Column:
    """What is drawn before a node's line: a bar for each ancestor that has siblings below, then a branch; nothing before a root."""
    inner = F.transform(F.slice(path, F.lit(2), F.greatest(F.size(path) - 2, F.lit(0))), lambda p: F.when(p % 2 == 1, "   ").otherwise("│  "))
    branch = F.when(F.element_at(path, -1) % 2 == 1, "└─ ").otherwise("├─ ")
    return F.when(F.size(path) == 1, "").otherwise(F.concat(F.array_join(inner, ""), branch))


def _bars(last: bytearray) -> bytes:
    """What nodes draw before the lines below them, by whether each is the last of its siblings (1)."""
    return bytes(last).replace(b"\x00", _BAR).replace(b"\x01", _BLANK)


def _walk(parent: np.ndarray) -> Iterator[list[tuple[bytes, list[tuple[int, int, int, bytes]]]]]:
    """The lines of nodes in order of siblings, -1 as the parent of roots, in reading order, some at a time: (head, [(node, depth, place, tail)]), the
    lines that begin alike together. Head and tail are what is drawn before a line."""
    n, kids = len(parent), np.argsort(parent, kind="stable")
    start = np.searchsorted(parent[kids], np.arange(-1, n + 1))
    ends = start[1:][np.diff(start) > 0] - 1
    last = np.zeros(n, np.uint8)
    last[kids[ends]] = 1
    last, back, start, parent = last.tolist(), kids[::-1].tolist(), (n - start).tolist(), parent.tolist()
    depth, place, size = [0] * n, 0, 0
    flags, anchors = bytearray(), []  # of the way to the node, and of those at each BLOCK-th depth
    held: dict[int, tuple[bytes, list]] = {}
    stack = back[start[1] : start[0]]
    while stack:
        v = stack.pop()
        depth[v] = d = depth[parent[v]] + 1 if parent[v] >= 0 else 0
        place += 1
        del flags[d:]
        flags.append(last[v])
        if d % BLOCK == 0:
            del anchors[d // BLOCK :]
            anchors.append(v)
        k = max(d - 1, 0) // BLOCK
        key = anchors[k] if k else -1
        if (lines := held.get(key)) is None:
            lines = held[key] = (_bars(flags[1 : k * BLOCK + 1]), [])
            size += len(lines[0])
        tail = _bars(flags[k * BLOCK + 1 : d]) + (_LAST if last[v] else _FORK) if d else b""
        lines[1].append((v, d, place, tail))
        size += len(tail) + 64
        if size > BYTES:
            yield list(held.values())
            held, size = {}, 0
        stack += back[start[v + 2] : start[v + 1]]
    if place < n:
        raise ValueError("parents lead in a circle")
    yield list(held.values())


def _walked(n: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, depth, place, lead) of trees of n (keys, node, up, size) that a task can hold."""
    order = Window.partitionBy(*keys).orderBy(F.desc("size"), "node")
    there = functools.reduce(lambda a, b: a & b, (F.col(k).isNotNull() for k in keys))  # without its keys, a parent isn't there
    n = n.select(*keys, "node", F.when(there, F.col("up").try_cast(n.schema["node"].dataType)).alias("up"), F.row_number().over(order).alias("rank"))
    line = T.StructType([T.StructField("node", n.schema["node"].dataType), T.StructField("depth", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("tail", T.StringType())])
    schema = T.StructType([*(n.schema[k] for k in keys), T.StructField("head", T.StringType()), T.StructField("lines", T.ArrayType(line))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches).sort_by("rank").combine_chunks()
        names, up = (t.column(c).combine_chunks() for c in ("node", "up"))
        first = t.slice(0, 1)
        parent = pc.index_in(up, value_set=names, skip_nulls=True).fill_null(-1).to_numpy(zero_copy_only=False)
        for found in _walk(parent):
            v, depth, place, tail = zip(*(x for _, lines in found for x in lines), strict=True)
            parts = [names.take(pa.array(v, pa.int64())), pa.array(depth, pa.int32()), pa.array(place, pa.int32()), pa.array(tail, pa.binary()).cast(pa.string())]
            ends = np.cumsum([0, *(len(lines) for _, lines in found)])
            lines = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(parts, names=["node", "depth", "place", "tail"]))
            own = [first.column(k).combine_chunks().take(pa.array([0] * len(found))) for k in keys]
            yield pa.RecordBatch.from_arrays([*own, pa.array([h for h, _ in found], pa.binary()).cast(pa.string()), lines], names=[*keys, "head", "lines"])

    x = n.groupBy(*keys).applyInArrow(run, schema).select(*keys, "head", F.explode("lines").alias("x"))
    return x.select(*keys, "x.node", "x.depth", "x.place", F.concat("head", "x.tail").alias("lead"))


def reading_order(nodes: DataFrame, keys: list[str], name: str, parent: str, size: str) -> DataFrame:
    """(keys, name, depth, place, lead): depth of a root is 0; place counts the lines of keys from 1."""
    n = cut(nodes.select(*keys, F.col(name).alias("node"), F.col(parent).alias("up"), F.col(size).alias("size")))
    large = cut(n.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > WHOLE).select(*keys))
    if not large.limit(1).count():
        return _walked(n, keys).withColumnRenamed("node", name)
    same = functools.reduce(lambda a, b: a & b, (n[k].eqNullSafe(large[k]) for k in keys))
    p = paths(n.join(large, same, "left_semi"), keys, "node", "up", "size")
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("path"))
    drawn = p.select(*keys, "node", (F.size("path") - 1).alias("depth"), place.alias("place"), lead(F.col("path")).alias("lead"))
    return _walked(n.join(large, same, "left_anti"), keys).union(drawn).withColumnRenamed("node", name)

"""The most similar larger sequence of each, among the distinct sequences of a group: exact, without comparing all pairs.

Sequences come in order (largest first), cut into slices of a bounded number of letters; each slice meets itself and every earlier one in a cell
of its own, so a large group is many tasks'. Within a cell, larger sequences a single edit away are looked up by hashes of what is left without one
letter, which is linear; only sequences without one are compared, and nothing is nearer to these than two edits. Sequences that share a piece form parts: one without any of its ``m`` pieces is ``m`` edits
away at least, so a sequence looks beyond its part only if nothing in it is nearer than that; then the edits to the first of each part, and from
there to the others, bound the edits to all of them from below. Within a part, candidates are tried best first by
the edits that their four-letter words admit at least, and trying ends when no bound beats, or equals and precedes, the best one found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut

#: Letters of a slice and of a bucket of cells, of a piece, of a word; rows of a block; pairs of a step; entries of matrices held at a time; rows of
#: a part whose first one bounds the others.
SLICE, BUCKET, PIECE, WORD, BLOCK, PAIRS, LIVE, LED = 5_000_000, 2_000_000, 16, 4, 256, 4096, 4_000_000, 8


class Texts:
    """Texts as a matrix of code points, with the words that each has."""

    def __init__(self, texts: list[str]):
        raw = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
        self.size = np.array([len(r) for r in raw], np.int64)
        self.code = np.zeros((len(raw), int(self.size.max(initial=0)) + 1), np.uint32)
        for k, r in enumerate(raw):
            self.code[k, : len(r)] = r
        self.words = np.zeros((len(raw), 256), bool)
        for at in range(self.code.shape[1] - WORD + 1):
            fit = np.flatnonzero(self.size >= at + WORD)
            word = np.zeros(len(fit), np.int64)
            for k in range(WORD):
                word = word * 4 + ((self.code[fit, at + k] >> 1) & 3)
            self.words[fit, word] = True
        self.kinds = self.words.sum(axis=1).astype(np.float32)
        #: The letters that occur, and which of them stands where.
        self.letters, at = np.unique(self.code, return_inverse=True)
        self.letter = at.reshape(self.code.shape).astype(np.int32)

    def grams(self, rows: np.ndarray, cell: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, hash with the row's cell) of the pieces at every ``step``-th place."""
        owner, out = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for at in range(0, self.code.shape[1] - PIECE + 1, step):
            fit = rows[self.size[rows] >= at + PIECE]
            h = cell[fit].astype(np.uint64) + np.uint64(1)
            for k in range(PIECE):
                h = h * np.uint64(0x9E3779B97F4A7C15) + self.code[fit, at + k]
                h ^= h >> np.uint64(29)
            owner.append(fit)
            out.append(h)
        return np.concatenate(owner), np.concatenate(out)

    def edits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The edit distance of pairs of rows, by bit vectors of the columns' differences, all pairs a column at a time."""
        out, wide = np.empty(len(a), np.int32), -(-self.code.shape[1] // 64)
        most = max(64, min(PAIRS, LIVE // (wide * len(self.letters))))
        for k in range(0, len(a), most):
            out[k : k + most] = self._edits(a[k : k + most], b[k : k + most])
        return out

    def _edits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        n, m = self.size[a], self.size[b]
        own, at = np.unique(a, return_inverse=True)
        wide = max(1, -(-int(n.max()) // 64))
        code = np.zeros((len(own), wide * 64), np.int32)
        take = min(wide * 64, self.letter.shape[1])
        code[:, :take] = self.letter[own, :take]
        equal = np.stack([np.packbits(code == c, axis=1, bitorder="little").view(np.uint64) for c in range(len(self.letters))])
        one, last = np.uint64(1), np.uint64(63)
        up, down = [np.full(len(a), ~np.uint64(0)) for _ in range(wide)], [np.zeros(len(a), np.uint64) for _ in range(wide)]
        score, out = n.copy(), np.where(m == 0, n, 0)
        end, bit = (n - 1) // 64, ((n - 1) % 64).astype(np.uint64)
        for j in range(int(m.max())):
            plus, minus = np.ones(len(a), np.uint64), np.zeros(len(a), np.uint64)
            eqs = equal[self.letter[b, j], at]
            for w in range(wide):
                eq, p, q = eqs[:, w], up[w], down[w]
                xv = eq | q
                eq = eq | minus
                xh = (((eq & p) + p) ^ p) | eq
                ph, mh = q | ~(xh | p), p & xh
                here = slice(None) if wide == 1 else end == w
                score[here] += ((ph[here] >> bit[here]) & one).astype(np.int64) - ((mh[here] >> bit[here]) & one).astype(np.int64)
                ph_in, mh_in = (ph << one) | plus, (mh << one) | minus
                plus, minus = ph >> last, mh >> last
                up[w], down[w] = mh_in | ~(xv | ph_in), ph_in & xv
            ends = m == j + 1
            out[ends] = score[ends]
        return np.where(n == 0, m, out)


def _parts(x: Texts, cell: np.ndarray, asked: np.ndarray, held: np.ndarray) -> np.ndarray:
    """A number for each row, the same for rows of a cell that a chain of shared pieces joins."""
    label = np.arange(len(x.size))
    row, piece = x.grams(asked, cell, PIECE)
    own, window = x.grams(held, cell, 1)
    kinds, at = np.unique(piece, return_inverse=True)
    if not len(kinds):
        return label
    to = np.minimum(np.searchsorted(kinds, window), len(kinds) - 1)
    hit = kinds[to] == window
    row, at = np.concatenate([row, own[hit]]), np.concatenate([at, to[hit]])
    for _ in range(64):
        least = np.full(len(kinds), len(label))
        np.minimum.at(least, at, label[row])
        new = label.copy()
        np.minimum.at(new, row, least[at])
        if (new == label).all():
            return label
        label = new
    return np.unique(cell, return_index=True)[1][np.unique(cell, return_inverse=True)[1]]  # a long chain: whole cells


def _first(keys: np.ndarray, rows: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The first of ``rows`` (ascending) with each wanted key; -1 if none has it."""
    kinds, at = np.unique(keys, return_index=True)
    if not len(kinds):
        return np.full(len(wanted), -1)
    to = np.minimum(np.searchsorted(kinds, wanted), len(kinds) - 1)
    return np.where(kinds[to] == wanted, rows[at[to]], -1)


def _single_edits(x: Texts, cell: np.ndarray, asked: np.ndarray, held: np.ndarray, need: np.ndarray, have: np.ndarray) -> np.ndarray:
    """The best of ``held`` (largest first) that is larger and a single edit away for each of ``asked``, -1 if none is, as far as hashes tell.

    Of equal letters but one, both leave the same without that place; of a letter more, the longer leaves the shorter. The first row of
    a hash is the largest, so no pairs are made."""
    base, back = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
    power = np.ones(x.code.shape[1] + 1, np.uint64)
    np.multiply.accumulate(np.full(x.code.shape[1], base), out=power[1:])
    own = cell.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    named = lambda h, size: (h ^ own) * base + size.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    letter = lambda k: (x.code[:, k].astype(np.uint64) + np.uint64(1)) * (k < x.size)
    total = np.zeros(len(x.size), np.uint64)
    for k in range(x.code.shape[1]):
        total += letter(k) * power[k]
    whole, before = named(total, x.size), np.zeros(len(x.size), np.uint64)
    none, most = len(x.size), int(x.size.max(initial=0))
    longer, same = np.full(len(asked), none), np.full(len(asked), none)  # of the candidates of a letter more, and of no more letters, the first

    def take(into: np.ndarray, at: np.ndarray, row: np.ndarray) -> None:
        ok = (row >= 0) & (have[row] > need[asked[at]])
        into[at[ok]] = np.minimum(into[at[ok]], row[ok])

    every = np.arange(len(asked))
    for k in range(most):
        here = letter(k) * power[k]
        left = named(before + (total - before - here) * back, x.size - 1)  # without the letter at k
        before += here
        h, at = held[x.size[held] > k], every[x.size[asked] > k]
        take(same, at, _first(left[h], h, left[asked[at]]))
        take(longer, every, _first(left[h], h, whole[asked]))
        take(same, at, _first(whole[held], held, left[asked[at]]))
    n = np.maximum(x.size[asked], 1)
    one, two = np.round(1 - 1 / (n + 1), 9), np.round(1 - 1 / n, 9)
    best = np.where((longer < none) & ((same == none) | (one > two) | (longer < same)), longer, same)
    return np.where(best < none, best, -1)


def _search(x: Texts, asked: np.ndarray, held: np.ndarray, need: np.ndarray, have: np.ndarray, least: np.ndarray, leader: np.ndarray, reach: np.ndarray):
    """Asks for the edits of pairs of rows until the best of ``held`` (in order) is known for each of ``asked``, which are ``least`` edits away from all
    larger ones; gives (asked row, held row, edits)."""
    common = x.words[asked].astype(np.float32) @ x.words[held].astype(np.float32).T
    lacking = np.maximum(x.kinds[asked][:, None], x.kinds[held][None, :]) - common
    low = np.maximum(np.ceil(lacking / WORD), np.maximum(least[asked][:, None], np.abs(x.size[asked][:, None] - x.size[held][None, :])))
    led = np.flatnonzero(leader[held] >= 0)
    if len(led):  # edits keep the triangle inequality
        leaders, at = np.unique(leader[held[led]], return_inverse=True)
        e = yield np.repeat(asked, len(leaders)), np.tile(leaders, len(asked))
        low[:, led] = np.maximum(low[:, led], np.abs(e.reshape(len(asked), -1)[:, at] - reach[held[led]][None, :]))
    longer = np.maximum(np.maximum(x.size[asked][:, None], x.size[held][None, :]), 1)
    may = np.where(have[held][None, :] > need[asked][:, None], np.round(1 - low / longer, 9), -1.0)
    known, found = np.zeros(may.shape, bool), np.zeros(may.shape, np.int32)
    rows, turn = np.arange(len(asked)), 0
    while True:
        first = may[rows].argmax(axis=1)  # of equals the first
        on = (may[rows, first] >= 0) & ~known[rows, first]
        rows, first = rows[on], first[on]
        if not len(rows):
            break
        r, c = rows, first
        if turn >= 2:  # bounds that are far off: more at a time
            k = min(len(held), 8 << min(turn, 20))
            more = np.argpartition(-np.where(known[rows], -1.0, may[rows]), k - 1, axis=1)[:, :k]
            r, c = np.concatenate([r, np.repeat(rows, k)]), np.concatenate([c, more.ravel()])
            found_best = np.full(len(may), -1.0)
            found_best[rows] = np.where(known[rows], may[rows], -1.0).max(axis=1)
            fit = (may[r, c] >= np.maximum(found_best[r], 0)) & ~known[r, c]
            r, c = np.divmod(np.unique(r[fit] * len(held) + c[fit]), len(held))
        e = yield asked[r], held[c]
        found[r, c], known[r, c] = e, True
        may[r, c] = np.round(1 - e / longer[r, c], 9)
        turn += 1
    first = may.argmax(axis=1)
    ok = np.flatnonzero(known[np.arange(len(asked)), first])
    return asked[ok], held[first[ok]], found[ok, first[ok]]


def _together(x: Texts, jobs: Iterator[tuple[np.ndarray, np.ndarray]], need: np.ndarray, have: np.ndarray, least: np.ndarray, leader: np.ndarray, reach: np.ndarray, best: np.ndarray, cost: np.ndarray) -> None:
    """Runs searches side by side, their pairs in one step; what they find goes into best and cost by row. Rows have a leader, or -1, that is ``reach``
    edits away."""
    live: list = []
    entries, more = 0, True
    while more or live:
        while more and entries < LIVE:
            if (job := next(jobs, None)) is None:
                more = False
                break
            size = len(job[0]) * len(job[1])
            live.append([_search(x, *job, need, have, least, leader, reach), None, size])
            entries += size
        wanted, left = [], []
        for one in live:
            try:
                wanted.append(one[0].send(one[1]))
                left.append(one)
            except StopIteration as end:
                row, other, e = end.value
                best[row], cost[row] = other, e
                entries -= one[2]
        live = left
        if live:
            e = x.edits(np.concatenate([w[0] for w in wanted]), np.concatenate([w[1] for w in wanted]))
            for one, part in zip(live, np.split(e, np.cumsum([len(w[0]) for w in wanted])[:-1]), strict=True):
                one[1] = part


def _jobs(asked: np.ndarray, held: np.ndarray, key: np.ndarray, need: np.ndarray, have: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(asked, held) rows of one key, in blocks; none where nothing is larger."""
    a, h = asked[np.argsort(key[asked], kind="stable")], held[np.argsort(key[held], kind="stable")]
    keys = np.unique(key[asked])
    edges = [np.searchsorted(key[v], keys, side=side) for v in (a, h) for side in ("left", "right")]
    for a0, a1, h0, h1 in zip(*edges, strict=True):
        one, other = a[a0:a1], h[h0:h1]
        if len(other):
            one, rows = one[need[one] < have[other].max()], max(1, min(BLOCK, LIVE // len(other)))
            for k in range(0, len(one), rows):
                yield one[k : k + rows], other


def nearest_larger(texts: list[str], size: np.ndarray, first: np.ndarray, cell: np.ndarray, asked: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, edits) by row, -1 for none: for each row of ``asked`` the most similar of the rows of ``held`` (in order) of its cell that are larger or
    ``first``, the first of equals. A row without a size has the first alone."""
    x = Texts(texts)
    have = np.where(first, np.inf, np.where(np.isnan(size), -np.inf, size))
    need = np.where(first, np.inf, np.where(np.isnan(size), np.finfo(float).max, size))
    best, cost = np.full(len(texts), -1), np.full(len(texts), -1, np.int32)
    one = _single_edits(x, cell, asked, held, need, have)
    hit = one >= 0
    least = np.full(len(texts), 2)
    least[asked[hit]] = 1
    hit[hit] = x.edits(asked[hit], one[hit]) == 1
    best[asked[hit]], cost[asked[hit]] = one[hit], 1
    asked = asked[~hit | (x.size[asked] < 3)]  # of shorter ones, a longer one two edits away may be as similar
    part = _parts(x, cell, asked, held)
    leader, reach = np.full(len(texts), -1), np.zeros(len(texts), np.int32)
    _together(x, _jobs(asked, held, part, need, have), need, have, least, leader, reach, best, cost)
    # what shares no piece is as many edits away as there are pieces
    n = x.size[asked]
    longer = np.maximum(np.maximum(n, x.size[np.maximum(best[asked], 0)]), 1)
    sure = (best[asked] >= 0) & (1 - cost[asked] / longer > n / np.maximum(n + n // PIECE, 1) + 1e-8)
    if not sure.all():
        _, first_of, at, n = np.unique(part[held], return_index=True, return_inverse=True, return_counts=True)
        led = n[at] >= LED
        leader[held[led]] = held[first_of[at[led]]]
        reach[held[led]] = x.edits(leader[held[led]], held[led])
    _together(x, _jobs(asked[~sure], held, cell, need, have), need, have, least, leader, reach, best, cost)
    return best, cost


def best_larger(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ordinal, parent, parent_size, identity, edits): of each of a group's ``distinct`` sequences (keys, ordinal, size, seq) the most similar larger
    one, or the first; of equals the larger, then the first. The first has none."""
    order = Window.partitionBy(*keys).orderBy(F.desc("size"), "ordinal")
    d = distinct.withColumn("rank", F.row_number().over(order)).withColumn("upto", F.sum(F.length("seq") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    d = cut(d.select(*keys, "ordinal", "size", "seq", "rank", F.floor(F.col("upto") / SLICE).alias("slice")))
    slices = d.groupBy(*keys).agg(F.max("slice").alias("last"))
    cell = lambda i, j: F.struct(i.cast("long").alias("i"), j.cast("long").alias("j"))
    s, last = F.col("slice"), F.col("last")
    down = F.transform(F.sequence(F.lit(0).cast("long"), s), lambda j: cell(s, j))
    up = F.transform(F.filter(F.sequence(s, last), lambda i: i > s), lambda i: cell(i, s))
    dealt = cut(d.join(slices, keys).select(*keys, "ordinal", F.col("size").cast("double").alias("size"), "seq", "rank", "slice", F.explode(F.concat(down, up)).alias("x")).select("*", "x.i", "x.j").drop("x"))
    letters = dealt.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]
    n = max(int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")), letters // BUCKET)
    kinds = {f.name: f.dataType.simpleString() for f in d.schema}

    def run(bucket: pd.DataFrame) -> pd.DataFrame:
        cell = bucket.groupby([*keys, "i", "j"], sort=False).ngroup()
        c = bucket.assign(cell=cell).sort_values(["cell", "rank"], kind="stable").reset_index(drop=True)
        asked, held = np.flatnonzero(c["slice"] == c["i"]), np.flatnonzero(c["slice"] == c["j"])
        best, cost = nearest_larger(c["seq"].tolist(), c["size"].to_numpy(float), (c["rank"] == 1).to_numpy(), c["cell"].to_numpy(), asked, held)
        one = asked[best[asked] >= 0]
        found, other = c.iloc[one].reset_index(drop=True), c.iloc[best[one]].reset_index(drop=True)
        longer = np.maximum(found["seq"].str.len(), other["seq"].str.len())
        return found[[*keys, "ordinal"]].assign(parent=other["ordinal"], place=other["rank"], identity=1 - cost[one] / longer, edits=cost[one])

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"ordinal {kinds['ordinal']}", f"parent {kinds['ordinal']}", "place int", "identity double", "edits int"])
    found = dealt.withColumn("bucket", F.pmod(F.xxhash64(*keys, "i", "j"), F.lit(n))).groupBy("bucket").applyInPandas(run, schema)
    x = F.max_by(F.struct("parent", "identity", "edits"), F.struct(F.round("identity", 9), -F.col("place")))
    found = found.groupBy(*keys, "ordinal").agg(x.alias("x")).select(*keys, "ordinal", "x.*")
    return found.join(d.select(*keys, F.col("ordinal").alias("parent"), F.col("size").alias("parent_size")), [*keys, "parent"]).select(*keys, "ordinal", "parent", "parent_size", "identity", "edits")

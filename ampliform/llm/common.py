"""Helpers that the operators of this subpackage share.

Texts cross into Python as Arrow batches; a null text is the empty text. All numpy work runs on slices of at
most ``SLICE`` bytes, so memory does not follow the length of a text or the size of a batch.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected
from ..operators.tables import cut, discard, own_folder  # noqa: F401

#: Bytes of text that one numpy step handles.
SLICE = 1 << 19

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def fresh(name: str, taken: Iterable[str]) -> str:
    """A column name that clashes with none of ``taken`` (Spark compares names without case)."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def give_back() -> None:
    """Hands free memory back to the system: a Python worker outlives its task, and waits with what it holds for the next one."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column as bytes; null is empty."""
    return [t or b"" for t in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows at most, which bounds what Python holds of them at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


@functools.lru_cache(maxsize=2)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << bits
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _BASE_INV, np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P, D): the hash of data[s:e] is (P[e] - P[s]) * D[s], whatever stands around it."""
    bits = max(16, int(len(data)).bit_length())
    up, down = _powers(bits)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out, down


#: Bytes that no word holds: the space and \x09 to \x0D. Lower-casing touches A-Z alone.
BLANK = np.zeros(256, bool)
BLANK[[0x20, 9, 10, 11, 12, 13]] = True
#: Bytes that are no letter, digit or part of a longer character.
PUNCTUATION = np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)])
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def word_hashes(text: bytes, blank: np.ndarray = BLANK) -> np.ndarray:
    """The hash of each word ``[^\\x20\\x09-\\x0D]+`` of the text, A-Z lower-cased, in order."""
    parts, at, n = [], 0, len(text)
    while at < n:
        end = min(n, at + SLICE)
        if end < n:  # a slice ends at white space
            cut_at = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            while cut_at < at and end < n:  # a word longer than a slice
                end = min(n, end + SLICE)
                cut_at = max(text.rfind(c, at, end) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
            end = cut_at + 1 if cut_at >= at and end < n else end
        parts.append(_slice_words(text[at:end], blank))
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _slice_words(text: bytes, blank: np.ndarray) -> np.ndarray:
    data = np.frombuffer(text.translate(_LOWER), np.uint8)
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~blank[data]
    edge = np.diff(solid)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    p, down = prefix_hash(data)
    return mix((p[end] - p[start]) * down[start])


def batched_words(texts: list[bytes], blank: np.ndarray = BLANK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes of the run, words per text) for runs of texts of about a slice."""
    first, size = 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or size + len(texts[i]) > SLICE and i > first:
            if i > first:
                if i - first == 1:
                    w = word_hashes(texts[first], blank)
                    yield first, w, np.array([len(w)])
                else:
                    yield first, *_run_words(texts[first:i], blank)
            first, size = i, 0
        if i < len(texts):
            size += len(texts[i]) + 1


def _run_words(texts: list[bytes], blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(texts).translate(_LOWER), np.uint8)
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~blank[data]
    edge = np.diff(solid)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    p, down = prefix_hash(data)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return mix((p[end] - p[start]) * down[start]), np.diff(np.searchsorted(start, ends), prepend=0)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (src, dst) reaches."""
    return connected(edges.select(F.col("src").cast("long"), F.col("dst").cast("long")))


def group_rows(columns: dict[str, np.ndarray], by: np.ndarray) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The columns split by the values of ``by``."""
    if not len(by):
        return
    order = np.argsort(by, kind="stable")
    keys = by[order]
    edges = np.flatnonzero(np.diff(keys)) + 1
    pieces = {k: np.split(v[order], edges) for k, v in columns.items()}
    for j, key in enumerate(keys[np.concatenate([[0], edges])]):
        yield int(key), {k: v[j] for k, v in pieces.items()}

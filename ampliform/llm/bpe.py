"""BPE encoding and decoding: a bounded-lookahead streaming transducer and an incremental byte-to-text decoder.

Encoding reads bytes from left to right. Each prefix has one last token, which depends on at most as many bytes as
the longest token has (`pairwise`). A state holds the prefixes that a later token may still attach to, each with
the tokens not yet put out; a token is stable, whatever follows, once they all share it, and is emitted then.
States are compiled when first met, in a table that is emptied when it has ``STATES``. `lookahead` is a merge list's
sufficient lookahead: merges times the longest token's bytes; what follows later never changes a token. No state
holds more bytes than that (`_settle` makes sure), so memory is constant. Between words the machine starts
anew, as no merge crosses a word of the pre-tokenizer's pattern; frequent words are memoised, in a table
that is emptied at a fixed size. Decoding turns ids into bytes and feeds an incremental UTF-8 machine which keeps
at most three bytes. Ids go into the result in runs of a fixed size.

Edge cases: a null text is empty and has no token; an added special token in a text becomes its id, as in the
library; very long words without a blank go through the transducer and are never held as a whole list of merges;
repeated rows, ties and extra columns need no care: each row is encoded by itself.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, pieces, utf8
from .pairwise import NEVER, Machine

#: The byte-level pre-tokenizer's pattern (fixed values of the format).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Words memoised at most, the longest word that is, the states kept at most, and the ids that are handed over at once.
MEMO, MEMO_WORD, STATES, RUN = 500_000, 64, 200_000, 1 << 16


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec(Machine):
    """A byte-level BPE vocabulary read from a tokenizer's JSON file."""

    def __init__(self, path: str, states: int | None = None, memo: int | None = None):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = byte_letters()
        raw = lambda s: bytes(letter[c] for c in s)
        self.ids = {raw(s): i for s, i in spec["model"]["vocab"].items() if all(c in letter for c in s)}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        ranks = {(raw(a), raw(b)): r for r, (a, b) in enumerate(pairs)}
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s in self.added:
            self.ids.pop(s.encode(), None)
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.added.items()}
        #: What a state holds of a token: its id, packed.
        packed = {b: i.to_bytes(4, "little") for b, i in self.ids.items()}
        longest = max(map(len, self.ids))
        super().__init__(set(self.ids), lambda a, b: ranks.get((a, b), NEVER), b"", lambda w, p: w + packed[p], self._settle, states or STATES)
        table = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        #: The tokens' bytes one after another, their sizes and places.
        self.flat, self.sizes = np.frombuffer(b"".join(table), np.uint8), np.array([len(t) for t in table])
        self.places = np.cumsum(self.sizes) - self.sizes
        #: Bytes after a token beyond which nothing can change it: each merge delays a decision by one token at most.
        self.waiting, self.lookahead = 4 * len(ranks), len(ranks) * longest
        self.words = regex.compile(PATTERN)
        #: The same for texts of characters below U+0250, with sets that the standard library can search.
        low = [chr(i) for i in range(0x250)]
        letters, digits, blanks = ("".join(c for c in low if regex.match(p, c)) for p in (r"\p{L}", r"\p{N}", r"\p{White_Space}"))
        self.low_words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{letters}{digits}{blanks}]+|[{blanks}]+(?![^{blanks}])|[{blanks}]+")
        self.high = re.compile("[^\\x00-\u024f]")
        self.special = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.memo = _Memo(self, memo or MEMO)

    def stream(self, chunks: Iterator[bytes]) -> Iterator[bytes]:
        """The ids of one word that comes in chunks, packed, each as soon as it's stable."""
        state = self.start
        for chunk in chunks:
            for c in chunk:
                state, put = state[c]
                if put:
                    yield put
        yield state.entries[0][2]

    def _settle(self, weights: list[bytes]) -> tuple[bytes, list[bytes]]:
        """Tokens that all encodings still possible share are stable. As many tokens may wait as there are merges, which bounds
        their bytes by the lookahead."""
        if len(weights) == 1:
            return weights[0], [b""]
        low, high, n = min(weights), max(weights), 0
        while n < len(low) and low[n : n + 4] == high[n : n + 4]:
            n += 4
        if len(low) - n > self.waiting or len(high) - n > self.waiting:
            raise RuntimeError("a token waits for more bytes than the sufficient lookahead")
        return (low[:n], [w[n:] for w in weights]) if n else (b"", weights)

    def word(self, word: str) -> bytes:
        """The ids of a word as little-endian unsigned 32-bit integers."""
        return b"".join(self.stream((word.encode(),)))

    def encode(self, text: str) -> Iterator[bytes]:
        """Runs of ids, packed."""
        for part in self.special.split(text) if self.special and self.special.search(text) else (text,):
            if part in self.added:
                yield self.added[part].to_bytes(4, "little")
                continue
            words = self.words if self.high.search(part) else self.low_words
            if len(part) <= RUN:
                yield b"".join(map(self.memo.__getitem__, words.findall(part)))
            else:
                held, size = [], 0
                for m in words.finditer(part):
                    held.append(self.memo[m[0]])
                    size += len(held[-1])
                    if size > 4 * RUN:
                        yield b"".join(held)
                        held, size = [], 0
                yield b"".join(held)

    def decode(self, runs: Iterator[bytes]) -> Iterator[str]:
        """Text from runs of packed ids; a malformed byte gives U+FFFD."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for run in runs:
            ids = np.frombuffer(run, "<u4")
            size = self.sizes[ids]
            ends = np.cumsum(size)
            at = np.repeat(self.places[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
            yield machine.decode(self.flat[at].tobytes())
        yield machine.decode(b"", final=True)


class _Memo(dict):
    def __init__(self, codec: Codec, most: int):
        super().__init__()
        self.codec, self.most = codec, most

    def __missing__(self, word: str) -> bytes:
        packed = self.codec.word(word)
        if len(word) <= MEMO_WORD:
            if len(self) >= self.most:
                self.clear()
            self[word] = packed
        return packed


@functools.lru_cache(maxsize=2)
def codec(path: str, states: int | None = None, memo: int | None = None) -> Codec:
    """One codec for each vocabulary and Python worker."""
    return Codec(path, states, memo)


def round_trip(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", states: int | None = None, memo: int | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row: encoded, then decoded from its ids. ``states`` and
    ``memo`` bound what a worker keeps of states and of words, where other stages need the memory more than this one the time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, states, memo)
        for b in pieces(batches):
            n, ids, back = [], [], []
            for t in utf8(b.column(1)):
                size, digest, turned = 0, hashlib.sha256(), hashlib.sha256()

                def runs(t=t, digest=digest):
                    nonlocal size
                    for r in c.encode(t.decode()):
                        size += len(r) // 4
                        digest.update(r)
                        yield r

                for s in c.decode(runs()):
                    turned.update(s.encode())
                n.append(size)
                ids.append(digest.hexdigest())
                back.append(turned.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        give_back()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("t")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with an array column of token ids."""

    @F.pandas_udf("array<int>")
    def run(texts):
        c = codec(path)
        return texts.map(lambda t: np.frombuffer(b"".join(c.encode(t or "")), "<i4"), na_action=None)

    return docs.withColumn(ids, run(F.col(text).cast("string")))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))

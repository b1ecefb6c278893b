"""Importance resampling against a plain version, with nulls, long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from ampliform.llm import importance

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, n_words long, weight double, rank string, th int"


def rows():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice(["th", "Er", "on", "é", "ß", "日本", "7", "-", "İ"]) for _ in range(rng.randrange(1, 5)))
    texts = [None, "", " \n", "a\x00b c", "x" * 3000, "ab " * 900] + [" ".join(word() for _ in range(rng.randrange(5, 90))) for _ in range(60)]
    out = [(i, t, 1, 0.5, "r", 2) for i, t in enumerate(texts)]
    return out + out[10:14] + [(10, texts[11], 1, 0.5, "r", 2), (None, texts[20], 1, 0.5, "r", 2)]


def features(text, low, high):
    w = WORD.findall((text or "").translate(LOWER))
    return w, [" ".join(w[i : i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, low, high, buckets, percent=10, least=20):
    b = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for d in docs:
        s.update(map(b, features(d[1], low, high)[1]))
    for x in target:
        t.update(map(b, features(x, low, high)[1]))
    n, m = sum(s.values()), sum(t.values())
    gain = {k: math.floor(1000 * math.log((t[k] + 1) * (n + buckets) / ((s[k] + 1) * (m + buckets)))) for k in range(buckets)}
    out = []
    for i, text, *_ in docs:
        w, f = features(text, low, high)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b(x)] for x in f)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least))
    able = sorted((-sc, 1 << 60 if i is None else i) for i, _, _, sc, ok in out if ok)
    drawn = Counter(able[: len(able) * percent // 100])
    return sorted(o[1:4] for o in out), drawn, len(able) * percent // 100


@pytest.mark.parametrize(("low", "high", "buckets", "percent"), [(1, 1, 10_000, 10), (1, 3, 50, 50), (2, 2, 7, 100)])
def test_scores(spark, low, high, buckets, percent):
    docs, target = rows(), ["thé on er", None, "ONß 7 日本", ""]
    got = importance.scored(spark.createDataFrame(docs, SCHEMA).repartition(5), spark.createDataFrame([(t, 1) for t in target], "text string, rank int"), low, high, buckets, percent).collect()
    want, drawn, n = plain(docs, target, low, high, buckets, percent)
    assert sorted((r.n_features, r.weight, r.score) for r in got) == want
    top = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in top] == list(range(1, n + 1))
    assert Counter((-r.score, 1 << 60 if r.doc_id is None else r.doc_id) for r in top) == drawn
    assert [(-r.score, 1 << 60 if r.doc_id is None else r.doc_id) for r in top] == sorted(drawn.elements())


def test_drawn_rows(spark):
    docs, target = spark.createDataFrame(rows(), SCHEMA), spark.createDataFrame([("thé on er",)], "text string")
    got = importance.resampled(docs, target, percent=50)
    assert got.columns == docs.columns
    ids = lambda d: Counter(r.doc_id for r in d.select("doc_id").collect())
    assert ids(got) == ids(importance.scored(docs, target, percent=50).where("rank is not null"))


def test_long_texts(monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 16)
    for _, text, *_ in rows():
        for low, high in ((1, 1), (1, 3), (2, 2)):
            (words, n, at, count), *_ = importance.document_buckets([(text or "").encode()], low, high, 97)
            w, f = features(text, low, high)
            want = Counter(zlib.crc32(x.encode()) % 97 for x in f)
            assert (words, n, dict(zip(at.tolist(), count.tolist(), strict=True))) == (len(w), len(f), dict(want))


def test_no_rows(spark):
    none, some = spark.createDataFrame([], SCHEMA), spark.createDataFrame(rows(), SCHEMA)
    target = spark.createDataFrame([], "text string")
    assert importance.scored(none, target).count() == 0
    assert importance.resampled(none, target).count() == 0
    want, drawn, n = plain(rows(), [], 1, 1, 10_000)
    got = importance.scored(some, target).collect()
    assert sorted((r.n_features, r.weight, r.score) for r in got) == want
    assert sum(r["rank"] is not None for r in got) == n

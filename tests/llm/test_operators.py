"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeated rows, empty tables and
extra columns whose names clash with those that the operators use."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest

from ampliform.llm import bpe, embedding_dedup, exact_dedup, jaccard_join, licenses, mixing, repeats, sharding, token_counts, toxicity

SCHEMA = "doc_id long, text string, source string, n long, k string, kept boolean, set_id long, h long, text_sha256 string, text_id long"
BLANK = re.compile("[\x20\x09-\x0d]")
WORD = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n):
    return " ".join("".join(rng.choice(["th", "er", "on", "an", "é", "ß", "re"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def corpus():
    rng = random.Random(5)
    texts = [None, "", " \n\t ", "one two", "One  two", "one two", "a b c d e", "under the MIT License. Apache License, Version 2; CC-BY-NC", "<|endoftext|> x", "日本語 ▁x 🙂", "x" * 3000, "ab " * 900]
    base = prose(rng, 150)
    passage = prose(rng, 90)
    texts += [base, base, base + " ", base.replace("th", "er", 3), base + " tail words here", base.upper()]
    for _ in range(12):
        texts.append(prose(rng, rng.randrange(20, 120)) + " " + passage + " " + prose(rng, rng.randrange(0, 60)))
    texts += [prose(rng, 200) for _ in range(12)] + [passage + passage, prose(rng, 5000)]
    return [(i, t, f"s{i % 3}" if i % 7 else None, 1, "k", True, 2, 3, "z", 4) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def components(ids, links):
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for i in sorted(ids):
        if i not in out:
            todo = [i]
            while todo:
                x = todo.pop()
                if x not in out:
                    out[x] = i
                    todo += near[x]
    return out


def test_exact(docs, rows, nothing, spark):
    norm = {i: BLANK.sub("", t or "") for i, t, *_ in rows}
    text = {i: t or "" for i, t, *_ in rows}
    groups = defaultdict(list)
    for i, s in norm.items():
        groups[s].append(i)
    for r in exact_dedup.decisions(docs).collect():
        g = groups[norm[r.doc_id]]
        keep = min(g, key=lambda i: (-len(text[i]), i))
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(g), keep == r.doc_id)
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(g, key=lambda i: (-len(text[i]), i)) for g in groups.values())
    assert exact_dedup.decisions(nothing).count() == 0
    odd = spark.createDataFrame([(None, "a"), (None, "a"), (7, "a "), (7, "a ")], "doc_id long, text string")
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.decisions(odd).collect()} == {(None, 7, 4, False), (7, 7, 4, True)}
    assert exact_dedup.keep_first(odd).count() == 1


def covered_bytes(data, need=400):
    """Brute force: which bytes of each text a string of ``need`` bytes covers that starts anywhere else too."""
    n = Counter(d[p : p + need] for d in data.values() for p in range(len(d) - need + 1))
    out = {}
    for i, d in data.items():
        cover = np.zeros(len(d), bool)
        for p in range(len(d) - need + 1):
            if n[d[p : p + need]] > 1:
                cover[p : p + need] = True
        out[i] = cover
    return out


def removed_like(got, data):
    cover = covered_bytes(data)
    for r in got:
        d, on = data[r.doc_id], cover[r.doc_id]
        runs = int((np.diff(np.concatenate([[0], on.astype(int)])) == 1).sum())
        assert (r.n_bytes, r.n_removed, r.n_spans) == (len(d), int(on.sum()), runs)
        assert r.kept_sha256 == hashlib.sha256(np.frombuffer(d, np.uint8)[~on].tobytes()).hexdigest()


@pytest.mark.parametrize("contexts", [2000, 2])
def test_repeats(docs, rows, nothing, monkeypatch, contexts):
    monkeypatch.setattr(repeats, "CONTEXTS", contexts)
    got = repeats.remove(docs).collect()
    assert len(got) == len(rows)
    removed_like(got, {i: (t or "").encode() for i, t, *_ in rows})
    if contexts == 2000:
        assert repeats.remove(nothing).count() == 0


@pytest.mark.parametrize("contexts", [2000, 6])
def test_repeats_of_hot_passages_and_long_texts(spark, monkeypatch, contexts):
    """Many texts share a passage, cut at different places; some are longer than a slice."""
    monkeypatch.setattr(repeats, "CONTEXTS", contexts)
    monkeypatch.setattr(repeats, "SLICE", 4000)
    rng = random.Random(12)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(900))
    data = {}
    for i in range(40):
        a, b = rng.randrange(0, 500), rng.randrange(380, 900)
        data[i] = ("".join(rng.choice("xyz ") for _ in range(rng.randrange(600))) + passage[a : max(b, a + 300)] + "".join(rng.choice("uvw ") for _ in range(rng.randrange(300)))).encode()
    for i in range(40, 44):
        data[i] = ("".join(rng.choice("klmn ") for _ in range(3900)) + passage + "".join(rng.choice("opq ") for _ in range(9000)) + passage[100:700]).encode()
    df = spark.createDataFrame([(i, d.decode()) for i, d in data.items()], "doc_id long, text string").repartition(3)
    removed_like(repeats.remove(df).collect(), data)
    if contexts == 2000:
        found = repeats.repeat_groups(df).toPandas()
        texts = {repeats.text_id(d): d for d in data.values()}
        for _, g in found.groupby(["part", "repeat"]):
            said = {texts[t][s : s + n] for t, s, n in zip(g["text_id"], g["start"], g["length"], strict=True)}
            assert len(said) == 1 and len(g) > 1  # one string, in several places
            word = said.pop()
            every = {(k, m.start()) for k, d in texts.items() for m in re.finditer(b"(?=" + re.escape(word) + b")", d)}
            assert every == set(zip(g["text_id"], g["start"], strict=True))


def test_repeat_groups_are_maximal():
    lefts, rights = [b"xyz" + b"a" * 197, b"xyz" + b"b" * 197, b"q" * 200], [b"r" * 400, b"r" * 398 + b"st", b"r" * 400]
    got = {(tuple(sorted(m)), a, b) for m, a, b in repeats.maximal_repeats(lefts, rights, 400)}
    assert got == {((0, 1), 3, 398), ((0, 2), 0, 400)}


def test_sharding(docs, nothing, spark):
    got = sharding.shard(docs, 3).toPandas()
    assert len(got) == docs.count()
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert sharding.shard(nothing, 3).count() == 0
    many = spark.createDataFrame([(i, "copy of one text" if i % 3 == 0 else f"text {i} " + "y" * (i % 50)) for i in range(6000)], "doc_id long, text string")
    size = sharding.shard(many, 6).groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert len(size) == 6 and size.max() < 1.05 * size.mean() and size.min() > 0.95 * size.mean()


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    centre = rng.standard_normal((40, 16))
    x = [centre[i % 40] + rng.standard_normal(16) * (0.02 if i < 300 else 3) for i in range(400)] + [centre[0]] * 3
    data = [(i, [float(v) for v in e], 1) for i, e in enumerate(x)] + [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [], 0), (1004, [1.0, None], 0), (1005, [1.0], 0), (1006, [2.0], 0)]
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>, v int")).collect()}
    u = np.stack(x)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = u @ u.T >= 0.9
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(hit), strict=True) if a < b]
    part = components(range(len(x)), links)
    found = sum(got[i].n_links for i in range(len(x)))
    assert found >= 0.98 * 2 * len(links)
    assert np.mean([got[i].component_id == part[i] for i in range(len(x))]) >= 0.98
    assert all(got[i].n_links <= hit[i].sum() - 1 for i in range(len(x)))
    assert [got[i].n_links for i in range(1000, 1007)] == [0, 0, 0, 0, 0, 1, 1]


def true_groups(data, least=0.9):
    """n_links and component_id of each vector by brute force."""
    x = np.array([e for _, e in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= least
    np.fill_diagonal(hit, False)
    ids = [i for i, _ in data]
    names = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(hit), strict=True)])
    return {i: (int(n), names[i]) for i, n in zip(ids, hit.sum(axis=1), strict=True)}


def test_dense_groups_link_across(spark):
    rng = np.random.default_rng(3)
    a, b = np.eye(32)[0], 0.92 * np.eye(32)[0] + np.sqrt(1 - 0.92**2) * np.eye(32)[1]
    data = [(i, ((a if i < 40 else b) + 0.01 * rng.standard_normal(32)).tolist()) for i in range(80)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == (want := true_groups(data))
    assert {c for _, c in want.values()} == {0} and max(n for n, _ in want.values()) > 40


def test_sparse_links_beside_a_hot_group(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "ROUNDS", 0)  # poor lists
    rng = np.random.default_rng(4)
    hot = np.eye(32)[0] + 0.01 * rng.standard_normal((400, 32))
    sparse = rng.standard_normal((300, 32))
    near = sparse + 0.07 * np.linalg.norm(sparse, axis=1, keepdims=True) * rng.standard_normal((300, 32))
    data = [(i, e.tolist()) for i, e in enumerate(np.concatenate([hot, sparse, near]))]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == true_groups(data)


def test_licenses(docs, rows, nothing):
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    text = {i: t or "" for i, t, *_ in rows}
    for r in licenses.report(docs).collect():
        w = word.findall(text[r.doc_id].translate(LOWER))
        hits = [(i, lab) for p, lab in licenses.BASE for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        assert (r.n_words, r.n_base) == (len(w), len(hits))
        assert (r.first_word, r.last_word) == ((min(hits)[0], max(hits)[0]) if hits else (None, None))
        assert r.base_labels == ",".join(sorted({h[1] for h in hits}))
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not hits
    assert licenses.report(nothing).count() == 0


def test_license_suppression(spark):
    df = spark.createDataFrame([(1, "Released under the GNU Lesser General Public License version 3"), (2, "SPDX-License-Identifier: MPL-2.0"), (3, "a mit of nothing")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.report(df).collect()} == {1: "lgpl-3", 2: "mpl-2", 3: ""}


def example(tree, rng):
    """A string that a parsed expression matches."""
    out = ""
    for op, arg in tree:
        kind = str(op)
        if kind == "LITERAL":
            out += chr(arg)
        elif kind == "ANY":
            out += "z"
        elif kind == "IN":
            low, high = arg[0][1] if str(arg[0][0]) == "RANGE" else (rng.choice(arg)[1],) * 2
            out += chr(rng.randint(low, high))
        elif kind == "BRANCH":
            out += example(rng.choice(arg[1]), rng)
        elif kind == "SUBPATTERN":
            out += example(arg[3], rng)
        else:
            assert kind == "MAX_REPEAT"
            out += "".join(example(arg[2], rng) for _ in range(rng.randint(arg[0], min(arg[1], arg[0] + 1))))
    return out


def test_each_license_rule_is_found(spark):
    rng = random.Random(2)
    said = [re.sub(" +", " ", example(re._parser.parse(r[4]), rng)).strip() for r in licenses.rules() for _ in range(4)]
    df = spark.createDataFrame([(i, f"zz {t} zz") for i, t in enumerate(said)], "doc_id long, text string")
    found = {r.doc_id: r.license.found for r in licenses.scan(df).collect()}
    assert not [t for i, t in enumerate(said) if not any(f.start <= 4 and f.start + f.length >= 4 + len(t) for f in found[i])]


def test_license_names_and_bodies(spark):
    texts = {
        "Apache-2.0": "apache-2", "Apache 2": "apache-2", "Boost 1.0": "boost-1", "Public Domain Dedication": "pddl", "licensed, with a boost": "",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of": "mit",
        "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.report(df).collect()} == dict(enumerate(texts.values()))


def test_mixing(docs, rows, nothing):
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    got = mixing.mix(docs).toPandas()
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert got.sort_values("doc_id").to_dict("list") == again.sort_values("doc_id").to_dict("list")
    got["source"] = got["doc_id"].map({r[0]: r[2] for r in rows}).fillna("null")
    assert (got["size"] == got["doc_id"].map(size)).all() and (got["taken"] <= 2 * got["size"]).all()
    by = got.groupby("source").agg(size=("size", "sum"), target=("target", "first"), taken=("taken", "sum"))
    assert (by["target"] <= 2 * by["size"] + 1e-6).all() and abs(by["target"].sum() - 1.5 * by["size"].sum()) < 1e-6
    assert ((by["target"] - by["taken"]).abs() <= 1).all()
    assert mixing.mix(nothing).count() == 0
    assert mixing.apply(docs).columns == docs.columns


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Sharing by weight, again and again among the sources that are not full."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = [s for s in names if s not in full]
        part = {s: left * w[s] / sum(w[t] for t in rest) for s in rest}
        over = {s for s in rest if part[s] > most * sizes[s]}
        if not over:
            return {s: most * sizes[s] if s in full else part[s] for s in names}
        full |= over


def test_mixing_targets_and_small_sources(spark):
    """A source of one word beside large ones gets its slot; equal rows and repeated ids are taken row by row."""
    data = [(i, "w " * (200 + i % 7), "big" if i % 2 else "other") for i in range(300)] + [(9000, "one", "tiny"), (9001, "a b", None), (7, "w w w", "big"), (7, "w w w", "big"), (None, "x y", "other"), (8, None, "void")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    sizes = defaultdict(int)
    for _, t, s in data:
        sizes[s] += len((t or "").split())
    want = plain_targets(sizes)
    got = mixing._mixed(df, (5, 2, 1), 1.5, 2.0, "text", "doc_id", "source").collect()
    assert len(got) == len(data) and all(abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source] for r in got)
    taken = defaultdict(int)
    for r in got:
        taken[r.source] += r.taken
        assert r.taken <= 2 * r.size
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    out = mixing.apply(df)
    n = Counter((r.doc_id, r.text, r.source) for r in out.collect())
    for key in {(r.doc_id, r.source) for r in got}:
        assert sum(c for (i, _, s), c in n.items() if (i, s) == key) == sum(int(r.taken / r.size + 0.5) for r in got if r.size and (r.doc_id, r.source) == key)


def test_toxicity(spark, docs, nothing):
    rng = random.Random(9)
    bad = ["grobnik", "sclurf", "vexmoor"]
    data, marks = [], []
    for i in range(1500):
        t, y = prose(rng, rng.randrange(10, 60)).split(), int(rng.random() < 0.2)
        if y:
            t.insert(rng.randrange(len(t)), rng.choice(bad).upper() if i % 2 else rng.choice(bad) + ",")
        data.append((i, " ".join(t)))
        marks.append((i, y))
    labels = spark.createDataFrame([*marks, (None, 1), (3, None)], "doc_id long, toxic int")
    frame = spark.createDataFrame([*data, (5000, None), (5001, "")], "doc_id long, text string")
    got = toxicity.scores(frame, labels).toPandas().set_index("doc_id")
    truth = pd.Series(dict(marks))
    held = got[got["held_out"]].index.intersection(truth.index)
    assert (got.loc[held, "predicted"] == truth[held]).mean() > 0.97
    assert got["score"].between(0, 1).all() and got.loc[5000, "score"] == got.loc[5001, "score"]
    clean = toxicity.keep_clean(docs, labels)
    assert clean.columns == docs.columns
    assert toxicity.scores(docs, labels.where("doc_id < 0")).count() == docs.count()
    assert toxicity.scores(nothing, labels).count() == 0


def odd_texts():
    rng = random.Random(4)
    made = ["".join(rng.choice("etaoin shr\n 'l0_-.é") for _ in range(rng.randrange(0, 300))) for _ in range(300)]
    return made + ["a" * 5000, " " * 700, "<|endoftext|>" * 3, "▁ x", "".join(chr(rng.randrange(1, 0x2FFF)) for _ in range(800)), "x " * 40000]


def test_bpe_is_the_librarys():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), bpe.Codec(path)
    for t in odd_texts():
        ids = lib.encode(t, add_special_tokens=False).ids
        runs = list(own.encode(t))
        assert np.frombuffer(b"".join(runs), "<u4").tolist() == ids
        assert "".join(own.decode(iter(runs))) == lib.decode(ids, skip_special_tokens=False)


def test_bpe_states_may_run_out(monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = bpe.Codec(path)
    monkeypatch.setattr(bpe, "STATES", 10)
    small = bpe.Codec(path)
    for t in [*odd_texts()[:60], "z" * 500 + "abcdefgh" * 40]:
        assert b"".join(whole.encode(t)) == b"".join(small.encode(t))


def test_bpe_query(docs, rows, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    text = {i: t or "" for i, t, *_ in rows}
    for r in bpe.round_trip(docs, path).collect():
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
    assert bpe.round_trip(nothing, path).count() == 0


def test_counts_are_the_librarys(monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    own = token_counts.Counter(path)
    for t in odd_texts():
        assert own.count(t) == len(lib.encode(t))
    monkeypatch.setattr(token_counts, "STATES", 10)
    small = token_counts.Counter(path)
    for t in odd_texts()[:60]:
        assert small.count(t) == own.count(t)


@pytest.mark.parametrize("meet", [4096, 5])
def test_state_maps_compose(monkeypatch, meet):
    """In any order, over any chunks, as walking does."""
    monkeypatch.setattr(token_counts, "MEET", meet)
    rng = random.Random(6)
    own = token_counts.counter(public_tokenizers.path("piece_bpe_32k.model"))
    for t in [*odd_texts()[::4], "internationalisation" * 40, "a" * 700, "ab  c" * 90]:
        if not t:
            continue
        whole = " " + t.replace("▁", " ")
        cuts = sorted({0, len(whole), *(rng.randrange(len(whole)) for _ in range(9))})
        maps = [own.map(whole[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        while len(maps) > 1:
            i = rng.randrange(len(maps) - 1)
            maps[i : i + 2] = [own.compose(*maps[i : i + 2])]
        assert own.total(maps[0]) == own.count(t)


def test_counts_query(spark, docs, rows, nothing, monkeypatch):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(token_counts, "LONG", 200)
    monkeypatch.setattr(token_counts, "CHUNK", 64)
    both = docs.union(docs.where("doc_id > 10"))
    want = sorted((i, len((t or "").encode()), len(lib.encode(t or "")), len(lib.encode(t or "")) > 100) for i, t, *_ in [*rows, *(r for r in rows if r[0] > 10)])
    assert sorted(map(tuple, token_counts.token_counts(both, path, 100).collect())) == want
    assert token_counts.token_counts(nothing, path).count() == 0


def test_jaccard(docs, rows, nothing, spark):
    sets = {}
    for i, t, *_ in rows:
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    part = components(sets, links)
    got = jaccard_join.join_classes(docs).collect()
    assert len(got) == len(rows)
    assert all((r.n_shingles, r.component_id) == (len(sets[r.doc_id]), part[r.doc_id]) for r in got)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(part.values()))
    assert jaccard_join.join_classes(nothing).count() == 0


def test_jaccard_size_bytes_are_never_stricter():
    for a, b in ((400_000, 310_000), (3_000_000, 2_400_000), (300, 240)):
        sizes = np.array([a, b])
        code = np.minimum(255, (np.log(sizes) / jaccard_join._STEP).astype(int)).astype(np.float64)
        for i in range(0, a // 4, a // 40):
            for j in range(0, b // 4, b // 40):
                share = np.array([i, j]) * 256 // sizes
                if jaccard_join._may_link(a, i, b, j, 75):
                    assert jaccard_join._may_link_bytes(code, share, np.array([0]), np.array([1]), 75)[0]


def test_jaccard_chains(spark, monkeypatch):
    """Links through steps of small edits, with groups larger than a chunk."""
    monkeypatch.setattr(jaccard_join, "MEMBERS", 4)
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    data = []
    for i in range(40):
        data.append((i, " ".join(words)))
        words[rng.randrange(120)] = f"n{i}"
        words[rng.randrange(120)] = f"m{i}"
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(116)} for i, t in data}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    part = components(sets, links)
    got = jaccard_join.join_classes(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in got} == part


def test_exact_in_segments(docs, monkeypatch):
    """A filter of several segments gives the same rows."""
    one, first = exact_dedup.decisions(docs).collect(), exact_dedup.keep_first(docs).collect()
    monkeypatch.setattr(exact_dedup, "BITS_PER_KEY", 1 << 12)
    assert len(exact_dedup._in_segments(docs.selectExpr("doc_id as key"), docs.count(), 16)) > 1
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, exact_dedup.decisions(docs, segment=16).collect()), key=str)
    assert sorted(r.doc_id for r in first) == sorted(r.doc_id for r in exact_dedup.keep_first(docs, segment=16).collect())


def test_exact_hot_group(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT", 2)
    df = spark.range(4000).selectExpr("id as doc_id", "case when id % 3 < 2 then 'a copy' else cast(id as string) end as text")
    got = {r.doc_id: r for r in exact_dedup.decisions(df).collect()}
    copies = [i for i in range(4000) if i % 3 < 2]
    assert len(got) == 4000 and all((got[i].keep_id, got[i].group_size) == (0, len(copies)) for i in copies)
    assert all(got[i].kept for i in range(2, 4000, 3)) and exact_dedup.keep_first(df).count() == 4000 - len(copies) + 1


def test_sharding_against_plain_values(spark, docs, rows):
    """Sizes, checksums and the law by plain Python; equal texts together; each shard a stretch of (text hash, row hash)."""
    both = docs.select("doc_id", "text").union(docs.where("doc_id < 9").select("doc_id", "text"))
    data = sorted(((i, t) for i, t, *_ in [*rows, *(r for r in rows if r[0] < 9)]), key=str)
    got = sharding.shard(both, 4).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) for r in got) == sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()), "bytes", None) for i, t in data)
    assert {r.shard for r in got} <= set(range(4))
    shard, crc = defaultdict(set), {i: zlib.crc32((t or "").encode()) for i, t in data}
    for r in got:
        shard[crc[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in shard.values())
    for k in range(4):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))


def test_embeddings_of_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, component_id string, v int"
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, [1.0, 0.0], "x", 1), (1, [1.0, 0.01], "x", 1), (2, [1.0, 0.0], "x", 1), (None, [0.0, 1.0], "x", 1), (3, None, "x", 1)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == 5 and sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.vec_id is not None) == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3)]


def test_ftrl_is_the_published_update():
    """Against a plain version, coordinate by coordinate."""
    rng = random.Random(3)
    rows = [(int(rng.random() < 0.4), sorted({rng.randrange(12) for _ in range(5)} | {12})) for _ in range(40)]
    z, n = [0.0] * 13, [0.0] * 13

    def weight(i):
        if abs(z[i]) <= toxicity.L1:
            return 0.0
        return -(z[i] - (1 if z[i] > 0 else -1) * toxicity.L1) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.PASSES):
        for y, at in rows:
            w = {i: weight(i) for i in at}
            g = 1 / (1 + np.exp(-(sum(w.values()) - 0.3))) - y
            for i in at:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * w[i]
                n[i] += g * g
    got = toxicity.ftrl([(y, np.array(at)) for y, at in rows], 12, -0.3)
    assert np.allclose(got, [weight(i) for i in range(13)]) and np.count_nonzero(got)


def test_keep_one_of_odd_ids(spark):
    """Of a component one row stays, with null and repeated ids too; rows without words stay."""
    base = " ".join(f"w{i}" for i in range(80))
    rows = [(5, base), (5, base + " end"), (None, base + " more"), (5, base), (3, "quite another text of some words here"), (None, ""), (None, "")]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(kept) == 4 and sorted((str(r.doc_id), r.text == "") for r in kept) == [("3", False), ("5", False), ("None", True), ("None", True)]


def test_bpe_memo_holds_the_words_of_a_corpus():
    class Stub:
        asked = 0

        def word(self, word):
            self.asked += 1
            return b""

    stub = Stub()
    memo = bpe._Memo(stub, bpe.MEMO)
    for _ in range(2):
        for i in range(345_000):  # distinct words of documents at sf0.1
            memo[str(i)]
    assert stub.asked == 345_000


def test_jaccard_asks_no_further_chunk_once_linked(spark, monkeypatch):
    asked = []
    whole = jaccard_join._chunk_links
    monkeypatch.setattr(jaccard_join, "MEMBERS", 4)
    monkeypatch.setattr(jaccard_join, "_chunk_links", lambda a, *more: (asked.append(a.count()), whole(a, *more))[1])
    words = [f"w{i}" for i in range(40)]
    # one large group of near copies, and sets that link with every member of it but begin no group with it
    data = [(i, " ".join([*words, f"x{i}"])) for i in range(40)]
    data += [(100 + i, " ".join([*words[:39], f"y{i}", f"z{i}"])) for i in range(3)]
    got = {r.doc_id: r.component_id for r in jaccard_join.join_classes(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0} and len(got) == 43
    assert sum(asked) <= 43  # chunks times queries before


def test_jaccard_sets_without_a_group_meet_in_blocks(spark, monkeypatch):
    """Near copies of one text that lie just too far apart to link are no query each to all others."""
    asked, whole = [], jaccard_join._chunk_links
    monkeypatch.setattr(jaccard_join, "_chunk_links", lambda a, *more: (asked.append(a.count()), whole(a, *more))[1])
    rng = random.Random(5)
    base = [f"w{i}" for i in range(80)]
    data = []
    for i in range(90):
        words = list(base)
        for j in rng.sample(range(5, 75, 5), 2):
            words[j] = f"x{i}_{j}"
        data.append((i, " ".join(words)))
        if i % 30 == 0:  # some link with a copy of their own
            words[77] = f"y{i}"
            data.append((1000 + i, " ".join(words)))
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(76)} for i, t in data}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    assert 3 <= len(links) < 200
    frame = spark.createDataFrame(data, "doc_id long, text string")
    for block in (256, 7):
        monkeypatch.setattr(jaccard_join, "BLOCK", block, raising=False)
        asked.clear()
        got = jaccard_join.join_classes(frame).collect()
        assert {r.doc_id: r.component_id for r in got} == components(sets, links)
        assert sum(asked) <= 10 * len(data)  # pairs of sets before


def test_jaccard_sketch_grows(spark, monkeypatch):
    """A token of many documents and a unique one stay apart in the order at any number of documents; results don't hang on the counters."""
    rows, most = [1, 256_410, 262_145, 769_230, 10**9], 8 * jaccard_join.CELLS
    assert [jaccard_join._cells(n) for n in rows] == [jaccard_join.CELLS, jaccard_join.CELLS, 2 * jaccard_join.CELLS, 4 * jaccard_join.CELLS, most]
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 3}x{k + (i % 3) // 2}" for k in range(60))) for i in range(30)], "doc_id long, text string")
    want = sorted(map(tuple, jaccard_join.join_classes(docs).collect()))
    monkeypatch.setattr(jaccard_join, "_cells", lambda n: 2 * jaccard_join.CELLS)
    assert sorted(map(tuple, jaccard_join.join_classes(docs).collect())) == want
    assert {c for _, _, c in want} == {3 * g for g in range(10)}

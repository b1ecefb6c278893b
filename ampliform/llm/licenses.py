"""License scans: ordered signature rules in DataFrame operations alone.

A text is put into normal form: words of ASCII digits, letters and all characters beyond ASCII, A-Z lower-cased,
one blank between. Rules are regular expressions over that form, built from ``NAMES`` and ``FORMS``, or taken from
``BODIES``; each has a keyword that all its matches hold, and is tried only on texts that hold it. Detections carry the rule's priority;
one that lies within a detection of a better priority (or of the same and longer) is suppressed. Labels are those of the
detections left and of the base phrases, which are never suppressed.

Edge cases: null and empty texts have no word, no label and score 0; overlapping places count; a text's other columns
are left alone; rows are scanned one by one, so repeated rows agree.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh

#: Phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: (label, keyword, expression for the name in normal form), the more specific first: the place is the priority.
NAMES = (
    ("agpl-3", "affero", r"(?:gnu )?affero general public licen[sc]e(?: v(?:ersion)? ?3(?: 0)?)?"),
    ("agpl-3", "agpl", r"agpl(?: ?v? ?3(?: 0)?)?(?: only| or later)?"),
    ("lgpl-2.1", "lesser", r"(?:gnu )?lesser general public licen[sc]e v(?:ersion)? ?2(?: 1)?"),
    ("lgpl-3", "lesser", r"(?:gnu )?lesser general public licen[sc]e v(?:ersion)? ?3(?: 0)?"),
    ("lgpl", "lesser", r"(?:gnu )?lesser general public licen[sc]e"),
    ("lgpl", "library general", r"(?:gnu )?library general public licen[sc]e"),
    ("lgpl-2.1", "lgpl", r"lgpl ?v? ?2(?: 1)?(?: only| or later)?"),
    ("lgpl-3", "lgpl", r"lgpl ?v? ?3(?: 0)?(?: only| or later)?"),
    ("lgpl", "lgpl", r"lgpl"),
    ("gpl-2", "general public", r"(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)? v(?:ersion)? ?2(?: 0)?"),
    ("gpl-3", "general public", r"(?:gnu )?general public licen[sc]e(?: as published by the free software foundation)?(?: either)? v(?:ersion)? ?3(?: 0)?"),
    ("gpl", "general public", r"(?:gnu )?general public licen[sc]e"),
    ("gpl-2", "gpl", r"gpl ?v? ?2(?: 0)?(?: only| or later)?"),
    ("gpl-3", "gpl", r"gpl ?v? ?3(?: 0)?(?: only| or later)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("gfdl", "free documentation", r"(?:gnu )?free documentation licen[sc]e(?: version 1(?: [123])?)?"),
    ("gfdl", "gfdl", r"gfdl(?: 1(?: [123])?)?"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: licen[sc]e)? ?(?:v(?:ersion)? ?)?1 1"),
    ("apache-2", "apache", r"apache(?: software)?(?: licen[sc]e)? ?(?:v(?:ersion)? ?)?2(?: 0)?"),
    ("bsd-4-clause", "bsd", r"(?:original |old )bsd|bsd 4 clause|4 clause bsd|four clause bsd"),
    ("bsd-3-clause", "bsd", r"(?:new |revised |modified )bsd|bsd 3 clause|3 clause bsd|three clause bsd"),
    ("bsd-2-clause", "bsd", r"(?:simplified |freebsd )bsd|bsd 2 clause|2 clause bsd|two clause bsd"),
    ("0bsd", "bsd", r"0bsd|bsd zero clause"),
    ("bsd", "bsd", r"bsd(?: style)?"),
    ("mit-0", "mit", r"mit no attribution|mit 0"),
    ("mit", "mit|expat|x11", r"(?:the )?(?:mit x11|mit|expat|x11)"),
    ("isc", "isc", r"isc"),
    ("mpl-1.1", "mozilla", r"mozilla public licen[sc]e v(?:ersion)? ?1(?: [01])?"),
    ("mpl-2", "mozilla", r"mozilla public licen[sc]e v(?:ersion)? ?2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public licen[sc]e"),
    ("mpl-2", "mpl", r"mpl ?v? ?2(?: 0)?"),
    ("epl-1", "eclipse", r"eclipse public licen[sc]e v(?:ersion)? ?1(?: 0)?"),
    ("epl-2", "eclipse", r"eclipse public licen[sc]e v(?:ersion)? ?2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public licen[sc]e"),
    ("cddl-1", "cddl", r"cddl(?: 1(?: [01])?)?"),
    ("cddl-1", "common development", r"common development and distribution licen[sc]e"),
    ("cpl-1", "common public", r"common public licen[sc]e"),
    ("eupl", "european union", r"european union public licen[sc]e"),
    ("eupl", "eupl", r"eupl(?: 1(?: [012])?)?"),
    ("artistic-2", "artistic", r"artistic licen[sc]e (?:v(?:ersion)? ?)?2(?: 0)?"),
    ("artistic-1", "artistic", r"(?:perl )?artistic"),
    ("boost-1", "boost", r"boost(?: software)?(?: licen[sc]e)?(?: (?:version )?1 0)?"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("python-2", "python", r"python(?: software foundation)?"),
    ("postgresql", "postgresql", r"postgresql"),
    ("openssl", "openssl", r"openssl"),
    ("ofl-1.1", "open font", r"(?:sil )?open font"),
    ("bsl-1.1", "business source", r"business source"),
    ("sspl-1", "server side public", r"server side public"),
    ("elastic-2", "elastic", r"elastic(?: 2 0)?"),
    ("ms-pl", "microsoft public", r"microsoft public"),
    ("odbl", "open database", r"open database"),
    ("odc-by", "open data commons", r"open data commons attribution"),
    ("pddl", "public domain dedication", r"public domain dedication(?: and licen[sc]e)?"),
    ("cc0-1", "cc0", r"cc0(?: 1 0)?(?: universal)?"),
    ("cc-by-nc-nd", "by nc nd", r"cc by nc nd(?: [1234] [05])?"),
    ("cc-by-nc-sa", "by nc sa", r"cc by nc sa(?: [1234] [05])?"),
    ("cc-by-nc", "by nc", r"cc by nc(?: [1234] [05])?"),
    ("cc-by-nd", "by nd", r"cc by nd(?: [1234] [05])?"),
    ("cc-by-sa", "by sa", r"cc by sa(?: [1234] [05])?"),
    ("cc-by", "cc by", r"cc by(?: [1234] [05])?"),
    ("cc-by-nc-nd", "deriv", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s?"),
    ("cc-by-nc-sa", "share", r"creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc", "commercial", r"creative commons attribution non ?commercial"),
    ("cc-by-sa", "share", r"creative commons attribution share ?alike"),
    ("cc-by-nd", "deriv", r"creative commons attribution no ?deriv(?:ative)?s?"),
    ("cc-by", "creative commons", r"creative commons attribution"),
)

_GIVEN = ("released", "distributed", "published", "available", "provided", "shared", "covered")

#: (score, what a text holds if the form is to match, expression around {name}), the surest first.
FORMS = (
    (1.0, ("spdx",), r"spdx licen[sc]e identifier {name}"),
    (0.95, ("licen",), r"(?:re)?licen[sc]ed under(?: the)?(?: terms of)?(?: the)? {name}(?: licen[sc]e)?"),
    (0.9, tuple(f"{v} {w} " for v in _GIVEN for w in ("under", "by")), rf"(?:{'|'.join(_GIVEN)}) (?:under|by)(?: the)?(?: terms of)?(?: the)? {{name}}(?: licen[sc]e)?"),
    (0.85, ("licen",), r"under(?: the)?(?: terms of)?(?: the)? {name} licen[sc]e"),
    (0.8, ("licen",), r"{name} (?:public )?licen[sc]e(?: v(?:ersion)? ?[0-9]+(?: [0-9]+)?)?"),
)
#: Names that are phrases of their own, as they hold a version or the word licence: they need no form around them.
_ALONE = 0.7
#: What such a name has to be where the one in NAMES is wider.
_STRICT = {"boost": r"boost(?: software)? licen[sc]e(?: (?:version )?1 0)?|boost(?: software)? (?:version )?1 0"}

#: (label, keyword, expression): what the bodies of licenses say.
_BODY = 0.9
BODIES = (
    ("boost-1", "organization obtaining a copy", r"permission is hereby granted free of charge to any person or organization obtaining a copy"),
    ("mit", "person obtaining a copy", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("0bsd", "granted the software is provided", r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided"),
    ("isc", "granted provided that", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided that"),
    ("postgresql", "software and its documentation", r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement"),
    ("bsd-3-clause", "endorse or promote", r"(?:neither the names? of .{1,200}|the names? of .{1,200} may not) be used to endorse or promote products derived from this software"),
    ("bsd", "source and binary forms", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("zlib", "held liable for any damages arising from the use", r"in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("unlicense", "free and unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("wtfpl", "what the fuck", r"you just do what the fuck you want to"),
)


def rules() -> list[tuple[int, str, str, float, str, tuple[str, ...]]]:
    """(priority, label, keyword, score, expression, what else the text holds), the best priority first."""
    out = []
    for place, (label, keyword, name) in enumerate(NAMES):
        for k, (score, needs, form) in enumerate(FORMS):
            out.append((place * 10 + k, label, keyword, score, form.replace("{name}", f"(?:{name})"), needs))
        if label.startswith("cc") or "licen" in name:
            out.append((place * 10 + len(FORMS), label, keyword, _ALONE, f"(?:{_STRICT.get(keyword, name)})", ()))
    for place, (label, keyword, body) in enumerate(BODIES, len(NAMES)):
        out.append((place * 10, label, keyword, _BODY, body, ()))
    return out


def normal_form(text: str) -> Column:
    """The words joined by single blanks, letters as they are."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return F.trim(F.regexp_replace(t, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))


def _places(norm: Column, rx: Column, extra) -> Column:
    """array of extra(start, length): each place where rx matches; characters from 0."""
    pieces, found = F.split(norm, rx, -1), F.regexp_extract_all(norm, rx, F.lit(0))
    size = lambda parts, n: F.aggregate(F.slice(parts, 1, n), F.lit(0), lambda a, p: a + F.length(p))
    return F.transform(found, lambda m, i: extra(size(pieces, i + 1) + size(found, i), F.length(m)))


def _word(norm: Column, start: Column) -> Column:
    """The number of the word that begins at character start of " w0 w1 ... "."""
    head = F.substring(norm, F.lit(1), start)
    return (F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit(""))) - 1).cast("long")


def _bounded(expression: str) -> str:
    return f"(?<= )(?:{expression})(?= )"


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a struct column "license": n_words, base (array of label, word), found (array of label, start,
    length, priority, score: the detections left)."""
    norm, low, gate, base, found, name = (fresh(n, docs.columns) for n in ("norm_", "low_", "gate_", "base_", "found_", "license"))
    n = F.col(norm)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    step = docs.withColumn(norm, normal_form(text))
    any_of = F.lit(False)
    wide = F.lower(n)  # lowers more than A-Z: a text that this form doesn't admit can't match
    words_of = {w for rule in rules() for w in rule[2].split("|")} | {phrase for phrase, _ in BASE}
    for w in sorted(w for w in words_of if not any(v != w and v in w for v in words_of)):
        any_of = any_of | wide.contains(w)
    step = step.withColumn(gate, any_of).withColumn(low, F.when(F.col(gate), F.concat(F.lit(" "), F.translate(n, upper, lower), F.lit(" "))))
    at = F.col(low)
    spots = [F.when(at.contains(phrase), _places(at, F.lit(_bounded(phrase)), lambda s, k, label=label: F.struct(F.lit(label).alias("label"), _word(at, s).alias("word")))) for phrase, label in BASE]
    empty = F.array().cast("array<struct<label:string,word:bigint>>")
    step = step.withColumn(base, F.when(F.col(gate), F.concat(*(F.coalesce(s, empty) for s in spots))).otherwise(empty))
    kinds = "array<struct<priority:int,label:string,score:double,start:int,length:int>>"
    hits = F.array().cast(kinds)
    by_need: dict[tuple, list] = {}
    for rule in rules():
        by_need.setdefault((rule[2], rule[5]), []).append(rule)
    has = lambda words: functools.reduce(lambda x, y: x | y, (at.contains(w) for w in words))
    tried = []
    for (keyword, needs), group in by_need.items():
        rows = F.array(*(F.struct(F.lit(p).alias("p"), F.lit(lab).alias("l"), F.lit(s).alias("s"), F.lit(_bounded(rx)).alias("rx")) for p, lab, _, s, rx, _ in group))
        held = has(keyword.split("|"))
        tried.append(F.when(held & has(needs) if needs else held, rows))
    todo = F.flatten(F.filter(F.array(*tried), lambda r: r.isNotNull()))
    each = F.flatten(F.transform(todo, lambda r: _places(at, r["rx"], lambda s, k: F.struct(r["p"].alias("priority"), r["l"].alias("label"), r["s"].alias("score"), s.alias("start"), k.alias("length")))))
    step = step.withColumn(found, F.when(F.col(gate), each).otherwise(hits).cast(kinds))
    d = F.col(found)
    inside = lambda x, y: (y["start"] <= x["start"]) & (y["start"] + y["length"] >= x["start"] + x["length"])
    better = lambda x, y: (y["priority"] < x["priority"]) & (F.floor(y["priority"] / 10) <= F.floor(x["priority"] / 10)) | (y["length"] > x["length"])
    left = F.filter(d, lambda x: ~F.exists(d, lambda y: inside(x, y) & better(x, y)))
    words = F.when(n == "", 0).otherwise(F.length(n) - F.length(F.replace(n, F.lit(" "), F.lit(""))) + 1).cast("long")
    return step.select(*docs.columns, F.struct(words.alias("n_words"), F.col(base).alias("base"), left.alias("found")).alias(name))


def report(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row."""
    rows = scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")))
    base, found = F.col("license.base"), F.col("license.found")
    labels = lambda *a: F.concat_ws(",", F.array_sort(F.array_distinct(F.concat(*a))))
    score = F.greatest(F.coalesce(F.array_max(found["score"]), F.lit(0.0)), F.when(F.size(base) > 0, 1.0).otherwise(0.0))
    return rows.select(
        "doc_id", F.col("license.n_words").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(base["word"]).alias("first_word"), F.array_max(base["word"]).alias("last_word"),
        labels(base["label"]).alias("base_labels"), labels(base["label"], found["label"]).alias("labels"), score.alias("score"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))

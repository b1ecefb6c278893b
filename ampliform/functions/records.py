"""Column functions over record names and FASTA headers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def specimen_of(name: Column) -> Column:
    """A record's specimen: its name without group, variant, merge and track marks."""
    return F.regexp_replace(name, r"-\d+(?:\.v\d+|-full)?(?:\.raw\.\d+\.v\d+)?(?:\.(?:ns|lq|chimera|filtered))?(?:-RiC\d+)?$", "")


def group_of(name: Column) -> Column:
    return F.regexp_extract(name, r"-(\d+)\.v\d+", 1)


def variant_of(name: Column) -> Column:
    return F.regexp_extract(name, r"\.(v\d+)", 1)


def field(header: Column, key: str) -> Column:
    """The value of key=value in a header; null if it isn't there."""
    return F.nullif(F.regexp_extract(header, rf"(?:^|\s){key}=(\S+)", 1), F.lit(""))


def share(value: Column, total: Column) -> Column:
    """value in percent of total; null if there is no total."""
    return 100.0 * value / F.nullif(total, F.lit(0))


def header(name: Column, size: Column, ric: Column, rid: Column, rid_min: Column, primers: Column, ambig: Column, cer: Column, err: Column, gid: Column, vid: Column) -> Column:
    """name and the fields that have a value, in a fixed order."""
    put = lambda key, text: F.when(text.isNotNull(), F.concat(F.lit(f"{key}="), text))
    return F.concat_ws(
        " ", name, put("size", size.cast("string")), put("ric", ric.cast("string")), put("rid", F.when(rid.isNotNull(), F.format_string("%.1f", 100 * rid))), put("rid_min", F.when(rid_min.isNotNull(), F.format_string("%.1f", 100 * rid_min))),
        put("primers", F.when(F.size(primers) > 0, F.array_join(primers, ","))), put("ambig", F.when(ambig > 0, ambig.cast("string"))),
        put("cer_factor", F.when(cer == float("inf"), "inf").when(cer.isNotNull(), F.format_string("%.3f", cer))), put("err_factor", F.when(err.isNotNull(), F.format_string("%.3f", err))),
        put("gid", gid.cast("string")), put("vid", vid.cast("string")),
    )


def parse(head: Column) -> Column:
    """A header as a struct of its fields: identities as shares, lists split, an absent field null (counts of reads 0)."""
    text = lambda key, what=r"\S+": F.nullif(F.regexp_extract(head, rf"(?:^|\s){key}=({what})", 1), F.lit(""))
    whole = lambda key: text(key, r"\d+").cast("int")
    number = lambda key: text(key, r"[\d.]+").cast("double")
    numbers = lambda key: F.split(text(key, r"\d+(?:\+\d+)*"), r"\+").cast("array<int>")
    cer = text("cer_factor", r"inf|[\d.]+")
    return F.struct(
        F.regexp_extract(head, r"^>?(\S+)", 1).alias("name"), F.coalesce(whole("size"), F.lit(0)).alias("size"), F.coalesce(whole("ric"), F.lit(0)).alias("ric"),
        (number("rid") / 100).alias("rid"), (number("rid_min") / 100).alias("rid_min"), F.split(text("primers"), ",").alias("primers"), numbers("rawric").alias("raw_ric"), numbers("rawlen").alias("raw_len"),
        whole("snp").alias("snp"), F.when(cer == "inf", F.lit(float("inf"))).otherwise(F.when(cer != "inf", cer).cast("double")).alias("cer_factor"),
        number("err_factor").alias("err_factor"), whole("gid").alias("gid"), whole("vid").alias("vid"), text("chimera").alias("chimera"), text("locus").alias("locus"), whole("length").alias("length"),
    )


def short_name(name: Column, track: Column) -> Column:
    """A record's group and variant, with its track if it didn't pass."""
    return F.concat(F.regexp_extract(name, r"-(\d+\.v\d+)", 1), F.when(track == "pass", "").otherwise(F.concat(F.lit("."), track)))


def metrics(size: Column, ric: Column, track: Column, cer: Column, err: Column) -> Column:
    """What a variant's line in a tree says of it."""
    two = lambda key, x: F.when(x.isNotNull(), F.concat(F.lit(f"{key}="), F.format_string("%.2f", x)))
    known = lambda key, x: F.concat(F.lit(f"{key}="), F.coalesce(x.cast("string"), F.lit("?")))
    return F.concat_ws("  ", known("size", size), known("ric", ric), track, two("cer", cer), two("err", err))


def more_fields(length: Column, snp: Column, locus: Column, chimera: Column) -> Column:
    """length, snp (if any), locus and chimera as header fields."""
    put = lambda key, x: F.when(x.isNotNull(), F.concat(F.lit(f"{key}="), x.cast("string")))
    return F.concat_ws(" ", put("length", length), put("snp", F.when(snp > 0, snp)), put("locus", locus), put("chimera", chimera))

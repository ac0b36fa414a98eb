"""License scan by ordered signature rules; DataFrame functions only, and no exchange: each document is scanned where it lies.

A text is A-Z lower-cased and turned into its words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with one space before each and one
at the end. Hundreds of hand-written signatures (``license_signatures``: grants, conditions, warranties, headers, exceptions,
SPDX identifiers) and those that a table of license families gives for titles and versions are regular expressions over
such words. Each has a keyword; texts without any keyword are never normalised, and of the others only
the signatures whose keyword occurs are tried. A signature has a priority (3: with a version or a license's own
sentence, 2: a title, 1: a hint); a detection whose words lie within those of one with the same or a higher priority is
suppressed, equal intervals by order of the rules. The labels of the base phrases stay even then.

Detections are found and resolved by folds that append to blocks of ``BLOCK`` entries, so a text with very many of them
takes time in proportion.

Defined results: null and empty texts have no words and no detections; repeated rows and null ids are scanned row by
row; other columns pass by.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .license_signatures import SIGNATURES, SPDX

BLOCK = 256
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

#: The base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: label; titles, split by |; short names, split by |; versions (words), split by |; keyword of the short names.
FAMILIES = (
    ("gpl", "gnu general public licen[sc]e|general public licen[sc]e", "gnu gpl|gpl", "1|1 0|2|2 0|3|3 0", "gpl"),
    ("lgpl", "gnu lesser general public licen[sc]e|gnu library general public licen[sc]e|lesser general public licen[sc]e", "gnu lgpl|lgpl", "2|2 0|2 1|3|3 0", "lgpl"),
    ("agpl", "gnu affero general public licen[sc]e|affero general public licen[sc]e", "gnu agpl|agpl", "1|1 0|3|3 0", "agpl"),
    ("gfdl", "gnu free documentation licen[sc]e", "gfdl", "1 1|1 2|1 3", "gfdl"),
    ("apache", "apache licen[sc]e|apache software licen[sc]e", "apache", "1|1 0|1 1|2|2 0", "apache"),
    ("mit", "mit licen[sc]e|expat licen[sc]e|mit expat licen[sc]e", "", "", ""),
    ("x11", "x11 licen[sc]e|mit x11 licen[sc]e", "", "", ""),
    ("bsd", "bsd licen[sc]e|berkeley software distribution licen[sc]e", "", "", ""),
    ("bsd-2-clause", "bsd 2 clause licen[sc]e|simplified bsd licen[sc]e|2 clause bsd licen[sc]e|freebsd licen[sc]e", "bsd 2 clause|2 clause bsd", "", "bsd"),
    ("bsd-3-clause", "bsd 3 clause licen[sc]e|new bsd licen[sc]e|modified bsd licen[sc]e|3 clause bsd licen[sc]e", "bsd 3 clause|3 clause bsd", "", "bsd"),
    ("bsd-4-clause", "bsd 4 clause licen[sc]e|original bsd licen[sc]e|4 clause bsd licen[sc]e", "bsd 4 clause|4 clause bsd", "", "bsd"),
    ("0bsd", "zero clause bsd licen[sc]e|bsd zero clause licen[sc]e", "0bsd", "", "0bsd"),
    ("isc", "isc licen[sc]e", "", "", ""),
    ("mpl", "mozilla public licen[sc]e", "mpl", "1 0|1 1|2|2 0", "mpl"),
    ("epl", "eclipse public licen[sc]e", "epl", "1 0|2|2 0", "epl"),
    ("edl", "eclipse distribution licen[sc]e", "edl", "1 0", "edl"),
    ("cddl", "common development and distribution licen[sc]e", "cddl", "1 0|1 1", "cddl"),
    ("cpl", "common public licen[sc]e", "cpl", "1 0", "cpl"),
    ("eupl", "european union public licen[sc]e", "eupl", "1 0|1 1|1 2", "eupl"),
    ("osl", "open software licen[sc]e", "osl", "1 0|2 0|2 1|3 0", "osl"),
    ("afl", "academic free licen[sc]e", "afl", "1 2|2 0|2 1|3 0", "afl"),
    ("artistic", "artistic licen[sc]e|perl artistic licen[sc]e", "artistic", "1 0|2 0", "artistic"),
    ("zlib", "zlib licen[sc]e|zlib libpng licen[sc]e", "", "", ""),
    ("boost", "boost software licen[sc]e", "bsl", "1 0", "bsl"),
    ("ofl", "sil open font licen[sc]e|open font licen[sc]e", "ofl", "1 0|1 1", "ofl"),
    ("psf", "python software foundation licen[sc]e|psf licen[sc]e", "psf", "2|2 0", "psf"),
    ("php", "php licen[sc]e", "", "3 0|3 01", ""),
    ("ruby", "ruby licen[sc]e", "", "", ""),
    ("postgresql", "postgresql licen[sc]e", "", "", ""),
    ("openssl", "openssl licen[sc]e", "", "", ""),
    ("ncsa", "university of illinois ncsa open source licen[sc]e|ncsa open source licen[sc]e", "", "", ""),
    ("ms-pl", "microsoft public licen[sc]e", "ms pl", "", "ms"),
    ("ms-rl", "microsoft reciprocal licen[sc]e", "ms rl", "", "ms"),
    ("cecill", "cecill licen[sc]e|cecill free software licen[sc]e", "cecill", "1 0|1 1|2 0|2 1", "cecill"),
    ("upl", "universal permissive licen[sc]e", "upl", "1 0", "upl"),
    ("zpl", "zope public licen[sc]e", "zpl", "2 0|2 1", "zpl"),
    ("w3c", "w3c software notice and licen[sc]e|w3c licen[sc]e", "", "", ""),
    ("sspl", "server side public licen[sc]e", "sspl", "1|1 0", "sspl"),
    ("busl", "business source licen[sc]e", "busl", "1 1", "busl"),
    ("elastic", "elastic licen[sc]e", "", "2|2 0", ""),
    ("odbl", "open database licen[sc]e|open data commons open database licen[sc]e", "odbl", "1 0", "odbl"),
    ("pddl", "open data commons public domain dedication and licen[sc]e", "pddl", "1 0", "pddl"),
    ("wtfpl", "do what the fuck you want to public licen[sc]e", "wtfpl", "2|2 0", "wtfpl"),
    ("cc0", "creative commons zero", "cc0", "1 0", "cc0"),
)
#: Creative Commons: suffix of the label, words of the short name, words of the title.
COMMONS = (
    ("", "by", "attribution"),
    ("-sa", "by sa", "attribution sharealike"),
    ("-nd", "by nd", "attribution noderivatives"),
    ("-nc", "by nc", "attribution noncommercial"),
    ("-nc-sa", "by nc sa", "attribution noncommercial sharealike"),
    ("-nc-nd", "by nc nd", "attribution noncommercial noderivatives"),
)
COMMONS_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: label, sentence of a license's own text (a pattern over words), keyword.
SENTENCES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", "permission"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd-3-clause", "neither the name of( the)?( \\S+){1,8} nor the names of its contributors", "contributors"),
    ("zlib", "this software is provided as is without any express or implied warranty", "warranty"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered"),
    ("gpl", "this program is free software you can redistribute it and or modify it", "redistribute"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy", "permission"),
    ("commons-clause", "commons clause licen[sc]e condition", "clause"),
)
#: The label of hints at a license that isn't named; it stands only where no other label is found.
UNKNOWN = "unknown"
#: label, hint, keyword.
HINTS = (
    ("proprietary", "all rights reserved", "reserved"),
    ("public-domain", "(released|placed|dedicated)( in)?to the public domain", "domain"),
    ("unlicense", "unlicense", "unlicense"),
    (UNKNOWN, "(licensed|released|distributed|available) under( the)?( terms of)?( the)?( \\S+){1,3} licen[sc]e", "under"),
    (UNKNOWN, "see( the)? licen[sc]e( file)?", "see"),
)


@dataclass(frozen=True)
class Rule:
    label: str
    keyword: str
    pattern: str
    priority: int


def rules() -> list[Rule]:
    """The base phrases, then all signatures, in order of their precedence."""
    out = [Rule(label, phrase.split(" ")[-1] if "license" in phrase else phrase.split(" ")[0], phrase, 2) for phrase, label in BASE]
    later = "( or( at your option)?( any)? later( version)?| only)?"
    for label, titles, shorts, versions, keyword in FAMILIES:
        names = [(t, "license" if "licen[sc]e" in t else t.split(" ")[0]) for t in filter(None, titles.split("|"))]
        for v in sorted(filter(None, versions.split("|")), key=lambda x: -len(x)):
            full = f"{label}-{v.replace(' ', '.')}"
            for t, k in names:
                out.append(Rule(full, k, f"{t}( version| v)? v?{v}{later}", 3))
            if shorts:
                out.append(Rule(full, keyword, f"({shorts})( version| v)? v?{v}{later}", 3))
        out += [Rule(label, k, t, 2) for t, k in names]
        if shorts and keyword != "apache" and keyword != "artistic" and not versions:
            out.append(Rule(label, keyword, f"({shorts})", 2))
        elif shorts and keyword not in ("apache", "artistic", "psf", "bsl"):
            out.append(Rule(label, keyword, f"({shorts})", 1))
    for suffix, short, title in reversed(COMMONS):
        for v in COMMONS_VERSIONS:
            out.append(Rule(f"cc-by{suffix}-{v.replace(' ', '.')}", "cc", f"cc {short} {v}", 3))
            out.append(Rule(f"cc-by{suffix}-{v.replace(' ', '.')}", "creative", f"creative commons {title}( licen[sc]e)?( version)? {v}( international| unported| generic)?", 3))
        out.append(Rule(f"cc-by{suffix}", "cc", f"cc {short}", 2))
        out.append(Rule(f"cc-by{suffix}", "creative", f"creative commons {title}( licen[sc]e)?", 2))
    out.append(Rule("cc0", "cc0", "cc0", 2))
    out += [Rule(label, keyword, text, 3) for label, text, keyword in SENTENCES]
    out += [Rule(label, keyword, pattern, priority) for label, keyword, priority, pattern, _ in SIGNATURES]
    out += [Rule(x.lower(), "spdx", f"spdx licen[sc]e identifier {re.sub('[^a-z0-9]+', ' ', x.lower())}", 3) for x in SPDX]
    out += [Rule(label, keyword, text, 1) for label, text, keyword in HINTS]
    return list(dict.fromkeys(out))


def keywords(signatures: list[Rule]) -> list[str]:
    """All keywords; ``license`` stands for both spellings."""
    words = {r.keyword for r in signatures}
    return sorted(words | {"licence"} if "license" in words else words)


def any_of(words: list[str]) -> str:
    """An expression for any of some words, by their common beginnings, so that a place is given up after a few letters."""
    tails: dict[str, list[str]] = {}
    for w in sorted(words):
        tails.setdefault(w[:1], []).append(w[1:])
    ends = [""] if tails.pop("", None) else []
    parts = [first + (any_of(rest) if len(rest) > 1 else rest[0]) for first, rest in tails.items()]
    # the longer ones first; what comes after decides
    return f"(?:{'|'.join(parts + ends)})" if len(parts) + len(ends) > 1 else (parts + ends)[0]


def normal(text: Column) -> Column:
    """`` w w ... w ``: a space before each word and one at the end; one space if there is none."""
    flat = F.regexp_replace(common.ascii_lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.concat(F.lit(" "), F.ltrim(flat), F.when(F.trim(flat) == "", F.lit("")).when(F.endswith(flat, F.lit(" ")), F.lit("")).otherwise(F.lit(" ")))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; inside a lambda a column is computed anew wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spaces(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit("")))


def folded(items: Column, state: Column, kind: str, step, emit) -> Column:
    """All ``emit(state, item)`` that aren't null, in order, while ``step`` carries the state on; appends to blocks. ``items`` is bound already."""
    empty = F.array().cast(f"array<{kind}>")

    def inner(acc, x):
        value = emit(acc["state"], x)
        return F.struct(step(acc["state"], x).alias("state"), F.concat(acc["out"], F.filter(F.array(value), lambda v: v.isNotNull())).alias("out"))

    def outer(acc, k):
        part = F.aggregate(F.slice(items, k * BLOCK + 1, BLOCK), F.struct(acc["state"].alias("state"), empty.alias("out")), inner)
        return let(part, lambda p: F.struct(p["state"].alias("state"), F.concat(acc["out"], F.array(p["out"])).alias("out")))

    blocks = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
    folded = F.aggregate(blocks, F.struct(state.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("out")), outer, lambda acc: F.flatten(acc["out"]))
    return F.when(F.size(items) > 0, folded).otherwise(empty)


DETECTION = "struct<s:int,ne:int,np:int,rule:int,label:string>"


def detections(norm: Column, signatures: list[Rule]) -> Column:
    """All detections, sorted: first word s, -(word after the last) ne, -priority np, number of the rule, label. ``norm`` is bound already."""
    occurring = F.regexp_extract_all(norm, F.lit(f" ({any_of(keywords(signatures))})(?= )"), F.lit(1))
    occurring = F.array_distinct(F.transform(occurring, lambda w: F.when(w == "licence", F.lit("license")).otherwise(w)))
    one = "named_struct('rule', {}, 'keyword', '{}', 'pattern', r' {}(?= )', 'np', {}, 'label', '{}')"
    table = F.expr(f"array({', '.join(one.format(i, r.keyword, r.pattern, -r.priority, r.label) for i, r in enumerate(signatures))})")
    none = F.array().cast(f"array<{DETECTION}>")

    def places(rule):
        def located(hits):  # the parts between hits are one more
            step = lambda at, x: at + spaces(x["before"]) + spaces(x["hit"])

            def emit(at, x):
                return let(at + spaces(x["before"]), lambda s: F.struct(s.alias("s"), (-(s + spaces(x["hit"]))).alias("ne"), rule["np"].alias("np"), rule["rule"].alias("rule"), rule["label"].alias("label")))

            pairs = F.arrays_zip(F.slice(F.split(norm, rule["pattern"], -1), F.lit(1), F.size(hits)).alias("before"), hits.alias("hit"))
            return F.when(F.size(hits) > 0, let(pairs, lambda p: folded(p, F.lit(0), DETECTION, step, emit))).otherwise(none)

        return let(F.regexp_extract_all(norm, rule["pattern"], F.lit(0)), located)

    tried = let(occurring, lambda words: F.filter(table, lambda r: F.array_contains(words, r["keyword"])))
    return F.array_sort(F.flatten(F.transform(tried, places)))


def resolved(found: Column) -> Column:
    """The detections that aren't within another of the same or a higher priority that comes before them in order."""
    level = lambda state, x: F.when(x["np"] == -3, state["e3"]).when(x["np"] == -2, state["e2"]).otherwise(state["e1"])

    def step(state, x):
        return F.struct(*[F.greatest(state[f"e{p}"], F.when(x["np"] <= -p, -x["ne"]).otherwise(-1)).alias(f"e{p}") for p in (1, 2, 3)])

    start = F.struct(*[F.lit(-1).alias(f"e{p}") for p in (1, 2, 3)])
    return folded(found, start, DETECTION, step, lambda state, x: F.when(level(state, x) < -x["ne"], x))


def scan(docs: DataFrame, signatures: list[Rule] | None = None) -> DataFrame:
    """docs with n_words, found (all detections) and kept (those not suppressed)."""
    signatures = rules() if signatures is None else signatures
    raw = F.coalesce(F.col("text"), F.lit(""))
    some = raw.rlike(f"(?i)(?<![0-9a-z]){any_of(keywords(signatures))}(?![0-9a-z])")
    none = F.array().cast(f"array<{DETECTION}>")
    both = lambda f: F.struct(f.alias("found"), F.when(F.size(f) > 0, resolved(f)).otherwise(none).alias("kept"))
    scanned = F.when(some, let(normal(raw), lambda norm: let(detections(norm, signatures), both))).otherwise(F.struct(none.alias("found"), none.alias("kept")))
    return docs.withColumn("n_words", F.regexp_count(raw, F.lit(WORD)).cast("long")).withColumn("_s", scanned).withColumn("found", F.col("_s.found")).withColumn("kept", F.col("_s.kept")).drop("_s")


def report(scanned: DataFrame) -> DataFrame:
    base = F.filter("found", lambda d: d["rule"] < len(BASE))
    names = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    labels = lambda x: F.transform(x, lambda d: d["label"])
    best = F.aggregate("kept", F.lit(0), lambda a, d: F.greatest(a, -d["np"]))
    out = scanned.withColumn("_base", base)
    return out.select(
        "doc_id",
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda d: d["s"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_base", lambda d: d["s"])).cast("long").alias("last_word"),
        names(labels(F.col("_base"))).alias("base_labels"),
        names(let(F.concat(labels(F.col("_base")), labels(F.col("kept"))), lambda x: F.when(F.size(F.array_remove(x, UNKNOWN)) > 0, F.array_remove(x, UNKNOWN)).otherwise(x))).alias("labels"),
        reduce(lambda c, x: c.when(best == x[0], F.lit(x[1])), ((2, 0.9), (1, 0.5)), F.when(best == 3, F.lit(1.0))).otherwise(F.lit(0.0)).alias("score"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(scan(common.table(spark, sf_dir, "documents").select("doc_id", "text")))

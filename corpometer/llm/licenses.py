"""License detection by ordered signature rules, in built-in functions only."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpometer.llm.common import ascii_lower, unused

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LEVELS = 4
CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.4}


@dataclass(frozen=True)
class Signature:
    """One rule. ``pattern`` is matched against words joined by single spaces and starts and ends at words;
    all ``keywords`` must be among a text's words before it is tried; level 1 is the strongest."""

    label: str
    pattern: str
    keywords: tuple[str, ...]
    level: int


#: Phrases that are counted wherever their words stand side by side, and their labels.
PHRASES = (
    ("cc by", "cc-by", "cc"),
    ("general public license", "gpl", "general"),
    ("all rights reserved", "reserved", "reserved"),
)

# Families of licenses: label, pattern of the name, keyword, versions.
NAMED = (
    ("gpl", "(?:the )?gnu general public licen[cs]e", "gnu", ("1", "2", "3")),
    ("lgpl", "(?:the )?gnu (?:lesser|library) general public licen[cs]e", "gnu", ("2", "2.1", "3")),
    ("agpl", "(?:the )?gnu affero general public licen[cs]e", "affero", ("1", "3")),
    ("gfdl", "(?:the )?gnu free documentation licen[cs]e", "gnu", ("1.1", "1.2", "1.3")),
    ("gpl", "gpl", "gpl", ("1", "2", "3")),
    ("lgpl", "lgpl", "lgpl", ("2", "2.1", "3")),
    ("agpl", "agpl", "agpl", ("1", "3")),
    ("gfdl", "gfdl", "gfdl", ("1.1", "1.2", "1.3")),
    ("apache", "(?:the )?apache(?: software)?(?: licen[cs]e)?", "apache", ("1.0", "1.1", "2", "2.0")),
    ("mpl", "(?:the )?mozilla public licen[cs]e", "mozilla", ("1.0", "1.1", "2.0")),
    ("mpl", "mpl", "mpl", ("1.0", "1.1", "2.0")),
    ("epl", "(?:the )?eclipse public licen[cs]e", "eclipse", ("1.0", "2.0")),
    ("epl", "epl", "epl", ("1.0", "2.0")),
    ("cddl", "common development and distribution licen[cs]e", "distribution", ("1.0", "1.1")),
    ("cddl", "cddl", "cddl", ("1.0", "1.1")),
    ("cpl", "common public licen[cs]e", "common", ("1.0",)),
    ("eupl", "european union public licen[cs]e", "european", ("1.0", "1.1", "1.2")),
    ("eupl", "eupl", "eupl", ("1.0", "1.1", "1.2")),
    ("artistic", "artistic licen[cs]e", "artistic", ("1.0", "2.0")),
    ("afl", "academic free licen[cs]e", "academic", ("1.1", "1.2", "2.0", "2.1", "3.0")),
    ("osl", "open software licen[cs]e", "open", ("1.0", "1.1", "2.0", "2.1", "3.0")),
    ("ofl", "(?:sil )?open font licen[cs]e", "font", ("1.0", "1.1")),
    ("bsl", "boost software licen[cs]e", "boost", ("1.0",)),
    ("php", "php licen[cs]e", "php", ("3.0", "3.01")),
    ("zpl", "zope public licen[cs]e", "zope", ("1.1", "2.0", "2.1")),
    ("cecill", "cecill(?: free software licen[cs]e agreement)?", "cecill", ("1.0", "1.1", "2.0", "2.1")),
    ("lppl", "latex project public licen[cs]e", "latex", ("1.0", "1.2", "1.3")),
    ("apsl", "apple public source licen[cs]e", "apple", ("1.0", "1.1", "1.2", "2.0")),
    ("nasa", "nasa open source agreement", "nasa", ("1.3",)),
    ("qpl", "q public licen[cs]e", "q", ("1.0",)),
    ("busl", "business source licen[cs]e", "business", ("1.0", "1.1")),
    ("sspl", "server side public licen[cs]e", "server", ("1",)),
    ("elastic", "elastic licen[cs]e", "elastic", ("1", "2", "2.0")),
    ("openrail", "(?:bigscience )?openrail(?: m)?(?: licen[cs]e)?", "openrail", ("1.0",)),
    ("openrail", "(?:(?:bigscience open|bigscience|open) rail(?: m)?(?: licen[cs]e)?|rail m(?: licen[cs]e)?|rail licen[cs]e)", "rail", ("1.0",)),
    ("odbl", "open database licen[cs]e", "database", ("1.0",)),
    ("odc-by", "open data commons attribution licen[cs]e", "commons", ("1.0",)),
    ("cdla-permissive", "community data licen[cs]e agreement permissive", "permissive", ("1.0", "2.0")),
    ("cdla-sharing", "community data licen[cs]e agreement sharing", "sharing", ("1.0",)),
)

# Creative Commons: label, words of the short name, pattern of the long name.
COMMONS = (
    ("cc-by", "by", "attribution"),
    ("cc-by-sa", "by sa", "attribution share ?alike"),
    ("cc-by-nd", "by nd", "attribution no ?deriv(?:atives|s)"),
    ("cc-by-nc", "by nc", "attribution non ?commercial"),
    ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:atives|s)"),
)
COMMONS_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

# Single signatures: label, pattern, keywords, level.
SINGLE = (
    ("mit", "(?:the )?mit licen[cs]e", ("mit",), 2),
    ("mit", "licen[cs]ed under (?:the )?mit", ("mit",), 2),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", ("hereby", "granted", "charge"), 1),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies", ("notice", "permission", "copies"), 2),
    ("x11", "x11 licen[cs]e", ("x11",), 2),
    ("bsd", "bsd licen[cs]e", ("bsd",), 3),
    ("bsd", "bsd style licen[cs]e", ("bsd", "style"), 3),
    ("bsd-2-clause", "(?:simplified|2 clause|two clause) bsd(?: licen[cs]e)?", ("bsd",), 2),
    ("bsd-2-clause", "bsd 2 clause(?: licen[cs]e)?", ("bsd", "clause"), 2),
    ("bsd-3-clause", "(?:new|revised|modified|3 clause|three clause) bsd(?: licen[cs]e)?", ("bsd",), 2),
    ("bsd-3-clause", "bsd 3 clause(?: licen[cs]e)?", ("bsd", "clause"), 2),
    ("bsd-4-clause", "(?:original|4 clause|four clause) bsd(?: licen[cs]e)?", ("bsd",), 2),
    ("bsd-4-clause", "bsd 4 clause(?: licen[cs]e)?", ("bsd", "clause"), 2),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution", "binary", "permitted"), 1),
    ("bsd-3-clause", "neither the name of (?:\\S+ ){1,12}nor the names of its contributors", ("neither", "contributors"), 2),
    ("isc", "isc licen[cs]e", ("isc",), 2),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ("permission", "distribute", "purpose"), 1),
    ("zlib", "zlib(?: libpng)? licen[cs]e", ("zlib",), 2),
    ("zlib", "this software is provided as is without any express or implied warranty", ("warranty", "implied"), 4),
    ("libpng", "libpng licen[cs]e", ("libpng",), 2),
    ("ncsa", "university of illinois ncsa open source licen[cs]e", ("ncsa",), 2),
    ("unlicense", "(?:the )?unlicense", ("unlicense",), 2),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("unencumbered",), 1),
    ("wtfpl", "do what the fuck you want to public licen[cs]e", ("fuck",), 2),
    ("wtfpl", "wtfpl", ("wtfpl",), 2),
    ("public-domain", "(?:released |placed |dedicated )?(?:in |into |to )?the public domain", ("public", "domain"), 3),
    ("postgresql", "postgresql licen[cs]e", ("postgresql",), 2),
    ("python", "python software foundation licen[cs]e", ("python",), 2),
    ("psf", "psf licen[cs]e", ("psf",), 2),
    ("ruby", "ruby licen[cs]e", ("ruby",), 2),
    ("vim", "vim licen[cs]e", ("vim",), 2),
    ("openssl", "openssl licen[cs]e", ("openssl",), 2),
    ("curl", "curl licen[cs]e", ("curl",), 2),
    ("w3c", "w3c software (?:notice and )?licen[cs]e", ("w3c",), 2),
    ("unicode", "unicode licen[cs]e agreement", ("unicode",), 2),
    ("ms-pl", "microsoft public licen[cs]e", ("microsoft",), 2),
    ("ms-rl", "microsoft reciprocal licen[cs]e", ("microsoft",), 2),
    ("beerware", "beerware licen[cs]e", ("beerware",), 2),
    ("beerware", "beer ware licen[cs]e", ("beer", "ware"), 2),
    ("json", "the software shall be used for good not evil", ("evil",), 1),
    ("apache", "licen[cs]ed under the apache licen[cs]e", ("apache",), 3),
    ("apache", "licen[cs]ed to the apache software foundation asf", ("apache",), 2),
    ("gpl", "this program is free software you can redistribute it and or modify it", ("redistribute", "modify"), 2),
    ("gpl", "under the terms of the gnu general public licen[cs]e", ("gnu", "terms"), 3),
    ("lgpl", "under the terms of the gnu lesser general public licen[cs]e", ("gnu", "lesser"), 3),
    ("mpl", "subject to the terms of the mozilla public licen[cs]e", ("mozilla",), 3),
    ("cc0", "cc0(?: 1 0)?(?: universal)?", ("cc0",), 2),
    ("cc0", "creative commons zero", ("creative", "zero"), 2),
    ("cc", "creative commons(?: licen[cs]e)?", ("creative",), 4),
    ("pddl", "public domain dedication and licen[cs]e", ("dedication",), 2),
    ("reserved", "all rights reserved", ("reserved",), 3),
    ("reserved", "tous droits r[eé]serv[eé]s", ("droits",), 3),
    ("reserved", "alle rechte vorbehalten", ("vorbehalten",), 3),
    ("reserved", "todos los derechos reservados", ("reservados",), 3),
    ("copyright", "copyright(?: c)? (?:19|20)\\d\\d", ("copyright",), 3),
    ("copyright", "c copyright (?:19|20)\\d\\d", ("copyright",), 3),
    ("copyright", "copyright (?:by|c|holder|notice|owner)", ("copyright",), 4),
    ("proprietary", "proprietary and confidential", ("proprietary",), 2),
    ("proprietary", "unauthori[sz]ed copying of this file", ("copying",), 2),
    ("no-warranty", "without warranty of any kind", ("warranty", "kind"), 4),
    ("no-warranty", "without warranties or conditions of any kind", ("warranties", "conditions"), 4),
    ("terms-of-use", "terms of (?:use|service)", ("terms",), 4),
    ("license-mention", "licensed under", ("licensed",), 4),
    ("license-mention", "licenced under", ("licenced",), 4),
    ("license-mention", "released under", ("released",), 4),
    ("license-mention", "see (?:the )?license", ("license",), 4),
    ("license-mention", "see (?:the )?licence", ("licence",), 4),
)


#: Identifiers of licenses without a family, as words: label and what stands behind the tag.
IDENTIFIERS = (
    ("mit", "mit"), ("mit", "mit 0"), ("isc", "isc"), ("bsd-2-clause", "bsd 2 clause"), ("bsd-3-clause", "bsd 3 clause"),
    ("bsd-4-clause", "bsd 4 clause"), ("0bsd", "0bsd"), ("zlib", "zlib"), ("unlicense", "unlicense"), ("wtfpl", "wtfpl"),
    ("cc0", "cc0 1 0"), ("bsl-1.0", "bsl 1 0"), ("postgresql", "postgresql"), ("x11", "x11"), ("ncsa", "ncsa"), ("beerware", "beerware"),
    ("curl", "curl"), ("openssl", "openssl"), ("python", "psf 2 0"), ("proprietary", "licenseref proprietary"),
)
#: Confidence of a fixed phrase by itself.
PHRASE_CONFIDENCE = 0.7
ADDED = ("n_words", "base", "detections", "score")


def _number(version: str) -> str:
    return version.replace(".", " ")


LATER = "(?: only)? or (?:at your option )?(?:any )?later(?: version)?"


def _versioned(label: str, name: str, word: str, version: str, has_point: bool) -> list[Signature]:
    """Rules for one version of a family: "name version 2", "version 2 of name", "name v2", "namev2", "name2", each
    with "or later" behind, and the identifier. A whole version may have a point and zero behind it, unless that is
    a version of its own."""
    n, own = _number(version), f"{label}-{version}"
    first = n.split(" ")[0]
    number = n if " " in n else n + ("" if has_point else "(?: 0)?") + "(?! \\d)"
    forms = [
        (f"{name} (?:version |v )?{number}", (word, first)),
        (f"version {number} of {name}", (word, first)),
        (f"{name} (?:version )?v{number}", (word, "v" + first)),
        (f"v{number} of {name}", (word, "v" + first)),
    ]
    if name.isalpha():
        forms += [(f"{name}v{number}", (f"{name}v{first}",)), (f"{name}{number}", (f"{name}{first}",))]
    out = [Signature(own, pattern + "(?: only)?", keys, 2) for pattern, keys in forms]
    out += [Signature(f"{own}-or-later", pattern + LATER, (*keys, "later"), 1) for pattern, keys in forms]
    spdx = f"spdx licen[cs]e identifier {label.replace('-', ' ')} {number}"
    out.append(Signature(f"{own}-or-later", spdx + " or later", (label.split("-")[0], "spdx", "later"), 1))
    out.append(Signature(own, spdx + "(?: only)?", (label.split("-")[0], "spdx"), 1))
    return out


def signatures() -> tuple[Signature, ...]:
    """All rules in order: the families spelled out by version and form, Creative Commons, single ones."""
    out: list[Signature] = []
    for label, name, word, versions in NAMED:
        for v in versions:
            out += _versioned(label, name, word, v, f"{v}.0" in versions)
        out.append(Signature(label, name, (word,), 3))
    for label, short, long in COMMONS:
        for v in COMMONS_VERSIONS:
            n = _number(v)
            first = n.split(" ")[0]
            out += [
                Signature(f"{label}-{v}", f"cc {short} {n}", ("cc", first), 1),
                Signature(f"{label}-{v}", f"creative commons {long} {n}", ("creative", first), 1),
            ]
        out += [
            Signature(label, f"cc {short}", ("cc",), 2),
            Signature(label, f"creative commons {long}", ("creative",), 2),
            Signature(label, f"creativecommons org licenses {short}", ("creativecommons",), 1),
        ]
    out += [Signature(label, pattern, keys, level) for label, pattern, keys, level in SINGLE]
    for label, name in IDENTIFIERS:
        out.append(Signature(label, f"spdx licen[cs]e identifier {name}", ("spdx", name.split(" ")[0]), 1))
    return tuple(dict.fromkeys(out))


def words_of(text: Column) -> Column:
    """Words in order: runs of letters, digits and characters beyond ASCII, A-Z lower-cased; null is empty."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def places(line: Column, pattern: Column) -> Column:
    """Places of a pattern in a line of words as (first, last), words from 0; ``line`` has a space at both ends."""
    whole = F.concat(F.lit("(?<= )(?:"), pattern, F.lit(")(?= )"))
    found = F.regexp_extract_all(line, whole, F.lit(0))
    between = F.split(line, whole, -1)
    start = F.struct(F.lit(-1).alias("at"), F.array().cast("array<struct<first:int,last:int>>").alias("out"))

    def step(state: Column, pair: Column) -> Column:
        first = state["at"] + _spaces(pair["gap"])
        last = first + _spaces(pair["hit"])
        return F.struct(last.alias("at"), F.concat(state["out"], F.array(F.struct(first.alias("first"), last.alias("last")))).alias("out"))

    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("hit"))
    return F.when(F.size(found) == 0, F.array().cast("array<struct<first:int,last:int>>")).otherwise(
        F.aggregate(pairs, start, step, lambda s: s["out"])
    )


def _named(spans: Column, label: str) -> Column:
    return F.transform(spans, lambda p: F.struct(F.lit(label).alias("label"), p["first"].alias("first"), p["last"].alias("last")))


def _table(rules: tuple[Signature, ...]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("rule"), F.lit(r.label).alias("label"), F.lit(r.level).alias("level"), F.lit(r.pattern).alias("pattern"),
                F.array(*[F.lit(k) for k in r.keywords]).alias("keywords"),
            )
            for i, r in enumerate(rules)
        ]
    )


def _surviving(found: Column) -> Column:
    """Detections that none of the same or a stronger level contains.

    In order of first word, longer ones first, a detection is contained if one before it, of its level
    or a stronger one, ends where it ends or later; so one pass keeps the furthest end of each level.
    """
    order = F.array_sort(
        F.transform(found, lambda d: F.struct(d["first"], (-d["last"]).alias("minus"), d["level"], d["rule"], d["label"], d["last"]))
    )
    ends = [F.lit(-1).alias(f"e{k}") for k in range(1, LEVELS + 1)]
    kept = F.array().cast("array<struct<rule:int,label:string,level:int,first:int,last:int>>").alias("kept")

    def step(state: Column, d: Column) -> Column:
        reach = F.greatest(*[F.when(d["level"] >= k, state[f"e{k}"]).otherwise(-1) for k in range(1, LEVELS + 1)])
        own = F.struct(d["rule"].alias("rule"), d["label"].alias("label"), d["level"].alias("level"), d["first"].alias("first"), d["last"].alias("last"))
        new = [F.when(d["level"] == k, F.greatest(state[f"e{k}"], d["last"])).otherwise(state[f"e{k}"]).alias(f"e{k}") for k in range(1, LEVELS + 1)]
        return F.struct(*new, F.when(reach >= d["last"], state["kept"]).otherwise(F.concat(state["kept"], F.array(own))).alias("kept"))

    return F.aggregate(order, F.struct(*ends, kept), step, lambda s: s["kept"])


def scanned(docs: DataFrame, text: str = "text", rules: tuple[Signature, ...] | None = None) -> DataFrame:
    """``docs`` without its text, with what was found in it.

    Added columns: ``n_words``; ``base``, the places of the fixed phrases (label, first, last);
    ``detections``, what is left of the rules' matches (rule, label, level, first, last); ``score``, the
    confidence of the strongest of both, 0 without any. Columns of these names are replaced, all others
    passed on. All are worked out in the row, whole texts of any length
    are read, and nothing is moved: a text is split into words once, texts without a keyword of any rule
    or phrase go no further, and of the others only rules whose keywords are all there are tried. A
    detection inside another of its level or a stronger one is dropped. Null and empty texts have no words.
    """
    rules = signatures() if rules is None else rules
    keywords = sorted(set(chain((p[2] for p in PHRASES), *(r.keywords for r in rules))))
    own = [c for c in docs.columns if c != text and c.lower() not in ADDED]
    kept = names = [F.col(f"`{c}`") for c in own]
    words, keys, line, raw = (unused(n, own) for n in ("__words", "__keys", "__line", "__found"))
    empty_spans = F.array().cast("array<struct<label:string,first:int,last:int>>")
    empty = F.array().cast("array<struct<rule:int,label:string,level:int,first:int,last:int>>")
    split = docs.select(*kept, words_of(F.col(text)).alias(words))
    gated = split.select(
        *names,
        F.size(words).cast("long").alias("n_words"),
        F.array_intersect(F.array(*[F.lit(k) for k in keywords]), F.col(words)).alias(keys),
        words,
    )
    lined = gated.select(
        *names, "n_words", keys,
        F.when(F.size(keys) > 0, F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))).alias(line),
    )
    base = F.flatten(F.array(*[_named(places(F.col(line), F.lit(phrase)), label) for phrase, label, _ in PHRASES]))
    fit = F.filter(_table(rules), lambda r: F.forall(r["keywords"], lambda k: F.array_contains(F.col(keys), k)))
    found = F.flatten(
        F.transform(
            fit,
            lambda r: F.transform(
                places(F.col(line), r["pattern"]),
                lambda p: F.struct(r["rule"].alias("rule"), r["label"].alias("label"), r["level"].alias("level"), p["first"].alias("first"), p["last"].alias("last")),
            ),
        )
    )
    hit = F.col(line).isNotNull()
    matched = lined.select(
        *names, "n_words",
        F.when(hit, base).otherwise(empty_spans).alias("base"),
        F.when(hit, found).otherwise(empty).alias(raw),
    )
    final = matched.select(
        *names, "n_words", "base",
        F.when(F.size(raw) > 0, _surviving(F.col(raw))).otherwise(empty).alias("detections"),
    )
    level = F.array_min(F.transform("detections", lambda d: d["level"]))
    score = F.lit(0.0)
    for k, value in CONFIDENCE.items():
        score = F.when(level == k, value).otherwise(score)
    phrase = F.when(F.size("base") > 0, PHRASE_CONFIDENCE).otherwise(0.0)
    return final.withColumn("score", F.greatest(score, phrase))

"""License detection by ordered signature rules, in DataFrame and SQL functions only.

Texts are brought to a string of words, each with its own space on either side, so
that case, punctuation and line breaks don't matter and rules, written as plain word
patterns, match whole words. A rule is tried only on texts that hold a word which one of
its alternatives can't do without (`needed`), and most texts are passed over because they
hold none. Detections overlap
(a full notice holds a name, a name holds a shorter one), so they are put in order of
place and one that lies within another of the same or a better rank is dropped.
Everything happens inside a text's row; nothing is shuffled.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
ANY_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"  # of a text whose capitals are still there


@dataclass(frozen=True)
class Rule:
    """pattern: words by single spaces; (a|b) for choices of words, a trailing ? for optional ones, * for any word.

    rank: 0 base phrase (always kept), 1 full notice, 2 identifier, 3 grant that names a license, 4 bare name.
    """

    label: str
    rank: int
    keyword: str
    pattern: str


#: Base phrases.
BASE = [("mit", "license", "under the mit license"), ("apache-2", "license", "apache license version 2"), ("cc-by-nc", "cc", "cc by nc")]

#: Full notices: label, keyword, telling words.
NOTICES = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "software", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", "permission", "permission is hereby granted free of charge to any person obtaining a copy of this software * * * * * * * * * * * * * without restriction including"),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "permission", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3-clause", "endorse", "neither the name of * (\\w+ )?(\\w+ )?(\\w+ )?(\\w+ )?nor the names of (its|their|any) contributors may be used to endorse or promote products"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("bsd-2-clause", "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer"),
    ("apache-2", "compliance", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", "apache", "licensed under the apache license version 2 0"),
    ("gpl-2", "gnu", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3", "gnu", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1", "gnu", "gnu lesser general public license as published by the free software foundation either version 2 1 of the license"),
    ("lgpl-3", "gnu", "gnu lesser general public license as published by the free software foundation either version 3 of the license"),
    ("agpl-3", "gnu", "gnu affero general public license as published by the free software foundation either version 3 of the license"),
    ("gfdl", "gnu", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl-2", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license (v )?2 0"),
    ("epl-1", "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("unlicense", "domain", "this is free and unencumbered software released into the public domain"),
    ("zlib", "warranty", "this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("bsl-1", "boost", "distributed under the boost software license version 1 0"),
    ("wtfpl", "fuck", "do what the fuck you want to public license"),
    ("cc0-1", "waived", "has waived all copyright and related or neighboring rights"),
    ("ofl-1.1", "font", "this font software is licensed under the sil open font license version 1 1"),
    ("ms-pl", "software", "if you use the software you accept this license if you do not accept the license do not use the software"),
    ("proprietary", "reserved", "all rights reserved unauthorized (copying|reproduction|use)"),
    ("proprietary", "confidential", "proprietary and confidential"),
]

#: Licenses by name: label, keyword, names in the text, identifiers.
NAMES = [
    ("mit", "mit", "mit license|the mit licence|mit licence|x11 license|expat license", "mit"),
    ("apache-2", "apache", "apache license (version |v )?2( 0)?|apache licence (version |v )?2( 0)?|apache software license (version |v )?2( 0)?", "apache 2 0"),
    ("apache-1.1", "apache", "apache (software )?license (version |v )?1 1", "apache 1 1"),
    ("apache", "apache", "apache license|apache licence|apache software license", "apache"),
    ("gpl-2", "gpl|general", "(gnu )?gpl (version |v )?2( 0)?|gplv2|gnu general public license (version |v )?2( 0)?", "gpl 2 0( only| or later)?"),
    ("gpl-3", "gpl|general", "(gnu )?gpl (version |v )?3( 0)?|gplv3|gnu general public license (version |v )?3( 0)?", "gpl 3 0( only| or later)?"),
    ("gpl", "gpl|general", "gnu general public license|gnu gpl|gnu public license|general public license", "gpl"),
    ("lgpl-2.1", "lgpl|lesser", "(gnu )?lgpl (version |v )?2 1|gnu lesser general public license (version |v )?2 1", "lgpl 2 1( only| or later)?"),
    ("lgpl-3", "lgpl|lesser", "(gnu )?lgpl (version |v )?3( 0)?|lgplv3|gnu lesser general public license (version |v )?3( 0)?", "lgpl 3 0( only| or later)?"),
    ("lgpl", "lgpl|lesser|library", "gnu lesser general public license|gnu library general public license|gnu lgpl", "lgpl"),
    ("agpl-3", "agpl|affero", "(gnu )?agpl (version |v )?3( 0)?|agplv3|gnu affero general public license (version |v )?3( 0)?", "agpl 3 0( only| or later)?"),
    ("agpl", "agpl|affero", "gnu affero general public license|affero general public license|gnu agpl", "agpl"),
    ("gfdl", "documentation|gfdl", "gnu free documentation license|free documentation license", "gfdl( 1 [123])?"),
    ("mpl-2", "mozilla", "mozilla public license (version |v )?2( 0)?", "mpl 2 0"),
    ("mpl-1.1", "mozilla", "mozilla public license (version |v )?1 1", "mpl 1 1"),
    ("mpl", "mozilla", "mozilla public license", "mpl"),
    ("epl-2", "eclipse", "eclipse public license (version |v )?2( 0)?", "epl 2 0"),
    ("epl-1", "eclipse", "eclipse public license (version |v )?1( 0)?", "epl 1 0"),
    ("epl", "eclipse", "eclipse public license", "epl"),
    ("bsd-2-clause", "bsd", "bsd 2 clause( license)?|2 clause bsd( license)?|simplified bsd( license)?|freebsd license", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "bsd 3 clause( license)?|3 clause bsd( license)?|new bsd( license)?|modified bsd( license)?|revised bsd( license)?", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "bsd 4 clause( license)?|4 clause bsd( license)?|original bsd( license)?", "bsd 4 clause"),
    ("0bsd", "bsd|0bsd", "zero clause bsd( license)?|bsd zero clause( license)?", "0bsd"),
    ("bsd", "bsd", "bsd license|bsd style license|berkeley software distribution license", "bsd"),
    ("isc", "isc", "isc license|isc licence|internet systems consortium license", "isc"),
    ("zlib", "zlib", "zlib license|zlib libpng license|zlib licence", "zlib"),
    ("bsl-1", "boost", "boost software license( version)?( 1 0)?|boost license", "bsl 1 0"),
    ("busl-1.1", "business", "business source license( version)?( 1 1)?", "busl 1 1"),
    ("unlicense", "unlicense", "the unlicense|unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl( version 2)?", "wtfpl"),
    ("artistic-2", "artistic", "artistic license (version |v )?2( 0)?", "artistic 2 0"),
    ("artistic-1", "artistic", "artistic license( version 1 0)?|perl artistic license", "artistic 1 0"),
    ("cddl-1", "cddl|distribution", "common development and distribution license( version 1 0)?|cddl( version)?( 1 0)?", "cddl 1 0"),
    ("cpl-1", "common", "common public license( version 1 0)?", "cpl 1 0"),
    ("ms-pl", "microsoft", "microsoft public license", "ms pl"),
    ("ms-rl", "microsoft", "microsoft reciprocal license", "ms rl"),
    ("eupl-1.2", "eupl|european", "european union public licen(c|s)e( version| v)?( 1 2)?|eupl( version| v)?( 1 2)?", "eupl 1 2"),
    ("osl-3", "open", "open software license( version| v)?( 3 0)?", "osl 3 0"),
    ("afl-3", "academic", "academic free license( version| v)?( 3 0)?", "afl 3 0"),
    ("ecl-2", "educational", "educational community license( version 2 0)?", "ecl 2 0"),
    ("ofl-1.1", "font|ofl", "sil open font license( version)?( 1 1)?|open font license", "ofl 1 1"),
    ("psf-2", "python", "python software foundation license( version 2)?|psf license|python license", "psf 2 0|python 2 0"),
    ("php-3", "php", "php license( version 3 0)?( 3 01)?", "php 3 01?"),
    ("ruby", "ruby", "ruby license", "ruby"),
    ("vim", "vim", "vim license", "vim"),
    ("openssl", "openssl", "openssl license|ssleay license", "openssl"),
    ("postgresql", "postgresql", "postgresql license|postgresql licence", "postgresql"),
    ("ncsa", "ncsa|illinois", "university of illinois ncsa open source license|ncsa license", "ncsa"),
    ("upl-1", "universal", "universal permissive license( version 1 0)?", "upl 1 0"),
    ("sspl-1", "server", "server side public license( version 1)?", "sspl 1 0"),
    ("elastic-2", "elastic", "elastic license( version)?( 2 0)?", "elastic 2 0"),
    ("blueoak-1", "blue", "blue oak model license( 1 0 0)?", "blueoak 1 0 0"),
    ("mulan-2", "mulan", "mulan permissive software license( v2)?", "mulanpsl 2 0"),
    ("cecill-2.1", "cecill", "cecill( license)?( 2 1)?|cecill b|cecill c", "cecill 2 1"),
    ("odbl-1", "database|odbl", "open (data commons )?open database license|open database license|odbl( 1 0)?", "odbl 1 0"),
    ("odc-by-1", "commons", "open data commons attribution license", "odc by 1 0"),
    ("pddl-1", "domain", "public domain dedication and license|open data commons public domain", "pddl 1 0"),
    ("cdla-permissive", "data", "community data license agreement( permissive)?", "cdla permissive( 1 0| 2 0)?"),
    ("openrail-m", "rail|openrail", "openrail m license|responsible ai license|bigscience rail license", "openrail"),
    ("llama", "llama", "llama (2 |3 |3 1 )?community license( agreement)?", "llama2|llama3"),
    ("cc0-1", "cc0|zero", "cc0( 1 0)?( universal)?|creative commons zero( 1 0)?", "cc0 1 0"),
    ("cc-by-nc-nd", "cc|creative", "cc by nc nd( [1234] 0)?|creative commons attribution non ?commercial no ?deriv(ative)?s?( works)?", "cc by nc nd [1234] 0"),
    ("cc-by-nc-sa", "cc|creative", "cc by nc sa( [1234] 0)?|creative commons attribution non ?commercial share ?alike", "cc by nc sa [1234] 0"),
    ("cc-by-nc", "cc|creative", "cc by nc( [1234] 0)?|creative commons attribution non ?commercial", "cc by nc [1234] 0"),
    ("cc-by-nd", "cc|creative", "cc by nd( [1234] 0)?|creative commons attribution no ?deriv(ative)?s?( works)?", "cc by nd [1234] 0"),
    ("cc-by-sa", "cc|creative", "cc by sa( [1234] 0)?|creative commons attribution share ?alike", "cc by sa [1234] 0"),
    ("cc-by", "cc|creative", "cc by( [1234] 0)?|creative commons attribution", "cc by [1234] 0"),
    ("cc", "creative", "creative commons", "cc"),
    ("public-domain", "domain", "public domain", "public domain"),
    ("proprietary", "rights", "all rights reserved", "proprietary"),
]

#: How a text grants the license it names.
GRANTS = [
    "(licensed|released|distributed|published|provided|available|covered|shared|redistributed) under (the )?(terms (and conditions )?of )?(the )?(a )?{}",
    "(license|licence) {}",
    "(subject to|according to|pursuant to|governed by) (the )?(terms (and conditions )?of )?(the )?{}",
]


def compile_pattern(pattern: str) -> str:
    """A word pattern as a regular expression over the string of words (valid for Java and RE2 alike).

    A word and its two spaces become " word "; groups keep their marks.
    """
    out, at = [], 0
    for m in re.finditer(r"\(|\)\??|\||\S+", re.sub(r"([()|])", r" \1 ", pattern).replace(") ?", ")?")):
        token = m[0]
        if token == "(":
            out.append("(?:")
        elif token[0] == ")" or token == "|":
            out.append(token)
        elif token == "*":
            out.append(" [^ ]+ ")
        elif token in ("?", "?commercial"):
            out.append(token)
        else:
            out.append(f" {token} ")
        at = m.end()
    return "".join(out)


def rules() -> list[Rule]:
    """All rules, in order: base phrases, notices, identifiers, grants, bare names. Some 400."""
    out = [Rule(label, 0, key, p) for label, key, p in BASE]
    out += [Rule(label, 1, key, p.replace("(\\w+ )?", "(*)?")) for label, key, p in NOTICES]
    for rank, name in ((2, "spdx"), (3, "grant"), (4, "name")):
        for label, keys, names, ids in NAMES:
            for key in keys.split("|"):
                if name == "spdx":
                    out.append(Rule(label, rank, "spdx", f"spdx license identifier ({_spaced(ids)})"))
                    break
                named = f"({_spaced(names)})"
                out += [Rule(label, rank, key, g.format(named)) for g in GRANTS] if name == "grant" else [Rule(label, rank, key, _spaced(names))]
    return out


#: Words that tell little: they are looked for only where an alternative has no others.
PLAIN = set("license licence public the a free software open source general version v and or of to under with for use this is in any terms style new".split())


def needed(pattern: str, prefer: frozenset[str] = frozenset()) -> frozenset[str]:
    """Words of which every match of the pattern holds one: of each alternative one it can't do without."""
    tokens = re.findall(r"\)\?|[()|]|[^\s()|]+", pattern)

    def cost(words: frozenset[str]) -> tuple:
        each = [0 if w in prefer else 1 if w not in PLAIN and len(w) > 2 and not w.isdigit() else 2 for w in words]
        return max(each), len(words), -min(map(len, words)), sorted(words)

    def choices(at: int) -> tuple[frozenset[str] | None, int]:
        """The words for the choices from a place up to their closing mark, or None if one of them can do without any."""
        of: list[frozenset[str] | None] = []
        sure: list[frozenset[str]] = []
        while True:
            token = tokens[at] if at < len(tokens) else ")"
            if token in ("|", ")", ")?"):
                of.append(min(sure, key=cost) if sure else None)
                if token != "|":
                    return (None if None in of else frozenset().union(*of)), at
                sure = []
            elif token == "(":
                inner, at = choices(at + 1)
                if inner and tokens[at] == ")":
                    sure.append(inner)
            elif re.fullmatch(r"[a-z0-9]+", token):  # neither any word nor a class of digits
                sure.append(frozenset([token]))
            at += 1

    found, _ = choices(0)
    if not found:
        raise ValueError(f"a match of {pattern} can do without any word")
    return found


def _spaced(names: str) -> str:
    """Write word parts such as "non ?commercial" and "licen(c|s)e" as choices of whole words."""
    for part, whole in (("non ?commercial", "(noncommercial|non commercial)"), ("no ?deriv(ative)?s?( works)?", "(noderivs|no derivs|noderivatives|no derivatives|noderivative|no derivative)( works)?"), ("share ?alike", "(sharealike|share alike)"), ("licen(c|s)e", "(license|licence)"), ("3 01?", "3 (0|01)")):
        names = names.replace(part, whole)
    return names


#: Score of a detection by its rank.
CONFIDENCE = (1.0, 1.0, 0.95, 0.8, 0.5)
#: A text that holds none of these (nor "cc by") can match no rule and is passed over; tests hold every rule to it.
GATE = (
    "licen", "permission", "redistribut", "domain", "gpl", "creative", "reserved", "confidential", "waived", "wtfpl",
    "bsd", "cddl", "cecill", "odbl", "cc0", "eupl", "spdx", "warranty", "endorse", "acknowledgement",
)


def words_of(text: Column) -> Column:
    """" word " for each word of the text in order, capitals A-Z made small; "" if there is none."""
    kept = F.regexp_replace(text, f"{GAP}*({ANY_WORD}+){GAP}*", " $1 ")
    small = F.translate(kept, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(text.rlike(ANY_WORD), small).otherwise(F.lit(""))


#: Words that no text has: they stand before and behind a match.
OPEN, CLOSE = "\x01", "\x02"


def _found(words: Column, rule: Column) -> Column:
    """All places where the rule's pattern stands: first word and the word behind the last.

    Matches are marked in the string of words, which is then cut into words: a mark's number less
    the marks before it is the word's. So the work is that of reading the text, however many matches it has.
    """
    marked = F.regexp_replace(words, rule["pattern"], F.lit(f" {OPEN} $0 {CLOSE} "))
    numbered = F.transform(F.filter(F.split(marked, " +"), lambda w: w != ""), lambda w, i: F.struct(w.alias("w"), i.alias("i")))

    def places(mark: str, before: int) -> Column:
        return F.transform(F.filter(numbered, lambda x: x["w"] == mark), lambda x, k: x["i"] - 2 * k - before)

    pairs = F.arrays_zip(places(OPEN, 0).alias("s"), places(CLOSE, 1).alias("e"))
    return F.transform(pairs, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), rule["rank"].alias("rank"), rule["label"].alias("label")))


HITS = "array<struct<s:int,e:int,rank:int,label:string>>"
#: Detections that are looked at in one go: what is built up step by step stays short.
STRIDE = 256


def _standing(ordered: Column) -> Column:
    """For each detection, in order of place, "1" if it stays and "0" if it is suppressed.

    The furthest end of each rank so far is all that is carried from one detection to the next.
    """
    far = F.array(*[F.lit(-1)] * len(CONFIDENCE))

    def step(a: Column, x: Column) -> Column:
        e = -x["minus"]
        within = F.exists(F.slice(a["far"], 1, x["rank"] + 1), lambda f: f >= e)
        stays = (x["rank"] == 0) | ~within
        new = F.transform(a["far"], lambda f, i: F.when((i == x["rank"]) & (f < e) & stays, e).otherwise(f))
        return F.struct(new.alias("far"), F.concat(a["flags"], F.when(stays, "1").otherwise("0")).alias("flags"))

    def stretch(a: Column, at: Column) -> Column:
        some = F.aggregate(F.slice(ordered, at * STRIDE + 1, F.lit(STRIDE)), F.struct(a["far"].alias("far"), F.lit("").alias("flags")), step)
        return F.transform(F.array(some), lambda r: F.struct(r["far"].alias("far"), F.concat(a["flags"], r["flags"]).alias("flags")))[0]

    numbers = F.sequence(F.lit(0), F.floor(F.size(ordered) / STRIDE).cast("int"))
    return F.split(F.aggregate(numbers, F.struct(far.alias("far"), F.lit("").alias("flags")), stretch, lambda a: a["flags"]), "")


RULES = "array<struct<keys:array<string>,rules:array<struct<pattern:string,rank:int,label:string>>>>"


def detections(words: Column, only: list[Rule] | None = None) -> Column:
    """The detections left after suppression, in order of place: structs s, e, rank, label.

    Rules are tried by the words they need: those of which the text holds none can't match.
    One is dropped if it lies within another of the same or a better rank (of equal ones the
    first in rule order stays); base phrases always stay.
    """
    keywords: dict[tuple[str, int, str], set[str]] = {}  # a rule stands once for each of its keywords
    for r in only or rules():
        keywords.setdefault((r.label, r.rank, r.pattern), set()).add(r.keyword)
    by_keys: dict[frozenset[str], list[dict]] = {}
    for (label, rank, pattern), prefer in keywords.items():
        by_keys.setdefault(needed(pattern, frozenset(prefer)), []).append({"pattern": compile_pattern(pattern), "rank": rank, "label": label})
    table = F.from_json(F.lit(json.dumps([{"keys": [f" {k} " for k in sorted(ks)], "rules": v} for ks, v in by_keys.items()])), RULES)
    tried = F.flatten(F.transform(F.filter(table, lambda t: F.exists(t["keys"], lambda k: F.contains(words, k))), lambda t: F.filter(t["rules"], lambda r: F.rlike(words, r["pattern"]))))
    every = F.flatten(F.transform(tried, lambda r: _found(words, r)))
    ordered = F.array_sort(F.transform(every, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("minus"), x["rank"].alias("rank"), x["label"].alias("label"))))

    def left(o: Column) -> Column:
        flags = F.transform(F.array(_standing(o)), lambda f: F.filter(o, lambda x, i: F.get(f, i) == "1"))[0]
        return F.transform(flags, lambda x: F.struct(x["s"].alias("s"), (-x["minus"]).alias("e"), x["rank"].alias("rank"), x["label"].alias("label")))

    return F.transform(F.array(ordered), left)[0]


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows with license_words (long) and license_hits (array of s, e, rank, label: words from the s-th up to before the e-th, from 0) added.

    Null and empty texts have no words and no hits. Columns of the added names are replaced.
    """
    text = F.coalesce(column(docs, text_col).cast("string"), F.lit(""))

    def passes(small: Column) -> Column:
        gate = F.contains(small, F.lit("cc")) & text.rlike(f"(?i)(^|{GAP})cc{GAP}+by")
        for g in GATE:
            gate = F.contains(small, F.lit(g)) | gate
        return gate

    gate = F.transform(F.array(F.lower(text)), passes)[0]
    rows = docs.withColumn("license_words", F.regexp_count(text, F.lit(f"{ANY_WORD}+")).cast("long"))
    string = F.when(gate, words_of(text)).otherwise(F.lit(""))

    none = F.array().cast(HITS)
    return rows.withColumn("license_hits", F.transform(F.array(string), lambda w: F.when(w == "", none).otherwise(detections(w)))[0])


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    A null or empty text has no words: counts 0, null places, empty labels, score 0. Very long texts are read whole. Repeated rows give
    repeated results; an empty table gives no row; columns other than id and text aren't looked at.
    """
    rows = scan_licenses(docs.select(column(docs, id_col).alias("doc_id"), column(docs, text_col).alias("text")))
    hits = F.col("license_hits")
    base = F.filter(hits, lambda x: x["rank"] == 0)
    names = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))), ",")
    best = F.array_min(F.transform(hits, lambda x: x["rank"]))
    score = F.lit(0.0)
    for rank, value in reversed(list(enumerate(CONFIDENCE))):
        score = F.when(best == rank, F.lit(value)).otherwise(score)
    return rows.select(
        "doc_id", F.col("license_words").alias("n_words"), F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["s"])).cast("long").alias("first_word"), F.array_max(F.transform(base, lambda x: x["s"])).cast("long").alias("last_word"),
        names(base).alias("base_labels"), names(hits).alias("labels"), score.alias("score"),
    )

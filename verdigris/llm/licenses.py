"""Operator 12, license scans by ordered signature rules, with native expressions only.

A text becomes its lower-case words (A-Z lower-cased; words are runs of letters and digits of ASCII and of everything beyond it), each
with one space around it. Rules are regular expressions over these words. Each has a level (1 a passage of a license's text, 2 a tag or a grant,
3 a name with its version, 4 a name) and words that every match holds: a rule is only tried on texts that hold these words, which one
intersection with the list of all such words tells.

Detections are intervals of words. One that lies within another of the same or a better level is suppressed, of equal intervals
the one whose rule comes later: "apache license" within "licensed under the apache license version 2 0" says nothing of its own. For this
detections are sorted by start, and each is compared with the furthest end so far of each level. Starts, ends and these
maxima are taken in blocks, so that the work is linear in the number of detections.

The contract's four phrases are counted beside the rules, and their labels always stay.
Everything is an expression over one row: no shuffle, and no document waits for another.

Score: the confidence of the best detection (by level: 1, 0.95, 0.9, 0.7; 0.8 for a phrase of the contract), 0 without any.

Cases: a null text is an empty one and has no words; ids play no part, so repeated or null ones keep their own rows; a very long text,
or one of nothing but license names, is scanned whole; an empty table gives an empty result; ``detected`` keeps all other
columns, ``scanned`` ignores them.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.common import table, text_or_empty

#: Phrases and labels of the contract.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CONFIDENCE, BASE_CONFIDENCE = (1.0, 0.95, 0.9, 0.7), 0.8
TEXT, GRANT, VERSION, NAME = 1, 2, 3, 4
BLOCK = 64
_OPEN, _CLOSE = "\x01", "\x02"

L = "licen[cs]e"
V = "(?:version |ver |v )?v?"
#: label, level, words that all matches hold, pattern. Names that have no versions, or whose versions don't matter.
NAMES = [
    ("mit", NAME, "mit", f"(?:the )?mit (?:x11 |expat )?(?:style |open source |public )?{L}"),
    ("mit", NAME, "expat", f"expat {L}"),
    ("x11", NAME, "x11", f"x11 {L}"),
    ("isc", NAME, "isc", f"isc (?:style )?{L}"),
    ("isc", NAME, "internet systems consortium", f"internet systems consortium {L}"),
    ("zlib", NAME, "zlib", f"zlib (?:libpng )?{L}"),
    ("libpng", NAME, "libpng", f"libpng {L}"),
    ("unlicense", NAME, "unlicense", "(?:the )?unlicense"),
    ("wtfpl", NAME, "wtfpl", "wtfpl"),
    ("wtfpl", NAME, "what want public", f"do what the f[^ ]* you want to public {L}"),
    ("beerware", NAME, "beerware", f"beerware(?: {L})?"),
    ("beerware", NAME, "beer ware", f"the beer ware {L}"),
    ("0bsd", NAME, "0bsd", "0bsd"),
    ("0bsd", NAME, "bsd clause", f"(?:bsd )?(?:zero|0) clause bsd(?: {L})?"),
    ("bsd-2-clause", VERSION, "bsd clause", f"bsd (?:2|two) clause(?: simplified)?(?: {L})?|(?:2|two) clause bsd(?: style)?(?: {L})?"),
    ("bsd-2-clause", VERSION, "simplified bsd", f"simplified bsd {L}"),
    ("bsd-2-clause", VERSION, "freebsd", f"freebsd {L}"),
    ("bsd-3-clause", VERSION, "bsd clause", f"bsd (?:3|three) clause(?: new| revised)?(?: {L})?|(?:3|three) clause bsd(?: style)?(?: {L})?"),
    ("bsd-3-clause", VERSION, "bsd", f"(?:new|revised|modified) bsd {L}"),
    ("bsd-4-clause", VERSION, "bsd clause", f"bsd (?:4|four) clause(?: original)?(?: {L})?|(?:4|four) clause bsd(?: {L})?"),
    ("bsd-4-clause", VERSION, "original bsd", f"original bsd {L}"),
    ("bsd", NAME, "bsd", f"(?:the )?bsd (?:style |type )?{L}"),
    ("bsd", NAME, "berkeley distribution", f"berkeley software distribution {L}"),
    ("postgresql", NAME, "postgresql", f"postgresql {L}"),
    ("ncsa", NAME, "ncsa", f"(?:university of illinois )?ncsa open source {L}"),
    ("json", NAME, "json", f"json {L}"),
    ("openssl", NAME, "openssl", f"openssl {L}"),
    ("ssleay", NAME, "ssleay", f"(?:original )?ssleay {L}"),
    ("curl", NAME, "curl", f"curl {L}"),
    ("vim", NAME, "vim", f"vim {L}"),
    ("ruby", NAME, "ruby", f"ruby {L}"),
    ("tcl", NAME, "tcl", f"tcl(?: tk)? {L}"),
    ("sleepycat", NAME, "sleepycat", f"sleepycat(?: software)? {L}"),
    ("icu", NAME, "icu", f"icu {L}"),
    ("unicode-dfs", NAME, "unicode", f"unicode (?:inc )?{L}(?: agreement)?"),
    ("w3c", NAME, "w3c", f"w3c (?:software (?:notice and )?|document )?{L}"),
    ("fsf-all-permissive", NAME, "fsf permissive", f"fsf all permissive {L}"),
    ("commons-clause", NAME, "commons clause", f"commons clause(?: {L})?(?: condition)?"),
    ("public-domain", NAME, "public domain", "(?:released|placed|dedicated|given|put|donated) (?:in|to|into) the public domain"),
    ("public-domain", NAME, "public domain", "(?:this|it) (?:work|software|code|file|document|text)? ?is (?:hereby )?in the public domain"),
    ("all-rights-reserved", NAME, "rights reserved", "all rights reserved"),
    ("proprietary", NAME, "proprietary confidential", "proprietary and confidential|confidential and proprietary"),
    ("commercial", NAME, "commercial", f"commercial (?:software )?{L}(?: agreement)?"),
    ("eula", NAME, "user agreement", f"end user {L} agreement"),
    ("copyleft", NAME, "copyleft", f"copyleft {L}"),
    ("apache", NAME, "apache", f"(?:the )?apache (?:software )?(?:foundation )?{L}"),
    ("gpl", NAME, "gnu general public", f"(?:the )?gnu general public {L}"),
    ("gpl", NAME, "gpl", f"(?:the )?(?:gnu )?gpl(?: {L})?"),
    ("lgpl", NAME, "gnu lesser", f"(?:the )?gnu lesser general public {L}"),
    ("lgpl", NAME, "gnu library", f"(?:the )?gnu library general public {L}"),
    ("lgpl", NAME, "lgpl", f"(?:the )?(?:gnu )?lgpl(?: {L})?"),
    ("agpl", NAME, "affero", f"(?:the )?(?:gnu )?affero general public {L}"),
    ("agpl", NAME, "agpl", f"(?:the )?(?:gnu )?agpl(?: {L})?"),
    ("gfdl", NAME, "gnu free documentation", f"(?:the )?gnu free documentation {L}"),
    ("gfdl", NAME, "gfdl", "(?:gnu )?gfdl"),
    ("mpl", NAME, "mozilla", f"(?:the )?mozilla public {L}"),
    ("epl", NAME, "eclipse", f"(?:the )?eclipse public {L}"),
    ("cc0", NAME, "cc0", "(?:creative commons )?cc0(?: universal)?"),
    ("cc", NAME, "creative commons", f"(?:a )?creative commons(?: {L})?"),
]
#: label, words, pattern of the name, versions. {v} in a label is the version; each version is a rule, with its dots as spaces.
VERSIONED = [
    ("apache-{v}", "apache", f"(?:the )?apache (?:software )?(?:foundation )?(?:{L} )?{V}", "1.0 1.1 2.0"),
    ("gpl-{v}", "gnu general public", f"(?:the )?gnu general public {L} {V}", "1.0 2.0 3.0"),
    ("gpl-{v}", "gpl", f"(?:gnu )?gpl (?:{L} )?{V}", "1.0 2.0 3.0"),
    ("lgpl-{v}", "gnu lesser", f"(?:the )?gnu lesser general public {L} {V}", "2.1 3.0"),
    ("lgpl-{v}", "gnu library", f"(?:the )?gnu library general public {L} {V}", "2.0"),
    ("lgpl-{v}", "lgpl", f"(?:gnu )?lgpl (?:{L} )?{V}", "2.0 2.1 3.0"),
    ("agpl-{v}", "affero", f"(?:the )?(?:gnu )?affero general public {L} {V}", "1.0 3.0"),
    ("agpl-{v}", "agpl", f"(?:gnu )?agpl (?:{L} )?{V}", "1.0 3.0"),
    ("gfdl-{v}", "gnu free documentation", f"(?:the )?gnu free documentation {L} {V}", "1.1 1.2 1.3"),
    ("gfdl-{v}", "gfdl", f"(?:gnu )?gfdl {V}", "1.1 1.2 1.3"),
    ("mpl-{v}", "mozilla", f"(?:the )?mozilla public {L} {V}", "1.0 1.1 2.0"),
    ("mpl-{v}", "mpl", f"mpl {V}", "1.0 1.1 2.0"),
    ("epl-{v}", "eclipse", f"(?:the )?eclipse public {L} {V}", "1.0 2.0"),
    ("epl-{v}", "epl", f"epl {V}", "1.0 2.0"),
    ("edl-{v}", "eclipse distribution", f"eclipse distribution {L} {V}", "1.0"),
    ("cddl-{v}", "cddl", f"cddl {V}", "1.0 1.1"),
    ("cddl-{v}", "common development distribution", f"common development and distribution {L} (?:cddl )?{V}", "1.0 1.1"),
    ("cpl-{v}", "common public", f"common public {L} {V}", "1.0"),
    ("ipl-{v}", "ibm public", f"ibm public {L} {V}", "1.0"),
    ("npl-{v}", "netscape", f"netscape public {L} {V}", "1.0 1.1"),
    ("bsl-{v}", "boost", f"boost software {L} {V}", "1.0"),
    ("artistic-{v}", "artistic", f"artistic {L} {V}", "1.0 2.0"),
    ("eupl-{v}", "european union public", f"european union public licen[cs]e (?:eupl )?{V}", "1.0 1.1 1.2"),
    ("eupl-{v}", "eupl", f"eupl {V}", "1.0 1.1 1.2"),
    ("osl-{v}", "open software", f"open software {L} (?:osl )?{V}", "1.0 2.0 2.1 3.0"),
    ("afl-{v}", "academic free", f"academic free {L} (?:afl )?{V}", "1.1 1.2 2.0 2.1 3.0"),
    ("ofl-{v}", "sil font", f"sil open font {L} {V}", "1.0 1.1"),
    ("ofl-{v}", "ofl", f"ofl {V}", "1.0 1.1"),
    ("php-{v}", "php", f"(?:the )?php {L} {V}", "3.0 3.01"),
    ("zpl-{v}", "zope", f"zope public {L} (?:zpl )?{V}", "1.1 2.0 2.1"),
    ("python-{v}", "python", f"python (?:software foundation )?{L} {V}", "2.0"),
    ("lppl-{v}", "latex project public", f"latex project public {L} {V}", "1.0 1.1 1.2 1.3a 1.3c"),
    ("lppl-{v}", "lppl", f"lppl {V}", "1.0 1.1 1.2 1.3a 1.3c"),
    ("ecl-{v}", "educational community", f"educational community {L} {V}", "1.0 2.0"),
    ("efl-{v}", "eiffel forum", f"eiffel forum {L} {V}", "1.0 2.0"),
    ("cecill-{v}", "cecill", f"cecill (?:free software {L} agreement )?{V}", "1.0 1.1 2.0 2.1"),
    ("mulanpsl-{v}", "mulan", f"mulan (?:permissive software {L}|psl) {V}", "1.0 2.0"),
    ("upl-{v}", "universal permissive", f"universal permissive {L} (?:upl )?{V}", "1.0"),
    ("sspl-{v}", "server side public", f"server side public {L} (?:sspl )?{V}", "1.0"),
    ("sspl-{v}", "sspl", f"sspl {V}", "1.0"),
    ("busl-{v}", "business source", f"business source {L} {V}", "1.1"),
    ("elastic-{v}", "elastic", f"elastic {L} {V}", "2.0"),
    ("polyform-noncommercial-{v}", "polyform noncommercial", f"polyform noncommercial {L} {V}", "1.0.0"),
    ("ms-pl", "microsoft public", f"microsoft public {L} ?{V}", "1.0"),
    ("ms-rl", "microsoft reciprocal", f"microsoft reciprocal {L} ?{V}", "1.0"),
    ("odbl-{v}", "odbl", f"(?:open database {L} )?odbl {V}", "1.0"),
    ("odbl-{v}", "open database", f"(?:odc )?open database {L} {V}", "1.0"),
    ("odc-by-{v}", "open data commons attribution", f"open data commons attribution {L} {V}", "1.0"),
    ("pddl-{v}", "public domain dedication", f"public domain dedication and {L} (?:pddl )?{V}", "1.0"),
    ("ogl-uk-{v}", "open government", f"open government licen[cs]e {V}", "1.0 2.0 3.0"),
    ("openrail-{v}", "openrail", f"(?:creativeml )?(?:open )?openrail m? ?{V}", "1.0"),
    ("cdla-permissive-{v}", "community data agreement permissive", f"community data {L} agreement permissive {V}", "1.0 2.0"),
    ("cdla-sharing-{v}", "community data agreement sharing", f"community data {L} agreement sharing {V}", "1.0"),
    ("cc0-{v}", "cc0", f"(?:creative commons )?cc0 (?:universal )?{V}", "1.0"),
]
#: The creative commons licenses: the parts of the short name, and of the long one.
CC_PARTS = {"by": "attribution", "nc": "non ?commercial", "sa": "share ?alike", "nd": "no ?deriv(?:ative)?s?(?: works)?"}
CC_KINDS, CC_VERSIONS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd"), ("1.0", "2.0", "2.5", "3.0", "4.0")
#: label, words, passages of license texts and notices that stand for the whole.
PASSAGES = [
    ("mit", "sublicense merchantability", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "sublicense", "to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("isc", "disclaims merchantability", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted"),
    ("isc", "disclaims", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse promote", "neither the name of (?:[^ ]+ ){1,12}?may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising acknowledgement", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("zlib", "misrepresented", "the origin of this software must not be misrepresented"),
    ("zlib", "altered", "altered source versions must be plainly marked as such"),
    ("apache-2.0", "apache compliance", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache-2.0", "apache perpetual", "a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-2.0", "apache licenses", "(?:https? )?(?:www )?apache org licenses license 2 0(?: html| txt)?"),
    ("gpl", "redistribute gnu", "(?:is free software )?you can redistribute it and or modify it under the terms of (?:the gnu general public license|the gnu gpl)"),
    ("gpl-2.0-or-later", "redistribute gnu either", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", "redistribute gnu either", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl-2.1-or-later", "redistribute gnu either", "under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0-or-later", "redistribute gnu either", "under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3.0-or-later", "affero either", "under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl", "gnu licenses", "(?:https? )?(?:www )?gnu org licenses gpl(?: (?:2|3) 0)?(?: html| txt)?"),
    ("lgpl", "gnu licenses", "(?:https? )?(?:www )?gnu org licenses lgpl(?: (?:2 1|3 0))?(?: html| txt)?"),
    ("agpl-3.0", "gnu licenses", "(?:https? )?(?:www )?gnu org licenses agpl(?: 3 0)?(?: html| txt)?"),
    ("gpl", "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("mpl-2.0", "mozilla mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-1.1", "mozilla contents", "the contents of this file are subject to the mozilla public license version 1 1"),
    ("mpl-2.0", "mozilla", "(?:https? )?(?:www )?mozilla org mpl 2 0"),
    ("epl-2.0", "eclipse accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0"),
    ("epl-1.0", "eclipse accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("cddl-1.0", "cddl contents", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("bsl-1.0", "boost", "distributed under the boost software license version 1 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "waived copyright", "has (?:dedicated the work to the public domain by )?waiv(?:ed|ing) all (?:of )?(?:his or her |their )?(?:copyright and related )?rights to the work"),
    ("ofl-1.1", "font reserved", "this font software is licensed under the sil open font license version 1 1"),
    ("wtfpl", "want", "you just do what the f[^ ]* you want to"),
    ("beerware", "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("json", "evil", "the software shall be used for good not evil"),
    ("openssl", "openssl toolkit", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("python-2.0", "psf", "psf is making python available to licensee on an as is basis"),
    ("artistic-2.0", "artistic", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed artistic"),
    ("gfdl", "invariant", "with no invariant sections no front cover texts and no back cover texts"),
    ("cc-by-sa", "sharealike", "you must distribute your contributions under the same license as the original"),
    ("all-rights-reserved", "prohibited reproduction", "unauthorized (?:copying|reproduction|distribution) (?:[^ ]+ ){0,8}?is (?:strictly )?prohibited"),
]
GRANTED = r"(?:dual |re)?(?:licen[cs]ed|released|distributed|available|provided|published|offered|redistributed|shared|governed|covered|issued) (?:[^ ]+ ){0,4}?(?:under|by) (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?"


def rules() -> list[dict]:
    """All rules in their order: rule (number), label, level, keys, pattern."""
    found: list[tuple[str, int, str, str]] = [(label, TEXT, keys, pattern) for label, keys, pattern in PASSAGES]
    names: list[tuple[str, int, str, str]] = []
    for label, keys, pattern, versions in VERSIONED:
        for v in versions.split():
            number = v.replace(".", " ").removesuffix(" 0") + ("(?: 0)?" if v.endswith(".0") else "")
            names.append((label.format(v=v), VERSION, keys, f"{pattern}{number}(?: or (?:any )?later| only)?(?: {L})?"))
    for kind in CC_KINDS:
        parts = kind.split("-")
        short, long = f"cc {' '.join(parts)}", f"creative commons {' '.join(CC_PARTS[p] for p in parts)}"
        for v in CC_VERSIONS:
            number = v.replace(".", " ")
            names.append((f"cc-{kind}-{v}", VERSION, "cc by", f"{short} {V}{number}(?: (?:international|unported|generic))?(?: {L})?"))
            names.append((f"cc-{kind}-{v}", VERSION, "creative commons attribution", f"{long} {V}{number}(?: (?:international|unported|generic))?(?: public)?(?: {L})?"))
            names.append((f"cc-{kind}-{v}", GRANT, "creativecommons", f"creativecommons org licenses {' '.join(parts)} {number}"))
        names.append((f"cc-{kind}", NAME, "cc by", f"{short}(?: {L})?"))
        names.append((f"cc-{kind}", NAME, "creative commons attribution", f"{long}(?: {L})?"))
    # of two names at one place the one with more parts comes first
    names = sorted(names, key=lambda x: (x[1], -x[0].count("-"))) + NAMES
    found += [(label, GRANT, f"{keys} spdx", rf"spdx {L} identifier (?:[^ ]+ ){{0,2}}?{label.replace('-', ' ').replace('.', ' ')}(?: only| or later)?") for label, keys in dict.fromkeys((n[0], "") for n in names)]
    found += [(label, GRANT, keys, f"{GRANTED}(?:{pattern})") for label, level, keys, pattern in names if level == VERSION]
    found += [(label, GRANT, keys, f"{GRANTED}(?:{pattern})") for label, level, keys, pattern in names if level == NAME and label not in ("commercial", "all-rights-reserved", "public-domain", "proprietary")]
    found += names
    return [{"rule": i, "label": label, "level": level, "keys": keys.split(), "pattern": f"(?<= )({pattern})(?= )"} for i, (label, level, keys, pattern) in enumerate(found)]


_RULE = "struct<rule:int,label:string,level:int,keys:array<string>,pattern:string>"
_SPAN = "struct<start:int,end:int,level:int,rule:int,label:string>"


def normalised(text: Column) -> Column:
    """The words of a text with one space before, between and behind them."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, NOT_WORD, " ")), F.lit(" "))


def _places(norm: Column, pattern: Column, make) -> Column:
    """make(start, end) of the matches of a pattern, in words. A match is marked at its first and last word."""
    marked = F.array(F.regexp_replace(norm, pattern, F.lit(f"{_OPEN}$1{_CLOSE}")))
    none = F.array().cast("array<int>")

    def found(m: Column) -> Column:
        words = F.split(m, " ")  # the first is empty: word i stands at i + 1
        begin = F.filter(F.transform(words, lambda w, i: F.when(F.startswith(w, F.lit(_OPEN)), i - 1)), lambda i: i.isNotNull())
        end = F.filter(F.transform(words, lambda w, i: F.when(F.endswith(w, F.lit(_CLOSE)), i)), lambda i: i.isNotNull())
        return F.zip_with(F.when(m != norm, begin).otherwise(none), F.when(m != norm, end).otherwise(none), make)

    return F.flatten(F.transform(marked, found))


def _unsuppressed(spans: Column) -> Column:
    """The sorted spans without those that lie in another one of a level as good, or better."""
    at = F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / BLOCK).cast("int"))
    blocks = F.transform(at, lambda b: F.slice(spans, b * BLOCK + 1, F.lit(BLOCK)))
    levels = F.array(*(F.lit(k) for k in range(1, len(CONFIDENCE) + 1)))
    # the furthest end so far of spans that are as good as a level, before each block
    furthest = F.transform(blocks, lambda k: F.transform(levels, lambda v: F.coalesce(F.array_max(F.transform(F.filter(k, lambda s: s["level"] <= v), lambda s: s["end"])), F.lit(-1))))
    state = "array<array<int>>"
    start = F.array(F.transform(levels, lambda v: F.lit(-1))).cast(state)
    before = F.aggregate(furthest, start, lambda a, x: F.concat(a, F.array(F.zip_with(F.element_at(a, -1), x, lambda p, q: F.greatest(p, q)))).cast(state))
    kept = F.zip_with(
        blocks,
        F.slice(before, F.lit(1), F.size(blocks)),
        lambda k, ends: F.filter(k, lambda s, i: (F.element_at(ends, s["level"]) < s["end"]) & ~F.exists(F.slice(k, F.lit(1), i), lambda e: (e["level"] <= s["level"]) & (e["end"] >= s["end"]))),
    )
    return F.flatten(kept)


def detected(docs: DataFrame) -> DataFrame:
    """Adds words (n), base (array of start, end, label) and detections (array of start, end, level, rule, label, sorted)."""
    listed = rules()
    by_key: dict[str, list[dict]] = {}
    for r in listed:
        by_key.setdefault(r["keys"][0], []).append(r)
    held = F.from_json(F.lit(json.dumps(by_key)), f"map<string,array<{_RULE}>>")
    keys = F.from_json(F.lit(json.dumps(sorted({k for r in listed for k in r["keys"]}))), "array<string>")
    norm = docs.withColumn("_norm", normalised(text_or_empty("text")))
    said = norm.withColumn("_keys", F.array_intersect(F.split("_norm", " "), keys))
    found = F.filter(F.flatten(F.filter(F.transform("_keys", lambda k: F.try_element_at(held, k)), lambda r: r.isNotNull())), lambda r: F.forall(r["keys"], lambda k: F.array_contains("_keys", k)))
    spans = F.transform(found, lambda r: _places(F.col("_norm"), r["pattern"], lambda s, e: F.struct(s.alias("start"), e.alias("end"), r["level"].alias("level"), r["rule"].alias("rule"), r["label"].alias("label"))))
    ordered = F.array_sort(F.transform(F.flatten(spans), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["level"].alias("level"), s["rule"].alias("rule"), s["label"].alias("label"))))
    plain = F.transform(ordered, lambda s: F.struct(s["start"].alias("start"), (-s["back"]).alias("end"), s["level"].alias("level"), s["rule"].alias("rule"), s["label"].alias("label")))
    none = F.array().cast(f"array<{_SPAN}>")

    def of_base(phrase: str, label: str) -> Column:
        places = _places(F.col("_norm"), F.lit(f"(?<= )({phrase})(?= )"), lambda s, e: F.struct(s.alias("start"), e.alias("end"), F.lit(label).alias("label")))
        return F.when(F.contains("_norm", F.lit(f" {phrase} ")), places).otherwise(F.array().cast("array<struct<start:int,end:int,label:string>>"))

    marked = said.withColumns({"_all": F.when(F.size("_keys") > 0, plain).otherwise(none), "base": F.concat(*(of_base(*x) for x in BASE.items()))})
    return marked.withColumns(
        {
            "words": F.when(F.col("_norm") == "  ", 0).otherwise(F.length("_norm") - F.length(F.translate("_norm", " ", "")) - 1).cast("long"),
            "detections": F.when(F.size("_all") > 1, _unsuppressed(F.col("_all"))).otherwise(F.col("_all")),
        }
    ).drop("_norm", "_keys", "_all")


def scanned(docs: DataFrame) -> DataFrame:
    """One row per document with the columns of the contract, and n_detections."""
    found = detected(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    starts, base_labels = F.transform("base", lambda s: s["start"]), F.transform("base", lambda s: s["label"])
    listed = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    confidence = F.array(*(F.lit(c) for c in CONFIDENCE))
    best = F.array_max(F.transform("detections", lambda s: F.element_at(confidence, s["level"])))
    return found.select(
        "doc_id",
        F.col("words").alias("n_words"),
        F.size("base").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        listed(base_labels).alias("base_labels"),
        listed(F.concat(base_labels, F.transform("detections", lambda s: s["label"]))).alias("labels"),
        F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size("base") > 0, BASE_CONFIDENCE).otherwise(0.0)).alias("score"),
        F.size("detections").cast("long").alias("n_detections"),
    )


def op12_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))

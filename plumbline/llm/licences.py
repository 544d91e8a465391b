"""Licence detection by ordered signature rules, in DataFrame functions alone.

A text is reduced to its lower-cased words with single spaces. Rules are regular expressions over that, each tried
only where its keyword, and for a version its number, occurs; a rule has a priority, by how specific what it says is.
A detection whose stretch lies within that of one of better or equal priority is dropped, so that the longest and most
specific reading stays. Places and suppression come from prefix folds, so that a text of many matches costs little more
than in proportion to them.
"""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    name: str
    label: str
    priority: int
    keyword: str
    pattern: str
    weight: float
    also: str = ""


#: Phrases that count wherever their words stand in a row, and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: (label, keyword, names as patterns): licences without versions, by the names that stand for them.
NAMED = [
    ("mit", "mit", ["mit license", "mit licence", "mit x11 license", "expat license", "the mit open source license"]),
    ("mit", "mit", ["mit style license", "mit licensed"]),
    ("mit-0", "mit", ["mit no attribution(?: license)?", "mit 0 license"]),
    ("x11", "x11", ["x11 license", "x consortium license"]),
    ("isc", "isc", ["isc license", "isc licence", "internet systems consortium license"]),
    ("bsd-2-clause", "bsd", ["bsd 2 clause(?: license)?", "2 clause bsd(?: license)?", "simplified bsd license", "two clause bsd license", "freebsd license"]),
    ("bsd-3-clause", "bsd", ["bsd 3 clause(?: license)?", "3 clause bsd(?: license)?", "new bsd license", "modified bsd license", "revised bsd license", "three clause bsd license"]),
    ("bsd-4-clause", "bsd", ["bsd 4 clause(?: license)?", "4 clause bsd(?: license)?", "original bsd license", "old bsd license"]),
    ("bsd-0-clause", "bsd", ["zero clause bsd(?: license)?", "bsd zero clause license", "0bsd"]),
    ("bsd", "bsd", ["bsd license", "bsd licence", "bsd style license", "bsd licensed", "berkeley software distribution license"]),
    ("zlib", "zlib", ["zlib license", "zlib libpng license", "zlib licence"]),
    ("libpng", "libpng", ["libpng license", "png reference library license"]),
    ("boost", "boost", ["boost software license", "boost license"]),
    ("unlicense", "unlicense", ["the unlicense", "unlicense org", "unlicensed into the public domain"]),
    ("wtfpl", "wtfpl", ["wtfpl"]),
    ("wtfpl", "public license", ["do what the fuck you want to public license"]),
    ("artistic", "artistic", ["artistic license", "clarified artistic license"]),
    ("perl", "perl", ["same terms as perl(?: itself)?", "under the terms of perl"]),
    ("python", "python", ["python software foundation license", "psf license", "python license agreement"]),
    ("ruby", "ruby", ["ruby license", "same terms as ruby"]),
    ("php", "php", ["php license"]),
    ("ofl", "font", ["sil open font license", "open font license"]),
    ("ubuntu-font", "font", ["ubuntu font licen[cs]e"]),
    ("bitstream", "bitstream", ["bitstream vera fonts copyright", "bitstream vera license"]),
    ("postgresql", "postgresql", ["postgresql license", "postgresql licence"]),
    ("openssl", "openssl", ["openssl license", "ssleay license", "original ssleay license"]),
    ("curl", "curl", ["curl license"]),
    ("icu", "icu", ["icu license", "unicode icu license"]),
    ("unicode", "unicode", ["unicode license agreement", "unicode terms of use"]),
    ("ijg", "jpeg", ["independent jpeg group s? ?software", "ijg license"]),
    ("ncsa", "ncsa", ["ncsa open source license", "university of illinois ncsa", "university of illinois open source license"]),
    ("intel", "intel", ["intel open source license", "intel simplified software license"]),
    ("ibm-public", "ibm", ["ibm public license"]),
    ("sun", "sun", ["sun industry standards source license", "sun public license"]),
    ("qpl", "q public", ["q public license"]),
    ("beerware", "beer", ["beer ware license", "beerware license"]),
    ("json", "json", ["json license"]),
    ("json", "evil", ["software shall be used for good not evil"]),
    ("cecill", "cecill", ["cecill(?: [abc])?(?: free software)? license", "licence cecill"]),
    ("mulan", "mulan", ["mulan permissive software license", "mulan psl"]),
    ("upl", "universal permissive", ["universal permissive license"]),
    ("blue-oak", "blue oak", ["blue oak model license"]),
    ("server-side", "server side", ["server side public license", "sspl"]),
    ("elastic", "elastic", ["elastic license"]),
    ("business-source", "business source", ["business source license", "busl"]),
    ("commons-clause", "commons clause", ["commons clause license", "commons clause"]),
    ("polyform", "polyform", ["polyform (?:noncommercial|small business|shield|strict|perimeter|internal use|free trial) license"]),
    ("openrail", "openrail", ["open ?rail(?: [mds]){0,2} license", "creativeml open rail m", "bigscience (?:bloom )?rail license"]),
    ("llama", "llama", ["llama (?:\\d )*community license", "llama \\d license"]),
    ("odbl", "database", ["open database license"]),
    ("odc-by", "open data", ["open data commons attribution license"]),
    ("pddl", "public domain", ["public domain dedication and license"]),
    ("ogl", "open government", ["open government licen[cs]e"]),
    ("etalab", "etalab", ["licence ouverte(?: open licence)? etalab", "etalab(?: 2 0)? licence"]),
    ("community-data", "community data", ["community data license agreement"]),
    ("proprietary", "proprietary", ["proprietary and confidential", "proprietary license", "proprietary software license"]),
    ("proprietary", "end user", ["end user license agreement"]),
    ("proprietary", "confidential", ["confidential and proprietary", "trade secret and confidential"]),
    ("commercial", "commercial", ["commercial license agreement", "for commercial use contact"]),
    ("non-commercial", "commercial", ["(?:for )?non commercial use only", "not for commercial use", "no commercial use"]),
    ("research-only", "research", ["for research (?:purposes|use) only", "for academic use only", "academic research license"]),
    ("reserved", "reserved", ["all rights reserved", "tous droits r[^ ]*serv[^ ]*s", "todos los derechos reservados", "alle rechte vorbehalten"]),
    ("reserved", "rechte", ["alle rechte vorbehalten"]),
    ("reserved", "droits", ["tous droits r[^ ]*serv[^ ]*s"]),
    ("reserved", "derechos", ["todos los derechos reservados"]),
    ("public-domain", "public domain", ["(?:released|placed|dedicated|put) (?:in|into|to) the public domain", "public domain dedication", "this work is in the public domain", "has been dedicated to the public domain"]),
    ("public-domain", "no copyright", ["no copyright is claimed", "no rights reserved"]),
    ("copyleft", "copyleft", ["copyleft license", "copyleft all wrongs reserved"]),
]

#: (label, keyword, sentence): wording of licence texts themselves.
WORDING = [
    ("mit", "permission is hereby granted", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial portions", "shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use", "permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("bsd", "redistribution and use", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd", "redistributions", "redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "endorse or promote", "may be used to endorse or promote products derived from this software without"),
    ("bsd-4-clause", "advertising materials", "all advertising materials mentioning features or use of this software"),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify"),
    ("gpl", "free software foundation", "as published by the free software foundation"),
    ("lgpl", "library is free", "this library is free software you can redistribute it and or modify"),
    ("gpl", "any warranty", "without any warranty without even the implied warranty of merchantability"),
    ("apache-2.0", "compliance with the license", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "warranties or conditions", "distributed on an as is basis without warranties or conditions of any kind"),
    ("mpl-2.0", "mozilla", "this source code form is subject to the terms of the mozilla public license"),
    ("zlib", "origin of this software", "the origin of this software must not be misrepresented"),
    ("zlib", "altered source", "altered source versions must be plainly marked as such"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("boost", "machine executable", "machine executable object code generated by a source language processor"),
    ("ofl", "reserved font name", "with reserved font name"),
    ("postgresql", "written agreement", "without fee and without a written agreement is hereby granted"),
    ("cc0", "waived all copyright", "has waived all copyright and related or neighbou?ring rights"),
    ("reserved", "without permission", "may not be reproduced (?:or distributed )?without (?:prior )?(?:written )?permission"),
    ("reserved", "no part of this", "no part of this (?:publication|book|work|document) may be reproduced"),
    ("proprietary", "unauthorized copying", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("warranty", "as is", "provided as is without warranty of any kind"),
    ("warranty", "liable", "in no event shall the (?:authors|copyright holders?|contributors)(?: or (?:authors|copyright holders?|contributors))* be liable"),
    ("warranty", "warranty", "no warranty express or implied"),
    ("licence-file", "license file", "see the license file(?: for details| for more information)?"),
    ("licence-file", "copying", "see the file copying(?: for details)?"),
    ("licence-file", "licensed", "dual licensed under"),
    ("licence-file", "license", "license terms and conditions"),
]

#: (label stem, keyword, name, versions): licences with versions.
VERSIONED = [
    ("gpl", "general public", "(?:gnu )?general public license", ["1", "2", "3"]),
    ("gpl", "gpl", "(?:gnu )?gpl", ["1", "2", "3"]),
    ("lgpl", "general public", "(?:gnu )?(?:lesser|library) general public license", ["2", "2.1", "3"]),
    ("lgpl", "lgpl", "(?:gnu )?lgpl", ["2", "2.1", "3"]),
    ("agpl", "affero", "(?:gnu )?affero general public license", ["1", "3"]),
    ("agpl", "agpl", "(?:gnu )?agpl", ["1", "3"]),
    ("gfdl", "documentation", "(?:gnu )?free documentation license", ["1.1", "1.2", "1.3"]),
    ("gfdl", "gfdl", "(?:gnu )?gfdl", ["1.1", "1.2", "1.3"]),
    ("apache", "apache", "apache(?: software)?(?: license| licence)", ["1.0", "1.1", "2.0"]),
    ("mpl", "mozilla", "mozilla public license", ["1.0", "1.1", "2.0"]),
    ("mpl", "mpl", "mpl", ["1.0", "1.1", "2.0"]),
    ("epl", "eclipse", "eclipse public license", ["1.0", "2.0"]),
    ("edl", "eclipse", "eclipse distribution license", ["1.0"]),
    ("cddl", "common development", "common development and distribution license", ["1.0", "1.1"]),
    ("cddl", "cddl", "cddl", ["1.0", "1.1"]),
    ("cpl", "common public", "common public license", ["0.5", "1.0"]),
    ("eupl", "european union", "european union public licen[cs]e", ["1.0", "1.1", "1.2"]),
    ("eupl", "eupl", "eupl", ["1.0", "1.1", "1.2"]),
    ("artistic", "artistic", "artistic license", ["1.0", "2.0"]),
    ("osl", "open software", "open software license", ["1.0", "2.0", "2.1", "3.0"]),
    ("afl", "academic", "academic free license", ["1.1", "1.2", "2.0", "2.1", "3.0"]),
    ("ms-pl", "microsoft", "microsoft public license", ["1.0"]),
    ("ms-rl", "microsoft", "microsoft reciprocal license", ["1.0"]),
    ("lppl", "latex", "latex project public license", ["1.0", "1.1", "1.2", "1.3"]),
    ("zpl", "zope", "zope public license", ["1.1", "2.0", "2.1"]),
    ("apsl", "apple", "apple public source license", ["1.0", "1.1", "1.2", "2.0"]),
    ("ofl", "font", "sil open font license", ["1.0", "1.1"]),
    ("boost", "boost", "boost software license", ["1.0"]),
    ("elastic", "elastic", "elastic license", ["1.0", "2.0"]),
    ("busl", "business source", "business source license", ["1.0", "1.1"]),
    ("ogl", "open government", "open government licen[cs]e", ["1.0", "2.0", "3.0"]),
    ("odbl", "database", "open database license", ["1.0"]),
    ("php", "php", "php license", ["3.0", "3.01"]),
    ("python", "python", "python software foundation license", ["2"]),
]

#: What follows a version where later ones may be taken, as words; and licences whose usual header names the publisher first.
LATER = "(?: or (?:at your option )?(?:any )?(?:later|newer)(?: versions?)?)"
PUBLISHED = ("general public", "affero", "documentation")
CC_KINDS = {"by": "attribution", "by sa": "attribution share ?alike", "by nd": "attribution no ?deriv(?:ative)?s", "by nc": "attribution non ?commercial", "by nc sa": "attribution non ?commercial share ?alike", "by nc nd": "attribution non ?commercial no ?deriv(?:ative)?s"}
CC_VERSIONS = ["1.0", "2.0", "2.5", "3.0", "4.0"]
GRANT = "(?:licen[sc]ed|released|distributed|available|published|provided|covered|made available) under (?:the |a )?(?:terms of the |terms and conditions of the |conditions of the )?"
#: Identifiers of licences as the public list of identifiers spells them, as words.
IDENTIFIERS = "mit apache-2.0 gpl-2.0-only gpl-2.0-or-later gpl-3.0-only gpl-3.0-or-later lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0-only lgpl-3.0-or-later agpl-3.0-only agpl-3.0-or-later bsd-2-clause bsd-3-clause bsd-4-clause 0bsd isc mpl-1.1 mpl-2.0 epl-1.0 epl-2.0 cddl-1.0 cc0-1.0 cc-by-3.0 cc-by-4.0 cc-by-sa-3.0 cc-by-sa-4.0 cc-by-nc-4.0 cc-by-nd-4.0 cc-by-nc-sa-4.0 cc-by-nc-nd-4.0 unlicense wtfpl zlib bsl-1.0 artistic-2.0 eupl-1.2 ofl-1.1 ncsa postgresql python-2.0 ruby upl-1.0 ms-pl odbl-1.0 gfdl-1.3-only".split()


def plain(pattern: str) -> str:
    """The longest run of plain characters that every match of a pattern must hold."""
    rest = pattern
    while (less := re.sub(r"(?<!\\)\([^()]*\)(?:[?*+]|\{[\d,]+\})?", "\0", rest)) != rest:
        rest = less
    rest = re.sub(r"\[[^\]]*\][?*+]?|\\.[?*+]?|.[?*]|[+.|]", "\0", rest)
    return max(rest.split("\0"), key=len).strip()


def _words(version: str) -> str:
    return version.replace(".", " ").replace("-", " ")


def rules() -> list[Rule]:
    """All rules, by priority: 1 identifiers, 2 grants of a version, 3 names with a version, 4 grants and wording,
    5 names alone."""
    out = []

    def add(label: str, priority: int, keyword: str, pattern: str, weight: float, core: str = "", also: str = ""):
        out.append(Rule(f"{label}/{priority}/{len(out)}", label, priority, plain(core or pattern) or keyword, f"(?<= ){pattern}(?= )", weight, also))

    for name in IDENTIFIERS:
        add(name, 1, "spdx", f"spdx license identifier {_words(name)}", 1.0)
    for stem, keyword, name, versions in VERSIONED:
        for v in versions:
            number = _words(v) + (" 0" if "." not in v else "")
            short = f"(?:{number}|{_words(v)})"
            said = f"{name} (?:(?:version|v) )?v?{short}"
            add(f"{stem}-{v}-or-later", 2, keyword, f"(?:{GRANT})?{said}{LATER}", 0.99, name, _words(v))
            add(f"{stem}-{v}", 2, keyword, GRANT + said, 0.97, name, _words(v))
            add(f"{stem}-{v}", 3, keyword, said, 0.9, name, _words(v))
            if keyword in PUBLISHED:
                header = f"{name} as published by the free software foundation (?:either )?version {short}(?: of the licen[sc]e)?"
                add(f"{stem}-{v}-or-later", 2, "free software foundation", f"(?:{GRANT})?{header}{LATER}", 0.99, also=f"version {_words(v)}")
                add(f"{stem}-{v}-only", 2, "free software foundation", f"(?:{GRANT})?{header} only", 0.99, also=f"version {_words(v)}")
                add(f"{stem}-{v}", 2, "free software foundation", f"(?:{GRANT})?{header}", 0.97, also=f"version {_words(v)}")
        add(stem, 4, keyword, GRANT + name, 0.85, name, " under ")
        add(stem, 5, keyword, name, 0.6, name)
    for kind, long in CC_KINDS.items():
        label = "cc-" + kind.replace(" ", "-")
        for v in CC_VERSIONS:
            add(f"{label}-{v}", 2, "cc by", f"(?:{GRANT})?cc {kind} {_words(v)}", 0.97)
            add(f"{label}-{v}", 2, "creative commons", f"(?:{GRANT})?creative commons {long} {_words(v)}(?: (?:international|unported|generic))?(?: licen[sc]e)?", 0.97)
            add(f"{label}-{v}", 3, "creativecommons", f"creativecommons org licenses {kind} {_words(v)}", 0.95)
        add(label, 4, "cc by", f"cc {kind}", 0.8)
        add(label, 4, "creative commons", f"creative commons {long}", 0.8)
    add("cc0-1.0", 2, "cc0", f"(?:{GRANT})?(?:creative commons )?cc0(?: 1 0)?(?: universal)?", 0.95)
    add("cc0-1.0", 3, "creative commons", "creative commons zero(?: v?1 0)?(?: universal)?", 0.9)
    add("creative-commons", 5, "creative commons", "creative commons(?: licen[sc]e)?", 0.5)
    for label, keyword, sentence in WORDING:
        add(label, 4, keyword, sentence, 0.8)
    for label, keyword, names in NAMED:
        for name in names:
            add(label, 4, keyword, GRANT + f"(?:{name})", 0.9, name, " under ")
            add(label, 5, keyword, f"(?:{name})", 0.7, name)
    return out


#: Every rule's keyword and every base phrase holds one of these; a text without any is not reduced to words. A space
#: stands for anything but word characters.
STEMS = (
    "licen|copyright|copyleft|copies|copying|spdx|gpl|mpl|gfdl|cddl|eupl|sspl|busl|wtfpl|0bsd|bsd 3|bsd 2|bsd 4|3 clause|2 clause|4 clause|bsd clause|clause bsd|mulan psl|"
    "cc by|cc0|creative ?commons|commons clause|public domain|reserved|reservados|vorbehalten|tous droits|"
    "permission|redistribution|warrant|liable|software|proprietary|confidential|commercial use|same terms|terms of|"
    "fonts copyright|use agreement|executable|reserved font|merchantability|waived all|unauthorized copying|no part of|source versions|rail m|"
    "research purposes|research use|academic use|evil|ssl|derived|written agreement|published by|no rights|no attribution|illinois ncsa"
)


def gate() -> str:
    """STEMS as a pattern over a text as it stands."""
    return "(?i)" + STEMS.replace(" ?", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*").replace(" ", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def may_match(text: Column) -> Column:
    """Whether a text holds any of STEMS. Searching for the stems' words is much cheaper than the pattern, which is
    tried only where they occur."""
    low = F.lower(text)
    any_stem = F.lit(False)
    for stem in STEMS.split("|"):
        words = [w for x in stem.replace(" ?", " ").split(" ") if (w := x)]
        any_stem = any_stem | reduce(lambda a, b: a & b, (F.contains(low, F.lit(w)) for w in words))
    return any_stem & F.rlike(text, F.lit(gate()))


NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words_only(text: Column) -> Column:
    """Lower-cased words with a space before, between and after."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(F.concat(F.lit(" "), low, F.lit(" ")), NOT_WORD, " ")


def _spaces(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def _bound(value: Column, of) -> Column:
    return F.get(F.transform(F.array(value), of), F.lit(0))


def folded(values: Column, merge) -> Column:
    """At each place merge of all elements up to it. Doubles its reach in each of log n passes, without an array that
    grows by one."""
    reach = F.when(F.size(values) > 1, F.transform(F.sequence(F.lit(1), F.length(F.bin(F.size(values) - 1))), lambda k: F.pow(F.lit(2.0), k - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(reach, values, lambda held, r: F.transform(held, lambda x, i: F.when(i >= r, merge(F.get(held, i - r), x)).otherwise(x)))


FOUND = "struct<begin:int,end:int,priority:int,label:string,weight:double,rule:string>"


def detections(words: Column, all_rules: list[Rule]) -> Column:
    """All matches of all rules whose keyword occurs: (begin, end, priority, label, weight, rule), characters in words."""
    # one literal, folded from JSON: the table is read once, however many rows are scanned. Rules are grouped by the
    # first word of their keywords, so that most are passed over together.
    groups: dict[str, list] = {}
    for r in all_rules:
        groups.setdefault(r.keyword.split(" ")[0], []).append(asdict(r) | {"rule": r.name})
    rule = "struct<keyword:string,also:string,pattern:string,priority:int,label:string,weight:double,rule:string>"
    table = F.from_json(F.lit(json.dumps([{"first": k, "rules": v} for k, v in groups.items()])), f"array<struct<first:string,rules:array<{rule}>>>")
    near = F.flatten(F.transform(F.filter(table, lambda g: F.contains(words, g["first"])), lambda g: g["rules"]))

    def of_rule(r):
        def placed(found):
            def each(parts):
                # a match begins after the parts up to its own and the matches before it
                steps = F.transform(found, lambda m, i: F.char_length(F.get(parts, i)) + F.when(i > 0, F.char_length(F.get(found, i - 1))).otherwise(0))
                return _bound(folded(steps, lambda a, b: a + b), lambda begins: F.transform(found, lambda m, i: F.struct(F.get(begins, i).alias("begin"), (F.get(begins, i) + F.char_length(m)).alias("end"), r["priority"].alias("priority"), r["label"].alias("label"), r["weight"].alias("weight"), r["rule"].alias("rule"))))

            return F.when(F.size(found) > 0, _bound(F.split(words, r["pattern"], -1), each)).otherwise(F.array().cast(f"array<{FOUND}>"))

        return _bound(F.regexp_extract_all(words, r["pattern"], F.lit(0)), placed)

    return F.flatten(F.transform(F.filter(near, lambda r: F.contains(words, r["keyword"]) & F.contains(words, r["also"])), of_rule))


#: Priorities are 1, the best, to this.
PRIORITIES = 5


def unsuppressed(found: Column) -> Column:
    """Without detections that lie within another of better priority, or of equal priority and longer or listed first;
    by place.

    Sorted by begin, then longest, best and first listed, all that can hold a detection stand before it; it is dropped
    if any of them of its priority or a better one ends no earlier.
    """
    sortable = F.transform(found, lambda d, i: F.struct(d["begin"].alias("begin"), (-d["end"]).alias("back"), d["priority"].alias("priority"), i.alias("i"), d["label"].alias("label"), d["weight"].alias("weight"), d["rule"].alias("rule")))

    def swept(held):
        ends = F.transform(held, lambda d: F.struct(*(F.when(d["priority"] <= p, -d["back"]).otherwise(-1).alias(f"p{p}") for p in range(1, PRIORITIES + 1))))
        furthest = folded(ends, lambda a, b: F.struct(*(F.greatest(a[f"p{p}"], b[f"p{p}"]).alias(f"p{p}") for p in range(1, PRIORITIES + 1))))

        def kept(before):
            def stays(d, i):
                last = F.get(before, i - 1)
                own = F.lit(-1)
                for p in range(PRIORITIES, 0, -1):
                    own = F.when(d["priority"] == p, last[f"p{p}"]).otherwise(own)
                return (i == 0) | (own < -d["back"])

            return F.filter(held, stays)

        return _bound(furthest, kept)

    return F.when(F.size(found) < 2, found).otherwise(F.transform(_bound(F.sort_array(sortable), swept), lambda d: F.struct(d["begin"].alias("begin"), (-d["back"]).alias("end"), d["priority"].alias("priority"), d["label"].alias("label"), d["weight"].alias("weight"), d["rule"].alias("rule"))))


def scan(docs: DataFrame, all_rules: list[Rule] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) for each row of docs.

    n_base counts every place where a base phrase's words stand in a row; first_word and last_word are the smallest
    and largest of their starts, null without any. labels are those of base phrases and of the detections that stay;
    score is the chance that one of the detections is right, taking their weights as independent, and 0.5 where only
    a base phrase was found. Null counts as the empty text. Repeated rows each get their row.
    """
    all_rules = all_rules if all_rules is not None else rules()
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n_words", F.regexp_count("text", F.lit(WORD)).cast("long"))
    # where the gate is shut the words are left out: no phrase and no rule can match
    rows = rows.withColumn("_words", F.when(may_match(F.col("text")), words_only(F.col("text"))))

    parts = {p: F.split(F.col("_words"), f"(?<= ){p}(?= )", -1) for p in BASE}
    base = F.array(*(F.struct(F.lit(label).alias("label"), (F.size(x) - 1).alias("n"), (_spaces(F.get(x, F.lit(0))) - 1).alias("first"), (F.col("n_words") - (_spaces(F.element_at(x, -1)) - 1) - len(p.split())).alias("last")) for (p, label), x in zip(BASE.items(), parts.values(), strict=True)))
    rows = rows.withColumn("_base", F.when(F.col("_words").isNotNull(), F.filter(base, lambda b: b["n"] > 0)).otherwise(F.array().cast("array<struct<label:string,n:int,first:int,last:bigint>>")))
    kept = F.when(F.col("_words").isNotNull(), _bound(detections(F.col("_words"), all_rules), unsuppressed)).otherwise(F.array().cast(f"array<{FOUND}>"))
    rows = rows.select("doc_id", "n_words", "_base", kept.alias("detections"))
    of_base = F.transform("_base", lambda b: b["label"])
    of_rules = F.transform("detections", lambda d: d["label"])
    missed = F.aggregate("detections", F.lit(1.0), lambda p, d: p * (1 - d["weight"]))
    return rows.select(
        "doc_id",
        "n_words",
        F.aggregate("_base", F.lit(0).cast("long"), lambda n, b: n + b["n"]).alias("n_base"),
        F.array_min(F.transform("_base", lambda b: b["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_base", lambda b: b["last"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(of_base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(of_base, of_rules))), ",").alias("labels"),
        F.when(F.size("detections") > 0, 1 - missed).when(F.size("_base") > 0, 0.5).otherwise(0.0).alias("score"),
        "detections",
    )



"""Licence scan by sentences and notices, ordered rules. DataFrame functions only.

A text is normalised: lower case, runs of anything but letters and digits become one
space, or one line feed where they hold a line end or follow the end of a sentence.
Known sentences are recognised anywhere in it, from left to right, of those that begin
in one place the longest; they may run over lines and need no final mark. Titles count
only as a line of their own or, for "The MIT License", at the begin of one. A notice is
a lead ("this project is licensed under the terms of the", "released under", ...) and a
name or SPDX identifier of a licence; "or", "and" add more. Holders of the BSD
endorsement clause may be anyone of up to 40 words.

The identifiers found, in order, are matched against the ordered rules: a rule is a
sequence of identifiers and names a licence; longer sequences come first, and what a
rule has matched is used up. The licences known are those of LICENSES and RULES.

Scale: one scan without a shuffle; the tables are constants.

Edge cases: null and empty texts have no licence; repeated rows and null ids get a row
each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices, by identifier.
SENTENCES = {
    "mit_name": "The MIT License",
    "mit_under": "Released under the MIT License",
    "mit_licensed": "Licensed under the MIT License",
    "mit_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    "mit_notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit_as_is": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "mit_liable": "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    "apache_under": "Licensed under the Apache License, Version 2.0",
    "apache_the": "Licensed under the Apache License, Version 2.0 (the \"License\")",
    "apache_comply": "you may not use this file except in compliance with the License",
    "apache_obtain": "You may obtain a copy of the License at",
    "apache_basis": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "apache_see": "See the License for the specific language governing permissions and limitations under the License",
    "gpl3_work": "This work is licensed under the GNU General Public License, version 3",
    "gpl2_work": "This work is licensed under the GNU General Public License, version 2",
    "gpl_redistribute": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl2_redistribute": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "gpl_hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl_details": "See the GNU General Public License for more details",
    "gpl_received": "You should have received a copy of the GNU General Public License along with this program",
    "bsd_permitted": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd_source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
    "bsd_binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
    "bsd_endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc_grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "cc_by": "Licensed under CC BY 4.0",
    "cc_by_sa": "Licensed under CC BY-SA 4.0",
    "cc_by_nc": "Licensed under CC BY-NC 4.0",
    "cc_by_nd": "Licensed under CC BY-ND 4.0",
    "cc_by_long": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc_by_sa_long": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc_by_nc_long": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc_zero": "To the extent possible under law, the author has dedicated all copyright and related rights to this work to the public domain worldwide",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "mpl_subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "reserved": "All rights reserved",
    "spdx_mit": "SPDX-License-Identifier: MIT",
    "spdx_apache": "SPDX-License-Identifier: Apache-2.0",
    "spdx_gpl3": "SPDX-License-Identifier: GPL-3.0-only",
    "spdx_gpl3_later": "SPDX-License-Identifier: GPL-3.0-or-later",
    "spdx_gpl2": "SPDX-License-Identifier: GPL-2.0-only",
    "spdx_bsd3": "SPDX-License-Identifier: BSD-3-Clause",
    "spdx_bsd2": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx_mpl": "SPDX-License-Identifier: MPL-2.0",
    "mit0_grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "apache_asf": "licenses this file to you under the Apache License, Version 2.0 (the \"License\")",
    "gpl_linux": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation",
    "any_hope": "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "lgpl_details": "See the GNU Lesser General Public License for more details",
    "agpl_details": "See the GNU Affero General Public License for more details",
    "bsd_advertise": "All advertising materials mentioning features or use of this software must display the following acknowledgement",
    "bsd_author": "The name of the author may not be used to endorse or promote products derived from this software without specific prior written permission",
    "isc_plain": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "zero_bsd": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "zlib_grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "boost_grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    "mpl1_subject": "The contents of this file are subject to the Mozilla Public License Version 1.1",
    "cddl_subject": "The contents of this file are subject to the terms of the Common Development and Distribution License",
    "epl1_made": "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",
    "wtfpl_title": "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE",
    "cc_zero_waived": "the person who associated CC0 with this work has waived all copyright and related or neighboring rights to this work",
    "cc_zero_url": "creativecommons.org/publicdomain/zero/1.0",
}
# The rules, by licence; of two sequences that fit, the longer one holds.
RULES = [
    ("MIT", ["mit_name", "mit_grant", "mit_notice", "mit_as_is", "mit_liable"]),
    ("MIT", ["mit_grant", "mit_notice", "mit_as_is", "mit_liable"]),
    ("MIT", ["mit_grant", "mit_notice"]),
    ("MIT", ["mit_grant"]),
    ("MIT", ["mit_name"]),
    ("MIT", ["mit_under"]),
    ("MIT", ["mit_licensed"]),
    ("MIT", ["spdx_mit"]),
    ("Apache-2.0", ["apache_the", "apache_comply", "apache_obtain", "apache_basis", "apache_see"]),
    ("Apache-2.0", ["apache_the", "apache_comply", "apache_obtain"]),
    ("Apache-2.0", ["apache_the"]),
    ("Apache-2.0", ["apache_under"]),
    ("Apache-2.0", ["spdx_apache"]),
    ("GPL-3.0-or-later", ["gpl_redistribute", "gpl_hope", "gpl_details", "gpl_received"]),
    ("GPL-3.0-or-later", ["gpl_redistribute"]),
    ("GPL-2.0-or-later", ["gpl2_redistribute", "gpl_hope", "gpl_details", "gpl_received"]),
    ("GPL-2.0-or-later", ["gpl2_redistribute"]),
    ("GPL-3.0-only", ["gpl3_work"]),
    ("GPL-2.0-only", ["gpl2_work"]),
    ("GPL-3.0-only", ["spdx_gpl3"]),
    ("GPL-3.0-or-later", ["spdx_gpl3_later"]),
    ("GPL-2.0-only", ["spdx_gpl2"]),
    ("BSD-3-Clause", ["bsd_permitted", "bsd_source", "bsd_binary", "bsd_endorse"]),
    ("BSD-2-Clause", ["bsd_permitted", "bsd_source", "bsd_binary"]),
    ("BSD-3-Clause", ["spdx_bsd3"]),
    ("BSD-2-Clause", ["spdx_bsd2"]),
    ("ISC", ["isc_grant"]),
    ("CC-BY-4.0", ["cc_by"]),
    ("CC-BY-4.0", ["cc_by_long"]),
    ("CC-BY-SA-4.0", ["cc_by_sa"]),
    ("CC-BY-SA-4.0", ["cc_by_sa_long"]),
    ("CC-BY-NC-4.0", ["cc_by_nc"]),
    ("CC-BY-NC-4.0", ["cc_by_nc_long"]),
    ("CC-BY-ND-4.0", ["cc_by_nd"]),
    ("CC0-1.0", ["cc_zero"]),
    ("Unlicense", ["unlicense"]),
    ("MPL-2.0", ["mpl_subject"]),
    ("MPL-2.0", ["spdx_mpl"]),
    ("MIT-0", ["mit0_grant"]),
    ("Apache-2.0", ["apache_asf", "apache_comply", "apache_obtain", "apache_basis", "apache_see"]),
    ("Apache-2.0", ["apache_asf"]),
    ("GPL-2.0-only", ["gpl_linux"]),
    ("BSD-4-Clause", ["bsd_permitted", "bsd_source", "bsd_binary", "bsd_advertise", "bsd_endorse"]),
    ("BSD-3-Clause", ["bsd_permitted", "bsd_source", "bsd_binary", "bsd_author"]),
    ("ISC", ["isc_plain"]),
    ("0BSD", ["zero_bsd"]),
    ("Zlib", ["zlib_grant"]),
    ("BSL-1.0", ["boost_grant"]),
    ("MPL-1.1", ["mpl1_subject"]),
    ("CDDL-1.0", ["cddl_subject"]),
    ("EPL-1.0", ["epl1_made"]),
    ("WTFPL", ["wtfpl_title"]),
    ("CC0-1.0", ["cc_zero_waived"]),
    ("CC0-1.0", ["cc_zero_url"]),
]


def normal(text: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", re.sub(r"([0-9])\+", r"\1 or later ", text.lower())).strip()


def _gnu() -> dict[str, list[str]]:
    """Names of the GNU licences, of one version and of that or a later one."""
    found: dict[str, list[str]] = {}
    for short, middle, versions in (("gpl", "", ("1.0", "2.0", "3.0")), ("lgpl", "lesser ", ("2.1", "3.0")), ("lgpl", "library ", ("2.0", "2.1")), ("agpl", "affero ", ("3.0",))):
        for v in versions:
            long = f"gnu {middle}general public"
            names = [f"{name} {n}" for n in {v, v.removesuffix(".0")} for name in (long, f"{long} {short}", f"{middle}general public", f"gnu {short}", short)]
            names += [f"{gnu}{short}{mark}{n}" for n in {v, v.removesuffix(".0")} for mark in ("", "v") for gnu in ("", "gnu ")]
            found.setdefault(f"{short.upper()}-{v}-only", []).extend([*names, *(f"{n} only" for n in names)])
            found.setdefault(f"{short.upper()}-{v}-or-later", []).extend(f"{n} {_LATER}" for n in names)
    return found


def _creative() -> dict[str, list[str]]:
    nc, sa = ("NonCommercial", "Non-Commercial"), ("ShareAlike", "Share Alike")
    nd = ("NoDerivatives", "NoDerivs", "No Derivatives", "No Derivative Works")
    tails = {"BY": [""], "BY-SA": [*sa], "BY-ND": [*nd], "BY-NC": [*nc], "BY-NC-SA": [f"{x} {y}" for x in nc for y in sa], "BY-NC-ND": [f"{x} {y}" for x in nc for y in nd]}
    found = {}
    for code, names in tails.items():
        for v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
            found[f"CC-{code}-{v}"] = [f"{n} {v}" for n in (*(f"Creative Commons Attribution {x}".strip() for x in names), f"CC {code}", f"Creative Commons {code}")]
    return found


#: In names: "or any later version" and its like as one word.
_LATER = "orlater"
# Names of public licences, by SPDX identifier; the identifier is a name too. "License", "version", "v" and FILLERS may stand anywhere in them.
LICENSES: dict[str, list[str]] = {
    "MIT": ["Expat"],
    "MIT-0": ["MIT No Attribution"],
    "Apache-2.0": ["Apache 2", "Apache Software 2.0", "Apache Software 2", "Apache2", "ASL 2.0"],
    "Apache-1.1": ["Apache Software 1.1"],
    **_gnu(),
    "BSD-2-Clause": ["2-Clause BSD", "two clause BSD", "BSD two clause", "Simplified BSD", "FreeBSD"],
    "BSD-3-Clause": ["3-Clause BSD", "three clause BSD", "BSD three clause", "New BSD", "Modified BSD", "Revised BSD"],
    "BSD-4-Clause": ["4-Clause BSD", "four clause BSD", "Original BSD"],
    "0BSD": ["Zero-Clause BSD", "BSD Zero Clause"],
    "ISC": [],
    "Zlib": [],
    "BSL-1.0": ["Boost Software 1.0", "Boost Software"],
    "MPL-1.1": ["Mozilla Public 1.1"],
    "MPL-2.0": ["Mozilla Public 2.0", "Mozilla Public 2", "MPL 2"],
    "EPL-1.0": ["Eclipse Public 1.0", "Eclipse Public 1"],
    "EPL-2.0": ["Eclipse Public 2.0", "Eclipse Public 2"],
    "CDDL-1.0": ["Common Development and Distribution 1.0"],
    "CDDL-1.1": ["Common Development and Distribution 1.1"],
    "EUPL-1.2": ["European Union Public 1.2"],
    "Artistic-2.0": [],
    "OFL-1.1": ["SIL Open Font 1.1", "Open Font 1.1", "SIL OFL 1.1"],
    "PostgreSQL": [],
    "PSF-2.0": ["Python Software Foundation 2", "PSF"],
    "MS-PL": ["Microsoft Public"],
    "WTFPL": ["Do What The Fuck You Want To Public"],
    "Unlicense": [],
    "CC0-1.0": ["CC0", "Creative Commons Zero 1.0", "Creative Commons CC0", "Creative Commons CC0 1.0"],
    **_creative(),
}
FILLERS = ("license", "licence", "version", "v", "international", "unported", "generic", "universal")
# Titles and the licences that they name.
TITLES = {"MIT License": "MIT", "BSD 2-Clause License": "BSD-2-Clause", "BSD 3-Clause License": "BSD-3-Clause", "ISC License": "ISC", "zlib License": "Zlib", "Boost Software License - Version 1.0": "BSL-1.0"}
GNU_TERMS = {}
for _short, _middle, _ends in (("GPL", "", ("1", "2", "3")), ("LGPL", "Lesser ", ("2.1", "3")), ("LGPL", "Library ", ("2",)), ("AGPL", "Affero ", ("3",))):
    for _v in _ends:
        _spdx = f"{_short}-{_v}" if "." in _v else f"{_short}-{_v}.0"
        _begin = f"you can redistribute it and/or modify it under the terms of the GNU {_middle}General Public License as published by the Free Software Foundation"
        for _either in ("either version", "version"):
            for _of in ("", " of the License"):
                GNU_TERMS[normal(f"{_begin}, {_either} {_v}{_of}")] = f"{_spdx}-only"
                GNU_TERMS[normal(f"{_begin}, {_either} {_v}{_of}, or (at your option) any later version")] = f"{_spdx}-or-later"
                GNU_TERMS[normal(f"{_begin}, {_either} {_v}{_of}, or any later version")] = f"{_spdx}-or-later"
        GNU_TERMS[normal(f"you can redistribute it and/or modify it under the terms of the GNU {_middle}General Public License version {_v} as published by the Free Software Foundation")] = f"{_spdx}-only"

#: Normalised phrases that are found anywhere, and the names that follow a lead, each with its identifier.
_PHRASES = {normal(text): name for name, text in SENTENCES.items() if name not in ("mit_name", "bsd_endorse")}
_NAMES: dict[str, str] = {}
_HEADS = {"the mit license": "mit_name"}
_IDENTIFIERS: dict[str, str] = {}
for _spdx, _known in LICENSES.items():
    _IDENTIFIERS[f"notice_{_spdx}"] = _IDENTIFIERS[f"spdx_{_spdx}"] = _spdx
    for _name in [_spdx.replace("-or-later", f"-{_LATER}"), *_known]:
        _NAMES.setdefault(normal(_name), f"notice_{_spdx}")
for _text, _spdx in GNU_TERMS.items():
    _PHRASES.setdefault(_text, f"terms_{_spdx}")
    _IDENTIFIERS[f"terms_{_spdx}"] = _spdx
for _text, _spdx in TITLES.items():
    _IDENTIFIERS[f"title_{_spdx}"] = _spdx
for _spdx in _creative():
    _code, _v = _spdx.removeprefix("CC-").lower().rsplit("-", 1)
    _PHRASES[normal(f"creativecommons.org/licenses/{_code}/{_v}")] = f"url_{_spdx}"
    _IDENTIFIERS[f"url_{_spdx}"] = _spdx
_NAMES["apache 2 0 the"] = "apache_the"  # (the "License")
#: Identifiers of all kinds; rules of those that stand for a licence on their own follow the others.
NAMED = [*SENTENCES, *_IDENTIFIERS]
_NUMBER = {name: i for i, name in enumerate(NAMED, 1)}
ALL_RULES = [*RULES, *((spdx, [name]) for name, spdx in _IDENTIFIERS.items())]
if unknown := [name for _, seq in ALL_RULES for name in seq if name not in _NUMBER]:
    raise ValueError(f"no sentence {unknown}")

_GAP = "[ \n]"


def _words(text: str) -> str:
    return text.replace(" ", _GAP)


_FILL = f"(?:of the license|{'|'.join(FILLERS)})"
_ANY_LATER = "or (?:at your option )?(?:any )?(?:later|newer|above|greater)(?: version)?"


def _trie(phrases: list[str], gap: str, word=lambda w: w) -> str:
    """A pattern of the phrases that takes the longest that fits."""
    tree: dict = {}
    for p in phrases:
        node = tree
        for w in p.split(" "):
            node = node.setdefault(w, {})
        node[""] = {}

    def made(node: dict) -> str:
        ways = []
        for w, below in node.items():
            if w:
                more = f"{gap}{made(below)}" if below.keys() != {""} else ""
                ways.append(f"{word(w)}\\b" + (f"(?:{more})?" if more and "" in below else more))
        return f"(?:{'|'.join(ways)})"

    return made(tree)


def _name_word(w: str) -> str:
    return {_LATER: _ANY_LATER, "the": "the license"}.get(w, f"v?{w}" if w.isdigit() else w)


_LEAD = _words(r"(?:this(?: [a-z0-9]+){1,4}? is )?(?:dual )?(?:made )?(?:(?:re)?licensed|released|distributed|available|published|provided|offered|covered) under (?:either of )?(?:(?:the|a|an) )?(?:(?:terms|conditions)(?: and conditions)? of )?(?:either )?(?:(?:the|a|an) )?")
_MORE = _words(r"(?:or|and) (?:or )?(?:(?:the|a|an) )?")
_SPDX = _words("spdx license identifier ")
_ENDORSE = _words(r"neither the names? of (?:[a-z0-9]+ ){1,40}?nor the names? of (?:[a-z0-9]+ ){1,10}?may be used to endorse or promote products derived from this software without specific prior written permission")


def pattern() -> str:
    inner = "do what the fuck you want to public"  # the only name with a "the" of its own
    names = _words(f"(?:{inner}|{_trie([n for n in _NAMES if n != inner], f' (?:{_FILL} )*', _name_word)})(?: {_FILL})*")
    heads = f"(?:^|(?<=\n))(?:{'|'.join(map(_words, _HEADS))}|(?:{'|'.join(_words(normal(t)) for t in TITLES)})(?=\n|$))"
    return f"(?:\\b(?:{_LEAD}|{_SPDX})|\\G{_GAP}{_MORE}){names}\\b|\\b(?:{_ENDORSE}|{heads}|{_words(_trie([*_PHRASES], ' '))})\\b"


def _anchors() -> list[str]:
    """Words of which every text with a match has one: found by taking the word that most of the phrases left have."""
    left = [set(p.split(" ")) for p in (*_PHRASES, *_HEADS, *map(normal, TITLES))]
    found = ["under", "spdx", "neither"]  # of notices, identifiers and the endorsement clause
    while left := [p for p in left if not any(a in w for a in found for w in p)]:
        counts: dict[str, int] = {}
        for p in left:
            for w in p:
                counts[w] = counts.get(w, 0) + 1
        found.append(max((w for w in counts if w.isalpha()), key=lambda w: (len(w) > 5, counts[w], len(w), w)))  # long words are rarer in other texts
    return found


ANCHORS = _anchors()


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of docs: keep, sentences (identifiers in order), licenses (names, in order of the rules), each an array."""
    told = docs.select(*keep, F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("_l"))
    # Only texts with an anchor are normalised and searched. Anchors are single words of letters, which normalising neither makes nor breaks.
    some = reduce(or_, (F.col("_l").contains(a) for a in ANCHORS))
    later = F.regexp_replace("_l", r"([0-9])\+", "$1 or later ")
    lines = F.regexp_replace(later, r"(?<=[.;:!?])\s+|[\r\n]+", "\n")
    clean = F.trim(F.regexp_replace(F.regexp_replace(lines, "[^a-z0-9\n]+", " "), " *\n[ \n]*", "\n"))
    met = told.select(*keep, F.when(some, F.regexp_extract_all(clean, F.lit(pattern()), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("_m"))
    phrases = {**{normal(t): n for n, t in SENTENCES.items()}, **_PHRASES, **_HEADS, **{normal(t): f"title_{x}" for t, x in TITLES.items()}}
    table = lambda d: F.create_map(*(F.lit(x) for pair in d.items() for x in pair))
    exact, notice = table({t: _NUMBER[n] for t, n in phrases.items()}), table({t: _NUMBER[n] for t, n in _NAMES.items()})

    def number(raw):
        m = F.trim(F.translate(raw, "\n", " "))
        name = F.regexp_replace(m, f"^(?:{_LEAD}|{_SPDX}|{_MORE})", "")
        name = F.regexp_replace(F.regexp_replace(name, r"\bof the license\b", ""), rf"\b{_ANY_LATER}\b", _LATER)
        name = F.regexp_replace(F.regexp_replace(name, rf"\b(?:{'|'.join(FILLERS)})\b", ""), r"\bv(?=[0-9])", "")
        name = F.trim(F.regexp_replace(name, " +", " "))
        return F.coalesce(exact[m], F.when(m.startswith("neither the name"), F.lit(_NUMBER["bsd_endorse"])), notice[name])

    listed = met.select(*keep, F.transform("_m", number).alias("ids"))
    # A sequence as text: every identifier between bars of its own, so that one rule is replaced without touching its neighbours.
    listed = listed.withColumn("_s", F.array_join(F.transform("ids", lambda x: F.concat(F.lit("|"), x.cast("string"), F.lit("|"))), ""))
    ordered = sorted(ALL_RULES, key=lambda r: -len(r[1]))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit("".join(f"|{_NUMBER[x]}|" for x in seq)).alias("seq")) for name, seq in ordered))
    start = F.struct(F.col("_s").alias("rest"), F.array().cast("array<string>").alias("names"))

    def step(acc, rule):
        has = acc["rest"].contains(rule["seq"])
        return F.struct(F.when(has, F.replace(acc["rest"], rule["seq"], F.lit("-"))).otherwise(acc["rest"]).alias("rest"), F.when(has, F.array_append(acc["names"], rule["name"])).otherwise(acc["names"]).alias("names"))

    matched = F.when(F.size("ids") > 0, F.aggregate(rules, start, step)["names"]).otherwise(F.array().cast("array<string>"))
    names = F.array(*(F.lit(n) for n in NAMED))
    return listed.select(*keep, F.transform("ids", lambda x: F.get(names, x - 1)).alias("sentences"), F.array_distinct(matched).alias("licenses"))


def digest(scanned: DataFrame) -> DataFrame:
    return scanned.select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"), F.array_join(F.sort_array("licenses"), ",").alias("licenses"))

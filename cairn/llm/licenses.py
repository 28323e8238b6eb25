"""License scans by ordered signature rules.

Texts are read as words of ASCII letters, digits and non-ASCII characters, lower-cased and joined by one space. Rules
are regular expressions over that form; each has keywords, and only rules whose keywords an Aho-Corasick pass
has seen are tried. Overlapping detections are settled by interval containment: a detection that lies inside a longer
one, or covers the same words with a lower priority, is dropped. The base phrases are always kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import text_slices

#: Phrases whose consecutive words always count, and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: label, SPDX names, and how texts name the licence (regular expressions over the joined words).
FAMILIES = (
    ("mit", "mit", "mit|expat|mit x11"),
    ("mit-0", "mit 0", "mit no attribution|mit 0"),
    ("apache-1.1", "apache 1 1", "apache (?:software )?(?:v|version )?1 1"),
    ("apache-2", "apache 2 0", "apache(?: software)?(?: license)?(?: v| version| version v)? ?2(?: 0)?"),
    ("bsd-2-clause", "bsd 2 clause", "bsd 2 clause|2 clause bsd|simplified bsd|freebsd"),
    ("bsd-3-clause", "bsd 3 clause", "bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd"),
    ("bsd-4-clause", "bsd 4 clause", "bsd 4 clause|4 clause bsd|original bsd"),
    ("0bsd", "0bsd", "zero clause bsd|0bsd|bsd zero clause"),
    ("gpl-1", "gpl 1 0(?: only| or later)?", "(?:gnu )?(?:general public license|gpl)(?: v| version)? ?1(?: 0)?"),
    ("gpl-2", "gpl 2 0(?: only| or later)?", "(?:gnu )?(?:general public license|gpl)(?: v| version)? ?2(?: 0)?"),
    ("gpl-3", "gpl 3 0(?: only| or later)?", "(?:gnu )?(?:general public license|gpl)(?: v| version)? ?3(?: 0)?"),
    ("lgpl-2", "lgpl 2 0(?: only| or later)?", "(?:gnu )?(?:library general public license|lgpl)(?: v| version)? ?2(?: 0)?"),
    ("lgpl-2.1", "lgpl 2 1(?: only| or later)?", "(?:gnu )?(?:lesser general public license|lgpl)(?: v| version)? ?2 1"),
    ("lgpl-3", "lgpl 3 0(?: only| or later)?", "(?:gnu )?(?:lesser general public license|lgpl)(?: v| version)? ?3(?: 0)?"),
    ("agpl-3", "agpl 3 0(?: only| or later)?", "(?:gnu )?(?:affero general public license|agpl)(?: v| version)? ?3(?: 0)?"),
    ("gfdl", "gfdl 1 [123](?: only| or later)?", "gnu free documentation license|gfdl"),
    ("mpl-1.1", "mpl 1 1", "mozilla public license(?: v| version)? ?1 1|mpl ?1 1"),
    ("mpl-2", "mpl 2 0", "mozilla public license(?: v| version)? ?2(?: 0)?|mpl ?2(?: 0)?"),
    ("epl-1", "epl 1 0", "eclipse public license(?: v| version)? ?1(?: 0)?|epl ?1 0"),
    ("epl-2", "epl 2 0", "eclipse public license(?: v| version)? ?2(?: 0)?|epl ?2 0"),
    ("eupl", "eupl 1 [12]", "european union public licen[cs]e|eupl"),
    ("cddl", "cddl 1 [01]", "common development and distribution license|cddl"),
    ("cpl", "cpl 1 0", "common public license"),
    ("artistic-1", "artistic 1 0", "artistic license(?: v| version)? ?1(?: 0)?"),
    ("artistic-2", "artistic 2 0", "artistic license(?: v| version)? ?2(?: 0)?"),
    ("isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?"),
    ("bsl-1", "bsl 1 0", "boost software license|boost license"),
    ("busl-1.1", "busl 1 1", "business source license"),
    ("sspl", "sspl 1 0", "server side public license|sspl"),
    ("elastic-2", "elastic 2 0", "elastic license"),
    ("unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl|do what the fuck you want to public license"),
    ("cc0", "cc0 1 0", "cc0|cc 0|creative commons zero"),
    ("cc-by", "cc by [1234] [05]", "cc by|creative commons attribution"),
    ("cc-by-sa", "cc by sa [1234] [05]", "cc by sa|creative commons attribution share ?alike"),
    ("cc-by-nd", "cc by nd [1234] [05]", "cc by nd|creative commons attribution no ?deriv(?:ative)?s?"),
    ("cc-by-nc", "cc by nc [1234] [05]", "cc by nc|creative commons attribution non ?commercial"),
    ("cc-by-nc-sa", "cc by nc sa [1234] [05]", "cc by nc sa|creative commons attribution non ?commercial share ?alike"),
    ("cc-by-nc-nd", "cc by nc nd [1234] [05]", "cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s?"),
    ("odbl", "odbl 1 0", "open database license|odbl"),
    ("odc-by", "odc by 1 0", "open data commons attribution"),
    ("pddl", "pddl 1 0", "public domain dedication and license|pddl"),
    ("ofl", "ofl 1 1", "sil open font license|open font license"),
    ("python-2", "python 2 0|psf 2 0", "python software foundation|psf"),
    ("php-3", "php 3 01?", "php(?: license)? ?3"),
    ("ruby", "ruby", "ruby"),
    ("openssl", "openssl", "openssl"),
    ("postgresql", "postgresql", "postgresql"),
    ("ms-pl", "ms pl", "microsoft public"),
    ("proprietary", "licenseref proprietary", "proprietary"),
)

#: Ways to state a licence: pattern with the place of its name, priority, confidence, keywords beside those of the name.
FORMS = (
    ("spdx license identifier {spdx}", 9, 1.0, "spdx"),
    ("(?:re)?(?:licensed|released|distributed|published|available|redistributed) under (?:the )?(?:terms of )?(?:the )?(?:{name})(?: (?:general )?(?:public )?licen[cs]e)?", 8, 0.95, "under"),
    ("(?:covered|governed) by (?:the )?(?:terms of )?(?:the )?(?:{name})(?: licen[cs]e)?", 7, 0.9, " by "),
    ("(?:under|see|read) (?:the )?(?:terms of )?(?:the )?(?:{name}) licen[cs]e", 6, 0.85, "licen"),
    ("(?:{name}) licen[cs]ed?", 5, 0.7, "licen"),
    ("licen[cs]es? (?:is |are )?(?:the )?(?:{name})", 4, 0.6, "licen"),
    ("(?:opensource org|spdx org) licenses (?:{spdx})", 7, 0.9, "licenses"),
)

#: Sentences that give a licence away without its name: pattern, label, priority, confidence, keyword.
SENTENCES = (
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit", 9, 0.95, "hereby granted"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc", 9, 0.95, "with or without fee"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", 8, 0.8, "redistribution and use"),
    ("neither the name of .{1,80}? nor the names of its contributors may be used to endorse", "bsd-3-clause", 9, 0.9, "neither the name"),
    ("all advertising materials mentioning features or use of this software must display", "bsd-4-clause", 9, 0.9, "advertising materials"),
    ("www apache org licenses license 2 0", "apache-2", 9, 0.95, "apache org"),
    ("you may not use this file except in compliance with the license", "apache-2", 6, 0.6, "except in compliance"),
    ("gnu (?:general|lesser general|affero general|library general) public license", "gpl", 3, 0.6, "public license"),
    ("(?:either )?version [123](?: 0)? of the license or at your option any later version", "gpl", 4, 0.6, "your option any later"),
    ("www gnu org licenses gpl (?:1|2|3) 0", "gpl", 7, 0.9, "gnu org"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2", 9, 1.0, "source code form"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl-2", 9, 0.9, "accompanying materials"),
    ("this is free and unencumbered software released into the public domain", "unlicense", 9, 1.0, "unencumbered"),
    ("dedicated to the public domain", "public-domain", 7, 0.8, "public domain"),
    ("(?:released|placed) (?:in|into) the public domain", "public-domain", 7, 0.8, "public domain"),
    ("creativecommons org publicdomain zero 1 0", "cc0", 9, 0.95, "creativecommons org"),
    ("creativecommons org licenses by [1234] [05]", "cc-by", 9, 0.95, "creativecommons org"),
    ("creativecommons org licenses by sa [1234] [05]", "cc-by-sa", 9, 0.95, "creativecommons org"),
    ("creativecommons org licenses by nc [1234] [05]", "cc-by-nc", 9, 0.95, "creativecommons org"),
    ("creativecommons org licenses by nd [1234] [05]", "cc-by-nd", 9, 0.95, "creativecommons org"),
    ("creativecommons org licenses by nc sa [1234] [05]", "cc-by-nc-sa", 9, 0.95, "creativecommons org"),
    ("creativecommons org licenses by nc nd [1234] [05]", "cc-by-nc-nd", 9, 0.95, "creativecommons org"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "mit", 5, 0.6, "merchantability"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions", "mit", 8, 0.85, "substantial portions"),
    ("except as contained in this notice the names? of .{1,80}? shall not be used in advertising", "x11", 9, 0.95, "used in advertising"),
    ("the software shall be used for good not evil", "json", 9, 1.0, "good not evil"),
    ("redistributions of source code must retain the (?:above )?copyright notice", "bsd", 7, 0.8, "must retain the"),
    ("redistributions in binary form must reproduce the above copyright notice", "bsd", 7, 0.8, "must reproduce the"),
    ("this product includes software developed by the university of california berkeley", "bsd-4-clause", 9, 0.95, "university of california"),
    ("this product includes software developed by the openssl project", "openssl", 9, 0.95, "openssl project"),
    ("this product includes cryptographic software written by eric young", "ssleay", 9, 0.95, "eric young"),
    ("this product includes software developed by the apache software foundation", "apache-1.1", 8, 0.8, "apache software foundation"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache-2", 8, 0.85, "as is basis"),
    ("subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide", "apache-2", 8, 0.8, "each contributor hereby"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", 8, 0.9, "free software you can"),
    ("this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license", "lgpl", 9, 0.95, "library is free software"),
    ("you should have received a copy of the gnu general public license", "gpl", 7, 0.85, "received a copy of the gnu"),
    ("you should have received a copy of the gnu (?:lesser|library) general public license", "lgpl", 8, 0.9, "received a copy of the gnu"),
    ("you should have received a copy of the gnu affero general public license", "agpl", 8, 0.9, "received a copy of the gnu"),
    ("interacting with it remotely through a computer network", "agpl-3", 8, 0.85, "remotely through a computer"),
    ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gfdl", 9, 0.95, "free documentation"),
    ("with no invariant sections no front cover texts and no back cover texts", "gfdl", 8, 0.85, "invariant sections"),
    ("the contents of this file are subject to the mozilla public license version 1 1", "mpl-1.1", 9, 1.0, "mozilla public license"),
    ("the contents of this file are subject to the terms of the common development and distribution license", "cddl", 9, 1.0, "common development and distribution"),
    ("the contents of this file are subject to the netscape public license", "npl", 9, 1.0, "netscape public"),
    ("the contents of this file are subject to the common public attribution license", "cpal", 9, 1.0, "public attribution license"),
    ("this software is provided as is without any express or implied warranty in no event will the authors be held liable", "zlib", 8, 0.85, "authors be held liable"),
    ("altered source versions must be plainly marked as such and must not be misrepresented", "zlib", 9, 0.95, "plainly marked as such"),
    ("this distribution is based on the work of the independent jpeg group", "ijg", 8, 0.85, "independent jpeg group"),
    ("permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation", "bsl-1", 9, 0.95, "accompanying documentation"),
    ("permission to use copy modify and distribute this software and its documentation for any purpose and without fee is hereby granted", "hpnd", 9, 0.9, "without fee is hereby granted"),
    ("permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted", "postgresql", 9, 0.95, "without a written agreement"),
    ("you can do whatever you want with this stuff if we meet some day", "beerware", 9, 1.0, "meet some day"),
    ("everyone is permitted to copy and distribute verbatim or modified copies of this license document", "wtfpl", 7, 0.7, "verbatim or modified"),
    ("anyone is free to copy modify publish use compile sell or distribute this software", "unlicense", 9, 0.95, "anyone is free to copy"),
    ("the person who associated a work with this deed has dedicated the work to the public domain", "cc0", 9, 0.95, "associated a work"),
    ("to the extent possible under law .{1,80}? has waived all copyright and related or neighboring rights", "cc0", 9, 0.95, "neighboring rights"),
    ("you must give appropriate credit provide a link to the license and indicate if changes were made", "cc-by", 7, 0.7, "appropriate credit"),
    ("you may not use the material for commercial purposes", "cc-by-nc", 7, 0.7, "commercial purposes"),
    ("if you remix transform or build upon the material you must distribute your contributions under the same license", "cc-by-sa", 7, 0.7, "same license"),
    ("if you remix transform or build upon the material you may not distribute the modified material", "cc-by-nd", 7, 0.7, "modified material"),
    ("made available under the open database license", "odbl", 9, 0.95, "open database"),
    ("contains information from .{1,80}? which is made available (?:here )?under the open data commons attribution license", "odc-by", 9, 0.95, "open data commons"),
    ("this font software is licensed under the sil open font license", "ofl", 9, 1.0, "font software"),
    ("no modified version of the font software may use the reserved font name", "ofl", 9, 0.95, "reserved font name"),
    ("this license agreement is between the python software foundation", "python-2", 9, 1.0, "python software foundation"),
    ("this product includes php software freely available from", "php-3", 9, 0.95, "php software"),
    ("you may redistribute your modifications of the software provided that you place your modifications in the public domain", "ruby", 7, 0.6, "place your modifications"),
    ("this license governs use of the accompanying software if you use the software you accept this license", "ms-pl", 8, 0.85, "governs use of the accompanying"),
    ("developed by .{1,120}? university of illinois", "ncsa", 7, 0.7, "university of illinois"),
    ("this software is governed by the cecill(?: [abc])? license under french law", "cecill", 9, 1.0, "cecill"),
    ("licensed under the eupl version 1 [12]", "eupl", 9, 1.0, "eupl"),
    ("licensed under the academic free license version [123] [01]", "afl", 9, 1.0, "academic free"),
    ("licensed under the open software license version [123] [01]", "osl", 9, 1.0, "open software license"),
    ("the licensor hereby grants you the right to copy modify create derivative works redistribute and make non production use", "busl-1.1", 9, 0.95, "non production use"),
    ("you may not provide the software to third parties as a hosted or managed service", "elastic-2", 9, 0.95, "managed service"),
    ("make the functionality of the program or a modified version available to third parties as a service", "sspl", 9, 0.95, "third parties as a service"),
    ("the license does not grant to you and the license does not include the right to sell the software", "commons-clause", 9, 0.95, "right to sell the software"),
    ("this is (?:an )?unpublished proprietary source code", "proprietary", 7, 0.8, "unpublished proprietary"),
    ("no part of this (?:publication|work|book) may be reproduced", "all-rights-reserved", 6, 0.7, "may be reproduced"),
    ("for (?:personal|internal) use only and may not be (?:copied|redistributed|resold)", "proprietary", 6, 0.6, "use only and may not"),
    ("for non ?commercial (?:research )?(?:and educational )?use only", "non-commercial", 5, 0.6, "use only"),
    ("all rights reserved", "all-rights-reserved", 2, 0.4, "all rights reserved"),
    ("unauthori[sz]ed (?:copying|reproduction|distribution) (?:of this file )?(?:via any medium )?is (?:strictly )?prohibited", "proprietary", 7, 0.8, "unauthori"),
    ("confidential and proprietary", "proprietary", 6, 0.7, "proprietary"),
)

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Rule(NamedTuple):
    label: str
    priority: int
    confidence: float
    keywords: tuple[str, ...]
    pattern: re.Pattern


class Found(NamedTuple):
    """A detection over the words [first, last]."""

    first: int
    last: int
    label: str
    priority: int
    confidence: float
    base: bool = False


def _keywords(name: str) -> tuple[str, ...]:
    """One plain piece of every alternative of a name."""
    plain = []
    depth, part = 0, ""
    for char in name + "|":
        depth += (char == "(") - (char == ")")
        if char == "|" and depth == 0:
            flat = re.sub(r"\(\?:.*?\)\??|\[.*?\]|.\?", "\0", part)
            plain.append(max((x.strip() for x in flat.split("\0")), key=len))
            part = ""
        else:
            part += char
    return tuple(plain)


@lru_cache(maxsize=1)
def rules() -> list[Rule]:
    """The rules in order of priority: every form of every family, then the sentences."""
    made = []
    for label, spdx, name in FAMILIES:
        for form, priority, confidence, keyword in FORMS:
            named = _keywords(spdx if "{spdx}" in form else name)
            pattern = form.replace("{spdx}", f"(?:{spdx})").replace("{name}", name)
            made.append(Rule(label, priority, confidence, (keyword, *named), re.compile(f"(?<= )(?:{pattern})(?= )")))
    for pattern, label, priority, confidence, keyword in SENTENCES:
        made.append(Rule(label, priority, confidence, (keyword,), re.compile(f"(?<= )(?:{pattern})(?= )")))
    return sorted(made, key=lambda r: (-r.priority, r.label))


class Scanner:
    """The compiled rules behind their keyword prefilter."""

    def __init__(self) -> None:
        self.rules = rules()
        self.gate: dict[str, list[int]] = {}  # a rule's first keyword opens it if one of the others is there as well
        self.automaton = ahocorasick.Automaton()
        for k, rule in enumerate(self.rules):
            self.gate.setdefault(rule.keywords[0], []).append(k)
        for word in {w for r in self.rules for w in r.keywords}:
            self.automaton.add_word(word, word)
        self.automaton.make_automaton()

    def scan(self, text: str) -> tuple[int, list[Found]]:
        """(number of words, detections left after suppression)."""
        words = text.encode("utf-8", "replace").translate(_WORDS).split(b" ")
        words = [w for w in words if w]
        joined = " " + b" ".join(words).decode("utf-8", "replace") + " "
        found: list[Found] = []
        gaps: np.ndarray | None = None

        def word_at(at: int) -> int:
            """The word that begins behind the space at a place of the joined text."""
            nonlocal gaps
            if gaps is None:
                gaps = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)
            return int(np.searchsorted(gaps, at))

        for phrase, label in BASE:
            at = joined.find(f" {phrase} ")
            while at >= 0:
                first = word_at(at)
                found.append(Found(first, first + phrase.count(" "), label, 10, 0.9, True))
                at = joined.find(f" {phrase} ", at + 1)
        seen = {w for _, w in self.automaton.iter(joined)}
        for word in seen & self.gate.keys():
            for k in self.gate[word]:
                rule = self.rules[k]
                if len(rule.keywords) == 1 or any(w in seen for w in rule.keywords[1:]):
                    for m in rule.pattern.finditer(joined):
                        first = word_at(m.start() - 1)
                        found.append(Found(first, first + m[0].count(" "), rule.label, rule.priority, rule.confidence))
        return len(words), suppress(found)


def suppress(found: list[Found]) -> list[Found]:
    """Detections in order of place; contained ones go, the base ones never do.

    One goes if another covers all its words and more, or the same words with a higher priority (then confidence,
    then the smaller label). In order of start and falling end, it is enough to hold the widest reach so far.
    """
    kept: list[Found] = []
    reach, owner = -1, None
    for x in sorted(set(found), key=lambda x: (x.first, -x.last, -x.priority, -x.confidence, x.label, not x.base)):
        inside = owner is not None and x.last <= reach
        if x.base or not inside:
            kept.append(x)
        if x.last > reach:
            reach, owner = x.last, x
    return kept


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner()


_FOUND = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("label", pa.string()), ("confidence", pa.float64()), ("base", pa.bool_())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scan = scanner().scan
    for batch in text_slices(batches, 1):
        rows = [scan(x.as_py() or "") for x in batch.column(1)]
        each = [[{"first": x.first, "last": x.last, "label": x.label, "confidence": x.confidence, "base": x.base} for x in found] for _, found in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array(each, _FOUND)], ["id", "n_words", "found"])


def scan(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_words, found``: the detections of every whole text, as structs (first, last, label, confidence, base).

    Words are numbered from 0. Detections with equal words keep the one of higher priority, then confidence, then the smaller
    label. The time grows with the length of a text, which is whole in memory. Null and empty texts have no words and no detection. Rows are scanned one by one:
    ids may be null or repeated, other columns are ignored, an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan, f"id {dict(rows.dtypes)['id']}, n_words long, found array<struct<first:bigint,last:bigint,label:string,confidence:double,base:boolean>>")

"""Licence scans: known sentences to identifiers, identifier sequences to ordered rules.

A text is cut into lines and sentences, and also into sentences across line ends, as licence texts are often wrapped.
Each normalised sentence (a-z and 0-9, single spaces) is looked up in a fixed table by its hash; the identifiers found,
in order, are matched against rules, each a list of identifiers that must follow one another, other sentences between
them allowed, but no unknown one where a longer rule has a sentence of its own.  Names (of holders, of what is licensed)
are slots of a sentence.  The longest rule speaks: a rule whose identifiers are all part of a longer rule that the text
meets is left out.  SPDX lines of one licence are sentences too; compound expressions are not taken apart.  A row never leaves its task; only texts with one of the anchor words, one of which every known sentence has,
are cut up.
"""

from __future__ import annotations

import re
import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices, normalised, by identifier.
SENTENCES = {
    1: "released under the mit license",
    2: "licensed under the mit license",
    3: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    4: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    5: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    6: "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    10: "licensed under the apache license version 2 0",
    11: "licensed under the apache license version 2 0 the license",
    12: "you may not use this file except in compliance with the license",
    13: "you may obtain a copy of the license at http www apache org licenses license 2 0",
    14: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    15: "see the license for the specific language governing permissions and limitations under the license",
    16: "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document",
    17: "licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license",
    20: "licensed under the gnu general public license version 3",
    21: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    22: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    23: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    24: "see the gnu general public license for more details",
    25: "licensed under the gnu general public license version 2",
    26: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    27: "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    28: "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    29: "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    30: "licensed under cc by nc 4 0",
    31: "licensed under cc by 4 0",
    32: "licensed under cc by sa 4 0",
    33: "licensed under a creative commons attribution 4 0 international license",
    34: "licensed under a creative commons attribution noncommercial 4 0 international license",
    35: "licensed under a creative commons attribution sharealike 4 0 international license",
    36: "see the gnu lesser general public license for more details",
    37: "see the gnu affero general public license for more details",
    38: "licensed under cc by nd 4 0",
    40: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    41: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    42: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    43: "neither the name of NAME nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    44: "this software is provided by NAME as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    46: "all advertising materials mentioning features or use of this software must display the following acknowledgement",
    49: "ENDORSEMENT",
    50: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    51: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
    52: "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies",
    60: "this source code form is subject to the terms of the mozilla public license v 2 0",
    61: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    62: "distributed under the boost software license version 1 0",
    63: "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    64: "licensed under the sil open font license version 1 1",
    65: "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed",
    70: "this is free and unencumbered software released into the public domain",
    71: "to the extent possible under law the author s have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    72: "you should have received a copy of the cc0 public domain dedication along with this software",
    73: "licensed under cc0 1 0",
    80: "this software is provided as is without any express or implied warranty",
    81: "in no event will the authors be held liable for any damages arising from the use of this software",
    90: "the gnu general public license is a free copyleft license for software and other kinds of works",
    91: "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed",
    92: "the licenses for most software are designed to take away your freedom to share and change it",
    93: "by contrast the gnu general public license is intended to guarantee your freedom to share and change free software to make sure the software is free for all its users",
    94: "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software",
    95: "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license supplemented by the additional permissions listed below",
    96: "this license the lesser general public license applies to some specially designated software packages typically libraries of the free software foundation and other authors who decide to use it",
    97: "contributor means each individual or legal entity that creates contributes to the creation of or owns covered software",
    98: "covered software means source code form to which the initial contributor has attached the notice in exhibit a the executable form of such source code form and modifications of such source code form in each case including portions thereof",
    82: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
}
# Rules by name, each a licence and the identifiers that follow one another.
RULES = {
    "mit-notice": ("MIT", (1,)),
    "mit-notice-2": ("MIT", (2,)),
    "mit-text": ("MIT", (3, 4, 5, 6)),
    "apache-2.0-notice": ("Apache-2.0", (10,)),
    "apache-2.0-header": ("Apache-2.0", (11, 12, 13, 14, 15)),
    "apache-2.0-text": ("Apache-2.0", (16, 17)),
    "gpl-3.0-text": ("GPL-3.0", (91, 90)),
    "gpl-2.0-text": ("GPL-2.0", (91, 92, 93)),
    "agpl-3.0-text": ("AGPL-3.0", (91, 94)),
    "lgpl-3.0-text": ("LGPL-3.0", (91, 95)),
    "lgpl-2.1-text": ("LGPL-2.1", (91, 92, 96)),
    "mpl-2.0-text": ("MPL-2.0", (97, 98)),
    "gpl-3.0-notice": ("GPL-3.0", (20,)),
    "gpl-3.0-header": ("GPL-3.0", (21, 23, 24)),
    "gpl-2.0-header": ("GPL-2.0", (22, 23, 24)),
    "gpl-2.0-notice": ("GPL-2.0", (25,)),
    "lgpl-2.1-header": ("LGPL-2.1", (26, 29, 36)),
    "lgpl-3.0-header": ("LGPL-3.0", (27, 29, 36)),
    "agpl-3.0-header": ("AGPL-3.0", (28, 23, 37)),
    "cc-by-nc-4.0-notice": ("CC-BY-NC-4.0", (30,)),
    "cc-by-nc-4.0-text": ("CC-BY-NC-4.0", (34,)),
    "cc-by-4.0-notice": ("CC-BY-4.0", (31,)),
    "cc-by-4.0-text": ("CC-BY-4.0", (33,)),
    "cc-by-sa-4.0-notice": ("CC-BY-SA-4.0", (32,)),
    "cc-by-sa-4.0-text": ("CC-BY-SA-4.0", (35,)),
    "cc-by-nd-4.0-notice": ("CC-BY-ND-4.0", (38,)),
    "bsd-2-clause": ("BSD-2-Clause", (40, 41, 42)),
    "bsd-2-clause-text": ("BSD-2-Clause", (40, 41, 42, 44)),
    "bsd-3-clause": ("BSD-3-Clause", (40, 41, 42, 43)),
    "bsd-3-clause-text": ("BSD-3-Clause", (40, 41, 42, 43, 44)),
    "bsd-4-clause-text": ("BSD-4-Clause", (46, 43, 44)),
    "isc-text": ("ISC", (50,)),
    "0bsd-text": ("0BSD", (51,)),
    "postgresql-text": ("PostgreSQL", (52,)),
    "mpl-2.0-notice": ("MPL-2.0", (60,)),
    "epl-2.0-notice": ("EPL-2.0", (61,)),
    "boost-1.0-notice": ("BSL-1.0", (62,)),
    "boost-1.0-text": ("BSL-1.0", (63,)),
    "ofl-1.1-notice": ("OFL-1.1", (64,)),
    "wtfpl-text": ("WTFPL", (65,)),
    "unlicense": ("Unlicense", (70,)),
    "cc0-1.0-header": ("CC0-1.0", (71, 72)),
    "cc0-1.0-notice": ("CC0-1.0", (73,)),
    "zlib-text": ("Zlib", (80, 81, 82)),
}
# Names that a licence goes by in SPDX lines beside its own, and licences known by these lines alone.
SPDX = {
    "GPL-2.0": ("GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-2.0+"), "GPL-3.0": ("GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "GPL-3.0+"),
    "LGPL-2.1": ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-2.1+"), "LGPL-3.0": ("LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "LGPL-3.0+"),
    "AGPL-3.0": ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later"),
}
ANCHORS = ("licen", "warrant", "copyright", "permi", "condition", "public domain", "redistribut", "liable", "covered software", "endorse", "advertising")


def normal(text: str) -> str:
    """a-z and 0-9 with single spaces."""
    return re.sub("[^a-z0-9]+", " ", text.lower()).strip()


for _k, _name in enumerate(dict.fromkeys(name for name, _ in list(RULES.values()))):
    for _j, _alias in enumerate(dict.fromkeys(map(normal, SPDX.get(_name, (_name,))))):
        SENTENCES[1000 + 10 * _k + _j] = f"spdx license identifier {_alias}"
        RULES[f"spdx-{_name.lower()}-{_j}" if _j else f"spdx-{_name.lower()}"] = (_name, (1000 + 10 * _k + _j,))

END = r"([.!?;:])[ \t\r\n]+"
#: Ends within known sentences, which are no cuts, and the URL lines of the Apache and Eclipse headers, which are some without a mark.  What may
#: stand before a line's words is what comments put there.
_GAP = r"\s+(?:[^A-Za-z0-9\s]+\s+)?"
WITHIN = [
    (rf"(?i)(this{_GAP}(?:program|library){_GAP}is{_GAP}free{_GAP}software)[:;]{_GAP}(you{_GAP}can)", "$1 $2"),
    (rf"(?i)(free{_GAP}software{_GAP}foundation);{_GAP}(either)", "$1 $2"),
    (rf"(?i)(without{_GAP}any{_GAP}warranty);{_GAP}(without{_GAP}even)", "$1 $2"),
    (rf"(?i)(mozilla{_GAP}public{_GAP}license,{_GAP}v)\.{_GAP}(2\.0)", "$1 $2"),
    (r"(?i)(at:?)[ \t]*[\r\n]+[^A-Za-z0-9]*(https?://www\.apache\.org/licenses/LICENSE-2\.0)[ \t]*[\r\n]", "$1 $2.\n"),
    (r"(?i)(https?://www\.eclipse\.org/legal/epl-2\.0/?)[ \t]*[\r\n]", "$1.\n"),
    (rf"(?i)(neither{_GAP}the{_GAP}names?{_GAP}of[^.!?;:]{{1,200}}(?:inc|ltd|corp|co|llc))\.(,?{_GAP}n?or)", "$1$2"),
    (rf"(?i)(software{_GAP}is{_GAP}provided{_GAP}by[^.!?;:]{{1,200}}(?:inc|ltd|corp|co|llc))\.(,?{_GAP})", "$1$2"),
    (r"(?i)(SPDX-License-Identifier):[ \t]+([A-Za-z0-9.+-]+)[ \t]*(?:\*/|-->)?[ \t]*(?:[\r\n]|$)", "$1 $2.\n"),
]
#: Slots of normalised sentences, in this order: marks of lists, who holds the rights, what is licensed, what stands before a
#: sentence without an end.  A sentence on endorsement that is no known clause is one of its own.
SLOTS = [
    (r"^[0-9a-z] (redistributions |all advertising |neither |the name )", "$1"),
    (
        r"^neither the names? of .{1,200} (?:nor|or) the names? of (?:its|their|his|her|any) (?:contributors|affiliates) may be used to endorse or promote products derived from this software without (?:specific )?prior written permission$",
        "neither the name of NAME nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    (
        r"^the names? of .{1,200} may not be used to endorse or promote products derived from this software without (?:specific )?prior written permission$",
        "neither the name of NAME nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ),
    (r"^all advertising materials mentioning features .*$", "all advertising materials mentioning features or use of this software must display the following acknowledgement"),
    (r"^[a-z0-9 ]*endorse or promote products[a-z0-9 ]*$|^neither the names? of [a-z0-9 ]*$", "ENDORSEMENT"),
    (r"^this software is provided by .{1,200} as is and any ", "this software is provided by NAME as is and any "),
    (r"^(?:this|the|all|our) (?:[a-z0-9]+ ){0,4}(?:is|are) (licensed|released|distributed) under ", "$1 under "),
    (r"^(licensed|released|distributed) under the terms of ", "$1 under "),
    (r"^.{0,200}(everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed)$", "$1"),
]
#: Rules that do not hold where one of these sentences is in the text.
BARRED = {"bsd-2-clause": (43, 46, 49), "bsd-2-clause-text": (43, 46, 49), "bsd-3-clause": (46,), "bsd-3-clause-text": (46,)}
#: A sentence of so many words or more that isn't known; the identifier 0 stands for a run of them.
UNKNOWN = r"^[a-z0-9]+(?: [a-z0-9]+){3}"

if missing := [i for i, text in SENTENCES.items() if not any(a in text.lower() for a in ANCHORS)]:
    raise ValueError(f"sentences without an anchor word: {missing}")


def _part_of(short: tuple[int, ...], long: tuple[int, ...]) -> bool:
    left = iter(long)
    return len(short) < len(long) and all(i in left for i in short)


def pattern(identifiers: tuple[int, ...], rules: dict[str, tuple[str, tuple[int, ...]]] | None = None) -> str:
    """A regular expression for lists of identifiers that hold these in order.

    Other sentences may stand between two of them, but no unknown one where a longer of ``rules`` has a sentence of its own.
    """
    inserted = set()
    for _, long in (rules or {}).values():
        if _part_of(identifiers, long):
            places = [long.index(i) for i in identifiers]
            inserted |= {k for k, (x, y) in enumerate(zip(places, places[1:])) if y - x > 1}
    out = f",{identifiers[0]},"
    for k, i in enumerate(identifiers[1:]):
        out += ("(?:[1-9][0-9]*,)*" if k in inserted else "(?:[0-9]+,)*") + f"{i},"
    return out


def covers(rules: dict[str, tuple[str, tuple[int, ...]]]) -> dict[str, list[str]]:
    """For each rule the longer rules that its identifiers are part of, in their order; for an SPDX line all others of its licence."""

    def speaks(name: str, other: str) -> bool:
        if name.startswith("spdx-"):
            return rules[name][0] == rules[other][0] and not other.startswith("spdx-")
        return _part_of(rules[name][1], rules[other][1])

    return {name: [other for other in rules if speaks(name, other)] for name in rules}


def lookup(sentences: dict[int, str]) -> tuple[Column, int]:
    """An array of (sentence, id) by CRC-32 modulo its size, and that size: no two sentences share a place."""
    hashes = {i: zlib.crc32(s.encode()) for i, s in sentences.items()}
    size = next(m for m in range(len(hashes), 1 << 24) if len({h % m for h in hashes.values()}) == len(hashes))
    places = dict.fromkeys(range(size), F.struct(F.lit(None).cast("string").alias("s"), F.lit(None).cast("int").alias("id")))
    places |= {h % size: F.struct(F.lit(sentences[i]).alias("s"), F.lit(i).alias("id")) for i, h in hashes.items()}
    return F.array(*places.values()), size


def sentence_ids(text: Column, sentences: dict[int, str], wrapped: bool) -> Column:
    """Identifiers of the known sentences of a text, in order, and 0 for each unknown one; short pieces are left out."""
    for inside, instead in WITHIN:
        text = F.regexp_replace(text, inside, instead)
    if wrapped:  # sentences go on over line ends, not over blank lines
        text = F.regexp_replace(F.regexp_replace(text, r"(?:\r?\n[ \t]*){2,}", "\x01"), r"[\r\n]+", " ")
    cut = F.split(F.regexp_replace(text, END, "$1\n"), "[\n\x01]")

    def plain(s: Column) -> Column:
        s = F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))
        for slot, instead in SLOTS:
            s = F.regexp_replace(s, slot, instead)
        return s

    known, size = lookup(sentences)

    def find(s: Column) -> Column:
        place = F.get(known, (F.crc32(s.cast("binary")) % size).cast("int"))
        return F.when(place["s"] == s, place["id"]).when(s.rlike(UNKNOWN), 0)

    return F.filter(F.transform(F.transform(cut, plain), find), lambda i: i.isNotNull())


def scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    sentences: dict[int, str] | None = None,
    rules: dict[str, tuple[str, tuple[int, ...]]] | None = None,
) -> DataFrame:
    """doc_id, rule, license and sentences (the identifiers found, comma-separated; SPDX lines with their own rules alone) for each rule that a text meets.

    A rule is reported once a row, from the cut by lines if that meets it, and not beside a longer rule that it is part
    of.  Null, empty and unlicensed texts give no row; rows that repeat an id repeat its findings; null ids are carried
    along; other columns are ignored; an empty table gives no rows.
    """
    sentences, rules = sentences or SENTENCES, rules or RULES
    text = F.col(text_col).cast("string")
    likely = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    likely = likely.filter(F.lower("text").rlike("|".join(map(re.escape, ANCHORS))))

    def listed(wrapped: bool) -> Column:
        ids = sentence_ids(F.col("text"), sentences, wrapped).cast("array<string>")
        return F.regexp_replace(F.concat(F.lit(","), F.array_join(ids, ","), F.lit(",")), "(?:,0)+,", ",0,")

    found = likely.select("doc_id", listed(False).alias("plain"), listed(True).alias("wrapped")).filter("plain rlike '[1-9]' or wrapped rlike '[1-9]'")

    def meets(name: str, way: str) -> Column:
        held = F.col(way).rlike(pattern(rules[name][1], rules))
        barred = BARRED.get(name)
        return held & ~F.concat("plain", "wrapped").rlike(f",(?:{'|'.join(map(str, barred))}),") if barred else held

    hit = {name: F.when(meets(name, "plain"), F.col("plain")).when(meets(name, "wrapped"), F.col("wrapped")) for name in rules}
    # a longer rule with an unknown sentence in place of its own is not met, but the shorter one is not meant either
    loosely = {name: F.col("plain").rlike(pattern(ids)) | F.col("wrapped").rlike(pattern(ids)) for name, (_, ids) in rules.items()}
    found = found.select("doc_id", *(h.alias(f"_{k}") for k, h in enumerate(hit.values())), *(h.alias(f"_loose{k}") for k, h in enumerate(loosely.values())))
    number = {name: k for k, name in enumerate(rules)}
    longer = covers(rules)

    def check(name: str) -> Column:
        silent = reduce(lambda a, b: a | b, (F.col(f"_loose{number[x]}") for x in longer[name]), F.lit(False))
        return F.struct(F.lit(name).alias("rule"), F.lit(rules[name][0]).alias("license"), F.when(~silent, F.col(f"_{number[name]}")).alias("found"))

    met = found.select("doc_id", F.inline(F.filter(F.array(*map(check, rules)), lambda x: x["found"].isNotNull())))
    texts = F.regexp_replace(F.col("found"), "(?:,1[0-9]{3})+,", ",")
    told = F.regexp_replace(F.when(F.col("rule").startswith("spdx-"), F.col("found")).otherwise(texts), ",0,", ",")
    return met.select("doc_id", "rule", "license", F.trim(told, F.lit(",")).alias("sentences"))


def oracle_sql() -> str:
    """The same rows in DuckDB SQL over documents."""
    known = ", ".join(f"({i}, '{s}')" for i, s in SENTENCES.items())
    rules = ", ".join(f"('{name}', '{licence}', '{pattern(ids, RULES)}', '{pattern(ids)}', '{','.join(map(str, BARRED.get(name, ())))}')" for name, (licence, ids) in RULES.items())
    longer = ", ".join(f"('{name}', '{other}')" for name, others in covers(RULES).items() for other in others)
    text = "text"
    for inside, instead in WITHIN:
        instead = instead.replace("$", "\\").replace("\n", "' || chr(10) || '")
        text = f"regexp_replace({text}, '{inside}', '{instead}', 'g')"
    plain = "trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g'))"
    for slot, instead in SLOTS:
        plain = f"regexp_replace({plain}, '{slot}', '{instead.replace('$', chr(92))}')"
    joined = r"regexp_replace(regexp_replace(text, '(?:\r?\n[ \t]*){2,}', chr(1), 'g'), '[\r\n]+', ' ', 'g')"
    return f"""
WITH texts AS (SELECT row_number() OVER () AS row_id, doc_id, {text} AS text FROM documents WHERE text IS NOT NULL),
cuts AS (SELECT row_id, doc_id, 0 AS way, text FROM texts UNION ALL SELECT row_id, doc_id, 1, {joined} FROM texts),
parts AS (SELECT row_id, doc_id, way, string_split(replace(regexp_replace(text, '([.!?;:])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(1), chr(10)), chr(10)) AS s FROM cuts),
pieces AS (SELECT row_id, doc_id, way, {plain} AS s, pos FROM (SELECT row_id, doc_id, way, unnest(s) AS s, unnest(range(len(s))) AS pos FROM parts)),
known(id, s) AS (VALUES {known}),
hits AS (SELECT row_id, doc_id, way, pos, coalesce(id, 0) AS id FROM pieces p LEFT JOIN known k ON p.s = k.s WHERE id IS NOT NULL OR regexp_matches(p.s, '{UNKNOWN}')),
found AS (SELECT row_id, doc_id, way, regexp_replace(',' || string_agg(id::VARCHAR, ',' ORDER BY pos) || ',', '(?:,0)+,', ',0,', 'g') AS ids FROM hits GROUP BY ALL),
rules(rule, license, pattern, loose, barred) AS (VALUES {rules}),
longer(rule, other) AS (VALUES {longer}),
present AS (SELECT DISTINCT row_id, id FROM hits WHERE id > 0),
barred AS (SELECT DISTINCT row_id, rule FROM (SELECT rule, unnest(string_split(barred, ','))::INTEGER AS id FROM rules WHERE barred <> '') JOIN present USING (id)),
met AS (SELECT row_id, doc_id, rule, license, trim(regexp_replace(CASE WHEN rule LIKE 'spdx-%' THEN ids ELSE regexp_replace(ids, '(?:,1[0-9]{{3}})+,', ',', 'g') END, ',0,', ',', 'g'), ',') AS sentences FROM found JOIN rules ON regexp_matches(ids, pattern) ANTI JOIN barred USING (row_id, rule)
  QUALIFY row_number() OVER (PARTITION BY row_id, rule ORDER BY way) = 1),
silent AS (SELECT f.row_id, l.rule FROM found f JOIN rules r ON regexp_matches(f.ids, r.loose) JOIN longer l ON l.other = r.rule)
SELECT doc_id, rule, license, sentences FROM met ANTI JOIN silent USING (row_id, rule)
"""

"""Licence scans by sentence rules.

A text is cut into sentences, each is normalised (lower case; runs of other characters
than letters, digits, ``.`` and ``+`` become one space; parts that vary from holder to
holder, as names and years, become a mark), and known sentences become licence-sentence
identifiers, in their order in the text. A tag ``SPDX-License-Identifier`` gives an
identifier for each known licence of its expression. Ordered rules are then matched
against the sequence of identifiers: the first rule whose sequence occurs names its
licence and takes those identifiers out, everywhere, before the next rule is tried.
Identifiers that no rule takes are reported as unmatched.

Everything is made of built-in string and array functions; a text without any word that
all known sentences share is passed over before it is cut.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised licence sentences and their identifiers.
SENTENCES = {
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "this project is licensed under the mit license": "MitRef",
    "the mit license": "MitTitle",
    "mit license": "MitTitle",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "MitGrant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "MitNotice",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "IscGrant",
    "licensed under the apache license version 2.0": "Apache2Ref",
    "licensed under the apache license version 2.0 the license": "Apache2Ref",
    "apache license version 2.0": "Apache2Title",
    "you may not use this file except in compliance with the license": "Apache2Comply",
    "you may obtain a copy of the license at": "Apache2Obtain",
    "see the license for the specific language governing permissions and limitations under the license": "Apache2See",
    "this work is licensed under the gnu general public license version 3": "Gpl3Ref",
    "licensed under the gnu general public license version 3": "Gpl3Ref",
    "this work is licensed under the gnu general public license version 2": "Gpl2Ref",
    "licensed under the gnu general public license version 2": "Gpl2Ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Gpl3Grant",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "Gpl2Grant",
    "see the gnu general public license for more details": "GplSee",
    "you should have received a copy of the gnu general public license along with this program": "GplCopy",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version": "Lgpl21Grant",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "BsdGrant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "BsdSource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "BsdBinary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "BsdEndorse",
    "licensed under cc by nc 4.0": "CcByNc4Ref",
    "licensed under cc by sa 4.0": "CcBySa4Ref",
    "licensed under cc by 4.0": "CcBy4Ref",
    "this work is licensed under a creative commons attribution 4.0 international license": "CcBy4Ref",
    "this work is licensed under a creative commons attribution noncommercial 4.0 international license": "CcByNc4Ref",
    "this work is licensed under a creative commons attribution sharealike 4.0 international license": "CcBySa4Ref",
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "Mpl2Ref",
    "this is free and unencumbered software released into the public domain": "UnlicenseRef",
    "all rights reserved": "AllRights",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "MitWarranty",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "IscWarranty",
    "isc license": "IscTitle",
    "bsd 2 clause license": "Bsd2Title",
    "bsd 3 clause license": "Bsd3Title",
    "apache license": "Apache2Head",
    "version 2.0 january 2004": "Apache2Version",
    "terms and conditions for use reproduction and distribution": "Apache2Terms",
    "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document": "Apache2Definition",
    "gnu general public license": "GplTitle",
    "gnu lesser general public license": "LgplTitle",
    "gnu affero general public license": "AgplTitle",
    "version 3 29 june 2007": "Version3",
    "version 2 june 1991": "Version2",
    "version 2.1 february 1999": "Version21",
    "version 3 19 november 2007": "VersionA3",
    "the gnu general public license is a free copyleft license for software and other kinds of works": "Gpl3Preamble",
    "the licenses for most software are designed to take away your freedom to share and change it": "Gpl2Preamble",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Agpl3Grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "Lgpl3Grant",
    "mozilla public license version 2.0": "Mpl2Title",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla.org mpl 2.0": "Mpl2Obtain",
    "eclipse public license v 2.0": "Epl2Title",
    "boost software license version 1.0 august 17th 2003": "BoostTitle",
    "this software is provided as is without any express or implied warranty": "ZlibWarranty",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "ZlibGrant",
    "cc0 1.0 universal": "Cc0Title",
    "creative commons legal code": "CcCode",
}
# Identifiers of the SPDX list that tags may name.
SPDX = (
    "MIT", "MIT-0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "0BSD", "ISC", "Zlib", "BSL-1.0", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
    "MPL-2.0", "EPL-2.0", "Artistic-2.0", "WTFPL", "PostgreSQL", "Python-2.0",
)
# Ordered rules. A licence and the sequence of identifiers that states it.
RULES = (
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("BSD-3-Clause", ("Bsd3Title",)),
    ("BSD-2-Clause", ("Bsd2Title",)),
    ("MIT", ("MitTitle", "MitGrant", "MitNotice", "MitWarranty")),
    ("MIT", ("MitGrant", "MitNotice", "MitWarranty")),
    ("MIT", ("MitTitle", "MitGrant", "MitNotice")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("ISC", ("IscTitle", "IscGrant", "IscWarranty")),
    ("ISC", ("IscGrant", "IscWarranty")),
    ("ISC", ("IscGrant",)),
    ("ISC", ("IscTitle",)),
    ("Zlib", ("ZlibWarranty", "ZlibGrant")),
    ("Apache-2.0", ("Apache2Head", "Apache2Version", "Apache2Terms", "Apache2Definition")),
    ("Apache-2.0", ("Apache2Head", "Apache2Version")),
    ("Apache-2.0", ("Apache2Ref", "Apache2Comply", "Apache2Obtain", "Apache2See")),
    ("Apache-2.0", ("Apache2Ref", "Apache2Comply", "Apache2Obtain")),
    ("Apache-2.0", ("Apache2Ref",)),
    ("Apache-2.0", ("Apache2Title",)),
    ("GPL-3.0-or-later", ("Gpl3Grant", "GplSee", "GplCopy")),
    ("GPL-3.0-or-later", ("Gpl3Grant",)),
    ("GPL-2.0-or-later", ("Gpl2Grant", "GplSee", "GplCopy")),
    ("GPL-2.0-or-later", ("Gpl2Grant",)),
    ("GPL-3.0-only", ("Gpl3Ref",)),
    ("GPL-2.0-only", ("Gpl2Ref",)),
    ("LGPL-2.1-or-later", ("Lgpl21Grant",)),
    ("LGPL-3.0-or-later", ("Lgpl3Grant",)),
    ("AGPL-3.0-or-later", ("Agpl3Grant",)),
    ("GPL-3.0-only", ("GplTitle", "Version3", "Gpl3Preamble")),
    ("GPL-3.0-only", ("GplTitle", "Version3")),
    ("GPL-2.0-only", ("GplTitle", "Version2", "Gpl2Preamble")),
    ("GPL-2.0-only", ("GplTitle", "Version2")),
    ("LGPL-3.0-only", ("LgplTitle", "Version3")),
    ("LGPL-2.1-only", ("LgplTitle", "Version21")),
    ("AGPL-3.0-only", ("AgplTitle", "VersionA3")),
    ("MIT", ("MitRef",)),
    ("MIT", ("MitTitle",)),
    ("CC-BY-NC-4.0", ("CcByNc4Ref",)),
    ("CC-BY-SA-4.0", ("CcBySa4Ref",)),
    ("CC-BY-4.0", ("CcBy4Ref",)),
    ("MPL-2.0", ("Mpl2Ref", "Mpl2Obtain")),
    ("MPL-2.0", ("Mpl2Ref",)),
    ("MPL-2.0", ("Mpl2Title",)),
    ("EPL-2.0", ("Epl2Title",)),
    ("BSL-1.0", ("BoostTitle",)),
    ("CC0-1.0", ("CcCode", "Cc0Title")),
    ("CC0-1.0", ("Cc0Title",)),
    ("Unlicense", ("UnlicenseRef",)),
)
#: Each known sentence holds one of these, so a text that holds none has no known sentence.
TRIGGERS = ("licens", "permi", "copyright", "redistribut", "public domain", "all rights", "neither the name", "merchantab", "warrant", "conditions for use", "june 2007", "june 1991", "february 1999", "november 2007", "january 2004", "cc0", "creative commons", "mpl")

#: Ends of sentences. A line feed within a sentence (wrapped lines) is a space, but not before a new capitalised line, a blank line or a list or comment mark.
NEW_LINE = r"\n[ \t]*(?:[*#/;>-]+[ \t]*)?([A-Z][a-z]|\n|[0-9]+[.)])"
END = r"[.!?;:][\x22')]*(?:[ \t\r\n]+|$)|[\x01]"
OTHER = r"[^a-z0-9.+]+"
EDGE = r"^[ .]+|[ .]+$"
#: Parts of normalised sentences that vary, with what they become.
VARIABLES = (
    (r"^version 2[.]0 january 2004 https? www[.]apache[.]org licenses$", "version 2.0 january 2004"),
    (r"^neither the names? of .{1,120} nor the names of (?:its|their|other) contributors may be used", "neither the name of the copyright holder nor the names of its contributors may be used"),
    (r"^(?:the name of .{1,120} may not|neither the name of .{1,120} may) be used to endorse", "neither the name of the copyright holder nor the names of its contributors may be used to endorse"),
    (r"^(?:copyright (?:c )?[0-9]{4}.{0,200} )?(?:this|the) (?:project|program|work|file|code|package|module|library|software|source code) is (?:released|distributed|made available|licensed) under the (mit|apache) license", r"licensed under the \1 license"),
    (r"^(?:this|the) (?:project|program|work|file|code|package|module|library|software) is (?:released|distributed|licensed) under (?:version )?([23]) (?:of the )?(?:gnu )?gpl$", r"licensed under the gnu general public license version \1"),
)
#: A tag, cut out as a sentence of its own.
TAG = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+() -]+)"


def _tags() -> dict[str, str]:
    """Licences of tags as normalised sentences spell them, with their identifiers."""
    return {re.sub(OTHER, " ", name.lower()).strip(" ."): f"Spdx:{name}" for name in SPDX}


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows ``doc_id``, ``n_sentence_ids``, ``sentence_ids``, ``licenses``, ``unmatched``, one a row of ``docs``.

    ``sentence_ids`` lists the identifiers in the order of the text, ``licenses`` the
    licences in the order of the rules, then of tags, each once, and ``unmatched`` what no
    rule took; all are comma-joined and empty if there is nothing. A null text counts as
    empty. Repeated rows stay; other columns of ``docs`` don't take part, whatever their
    names. An empty table gives no rows.
    """
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t"))
    low = F.lower("t")
    likely = F.lit(False)
    for word in TRIGGERS:
        likely = likely | low.contains(word)
    split = F.split(F.regexp_replace(F.regexp_replace("t", TAG, "\x01spdx $1\x01"), NEW_LINE, "\x01$1"), END)
    known, tags = (F.create_map(*[F.lit(x) for pair in d.items() for x in pair]) for d in (SENTENCES, _tags()))

    def identified(sentence: Column) -> Column:
        fixed = sentence
        for pattern, to in VARIABLES:
            fixed = F.regexp_replace(fixed, pattern, to.replace("\\1", "$1"))
        named = F.transform(F.split(F.substring(sentence, 6, 1_000_000), " (?:or|and|with) "), lambda x: F.try_element_at(tags, x))
        return F.when(sentence.startswith("spdx "), named).otherwise(F.array(F.try_element_at(known, fixed)))

    normal = F.transform(split, lambda s: F.regexp_replace(F.regexp_replace(F.lower(s), OTHER, " "), EDGE, ""))
    found = F.filter(F.flatten(F.transform(F.filter(normal, lambda s: s != ""), identified)), lambda s: s.isNotNull())
    ids = F.when(likely, found).otherwise(F.array().cast("array<string>"))
    out = source.select("doc_id", ids.alias("ids"))
    # "<a><b>": a rule's sequence is a substring; what it takes leaves "|", which no sequence crosses.
    out = out.withColumn("left0", F.concat_ws("", F.transform("ids", lambda s: F.concat(F.lit("<"), s, F.lit(">")))))
    named = []
    for i, (license, sequence) in enumerate(RULES):
        spelt = "".join(f"<{s}>" for s in sequence)
        out = out.withColumn(f"hit{i}", F.col(f"left{i}").contains(spelt)).withColumn(f"left{i + 1}", F.replace(f"left{i}", F.lit(spelt), F.lit("|")))
        named.append(F.when(F.col(f"hit{i}"), F.lit(license)))
    rest = F.regexp_replace(F.regexp_replace(F.col(f"left{len(RULES)}"), "<Spdx:[^>]*>", ""), "[|<]", "")
    by_tag = F.transform(F.filter("ids", lambda s: s.startswith("Spdx:")), lambda s: F.substring(s, 6, 1000))
    return out.select(
        "doc_id", F.size("ids").cast("long").alias("n_sentence_ids"), F.array_join("ids", ",").alias("sentence_ids"),
        F.array_join(F.array_distinct(F.concat(F.array_compact(F.array(*named)), by_tag)), ",").alias("licenses"), F.regexp_replace(F.replace(rest, F.lit(">"), F.lit(",")), ",$", "").alias("unmatched"),
    )


def oracle() -> str:
    """The same scan as DuckDB SQL over ``documents``."""
    q = lambda s: "'" + s.replace("'", "''") + "'"
    likely = " OR ".join(f"contains(lower(t), {q(w)})" for w in TRIGGERS)
    known, tags = ("MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in d.items()) + "}" for d in (SENTENCES, _tags()))
    fixed = "x"
    for pattern, to in VARIABLES:
        fixed = f"regexp_replace({fixed}, {q(pattern)}, {q(to)}, 'g')"
    steps, at = [], "l0"
    steps.append("l0 AS (SELECT doc_id, ids, coalesce(array_to_string(list_transform(ids, lambda s: '<' || s || '>'), ''), '') AS r, [] :: VARCHAR[] AS named FROM found)")
    for i, (license, sequence) in enumerate(RULES):
        spelt = q("".join(f"<{s}>" for s in sequence))
        steps.append(f"l{i + 1} AS (SELECT doc_id, ids, replace(r, {spelt}, '|') AS r, CASE WHEN contains(r, {spelt}) AND NOT list_contains(named, {q(license)}) THEN list_append(named, {q(license)}) ELSE named END AS named FROM l{i})")
        at = f"l{i + 1}"
    return f"""
    WITH source AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    cut AS (SELECT doc_id, CASE WHEN {likely} THEN string_split_regex(regexp_replace(regexp_replace(t, {q(TAG)}, chr(1) || 'spdx \\1' || chr(1), 'g'), {q(NEW_LINE)}, chr(1) || '\\1', 'g'), {q(END)}) ELSE [] :: VARCHAR[] END AS s FROM source),
    normal AS (SELECT doc_id, list_transform(s, lambda x: regexp_replace(regexp_replace(lower(x), {q(OTHER)}, ' ', 'g'), {q(EDGE)}, '', 'g')) AS s FROM cut),
    found AS (SELECT doc_id, list_filter(flatten(list_transform(list_filter(s, lambda x: x != ''), lambda x: CASE WHEN starts_with(x, 'spdx ') THEN list_transform(string_split_regex(substr(x, 6), ' (?:or|and|with) '), lambda y: {tags}[y]) ELSE [{known}[{fixed}]] END)), lambda x: x IS NOT NULL) AS ids FROM normal),
    {', '.join(steps)}
    SELECT doc_id, len(ids) :: BIGINT AS n_sentence_ids, coalesce(array_to_string(ids, ','), '') AS sentence_ids, coalesce(array_to_string(list_concat(named, list_filter(tagged, lambda x, i: NOT list_contains(named, x) AND list_position(tagged, x) = i)), ','), '') AS licenses,
      regexp_replace(replace(regexp_replace(regexp_replace(r, '<Spdx:[^>]*>', '', 'g'), '[|<]', '', 'g'), '>', ','), ',$', '') AS unmatched FROM (SELECT *, list_transform(list_filter(ids, lambda x: starts_with(x, 'Spdx:')), lambda x: substr(x, 6)) AS tagged FROM {at})"""

"""Licence scans by sentence rules, with SQL functions only.

A text is cut at ends of sentences and lines, and its pieces are normalised (lower
case, everything but letters, digits and inner full stops as one space; copyright
lines as one form). A known sentence is found where it fills one or more whole pieces
in a row, so it may be wrapped over lines and have any stops inside; of several the
longest is taken. Known sentences have identifiers; a text's identifiers, in order, are matched
against ordered rules, each a licence and a pattern of identifiers. All rules that
match are reported, in the order of the rules; a rule's identifiers are taken out
before later, weaker rules are tried.

Everything happens within a row: no shuffle, no broadcast, no Python worker. Every
text is cut and looked up. Null and empty texts have no sentences.
Repeated sentences are repeated identifiers. Input columns named as an output are
replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Identifier and normalised sentence of known licence texts. Fixed values.
SENTENCES = [
    ("MIT-REF", "released under the mit license"),
    ("MIT-REF", "licensed under the mit license"),
    ("MIT-REF", "this project is licensed under the mit license"),
    ("MIT-REF", "mit license"),
    ("MIT-REF", "spdx license identifier mit"),
    ("MIT-GRANT", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("MIT-NOTICE", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("AS-IS-SOFTWARE", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("NO-LIABILITY", "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("APACHE2-REF", "licensed under the apache license version 2.0"),
    ("APACHE2-REF", "licensed under the apache license version 2.0 the license"),
    ("APACHE2-REF", "this project is licensed under the apache license 2.0"),
    ("APACHE2-REF", "apache license version 2.0"),
    ("APACHE2-REF", "spdx license identifier apache 2.0"),
    ("APACHE2-COMPLY", "you may not use this file except in compliance with the license"),
    ("APACHE2-COPY", "you may obtain a copy of the license at"),
    ("APACHE2-AS-IS", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("GPL3-REF", "this work is licensed under the gnu general public license version 3"),
    ("GPL3-REF", "licensed under the gnu general public license version 3"),
    ("GPL3-REF", "licensed under the gnu general public license v3.0"),
    ("GPL3-REF", "gnu general public license version 3"),
    ("GPL3-REF", "spdx license identifier gpl 3.0 only"),
    ("GPL2-REF", "licensed under the gnu general public license version 2"),
    ("GPL2-REF", "this work is licensed under the gnu general public license version 2"),
    ("GPL2-REF", "gnu general public license version 2"),
    ("GPL2-REF", "spdx license identifier gpl 2.0 only"),
    ("GPL-GRANT-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("GPL-GRANT-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("GPL-NO-WARRANTY", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("GPL-SEE", "see the gnu general public license for more details"),
    ("LGPL3-REF", "licensed under the gnu lesser general public license version 3"),
    ("AGPL3-REF", "licensed under the gnu affero general public license version 3"),
    ("MPL2-REF", "this source code form is subject to the terms of the mozilla public license v. 2.0"),
    ("MPL2-REF", "licensed under the mozilla public license version 2.0"),
    ("MPL2-COPY", "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0"),
    ("BSD-GRANT", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("BSD-SOURCE", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("BSD-BINARY", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("BSD-ENDORSE", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSD2-REF", "licensed under the bsd 2 clause license"),
    ("BSD3-REF", "licensed under the bsd 3 clause license"),
    ("ISC-GRANT", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISC-REF", "licensed under the isc license"),
    ("UNLICENSE", "this is free and unencumbered software released into the public domain"),
    ("CC0-REF", "released under cc0 1.0 universal"),
    ("CC-BY-REF", "licensed under cc by 4.0"),
    ("CC-BY-SA-REF", "licensed under cc by sa 4.0"),
    ("CC-BY-NC-REF", "licensed under cc by nc 4.0"),
    ("CC-BY-ND-REF", "licensed under cc by nd 4.0"),
    ("CC-BY-NC-SA-REF", "licensed under cc by nc sa 4.0"),
    ("CC-BY-REF", "this work is licensed under a creative commons attribution 4.0 international license"),
    ("CC-BY-SA-REF", "this work is licensed under a creative commons attribution sharealike 4.0 international license"),
    ("CC-BY-NC-REF", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"),
    ("MIT-REF", "the mit license"),
    ("MIT-REF", "the mit license mit"),
    ("MIT-REF", "distributed under the mit license"),
    ("MIT-REF", "this software is licensed under the mit license"),
    ("MIT-NOTICE", "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"),
    ("APACHE2-REF", "this software is licensed under the apache license version 2.0"),
    ("APACHE2-SEE", "see the license for the specific language governing permissions and limitations under the license"),
    ("GPL-COPY", "you should have received a copy of the gnu general public license along with this program"),
    ("LGPL-GRANT-2.1", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version"),
    ("LGPL-GRANT-3", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("LGPL-NO-WARRANTY", "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("AGPL-GRANT-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("LGPL21-REF", "licensed under the gnu lesser general public license version 2.1"),
    ("BSD-AS-IS", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("BSD-NO-LIABILITY", "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"),
    ("BSD3-REF", "licensed under the 3 clause bsd license"),
    ("BSD2-REF", "licensed under the 2 clause bsd license"),
    ("ISC-AS-IS", "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("BSL1-REF", "boost software license version 1.0"),
    ("BSL1-REF", "distributed under the boost software license version 1.0"),
    ("ZLIB-AS-IS", "this software is provided as is without any express or implied warranty"),
    ("ZLIB-NO-LIABILITY", "in no event will the authors be held liable for any damages arising from the use of this software"),
    ("ZLIB-GRANT", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("EPL2-REF", "this program and the accompanying materials are made available under the terms of the eclipse public license v. 2.0 which is available at http www.eclipse.org legal epl 2.0"),
    ("EPL2-REF", "licensed under the eclipse public license version 2.0"),
    ("UNLICENSE-USE", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("CC0-REF", "licensed under cc0 1.0"),
    ("CC-BY-NC-SA-REF", "this work is licensed under a creative commons attribution noncommercial sharealike 4.0 international license"),
    ("CC-BY-ND-REF", "this work is licensed under a creative commons attribution noderivatives 4.0 international license"),
    ("SPDX-BSD-3", "spdx license identifier bsd 3 clause"),
    ("SPDX-BSD-2", "spdx license identifier bsd 2 clause"),
    ("ISC-REF", "spdx license identifier isc"),
    ("MPL2-REF", "spdx license identifier mpl 2.0"),
    ("SPDX-GPL-3-LATER", "spdx license identifier gpl 3.0 or later"),
    ("SPDX-GPL-2-LATER", "spdx license identifier gpl 2.0 or later"),
    ("LGPL3-REF", "spdx license identifier lgpl 3.0 only"),
    ("AGPL3-REF", "spdx license identifier agpl 3.0 only"),
    ("UNLICENSE", "spdx license identifier unlicense"),
    ("CC0-REF", "spdx license identifier cc0 1.0"),
    ("BSL1-REF", "spdx license identifier bsl 1.0"),
    ("SPDX-ZLIB", "spdx license identifier zlib"),
    ("EPL2-REF", "spdx license identifier epl 2.0"),
    ("ALL-RIGHTS", "all rights reserved"),
    ("COPYRIGHT", "copyright notice"),
]
#: Licence and pattern of identifiers, strongest first. Each identifier ends with a semicolon. Fixed values.
RULES = [
    ("MIT", "MIT-GRANT;(?:[A-Z0-9-]+;){0,2}MIT-NOTICE;(?:[A-Z0-9-]+;){0,2}AS-IS-SOFTWARE;(?:NO-LIABILITY;)?"),
    ("BSD-3-Clause", "BSD-GRANT;(?:[A-Z0-9-]+;){0,1}BSD-SOURCE;BSD-BINARY;BSD-ENDORSE;(?:BSD-AS-IS;)?(?:BSD-NO-LIABILITY;)?"),
    ("BSD-2-Clause", "BSD-GRANT;(?:[A-Z0-9-]+;){0,1}BSD-SOURCE;BSD-BINARY;(?:BSD-AS-IS;)?(?:BSD-NO-LIABILITY;)?"),
    ("Apache-2.0", "APACHE2-REF;(?:APACHE2-COMPLY;)?(?:APACHE2-COPY;)?(?:APACHE2-AS-IS;)?(?:APACHE2-SEE;)?"),
    ("GPL-3.0-or-later", "GPL-GRANT-3;(?:GPL-NO-WARRANTY;)?(?:GPL-SEE;)?(?:GPL-COPY;)?"),
    ("GPL-2.0-or-later", "GPL-GRANT-2;(?:GPL-NO-WARRANTY;)?(?:GPL-SEE;)?(?:GPL-COPY;)?"),
    ("AGPL-3.0-or-later", "AGPL-GRANT-3;(?:GPL-NO-WARRANTY;)?"),
    ("LGPL-3.0-or-later", "LGPL-GRANT-3;(?:LGPL-NO-WARRANTY;)?"),
    ("LGPL-2.1-or-later", "LGPL-GRANT-2.1;(?:LGPL-NO-WARRANTY;)?"),
    ("Zlib", "(?:ZLIB-AS-IS;(?:ZLIB-NO-LIABILITY;)?ZLIB-GRANT|SPDX-ZLIB);"),
    ("ISC", "(?:ISC-GRANT|ISC-REF);(?:ISC-AS-IS;)?"),
    ("MPL-2.0", "MPL2-REF;(?:MPL2-COPY;)?"),
    ("MIT", "MIT-REF;"),
    ("GPL-3.0-or-later", "SPDX-GPL-3-LATER;"),
    ("GPL-2.0-or-later", "SPDX-GPL-2-LATER;"),
    ("GPL-3.0-only", "GPL3-REF;"),
    ("GPL-2.0-only", "GPL2-REF;"),
    ("LGPL-3.0-only", "LGPL3-REF;"),
    ("AGPL-3.0-only", "AGPL3-REF;"),
    ("LGPL-2.1-only", "LGPL21-REF;"),
    ("BSD-2-Clause", "(?:BSD2-REF|SPDX-BSD-2);"),
    ("BSD-3-Clause", "(?:BSD3-REF|SPDX-BSD-3);"),
    ("BSL-1.0", "BSL1-REF;"),
    ("EPL-2.0", "EPL2-REF;"),
    ("Unlicense", "UNLICENSE;(?:UNLICENSE-USE;)?"),
    ("CC0-1.0", "CC0-REF;"),
    ("CC-BY-4.0", "CC-BY-REF;"),
    ("CC-BY-SA-4.0", "CC-BY-SA-REF;"),
    ("CC-BY-NC-4.0", "CC-BY-NC-REF;"),
    ("CC-BY-ND-4.0", "CC-BY-ND-REF;"),
    ("CC-BY-NC-SA-4.0", "CC-BY-NC-SA-REF;"),
    ("Proprietary", "(?:COPYRIGHT;)?ALL-RIGHTS;"),
]
#: Patterns and what takes their place, in order: ends of sentences and lines, other characters, full stops outside numbers, spaces.
_FOLD = [("[.!?:;]+[ \t\n\r\f]+|[\n\r]+", "\n"), ("[^a-z0-9.\n]+", " "), ("(?<![0-9])[.]+|[.]+(?![a-z0-9])", " "), (" *\n[ \n]*", "\n"), (" +", " ")]


def _stream(text):
    """Normalised words of a text, a line for each piece between ends of sentences or lines."""
    text = F.lower(text)
    for pattern, by in _FOLD:
        text = F.regexp_replace(text, pattern, by)
    return text


def _key(sentence: str) -> str:
    """A known sentence as _stream() has it, with all pieces on one line."""
    for pattern, by in _FOLD:
        sentence = re.sub(pattern, by, sentence)
    return sentence.replace("\n", " ").strip()


def scan(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """docs with sentence_ids (identifiers, each ended by a semicolon) and licenses (comma-joined, distinct, in the order of RULES)."""
    docs = docs.drop("sentence_ids", "licenses", "n_sentences")
    at = _stream(F.concat(F.lit("\n"), F.col(text), F.lit("\n")))
    keys = {_key(s): n for n, s in SENTENCES}
    longest = sorted(keys, key=lambda k: (-len(k), k))
    pattern = "\n(" + "|".join(k.replace(" ", "[ \n]").replace(".", "[.]").replace("http[", "https?[") for k in longest) + "|copyright [^\n]*)(?=\n)"
    table = F.create_map(*[F.lit(x) for k, n in keys.items() for x in (k, n)])
    # a copyright line with any words is the copyright notice
    known = F.transform(F.regexp_extract_all(at, F.lit(pattern), F.lit(1)), lambda s: F.coalesce(F.try_element_at(table, F.regexp_replace(F.translate(s, "\n", " "), "\\bhttps ", "http ")), F.lit("COPYRIGHT")))
    ids = F.coalesce(F.concat_ws("", F.transform(known, lambda i: F.concat(i, F.lit(";")))), F.lit(""))
    out = docs.withColumn("sentence_ids", ids)
    left, found = F.col("sentence_ids"), []
    for name, rule in RULES:
        found.append(F.when(left.rlike(f"(?:^|;){rule}"), F.lit(name)))
        left = F.regexp_replace(left, f"(^|;){rule}", "$1")
    licenses = F.when(F.col("sentence_ids") == "", F.lit("")).otherwise(F.concat_ws(",", F.array_distinct(F.array_compact(F.array(*found)))))
    return out.withColumn("licenses", licenses).withColumn("n_sentences", (F.length("sentence_ids") - F.length(F.replace("sentence_ids", F.lit(";")))).cast("long"))


def report(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).select("doc_id", "n_sentences", "sentence_ids", "licenses")


def oracle() -> str:
    """The same in DuckDB's SQL, whose regular expressions have no look-around: a full
    stop inside a number is kept by a mark, and line ends are doubled so that one piece's
    end is not the next one's beginning."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def replaced(text: str, pattern: str, by: str) -> str:
        return f"regexp_replace({text}, {quoted(pattern)}, {by if by.startswith('chr') else quoted(by)}, 'g')"

    stream = "lower(chr(10) || text || chr(10))"
    inner = ("([0-9])[.]([a-z0-9])", "\\1\x01\\2")
    for pattern, by in ((_FOLD[0][0], "chr(10)"), (_FOLD[1][0], " "), inner, inner, ("[.]+", " "), ("\x01", "."), (_FOLD[3][0], "chr(10)"), (_FOLD[4][0], " "), ("\n", "chr(10) || chr(10)")):
        stream = replaced(stream, pattern, by)
    keys = {_key(s): n for n, s in SENTENCES}
    known = "|".join(k.replace(".", "[.]").replace("http ", "https? ").replace(" ", "(?: |\n\n)") for k in sorted(keys, key=lambda k: (-len(k), k)))
    pattern = f"\n({known}|copyright [^\n]*)\n"
    pairs = ", ".join(f"{quoted(k)}: {quoted(n)}" for k, n in keys.items())
    found = replaced(replaced("s", "\n+", " "), "\\bhttps ", "http ")
    steps, chain = [], "f0 AS (SELECT *, sentence_ids AS left0 FROM known)"
    for i, (name, rule) in enumerate(RULES):
        steps.append(f"CASE WHEN regexp_matches(left{i}, {quoted('(?:^|;)' + rule)}) THEN {quoted(name)} END")
    for i, (_, rule) in enumerate(RULES[:-1]):
        chain += f", f{i + 1} AS (SELECT *, regexp_replace(left{i}, {quoted('(^|;)' + rule)}, '\\1', 'g') AS left{i + 1} FROM f{i})"
    return f"""
WITH cut AS (SELECT doc_id, {stream} AS pieces FROM documents),
known AS (SELECT doc_id, coalesce(array_to_string(list_transform(regexp_extract_all(pieces, {quoted(pattern)}, 1), lambda s: coalesce(MAP {{{pairs}}}[{found}], 'COPYRIGHT') || ';'), ''), '') AS sentence_ids FROM cut),
{chain}
SELECT doc_id, CAST(length(sentence_ids) - length(replace(sentence_ids, ';', '')) AS BIGINT) AS n_sentences, sentence_ids, array_to_string(list_filter(found, lambda x, i: x IS NOT NULL AND list_position(found, x) = i), ',') AS licenses
FROM (SELECT *, list_value({", ".join(steps)}) AS found FROM f{len(RULES) - 1})
"""

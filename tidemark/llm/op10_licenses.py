"""License scans (operator 10, native): sentence rules.

A text is normalised (lower case, everything but a-z and 0-9 one space, line ends kept),
and a known sentence that fills one line or several becomes its identifier; all others are
left out. Sentences end at ``.!?`` and blank lines (blank but for comment marks, too), and a
single line end within a sentence is a space, so that wrapped notices are found as well as
those of one line. ``:`` and ``;`` stand within known sentences and end none by themselves.
Sentences like "This project is released under the MIT License - see the LICENSE file for details" are known by a pattern
and the licence's name in it, and an SPDX expression (``(MIT OR Apache-2.0)``, ``GPL-2.0-only WITH ...``) stands for one
identifier sentence of each of its licences; what follows WITH is an exception and no licence. The DuckDB SQL knows sentences
of one line only and is equal where none is wrapped. The identifiers in their order are matched against licence rules, each an
ordered run of identifiers, some of which must not go on with a certain one. Everything is a projection of built-in functions: no shuffle, no
Python on the executors.

Every known sentence holds one of ``CUES`` or says what something is under, so texts without
any are settled before they are split. Null and empty texts have no sentences and no licences. A sentence that occurs
again is listed again; a licence is listed once, in the order of the rules (ties between
rules don't arise). Very long texts are split whole. Repeated rows are judged each on its
own and an empty table gives an empty result. Only the id and text columns are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Known licence sentences, by identifier.
SENTENCES = {
    "apache-line": ("Licensed under the Apache License, Version 2.0.", "Released under the Apache License, Version 2.0.",
                    "This work is licensed under the Apache License, Version 2.0.", "Distributed under the Apache License 2.0."),
    "apache-notice": ('Licensed under the Apache License, Version 2.0 (the "License");',
                      'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    "apache-copy": ("You may obtain a copy of the License at",),
    "apache-asis": ('Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',),
    "mit-line": ("Released under the MIT License.", "Licensed under the MIT License.", "This work is licensed under the MIT License.",
                 "This software is released under the MIT License.", "Distributed under the MIT License."),
    "mit-grant": ('Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',),
    "mit-keep": ("The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",),
    "mit-asis": ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',),
    "isc-grant": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "bsd-grant": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",),
    "bsd-source": ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",),
    "bsd-binary": ("Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",),
    "bsd-names": ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",),
    "bsd-asis": ('THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',),
    "bsd-line": ("Licensed under the BSD License.", "Released under the BSD License."),
    "gpl3-line": ("This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.",
                  "Released under the GNU General Public License, version 3.", "Licensed under the GNU GPL version 3."),
    "gpl2-line": ("This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.",
                  "Released under the GNU General Public License, version 2."),
    "gpl-free": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "gpl-hope": ("This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",),
    "lgpl-line": ("Licensed under the GNU Lesser General Public License, version 3.", "This work is licensed under the GNU Lesser General Public License, version 3."),
    "mpl2-line": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0.",
                  "Licensed under the Mozilla Public License 2.0.", "This work is licensed under the Mozilla Public License, version 2.0."),
    "mpl2-where": ("If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
                   "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    "mpl11-line": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1.", "Licensed under the Mozilla Public License, version 1.1.",
                   "The contents of this file are subject to the Mozilla Public License Version 1.1"),
    "gpl2-free": ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",),
    "agpl-free": ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",),
    "agpl-line": ("Licensed under the GNU Affero General Public License, version 3.", "This work is licensed under the GNU Affero General Public License, version 3."),
    "lgpl21-line": ("Licensed under the GNU Lesser General Public License, version 2.1.", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    "lgpl-free": ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",),
    "epl2-line": ("Licensed under the Eclipse Public License, version 2.0.", "This work is licensed under the Eclipse Public License, version 2.0."),
    "boost-line": ("Distributed under the Boost Software License, Version 1.0.", "Licensed under the Boost Software License, Version 1.0."),
    "unlicense-free": ("This is free and unencumbered software released into the public domain.",),
    "cc0-line": ("This work is licensed under CC0 1.0.", "Licensed under CC0 1.0.", "This work is licensed under a Creative Commons Zero 1.0 Universal License."),
    "cc-by3-line": ("Licensed under CC BY 3.0.", "This work is licensed under CC BY 3.0.", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    "cc-by-sa3-line": ("Licensed under CC BY-SA 3.0.", "This work is licensed under CC BY-SA 3.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    "zlib-asis": ("This software is provided 'as-is', without any express or implied warranty.",),
    "zlib-grant": ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",),
    "spdx-gpl2": ("SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0"),
    "spdx-agpl": ("SPDX-License-Identifier: AGPL-3.0-only", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "spdx-lgpl3": ("SPDX-License-Identifier: LGPL-3.0-only", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "spdx-lgpl21": ("SPDX-License-Identifier: LGPL-2.1-only", "SPDX-License-Identifier: LGPL-2.1-or-later"),
    "spdx-isc": ("SPDX-License-Identifier: ISC",), "spdx-bsd2": ("SPDX-License-Identifier: BSD-2-Clause",), "spdx-cc0": ("SPDX-License-Identifier: CC0-1.0",),
    "spdx-epl2": ("SPDX-License-Identifier: EPL-2.0",), "spdx-boost": ("SPDX-License-Identifier: BSL-1.0",), "spdx-unlicense": ("SPDX-License-Identifier: Unlicense",),
    "cc-by-nc-line": ("Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.",
                      "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "cc-by-line": ("Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.",
                   "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "cc-by-sa-line": ("Licensed under CC BY-SA 4.0.", "This work is licensed under CC BY-SA 4.0.",
                      "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "spdx-mit": ("SPDX-License-Identifier: MIT",), "spdx-apache": ("SPDX-License-Identifier: Apache-2.0",),
    "spdx-gpl3": ("SPDX-License-Identifier: GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-or-later"),
    "spdx-bsd3": ("SPDX-License-Identifier: BSD-3-Clause",), "spdx-mpl": ("SPDX-License-Identifier: MPL-2.0",),
}

#: Names that licences have in sentences that say what something is licensed under, by identifier.
NAMES = {
    "mit-line": ("the MIT License", "the MIT Licence", "MIT", "the terms of the MIT License", "an MIT License", "the MIT License (MIT)"),
    "apache-line": ("the Apache License, Version 2.0", "the Apache License 2.0", "the Apache 2.0 License", "Apache 2.0", "Apache-2.0", "the terms of the Apache License, Version 2.0"),
    "bsd2-line": ("the BSD 2-Clause License", "the 2-Clause BSD License", "the Simplified BSD License", "BSD-2-Clause"),
    "bsd3-line": ("the BSD 3-Clause License", "the 3-Clause BSD License", "the New BSD License", "BSD-3-Clause"),
    "bsd-line": ("the BSD License", "a BSD-style License"),
    "isc-line": ("the ISC License", "ISC"),
    "gpl3-line": ("the GNU General Public License, version 3", "the GNU General Public License v3.0", "the GPLv3", "the GPL v3", "GPL-3.0", "the GNU GPL version 3", "the GNU GPLv3"),
    "gpl2-line": ("the GNU General Public License, version 2", "the GNU General Public License v2.0", "the GPLv2", "the GPL v2", "GPL-2.0", "the GNU GPL version 2"),
    "lgpl-line": ("the GNU Lesser General Public License, version 3", "the LGPLv3", "LGPL-3.0"),
    "lgpl21-line": ("the GNU Lesser General Public License, version 2.1", "the LGPL v2.1", "LGPL-2.1"),
    "agpl-line": ("the GNU Affero General Public License, version 3", "the AGPLv3", "AGPL-3.0"),
    "mpl2-line": ("the Mozilla Public License, version 2.0", "the Mozilla Public License 2.0", "MPL-2.0", "the MPL 2.0"),
    "epl2-line": ("the Eclipse Public License, version 2.0", "the Eclipse Public License 2.0", "EPL-2.0"),
    "boost-line": ("the Boost Software License, Version 1.0", "the Boost Software License 1.0", "BSL-1.0"),
    "unlicense-line": ("the Unlicense",), "zlib-line": ("the zlib License", "the zlib/libpng License"),
    "cc0-line": ("CC0 1.0", "CC0", "a Creative Commons Zero 1.0 Universal License"),
    "cc-by-line": ("CC BY 4.0", "a Creative Commons Attribution 4.0 International License", "the Creative Commons Attribution 4.0 International License"),
    "cc-by-sa-line": ("CC BY-SA 4.0", "a Creative Commons Attribution-ShareAlike 4.0 International License", "the Creative Commons Attribution-ShareAlike 4.0 International License"),
    "cc-by-nc-line": ("CC BY-NC 4.0", "a Creative Commons Attribution-NonCommercial 4.0 International License"),
    "wtfpl-line": ("the WTFPL",), "artistic2-line": ("the Artistic License 2.0",), "upl-line": ("the Universal Permissive License, version 1.0",),
}
#: What is licensed, how it is said, and what may follow.
THINGS = ("work", "software", "project", "program", "library", "code", "package", "file", "repository", "module", "crate", "documentation")
VERBS = ("licensed", "released", "distributed", "available", "published", "provided", "made available")
TAILS = ("see the license file for details", "see the license file for more details", "see the license file", "see license for details", "see license for more information",
         "see the license md file for details", "see license md for details", "see license file for details", "see license")

#: Licence rules in order; each is a run of sentence identifiers, and what must not follow it, if anything.
RULES = (
    ("Apache-2.0", ("apache-line",)), ("Apache-2.0", ("spdx-apache",)), ("Apache-2.0", ("apache-notice", "apache-copy", "apache-asis")),
    ("Apache-2.0", ("apache-notice", "apache-asis")),
    ("MIT", ("mit-line",)), ("MIT", ("spdx-mit",)), ("MIT", ("mit-grant", "mit-keep", "mit-asis")),
    ("ISC", ("isc-grant",)), ("ISC", ("isc-line",)), ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary"), "bsd-names"), ("BSD-2-Clause", ("bsd2-line",)), ("BSD-3-Clause", ("bsd3-line",)),
    ("Unlicense", ("unlicense-line",)), ("Zlib", ("zlib-line",)), ("WTFPL", ("wtfpl-line",)), ("Artistic-2.0", ("artistic2-line",)), ("UPL-1.0", ("upl-line",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")), ("BSD-3-Clause", ("spdx-bsd3",)), ("BSD", ("bsd-line",)),
    ("GPL-3.0", ("gpl3-line",)), ("GPL-3.0", ("spdx-gpl3",)), ("GPL-3.0", ("gpl-free", "gpl-hope")), ("GPL-2.0", ("gpl2-line",)),
    ("LGPL-3.0", ("lgpl-line",)), ("MPL-2.0", ("mpl2-line",)), ("MPL-2.0", ("spdx-mpl",)), ("MPL-1.1", ("mpl11-line",)),
    ("GPL-2.0", ("spdx-gpl2",)), ("GPL-2.0", ("gpl2-free", "gpl-hope")), ("AGPL-3.0", ("agpl-line",)), ("AGPL-3.0", ("spdx-agpl",)), ("AGPL-3.0", ("agpl-free", "gpl-hope")),
    ("LGPL-3.0", ("spdx-lgpl3",)), ("LGPL-2.1", ("lgpl21-line",)), ("LGPL-2.1", ("spdx-lgpl21",)), ("LGPL-2.1", ("lgpl-free",)),
    ("EPL-2.0", ("epl2-line",)), ("EPL-2.0", ("spdx-epl2",)), ("BSL-1.0", ("boost-line",)), ("BSL-1.0", ("spdx-boost",)),
    ("Unlicense", ("unlicense-free",)), ("Unlicense", ("spdx-unlicense",)), ("ISC", ("spdx-isc",)), ("BSD-2-Clause", ("spdx-bsd2",)), ("Zlib", ("zlib-asis", "zlib-grant")),
    ("CC0-1.0", ("cc0-line",)), ("CC0-1.0", ("spdx-cc0",)), ("CC-BY-3.0", ("cc-by3-line",)), ("CC-BY-SA-3.0", ("cc-by-sa3-line",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-line",)), ("CC-BY-SA-4.0", ("cc-by-sa-line",)), ("CC-BY-4.0", ("cc-by-line",)),
)

#: Every known sentence holds one of these.
CUES = ("licen", "permission", "warrant", "redistribut", "copyright", "free and unencumbered", "cc0", "copy of the mpl")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(sentence: str) -> str:
    return re.sub("[^a-z0-9]+", " ", sentence.lower()).strip(" ")


KNOWN = {normal(s): name for name, all_forms in SENTENCES.items() for s in all_forms}


_BY_NAME = {normal(n): name for name, names in NAMES.items() for n in names}
_ALTERNATIVES = lambda words: "|".join(sorted(words, key=len, reverse=True))
#: A sentence that says what something is licensed under; its first group is the licence's name.
_SAID = f"(?:(?:this|the) (?:{_ALTERNATIVES(THINGS)}) is )?(?:{_ALTERNATIVES(VERBS)}) under ({_ALTERNATIVES(_BY_NAME)})(?: (?:{_ALTERNATIVES(TAILS)}))?"
#: A known sentence from the start of a line to the end of one; a blank line ends it. The longest comes first.
_WHOLE_LINES = (
    r"(?<![^\n])(?:" + "|".join(k.replace(" ", r"[ \n]") for k in sorted(KNOWN, key=len, reverse=True)) + "|" + _SAID.replace("(?: ", r"(?:[ \n]").replace(" ", r"[ \n]").replace(r"[[ \n]\n]", r"[ \n]") + r")(?![^\n])"
)
#: An SPDX expression.
_LICENCE = r"\(*[A-Za-z0-9.+-]+\)*"
_SPDX, _EXPRESSION = "SPDX-License-Identifier:", rf"^[ \t]*{_LICENCE}(?:[ \t]+(?:AND|OR|WITH)[ \t]+{_LICENCE})+"


def spdx_apart(text: Column) -> Column:
    """The text with an identifier line for each licence of an SPDX expression of several."""
    pieces = F.split(text, _SPDX)

    def one(piece: Column, i: Column) -> Column:
        said = F.regexp_extract(piece, _EXPRESSION, 0)
        licences = F.regexp_extract_all(F.regexp_replace(said, r"WITH[ \t]+[A-Za-z0-9.+-]+", ""), F.lit("[A-Za-z0-9.+-]+"), F.lit(0))
        lines = F.transform(F.filter(licences, lambda x: ~x.isin("AND", "OR")), lambda x: F.concat(F.lit(f"\n\n{_SPDX} "), x))
        several = F.concat(F.array_join(lines, ""), F.lit("\n\n"), F.substring(piece, F.length(said) + 1, F.length(piece)))
        return F.when(i == 0, piece).when(said == "", F.concat(F.lit(_SPDX), piece)).otherwise(several)

    return F.when(text.contains(_SPDX), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def sentence_ids(text: Column) -> Column:
    """Identifiers of a text's known sentences, in order."""
    numbered = F.regexp_replace(spdx_apart(text), r"([ (][vV])\.[ \t]+([0-9])", "$1 $2")  # "v. 2.0" ends no sentence
    ended = F.translate(F.regexp_replace(numbered, r"[.!?][ \t\r\n]+", "\n\n"), _UPPER, _LOWER)
    lines = F.trim(F.regexp_replace(F.regexp_replace(ended, "[^a-z0-9\n]+", " "), " ?\n ?", "\n"))
    known, named = (F.create_map(*(F.lit(x) for pair in table.items() for x in pair)) for table in (KNOWN, _BY_NAME))

    def identified(sentence: Column) -> Column:
        plain = F.translate(sentence, "\n", " ")
        return F.coalesce(F.try_element_at(known, plain), F.try_element_at(named, F.regexp_extract(plain, f"^{_SAID}$", 1)))

    found = F.transform(F.regexp_extract_all(lines, F.lit(_WHOLE_LINES), F.lit(0)), identified)
    return F.when(_has_cue(text), found).otherwise(F.array().cast("array<string>"))


#: What a sentence with a licence's name holds, if none of the cues: "under" and the start of the name.
_UNDER = r"under[^a-z0-9]+(?:" + _ALTERNATIVES({" ".join(k.split()[:2] if k.startswith(("the ", "a ", "an ")) else k.split()[:1]) for k in _BY_NAME}).replace(" ", "[^a-z0-9]+") + ")"


def _has_cue(text: Column) -> Column:
    low = F.lower(text)
    out = low.contains(CUES[0])
    for cue in CUES[1:]:
        out = out | low.contains(cue)
    return out | low.rlike(_UNDER)


def licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Known sentences and licences of each document."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), sentence_ids(text).alias("ids"))
    run = F.concat(F.lit(","), F.array_join("ids", ","), F.lit(","))

    def met(ids: tuple[str, ...], unless: str = "") -> Column:
        said = "," + ",".join(ids) + ","
        return run.contains(said) & ~run.contains(f"{said}{unless},") if unless else run.contains(said)

    names = F.array(*(F.when(met(*rule), F.lit(name)) for name, *rule in RULES))
    found = F.array_distinct(F.filter(names, lambda x: x.isNotNull()))
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_sentences"),
        F.array_join("ids", ",").alias("sentence_ids"),
        F.size(found).cast("long").alias("n_licenses"),
        F.array_join(found, ",").alias("licenses"),
    )


def oracle() -> str:
    """The same in DuckDB's SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in KNOWN.items()) + "}"
    by_name = "MAP {" + ", ".join(f"{quote(k)}: {quote(v)}" for k, v in _BY_NAME.items()) + "}"

    def met(ids: tuple[str, ...], unless: str = "") -> str:
        said = "," + ",".join(ids) + ","
        return f"contains(run, {quote(said)})" + (f" AND NOT contains(run, {quote(said + unless + ',')})" if unless else "")

    names = ", ".join(f"CASE WHEN {met(*rule)} THEN {quote(name)} END" for name, *rule in RULES)
    order = list(dict.fromkeys(name for name, *_ in RULES))
    ordered = "[" + ", ".join(quote(n) for n in order) + "]"
    return f"""
WITH pieces AS (SELECT doc_id, string_split(coalesce(text, ''), '{_SPDX}') AS p FROM documents),
apart AS (
  SELECT doc_id, array_to_string(list_transform(p, lambda x, i: CASE WHEN i = 1 THEN x WHEN regexp_extract(x, '{_EXPRESSION}') = '' THEN '{_SPDX}' || x
    ELSE array_to_string(list_transform(list_filter(regexp_extract_all(regexp_replace(regexp_extract(x, '{_EXPRESSION}'), 'WITH[ \t]+[A-Za-z0-9.+-]+', '', 'g'), '[A-Za-z0-9.+-]+'), lambda y: y NOT IN ('AND', 'OR')),
      lambda y: chr(10) || '{_SPDX} ' || y), '') || chr(10) || substr(x, length(regexp_extract(x, '{_EXPRESSION}')) + 1) END), '') AS text FROM pieces
), cut_up AS (
  SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([ (][vV])\\.[ \\t]+([0-9])', '\\1 \\2', 'g'), '([.!?])[ \\t\\r\\n]+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM apart
), plain AS (
  SELECT doc_id, list_transform(parts, lambda s: trim(regexp_replace(translate(s, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g'), ' ')) AS parts FROM cut_up
), known AS (
  SELECT doc_id, list_filter(list_transform(parts, lambda s: coalesce(({known})[s], ({by_name})[regexp_extract(s, '^{_SAID}$', 1)])), lambda x: x IS NOT NULL) AS ids FROM plain
), runs AS (SELECT doc_id, ids, ',' || array_to_string(ids, ',') || ',' AS run FROM known),
named AS (SELECT doc_id, ids, [{names}] AS names FROM runs),
found AS (SELECT doc_id, ids, list_filter({ordered}, lambda n: list_contains(names, n)) AS found FROM named)
SELECT doc_id, len(ids)::BIGINT AS n_sentences, coalesce(array_to_string(ids, ','), '') AS sentence_ids,
       len(found)::BIGINT AS n_licenses, coalesce(array_to_string(found, ','), '') AS licenses FROM found"""


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))

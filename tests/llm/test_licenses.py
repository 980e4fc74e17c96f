"""Licence notices as they are found, in whole files."""

from __future__ import annotations

import pytest

from tidemark.llm import op10_licenses

BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
ASIS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE FOR ANY DAMAGES.
"""
FOUND = [
    ("Copyright (c) 2020 Me\n\n" + BSD.replace("1. ", "").replace("2. ", "") + ASIS, "BSD-2-Clause"),
    ("Copyright (c) 2020 Me\n\n" + BSD.replace("1. ", "").replace("2. ", "") + NAMES.replace("3. ", "") + ASIS, "BSD-3-Clause"),
    ("# SPDX-License-Identifier: (MIT OR Apache-2.0)\nimport this", "Apache-2.0,MIT"),
    ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", "GPL-2.0"),
    ("// SPDX-License-Identifier: MIT AND (ISC OR BSD-2-Clause)\n", "MIT,ISC,BSD-2-Clause"),
    ("// SPDX-License-Identifier: MIT\ncode", "MIT"),
    ("This project is licensed under the MIT License - see the LICENSE file for details.", "MIT"),
    ("This project is licensed under the MIT License - see the [LICENSE](LICENSE) file\nfor details", ""),
    ("It works.\n\nThis library is distributed under the\nSimplified BSD License. See more below.", "BSD-2-Clause"),
    ("Released under CC BY 4.0.", "CC-BY-4.0"),
    ("The documentation is available under the\n  Mozilla Public License 2.0.", "MPL-2.0"),
    ("Published under MIT", "MIT"),
    ("We live under MIT rule and are under the BSD flag.", ""),
    ("He was released under the MIT bridge.", ""),
    (None, ""),
    ("", ""),
    ("SPDX-License-Identifier:", ""),
    ("SPDX-License-Identifier: OR AND WITH", ""),
]


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_notices(spark, mark):
    rows = [(i, t and "\n".join((mark + line).rstrip() for line in t.split("\n")), "x") for i, (t, _) in enumerate(FOUND)]
    got = op10_licenses.licenses(spark.createDataFrame(rows, "doc_id long, text string, ids string")).collect()
    assert {FOUND[r["doc_id"]][0]: r["licenses"] for r in got} == dict(FOUND)


def test_every_sentence_by_pattern_has_a_cue(spark):
    said = [f"{lead}{verb} under {name}{tail}." for lead in ("", "This work is ") for verb in ("Licensed", "released") for names in op10_licenses.NAMES.values() for name in names for tail in ("", " - see LICENSE for details")]
    got = op10_licenses.licenses(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).where("n_licenses <> 1").collect()
    assert [said[r["doc_id"]] for r in got] == []

"""Licences beyond the common families, denials, and expressions in tags."""

from __future__ import annotations

from paperloom.llm import op1_licenses

ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
"""
MPL = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at http://mozilla.org/MPL/2.0/. */"""
WANT = {
    ZLIB: ["Zlib"],
    MPL: ["MPL-2.0"],
    "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.": ["MPL-2.0"],
    "Distributed under the Boost Software License, Version 1.0.": ["BSL-1.0"],
    "This program is made available under the terms of the Eclipse Public License v2.0 which accompanies it.": ["EPL-2.0"],
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.": ["OFL-1.1"],
    "Licensed under the EUPL, Version 1.2 or later": ["EUPL-1.2"],
    "The contents of this file are subject to the terms of the Common Development and Distribution License (the License).": ["CDDL"],
    "Released under the Artistic License 2.0.": ["Artistic-2.0"],
    "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE": ["WTFPL"],
    "Released under the zlib license.": ["Zlib"],
    "Released under the BSD 3-Clause License": ["BSD-3-Clause"],
    "Available under the PostgreSQL License, see the file.": ["PostgreSQL"],
    "SPDX-License-Identifier: MIT OR Apache-2.0": ["MIT", "Apache-2.0"],
    "# SPDX-License-Identifier: (EPL-2.0 OR GPL-2.0-or-later WITH Classpath-exception-2.0) AND 0BSD\nimport os": ["EPL-2.0", "GPL-2.0", "0BSD"],
    "SPDX-License-Identifier: MIT OR MIT": ["MIT"],
    **{f"// SPDX-License-Identifier: {x}": [x] for x in op1_licenses.SPDX},
}
DENIED = (
    "This is not released under the MIT license.",
    "It was never licensed under the Apache License, Version 2.0.",
    "The work is neither published nor distributed under the GNU General Public License.",
    "These files are no longer available under the zlib license.",
    "This isn't licensed under CC BY 4.0",
)
NEITHER = ("The party ruled under a license of the town.", "SPDX-License-Identifier: Nothing-9.9", "SPDX-License-Identifier:", "He is subject to the rules of the public license office")


def test_licences_by_sentence_name_and_tag(spark):
    rows = spark.createDataFrame([(t,) for t in [*WANT, *DENIED, *NEITHER, None, ""]], "text string")
    got = {r.text: r for r in op1_licenses.scan(rows).collect()}
    assert {t: got[t].licenses for t in WANT} == WANT
    assert not any(got[t].unclaimed for t in WANT)
    for t in DENIED:
        assert (got[t].licenses, got[t].unclaimed) == ([], ["denied"]), t
    for t in (*NEITHER, None, ""):
        assert got[t].licenses == [], t


def test_a_table_of_licences():
    """Sixty licences and more, each identifier known by one sentence at least."""
    names = {name for name, _ in op1_licenses.RULES} | set(op1_licenses.ALONE.values())
    assert len(names) >= 90
    assert all(len(run) > 1 for _, run in op1_licenses.RULES)


def test_every_key_has_one_of_the_words():
    import re

    keys = op1_licenses.KEY.strip("()").replace("licen[cs]e", "license").replace("cc (by|attribution)", "cc by").replace("june (1991|2007)", "june 1991")
    for key in [*keys.split("|"), *op1_licenses.KNOWN]:
        assert re.search(op1_licenses.WORDS, key), key


def test_sql_of_all_texts(spark, tmp_path):
    import oracle
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = [*WANT, *DENIED, *NEITHER, None, "", ZLIB + MPL + "\nSPDX-License-Identifier: MIT OR Zlib\n"]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}), tmp_path / "documents.parquet")
    got = op1_licenses.op1_license_scan(spark, str(tmp_path))
    assert oracle.spark_rows(got) == oracle.sql_rows(op1_licenses.oracle(), tmp_path)

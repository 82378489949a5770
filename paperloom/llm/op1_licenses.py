"""Licence scans by sentence rules.

Texts are cut into sentences and normalised; a normalised sentence that is a known
licence sentence (by its text, or by its pattern where holders, years and versions vary)
gives that sentence's identifier.  A sentence that refers to a licence by name ("released
under the terms of the ... license") gives the identifier of that name and version; one that
denies it ("is not released under ...") gives ``denied``, which no rule claims.  An SPDX tag
gives an identifier for each licence of its expression (OR, AND, brackets).
The text's sequence of identifiers is then matched against ordered rules: each rule is a run
of identifiers that stands for a licence; a matched run is taken out, so a later, shorter
rule can't claim its parts.  Identifiers that stand for a licence on their own (``ALONE``)
come after all runs, in their order in the text.  Identifiers that no rule claims stay in
``unclaimed``.

All of it is column expressions: no Python, no shuffle, one scan.  Every text is cut whole;
only normalised sentences with a key word (every known sentence has one of ``KEY``) are
looked up.

Defined cases: null and empty texts have no sentences and no licence; repeated
sentences count once in a run of the same identifier; columns of ``docs`` named like one
of ``ADDED`` are replaced by ``scan``, all others are untouched; repeated rows get equal
results; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Known sentences, normalised, that are always the same, by their text.
KNOWN = {
    "all rights reserved": "rights",
    "mit license": "mit_title",
    "the mit license": "mit_title",
    "the mit license (mit)": "mit_title",
    "isc license": "isc_title",
    "you may not use this file except in compliance with the license": "apache2_use",
    "you may obtain a copy of the license at": "apache2_copy",
    "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, without warranties or conditions of any kind, either express or implied": "apache2_warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache2_see",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit_notice",
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd_grant",
    "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met": "bsd_grant",
    "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer": "bsd_source",
    "see the gnu general public license for more details": "gnu_see",
    "see the gnu lesser general public license for more details": "gnu_see",
    "see the gnu affero general public license for more details": "gnu_see",
    "this source code form is subject to the terms of the mozilla public license, v2.0": "mpl2_subject",
    "this source code form is subject to the terms of the mozilla public": "mpl_subject",
    "license, v2.0": "license_v2",
    "mozilla public license version 2.0": "mpl2_title",
    "this software is provided as is, without any express or implied warranty": "zlib_as_is",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib_liable",
    "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:": "zlib_grant",
    "permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions": "zlib_grant",
    "boost software license version 1.0 august 17th, 2003": "boost_title",
    "do what the fuck you want to public license": "wtfpl_title",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed": "wtfpl_copy",
    "sil open font license version 1.1 26 february 2007": "ofl_title",
    "eclipse public license v 1.0": "epl1_title",
    "eclipse public license v 2.0": "epl2_title",
    "eclipse public license v1.0": "epl1_title",
    "eclipse public license v2.0": "epl2_title",
    "the artistic license 2.0": "artistic2_title",
    "the artistic license": "artistic1_title",
    "european union public licence v1.2": "eupl12_title",
    "common development and distribution license (cddl) version 1.0": "cddl1_title",
    "academic free license (afl) v3.0": "afl3_title",
    "microsoft public license (ms pl)": "mspl_title",
    "microsoft reciprocal license (ms rl)": "msrl_title",
    "apache license": "apache_title",
    "version 2.0, january 2004": "apache_v2",
    "the unlicense": "unlicense",
    "permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies": "postgresql_grant",
    "the universal permissive license (upl), version 1.0": "upl_title",
    "python software foundation license version 2": "psf_title",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "gnu general public license": "gpl_title",
    "gnu lesser general public license": "lgpl_title",
    "gnu affero general public license": "agpl_title",
    "version 2, june 1991": "gnu_v2",
    "version 2.1, february 1999": "gnu_v21",
    "version 3, 29 june 2007": "gnu_v3",
    "version 3, 19 november 2007": "gnu_v3",
}


#: Identifiers of the public SPDX list that stand in tags as they are, beside the families of ``_SPDX``.
SPDX = (
    "0BSD", "AFL-3.0", "Apache-1.0", "Apache-1.1", "Artistic-1.0", "Artistic-1.0-Perl", "Artistic-2.0", "Beerware", "BlueOak-1.0.0",
    "BSD-1-Clause", "BSD-3-Clause-Clear", "BSD-4-Clause", "BSL-1.0", "BUSL-1.1", "CDDL-1.0", "CDDL-1.1", "CECILL-2.1", "CPL-1.0",
    "curl", "ECL-2.0", "EFL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "FTL", "HPND", "ICU", "IJG", "IPL-1.0", "JSON",
    "Libpng", "libtiff", "LPPL-1.3c", "MIT-0", "MPL-1.0", "MPL-1.1", "MS-PL", "MS-RL", "MulanPSL-2.0", "NCSA", "NPOSL-3.0",
    "ODbL-1.0", "OFL-1.1", "OpenSSL", "OSL-3.0", "PDDL-1.0", "PHP-3.01", "PostgreSQL", "PSF-2.0", "Python-2.0", "QPL-1.0", "Ruby",
    "SISSL", "SSPL-1.0", "Unicode-3.0", "Unicode-DFS-2016", "UPL-1.0", "Vim", "W3C", "WTFPL", "X11", "Xnet", "Zlib", "ZPL-2.1",
)

#: Names in sentences that refer to a licence: (name, licence, versions that may follow).
NAMES = (
    ("academic free", "AFL", ("3.0",)), ("artistic", "Artistic", ("1.0", "2.0")), ("blue oak model", "BlueOak-1.0.0", ()), ("boost software", "BSL-1.0", ()),
    ("bsd 2 clause", "BSD-2-Clause", ()), ("2 clause bsd", "BSD-2-Clause", ()), ("simplified bsd", "BSD-2-Clause", ()), ("freebsd", "BSD-2-Clause", ()),
    ("bsd 3 clause", "BSD-3-Clause", ()), ("3 clause bsd", "BSD-3-Clause", ()), ("new bsd", "BSD-3-Clause", ()), ("modified bsd", "BSD-3-Clause", ()), ("revised bsd", "BSD-3-Clause", ()),
    ("bsd 4 clause", "BSD-4-Clause", ()), ("4 clause bsd", "BSD-4-Clause", ()), ("original bsd", "BSD-4-Clause", ()), ("bsd", "BSD", ()),
    ("business source", "BUSL-1.1", ()), ("common development and distribution", "CDDL", ("1.0", "1.1")), ("common public", "CPL-1.0", ()), ("do what the fuck you want to public", "WTFPL", ()),
    ("eclipse distribution", "BSD-3-Clause", ()), ("eclipse public", "EPL", ("1.0", "2.0")), ("educational community", "ECL-2.0", ()), ("european union public", "EUPL", ("1.1", "1.2")), ("eupl", "EUPL", ("1.1", "1.2")),
    ("freetype project", "FTL", ()), ("gnu free documentation", "GFDL", ("1.1", "1.2", "1.3")), ("isc", "ISC", ()), ("latex project public", "LPPL", ()), ("microsoft public", "MS-PL", ()), ("microsoft reciprocal", "MS-RL", ()),
    ("mozilla public", "MPL", ("1.0", "1.1", "2.0")), ("mulan permissive software", "MulanPSL-2.0", ()), ("open database", "ODbL-1.0", ()), ("open software", "OSL", ("3.0",)), ("openssl", "OpenSSL", ()), ("php", "PHP", ("3.01",)),
    ("postgresql", "PostgreSQL", ()), ("python software foundation", "PSF-2.0", ()), ("q public", "QPL-1.0", ()), ("ruby", "Ruby", ()), ("server side public", "SSPL-1.0", ()), ("sil open font", "OFL-1.1", ()), ("universal permissive", "UPL-1.0", ()),
    ("university of illinois/ncsa open source", "NCSA", ()), ("vim", "Vim", ()), ("w3c software", "W3C", ()), ("x11", "X11", ()), ("zlib/libpng", "Zlib", ()), ("zlib", "Zlib", ()), ("zope public", "ZPL", ("2.1",)),
)
#: Identifier and licence of a name with its version, and of the name alone.
REFERENCES = {f"ref {name} {v}".strip(): f"{licence}-{v}".strip("-") for name, licence, versions in NAMES for v in (*versions, "")}
#: A reference: its second group is the name, its third the version.
REFERENCE = (
    r"^(.* )?(?:released|distributed|licensed|available|provided|published|covered|subject) (?:under|by|to) (?:a |the )?(?:terms (?:and conditions )?of )?(?:a |the )?"
    rf"({'|'.join(n for n, *_ in sorted(NAMES, key=lambda x: -len(x[0])))})(?: licen[cs]e)?(?: \([a-z /]+\))?(?:,? (?:version |v ?)?([0-9]+\.[0-9]+))?(?:$|[ ,;(].*$)"
)
#: The start of a tag, and what stands between the licences of its expression, whose brackets go.
TAG, BETWEEN = r"(?i)^[^a-z]*spdx-license-identifier:", r"[ \t]+(?:OR|AND|or|and)[ \t]+"


def _later(version: str) -> str:
    return rf"{version}(\+| only| or later)?"


def _gnu(kind: str, version: str = "") -> str:
    number = rf",? (version|v) ?{version}(\.0)?" if version else ""
    return rf"(.* )?under (the )?(terms of )?(the )?gnu {kind}general public licen[cs]e{number}([ ,;(].*)?"


def _free(kind: str, version: str = "") -> str:
    number = rf"[;,] (either )?version {version}[ ,;].*" if version else ".*"
    return rf".* is free software[:;]? ?;? ?you can redistribute it and/?(or )? ?modify it under the terms of the gnu {kind}general public license as published by the free software foundation{number}"


def _creative(*parts: str) -> str:
    names = {"by": "by|attribution", "nc": "nc|noncommercial|non commercial", "nd": "nd|noderivs|noderivatives|no derivatives|no derivs", "sa": "sa|sharealike|share alike"}
    words = " ".join(f"({names[p]})" for p in parts)
    return rf"((.* )?under (a |the )?)?(cc|creative commons) {words}( (version |v)?[1-4]\.[05])?( international| unported| generic)?( public)?( licen[cs]e)?([ ,;(].*)?"


#: GNU licences: identifier, words of the name, versions (the longer ones first).
_GNU = (("agpl", "affero ", ("3",)), ("lgpl", "(lesser|library) ", ("2.1", "3", "2")), ("gpl", "", ("2", "3")))
#: Parts of the Creative Commons licences, the longer names first.
_CC = (("by", "nc", "sa"), ("by", "nc", "nd"), ("by", "nc"), ("by", "nd"), ("by", "sa"), ("by",))
#: SPDX tags: identifier, pattern of the tag's value, licence.
_SPDX = (
    ("apache2", r"apache 2\.0", "Apache-2.0"), ("mit", "mit", "MIT"), ("bsd3", "bsd 3 clause", "BSD-3-Clause"), ("bsd2", "bsd 2 clause", "BSD-2-Clause"), ("mpl2", r"mpl 2\.0", "MPL-2.0"),
    ("cc0", r"cc0 1\.0", "CC0-1.0"), ("isc", "isc", "ISC"), ("unlicense", "unlicense", "Unlicense"),
    *((f"{n}{v.replace('.', '')}", _later(rf"{n} {v if '.' in v else v + '.0'}".replace(".", r"\.")), f"{n.upper()}-{v if '.' in v else v + '.0'}") for n, _, versions in _GNU for v in versions),
    *(("cc_" + "_".join(p), rf"cc {' '.join(p)} [1-4]\.[05]", "-".join(["CC", *map(str.upper, p)])) for p in _CC),
)

#: (identifier, pattern over the whole normalised sentence) of known sentences with holders, years or
#: versions in them; the first that matches counts.  Patterns are read alike by Java and RE2.
SENTENCES = (
    *((f"spdx_{n}", rf"spdx license identifier:? {p}( with .*)?") for n, p, _ in _SPDX),
    ("denied", r"(.* )?(not|never|neither|nor|no longer|isnt|arent|wasnt|cannot)( [a-z]+){0,5} under (.* )?(licen[cs]e|cc|gnu|creative commons|eupl).*"),
    ("mpl_copy", r"if a copy of the mpl was not distributed with this file, you can obtain one at.*"),
    ("copyright", r"(copyright .*|\(c\) copyright .*)"),
    ("mit_ref", r"(.* )?(released|distributed|licensed|available|provided|published) under (the )?(terms of )?(the )?mit licen[cs]e( .*)?"),
    ("apache2_header", r"(.* )?licensed under the apache license, version 2\.0( \(the license\))?; you may not use this file except in compliance with the license"),
    ("apache2_ref", r"(.* )?licensed under the apache license, version 2\.0( \(the license\))?(;.*)?"),
    ("apache2_copy", r"you may obtain a copy of the license at .*"),
    ("mit_grant", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files \(the software\), to deal in the software without restriction.*"),
    ("as_is", r"the software is provided as is, without warranty of any kind, express or implied.*"),
    ("no_liability", r"in no event shall the (authors|author|copyright holders?|authors or copyright holders).* be liable for any.*"),
    ("boost_grant", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license.*"),
    ("isc_grant", r"permission to use, copy, modify, and/?(or )? ?distribute this software for any purpose with or without fee is hereby granted, provided that.*"),
    ("bsd_source", r"[1*]\.? redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("bsd_binary", r"([2*]\.? )?redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer.*"),
    ("bsd_endorse", r"([3*]\.? )?neither the name of .* may be used to endorse or promote products.*"),
    ("bsd_as_is", r"this software is provided by .* as is and any express or implied warranties.*"),
    *((f"{n}{v.replace('.', '')}_free", _free(kind, v.replace(".", r"\."))) for n, kind, versions in _GNU for v in versions),
    *((f"{n}_free", _free(kind)) for n, kind, _ in _GNU),
    ("gnu_warranty", r"this (program|library) is distributed in the hope that it will be useful, but without any warranty.*"),
    ("gnu_copy", r"you should have received a copy of the gnu (lesser |affero |library )?general public license along with this (program|library).*"),
    ("cc0", r"(.* )?(dedicated to the public domain|cc0 1\.0 universal)( .*)?(license|licence|copyright.*)?"),
    *((f"{n}{v.replace('.', '')}_ref", _gnu(kind, v.replace(".", r"\."))) for n, kind, versions in _GNU for v in versions),
    *((f"{n}_ref", _gnu(kind)) for n, kind, _ in _GNU),
    *(("_".join(("cc", *p)), _creative(*p)) for p in _CC),
)


def _runs(name: str, *ids: str, least: int = 1) -> tuple[tuple[str, tuple[str, ...]], ...]:
    """A rule for the whole run of ``ids`` and, in order, for its beginnings of ``least`` or more."""
    return tuple((name, ids[:k]) for k in range(len(ids), least - 1, -1))


def _gnu_name(n: str, v: str = "") -> str:
    return n.upper() + (f"-{v if '.' in v else v + '.0'}" if v else "")


#: Ordered: (licence, run of identifiers).
_ORDERED = (
    *_runs("Zlib", "zlib_as_is", "zlib_liable", "zlib_grant", least=2),
    ("Apache-2.0", ("apache_title", "apache_v2")),
    *_runs("MPL-2.0", "mpl_subject", "license_v2", "mpl_copy", least=2),
    *_runs("MPL-2.0", "mpl2_subject", "mpl_copy"),
    *_runs("WTFPL", "wtfpl_title", "wtfpl_copy"),
    *_runs("BSL-1.0", "boost_title", "boost_grant"),
    ("BSL-1.0", ("boost_grant",)), ("WTFPL", ("wtfpl_copy",)), ("Zlib", ("zlib_grant",)), ("MPL-2.0", ("mpl2_title",)), ("OFL-1.1", ("ofl_title",)), ("EPL-1.0", ("epl1_title",)), ("EPL-2.0", ("epl2_title",)),
    ("Artistic-2.0", ("artistic2_title",)), ("Artistic-1.0", ("artistic1_title",)), ("EUPL-1.2", ("eupl12_title",)), ("CDDL-1.0", ("cddl1_title",)), ("AFL-3.0", ("afl3_title",)), ("MS-PL", ("mspl_title",)), ("MS-RL", ("msrl_title",)),
    ("PostgreSQL", ("postgresql_grant",)), ("UPL-1.0", ("upl_title",)), ("PSF-2.0", ("psf_title",)),
    *_runs("MIT", "mit_grant", "mit_notice", "as_is", "no_liability", least=2),
    *_runs("ISC", "isc_grant", "as_is", "no_liability"),
    *_runs("BSD-3-Clause", "bsd_grant", "bsd_source", "bsd_binary", "bsd_endorse", "bsd_as_is", "no_liability", least=4),
    *_runs("BSD-2-Clause", "bsd_grant", "bsd_source", "bsd_binary", "bsd_as_is", "no_liability", least=3),
    *_runs("Apache-2.0", "apache2_header", "apache2_copy", "apache2_warranty", "apache2_see"),
    *_runs("Apache-2.0", "apache2_ref", "apache2_use", "apache2_copy", "apache2_warranty", "apache2_see"),
    *(rule for n, _, versions in _GNU for v in (*versions, "") for rule in _runs(_gnu_name(n, v), f"{n}{v.replace('.', '')}_free", "gnu_warranty", "gnu_see", "gnu_copy")),
    *((_gnu_name(n, v), (f"{n}_title", f"gnu_v{v.replace('.', '')}")) for n, v in (("agpl", "3"), ("lgpl", "2.1"), ("lgpl", "3"), ("gpl", "2"), ("gpl", "3"))),
    *((_gnu_name(n), (f"{n}_title",)) for n, _, _ in _GNU),
    ("MIT", ("mit_ref",)),
    ("MIT", ("mit_title",)),
    ("ISC", ("isc_title",)),
    ("CC0-1.0", ("cc0",)),
    ("Unlicense", ("unlicense",)),
    *((name, (f"spdx_{n}",)) for n, _, name in _SPDX),
    *((_gnu_name(n, v), (f"{n}{v.replace('.', '')}_ref",)) for n, _, versions in _GNU for v in (*versions, "")),
    *(("-".join(("CC", *map(str.upper, p))), ("_".join(("cc", *p)),)) for p in _CC),
)

#: Runs of two identifiers or more, in order; and the licences of identifiers that stand alone.
RULES = tuple((name, run) for name, run in _ORDERED if len(run) > 1)
ALONE = {run[0]: name for name, run in _ORDERED if len(run) == 1} | {f"spdx_{x}": x for x in SPDX} | REFERENCES
KNOWN |= {f"spdx license identifier: {x.lower().replace('-', ' ')}": f"spdx_{x}" for x in SPDX}

#: One of these is in every known sentence, normalised.
KEY = r"(licen[cs]e|eupl|mozilla public|january 2004|of the mpl|copyright|rights reserved|permission|redistribut|warrant|liable|endorse|free software|public domain|unencumbered|cc0|cc (by|attribution)|creative commons|june (1991|2007)|february 1999|november 2007)"
#: A text without one of these words of ``KEY``, in lower case and without quotes, has no known sentence and isn't cut.
WORDS = r"(licen[cs]e|eupl|mozilla|january|mpl|copyright|rights|permission|redistribut|warrant|liable|endorse|software|domain|unencumbered|cc[^a-z]|creative|june|february|november)"
#: Cuts of a text into sentences, in order: (pattern, what stands for it), U+0001 being the mark.
CUTS = (
    (r"\b([vV])\.[ \t]+([0-9])", "$1$2"),
    (r"^[ \t]*(?:#+|\*+|//+|--+|;+|%+|/\*+)[ \t]?", ""),
    (r"(?i)(SPDX-License-Identifier:[^\r\n]*?)[ \t]*(?:\*/|-->)?[ \t]*(?:\r?\n|\z)", "\u0001$1\u0001"),
    (r"\r?\n[ \t]*\r?\n", "\u0001"),
    (r"([.!?])[ \t\r\n]+", "$1\u0001"),
    (r"([^,\r\n])\r?\n[ \t]*([A-Z0-9(][^A-Z])", "$1\u0001$2"),
)
QUOTES = "[\"'`“”‘’]"


def _marked(text: Column) -> Column:
    """The text with a mark (U+0001) after each sentence; comment signs at line starts go.

    Sentences end at . ! or ? before white space, at a blank line, at either end of an SPDX
    tag, and at a line's end unless it has a comma there or the next line goes on in lower
    case or in capitals.
    """
    for pattern, mark in CUTS:
        text = F.regexp_replace(text, f"(?md){pattern}" if pattern.startswith("^") else pattern, mark)
    return text


def normalised(sentence: Column) -> Column:
    """Lower case, quotes gone, dashes and white space as single spaces, no end mark."""
    plain = F.regexp_replace(F.lower(sentence), QUOTES, "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[-–— \t\r\n]+", " "), r"[.!? ]+$", ""))


def identifier(sentence: Column) -> Column:
    """The known sentence's identifier, or null: by its text, else the first pattern that matches it whole, else by the name it refers to."""
    found = None
    for name, pattern in SENTENCES:
        matches = sentence.rlike(f"^(?:{pattern})$")
        found = F.when(matches, name) if found is None else found.when(matches, name)
    named = F.concat(F.lit("ref "), F.regexp_extract(sentence, REFERENCE, 2))
    full = F.concat_ws(" ", named, F.regexp_extract(sentence, REFERENCE, 3))
    by_name = F.when(sentence.rlike(REFERENCE), F.coalesce(*(F.when(x.isin(list(REFERENCES)), x) for x in (full, named))))
    return F.when(sentence.rlike(KEY), F.coalesce(F.try_element_at(_map(KNOWN), sentence), found, by_name))


def _map(table_: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table_.items() for x in pair])


def _licences_of_tags(sentences: Column) -> Column:
    """Sentences, with a tag for each licence of an SPDX expression."""
    each = lambda s: F.transform(F.split(F.translate(s, "()", ""), BETWEEN), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("SPDX-License-Identifier: "), x)))
    return F.flatten(F.transform(sentences, lambda s: F.when(s.rlike(TAG), each(s)).otherwise(F.array(s))))


def _matched(sequence: Column) -> Column:
    """(rest, licences) of a ``|a|b|`` sequence, rule after rule."""
    rules = F.array(*[F.struct(F.lit("|" + "|".join(run) + "|").alias("run"), F.lit(name).alias("name")) for name, run in RULES])
    start = F.struct(sequence.alias("rest"), F.array().cast("array<string>").alias("licences"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["rest"], rule["run"])
        rest = F.when(hit, F.replace(state["rest"], rule["run"], F.lit("||"))).otherwise(state["rest"])
        licences = F.when(hit & ~F.array_contains(state["licences"], rule["name"]), F.array_append(state["licences"], rule["name"])).otherwise(state["licences"])
        return F.struct(rest.alias("rest"), licences.alias("licences"))

    return F.aggregate(rules, start, step)


ADDED = ("sentence_ids", "licenses", "unclaimed")


def scan(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` with sentence_ids (in order, runs of one collapsed), licenses and unclaimed.

    Notices of holders (copyright, rights) belong to any licence and are no part of a run.
    """
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    sentences = F.transform(_licences_of_tags(F.split(_marked(text), "\u0001")), normalised)
    some = F.translate(F.lower(text), QUOTES[1:-1], "").rlike(WORDS)
    ids = F.when(some, F.filter(F.transform(sentences, identifier), lambda x: x.isNotNull())).otherwise(F.array().cast("array<string>"))
    one = F.aggregate(ids, F.array().cast("array<string>"), lambda acc, x: F.when(F.try_element_at(acc, F.lit(-1)).eqNullSafe(x), acc).otherwise(F.array_append(acc, x)))
    rows = docs.select(*[F.col(c) for c in docs.columns if c not in ADDED], one.alias("sentence_ids"))
    owned = F.filter(F.col("sentence_ids"), lambda x: ~x.isin("copyright", "rights"))
    sequence = F.when(F.size(owned) > 0, F.concat(F.lit("|"), F.array_join(owned, "|"), F.lit("|"))).otherwise(F.lit(""))
    match = F.when(F.size("sentence_ids") > 0, _matched(sequence))
    empty = F.array().cast("array<string>")
    packed = rows.withColumn("licenses", match)  # the struct first, so that it is computed once
    left = F.coalesce(F.filter(F.split(F.col("licenses.rest"), r"\|"), lambda x: x != ""), empty)
    alone = F.transform(F.filter(left, lambda x: x.isin(list(ALONE))), lambda x: F.try_element_at(_map(ALONE), x))
    licences = F.array_distinct(F.concat(F.coalesce("licenses.licences", empty), alone))
    return packed.withColumns({"licenses": licences, "unclaimed": F.filter(left, lambda x: ~x.isin(list(ALONE)))})


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = [F.array_join(c, ",").alias(c) for c in ADDED]
    return found.select("doc_id", *joined, F.size("licenses").cast("long").alias("n_licenses"))


def oracle() -> str:
    def lit(x: str) -> str:
        return "'" + x.replace("'", "''").replace("\u0001", "' || chr(1) || '") + "'"

    cases = "\n".join(f"    WHEN regexp_full_match(s, {lit(p)}) THEN {lit(n)}" for n, p in SENTENCES)
    texts, alone, named = (", ".join(f"({lit(t)}, {lit(n)})" for t, n in d.items()) for d in (KNOWN, ALONE, {x: x for x in REFERENCES}))
    marked = "coalesce(text, '')"
    for pattern, mark in CUTS:
        mark = mark.replace("$1", "\\1").replace("$2", "\\2")
        marked = f"regexp_replace({marked}, {lit(('(?m)' if pattern.startswith('^') else '') + pattern)}, {lit(mark)}, 'g')"
    steps = []
    for i, (name, run) in enumerate(RULES):
        mark = lit("|" + "|".join(run) + "|")
        steps.append(f"r{i + 1} AS (SELECT doc_id, ids, CASE WHEN contains(rest, {mark}) THEN replace(rest, {mark}, '||') ELSE rest END AS rest, CASE WHEN contains(rest, {mark}) AND NOT list_contains(lic, {lit(name)}) THEN list_append(lic, {lit(name)}) ELSE lic END AS lic FROM r{i})")
    return rf"""
WITH marked AS (SELECT doc_id, string_split({marked}, chr(1)) AS ss FROM documents),
whole AS (SELECT doc_id, unnest(ss) AS s1, generate_subscripts(ss, 1) AS pos1 FROM marked),
tags AS (SELECT doc_id, pos1, CASE WHEN regexp_matches(s1, {lit(TAG)}) THEN string_split_regex(translate(s1, '()', ''), {lit(BETWEEN)}) ELSE [s1] END AS parts FROM whole),
part AS (SELECT doc_id, pos1, unnest(parts) AS s2, generate_subscripts(parts, 1) AS pos2 FROM tags),
cut AS (SELECT doc_id, pos1 * 1000000 + pos2 AS pos, CASE WHEN pos2 = 1 THEN s2 ELSE 'SPDX-License-Identifier: ' || s2 END AS s0 FROM part),
norm AS (SELECT doc_id, pos, trim(regexp_replace(regexp_replace(regexp_replace(lower(s0), {lit(QUOTES)}, '', 'g'), '[-\x{{2013}}\x{{2014}} \t\r\n]+', ' ', 'g'), '[.!? ]+$', ''), ' ') AS s FROM cut),
same(text, id) AS (VALUES {texts}),
alone(id, name) AS (VALUES {alone}),
ref(id, id2) AS (VALUES {named}),
keyed AS (SELECT *, 'ref ' || regexp_extract(s, {lit(REFERENCE)}, 2) AS by_name, trim('ref ' || regexp_extract(s, {lit(REFERENCE)}, 2) || ' ' || regexp_extract(s, {lit(REFERENCE)}, 3)) AS by_version
  FROM norm WHERE regexp_matches(s, {lit(KEY)})),
named AS (SELECT doc_id, pos, coalesce(same.id, CASE
{cases}
    END, r1.id, r2.id) AS id FROM keyed LEFT JOIN same ON same.text = keyed.s LEFT JOIN ref r1 ON r1.id = by_version LEFT JOIN ref r2 ON r2.id = by_name),
known AS (SELECT *, lag(id) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM named WHERE id IS NOT NULL),
seqs AS (SELECT doc_id, list(id ORDER BY pos) AS ids, coalesce('|' || string_agg(id, '|' ORDER BY pos) FILTER (WHERE id NOT IN ('copyright', 'rights')) || '|', '') AS seq
  FROM known WHERE before IS DISTINCT FROM id GROUP BY doc_id),
r0 AS (SELECT doc_id, ids, seq AS rest, []::VARCHAR[] AS lic FROM seqs),
{", ".join(steps)},
rest AS (SELECT doc_id, list_filter(string_split(rest, '|'), lambda x: x <> '') AS left_ids FROM r{len(RULES)}),
spread AS (SELECT doc_id, unnest(left_ids) AS id, generate_subscripts(left_ids, 1) AS pos FROM rest),
settled AS (SELECT doc_id, list(name ORDER BY pos) FILTER (WHERE name IS NOT NULL) AS names, string_agg(id, ',' ORDER BY pos) FILTER (WHERE name IS NULL) AS unclaimed FROM spread LEFT JOIN alone USING (id) GROUP BY doc_id),
both_ AS (SELECT r.doc_id, ids, list_concat(lic, coalesce(names, []::VARCHAR[])) AS lic, unclaimed FROM r{len(RULES)} r LEFT JOIN settled USING (doc_id)),
final AS (SELECT doc_id, ids, list_filter(lic, lambda x, i: list_position(lic, x) = i) AS lic, unclaimed FROM both_)
SELECT d.doc_id, coalesce(array_to_string(f.ids, ','), '') AS sentence_ids, coalesce(array_to_string(f.lic, ','), '') AS licenses,
       coalesce(f.unclaimed, '') AS unclaimed, coalesce(len(f.lic), 0)::BIGINT AS n_licenses
FROM documents d LEFT JOIN final f USING (doc_id)
"""


QUERIES = {"op1_license_scan": op1_license_scan, "op1_license_families": op1_license_scan}
ORACLES = {"op1_license_scan": oracle()}

"""The training-data operators against brute force, on small tables with odd rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from paperloom.llm import op1_licenses, op2_token_ids, op3_mixing, op4_html, op5_toxicity, op6_near_dedup, op7_warc, op8_quality, op9_substrings, op10_decontamination
from paperloom.llm.queries import oracle_sql, queries

ROWS = [
    (1, "the cat sat on the mat and the dog ran off to the far hill by night", "en", "a", 0),
    (2, None, None, None, 0),
    (3, "", "en", "b", 0),
    (4, " \n\t ", "en", "b", 0),
    (5, "one two", "en", "c", 0),
    (6, "word " * 40_000, "de", "a", 0),
    (6, "word " * 40_000, "de", "a", 0),
    (None, "a text without an id that goes on for some words", "en", "d", 0),
    (8, "straße ÉTÉ 漢字 <|endoftext|> don't x́ a b", "fr", "a", 0),
    (9, "the cat sat on the mat and the dog ran off to the far hill by night", "en", "a", 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_its_sql(spark, data, name):
    from oracle import spark_rows, sql_rows

    assert spark_rows(queries()[name](spark, data)) == sql_rows(oracle_sql()[name], data)


def test_licenses(spark, docs, none):
    assert op1_licenses.scan(none).count() == 0
    assert all(not r.licenses for r in op1_licenses.scan(docs).collect())
    rows = spark.createDataFrame([(i, t, "mine") for i, (t, _) in enumerate(LICENCE_TEXTS)], "i int, text string, licenses string")
    got = {r.i: (r.licenses, r.unclaimed) for r in op1_licenses.scan(rows).collect()}
    assert got == {i: (want, []) for i, (_, want) in enumerate(LICENCE_TEXTS)}
    key = re.compile(op1_licenses.KEY)
    assert all(key.search(t) for t in op1_licenses.KNOWN)
    for name, pattern in op1_licenses.SENTENCES:
        assert key.search(pattern.replace("[cs]", "c").replace("(by|attribution)", "by")), name


MIT_TEXT = """Copyright (c) 2020 Ann

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, and more.

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software."""
APACHE_HEADER = """   Copyright 2020 Ann

   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
   See the License for the specific language governing permissions and
   limitations under the License."""


def gnu_header(kind, version, thing="program"):
    return f"""    This {thing} is free software: you can redistribute it and/or modify
    it under the terms of the GNU {kind}General Public License as published by
    the Free Software Foundation, either version {version} of the License, or
    (at your option) any later version.

    This {thing} is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU {kind}General Public License for more details.

    You should have received a copy of the GNU {kind}General Public License
    along with this {thing}.  If not, see <https://www.gnu.org/licenses/>."""


BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""
LICENCE_TEXTS = [
    (MIT_TEXT + "\n\nLicensed under the Apache License, Version 2.0.", ["MIT", "Apache-2.0"]),
    (APACHE_HEADER, ["Apache-2.0"]),
    ("".join(f"# {x}\n" for x in APACHE_HEADER.split("\n")) + "import os", ["Apache-2.0"]),
    ("This work is licensed under the Apache License,\nVersion 2.0.", ["Apache-2.0"]),
    (gnu_header("", "3"), ["GPL-3.0"]),
    (gnu_header("", "2"), ["GPL-2.0"]),
    (gnu_header("Affero ", "3"), ["AGPL-3.0"]),
    (gnu_header("Lesser ", "2.1", "library"), ["LGPL-2.1"]),
    ("                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\nMore text.", ["GPL-3.0"]),
    (BSD_TEXT, ["BSD-3-Clause"]),
    ("MIT License\n\n" + MIT_TEXT, ["MIT"]),
]


LICENCE_LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
    "Released under the MIT License.": "MIT",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "All rights reserved.": "",
    "Distributed under the terms of the GNU Lesser General Public License v2.1.": "LGPL-2.1",
    "Licensed under the GNU Affero General Public License, version 3 or later.": "AGPL-3.0",
    "Licensed under the GNU General Public License.": "GPL",
    "This text is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 2.5 Generic License.": "CC-BY-NC-SA",
    "Licensed under CC BY-ND 1.0.": "CC-BY-ND",
    "Published under the Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License": "CC-BY-NC-ND",
    "Licensed under CC-BY-SA 3.0": "CC-BY-SA",
    "Licensed under CC BY 4.0": "CC-BY",
    "SPDX-License-Identifier: AGPL-3.0-or-later": "AGPL-3.0",
    "SPDX-License-Identifier: CC-BY-NC-4.0": "CC-BY-NC",
    "The licence of the car was under review.": "",
}


def test_license_families(spark, docs):
    rows = spark.createDataFrame(list(LICENCE_LINES.items()), "text string, want string")
    got = op1_licenses.scan(rows).collect()
    assert {r.text: ",".join(r.licenses) for r in got} == LICENCE_LINES and not any(r.unclaimed for r in got)



def test_license_families_cut_by_lines(spark):
    want = {
        "CC0 1.0 Universal": ("cc0", "CC0-1.0"),
        "This work is dedicated to the public\ndomain.": ("cc0", "CC0-1.0"),
        "All rights\nreserved.": ("rights", ""),
        "# SPDX-License-Identifier: MIT\nimport os\nprint(os)": ("spdx_mit", "MIT"),
        "/* SPDX-License-Identifier: GPL-2.0-only */\nint main;": ("spdx_gpl2", "GPL-2.0"),
        "a line before\n# SPDX-License-Identifier: LGPL-2.1-or-later": ("spdx_lgpl21", "LGPL-2.1"),
        "Licensed under CC\nBY 4.0": ("cc_by", "CC-BY"),
    }
    rows = spark.createDataFrame([(t,) for t in [*want, *LICENCE_LINES, None]], "text string")
    got = {r.text: (",".join(r.sentence_ids), ",".join(r.licenses)) for r in op1_licenses.scan(rows).collect()}
    assert {t: got[t] for t in want} == want and got[None] == ("", "")
    assert {t: got[t][1] for t in LICENCE_LINES} == LICENCE_LINES


def test_token_ids_round_trip(spark, docs, none):
    assert op2_token_ids.encode_documents(none).count() == 0
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op2_token_ids.tokenizer_path())
    at, want = 0, []
    for r in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(r[1] or "", add_special_tokens=False).ids, 1]
        want.append((r[0], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((tuple(r) for r in op2_token_ids.encode_documents(docs).collect()), key=lambda r: r[1]) == want


def test_elias_fano():
    rng = np.random.default_rng(1)
    for n, top in ((1, 1), (5, 3), (1000, 10**7), (2000, 50)):
        values = np.sort(rng.integers(0, top, n))
        e = op2_token_ids.EliasFano.from_bytes(op2_token_ids.EliasFano.build(values, top).to_bytes())
        assert (e.values() == values).all() and [e.select(i) for i in range(n)] == values.tolist()


def test_mixing(spark, docs, none):
    assert op3_mixing.mix(none).count() == 0
    rows = op3_mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and all(r.taken <= 3 * r.size for r in rows)
    many = spark.createDataFrame([(i, "w " * (1 + i % 7), "en", f"s{i % 4}", 0) for i in range(4000)], SCHEMA)
    sums = collections.defaultdict(int)
    targets = {}
    for r in op3_mixing.mix(many).collect():
        sums[r.source] += r.taken
        targets[r.source] = r.target
    assert all(abs(sums[s] - t) <= 7 for s, t in targets.items())
    assert abs(sum(targets.values()) - sum(1 + i % 7 for i in range(4000))) < 1e-6


def test_html():
    page = """<head><title>t</title></head><p>A <b>b</b><p>B<br>C<ul><li>x<li>y<ol start=4><li>z</ol></ul>
    <table><tr><th>Name<th>N<tr><td>pear<td>12</table><div hidden>no</div><p style="display: none">no</p><script>1<2</script><pre>a
  b</pre>&amp;"""
    assert op4_html.visible_text(page) == "A b\n\nB\nC\n\n- x\n- y\n  4. z\n\nName | N\npear | 12\n\na\n  b\n\n&"
    assert op4_html.visible_text("") == "" and op4_html.visible_text("<<<a") is not None
    assert len(op4_html.visible_text("<div>" * 50_000 + "deep")) == 4


def test_toxicity(spark, docs, none):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(base, k=60)
        if toxic := i % 5 == 0:
            words[rng.randrange(60)] = words[rng.randrange(60)] = "vilewords"
        rows.append((i, " ".join(words), "en", "a", 0))
        labels.append((i, i % 2, int(toxic)))
    corpus = spark.createDataFrame(rows, SCHEMA)
    model = op5_toxicity.fit(corpus.filter("doc_id < 400"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r.doc_id: r for r in op5_toxicity.score(corpus.filter("doc_id >= 400"), model).collect()}
    right = sum(r.rejected == (i % 5 == 0) for i, r in got.items())
    assert right >= 0.97 * len(got)
    assert op5_toxicity.score(docs, model).count() == len(ROWS) and op5_toxicity.score(none, model).count() == 0
    empty = op5_toxicity.fit(none, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert not any(r.rejected for r in op5_toxicity.score(docs, empty).collect())


def shingle_sets(texts, n=5):
    return [{tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if (w := (t or "").split()) else set() for t in texts]


def test_near_duplicates(spark, docs, none):
    assert op6_near_dedup.classes(none).count() == 0
    assert {(r.doc_id, r.class_id) for r in op6_near_dedup.classes(docs).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (None, None), (8, 8), (9, 1)}
    rng = random.Random(5)
    texts = []
    for g in range(12):
        base = [f"{g}-{rng.randrange(500)}" for _ in range(120)]
        texts.append(" ".join(base))
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(120)] = f"e{rng.randrange(40)}"
            texts.append(" ".join(copy))
    sets, label = shingle_sets(texts), list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    df = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in enumerate(texts)], SCHEMA)
    assert {r.doc_id: r.class_id for r in op6_near_dedup.classes(df).collect()} == dict(enumerate(label))
    assert {r.doc_id for r in op6_near_dedup.keep_one(df).collect()} == set(label)


def test_dart_signatures_estimate_weighted_similarity():
    import pyarrow as pa

    from paperloom.llm.words import words_of

    a, b = "a b c d e f g h i j " * 3 + "k l m n", "a b c d e f g h i j " * 2 + "o p q r"
    found = op6_near_dedup.shingles(words_of(pa.array([a, b])), 1, True)
    s = op6_near_dedup.signatures(*found, 2, 4000)
    x, y = (collections.Counter(t.split()) for t in (a, b))
    want = sum((x & y).values()) / sum((x | y).values())
    assert abs((s[0] == s[1]).mean() - want) < 0.03


def test_warc(spark):
    big = "<p>" + "x" * 5000
    rows = [(1, "u", big), (2, None, big), (3, "v", "é" * 100), (4, "v", "é" * 100), (5, "w", None), (6, "w", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    files = op7_warc.write_archives(op7_warc.record_types(pages), op7_warc.fresh_path(spark, "warc-test"))
    got = {r.page_id: r for r in op7_warc.records_of(op7_warc.read_archives(files, False)).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {1: ("revisit", 2), 2: ("response", None), 3: ("response", None), 4: ("response", None), 5: ("response", None), 6: ("response", None)}
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    chunks = op7_warc.read_archives(files, True, chunk=1000).filter("page_id = 2").orderBy("chunk_no").collect()
    assert b"".join(bytes(c.data) for c in chunks) == big.encode() and len(chunks) == 6
    assert chunks[1].digest_so_far == hashlib.sha1(big.encode()[:2000]).hexdigest()


def test_quality(spark, docs, none):
    def run(df):
        return op8_quality.judge(op8_quality.stored(op8_quality.measures(df, op8_quality.model_path()), "quality-test")).collect()

    assert run(none) == []
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_repeat_words, r.base_failed) for r in run(docs))
    want = collections.Counter()
    for i, t, *_ in ROWS:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        at = collections.defaultdict(list)
        for k in range(len(w) - 4):
            at[tuple(w[k : k + 5])].append(k)
        again = {k + j for x in at.values() if len(x) > 1 for k in x for j in range(5)}
        want[(i, len(w), sum(map(len, w)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w))] += 1
    assert got == want



@pytest.mark.parametrize("size", [600, 60])
def test_quality_rejects_planted_junk(spark, size):
    """Junk is a fifth of the distinct texts and copied, in tables of many and of few rows."""
    rng = random.Random(23)
    base = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 9))) for _ in range(2000)]
    rows, junk = [], set()
    for i in range(size):
        words = rng.choices(base, k=150)
        if i % 5 == 0:
            junk.add(i)
            words = [w + rng.choice(["***", "&&&", "%%%"]) for w in words] if i % 10 else " | ".join(words).split(" ")
        rows += [(i, " ".join(words), "en", "a", 0)] * (3 if i % 5 == 0 else 1)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.base_failed, r.kept) for r in op8_quality.judge(op8_quality.stored(op8_quality.measures(df, op8_quality.model_path()), "quality-junk")).collect()}
    assert not any(failed for failed, _ in got.values())
    assert {i for i, (_, kept) in got.items() if not kept} == junk


def test_scripts():
    import pyarrow as pa

    from paperloom.llm.words import words_of

    assert op8_quality.scripts(words_of(pa.array([None, "", "abc д", "где a", "", "漢字 漢字 a", " 1 "]))).tolist() == [1, 1, 1, 3, 1, 9, 1]


def brute_repeats(rows, width):
    seen = collections.Counter()
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for _, w in split:
        seen.update(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    out = []
    for i, w in split:
        gone = {k + j for k in range(len(w) - width + 1) if seen[tuple(w[k : k + width])] > 1 for j in range(width)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("shard", [512, 1])
def test_substrings(spark, none, shard):
    assert op9_substrings.remove_repeats(none).count() == 0
    rng = random.Random(7)
    passage = [f"p{i}" for i in range(60)]
    rows = [(1, None), (2, ""), (3, "same " * 50), (4, "short text")]
    for i in range(5, 40):
        words = [f"{rng.randrange(30)}" for _ in range(rng.randrange(20, 120))]
        if i % 2:
            a = rng.randrange(25)
            words[10:10] = passage[a : a + rng.randrange(30, 60)]
        rows.append((i, " ".join(words)))
    rows += [rows[10], (None, rows[11][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in op9_substrings.remove_repeats(df, shard=shard).collect()), key=str)
    assert got == brute_repeats(rows, 35)


def test_a_phrase_in_many_repeated_passages(spark):
    """One phrase is the anchor of many different passages, each of which occurs twice."""
    rng = random.Random(9)
    phrase = [f"q{i}" for i in range(8)]
    passages = [[f"{rng.randrange(10**6)}" for _ in range(30)] + phrase + [f"{rng.randrange(10**6)}" for _ in range(30)] for _ in range(60)]
    rows = [(2 * i + k, " ".join([f"x{i}-{k}"] + p)) for i, p in enumerate(passages) for k in range(2)]
    for shard in (5, 1000):
        got = sorted((tuple(r) for r in op9_substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), shard=shard).collect()), key=str)
        assert got == brute_repeats(rows, 35)


def test_decontamination(spark, docs, none):
    rng = random.Random(11)
    items = [(i, " ".join(f"b{rng.randrange(900)}" for _ in range(rng.randrange(30, 60))) + ".") for i in range(20)] + [(20, None), (21, "")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = []
    for i in range(200):
        words = [f"c{rng.randrange(3000)}" for _ in range(150)]
        if i % 4 == 0:
            leak = items[i % 20][1].split()
            for k in rng.sample(range(len(leak)), 3):
                leak[k] = "changed"
            words[70:70] = leak
        rows.append((i, " ".join(words), "en", "a", 0))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.contaminated, r.item_id) for r in op10_decontamination.contaminated(df, bench).collect()}
    assert {i for i, (bad, _) in got.items() if bad} == set(range(0, 200, 4))
    assert all(got[i][1] == i % 20 for i in range(0, 200, 4))
    assert not any(r.contaminated for r in op10_decontamination.contaminated(docs, bench).collect())
    assert op10_decontamination.contaminated(none, bench).count() == 0
    assert not any(r.contaminated for r in op10_decontamination.contaminated(docs, bench.limit(0)).collect())
    assert op10_decontamination.common_subsequence([b"a b c d".split()], b"x a c y d".split()) == 3
    assert op10_decontamination.common_subsequence([b"a b".split(), b"c d".split()], b"c d x a b".split()) == 4


def test_decontamination_finds_copies_of_thousands_of_items(spark):
    rng = random.Random(17)
    words = [f"v{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randrange(15, 60)))) for i in range(3000)]
    rows = []
    for i in range(600):
        text = rng.choices(words, k=60) + [f"c{rng.randrange(3000)}" for _ in range(60)]
        if i % 2 == 0:
            text[60:60] = items[5 * i][1].split()
        rows.append((i, " ".join(text), "en", "a", 0))
    df = spark.createDataFrame(rows, SCHEMA)
    index = op10_decontamination.build_index(df, items, rank=64)
    got = {r.doc_id: r.item_id for r in op10_decontamination.search(df, index).collect() if r.contaminated}
    assert got == {i: 5 * i for i in range(0, 600, 2)}



def test_decontamination_of_long_common_and_nameless_items(spark):
    rng = random.Random(29)
    word = lambda kind, n: " ".join(f"{kind}{rng.randrange(2000)}" for _ in range(n))
    common = "it is in the of a to and as it was on the"
    items = [(1, word("a", 206)), (2, word("b", 400)), (3, word("d", 900)), (None, word("n", 30)), (4, common), (5, word("e", 40))]
    rows = []
    for i in range(100):
        parts = [" ".join(rng.sample(common.split(), 13)) + " " + word("c", 8) for _ in range(8)]
        rows.append([i, " ".join(parts), "en", "a", 0])
    for i, (_, text) in enumerate(items):
        words = text.split()
        if len(words) > 100:
            for k in range(5, len(words), 9):
                words[k] = "changed"
        rows[10 * i][1] = f"{word('c', 50)} {' '.join(words)} {word('c', 50)}"
    df = spark.createDataFrame([tuple(r) for r in rows], SCHEMA)
    found = op10_decontamination.contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: (r.item_id, r.n_items) for r in found.collect() if r.contaminated}
    assert got == {10 * i: (items[i][0], 1) for i in range(len(items))}


def test_pipeline(spark, data):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = corpus_pipeline.table(spark, data, "documents")
    kept, columns = docs.count(), docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, data), f"test-{name}")
        assert docs.columns == columns and 0 < docs.count()
        if name != "mixing":
            assert docs.count() <= kept
            kept = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert out.count() == docs.count()

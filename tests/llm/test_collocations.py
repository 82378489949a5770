"""op11 against a plain version, with odd texts, small bitmaps and small slices."""

import collections
import random
import re

import pytest

from paperloom.llm import op11_collocations

SCHEMA = "doc_id long, text string, lang string, phrase string"
SMALL = ["the old tree stood by the old tree. The OLD tree", None, "", " \t\n", "a", "x,y;z", "one two\tthree  four five\x0bsix", "É é ÉCOLE école", "New York new york NEW YORK\nnew york"]


def plain(rows, least, top, share):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang, text = lang if lang is not None else "und", text or ""
        folded = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", folded):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    scored = []
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    for (lang, p), a in cand.items():
        around = [b for (l2, q), b in cand.items() if l2 == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= share * a for b in around):
            continue
        score, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        scored.append((lang, -score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    out, rank = [], collections.Counter()
    for lang, score, a, p, left, right in sorted(scored):
        rank[lang] += 1
        if rank[lang] <= top:
            out.append((lang, rank[lang], p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(12)] + ["The", "OLD", "naïve", "漢字"]
    made = [" ".join(rng.choices(words, k=rng.randint(1, 60))).replace("w3 ", "w3. ").replace("w5", "w5 w6 w7") for _ in range(60)]
    return [(rng.choice(["en", "de", None]), t) for t in made + SMALL * 3]


@pytest.mark.parametrize(("buckets", "size"), [(1 << 24, 1 << 22), (64, 150), (1 << 18, 40)])
def test_phrases(spark, buckets, size):
    rows = texts(buckets)
    docs = spark.createDataFrame([(i % 7, t, lang, "clash") for i, (lang, t) in enumerate(rows)], SCHEMA).repartition(3)
    for least, top, share in ((2, 2000, 80), (5, 10, 80), (3, 50, 101)):
        got = op11_collocations.collocations(docs, least=least, top=top, share=share, buckets=buckets, slice_bytes=size)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted(tuple(r) for r in got.collect()) == plain(rows, least, top, share)


def test_nothing(spark):
    docs = spark.createDataFrame([(1, None, None, "x"), (2, "", "en", "x")], SCHEMA)
    assert op11_collocations.collocations(docs).count() == 0
    assert op11_collocations.collocations(docs.limit(0)).count() == 0


def test_bitmaps_let_little_through(spark, data):
    """What is counted exactly in the second pass is close to what is frequent."""
    docs = spark.read.parquet(f"{data}/documents.parquet").select("lang", "text")
    first = op11_collocations.one_pass(docs, 1, None, None, 30, False).persist()
    words = first.filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg({"n": "sum"}).withColumnRenamed("sum(n)", "f").filter("f >= 30")
    send = spark.sparkContext.broadcast
    frequent, buckets = send(op11_collocations.bitmap_of(op11_collocations._bits_of_phrases(words), 1)), send(op11_collocations.bitmap_of(first.filter("block IS NOT NULL"), 30))
    found = op11_collocations.one_pass(docs, 2, frequent, buckets, 30, True).filter("phrase IS NOT NULL").groupBy("lang", "phrase").agg({"n": "sum"}).withColumnRenamed("sum(n)", "f")
    counts = [r.f for r in found.collect()]
    assert sum(n >= 30 for n in counts) >= 0.9 * len(counts) > 0
    first.unpersist()

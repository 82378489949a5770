"""Fertility: junk that only tokens show, and measures and verdicts against a plain version."""

from __future__ import annotations

import collections
import math
import random
import statistics

import numpy as np
import pytest

from paperloom.llm import op8_quality as q

SCHEMA = "doc_id long, lang string, text string"


def judged(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.doc_id: r for r in q.judge(q.stored(q.measures(df, q.model_path()), "fertility-test"), **more).collect()}


def prose(rng, base, n):
    return rng.choices(base, k=n)


def junk(kind, rng, words):
    if kind == "signs":
        return [w + rng.choice(["***", "&&&", "%%%"]) for w in words]
    if kind == "bars":
        return " | ".join(words).split(" ")
    if kind == "other signs":  # none of the signs that the contract counts
        return [w + rng.choice(["~~", "==", "@@"]) for w in words]
    if kind == "letters":
        return ["".join(rng.choices("bcdfghjklmnpqrstvwxz", k=rng.randrange(5, 11))) for _ in words]
    if kind == "script":
        return ["".join(chr(rng.randrange(0x10D0, 0x10F1)) for _ in range(rng.randrange(3, 9))) for _ in words]
    if kind == "end":
        return words[:300] + [w + rng.choice(["***", "&&&", "%%%"]) for w in words[300:]]
    raise ValueError(kind)


KINDS = ("signs", "bars", "other signs", "letters", "script", "end")


def test_junk_is_rejected_by_fertility(spark):
    """At least 0.9 of each kind, a hundredth of the others at most, and each measure's part."""
    rng = random.Random(5)
    base = ["".join(rng.choices(["ing", "th", "er", "ou", "at", "st", "re", "on", "nd", "ha", "ea", "ly"], k=rng.randrange(1, 4))) for _ in range(900)]
    rows, planted = [], {}
    for i in range(700):
        kind = KINDS[i % 42] if i % 42 < len(KINDS) else None
        words = prose(rng, base, 420 if kind == "end" else rng.choice([40, 90, 150, 400]))
        rows.append((i, "en", " ".join(junk(kind, rng, words) if kind else words)))
        planted[i] = kind
    got = judged(spark, rows)
    assert not any(r.base_failed for r in got.values())
    found = collections.Counter(planted[i] for i, r in got.items() if not r.kept)
    total = collections.Counter(planted.values())
    for kind in KINDS:
        assert found[kind] >= 0.9 * total[kind], (kind, found, total)
    assert found[None] <= 0.01 * total[None]
    assert any(r.n_symbols == 0 and not r.kept for i, r in got.items() if planted[i] == "other signs")
    alone = {name: collections.Counter(planted[i] for i, r in judged(spark, rows, measured=(name,)).items() if not r.kept) for name in q.LEVELS}
    assert alone["chars_per_token"]["letters"] and alone["byte_share"]["script"] and alone["end_entropy"]["signs"] and alone["worst_end_entropy"]["end"], alone


def plain(rows, model):
    """Measures by loops over words and windows."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)

    def bits(x):
        return -sum(c / len(x) * math.log2(c / len(x)) for c in collections.Counter(x).values()) if x else 0.0

    out = {}
    for i, _, text in rows:
        words = (text or "").encode().split()
        ids = [m.encode(w.decode()) for w in words]
        flat = [x for w in ids for x in w]
        starts = sorted({*range(0, max(len(words) - q.SPAN, 0), q.STEP), max(len(words) - q.SPAN, 0)}) if words else []
        spans = [(s, min(s + q.SPAN, len(words))) for s in starts]
        ends = [bits([ids[k][-1] for k in range(a, b)]) for a, b in spans]
        chars = [sum(len(words[k].decode()) for k in range(a, b)) / sum(len(ids[k]) for k in range(a, b)) for a, b in spans]
        some = max(len(flat), 1)
        out[i] = {
            "chars_per_token": sum(len(w.decode()) for w in words) / some,
            "byte_share": sum(m.is_byte(x) for x in flat) / some,
            "entropy": bits(flat),
            "end_entropy": statistics.fmean(ends) if ends else 0.0,
            "worst_end_entropy": min(ends, default=0.0),
            "worst_chars_per_token": min(chars, default=0.0),
            "n_tokens": len(flat),
            "n_words": len(words),
        }
    return out


@pytest.mark.parametrize("least", [4, 10**6])
def test_measures_and_verdicts_equal_a_plain_version(spark, least):
    """Bands by language and class where there are ``least`` texts, else by script, as a loop finds them."""
    rng = random.Random(8)
    base = ["".join(rng.choices("etaoinshrdluéü漢", k=rng.randrange(1, 9))) for _ in range(300)]
    rows = [(0, "en", None), (1, None, ""), (2, "en", "a b"), (3, "de", "x" * 5000), (4, "en", " \t\n")]
    rows += [(i, rng.choice(["en", "de"]), " ".join(prose(rng, base, rng.choice([12, 30, 64, 65, 96, 97, 200])))) for i in range(5, 60)]
    rows += [(i, "en", " ".join(w + "***" for w in prose(rng, base, 100))) for i in range(60, 64)]
    got, want = judged(spark, rows, least=least), plain(rows, q.model_path())
    assert set(got) == set(want)
    for i, w in want.items():
        for name, value in w.items():
            assert got[i][name] == pytest.approx(value, abs=1e-9), (i, name)

    def classes(i, suffix):
        w = want[i]
        value = {"lang": langs[i], "script": 1, "length_class": int(math.log2(max(w["n_tokens"], 1))), "word_class": int(math.log2(min(max(w["n_words"], 1), q.SPAN)))}
        return tuple(value[k] for k in q.KEYS[suffix])

    langs = {i: lang for i, lang, _ in rows}
    fit = [i for i in want if not got[i].base_failed]
    for i in fit:
        inside = True
        for name, levels in q.LEVELS.items():
            for suffix in levels:
                same = [round(want[k][name], 3) for k in fit if classes(k, suffix) == classes(i, suffix)]
                if len(same) >= (least if "lang" in q.KEYS[suffix] else 1):
                    break
            low, middle, high = np.percentile(same, [25, 50, 75])
            sd = max((high - low) / 1.349, q.FLOOR[name]) * math.sqrt(max(1.0, q.LEAST / len(same)))
            inside &= abs(want[i][name] - middle) <= q.WIDTH[name] * max(sd, q.NOISE[name] / math.sqrt(max(want[i]["n_tokens"], 1)))
        assert got[i].kept == inside, i
    assert not any(r.kept for r in got.values() if r.base_failed)


def test_entropies_and_windows():
    ids = np.array([1, 1, 2, 3, 3, 3, 4, 9], "<u4")
    got = q.entropies(ids, np.array([0, 3, 3, 0]), np.array([3, 3, 8, 8]))
    assert got == pytest.approx([0.9182958, 0.0, 1.3709506, 2.1556391], abs=1e-6)
    text, start, end = q.windows(np.array([0, 0, 3, 13, 21]), span=8, step=4)
    assert list(zip(text.tolist(), start.tolist(), end.tolist())) == [(1, 0, 3), (2, 3, 11), (2, 5, 13), (3, 13, 21)]

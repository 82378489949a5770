"""Overlap joins against all pairs, and bullets against a plain reading of the rules."""

import random
import re

from paperloom.operators import grounding as g
from paperloom.operators.evidence import FORMULA_SIGNS, STOP_WORDS, TERMS, TOKEN


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    sets = lambda n: [(i, [rng.choice(words[: rng.choice((4, 40))]) for _ in range(rng.randint(0, 9))] if i % 11 else None) for i in range(n)]
    left, right = sets(80), [*sets(120), (7, ["w1", "w2"]), (7, ["w1", "w2"])]
    frames = [spark.createDataFrame(x, "id int, tokens array<string>").repartition(3) for x in (left, right)]
    for least in (1, 2, 3):
        want = sorted((i, j, len(set(a or []) & set(b or []))) for i, a in left for j, b in right if len(set(a or []) & set(b or [])) >= least)
        assert sorted(map(tuple, g.overlapping(*frames, least).collect())) == want
    assert g.overlapping(frames[0].limit(0), frames[1]).count() == 0


def test_rare_tokens_make_the_lists(spark):
    """A token that all sets have is in no list, so sets that share nothing else never meet."""
    rows = spark.createDataFrame([(i, ["every", f"own{i}"]) for i in range(300)], "id int, tokens array<string>")
    other = spark.createDataFrame([(i, ["every", f"other{i}", f"own{i}"]) for i in range(5)], "id int, tokens array<string>")
    assert sorted(map(tuple, g.overlapping(rows, other).collect())) == [(i, i, 2) for i in range(5)]


EVIDENCE = [
    "The PILOT policy network maps RGB-D observations to whole-body actions at 50 Hz.",
    "Energy is E = mc^2 and the loss falls by 12.5 percent; Kalman filters track every target state.",
    "Nothing to see",
    "",
    None,
]
BULLETS = ["Not specified in the source", "The method improves robustness", "Uses a world model", "PILOT runs fast", "kalman filters track", "Hz of 50 whole", "Target Kalman", "Other Words entirely", "E = mc^2", "", "the and for", "12.5 gains", "complex scenarios with PILOT"]


def plain(bullet, evidence):
    search = lambda p, t: re.search(p, t, re.ASCII) is not None
    tokens = lambda t: {x.lower() for x in re.findall(TOKEN, t) if len(x) >= 4 or re.fullmatch("[A-Z0-9.+-]{2,}", x)} - set(STOP_WORDS)
    if search(g.SILENT, bullet):
        return True
    if any(search(p, bullet) for p in g.GENERIC):
        return False
    if any(a in bullet.lower() for a in g.ANCHORS) or not (evidence or "").strip():
        return True
    exact = [label for entries in TERMS.values() for label, p in [e for e in entries if search(e[1].removeprefix("(-i)"), evidence) or (not e[1].startswith("(-i)") and search("(?i)" + e[1], evidence))][:6]]
    exact += [x for x in re.split(r"(?<=[.!?;])\s+", evidence) if search(FORMULA_SIGNS, x)]
    if any(len(x) >= 3 and x.lower() in bullet.lower() for x in exact):
        return True
    own = tokens(bullet)
    named = search(g.NAMED, bullet) and any(t in evidence.lower() for t in own)
    return len(own & tokens(evidence)) >= 2 or named


def test_bullets_rest_on_their_slides(spark):
    slides = spark.createDataFrame([(1, i, e) for i, e in enumerate(EVIDENCE)], "plan int, slide int, evidence string")
    rows = [(1, s, i, b) for s in range(len(EVIDENCE) + 1) for i, b in enumerate(BULLETS)]
    got = {(r.slide, r.pos) for r in g.grounded(spark.createDataFrame(rows, "plan int, slide int, pos int, bullet string"), slides).collect()}
    want = {(s, i) for _, s, i, b in rows if plain(b, EVIDENCE[s] if s < len(EVIDENCE) else None)}
    assert got == want, (got ^ want)

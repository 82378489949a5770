"""Underlines of lines of rectangles, against a plain sweep."""

import random
import statistics

from paperloom.operators import highlights as h

SCHEMA = "page int, pos int, left double, top double, right double, bottom double"


def plain(rects, width, height):
    kept, seen = [], set()
    for r in rects:
        if None in r:
            continue
        key = tuple(int((x * 2 + 0.5) // 1) for x in r)
        if key not in seen:
            seen.add(key)
            kept.append(r)
    cut = [(min(width, max(0, a)), min(height, max(0, b)), min(width, max(0, c)), min(height, max(0, d))) for a, b, c, d in kept]
    cut = sorted((r for r in cut if r[2] - r[0] > 0.5 and r[3] - r[1] > 0.5), key=lambda r: (r[1], r[0]))
    groups = []
    for left, top, right, bottom in cut:
        for g in groups:
            overlap = min(bottom, g["b"]) - max(top, g["t"])
            if overlap > 0 and overlap / min(bottom - top, g["b"] - g["t"]) >= 0.35:
                g["t"], g["b"] = min(g["t"], top), max(g["b"], bottom)
                g["rs"].append((left, right, bottom))
                break
        else:
            groups.append({"t": top, "b": bottom, "rs": [(left, right, bottom)]})
    out = []
    for g in groups:
        left, right = min(r[0] for r in g["rs"]), max(r[1] for r in g["rs"])
        out.append((left, min(height - 1, max(0, statistics.median(r[2] for r in g["rs"]) - 1)), right - left))
    return sorted(tuple(round(x, 6) for x in o) for o in out)


def test_underlines_equal_a_plain_sweep(spark):
    rng = random.Random(2)
    pages = {}
    for page in range(40):
        pages[page] = []
        for _ in range(rng.randint(0, 25)):
            left, top = rng.uniform(-20, 190), rng.uniform(-10, 100)
            pages[page].append((left, top, left + rng.uniform(0, 60), top + rng.uniform(0, 25)))
        pages[page] += pages[page][:2]
    pages[0].append((None, 1.0, 2.0, 3.0))
    rows = [(p, i, *r) for p, rs in pages.items() for i, r in enumerate(rs)]
    found = {}
    for r in h.underlines(spark.createDataFrame(rows, SCHEMA).repartition(3), 200, 100).collect():
        found.setdefault(r.page, []).append((round(r.left, 6), round(r.top, 6), round(r.width, 6)))
    assert {p: sorted(v) for p, v in found.items()} == {p: plain(rs, 200, 100) for p, rs in pages.items() if plain(rs, 200, 100)}


def test_places_are_told_apart_to_half_a_unit(spark):
    rows = [(1, 0, 1.0, 1.0, 5.0, 5.0), (1, 1, 1.1, 1.2, 5.0, 4.9), (1, 2, 1.3, 1.0, 5.0, 5.0), (2, 0, 1.0, 1.0, 5.0, 5.0)]
    got = sorted((r.page, r.pos) for r in h.distinct_rects(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 0), (1, 2), (2, 0)]
    assert h.underlines(spark.createDataFrame([], SCHEMA), 10, 10).count() == 0

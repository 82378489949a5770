"""Merges of style dictionaries against the rule applied one by one."""

import json
import random

from paperloom.operators import styles

CURRENT, IMPORTED = "book string, key string, value string", "book string, pos long, key string, value string"


def plain(current, imported):
    found, renames = dict(current), {}
    for key, value in imported:
        if key not in found:
            found[key] = value
        elif json.loads(found[key]) != json.loads(value):
            n = 2
            while f"{key}-{n}" in found:
                n += 1
            found[f"{key}-{n}"] = value
            renames[key] = f"{key}-{n}"
    return found, renames


def test_merge_equals_the_rule(spark):
    """Names of conflicts may be names of later styles, at any depth."""
    rng = random.Random(4)
    names = ["a", "a-2", "a-3", "a-2-2", "b", "b-2", "c"]
    books = {}
    for i in range(60):
        pick = lambda: {k: json.dumps({"v": rng.randint(0, 2)}) for k in rng.sample(names, rng.randint(0, 7))}
        current, imported = pick(), list(pick().items())
        rng.shuffle(imported)
        books[f"b{i}"] = (current, imported)
    rows = [(b, k, v) for b, (c, _) in books.items() for k, v in c.items()]
    more = [(b, 3 * i, k, v.replace(":", " :\n")) for b, (_, m) in books.items() for i, (k, v) in enumerate(m)]
    got = styles.merged(spark.createDataFrame(rows, CURRENT), spark.createDataFrame(more, IMPORTED)).collect()
    assert {r.book for r in got} == {b for b, (c, m) in books.items() if c or m}
    for r in got:
        want, renames = plain(*books[r.book])
        assert {k: json.loads(v) for k, v in r.styles.items()} == {k: json.loads(v) for k, v in want.items()}, books[r.book]
        assert r.renames == renames


def test_first_rows_count_and_cells_follow(spark):
    current = spark.createDataFrame([("x", "a", "1"), ("x", "a", "2"), ("x", None, "3")], CURRENT)
    imported = spark.createDataFrame([("x", 2, "a", "7"), ("x", 1, "a", "5"), ("y", 1, "a", None), ("x", 3, None, "1")], IMPORTED)
    books = styles.merged(current, imported)
    assert {r.book: (r.styles, r.renames) for r in books.collect()} == {"x": ({"a": "1", "a-2": "5"}, {"a": "a-2"}), "y": ({"a": "null"}, {})}
    cells = spark.createDataFrame([("x", "a", 1), ("x", None, 2), ("y", "a", 3), ("z", "a", 4), ("x", "b", 5)], "book string, style string, cell int")
    assert {(r.cell, r.style) for r in styles.renamed(cells, books).collect()} == {(1, "a-2"), (2, None), (3, "a"), (4, "a"), (5, "b")}

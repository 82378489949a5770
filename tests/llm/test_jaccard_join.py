"""op13 against all pairs: near copies, chains, hot segments and odd rows."""

import random
import re

import numpy as np
import pytest

from paperloom.llm import op6_near_dedup as op6
from paperloom.llm import op13_jaccard_join as op13

SCHEMA = "doc_id long, text string, node string, place int"


def plain(rows, percent=90):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        known = least.get(find(i))
        least[find(i)] = doc if known is None else known if doc is None else min(doc, known)
    return sorted(((doc, len(sets[i]), least[find(i)] if sets[i] else doc) for i, (doc, _) in enumerate(rows)), key=repr)


def got(spark, rows, **options):
    docs = spark.createDataFrame([(d, t, "clash", 1) for d, t in rows], SCHEMA)
    found = op13.joined(docs, **options)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    return sorted((tuple(r) for r in found.collect()), key=repr)


def edited(rng, words, k):
    out = list(words)
    for _ in range(k):
        out[rng.randrange(len(out))] = f"n{rng.randrange(10**6)}"
    return out


def near_copies(seed):
    rng = random.Random(seed)
    rows = []
    for size in (3, 8, 11, 14, 21, 40, 90, 200, 400):
        for _ in range(3):
            base = [f"v{rng.randrange(300)}" for _ in range(size)]
            chain = base
            for _ in range(6):
                chain = edited(rng, chain, rng.randint(0, max(1, size // 60)))
                rows.append(" ".join(chain + [f"t{i}" for i in range(rng.randint(0, max(1, size // 20)))]))
    rows += [None, "", " \n", "a", "A", "a b", "A  b", "a b c", "a B\nC", "one two three four", "one two three four"]
    rng.shuffle(rows)
    ids = [*range(len(rows) - 3), 5, None, None]
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_all_pairs(spark, seed):
    rows = near_copies(seed)
    assert got(spark, rows) == plain(rows)


def test_lower_threshold(spark):
    rows = near_copies(3)
    assert got(spark, rows, percent=70) == plain(rows, 70)


def test_allocation_trades_dear_segments(spark):
    """In band 20, of four segments, one has far more collisions: it goes, and the one with the fewest gets 1."""
    nodes = spark.createDataFrame([(20, 4, 40)] * 50 + [(21, 5, 50)] * 50, "band int, segments int, n_shingles long")
    met = [(20, 0, 3), (20, 1, 50), (20, 2, 2), (20, 3, 4), (21, 0, 40), (21, 1, 40), (21, 2, 41), (21, 3, 40), (21, 4, 39)]
    rows = spark.createDataFrame([((b << 24) + s, k, n) for k, (b, s, n) in enumerate(met)], "place int, key long, n long")
    assert {(r.place, r.allowance) for r in op13.allocation(nodes, rows).collect()} == {((20 << 24) + 1, -1), ((20 << 24) + 2, 1)}


@pytest.mark.parametrize("turn", [0, 1])
def test_traded_segments_lose_no_link(spark, monkeypatch, turn):
    """As many segments as there may be are left out, in all schemes, and as many have an allowance of 1."""

    def trades(nodes, met):
        segments = {}
        for r in nodes.select("band", "segments").distinct().collect():
            segments[r.band] = r.segments
        rows = [((b << 24) + s, -1 if (i + turn) % 2 else 1) for b, m in segments.items() for i, s in enumerate(range(m // 2 * 2))]
        return spark.createDataFrame(rows, "place int, allowance int")

    monkeypatch.setattr(op13, "allocation", trades)
    rows = near_copies(11)
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("buckets", [1 << 24, 1 << 16])
def test_members_that_share_edits_stay(spark, buckets):
    """Of a hub's members, those with edits of their own alone go; those that share enough of theirs stay, with the shared ones."""
    rng = random.Random(9)
    own = lambda n: [rng.randrange(1 << 62) for _ in range(n)]
    both = own(90)
    rows = [(bytes([i] * 16), b"h" * 16, 0.5, 300, 50, 50, own(100)) for i in range(30)]
    rows += [(bytes([100 + i] * 16), b"h" * 16, 0.5, 300, 50, 50, both + own(10)) for i in range(2)]
    rows += [(bytes([110] * 16), b"g" * 16, 0.5, 300, 50, 50, both + own(10)), (bytes([111] * 16), b"h" * 16, 0.97, 300, 1, 1, own(2))]
    stars = spark.createDataFrame(rows, "a binary, b binary, similarity double, size_b long, removed long, added long, edits array<long>").repartition(3)
    got = {r.a[0]: r.edits for r in op13.able(stars, 0.9, buckets).collect()}
    assert {100, 101} <= set(got) and 110 not in got and len(got) <= 4
    assert set(both) <= set(got[100]) and (buckets < 1 << 20 or len(got[100]) <= len(both) + 1)


def test_pigeonhole():
    """Sets that differ in no more than the scheme's bound have a segment within its allowance, whatever the trades."""
    rng = np.random.default_rng(5)
    schemes = op13.Schemes(5000, 90)
    assert (schemes.segments[1:] >= schemes.segments[:-1]).all()
    for _ in range(300):
        n = int(rng.integers(2, 900))
        x = rng.integers(1, 2**63, n).astype(np.uint64)
        y = x.copy()
        change = int(rng.integers(0, max(1, n // 9)))
        y = np.concatenate([y[change // 2 :], rng.integers(1, 2**63, change - change // 2).astype(np.uint64)])
        common, union = len(set(x) & set(y)), len(set(x) | set(y))
        if 100 * common < 90 * union:
            continue
        small, large = sorted((len(x), len(y)))
        band, lower = schemes.of(np.array([small, large]))
        assert band[0] == band[1] or (band[1] == band[0] + 1 and lower[1])
        m = int(schemes.segments[band[0]])
        assert union - common < m
        trades = int(rng.integers(0, m // 2 + 1))
        keys = []
        for s in (x, y):
            _, full, at, without = op13.subset_keys(np.zeros(len(s), int), s, band[:1], np.array([m]))
            keys.append([{int(full[i])} for i in range(m)])
            for i, k in zip(at, without, strict=True):
                if i >= m - trades:
                    keys[-1][i].add(int(k))
        assert any(keys[0][i] & keys[1][i] for i in range(trades, m))


def test_no_rows_and_nothing_alike(spark):
    docs = spark.createDataFrame([(1, None, "x", 1), (2, "only one", "x", 1)], SCHEMA)
    assert sorted(map(tuple, op13.joined(docs).collect())) == [(1, 0, 1), (2, 1, 2)]
    assert op13.joined(docs.limit(0)).count() == 0




@pytest.mark.parametrize("per_copy, most", [(500, 1 << 22), (7, 1 << 22), (500, 40)])
def test_edits_of_one_hub_are_counted_exactly(spark, monkeypatch, per_copy, most):
    """Members of a hub give only the edits that another can share; of hubs in several tasks, or with too many edits, all."""
    monkeypatch.setattr(op6, "GROUP_EDITS", most)
    hub = [f"h{i}" for i in range(200)]
    texts = {0: " ".join(hub)}
    # Far from the hub and from all others, near to each other, and near to the hub.
    texts |= {i: " ".join(hub[:150] + [f"u{i}x{j}" for j in range(40)]) for i in range(1, 20)}
    texts |= {20 + i: " ".join(hub[:150] + [f"s{j}" for j in range(40)] + [f"v{i}"]) for i in range(2)}
    texts |= {30: " ".join([*hub[:199], "end"])}
    node = {i: bytes([i] * 16) for i in texts}
    stored = spark.createDataFrame([(node[i], t) for i, t in texts.items()], "node binary, text string")
    pairs = spark.createDataFrame([(node[i], node[0]) for i in texts if i], "a binary, b binary")
    found = {r.a[0]: r for r in op6.compared(pairs, stored, 3, edits=True, per_copy=per_copy, least=0.9).collect()}
    plain_ = {r.a[0]: r for r in op6.compared(pairs, stored, 3, edits=True).collect()}
    assert set(found) == set(plain_) == set(texts) - {0}
    assert all(found[i][:6] == plain_[i][:6] for i in found)
    both = set(plain_[20].edits) & set(plain_[21].edits)
    assert both <= set(found[20].edits) & set(found[21].edits)
    if per_copy == 500 and most > 40:
        assert set(found[20].edits) == set(found[21].edits) == both
        assert not any(found[i].edits for i in found if i not in (20, 21))
    else:
        assert all(set(found[i].edits) == set(plain_[i].edits) for i in found)


def test_fixed_bitmaps_lose_no_key_and_no_text(spark):
    """However many share a bucket; with enough buckets, other keys and texts are left out before they are shuffled."""
    nodes = spark.createDataFrame([(bytes([i] * 16), [(i * 1000 + j) * 0x9E3779B97F4A7C1 % (1 << 63) for j in range(20)] + [77 << 50]) for i in range(50)], "node binary, keys array<long>")
    keys = spark.createDataFrame([(77 << 50, 50)], "key long, n long")
    wanted = spark.createDataFrame([(bytes([i] * 16), i if i else None) for i in range(5)], "node binary, rep long")
    docs = spark.createDataFrame([(i if i else None, bytes([i] * 16), f"t{i}") for i in range(50)] + [(60 + i, bytes([1] * 16), "t1") for i in range(9)], "doc_id long, node binary, text string")
    for buckets in (1 << 16, 1 << 24):
        got = [tuple(r) for r in op13.keys_among(nodes, keys, buckets).collect()]
        assert {n[0] for n, k in got if k == 77 << 50} == set(range(50)) and len(got) == len(set(got))
        assert buckets < 1 << 24 or len(got) < 70
        assert sorted((r.node[0], r.text) for r in op13.texts_of(docs, wanted, buckets).collect()) == [(i, f"t{i}") for i in range(5)]

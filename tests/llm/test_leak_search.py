"""The search for benchmark items: hashes of words, common subsequences and what of them isn't computed."""

import random
import types

import numpy as np
import pyarrow as pa
import pytest

from paperloom.llm import op10_decontamination as op10
from paperloom.llm.words import LONG, hashes_by_eight, words_of


def test_equal_words_alone_have_equal_hashes():
    rng = random.Random(4)
    # Words of all lengths about the limits, of zero bytes too, at other places and with other neighbours.
    words = list({bytes(rng.choice((0, 97, 98, 255)) for _ in range(n)) for n in [*range(1, 30), LONG - 1, LONG, LONG + 1, 200, 5000] for _ in range(6)})
    texts = [b" ".join(rng.sample(words, len(words))) for _ in range(5)] + [b"", words[0]]
    found = {}
    w = words_of(pa.array(texts, pa.binary()), hashes_by_eight)
    for a, b, h in zip(w.start, w.end, w.hash, strict=True):
        found.setdefault(w.data[a:b].tobytes(), set()).add(int(h))
    assert set(found) == set(words) and all(len(x) == 1 for x in found.values())
    assert len({next(iter(x)) for x in found.values()}) == len(words)
    assert len(words_of(pa.array([None, "", "  "]), hashes_by_eight).hash) == 0


@pytest.mark.parametrize("n", [0, 1, 2, 50, 3000])
def test_numbers_of_words(n):
    """Every word has the place of its hash, whatever upper bits they share; others have none."""
    rng = np.random.default_rng(n)
    near = np.uint64(7 << 50) + np.arange(n // 2, dtype=np.uint64) * np.uint64(3)
    known = np.concatenate([near, rng.integers(0, 1 << 64, n - n // 2, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64)[: n // 2]])
    vocabulary = op10.Vocabulary(known)
    places = {h: i for i, h in enumerate(sorted(set(known.tolist())))}
    asked = np.concatenate([known, known + np.uint64(1), rng.integers(0, 1 << 64, 500, dtype=np.uint64)])
    assert vocabulary.number(asked).tolist() == [places.get(h, -1) for h in asked.tolist()]
    assert vocabulary.number(asked[:0]).tolist() == []


def lcs(a, b):
    rows = [[0] * (len(b) + 1)]
    for x in a:
        rows.append([0])
        for j, y in enumerate(b):
            rows[-1].append(rows[-2][j] + 1 if x == y else max(rows[-2][j + 1], rows[-1][j]))
    return rows[-1][-1]


def test_common_subsequences_and_their_bound():
    """One word may serve several segments, so that it adds one for each."""
    rng = random.Random(5)
    for _ in range(200):
        segments = [[rng.choice(b"abcdef") for _ in range(rng.randint(1, 9))] for _ in range(rng.randint(1, 4))]
        b = [rng.choice(b"abcdefgh") for _ in range(rng.randint(0, 30))]
        whole, parts = sum(lcs(s, b) for s in segments), op10.Parts(segments)
        assert op10.common_subsequence(segments, b) == parts.common(b) == whole
        cut = rng.randint(0, len(b))
        assert whole <= parts.common(b[:cut]) + parts.most(b[cut:])


def searched(index, texts):
    """Rows of ``search`` over ``texts``, run here."""
    docs = types.SimpleNamespace(columns=["doc_id", "text"], sparkSession=types.SimpleNamespace(sparkContext=types.SimpleNamespace(broadcast=lambda x: types.SimpleNamespace(value=x))))
    docs.schema = types.SimpleNamespace(add=lambda *_: docs.schema)
    docs.select, docs.mapInArrow = lambda *_: docs, lambda run, _: run
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "text"])
    return pa.Table.from_batches(op10.search(docs, index)(iter([batch]))).drop_columns(["text"]).to_pylist()


@pytest.fixture
def index():
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(120)}"
    items = [(i, ". ".join(" ".join(word() for _ in range(rng.randint(5, 14))) for _ in range(4)) + ".") for i in range(20)]
    vocabulary = op10.Vocabulary(op10.folded_words(pa.array([t for _, t in items])).hash)
    n = len(vocabulary.hashes)
    return op10.Index(vocabulary, np.ones(n), np.eye(n, dtype=np.float32), items), items, word


def test_what_is_left_out_changes_no_verdict(index, monkeypatch):
    """Verdicts and strongest items are those of all candidates; fewer common subsequences than two for each are computed."""
    ix, items, word = index
    rng = random.Random(7)
    texts = [" ".join(word() for _ in range(rng.randint(20, 400))) for _ in range(40)] + [f"x y {t} z" for _, t in items] + [None, ""]
    texts += [" ".join(x for x in t.split() if rng.random() < 0.6 or rng.random() < 0.3) for _, t in items]
    calls, candidates = [0], 0
    common = op10.Parts.common

    def counted(self, b):
        calls[0] += 1
        return common(self, b)

    monkeypatch.setattr(op10.Parts, "common", counted)
    got, did = searched(ix, texts), calls[0]
    w = op10.folded_words(pa.array(texts))
    best, hits = [None] * len(texts), [set() for _ in texts]
    for text, low, high, item, close in ix.candidates(w, op10.COSINE):
        candidates += 1
        if item.key in hits[text]:
            continue
        around = w.text(low, high).split()
        share, answer = sum(lcs(s, around) for s in item.segments) / len(item.words), lcs(item.answer, around) / len(item.answer)
        bad = share >= op10.LCS or (close > 0 and (share >= op10.PARAPHRASE or (share >= op10.ANSWERED and answer >= op10.ANSWER)))
        if bad:
            hits[text].add(item.key)
        found = (bad, share, close, True, -item.item_id, answer)
        if best[text] is None or found > best[text]:
            best[text] = found
    want = [(b[0], -b[4], b[2], b[1], b[5], len(h)) if b else (False, None, 0.0, 0.0, 0.0, 0) for b, h in zip(best, hits, strict=True)]
    assert [tuple(r[k] for k in op10.ADDED) for r in got] == want
    assert sum(r["contaminated"] for r in got) >= 20 and did < 1.2 * candidates

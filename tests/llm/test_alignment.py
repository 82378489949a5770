"""op12 against a plain version, on odd texts and on a whole small table."""

import collections
import hashlib

import public_tokenizers as P
import sentencepiece
from tokenizers import Tokenizer

from paperloom.llm import op12_alignment

SCHEMA = "doc_id long, text string, lang string"
ODD = ["", None, " ", "\n", "a b  c\n\n d\te", "<|endoftext|> hi <s> x </s> <unk>", "a▁b", "漢字 é x́ ﬁ ① ２", "\x00a ﻿​ b", "don't  '  s   ", "x" * 3000 + " " + "y " * 500, "😀   　z", "the cat sat", "the cat sat"]


def plain(texts):
    a_model = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    vocab = {i: t for t, i in a_model.get_vocab().items()}
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in shown)}

    def b_bytes(i):
        p = b_model.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_model.is_byte(i) else p.replace("▁", " ").encode()

    links, out = [], []
    for text in texts:
        want = (" " + (text or "")).encode()
        a = a_model.encode(want.decode(), add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        a_tokens, b_tokens = [bytes(chars[c] for c in vocab[i]) for i in a], [b_bytes(i) for i in b]
        if not text or b"".join(a_tokens) != want or b"".join(b_tokens) != want:
            links.append([])
            out.append((0, 0, 0, ""))
            continue

        def spans(tokens):
            at = 0
            for t in tokens:
                yield at, at + len(t)
                at += len(t)

        a_spans, b_spans = list(spans(a_tokens)), list(spans(b_tokens))
        met, j = [], 0
        for i, (low, high) in enumerate(a_spans):
            while b_spans[j][1] <= low:
                j += 1
            k = j
            while k < len(b_spans) and b_spans[k][0] < high:
                met.append((a[i], b[k]))
                k += 1
        ends = sorted({e for _, e in a_spans} & {e for _, e in b_spans})
        groups, i, j = [], 0, 0
        for end in ends:
            ga, gb = [], []
            while i < len(a) and a_spans[i][1] <= end:
                ga.append(str(a[i]))
                i += 1
            while j < len(b) and b_spans[j][1] <= end:
                gb.append(str(b[j]))
                j += 1
            groups.append(",".join(ga) + "|" + ",".join(gb))
        links.append(met)
        out.append((len(a), len(b), len(groups), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    count = collections.Counter(p for m in links for p in m)
    best = collections.defaultdict(int)
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(n_a, n_b, g, len(m), sum(count[p] == best[p[1]] for p in m), sum(count[p] for p in m), sha) for (n_a, n_b, g, sha), m in zip(out, links, strict=True)]


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def rows_of(df):
    assert df.columns == COLUMNS
    return sorted((tuple(r) for r in df.collect()), key=repr)


def expected(ids, texts):
    return sorted(((i, *r) for i, r in zip(ids, plain(texts), strict=True)), key=repr)


def test_odd_texts(spark):
    ids = [*range(len(ODD) - 2), 7, None]
    docs = spark.createDataFrame([(i, t, "key") for i, t in zip(ids, ODD, strict=True)], "doc_id long, text string, key string")
    assert rows_of(op12_alignment.align(docs)) == expected(ids, ODD)
    assert rows_of(op12_alignment.align(docs.limit(0))) == []


def test_whole_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    assert rows_of(op12_alignment.op12_alignment(spark, data)) == expected([r.doc_id for r in rows], [r.text for r in rows])


def test_parts_and_shares_change_nothing(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(60)
    whole = rows_of(op12_alignment.align(docs))
    monkeypatch.setattr(op12_alignment, "PER_TASK", 3)
    a, b = op12_alignment._sides(op12_alignment.byte_bpe_path(), op12_alignment.piece_bpe_path())
    texts = [r.text for r in docs.collect() if r.text]
    assert any(len(op12_alignment.parts_of(t, 300)) > 3 for t in texts)
    for side, other in ((a, lambda t: a.encode([" " + t])[0]), (b, lambda t: b.encode([" " + t])[0])):
        for t in texts:
            assert [int(i) for p in side.encode(op12_alignment.parts_of(t, 300)) for i in p] == [int(i) for i in other(t)]
    assert rows_of(op12_alignment.align(docs, slice_bytes=4000, part_chars=300, entries=16)) == whole


def test_long_texts(spark):
    texts = ["x" * 300_000, " " * 300_000, "\n" * 300_000, "a b" * 300_000, "word, " * 200_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert rows_of(op12_alignment.align(docs)) == expected(range(len(texts)), texts)

"""Odd rows that the training-data operators must not lose, and stages against brute force."""

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.llm import op1_licenses, op2_token_ids, op3_mixing, op4_html, op5_toxicity, op6_near_dedup, op7_warc, op8_quality, op9_substrings, op10_decontamination

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts_of(rows):
    return collections.Counter(r.text for r in rows)


def test_keep_one_keeps_classes_of_null_and_equal_ids_apart(spark):
    words = lambda x: " ".join(f"{x}{i}" for i in range(12))
    rows = [(i, words(t)) for i, t in ((1, "a"), (1, "a"), (1, "b"), (1, "b"), (None, "c"), (None, "c"), (None, "d"), (None, "d"), (7, "e"), (None, "e"))] + [(None, None), (None, ""), (3, " ")]
    got = op6_near_dedup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    assert texts_of(got.collect()) == collections.Counter([words(x) for x in "abcde"] + [None, "", " "])


def test_near_duplicates_of_two_clusters_in_one_bucket(spark):
    """A cluster and another that shares six tenths with it: no link between them, none lost within."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(300)]
    other = base[:225] + [f"v{i}" for i in range(75)]
    rows = []
    for k in range(90):
        w = list(base if k % 3 else other)
        for _ in range(3):
            w[rng.randrange(300)] = f"e{rng.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: r.class_id for r in op6_near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: (1 if k % 3 else 0) for k in range(90)}


def test_mixing_tells_null_and_repeated_ids_apart(spark):
    rows = [(None, "w " * 10, "a")] * 100 + [(i, "w " * 10, "b") for i in range(50)] + [(7, f"x{i % 5} " * 5, "c") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for taken in (op3_mixing.mix(df).groupBy("source").agg(F.sum("taken").alias("n")), op3_mixing.repeat(df).groupBy("source").agg(F.sum(op3_mixing.size_of()).alias("n"))):
        assert {r.source: abs(r.n - t) <= 10 for r, t in zip(taken.orderBy("source").collect(), (1875, 750, 375), strict=True)} == dict.fromkeys("abc", True)


def test_token_files_keep_the_least_id_and_null(spark):
    rows = [(-(1 << 63), "a b"), (None, "c"), (5, "x " * 40), (5, "x " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    manifest = op2_token_ids.write_ids(docs, op2_token_ids.fresh_path(spark, "tokens-test"), op2_token_ids.tokenizer_path(), shard_ids=30)
    got = op2_token_ids.read_ids(manifest, run=1).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), len(t.split()) + 1) for i, t in rows)
    path = manifest.filter("documents > 0").first().path
    with op2_token_ids.files.seekable(path) as f:
        one = op2_token_ids.TokenFile(f, path)
        whole = one.read(0, one.n).tolist()
        assert whole == [i for k in range(one.n) for i in op2_token_ids.read_document(path, k).tolist()]


def test_encoder_equals_the_tokenizer_on_odd_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(1)
    plain = op2_token_ids.WordEncoder(op2_token_ids.tokenizer_path(), most=300)
    whole = Tokenizer.from_file(op2_token_ids.tokenizer_path())
    signs = [*"abzAZ''''  \n\t09.,!?-_<|>éÉÀßÿ÷×Øøñ", "'s", "'LL", "'re", "'ve", "don't", "<|endoftext|>", "漢", "ª", "\x7f", "x́", "½"]
    for k in range(30):
        texts = [None if i % 50 == 0 else "".join(rng.choices(signs if k % 2 else signs[:-8], k=rng.randrange(30))) for i in range(100)]
        ids, counts = plain.encode(pa.array(texts, pa.string()), 1)
        want = [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]
        assert counts.tolist() == [len(x) for x in want] and ids.tolist() == [i for x in want for i in x]


def test_warc_null_page_ids_revisit(spark):
    big = "y" * 3000
    rows = [(None, None, big), (4, None, big), (None, None, "z" * 2000), (None, None, "z" * 2000), (9, None, None)]
    got = op7_warc.record_types(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted((str(r.page_id), r.record_type, r.refers_to) for r in got) == [("4", "response", None), ("9", "response", None), ("None", "response", None), ("None", "response", None), ("None", "revisit", 4)]
    none = spark.createDataFrame([], "page_id long, url string, html string")
    files = op7_warc.write_archives(op7_warc.record_types(none), op7_warc.fresh_path(spark, "warc-none"))
    assert op7_warc.records_of(op7_warc.read_archives(files, False)).count() == 0


def test_html_depth_spans_and_forms(spark):
    for deep in ("<div>" * 60_000, "<p><span>" * 30_000, "<ul><li>" * 3_000, "<table><tr><td>" * 300):
        assert op4_html.visible_text(deep + "x").strip(" -|\n") .endswith("x")
    assert op4_html.visible_text("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f<td colspan=2>g</table>") == "a | b | c\n  | d | e\nf | g"
    page = "<p>pick <select><option>one<option selected>two</select> now<textarea>x\n  y &amp; z</textarea><svg><title>t</title><text>draw</text></svg><noscript>no</noscript>"
    assert op4_html.visible_text(page) == "pick two now\nx\n  y & z\ndraw"
    rows = spark.createDataFrame([(1, None, "old"), (2, "", "old"), (3, "<b>x</b>", "old")], "page_id long, html string, text string")
    assert {r.page_id: r.text for r in op4_html.extract(rows).collect()} == {1: None, 2: "", 3: "x"}
    assert op4_html.extract(rows.limit(0)).count() == 0


def test_columns_of_clashing_names(spark):
    names = "licenses sentence_ids unclaimed p_toxic expected_severity severity rejected contaminated item_id cosine _row _id _node size hash at place label node"
    docs = spark.createDataFrame([(i, f"some plain words of text number {i} that go on", "en", "a", 1) for i in range(6)], SCHEMA).select("*", *[F.lit("mine").alias(n) for n in names.split()])
    bench = spark.createDataFrame([(1, "an item of words that nobody copied at all today")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 1), (1, 0, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    for kept in (op5_toxicity.drop_toxic(docs, labels), op6_near_dedup.keep_one(docs), op10_decontamination.drop_contaminated(docs, bench), op3_mixing.repeat(docs)):
        assert kept.columns == docs.columns
        assert {r.licenses for r in kept.collect()} == {"mine"}
    assert [r.licenses for r in op1_licenses.scan(docs).collect()] == [[]] * 6
    model = op5_toxicity.fit(docs, labels)
    assert op5_toxicity.score(docs, model).filter("rejected").count() == 0
    assert op8_quality.judge(op8_quality.stored(op8_quality.measures(docs, op8_quality.model_path()), "t")).count() == 6
    assert op9_substrings.remove_repeats(docs).count() == 6


def test_toxicity_of_graded_and_conflicting_labels(spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(900):
        words = rng.choices(base, k=80)
        grade = (0, 0, 0, 1, 2)[i % 5]
        for _ in range(3 * (grade > 0)):
            words[rng.randrange(80)] = "harsh"
        for _ in range(6 * (grade == 2)):
            words[rng.randrange(80)] = "vilest"
        rows.append((i, " ".join(words), "en", "a", 0))
        labels.append((i, 0 if grade == 2 else 1, int(grade > 0)))
        if grade == 2:  # a second label of a lower grade doesn't count
            labels.append((i, 1, 1))
    docs = spark.createDataFrame(rows, SCHEMA)
    model = op5_toxicity.fit(docs.filter("doc_id < 600"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = op5_toxicity.score(docs.filter("doc_id >= 600"), model).collect()
    grade = {i: (0, 0, 0, 1, 2)[i % 5] for i in range(900)}
    assert sum(r.rejected == (grade[r.doc_id] > 0) for r in got) >= 0.98 * len(got)
    assert sum(r.severity == 2 for r in got if grade[r.doc_id] == 2) >= 0.9 * sum(grade[r.doc_id] == 2 for r in got)
    mean = lambda g: sum(r.expected_severity for r in got if grade[r.doc_id] == g) / sum(grade[r.doc_id] == g for r in got)
    assert mean(0) < 0.3 < mean(1) < mean(2)


KINDS = ("copy", "upper", "swap", "third", "second", "insert")


def leaked(kind, words, rng):
    if kind == "upper":
        return [w.upper().rstrip(".") for w in words]
    if kind == "swap":
        return words[len(words) // 2 :] + words[: len(words) // 2]
    if kind in ("third", "second"):
        step = 3 if kind == "third" else 2
        return [f"z{rng.randrange(10**6)}" if i % step == 1 else w for i, w in enumerate(words)]
    if kind == "insert":
        return [y for w in words for y in ((w,) if rng.random() < 0.7 else (w, f"q{rng.randrange(10**6)}"))]
    return words


def test_decontamination_finds_paraphrases(spark):
    rng = random.Random(4)
    corpus = [f"c{i}" for i in range(2500)]
    items = [(i, " ".join(rng.choices(corpus, k=rng.randrange(30, 60)))) for i in range(60)]
    rows, kinds = [], {}
    for i in range(900):
        w = rng.choices(corpus, k=120)
        if i % 2:
            kinds[i] = KINDS[i // 2 % len(KINDS)]
            w[50:50] = leaked(kinds[i], items[i % 60][1].split(), rng)
        rows.append((i, " ".join(w), "en", "a", 0))
    found = {r.doc_id: (r.contaminated, r.item_id) for r in op10_decontamination.contaminated(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    hits, every = collections.Counter(), collections.Counter(kinds.values())
    for i, kind in kinds.items():
        hits[kind] += found[i] == (True, i % 60)
    assert all(hits[k] >= (0.9 if k != "second" else 0.75) * every[k] for k in KINDS), (hits, every)
    assert not any(bad for i, (bad, _) in found.items() if i not in kinds)


def test_decontamination_of_a_corpus_that_is_the_item_and_by_parts(spark):
    item = "What is the name of the long river that runs by the old town? It is the Blue River."
    bench = spark.createDataFrame([(3, item), (4, "something else that is asked of nobody here at all")], "item_id long, text string")
    got = op10_decontamination.contaminated(spark.createDataFrame([(1, item), (2, None)], "doc_id long, text string"), bench).collect()
    assert {(r.doc_id, r.contaminated, r.item_id) for r in got} == {(1, True, 3), (2, False, None)}
    parts = op10_decontamination.parts_of(bench, most=40)
    assert len(parts) > 2 and sorted(r for p in parts for r in p) == sorted((r.item_id, r.text) for r in bench.collect())


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    """Every stage's rows on a small table with planted copies, leaks and toxic texts."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(6)
    base = [f"w{i}" for i in range(1500)]
    items = [(i, " ".join(rng.choices(base, k=40))) for i in range(10)]
    rows, labels = [], []
    for i in range(400):
        w = rng.choices(base, k=100)
        if i % 8 == 0:
            for _ in range(5):
                w[rng.randrange(100)] = "vile"
        if i % 10 == 3:
            w[30:30] = items[i % 10][1].split()
        if i % 7 == 5 and i > 20:  # a near copy of an earlier text
            w = rows[i - 20][1].split()
            w[len(w) // 2] = f"e{i}"
        rows.append((i, " ".join(w), "en", f"s{i % 3}", len(w)))
        labels.append((i, 1, int("vile" in w)))
    rows += [(None, None, None, None, None), (401, "", "en", None, 0)]
    for name, data, schema in (("documents", rows, SCHEMA), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", items, "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs, names = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stored(stage(spark, docs, str(tmp_path)), f"case-{name}")
        names[name] = docs.collect()
    ids = lambda name: {r.doc_id for r in names[name]}
    text = {r[0]: r[1] for r in rows}
    assert ids("toxicity") == {i for i, t in text.items() if "vile" not in (t or "").split()}
    kept, left = [], sorted((i for i in ids("toxicity") if i is not None))
    sets = {i: shingles(text[i]) for i in left}
    label = {i: i for i in left}
    for i in left:
        for j in left:
            if j < i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                old, new = sorted((label[i], label[j]), reverse=True)
                label = {k: new if v == old else v for k, v in label.items()}
    kept = {i for i in left if label[i] == i} | {None}
    assert ids("near_dedup") == kept and len(names["near_dedup"]) == len(kept)
    leaks = {i for i in kept if any(item in (text[i] or "") for _, item in items)}
    assert leaks and ids("decontamination") == kept - leaks
    times = collections.Counter(r.doc_id for r in names["mixing"])
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", text[i] or "")) for i in kept - leaks}
    source = {r[0]: r[3] for r in rows}
    want = {r.source: r.target for r in op3_mixing.mix(spark.createDataFrame([r for r in rows if r[0] in kept - leaks], SCHEMA)).collect()}
    assert set(times) <= kept - leaks and all(times[i] <= 3 for i in times)
    for s, target in want.items():
        assert abs(sum(sizes[i] * n for i, n in times.items() if source[i] == s) - target) <= max(sizes.values())
    out = pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert collections.Counter(r.doc_id for r in out) == times
    assert collections.Counter(r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()) == times
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0

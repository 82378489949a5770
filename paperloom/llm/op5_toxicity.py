"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade > j | x) = sigmoid(w.x - theta_j): one weight vector for all ordered thresholds
theta_0 < theta_1 < ..., so all grades train the same weights.  Features are the
distinct lower-case letter runs of a text and their beginnings, hashed.  Grades come from ``labels``: 0 not
toxic; 1 toxic in a text of good quality; 2 toxic in a text of poor quality.

Fitting uses a bounded sample of labelled rows (at most ``TOXIC_ROWS`` toxic ones and
``CLEAN_ROWS`` others, the first by a hash of their doc_id), on the driver, by accelerated proximal
gradient with an L1 penalty.  Scoring covers every whole text, and needs no shuffle.

Defined cases: null and empty text has no features and the severity of the thresholds
alone; repeated rows get equal scores; labels of absent documents, with null grades or
in conflict over one doc_id (the larger grade counts) do no harm; without any labelled
row of either kind all severities are 0 and nothing is rejected.  Other columns are kept by
``score`` (but for those it adds, which it replaces) and all of them by ``drop_toxic``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, stored, table, text_or_empty
from .words import slices

#: Labelled rows that fitting takes at most, of either kind.
TOXIC_ROWS, CLEAN_ROWS = 3000, 5000
FEATURE_BITS = 20
SCREEN = 4.0
MOST_FEATURES = 1500
LETTERS = re.compile(r"[^\W\d_]+")
#: A document is rejected when its probability of any toxic grade reaches this.
REJECT = 0.3


def parts(word: str) -> list[str]:
    """The word and, as inflected forms share their stem, its beginnings of 4 to 7 letters."""
    return [word, *(f"{word[:k]}*" for k in range(4, min(len(word), 8)))]


def feature_ids(word: str) -> tuple[int, ...]:
    import xxhash

    return tuple({xxhash.xxh64_intdigest(p) >> (64 - FEATURE_BITS) for p in parts(word)})


def words(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def strength(count, n_words):
    """A feature's value: its count over the root of the text's words, so that a long text needs more."""
    return np.minimum(10.0 * count / np.sqrt(np.maximum(n_words, 1)), 10.0)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class CumulativeLink:
    """Sparse weights by feature, and the ordered thresholds."""

    weights: dict[int, float]
    thresholds: np.ndarray

    def above(self, score: np.ndarray) -> np.ndarray:
        """P(grade > j) for each threshold j."""
        return _sigmoid(np.asarray(score)[:, None] - self.thresholds[None, :])

    @classmethod
    def fit(cls, features: np.ndarray, matrix: np.ndarray, grades: np.ndarray, l1: float = 2e-3, steps: int = 400) -> CumulativeLink:
        """Proximal accelerated gradient on the mean negative log-likelihood plus l1 * |w|.

        ``matrix``: a row per text and a column per feature, scaled to unit variance while fitting.
        """
        n, k = len(grades), int(grades.max()) if len(grades) else 0
        if k < 1 or grades.min() > 0 or not len(features):
            return cls({}, np.full(max(k, 1), 35.0))
        matrix = matrix.astype(np.float32)
        scale = matrix.std(axis=0) + 1e-6
        matrix /= scale
        v = np.ones(len(features), np.float32)
        for _ in range(20):  # the largest curvature sets the step
            v = matrix.T @ (matrix @ v)
            size = float(np.linalg.norm(v))
            v /= size
        rate = 1 / (0.5 * size / n + 0.5)
        share = np.array([(grades > j).mean() for j in range(k)]).clip(1e-3, 1 - 1e-3)
        theta = np.maximum.accumulate(-np.log(share / (1 - share)) + np.arange(k) * 1e-3)
        i = np.arange(n)

        def gradient(w, t):
            p = _sigmoid((matrix @ w.astype(np.float32)).astype(np.float64)[:, None] - t[None, :])
            above = np.concatenate([np.ones((n, 1)), p, np.zeros((n, 1))], 1)  # P(grade > j - 1)
            upper, lower = above[i, grades], above[i, grades + 1]
            like = np.maximum(upper - lower, 1e-12)
            gu, gl = upper * (1 - upper), lower * (1 - lower)
            gt = np.array([(gu / like)[grades == j + 1].sum() - (gl / like)[grades == j].sum() for j in range(k)]) / n
            return matrix.T @ (-(gu - gl) / like / n).astype(np.float32), gt

        w = np.zeros(len(features))
        y, ty, t, momentum = w.copy(), theta.copy(), theta.copy(), 1.0
        for _ in range(steps):
            gw, gt = gradient(y, ty)
            new = y - rate * gw
            new = np.sign(new) * np.maximum(np.abs(new) - rate * l1, 0)
            new_t = ty - rate * gt
            for j in range(1, k):
                new_t[j] = max(new_t[j], new_t[j - 1] + 1e-3)
            following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
            y, ty = new + (momentum - 1) / following * (new - w), new_t + (momentum - 1) / following * (new_t - t)
            w, t, momentum = new, new_t, following
        return cls({int(features[j]): float(w[j] / scale[j]) for j in np.flatnonzero(w)}, t)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade: 0, 1 (toxic, good quality), 2 (toxic, poor quality)."""
    grade = F.when(F.col("toxic") == 0, 0).when(F.coalesce(F.col("quality"), F.lit(0)) > 0, 1).otherwise(2)
    return labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(grade).alias("grade"))


def screened(rows: DataFrame) -> DataFrame:
    """The ``MOST_FEATURES`` clearest features of ``rows`` (grade, f, x): those in three texts or more whose
    mean among toxic texts differs from that among the others by ``SCREEN`` standard errors or more.

    ``rows`` has a row without a feature (null) for each text.  Sums by feature combine before the shuffle.
    """
    toxic, x = F.col("grade") > 0, F.col("x")
    sums = {f"{k}{i}": F.sum(F.when(toxic if i else ~toxic, v).otherwise(0.0)) for i in (0, 1) for k, v in (("s", x), ("q", x * x))}
    found = rows.filter("f IS NOT NULL").groupBy("f").agg(F.count("*").alias("n"), *[v.alias(k) for k, v in sums.items()])
    texts = rows.filter("f IS NULL").agg(F.count_if(~toxic).alias("n0"), F.count_if(toxic).alias("n1"))
    mean = {i: F.col(f"s{i}") / F.col(f"n{i}") for i in (0, 1)}
    error = F.sqrt(sum(F.greatest(F.col(f"q{i}") / F.col(f"n{i}") - mean[i] * mean[i], F.lit(1e-9)) / F.col(f"n{i}") for i in (0, 1)))
    clear = found.crossJoin(texts).filter("n >= 3 AND n0 > 0 AND n1 > 0").select("f", (F.abs(mean[1] - mean[0]) / error).alias("z"))  # one row of texts
    return clear.filter(F.col("z") >= SCREEN).orderBy(F.round("z", 9).desc(), "f").limit(MOST_FEATURES).select("f")


def fit(docs: DataFrame, labels: DataFrame, toxic: int = TOXIC_ROWS, clean: int = CLEAN_ROWS) -> CumulativeLink:
    """Fits on at most ``toxic`` + ``clean`` labelled documents, the first of either kind by a hash of their doc_id.

    Features are screened in Spark; the driver gets the kept ones of these rows alone, at most
    (toxic + clean) x ``MOST_FEATURES`` numbers.
    """
    with scratch(docs.sparkSession):
        known, order = stored(graded(labels), "toxicity-grades"), [F.xxhash64("doc_id"), "doc_id"]
        # A top-k by hash: no task holds more than k rows.
        sample = known.filter("grade > 0").orderBy(*order).limit(toxic).unionByName(known.filter("grade = 0").orderBy(*order).limit(clean))
        # At most toxic + clean rows of (id, grade): their size is proven, so they are broadcast.
        held = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")

        def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text"):
                    ids, values, sizes = [], [], []
                    for text in part.column("text").to_pylist():
                        found = words(text)
                        counts: Counter[int] = Counter()
                        for w, c in Counter(found).items():
                            for f in feature_ids(w):
                                counts[f] += c
                        of = np.array(sorted(counts), np.int32)
                        ids.append(of)
                        values.append(strength(np.array([counts[f] for f in of.tolist()], np.float32), len(found)).astype(np.float32))
                        sizes.append(len(of))
                    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                    lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x))) for x in (ids, values)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade").cast(pa.int32()), *lists], ["doc_id", "grade", "ids", "vals"])

        # The same labelled document may come in many rows; one of each is enough.
        texts = held.mapInArrow(take, "doc_id long, grade int, ids array<int>, vals array<float>").groupBy("doc_id").agg(F.first("grade").alias("grade"), F.max(F.struct("ids", "vals")).alias("x"))
        texts = stored(texts.select("doc_id", "grade", "x.*"), "toxicity-texts")
        pairs = texts.select("doc_id", "grade", F.explode(F.arrays_zip("ids", "vals")).alias("p")).select("doc_id", "grade", F.col("p.ids").alias("f"), F.col("p.vals").cast("double").alias("x"))
        kept = stored(screened(pairs.unionByName(texts.select("doc_id", "grade", F.lit(None).cast("int").alias("f"), F.lit(None).cast("double").alias("x")))), "toxicity-features")
        grades = texts.select("doc_id", "grade").orderBy("doc_id").toArrow()
        cells = pairs.join(F.broadcast(kept), "f").select("doc_id", "f", "x").toArrow()
    ids = grades.column("doc_id").to_numpy()
    features, column = np.unique(cells.column("f").to_numpy(), return_inverse=True)
    matrix = np.zeros((len(ids), len(features)), np.float32)
    matrix[np.searchsorted(ids, cells.column("doc_id").to_numpy()), column] = cells.column("x").to_numpy()
    return CumulativeLink.fit(features, matrix, grades.column("grade").to_numpy().astype(np.int64))


def score(docs: DataFrame, model: CumulativeLink, column: str = "text") -> DataFrame:
    """``docs`` with p_toxic, expected_severity (sum over j of P(grade > j)), severity and rejected.

    Columns of ``docs`` of these four names are replaced.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast((model.weights, model.thresholds))  # non-zero weights of a fixed feature space
    names = [c for c in docs.columns if c not in ("p_toxic", "expected_severity", "severity", "rejected")]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = held.value
        link, known = CumulativeLink(weights, thresholds), {}
        for batch in batches:
            for part in slices(batch, column, 4 << 20):
                total = np.zeros(part.num_rows)
                for i, text in enumerate(part.column(column).to_pylist()):
                    found = words(text)
                    counts: dict[int, int] = {}
                    for w in found:
                        fs = known.get(w)
                        if fs is None:
                            if len(known) > 100_000:
                                known.clear()
                            fs = known[w] = tuple(f for f in feature_ids(w) if f in weights)
                        for f in fs:
                            counts[f] = counts.get(f, 0) + 1
                    total[i] = sum(weights[f] * strength(counts[f], len(found)) for f in sorted(counts))
                above = link.above(total)
                expected = above.sum(axis=1)
                # The most likely grade.
                bounds = np.concatenate([np.ones((len(total), 1)), above, np.zeros((len(total), 1))], 1)
                likely = np.argmax(bounds[:, :-1] - bounds[:, 1:], axis=1)
                extra = [pa.array(above[:, 0]), pa.array(expected), pa.array(likely.astype(np.int32)), pa.array(above[:, 0] >= REJECT)]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + extra, [*names, "p_toxic", "expected_severity", "severity", "rejected"])

    schema = docs.select(*names).schema.add("p_toxic", "double").add("expected_severity", "double").add("severity", "integer").add("rejected", "boolean")
    return docs.select(*names).mapInArrow(add, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs.select("doc_id", "text"), model).drop("text")


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, with the columns of ``docs``."""
    packed = docs.select(F.struct(*docs.columns).alias("_row"), text_or_empty().alias("text"))
    return score(packed, fit(docs, labels)).filter("NOT rejected").select("_row.*")


QUERIES = {"op5_toxicity": op5_toxicity}
ORACLES: dict[str, str] = {}

"""Exact Jaccard join of documents' word shingles by universe partition and pigeonhole.

Sets are put in bands of size.  In the scheme of band k, the smaller set of a linked pair
has a size in the band and the larger at most 1/T of it, so they differ in at most H_k
elements.  The universe of shingles is dealt by a hash to m segments, and each segment i
has an allowance t_i: 0 asks for equal subsets there, 1 for subsets that differ in one
element at most (equal subsets, or one side's one-deletion neighbour equal to the other's
subset), -1 leaves the segment out.  As long as the sum of t_i + 1 is over H_k, two sets
that miss every segment differ in more than H_k elements; so no link is lost.  A set is
in its own band's scheme, and in that of the band below if it may be the larger there.

Allocation by cost: all segments of a scheme start with 0 (m = H_k + 1).  The first pass
counts what collides in each.  A segment that has more collisions than its scheme's median
by more than one-deletion keys would cost is left out, and the one with the fewest gets 1
in its place.  What really is similar collides in nearly all segments alike, so it makes no
segment dearer than another; subsets of few or of very common shingles do.

What meets in a bucket is compared with one hub, exactly, by all shingles, and links that
miss their hub are found by shared edits (``op6_near_dedup``, which has the proof; it holds
for any buckets in which linked texts meet).  So a bucket of k texts costs k - 1
comparisons and no pairs within it.  The members of a hub meet in one task (a hub of many in
several), so their edits are counted there and only shared ones are written; bitmaps of
fixed size leave most other keys and texts out before these are shuffled.  Full bitmaps or
hubs in several tasks let more through and lose nothing.

Defined cases: A-Z are lower-cased, words are runs of anything but ASCII white space;
fewer than ``WORDS`` words are one shingle of them all; texts without a word (null, empty,
blank) have an empty set, are linked with nothing and are components of their own; equal
texts are linked; repeated rows and doc_ids are documents like others, and a null doc_id
names a component only if all of it have none; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import drop_stored, stored, table, text_or_empty
from .components import components
from .op11_collocations import Bitmap, _add, _blocks, _bucket, bitmap_of
from .op6_near_dedup import compared, edited_pairs, hub_pairs, node_of, shingles
from .words import U, mix, slices, words_of

WORDS, PERCENT = 3, 90
#: Sizes of a band grow by this factor from its first to the next band's first.
BAND = 1.25
#: What a comparison with a hub costs, in rows of keys.
COMPARISON = 40
#: Hashed buckets in which edits are counted: a bitmap of 8 MB.
EDIT_BUCKETS = 1 << 26
#: The same for the keys that several texts have, and for the texts that meet another: 8 and 2 MB.
KEY_BUCKETS, TEXT_BUCKETS = 1 << 26, 1 << 24
_PLACE_BITS = 24
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Schemes:
    """Bands of sizes, and the segments that the scheme of each has, up to some size."""

    def __init__(self, most: int, percent: int):
        self.percent, first = percent, [1]
        while first[-1] <= most:
            first.append(max(first[-1] + 1, int(first[-1] * BAND)))
        self.first = np.array(first, np.int64)
        largest = self.first[1:] - 1
        both = largest + 100 * largest // percent
        self.segments = (100 - percent) * both // (100 + percent) + 1

    def of(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The band of every size, and whether it may be the larger set in the scheme below."""
        band = np.searchsorted(self.first, size, side="right") - 1
        smallest = -(-self.percent * size // 100)  # of the sets that it may be linked with
        return band, smallest < self.first[band]


def _salt(band: np.ndarray) -> np.ndarray:
    return mix((band.astype(U) + U(1)) * U(0x9FB21C651E98DF25))


def subset_keys(of: np.ndarray, element: np.ndarray, band: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all segments of sets 0, 1...: the first key of each set and the keys; then, for
    each element, the number of its key, and the key of its segment without it.

    ``of`` and ``element``: the sets' elements; ``band`` and ``segments`` of each set.
    """
    first = np.cumsum(segments) - segments
    value = mix(element + U(0x9E3779B97F4A7C15))
    at = first[of] + (mix(element ^ _salt(band)[of]) % segments[of].astype(U)).astype(np.int64)
    total = np.zeros(int(segments.sum()), U)
    np.add.at(total, at, value)
    number = np.arange(len(total)) - np.repeat(first, segments)
    place = mix(np.repeat(_salt(band), segments) + number.astype(U))
    return first, mix(total + place), at, mix(total[at] - value + place[at])


def _members(size: np.ndarray, schemes: Schemes) -> tuple[np.ndarray, np.ndarray]:
    """(set, band) of every set in its own scheme and in the one below, by set, its own first."""
    band, lower = schemes.of(size)
    lower &= size > 0
    sets = np.concatenate([np.flatnonzero(size > 0), np.flatnonzero(lower)])
    bands = np.concatenate([band[size > 0], band[lower] - 1])
    order = np.argsort(sets, kind="stable")
    return sets[order], bands[order]


def _elements(sets: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For members 0, 1... with the elements of their ``sets``: (member, number of the element)."""
    n = bounds[sets + 1] - bounds[sets]
    of = np.repeat(np.arange(len(sets)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + bounds[sets][of]


def _sets_of(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows, the bounds of each row's shingles and the shingles."""
    for part in slices(batch, "text", 1 << 20):
        text, shingle, _ = shingles(words_of(part.column("text")), width)
        yield part, np.searchsorted(text, np.arange(part.num_rows + 1)), shingle


def keyed(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, node, n_shingles, band, segments (of the own scheme) and the keys of all segments of
    its one or two schemes, own first, of every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, bounds, shingle in _sets_of(batch, width):
                size = np.diff(bounds)
                schemes = Schemes(int(size.max(initial=1)), percent)
                sets, bands = _members(size, schemes)
                of, number = _elements(sets, bounds)
                segments = schemes.segments[bands]
                _, keys, _, _ = subset_keys(of, shingle[number], bands, segments)
                per_set = np.bincount(sets, segments, part.num_rows).astype(np.int64)
                band = schemes.of(size)[0]
                own = np.where(size > 0, schemes.segments[np.maximum(band, 0)], 0)
                lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_set)])), pa.array(keys.view(np.int64))).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), pa.array(size.astype(np.int64)), pa.array(band.astype(np.int32)), pa.array(own.astype(np.int32)), lists], ["doc_id", "node", "n_shingles", "band", "segments", "keys"])

    return docs.select("doc_id", "node", "text").mapInArrow(run, "doc_id long, node binary, n_shingles long, band int, segments int, keys array<long>")


def deleted(texts: DataFrame, width: int, percent: int, raised) -> DataFrame:
    """(node, key) of the one-deletion neighbours in the segments that have an allowance of 1.

    ``raised``: a broadcast sorted array of their places; there are no more than segments.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = raised.value
        for batch in batches:
            for part, bounds, shingle in _sets_of(batch, width):
                size = np.diff(bounds)
                schemes = Schemes(int(size.max(initial=1)), percent)
                sets, bands = _members(size, schemes)
                of, number = _elements(sets, bounds)
                first, _, at, without = subset_keys(of, shingle[number], bands, schemes.segments[bands])
                hit = np.flatnonzero(np.isin((bands[of] << _PLACE_BITS) + at - first[of], wanted))
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(sets[of[hit]])), pa.array(without[hit].view(np.int64))], ["node", "key"])

    return texts.select("node", "text").mapInArrow(run, "node binary, key long")


def allocation(nodes: DataFrame, met: DataFrame) -> DataFrame:
    """(place, allowance) of the segments whose allowance isn't 0.

    ``met``: place, key and n of the keys of several nodes.  The tables here have a row for
    each segment of a scheme, so they grow with the longest text and not with the corpus.
    """
    own = nodes.groupBy("band").agg(F.max("segments").alias("segments"), F.count("*").alias("nodes"), F.avg("n_shingles").alias("size"))
    places = own.select("nodes", "band", "segments", (F.col("size") / F.col("segments")).alias("subset"), F.explode(F.sequence(F.lit(0), F.col("segments") - 1)).alias("segment"))
    places = places.withColumn("place", F.shiftleft("band", _PLACE_BITS) + F.col("segment"))
    cost = places.join(met.groupBy("place").agg(F.sum(F.col("n") - 1).alias("met")), "place", "left").withColumn("met", F.coalesce("met", F.lit(0)))
    usual = cost.groupBy("band").agg(F.percentile("met", 0.5).alias("usual"))
    scheme = W.partitionBy("band")
    ranked = cost.join(usual, "band").select("place", "segments", (COMPARISON * (F.col("met") - F.col("usual")) > F.col("nodes") * (F.col("subset") + 2)).alias("dear"), F.row_number().over(scheme.orderBy(F.desc("met"), "place")).alias("rank"), F.col("band"))
    traded = ranked.withColumn("trades", F.least(F.sum(F.col("dear").cast("int")).over(scheme), F.floor(F.col("segments") / 2)))
    return traded.select("place", F.when(F.col("rank") <= F.col("trades"), -1).when(F.col("rank") > F.col("segments") - F.col("trades"), 1).alias("allowance")).filter("allowance IS NOT NULL")


def seen(hashes: DataFrame, buckets: int):
    """A broadcast bitmap, of fixed size, of the 64-bit hashes in the one column of ``hashes``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.uint8)
        for batch in batches:
            counts[_bucket(batch.column(0).to_numpy().view(U), buckets)] = 1
        yield from _blocks(counts)

    return hashes.sparkSession.sparkContext.broadcast(bitmap_of(hashes.mapInArrow(count, "block int, at binary, times binary"), 1, buckets))


def keys_among(nodes: DataFrame, keys: DataFrame, buckets: int = KEY_BUCKETS) -> DataFrame:
    """(node, key): of the keys of ``nodes`` all that are in ``keys``, and few others, before they are shuffled."""
    bitmap = seen(keys.select("key"), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bitmap(bitmap.value)
        for batch in batches:
            lists = batch.column("keys")
            key = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            hit = np.flatnonzero(bits.has(key.view(U)))
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(row[hit])), pa.array(key[hit])], ["node", "key"])

    return nodes.select("node", "keys").mapInArrow(run, "node binary, key long")


def texts_of(folded: DataFrame, wanted: DataFrame, buckets: int = TEXT_BUCKETS) -> DataFrame:
    """(node, text) of the nodes in ``wanted`` (node, rep), from one row of ``folded`` each.

    A bitmap of their hashes leaves most other rows out before texts are shuffled.
    """
    bitmap = seen(wanted.select(F.xxhash64("rep", "node")), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bitmap(bitmap.value)
        for batch in batches:
            yield batch.filter(pa.array(bits.has(batch.column("_hash").to_numpy().view(U))))

    some = folded.select("doc_id", "node", "text", F.xxhash64(F.col("doc_id").cast("long"), "node").alias("_hash"))
    some = some.mapInArrow(run, some.schema)
    right = wanted.select(F.col("node").alias("_n"), "rep").hint("merge")
    found = some.join(right, (F.col("node") == F.col("_n")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")
    return stored(found.dropDuplicates(["node"]), "join-texts")


def able(stars: DataFrame, least: float, buckets: int = EDIT_BUCKETS) -> DataFrame:
    """``stars`` without members that can't be linked with another of their hub, and without edits that none shares.

    A member of cost e (``op6_near_dedup``) needs more than e shared edits, or, if it misses
    the hub, more than e less the hub's bound.  Edits are counted by hub in hashed buckets, a
    bitmap of fixed size, so an edit that is shared always counts as such and nothing is
    shuffled by edits; the more edits share buckets, the more members stay.
    """
    c = least / (1 + least)

    def keys(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Of every edit: its hash with its hub's, and its row."""
        lists = batch.column("edits")
        hubs = np.array([int.from_bytes(b[:8], "little") for b in batch.column("b").to_pylist()], U)
        row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
        return mix(lists.flatten().to_numpy().view(U) ^ mix(hubs)[row]), row

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.uint8)
        for batch in batches:
            _add(counts, _bucket(keys(batch)[0], buckets), 2)
        yield from _blocks(counts)

    shared = stars.sparkSession.sparkContext.broadcast(bitmap_of(stars.select("b", "edits").mapInArrow(count, "block int, at binary, times binary"), 2, buckets))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = Bitmap(shared.value)
        for batch in batches:
            hashed, row = keys(batch)
            hit = bits.has(hashed)
            n = np.bincount(row[hit], minlength=batch.num_rows)
            similarity, size, removed, added = (batch.column(k).to_numpy() for k in ("similarity", "size_b", "removed", "added"))
            needed = (1 - c) * removed + c * added - np.where(similarity < least, (1 - 2 * c) * size, 0)
            stay = pa.array(n > needed - 1e-6)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), batch.column("edits").flatten().filter(pa.array(hit)))
            columns = [lists if k == "edits" else batch.column(k) for k in batch.schema.names]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(stay)

    return stored(stars.mapInArrow(keep, stars.schema), "join-able")


def joined(docs: DataFrame, percent: int = PERCENT, width: int = WORDS) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs``."""
    spark = docs.sparkSession
    folded = docs.select("doc_id", F.translate(text_or_empty(), _UPPER, _LOWER).alias("text")).withColumn("node", node_of())
    rows = stored(keyed(folded, width, percent), "join-keyed")
    # One row per distinct text, whatever the number of copies.
    nodes = stored(rows.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("band").alias("band"), F.first("segments").alias("segments"), F.first("keys").alias("keys")), "join-nodes")
    at = F.when(F.col("pos") < F.col("segments"), F.shiftleft("band", _PLACE_BITS) + F.col("pos")).otherwise(F.shiftleft(F.col("band") - 1, _PLACE_BITS) + F.col("pos") - F.col("segments"))
    held = nodes.select("node", "band", "segments", F.posexplode("keys").alias("pos", "key")).select("node", at.alias("place"), "key")
    slim = stored(rows.select("doc_id", "node", "n_shingles"), "join-rows")
    drop_stored(rows)  # the keys are in ``nodes``
    met = stored(held.groupBy("place", "key").agg(F.count("*").alias("n")).filter("n > 1"), "join-met")
    allowed = stored(allocation(nodes, met), "join-allowances")
    raised = sorted(r.place for r in allowed.filter("allowance = 1").select("place").collect())  # fewer than the segments of the longest text's scheme and those below
    shared = met.join(allowed.select("place"), "place", "left_anti").select("key", "n")
    if raised:
        texts = folded.join(nodes.select(F.col("node").alias("_n"), "rep").hint("merge"), (F.col("node") == F.col("_n")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text").dropDuplicates(["node"])
        less = stored(deleted(texts, width, percent, spark.sparkContext.broadcast(np.array(raised))), "join-deleted")
        full = held.join(allowed.filter("allowance = 1").select("place"), "place").select("key", F.lit(1).alias("full"))
        both = full.unionByName(less.select("key", F.lit(0).alias("full"))).groupBy("key").agg(F.count("*").alias("n"), F.max("full").alias("full"))
        shared = shared.unionByName(both.filter("n > 1 AND full = 1").select("key", "n"))
    shared = stored(shared, "join-shared")
    buckets = keys_among(nodes, shared)
    members = stored((buckets.unionByName(less) if raised else buckets).join(shared, "key"), "join-members")
    pairs = stored(hub_pairs(members), "join-pairs")
    edges = None
    if not pairs.isEmpty():
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct().join(nodes.select("node", "rep"), "node")
        texts = texts_of(folded, stored(wanted, "join-wanted"))
        drop_stored(nodes)
        least = percent / 100
        stars = stored(compared(pairs, texts, width, edits=True, least=least), "join-stars")
        edges = stars.filter(F.col("similarity") >= least).select("a", "b")
        more = stored(edited_pairs(able(stars, least), stored(components(edges), "join-labels"), least), "join-edited")
        if not more.isEmpty():
            edges = edges.union(stored(compared(more, texts, width), "join-more").filter(F.col("similarity") >= least).select("a", "b"))
    named = slim
    if edges is not None:
        named = named.join(stored(components(edges), "join-components"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    else:
        named = named.withColumn("label", F.col("node"))
    named = stored(named, "join-named")
    groups = stored(named.filter("n_shingles > 0").groupBy("label").agg(F.min("doc_id").alias("component_id")), "join-groups")
    linked = named.filter("n_shingles > 0").join(groups, "label").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(named.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


def oracle() -> str:
    return rf"""
WITH RECURSIVE t AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
u AS MATERIALIZED (SELECT w, min(doc_id) AS rep FROM t WHERE len(w) > 0 GROUP BY w),
s AS MATERIALIZED (
  SELECT DISTINCT rep, array_to_string(w[i : i + {WORDS - 1}], ' ') AS g
  FROM (SELECT rep, w, unnest(range(1, greatest(len(w) - {WORDS - 2}, 1) + CASE WHEN len(w) < {WORDS} THEN 1 ELSE 0 END)) AS i FROM u)),
n AS MATERIALIZED (SELECT rep, count(*)::BIGINT AS n FROM s GROUP BY rep),
x AS MATERIALIZED (SELECT rep, g, n FROM s JOIN n USING (rep)),
e AS MATERIALIZED (
  SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep AND 100 * a.n >= {PERCENT} * b.n AND 100 * b.n >= {PERCENT} * a.n
  GROUP BY a.rep, b.rep HAVING 100 * count(*) >= {PERCENT} * (any_value(a.n) + any_value(b.n) - count(*))),
sides AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT rep, rep AS other FROM u UNION SELECT r.rep, sides.b FROM r JOIN sides ON sides.a = r.other),
c AS (SELECT rep, min(other) AS component_id FROM r GROUP BY rep)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c.component_id, t.doc_id) AS component_id
FROM t LEFT JOIN u ON u.w = t.w LEFT JOIN n ON n.rep = u.rep LEFT JOIN c ON c.rep = u.rep
"""


QUERIES = {"op13_jaccard_join": op13_jaccard_join}
ORACLES = {"op13_jaccard_join": oracle()}

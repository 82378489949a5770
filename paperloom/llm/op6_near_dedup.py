"""Near-duplicate documents by DartMinHash signatures and banded joining.

A document is a weighted set of its ``WORDS``-word shingles.  Darts are thrown into
the plane (weight, rank) of every element by hashes of the element alone, at one dart
per unit of area and in regions of doubling rank; a dart counts if it lands under the
element's weight.  Each dart has a coordinate of the signature, and each coordinate
keeps its earliest (lowest rank) dart.  Two sets agree on a coordinate with the
probability of their weighted Jaccard similarity.  Only as much of the rank axis is
looked at as fills all coordinates, about k ln k darts whatever the document's length.

Documents with equal texts are one node.  Signatures are cut into ``BANDS`` bands; in
every bucket of equal bands each member is compared with one hub, exactly, by its
shingles; the hub is the member that meets most others in all its buckets, so a group's
original serves nearly all of it.

Links between members that miss their hub's similarity are found without pairing them.
A member z is its hub h with r(z) shingles removed and a(z) added.  For a similarity T
let c = T / (1 + T) and e(z) = (1 - c) r(z) + c a(z); z is linked to h just when
e(z) <= (1 - 2c) |h|, and x is linked to y just when they share at least
e(x) + e(y) - (1 - 2c) |h| of these edits.  So a y that misses h shares over e(x) of the
edits of any x it is linked to.  Edits that no other member of the hub has can't be
shared: an x with no more than e(x) others has no such link, and of those others all but
e(x) of the rarest are enough to meet every y by equality.  Members of one component
aren't paired, nor those that are too far from the hub for any that they could meet.  What
meets is compared exactly.

Defined cases: fewer than ``WORDS`` words are one shingle of them all; texts without a
word (null, empty, blank) have no shingle and are classes of their own; a null doc_id
is carried along and never names a class unless all its class have none; equal doc_ids of
different texts don't join their classes; repeated rows are copies; other columns of
``docs`` are not read by ``classes`` and come through ``keep_one`` whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored, table, text_or_empty
from .components import components
from .words import U, Words, mix, runs, slices, window_hashes, words_of

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
#: Height of the first region of ranks; each further one ends at twice the rank.
FIRST_RANK = 1 / 16
#: Edits that the members of one hub may have together to be held in one task: 32 MB.
GROUP_EDITS = 1 << 22


def shingles(w: Words, width: int = WORDS, weighted: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight), sorted by text: distinct shingles of every text."""
    starts, text = runs(w.first, width)
    found, of = [window_hashes(w.hash, starts, width)], [text]
    count = np.diff(w.first)
    for n in range(1, width):
        short = np.flatnonzero(count == n)
        found.append(window_hashes(w.hash, w.first[:-1][short], n, seed=n))
        of.append(short)
    shingle, text = np.concatenate(found), np.concatenate(of)
    order = np.lexsort((shingle, text))
    shingle, text = shingle[order], text[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    first = np.flatnonzero(new)
    weight = np.diff(np.append(first, len(text))) if weighted else np.ones(len(first), np.int64)
    return text[first], shingle[first], weight


def _poisson(area: float) -> np.ndarray:
    """Bounds of 64-bit hashes by which a region of this area has 0, 1, 2... darts."""
    p = [math.exp(-area)]
    while len(p) < area or p[-1] > 1e-19:
        p.append(p[-1] * area / len(p))
    return (np.minimum(np.cumsum(p), 1 - 2**-53) * 2.0**64).astype(U)


_TABLES: dict[float, np.ndarray] = {}


def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """The n x k signatures; texts without elements have zeros."""
    best = np.full(n * k, np.inf)
    out = np.zeros(n * k, U)
    open_ = np.zeros(n, bool)
    open_[text] = True
    low, high, level = 0.0, FIRST_RANK, 0
    while open_.any():
        mask = open_[text]
        t, e, x = text[mask], element[mask], weight[mask]
        nu = 0
        while len(t):  # weights in [2**nu - 1, 2**(nu + 1) - 1)
            width = float(1 << nu)
            area = width * (high - low)
            if area not in _TABLES:
                _TABLES[area] = _poisson(area)
            salt = U(((level << 8 | nu) + 1) * 0xA24BAED4963EE407 % (1 << 64))
            region = mix(e ^ salt)
            darts = np.searchsorted(_TABLES[area], region, side="right")
            hit = np.flatnonzero(darts)
            i = np.repeat(hit, darts[hit])
            number = np.arange(len(i)) - np.repeat(np.cumsum(darts[hit]) - darts[hit], darts[hit])
            dart = mix(region[i] + (number.astype(U) + U(1)) * U(0x9FB21C651E98DF25))
            rank = low + (high - low) * ((dart >> U(11)).astype(np.float64) / 2**53)
            second = mix(dart ^ U(0xC2B2AE3D27D4EB4F))
            under = (width - 1) + width * ((second >> U(24)).astype(np.float64) / 2**40) < x[i]
            key = t[i] * k + (second & U(0xFFFFFF)).astype(np.int64) % k
            key, rank, dart = key[under], rank[under], dart[under]
            np.minimum.at(best, key, rank)
            won = rank == best[key]
            out[key[won]] = dart[won]
            more = x > 2 * width - 1
            t, e, x = t[more], e[more], x[more]
            nu += 1
        filled = np.isfinite(best).reshape(n, k).all(axis=1)
        open_ &= ~filled
        low, high, level = high, high * 2, level + 1
    return out.reshape(n, k)


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    n = len(signature)
    flat = signature.reshape(-1)
    starts = (np.arange(n)[:, None] * (bands * rows) + np.arange(bands) * rows).reshape(-1)
    return mix(window_hashes(flat, starts, rows).reshape(n, bands) + np.arange(1, bands + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def node_of(column: str = "text"):
    return F.unhex(F.md5(text_or_empty(column)))


def signed(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = WORDS, weighted: bool = False) -> DataFrame:
    """doc_id, node and the keys of its bands (null without words) for every row of ``docs``."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                w = words_of(part.column("text"))
                text, shingle, weight = shingles(w, width, weighted)
                n = part.num_rows
                keys = bands_of(signatures(text, shingle, weight, n, bands * rows), bands, rows).view(np.int64)
                empty = np.diff(w.first) == 0
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * bands), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), pc_null(lists, empty)], ["doc_id", "node", "bands"])

    def pc_null(lists: pa.ListArray, empty: np.ndarray) -> pa.Array:
        import pyarrow.compute as pc

        return pc.if_else(pa.array(~empty), lists, pa.scalar(None, lists.type))

    return docs.select("doc_id", node_of().alias("node"), text_or_empty().alias("text")).mapInArrow(sign, "doc_id long, node binary, bands array<long>")


def shared_edits(group: list[tuple], least: float) -> list[tuple]:
    """The rows (a, b, similarity, size_b, removed, added, edits) of all members of one hub, of
    their edits only those that another has; none if no other can be linked with the member.

    x and y are linked just when they share e(x) + e(y) - (1 - 2c) |h| edits, and neither can
    share more than it has left; who can reach that with nobody goes, and leaves the others fewer.
    """
    if not group:
        return group
    c = least / (1 + least)
    similarity, size, removed, added = (np.array([g[k] for g in group]) for k in range(2, 6))
    cost, bound, missed = (1 - c) * removed + c * added, (1 - 2 * c) * size, similarity < least
    edit = np.concatenate([g[6] for g in group])
    row = np.repeat(np.arange(len(group)), [len(g[6]) for g in group])
    n = len(group)
    for _ in range(4):
        if len(edit):
            _, at, count = np.unique(edit, return_inverse=True, return_counts=True)
            both = count[at] > 1
            edit, row = edit[both], row[both]
        has = np.bincount(row, minlength=n)
        able = cost[:, None] + cost - bound <= np.minimum(has[:, None], has) + 1e-6
        able &= missed[:, None] | missed
        np.fill_diagonal(able, False)
        stay = (able.any(axis=1))[row]
        if stay.all():
            break
        edit, row = edit[stay], row[stay]
    ends = np.searchsorted(row, np.arange(n + 1))
    return [(*g[:6], edit[ends[i] : ends[i + 1]]) for i, g in enumerate(group)]


def compared(pairs: DataFrame, texts: DataFrame, width: int = WORDS, weighted: bool = False, edits: bool = False, per_copy: int = 500, least: float | None = None) -> DataFrame:
    """(a, b, similarity, size_b, removed, added) of pairs (a, b) of nodes, exact by their shingles.

    ``texts``: stored rows node, text.  A hub's text goes once to every ``per_copy`` of its
    members, ahead of them; ``edits`` adds the hashes of the shingles of b that a lacks and
    of those it adds.  Repeated shingles are told apart by their number when ``weighted``.
    With ``least`` the members of a hub that has one copy, which meet here in one task, give
    only their ``shared_edits``; those of a hub with more copies give all their edits, as do
    those that have over ``GROUP_EDITS`` together.
    """

    def sets(w: Words) -> tuple[np.ndarray, np.ndarray]:
        text, shingle, weight = shingles(w, width, weighted)
        if weighted:
            text, number = np.repeat(text, weight), np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
            shingle = mix(np.repeat(shingle, weight) + number.astype(U) * U(0x9E3779B97F4A7C15))
            order = np.lexsort((shingle, text))
            text, shingle = text[order], shingle[order]
        return text, shingle

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, group, whole, held = np.zeros(0, U), [], False, 0
        ready: list[tuple] = []

        def given() -> pa.RecordBatch:
            *columns, changed = zip(*ready, strict=True)
            arrays = [pa.array(c, k) for c, k in zip(columns, [pa.binary(), pa.binary(), pa.float64(), pa.int64(), pa.int64(), pa.int64()], strict=True)]
            if edits:
                offsets = np.concatenate([[0], np.cumsum([len(c) for c in changed])]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(changed).view(np.int64))))
            ready.clear()
            return pa.RecordBatch.from_arrays(arrays, ["a", "b", "similarity", "size_b", "removed", "added"] + ["edits"] * edits)

        for batch in batches:
            for part in slices(batch, "text"):
                text, shingle = sets(words_of(part.column("text")))
                bounds = np.searchsorted(text, np.arange(part.num_rows + 1))
                a, b, copies = (part.column(k).to_pylist() for k in ("a", "b", "_copies"))
                for i in range(part.num_rows):
                    x = shingle[bounds[i] : bounds[i + 1]]
                    if a[i] is None:
                        ready += shared_edits(group, least) if whole else group
                        hub, group, whole, held = x.copy(), [], least is not None and copies[i] == 1, 0
                        continue
                    common = len(np.intersect1d(x, hub, assume_unique=True))
                    changed = np.concatenate([np.setdiff1d(hub, x, assume_unique=True), np.setdiff1d(x, hub, assume_unique=True)]) if edits else None
                    group.append((a[i], b[i], common / max(1, len(x) + len(hub) - common), len(hub), len(hub) - common, len(x) - common, changed))
                    held += len(hub) + len(x) - 2 * common
                    whole &= held <= GROUP_EDITS
                if not whole:
                    ready += group
                    group = []
                if ready:
                    yield given()
        ready += shared_edits(group, least) if whole else group
        if ready:
            yield given()

    schema = "a binary, b binary, similarity double, size_b long, removed long, added long" + ", edits array<long>" * edits
    # Texts grow with the corpus, so they are not broadcast at any size.  The counts are stored, so that the joins below are of plain exchanges and Spark can split the rows of a hot hub.
    copies = stored(pairs.groupBy("b").agg(F.ceil(F.count("*") / F.lit(per_copy)).cast("int").alias("_copies")), "near-copies")
    member = pairs.join(copies, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("_copies")).cast("int").alias("_salt")).join(texts.select(F.col("node").alias("a"), "text").hint("merge"), "a").select("a", "b", "_salt", F.lit(None).cast("int").alias("_copies"), "text")
    hubs = texts.select(F.col("node").alias("b"), "text").hint("merge").join(copies, "b").select(F.lit(None).cast("binary").alias("a"), "b", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)).alias("_salt"), "_copies", "text")
    n = max(2, shuffle_partitions(pairs.sparkSession))
    dealt = member.unionByName(hubs).repartition(n, "b", "_salt").sortWithinPartitions("b", "_salt", F.col("a").asc_nulls_first())
    return dealt.select("a", "b", "_copies", "text").mapInArrow(compare, schema)


def hub_pairs(members: DataFrame) -> DataFrame:
    """(a, b): every member of a bucket (key, node, n members) with the bucket's hub."""
    met = members.groupBy("node").agg(F.sum("n").alias("met"))
    placed = stored(members.join(met, "node"), "near-placed")
    hubs = placed.groupBy("key").agg(F.max(F.struct("met", "node")).alias("hub")).select("key", F.col("hub.node").alias("b"))
    return placed.join(hubs, "key").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()


def edited_pairs(stars: DataFrame, label: DataFrame, threshold: float) -> DataFrame:
    """(a, b): members of one hub, of different components, that may be linked though one misses the hub.

    ``stars``: stored rows of ``compared`` with edits, b the hub; ``label``: node and label
    of the linked nodes.  Within one component nothing is paired: the members of an edit's
    largest component meet only those of its other components.
    """
    c = threshold / (1 + threshold)
    missed = F.col("similarity") < threshold
    open_ = stars.groupBy("b").agg(F.count("*").alias("k"), F.max(missed).alias("m")).filter("k > 1 AND m").select("b")
    open_ = stored(open_, "near-open")
    cost = (1 - c) * F.col("removed") + c * F.col("added")
    bound = (1 - 2 * c) * F.col("size_b")
    named = stars.join(label.withColumnsRenamed({"node": "a", "label": "l"}), "a", "left").withColumn("l", F.coalesce("l", "a"))
    rows = named.join(open_, "b").select("a", "b", "l", missed.alias("missed"), cost.alias("cost"), bound.alias("bound"), F.explode("edits").alias("edit"))
    # By edit: its members by component, then the members in all, the components and the largest of them.
    by_label = rows.groupBy("b", "edit", "l").agg(F.count("*").alias("n"))
    often = by_label.groupBy("b", "edit").agg(F.sum("n").alias("f"), F.count("*").alias("labels"), F.max(F.struct("n", "l"))["l"].alias("top")).filter("f > 1")
    often = stored(often, "near-often")
    # Per member all its shared edits, rarest first: at most the shingles of one text and its hub.
    edit = F.struct("f", "edit", (F.col("labels") > 1).alias("open"), (F.col("l") == F.col("top")).alias("top"))
    by_member = rows.join(often, ["b", "edit"]).groupBy("a", "b", "l", "cost", "bound", "missed").agg(F.array_sort(F.collect_list(edit)).alias("es"))
    held = stored(by_member.withColumn("s", F.size("es")), "near-shared")
    prefix = F.slice("es", F.lit(1), F.greatest(F.lit(1), F.col("s") - F.floor(F.col("cost") - 1e-6).cast("int")))
    unpacked = ["e.edit", "e.top"]
    probe = held.filter(F.col("s") > F.col("cost") - 1e-6).select(F.col("a").alias("x"), "b", "bound", F.col("l").alias("lx"), F.col("cost").alias("cx"), F.col("s").alias("sx"), F.explode(F.filter(prefix, lambda e: e["open"])).alias("e")).select("x", "b", "bound", "lx", "cx", "sx", *unpacked)
    other = held.filter("missed").select(F.col("a").alias("y"), "b", F.col("l").alias("ly"), F.col("cost").alias("cy"), F.col("s").alias("sy"), F.explode(F.filter("es", lambda e: e["open"])).alias("e")).select("y", "b", "ly", "cy", "sy", *unpacked)
    # Neither can share more edits than it has, so most members can't reach what the pair would
    # cost even with the cheapest that they could meet here, and aren't joined.
    best = stored(other.groupBy("b", "edit").agg(F.min("cy").alias("cy_all"), F.min(F.when(~F.col("top"), F.col("cy"))).alias("cy_rest"), F.max("sy").alias("sy_all")), "near-cheapest")
    cheapest = F.when(F.col("top"), F.col("cy_rest")).otherwise(F.col("cy_all"))
    probe = probe.join(best, ["b", "edit"]).filter(F.col("cx") + cheapest - F.col("bound") <= F.least("sx", "sy_all") + 1e-6).drop("cy_all", "cy_rest", "sy_all")
    able = (F.col("lx") != F.col("ly")) & (F.col("cx") + F.col("cy") - F.col("bound") <= F.least("sx", "sy") + 1e-6)
    met = None
    for mine, theirs in (("NOT top", "TRUE"), ("top", "NOT top")):
        some = probe.filter(mine).drop("top").join(other.filter(theirs).drop("top"), ["b", "edit"]).filter(able).select("x", "y")
        met = some if met is None else met.unionByName(some)
    return met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def classes(docs: DataFrame, threshold: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, width: int = WORDS, weighted: bool = False) -> DataFrame:
    """doc_id, node, label (of the class; null without words), class_id (its least doc_id) and class_size."""
    rows_ = stored(signed(docs, bands, rows, width, weighted), "near-signed")
    with_words = rows_.filter("bands IS NOT NULL")
    # One row per distinct text, whatever the number of copies.
    nodes = stored(with_words.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "near-nodes")
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    members = stored(buckets.join(shared, "key"), "near-members")
    wanted = stored(members.select("node").distinct().join(nodes.select("node", "rep"), "node"), "near-wanted")
    texts = docs.select("doc_id", node_of().alias("node"), text_or_empty().alias("text")).withColumnRenamed("node", "n_")
    # One row for each text that meets another: it grows with the corpus and is not broadcast at any size.
    found = texts.join(wanted.hint("merge"), (F.col("n_") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("rep"))).select("node", "text")
    held = stored(found.dropDuplicates(["node"]), "near-texts")

    edges = None
    pairs = stored(hub_pairs(members), "near-pairs")
    if not pairs.isEmpty():
        stars = stored(compared(pairs, held, width, weighted, True), "near-stars")
        edges = stars.filter(F.col("similarity") >= threshold).select("a", "b")
        more = stored(edited_pairs(stars, stored(components(edges), "near-labels"), threshold), "near-edited")
        if not more.isEmpty():
            found = stored(compared(more, held, width, weighted), "near-more")
            edges = edges.union(found.filter(F.col("similarity") >= threshold).select("a", "b"))
    named = rows_.select("doc_id", "node", F.col("bands").isNotNull().alias("_words"))
    if edges is not None:
        named = named.join(stored(components(edges), "near-components"), "node", "left")
    else:
        named = named.withColumn("label", F.lit(None).cast("binary"))
    named = stored(named.withColumn("label", F.when(F.col("_words"), F.coalesce("label", "node"))), "near-named")
    groups = named.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    alone = named.filter("label IS NULL").select("doc_id", "node", "label", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return named.join(stored(groups, "near-groups"), "label").select("doc_id", "node", "label", "class_id", "class_size").unionByName(alone)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without all but one document of every class: of its least doc_id, and of
    the rows with that id one of the least node.

    A class is known by its label, so classes whose doc_ids are null or equal stay apart.
    """
    found = stored(classes(docs, **options).filter("class_size > 1"), "near-classes")
    # One row per class: null ids come last, as they name no class.
    named = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "node")
    stays = stored(found.groupBy("label").agg(F.min(named).alias("_s")).select(F.col("label").alias("_label"), F.col("_s.doc_id").alias("_i"), F.col("_s.node").alias("_m")), "near-stays")
    # A node has one label, so these are one row for each distinct text in a class of several rows.
    marks = stored(found.select("node", "label").distinct().withColumnRenamed("node", "_n").join(stays, F.col("label") == F.col("_label")).select("_n", "_label", "_i", "_m"), "near-marks")
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), node_of().alias("_node"))
    marked = rows.join(marks.hint("merge"), F.col("_node") == F.col("_n"), "left")
    kept = marked.filter("_n IS NULL").select("_row.*")
    one = marked.filter((F.col("_node") == F.col("_m")) & F.col("_id").eqNullSafe(F.col("_i"))).dropDuplicates(["_label"]).select("_row.*")
    return kept.unionByName(one)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


QUERIES = {"op6_near_dedup": op6_near_dedup}
ORACLES: dict[str, str] = {}

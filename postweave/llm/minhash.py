"""MinHash near-dedup: fast similarity sketching, banding, exact verification.

A document's set holds its distinct five-word shingles (A-Z lower-cased, hashed to 64 bits).

Sketch. Rounds throw every element into one of ``COORDINATES`` bins by hash; a bin keeps the smallest
value of the first round that reaches it. After as many random rounds as there are bins, round
``COORDINATES + b`` puts all elements into bin b, so every coordinate fills for a set of any size.
Coordinates of two sets agree with probability J each and concentrate like independent ones.

Banding. 32 bands of 4 coordinates: sets with J = 0.75 share no band with probability 6e-6. Documents
with equal sets form one class first, so copies cost one bucket entry. Buckets with several classes
become stars around one member; their connected components are the clusters.

Verification. A cluster's full sets meet in one task, or in parts of bounded size, and exact
intersections are computed, over an inverted index of the part, for pairs whose sketches agree in 60 of
128 places (for J = 0.75 that is seven standard deviations below the mean) and that no link connects yet. No pairs leave a task,
only one root for each class. Of a cluster in several parts, some leaders go to every part; what
then is outside the cluster's largest component is compared with every part, so a link between
parts joins its components as well as any other. The work on a cluster that its leaders hold
together grows with its size, not with its square.

Defined cases: null and empty texts, and texts of white space, have the empty set and are linked with
nothing; with fewer than five words the whole sequence is the one shingle. Rows that repeat a document are
in its component and marked alike; rows without an id join components and never name one, unless all rows
of a component lack it: then component_id is null and all are kept. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postweave.llm.common import SPACES, ascii_lower, broadcast_within, stored, text_of

WIDTH = 5
PERCENT = 75
COORDINATES = 128
BAND_ROWS = 4
BANDS = COORDINATES // BAND_ROWS
LEAST_AGREEMENT = 60
LEADERS = 16
#: Shingles (8 bytes each) and sets that one verification task takes together.
PART_SHINGLES = 2_000_000
PART_SETS = 2_000
BROADCAST_BYTES = 48 << 20

_GOLDEN = 0x9E3779B97F4A7C15


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(text: Column) -> Column:
    words = F.btrim(ascii_lower(text), F.lit(SPACES))
    return F.when(words == "", F.array().cast("array<bigint>")).otherwise(
        F.transform(F.split(words, "[\\x20\\x09-\\x0D]+"), lambda w: F.xxhash64(w)))


def shingle_set(words: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a text given as word hashes."""
    words = words.view(np.uint64)
    if len(words) == 0:
        return words
    width = min(WIDTH, len(words))
    total = np.full(len(words) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total = _mix64(total + words[k:len(words) - width + 1 + k])
    return np.unique(total)


def node_of(shingles: np.ndarray) -> bytes:
    """128 bits that name a set."""
    salted = _mix64(shingles + np.uint64(_GOLDEN))
    return int(_mix64(salted).sum()).to_bytes(8, "big") + int(salted.sum()).to_bytes(8, "big")


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The fast similarity sketch of a set that is not empty: COORDINATES values of 32 bits."""
    n, bins = len(shingles), COORDINATES
    best = np.full(bins, np.iinfo(np.uint64).max, dtype=np.uint64)
    missing = np.arange(bins)
    step = min(bins, max(1, -(-bins * 8 // n)))
    for first in range(0, bins, step):
        rounds = np.arange(first, min(first + step, bins), dtype=np.uint64)
        h = _mix64(shingles[None, :] + ((rounds + np.uint64(1)) * np.uint64(_GOLDEN))[:, None])
        # Bin, then round, then value: the first of each bin is what it keeps.
        keys = ((h >> np.uint64(57)) << np.uint64(57)) | (rounds[:, None] << np.uint64(49)) | (h & np.uint64((1 << 49) - 1))
        keys = np.sort(keys.ravel())
        at = np.searchsorted(keys, missing.astype(np.uint64) << np.uint64(57))
        there = at < len(keys)
        there[there] = (keys[at[there]] >> np.uint64(57)).astype(np.int64) == missing[there]
        best[missing[there]] = keys[at[there]]
        missing = missing[~there]
        if len(missing) == 0:
            break
    for b in missing.tolist():
        turn = bins + b
        h = _mix64(shingles + np.uint64((turn + 1) * _GOLDEN % (1 << 64)))
        best[b] = np.uint64(b << 57) | np.uint64(turn << 49) | (h & np.uint64((1 << 49) - 1)).min()
    return (_mix64(best) >> np.uint64(32)).astype(np.uint32)


def bands_of(coordinates: np.ndarray) -> np.ndarray:
    total = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        total = _mix64(total * np.uint64(_GOLDEN) + coordinates[k::BAND_ROWS])
    return total.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per document: _id, _text (hash), _node, _n, _bands."""
    for batch in batches:
        words = batch.column(2)
        flat = words.values.to_numpy(zero_copy_only=False)
        offsets = words.offsets.to_numpy()
        nodes, sizes, bands = [], [], []
        for start, end in zip(offsets[:-1], offsets[1:]):
            own = shingle_set(flat[start:end])
            sizes.append(len(own))
            nodes.append(node_of(own) if len(own) else None)
            bands.append(bands_of(sketch(own)) if len(own) else np.zeros(0, dtype=np.int64))
        stops = np.concatenate([[0], np.cumsum([len(b) for b in bands])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(stops), pa.array(np.concatenate(bands)))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), lists],
            names=["_id", "_text", "_node", "_n", "_bands"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over edges (a, b), by alternating stars.

    Every round makes neighbours point to the smallest node they know, until nothing changes.
    Rounds are written to the shared folder; no set of nodes gathers anywhere."""
    def starred(pairs: DataFrame, up: bool) -> DataFrame:
        both = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a")))
        seen = both if up else both.filter("b <= a")
        least = seen.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = seen.join(least, "a")
        if up:
            out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                least.select("a", F.col("m").alias("b")))
        return out.filter("a <> b").distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    current, before = edges.select("a", "b"), None
    while True:
        current = stored(starred(starred(current, True), False), "stars")
        now = state(current)
        if now == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


class _Overlaps:
    """Exact intersection sizes of one set of a group with all others, over an inverted index."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.k = len(sets)
        sizes = np.array([len(s) for s in sets])
        self.ends = np.cumsum(sizes)
        _, self.terms = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(self.terms, kind="stable")
        self.owners = np.repeat(np.arange(self.k), sizes)[order]
        self.counts = np.bincount(self.terms)
        self.starts = np.cumsum(self.counts) - self.counts

    def of(self, i: int) -> np.ndarray:
        own = self.terms[(self.ends[i - 1] if i else 0):self.ends[i]]
        lengths = self.counts[own]
        begin = np.repeat(self.starts[own] - (np.cumsum(lengths) - lengths), lengths)
        return np.bincount(self.owners[begin + np.arange(len(begin))], minlength=self.k)


def solve(nodes: list[bytes], sets: list[np.ndarray], labels: list | None = None) -> list[bytes]:
    """The smallest node of each set's component under exact links. ``labels``: components known
    so far (equal label: connected)."""
    k = len(nodes)
    known: dict = {}
    comp = np.array([known.setdefault(x, len(known)) for x in labels] if labels else range(k))
    sizes = np.array([len(s) for s in sets])
    marks = np.stack([sketch(s).astype(np.uint8) for s in sets]) if k > 2 else None
    overlaps = None
    for i in range(k - 1):
        rest = np.arange(i + 1, k)
        low, high = np.minimum(sizes[i], sizes[rest]), np.maximum(sizes[i], sizes[rest])
        rest = rest[(comp[rest] != comp[i]) & (100 * low >= PERCENT * high)]
        if marks is not None and len(rest):
            rest = rest[(marks[rest] == marks[i]).sum(axis=1) >= LEAST_AGREEMENT]
        if len(rest) == 0:
            continue
        if len(rest) > 4:
            overlaps = overlaps or _Overlaps(sets)
            both = overlaps.of(i)[rest]
        else:
            both = np.array([_common(sets[i], sets[j]) for j in rest])
        linked = rest[100 * both >= PERCENT * (sizes[i] + sizes[rest] - both)]
        comp[np.isin(comp, comp[linked])] = comp[i]
    least: dict[int, bytes] = {}
    for c, node in zip(comp.tolist(), nodes):
        least[c] = min(least.get(c, node), node)
    return [least[c] for c in comp.tolist()]


def _solved(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame.drop_duplicates("_node")
    sets = [shingle_set(np.asarray(w)) for w in frame["_words"]]
    labels = list(frame["_label"]) if "_label" in frame else None
    return pd.DataFrame({"_cluster": frame["_cluster"], "_node": frame["_node"],
                         "_root": solve(list(frame["_node"]), sets, labels)})


_SOLVED = "_cluster long, _node binary, _root binary"


def _across_parts(rows: DataFrame, part_shingles: int, part_sets: int) -> DataFrame:
    """(_node, _root) of clusters in several parts; rows: _cluster, _parts, _size, _node, _n, _words."""
    turn = F.xxhash64("_node")
    own = F.pmod(turn, F.col("_parts")).cast("int")
    leads = F.pmod(F.xxhash64(turn), F.greatest(F.lit(1), F.floor(F.col("_size") / LEADERS))) == 0
    everywhere = F.sequence(F.lit(0), (F.col("_parts") - 1).cast("int"))
    rows = rows.withColumn("_own", own)
    dealt = rows.withColumn("_part", F.explode(F.when(leads, everywhere).otherwise(F.array("_own"))))
    first = stored(dealt.groupBy("_cluster", "_part").applyInPandas(lambda f: _solved(f), _SOLVED), "parts")
    links = first.select(F.col("_node").alias("a"), F.col("_root").alias("b"))

    def labelled(edges: DataFrame) -> DataFrame:
        roots = components(edges.filter("a <> b").distinct())
        every = first.select("_cluster", "_node").distinct()
        return every.join(roots, every["_node"] == roots["node"], "left").select(
            "_cluster", "_node", F.coalesce("root", "_node").alias("_root"))

    known = stored(labelled(links), "known")
    largest = (known.groupBy("_cluster", "_root").count().groupBy("_cluster")
               .agg(F.max_by("_root", F.struct("count", "_root")).alias("_main")))
    rows = rows.join(known.drop("_cluster").withColumnRenamed("_root", "_label"), "_node").join(
        F.broadcast(largest), "_cluster").withColumn("_away", F.col("_label") != F.col("_main"))
    weights = rows.filter("_away").groupBy("_cluster").agg(F.sum("_n").alias("_loose"), F.count("*").alias("_sets"))
    rows = rows.join(F.broadcast(weights), "_cluster")  # a cluster without any is settled
    groups = F.greatest(F.ceil(F.col("_loose") / part_shingles), F.ceil(F.col("_sets") / part_sets)).cast("int")
    all_groups = F.sequence(F.lit(0), groups - 1)
    own_group = F.pmod(F.xxhash64(F.xxhash64("_node"), F.lit(1)), groups).cast("int")
    pairs = lambda parts, some: F.flatten(F.transform(parts, lambda p: F.transform(
        some, lambda g: F.struct(p.alias("part"), g.alias("group")))))
    cells = F.when(F.col("_away"), F.array_union(pairs(everywhere, F.array(own_group)), pairs(F.array("_own"), all_groups))
                   ).otherwise(pairs(F.array("_own"), all_groups))
    second = rows.withColumn("_cell", F.explode(cells)).withColumn("_part", F.col("_cell.part")).withColumn("_group", F.col("_cell.group"))
    second = second.select("_cluster", "_part", "_group", "_node", "_words", "_label")
    more = stored(second.groupBy("_cluster", "_part", "_group").applyInPandas(lambda f: _solved(f), _SOLVED), "cells")
    return labelled(links.union(more.select("_node", "_root"))).select("_node", "_root")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    part_shingles: int = PART_SHINGLES, part_sets: int = PART_SETS) -> DataFrame:
    """One row per document: id, n_shingles, component_id, kept; and _text, the text's hash."""
    text = text_of(text_col)
    raw = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_text"), text.alias("_raw"))
    signed = stored(raw.select("_id", "_text", word_hashes(F.col("_raw")).alias("_words")).mapInArrow(
        _signed, "_id long, _text long, _node binary, _n long, _bands array<bigint>"), "signed")
    short = F.xxhash64("_node")
    banded = signed.filter("_n > 0").select(short.alias("_short"), F.explode("_bands").alias("_band"))
    shared = banded.groupBy("_band").agg(F.min("_short").alias("_lead"), F.max("_short").alias("_last"))
    shared = stored(shared.filter("_lead < _last").select("_band", "_lead"), "buckets")
    stars = banded.join(broadcast_within(shared, 40, BROADCAST_BYTES), "_band").filter("_short <> _lead")
    clusters = components(stars.select(F.col("_short").alias("a"), F.col("_lead").alias("b")).distinct())
    clusters = clusters.union(clusters.select(F.col("root"), F.col("root")).distinct())
    clusters = stored(clusters.select(F.col("node").alias("_short"), F.col("root").alias("_cluster")), "clusters")

    # One document stands for each class; its full set is read from the texts again.
    classes = signed.filter("_n > 0").groupBy("_node").agg(
        F.min("_id").alias("_least"), F.min(F.struct("_text", "_id")).alias("_one"), F.first("_n").alias("_n"))
    classes = stored(classes.withColumn("_short", short), "classes")
    members = classes.join(broadcast_within(clusters, 32, BROADCAST_BYTES), "_short").select(
        "_cluster", "_node", "_n", "_one._text", "_one._id")
    weights = members.groupBy("_cluster").agg(F.sum("_n").alias("_weight"), F.count("*").alias("_size"))
    weights = weights.withColumn("_parts", F.greatest(
        F.ceil(F.col("_weight") / part_shingles), F.ceil(F.col("_size") / part_sets))).drop("_weight")
    members = stored(members.join(weights, "_cluster"), "members")
    there = broadcast_within(members, 120, BROADCAST_BYTES).withColumnRenamed("_text", "_t").withColumnRenamed("_id", "_i")
    texts = raw.join(there, (raw["_text"] == there["_t"]) & raw["_id"].eqNullSafe(there["_i"]))
    texts = texts.select("_cluster", "_parts", "_size", "_node", "_n", word_hashes(F.col("_raw")).alias("_words"))
    alone = texts.filter("_parts = 1").select("_cluster", "_node", "_words").groupBy("_cluster").applyInPandas(
        lambda f: _solved(f), _SOLVED)
    roots = alone.select("_node", "_root")
    if members.filter("_parts > 1").limit(1).count():
        wide = stored(texts.filter("_parts > 1"), "wide")
        roots = roots.union(_across_parts(wide, part_shingles, part_sets))
    roots = stored(roots, "roots")

    least = roots.join(classes, "_node").groupBy("_root").agg(F.min("_least").alias("_component"))
    named = roots.join(least, "_root").select("_node", "_component")
    labels = classes.join(broadcast_within(stored(named, "named"), 60, BROADCAST_BYTES), "_node", "left").select(
        "_node", F.coalesce("_component", "_least").alias("_component"))
    filled = signed.filter("_n > 0").select("_id", "_text", "_node", "_n").join(labels, "_node").select(
        "_id", "_text", "_n", "_component")
    bare = signed.filter("_n = 0").select("_id", "_text", "_n", F.col("_id").alias("_component"))
    return filled.unionByName(bare).select(
        F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.col("_component").alias("component_id"),
        F.col("_id").eqNullSafe(F.col("_component")).alias("kept"), "_text")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one of each component, the one with the smallest id, with all their
    columns. Of rows that repeat that document all stay; exact dedup comes before.

    Documents that go are few beside those that stay: their keys are broadcast within a checked
    size, else joined."""
    found = near_components(docs, id_col, text_col, **options)
    gone = stored(found.filter("not kept").select(F.col(id_col).alias("_gone"), F.col("_text").alias("_hash")).distinct(), "gone")
    gone = broadcast_within(gone, 40, BROADCAST_BYTES)
    same = docs[id_col].cast("long").eqNullSafe(gone["_gone"]) & (F.xxhash64(text_of(text_col)) == gone["_hash"])
    return docs.join(gone, same, "left_anti")

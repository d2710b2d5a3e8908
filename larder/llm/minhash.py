"""MinHash near-duplicate detection.

One-permutation hashing splits the hash range of a document's word shingles into slots and
keeps the minimum of each; empty slots are filled by optimal densification (each empty slot
probes others by its own fixed random sequence until one that had a value). Bands of the
signature are bucket keys.

Within a bucket only star-shaped candidate edges are made, from a hub to the other members, and
confirmed on full shingle sets. That leaves apart documents that resemble each other more than
they do the hub. So buckets that hold more than one component are taken further: those with common
members join into families, a family is cut into blocks of at most about ``BLOCK`` documents, and tasks compare
two blocks at a time on full sets. They return a spanning set of the links found, never the pairs,
so that what is made stays linear while no pair that met in a bucket is passed over.

Defined results: a null or blank text has an empty set (``n_shingles`` 0) and is linked with
nothing; a row without doc_id takes no part, its component is null and it is kept; rows that
share a doc_id are one node; documents with equal sets are one node while candidates are made.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import bound_batches, cut, release_memory, shared_dir, stored
from larder.llm.components import connected_components, union_find

WORDS = 5
SLOTS = 256
#: Most rows of a band, and the share of pairs at the threshold that all bands together may miss.
ROWS, MISSED = 8, 1e-4
#: Probes of a slot before it takes the next filled slot; one in 1e14 needs more.
PROBES = 4096
#: Words that a task remembers.
WORD_CACHE = 100_000
#: Documents of a block, and columns of a slice of its 0-1 matrix.
BLOCK, SLICE = 768, 2048

_rng = np.random.RandomState(20240607)
_MUL = (_rng.randint(0, 2**62, size=(WORDS, 1), dtype=np.int64).astype(np.uint64) * np.uint64(2)) + np.uint64(1)
_ROW_MUL = (_rng.randint(0, 2**62, size=ROWS, dtype=np.int64).astype(np.uint64) * np.uint64(2)) + np.uint64(1)
_BAND_ADD = _rng.randint(0, 2**62, size=SLOTS // ROWS, dtype=np.int64).astype(np.uint64)
_PROBE = _rng.randint(0, SLOTS, size=(PROBES, SLOTS))
_BAND_ADD = np.concatenate((_BAND_ADD, _rng.randint(0, 2**62, size=SLOTS - SLOTS // ROWS, dtype=np.int64).astype(np.uint64)))
_EDGES = np.arange(SLOTS, dtype=np.uint64) << np.uint64(64 - 8)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, known: dict[bytes, int], words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles (A-Z lower-cased, ASCII white space).

    ``known`` remembers hashes of words; it is the caller's, so that nothing of it outlives a task.
    """
    tokens = (text or "").encode("utf-8", "replace").lower().split()
    if not tokens:
        return np.empty(0, np.uint64)
    if len(known) > WORD_CACHE:
        known.clear()
    try:
        w = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    except KeyError:
        for t in set(tokens).difference(known):
            known[t] = xxhash.xxh3_64_intdigest(t)
        w = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    if len(w) < words:
        return _mixed((w * _MUL[: len(w), 0]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(w)))
    n = len(w) - words + 1
    h = np.zeros(n, np.uint64)
    for i in range(words):
        h += w[i : i + n] * _MUL[i, 0]
    return np.unique(_mixed(h))


def densified(slots: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Fill the empty slots of each row from filled ones by the slot's probe sequence."""
    out = slots.copy()
    r, c = np.nonzero(~filled & filled.any(axis=1, keepdims=True))
    for probe in _PROBE:
        if not len(r):
            return out
        source = probe[c]
        hit = filled[r, source]
        out[r[hit], c[hit]] = slots[r[hit], source[hit]]
        r, c = r[~hit], c[~hit]
    for i, j in zip(r, c, strict=True):
        out[i, j] = slots[i, np.nonzero(filled[i])[0][0]]
    return out


def banding(percent: int) -> tuple[int, int]:
    """Bands and rows of a band: the longest bands that miss few enough pairs at the threshold."""
    return next(((SLOTS // r, r) for r in range(ROWS, 1, -1) if (1 - (percent / 100) ** r) ** (SLOTS // r) <= MISSED), (SLOTS, 1))


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Bucket keys, one row of ``bands`` for each non-empty set."""
    slots, filled = np.zeros((len(sets), SLOTS), np.uint64), np.zeros((len(sets), SLOTS), bool)
    for i, u in enumerate(sets):
        at = np.searchsorted(u, _EDGES)
        inside = at < len(u)
        value = u[np.where(inside, at, 0)]
        filled[i] = inside & ((value >> np.uint64(56)) == np.arange(SLOTS, dtype=np.uint64))
        slots[i] = np.where(filled[i], value, np.uint64(0))
    sig = densified(slots, filled)[:, : bands * rows].reshape(len(sets), bands, rows)
    return _mixed((sig * _ROW_MUL[:rows]).sum(axis=2, dtype=np.uint64) + _BAND_ADD[:bands]).view(np.int64)


_FEATURES = "doc_id long, n_shingles long, set_a long, set_b long, keys array<long>"


def _trimmed(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task that gives its memory back when it ends."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return trimmed


def _features(percent: int):
    bands, rows = banding(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            sets = [shingle_set(t.as_py(), known) for t in batch.column(1)]
            sizes = np.array([len(u) for u in sets], np.int64)
            digests = np.array([np.frombuffer(xxhash.xxh3_128_digest(u.tobytes()), np.int64) for u in sets], np.int64).reshape(-1, 2)
            some = np.flatnonzero(sizes)
            flat = band_keys([sets[i] for i in some], bands, rows).ravel() if len(some) else np.empty(0, np.int64)
            offsets = np.concatenate(([0], np.cumsum(np.where(sizes > 0, bands, 0)))).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(sizes), pa.array(np.ascontiguousarray(digests[:, 0])), pa.array(np.ascontiguousarray(digests[:, 1])), keys], ["doc_id", "n_shingles", "set_a", "set_b", "keys"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own, known = None, np.empty(0, np.uint64), {}
        for batch in batches:
            a, ta, b, tb = (batch.column(i) for i in range(4))
            keep = []
            for i, x in enumerate(a.to_pylist()):
                if x != hub:
                    hub, own = x, shingle_set(ta[i].as_py(), known)
                other = shingle_set(tb[i].as_py(), known)
                both = len(np.intersect1d(own, other, assume_unique=True))
                keep.append(both > 0 and 100 * both >= percent * (len(own) + len(other) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return run


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of slices of their 0-1 matrix."""
    rows = np.repeat(np.arange(len(sets)), [len(u) for u in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    keep = shared[column]
    rows, column = rows[keep], place[column[keep]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    for start in range(0, int(shared.sum()), SLICE):
        lo, hi = np.searchsorted(column, (start, start + SLICE))
        part = np.zeros((len(sets), SLICE), np.float32)
        part[rows[lo:hi], column[lo:hi] - start] = 1
        out += part @ part.T
    return out


def _block_links(percent: int):
    def linked(docs: list[int], comps: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        sizes, comp = np.array([len(u) for u in sets]), np.array(comps)
        both = common_counts(sets)
        near = (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)) & (both > 0) & (comp[:, None] != comp[None, :])
        i, j = np.nonzero(np.triu(near, 1))
        ids = np.array(docs, np.int64)
        # A spanning set of the links is enough for the components.
        found = [(x, y) for x, y in union_find(zip(ids[i].tolist(), ids[j].tolist(), strict=True)).items() if x != y]
        return pa.RecordBatch.from_arrays([pa.array([y for _, y in found], pa.int64()), pa.array([x for x, _ in found], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, docs, comps, sets, known = None, [], [], [], {}
        for batch in batches:
            for family, lo, hi, doc, comp, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (family, lo, hi) != now:
                    if len(docs) > 1:
                        yield linked(docs, comps, sets)
                    now, docs, comps, sets = (family, lo, hi), [], [], []
                docs.append(doc)
                comps.append(comp)
                sets.append(shingle_set(text, known))
        if len(docs) > 1:
            yield linked(docs, comps, sets)

    return run


def minhash_links(docs: DataFrame, features: DataFrame, percent: int) -> DataFrame:
    """Confirmed links ``(a, b)`` between representatives of distinct shingle sets.

    ``docs`` has (doc_id, text), ``features`` one row per distinct set: (doc_id, n_shingles, keys).
    The links suffice for the components: what is already connected is not linked again.
    """
    rows = features.select(F.explode("keys").alias("key"), F.col("doc_id").alias("doc"), F.col("n_shingles").alias("n"))
    full = rows.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo <> hi").select("key")
    live = stored(rows.join(full, "key"), "minhash-buckets")
    texts = stored(docs.join(live.select(F.col("doc").alias("doc_id")).distinct(), "doc_id", "left_semi"), "minhash-texts")
    # The hub of a bucket is its member of least hash, so that buckets with the same members share it.
    hubs = live.groupBy("key").agg(F.min(F.struct(F.xxhash64("doc").alias("h"), "doc", "n")).alias("hub"))
    stars = stored(live.join(hubs.select("key", F.col("hub.doc").alias("hub"), F.col("hub.n").alias("hub_n")), "key"), "minhash-stars")
    pairs = stars.where((F.col("doc") != F.col("hub")) & (100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))).select(F.col("hub").alias("a"), F.col("doc").alias("b")).distinct()
    b_text = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("b_text"))
    a_text = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("a_text"))
    links = cut(pairs.join(b_text, "b").join(a_text, "a").select("a", "a_text", "b", "b_text").mapInArrow(_trimmed(_confirm(percent)), "a long, b long"))
    comps = connected_components(links).withColumnRenamed("node", "doc")
    # What a star leaves apart may still be linked: buckets that hold two components join into families.
    marked = stars.join(comps, "doc", "left").select("key", "doc", "hub", F.coalesce("component", "doc").alias("comp"))
    mixed = marked.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    rest = cut(marked.join(mixed, "key").select("doc", "hub", "comp").distinct())
    families = connected_components(rest, "doc", "hub").select(F.col("node").alias("doc"), F.col("component").alias("family"))
    members = rest.select("doc", "comp").distinct().join(families, "doc")
    sizes = members.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    member = members.join(sizes, "family").join(texts.select(F.col("doc_id").alias("doc"), "text"), "doc")
    block = F.pmod(F.xxhash64("doc"), F.col("blocks"))
    dealt = member.select("family", "doc", "comp", "text", block.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("family", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "doc", "comp", "text")
    more = cut(dealt.repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi").mapInArrow(_trimmed(_block_links(percent)), "a long, b long"))
    return links.union(more)


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Near-duplicate classes of ``docs`` (doc_id, text): one row per input row.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable by links of Jaccard
    similarity >= percent / 100 on 5-word shingle sets) and kept (doc_id = component_id).
    """
    spark = docs.sparkSession
    shared_dir(spark)
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = stored(docs.mapInArrow(_trimmed(_features(percent)), _FEATURES), "minhash-features")
    known = features.where("n_shingles > 0 and doc_id is not null")
    classes = stored(known.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep")), "minhash-classes")
    own = known.join(classes.select(F.col("rep").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"], "left_semi").dropDuplicates(["doc_id", "set_a", "set_b"])
    links = minhash_links(docs, own.select("doc_id", "n_shingles", "keys"), percent)
    # Rows that share a doc_id are one node, whatever their sets.
    same = known.select("doc_id", "set_a", "set_b").join(classes, ["set_a", "set_b"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).where("a <> b")
    comps = connected_components(links.union(same))
    return features.select("doc_id", "n_shingles").join(comps.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"), F.coalesce(F.coalesce("component", "doc_id") == F.col("doc_id"), F.lit(True)).alias("kept")
    )

"""SimHash near-duplicates at a stated similarity of word-shingle sets.

1. Texts of equal shingle sets are one node, so exact copies cost nothing however many there are. Its fingerprint is the
   SimHash of the set.
2. ``BANDS`` keys a node, each over ``DEPTH`` minima of the set, deal the nodes into buckets: two sets of similarity s share
   a bucket with probability 1 - (1 - s^DEPTH)^BANDS, 0.998 at 0.8. Buckets by the bits of the fingerprint itself, as
   for a radius of 3, would have to be far too many: at 0.8 fingerprints differ in about 10 of 64 bits, and in up to 22.
3. In a bucket, fingerprints are compared by bit planes and carry-save counters (``simhash.bucket_links``). Pairs within
   ``RADIUS`` bits are candidates: fewer than one pair in a thousand at 0.8 is beyond it (simulated for sets of 4 to 500).
4. The ``SKETCH`` least hashes of both sets bound their similarity: those of smaller sets are the sets, and of larger
   ones their share is at least ``least`` less four standard deviations. What is left is checked exactly, on whole texts.

First every node is checked against one pivot, the node of its buckets that shares most buckets with others, as the text
that copies were made from does. The comparison of whole buckets then only looks for pairs that are not in one component
yet: others cannot change it. So a large group of near copies costs one check a node, no candidate pair is left out, and
texts that only resemble a group are told apart inside the buckets' tasks, without a row a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlight.llm.common import staged, trimmed
from quadlight.llm.components import connected_components
from quadlight.llm.simhash import _digests, bucket_links, in_tiles, in_whole_buckets

BANDS, DEPTH = 16, 5
#: Ids of texts that are broadcast to find them; for more of them all texts are shuffled once.
MOST_IDS = 1 << 20
RADIUS = 22
SKETCH = 256
SEED = 42
_RNG = np.random.default_rng(SEED)
_FLIP = _RNG.integers(0, 1 << 63, BANDS * DEPTH, dtype=np.uint64)[:, None]
_TIMES = (_RNG.integers(0, 1 << 63, BANDS * DEPTH, dtype=np.uint64) | np.uint64(1))[:, None]


def shingle_set(text: bytes | None, shingle: int) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles, sorted."""
    return np.unique(np.frombuffer(b"".join(_digests(text or b"", shingle, SEED)), ">u8").astype(np.uint64))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The keys (int64) of a shingle set; none of an empty one."""
    from xxhash import xxh64_intdigest

    if not len(hashes):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(hashes), 4096):
        x = (hashes[None, lo : lo + 4096] ^ _FLIP) * _TIMES
        x ^= x >> np.uint64(29)
        np.minimum(least, (x * _TIMES).min(axis=1), out=least)
    return np.array([xxh64_intdigest(m.tobytes()) for m in least.reshape(BANDS, DEPTH)], np.uint64).view(np.int64)


def set_fingerprint(hashes: np.ndarray) -> np.uint64:
    """The SimHash of a shingle set: every bit is the majority of that bit, 0 for the empty set and ties."""
    total = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 14):
        total += np.unpackbits(hashes[lo : lo + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes)).view(">u8").astype(np.uint64)[0]


def _prints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            digests, prints, keys = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.uint64), []
            for i, text in enumerate(batch.column(1)):
                hashes = shingle_set(text.as_py(), shingle)
                digests[i], prints[i] = xxh64_intdigest(hashes.tobytes()), set_fingerprint(hashes)
                keys.append(band_keys(hashes))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests.view(np.int64)), pa.array(prints.view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["id", "digest", "fp", "keys"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).mapInArrow(trimmed(run), "id long, digest long, fp long, keys array<long>")


def _sketches(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, sketch): the first 32 bits of each text's least hashes, sorted, and whether these are all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text in batch.column(1):
                hashes = shingle_set(text.as_py(), shingle)
                found.append(bytes([len(hashes) <= SKETCH]) + (hashes[:SKETCH] >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], ["node", "sketch"])

    return texts.select(F.col("id").alias("node"), "text").mapInArrow(trimmed(run), "node long, sketch binary")


def may_reach(a: bytes, b: bytes, least: float) -> bool:
    """Whether two sketches allow a similarity of ``least``."""
    x, y = np.frombuffer(a, "<u4", offset=1), np.frombuffer(b, "<u4", offset=1)
    if not len(x) or not len(y):
        return len(x) == len(y)
    ends = [z[-1] for z, whole in ((x, a[0]), (y, b[0])) if not whole]
    if ends:  # beyond the end of a sketch nothing is known
        x, y = x[: np.searchsorted(x, min(ends), "right")], y[: np.searchsorted(y, min(ends), "right")]
    both = np.sort(np.concatenate((x, y)))
    shared = int((both[1:] == both[:-1]).sum())
    known = len(both) - shared
    return shared >= (least - (4 * (least * (1 - least) / known) ** 0.5 if ends else 0.0)) * known - 1e-9


def _candidates(buckets: DataFrame, radius: int, least: float, tile: int, owner: str) -> DataFrame:
    """Pairs (a, b) of nodes that share a bucket (t, key, fp, node, c, keys, sketch), are within ``radius`` bits, differ in
    c and may be similar enough. A pair that shares several buckets is looked at in the first."""

    def solve(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        new = np.zeros(len(rows["t"]), bool)
        for k in ("t", "key", "ca", "cb"):
            new[1:] |= rows[k][1:] != rows[k][:-1]
        group, cross = np.cumsum(new), rows["ca"] != rows["cb"]
        found = [np.zeros((2, 0), np.int64)]
        for part in (~cross, cross):
            at = np.flatnonzero(part)
            if len(at) > 1:
                a, b = bucket_links(rows["fp"][at].view(np.uint64), group[at], rows["side"][at] if part is cross else None, radius, rows["c"][at], most=1 << 16)
                keys, bands, sketch, ends = np.stack(rows["keys"][at]), rows["t"][at], rows["sketch"][at], rows["node"][at]
                for lo in range(0, len(a), 1 << 16):
                    x, y = a[lo : lo + (1 << 16)], b[lo : lo + (1 << 16)]
                    first = ~((keys[x] == keys[y]) & (np.arange(BANDS) < bands[x][:, None])).any(axis=1)
                    near = [(i, j) for i, j in zip(x[first].tolist(), y[first].tolist(), strict=True) if may_reach(sketch[i], sketch[j], least)]
                    if near:
                        found.append(np.sort(ends[np.array(near).T], axis=0))
        a, b = np.concatenate(found, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    find = in_whole_buckets(solve)
    cold, hot = in_tiles(buckets.select("t", "key", "fp", "node", "c", "keys", "sketch"), tile, owner)
    pairs = cold.mapInArrow(trimmed(find), "a long, b long")
    return pairs if hot is None else pairs.union(hot.mapInArrow(trimmed(find), "a long, b long"))


def _texts_of(pairs: DataFrame, texts: DataFrame, owner: str) -> DataFrame:
    """The texts (id, text) that ``pairs`` (a, b) speak of."""
    ids = staged(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids", owner)
    ids = F.broadcast(ids) if ids.count() <= MOST_IDS else ids
    return staged(texts.select("id", F.col("text").cast("binary").alias("text")).join(ids, "id", "left_semi"), "texts", owner)


def _similar(pairs: DataFrame, texts: DataFrame, shingle: int, least: float, owner: str) -> DataFrame:
    """The ``pairs`` (a, b) whose texts (id, text) are similar enough. Many pairs may share their b: their rows meet its text
    sorted by it, so its set is made once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, np.ndarray] = {}

        def of(number: int, text: pa.Scalar) -> np.ndarray:
            if number not in seen:
                if len(seen) >= 64:
                    seen.clear()
                seen[number] = shingle_set(text.as_py(), shingle)
            return seen[number]

        first = None  # the set of a pair's first text, whose row stands before the second's
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in (0, 1))
            keep = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                if first is None:
                    first = of(x, batch.column(2)[i])
                    continue
                second = of(y, batch.column(2)[i])
                both = len(np.intersect1d(first, second, assume_unique=True))
                keep[i] = both >= least * (len(first) + len(second) - both)
                first = None
            yield pa.RecordBatch.from_arrays([pa.array(np.array(c, np.int64)[keep]) for c in (a, b)], ["a", "b"])

    # Two rows a pair, one after the other: batches of rows with one text each take half the memory.
    needed = _texts_of(pairs, texts, owner)
    wide = pairs.join(needed.toDF("a", "ta"), "a").join(needed.toDF("b", "tb"), "b")
    return wide.select("a", "b", F.explode(F.array("ta", "tb")).alias("t")).mapInArrow(trimmed(run), "a long, b long")


def near_copy_components(docs: DataFrame, id_col: str, text_col: str = "text", shingle: int = 5, least: float = 0.8, radius: int = RADIUS, tile: int = 1024, owner: str = "") -> DataFrame:
    """(id_col, component_id) of each row; ids are distinct whole numbers.

    Rows are linked if their texts' sets of ``shingle`` words have a Jaccard similarity of at least ``least``; a shorter
    text is one shingle. Null, empty and wordless texts have the empty set and are linked with each other alone.
    ``component_id`` is the smallest id that is reached. An empty table gives an empty result; extra columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    prints = staged(_prints(docs, id_col, text_col, shingle), "sets", owner)
    nodes = staged(prints.groupBy("digest").agg(F.min("id").alias("node"), F.min("fp").alias("fp"), F.min("keys").alias("keys")), "set-nodes", owner)
    dealt = nodes.select("node", "fp", F.posexplode("keys").alias("t", "key"))
    crowded = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    places = F.collect_list(F.struct("t", "key")).alias("places")  # BANDS at most
    shared = staged(dealt.join(crowded, ["t", "key"]).groupBy("node", "fp").agg(F.sum("n").alias("crowd"), places), "shared", owner)
    here = shared.select("node", "fp", "crowd", F.explode("places").alias("x")).select("node", "fp", "crowd", "x.t", "x.key")
    pivots = here.groupBy("t", "key").agg(F.max(F.struct("crowd", "node", "fp")).alias("p"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("p.fp"))) <= radius
    first = here.join(pivots, ["t", "key"]).where(F.col("node") != F.col("p.node")).where(near)
    tried = staged(first.groupBy("node").agg(F.max("p").alias("p")).select(F.col("node").alias("a"), F.col("p.node").alias("b")), "pairs", owner)
    links = staged(_similar(tried, texts, shingle, least, owner), "similar", owner)
    labels = connected_components(links, owner)
    now = shared.join(labels.toDF("node", "component"), "node", "left").withColumn("c", F.coalesce("component", "node"))
    here = now.select("node", "fp", "c", F.explode("places").alias("x")).select("node", "fp", "c", "x.t", "x.key")
    unsettled = here.groupBy("t", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi")
    left = staged(here.join(unsettled, ["t", "key"], "left_semi"), "unsettled", owner)
    if not left.isEmpty():
        ids = left.select(F.col("node").alias("a"), F.col("node").alias("b")).distinct()
        known = staged(_sketches(_texts_of(ids, texts, owner), shingle).join(nodes.select("node", "keys"), "node"), "sketches", owner)
        pairs = _candidates(left.join(known, "node"), radius, least, tile, owner)
        same = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = staged(pairs.join(same, ["a", "b"], "left_anti"), "pairs", owner)
        if not pairs.isEmpty():
            more = staged(_similar(pairs, texts, shingle, least, owner), "similar", owner)
            labels = connected_components(links.union(more), owner)
    named = nodes.join(labels.toDF("node", "component"), "node", "left").select("digest", F.coalesce("component", "node").alias("component_id"))
    return prints.join(named, "digest").select(F.col("id").alias(id_col), "component_id")

"""SimHash near-duplicates by bit-sliced comparison.

1. A fingerprint per document: every bit is the majority of that bit over the XXH64 values of its word shingles.
2. Distinct fingerprints are dealt into buckets by pairs of bit blocks. With ``radius`` 3 and 5 blocks, two
   fingerprints within the radius agree on at least two whole blocks, so some bucket holds both: nothing is lost.
3. In a bucket, the fingerprints stand as 64 vertical bit planes of 64 lanes to a word. A query's distance to 64 lanes
   is counted at once by carry-save counters (ones, twos, and an overflow above the radius), and a word is abandoned
   as soon as all of its lanes have overflowed.
4. Each bucket gives a spanning forest of its links (never all pairs), and the forests are joined into components.

A bucket of more than ``tile`` fingerprints is dealt out as pairs of chunks to many tasks; all of its pairs are still
compared. Equal fingerprints are one node, so exact copies cost nothing however many there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadlight.llm.common import staged, trimmed, word_chunks
from quadlight.llm.components import connected_components

BITS = 64
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Hash values whose bits are counted at a time.
STEP = 1 << 16
#: Crowded buckets whose numbers are broadcast (24 bytes each).
MOST_CROWDS = 1 << 18


def _digests(text: bytes, shingle: int, seed: int) -> Iterator[bytes]:
    """XXH64 (8 bytes, big-endian) of each shingle of a lower-cased text, in parts."""
    from xxhash import xxh64_digest

    rest: list[bytes] = []
    seen = False
    for words in word_chunks(text.lower()):
        words = rest + words
        if len(words) < shingle:
            rest = words
            continue
        seen = True
        yield b"".join([xxh64_digest(b" ".join(t), seed) for t in zip(*(words[i:] for i in range(shingle)))])
        rest = words[len(words) - shingle + 1 :] if shingle > 1 else []
    if not seen and rest:
        yield xxh64_digest(b" ".join(rest), seed)


def many_fingerprints(texts: list[bytes | None], shingle: int = 3, seed: int = 42) -> np.ndarray:
    """The fingerprints (uint64) of UTF-8 texts; 0 for a null or wordless text."""
    sums, n = np.zeros((len(texts), BITS), np.int64), np.zeros(len(texts), np.int64)
    held: list[bytes] = []
    at: list[int] = []
    sizes: list[int] = []

    def count() -> None:
        if held:
            bits = np.unpackbits(np.frombuffer(b"".join(held), np.uint8).reshape(-1, 8), axis=1)
            starts = np.cumsum([0, *sizes[:-1]])
            np.add.at(sums, at, np.add.reduceat(bits, starts, axis=0, dtype=np.int64))
            np.add.at(n, at, sizes)
        for x in (held, at, sizes):
            x.clear()

    filled = 0
    for i, text in enumerate(texts):
        for part in _digests(text or b"", shingle, seed):
            held.append(part)
            at.append(i)
            sizes.append(len(part) // 8)
            filled += sizes[-1]
            if filled >= STEP:
                count()
                filled = 0
    count()
    return np.packbits(2 * sums > n[:, None], axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id_col, fp: long holding the 64 bits) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = many_fingerprints(batch.column(1).to_pylist(), shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], [id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col).cast("binary")).mapInArrow(trimmed(run), f"`{id_col}` {kind}, fp long")


def block_masks(radius: int, agree: int = 2) -> list[int]:
    """Masks of which any two fingerprints within ``radius`` share one: ``agree`` of ``radius + agree`` blocks."""
    n = radius + agree
    edges = [BITS * i // n for i in range(n + 1)]
    block = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(block[i] for i in pick) for pick in combinations(range(n), agree)]


def bucket_links(fp: np.ndarray, group: np.ndarray, side: np.ndarray | None, radius: int, label: np.ndarray | None = None, most: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs (i < j) within ``radius`` whose rows share a group; rows of a group stand together.

    ``side``: None to compare all pairs, else only those with side 0 on the left and side 1 on the right. ``label``: pairs
    of one label are left out. ``most``: words of lanes that are counted at a time.
    """
    n = len(fp)
    lanes = np.concatenate((fp, np.zeros(-n % BITS, np.uint64)))
    words = len(lanes) // BITS
    first = np.searchsorted(group, group, "left")
    last = np.searchsorted(group, group, "right")
    row = np.arange(n)
    start = row + 1 if side is None else np.maximum(row + 1, first)
    queries = row[(start < last) & (True if side is None else side == 0)]
    if not len(queries):
        return row[:0], row[:0]
    planes = np.empty((BITS, words), np.uint64)
    for b in range(BITS):
        planes[b] = np.packbits(((lanes >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8")
    ones = None if side is None else np.packbits(np.concatenate((side, np.zeros(-n % BITS, side.dtype))).astype(np.uint8), bitorder="little").view("<u8")
    out_a, out_b = [], []
    per = (last - 1) // BITS - start // BITS + 1
    total = np.cumsum(per[queries])
    cuts = np.unique(np.concatenate(([0], np.searchsorted(total, np.arange(most, total[-1], most)), [len(queries)])))
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        q = queries[lo:hi]
        qi = np.repeat(q, per[q])
        wi = start[qi] // BITS + (np.arange(len(qi)) - np.repeat(np.cumsum(per[q]) - per[q], per[q]))
        # Lanes outside the query's group or before it count as overflowed from the start.
        low = np.clip(start[qi] - wi * BITS, 0, BITS)
        high = np.clip(last[qi] - wi * BITS, 0, BITS)
        below = lambda k: np.where(k >= BITS, FULL, (np.uint64(1) << np.minimum(k, BITS - 1).astype(np.uint64)) - np.uint64(1))
        over = ~(below(high) & ~below(low))
        if ones is not None:
            over |= ~ones[wi]
        counters = [np.zeros(len(qi), np.uint64) for _ in range(int(radius).bit_length())]
        values = fp[qi]
        for b in range(BITS):
            carry = planes[b][wi] ^ (np.uint64(0) - ((values >> np.uint64(b)) & np.uint64(1)))
            for c in counters:
                c ^= carry
                carry &= ~c
            over |= carry
            if b % 8 == 7:
                keep = over != FULL
                if not keep.all():
                    qi, wi, over, values = qi[keep], wi[keep], over[keep], values[keep]
                    counters = [c[keep] for c in counters]
                if not len(qi):
                    break
        if len(qi):
            hit = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            cell, lane = np.nonzero(hit)
            a, b = qi[cell], wi[cell] * BITS + lane
            near = np.bitwise_count(fp[a] ^ fp[b]) <= radius  # counters of a radius that is no power of two less one
            if label is not None:
                near &= label[a] != label[b]
            out_a.append(a[near])
            out_b.append(b[near])
    if not out_a:
        return row[:0], row[:0]
    return np.concatenate(out_a), np.concatenate(out_b)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row that each of ``n`` rows reaches over the links."""
    label = np.arange(n)
    while True:
        before = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, before):
            return label


def _links_in_order(radius: int, masks: list[int]):
    """Reads rows sorted by bucket and yields the spanning forest of each bucket's links."""
    bit_masks = np.array(masks, np.uint64)

    def solve(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        fp = rows["fp"].view(np.uint64)
        new = np.zeros(len(fp), bool)
        for k in ("t", "key", "ca", "cb"):
            new[1:] |= rows[k][1:] != rows[k][:-1]
        group = np.cumsum(new)
        cross = rows["ca"] != rows["cb"]
        found = []
        for part in (~cross, cross):
            at = np.flatnonzero(part)
            if len(at) < 2:
                continue
            a, b = bucket_links(fp[at], group[at], rows["side"][at] if part is cross else None, radius)
            a, b = at[a], at[b]
            # A pair that several buckets hold is kept in the first alone.
            apart, mine, first = fp[a] ^ fp[b], rows["t"][a], np.ones(len(a), bool)
            for t, m in enumerate(bit_masks):
                first &= (t >= mine) | ((apart & m) != 0)
            found.append((a[first], b[first]))
        a, b = (np.concatenate([f[i] for f in found]) if found else np.zeros(0, np.int64) for i in (0, 1))
        if len(a):
            used, local = np.unique(np.concatenate((a, b)), return_inverse=True)
            label = forest(len(used), local[: len(a)], local[len(a) :])
            child = np.flatnonzero(label != np.arange(len(used)))
            a, b = used[label[child]], used[child]
        return pa.RecordBatch.from_arrays([pa.array(rows["fp"][a]), pa.array(rows["fp"][b])], ["a", "b"])

    return in_whole_buckets(solve)


def in_whole_buckets(solve: Callable[[dict[str, np.ndarray]], pa.RecordBatch], enough: int = 40_000) -> Callable[[Iterator], Iterator]:
    """Reads rows sorted by bucket and tile (t, key, ca, cb) and gives whole buckets to ``solve``, some at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        size = 0
        join = lambda parts: {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append({k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(batch.schema.names)})
            size += batch.num_rows
            if size < enough:
                continue
            rows = join(held)
            last = {k: rows[k][-1] for k in ("t", "key", "ca", "cb")}
            whole = np.zeros(len(rows["t"]), bool)
            for k, v in last.items():
                whole |= rows[k] != v
            held = [{k: v[~whole] for k, v in rows.items()}]
            size = len(held[0]["t"])
            if whole.any():
                yield solve({k: v[whole] for k, v in rows.items()})
        if size:
            yield solve(join(held))

    return run


def in_tiles(dealt: DataFrame, tile: int, owner: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows (t, key, fp and others) with ca, cb and side, repartitioned and sorted for ``in_whole_buckets``: buckets of up to
    ``tile`` rows whole, and what is more in pairs of chunks, all of which meet in some task; None if there are none.

    The numbers of crowded buckets are dealt to the rows by a broadcast join: each stands for over ``tile`` rows, and past
    ``MOST_CROWDS`` of them the rows of a bucket are first dealt over salts.
    """
    rest = [c for c in dealt.columns if c not in ("t", "key")]
    crowd = dealt.groupBy("t", "key").count().where(F.col("count") > tile)
    crowd = staged(crowd.select("t", "key", F.ceil(F.col("count") / tile).cast("int").alias("chunks")), "crowds", owner)
    none, n = F.lit(0), crowd.count()
    if n <= MOST_CROWDS:
        marked = dealt.join(F.broadcast(crowd), ["t", "key"], "left")
    else:
        salted = crowd.select("*", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("_s"))
        marked = dealt.withColumn("_s", F.pmod(F.xxhash64("fp"), F.lit(16)).cast("int")).join(salted, ["t", "key", "_s"], "left").drop("_s")
    cold = marked.where("chunks is null").select("t", "key", none.alias("ca"), none.alias("cb"), none.alias("side"), *rest)
    cold = cold.repartition("t", "key").sortWithinPartitions("t", "key")
    if not n:
        return cold, None
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    hot = marked.where("chunks is not null").select("t", "key", *rest, mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other"))
    hot = hot.select("t", "key", F.least("mine", "other").alias("ca"), F.greatest("mine", "other").alias("cb"), F.when(F.col("mine") > F.col("other"), 1).otherwise(0).alias("side"), *rest)
    return cold, hot.repartition("t", "key", "ca", "cb").sortWithinPartitions("t", "key", "ca", "cb", "side")


def near_links(nodes: DataFrame, radius: int = 3, agree: int = 2, tile: int = 4096, owner: str = "") -> DataFrame:
    """Links (a, b) between distinct fingerprints ``nodes.fp`` that connect all pairs within ``radius``.

    The links are spanning forests: two fingerprints are joined by a path exactly if links of at most ``radius`` bits
    join them. An empty table gives no links.
    """
    masks = block_masks(radius, agree)
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.struct(F.lit(i).cast("short").alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for i, m in enumerate(masks)])
    dealt = nodes.select("fp", F.explode(keys).alias("x")).select("x.t", "x.key", "fp")
    find = _links_in_order(radius, masks)
    cold, hot = in_tiles(dealt, tile, owner)
    links = cold.mapInArrow(trimmed(find), "a long, b long")
    return links if hot is None else links.union(hot.mapInArrow(trimmed(find), "a long, b long"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, seed: int = 42, tile: int = 4096, owner: str = "") -> DataFrame:
    """Every row of ``docs`` with its fingerprint and near-duplicate component.

    Returns (id_col, fp: long, component_id): the smallest id that is reachable over links of at most ``radius``
    differing bits. Null, empty and wordless texts have fingerprint zero and are linked like any other. Rows with a
    repeated id stay apart and share a component if their texts do; null ids are never the smallest (a component of
    null ids alone has a null ``component_id``). Extra columns are ignored; an empty table gives an empty result.
    """
    prints = staged(fingerprints(docs, id_col, text_col, shingle, seed), "prints", owner)
    nodes = staged(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "nodes", owner)
    labels = connected_components(near_links(nodes.select("fp"), radius, tile=tile, owner=owner), owner)
    member = nodes.join(labels.withColumnRenamed("node", "fp"), "fp")
    least = member.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = staged(member.select("fp", "component").join(least, "component").select("fp", "component_id"), "linked", owner)
    names = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    names = staged(names, "names", owner)
    return prints.join(names, "fp").select(id_col, "fp", "component_id")


def hex_fingerprint(fp) -> F.Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
